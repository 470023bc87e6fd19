"""The older interface: reliability and gold comparison of one wide table of coders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotrail.functions.scalar import ratio
from annotrail.operators.ratings import complete_cases, first_codes, min_coders, wide_to_long
from annotrail.operators.reliability import _joined, alpha_nominal, fleiss_kappa

ICR = ("units_included", "coders", "categories", "percent_unanimous_units", "mean_pairwise_percent_agreement", "mean_pairwise_cohens_kappa", "kripp_alpha_nominal", "fleiss_kappa")


def pairwise(ratings: DataFrame, coders: list[str]) -> DataFrame:
    """(a, b, n, agreement, kappa) of each pair of coders with two units or more in common.

    A unit's codes meet within its row, so a pair of coders takes no join.
    """
    codes = ratings.groupBy("unit_id").agg(*[F.min(F.when(F.col("rater_id") == c, F.col("code"))).alias(f"c{k}") for k, c in enumerate(coders)])
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("x"), F.col(f"c{j}").alias("y")) for i, a in enumerate(coders) for j, b in enumerate(coders) if i < j]
    both = codes.select(F.inline(F.array(*pairs))).filter("x is not null and y is not null")
    cells = both.groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("x").alias("c"), F.col("n").alias("nx"), zero.alias("ny"), F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(zero).alias("same")),
        F.struct(F.col("y").alias("c"), zero.alias("nx"), F.col("n").alias("ny"), zero.alias("same")),
    )
    code = cells.select("a", "b", F.inline(sides)).groupBy("a", "b", "c").agg(*[F.sum(k).alias(k) for k in ("nx", "ny", "same")])
    pair = code.groupBy("a", "b").agg(F.sum("nx").alias("n"), F.sum("same").alias("same"), F.sum(F.col("nx") * F.col("ny")).alias("e")).filter("n >= 2")
    po, pe = ratio(F.col("same"), F.col("n")), ratio(F.col("e"), F.col("n") * F.col("n"))
    return pair.select("a", "b", "n", po.alias("agreement"), ratio(po - pe, 1 - pe).alias("kappa"))


def icr(ratings: DataFrame, coders: list[str], least: int = 2, order: str | None = None) -> DataFrame:
    """One row of reliability over the units with ``least`` codes or more; rates have four decimals."""
    r = min_coders(first_codes(ratings, order), least)
    head = r.agg(F.countDistinct("unit_id").alias("units_included"), F.countDistinct("rater_id").alias("coders"), F.countDistinct("code").alias("categories"))
    unit = r.groupBy("unit_id").agg((F.min("code") == F.max("code")).alias("same"), F.count("*").alias("k")).filter("k >= 2")
    same = unit.agg(F.avg(F.col("same").cast("double")).alias("percent_unanimous_units"))
    pairs = pairwise(r, coders).agg(F.avg("agreement").alias("mean_pairwise_percent_agreement"), F.avg("kappa").alias("mean_pairwise_cohens_kappa"))
    alpha = alpha_nominal(r).toDF("kripp_alpha_nominal")
    whole = complete_cases(r, len(coders))
    fleiss = fleiss_kappa(whole, len(coders))
    enough = whole.agg((F.countDistinct("unit_id") >= 2).alias("rows"), (F.countDistinct("code") >= 2).alias("codes"))
    fleiss = _joined([fleiss, enough]).select(F.when(F.col("rows") & F.col("codes"), F.col("kappa")).alias("fleiss_kappa"))
    out = _joined([head, same, pairs, alpha, fleiss])
    return out.select(*ICR[:3], *[F.round(c, 4).alias(c) for c in ICR[3:]])


def gold(ratings: DataFrame, coders: list[str], truth: str, order: str | None = None) -> DataFrame:
    """(coder_id, n, accuracy, precision_macro, recall_macro, f1_macro) of each other coder on the units the gold has coded.

    Classes are all codes of all coders on those units; means leave undefined classes out.
    """
    r = first_codes(ratings, order)
    true = r.filter(F.col("rater_id") == truth).select("unit_id", F.col("code").alias("t"))
    rest = r.filter(F.col("rater_id") != truth).join(true, "unit_id")
    cells = rest.groupBy(F.col("rater_id").alias("coder_id"), "t", F.col("code").alias("e")).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("t").alias("c"), F.col("n").alias("nt"), zero.alias("ne"), F.when(F.col("t") == F.col("e"), F.col("n")).otherwise(zero).alias("tp")),
        F.struct(F.col("e").alias("c"), zero.alias("nt"), F.col("n").alias("ne"), zero.alias("tp")),
    )
    c = cells.select("coder_id", F.inline(sides)).groupBy("coder_id", "c").agg(*[F.sum(k).alias(k) for k in ("nt", "ne", "tp")])
    p, q = ratio(F.col("tp"), F.col("ne")), ratio(F.col("tp"), F.col("nt"))
    c = c.select("coder_id", "nt", "tp", p.alias("p"), q.alias("r"), F.try_divide(2 * p * q, p + q).alias("f"))
    rates = {"accuracy": ratio(F.sum("tp"), F.sum("nt")), "precision_macro": F.avg("p"), "recall_macro": F.avg("r"), "f1_macro": F.avg("f")}
    return c.groupBy("coder_id").agg(F.sum("nt").alias("n"), *[F.round(v, 4).alias(k) for k, v in rates.items()])


def validate(data: DataFrame, id: str, coder_cols: list[str], min_coders: int = 2, mode: str = "icr", gold_col: str | None = None, output: str = "list", order: str | None = None):
    """Reliability (mode "icr") or comparison with ``gold_col`` (mode "gold") of a table with a column for each coder.

    output "list" gives a dictionary (icr) or the table (gold), "data.frame" long rows (metric, value).
    Of a unit that occurs again the first code counts: by the column ``order``, or the least one where a table has no order.
    """
    if not isinstance(min_coders, int) or min_coders < 2:
        raise ValueError("min_coders must be a whole number of 2 or more")
    if mode not in ("icr", "gold"):
        raise ValueError("mode must be icr or gold")
    missing = [c for c in (id, *coder_cols) if c not in data.columns]
    if missing:
        raise ValueError(f"not in the data: {', '.join(missing)}")
    if len(coder_cols) < 2:
        raise ValueError("two or more coder columns are needed")
    ratings = wide_to_long(data, id, coder_cols, order)
    if mode == "gold":
        if gold_col not in coder_cols:
            raise ValueError("gold must be one of the coder columns")
        return gold(ratings, coder_cols, gold_col, order)
    out = icr(ratings, coder_cols, min_coders, order)
    if output == "data.frame":
        return out.select([F.col(c).cast("double").alias(c) for c in ICR]).unpivot([], list(ICR), "metric", "value")
    row = out.first().asDict()
    if not row["units_included"]:
        return {"message": f"no unit has codes of {min_coders} coders or more"}
    return row
