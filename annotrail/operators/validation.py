"""Validation of one coder against a gold standard.

The confusion table (truth, estimate, n) is the only aggregate over units for
labels and ordered levels; all metrics follow from its at most K * K rows. The
interval metrics take sums over the joined units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annotrail.functions.scalar import pearson, ratio
from annotrail.operators.ratings import complete_cases, ratings_wide
from annotrail.operators.reliability import _crossed, _joined, icc_agreement

LEVELS = ("nominal", "ordinal", "interval")
AVERAGES = ("macro", "micro", "weighted", "none")
ESTIMATE, TRUTH = "estimate", "truth"


def aligned(ratings: DataFrame, estimate: str, truth: str) -> DataFrame:
    """(unit_id, estimate, truth, e, t) for the units that both have coded: texts and numbers."""
    r = ratings.filter(F.col("rater_id").isin(estimate, truth))
    unit = [F.max(F.when(F.col("rater_id") == who, F.col(c))).alias(name) for who, name, c in ((estimate, ESTIMATE, "code"), (truth, TRUTH, "code"), (estimate, "e", "num"), (truth, "t", "num"))]
    return r.groupBy("unit_id").agg(*unit).filter(f"{ESTIMATE} is not null and {TRUTH} is not null")


def confusion(pairs: DataFrame) -> DataFrame:
    """(truth, estimate, n) for the combinations that occur."""
    return pairs.groupBy(TRUTH, ESTIMATE).agg(F.count("*").alias("n"))


def confusion_filled(table: DataFrame) -> DataFrame:
    """The table with zeros for the combinations of levels that don't occur."""
    kinds = table.select(F.explode(F.array(TRUTH, ESTIMATE)).alias("k")).distinct()
    every = kinds.agg(F.sort_array(F.collect_set("k")).alias("ks"))
    grid = every.select(F.explode("ks").alias(TRUTH), "ks").select(TRUTH, F.explode("ks").alias(ESTIMATE))
    return grid.join(table, [TRUTH, ESTIMATE], "left").select(TRUTH, ESTIMATE, F.coalesce("n", F.lit(0)).alias("n"))


def by_class(table: DataFrame) -> DataFrame:
    """class, n_truth, n_estimate, tp, precision, recall, f1 of each class; undefined values are null.

    F1 is null if precision or recall is, and 0 if both are 0.
    """
    zero = F.lit(0).cast("long")
    hit = F.when(F.col(TRUTH) == F.col(ESTIMATE), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col(TRUTH).alias("class"), F.col("n").alias("t"), zero.alias("e"), hit.alias("tp")),
        F.struct(F.col(ESTIMATE).alias("class"), zero.alias("t"), F.col("n").alias("e"), zero.alias("tp")),
    )
    c = table.select(F.inline(sides)).groupBy("class").agg(F.sum("t").alias("n_truth"), F.sum("e").alias("n_estimate"), F.sum("tp").alias("tp"))
    p, r = ratio(F.col("tp"), F.col("n_estimate")), ratio(F.col("tp"), F.col("n_truth"))
    f1 = F.when(p.isNotNull() & r.isNotNull(), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
    return c.select("class", "n_truth", "n_estimate", "tp", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def averaged(classes: DataFrame, average: str) -> DataFrame:
    """One row: precision, recall, f1. Undefined classes are left out of macro and weighted means."""
    if average == "micro":
        same = [ratio(F.sum("tp"), F.sum("n_truth")).alias(c) for c in ("precision", "recall", "f1")]
        return classes.agg(*same)
    if average == "macro":
        return classes.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    if average == "weighted":
        return classes.agg(*[ratio(F.sum(F.col(c) * F.col("n_truth")), F.sum(F.when(F.col(c).isNotNull(), F.col("n_truth")))).alias(c) for c in ("precision", "recall", "f1")])
    raise ValueError(f"average must be one of {', '.join(AVERAGES)}")


def accuracy_kappa(classes: DataFrame) -> DataFrame:
    """One row: n, accuracy, kappa from the table by class."""
    n = F.sum("n_truth")
    seen, chance = ratio(F.sum("tp"), n), ratio(F.sum(F.col("n_truth") * F.col("n_estimate")), n * n)
    return classes.agg(n.alias("n"), seen.alias("accuracy"), ratio(seen - chance, 1 - chance).alias("kappa"))


def level_index(table: DataFrame, order: list[str] | None = None, compat: bool = False) -> DataFrame:
    """(code, level) over the labels of both sides: by ``order``, by value if all are numbers, else by text.

    With ``compat`` always by text, so that "10" comes before "2".
    """
    kinds = table.select(F.explode(F.array(TRUTH, ESTIMATE)).alias("code")).distinct()
    if order is not None:
        place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("code"))
        return kinds.select("code", place.cast("int").alias("level"))
    kinds = kinds.withColumn("num", F.col("code").try_cast("double"))
    numeric = F.count("*").over(W.partitionBy()) == F.count("num").over(W.partitionBy())
    by = W.orderBy("code") if compat else W.orderBy(F.when(F.col("numeric"), F.col("num")), "code")
    return kinds.withColumn("numeric", numeric).select("code", F.row_number().over(by).alias("level"))


def ordinal_metrics(table: DataFrame, order: list[str] | None = None, compat: bool = False) -> DataFrame:
    """One row: n, rho (Spearman), tau (Kendall's tau-b) and mae.

    mae is over values where all labels are numbers and no ``order`` is given, else, and with ``compat``, over level indexes.
    Concordant pairs come from running sums over the grid of levels, K * K rows, not from pairs of cells.
    """
    at = level_index(table, order, compat)
    cells = table.join(at.toDF(TRUTH, "i"), TRUTH).join(at.toDF(ESTIMATE, "j"), ESTIMATE)
    plain = F.lit(order is not None or compat)
    value = [F.when(plain | F.col(c).try_cast("double").isNull(), F.col(k).cast("double")).otherwise(F.col(c).try_cast("double")) for c, k in ((TRUTH, "i"), (ESTIMATE, "j"))]
    all_numbers = F.min((F.col(TRUTH).try_cast("double").isNotNull() & F.col(ESTIMATE).try_cast("double").isNotNull()).cast("int")) == 1
    n = F.sum("n")
    mae = F.when(all_numbers, F.sum(F.col("n") * F.abs(value[0] - value[1]))).otherwise(F.sum(F.col("n") * F.abs(F.col("i") - F.col("j")).cast("double")))
    head = cells.agg(n.alias("n"), ratio(mae, n).alias("mae"))

    grid = confusion_filled(cells.select(F.col("i").alias(TRUTH), F.col("j").alias(ESTIMATE), "n")).toDF("i", "j", "n")
    left = W.partitionBy("i").orderBy("j").rowsBetween(W.unboundedPreceding, -1)
    grid = grid.select("*", F.coalesce(F.sum("n").over(left), F.lit(0)).alias("left"), F.sum("n").over(W.partitionBy("i")).alias("row"), F.sum("n").over(W.partitionBy("j")).alias("col"))
    above = W.partitionBy("j").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    sums = {c: F.coalesce(F.sum(c).over(above), F.lit(0)) for c in ("left", "row", "n")}
    grid = grid.select("*", sums["left"].alias("con"), (sums["row"] - sums["left"] - sums["n"]).alias("dis"), sums["row"].alias("above_i"))
    before = F.coalesce(F.sum("col").over(left), F.lit(0))
    grid = grid.select("*", (F.col("above_i") + (F.col("row") + 1) / F.lit(2.0)).alias("ri"), (before + (F.col("col") + 1) / F.lit(2.0)).alias("rj"))
    w = F.col("n").cast("double")
    mean = (F.sum("n") + 1) / F.lit(2.0)
    big = F.sum(w)
    xy = F.sum(w * F.col("ri") * F.col("rj")) - big * mean * mean
    xx, yy = (F.sum(w * F.col(c) * F.col(c)) - big * mean * mean for c in ("ri", "rj"))
    concord = F.sum(w * (F.col("con") - F.col("dis")))
    # A cell of the grid stands for n units, each tied in truth with row - 1 others.
    tied = [F.sum(w * (F.col(c) - 1)) / 2 for c in ("row", "col")]
    pairs = big * (big - 1) / 2
    rank = grid.agg(ratio(xy, F.sqrt(xx * yy)).alias("rho"), ratio(concord, F.sqrt((pairs - tied[0]) * (pairs - tied[1]))).alias("tau"))
    return _joined([head, rank]).select("n", "rho", "tau", "mae")


def interval_metrics(pairs: DataFrame) -> DataFrame:
    """One row: n, r, mae, rmse, icc of numbers."""
    d = F.col("e") - F.col("t")
    sums = pairs.agg(F.count("*").alias("n"), pearson(F.col("e"), F.col("t")).alias("r"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))
    return _joined([sums, icc_agreement(pairs, ["e", "t"])])


def validate(
    ratings: DataFrame,
    estimate: str,
    truth: str,
    level: str = "nominal",
    average: str = "macro",
    order: list[str] | None = None,
    compat: bool = False,
) -> DataFrame:
    """One row with level, n and the metrics of ``level``; for average "none" the table by class."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {', '.join(LEVELS)}")
    pairs = aligned(ratings, estimate, truth)
    if level == "interval":
        out = interval_metrics(pairs)
    elif level == "ordinal":
        out = ordinal_metrics(confusion(pairs), order, compat)
    else:
        classes = by_class(confusion(pairs))
        if average == "none":
            return classes
        out = _joined([accuracy_kappa(classes), averaged(classes, average), classes.agg(F.count("*").alias("n_classes"))])
    return out.select(F.lit(level).alias("level"), *out.columns)
