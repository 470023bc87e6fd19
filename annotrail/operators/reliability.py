"""Agreement of two or more raters.

``compare`` takes ratings and returns one row of statistics, from counts of the
combinations of codes where they are few (``cells``). The single statistics here
need no complete cases: they are arithmetic over counts by unit and code, over
counts by value, or over sums of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annotrail.functions.scalar import pearson, ratio
from annotrail.operators import cells
from annotrail.operators.ratings import complete_cases, encoded, mid_ranks, paired, ratings_wide
from annotrail.session import ship

LEVELS = ("nominal", "ordinal", "interval", "ratio")
#: Different values in a block of the ratio-level disagreement, which is quadratic in them.
BLOCK = 4096


def _joined(parts: list[DataFrame]) -> DataFrame:
    """One-row tables side by side."""
    keyed = [p.withColumn("__one", F.lit(1)) for p in parts]
    return reduce(lambda a, b: a.join(b, "__one"), keyed).drop("__one")


def unit_counts(ratings: DataFrame) -> DataFrame:
    """(unit_id, m, s2): codes of each unit and the sum of squared counts of its different codes."""
    n = ratings.filter("code is not null").groupBy("unit_id", "code").agg(F.count("*").alias("n"))
    return n.groupBy("unit_id").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("s2"))


def percent_agreement(ratings: DataFrame, tolerance: float = 0.0, numeric: bool = False) -> DataFrame:
    """Share of units whose raters agree; numbers agree within ``tolerance``."""
    same = F.max("num") - F.min("num") <= tolerance if numeric else F.min("code") == F.max("code")
    unit = ratings.groupBy("unit_id").agg(same.alias("same"))
    return unit.agg(F.avg(F.col("same").cast("double")).alias("percent_agreement"))


def _pairable(ratings: DataFrame) -> DataFrame:
    """Ratings of units with two codes or more, the only ones that alpha counts."""
    m = F.count("code").over(W.partitionBy("unit_id"))
    return ratings.filter("code is not null").withColumn("m", m).filter("m >= 2")


def alpha_nominal(ratings: DataFrame) -> DataFrame:
    """Krippendorff's alpha for labels, with missing codes; 1 if only one label occurs."""
    r = _pairable(ratings)
    n = r.groupBy("unit_id", "code").agg(F.count("*").alias("n"), F.first("m").alias("m"))
    unit = n.groupBy("unit_id").agg(F.first("m").alias("m"), F.sum(F.col("n") * F.col("n")).alias("s2"))
    seen = unit.agg(F.sum("m").alias("N"), F.sum((F.col("m") * F.col("m") - F.col("s2")) / (F.col("m") - 1)).alias("do"))
    code = r.groupBy("code").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("c2"))
    expected = ratio(F.col("N") * F.col("N") - F.col("c2"), F.col("N") - 1)
    out = F.when(expected == 0, 1.0).otherwise(1 - ratio(F.col("do"), expected))
    return _joined([seen, code]).select(out.alias("alpha_nominal"))


def alpha_interval(ratings: DataFrame, name: str = "alpha_interval") -> DataFrame:
    """Krippendorff's alpha for numbers, from sums alone; centred first, as squares of far values cancel badly."""
    r = _pairable(ratings)
    mean = r.agg(F.avg("num").alias("mean"))
    unit = _crossed(r, mean).withColumn("x", F.col("num") - F.col("mean")).groupBy("unit_id").agg(F.first("m").alias("m"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    do = F.sum(2 * (F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1))
    all_ = unit.agg(do.alias("do"), F.sum("m").alias("N"), F.sum("s").alias("S"), F.sum("q").alias("Q"))
    de = ratio(2 * (F.col("N") * F.col("Q") - F.col("S") * F.col("S")), F.col("N") - 1)
    return all_.select(F.when(F.abs(de) < 1e-300, 1.0).otherwise(1 - ratio(F.col("do"), de)).alias(name))


def alpha_ordinal(ratings: DataFrame) -> DataFrame:
    """Ordinal alpha: interval alpha of the values' mid-ranks over all pairable codes."""
    r = _pairable(ratings)
    counts = r.groupBy("num").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(W.orderBy("num").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    mids = counts.select("num", (before + F.col("k") / F.lit(2.0)).alias("mid"))
    return alpha_interval(r.drop("m").join(mids, "num").withColumn("num", F.col("mid")).drop("mid"), "alpha_ordinal")


def alpha_ratio(ratings: DataFrame) -> DataFrame:
    """Ratio alpha, whose distance is ((a - b) / (a + b)) ** 2.

    The expected distance is over all pairs of different values, however many there are: values are dealt to blocks of about
    ``BLOCK``, and blocks meet blocks, a matrix in memory at a time. No row is made for a pair of values.
    """
    ship(ratings.sparkSession)
    r = _pairable(ratings)
    values = r.groupBy("num").agg(F.count("*").alias("k"))
    blocks = max(1, -(-values.count() // BLOCK))
    block = F.pmod(F.xxhash64("num"), F.lit(blocks)).cast("int")
    rows = values.groupBy(block.alias("i")).agg(F.collect_list("num").alias("x"), F.collect_list(F.col("k").cast("double")).alias("xk"))
    left = rows.withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(blocks - 1))))
    both = left.join(rows.select(F.col("i").alias("j"), F.col("x").alias("y"), F.col("xk").alias("yk")), "j").select("i", "j", "x", "xk", "y", "yk")
    part = both.mapInArrow(_block_distance, "distance double")
    total = values.agg(F.sum("k").alias("N"))
    de = _joined([part.agg(F.sum("distance").alias("d")), total]).select(ratio(F.col("d"), F.col("N") - 1).alias("de"))

    def gap(a: Column, b: Column) -> Column:
        d = F.try_divide(a - b, a + b)
        return F.coalesce(d * d, F.lit(0.0))

    unit = r.groupBy("unit_id").agg(F.collect_list("num").alias("xs"), F.first("m").alias("m"))
    inner = F.aggregate("xs", F.lit(0.0), lambda s, a: s + F.aggregate("xs", F.lit(0.0), lambda t, b: t + gap(a, b)))
    do = unit.agg(F.sum(inner / (F.col("m") - 1)).alias("do"))
    return _joined([de, do]).select(F.when(F.col("de") == 0, 1.0).otherwise(1 - ratio(F.col("do"), F.col("de"))).alias("alpha_ratio"))


def _block_distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted distances between two blocks of values, once for a block with itself and twice for others."""
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            x, xk, y, yk = (batch.column(c)[k].values.to_numpy() for c in ("x", "xk", "y", "yk"))
            total = 0.0
            for at in range(0, len(x), 256):
                a = x[at : at + 256, None]
                both = a + y[None, :]
                d = np.divide(a - y[None, :], both, out=np.zeros(both.shape), where=both != 0)
                total += float(xk[at : at + 256] @ (d * d) @ yk)
            out.append(total * (1 if batch.column("i")[k] == batch.column("j")[k] else 2))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["distance"])


def _crossed(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Rows beside a table of one row."""
    return rows.crossJoin(F.broadcast(one))


def cohen_kappa(ratings: DataFrame, a: str, b: str) -> DataFrame:
    code = ratings.groupBy("code").agg(*[F.count_if(F.col("rater_id") == r).alias(n) for r, n in ((a, "na"), (b, "nb"))])
    chance = code.agg(F.sum(F.col("na") * F.col("nb")).alias("e"), F.sum("na").alias("n"))
    pe = ratio(F.col("e"), F.col("n") * F.col("n"))
    return _joined([chance, percent_agreement(ratings)]).select(ratio(F.col("percent_agreement") - pe, 1 - pe).alias("kappa"))


def fleiss_kappa(ratings: DataFrame, m: int) -> DataFrame:
    """Fleiss' kappa of complete cases."""
    seen = unit_counts(ratings).agg(F.count("*").alias("n"), F.sum("s2").alias("s2"))
    code = ratings.groupBy("code").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("c2"))
    nm = F.col("n") * m
    p, pe = ratio(F.col("s2") - nm, nm * (m - 1)), ratio(F.col("c2"), nm * nm)
    return _joined([seen, code]).select(ratio(p - pe, 1 - pe).alias("kappa"))


def weighted_kappa(wide: DataFrame, a: str, b: str) -> DataFrame:
    """Kappa with squared weights on level indexes; the number of levels cancels, so moments do."""
    x, y = F.col(a), F.col(b)
    seen = F.avg((x - y) * (x - y))
    chance = F.avg(x * x) + F.avg(y * y) - 2 * F.avg(x) * F.avg(y)
    return wide.agg((1 - F.try_divide(seen, chance)).alias("kappa_weighted"))


def kendall_w(ranked: DataFrame, m: int) -> DataFrame:
    """Kendall's W without correction for ties, from rows with ``rank``."""
    unit = ranked.groupBy("unit_id").agg(F.sum("rank").alias("r"))
    n = F.count("*").cast("double")
    return unit.agg(ratio(12 * F.var_pop("r") * n, m * m * (n * n * n - n)).alias("w"))


def mean_pairwise(wide: DataFrame, raters: list[str], name: str) -> DataFrame:
    """Mean correlation over all pairs of raters; null as soon as one is undefined."""
    pairs = paired({r: F.col(f"`{r}`") for r in raters})
    return wide.agg((reduce(lambda s, x: s + x, [pearson(x, y) for x, y in pairs]) / len(pairs)).alias(name))


def icc_agreement(wide: DataFrame, raters: list[str]) -> DataFrame:
    """ICC(A,1): two-way, absolute agreement, single rater."""
    m = len(raters)
    mean = wide.agg((reduce(lambda s, x: s + x, [F.avg(f"`{r}`") for r in raters]) / m).alias("mean"))
    x = _crossed(wide, mean).select(*[(F.col(f"`{r}`") - F.col("mean")).alias(f"x{k}") for k, r in enumerate(raters)])
    xs = [F.col(f"x{k}") for k in range(m)]
    row = reduce(lambda s, c: s + c, xs) / m
    all_ = x.agg(
        F.count("*").cast("double").alias("n"), F.sum(row * row).alias("rr"), F.sum(reduce(lambda s, c: s + c, [c * c for c in xs])).alias("q"),
        *[F.avg(c).alias(f"c{k}") for k, c in enumerate(xs)],
    )
    n, cc = F.col("n"), reduce(lambda s, c: s + c, [F.col(f"c{k}") * F.col(f"c{k}") for k in range(m)])
    ssr, ssc = m * F.col("rr"), n * cc
    msr, msc = ratio(ssr, n - 1), ssc / (m - 1)
    mse = ratio(F.col("q") - ssr - ssc, (n - 1) * (m - 1))
    return all_.select(ratio(msr - mse, msr + (m - 1) * mse + m * (msc - mse) / n).alias("icc"))


def compare(
    ratings: DataFrame,
    raters: list[str],
    level: str = "nominal",
    tolerance: float = 0.0,
    order: list[str] | None = None,
    compat: bool = False,
) -> DataFrame:
    """One row with level, subjects, raters and the statistics of ``level``; undefined ones are null.

    Labels are compared as numbers where the level asks for it: by ``order``, by
    value if all are numbers, else by text. ``tolerance`` counts for numbers only;
    with ``compat`` also for numeric labels at the nominal level, and ratio alpha
    is named alpha_interval.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {', '.join(LEVELS)}")
    m = len(raters)
    found = _from_cells(ratings, raters, level, tolerance, order, compat) if level != "ratio" else None
    if found is not None:
        return found
    r = complete_cases(ratings, m)
    head = r.agg(F.lit(level).alias("level"), (F.count("*") / m).cast("long").alias("subjects"), F.lit(m).alias("raters"))
    if level == "nominal":
        parts = [alpha_nominal(r), cohen_kappa(r, *raters) if m == 2 else fleiss_kappa(r, m)]
        parts += [percent_agreement(r, tolerance, numeric=compat and tolerance > 0)]
        head = head.withColumn("kappa_type", F.lit("Cohen's" if m == 2 else "Fleiss'"))
    elif level == "ordinal":
        coded = encoded(r, order)
        ranked = mid_ranks(coded)
        parts = [alpha_ordinal(coded), kendall_w(ranked, m), mean_pairwise(ratings_wide(ranked, raters, "rank"), raters, "rho")]
        if m == 2:
            parts.append(weighted_kappa(ratings_wide(coded, raters, "num"), *raters))
        parts.append(percent_agreement(coded if order else r, tolerance, numeric=True) if order or not _texts(r) else percent_agreement(r))
    else:
        wide = ratings_wide(r, raters, "num")
        alpha = alpha_interval(r) if level == "interval" else alpha_ratio(r)
        if level == "ratio" and compat:
            alpha = alpha.withColumnRenamed("alpha_ratio", "alpha_interval")
        parts = [alpha, icc_agreement(wide, raters), mean_pairwise(wide, raters, "r"), percent_agreement(r, tolerance, numeric=True)]
    return _joined([head, *parts])


def _from_cells(ratings: DataFrame, raters: list[str], level: str, tolerance: float, order: list[str] | None, compat: bool) -> DataFrame | None:
    """The row from counts of combinations; None if there is none, or too many of them, or codes that ``order`` hasn't."""
    m = len(raters)
    rows = cells.combinations(ratings, raters).limit(cells.MAX_CELLS + 1).toArrow()
    if not 0 < len(rows) <= cells.MAX_CELLS:
        return None
    code = np.stack([rows[f"code{k}"].to_numpy() for k in range(m)], axis=1)
    if order and not set(code.ravel()) <= set(order):
        return None
    num = np.stack([rows[f"num{k}"].to_numpy().astype(float) for k in range(m)], axis=1)
    n = rows["n"].to_numpy().astype(float)
    if level == "interval" and np.isnan(num).any():
        return None
    stats = cells.statistics(code, num, n, level, tolerance, order, compat)
    stats = {k: None if isinstance(v, float) and np.isnan(v) else v for k, v in stats.items()}
    kinds = ", ".join(["level string, subjects bigint, raters int", *(f"{k} {'string' if k == 'kappa_type' else 'double'}" for k in stats)])
    return ratings.sparkSession.createDataFrame([(level, int(n.sum()), m, *stats.values())], kinds)


def _texts(ratings: DataFrame) -> bool:
    """Whether some code is no number."""
    return not ratings.filter("code is not null and num is null").isEmpty()


def compute(ratings: DataFrame, raters: list[str], measure: str, level: str = "nominal", tolerance: float = 0.0) -> float | None:
    """One statistic: measure is alpha, kappa, kendall or agreement."""
    name = {
        "alpha": f"alpha_{level}",
        "kappa": "kappa" if level == "nominal" else "kappa_weighted",
        "kendall": "w",
        "agreement": "percent_agreement",
    }.get(measure)
    if name is None:
        raise ValueError("measure must be alpha, kappa, kendall or agreement")
    row = compare(ratings, raters, "ordinal" if measure == "kendall" else level, tolerance)
    if name not in row.columns:
        raise ValueError(f"{measure} is not defined for {len(raters)} raters at the {level} level")
    return row.select(name).first()[0]
