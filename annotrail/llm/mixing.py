"""Mixing sources to target weights by Pareto order sampling.

Targets. Sources, ordered by code point with null last, weigh ``weights`` in
turn and share ``share`` of all words; a target stops at ``max_copies`` times
its source's size and the excess goes to the others by weight. That is
min(max_copies * size, level * weight) with one common level, found in closed
form from running sums.

Copies. A source that is to give r times its words first takes floor(r) whole
copies of each document. The rest is a sample without replacement whose
inclusion probabilities grow with the square root of a document's size,
p = min(1, k * sqrt(size)), k such that the expected words are what is missing.
Documents with p = 1 are certain. The others are ranked by their random odds
over their inclusion odds, u / (1 - u) over p / (1 - p), and taken from the
smallest on while half of the next one still fits: a sample of fixed size in
words, off by at most half a document.

The ranking is never sorted as a whole. Words are summed in bins of the rank;
the bin where the target is met is cut into bins again, and only the rows of
the last bin are ordered. So a source with a third of all rows takes no more
memory in a task than any other.

Defined cases: null and wordless texts have size 0 and take 0 words. A null
source is a source. Random numbers come from the id and the text, so reruns
agree and identical rows, which nothing can tell apart, are taken or left
together. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annotrail.llm.common import WORD, like, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
SEED = "mix-1"
#: Bins in each of the two rounds that narrow down where a source's target is met.
BINS = 4096


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target from one row (source, source_size) for each source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * max_copies
    rows = sizes.withColumn("weight", turn).withColumn("cap", cap)
    rising = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(W.unboundedPreceding, -1), rising.rowsBetween(0, W.unboundedFollowing)
    rows = rows.select(
        "*",
        (
            (F.lit(share) * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            / F.sum("weight").over(after)
        ).alias("level"),
    )
    # The first source that stays below its cap sets the level for all after it.
    found = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(W.partitionBy())
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), found["level"] * F.col("weight")).alias("target"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) with 52 bits from the id and the text."""
    name = F.md5(F.concat(F.lit(SEED), F.lit("|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))).cast("binary"))
    return (F.conv(F.substring(name, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """One stored row for each source of rows (source, size, u): its target and how it is met."""
    rows = rows.withColumn("key", _key(F.col("source")))
    of = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_copies)
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    of = of.select(_key(F.col("source")).alias("key"), "source_size", "target", F.least(F.floor(rate), F.lit(max_copies)).cast("int").alias("base"))
    of = stored(of.withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")), "mix-targets")

    # k of each source: sizes from the largest down are certain as long as k * sqrt(size) reaches 1.
    kinds = rows.filter("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")).join(of.select("key", "rest"), "key")
    kinds = kinds.select("key", "size", "rest", (F.col("n") * F.col("size")).alias("words"))
    above = W.partitionBy("key").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("key").orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    left = F.col("rest") - F.coalesce(F.sum("words").over(above), F.lit(0))
    # Whole numbers sum alike in any order, fractions don't; so reruns agree.
    pull = F.sum(F.round(_root() * 1024).cast("long") * F.col("words")).over(upto)
    kinds = kinds.select("key", "size", left.alias("left"), (left * 1024 / pull).alias("k")).filter(F.col("k") * _root() < 1)
    found = kinds.groupBy("key").agg(F.max_by("k", "size").alias("k"), F.max("size").alias("largest"), F.max_by("left", "size").alias("left"))
    of = of.join(found, "key", "left").select(
        "key", "source_size", "target", "base",
        F.when(F.col("rest") > 0, F.coalesce("k", F.lit(1.0))).otherwise(0.0).alias("k"),
        F.coalesce("largest", F.lit(0)).alias("largest"),
        F.coalesce("left", F.lit(0.0)).alias("left"),
    )
    of = stored(of, "mix-rates")

    grid = _ranked(rows, of).filter("rank is not null").select("key", "left", "size", "rank", "bin1", "bin2")
    first = _met(grid.groupBy("key", "left", "bin1").agg(F.sum("size").alias("w")), "bin1", F.lit(0))
    first = stored(first.select("key", F.col("bin1").alias("at1"), F.col("before").alias("before1")), "mix-bin1")
    inner = grid.join(first, "key").filter("bin1 = at1")
    second = _met(inner.groupBy("key", "left", "before1", "bin2").agg(F.sum("size").alias("w")), "bin2", F.col("before1"))
    second = stored(second.select("key", F.col("bin2").alias("at2"), F.col("before").alias("before2")), "mix-bin2")
    last = inner.join(second, "key").filter("bin2 = at2")
    ties = last.groupBy("key", "left", "before2", "rank").agg(F.sum("size").alias("w"))
    run = F.coalesce(F.sum("w").over(W.partitionBy("key").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ties = ties.withColumn("out", F.col("before2") + run + F.col("w") / 2 > F.col("left"))
    cut = ties.groupBy("key").agg(F.min(F.when(F.col("out"), F.col("rank"))).alias("out_from"))
    ends = first.join(second, "key").join(cut, "key").select("key", "at1", "at2", "out_from")
    return stored(of.join(ends, "key", "left"), "mix-plan")


def _root() -> Column:
    return F.sqrt(F.col("size").cast("double"))


def _ranked(rows: DataFrame, of: DataFrame) -> DataFrame:
    """The plan's figures beside each row, and its rank in (0, 1) with its bins; no rank where nothing is drawn."""
    p = F.col("k") * _root()
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    drawn = (F.col("size") > 0) & (F.col("size") <= F.col("largest")) & (F.col("k") > 0)
    rows = rows.join(of, "key").withColumn("rank", F.when(drawn, odds / (1 + odds)))
    rows = rows.withColumn("bin1", F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1)))
    return rows.withColumn("bin2", F.least(F.floor((F.col("rank") * BINS - F.col("bin1")) * BINS), F.lit(BINS - 1)))


def copies(rows: DataFrame, of: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """Adds source_size, target and copies to rows (source, size, u), by their plan."""
    rows = _ranked(rows.withColumn("key", _key(F.col("source"))), of)
    drawn = (
        F.when(F.col("rank").isNull(), (F.col("size") > F.col("largest")) & (F.col("k") > 0))
        .when(F.col("at1").isNull(), True)
        .when(F.col("bin1") != F.col("at1"), F.col("bin1") < F.col("at1"))
        .when(F.col("bin2") != F.col("at2"), F.col("bin2") < F.col("at2"))
        .otherwise(F.coalesce(F.col("rank") < F.col("out_from"), F.lit(True)))
    )
    n = F.least(F.col("base") + drawn.cast("int"), F.lit(max_copies))
    return rows.withColumn("copies", F.when(F.col("size") > 0, n).otherwise(0))


def _met(bins: DataFrame, name: str, start: Column) -> DataFrame:
    """For each source, the first bin in which the running words pass what is left, and the words before it."""
    run = F.sum("w").over(W.partitionBy("key").orderBy(name))
    rows = bins.withColumn("upto", run + start).filter(F.col("upto") >= F.col("left"))
    return rows.groupBy("key").agg(F.min_by(F.struct(F.col(name), (F.col("upto") - F.col("w")).alias("before")), name).alias("m")).select("key", "m.*")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        "*",
        F.col(source_col).alias("__source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("__size"),
        _uniform(F.col(id_col), text).alias("__u"),
    )


def report(docs: DataFrame) -> DataFrame:
    """The digest of ``op4`` and the copies taken: a row for each row."""
    rows = _sized(docs, "doc_id", "text", "source")
    rows = stored(rows.select("doc_id", F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__u").alias("u")), "mix-sizes")
    mixed = copies(rows, plan(rows))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("copies").cast("long").alias("copies")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, in the columns of ``docs``."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    at = {c: f"c{names.index(c)}" for c in ("doc_id", "text", "source")}
    rows = _sized(plain, at["doc_id"], at["text"], at["source"])
    rows = rows.select(*plain.columns, F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__u").alias("u"))
    of = plan(stored(rows.select("source", "size", "u"), "mix-sizes"))
    mixed = copies(rows, of).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return like(mixed.select(*plain.columns).toDF(*names), docs)
