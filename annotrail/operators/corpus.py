"""Corpus helpers: subsets, samples, tables of counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annotrail.session import stored


def sequence_ids(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Positions from 1 on in the order of ``order``: counts of ranges of the order first, so no task sorts all rows.

    The ranges are stored, as two evaluations need not draw the same ones.
    """
    spread = stored(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    spread = spread.withColumn("__k", F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    sizes = spread.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offset = sizes.select("__p", before.alias("__before"))
    return spread.join(F.broadcast(offset), "__p").withColumn(name, (F.col("__k") + F.col("__before")).cast("long")).drop("__p", "__k", "__before")


def positions(df: DataFrame, wanted: list[int], order: list[str]) -> DataFrame:
    """The rows at given positions of an order, with all their variables."""
    return sequence_ids(df, order).filter(F.col("position").isin(wanted)).drop("position")


def distinct_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the least id of each text; null texts count as one text."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(F.md5(F.col(text_col).cast("binary")).alias("k")).agg(F.min_by(row, F.col(id_col)).alias("row"))
    return best.select("row.*")


def stratified(df: DataFrame, by: list[str], n: int, order: Column | None = None, seed: int = 1) -> DataFrame:
    """``n`` rows of each group without replacement: the first by ``order``, or by a hash of the row.

    The group's candidates shrink to ``n`` for each of 64 salts before they meet.
    """
    key = order if order is not None else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.lit(seed))
    rows = df.withColumn("__key", key).withColumn("__salt", F.pmod(F.xxhash64("__key"), F.lit(64)))
    part = F.row_number().over(W.partitionBy(*by, "__salt").orderBy("__key"))
    rows = rows.withColumn("__r", part).filter(F.col("__r") <= n)
    whole = F.row_number().over(W.partitionBy(*by).orderBy("__key"))
    return rows.withColumn("__r", whole).filter(F.col("__r") <= n).drop("__key", "__salt", "__r")


def stratified_with_replacement(df: DataFrame, by: list[str], n: int, key: str | None = None, seed: int = 1) -> DataFrame:
    """``n`` draws from each group with replacement; ``draw`` numbers them from 1 on.

    Rows stand in order of the MD5 of ``key``, or of the whole row; a group is numbered in 256 parts by its first byte, so no task sorts it whole.
    """
    text = F.col(f"`{key}`").cast("string") if key else F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    name = F.md5(text.cast("binary"))
    rows = df.withColumn("__m", F.coalesce(name, F.lit(""))).withColumn("__s", F.substring("__m", 1, 2))
    sizes = rows.groupBy(*by, "__s").agg(F.count("*").alias("__n"))
    group = W.partitionBy(*by)
    before = F.coalesce(F.sum("__n").over(group.orderBy("__s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*by, "__s", before.alias("__before"), F.sum("__n").over(group).alias("__all"))
    text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in by], F.col("draw").cast("string"), F.lit(str(seed)))
    draws = sizes.select(*by, "__all").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    draws = draws.withColumn("__i", F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long"), F.col("__all")))
    place = F.row_number().over(W.partitionBy(*by, "__s").orderBy("__m", *[F.col(f"`{c}`") for c in df.columns])) - 1

    def on(a: str, b: str, *more: str) -> Column:
        return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in (*by, *more)])

    rows = rows.withColumn("__k", place).alias("r").join(sizes.select(*by, "__s", "__before").alias("s"), on("r", "s", "__s"))
    rows = rows.select(*[f"r.{c}" for c in df.columns], (F.col("r.__k") + F.col("s.__before")).alias("__i")).alias("r")
    return rows.join(draws.alias("d"), on("r", "d", "__i")).select(*[f"r.{c}" for c in df.columns], "d.draw")


def crosstab(df: DataFrame, row: str, column: str, columns: list[str]) -> DataFrame:
    """Counts of ``row`` by ``column``, with a row of totals named Total."""
    counts = [F.count_if(F.col(column) == c).alias(c) for c in columns]
    each = df.groupBy(F.col(row).cast("string").alias(row)).agg(*counts, F.count("*").alias("total"))
    return each.unionByName(df.agg(F.lit("Total").alias(row), *counts, F.count("*").alias("total")))


def preview(df: DataFrame, text_col: str = "text", n: int = 2, width: int = 60) -> str:
    """A line on the corpus and the beginnings of its first texts."""
    from annotrail.functions.scalar import shortened

    head = [f"Corpus with variables {', '.join(c for c in df.columns if c != text_col)}"]
    return "\n".join(head + [f"{k}: {shortened(r[text_col] or '', width)}" for k, r in enumerate(df.limit(n).collect(), 1)])
