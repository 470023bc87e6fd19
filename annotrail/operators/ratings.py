"""Aligning, reshaping and filtering of ratings.

The canonical form is long: (unit_id STRING, rater_id STRING, code STRING,
num DOUBLE), a row for each unit and rater. Joins of coders' tables become a
union and one shuffle on ``unit_id``, whatever the number of coders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annotrail.functions.scalar import label, number, require


def ratings_long(raters: dict[str, DataFrame], by: str, unit: str = ".id") -> DataFrame:
    """Ratings of variable ``by`` from a table for each rater; blank names become rater<i>."""
    parts = []
    for k, (name, df) in enumerate(raters.items(), 1):
        require(df, unit, by)
        code, ident = F.col(f"`{by}`"), F.col(f"`{unit}`")
        kind = df.schema[by].dataType
        parts.append(
            df.select(
                label(ident, df.schema[unit].dataType).alias("unit_id"),
                F.lit(name or f"rater{k}").alias("rater_id"),
                label(code, kind).alias("code"),
                number(code, kind).alias("num"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def wide_to_long(df: DataFrame, unit: str, coders: list[str], order: str | None = None) -> DataFrame:
    """Ratings from a table with a column for each coder, and the column ``order`` if it is named."""
    require(df, unit, *coders, *([order] if order else []))
    cells = [F.struct(F.lit(c).alias("rater_id"), label(F.col(f"`{c}`"), df.schema[c].dataType).alias("code"), number(F.col(f"`{c}`"), df.schema[c].dataType).alias("num")) for c in coders]
    return df.select(label(F.col(f"`{unit}`"), df.schema[unit].dataType).alias("unit_id"), *([F.col(f"`{order}`")] if order else []), F.inline(F.array(*cells)))


def first_codes(ratings: DataFrame, order: str | None = None) -> DataFrame:
    """One non-null rating for each unit and rater: the first by ``order``, or the least code."""
    by = F.col(order) if order else F.col("code")
    best = F.min_by(F.struct("code", "num"), by)
    return ratings.filter("code is not null").groupBy("unit_id", "rater_id").agg(best.alias("b")).select("unit_id", "rater_id", "b.code", "b.num")


def ratings_wide(ratings: DataFrame, raters: list[str], value: str = "code") -> DataFrame:
    """A row for each unit with a column for each rater; repeated ratings keep the least."""
    return ratings.groupBy("unit_id").agg(*[F.min(F.when(F.col("rater_id") == r, F.col(value))).alias(r) for r in raters])


def complete_cases(ratings: DataFrame, raters: int) -> DataFrame:
    """Ratings of the units that all raters have coded."""
    coded = F.count("code").over(W.partitionBy("unit_id"))
    return ratings.filter("code is not null").withColumn("__n", coded).filter(F.col("__n") == raters).drop("__n")


def min_coders(ratings: DataFrame, least: int = 2) -> DataFrame:
    """Ratings of the units with codes of at least ``least`` coders."""
    coded = F.count("code").over(W.partitionBy("unit_id"))
    return ratings.withColumn("__n", coded).filter(F.col("__n") >= least).drop("__n")


def missing_counts(ratings: DataFrame, raters: list[str]) -> DataFrame:
    """One row: common units, and for each rater those it left uncoded among them (before any filter)."""
    unit = ratings.groupBy("unit_id").agg(
        F.countDistinct("rater_id").alias("n"), *[F.max(F.when(F.col("rater_id") == r, F.col("code").isNull())).alias(r) for r in raters]
    )
    unit = unit.filter(F.col("n") == len(raters))
    return unit.agg(F.count("*").alias("units"), *[F.count_if(F.col(f"`{r}`")).alias(f"missing_{r}") for r in raters])


def check(ratings: DataFrame, raters: list[str]) -> dict[str, int]:
    """Counts for the eager checks; raises on repeated ids, no common units and no complete case."""
    one = ratings.groupBy("unit_id", "rater_id").agg(F.count("*").alias("k"), F.count("code").alias("c"))
    unit = one.groupBy("unit_id").agg(F.max("k").alias("k"), F.count("*").alias("n"), F.sum((F.col("c") > 0).cast("int")).alias("c"))
    m = len(raters)
    row = unit.agg(
        F.coalesce(F.max("k"), F.lit(0)).alias("repeats"), F.count_if(F.col("n") == m).alias("common"), F.count_if((F.col("n") == m) & (F.col("c") == m)).alias("complete")
    ).first().asDict()
    if row["repeats"] > 1:
        raise ValueError("Ids occur more than once within a rater; pass dedupe='first' to keep the first")
    if not row["common"]:
        raise ValueError("No common units across the raters; no matching units found")
    if not row["complete"]:
        raise ValueError("No complete cases found: every common unit lacks a code")
    return row


def levels(ratings: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(code, level): dense indexes from 1 on; by ``order``, else numbers by value, else text by bytes."""
    if order is not None:
        pairs = F.array(*[F.struct(F.lit(x).alias("code"), F.lit(k).alias("level")) for k, x in enumerate(order, 1)])
        return ratings.sparkSession.range(1).select(F.inline(pairs))
    kinds = ratings.filter("code is not null").groupBy("code").agg(F.min("num").alias("num"))
    numeric = (F.count("*").over(W.partitionBy()) == F.count("num").over(W.partitionBy())).alias("numeric")
    kinds = kinds.select("code", "num", numeric)
    by = W.orderBy(F.when(F.col("numeric"), F.col("num")), "code")
    return kinds.select("code", F.row_number().over(by).alias("level"))


def encoded(ratings: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Ratings whose ``num`` is the index of the code's level."""
    return ratings.drop("num").join(levels(ratings, order), "code").withColumn("num", F.col("level").cast("double")).select("unit_id", "rater_id", "code", "num")


def mid_ranks(ratings: DataFrame, value: str = "num") -> DataFrame:
    """Ratings with ``rank``, the mean rank of their value within the rater.

    Ranks come from counts of each rater's values, so a rater's units are never sorted in one task.
    """
    counts = ratings.groupBy("rater_id", value).agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(W.partitionBy("rater_id").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select("rater_id", value, (before + (F.col("k") + 1) / F.lit(2.0)).cast("double").alias("rank"))
    return ratings.join(ranks, ["rater_id", value])


def paired(column_of: dict[str, Column]) -> list[tuple[Column, Column]]:
    names = list(column_of)
    return [(column_of[a], column_of[b]) for i, a in enumerate(names) for b in names[i + 1 :]]
