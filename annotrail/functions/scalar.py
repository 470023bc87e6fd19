"""Null-safe scalar expressions shared by the statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def label(column: Column, kind: T.DataType) -> Column:
    """The canonical text of a code or an id: 1.0 and 1 are both '1', NaN is null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
        text = F.when(whole, column.cast("long").cast("string")).otherwise(column.cast("string"))
        return F.when(~F.isnan(column), text)
    if isinstance(kind, T.DecimalType):  # its own digits: a double would make different large ids one
        text = column.cast("string")
        return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text) if kind.scale else text
    return column.cast("string")


def number(column: Column, kind: T.DataType) -> Column:
    """A code as a double; null if it isn't one."""
    out = column.cast("double") if isinstance(kind, (T.NumericType, T.BooleanType)) else F.try_to_number_double(column) if hasattr(F, "try_to_number_double") else column.try_cast("double")
    return F.when(~F.isnan(out), out)


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; null where a side is constant (``corr`` would raise)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def last_part(model: Column) -> Column:
    """The part of a model's name after its last slash."""
    return F.regexp_replace(model, "^.*/", "")


def shortened(text: str, n: int = 60) -> str:
    return text if len(text) <= n else text[:n] + "..."


def clipped(text: Column, n: int = 60) -> Column:
    """``shortened`` of a column."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("...")))


def tokens(text: Column) -> Column:
    """The number of words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def without_number(name: Column) -> Column:
    """A document's name without a numeric suffix such as ``.3``."""
    return F.regexp_replace(name, r"\.[0-9]+$", "")


def require(df: DataFrame, *columns: str) -> None:
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"Variable {c!r} not found; there are: {', '.join(df.columns)}")
