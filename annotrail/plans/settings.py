"""The older trail interface: settings, records and their comparison."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotrail.operators import legacy
from annotrail.plans.codebook import Codebook, Task
from annotrail.plans.coding import code
from annotrail.sources.backends import Backend


@dataclass(frozen=True)
class Setting:
    provider: str = "openai"
    model: str = "gpt-4o-mini"
    temperature: float = 0.0
    extra: dict[str, Any] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if not self.provider or not self.model:
            raise ValueError("provider and model must be given")
        if not 0 <= self.temperature <= 2:
            raise ValueError("temperature must lie between 0 and 2")


@dataclass
class Record:
    setting: Setting
    df: DataFrame


def annotate(data: DataFrame, task: Codebook | Task, model: str, backend: Backend, **options: Any) -> DataFrame:
    warnings.warn("annotate() is superseded by code()", DeprecationWarning, stacklevel=2)
    return code(data, task, model, backend, **options).df


def record(data: DataFrame, text_col: str, task: Codebook | Task, setting: Setting, backend: Backend, id_col: str = "id", cache_dir: str | None = None, overwrite: bool = False, annotate_fun: Callable[..., DataFrame] | None = None) -> Record:
    """One run of a setting; with ``cache_dir``, answers once given are read again unless ``overwrite``.

    ``annotate_fun(units, task, model, backend, temperature=..., ...)`` stands in for the engine's own coding, and isn't cached.
    """
    units = data.select(F.col(id_col).cast("string").alias("unit_id"), F.col(text_col).alias("content"))
    model, options = f"{setting.provider}/{setting.model}", {"temperature": setting.temperature, **setting.extra}
    df = annotate_fun(units, task, model, backend, **options) if annotate_fun else code(units, task, model, backend, store=cache_dir, overwrite=overwrite, **options).df
    return Record(setting, df.withColumnRenamed("unit_id", id_col))


def matrix(records: dict[str, Record], id_col: str = "id", label_col: str = "label") -> DataFrame:
    """A row for each unit with a column for each record."""
    long = reduce(DataFrame.unionByName, [r.df.select(F.col(id_col), F.lit(n).alias("__r"), F.col(label_col).cast("string").alias("__c")) for n, r in records.items()])
    return long.groupBy(id_col).agg(*[F.min(F.when(F.col("__r") == n, F.col("__c"))).alias(n) for n in records])


def icr(records: dict[str, Record], id_col: str = "id", label_col: str = "label", min_coders: int = 2, icr_fun: Callable = legacy.validate, **options: Any) -> Any:
    return icr_fun(matrix(records, id_col, label_col), id=id_col, coder_cols=list(records), min_coders=min_coders, **options)


def compare(data: DataFrame, text_col: str, task: Codebook | Task, settings: dict[str, Setting], backends: dict[str, Backend], id_col: str = "id", label_col: str = "label", cache_dir: str | None = None, min_coders: int = 2, overwrite: bool = False, annotate_fun: Callable[..., DataFrame] | None = None) -> dict[str, Any]:
    """All settings' records, their matrix and its reliability."""
    records = {n: record(data, text_col, task, s, backends[n], id_col, cache_dir, overwrite, annotate_fun) for n, s in settings.items()}
    return {"records": records, "matrix": matrix(records, id_col, label_col), "icr": icr(records, id_col, label_col, min_coders)}
