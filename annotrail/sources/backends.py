"""Backends that turn units into codes.

A backend adds a struct column ``codes`` of the codebook's schema to a table
(unit_id, content). Rule and replay backends are plain expressions and joins;
a service is called from the executors, a bounded number of requests at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotrail.plans.codebook import Codebook
from annotrail.session import qualified, ship


#: Columns on what an answer took, which a backend may add.
USAGE = ("input_tokens", "output_tokens", "cost")


class Backend(Protocol):
    def answer(self, units: DataFrame, codebook: Codebook, options: dict) -> DataFrame: ...


class RuleBackend:
    """Codes from expressions over the units' columns, a dictionary of field and expression."""

    def __init__(self, **rules: Column):
        self.rules = rules

    def answer(self, units: DataFrame, codebook: Codebook, options: dict) -> DataFrame:
        fields = [self.rules.get(n, F.lit(None)).cast(k.spark()).alias(n) for n, k in codebook.schema.fields]
        return units.withColumn("codes", F.struct(*fields))


class ReplayBackend:
    """Codes from stored answers (unit_id and a column for each field)."""

    def __init__(self, answers: DataFrame):
        self.answers = answers

    def answer(self, units: DataFrame, codebook: Codebook, options: dict) -> DataFrame:
        fields = [F.col(n).cast(k.spark()).alias(n) for n, k in codebook.schema.fields]
        stored = self.answers.select("unit_id", F.struct(*fields).alias("codes"))
        return units.join(stored, "unit_id", "left")


class CallBackend:
    """Codes from ``ask(prompt, content, options)``, which returns a dictionary of the schema's fields, or that and one of ``USAGE``.

    ``include_tokens`` and ``include_cost`` add those columns.

    ``max_active`` bounds the requests of a task at a time, ``rpm`` those of all tasks a
    minute, shared evenly by the partitions. ``on_error`` is "return" (null codes and the
    message in ``error``) or "stop". Answers aren't repeatable, so a run is stored before use.
    """

    def __init__(self, ask: Callable[[str, str, dict], dict]):
        self.ask = ask

    def answer(self, units: DataFrame, codebook: Codebook, options: dict) -> DataFrame:
        ship(units.sparkSession)
        ask, prompt = self.ask, codebook.prompt()
        active, stop = int(options.get("max_active", 10)), options.get("on_error", "return") == "stop"
        parts = units.rdd.getNumPartitions() if options.get("rpm") else 1
        pause = 60.0 * parts / options["rpm"] if options.get("rpm") else 0.0
        names = [f.name for f in units.schema]
        usage = [*(USAGE[:2] if options.get("include_tokens") else ()), *(USAGE[2:] if options.get("include_cost") else ())]

        def one(content):
            try:
                got = ask(prompt, content, options)
                fields, used = got if isinstance(got, tuple) else (got, {})
                return json.dumps(fields), None, [used.get(c) for c in usage]
            except Exception as error:  # a service may fail for one unit and not for others
                if stop:
                    raise
                return None, str(error), [None] * len(usage)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import time

            with ThreadPoolExecutor(active) as pool:
                for batch in batches:
                    jobs = []
                    for content in batch["content"]:
                        jobs.append(pool.submit(one, content))
                        if pause:
                            time.sleep(pause)
                    got = [j.result() for j in jobs]
                    yield batch[names].assign(__answer=[g[0] for g in got], error=[g[1] for g in got], **{c: pd.Series([g[2][k] for g in got], dtype="float64") for k, c in enumerate(usage)})

        schema = T.StructType([*units.schema.fields, T.StructField("__answer", T.StringType()), T.StructField("error", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in usage]])
        out = units.mapInPandas(run, schema)
        return out.withColumn("codes", F.from_json("__answer", codebook.schema.spark())).drop("__answer")


class HttpBackend(CallBackend):
    """Codes from an HTTP service that takes {prompt, content, model, ...} and returns the fields as JSON."""

    def __init__(self, url: str, headers: dict[str, str] | None = None, timeout: float = 60.0):
        def ask(prompt: str, content: str, options: dict) -> dict:
            from urllib.request import Request, urlopen

            body = json.dumps({"prompt": prompt, "content": content, **options.get("chat", {})}).encode()
            with urlopen(Request(url, body, {"Content-Type": "application/json", **(headers or {})}), timeout=timeout) as answer:
                return json.loads(answer.read())

        super().__init__(ask)


def texts(df: DataFrame, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """Units (unit_id, content) from a text column; without an id, positions in order of the text."""
    if df.schema[text_col].dataType != T.StringType():
        raise TypeError("a codebook for texts expects text input")
    if id_col is None:
        from annotrail.operators.corpus import sequence_ids

        df, id_col = sequence_ids(df.select(text_col), [text_col]), "position"
    return df.select(F.col(id_col).cast("string").alias("unit_id"), F.col(text_col).alias("content"))


def images(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """Units (unit_id, content) of image files; content is the path, the bytes stay with the files.

    With ``folders`` each name that matches ``path`` is one unit: a file, or a folder with all files below it.
    Files without a byte, hidden ones and folders of nothing else are no units.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", folders).load(path).select("path")
    if folders:
        if re.search(r"\{[^}]*/", path):
            raise ValueError("braces in the path of folders must not contain a slash")
        parts = qualified(spark, path).count("/") + 1  # what matches has as many names in its path as the pattern
        files = files.select(F.substring_index("path", "/", parts).alias("path")).distinct()
    return files.select(F.substring_index("path", "/", -1).alias("unit_id"), F.col("path").alias("content"))
