"""Coding of units as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotrail.plans.codebook import Codebook, conform
from annotrail.sources.backends import Backend


def coded_stream(units: DataFrame, codebook: Codebook, backend: Backend, options: dict | None = None) -> DataFrame:
    """(unit_id, fields) of a streaming table (unit_id, content); stateless, so any output mode does."""
    answers = conform(backend.answer(units, codebook, options or {}), codebook)
    return answers.select("unit_id", *[F.col(f"codes.{n}").alias(n) for n, _ in codebook.schema.fields])
