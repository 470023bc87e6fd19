"""Coding runs: by a backend, by people, again with changes, and stored answers."""

from __future__ import annotations

import hashlib
import json
import platform
import re
import warnings
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from typing import Any

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotrail.plans.codebook import Codebook, Task, as_codebook, conform, record
from annotrail.session import exists, remove
from annotrail.sources.backends import USAGE, Backend

#: Options of how requests are sent; the others known go to the model.
PARALLEL = ("max_active", "rpm", "on_error", "convert", "include_tokens", "include_cost")
BATCH = ("path", "wait", "ignore_hash")
CHAT = ("params", "temperature", "seed", "max_tokens", "api_args", "base_url", "echo", "top_p")


@dataclass
class Run:
    name: str
    kind: str = "coded"
    parents: tuple[str, ...] = ()
    timestamp: datetime = field(default_factory=lambda: datetime.now(UTC))
    model: str | None = None
    batch: bool = False
    codebook: Codebook | None = None
    chat_args: dict[str, Any] = field(default_factory=dict)
    execution_args: dict[str, Any] = field(default_factory=dict)
    metadata: dict[str, Any] = field(default_factory=dict)
    call: str = ""
    metrics: dict[str, Any] = field(default_factory=dict)

    @property
    def temperature(self) -> Any:
        return self.chat_args.get("temperature", (self.chat_args.get("params") or {}).get("temperature"))


@dataclass
class Coded:
    """Codes (unit_id first, then the schema's fields), how they came about, and the units."""

    df: DataFrame
    run: Run
    source: DataFrame | None = None
    backend: Backend | None = None

    @property
    def input_type(self) -> str:
        return "human" if self.run.kind == "human" else self.run.codebook.input_type if self.run.codebook else "text"

    def count_units(self) -> int:
        """The number of units, counted once, of the units and not of the answers, which may be asked for again."""
        if not isinstance(self.run.metadata.get("n_units"), int):
            self.run.metadata["n_units"] = (self.df if self.source is None or self.run.kind == "human" else self.source).count()
        return self.run.metadata["n_units"]

    def total_cost(self) -> float | None:
        """The sum of what the answers cost; null without a column ``cost``."""
        return self.df.agg(F.sum("cost")).first()[0] if "cost" in self.df.columns else None

    def __repr__(self) -> str:
        r = self.run
        lines = [f"Coded run: {r.name}", f"  Codebook: {r.codebook.name if r.codebook else '-'}", f"  Model: {r.model or 'human'}", f"  Units: {r.metadata.get('n_units') or 'not counted'}"]
        if r.parents:
            lines.append(f"  Parent: {', '.join(r.parents)}")
        return "\n".join(lines)


def routed(options: dict[str, Any], batch: bool) -> tuple[dict, dict]:
    """(options of the model, options of sending); unknown ones are named in a warning and dropped."""
    sending = (*PARALLEL, *BATCH) if batch else PARALLEL
    chat = {k: v for k, v in options.items() if k in CHAT}
    send = {k: v for k, v in options.items() if k in sending}
    if unknown := [k for k in options if k not in chat and k not in send]:
        warnings.warn(f"options not recognized and ignored: {', '.join(unknown)}", stacklevel=3)
    return chat, send


def digest(*parts: Any) -> str:
    """A stable name of values, 64 hex digits; runs use the first eight."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def code(
    units: DataFrame,
    codebook: Codebook | Task,
    model: str,
    backend: Backend,
    name: str = "original",
    batch: bool = False,
    store: str | None = None,
    overwrite: bool = False,
    **options: Any,
) -> Coded:
    """Codes of ``units`` (unit_id, content).

    With ``store``, answers are kept there by a key of unit, codebook, model and
    options; only units without one are asked for, and a run that broke off goes on.
    With ``overwrite`` all are asked again. ``convert=False`` gives the answer as JSON text,
    ``include_tokens`` and ``include_cost`` what the backend tells of them. With ``batch`` the
    backend sends one job; if it isn't done yet, the same call later goes on with it.
    """
    codebook = as_codebook(codebook)
    if not {"unit_id", "content"} <= set(units.columns):
        raise TypeError("expects text input" if codebook.input_type == "text" else "expects image file paths")
    chat, send = routed(options, batch)
    asked = {**send, "chat": {"model": model, **chat}}
    if store is None:
        answers = backend.answer(units, codebook, asked)
    else:
        answers = _kept(units, codebook, backend, asked, store, digest(codebook.json(), model, chat), overwrite)
    answers = conform(answers, codebook)
    fields = [F.col(f"codes.{n}").alias(n) for n, _ in codebook.schema.fields] if send.get("convert", True) else [F.to_json("codes").alias("answer")]
    extra = [c for c in (*USAGE, "error") if c in answers.columns]
    metadata = {"n_units": None, "spark": pyspark.__version__, "python": platform.python_version()}
    run = Run(name, "coded", (), model=model, batch=batch, codebook=codebook, chat_args={"name": model, **chat}, execution_args=send, metadata=metadata, call=f"code(model={model!r}, codebook={codebook.name!r}, name={name!r})")
    return Coded(answers.select("unit_id", *fields, *extra), run, units, backend)


def _kept(units: DataFrame, codebook: Codebook, backend: Backend, options: dict, store: str, key: str, overwrite: bool = False) -> DataFrame:
    spark = units.sparkSession
    path = f"{store.rstrip('/')}/{key}"
    keyed = units.withColumn("content_key", F.sha2(F.concat_ws("\x1f", "unit_id", "content"), 256))
    if overwrite:
        remove(spark, path)
    there = exists(spark, path)
    todo = keyed.join(spark.read.parquet(path).select("content_key"), "content_key", "left_anti") if there else keyed
    new = backend.answer(todo, codebook, options)
    if "error" in new.columns:  # failed units are asked again next time
        new = new.filter("error is null")
    new.select("content_key", "codes", *[c for c in USAGE if c in new.columns]).write.mode("append").parquet(path)
    return keyed.join(spark.read.parquet(path).dropDuplicates(["content_key"]), "content_key", "left").drop("content_key")


def human(data: DataFrame, name: str = "human_coder", codebook: Codebook | None = None, texts: DataFrame | None = None, metadata: dict | None = None, unit: str = ".id") -> Coded:
    """People's codes as a run; own metadata add to the defaults, which win."""
    if unit not in data.columns:
        raise ValueError(f"the data must contain a {unit!r} column")
    rest = [c for c in data.columns if c != unit]
    df = data.select(F.col(f"`{unit}`").cast("string").alias("unit_id"), *[F.col(f"`{c}`") for c in rest])
    codebook = codebook or Codebook("Human-coded data", "Codes assigned by people", record())
    meta = {**(metadata or {}), "source": "human", "n_units": None}
    run = Run(name, "human", codebook=codebook, chat_args={"source": "human"}, metadata=meta, call=f"human(name={name!r})")
    return Coded(df, run, texts)


def replicate(x: Coded, codebook: Codebook | None = None, model: str | None = None, batch: bool | None = None, name: str | None = None, backend: Backend | None = None, ancestors: dict[str, Run] | None = None, **options: Any) -> Coded:
    """The run again, with changes; options of the model and of sending are both kept.

    The name is the new model's last part, or replication_<k>, k one more than
    the replications among the run's ancestors.
    """
    if x.run.kind == "human" or x.source is None:
        raise ValueError("only a run of a model over stored units can be replicated")
    old = x.run
    new_model = model or old.model
    if name is None:
        if new_model != old.model:
            name = new_model.rsplit("/", 1)[-1]
        else:
            line, runs, at = 0, ancestors or {}, old
            while at is not None:
                found = re.match(r"replication_(\d+)$", at.name)
                line = max(line, int(found[1]) if found else 0)
                at = runs.get(at.parents[0]) if at.parents else None
            name = f"replication_{line + 1}"
    kept = {k: v for k, v in old.chat_args.items() if k != "name"}
    out = code(x.source, codebook or old.codebook, new_model, backend or x.backend, name, old.batch if batch is None else batch, **{**kept, **old.execution_args, **options})
    out.run = replace(out.run, parents=(old.name,), call=f"replicate({old.name!r}, name={name!r})")
    return out
