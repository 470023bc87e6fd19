"""The audit trail: runs and their parents, saved, exported and reported."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotrail.functions.scalar import require
from annotrail.operators import reliability, validation
from annotrail.operators.ratings import check, first_codes, ratings_long
from annotrail.plans.coding import Coded, Run, digest
from annotrail.session import exists, read_text, stored, write_text

RUNS = "name string, kind string, parents array<string>, ts timestamp, model string, batch boolean, codebook_name string, codebook_json string, chat_args map<string,string>, execution_args map<string,string>, metadata map<string,string>, call string, metrics map<string,double>"

#: How metrics are called in reports.
NAMES = {
    "percent_agreement": "Percent agreement",
    "alpha_nominal": "Krippendorff's alpha (nominal)",
    "alpha_ordinal": "Krippendorff's alpha (ordinal)",
    "alpha_interval": "Krippendorff's alpha (interval)",
    "alpha_ratio": "Krippendorff's alpha (ratio)",
    "kappa": "Kappa",
    "kappa_weighted": "Weighted kappa",
    "w": "Kendall's W",
    "rho": "Spearman's rho",
    "tau": "Kendall's tau",
    "r": "Pearson's r",
    "icc": "ICC",
    "accuracy": "Accuracy",
    "precision": "Precision",
    "recall": "Recall",
    "f1": "F1",
    "mae": "MAE",
    "rmse": "RMSE",
}


@dataclass
class Result:
    """A comparison or validation: one row of metrics, and its run."""

    df: DataFrame
    run: Run
    by_class: DataFrame | None = None
    confusion: DataFrame | None = None
    about: dict[str, Any] = field(default_factory=dict)
    _row: dict | None = field(default=None, repr=False)

    def metrics(self) -> dict[str, Any]:
        if self._row is None:
            self._row = self.df.first().asDict()
            if undefined := [NAMES.get(k, k) for k, v in self._row.items() if v is None]:
                warnings.warn(f"undefined for these codes: {', '.join(undefined)}", stacklevel=3)
            self.run.metrics = {k: v for k, v in self._row.items() if v is not None}
        return self._row

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in self.about:
            return self.about[name]
        row = self.metrics()
        if name in row:
            return row[name]
        raise AttributeError(name)

    def long(self) -> DataFrame:
        """(metric, value) rows of the numeric results."""
        numeric = [f.name for f in self.df.schema if f.dataType.typeName() in ("double", "long", "integer")]
        return self.df.select([F.col(c).cast("double").alias(c) for c in numeric]).unpivot([], numeric, "metric", "value")

    def __repr__(self) -> str:
        lines = [f"{self.run.kind.capitalize()}: {', '.join(self.run.parents)}"]
        for k, v in self.metrics().items():
            if v is not None:
                lines.append(f"  {NAMES.get(k, k)}: {v:.4f}" if isinstance(v, float) else f"  {k}: {v}")
        return "\n".join(lines)


def _tables(objects: dict[str, Coded | DataFrame], unit: str) -> tuple[dict[str, DataFrame], dict[str, Run]]:
    tables, runs = {}, {}
    for k, (name, x) in enumerate(objects.items(), 1):
        if isinstance(x, Coded):
            tables[name or x.run.name], runs[name or x.run.name] = x.df.withColumnRenamed("unit_id", unit), x.run
        elif isinstance(x, DataFrame):
            tables[name or f"rater{k}"], runs[name or f"rater{k}"] = x, Run(f"auto_converted_{name or k}", "human")
        else:
            raise TypeError("every object must be a coded run or a table")
    return tables, runs


def compare(objects: dict[str, Coded | DataFrame] | list, by: str, level: str = "nominal", tolerance: float = 0.0, order: list[str] | None = None, unit: str = ".id", strict: bool = True, dedupe: str | None = None, compat: bool = False) -> Result:
    """Agreement of two or more coders on variable ``by``."""
    if isinstance(objects, list):
        objects = {(x.run.name if isinstance(x, Coded) else f"rater{k}"): x for k, x in enumerate(objects, 1)}
    if len(objects) < 2:
        raise ValueError("At least two coders are needed for a comparison")
    tables, runs = _tables(objects, unit)
    ratings = ratings_long(tables, by, unit)
    if dedupe == "first":
        ratings = first_codes(ratings)
    if strict:
        check(ratings, list(tables))
    parents = tuple(r.name for r in runs.values())
    name = f"comparison_{digest('comparison', parents, by, level, tolerance, order)[:8]}"
    return Result(reliability.compare(ratings, list(tables), level, tolerance, order, compat), Run(name, "comparison", parents, call=f"compare(by={by!r}, level={level!r})"), about={"variable": by, "level": level, "tolerance": tolerance})


def validate(x: Coded | DataFrame, gold: Coded | DataFrame, by: str, level: str = "nominal", average: str = "macro", order: list[str] | None = None, unit: str = ".id", strict: bool = True, compat: bool = False) -> Result:
    """One coder against a gold standard on variable ``by``."""
    if level not in validation.LEVELS:
        raise ValueError(f"level must be one of {', '.join(validation.LEVELS)}")
    if average not in validation.AVERAGES:
        raise ValueError(f"average must be one of {', '.join(validation.AVERAGES)}")
    if level != "nominal" and average != "macro":
        warnings.warn("average counts at the nominal level only", stacklevel=2)
    for what, side in (("x", x), ("gold", gold)):
        if isinstance(side, DataFrame) and unit not in side.columns:
            raise ValueError(f"{what} must contain a {unit!r} column")
    tables, runs = _tables({"estimate": x, "truth": gold}, unit)
    for t in tables.values():
        require(t, by)
    ratings = ratings_long(tables, by, unit)
    if strict:
        counts = ratings.groupBy("unit_id").agg(*[F.count_if(F.col("rater_id") == r).alias(r) for r in tables], *[F.count_if((F.col("rater_id") == r) & F.col("code").isNull()).alias(f"no_{r}") for r in tables])
        both = (F.col("estimate") > 0) & (F.col("truth") > 0)
        row = counts.agg(F.count_if(both).alias("n"), *[F.count_if(both & (F.col(f"no_{r}") > 0)).alias(r) for r in tables], F.count_if(both & (F.col("no_estimate") == 0) & (F.col("no_truth") == 0)).alias("whole")).first()
        if not row["n"]:
            raise ValueError("No matching units found")
        if not row["whole"]:
            raise ValueError("No complete cases found")
        if row["estimate"] or row["truth"]:
            warnings.warn(f"Missing values detected: {row['estimate']} in x, {row['truth']} in gold; those units are left out", stacklevel=2)
    parents = tuple(r.name for r in runs.values())
    name = f"validation_{digest('validation', parents, by, level, average, order)[:8]}"
    pairs = validation.aligned(ratings, "estimate", "truth")
    table = None if level == "interval" else validation.confusion(pairs)
    out = validation.validate(ratings, "estimate", "truth", level, "macro" if average == "none" else average, order, compat)
    classes = validation.by_class(table) if average == "none" and level == "nominal" else None
    about = {"variable": by, "level": level, "average": average if level == "nominal" else None}
    return Result(out, Run(name, "validation", parents, call=f"validate(by={by!r}, level={level!r})"), classes, table, about)


@dataclass
class Trail:
    runs: list[Run]
    complete: bool
    data: dict[str, DataFrame] = field(default_factory=dict)

    def __repr__(self) -> str:
        lines = [f"Trail of {len(self.runs)} runs, {'complete' if self.complete else 'with missing parents'}"]
        return "\n".join(lines + [f"  {k}. {r.name}" + (f" (parent: {', '.join(r.parents)})" if r.parents else "") for k, r in enumerate(self.runs, 1)])


def ordered(runs: dict[str, Run]) -> list[Run]:
    """Parents before children, otherwise by time and name; runs on a cycle come last."""
    left, out, placed = dict(runs), [], set()
    while left:
        ready = [r for r in left.values() if all(p in placed or p not in runs for p in r.parents)] or list(left.values())[:1]
        first = min(ready, key=lambda r: (r.timestamp.timestamp(), r.name))
        out.append(first)
        placed.add(first.name)
        del left[first.name]
    return out


def trail(*objects: Coded | Result) -> Trail:
    runs: dict[str, Run] = {}
    data: dict[str, DataFrame] = {}
    for x in objects:
        if not isinstance(x, Coded | Result):
            raise TypeError("a trail takes coded runs, comparisons and validations")
        if x.run is None:
            raise ValueError("an object has no run")
        if x.run.name in runs and runs[x.run.name] is not x.run:
            raise ValueError(f"two runs are named {x.run.name!r}")
        if isinstance(x, Result):
            x.metrics()
        else:
            data[x.run.name] = x.df
            x.count_units()
        runs[x.run.name] = x.run
    complete = all(p in runs for r in runs.values() for p in r.parents)
    return Trail(ordered(runs), complete, data)


def runs_table(spark: SparkSession, t: Trail) -> DataFrame:
    text = lambda d: {str(k): str(v) for k, v in d.items()}
    rows = [
        (r.name, r.kind, list(r.parents), r.timestamp, r.model, r.batch, r.codebook.name if r.codebook else None, r.codebook.json() if r.codebook else None, text(r.chat_args), text(r.execution_args), text(r.metadata), r.call,
         {k: float(v) for k, v in r.metrics.items() if isinstance(v, int | float)})
        for r in t.runs
    ]
    return spark.createDataFrame(rows, RUNS)


def missing_parents(runs: DataFrame) -> DataFrame:
    """(child, parent) for parents that are no run."""
    edges = runs.select(F.col("name").alias("child"), F.explode("parents").alias("parent"))
    return edges.join(runs.select(F.col("name").alias("parent")), "parent", "left_anti").select("child", "parent")


def depths(runs: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(name, depth): 0 for runs without a parent among the runs, else one more than the deepest parent.

    Level by level: a run is placed once all its parents are, so every edge is read once for each level it waits, however many
    paths there are. Runs on a cycle, and those below one, are never placed; their depth is null.
    """
    names = stored(runs.select("name").distinct(), "names")
    edges = runs.select(F.col("name").alias("child"), F.explode("parents").alias("parent")).distinct()
    waiting = stored(edges.join(names.select(F.col("name").alias("parent")), "parent").select("child", "parent"), "edges")
    level = stored(names.join(waiting.select(F.col("child").alias("name")), "name", "left_anti"), "level")
    placed = [level.withColumn("depth", F.lit(0))]
    for depth in range(1, rounds):
        above = stored(waiting.join(level.select(F.col("name").alias("parent")), "parent", "left_anti"), "edges")
        ready = waiting.select(F.col("child").alias("name")).distinct().join(above.select(F.col("child").alias("name")), "name", "left_anti")
        level, waiting = stored(ready, "level"), above
        if level.isEmpty():
            break
        placed.append(level.withColumn("depth", F.lit(depth)))
    every = reduce(DataFrame.unionByName, placed)
    return names.join(every, "name", "left")


def save(t: Trail, path: str, spark: SparkSession) -> None:
    """The runs, the edges and each run's codes as Parquet below ``path``."""
    runs = runs_table(spark, t)
    runs.write.mode("overwrite").parquet(f"{path}/runs")
    runs.select(F.col("name").alias("child"), F.explode("parents").alias("parent")).write.mode("overwrite").parquet(f"{path}/edges")
    for name, df in t.data.items():
        df.write.mode("overwrite").parquet(f"{path}/data/{digest(name)[:16]}")


def exported(t: Trail, file: str | None = None, spark: SparkSession | None = None) -> str:
    """The trail as JSON, also written to ``file`` on any file system if one is named."""
    runs = []
    for r in t.runs:
        one = {"name": r.name, "parent": list(r.parents) if len(r.parents) > 1 else r.parents[0] if r.parents else None, "timestamp": r.timestamp.strftime("%Y-%m-%d %H:%M:%S"), "model": r.model, "temperature": r.temperature, "codebook_name": r.codebook.name if r.codebook else None, "call": r.call, "metadata": {k: v for k, v in r.metadata.items()}}
        runs.append(one)
    text = json.dumps({"complete": t.complete, "n_runs": len(t.runs), "runs": runs}, indent=2, default=str)
    if file is not None:
        write_text(spark or SparkSession.active(), file, text)
    return text


def imported(spark: SparkSession, file: str) -> dict[str, Any]:
    """What ``exported`` wrote."""
    return json.loads(read_text(spark, file))


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The runs and each run's codes, by name, as ``save`` wrote them."""
    runs = spark.read.parquet(f"{path}/runs")
    coded = [r["name"] for r in runs.filter(F.col("kind").isin("coded", "human")).select("name").collect()]
    return runs, {n: spark.read.parquet(f"{path}/data/{digest(n)[:16]}") for n in coded if exists(spark, f"{path}/data/{digest(n)[:16]}")}


#: Facts on a comparison that stand before its metrics.
FACTS = {"level": "Level", "subjects": "Subjects", "raters": "Raters", "kappa_type": "Kappa type", "n": "Units", "n_classes": "Classes"}


def report(t: Trail, file: str, include_comparisons: bool = False, include_validations: bool = False, spark: SparkSession | None = None) -> str:
    """Write the report to a .qmd or .Rmd file and return its text."""
    kind = file.rsplit(".", 1)[-1]
    if kind not in ("qmd", "Rmd"):
        raise ValueError("a report's file must end in .qmd or .Rmd")
    out = ["---", 'title: "Audit trail"', "format: html" if kind == "qmd" else "output: html_document", "---", "", "## Trail summary", ""]
    out += [f"- **Number of runs:** {len(t.runs)}", f"- **Complete:** {'Yes' if t.complete else 'No (missing parent runs)'}", "", "## Timeline", ""]
    for k, r in enumerate(t.runs, 1):
        facts = {"Parent run": ", ".join(r.parents) or "None (original)", "Timestamp": r.timestamp.strftime("%Y-%m-%d %H:%M:%S"), "Model": r.model, "Temperature": r.temperature, "Codebook": r.codebook.name if r.codebook else None, "Units coded": r.metadata.get("n_units")}
        out += [f"### {k}. {r.name}", "", *[f"**{n}:** {v}  " for n, v in facts.items() if v is not None], "", "**Call:**", "", "```python", r.call, "```", ""]
    for wanted, what, title in ((include_comparisons, "comparison", "Inter-rater reliability comparisons"), (include_validations, "validation", "Validation against gold standard")):
        found = [r for r in t.runs if r.kind == what and wanted]
        if found:
            out += [f"## {title}", ""]
        for r in found:
            out += [f"### {r.name}", "", f"- **Runs:** {', '.join(r.parents)}"]
            out += [f"- **{title}:** {r.metrics[n]}" for n, title in FACTS.items() if r.metrics.get(n) is not None]
            out += [f"- **{NAMES[n]}:** {v:.4f}" for n, v in r.metrics.items() if n in NAMES and v is not None] + [""]
    out += ["## System information", ""] + [f"- **{k}:** {v}" for k, v in sorted({(k, str(v)) for r in t.runs for k, v in r.metadata.items() if k in ("spark", "python")})]
    text = "\n".join(out) + "\n"
    write_text(spark or SparkSession.active(), file, text)
    return text


def archive(x: Trail | Coded | Result, *more: Coded | Result, path: str | None = None, spark: SparkSession | None = None, with_report: bool = True) -> Trail:
    """Save, export and report a trail below ``path``."""
    if path is None:
        raise ValueError("path is required")
    if isinstance(x, Trail):
        if more:
            warnings.warn("further objects are ignored where a trail is given", stacklevel=2)
        t = x
    else:
        t = trail(x, *more)
    spark = spark or SparkSession.active()
    save(t, path, spark)
    exported(t, f"{path}/trail.json", spark)
    if with_report:
        report(t, f"{path}/trail.qmd", include_comparisons=True, include_validations=True, spark=spark)
    return t
