"""Registered queries on runs, trails and scalar helpers, with their SQL for DuckDB.

They go through the public interface: coded runs by rules, replications, imported
human codes, comparisons and validations, trails that are saved, exported,
reported and read again, and the older trail interface.
"""

from __future__ import annotations

import re
import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotrail.functions import scalar
from annotrail.operators import corpus, legacy, reliability
from annotrail.operators import ratings as R
from annotrail.plans import codebook as cb
from annotrail.plans import coding, lineage, settings
from annotrail.queries import _ICR_SQL, _KAPPA, _MISS, _NOM, _ORD, NOMINAL, ORDINAL, _agree, _coders, _query, _rounded, _table
from annotrail.session import scratch
from annotrail.sources.backends import ReplayBackend, RuleBackend, images, texts

_SIZE = "length(text)"
_CODED = f"SELECT CAST(doc_id AS VARCHAR) AS unit_id, CASE WHEN {_SIZE} % 2 = 0 THEN 'pos' ELSE 'neg' END AS sentiment, CAST(least({_SIZE} // 500 + 1, 10) AS INT) AS rating FROM documents"
_AGAIN = f"SELECT CAST(doc_id AS VARCHAR) AS unit_id, CASE WHEN {_SIZE} % 3 = 0 THEN 'pos' ELSE 'neg' END AS sentiment, CAST(least({_SIZE} // 400 + 1, 10) AS INT) AS rating FROM documents"
#: Both runs beside each other, as the SQL of agreement takes them.
_RUNS = f"base AS (SELECT a.unit_id, a.sentiment AS x, b.sentiment AS y, a.rating AS i, b.rating AS j FROM ({_CODED}) a JOIN ({_AGAIN}) b USING (unit_id))"


def _rules(of: int = 2, step: int = 500) -> RuleBackend:
    size = F.length("content")
    return RuleBackend(sentiment=F.when(size % of == 0, "pos").otherwise("neg"), rating=F.least(F.floor(size / step) + 1, F.lit(10)))


def _run(spark, sf_dir, **more) -> coding.Coded:
    return coding.code(texts(_table(spark, sf_dir, "documents")), cb.SENTIMENT, "rules/length", _rules(), **more)


def _pair(spark, sf_dir) -> tuple[coding.Coded, coding.Coded]:
    one = _run(spark, sf_dir)
    return one, coding.replicate(one, backend=_rules(3, 400), temperature=0.5)


def _trail(spark, sf_dir) -> lineage.Trail:
    one, two = _pair(spark, sf_dir)
    return lineage.trail(one, two, lineage.compare([one, two], "sentiment", unit="unit_id", strict=False), lineage.validate(one, two, "sentiment", unit="unit_id", strict=False))


def _rows(spark, rows: list[tuple], kinds: str) -> DataFrame:
    return spark.createDataFrame(rows, kinds)


# ---- runs --------------------------------------------------------------------

@_query("SELECT CAST(doc_id AS VARCHAR) AS unit_id, quality, toxic FROM labels")
def human_run(spark, sf_dir):
    return coding.human(_table(spark, sf_dir, "labels").withColumnRenamed("doc_id", ".id"), name="people").df


@_query(f"SELECT 'original' AS run, * FROM ({_CODED}) UNION ALL SELECT 'replication_1', * FROM ({_AGAIN}) UNION ALL SELECT 'replication_2', * FROM ({_AGAIN}) UNION ALL SELECT 'other', * FROM ({_CODED})")
def replicated_runs(spark, sf_dir):
    """A run again with another backend, once more from that one, and with another model, which names it."""
    one, two = _pair(spark, sf_dir)
    three = coding.replicate(two, ancestors={one.run.name: one.run})
    four = coding.replicate(one, model="rules/other")
    return reduce(DataFrame.unionByName, [r.df.select(F.lit(r.run.name).alias("run"), "*") for r in (one, two, three, four)])


@_query(f"SELECT * FROM ({_CODED}) WHERE rating > 3 UNION ALL SELECT unit_id, NULL, NULL FROM ({_CODED}) WHERE NOT rating > 3")
def replayed_run(spark, sf_dir):
    """Stored answers of some units; the others get null codes."""
    answers = _run(spark, sf_dir).df.filter("rating > 3")
    return coding.code(texts(_table(spark, sf_dir, "documents")), cb.SENTIMENT, "stored/answers", ReplayBackend(answers)).df


@_query(_CODED)
def stored_run(spark, sf_dir):
    """The second call finds all answers of the first one, so its own rules, which differ, are never asked."""
    store = scratch(spark, "store")
    _run(spark, sf_dir, store=store)
    return coding.code(texts(_table(spark, sf_dir, "documents")), cb.SENTIMENT, "rules/length", _rules(3, 400), store=store).df


@_query(_AGAIN)
def overwritten_run(spark, sf_dir):
    store = scratch(spark, "store")
    _run(spark, sf_dir, store=store)
    return coding.code(texts(_table(spark, sf_dir, "documents")), cb.SENTIMENT, "rules/length", _rules(3, 400), store=store, overwrite=True).df


@_query("SELECT CAST(item_id AS VARCHAR) AS unit_id, CAST(length(text) AS INT) AS size, text LIKE 'a%' AS first FROM benchmark")
def task_annotate(spark, sf_dir):
    """The older task and annotate."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)
        task = cb.task("size", "Measure the text.", cb.record(size=cb.integer(), first=cb.boolean()))
        units = texts(_table(spark, sf_dir, "benchmark").withColumn("item_id", F.col("item_id").cast("string")), "item_id")
        return settings.annotate(units, task, "rules/size", RuleBackend(size=F.length("content"), first=F.col("content").startswith("a")))


@_query("SELECT CAST(doc_id AS VARCHAR) AS unit_id, CASE WHEN lang IN ('en', 'de') THEN lang END AS tongue FROM documents")
def enum_conform(spark, sf_dir):
    """Values outside an enum become null."""
    docs = _table(spark, sf_dir, "documents")
    book = cb.Codebook("tongue", "Name the language.", cb.record(tongue=cb.enum(["en", "de"])))
    units = docs.select(F.col("doc_id").cast("string").alias("unit_id"), F.col("text").alias("content"), "lang")
    return coding.code(units, book, "rules/lang", RuleBackend(tongue=F.col("lang"))).df


@_query("SELECT 'labels.parquet' AS unit_id UNION ALL SELECT 'nation.parquet'")
def image_units(spark, sf_dir):
    """Units of files, by name, a table in parts as one; the bytes are never read."""
    return images(spark, f"{sf_dir}/{{labels,nation}}.parquet", folders=True).select("unit_id")


@_query("SELECT 'Sentiment analysis' AS name UNION ALL SELECT 'converted'")
def codebook_names(spark, sf_dir):
    """A codebook as it is, and a task as a codebook."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)
        task = cb.task("converted", "Code this.", cb.record(x=cb.string()))
    return _rows(spark, [(cb.as_codebook(x).name,) for x in (cb.SENTIMENT, task)], "name string")


# ---- comparisons and trails ----------------------------------------------------

@_query("WITH " + _NOM + ", kap AS (" + _KAPPA.format(a="quality", b="length") + f") SELECT round({_agree(NOMINAL[:2])}, 6) AS percent_agreement, any_value(kap.kappa) AS kappa, count(*) AS subjects FROM base, kap")
def compare_plain_tables(spark, sf_dir):
    """Plain tables as coders, named by their place."""
    r = _coders(spark, sf_dir, "nominal", NOMINAL[:2])
    tables = [r.filter(F.col("rater_id") == n).select(F.col("unit_id").alias(".id"), F.col("num").alias("good")) for n in NOMINAL[:2]]
    return _rounded(lineage.compare(tables, "good").df.select("percent_agreement", "kappa", "subjects"))


@_query("WITH " + _RUNS + ", kap AS (" + _KAPPA.format(a="x", b="y") + """),
 s AS (SELECT avg(CAST(x = y AS INT)) AS same, count(*) AS n FROM base)
 SELECT 'percent_agreement' AS metric, round(same, 6) AS value FROM s UNION ALL SELECT 'kappa', kappa FROM kap UNION ALL SELECT 'subjects', n FROM s UNION ALL SELECT 'raters', 2""")
def comparison_metrics(spark, sf_dir):
    """The metrics of two runs as rows."""
    found = lineage.compare(list(_pair(spark, sf_dir)), "sentiment", unit="unit_id")
    return _rounded(found.long().filter("metric <> 'alpha_nominal'"))


@_query("WITH " + _RUNS + """, c AS (SELECT y AS truth, x AS estimate, count(*) AS n FROM base GROUP BY 1, 2),
 k AS (SELECT truth AS class, sum(n) AS t, sum(n) FILTER (truth = estimate) AS tp FROM c GROUP BY 1), e AS (SELECT estimate AS class, sum(n) AS e FROM c GROUP BY 1)
 SELECT 'recall' AS metric, round(avg(tp / t), 6) AS value FROM k UNION ALL SELECT 'precision', round(avg(tp / e), 6) FROM k JOIN e USING (class)
 UNION ALL SELECT 'accuracy', round(sum(tp) / sum(t), 6) FROM k UNION ALL SELECT 'n_classes', count(*) FROM k UNION ALL SELECT 'n', sum(t) FROM k""")
def validation_metrics(spark, sf_dir):
    one, two = _pair(spark, sf_dir)
    found = lineage.validate(one, two, "sentiment", unit="unit_id")
    return _rounded(found.long().filter("metric not in ('kappa', 'f1')"))


@_query("SELECT 'sentiment' AS variable, 'nominal' AS level, 'macro' AS average, count(DISTINCT CASE WHEN length(text) % 2 = 0 THEN 1 ELSE 0 END) AS n_classes FROM documents")
def validation_about(spark, sf_dir):
    found = lineage.validate(*_pair(spark, sf_dir), "sentiment", unit="unit_id")
    return _rows(spark, [(found.variable, found.level, found.average, found.n_classes)], "variable string, level string, average string, n_classes bigint")


_TRAIL_SQL = """SELECT * FROM (VALUES ('original', 'coded', 0, 'rules/length', NULL), ('replication_1', 'coded', 1, 'rules/length', '0.5')) v(name, kind, n_parents, model, temperature)
 UNION ALL SELECT kind, kind, 2, NULL, NULL FROM (VALUES ('comparison'), ('validation')) w(kind)"""


def _plain(runs: DataFrame) -> DataFrame:
    """Runs without times; of names with a digest the kind."""
    return runs.select(F.regexp_replace("name", "_[0-9a-f]{8}$", "").alias("name"), "kind", F.size("parents").alias("n_parents"), "model", F.col("chat_args")["temperature"].alias("temperature"))


@_query(_TRAIL_SQL)
def trail_runs(spark, sf_dir):
    return _plain(lineage.runs_table(spark, _trail(spark, sf_dir)))


@_query(_TRAIL_SQL)
def trail_saved(spark, sf_dir):
    path = scratch(spark, "trail")
    lineage.save(_trail(spark, sf_dir), path, spark)
    return _plain(lineage.load(spark, path)[0])


@_query(f"SELECT 'original' AS run, * FROM ({_CODED}) UNION ALL SELECT 'replication_1', * FROM ({_AGAIN})")
def trail_codes(spark, sf_dir):
    """The codes of an archived trail, read again."""
    path = scratch(spark, "trail")
    lineage.archive(_trail(spark, sf_dir), path=path, spark=spark)
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("run"), "*") for n, df in lineage.load(spark, path)[1].items()])


@_query("""SELECT v.*, CASE WHEN n_units THEN CAST((SELECT count(*) FROM documents) AS BIGINT) END AS n_units FROM (VALUES ('original', NULL, 'Sentiment analysis'), ('replication_1', 'original', 'Sentiment analysis'), ('comparison', 'original,replication_1', NULL),
 ('validation', 'original,replication_1', NULL)) v(name, parent, codebook), (SELECT true AS n_units) WHERE codebook IS NOT NULL UNION ALL
 SELECT w.*, NULL FROM (VALUES ('comparison', 'original,replication_1', NULL), ('validation', 'original,replication_1', NULL)) w(name, parent, codebook)""")
def trail_exported(spark, sf_dir):
    """The JSON file of a trail, read again."""
    path = scratch(spark, "trail") + ".json"
    lineage.exported(_trail(spark, sf_dir), path, spark)
    rows = [(re.sub("_[0-9a-f]{8}$", "", r["name"]), ",".join(r["parent"]) if isinstance(r["parent"], list) else r["parent"], r["codebook_name"], r["metadata"].get("n_units")) for r in lineage.imported(spark, path)["runs"]]
    return _rows(spark, rows, "name string, parent string, codebook string, n_units bigint")


@_query("WITH " + _RUNS + """ SELECT '**Units coded:** ' || count(*) AS line, CAST(2 AS BIGINT) AS n FROM base UNION ALL SELECT '- **Percent agreement:** ' || printf('%.4f', avg(CAST(x = y AS INT))), 1 FROM base
 UNION ALL SELECT '- **Accuracy:** ' || printf('%.4f', avg(CAST(x = y AS INT))), 1 FROM base UNION ALL SELECT '- **Subjects:** ' || count(*), 1 FROM base UNION ALL SELECT '- **Kappa type:** Cohen''s', 1 UNION ALL SELECT '- **Number of runs:** 4', 1 UNION ALL SELECT '- **Complete:** Yes', 1""")
def trail_report(spark, sf_dir):
    """Some lines of the report and how often they stand there."""
    text = lineage.report(_trail(spark, sf_dir), scratch(spark, "report") + ".qmd", True, True, spark)
    wanted = r"\*\*Units coded|Percent agreement|Accuracy|Subjects|Kappa type|Number of runs|\*\*Complete"
    lines = [x.strip() for x in text.split("\n") if re.search(wanted, x)]
    return _rows(spark, [(x,) for x in lines], "line string").groupBy("line").agg(F.count("*").alias("n"))


@_query("SELECT * FROM (VALUES ('original', 1), ('replication_1', 2), ('comparison', 3), ('validation', 4)) v(name, place)")
def trail_sorted(spark, sf_dir):
    """Runs of a trail, parents first, whatever order they were given in."""
    t = _trail(spark, sf_dir)
    runs = lineage.ordered({r.name: r for r in reversed(t.runs)})
    names = [re.sub("_[0-9a-f]{8}$", "", r.name) for r in runs]
    return _rows(spark, [(n, k) for k, n in enumerate(names, 1)], "name string, place int")


# ---- the older trail interface --------------------------------------------------

_LABEL = "CASE WHEN length(text) % {n} = 0 THEN 'long' ELSE 'short' END"
_OLD = f"SELECT CAST(doc_id AS VARCHAR) AS id, {_LABEL.format(n=2)} AS a, {_LABEL.format(n=3)} AS b FROM documents"


def _records(spark, sf_dir, **more) -> dict[str, settings.Record]:
    book = cb.Codebook("label", "Label the text.", cb.record(label=cb.string()))
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    rule = {n: RuleBackend(label=F.when(F.length("content") % k == 0, "long").otherwise("short")) for n, k in (("a", 2), ("b", 3))}
    return {n: settings.record(docs, "text", book, settings.Setting(model=n, temperature=0.5), rule[n], **more) for n in rule}


@_query(f"SELECT id, a AS label FROM ({_OLD})")
def old_record(spark, sf_dir):
    return _records(spark, sf_dir, cache_dir=scratch(spark, "records"), overwrite=True)["a"].df


@_query(_OLD)
def old_matrix(spark, sf_dir):
    return settings.matrix(_records(spark, sf_dir))


@_query(f"WITH base AS (SELECT id AS unit_id, a, b FROM ({_OLD})), kap AS (" + _KAPPA.format(a="a", b="b") + """)
 SELECT 'units_included' AS metric, CAST(count(*) AS DOUBLE) AS value FROM base UNION ALL SELECT 'coders', 2 UNION ALL SELECT 'categories', 2
 UNION ALL SELECT 'percent_unanimous_units', round(avg(CAST(a = b AS INT)), 4) FROM base UNION ALL SELECT 'mean_pairwise_percent_agreement', round(avg(CAST(a = b AS INT)), 4) FROM base
 UNION ALL SELECT 'mean_pairwise_cohens_kappa', round(kappa, 4) FROM kap""")
def old_icr(spark, sf_dir):
    """Reliability of records through the pluggable function, as long rows."""
    found = settings.icr(_records(spark, sf_dir), output="data.frame")
    return found.filter("metric not in ('kripp_alpha_nominal', 'fleiss_kappa')")


@_query("SELECT 'openai' AS provider, 'a' AS model, CAST(0.5 AS DOUBLE) AS temperature UNION ALL SELECT 'openai', 'b', 0.5")
def old_settings(spark, sf_dir):
    return _rows(spark, [(r.setting.provider, r.setting.model, r.setting.temperature) for r in _records(spark, sf_dir).values()], "provider string, model string, temperature double")


@_query(f"SELECT metric, value FROM (UNPIVOT (SELECT * FROM ({_ICR_SQL})) ON COLUMNS(* EXCLUDE (units_included, coders, categories)) INTO NAME metric VALUE value)")
def legacy_long(spark, sf_dir):
    """The older reliability as rows; counts left out."""
    wide = R.ratings_wide(_coders(spark, sf_dir, "nominal", NOMINAL, False), NOMINAL)
    return legacy.validate(wide, "unit_id", NOMINAL, output="data.frame").filter("metric not in ('units_included', 'coders', 'categories')")


@_query("""WITH d AS (SELECT doc_id, source, length(text) // 1000 AS size, lang FROM documents), f AS (SELECT source AS unit_id, arg_min(size, doc_id) AS a, arg_min(lang, doc_id) AS b FROM d GROUP BY source)
 SELECT unit_id, 'size' AS rater_id, CAST(a AS VARCHAR) AS code FROM f UNION ALL SELECT unit_id, 'lang', b FROM f""")
def first_by_order(spark, sf_dir):
    """Of each unit the first code in order of the rows."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "source", F.floor(F.length("text") / 1000).cast("string").alias("size"), "lang")
    return R.first_codes(R.wide_to_long(d, "source", ["size", "lang"], "doc_id"), "doc_id").select("unit_id", "rater_id", "code")


# ---- single statistics, warnings and checks -------------------------------------

@_query("WITH " + _ORD + f", kap AS (" + _KAPPA.format(a="priority", b="customer") + f") SELECT round(any_value(kap.kappa), 6) AS kappa, round({_agree(ORDINAL[:2], 1)}, 6) AS agreement FROM base, kap")
def compute_one(spark, sf_dir):
    """One statistic by measure."""
    r = _coders(spark, sf_dir, "ordinal", ORDINAL[:2])
    found = [reliability.compute(r, ORDINAL[:2], "kappa"), reliability.compute(r, ORDINAL[:2], "agreement", "interval", 1)]
    return _rounded(_rows(spark, [tuple(found)], "kappa double, agreement double"))


@_query("WITH " + _MISS + " SELECT 1 AS repeats, count(*) FILTER (true) AS common, count(*) FILTER (quality IS NOT NULL AND length IS NOT NULL AND language IS NOT NULL) AS complete FROM base")
def preconditions(spark, sf_dir):
    found = R.check(_coders(spark, sf_dir, "nominal", NOMINAL, False), NOMINAL)
    return _rows(spark, [(found["repeats"], found["common"], found["complete"])], "repeats int, common bigint, complete bigint")


@_query("SELECT 'At least two coders are needed for a comparison' AS message UNION ALL SELECT 'level must be one of nominal, ordinal, interval' UNION ALL SELECT 'min_coders must be a whole number of 2 or more' UNION ALL SELECT 'no unit has codes of 3 coders or more'")
def checked_arguments(spark, sf_dir):
    """What wrong arguments and tables without units are told."""
    wide = R.ratings_wide(_coders(spark, sf_dir, "nominal", NOMINAL[:2]), NOMINAL[:2])
    one = wide.withColumnRenamed("unit_id", ".id")
    calls = [lambda: lineage.compare([one], "quality"), lambda: lineage.validate(one, one, "quality", "ratio"), lambda: legacy.validate(wide, "unit_id", NOMINAL[:2], 1)]
    told = [legacy.validate(wide, "unit_id", NOMINAL[:2], 3)["message"]]
    for call in calls:
        try:
            call()
        except ValueError as error:
            told.append(str(error))
    return _rows(spark, [(x,) for x in told], "message string")


@_query("SELECT 'Pearson''s r, ICC' AS told")
def undefined_statistics(spark, sf_dir):
    """A statistic that can't be computed is null, and named in a warning."""
    r = _coders(spark, sf_dir, "interval", ["quantity"])
    same = r.select(F.col("unit_id").alias(".id"), F.lit(1.0).alias("x"))
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        row = lineage.compare([same, same], "x", "interval").metrics()
    names = ["Pearson's r"] * (row["r"] is None) + ["ICC"] * (row["icc"] is None)
    told = str(seen[-1].message) if seen else ""
    return _rows(spark, [(", ".join(n for n in names if n in told),)], "told string")


@_query("WITH " + _ORD + " SELECT 'priority' AS rater_id, CAST(count(*) AS BIGINT) AS n FROM base UNION ALL SELECT 'rater2', count(*) FROM base")
def rater_names(spark, sf_dir):
    """Blank names are numbered."""
    r = _coders(spark, sf_dir, "ordinal", ORDINAL[:2])
    tables = {n: r.filter(F.col("rater_id") == x).select(F.col("unit_id").alias(".id"), "num") for n, x in (("priority", "priority"), ("", "customer"))}
    return R.ratings_long(tables, "num").groupBy("rater_id").agg(F.count("*").alias("n"))


# ---- scalar helpers ---------------------------------------------------------------

@_query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS a, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) END AS b, CAST(o_custkey % 2 = 0 AS VARCHAR) AS c FROM orders")
def canonical_text(spark, sf_dir):
    """One text for 1 and 1.0; decimals without zeros at the end."""
    d = _table(spark, sf_dir, "orders")
    whole = F.col("o_totalprice").cast("double") == F.floor(F.col("o_totalprice").cast("double"))
    d = d.select("o_orderkey", F.col("o_custkey").cast("double").alias("a"), F.when(whole, F.col("o_totalprice").cast("decimal(20,2)")).alias("b"), (F.col("o_custkey") % 2 == 0).alias("c"))
    return d.select("o_orderkey", *[scalar.label(F.col(c), d.schema[c].dataType).alias(c) for c in "abc"])


@_query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS INT) AS tokens, CASE WHEN length(text) <= 60 THEN text ELSE substr(text, 1, 60) || '...' END AS head FROM documents")
def text_helpers(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", scalar.tokens(F.col("text")).alias("tokens"), scalar.clipped(F.col("text")).alias("head"))


@_query(r"SELECT page_id, regexp_replace(url, '^.*/', '') AS model, list_last(string_split(url, '/')) AS base, regexp_replace('doc.' || page_id, '\.[0-9]+$', '') AS name FROM pages")
def name_helpers(spark, sf_dir):
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", scalar.last_part(url).alias("model"), scalar.base_name(url).alias("base"), scalar.without_number(F.concat(F.lit("doc."), F.col("page_id").cast("string"))).alias("name"))


@_query("SELECT 'You are an expert.' || chr(10) || chr(10) || 'Code it.' AS prompt UNION ALL SELECT 'Code it.'")
def prompts(spark, sf_dir):
    """Role and instructions; a role that is missing or empty leaves none."""
    books = [cb.Codebook("x", "Code it.", cb.record(y=cb.string()), role) for role in ("You are an expert.", None, "")]
    return _rows(spark, [(b.prompt(),) for b in books], "prompt string").distinct()


@_query("SELECT * FROM (VALUES ('temperature', 'chat'), ('max_active', 'send'), ('wait', 'batch send'), ('colour', 'unknown')) v(option, goes)")
def routed_options(spark, sf_dir):
    options = {"temperature": 0, "max_active": 3, "wait": True, "colour": 1}
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        (chat, send), (_, batch) = (coding.routed(options, b) for b in (False, True))
    rows = [(k, "chat" if k in chat else "send" if k in send else "batch send" if k in batch else "unknown" if k in str(seen[-1].message) else "lost") for k in options]
    return _rows(spark, rows, "option string, goes string")


@_query("SELECT 64 AS length, 1 AS same, 2 AS kinds")
def digests(spark, sf_dir):
    """Equal values have one digest whatever the order of their keys; others another."""
    a, b, c = coding.digest({"x": 1, "y": 2}), coding.digest({"y": 2, "x": 1}), coding.digest({"x": 2})
    return _rows(spark, [(len(a), len({a, b}), len({a, b, c}))], "length int, same int, kinds int")


# ---- corpus ------------------------------------------------------------------------

@_query("SELECT doc_id, source, lang FROM documents WHERE source = 'src1' AND lang = 'en'")
def filter_by_variable(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "source", "lang").filter("source = 'src1' and lang = 'en'")


@_query("""WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
 w AS (SELECT DISTINCT lang, n FROM d), t AS (SELECT lang, draw, CAST('0x' || substr(md5(coalesce(lang, '') || '|' || draw || '|1'), 1, 13) AS BIGINT) % n AS i FROM w, range(1, 101) r(draw))
 SELECT d.doc_id, d.lang, CAST(t.draw AS INT) AS draw FROM t JOIN d ON t.i = d.i AND t.lang IS NOT DISTINCT FROM d.lang""")
def stratified_with_replacement(spark, sf_dir):
    return corpus.stratified_with_replacement(_table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], 100, "doc_id")


@_query("SELECT doc_id, position FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position FROM documents) WHERE position IN (1, 2, 10, 50)")
def corpus_subset(spark, sf_dir):
    """Documents at positions of the corpus."""
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    found = corpus.sequence_ids(docs, ["doc_id"]).select("doc_id", "position")
    return found.join(corpus.positions(docs, [1, 2, 10, 50], ["doc_id"]), "doc_id", "left_semi")


@_query("SELECT 'Corpus with variables doc_id, lang' AS line UNION ALL SELECT '1: ' || CASE WHEN length(text) <= 60 THEN text ELSE substr(text, 1, 60) || '...' END FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 1)")
def corpus_preview(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text").orderBy("doc_id")
    head, _, rest = corpus.preview(docs, n=1).partition("\n")
    return _rows(spark, [(head,), (rest,)], "line string")
