"""Codebooks, coding runs, lineage and corpus helpers."""

import json
import warnings

import pytest
from pyspark.sql import functions as F

from annotrail.functions.scalar import label
from annotrail.operators import corpus, legacy
from annotrail.plans import codebook as cb
from annotrail.plans import coding, lineage, settings
from annotrail.sources.backends import CallBackend, ReplayBackend, RuleBackend, images, texts
from annotrail.sources.batch import BatchBackend, BatchPending
from annotrail.streaming.coding import coded_stream


@pytest.fixture()
def units(spark):
    return spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", "so so")], "unit_id string, content string")


def rules():
    return RuleBackend(sentiment=F.when(F.col("content") == "bad", "neg").when(F.col("content") == "good", "pos").otherwise("mixed"), rating=F.length("content"))


def test_codebook_and_task():
    assert cb.SENTIMENT.schema.spark().simpleString() == "struct<sentiment:string,rating:int>"
    assert cb.SENTIMENT.prompt().startswith("You are a political") and "\n\nAnalyze" in cb.SENTIMENT.prompt()
    with pytest.warns(DeprecationWarning):
        t = cb.task("old", "Code this.", cb.record(x=cb.array(cb.string())))
    assert cb.as_codebook(t).instructions == "Code this." and cb.as_codebook(t).schema.spark().simpleString() == "struct<x:array<string>>"
    with pytest.raises(ValueError):
        cb.Codebook("x", "y", cb.record(), input_type="sound")
    with pytest.raises(TypeError):
        cb.as_codebook(3)


def test_code_checks_enums_and_options(spark, units):
    with pytest.warns(UserWarning, match="not recognized"):
        run = coding.code(units, cb.SENTIMENT, "rules/x", rules(), temperature=0, max_active=2, nonsense=1)
    got = {r.unit_id: (r.sentiment, r.rating) for r in run.df.collect()}
    assert got == {"1": ("pos", 4), "2": ("neg", 3), "3": (None, 5)}
    assert run.run.chat_args["temperature"] == 0 and run.run.execution_args == {"max_active": 2}
    with pytest.raises(TypeError, match="expects text input"):
        coding.code(spark.range(1), cb.SENTIMENT, "m", rules())
    with pytest.raises(TypeError, match="expects text input"):
        texts(spark.range(1).withColumnRenamed("id", "text"))


def test_replicate_names_and_options(units):
    first = coding.code(units, cb.SENTIMENT, "a/one", rules(), temperature=0.5, rpm=None)
    again = coding.replicate(first)
    third = coding.replicate(again, ancestors={r.run.name: r.run for r in (first, again)})
    assert [first.run.name, again.run.name, third.run.name] == ["original", "replication_1", "replication_2"]
    fourth = coding.replicate(third, ancestors={r.run.name: r.run for r in (first, again, third)})
    assert fourth.run.name == "replication_3" and fourth.run.chat_args["temperature"] == 0.5
    other = coding.replicate(first, model="b/two-20250514")
    assert other.run.name == "two-20250514" and other.run.parents == ("original",)


def test_human_and_replay(spark, units):
    data = spark.createDataFrame([(1, "pos"), (2, "neg")], "`.id` int, sentiment string")
    h = coding.human(data, metadata={"source": "mine", "who": "x"})
    assert h.input_type == "human" and h.run.metadata["source"] == "human" and h.run.metadata["who"] == "x"
    with pytest.raises(ValueError):
        coding.human(data.withColumnRenamed(".id", "id"))
    with pytest.raises(ValueError):
        coding.replicate(h)
    stored = spark.createDataFrame([("1", "neg", 9)], "unit_id string, sentiment string, rating int")
    got = {r.unit_id: r.sentiment for r in coding.code(units, cb.SENTIMENT, "m", ReplayBackend(stored)).df.collect()}
    assert got == {"1": "neg", "2": None, "3": None}


def test_store_resumes_and_errors_are_isolated(spark, units, tmp_path):
    def ask(prompt, content, options):
        if content == "bad":
            raise RuntimeError("no")
        return {"sentiment": "pos", "rating": len(content)}

    run = coding.code(units, cb.SENTIMENT, "m", CallBackend(ask), store=str(tmp_path))
    assert {r.unit_id: r.rating for r in run.df.collect()} == {"1": 4, "2": None, "3": 5}
    again = coding.code(units, cb.SENTIMENT, "m", rules(), store=str(tmp_path))
    assert {r.unit_id: r.rating for r in again.df.collect()} == {"1": 4, "2": 3, "3": 5}


def test_batch_job_goes_on(spark, units, tmp_path):
    class Service:
        def __init__(self):
            self.sent, self.done = [], False

        def submit(self, requests, prompt, options):
            self.sent.append(requests)
            return "job-1"

        def answers(self, job):
            if not self.done:
                return None
            out = str(tmp_path / "answers")
            spark.read.json(self.sent[0]).selectExpr("unit_id", "'pos' as sentiment", "length(content) as rating").write.mode("overwrite").json(out)
            return out

    service = Service()
    ask = lambda u=units, **more: coding.code(u, cb.SENTIMENT, "m", BatchBackend(service, str(tmp_path / "jobs"), 0.01), batch=True, **more)
    with pytest.raises(BatchPending):
        ask(wait=False)
    service.done = True
    assert {r.unit_id: r.rating for r in ask(wait=True).df.collect()} == {"1": 4, "2": 3, "3": 5} and len(service.sent) == 1
    with pytest.raises(ValueError):
        ask(units.filter("unit_id = '1'"))
    assert ask(units.filter("unit_id = '1'"), ignore_hash=True).df.count() == 1


def test_tokens_cost_and_overwrite(spark, units, tmp_path):
    def ask(prompt, content, options):
        return {"sentiment": "pos", "rating": 1}, {"input_tokens": len(content), "output_tokens": 2, "cost": 0.5}

    run = coding.code(units, cb.SENTIMENT, "m", CallBackend(ask), include_tokens=True, include_cost=True)
    assert run.df.columns == ["unit_id", "sentiment", "rating", "input_tokens", "output_tokens", "cost", "error"] and run.total_cost() == 1.5
    assert json.loads(coding.code(units, cb.SENTIMENT, "m", CallBackend(ask), convert=False).df.first().answer) == {"sentiment": "pos", "rating": 1}
    assert run.count_units() == 3 and run.run.metadata["n_units"] == 3
    coding.code(units, cb.SENTIMENT, "m", CallBackend(ask), store=str(tmp_path))
    again = coding.code(units, cb.SENTIMENT, "m", rules(), store=str(tmp_path), overwrite=True)
    assert {r.unit_id: r.rating for r in again.df.collect()} == {"1": 4, "2": 3, "3": 5}


def test_depths_of_diamonds_and_cycles(spark):
    rows = [("r", [])] + [(f"{x}{k}", [f"a{k - 1}", f"b{k - 1}"] if k else ["r"]) for k in range(6) for x in "ab"] + [("x", ["y"]), ("y", ["x"]), ("z", ["x", "r"])]
    got = {r.name: r.depth for r in lineage.depths(spark.createDataFrame(rows, "name string, parents array<string>")).collect()}
    assert got["r"] == 0 and got["a5"] == got["b5"] == 6 and got["x"] is got["y"] is got["z"] is None and len(got) == 16


def test_first_code_by_order_and_decimal_ids(spark):
    d = spark.createDataFrame([(1, "u", "b", "b"), (2, "u", "a", "b"), (3, "v", "a", "a")], "k int, id string, x string, y string")
    assert legacy.validate(d, "id", ["x", "y"])["percent_unanimous_units"] == 0.5
    assert legacy.validate(d, "id", ["x", "y"], order="k")["percent_unanimous_units"] == 1.0
    big = spark.sql("select cast('9007199254740993' as decimal(20,0)) i union all select cast('9007199254740992' as decimal(20,0)) union all select 3")
    assert sorted(r.t for r in big.select(label(F.col("i"), big.schema["i"].dataType).alias("t")).collect()) == ["3", "9007199254740992", "9007199254740993"]
    cents = spark.sql("select cast('1.50' as decimal(10,2)) i union all select cast('2.00' as decimal(10,2)) union all select cast('100' as decimal(10,2))")
    assert sorted(r.t for r in cents.select(label(F.col("i"), cents.schema["i"].dataType).alias("t")).collect()) == ["1.5", "100", "2"]


def test_images(spark, tmp_path):
    for n in ("a.png", "b.jpg"):
        (tmp_path / n).write_bytes(b"x")
    assert sorted(r.unit_id for r in images(spark, str(tmp_path)).collect()) == ["a.png", "b.jpg"]


def test_trail(spark, units, tmp_path):
    one = coding.code(units, cb.SENTIMENT, "a/one", rules(), params={"temperature": 0.5})
    two = coding.replicate(one)
    c = lineage.compare([one, two], "sentiment")
    v = lineage.validate(one, two, "sentiment")
    t = lineage.trail(v, c, two, one)
    assert t.complete and [r.name for r in t.runs][:2] == ["original", "replication_1"] and len(t.runs) == 4
    assert not lineage.trail(two).complete
    with pytest.raises(TypeError):
        lineage.trail(3)
    lineage.archive(t, path=str(tmp_path / "a"), spark=spark)
    j = json.loads((tmp_path / "a/trail.json").read_text())
    assert j["n_runs"] == 4 and j["complete"] and j["runs"][0]["temperature"] == 0.5 and j["runs"][0]["codebook_name"] == "Sentiment analysis"
    assert spark.read.parquet(str(tmp_path / "a/runs")).count() == 4
    text = lineage.report(t, str(tmp_path / "r.Rmd"), True, True)
    assert "Inter-rater reliability comparisons" in text and "Validation against gold standard" in text and "output: html_document" in text
    assert "format: html" in (tmp_path / "a/trail.qmd").read_text()
    with pytest.raises(ValueError):
        lineage.report(t, str(tmp_path / "r.txt"))
    with pytest.raises(ValueError):
        lineage.archive(t)
    runs = lineage.runs_table(spark, t)
    assert lineage.missing_parents(runs).isEmpty()
    assert {r.name: r.depth for r in lineage.depths(runs).collect()}["replication_1"] == 1


def test_older_trail(spark):
    d = spark.createDataFrame([("1", "good"), ("2", "bad")], "id string, text string")
    book = cb.Codebook("l", "label", cb.record(label=cb.string()))
    a, b = RuleBackend(label=F.col("content")), RuleBackend(label=F.lit("good"))
    got = settings.compare(d, "text", book, {"a": settings.Setting(), "b": settings.Setting(model="x")}, {"a": a, "b": b})
    assert got["icr"]["mean_pairwise_percent_agreement"] == 0.5
    with pytest.raises(ValueError):
        settings.Setting(temperature=3)
    with pytest.warns(DeprecationWarning):
        settings.annotate(texts(d, "id"), book, "m", a)


def test_corpus(spark):
    d = spark.createDataFrame([(k, "abc"[k % 3], f"t{k % 4}") for k in range(30)], "doc_id int, g string, text string")
    assert corpus.stratified(d, ["g"], 4).groupBy("g").count().filter("count <> 4").isEmpty()
    drawn = corpus.stratified_with_replacement(d, ["g"], 20)
    assert drawn.count() == 60 and drawn.join(d, ["doc_id", "g"], "left_anti").isEmpty()
    assert [r.doc_id for r in corpus.distinct_texts(d).orderBy("doc_id").collect()] == [0, 1, 2, 3]
    assert [r.doc_id for r in corpus.positions(d, [1, 30], ["g", "doc_id"]).orderBy("doc_id").collect()] == [0, 29]
    assert corpus.crosstab(d, "g", "text", ["t0"]).filter("g = 'Total'").first().total == 30
    assert corpus.preview(d).count("\n") == 2


def test_stream(spark, units, tmp_path):
    units.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(units.schema).parquet(str(tmp_path / "in"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        q = coded_stream(stream, cb.SENTIMENT, rules()).writeStream.format("memory").queryName("coded").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("coded").filter("sentiment = 'neg'").count() == 1
