"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    text = lambda n=60: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    item = " ".join(f"bench{k}" for k in range(15))
    clean = [text() for _ in range(200)]
    toxic = [text(30) + " Grobian wretched " + text(30) for _ in range(40)]
    copy = text(80)
    near = copy.replace(copy.split()[40], "edited", 1)
    leak = text() + " " + item + " " + text()
    menu = [f"{text()}\nSite menu here" for _ in range(60)]
    texts = [*clean, *toxic, copy, copy, near, leak, *menu]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(200 <= k < 240)) for k in range(240)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    at = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, d)
        assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        at.write.parquet(out := f"{d}/out-{len(seen)}")
        at = spark.read.parquet(out)
        seen[name] = {r.doc_id: r.text for r in at.collect()}
    tox, lines, dup, leaks, _ = seen.values()
    assert not any(200 <= k < 240 for k in tox) and all(k in tox for k in range(200))
    assert not any("Site menu" in t for t in lines.values()) and len(lines) == len(tox)
    assert sorted(k for k in dup if 240 <= k < 243) == [240] and all(k in dup for k in range(200))
    assert "bench7" not in leaks[243] and leaks[0] == clean[0]
    mixed = corpus_pipeline.run(spark, d)
    assert mixed.groupBy("doc_id").count().filter("count > 2").isEmpty() and not mixed.isEmpty()


def test_stages_of_odd_tables(spark, tmp_path):
    """Nulls in any column, repeated rows, a very long text, further columns of clashing names, and an empty table."""
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, component string, host int, c0 string, h string, y int, n int, __x string"
    more = ("i", "c", 1, "z", "h", 2, 3, "x")
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
    rows = [(1, "plain words here " * 9, "en", "s", 5, *more)] * 3 + [(None, None, None, None, None, *[None] * 8), (2, None, "en", None, 1, *more), (None, "some text of its own", None, "s", None, *more), (3, "", "en", "s", 0, *more), (4, long, "en", "s", len(long), *more)]
    for name, some in (("odd", rows), ("empty", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(some, kinds).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, None, None), (3, 0, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "a benchmark item of ten words that no text holds at all"), (None, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
        at = spark.read.parquet(f"{d}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, d)
            assert at.columns == [f.split()[0] for f in kinds.split(", ")], stage_name
        assert (at.count() > 0) == bool(some)
