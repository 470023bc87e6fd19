"""Line dedup by site-relative frequency.

A line is boilerplate of a host if more than ``max_ratio`` of the host's pages
have it, and ``min_pages`` pages at least. A page counts once for a line however
often the line is in it, and pages of one host with the same text count as one
page, above and below the fraction line: mirrored copies are the business of
near-duplicate removal and don't make their lines boilerplate.

As a page has each line once, a host has at most (mean distinct lines of a
page) / ``max_ratio`` lines above the ratio, however many pages it has; that
bounds the list kept for each host in ``report``.

That is the measure of ``report``, whose SQL fixes both values. ``dedup_lines``
also cuts lines far above their chance count, at every host size (``CHANCE``):
if no word makes up more than ``COMMON`` of a text's words, a line of k words
comes up by chance at most (lines of the host) x ``COMMON`` ^ k times, and a line
on ten times as many pages, and ``min_pages`` at least, is no prose. On a host of
three or four pages it must be on all of them; two pages tell nothing. As near
copies share prose, pages with the same longest line count once here.

Defined cases: lines end at ``\\n``; a line is compared without spaces at its
ends; lines without a word are never dropped. A null host is a host. A null
text is no page and stays null. A text may lose all its lines and is then
empty. Repeated rows are pages with the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotrail.llm.common import like, perhaps, stored, text_key

MAX_RATIO = 0.1
MIN_PAGES = 5
#: A line on this many times its chance count isn't there by chance.
CHANCE = 10.0
#: At least the share of the most frequent word among all words.
COMMON = 0.1
#: Words are counted in so many first characters of a line; more words make no difference.
HEAD = 200


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _name(line: Column) -> Column:
    """The 128 bits by which a line is known; null for one without a word."""
    line = F.trim(line)
    return F.when(line.rlike(r"[^\x20\x09-\x0D]"), F.md5(line.cast("binary")))


def _words(line: Column) -> Column:
    """Words in the line's first ``HEAD`` characters."""
    return F.size(F.filter(F.split(F.substring(F.trim(line), 1, HEAD), r"[\x20\x09-\x0D]+"), lambda x: x != ""))


def frequent(
    docs: DataFrame, host_col: str, text_col: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, chance: float | None = None
) -> DataFrame:
    """host, line: the name of each boilerplate line of a host; with ``chance``, also of those beyond it."""
    page = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("t")).filter("t is not null")
    lines = _lines(F.col("t"))
    if chance is None:
        each, lead = F.transform(lines, lambda x: F.struct(_name(x).alias("line"))), F.lit(0)
    else:
        each = F.transform(lines, lambda x: F.struct(_name(x).alias("line"), _words(x).alias("words")))
        lead = F.xxhash64(F.trim(F.array_max(F.transform(lines, lambda x: F.struct(F.length(F.trim(x)), x.alias("x"))))["x"]))
    page = page.select("host", text_key(F.col("t")).alias("page"), lead.alias("lead"), F.array_distinct(F.filter(each, lambda x: x["line"].isNotNull())).alias("lines"))
    # One row for each line of each page; equal pages meet before lines are counted.
    seen = page.select("host", "page", "lead", F.inline("lines")).distinct()
    total = page.select("host", "page", "lead", F.size("lines").alias("size")).distinct().groupBy("host").agg(F.count("*").alias("pages"), F.sum("size").alias("size"))
    if chance is None:
        count = seen.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
        beyond = F.lit(False)
    else:
        # First by lead, so that a line of a whole host isn't counted in one task.
        count = seen.groupBy("host", "line", "words", "lead").agg(F.count("*").alias("n")).groupBy("host", "line", "words")
        count = count.agg(F.sum("n").alias("n"), F.count("*").alias("leads")).filter(F.col("n") >= min(3, min_pages))
        least = F.greatest(F.least(F.lit(min_pages), F.col("pages")), F.lit(3))
        beyond = (F.col("leads") >= least) & (F.col("leads") >= chance * F.col("size") * F.pow(F.lit(COMMON), F.col("words")))
    count, total = count.alias("c"), total.alias("t")
    often = count.join(total, F.col("c.host").eqNullSafe(F.col("t.host")))
    often = often.filter((F.col("n") >= min_pages) & (F.col("n") > F.col("pages") * F.lit(max_ratio)) | beyond)
    return often.select(F.col("c.host").alias("host"), "line")


def boilerplate(docs: DataFrame, host_col: str, text_col: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, lines: the names of each host's boilerplate lines, for hosts that have any."""
    often = frequent(docs, host_col, text_col, max_ratio, min_pages)
    return often.groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def _applied(docs: DataFrame, host: str, text: str, found: DataFrame) -> DataFrame:
    """``docs`` with __text (without boilerplate), __n_lines and __n_dropped."""
    found = found.select(F.col("host").alias("__host"), F.col("lines").alias("__lines"))
    wide = docs.join(found, F.col(host).eqNullSafe(F.col("__host")), "left")
    lines = _lines(F.col(text))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("__lines"), _name(x)), F.lit(False)))
    wide = wide.withColumn("__kept", F.when(F.col("__lines").isNotNull(), kept))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
    return wide.select(
        *docs.columns,
        F.when(F.col("__kept").isNull(), F.col(text)).otherwise(F.array_join("__kept", "\n")).alias("__text"),
        n_lines.alias("__n_lines"),
        F.when(F.col("__kept").isNull(), 0).otherwise(n_lines - F.size("__kept")).cast("long").alias("__n_dropped"),
    )


def _without(docs: DataFrame, host: str, text: str, found: DataFrame) -> DataFrame:
    """``docs`` without the lines ``found``, whose number has no bound, so nothing is sent out but bitmaps of bounded size.

    Lines that may be among them meet the list by host and line; texts that lose some meet their lines by host and text.
    """
    page = docs.select(F.col(host).alias("__host"), text_key(F.col(text)).alias("__page"), F.col(text).alias("t")).filter("t is not null")
    lines = page.select("__host", "__page", F.explode(F.array_distinct(F.transform(_lines(F.col("t")), _name))).alias("__line")).filter("__line is not null")
    sought = found.select(F.col("host").alias("__host"), F.col("line").alias("__line"))
    near = perhaps(lines, sought, ["__host", "__line"]).filter("__hit").drop("__hit").alias("x")
    listed = near.join(sought.alias("y"), F.col("x.__host").eqNullSafe(F.col("y.__host")) & (F.col("x.__line") == F.col("y.__line")))
    drops = listed.groupBy("x.__host", "x.__page").agg(F.collect_set("x.__line").alias("__drops"))
    drops = stored(drops, "boilerplate-of-texts")

    rows = perhaps(docs.withColumn("__host", F.col(host)).withColumn("__page", text_key(F.col(text))), drops, ["__host", "__page"])
    some = rows.filter("__hit").alias("x")
    some = some.join(drops.alias("y"), F.col("x.__host").eqNullSafe(F.col("y.__host")) & (F.col("x.__page") == F.col("y.__page")), "left")
    kept = F.filter(_lines(F.col(text)), lambda x: ~F.coalesce(F.array_contains("__drops", _name(x)), F.lit(False)))
    some = some.withColumn(text, F.when(F.col("__drops").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
    return rows.filter("not __hit").select(*docs.columns).unionByName(some.select(*docs.columns))


def dedup_lines(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    chance: float | None = CHANCE,
) -> DataFrame:
    """``docs`` with the boilerplate lines of each row's host cut from its text; every row stays."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    host, text = (f"c{names.index(c)}" for c in (host_col, text_col))
    found = stored(frequent(plain, host, text, max_ratio, min_pages, chance), "boilerplate")
    out = _without(plain, host, text, found)
    return like(out.select(*plain.columns).toDF(*names), docs)


def report(docs: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """doc_id, source, n_lines, n_dropped and the text that stays, for each row."""
    rows = docs.select("doc_id", "source", "text")
    found = stored(boilerplate(rows, "source", "text", max_ratio, min_pages), "boilerplate")
    return _applied(rows, "source", "text", found).select(
        "doc_id", "source", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.col("__text").alias("text")
    )
