"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a text's language are multiplied:

- the likelihood of its byte trigrams under each language, tempered to
  ``EVIDENCE`` trigrams, as neighbouring trigrams tell the same thing twice;
- the language its markup declares (``<html lang=...>``), if any;
- the language its address names: a country suffix or a path part, if any;
- the prior of its host: the mean posterior of the host's other texts, smoothed
  towards that of its domain, which is smoothed towards that of all texts.

How far a declaration or an address can be trusted is itself counted over the
corpus, by how often it agrees with the text. Trigram models are fitted on about
``MAX_LABELLED`` labelled texts drawn by hash, ``LEAST_EACH`` of each language at
least or all it has; every labelled language is modelled, however many there are.
Priors and trust come from all texts by grouped aggregation.

Defined cases: a null or empty text has no likelihood and is judged by the rest.
Evidence that is missing or names an unknown language says nothing. A null host
is a host. A suffix of a country of several main languages (ch, be, ca, in) or
of none says nothing. Without labelled texts there is no language: lang is null, kept false.
"""

from __future__ import annotations

import html as markup
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotrail.llm.common import by_row, stored

MAX_LABELLED = 6000
#: Texts drawn of each language where there are so many that MAX_LABELLED would leave fewer.
LEAST_EACH = 90
BUCKETS = 1 << 14
EVIDENCE = 40.0
#: Texts' worth of the wider prior in a host's and a domain's.
STRENGTH = 5.0
#: Texts' worth of the opinion that declarations and addresses are right in four of five cases.
TRUST_PRIOR = 20.0
MIN_POSTERIOR = 0.5

#: Languages that country suffixes stand for.
SUFFIX = {
    suffix: lang
    for lang, suffixes in {
        "de": "de at li", "fr": "fr mc sn", "es": "es mx ar cl co pe ve ec uy bo cr cu do gt hn ni pa sv", "en": "uk us au nz ie", "it": "it sm va", "pt": "pt br ao mz", "nl": "nl",
        "pl": "pl", "ru": "ru su", "uk": "ua", "cs": "cz", "sk": "sk", "sl": "si", "hr": "hr", "sr": "rs", "bg": "bg", "ro": "ro md", "hu": "hu", "el": "gr", "tr": "tr",
        "sv": "se", "no": "no", "da": "dk", "fi": "fi", "is": "is", "et": "ee", "lv": "lv", "lt": "lt", "sq": "al", "hy": "am", "ka": "ge", "ja": "jp", "zh": "cn tw", "ko": "kr kp",
        "vi": "vn", "th": "th", "id": "id", "ms": "my", "km": "kh", "mn": "mn", "ne": "np", "bn": "bd", "he": "il", "fa": "ir", "ar": "sa ae eg iq jo kw ly om qa sy ye",
    }.items()
    for suffix in suffixes.split()
}

_U = np.uint64
_DECLARED = re.compile(r"<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_DROP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.I | re.S)
_ADDRESS = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)[^/?#]*([^?#]*)", re.I)


def trigrams(text: str) -> np.ndarray:
    b = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8).astype(np.uint64)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    h = (b[:-2] << _U(16)) | (b[1:-1] << _U(8)) | b[2:]
    return ((h * _U(0x9E3779B97F4A7C15)) >> _U(50)).astype(np.int64) % BUCKETS


def visible(page: str | None) -> str:
    return " ".join(markup.unescape(_DROP.sub(" ", page)).split()) if page else ""


def declared(page: str | None) -> str | None:
    found = _DECLARED.search(page) if page else None
    return found[1].lower() if found else None


def address(url: str | None, languages: set[str]) -> tuple[str | None, str | None, str | None]:
    """(host, domain, language named by a path part or else by the suffix)."""
    found = _ADDRESS.match(url or "")
    if not found or not found[1]:
        return None, None, None
    host = found[1].lower().rstrip(".")
    parts = host.split(".")
    named = next((p.lower() for p in found[2].split("/") if p.lower() in languages), None)
    return host, ".".join(parts[-2:]), named or SUFFIX.get(parts[-1])


def model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the log chance of each bucket by language."""
    known = labelled.select(F.col(text_col).alias("t"), F.lower(F.col(lang_col)).alias("l")).filter("t is not null and l is not null")
    count = known.groupBy("l").agg(F.count("*").alias("n")).collect()
    languages = sorted(r.l for r in count)
    if not languages:
        return [], np.zeros((0, BUCKETS), np.float32)
    each = max(MAX_LABELLED / len(languages), LEAST_EACH)
    place = {x: k for k, x in enumerate(languages)}
    share = known.sparkSession.createDataFrame([(r.l, place[r.l], min(1.0, each / r.n)) for r in count], "l string, k int, share double")
    draw = F.pmod(F.xxhash64("t"), F.lit(1 << 30)) / float(1 << 30)
    known = known.join(F.broadcast(share), "l").filter(draw < F.col("share"))

    def make():
        def one(lang, text):
            at, n = np.unique(trigrams(text), return_counts=True)
            yield lang, at.tolist(), n.tolist()

        return one

    grams = by_row(known, ["k", "t"], "k int, at array<int>, n array<bigint>", make)
    grams = grams.select("k", F.explode(F.arrays_zip("at", "n")).alias("g")).groupBy("k", "g.at").agg(F.sum("g.n").alias("n"))
    found = grams.toArrow()
    counts = np.full((len(languages), BUCKETS), 0.1)
    counts[found["k"].to_numpy(), found["at"].to_numpy()] += found["n"].to_numpy()
    return languages, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def identify(rows: DataFrame, keep: list[str], languages: list[str], table: np.ndarray) -> DataFrame:
    """``keep`` and text_lang, lang, posterior, kept for rows with ``keep`` and text, page, url, site.

    A row has a text, or a page whose visible text counts; ``site`` is the host where there is no url.
    """
    spark = rows.sparkSession
    if not languages:
        null = F.lit(None).cast("string")
        return rows.select(*keep, null.alias("host"), null.alias("text_lang"), null.alias("lang"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"))
    sent = spark.sparkContext.broadcast((languages, table))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def make():
        languages, table = sent.value
        known = set(languages)
        place = {x: k for k, x in enumerate(languages)}

        def one(*row):
            text, page, url, site = row[len(keep) :]
            grams = trigrams(visible(page) if page is not None else text or "")
            if page is None and not text:
                grams = grams[:0]
            host, domain, named = address(url, known)
            if url is None:
                host = domain = site
            like = np.zeros(len(languages))
            if len(grams):
                for k in range(0, len(grams), 1 << 13):
                    like += table[:, grams[k : k + (1 << 13)]].astype(np.float64).sum(1)
                like *= min(1.0, EVIDENCE / len(grams))
                like -= like.max()
            yield (*row[: len(keep)], host, domain, place.get(declared(page)), place.get(named), len(grams) > 0, like.tolist())

        return one

    seen = by_row(rows, [*keep, "text", "page", "url", "site"], f"{kinds}, host string, domain string, declared int, named int, has_text boolean, like array<double>", make)
    size = F.aggregate(F.transform("like", F.exp), F.lit(0.0), lambda a, x: a + x)
    seen = seen.withColumn("post", F.transform("like", lambda x: F.exp(x) / size))
    seen = stored(seen.withColumn("host", F.coalesce("host", F.lit(""))).withColumn("domain", F.coalesce("domain", F.lit(""))), "language-evidence")

    # Sums are of rows (group, language), so that no plan grows with the number of languages.
    n = len(languages)
    each = seen.filter("has_text").select("host", "domain", F.posexplode("post").alias("k", "p"))
    host = stored(each.groupBy("host", "domain", "k").agg(F.sum("p").alias("p")), "language-hosts")
    domain = stored(host.groupBy("domain", "k").agg(F.sum("p").alias("p")), "language-domains")
    everywhere = np.ones(n)
    for r in domain.groupBy("k").agg(F.sum("p").alias("p")).collect():
        everywhere[r.k] += r.p
    everywhere /= everywhere.sum()
    row = F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda x: x["p"])
    host, domain = host.groupBy("host", "domain").agg(row.alias("h")), domain.groupBy("domain").agg(row.alias("d"))

    best = F.when(F.col("has_text"), (F.array_position("post", F.array_max("post")) - 1).cast("int"))
    both = {c: F.col(c).isNotNull() & best.isNotNull() for c in ("declared", "named")}
    trust = seen.agg(*[((F.count_if(both[c] & (F.col(c) == best)) + 0.8 * TRUST_PRIOR) / (F.count_if(both[c]) + TRUST_PRIOR)).alias(c) for c in both]).first()

    none = F.array_repeat(F.lit(0.0), n)

    def says(column: str) -> Column:
        """Log chances of the evidence by language; zeros where it is missing."""
        right = min(max(trust[column], 1 / n), 0.98)  # never held against a language
        wrong = (1 - right) / max(n - 1, 1)
        given = F.transform(none, lambda _, k: F.when(k == F.col(column), float(np.log(right))).otherwise(float(np.log(wrong))))
        return F.when(F.col(column).isNull(), none).otherwise(given)

    def less(sums: str) -> Column:
        """A group's sums without the text's own opinion, which counts once, as likelihood."""
        return F.zip_with(F.coalesce(sums, none), F.when(F.col("has_text"), F.col("post")).otherwise(none), lambda x, own: F.greatest(x - own, F.lit(0.0)))

    def added(values: str) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    wide = seen.join(host, ["host", "domain"], "left").join(domain, "domain", "left")
    wide = wide.withColumn("host_n", less("h")).withColumn("domain_n", less("d")).withColumn("host_all", added("host_n")).withColumn("domain_all", added("domain_n"))
    wide = wide.withColumn("dp", F.zip_with("domain_n", F.array(*[F.lit(float(x)) for x in everywhere]), lambda x, e: (x + STRENGTH * e) / (F.col("domain_all") + STRENGTH)))
    wide = wide.withColumn("hp", F.zip_with("host_n", "dp", lambda x, d: (x + STRENGTH * d) / (F.col("host_all") + STRENGTH)))
    wide = wide.withColumn("e", F.zip_with(says("declared"), says("named"), lambda x, y: x + y))
    wide = wide.withColumn("score", F.zip_with(F.zip_with("like", "hp", lambda x, h: x + F.ln(h)), "e", lambda x, e: x + e))
    top = F.array_max("score")
    rest = F.aggregate(F.transform("score", lambda x: F.exp(x - F.array_max("score"))), F.lit(0.0), lambda a, x: a + x)
    names = F.array(*[F.lit(x) for x in languages])
    out = wide.select(
        *keep, "host",
        F.when(F.col("has_text"), F.element_at(names, F.array_position("post", F.array_max("post")).cast("int"))).alias("text_lang"),
        F.element_at(names, F.array_position("score", top).cast("int")).alias("lang"),
        (1 / rest).alias("posterior"),
    )
    return out.withColumn("kept", F.col("posterior") >= MIN_POSTERIOR)


def report(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each document (doc_id set) and each page (page_id set): host, text_lang, lang, posterior, kept."""
    languages, table = model(docs)
    null = F.lit(None).cast("string")
    both = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", null.alias("page"), null.alias("url"), F.col("source").alias("site"))
    both = both.unionByName(pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", null.alias("text"), F.coalesce("html", F.lit("")).alias("page"), "url", null.alias("site")))
    return identify(both, ["doc_id", "page_id"], languages, table)
