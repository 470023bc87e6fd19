"""Quality rules with compression bands.

A text passes if its base counts do and if zstandard finds it neither too
repetitive nor incompressible. The ratio (bytes over compressed bytes) is
taken over the whole text and over fixed chunks of ``CHUNK`` bytes. A text is
rejected if its whole ratio leaves the band of its length, or if chunks that
leave the band of a chunk hold over half of its bytes. What is left at the end
is judged by the text's last ``CHUNK`` bytes and counts for its own bytes only;
a text shorter than a chunk has the band of its length alone.

Limits depend on the length, as short texts compress less and carry the frame's
own bytes. ``BANDS`` holds for any corpus. Within it the corpus sets its own: in
each band of ``2 ** (1 / PER_OCTAVE)`` times the length, texts that pass the base
rule and lie more than ``SPREAD`` robust deviations (quartile range over 1.349)
from the median are rejected; the same for chunks. Quartiles come from counts of
all texts by band and ratio in steps of 1 / ``STEPS``, so they are the same in any
run; a band of fewer than ``LEAST`` texts has the fixed limits alone.

Defined cases: a null or wordless text has zero counts and fails the base
rule. Chunks cut through code points, as compression sees bytes only. Repeated
rows are judged each.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotrail.llm.common import by_row, stored

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
CHUNK = 4096
LEVEL = 3
#: (bytes below which it holds, least ratio, greatest ratio); natural prose lies well inside.
BANDS = ((256, 0.55, 3.0), (1024, 1.05, 3.0), (4096, 1.2, 3.2), (32768, 1.3, 3.8), (float("inf"), 1.3, 4.5))
CHUNK_BAND = (1.2, 3.5)
PER_OCTAVE = 4
SPREAD = 4.0
LEAST = 100
STEPS = 512
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more, the first included.

    Ranks of single words double to ranks of two, four and eight words, so equal
    ranks are equal windows, without hashing.
    """
    n = len(words) - window + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    span, count = 1, len(seen)
    while span < window:
        step = min(span, window - span)
        pair = rank[:-step] * count + rank[step:]
        values, rank = np.unique(pair, return_inverse=True)
        count, span = len(values), span + step
        if count == len(pair) and span < window:  # all differ, so do all longer ones
            return 0
    times = np.bincount(rank, minlength=count)
    twice = np.flatnonzero(times[rank] > 1)
    if not len(twice):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    chars = sum(map(len, words)) - _continuations(raw)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


_CONTINUATION = bytes(range(0x80, 0xC0))


def _continuations(raw: bytes) -> int:
    return 0 if raw.isascii() else len(raw) - len(raw.translate(None, _CONTINUATION))


def ratios(raw: bytes, press: zstandard.ZstdCompressor) -> tuple[float, list[float]]:
    """The ratio of the whole text and those of its chunks, the last one of its last bytes."""
    n = len(raw)
    if not n:
        return 0.0, []
    parts = [raw[min(at, n - CHUNK) : min(at, n - CHUNK) + CHUNK] for at in range(0, n, CHUNK)] if n >= CHUNK else []
    return n / len(press.compress(raw)), [CHUNK / len(press.compress(x)) for x in parts]


def band_verdict(raw: bytes, press: zstandard.ZstdCompressor, band: tuple[float, float] | None = None, chunk_band: tuple[float, float] = CHUNK_BAND) -> tuple[float, float, bool]:
    """The whole ratio, the share of bytes in chunks outside their band, and the verdict; by the fixed limits unless others are given."""
    n = len(raw)
    if not n:
        return 0.0, 0.0, False
    ratio, chunks = ratios(raw, press)
    low, high = band or fixed_band(n)
    bad = sum(min(CHUNK, n - k * CHUNK) for k, r in enumerate(chunks) if not chunk_band[0] <= r <= chunk_band[1])
    return ratio, bad / n, low <= ratio <= high and bad / n <= 0.5


def fixed_band(n: int) -> tuple[float, float]:
    return next((lo, hi) for below, lo, hi in BANDS if n < below)


def fitted(cells: np.ndarray, counts: np.ndarray, outer: tuple[float, float]) -> tuple[float, float]:
    """The limits within ``outer`` from counts of ratios in steps of 1 / STEPS."""
    if counts.sum() < LEAST:
        return outer
    order = np.argsort(cells)
    upto = np.cumsum(counts[order])
    low, mid, high = (cells[order][np.searchsorted(upto, q * upto[-1])] / STEPS for q in (0.25, 0.5, 0.75))
    reach = SPREAD * (max(high - low, 1 / STEPS) / 1.349) + 1 / STEPS
    return float(max(outer[0], mid - reach)), float(min(outer[1], mid + reach))


def _cell(ratio: Column) -> Column:
    return F.round(ratio * STEPS).cast("int")


def limits(rows: DataFrame) -> tuple[list[tuple[int, float, float]], tuple[float, float]]:
    """(band, low, high) of each band of lengths that has its own limits, and the limits of a chunk."""
    good = rows.filter("not base_failed")
    found = good.groupBy("band", _cell(F.col("zstd_ratio")).alias("cell")).agg(F.count("*").alias("n")).toArrow()
    band, cell, n = (found[c].to_numpy() for c in ("band", "cell", "n"))
    out = []
    for b in np.unique(band):
        here = band == b
        if n[here].sum() >= LEAST:
            out.append((int(b), *fitted(cell[here], n[here], (0.0, float("inf")))))
    chunks = good.select(F.explode("chunks").alias("r")).groupBy(_cell(F.col("r")).alias("cell")).agg(F.count("*").alias("n")).toArrow()
    return out, fitted(chunks["cell"].to_numpy(), chunks["n"].to_numpy(), CHUNK_BAND)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of ``op3`` with the whole ratio, the share of bad chunks and the limits of its length: a row for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"`{id_col}` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, n_bytes bigint, band int, zstd_ratio double, chunks array<double>, __low double, __high double"
    )

    def make():
        press = zstandard.ZstdCompressor(level=LEVEL)

        def one(doc_id, text):
            n, chars, symbols, dup, repeat = base_counts(text)
            failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
            raw = (text or "").encode()
            yield doc_id, n, chars, symbols, dup, repeat, failed, len(raw), int(PER_OCTAVE * np.log2(len(raw) + 1)), *ratios(raw, press), *fixed_band(len(raw))

        return one

    rows = stored(by_row(docs, [id_col, text_col], schema, make), "compression")
    bands, (chunk_low, chunk_high) = limits(rows)
    own = docs.sparkSession.createDataFrame(bands, "band int, low double, high double")
    rows = rows.join(F.broadcast(own), "band", "left")
    low, high = F.greatest("__low", "low"), F.least("__high", "high")
    # Of the last chunk only the bytes that no other has count.
    bad = F.transform("chunks", lambda r, k: F.when((r >= chunk_low) & (r <= chunk_high), 0).otherwise(F.least(F.lit(CHUNK), F.col("n_bytes") - k * CHUNK)).cast("long"))
    share = F.coalesce(F.try_divide(F.aggregate(bad, F.lit(0).cast("long"), lambda s, x: s + x), F.col("n_bytes")), F.lit(0.0))
    rows = rows.withColumn("share", share).withColumn("l", low).withColumn("h", high)
    kept = ~F.col("base_failed") & (F.col("zstd_ratio") >= F.col("l")) & (F.col("zstd_ratio") <= F.col("h")) & (F.col("share") <= 0.5)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return rows.select(F.col(f"`{id_col}`"), *counts, kept.alias("kept"), "zstd_ratio", F.col("share").alias("bad_chunk_share"), F.col("l").alias("ratio_low"), F.col("h").alias("ratio_high"))
