"""Exact removal of repeated substrings by counts of fingerprints at anchors, in place of prefix doubling.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else, in the same text or another. Ranking the suffixes at every byte would
sort some nine times as many (position, rank) pairs as there are bytes; here
only suffixes at anchors are ranked, and the result is still exact.

Anchors. Among ``SPAN`` neighbouring positions the one with the least hash of
its ``GRAM`` bytes is an anchor. Each window of ``LENGTH`` bytes is owned by
the anchor of its first ``SPAN`` positions, so equal windows have equal
anchors at equal distances: window a - d of anchor a equals a window at the
same distance d from another anchor, or none.

Doubling. A (position, rank) pair is an anchor and the name of the string that
starts some bytes before it; names are fingerprints, which are equal for equal
strings wherever they are computed: a polynomial for candidates, and xxHash64
beside it wherever a name decides. The names of each round are
dealt to the cluster and counted; what is unique drops out, and the rest goes
on with longer strings, until the length is reached:

1. the LENGTH - SPAN + 1 bytes from the anchor on, common to all its windows;
2. the union of all windows an anchor owns: if it occurs again, all of them do;
3. for each ``STEP`` distances, the bytes common to their windows (unique: none
   repeats) and the union of them (repeated: all do);
4. single windows.

A round names all places that share the common bytes of an open place, settled
or not, as the match of an open window may lie in a settled place.

Passages. A passage of ``PASSAGE`` words can be shorter than ``LENGTH`` bytes. The
same rounds therefore also name windows of so many words, whatever blanks stand
between them: the anchor of a window is the least of its grams of ``GRAM_WORDS``
words, round 1 names grams, round 2 the union of an anchor's windows, round 3
single windows. Words in windows that another document has too (repeats within
a document don't count here) aren't removed; their document is marked. A document
needs one such window, so those with a repeated union leave the later rounds.

Each text is there once with the number of its copies; a text that has copies
goes altogether. Texts are stored in buckets by their name, so the rounds read
them without moving them.

Defined cases: null is the empty text; texts shorter than ``LENGTH`` lose
nothing. Repeated rows are copies, so each loses its text, and shares a passage if it
has ``PASSAGE`` words or more. Strings are bytes; what remains need not be valid UTF-8, so the operator returns spans and bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotrail.llm.common import perhaps, shared_dir, stored

LENGTH = 400
SPAN = 128
GRAM = 32
STEP = 16
#: A passage is a run of over 50 words.
PASSAGE = 51
GRAM_WORDS = 16
#: Positions worked on at a time; bounds the memory that a very long text takes.
SEGMENT = 1 << 20

_U = np.uint64
#: Odd base of the polynomial fingerprint, modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
#: Tags that tell names of words from names of bytes.
_GRAM_TAG, _UNION_TAG, _WINDOW_TAG = 1 << 20, 1 << 21, 1 << 22
#: Candidates' and deciding names of words are odd, those of bytes even, so that a round sees which kind a text has.
_ODD = _U(1)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Powers:
    """Powers of the base and of its inverse, as long as the longest segment so far."""

    def __init__(self):
        self.n, self.whole = 0, (b"", None)
        self.bytes = _mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))

    def upto(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 1 << 17)
            self.up, self.down = (self._row(b) for b in (_BASE, pow(_BASE, -1, 1 << 64)))

    def prefix(self, raw: bytes, at: int, size: int) -> Prefix:
        """Of raw[at : at + size]; that of a whole text is kept until the next."""
        if self.whole[0] is raw and size == len(raw):
            return self.whole[1]
        p = Prefix(np.frombuffer(raw, np.uint8, size, at), self)
        if size == len(raw):
            self.whole = (raw, p)
        return p

    def _row(self, base: int) -> np.ndarray:
        x = np.full(self.n + 1, base, np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)


class Prefix:
    """Running sums of a segment (bytes, or the codes of words); names of its substrings."""

    def __init__(self, raw: np.ndarray, powers: Powers):
        powers.upto(len(raw) + 1)
        self.powers, self.raw = powers, raw
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        values = powers.bytes[raw] if raw.dtype == np.uint8 else raw
        np.cumsum(values * powers.up[: len(raw)], out=self.sums[1:])

    def name(self, start, end, tag: np.ndarray | int = 0) -> np.ndarray:
        """Fingerprint of raw[start:end], told apart by tag."""
        x = (self.sums[end] - self.sums[start]) * self.powers.down[start]
        return _mix(x + np.asarray(end - start).astype(np.uint64) * _U(0xA0761D6478BD642F) + np.asarray(tag).astype(np.uint64) * _U(0xE7037ED1A0B428DB))

    def grams(self, size: int, tag: int = 0) -> np.ndarray:
        """The names of all substrings of ``size``."""
        x = self.sums[size:] - self.sums[: len(self.sums) - size]
        x *= self.powers.down[: len(x)]
        x += _U((size * 0xA0761D6478BD642F + tag * 0xE7037ED1A0B428DB) % (1 << 64))
        return _mix(x)

    def proof(self, start, end, tag: np.ndarray | int = 0) -> np.ndarray:
        """xxHash64 of raw[start:end], seeded with tag: no polynomial, so that no text is made of its zeros."""
        size, view = self.raw.itemsize, memoryview(self.raw).cast("B")
        each = zip((start * size).tolist(), (end * size).tolist(), np.broadcast_to(tag, len(start)).tolist(), strict=True)
        return np.fromiter((xxhash.xxh64_intdigest(view[s:e], t) for s, e, t in each), np.uint64, len(start))


def owned(least: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, low, high) from each window's least gram, with the gram's position in its low 32 bits; windows count from ``first``."""
    own = (least & _U(0xFFFFFFFF)).astype(np.int64)
    turn = np.flatnonzero(np.diff(own)) + 1
    low = np.concatenate([[0], turn]) + first
    high = np.concatenate([turn - 1, [len(own) - 1]]) + first
    return own[low - first], low, high


def leasts(gram: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` neighbouring grams (their upper halves) with its position."""
    least = gram & _U(0xFFFFFFFF00000000)
    least |= np.arange(len(gram), dtype=np.uint64)
    step = 1
    while 2 * step <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    return np.minimum(least[: -(span - step)], least[span - step :]) if step < span else least


def segments(raw: bytes, powers: Powers, length: int = LENGTH) -> Iterator[tuple]:
    """(prefix, base, anchors, low, high): windows low..high belong to each anchor.

    Positions count from ``base``. An anchor lies in one segment with all its windows.
    """
    n, at = len(raw), 0
    while at + length <= n:
        base = max(0, at - SPAN)
        end = min(n, at + SEGMENT + length + SPAN)
        p = powers.prefix(raw, base, end - base)
        size = end - base
        first, last = at - base, size - length if end == n else at - base + SEGMENT
        least = leasts(p.grams(GRAM), SPAN)
        anchors, low, high = owned(least[first : last + 1], first)
        if end == n:
            yield p, base, anchors, low, high
            return
        yield p, base, anchors[:-1], low[:-1], high[:-1]
        at = base + int(low[-1])


def worded(raw: bytes, powers: Powers, passage: int = PASSAGE) -> Iterator[tuple]:
    """(prefix over codes of words, number of the first word) of pieces of a text; every window of ``passage`` words lies in one."""
    n, at, seen, carry = len(raw), 0, 0, np.zeros(0, np.uint64)
    while at < n:
        end = min(n, at + SEGMENT)
        blank = _BLANK[np.frombuffer(raw, np.uint8, end - at, at)]
        while end < n and not blank.any():  # a very long word
            end = min(n, end + SEGMENT)
            blank = _BLANK[np.frombuffer(raw, np.uint8, end - at, at)]
        if end < n:
            blank = blank[: np.flatnonzero(blank)[-1] + 1]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        edge = np.concatenate([[0] * (not blank[0]), edge, [len(blank)] * (not blank[-1])]).astype(np.int64)
        p = powers.prefix(raw, at, len(blank))
        codes = np.concatenate([carry, p.name(edge[::2], edge[1::2])])
        yield Prefix(codes, powers), seen - len(carry)
        seen += len(edge) // 2
        carry, at = codes[len(codes) - min(passage - 1, len(codes)) :], at + len(blank)


def _has(found: np.ndarray, odd: int) -> bool:
    return bool((found & _ODD == odd).any())


def _in(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(found, keys)
    at[at == len(found)] = 0
    return found[at] == keys


class Rounds:
    """What each round names in a text, given what the rounds before it found.

    ``found`` holds sorted names of the text: "core", those of round 1 that go
    on; "union", the repeated ones of round 2; "inner", the common bytes of round
    3 that go on; "outer", the repeated unions of round 3; "window", those of round 4.
    """

    def __init__(self, length: int = LENGTH, passage: int = PASSAGE):
        self.length, self.passage = length, passage
        self.powers = Powers()

    def names(self, raw: bytes, turn: int, found: dict[str, np.ndarray]) -> list[tuple[np.ndarray, ...]]:
        """Tuples of arrays (c, a, b): the common bytes' name, and both halves of the name that settles; 0, 0 for none."""
        out = []
        for p, _, a, low, high in segments(raw, self.powers, self.length) if turn == 1 or _has(found["core"], 0) else ():
            core = self._core(p, a)
            if turn == 1:
                out.append((core, core, core))
                continue
            on = _in(core, found["core"])
            a, low, high, core = a[on], low[on], high[on], core[on]
            if turn == 2 and len(a):
                out.append((core, *self._both(p, low, high + self.length, a - low)))
            elif len(a):
                d, x, lo, hi = self._steps(a, low, high)
                inner = self._inner(p, d, x)
                if turn == 3:
                    whole, start, end, tag = self._outer(p, d, x)
                    halves = np.zeros((2, len(x)), np.uint64)
                    halves[:, whole] = self._both(p, start, end, tag)
                    out.append((inner, *halves))
                else:
                    go = _in(inner, found["inner"])
                    w = _ranges(lo[go], hi[go])
                    if len(w):
                        names = self._both(p, w, w + self.length, 0)
                        out.append((names[0], *names))
        return out

    def word_names(self, raw: bytes, turn: int, found: dict[str, np.ndarray]) -> list[tuple[np.ndarray, ...]]:
        """As ``names``, of words; none in round 4."""
        out = []
        for p, _ in worded(raw, self.powers, self.passage) if turn == 1 or turn < 4 and _has(found["core"], 1) else ():
            gram, a, low, high = self._grams(p)
            if turn > 1:
                on = _in(gram, found["core"])
                gram, a, low, high = gram[on], a[on], low[on], high[on]
            if not len(a):
                continue
            if turn == 1:
                out.append((gram, gram, gram))
            elif turn == 2:
                out.append((gram, *self._both(p, low, high + self.passage, a - low + _UNION_TAG)))
            else:
                w = _ranges(low, high)
                names = self._both(p, w, w + self.passage, _WINDOW_TAG)
                out.append((names[0], *names))
        return out

    def runs(self, raw: bytes, found: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        """Runs (first, last) of windows that repeat."""
        out: list[tuple[int, int]] = []
        if not any(_has(found[c], 0) for c in ("union", "outer", "window")):
            return out
        for p, base, a, low, high in segments(raw, self.powers, self.length):
            again = _in(self._proof(p, low, high + self.length, a - low), found["union"])
            out += zip((low[again] + base).tolist(), (high[again] + base).tolist(), strict=True)
            a, low, high = a[~again], low[~again], high[~again]
            on = _in(self._core(p, a), found["core"])
            if not on.any():
                continue
            d, x, lo, hi = self._steps(a[on], low[on], high[on])
            whole, start, end, tag = self._outer(p, d, x)
            every = np.zeros(len(x), bool)
            every[whole] = _in(self._proof(p, start, end, tag), found["outer"])
            out += zip((lo[every] + base).tolist(), (hi[every] + base).tolist(), strict=True)
            go = ~every & _in(self._inner(p, d, x), found["inner"])
            w = _ranges(lo[go], hi[go])
            hit = w[_in(self._proof(p, w, w + self.length, 0), found["window"])] + base
            out += zip(hit.tolist(), hit.tolist(), strict=True)
        return out

    def _proof(self, p, start, end, tag):
        x = p.proof(start, end, tag)
        return x & ~_ODD if p.raw.dtype == np.uint8 else x | _ODD

    def _both(self, p, start, end, tag):
        return p.name(start, end, tag), self._proof(p, start, end, tag)

    def _grams(self, p):
        """(gram, anchor, low, high) over the words of a piece."""
        n, size = len(p.raw), min(GRAM_WORDS, self.passage)
        if n < self.passage:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none, none, none
        gram = p.grams(size, _GRAM_TAG)
        a, low, high = owned(leasts(gram, self.passage - size + 1), 0)
        return gram[a] | _ODD, a, low, high

    def _core(self, p, a):
        return p.name(a, a + self.length - SPAN + 1) & ~_ODD

    def _steps(self, a, low, high):
        """For each STEP distances and each anchor with windows there: the least distance, the anchor, those windows."""
        d = np.arange(0, SPAN, STEP)[:, None]
        lo, hi = np.maximum(low, a - d - STEP + 1), np.minimum(high, a - d)
        here = lo <= hi
        k, x = np.nonzero(here)
        return k * STEP, a[x], lo[here], hi[here]

    def _inner(self, p, d, x):
        return p.name(x - d, x - d - STEP + 1 + self.length, 2 * d + 1)

    def _outer(self, p, d, x):
        start, end = x - d - STEP + 1, x - d + self.length
        whole = (start >= 0) & (end <= len(p.raw))
        return whole, start[whole], end[whole], 2 * d[whole] + 2


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All positions from each low to its high."""
    size = high - low + 1
    return np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)[: len(low)], size) + np.arange(size.sum())


def covered(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs [start, end) under windows that start in the runs."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(s, e) for s, e in out]


def _texts(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """A stored table (id, t, m): each different text, its name and its number of rows, in buckets by name; and the table's name."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.unhex(F.md5(t.cast("binary"))).alias("id"), t.alias("t")).groupBy("id").agg(F.first("t").alias("t"), F.count("*").alias("m"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    name = f"annotrail_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    # The aggregate has dealt the rows to n partitions by id, as the buckets are, so they need no further shuffle.
    rows.write.bucketBy(n, "id").option("path", path).option("compression", "zstd").saveAsTable(name)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.table(name), name


def _mapped(rows: DataFrame, found: list[str], schema: str, make: Callable) -> DataFrame:
    """Apply make()(id, raw, m, found) to texts; it returns a list of values for one row or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, build = make()
        none = np.zeros(0, np.uint64)
        for batch in batches:
            out, size = [], 0
            for k in range(batch.num_rows):
                arrays = {}
                for c, name in zip(batch.columns[3:], found, strict=True):
                    got = c[k].values
                    arrays[name] = none if got is None else np.sort(got.to_numpy(zero_copy_only=False).view(np.uint64))
                raw = batch.column(1)[k].as_py().encode()
                got = fn(batch.column(0)[k].as_py(), raw, batch.column(2)[k].as_py(), arrays)
                if got is not None:
                    out.append(got)
                    size += 1 + len(raw)
                if size > 2_000_000:
                    yield build(out)
                    out, size = [], 0
            if out:
                yield build(out)

    return rows.select("id", "t", "m", *found).mapInArrow(run, schema)


def _named(rows: DataFrame, turn: int, found: list[str], length: int, passage: int) -> DataFrame:
    """(id, c, a, b): the names of a round; twice where a text has copies, or has a name of bytes twice."""
    kind = pa.struct([(c, pa.int64()) for c in "cab"][: 1 if turn == 1 else 3])

    def make():
        rounds = Rounds(length, passage)

        def told(names, m, within):
            if turn == 1:
                x, times = np.unique(np.concatenate([n[0] for n in names]), return_counts=True)
                return np.repeat(x, np.minimum(np.maximum(times if within else 1, min(m, 2)), 2))[:, None]
            x = np.concatenate([np.stack(n, axis=1) for n in names])
            # c and a tell rows of one text apart; both are hashes, so their mix does too.
            _, first, times = np.unique(x[:, 0] + _mix(x[:, 1]), return_index=True, return_counts=True)
            return x[np.repeat(first, np.minimum(np.maximum(times if within else 1, min(m, 2)), 2))]

        def one(ident, raw, m, found):
            names = rounds.names(raw, turn, found) if len(raw) >= length else []
            words = rounds.word_names(raw, turn, found) if len(raw) >= 2 * passage - 1 else []
            if not names and not words:
                return None
            return ident, np.concatenate([told(n, m, n is names) for n in (names, words) if n])

        def build(out):
            flat = np.concatenate([x for _, x in out]).view(np.int64)
            ends = np.cumsum([0, *(len(x) for _, x in out)]).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(kind.num_fields)], fields=list(kind))
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), values)], names=["id", "keys"])

        return one, build

    fields = ", ".join(f"{f.name}: bigint" for f in kind)
    out = _mapped(rows, found, f"id binary, keys array<struct<{fields}>>", make)
    return stored(out, f"names{turn}").select("id", F.explode("keys").alias("k")).select("id", "k.*")


def _twice(names: DataFrame, *by: str) -> DataFrame:
    """The names that occur twice or more."""
    return names.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").select(*by)


def _of_text(names: DataFrame, which: DataFrame, by: list[str], pick: str, alias: str) -> DataFrame:
    """(id, alias): for each text, its names among ``which``."""
    return stored(names.join(which, by).groupBy("id").agg(F.collect_set(pick).alias(alias)), f"found-{alias}")


def repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """(id, n_bytes, spans, passage, kept_sha256) for each different text; id is its MD5.

    spans are the removed byte runs; passage says whether another document shares ``passage`` words in a row.
    """
    texts, name = _texts(docs, text_col)
    try:
        return _repeats(texts, length, passage)
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def _repeats(texts: DataFrame, length: int, passage: int) -> DataFrame:
    cores = _named(texts, 1, [], length, passage)
    again = stored(_twice(cores, "c"), "repeated-cores")
    # Most names are unique; a bitmap drops them where they are.
    core = _of_text(perhaps(cores, again, ["c"]).filter("__hit").drop("__hit"), again, ["c"], "c", "core")

    unions = _named(texts.join(core, "id"), 2, ["core"], length, passage)
    again = _twice(unions, "a", "b")
    union = _of_text(unions, again, ["a", "b"], "b", "union")
    # One repeated union of words settles a text's words.
    marked = union.filter(F.exists("union", lambda x: x.bitwiseAND(F.lit(1)) == 1)).select("id", F.lit(True).alias("marked"))
    open_ = unions.join(again, ["a", "b"], "left_anti").join(marked, "id", "left")
    open_ = open_.filter((F.col("c").bitwiseAND(F.lit(1)) == 0) | F.col("marked").isNull()).select("c").distinct()
    core = _of_text(unions, open_, ["c"], "c", "core")

    steps = _named(texts.join(core, "id"), 3, ["core"], length, passage)
    whole = steps.filter("not (a = 0 and b = 0)")
    again = stored(_twice(whole, "a", "b"), "outer")
    outer = _of_text(whole, again, ["a", "b"], "b", "outer")
    open_ = steps.join(again, ["a", "b"], "left_anti").select("c").distinct()
    inner = _of_text(steps, open_.join(_twice(steps, "c"), "c"), ["c"], "c", "inner")

    windows = _named(texts.join(core, "id").join(inner, "id"), 4, ["core", "inner"], length, passage)
    window = _of_text(windows, _twice(windows, "a", "b"), ["a", "b"], "b", "window")

    found, final = ["core", "union", "inner", "outer", "window"], texts
    for part in (core, union, inner, outer, window):
        final = final.join(part, "id", "left")

    def make():
        rounds = Rounds(length, passage)

        def one(ident, raw, m, found):
            if m > 1:
                spans, shared = [(0, len(raw))] if len(raw) >= length else [], len(raw.split()) >= passage
            else:
                spans = covered(rounds.runs(raw, found), length) if len(raw) >= length else []
                shared = any(_has(found[c], 1) for c in ("union", "outer"))
            kept, last = hashlib.sha256(), 0
            for s, e in spans:
                kept.update(raw[last:s])
                last = e
            kept.update(raw[last:])
            return ident, len(raw), [{"start": s, "end": e} for s, e in spans], shared, kept.hexdigest()

        runs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.binary(), pa.int64(), runs, pa.bool_(), pa.string()]

        def build(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "n_bytes", "spans", "passage", "kept_sha256"])

        return one, build

    runs = "array<struct<start: bigint, end: bigint>>"
    return stored(_mapped(final, found, f"id binary, n_bytes bigint, spans {runs}, passage boolean, kept_sha256 string", make), "repeats")


def report(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """The digest of ``op2`` and passage, 1 if another document shares a run of over 50 words, else 0: a row for each row."""
    done = repeats(docs, "text", length, passage)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    done = done.select("id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", F.col("passage").cast("int").alias("passage"))
    rows = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("id"))
    return rows.join(done, "id").drop("id")
