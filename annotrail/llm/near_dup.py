"""Near-duplicate removal with ProbMinHash.

A text is a set of shingles of ``SHINGLE`` lower-cased words. Each shingle is a
Poisson process whose rate is its weight, with points dealt to the registers at
random; a register keeps the shingle of its earliest point. A shingle stops as
soon as its next point is later than the latest register, so work is about one
point for each shingle. Two texts agree in a register with the probability
Jaccard of their sets. All shingles weigh 1, however often they occur, so that
this is the plain Jaccard by which links are verified: with weights that grow
with the count, a line repeated in one copy would hide it from the other.

Exact copies meet first, by the MD5 of their text. The signatures of different
texts are cut into bands, and texts that share a band are candidates. In a
bucket of at most ``SMALL`` texts all pairs are; in a larger one each text is
paired with ``LEADERS`` leaders of the bucket: the one most central, judged by
the sizes of the buckets it is in, and some drawn by hash. Texts that are then
not in the bucket's largest class are compared with every text of another class
in it, a block of ``BLOCK`` texts against another at a time, which counts common
shingles without a row for each pair. So any two texts that share a band either
are compared or are in one class already; none is capped. Pairs whose signatures agree in ``MIN_AGREE`` of
the registers are verified: they link if the exact Jaccard similarity of their
shingle sets is ``THRESHOLD`` or more. Classes are the connected components.

Defined cases: a text of fewer words than a shingle is one shingle. Null and
wordless texts are in no class but their own, and stay. Of a class the row with
the least id stays, null ids last; of rows with the same id and text, one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotrail.llm.common import by_row, like, perhaps, stored
from annotrail.llm.components import components
from annotrail.session import ship

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: A pair at the threshold agrees in 0.8 of 120 registers, give or take 0.037, as registers are independent.
MIN_AGREE = 0.62
SMALL = 12
LEADERS = 6
BLOCK = 32

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Hashes of a text's shingles; word hashes are remembered."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().encode().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 1 << 16:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        code = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(words) - self.size + 1)
        out = np.full(n, len(words) if len(words) < self.size else self.size, np.uint64)
        for k in range(min(self.size, len(words))):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + code[k : k + n])
        return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """Registers of weighted sets (element hashes, weights), one row for each set.

    The sets' processes run side by side, a point of each at a time; a set's
    elements drop out when their next point can no longer win a register.
    """
    first = np.full((len(sets), registers), np.inf)
    winner = np.zeros((len(sets), registers), np.uint64)
    flat, win = first.reshape(-1), winner.reshape(-1)
    item = np.concatenate([s[0] for s in sets]) if sets else np.zeros(0, np.uint64)
    rate = np.concatenate([s[1] for s in sets]) if sets else np.zeros(0)
    of = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    at = np.zeros(len(item))
    turn = 0
    while len(item):
        turn += 1
        draw = _mix(item + _U(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = at - np.log(((draw >> _U(11)).astype(np.float64) + 1) * 2.0**-53) / rate
        slot = of * registers + (_mix(draw ^ _U(0xD6E8FEB86659FD93)) % _U(registers)).astype(np.int64)
        better = np.flatnonzero(at < flat[slot])
        np.minimum.at(flat, slot[better], at[better])
        won = better[at[better] == flat[slot[better]]]
        win[slot[won]] = item[won]
        live = np.unique(of)
        latest = np.zeros(len(sets))
        latest[live] = first[live].max(axis=1)
        on = at < latest[of]
        item, rate, of, at = item[on], rate[on], of[on], at[on]
    return winner


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, id (MD5 of the text) and sig for each row whose text has a word; null sig otherwise."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t"))
    kind = pa.schema([("id", pa.binary()), ("sig", pa.list_(pa.int32()))])

    def parts(batch: pa.RecordBatch) -> Iterator[list]:
        part, size = [], 0
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part.append(row)
            size += len(row[1] or "")
            if len(part) >= 1024 or size >= 1_000_000:
                yield part
                part, size = [], 0
        if part:
            yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                for part in parts(whole.slice(k, 2048)):
                    sets, has = [], []
                    for _, t in part:
                        values = np.unique(shingles(t or ""))
                        has.append(len(values) > 0)
                        if len(values):
                            sets.append((values, np.ones(len(values))))
                    sig = iter((signatures(sets) & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([d for d, _ in part], whole.schema.field(0).type),
                            pa.array([None if t is None else hashlib.md5(t.encode()).digest() for _, t in part], pa.binary()),
                            pa.array([next(sig) if h else None for h in has], kind.field("sig").type),
                        ],
                        names=["doc", "id", "sig"],
                    )

    return rows.mapInArrow(run, f"doc {docs.schema[id_col].dataType.simpleString()}, id binary, sig array<int>")


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _linked(pairs: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar: signatures first, then shingles."""
    sa, sb = sigs.toDF("a", "sa"), sigs.toDF("b", "sb")
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = pairs.join(sa, "a").join(sb, "b").filter(agree >= MIN_AGREE * REGISTERS).select("a", "b")
    near = stored(near, "near-pairs")
    wanted = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    text = stored(_among(texts, wanted), "near-texts")
    both = near.join(text.toDF("a", "ta"), "a").join(text.toDF("b", "tb"), "b")

    def make():
        shingles = Shingler()

        def one(a, b, ta, tb):
            x, y = np.unique(shingles(ta)), np.unique(shingles(tb))
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common >= THRESHOLD * (len(x) + len(y) - common) - 1e-9:
                yield a, b

        return one

    return stored(by_row(both, ["a", "b", "ta", "tb"], "a binary, b binary", make), "links")


def _among(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """One row (id, t) for each of ``ids``; only about the texts wanted move."""
    near = perhaps(texts, ids, ["id"]).filter("__hit").select("id", "t")
    # An inner join: a semi join would be planned below the bitmap and move all texts.
    return near.join(ids, "id").groupBy("id").agg(F.first("t").alias("t"))


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """(bucket, name, members): each bucket's rows in blocks of about BLOCK."""
    size = rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    cut = rows.join(size, "bucket").withColumn(name, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return cut.groupBy("bucket", name).agg(F.first("parts").cast("int").alias("parts"), F.collect_list(F.struct("id", "c", "x")).alias("members"))


def _across(mixed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of texts outside their bucket's main class with texts of other classes in it: one for each text and class, which connects them as well as all would."""
    spark = mixed.sparkSession

    def make():
        shingles = Shingler()

        def one(ident, text):
            yield ident, np.unique(shingles(text)).view(np.int64).tolist()

        return one

    sets = stored(by_row(_among(texts, mixed.select("id").distinct()), ["id", "t"], "id binary, x array<bigint>", make), "shingles")
    rows = stored(mixed.join(sets, "id"), "mixed-shingles")
    rest = _blocks(rows.filter("c <> main"), "i").drop("parts")
    every = _blocks(rows, "j")
    # Each block of the rest names its partners, so a large bucket's pairs of blocks spread.
    parts = every.groupBy("bucket").agg(F.max("parts").alias("parts"))
    rest = rest.join(parts, "bucket").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = rest.select("bucket", "j", F.col("members").alias("one")).join(every.select("bucket", "j", F.col("members").alias("two")), ["bucket", "j"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[bytes, bytes], bytes] = {}
            for k in range(batch.num_rows):
                for a, c, b in _similar(*(batch.column(n)[k].values for n in (0, 1))):
                    found.setdefault((a, c), b)
            rows = [(*k, found[k]) for k in sorted(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in range(3)], names=["a", "c", "b"])

    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, str(16 << 20))  # blocks are large rows
    try:
        links = both.select("one", "two").mapInArrow(run, "a binary, c binary, b binary")
        return stored(links.groupBy("a", "c").agg(F.min("b").alias("b")).select(*_pairs(F.col("a"), F.col("b"))), "across")
    finally:
        if before is None:
            spark.conf.unset(conf)
        else:
            spark.conf.set(conf, before)


def _similar(one: pa.StructArray, two: pa.StructArray) -> Iterator[tuple[bytes, bytes, bytes]]:
    """(a, c, b) for texts a of one block and b, of another class c, of the other whose sets x are similar."""
    ids, classes_ = ([block.field(k).to_pylist() for block in (one, two)] for k in range(2))
    sets = [block.field(2) for block in (one, two)]
    flat = sets[1].flatten().to_numpy()
    size = np.diff(sets[1].offsets.to_numpy())
    owner = np.repeat(np.arange(len(two)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for k in range(len(one)):
        x = sets[0][k].values.to_numpy()
        low, high = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(two))
        for j in np.flatnonzero(common >= THRESHOLD * (len(x) + size - common) - 1e-9):
            if classes_[0][k] != classes_[1][j]:
                yield ids[0][k], classes_[1][j], ids[1][j]


def _joined(found: DataFrame, extra: DataFrame) -> DataFrame:
    """The components with further links, which are few and connect whole components."""
    of = found.select("id", "component")
    links = extra.join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left")
    links = links.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    more = stored(components(links), "more-components")
    alone = more.select("id").join(of, "id", "left_anti").select("id", F.col("id").alias("component"))
    every = of.unionByName(alone).join(more.toDF("component", "c"), "component", "left")
    return every.select("id", F.coalesce("c", "component").alias("component"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, members): rows (doc, id) with the text's name, and members (id, component) of classes with several texts."""
    signed = stored(_signed(docs, id_col, text_col), "signatures")
    sigs = stored(signed.filter("sig is not null").groupBy("id").agg(F.first("sig").alias("sig")), "distinct-signatures")
    texts = docs.select(F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("id"), F.col(text_col).alias("t"))

    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.slice("sig", k * ROWS + 1, ROWS)))
    banded = sigs.select("id", F.explode(band).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(banded.join(shared, "bucket"), "buckets")

    small = shared.filter(F.col("n") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    each = F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, F.lit(SMALL)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    pairs = small.select(F.explode(F.flatten(each)).alias("p")).select("p.a", "p.b")

    large = shared.filter(F.col("n") > SMALL)
    has_large = not large.isEmpty()
    if has_large:
        central = shared.groupBy("id").agg(F.sum("n").alias("score"))
        large = stored(large.join(central, "id"), "large-buckets")
        leads = [F.max_by("id", F.struct("score", "id")), *(F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(1, LEADERS))]
        leads = large.groupBy("bucket").agg(F.array_distinct(F.array(*leads)).alias("leads"))
        led = large.join(leads, "bucket").select("id", F.explode("leads").alias("lead")).filter("id <> lead")
        pairs = pairs.union(led.select(*_pairs(F.col("id"), F.col("lead"))))
    pairs = stored(pairs.distinct(), "pairs")
    links = _linked(pairs, sigs, texts)
    found = stored(components(links), "components")

    if has_large:
        placed = large.select("bucket", "id").join(found, "id", "left").withColumn("c", F.coalesce("component", "id"))
        placed = stored(placed.select("bucket", "id", "c"), "placed")
        main = placed.groupBy("bucket", "c").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("kinds"))
        mixed = stored(placed.join(main.filter("kinds > 1").select("bucket", "main"), "bucket"), "mixed")
        if not mixed.isEmpty():
            extra = _across(mixed, texts)
            if not extra.isEmpty():
                found = stored(_joined(found, extra), "components")
    return signed.select("doc", "id", F.col("sig").isNotNull().alias("worded")), found


def _classed(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with class key c (null for texts without words), and one row for each class."""
    rows = rows.join(found, "id", "left").withColumn("c", F.when(F.col("worded"), F.coalesce("component", "id")))
    first = F.min(F.struct(F.col("doc").isNull().alias("n"), "doc", "id")).alias("first")
    return rows, rows.filter("c is not null").groupBy("c").agg(first, F.count("*").alias("size"))


def report(docs: DataFrame) -> DataFrame:
    """A row for each row: doc_id, class_id (least doc_id of its class), class_size, kept (true on the class's first)."""
    rows, found = classes(docs)
    rows, per = _classed(rows, found)
    out = rows.join(per, "c", "left")
    return out.select(
        F.col("doc").alias("doc_id"),
        F.when(F.col("c").isNull(), F.col("doc")).otherwise(F.col("first.doc")).alias("class_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("class_size"),
        (F.col("c").isNull() | (F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("id") == F.col("first.id")))).alias("kept"),
    )


def _without(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """``rows`` whose (__doc, __id) isn't listed."""
    listed = listed.select(F.col("__doc").alias("__d"), F.col("__id").alias("__i"), F.lit(True).alias("__in"))
    return rows.join(listed, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__id") == F.col("__i")), "left").filter("__in is null").drop("__d", "__i", "__in")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, and every row without words."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    ident, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    rows, found = classes(plain, ident, text)
    rows, per = _classed(rows, found)
    # Only classes with several rows lose some; the others need no look-up.
    several = stored(per.filter("size > 1").select("c", "first"), "classes")
    gone = rows.join(several, "c").filter(~(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("id") == F.col("first.id"))))
    pair = ["__doc", "__id"]
    gone = stored(gone.select(F.col("doc").alias("__doc"), F.col("id").alias("__id")).distinct(), "gone")
    again = rows.filter("c is not null").join(several, "c", "left_semi").groupBy("doc", "id").count().filter("count > 1")
    again = stored(again.select(F.col("doc").alias("__doc"), F.col("id").alias("__id")), "again")
    named = plain.withColumn("__doc", F.col(ident)).withColumn("__id", F.unhex(F.md5(F.col(text).cast("binary"))))
    named = perhaps(named, gone.union(again), pair)
    # Outer joins, not anti joins, which would be planned below the bitmap and move all texts.
    kept, some = named.filter("not __hit"), _without(named.filter("__hit"), gone)
    if again.isEmpty():
        kept = kept.unionByName(some)
    else:
        listed = again.withColumnsRenamed({"__doc": "__d", "__id": "__i"})
        twice = some.join(listed, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__id") == F.col("__i"))).drop("__d", "__i")
        kept = kept.unionByName(_without(some, again)).unionByName(twice.dropDuplicates(pair))
    return like(kept.select(*plain.columns).toDF(*names), docs)
