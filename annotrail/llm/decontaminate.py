"""Benchmark decontamination with a generalised suffix automaton.

The items of a benchmark, lower-cased and cut into words, form one automaton.
Every text streams through it; the longest match that ends at each word tells
which words lie in a window (``window`` consecutive item words, or the whole
item where it is shorter). Windows never cross a text, and a word outside the
benchmark's vocabulary ends every match, so only runs of known words stream.

Defined cases: a null or wordless text has no words and no hits. Items that
are null or wordless have no window. An item with a null id removes words but
is in no list of items. Repeated items count once by id; repeated rows of the
corpus are rows of the result. An empty benchmark leaves every text alone.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotrail.llm.common import by_row, like, stored

WINDOW = 10
#: Bytes of benchmark text in one automaton; a larger benchmark takes several passes.
BLOCK_BYTES = 8 << 20
#: A text that loses at least this share of its words goes altogether.
MAX_COVERAGE = 0.8

_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
#: Lower-cases A-Z and blanks what is no word byte; bytes from 0x80 belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEEP else 32 for c in range(256))
_SPAN = re.compile(rb"[^ ]+")


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences; states know the items they occur in."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [
            (item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for item, ws in items if ws
        ]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        n = len(self.next)
        self.shortest = min([window, *(len(seq) for _, seq in coded)])
        # owners[v]: items with a window that is the suffix class v.
        self.owners: list[set] = [set() for _ in range(n)]
        self.whole: list[list[tuple[int, str | None]]] = [[] for _ in range(n)]
        for item, seq in coded:
            v = 0
            for c in seq:
                v = self.next[v][c]
                u = v
                while u > 0 and self.length[u] >= window and item not in self.owners[u]:
                    self.owners[u].add(item)
                    u = self.link[u]
            if len(seq) < window:
                while self.length[self.link[v]] >= len(seq):
                    v = self.link[v]
                self.whole[v].append((len(seq), item))
        # top[v]: the class of the last `window` words; short[v]: nearest class of a whole short item.
        self.top = [0] * n
        self.short = [-1] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            self.top[v] = self.top[up] if self.length[up] >= window else v
            self.short[v] = v if self.whole[v] else self.short[up]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def spans(self, text_words: list[bytes]) -> tuple[list[list[int]], set]:
        """Maximal runs [start, end) of hit words, and the items whose windows occur."""
        get, nxt, link, length = self.vocabulary.get, self.next, self.link, self.length
        ids = [get(w, -1) for w in text_words]
        out: list[list[int]] = []
        items: set = set()
        n, at, shortest, window = len(ids), 0, self.shortest, self.window

        def hit(start: int, end: int) -> None:
            while out and start <= out[-1][1]:
                start = min(start, out.pop()[0])
            out.append([start, end])

        while at < n:
            if ids[at] < 0:
                at += 1
                continue
            end = at + 1
            while end < n and ids[end] >= 0:
                end += 1
            if end - at >= shortest:
                v = matched = 0
                for i in range(at, end):
                    c = ids[i]
                    while v and c not in nxt[v]:
                        v = link[v]
                        matched = length[v]
                    if c in nxt[v]:
                        v = nxt[v][c]
                        matched += 1
                    if matched >= window:
                        hit(i + 1 - window, i + 1)
                        items |= self.owners[self.top[v]]
                    u = self.short[v]
                    while u > 0:
                        for size, item in self.whole[u]:
                            if size <= matched:
                                hit(i + 1 - size, i + 1)
                                items.add(item)
                        u = self.short[link[u]]
            at = end
        return out, items


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> list[list]:
    """The benchmark in lists of at most about ``block_bytes``, each small enough to send out."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // block_bytes)
    part = rows.distinct().withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(max(n, 1))))
    return [
        [(r.i, words(r.t)) for r in sorted(part.filter(F.col("b") == k).collect(), key=lambda r: (r.i or "", r.t))]
        for k in range(n)
    ]


_CACHE: dict = {}


def _scan(docs: DataFrame, keep: list[str], text_col: str, found: list, window: int) -> DataFrame:
    """``keep`` and the text with hits: n_words, starts, ends of maximal runs, items."""
    spark = docs.sparkSession
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{fields}, n_words bigint, starts array<int>, ends array<int>, items array<string>"
    out = docs.select(*[F.col(f"`{c}`") for c in keep])
    for k, block in enumerate(found or [[]]):
        sent = spark.sparkContext.broadcast(block)
        at_text = keep.index(text_col)

        def make(sent=sent, first=k == 0, key=uuid.uuid4().hex) -> Callable:
            if _CACHE.get("key") != key:  # a worker serves many tasks
                _CACHE.update(key=key, automaton=Automaton(sent.value, window))
            automaton = _CACHE["automaton"]

            def one(*values):
                row, before = values[: len(keep)], values[len(keep) :]
                ws = words(row[at_text])
                runs, items = automaton.spans(ws) if automaton.vocabulary else ([], set())
                items.discard(None)
                if not first:
                    runs = _merged([*zip(before[1], before[2], strict=True), *runs])
                    items |= set(before[3])
                yield (*row, len(ws), [r[0] for r in runs], [r[1] for r in runs], sorted(items))

            return one

        out = by_row(out, out.columns, schema, make)
        if k + 1 < len(found):
            out = stored(out, "decontaminate")
    return out


def _merged(runs: list) -> list:
    out: list[list[int]] = []
    for s, e in sorted(map(tuple, runs)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """For each row of ``docs``: its id, n_words, the hit runs and the items found."""
    return _scan(docs, [id_col, text_col], text_col, blocks(benchmark, item_col, item_text), window).drop(text_col)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The digest of ``op8``: one row for each row of ``docs``."""
    found = hits(docs, benchmark, window=window)
    n_hit = F.aggregate(
        F.zip_with("starts", "ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b
    )
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


def cut(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the words of the runs, each run taken from its first to its last byte."""
    raw = text.encode()
    at = [(m.start(), m.end()) for m in _SPAN.finditer(raw.translate(_FOLD))]
    out, last = [], 0
    for s, e in zip(starts, ends, strict=True):
        out.append(raw[last : at[s][0]])
        last = at[e - 1][1]
    out.append(raw[last:])
    return b"".join(out).decode()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    window: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
) -> DataFrame:
    """``docs`` with every hit run cut from its text; rows hit over ``max_coverage`` go.

    Rows without a hit come back as they are, null and empty texts included.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    text = f"c{names.index(text_col)}"
    scanned = _scan(plain, plain.columns, text, blocks(benchmark, "item_id", "text"), window)
    at_text = names.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)

    def make():
        def one(*values):
            row, (n_words, starts, ends, _) = list(values[: len(names)]), values[len(names) :]
            if starts:
                if sum(ends) - sum(starts) >= max_coverage * n_words:
                    return
                row[at_text] = cut(row[at_text], starts, ends)
            yield tuple(row)

        return one

    return like(by_row(scanned, scanned.columns, schema, make).toDF(*names), docs)


def digest(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()
