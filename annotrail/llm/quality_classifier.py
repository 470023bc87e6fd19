"""Quality classifier from weak labels.

Overlapping heuristics each call a text good, bad or nothing. Their accuracies
are estimated without labels by expectation maximisation: a text's true class is
hidden, and each heuristic votes independently given the class, with its own
chances for each class. Only the pattern of votes matters, so all texts are
counted by pattern and the estimation runs over at most 3 ** (heuristics)
counts, exactly as over all texts. Posterior classes of a bounded sample
(``MAX_TRAIN`` texts, half of each likely class, drawn by hash) then train a
linear scorer over hashed features: byte trigrams, four-grams of character
classes, and ranges of the text's statistics. It scores every whole text.

Defined cases: null and wordless texts have score 0 and are not kept. An empty
corpus gives no row. If all texts are of one class, the scorer has that class's
intercept alone. Repeated rows count each.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotrail.llm.common import by_row

MAX_TRAIN = 4000
DIM = 1 << 14
STEPS = 300
RIDGE = 1e-4
PRIOR_SHARE = 0.05
_U = np.uint64

#: Classes of bytes; lower, upper, digit, blank, newline, above ASCII; other bytes stay themselves.
_CLASS = np.array(
    [1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c in (32, 9) else 5 if c == 10 else 1 if c >= 128 else c for c in range(256)],
    np.uint64,
)
#: Ranges of the statistics.
_EDGES = np.geomspace(1e-3, 30, 24)
_PLAIN = re.compile(rb"[\"'(]?[A-Za-z\x80-\xff'-]+[.,;:?!\"')]?")
_END = (b".", b"!", b"?", b'"', b":", b";", b")")


def statistics(raw: bytes) -> dict[str, float]:
    words = raw.split()
    each = Counter(words)
    n = max(len(words), 1)
    lines = [x.strip() for x in raw.split(b"\n") if x.strip()]
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lower, upper = counts[97:123].sum(), counts[65:91].sum()
    letters = max(lower + upper, 1)
    symbols = sum(int(counts[c]) for c in b"#*$%&|<>{}[]\\^~_=+@")
    marks = sum(int(counts[c]) for c in b"!?")
    return {
        "words": len(words),
        "variety": len(each) / n,
        "mean_word": sum(map(len, words)) / n,
        "upper": upper / letters,
        "symbols": symbols / n,
        "marks": marks / n,
        "digits": counts[48:58].sum() / max(len(raw), 1),
        "ended": sum(x.endswith(_END) for x in lines) / max(len(lines), 1),
        "same_lines": 1 - len(set(lines)) / max(len(lines), 1),
        "plain_words": sum(k for w, k in each.items() if _PLAIN.fullmatch(w)) / n,
    }


def _range(x: float, good: tuple[float, float], bad: tuple[float, float]) -> int:
    """1 inside the good range, 0 outside the bad limits, 2 (no vote) between."""
    return 1 if good[0] <= x <= good[1] else 0 if x < bad[0] or x > bad[1] else 2


def votes(s: dict[str, float]) -> tuple[int, ...]:
    """What each heuristic says: 1 good, 0 bad, 2 nothing."""
    # The share of different words falls with length, as for any natural text.
    least = min(0.5, 4 * max(s["words"], 1) ** -0.5)
    return (
        _range(s["symbols"], (0, 0.03), (0, 0.15)),
        _range(s["upper"], (0, 0.25), (0, 0.6)),
        2 if s["words"] < 20 else _range(s["variety"], (least, 1), (least / 2.5, 1)),
        _range(s["mean_word"], (3.0, 9.0), (2.0, 14.0)),
        _range(s["ended"], (0.5, 1), (0.1, 1)),
        2 if s["words"] < 20 else _range(s["marks"], (0, 0.1), (0, 0.4)),
        2 if s["words"] < 50 else _range(s["same_lines"], (0, 0.2), (0, 0.5)),
        _range(s["digits"], (0, 0.1), (0, 0.3)),
        2 if s["words"] < 10 else _range(s["plain_words"], (0.85, 1), (0.6, 1)),
    )


@dataclass(frozen=True)
class Labeller:
    """Prior of good texts, and each heuristic's chance of a good vote by class, given that it votes."""

    prior: float
    chance: np.ndarray = field(repr=False)

    def posterior(self, votes_: tuple[int, ...]) -> float:
        odds = np.log(self.prior) - np.log(1 - self.prior)
        for (bad, good), vote in zip(self.chance, votes_, strict=True):
            if vote < 2:
                odds += np.log(good if vote else 1 - good) - np.log(bad if vote else 1 - bad)
        return float(1 / (1 + np.exp(-np.clip(odds, -500, 500))))


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 100) -> Labeller:
    """Expectation maximisation over the counts of vote patterns.

    It starts from texts with a bad vote being bad. A heuristic's chances have a
    prior worth ``PRIOR_SHARE`` of the texts: it rarely calls a good text bad, and
    finds half of the bad ones. A vote withheld says nothing about the class.
    """
    patterns = sorted(counts)
    v = np.array(patterns)
    n = np.array([counts[p] for p in patterns], float)
    q = np.where((v == 0).any(1), 0.1, 0.95)
    extra = PRIOR_SHARE * n.sum() + 1
    out = None
    for _ in range(rounds):
        chance = np.empty((v.shape[1], 2))
        for k, least in ((0, 0.5), (1, 0.99)):
            weight = n * (q if k else 1 - q)
            good, all_ = ((weight[:, None] * x).sum(0) for x in (v == 1, v < 2))
            chance[:, k] = np.clip((good + least * extra) / (all_ + extra), 1e-4, 1 - 1e-4)
        out = Labeller(float(np.clip(((n * q).sum() + 1) / (n.sum() + 2), 1e-4, 1 - 1e-4)), chance)
        new = np.array([out.posterior(p) for p in patterns])
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return out


def hashed(raw: bytes, stats: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Features (index, value) of a text; the values of each kind have length 1."""
    b = np.frombuffer(raw, np.uint8)
    parts = []
    for codes, n, salt in ((b.astype(np.uint64), 3, 1), (_CLASS[b], 4, 2)):
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, salt, np.uint64)
        for k in range(n):
            h = (h + codes[k : k + len(h)]) * _U(0x9E3779B97F4A7C15)
            h ^= h >> _U(29)
        count = np.bincount((h % _U(DIM)).astype(np.int64), minlength=DIM)
        at = np.flatnonzero(count)
        parts.append((at, np.sqrt(count[at] / len(h))))
    bins = np.searchsorted(_EDGES, list(stats.values()), "right")
    at = (7919 * np.arange(1, len(bins) + 1) + 104729 * bins) % DIM
    parts.append((at, np.full(len(at), len(at) ** -0.5)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fit(samples: list[tuple[float, float, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Weights and intercept from (posterior, weight, index, value), by accelerated descent on the logistic loss."""
    y, c = (np.array([s[k] for s in samples]) for k in (0, 1))
    c = c / c.sum()
    row = np.repeat(np.arange(len(samples)), [len(s[2]) for s in samples])
    col, val = (np.concatenate([s[k] for s in samples]) for k in (2, 3))
    # Sums over runs: of a row as the values stand, of a column in order of the columns.
    starts = np.concatenate([[0], np.cumsum([len(s[2]) for s in samples])[:-1]])
    by_col = np.argsort(col, kind="stable")
    col_row, col_val, here = row[by_col], val[by_col], np.unique(col)
    col_starts = np.searchsorted(col[by_col], here)
    w, b = np.zeros(DIM), 0.0
    ahead, b_ahead, speed, step = w, b, 1.0, 1 / (0.25 * 4 + RIDGE)
    for _ in range(STEPS):
        z = np.add.reduceat(val * ahead[col], starts) + b_ahead
        miss = c * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        slope = RIDGE * ahead
        slope[here] += np.add.reduceat(col_val * miss[col_row], col_starts)
        new = ahead - step * slope
        b_new = b_ahead - step * miss.sum()
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead, b_ahead = new + (speed - 1) / faster * (new - w), b_new + (speed - 1) / faster * (b_new - b)
        w, b, speed = new, b_new, faster
    return w, b


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, votes, posterior (by the votes), score (by the scorer) and kept (score of 0.5 or more): a row for each row."""

    def count():
        def one(text):
            raw = (text or "").encode()
            if raw.split():
                yield (list(votes(statistics(raw))),)

        return one

    voted = by_row(docs, [text_col], "v array<int>", count)
    counts = {tuple(r.v): r.n for r in voted.groupBy("v").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return docs.select(F.col(id_col), F.lit(None).cast("array<int>").alias("votes"), F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    labeller = estimate(counts)
    posterior = {v: labeller.posterior(v) for v in counts}
    sizes = [sum(n for v, n in counts.items() if (posterior[v] >= 0.5) == side) for side in (False, True)]
    take = [min(1.0, MAX_TRAIN / 2 / n) if n else 0.0 for n in sizes]

    def sample(take=take, posterior=posterior):
        def one(h, text):
            raw = (text or "").encode()
            u = (h % (1 << 32)) / (1 << 32)
            if u >= max(take) or not raw.split():
                return
            s = statistics(raw)
            p = posterior[votes(s)]
            if u < take[p >= 0.5]:
                at, value = hashed(raw, s)
                yield p, 1 / take[p >= 0.5], at.astype(np.int32).tobytes(), value.astype(np.float32).tobytes()

        return one

    picked = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")).filter(F.pmod("h", F.lit(1 << 32)) < max(take) * (1 << 32))
    picked = by_row(picked, ["h", "t"], "p double, c double, at binary, value binary", sample).collect()
    samples = sorted((r.p, r.c, bytes(r.at), bytes(r.value)) for r in picked)
    if samples:
        w, b = fit([(p, c, np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for p, c, a, v in samples])
    else:
        w, b = np.zeros(DIM), 0.0
    sent = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), float(b), posterior))
    kind = docs.schema[id_col].dataType.simpleString()

    def score():
        w, b, posterior = sent.value

        def one(ident, text):
            raw = (text or "").encode()
            if not raw.split():
                yield ident, None, 0.0, 0.0, False
                return
            s = statistics(raw)
            v = votes(s)
            at, value = hashed(raw, s)
            z = b + float((w[at] * value).sum())
            p = float(1 / (1 + np.exp(-min(max(z, -500), 500))))
            yield ident, list(v), posterior[v], p, p >= 0.5

        return one

    return by_row(docs, [id_col, text_col], f"`{id_col}` {kind}, votes array<int>, posterior double, score double, kept boolean", score)
