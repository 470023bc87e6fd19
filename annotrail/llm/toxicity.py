"""Toxicity: a linear classifier regularised by counterfactuals.

A text is the set of its lower-cased words and of the words' first three, four
and five letters, hashed; presence counts, not frequency. The model is a
logistic regression over the features whose document frequencies differ
significantly between the labels. Beside the usual penalty on large weights it
has one on score changes: each labelled text that names a group is repeated
with the group terms swapped for others of their kind and with them taken out, a
text that names none with a term put in (drawn by a hash of the text) and with
the next of its kind instead. The squared change of the score, times
``SWAP_PENALTY``, is added to the loss. A group name that happens to be frequent
in toxic texts, or that shares the beginning of a word that is, so gets no weight
of its own, and neutral mentions aren't flagged. The terms are a parameter.
``Model`` has the number of pairs and their mean score change.

The model is fitted on about ``MAX_LABELLED`` labelled rows, drawn by a hash of
their id, and has ``MAX_FEATURES`` features at most; both bound the driver's
work. Texts are scored whole.

Defined cases: null and empty texts have no feature and get the score of the
intercept. Null ids and null labels teach nothing; labels of repeated ids are
averaged. Without labelled rows of both kinds all scores are the mean label,
or 0 without any.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotrail.llm.common import by_row, like, stored

MAX_LABELLED = 20_000
MAX_FEATURES = 4096
MIN_Z = 4.0
SWAP_PENALTY = 4.0
RIDGE = 2e-4
STEPS = 400

#: Group terms by kind; a term is swapped for the next of its kind.
GROUPS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("gay", "lesbian", "bisexual", "queer", "heterosexual"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("african", "european", "american", "mexican", "arab", "chinese", "indian"),
    ("immigrants", "refugees", "citizens", "natives"),
    ("deaf", "blind", "disabled", "autistic"),
    ("elderly", "young", "old", "teenage"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("juden", "muslime", "christen"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("juifs", "musulmans", "chrétiens"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("judíos", "musulmanes", "cristianos"),
)


def swaps(groups: Sequence[Sequence[str]] = GROUPS) -> dict[str, str]:
    """Each lower-cased term with the next of its kind."""
    return {term.lower(): kind[(k + 1) % len(kind)].lower() for kind in groups for k, term in enumerate(kind)}

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    parts = ["=" + word, *("^" + word[:n] for n in (3, 4, 5) if len(word) >= n)]
    return [crc32(p.encode()) >> 1 for p in parts]


def swapped(found: set[str], swap: dict[str, str]) -> list[tuple[set[str], set[str]]]:
    """Pairs of word sets whose scores should be equal: with each group term replaced by the next of its kind, and without; for a text without terms, with one put in, and with the next of its kind."""
    if not swap:
        return []
    if found.isdisjoint(swap):
        terms = sorted(swap)
        term = terms[crc32(" ".join(sorted(found)).encode()) % len(terms)]
        return [(found, found | {term}), (found | {term}, found | {swap[term]})]
    return [(found, {swap.get(w, w) for w in found}), (found, found - swap.keys())]


@dataclass(frozen=True)
class Model:
    """Weights and intercept; the pairs that the penalty acted on, and the mean change of the score between their sides."""

    weights: dict[int, float]
    intercept: float
    n_pairs: int = 0
    gap: float = 0.0

    def scorer(self):
        """A function of a text; it remembers the words that have weights."""
        known: dict[str, tuple[int, ...]] = {}
        weights = self.weights

        def score(text: str | None) -> float:
            hit: set[int] = set()
            for w in words(text):
                f = known.get(w)
                if f is None:
                    f = tuple(x for x in features(w) if x in weights)
                    if len(known) >= 1 << 16:
                        known.clear()
                    known[w] = f
                if f:
                    hit.update(f)
            z = self.intercept + sum(weights[x] for x in sorted(hit))
            return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))

        return score


def fit(samples: list[tuple[float, list[int], list[list[int]]]], n_features: int, swap_penalty: float = SWAP_PENALTY):
    """Weights and intercept from (label, features, features after each swap)."""
    y = np.array([s[0] for s in samples])
    row = np.repeat(np.arange(len(samples)), [len(s[1]) for s in samples])
    col = np.fromiter((x for s in samples for x in s[1]), np.int64)
    pairs = [(set(s[1]), set(g)) for s in samples for g in s[2]]
    change = [(k, x, sign) for k, (a, b) in enumerate(pairs) for x, sign in [*((x, 1.0) for x in sorted(b - a)), *((x, -1.0) for x in sorted(a - b))]]
    c_row, c_col = (np.array([c[k] for c in change], np.int64) for k in range(2))
    return descent(y, row, col, len(pairs), c_row, c_col, np.array([c[2] for c in change]), n_features, swap_penalty)


def descent(y, row, col, n_pairs: int, c_row, c_col, c_sign, n_features: int, swap_penalty: float):
    """Weights and intercept from labels, features (row, col), and for each pair the features with their sign that its second side has and the first hasn't.

    Nesterov's accelerated descent on the mean logistic loss + ridge + swap penalty.
    """

    def times(w):
        return np.bincount(row, w[col], len(y)) if len(col) else np.zeros(len(y))

    def moved(w):
        return np.bincount(c_row, c_sign * w[c_col], n_pairs)

    def back(r, c, v):
        return np.bincount(c, v[r], n_features) if len(c) else np.zeros(n_features)

    # The step is the inverse of the largest curvature, found by power iteration.
    w = np.ones(n_features) / np.sqrt(max(n_features, 1))
    curve = 1.0
    for _ in range(12):
        up = back(row, col, times(w)) / (4 * len(y)) + RIDGE * w
        if len(c_row):
            up += 2 * swap_penalty * np.bincount(c_col, c_sign * moved(w)[c_row], n_features) / n_pairs
        curve = float(np.linalg.norm(up)) or 1.0
        w = up / curve
    step = 1 / (1.1 * curve + 0.25)

    w, b = np.zeros(n_features), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    ahead, b_ahead, speed = w, b, 1.0
    for _ in range(STEPS):
        miss = 1 / (1 + np.exp(-np.clip(times(ahead) + b_ahead, -500, 500))) - y
        grad = back(row, col, miss) / len(y) + RIDGE * ahead
        if len(c_row):
            grad += 2 * swap_penalty * np.bincount(c_col, c_sign * moved(ahead)[c_row], n_features) / n_pairs
        new, b_new = ahead - step * grad, b_ahead - step * miss.mean()
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead, b_ahead = new + (speed - 1) / faster * (new - w), b_new + (speed - 1) / faster * (b_new - b)
        w, b, speed = new, b_new, faster
    return w, b


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    swap_penalty: float = SWAP_PENALTY,
    groups: Sequence[Sequence[str]] = GROUPS,
) -> Model:
    """The model of the labelled rows whose crc32(id as text) mod 5 is not 0."""
    ident = F.col(id_col).cast("string")
    known = labels.select(ident.alias("i"), F.col(label_col).cast("double").alias("y")).filter("i is not null and y is not null")
    known = known.filter(F.crc32(F.col("i").cast("binary")) % 5 != 0)
    n = known.count()
    if n > MAX_LABELLED:
        known = known.filter(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < int((1 << 20) * MAX_LABELLED / n))
    known = known.groupBy("i").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    rows = docs.select(ident.alias("i"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h")).join(F.broadcast(stored(known, "toxicity-labels")), "i")

    swap = swaps(groups)

    def make():
        def one(h, y, text):
            found = words(text)
            own = {f for w in found for f in features(w)}
            pick = lambda ws: own | {f for w in ws - found for f in features(w)} if ws >= found else {f for w in ws for f in features(w)}
            # Of each pair only the features that one side has and the other hasn't, and each side's score without them.
            pairs = []
            for a, b in swapped(found, swap):
                a, b = pick(a), pick(b)
                pairs.append([sorted(a - b), sorted(b - a), sorted(a - own), sorted(own - a)])
            yield h, y, sorted(own), pairs

        return one

    rows = stored(by_row(rows, ["h", "y", "t"], "h bigint, y double, f array<bigint>, g array<array<array<bigint>>>", make), "toxicity-rows")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("pos")).first()
    pos, neg = total["pos"], total["n"] - total["pos"]
    if not pos or not neg:
        mean = pos / total["n"] if total["n"] else 0.0
        return Model({}, 500.0 if mean == 1 else -500.0)
    # Two-proportion z of each feature; both versions of a swapped text count for the frequency.
    freq = rows.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.count("*").alias("k"))
    share = F.col("k") / (pos + neg)
    z = (F.col("a") / pos - (F.col("k") - F.col("a")) / neg) / F.sqrt(share * (1 - share) * (1 / pos + 1 / neg))
    freq = freq.filter((F.col("k") >= 3) & (F.col("k") < pos + neg)).withColumn("z", z).filter(F.abs("z") >= MIN_Z)
    chosen = sorted(r.f for r in freq.orderBy(F.desc(F.abs("z")), "f").limit(MAX_FEATURES).collect())
    if not chosen:
        return Model({}, float(np.log(pos / neg)))
    at = {f: k for k, f in enumerate(chosen)}
    here = set(chosen)

    def slim():
        def one(h, y, f, g):
            yield h, y, [at[x] for x in f if x in here], [[[at[x] for x in part if x in here] for part in pair] for pair in g]

        return one

    # As arrays, in an order of their own: sums of floats depend on it.
    found = by_row(rows, ["h", "y", "f", "g"], "h bigint, y double, f array<int>, g array<array<array<int>>>", slim).toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    y, (f, g) = found["y"].to_numpy(), (found[c].combine_chunks() for c in "fg")
    row, col = _flat(f)
    of_pair, pairs = _of(g), g.flatten()
    part, member = _flat(pairs.flatten())  # four parts of each pair: gone, come, added, dropped
    pair, kind = part // 4, part % 4
    moved = kind < 2
    sign = np.where(kind % 2 == 1, 1.0, -1.0)
    w, b = descent(y, row, col, len(pairs), pair[moved], member[moved], sign[moved], len(chosen), swap_penalty)
    gap = 0.0
    if len(pairs):
        own = np.bincount(row, w[col], len(y))[of_pair]
        first = b + own + np.bincount(pair[~moved], -sign[~moved] * w[member[~moved]], len(pairs))
        second = first + np.bincount(pair[moved], sign[moved] * w[member[moved]], len(pairs))
        gap = float(np.abs(np.diff([1 / (1 + np.exp(-np.clip(z, -500, 500))) for z in (first, second)], axis=0)).mean())
    return Model({f: float(w[k]) for f, k in at.items() if w[k]}, float(b), len(pairs), gap)


def _of(lists) -> np.ndarray:
    """The list that each value of an Arrow array of lists is in."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    return _of(lists), lists.flatten().to_numpy().astype(np.int64)


def _scored(docs: DataFrame, columns: list[str], text_col: str, model: Model) -> DataFrame:
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    at = columns.index(text_col)

    def make():
        score = model.scorer()

        def one(*row):
            yield (*row, score(row[at]))

        return one

    return by_row(docs, columns, f"{kinds}, `__score` double", make)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of ``op9``: a row for each row; a null id is not held out."""
    rows = _scored(docs.select("doc_id", "text"), ["doc_id", "text"], "text", train(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model, trained on them and ``labels``, calls toxic."""
    model = train(docs, labels, text_col=text_col)
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    kept = _scored(plain, plain.columns, f"c{names.index(text_col)}", model).filter("__score < 0.5")
    return like(kept.drop("__score").toDF(*names), docs)
