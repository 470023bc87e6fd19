"""Agreement from counts of the combinations of codes that complete units have.

Labels, ordered levels and measurements on a scale have few combinations however
many units there are: two shuffles (by unit, by combination) leave a table of at
most ``MAX_CELLS`` rows, from which all statistics follow by weighted sums. A
table of more combinations goes the way of ``reliability``, with equal results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CELLS = 20_000


def combinations(ratings: DataFrame, raters: list[str]) -> DataFrame:
    """(code0, num0, code1, ..., n) of the units that every rater has coded once; ``extra`` counts rows beyond one for each rater."""
    coded = ratings.filter("code is not null")
    cells = [F.min(F.when(F.col("rater_id") == r, F.struct("code", "num"))).alias(f"c{k}") for k, r in enumerate(raters)]
    unit = coded.groupBy("unit_id").agg(*cells, F.count("*").alias("m")).filter(F.col("m") == len(raters)).dropna()
    both = [F.col(f"c{k}.{x}").alias(f"{x}{k}") for k in range(len(raters)) for x in ("code", "num")]
    return unit.select(*both).groupBy(*[f"{x}{k}" for k in range(len(raters)) for x in ("code", "num")]).agg(F.count("*").alias("n"))


def _ratio(a: float, b: float) -> float | None:
    return None if b == 0 else float(a) / float(b)


def _alpha(x: np.ndarray, n: np.ndarray) -> float | None:
    """Interval alpha of units' values x (a row for each combination, n units)."""
    m = x.shape[1]
    x = x - (x * n[:, None]).sum() / (m * n.sum())
    s, q = x.sum(1), (x * x).sum(1)
    do = float((n * 2 * (m * q - s * s)).sum()) / (m - 1)
    total = float(m * n.sum())
    de = 2 * (total * float((n * q).sum()) - float((n * s).sum()) ** 2) / (total - 1)
    return 1.0 if abs(de) < 1e-300 else 1 - do / de


def _pearson(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float | None:
    w = n / n.sum()
    x, y = x - (w * x).sum(), y - (w * y).sum()
    return _ratio((w * x * y).sum(), np.sqrt((w * x * x).sum() * (w * y * y).sum()))


def _mean_pairs(x: np.ndarray, n: np.ndarray) -> float | None:
    found = [_pearson(x[:, i], x[:, j], n) for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])]
    return None if None in found else float(np.mean(found))


def _icc(x: np.ndarray, n: np.ndarray) -> float | None:
    m, units = x.shape[1], float(n.sum())
    x = x - ((x * n[:, None]).sum(0) / units).mean()
    row = x.mean(1)
    ssr, ssc = m * float((n * row * row).sum()), units * float((((x * n[:, None]).sum(0) / units) ** 2).sum())
    if units < 2:
        return None
    msr, msc = ssr / (units - 1), ssc / (m - 1)
    mse = (float((n[:, None] * x * x).sum()) - ssr - ssc) / ((units - 1) * (m - 1))
    return _ratio(msr - mse, msr + (m - 1) * mse + m * (msc - mse) / units)


def _ranks(level: np.ndarray, n: np.ndarray, shift: float) -> np.ndarray:
    """Of each of the levels 0, 1, ...: the count below, and half of its own count and ``shift``."""
    k = np.bincount(level, n, level.max() + 1)
    return np.concatenate([[0], np.cumsum(k)[:-1]]) + (k + shift) / 2


def statistics(code: np.ndarray, num: np.ndarray, n: np.ndarray, level: str, tolerance: float, order: list[str] | None, compat: bool) -> dict[str, float | str | None]:
    """The statistics of ``level`` by name, in the order of ``reliability.compare``; num is NaN for what is no number."""
    m = code.shape[1]
    same = lambda x: _ratio(n[x.max(1) - x.min(1) <= tolerance].sum(), n.sum())
    equal = _ratio(n[(code == code[:, :1]).all(1)].sum(), n.sum())
    numeric = not np.isnan(num).any()
    if level == "interval":
        return {"alpha_interval": _alpha(num, n), "icc": _icc(num, n), "r": _mean_pairs(num, n), "percent_agreement": same(num)}
    kinds = sorted(set(code.ravel()), key=str.encode)
    if level == "ordinal":
        value = {c: v for c, v in zip(code.ravel(), num.ravel(), strict=True)}
        kinds = [c for c in order if c in value] if order else sorted(kinds, key=lambda c: (value[c], c.encode()) if numeric else c.encode())
    place = {c: k for k, c in enumerate(kinds)}
    at = np.array([[place.get(c, -1) for c in row] for row in code])
    counts = np.array([np.bincount(at[:, k], n, len(kinds)) for k in range(m)])
    total = float(m * n.sum())
    if level == "nominal":
        s2 = sum(((at == at[:, [k]]).sum(1)) for k in range(m))  # the sum of squared counts of a unit's codes
        pooled = float((counts.sum(0) ** 2).sum())
        expected = _ratio(total * total - pooled, total - 1)
        alpha = 1.0 if expected == 0 else None if expected is None else 1 - float((n * (m * m - s2)).sum()) / (m - 1) / expected
        if m == 2:
            po, pe, name = equal, _ratio((counts[0] * counts[1]).sum(), float(n.sum()) ** 2), "Cohen's"
        else:
            po, pe, name = _ratio(float((n * s2).sum()) - total, total * (m - 1)), _ratio(pooled, total * total), "Fleiss'"
        return {"kappa_type": name, "alpha_nominal": alpha, "kappa": _ratio(po - pe, 1 - pe), "percent_agreement": same(num) if compat and tolerance > 0 and numeric else equal}
    mid = _ranks(at.ravel(), np.repeat(n, m), 0.0)[at]
    rank = np.stack([_ranks(at[:, k], n, 1.0)[at[:, k]] for k in range(m)], axis=1)
    units, sums = float(n.sum()), rank.sum(1)
    w = _ratio(12 * float((n * (sums - (n * sums).sum() / units) ** 2).sum()), m * m * (units**3 - units))
    out = {"alpha_ordinal": _alpha(mid, n), "w": w, "rho": _mean_pairs(rank, n)}
    if m == 2:
        x, y = (at + 1.0).T
        mean = lambda z: float((n * z).sum()) / units
        chance = mean(x * x) + mean(y * y) - 2 * mean(x) * mean(y)
        ratio = _ratio(mean((x - y) ** 2), chance)
        out["kappa_weighted"] = None if ratio is None else 1 - ratio
    out["percent_agreement"] = same(at + 1.0) if order else same(num) if numeric else equal
    return out
