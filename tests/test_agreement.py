"""Agreement and validation against values computed from the published definitions."""

import itertools
import random

import pytest

from annotrail.operators import legacy, reliability, validation
from annotrail.operators import ratings as R
from annotrail.plans import lineage


def coder(spark, values, by="v", start=1):
    kind = "string" if any(isinstance(v, str) for v in values) else "double"
    rows = [(k, v if v is None or kind == "string" else float(v)) for k, v in enumerate(values, start)]
    return spark.createDataFrame(rows, f"`.id` int, `{by}` {kind}").coalesce(1)


def long(spark, *columns):
    names = [f"r{k}" for k in range(1, len(columns) + 1)]
    return R.ratings_long({n: coder(spark, c) for n, c in zip(names, columns)}, "v"), names


def row(df):
    return df.first().asDict()


F1 = ("AAAAAAABBB", "ABABABABAB")


def test_nominal_two_coders(spark):
    r, names = long(spark, *F1)
    got = row(reliability.compare(r, names, "nominal"))
    assert got["percent_agreement"] == pytest.approx(0.6)
    assert got["kappa"] == pytest.approx(0.2) and got["kappa_type"] == "Cohen's"
    assert got["alpha_nominal"] == pytest.approx(0.208333, abs=1e-6)
    assert got["subjects"] == 10 and got["raters"] == 2


def test_nominal_three_coders(spark):
    r, names = long(spark, "ABABABAB", "AAAAAABB", "AAAAAAAB")
    got = row(reliability.compare(r, names, "nominal"))
    assert (got["percent_agreement"], got["kappa"], got["alpha_nominal"]) == pytest.approx((0.5, 0.193277, 0.226891), abs=1e-6)
    assert got["kappa_type"] == "Fleiss'"


F4 = ([1, 2, 3, 1, 2], [1, 2, 2, 1, 3])
F9 = ([1, 2, 3, 4, 5, 3], [2, 2, 3, 5, 5, 1], [1, 3, 3, 4, 4, 2])


def test_ordered_two_coders(spark):
    r, names = long(spark, *F4)
    o = row(reliability.compare(r, names, "ordinal"))
    assert (o["alpha_ordinal"], o["kappa_weighted"], o["w"], o["rho"], o["percent_agreement"]) == pytest.approx((0.775, 0.642857, 0.7875, 0.75, 0.6), abs=1e-6)
    i = row(reliability.compare(r, names, "interval", tolerance=1))
    assert (i["alpha_interval"], i["icc"], i["r"], i["percent_agreement"]) == pytest.approx((0.678571, 0.692308, 0.642857, 1.0), abs=1e-6)
    q = row(reliability.compare(r, names, "ratio"))
    assert q["alpha_ratio"] == pytest.approx(0.824295, abs=1e-6)
    assert "alpha_interval" in reliability.compare(r, names, "ratio", compat=True).columns


def test_ordered_three_coders(spark):
    r, names = long(spark, *F9)
    o = row(reliability.compare(r, names, "ordinal", tolerance=1))
    assert (o["alpha_ordinal"], o["w"], o["rho"], o["percent_agreement"]) == pytest.approx((0.798783, 0.831746, 0.810325, 0.833333), abs=1e-6)
    assert "kappa_weighted" not in o
    i = row(reliability.compare(r, names, "interval"))
    assert (i["alpha_interval"], i["icc"], i["r"], i["percent_agreement"]) == pytest.approx((0.786355, 0.804469, 0.808453, 0.166667), abs=1e-6)
    assert row(reliability.compare(r, names, "ratio"))["alpha_ratio"] == pytest.approx(0.644856, abs=1e-6)


def test_levels_can_be_given(spark):
    r, names = long(spark, ["low", "medium", "high", "low"], ["low", "high", "high", "low"])
    given = row(reliability.compare(r, names, "ordinal", order=["low", "medium", "high"]))
    default = row(reliability.compare(r, names, "ordinal"))
    assert given["kappa_weighted"] != pytest.approx(default["kappa_weighted"])


def test_constant_coder_gives_nulls(spark):
    r, names = long(spark, [1, 1, 1], [1, 2, 3])
    assert row(reliability.compare(r, names, "interval"))["r"] is None
    r, names = long(spark, "AAA", "AAA")
    got = row(reliability.compare(r, names, "nominal"))
    assert got["alpha_nominal"] == 1.0 and got["kappa"] is None and got["percent_agreement"] == 1.0


def coincidence_alpha(units, distance):
    """Krippendorff's alpha by its coincidence matrix."""
    units = [[v for v in u if v is not None] for u in units]
    units = [u for u in units if len(u) > 1]
    values = [v for u in units for v in u]
    do = sum(distance(a, b, values) / (len(u) - 1) for u in units for a, b in itertools.permutations(u, 2))
    de = sum(distance(a, b, values) for a, b in itertools.permutations(values, 2)) / (len(values) - 1)
    return 1 - do / de


DISTANCE = {
    "nominal": lambda a, b, _: float(a != b),
    "interval": lambda a, b, _: (a - b) ** 2,
    "ratio": lambda a, b, _: ((a - b) / (a + b)) ** 2,
    "ordinal": lambda a, b, v: (sum(min(a, b) <= x <= max(a, b) for x in v) - (v.count(a) + v.count(b)) / 2) ** 2,
}


@pytest.mark.parametrize("level", list(DISTANCE))
def test_alpha_equals_coincidence_form_with_gaps(spark, level):
    rng = random.Random(level)
    units = [[rng.choice([None, 1, 2, 3, 4]) for _ in range(4)] for _ in range(30)]
    r, names = long(spark, *zip(*units))
    got = getattr(reliability, f"alpha_{level}")(r).first()[0]
    assert got == pytest.approx(coincidence_alpha(units, DISTANCE[level]), abs=1e-9)


def confusion_of(spark, estimate, gold):
    r = R.ratings_long({"e": coder(spark, estimate), "t": coder(spark, gold)}, "v")
    return validation.confusion(validation.aligned(r, "e", "t"))


def test_validation_nominal(spark):
    table = confusion_of(spark, *F1)
    classes = validation.by_class(table)
    assert row(validation.averaged(classes, "macro")) == pytest.approx({"precision": 0.619048, "recall": 0.6, "f1": 0.583333}, abs=1e-6)
    assert row(validation.averaged(classes, "micro")) == pytest.approx({"precision": 0.6, "recall": 0.6, "f1": 0.6})
    by = {x["class"]: x for x in classes.collect()}
    assert (by["A"].precision, by["A"].recall, by["B"].precision, by["B"].recall) == pytest.approx((4 / 7, 4 / 5, 2 / 3, 2 / 5))


def test_validation_class_never_predicted(spark):
    classes = validation.by_class(confusion_of(spark, "AAAABBBBAA", "AAAAAABBBC"))
    assert row(validation.accuracy_kappa(classes)) == pytest.approx({"n": 10, "accuracy": 0.6, "kappa": 0.230769}, abs=1e-6)
    assert row(validation.averaged(classes, "macro")) == pytest.approx({"precision": 0.583333, "recall": 0.444444, "f1": 0.619048}, abs=1e-6)
    assert row(validation.averaged(classes, "weighted")) == pytest.approx({"precision": 0.611111, "recall": 0.6, "f1": 0.634921}, abs=1e-6)


F6 = ([1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 2, 3, 4, 5, 1, 3, 4, 5, 1, 2], [1, 2, 3, 4, 5, 2, 3, 4, 5, 4, 2, 3, 3, 5, 1, 3, 4, 4, 2, 2])


def test_validation_ordinal_and_interval(spark):
    o = row(validation.ordinal_metrics(confusion_of(spark, *F6)))
    assert (o["rho"], o["tau"], o["mae"]) == pytest.approx((0.90532, 0.82918, 0.4), abs=1e-5)
    r = R.ratings_long({"e": coder(spark, F6[0]), "t": coder(spark, F6[1])}, "v")
    i = row(validation.interval_metrics(validation.aligned(r, "e", "t")))
    assert (i["r"], i["icc"], i["mae"], i["rmse"]) == pytest.approx((0.897891, 0.890805, 0.4, 0.632456), abs=1e-6)


def test_validation_order_of_numbers(spark):
    table = confusion_of(spark, [1, 2, 10, 9, 3, 2], [2, 2, 9, 10, 3, 1])
    o = row(validation.ordinal_metrics(table))
    assert (o["rho"], o["tau"], o["mae"]) == pytest.approx((0.808824, 0.642857, 0.666667), abs=1e-6)
    c = row(validation.ordinal_metrics(table, compat=True))
    assert (c["rho"], c["tau"], c["mae"]) == pytest.approx((-0.308824, -0.214286, 1.666667), abs=1e-6)


WIDE = [("a", "A", "A", "A"), ("b", "A", "B", "A"), ("c", "B", "B", None), ("d", "C", "C", "C"), ("e", "B", None, None), ("f", "A", "B", "C"), ("g", None, "C", "C")]


def test_older_interface(spark):
    d = spark.createDataFrame(WIDE, "id string, c1 string, c2 string, c3 string")
    got = legacy.validate(d, "id", ["c1", "c2", "c3"])
    assert (got["units_included"], got["coders"], got["categories"]) == (6, 3, 3)
    want = {"percent_unanimous_units": 0.6667, "mean_pairwise_percent_agreement": 0.65, "mean_pairwise_cohens_kappa": 0.4521, "kripp_alpha_nominal": 0.5536, "fleiss_kappa": 0.3182}
    assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-4)
    gold = {r.coder_id: r for r in legacy.validate(d, "id", ["c1", "c2", "c3"], mode="gold", gold_col="c1").collect()}
    assert (gold["c2"].n, gold["c2"].accuracy, gold["c2"].precision_macro, gold["c2"].recall_macro, gold["c2"].f1_macro) == pytest.approx((5, 0.6, 0.7778, 0.7778, 0.6667))
    assert (gold["c3"].n, gold["c3"].accuracy, gold["c3"].precision_macro, gold["c3"].recall_macro, gold["c3"].f1_macro) == pytest.approx((4, 0.75, 0.75, 0.8333, 0.7333))
    assert legacy.validate(d, "id", ["c1", "c2", "c3"], output="data.frame").count() == 8
    with pytest.raises(ValueError):
        legacy.validate(d, "id", ["c1"])
    with pytest.raises(ValueError):
        legacy.validate(d, "id", ["c1", "c2"], min_coders=1)


def test_compare_and_validate_objects(spark):
    a, b = coder(spark, F1[0], "category"), coder(spark, F1[1], "category")
    got = lineage.compare({"a": a, "b": b}, "category")
    assert got.kappa == pytest.approx(0.2) and got.run.kind == "comparison"
    assert lineage.compare({"a": a, "b": b}, "category", level="ordinal").run.name != got.run.name
    v = lineage.validate(a, b, "category", average="none")
    assert v.accuracy == pytest.approx(0.6) and v.by_class.count() == 2
    with pytest.raises(ValueError, match="At least two"):
        lineage.compare({"a": a}, "category")
    with pytest.raises(TypeError, match="must be"):
        lineage.compare({"a": a, "b": 3}, "category")
    with pytest.raises(ValueError, match="not found"):
        lineage.compare({"a": a, "b": b}, "other")
    with pytest.raises(ValueError, match="No common units"):
        lineage.compare({"a": a, "b": coder(spark, "AB", "category", 90)}, "category")
    with pytest.raises(ValueError, match="more than once"):
        lineage.compare({"a": a.union(a), "b": b}, "category")
    assert lineage.compare({"a": a.union(a), "b": b}, "category", dedupe="first").subjects == 10
    with pytest.raises(ValueError, match="must contain"):
        lineage.validate(a, b.withColumnRenamed(".id", "x"), "category")
    with pytest.raises(ValueError, match="No matching units"):
        lineage.validate(a, coder(spark, "AB", "category", 90), "category")
    with pytest.raises(ValueError, match="No complete cases"):
        lineage.validate(a, spark.createDataFrame([(1, None)], "`.id` int, category string"), "category")
    with pytest.warns(UserWarning, match="Missing values detected"):
        assert lineage.validate(coder(spark, [None, "A", "B"], "category"), b, "category").n == 2
    with pytest.warns(UserWarning, match="average"):
        lineage.validate(coder(spark, [1, 2], "n"), coder(spark, [1, 2], "n"), "n", level="ordinal", average="micro")
    assert lineage.validate(coder(spark, "ABABABABAB", "category"), coder(spark, "ABABABABABA", "category", 5), "category").n == 6


def test_ratio_alpha_of_many_values(spark, monkeypatch):
    """Blocks of values against blocks give what all pairs give; ratios over zero sums count nothing."""
    import numpy as np

    monkeypatch.setattr(reliability, "BLOCK", 64)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.gamma(2.0, 3.0, (400, 2)), [[0.0, 0.0], [2.0, -2.0]]])
    rows = [(str(k), r, str(v), float(v)) for k, pair in enumerate(x) for r, v in zip("ab", pair)]
    got = reliability.alpha_ratio(spark.createDataFrame(rows, "unit_id string, rater_id string, code string, num double")).first()[0]

    def gap(a, b):
        s = a + b
        return np.divide(a - b, s, out=np.zeros(np.broadcast(a, b).shape), where=s != 0) ** 2

    v = x.ravel()
    expected = gap(v[:, None], v[None, :]).sum() / (len(v) - 1)
    observed = 2 * gap(x[:, 0], x[:, 1]).sum()
    assert got == pytest.approx(1 - observed / expected, rel=1e-9)


@pytest.mark.parametrize("level", ["nominal", "ordinal", "interval"])
@pytest.mark.parametrize("m", [2, 3])
def test_cells_equal_the_long_way(spark, monkeypatch, level, m):
    """Counts of combinations give the same row as joins and windows do; gaps and equal codes included."""
    from annotrail.operators import cells

    rng = random.Random(31)
    names = "abc"[:m]
    rows = [(str(u), r, str(v), float(v)) for u in range(300) for r, v in zip(names, [min(9, max(1, u % 7 + rng.randrange(3))) for _ in names]) if rng.random() > 0.1]
    d = spark.createDataFrame(rows, "unit_id string, rater_id string, code string, num double")
    short = reliability.compare(d, list(names), level, 1.0).first().asDict()
    monkeypatch.setattr(cells, "MAX_CELLS", 0)
    long = reliability.compare(d, list(names), level, 1.0).first().asDict()
    assert list(short) == list(long)
    for k, v in long.items():
        assert short[k] == (pytest.approx(v, rel=1e-9) if isinstance(v, float) else v), k
