"""Shapley values, permutations and calibration against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.operators import calibration as C
from loomgrid.operators import permutation as P
from loomgrid.operators.shapley import contributions, ensemble_values, summary
from loomgrid.operators.trees import Ensemble, Tree


def random_tree(rng, depth, width):
    tree = Tree()

    def build(level, cover):
        node = tree.add(rng.gauss(0, 1), cover)
        if level and cover > 2 and rng.random() < 0.85:
            column = rng.randint(0, width)
            tree.column[node], tree.cut[node] = column, float(rng.randint(0, 3))
            part = cover * rng.uniform(0.1, 0.9)
            tree.left[node] = build(level - 1, part)
            tree.right[node] = build(level - 1, cover - part)
        return node

    build(depth, 100.0)
    return tree


def expected(tree, x, known, node=0):
    """Value of the tree where only the columns in ``known`` are told."""
    column = tree.column[node]
    if column < 0:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if column in known:
        goes_left = x[column] == tree.cut[node] if column == len(x) - 1 else x[column] < tree.cut[node]
        return expected(tree, x, known, left if goes_left else right)
    return sum(tree.cover[c] / tree.cover[node] * expected(tree, x, known, c) for c in (left, right))


def test_shapley_values_equal_the_sum_over_all_coalitions():
    rng = random.Random(3)
    for _ in range(12):
        trees = [random_tree(rng, rng.choice([0, 2, 5]), 3) for _ in range(3)]
        rows = [[rng.uniform(-1, 4) for _ in range(3)] + [float(rng.randint(-1, 3))] for _ in range(6)]
        numbers, category = np.array([r[:3] for r in rows]), np.array([r[3] for r in rows])
        for kind in ("boosting", "forest"):
            found = Ensemble(kind, ["a", "b", "c"], "s", 4, trees, [])
            base, values = ensemble_values(found, numbers, category)
            assert values.sum(1) + base == pytest.approx(found.raw(numbers, category))
            for x, got in zip(rows, values, strict=True):
                for j in range(4):
                    others = [c for c in range(4) if c != j]
                    want = sum(
                        math.factorial(k) * math.factorial(3 - k) / 24 * sum(expected(t, x, {*part, j}) - expected(t, x, set(part)) for t in trees)
                        for k in range(4) for part in itertools.combinations(others, k)
                    )
                    assert got[j] == pytest.approx(want if kind == "boosting" else want / 3, abs=1e-9)


def test_contributions_of_rows(spark):
    rng = random.Random(5)
    found = Ensemble("boosting", ["a", "b"], "s", 3, [random_tree(rng, 4, 2) for _ in range(4)], [])
    rows = [(i, rng.uniform(-1, 4), float(rng.randint(0, 3)), rng.randint(0, 2)) for i in range(50)]
    frame = spark.createDataFrame(rows, "id int, a double, b double, s int")
    base, values = ensemble_values(found, np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows]))
    for r in contributions(found, frame).collect():
        assert r["shap_base"] == pytest.approx(base) and r["shap_values"] == pytest.approx(values[r["id"]].tolist())
    still = {r["feature"]: r["direction"] for r in summary(found, frame.withColumn("a", F.lit(1.0))).collect()}
    assert still["a"] is None and still["s"] is None  # no direction of what doesn't vary
    means = {r["feature"]: r["mean_abs"] for r in summary(found, frame).collect()}
    assert [means[c] for c in ("a", "b", "s")] == pytest.approx(np.abs(values).mean(0).tolist())


def test_permutation_is_exact_and_seeded(spark):
    rows = [(f"k{i}", i % 7, float(i)) for i in range(3000)] + [("none", 1, None)]
    frame = spark.createDataFrame(rows, "k string, g int, x double").repartition(5)
    ranks = sorted(r["r"] for r in P.ranked(frame, F.col("k"), 1, "r").collect())
    assert ranks == list(range(len(rows)))
    got = {r["k"]: (r["g"], r["x"]) for r in P.permuted(frame, F.col("k"), "x").collect()}
    assert {k: g for k, (g, _) in got.items()} == {k: g for k, g, _ in rows}
    assert sorted(map(str, (x for _, x in got.values()))) == sorted(str(r[2]) for r in rows)
    moved = sum(got[k][1] != x for k, _, x in rows)
    assert moved > 2900  # a random permutation keeps about one in place
    assert got == {r["k"]: (r["g"], r["x"]) for r in P.permuted(frame.repartition(2), F.col("k"), "x").collect()}
    assert got != {r["k"]: (r["g"], r["x"]) for r in P.permuted(frame, F.col("k"), "x", 7).collect()}
    assert P.permuted(frame.limit(0), F.col("k"), "x").count() == 0


def test_permutation_importance_finds_what_the_metric_needs(spark):
    rng = random.Random(6)
    frame = spark.createDataFrame([(i, rng.random(), rng.random()) for i in range(500)], "k int, a double, b double").withColumn("y", F.col("a"))
    metric = lambda rows: rows.agg(-F.avg(F.abs(F.col("y") - F.col("a"))))
    found = {r["feature"]: r["importance"] for r in P.permutation_importance(frame, F.col("k"), ["a", "b"], metric).collect()}
    assert found["b"] == 0 and 0.25 < found["a"] < 0.42


def pooled(rows):
    """Plain pool-adjacent-violators over distinct p: (p, fitted)."""
    groups = []
    for p in sorted({p for _, p in rows}):
        ys = [y for y, q in rows if q == p]
        groups.append([sum(ys), len(ys), [p]])
        while len(groups) > 1 and groups[-2][0] * groups[-1][1] >= groups[-1][0] * groups[-2][1]:
            last = groups.pop()
            groups[-1] = [a + b for a, b in zip(groups[-1], last, strict=True)]
    return {p: s / n for s, n, ps in groups for p in ps}


@pytest.mark.parametrize("ties", [False, True])
def test_isotonic_calibration_equals_pooling(spark, ties):
    rng = random.Random(7)
    rows = [(int(rng.random() < p**2), round(p, 2) if ties else p) for p in (rng.random() for _ in range(3000))] + [(1, 0.0), (0, 1.0), (1, 1.0)]
    frame = spark.createDataFrame(rows, "y int, p double").repartition(4)
    blocks = C.isotonic(frame)
    want = pooled(rows)
    got = C.calibrated(frame.withColumn("calibrated", F.lit("clash")).drop("calibrated"), blocks).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["calibrated"] == pytest.approx(want[r["p"]], abs=1e-12)
    values = [r["value"] for r in blocks.orderBy("high").collect()]
    assert values == sorted(values) and len(values) == len(set(want.values())) and sum(r["n"] for r in blocks.collect()) == len(rows)
    beyond = spark.createDataFrame([(0, None)], "y int, p double")
    assert C.calibrated(beyond, blocks).first()["calibrated"] is None


def test_isotonic_of_few_rows(spark):
    for rows, want in (([], []), ([(1, 0.3)], [(None, 0.3, 1.0, 1)]), ([(1, 0.3), (0, 0.3), (0, 0.9)], [(None, 0.9, 1 / 3, 3)])):
        found = C.isotonic(spark.createDataFrame(rows, "y int, p double"))
        assert [tuple(r) for r in found.collect()] == want


def test_scores(spark):
    rng = random.Random(8)
    rows = [(int(rng.random() < p), round(p, 3)) for p in (rng.random() for _ in range(800))]
    found = C.calibration_scores(spark.createDataFrame(rows, "y int, p double")).first()
    assert found["brier"] == pytest.approx(sum((p - y) ** 2 for y, p in rows) / len(rows), abs=1e-6)
    precision, seen, hits, area = 0.0, 0, 0, 0.0
    for p in sorted({p for _, p in rows}, reverse=True):
        here = [y for y, q in rows if q == p]
        seen, hits = seen + len(here), hits + sum(here)
        area += sum(here) * hits / seen
    precision = area / hits
    assert found["pr_auc"] == pytest.approx(precision, abs=1e-6) and 0 <= found["calibration_error"] < 0.1
