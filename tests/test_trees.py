"""Boosting, the balanced forest and Shapley values against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.operators import trees as T

SCHEMA = "a double, b double, s int, label double"


def table(seed=1, n=300):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b, s = round(rng.gauss(0, 1), 2), float(rng.randint(0, 6)), rng.randint(0, 4)
        rows.append((a, b, s, float(rng.random() < 1 / (1 + math.exp(-(2 * a - 0.5 * b + (2 if s == 3 else 0)))))))
    return rows


def slow_tree(rows, g, h, depth, least, l2, rate, every=None):
    """The best tree by trying every cut of every column: nested tuples, or a leaf's value."""
    every = every or rows
    total_g, total_h = sum(g), sum(h)
    leaf = -rate * total_g / (total_h + l2)
    score = lambda x, y: x * x / (y + l2)
    best = None
    if depth:
        tests = [(c, e) for c in (0, 1) for e in sorted({r[c] for r in every})[1:]] + [(2, v) for v in range(5)]
        for c, e in tests:
            side = [(r[c] == e) if c == 2 else r[c] < e for r in rows]
            gl, hl = sum(x for x, s in zip(g, side, strict=True) if s), sum(x for x, s in zip(h, side, strict=True) if s)
            if not any(side) or all(side) or min(hl, total_h - hl) < least:
                continue
            gain = score(gl, hl) + score(total_g - gl, total_h - hl) - score(total_g, total_h)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-6):
                best = gain, c, e, side
    if best is None:
        return leaf
    _, c, e, side = best
    parts = [[[x for x, s in zip(xs, side, strict=True) if s == want] for xs in (rows, g, h)] for want in (True, False)]
    return c, e, slow_tree(*parts[0], depth - 1, least, l2, rate, every), slow_tree(*parts[1], depth - 1, least, l2, rate, every)


def as_tuple(tree, node=0):
    if tree.column[node] < 0:
        return tree.value[node]
    return tree.column[node], tree.cut[node], as_tuple(tree, tree.left[node]), as_tuple(tree, tree.right[node])


def same(found, wanted):
    if isinstance(wanted, tuple):
        assert isinstance(found, tuple) and found[:2] == wanted[:2]
        same(found[2], wanted[2])
        same(found[3], wanted[3])
    else:
        assert found == pytest.approx(wanted, abs=1e-4)


@pytest.mark.parametrize("seed", [1, 2])
def test_boosted_trees_equal_a_search_of_all_cuts(spark, seed):
    rows = table(seed, 200)
    found = T.fit_boosting(spark.createDataFrame(rows, SCHEMA).repartition(3), ["a", "b"], "s", 5, "label", rounds=3, depth=3, rate=0.3, subsample=1.0, colsample=1.0, min_child_weight=2.0)
    weight = sum(r[3] == 0 for r in rows) / sum(r[3] == 1 for r in rows)
    margin = [0.0] * len(rows)
    for tree in found.trees:
        p = [1 / (1 + math.exp(-m)) for m in margin]
        w = [weight if r[3] == 1 else 1.0 for r in rows]
        g, h = [(q - r[3]) * x for q, r, x in zip(p, rows, w, strict=True)], [q * (1 - q) * x for q, x in zip(p, w, strict=True)]
        same(as_tuple(tree), slow_tree(rows, g, h, 3, 2.0, 1.0, 0.3))
        step = np.array(tree.value)[tree.leaves(np.array([r[:2] for r in rows]), np.array([r[2] for r in rows]))]
        margin = [m + s for m, s in zip(margin, step, strict=True)]
    assert max(found.gains) > 0 and len(found.gains) == 7


def test_boosting_is_the_same_however_rows_are_partitioned(spark):
    frame = spark.createDataFrame(table(3), SCHEMA)
    made = [T.fit_boosting(frame.repartition(k), ["a", "b"], "s", 5, "label", rounds=4, depth=4, rate=0.2).to_json() for k in (1, 5)]
    assert made[0] == made[1]


def test_margins_are_held_until_the_next_tree_has_read_them(spark, monkeypatch):
    """A table that is let go before its successor is computed is computed again, and with it all since the last checkpoint."""
    events, frame = [], spark.createDataFrame(table(3), SCHEMA)
    grow, kind = T.grow, type(frame)
    persist, unpersist = kind.persist, kind.unpersist
    monkeypatch.setattr(T, "grow", lambda *given: (grow(*given), events.append("grow"))[0])
    monkeypatch.setattr(kind, "persist", lambda df: (persist(df), events.append("persist"))[0])
    monkeypatch.setattr(kind, "unpersist", lambda df: (unpersist(df), events.append("unpersist"))[0])
    T.fit_boosting(frame, ["a", "b"], "s", 5, "label", rounds=4, depth=2, rate=0.3)
    assert events.count("grow") == 4 and events.count("persist") == 3  # none for the last tree, whose margins nobody reads
    assert all(events[i - 1] != "persist" for i, e in enumerate(events) if e == "unpersist")


def test_a_level_takes_one_shuffle_and_cells_for_each_category_once(spark, monkeypatch):
    categories, rows = 5000, [(i, bytes([i % 3, i % 7]), i, float(i % 2), 0.0) for i in range(200)]
    monkeypatch.setattr(T, "TALLY_CELLS", 1 + 2 * T.BINS + categories)  # as much as a node needs
    tree, may = T.Tree(), np.ones((1, 2 + categories), bool)
    tree.add(0.0, 0.0)
    statistics = lambda t, key, y, margin: (np.ones(len(key), np.int64), np.rint((0.5 - y) * T.UNIT), np.full(len(key), float(T.UNIT)))
    sums = T.level_sums(spark.createDataFrame(rows, T.ROWS).repartition(3), 2, {0: tree}, {0: [0]}, {0: may}, statistics)
    found = {(r["col"], r["bin"]): (r["a"], r["b"], r["n"]) for r in sums.collect()}
    of = lambda keep: (lambda own: (sum(round((0.5 - r[3]) * T.UNIT) for r in own), len(own) * T.UNIT, len(own)))([r for r in rows if keep(r)])
    want = {(-1, 0): of(lambda r: True)} | {(c, v): of(lambda r, c=c, v=v: r[1][c] == v) for c, k in ((0, 3), (1, 7)) for v in range(k)} | {(2, v): of(lambda r, v=v: r[2] == v) for v in range(200)}
    assert found == want
    plan = T.best_cuts(sums, 2, lambda a, b: f"({a}) * ({a}) / ({b})", 0.0, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(tree") == 1


def test_an_exact_sample_orders_few_rows(spark):
    from loomgrid.operators.metrics import exact_sample

    rows = spark.range(20000).selectExpr("cast(id as string) AS k")
    found = exact_sample(rows, 5000, F.col("k"), 7)
    wanted = sorted((hashlib.md5(f"{i}|7".encode()).hexdigest(), str(i)) for i in range(20000))[:5000]
    assert sorted(r["k"] for r in found.collect()) == sorted(k for _, k in wanted)
    assert "limit=5000" not in found._jdf.queryExecution().executedPlan().toString()  # one task would order as many
    assert exact_sample(rows, 20000, F.col("k")).count() == 20000 and "TakeOrdered" not in exact_sample(rows, 20000, F.col("k"))._jdf.queryExecution().executedPlan().toString()


def test_forest_is_the_same_however_trees_share_jobs_and_memory(spark, monkeypatch):
    frame = spark.createDataFrame(table(6, 120), SCHEMA).repartition(2)
    made = []
    for together, cells in ((3, T.TALLY_CELLS), (2, T.TALLY_CELLS), (3, 2 * 4 * T.BINS), (3, 0)):
        monkeypatch.setattr(T, "TALLY_CELLS", cells)
        made.append(T.fit_forest(frame, ["a", "b"], "s", 5, "label", trees=3, depth=3, together=together))
    for other in made[1:]:
        assert other.trees == made[0].trees
        assert other.gains == pytest.approx(made[0].gains)


def test_bootstraps_balance_their_own_classes(spark):
    rows = table(4)
    frame = spark.createDataFrame(rows, SCHEMA)
    edges = T.edges_of(frame, ["a", "b"])
    kept = T.binned(frame, ["a", "b"], "s", "label", edges).collect()
    key, y = np.array([r["key"] for r in kept]), np.array([r["y"] for r in kept])
    weights = T.bootstrap_classes(T.binned(frame, ["a", "b"], "s", "label", edges), [0, 1, 2], 42, 2)
    for t, w in weights.items():
        counts = T.bootstrap_counts(key, t, 42)
        for c in (0, 1):
            assert w[c] == pytest.approx(counts.sum() / (2 * counts[y == c].sum()))
    assert len({round(w[1], 9) for w in weights.values()}) == 3
    many = T.bootstrap_counts(np.arange(100_000), 7, 42)
    assert many.mean() == pytest.approx(1, abs=0.02) and (many == 0).mean() == pytest.approx(math.exp(-1), abs=0.01)


def test_a_tree_of_the_forest_equals_a_search_of_all_cuts(spark, monkeypatch):
    """With all columns tried at each node, a tree's cuts have the least weighted Gini impurity of its balanced bootstrap."""
    monkeypatch.setattr(T.math, "sqrt", lambda x: x)
    rows = table(5, 120)
    frame = spark.createDataFrame(rows, SCHEMA)
    found = T.fit_forest(frame, ["a", "b"], "s", 5, "label", trees=2, depth=2, min_leaf=5)
    keys = {tuple(r[1:]): r[0] for r in frame.select(F.xxhash64("a", "b", "s", "label"), "*").collect()}
    for t, tree in enumerate(found.trees):
        count = T.bootstrap_counts(np.array([keys[r] for r in rows]), t, 42)
        by_class = {c: sum(int(n) for n, r in zip(count, rows, strict=True) if r[3] == c) for c in (0, 1)}
        weight = {c: sum(by_class.values()) / (2 * n) for c, n in by_class.items()}

        def impurity(part, count=count, weight=weight):
            w = {c: sum(count[i] * weight[c] for i in part if rows[i][3] == c) for c in (0, 1)}
            total = sum(w.values())
            return total - (w[0] ** 2 + w[1] ** 2) / total if total else 0.0

        def best(part, count=count):
            tests = [(c, e) for c in (0, 1) for e in sorted({r[c] for r in rows})[1:]] + [(2, v) for v in range(5)]
            sides = [([i for i in part if (rows[i][2] == e if c == 2 else rows[i][c] < e)], c, e) for c, e in tests]
            fine = [(impurity(s) + impurity([i for i in part if i not in set(s)])) for s, _, _ in sides if 5 <= sum(count[i] for i in s) <= sum(count[i] for i in part) - 5]
            return min(fine, default=None)

        def check(node, part, tree=tree, count=count):
            if tree.column[node] < 0:
                return
            c, e = tree.column[node], tree.cut[node]
            left = [i for i in part if (rows[i][2] == e if c == 2 else rows[i][c] < e)]
            right = [i for i in part if i not in set(left)]
            assert impurity(left) + impurity(right) == pytest.approx(best(part), abs=1e-4)
            check(tree.left[node], left)
            check(tree.right[node], right)

        check(0, list(range(len(rows))))
        assert tree.value[0] == pytest.approx(0.5, abs=1e-6)  # balanced


def test_models_are_stages_that_are_saved_and_loaded(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import StringIndexer

    train = spark.createDataFrame(table(6, 400), SCHEMA).withColumn("sensor", F.concat(F.lit("s"), "s"))
    rows = spark.createDataFrame(table(7, 100), SCHEMA).withColumn("sensor", F.when(F.col("a") > 1, "unseen").otherwise(F.concat(F.lit("s"), "s")))
    for stage in (T.Boosting(["a", "b"], "sensor_index", rounds=12, depth=3, rate=0.3), T.BalancedForest(["a", "b"], "sensor_index", trees=8, depth=5)):
        model = Pipeline(stages=[StringIndexer(inputCol="sensor", outputCol="sensor_index", handleInvalid="keep"), stage]).fit(train)
        found = [tuple(r) for r in model.transform(rows).select("label", "prediction", "probability").collect()]
        assert sum(a == b for a, b, _ in found) / len(found) > 0.7 and all(sum(p) == pytest.approx(1) for _, _, p in found)
        path = str(tmp_path / type(stage).__name__)
        model.save(path)
        assert [tuple(r) for r in PipelineModel.load(path).transform(rows).select("label", "prediction", "probability").collect()] == found
        assert sum(model.stages[-1].featureImportances) == pytest.approx(1)


def test_one_class_and_no_rows(spark):
    for rows in ([], [(1.0, 2.0, 0, 1.0)] * 20):
        frame = spark.createDataFrame(rows, SCHEMA)
        assert len(T.fit_boosting(frame, ["a", "b"], "s", 1, "label", rounds=2, depth=2, rate=0.1).trees) <= 2
        assert all(len(t.column) == 1 for t in T.fit_forest(frame, ["a", "b"], "s", 1, "label", trees=2, depth=2).trees)


def test_fits_run_side_by_side(spark):
    """Jobs of several threads overlap, come back in their order, and see the caller's folder for checkpoints; a failure is passed on."""
    import threading

    from loomgrid.functions.lineage import _OWN, side_by_side

    meet, token = threading.Barrier(3, timeout=60), _OWN.set("/tmp/own")

    def job(i):
        meet.wait()  # passes only if all three run at the same time
        return spark.range(10 + i).count(), _OWN.get()

    try:
        assert side_by_side(spark, [lambda i=i: job(i) for i in range(3)]) == [(10, "/tmp/own"), (11, "/tmp/own"), (12, "/tmp/own")]
    finally:
        _OWN.reset(token)
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, [lambda: 1 // 0, lambda: 2])
