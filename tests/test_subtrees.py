"""Trees whose large nodes grow over Spark and whose small ones grow in a task."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from loomgrid.operators import ml
from loomgrid.operators import subtrees as S
from loomgrid.operators import trees as T

SCHEMA = "a double, b double, s int, label double"


def table(seed, n):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        a, b, s = float(rng.randint(0, 20)), float(rng.randint(0, 6)), rng.randint(0, 4)
        rows.append((a, b, s, float(rng.random() < 1 / (1 + math.exp(-(0.3 * (a - 10) - 0.5 * (b - 3) + (2 if s == 3 else 0)))))))
    return rows


def test_trees_are_the_same_whichever_nodes_are_large(spark, monkeypatch):
    frame, made = spark.createDataFrame(table(1, 400), SCHEMA), []
    for local, parts in ((0, 3), (60, 4), (10**6, 1)):
        monkeypatch.setattr(S, "LOCAL_ROWS", local)
        forest = T.fit_forest(frame.repartition(parts), ["a", "b"], "s", 5, "label", trees=3, depth=5, min_leaf=2)
        boosted = T.fit_gradient_boosting(frame.repartition(parts), ["a", "b"], "s", 5, "label", rounds=12, depth=4, rate=0.3, min_leaf=2)
        made.append((forest, boosted))
    for forest, boosted in made[1:]:
        assert forest.trees == made[0][0].trees and boosted.trees == made[0][1].trees
        assert forest.gains == pytest.approx(made[0][0].gains) and boosted.gains == pytest.approx(made[0][1].gains)
    assert max(len(t.column) for t in made[0][0].trees) > 15 and len(made[0][1].trees) == 12


def test_forest_equals_one_grown_by_level_sums(spark, monkeypatch):
    """With all columns tried, the trees are those of the other way, a level at a time in SQL."""
    monkeypatch.setattr(T.math, "sqrt", lambda x: x)
    monkeypatch.setattr(S, "LOCAL_ROWS", 80)
    frame = spark.createDataFrame(table(2, 500), SCHEMA)
    edges = T.edges_of(frame, ["a", "b"])
    rows = T.binned(frame, ["a", "b"], "s", "label", edges).cache()
    weights = T.bootstrap_classes(rows, [0, 1], 42, 2)

    def statistics(t, key, y, margin):
        count = T.bootstrap_counts(key, t, 42)
        w = np.rint(count * np.where(y == 1, weights[t][1], weights[t][0]) * T.UNIT)
        return count, w * (y == 1), w

    score = lambda a, b: f"coalesce(try_divide(({a}) * ({a}) + ({b} - ({a})) * ({b} - ({a})), {b}), 0D)"
    wanted = T.grow(rows, 2, 5, edges, [0, 1], 6, lambda t, n: np.ones(7, bool), statistics, score, lambda a, b: a / b if b else 0.0, 0.0, 3, np.zeros(7), lambda a, b: a <= 0 or a >= b)
    found = T.fit_forest(frame, ["a", "b"], "s", 5, "label", trees=2, depth=6, min_leaf=3)
    assert found.trees == [wanted[0], wanted[1]] and len(wanted[0].column) > 15


def test_gradient_boosting_equals_sparks(spark, monkeypatch):
    """On columns of few values, without draws, all probabilities and importances are those of Spark's classifier on one-hot columns."""
    monkeypatch.setattr(S, "LOCAL_ROWS", 150)
    rows = table(3, 600)
    frame = spark.createDataFrame(rows, SCHEMA)
    positives = sum(r[3] for r in rows)
    wide = spark.createDataFrame([(i, Vectors.dense([r[0], r[1], *(float(r[2] == v) for v in range(5))]), r[3], len(rows) / (2 * (positives if r[3] else len(rows) - positives))) for i, r in enumerate(rows)], ["i", "features", "label", "weight"])
    spark_model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=6, maxDepth=4, stepSize=0.2, subsamplingRate=1.0, featureSubsetStrategy="all", minInstancesPerNode=5, seed=1).fit(wide)
    wanted = [r["p"] for r in spark_model.transform(wide).orderBy("i").select(vector_to_array("probability")[1].alias("p")).collect()]
    found = T.fit_gradient_boosting(frame, ["a", "b"], "s", 5, "label", rounds=6, depth=4, rate=0.2, subsample=1.0, colsample=1.0, min_leaf=5)
    assert found.probability(np.array([r[:2] for r in rows]), np.array([r[2] for r in rows])).tolist() == pytest.approx(wanted, abs=1e-5)
    assert (np.array(found.gains) / sum(found.gains)).tolist() == pytest.approx(spark_model.featureImportances.toArray().tolist(), abs=1e-4)


def test_a_small_table_takes_as_many_jobs_however_deep_its_trees(spark):
    frame, jobs = spark.createDataFrame(table(4, 300), SCHEMA), []
    for depth in (2, 9):
        spark.sparkContext.setJobGroup(f"forest of depth {depth}", "")
        T.fit_forest(frame, ["a", "b"], "s", 5, "label", trees=2, depth=depth, min_leaf=1)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest of depth {depth}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_sensors_are_one_column_of_the_rows_that_trees_learn_from(spark):
    """Nothing is kept for each row and sensor: a table of 5,000 sensors is learned from like one of few."""
    assert [type(s).__name__ for s in ml.stages("gradient_boosting", ml.Settings(), 10)] == ["StringIndexer", "GradientBoosting"]
    rows = spark.range(10_000).select((F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 5000).cast("int").alias("s"), (F.col("id") % 50 > 20).cast("double").alias("label"))
    found = T.fit_gradient_boosting(rows, ["a", "b"], "s", 5000, "label", rounds=2, depth=3, rate=0.3, subsample=1.0, colsample=1.0)
    assert found.trees[0].column[0] == 0 and found.trees[0].cut[0] == pytest.approx(21, abs=2) and len(found.gains) == 5002


def test_gradient_boosting_of_one_class_and_no_rows(spark):
    for rows in ([], [(1.0, 2.0, 0, 1.0)] * 20):
        assert all(len(t.column) == 1 for t in T.fit_gradient_boosting(spark.createDataFrame(rows, SCHEMA), ["a", "b"], "s", 1, "label", rounds=2, depth=2, rate=0.1).trees)
