"""Models on hand-made samples that a straight line can't tell apart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomgrid import queries as registry
from loomgrid.operators import metrics, ml
from loomgrid.operators.features import FEATURES
from loomgrid.sources import files

SMALL = ml.Settings(iterations=5, trees=3, tree_depth=3, min_leaf=1, boosts=2, boost_depth=3)


@pytest.fixture(scope="module")
def samples(spark):
    """The label is 1 where the first feature lies outside the middle half of its range."""
    rng, rows = random.Random(7), []
    for i in range(500):
        a = rng.random()
        split = "train" if i < 300 else "validation" if i < 400 else "test"
        rows.append((str(i % 3), dt.datetime(2012, 3, 1) + dt.timedelta(minutes=i), i, split, int(abs(a - 0.5) > 0.25), a, *(rng.random() for _ in FEATURES[1:])))
    names = ", ".join(f"{c} double" for c in FEATURES)
    return spark.createDataFrame(rows, f"sensor_id string, ts timestamp_ntz, t bigint, split string, target int, {names}").cache()


def test_explains_the_winner_of_validation(spark, samples, monkeypatch):
    monkeypatch.setattr(registry, "model_part", lambda name: lambda spark, sf_dir: samples)
    monkeypatch.setattr(ml, "Settings", lambda: SMALL)
    found = registry.queries()["local_explanation"](spark, "").collect()
    models = ml.fit_models(samples, SMALL)
    f1 = {name: row.first()["f1"] for name, (_, row) in ml.validated(models, samples).items()}
    best = max(f1, key=f1.get)
    assert len(f1) == 3 and f1[best] > f1["logistic_regression"] + 0.1
    highest = ml.scored(models[best], samples.where("split = 'test'")).agg(F.max("p")).first()[0]
    assert found[0]["p_base"] == pytest.approx(highest, abs=1e-6) and found[0]["feature"] == FEATURES[0] and {r["model"] for r in found} == {best}


def test_equal_models_go_by_their_order(spark):
    rows = spark.createDataFrame([(m, 1.0, 1.0, 1.0) for m in sorted(ml.MODELS)], "model string, f1 double, recall double, auc double")
    assert metrics.best_model(rows, ml.MODELS).first()["model"] == ml.MODELS[0]
    worse = rows.withColumn("auc", F.when(F.col("model") == ml.MODELS[0], 0.5).otherwise(0.9))
    assert metrics.best_model(worse, ml.MODELS).first()["model"] == ml.MODELS[1]


def test_comparison_has_the_settings_of_the_reference(spark, samples, monkeypatch):
    given = []
    monkeypatch.setattr(registry, "model_part", lambda name: lambda spark, sf_dir: samples)
    monkeypatch.setattr(ml, "compare_models", lambda found, settings: given.append(settings))
    registry.queries()["model_comparison"](spark, "")
    assert [(s.trees, s.tree_depth, s.boosts, s.boost_depth, s.boost_rate) for s in given] == [(120, 16, 200, 8, 0.08)]


def test_models_learn_from_all_training_rows(spark):
    """More rows than the million that fits used to be cut to."""
    rows = spark.range(1_000_200).select(F.lit("s").alias("sensor_id"), F.col("id").alias("t"), F.lit("train").alias("split"), (F.col("id") % 4).cast("int").alias("target")).withColumn("target", F.least("target", F.lit(1)))
    found = ml.dealt_rows(rows).groupBy("label").agg(F.count("*").alias("n"), F.first("weight").alias("w")).orderBy("label").collect()
    assert [r["n"] for r in found] == [250_050, 750_150]
    assert [r["w"] for r in found] == pytest.approx([2, 2 / 3])


def test_training_rows_are_dealt_in_whole_rounds_of_tasks(spark, samples, monkeypatch):
    monkeypatch.setattr(ml, "TASK_ROWS", 30)  # 300 rows, 4 cores
    assert ml.dealt_rows(samples).rdd.getNumPartitions() == 12 and ml.dealt_rows(samples).count() == 300


def test_importances_thresholds_and_storage(spark, samples, tmp_path):
    models = ml.fit_models(samples, SMALL)
    found = ml.all_importances(samples, SMALL).collect()
    for name in ml.MODELS:
        own = {r["feature"]: r["importance"] for r in found if r["model"] == name}
        assert set(own) == {*FEATURES, "sensor_id"}
        if name != "logistic_regression":
            assert max(own, key=own.get) == FEATURES[0] and sum(own.values()) == pytest.approx(1, abs=1e-4)
    rows = ml.compare_models(samples, SMALL).collect()
    assert sorted((r["model"], r["split"]) for r in rows) == sorted((m, s) for m in ml.MODELS for s in ("validation", "test"))
    assert all(r["tp"] + r["fp"] + r["fn"] + r["tn"] == 100 and r["accuracy"] == pytest.approx((r["tp"] + r["tn"]) / 100) for r in rows)
    reference = ml.reference_values(samples.where("split = 'train'"))
    values = sorted(r[0] for r in samples.where("split = 'train'").select(FEATURES[1]).collect())
    assert reference[FEATURES[1]] == pytest.approx((values[149] + values[150]) / 2) and reference["sensor_id"] == "0"
    model, path = models["random_forest"], str(tmp_path / "model")
    digest = files.save_model(model, path)
    again = files.load_model(spark, path, digest)
    score = lambda m: [r["p"] for r in ml.scored(m, samples).orderBy("t").collect()]
    assert score(again) == score(model)
    with pytest.raises(ValueError, match="digest"):
        files.load_model(spark, path, "0" * 64)


def test_splits_and_json(spark, samples, tmp_path):
    path = str(tmp_path / "splits")
    assert {r["split"]: r["n_rows"] for r in files.write_splits(samples, path).collect()} == {"train": 300, "validation": 100, "test": 100}
    assert spark.read.parquet(path).where("split = 'test'").count() == 100
    where = str(tmp_path / "report")
    files.write_json(spark, where, {"schema_version": "1.0", "n": samples.agg(F.count("*").alias("k")).first(), "bad": [float("nan"), float("inf")], "when": dt.date(2012, 3, 1)})
    assert files.read_artifact(spark, where, {"n"}).data == {"schema_version": "1.0", "n": {"k": 500}, "bad": [None, None], "when": "2012-03-01"}
    assert files.read_config(spark, where, {"n", "when"})["n"] == {"k": 500}
    with pytest.raises(ValueError, match="other, seed"):
        files.read_config(spark, where, {"n", "seed", "other"})
