"""Risk models on the model table, their comparison, importances and local explanations.

The logistic regression is Spark's; the forest, ``gradient_boosting`` (of first order, by Spark's rule) and ``second_order_boosting`` are those of
``operators/trees.py``. Fitted models are stored in the shared folder and loaded by whatever asks for the same rows and settings in the same application.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.columns import direction, risk_band, source_feature
from loomgrid.functions.lineage import shared_folder, side_by_side, tasks_for
from loomgrid.operators.features import FEATURES
from loomgrid.operators.metrics import best_model, best_threshold, confusion_metrics, importance_rollup, roc_auc, threshold_sweep
from loomgrid.operators.trees import BalancedForest, Boosting, GradientBoosting
from loomgrid.sources.files import load_model, save_model

MODELS = ("logistic_regression", "random_forest", "gradient_boosting")
#: Beside these: boosting with second-order gains, and Spark's own trees, whose work is rows times sensors.
MORE_MODELS = ("second_order_boosting", "spark_random_forest", "spark_gradient_boosting")

#: Training rows of a task at most.
TASK_ROWS = 250_000


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    iterations: int = 100
    trees: int = 120
    tree_depth: int = 16
    min_leaf: int = 5
    boosts: int = 200
    boost_depth: int = 8
    boost_rate: float = 0.08
    subsample: float = 0.8
    colsample: float = 0.8
    min_child_weight: float = 5.0
    l2: float = 1.0


def indexer() -> StringIndexer:
    """The number of a sensor of the training rows; the one beyond all for others."""
    return StringIndexer(inputCol="sensor_id", outputCol="sensor_index", handleInvalid="keep", stringOrderType="alphabetAsc")


def preparation() -> list:
    """Scaled numbers (not centred), and one column for each sensor of the training rows; an unseen sensor has none set."""
    return [
        indexer(),
        OneHotEncoder(inputCol="sensor_index", outputCol="sensor_vector", dropLast=True),
        VectorAssembler(inputCols=FEATURES, outputCol="numbers", handleInvalid="error"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=False, withStd=True),
        VectorAssembler(inputCols=["scaled", "sensor_vector"], outputCol="features"),
    ]


def stages(name: str, settings: Settings, n_rows: int) -> list:
    """The stages of a model's pipeline. Trees take numbers as they are, and the sensor as a category."""
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    if name == "random_forest":
        return [indexer(), BalancedForest(FEATURES, "sensor_index", trees=settings.trees, depth=settings.tree_depth, min_leaf=settings.min_leaf, seed=settings.seed)]
    if name == "gradient_boosting":
        return [indexer(), GradientBoosting(FEATURES, "sensor_index", rounds=settings.boosts, depth=settings.boost_depth, rate=settings.boost_rate, subsample=settings.subsample, colsample=settings.subsample, min_leaf=settings.min_leaf, seed=settings.seed)]
    if name == "second_order_boosting":
        boosting = Boosting(FEATURES, "sensor_index", rounds=settings.boosts, depth=settings.boost_depth, rate=settings.boost_rate, subsample=settings.subsample, colsample=settings.colsample, min_child_weight=settings.min_child_weight, l2=settings.l2, seed=settings.seed)
        return [indexer(), boosting]
    known = {
        # an L2 penalty of C = 1 on summed losses is 1 / n on mean losses, as balanced weights sum to n
        "logistic_regression": lambda: LogisticRegression(**common, maxIter=settings.iterations, regParam=1.0 / max(1, n_rows), elasticNetParam=0.0, standardization=False),
        "spark_random_forest": lambda: RandomForestClassifier(**common, numTrees=settings.trees, maxDepth=settings.tree_depth, minInstancesPerNode=settings.min_leaf, featureSubsetStrategy="sqrt", seed=settings.seed),
        "spark_gradient_boosting": lambda: GBTClassifier(**common, maxIter=settings.boosts, maxDepth=settings.boost_depth, stepSize=settings.boost_rate, subsamplingRate=settings.subsample, featureSubsetStrategy=str(settings.subsample), minInstancesPerNode=settings.min_leaf, seed=settings.seed),
    }
    return [*preparation(), known[name]()]


def training_rows(found: DataFrame) -> DataFrame:
    """All training rows with balanced class weights."""
    rows = found.where("split = 'train'")
    counts = rows.groupBy(F.col("target").alias("kind")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    weights = counts.crossJoin(total).select("kind", (F.col("total") / (F.col("kinds") * F.col("n"))).alias("weight"))  # a row for each class
    return rows.join(F.broadcast(weights), rows["target"] == weights["kind"]).drop("kind").withColumn("label", F.col("target").cast("double"))


def dealt_rows(found: DataFrame) -> DataFrame:
    """``training_rows`` over all cores, as fits run thousands of jobs over them and small tables arrive in one partition; by key and in order, so that draws
    by partition are the same in each run."""
    n, cores = found.where("split = 'train'").count(), found.sparkSession.sparkContext.defaultParallelism
    tasks = tasks_for(found.sparkSession, n) if n <= cores * TASK_ROWS else -(-n // (cores * TASK_ROWS)) * cores  # else the last round of tasks leaves cores idle
    return training_rows(found).repartition(tasks, "sensor_id", "t").sortWithinPartitions("sensor_id", "t")


#: Of the rows and settings that models were fitted with: the rows (held, so that their identity isn't given to others), and path and digest of each model.
_STORED: dict[tuple, tuple[DataFrame, dict[str, tuple[str, str]]]] = {}


def fit_models(found: DataFrame, settings: Settings, names: tuple[str, ...] = MODELS) -> dict[str, PipelineModel]:
    """The pipeline of each model, all fitted on the same training rows; a model that this application has fitted with them before is loaded."""
    spark = found.sparkSession
    _, stored = _STORED.setdefault((spark.sparkContext.applicationId, id(found), settings), (found, {}))
    missing = [name for name in names if name not in stored]
    if missing:
        train, folder = dealt_rows(found).cache(), f"{shared_folder(spark)}/models-{uuid.uuid4()}"
        try:
            n_rows = train.count()

            def fitted(name: str) -> tuple[str, str]:
                path = f"{folder}/{name}"
                return path, save_model(Pipeline(stages=stages(name, settings, n_rows)).fit(train), path)

            stored.update(zip(missing, side_by_side(spark, [partial(fitted, name) for name in missing]), strict=True))
        finally:
            train.unpersist()
    return {name: load_model(spark, *stored[name]) for name in names}


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("sensor_id", "ts", "t", "split", F.col("target").alias("y"), vector_to_array("probability")[1].alias("p"))


def judged(name: str, split: str, rows: DataFrame, threshold: float) -> DataFrame:
    """Metrics of a model's scored rows at its threshold, as one row."""
    return confusion_metrics(rows, threshold).crossJoin(roc_auc(rows)).select(F.lit(name).alias("model"), F.lit(split).alias("split"), F.lit(threshold).alias("threshold"), "accuracy", "precision", "recall", "f1", "auc", "tp", "fp", "fn", "tn")  # one row each


def validated(models: dict[str, PipelineModel], found: DataFrame) -> dict[str, tuple[float, DataFrame]]:
    """For each model its threshold chosen on validation rows, and its metrics there."""
    out = {}
    for name, model in models.items():
        rows = scored(model, found.where("split = 'validation'")).cache()
        threshold = best_threshold(threshold_sweep(rows)).first()["threshold"]
        row = judged(name, "validation", rows, threshold)
        out[name] = threshold, rows.sparkSession.createDataFrame(row.collect(), row.schema)  # one row
        rows.unpersist()
    return out


def compare_models(found: DataFrame, settings: Settings, names: tuple[str, ...] = MODELS) -> DataFrame:
    """For each model its threshold chosen on validation rows, and metrics on validation and test rows."""
    models, out = fit_models(found, settings, names), None
    for name, (threshold, row) in validated(models, found).items():
        row = row.unionByName(judged(name, "test", scored(models[name], found.where("split = 'test'")), threshold))
        out = row if out is None else out.unionByName(row)
    return out


def select_model(found: DataFrame, settings: Settings, names: tuple[str, ...] = MODELS) -> tuple[str, PipelineModel]:
    """Name and pipeline of the model that is best on validation rows, the first of ``names`` among equals."""
    models = fit_models(found, settings, names)
    results = reduce(DataFrame.unionByName, (row for _, row in validated(models, found).values()))
    name = best_model(results, names).first()["model"]
    return name, models[name]


def all_importances(found: DataFrame, settings: Settings, names: tuple[str, ...] = MODELS) -> DataFrame:
    """Importances by source feature of every fitted model."""
    models = fit_models(found, settings, names)
    return reduce(DataFrame.unionByName, (importances(models[n]).select(F.lit(n).alias("model"), "feature", "importance") for n in names))


def importances(model: PipelineModel, sensors: list[str] | None = None) -> DataFrame:
    """Absolute coefficients or impurity importances, summed by source feature."""
    from pyspark.sql import SparkSession

    last = model.stages[-1]
    values = [abs(float(v)) for v in (last.coefficients.toArray() if hasattr(last, "coefficients") else last.featureImportances.toArray())]
    labels = model.stages[0].labels
    names = [*FEATURES, *(f"sensor_id_{s}" for s in labels)]
    rows = SparkSession.getActiveSession().createDataFrame(list(zip(names, values, strict=False)), "name string, importance double")
    return importance_rollup(rows, source_feature(F.col("name"), "sensor_id"))


def reference_values(train: DataFrame) -> dict[str, object]:
    """Median of each number and the most frequent sensor (the least of equals)."""
    row = train.agg(*(F.median(c).alias(c) for c in FEATURES), F.mode("sensor_id", True).alias("sensor_id")).first()
    return row.asDict()


def first_sensor(train: DataFrame) -> DataFrame:
    """The training rows of the first sensor alone, which a replay's explanations refer to."""
    return train.join(F.broadcast(train.agg(F.min("sensor_id").alias("sensor_id"))), "sensor_id")  # one row


def reference_table(train: DataFrame) -> DataFrame:
    """feature and value of ``reference_values`` as rows, numbers as they are and the sensor as text beside them."""
    found = reference_values(train)
    rows = [(c, float(found[c]) if found[c] is not None else None, None) for c in FEATURES] + [("sensor_id", None, found["sensor_id"])]
    return train.sparkSession.createDataFrame(rows, "feature string, value double, name string")


def factor_table(rows: DataFrame, value: str = "value", delta: str = "delta") -> DataFrame:
    """``rows`` with the texts that are shown for a factor: its value to three places, its signed effect to four, and the effect's direction."""
    return rows.withColumn("value_text", F.format_string("%.3f", value)).withColumn("delta_text", F.format_string("%+.4f", delta)).withColumn("direction", direction(F.col(delta)))


def explain(model: PipelineModel, row: DataFrame, reference: dict[str, object], top: int = 10) -> DataFrame:
    """How the probability of one row changes when each feature in turn takes its reference value; largest changes first.

    All variants go through the model at once, as rows.
    """
    names = ["sensor_id", *FEATURES]
    variants = row.limit(1).withColumn("changed", F.explode(F.array(F.lit(""), *(F.lit(n) for n in names))))
    for n in names:
        kind = dict(row.dtypes)[n]
        variants = variants.withColumn(n, F.when(F.col("changed") == n, F.lit(reference[n]).cast(kind)).otherwise(F.col(n)))
    p = model.transform(variants).select("changed", vector_to_array("probability")[1].alias("p"))
    base = p.where("changed = ''").select(F.col("p").alias("p_base"))
    return p.where("changed != ''").crossJoin(base).select(F.col("changed").alias("feature"), F.round("p_base", 6).alias("p_base"), F.round(F.col("p_base") - F.col("p"), 6).alias("delta")).orderBy(F.desc(F.abs("delta")), "feature").limit(top)  # base: one row


def score_rows(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Probability and risk band of replay rows (features of a sensor at a time) by a fitted or loaded model."""
    p = model.transform(rows).select("sensor_id", "ts", F.round(vector_to_array("probability")[1], 6).alias("p"))
    return p.withColumn("risk", risk_band(F.col("p")))


def riskiest(rows: DataFrame) -> DataFrame:
    """The row with the highest probability, the first by sensor and time among equals."""
    return rows.orderBy(F.desc("p"), "sensor_id", "ts").limit(1)
