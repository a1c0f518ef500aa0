"""Registered queries of the time-series operators, and the same results in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import columns as C
from loomgrid.functions.lineage import checkpoint, shared_folder
from loomgrid.operators import features as X
from loomgrid.operators import calibration, graph, metrics, ml, permutation, replay
from loomgrid.operators import matching as M
from loomgrid.operators import patterns as P
from loomgrid.operators import quality as Q
from loomgrid.operators import split as S
from loomgrid.operators.neighbours import neighbour_features
from loomgrid.operators.shapley import summary
from loomgrid.operators.trees import Ensemble
from loomgrid.operators.windows import run_table
from loomgrid.plans.analysis import Plan, model_data
from loomgrid.sources.files import footer_counts
from loomgrid.sources.grid import check_grid, event_grid
from loomgrid.sources.publish import publish, published
from loomgrid.sql import ORACLES

PLAN = Plan()
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_grid(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(event_grid(spark, sf_dir))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if c in names or (not names and t == "double") else F.col(c) for c, t in df.dtypes))


def with_flow(grid: DataFrame) -> DataFrame:
    return P.with_ratio(grid, P.free_flow(grid))


def windowed(columns: Callable[[], dict]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = columns()
        return rounded(X.windowed(with_flow(event_grid(spark, sf_dir)), made).select("sensor_id", "ts", *made))

    return run


def parts_of(grid: DataFrame) -> tuple[int, list[S.Segment]]:
    first, n = S.time_axis(grid)
    return first, S.segments(n, PLAN.train, PLAN.validation, PLAN.test)


def supplier_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places made of suppliers' columns."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").cast("string").alias("sensor_id"), F.round(34 + F.col("s_acctbal") / 100000, 6).alias("latitude"), F.round(-118 - F.col("s_nationkey") / 100, 6).alias("longitude"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of consecutive lines of an order are neighbours; the cost is the smallest difference of their prices."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_extendedprice")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.lead("l_suppkey").over(w).alias("b"), F.abs(F.col("l_extendedprice") - F.lead("l_extendedprice").over(w)).alias("cost")).where("b is not null")
    return steps.groupBy(F.col("a").cast("string").alias("from_id"), F.col("b").cast("string").alias("to_id")).agg(F.round(F.min("cost"), 2).alias("cost"))


def pruned_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sensor_edges(supply_edges(spark, sf_dir), graph.locations(supplier_places(spark, sf_dir)))


def corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("sensor_id")).agg((100.0 * F.count_if(F.col("l_quantity") < 25) / F.count("*")).alias("percent"))
    return graph.corridor_bands(pruned_edges(spark, sf_dir), share, graph.locations(supplier_places(spark, sf_dir)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the label of their future, and as probability how far their speed lies below free flow."""
    rows = X.labels(with_flow(event_grid(spark, sf_dir))).where("future_complete and ratio is not null")
    return rows.select("sensor_id", "ts", F.col("label_60").alias("y"), F.round(1 - F.least(F.col("ratio"), F.lit(1.0)), 6).alias("p"))


def model_part(name: str) -> Query:
    return lambda spark, sf_dir: model_data(event_grid(spark, sf_dir), PLAN)[name]


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = model_part("samples")(spark, sf_dir)
    return rounded(found.select("sensor_id", "ts", "split", *X.FEATURES, F.col("target").cast("bigint").alias("target")))


def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_flow(event_grid(spark, sf_dir)).where("v is not null").withColumn("hit", C.congested(F.col("ratio"), 0.6).cast("int"))
    return replay.heatmap_cells(rows, "hit")


def train_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = event_grid(spark, sf_dir)
    first, parts = parts_of(grid)
    return rounded(S.train_stats(grid, parts[0], first))


def period_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model_part("period_stats")(spark, sf_dir))


def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = event_grid(spark, sf_dir)
    first, parts = parts_of(grid)
    return grid.groupBy(S.segment_column(parts, first).alias("split")).agg(F.count("*").alias("cells"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = event_grid(spark, sf_dir)
    until = grid.agg(F.max("ts")).first()[0]
    return replay.recent_window(grid, "0", until).select("sensor_id", "ts", "speed")


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = M.surroundings(event_grid(spark, sf_dir), 0.60, 60, 3, 12, 6, True)
    return M.matched_controls(cells)


#: Shorter events, of which every scale of the tables has some with and some without a control.
SHORT = {"threshold": 0.25, "step_minutes": 60, "min_steps": 2, "before": 3, "after": 2, "centred": True}


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbour_features(event_grid(spark, sf_dir), supply_edges(spark, sf_dir))
    return rounded(rows, *(c for c in rows.columns if c.startswith("near_mean")))


def group_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("period", F.when(F.hour("ts").isin(7, 8, 9, 16, 17, 18), "peak").otherwise("other")).withColumn("day_type", F.when(C.is_weekend(F.col("ts")), "Weekend").otherwise("Weekday"))
    return metrics.group_errors(rows, [[], ["period"], ["day_type"], ["period", "day_type"], ["sensor_id"]], 0.5)


def short_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = event_grid(spark, sf_dir)
    first, parts = parts_of(grid)
    return rounded(X.fill_short_gaps(grid, S.period_stats(grid, parts[0], first, PLAN.step_minutes)), "filled")


def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.isotonic(scored(spark, sf_dir).withColumn("p", F.round("p", 2))).select("high", "n", F.round("value", 9).alias("value"))


def stored_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples published by split, read back and checked: rows, faults and the order of the splits of what is stored."""
    root = f"{shared_folder(spark)}/splits-{uuid.uuid4()}"
    publish(model_part("samples")(spark, sf_dir), root, ["sensor_id", "ts"], partition_by=["split"])
    stored = published(spark, root)
    return X.dataset_checks(stored).join(S.leakage_report(stored).select("split", "after_previous"), "split")


def faulty_grid(grid: DataFrame) -> DataFrame:
    """A grid with faults: every 97th step of sensor 0 comes twice, every 89th is missing for all, and one reading lies half a step off."""
    kept = grid.where("t % 89 != 0")
    shifted = kept.withColumn("ts", F.when((F.col("sensor_id") == "0") & (F.col("t") % 101 == 0), F.expr("ts + INTERVAL 30 MINUTES")).otherwise(F.col("ts")))
    return shifted.unionByName(kept.where("sensor_id = '0' and t % 97 = 0"))


def faulty_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with faults: nulls at every 5th step, repeated rows at every 7th, a target of 2 at every 11th, and training rows as late as the others at every 13th."""
    found = model_part("samples")(spark, sf_dir)
    late = F.when(F.col("t") % 13 == 0, "train").otherwise(F.col("split"))
    broken = found.withColumn("ratio", F.when(F.col("t") % 5 != 0, F.col("ratio"))).withColumn("target", F.when(F.col("t") % 11 == 0, 2).otherwise(F.col("target"))).withColumn("split", late)
    return broken.unionByName(broken.where("t % 7 = 0"))


def faulty_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpoint(faulty_samples(spark, sf_dir))
    return X.dataset_checks(rows).join(S.leakage_report(rows).select("split", "after_previous"), "split")


def explanation_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = checkpoint(model_part("samples")(spark, sf_dir).where("split = 'train'"))
    both = [ml.reference_table(rows).withColumn("scope", F.lit(scope)) for scope, rows in (("all", train), ("first_sensor", ml.first_sensor(train)))]
    return rounded(both[0].unionByName(both[1]).where("value is not null or name is not null"), "value")  # a table without training rows has none


def factor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max("p_retailprice").alias("value"))
    return ml.factor_table(part.select(F.col("p_brand").alias("feature"), "value", F.round(F.col("value") / 100 - 9, 4).alias("delta")))


def permuted_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("|", "sensor_id", F.col("t").cast("string"))
    return permutation.permuted(event_grid(spark, sf_dir), key, "speed").select("sensor_id", "ts", "speed")


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = event_grid(spark, sf_dir).where("speed > 0")
    key = F.concat_ws("|", "sensor_id", F.col("t").cast("string"))
    return metrics.exact_sample(grid, 500, key).orderBy(F.md5(F.concat_ws("|", key, F.lit("42"))), key).select("sensor_id", "ts")  # 500 rows


def melted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.sensor_risk(event_grid(spark, sf_dir)).select("sensor_id", "coverage_rate", "congestion_rate_50", "congestion_rate_60", "congestion_rate_70")
    return metrics.melt_metrics(rows, "sensor_id", rows.columns[1:])


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price shares of part types as importances of encoded columns: ``numeric__size`` or ``category__type_<type>``."""
    part = table(spark, sf_dir, "part")
    encoded = part.select(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("category__type_"), "p_type")).otherwise(F.concat(F.lit("numeric__"), F.lower("p_brand"))).alias("name"), F.col("p_retailprice").alias("importance"))
    return metrics.importance_rollup(encoded, C.source_feature(F.col("name"), "type"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.slug(F.concat_ws(" / ", "p_name", "p_brand", "p_type")).alias("slug"))


def casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and minutes of text that may be neither."""
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    value = F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(F.col("event_id").cast("string"))
    return e.select("event_id", C.number(value).alias("number"), C.minute_text(text).alias("minute"))


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sensors = event_grid(spark, sf_dir).select("sensor_id").distinct()
    return graph.ordered_lookup(sensors, graph.locations(supplier_places(spark, sf_dir)))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.key_differences(event_grid(spark, sf_dir).select("sensor_id"), supplier_places(spark, sf_dir))


_ROWS: dict[tuple[str, str], DataFrame] = {}


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples, cut from their plan: fits and metrics run it many times, and the driver would hold as many copies of it. The
    queries of an application share them, and with them the fitted models."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _ROWS:
        _ROWS[key] = checkpoint(model_part("samples")(spark, sf_dir))
    return _ROWS[key]


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = model_rows(spark, sf_dir)
    return ml.compare_models(found, ml.Settings())


#: Fewer and smaller trees than the defaults, for the two ways of boosting side by side.
FEW = {"boosts": 20, "boost_depth": 4}


def boosting_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.compare_models(model_rows(spark, sf_dir), ml.Settings(**FEW), ("second_order_boosting", "gradient_boosting"))


def trees_of(found: DataFrame) -> tuple[Ensemble, DataFrame]:
    """The second-order boosting and the test rows with what it reads."""
    model = ml.fit_models(found, ml.Settings(**FEW), ("second_order_boosting",))["second_order_boosting"]
    return model.stages[-1].trees, model.stages[0].transform(found.where("split = 'test'"))


def model_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary(*trees_of(model_rows(spark, sf_dir)))
    return rounded(rows, "mean_abs", "direction")


def replay_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last test row of each sensor, scored by the model that is best on validation rows."""
    found = model_rows(spark, sf_dir)
    name, model = ml.select_model(found, ml.Settings())
    last = found.where("split = 'test'").groupBy("sensor_id").agg(F.max("t").alias("t"))
    return ml.score_rows(model, found.where("split = 'test'").join(last, ["sensor_id", "t"])).withColumn("model", F.lit(name))


def explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = model_rows(spark, sf_dir)
    name, model = ml.select_model(found, ml.Settings())
    row = ml.riskiest(ml.scored(model, found.where("split = 'test'"))).select("sensor_id", "t")
    return ml.explain(model, found.join(F.broadcast(row), ["sensor_id", "t"]), ml.reference_values(found.where("split = 'train'"))).withColumn("model", F.lit(name))  # one row


def model_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.all_importances(model_rows(spark, sf_dir), ml.Settings())


def best_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = model_rows(spark, sf_dir)
    judged = ml.validated(ml.fit_models(found, ml.Settings()), found)
    return metrics.best_model(reduce(DataFrame.unionByName, (row for _, row in judged.values())), ml.MODELS)


def clean_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.clean_long(event_grid(spark, sf_dir), graph.locations(supplier_places(spark, sf_dir)))
    return rows.select("ts", "sensor_id", F.round(F.col("speed_raw").cast("double"), 3).alias("speed_raw"), F.round(F.col("speed_valid").cast("double"), 3).alias("speed_valid"), F.col("hour").cast("bigint").alias("hour"), F.col("day_of_week").cast("bigint").alias("day_of_week"), "is_weekend", *(F.round(F.col(c).cast("double"), 3).alias(c) for c in ("latitude", "longitude")), *rows.columns[9:])


def queries() -> dict[str, Query]:
    return {
        "dense_grid": on_grid(lambda g: g.select("sensor_id", "ts", "speed")),
        "grid_validation": on_grid(lambda g: check_grid(g, 3600)),
        "hourly_pattern": on_grid(P.hourly_pattern),
        "weekday_hour_pattern": on_grid(P.weekday_hour_pattern),
        "day_type_hour_pattern": on_grid(P.day_type_hour_pattern),
        "daily_trend": on_grid(P.daily_trend),
        "sensor_risk": lambda spark, sf_dir: P.sensor_risk(event_grid(spark, sf_dir), graph.locations(supplier_places(spark, sf_dir))),
        "run_event_metrics": on_grid(P.run_events),
        "free_flow_q85": on_grid(lambda g: rounded(P.free_flow(g))),
        "congestion_state_rates": on_grid(P.congestion_rates),
        "quality_flags": on_grid(lambda g: Q.quality_flags(g).drop("t")),
        "quality_summary": on_grid(lambda g: Q.quality_summary(Q.quality_flags(g))),
        "systemwide_zero": on_grid(lambda g: Q.zero_share(g).drop("t")),
        "majority_zero": on_grid(lambda g: Q.systemwide_runs(g, majority=True)),
        "long_zero_runs": on_grid(lambda g: Q.long_zero_runs(g, 3).where("is_long_sensor_zero_run").select("sensor_id", "ts")),
        "large_jumps": on_grid(lambda g: Q.large_jumps(g).where("is_large_jump").select("sensor_id", "ts", "is_large_jump_from_zero")),
        "sensor_audit": on_grid(Q.sensor_audit),
        "zero_runs_audit": on_grid(Q.zero_run_audit),
        "top_zero_timestamps": on_grid(Q.top_zero_timestamps),
        "interval_counts": lambda spark, sf_dir: Q.interval_counts(table(spark, sf_dir, "events")),
        "global_quantiles": on_grid(Q.global_quantiles),
        "clean_table": clean_table,
        "lag_features": windowed(X.lags),
        "rolling_features": windowed(X.rolling),
        "trend_features": windowed(lambda: X.trends(60)),
        "decline_steps": on_grid(lambda g: X.decline_steps(g).select("sensor_id", "ts", "decline_steps")),
        "calendar_features": on_grid(lambda g: rounded(g.select("sensor_id", "ts", *(c.alias(k) for k, c in X.calendar(60).items())))),
        "history_mask": windowed(lambda: {"history_complete": X.history_complete()}),
        "future_label": windowed(lambda: dict(zip(("future_count", "future_complete"), X.future_counts(0.60), strict=True))),
        "label_sensitivity": on_grid(lambda g: X.labels(with_flow(g)).groupBy("sensor_id").agg(*(F.count_if(F.col("future_complete") & (F.col(f"label_{k}") == 1)).alias(f"positives_{k}") for k in (50, 60, 70)))),
        "time_split": time_split,
        "segment_purge": model_part("segments"),
        "train_stats": train_stats,
        "period_stats": period_stats,
        "feature_table": feature_table,
        "split_summary": model_part("summary"),
        "dataset_checks": model_part("checks"),
        "leakage_report": lambda spark, sf_dir: S.leakage_report(model_part("samples")(spark, sf_dir)),
        "heatmap_cells": lambda spark, sf_dir: rounded(heat(spark, sf_dir)),
        "heatmap_top40": lambda spark, sf_dir: replay.heatmap_top(heat(spark, sf_dir)),
        "heatmap_pivot": lambda spark, sf_dir: replay.heatmap_pivot(heat(spark, sf_dir)),
        "replay_tail": on_grid(lambda g: replay.replay_tail(g).select("sensor_id", "ts", "speed")),
        "recent_window": recent,
        "sensor_edges": pruned_edges,
        "corridor_bands": corridor,
        "map_centre": lambda spark, sf_dir: graph.map_centre(supplier_places(spark, sf_dir)),
        "risk_bands": lambda spark, sf_dir: replay.banded(scored(spark, sf_dir)).groupBy("risk").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("positive_rate")),
        "threshold_sweep": lambda spark, sf_dir: metrics.threshold_sweep(scored(spark, sf_dir)),
        "best_threshold": lambda spark, sf_dir: metrics.best_threshold(metrics.threshold_sweep(scored(spark, sf_dir))),
        "confusion_metrics": lambda spark, sf_dir: metrics.confusion_metrics(scored(spark, sf_dir), 0.5),
        "roc_auc": lambda spark, sf_dir: metrics.roc_auc(scored(spark, sf_dir)),
        "roc_points": lambda spark, sf_dir: metrics.roc_points(scored(spark, sf_dir)),
        "class_balance": lambda spark, sf_dir: metrics.class_balance(scored(spark, sf_dir), "y"),
        "spearman_ranks": on_grid(lambda g: P.spearman(P.sensor_risk(g))),
        "zero_sensitivity": on_grid(P.zero_sensitivity),
        "weekday_weekend_gap": on_grid(P.rush_hour_gap),
        "weekday_pivot": on_grid(P.weekday_pivot),
        "coverage_topk": on_grid(lambda g: P.coverage_topk(P.sensor_risk(g))),
        "slowest_hours": on_grid(lambda g: P.slowest_hours(P.hourly_pattern(g))),
        "importance_rollup": importance,
        "metric_melt": melted,
        "train_sample": sample,
        "matched_controls": matched,
        "event_profile": on_grid(M.event_profile),
        "short_event_controls": on_grid(lambda g: M.matched_controls(M.surroundings(g, **SHORT))),
        "short_event_profile": on_grid(lambda g: M.event_profile(g, **SHORT)),
        "neighbour_features": near,
        "group_errors": group_errors,
        "short_gaps": short_gaps,
        "calibration_curve": lambda spark, sf_dir: calibration.calibration_curve(scored(spark, sf_dir)),
        "calibration_scores": lambda spark, sf_dir: calibration.calibration_scores(scored(spark, sf_dir)),
        "isotonic_fit": isotonic_fit,
        "permuted_column": permuted_column,
        "stored_splits": stored_splits,
        "faulty_grid_validation": on_grid(lambda g: check_grid(faulty_grid(g), 3600)),
        "faulty_dataset_checks": faulty_checks,
        "explanation_reference": explanation_reference,
        "factor_table": factor_table,
        "footer_counts": lambda spark, sf_dir: footer_counts(spark, f"{sf_dir}/orders.parquet"),
        "congested_runs": on_grid(lambda g: run_table(with_flow(g).withColumn("congested", C.congested(F.col("ratio"), 0.6)), "congested")),
        "location_lookup": lookup,
        "key_uniqueness": keys,
        "slug": slugs,
        "safe_casts": casts,
        "model_comparison": models,
        "local_explanation": explanation,
        "model_importances": model_importances,
        "best_model": best_of_models,
        "boosting_comparison": boosting_comparison,
        "model_shapley": model_shapley,
        "replay_scores": replay_scores,
        "distinct_dates": on_grid(replay.distinct_dates),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
