"""Small hand-made grids: each fixes one rule of the operators."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from loomgrid.functions import columns as C
from loomgrid.operators import features as X
from loomgrid.operators import graph, metrics
from loomgrid.operators import matching as M
from loomgrid.operators import patterns as P
from loomgrid.operators import quality as Q
from loomgrid.operators import split as S
from loomgrid.operators.quantiles import exact_quantiles, in_ranges, many_quantiles
from loomgrid.operators.windows import run_table, runs
from loomgrid.sources.files import read_artifact, read_csv, sensor_history, write_observations
from loomgrid.sources.grid import check_grid, densify, event_grid, long_form, readings, require_grid

START = dt.datetime(2012, 3, 1)
STEP = 300


def grid(spark, rows, sensors="ABC"):
    """Rows of speeds, one for each step, as a long grid."""
    first = int((START - dt.datetime(1970, 1, 1)).total_seconds()) // STEP
    flat = [(s, START + dt.timedelta(seconds=STEP * i), first + i, float(v)) for i, row in enumerate(rows) for s, v in zip(sensors, row, strict=False)]
    return spark.createDataFrame(flat, "sensor_id string, ts timestamp_ntz, t bigint, speed double"), first


SPEEDS = [(60, 55, 50), (0, 0, 0), (0, 45, 0), (20, 44, 0), (65, 43, 48), (64, 42, 47)]


def cells(df, first, flag):
    return {(r["t"] - first, r["sensor_id"]) for r in df.where(flag).collect()}


def test_grid_check(spark):
    g, _ = grid(spark, SPEEDS)
    found = check_grid(g, STEP).first()
    assert (found["n_rows"], found["sensors"], found["steps"], found["is_grid"]) == (18, 3, 6, True)
    holes = g.where(F.col("ts") != START + dt.timedelta(seconds=2 * STEP))
    with pytest.raises(ValueError, match="intervals"):
        require_grid(holes, STEP)
    with pytest.raises(ValueError, match="repeated"):
        require_grid(g.unionByName(g.limit(1)), STEP)


def test_densify_fills_with_zero(spark):
    found = spark.createDataFrame([("a", 10, 5.0), ("a", 13, 6.0), ("b", 11, 7.0)], "sensor_id string, t bigint, speed double")
    rows = {(r["sensor_id"], r["t"]): r["speed"] for r in densify(found, STEP).collect()}
    assert len(rows) == 8 and rows["a", 11] == 0 and rows["b", 11] == 7 and rows["b", 13] == 0


def test_quality_flags(spark):
    g, first = grid(spark, SPEEDS)
    flags = Q.quality_flags(g, 0.5, 2, 40.0).cache()
    assert cells(flags, first, "is_systemwide_zero") == {(1, s) for s in "ABC"}
    assert cells(flags, first, "is_majority_zero") == {(i, s) for i in (1, 2) for s in "ABC"}
    long_ = cells(flags, first, "is_long_sensor_zero_run")
    assert {(1, "A"), (2, "A"), (3, "C")} <= long_ and (1, "B") not in long_
    jumps, from_zero = cells(flags, first, "is_large_jump"), cells(flags, first, "is_large_jump_from_zero")
    assert (1, "A") in from_zero and (4, "A") in jumps and (4, "A") not in from_zero and not any(i == 0 for i, _ in jumps)


@pytest.mark.parametrize("chunk", [2, 3, 4096])
def test_runs_over_chunks(spark, chunk):
    g, first = grid(spark, [(0, 1), (1, 1), (1, 0), (0, 1)], "AB")
    flagged = g.withColumn("on", F.col("speed") == 1)
    long_ = {(r["t"] - first, r["sensor_id"]) for r in runs(flagged, "on", chunk).where("run_steps >= 2").collect()}
    assert long_ == {(1, "A"), (2, "A"), (0, "B"), (1, "B")}
    assert {(r["sensor_id"], r["run_start"] - first, r["run_steps"]) for r in run_table(flagged, "on", chunk).collect()} == {("A", 1, 2), ("B", 0, 2), ("B", 3, 1)}


def test_zero_is_missing_only_in_views(spark):
    g, first = grid(spark, [(0, 10), (20, 20), (40, 30), (60, 40)], "AB")
    flow = P.free_flow(g, 0.75)
    rated = P.with_ratio(g, flow).withColumn("hit", C.congested(F.col("ratio"), 0.6))
    rows = {(r["t"] - first, r["sensor_id"]): r for r in rated.collect()}
    assert rows[0, "A"]["v"] is None and rows[0, "A"]["speed"] == 0
    assert [rows[0, "A"]["hit"], rows[1, "A"]["hit"], rows[0, "B"]["hit"]] == [False, True, True]
    assert P.day_type_hour_pattern(g).count() == 48


def test_nan_and_infinity_are_missing(spark):
    g, _ = grid(spark, [(math.nan, math.inf, -1)])
    assert g.select(C.valid_speed(F.col("speed")).alias("v")).where("v is not null").count() == 0


def test_segments():
    parts = S.segments(100)
    assert [p.observations for p in parts] == [70, 10, 20]
    assert (parts[0].sample_end(2), parts[1].sample_start(2)) == (67, 72)
    assert [p.observations for p in S.segments(34272)] == [23990, 3427, 6855]
    with pytest.raises(ValueError):
        S.segments(100, 0.9, 0.1, 0.1)
    with pytest.raises(ValueError):
        S.require_windows(S.segments(30), 12, 6)


def test_later_rows_do_not_change_training_statistics(spark):
    base, changed = [(60, 60)] * 40, [(60, 60)] * 28 + [(999, 999)] * 12
    part, out = S.Segment("train", 0, 27), []
    for rows in (base, changed):
        g, first = grid(spark, rows, "AB")
        out.append(sorted(map(tuple, S.train_stats(g, part, first).collect())))
        assert S.period_stats(g, part, first, 5).count() == 2 * 2 * 288
    assert out[0] == out[1]


def test_future_counts(spark):
    g, first = grid(spark, [(60,), (20,), (20,), (20,), (60,), (60,)], "A")
    state = P.with_ratio(g, spark.createDataFrame([("A", 60.0)], "sensor_id string, free_flow double"))
    count, _ = X.future_counts(0.6, 3)
    found = X.windowed(state, {"n": count}, 0, 3).orderBy("t").collect()
    assert [r["n"] for r in found] == [3, 2, 1, -1, -1, -1]


def test_future_changes_labels_not_features(spark):
    tables = []
    for slow in (False, True):
        rows = [(20,) if slow and 16 <= i <= 18 else (60,) for i in range(45)]
        g, first = grid(spark, rows, "A")
        parts = [S.Segment("train", 0, 19), S.Segment("validation", 20, 34), S.Segment("test", 35, 44)]
        stats_free = X.model_table(g, parts, first, 5, 12, 3, 0.6, (0.5, 0.6, 0.7), 2)
        tables.append(stats_free.where(F.col("t") == first + 15).first())
    a, b = tables
    assert a["label_60"] == 0 and b["label_60"] == 1
    for name in ("v", "ratio_lag_12", "speed_mean_12", "speed_std_12", "trend_6", "decline_steps"):
        assert a[name] == b[name]
    with pytest.raises(ValueError):
        X.model_table(g, parts, first, 5, threshold=0.55)


def test_declines_restart(spark):
    g, _ = grid(spark, [(50,), (40,), (30,), (0,), (20,), (10,), (10,)], "A")
    assert [r["decline_steps"] for r in X.decline_steps(g).orderBy("t").collect()] == [0, 1, 2, 0, 0, 1, 0]


def test_threshold_sweep_and_metrics(spark):
    rows = spark.createDataFrame([(0, 0.05), (0, 0.2), (1, 0.6), (1, 0.7), (1, 0.95), (0, 0.8)], "y int, p double")
    sweep = metrics.threshold_sweep(rows, 10, 90, 10)
    assert sweep.count() == 9 and metrics.best_threshold(sweep).first()["f1"] >= 0.8
    one = metrics.confusion_metrics(spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.8), (1, 0.9)], "y int, p double"), 0.5).first()
    assert (one["tp"], one["fp"], one["fn"], one["tn"], one["f1"]) == (2, 0, 0, 2, 1.0)
    assert metrics.roc_auc(rows).first()["auc"] == pytest.approx(7 / 9, abs=1e-6)
    assert metrics.roc_auc(rows.where("y = 1")).first()["auc"] is None
    assert metrics.exact_sample(rows, 4, F.col("p").cast("string")).count() == 4


def test_sweep_equals_direct_comparison(spark):
    rows = spark.range(2000).select((F.col("id") % 3 == 0).cast("int").alias("y"), F.round(F.rand(5), 2).alias("p")).cache()
    local = [(r["y"], r["p"]) for r in rows.collect()]
    for r in metrics.threshold_sweep(rows).collect():
        tp, pred, pos = sum(y for y, p in local if p >= r["threshold"]), sum(p >= r["threshold"] for _, p in local), sum(y for y, _ in local)
        assert r["recall"] == pytest.approx(tp / pos, abs=1e-6) and r["precision"] == pytest.approx(tp / pred if pred else 0, abs=1e-6)


def test_risk_bands(spark):
    band = lambda p, strict=False: spark.createDataFrame([(p,)], "p double").select(C.risk_band(F.col("p"), strict).alias("b")).first()["b"]
    assert [band(p) for p in (0.0, 0.3999, 0.40, 0.6999, 0.70, 1.0)] == ["low", "low", "medium", "medium", "high", "high"]
    for p in (-0.01, 1.01):
        with pytest.raises(Exception, match="probability"):
            band(p, True)


def test_edges_are_pruned_in_order(spark):
    places = spark.createDataFrame([("9", "1", "1"), ("10", "1", "2"), ("11", "1", "x"), ("12", "2", "2"), ("9", "5", "5")], "sensor_id string, latitude string, longitude string")
    known = graph.locations(places)
    assert sorted(r["sensor_id"] for r in known.collect()) == ["10", "12", "9"]
    edges = spark.createDataFrame([("9", "10", 5.0), ("10", "9", 4.0), ("9", "12", 4000.0), ("9", "9", 0.0), ("9", "11", 1.0), ("12", "10", 2000.0)], "from_id string, to_id string, cost double")
    assert {tuple(r) for r in graph.sensor_edges(edges, known).collect()} == {("10", "9", 4.0), ("10", "12", 2000.0)}


def brute_matches(events, controls):
    used, out = set(), {}
    for e in sorted(events):
        order = sorted(controls, key=lambda c: (abs(c - e), c))
        free = [c for c in order if c not in used]
        pick = free[0] if free else order[0] if order else None
        used.add(pick)
        out[e] = (pick, bool(order) and not free)
    return out


def test_greedy_matching(spark):
    events, controls = [100, 148, 196, 244], [124, 172, 52]
    rows = [("A", t, True, False) for t in events] + [("A", t, False, True) for t in controls] + [("B", 5, True, False)]
    df = spark.createDataFrame(rows, "sensor_id string, t bigint, is_event boolean, is_control boolean").withColumns({"is_weekend": F.lit(False), "time_slot": F.lit(4)})
    found = {(r["sensor_id"], r["event_t"]): (r["control_t"], r["is_reused"]) for r in M.matched_controls(df).collect()}
    assert found == {("A", e): v for e, v in brute_matches(events, controls).items()} | {("B", 5): (None, False)}


def test_control_windows(spark):
    speeds = [(60.0,)] * 120
    speeds[40] = speeds[41] = speeds[42] = (20.0,)
    speeds[88] = (0.0,)
    g, first = grid(spark, speeds, "A")
    both = {c: {r["t"] - first for r in M.surroundings(g, 0.6, 5, 3, 12, 6, c).where("is_control").collect()} for c in (True, False)}
    assert 99 in both[True] and 99 not in both[False]  # a gap at offset -11 counts only in the whole window
    assert {r["t"] - first for r in M.surroundings(g, 0.6, 5, 3, 12, 6, True).where("is_event").collect()} == {40}


def test_files(spark, tmp_path):
    cases = {"a": "{", "b": "[]", "c": '{"schema_version": "0.9"}', "d": '{"schema_version": "1.0"}', "e": '{"schema_version": "1.0", "items": []}'}
    for k, v in cases.items():
        (tmp_path / f"{k}.json").write_text(v)
    errors = {k: read_artifact(spark, str(tmp_path / f"{k}.json"), {"items"}).error for k in [*cases, "absent"]}
    assert errors["absent"] == "missing" and errors["a"] == "not JSON" and errors["b"] == "not an object" and "0.9" in errors["c"] and "items" in errors["d"] and errors["e"] is None
    (tmp_path / "l.csv").write_text("﻿sensor_id,latitude\n007,1.5\n", encoding="utf-8")
    assert read_csv(spark, str(tmp_path / "l.csv"), "sensor_id string, latitude double").first()["sensor_id"] == "007"
    g, _ = grid(spark, SPEEDS)
    assert write_observations(g, str(tmp_path / "obs"), 2) == 18
    one = sensor_history(spark, str(tmp_path / "obs"), "A")
    assert one.count() == 6 and "PushedFilters: [IsNotNull(sensor_id), EqualTo(sensor_id,A)]" in one._jdf.queryExecution().toString()


def test_wide_to_long_and_names(spark):
    wide = spark.createDataFrame([(START, 1.0, 2.0)], "ts timestamp_ntz, A double, B double")
    assert {(r["sensor_id"], r["speed"]) for r in long_form(wide, "ts", ["A", "B"]).collect()} == {("A", 1.0), ("B", 2.0)}
    row = spark.createDataFrame([("  XG-Boost (v2) ", "category__sensor_id_77", "speed")], "a string, b string, c string").select(
        C.slug(F.col("a")), C.source_feature(F.col("b"), "sensor_id"), C.localized(F.col("c"), {"speed": "Speed"}), C.localized(F.col("a"), {}), C.percent_band(F.lit(100.0))
    ).first()
    assert list(row) == ["xg_boost_v2", "sensor_id", "Speed", "  XG-Boost (v2) ", "80-100%"]


def test_empty_grid(spark):
    g, _ = grid(spark, [], "A")
    assert P.hourly_pattern(g).count() == 0 and Q.quality_flags(g).count() == 0 and P.sensor_risk(g).count() == 0 and M.event_profile(g).count() == 0
    assert json.loads(Q.quality_summary(Q.quality_flags(g)).toJSON().first())["cells"] == 0


def test_stream_replay(spark, tmp_path):
    from loomgrid.streaming.replay import readings_stream, window_means

    g, _ = grid(spark, SPEEDS)
    g.select(F.col("ts").cast("timestamp").alias("ts"), "sensor_id", "speed").coalesce(1).write.parquet(str(tmp_path / "in"))
    query = window_means(readings_stream(spark, str(tmp_path / "in")), "10 minutes").writeStream.format("memory").queryName("replayed").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("replayed").where("sensor_id = 'A'").agg(F.sum("n")).first()[0] == 6


def test_exact_quantiles(spark):
    rng = random.Random(4)
    rows = [("a", float(rng.choice([1, 1, 1, 2, 50]))) for _ in range(301)] + [("b", rng.gauss(0, 100)) for _ in range(200)] + [("b", 1e6), ("c", 3.0), ("d", None), ("e", 1.0), ("e", 2.0)]
    frame = spark.createDataFrame(rows, "k string, v double")
    qs = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    want = {r["k"]: r["q"] for r in frame.where("v is not null").groupBy("k").agg(F.percentile("v", qs).alias("q")).collect()}
    for ranges in (1, 7, 128):
        got = {r["k"]: r["q"] for r in exact_quantiles(frame, ["k"], F.col("v"), qs, ranges=ranges).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert exact_quantiles(frame.limit(0), ["k"], F.col("v"), qs).count() == 0


def test_quantiles_of_outliers_and_infinities(spark):
    """However far values lie apart, no range holds over twice its share of them; infinite ends are quantiles like others."""
    values = spark.range(20_000).select(F.lit(1).alias("g"), F.when(F.col("id") == 0, 1e300).when(F.col("id") < 100, F.col("id") * 1e9).otherwise(F.col("id") / 1e6).alias("_x"), F.lit(1).alias("_n"))
    sizes = [r["count"] for r in in_ranges(values, ["g"], 100).groupBy("_range").count().collect()]
    assert max(sizes) <= 2 * 20_000 / 100 and sum(sizes) == 20_000
    rows = spark.createDataFrame([(1, float("-inf"), 2.0), (1, 1.0, None), (1, float("inf"), 4.0), (2, float("-inf"), None), (2, float("-inf"), None)], "g int, a double, b double")
    got = {r["g"]: (r["a"], r["b"]) for r in many_quantiles(rows, ["g"], {"a": (F.col("a"), [0.0, 0.5, 1.0]), "b": (F.col("b"), [0.5])}).collect()}
    assert got == {1: ([float("-inf"), 1.0, float("inf")], [3.0]), 2: ([float("-inf")] * 3, None)}


def test_hourly_medians_that_are_ties(spark):
    """Two readings of six places an hour: their mean often ends in a 5 at the seventh, which goes up, though doubles lie on either side of it."""
    draw, start = random.Random(5), dt.datetime(2024, 1, 1)
    rows, wanted = [], {}
    for h in range(24):
        low = draw.randrange(10**6, 10**8)
        wanted[h] = (low + 1) / 10**6
        rows += [(s, start + dt.timedelta(hours=h), h, x / 10**6) for s, x in (("A", low), ("B", low + 1))]
    frame = spark.createDataFrame(rows, "sensor_id string, ts timestamp_ntz, t bigint, speed double")
    hourly = {r["hour"]: (r["median_speed"], r["median_with_zero"]) for r in P.hourly_pattern(frame).collect()}
    assert hourly == {h: (x, x) for h, x in wanted.items()}
    assert {r["hour"]: r["median_speed"] for r in P.weekday_hour_pattern(frame).collect()} == wanted
    assert {r["hour"]: r["median_speed"] for r in P.day_type_hour_pattern(frame).where("valid_count > 0").collect()} == wanted


def test_ranges_are_laid_once(spark, monkeypatch):
    """Approximate edges depend on the order in which partitions are merged, so totals and values of ranges have to see the same ones."""
    from loomgrid.operators import quantiles

    kept = []
    monkeypatch.setattr(quantiles, "checkpoint", lambda df: kept.append(df.columns) or df.checkpoint())
    spark.sparkContext.setCheckpointDir("/tmp/spark-ranges") if spark.sparkContext.getCheckpointDir() is None else None
    assert exact_quantiles(spark.range(1000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v")), ["k"], F.col("v"), [0.5]).first()["q"] == [499.5]
    assert any("_edges" in columns for columns in kept)


@pytest.mark.parametrize("users", [range(10), range(100), [3, 95, 96, 98, *range(200, 240, 3), *range(1000, 1100, 3)], [-5, -4, *range(80)], []])
def test_event_grid_equals_its_definition(spark, tmp_path, users):
    rng = random.Random(6)
    rows = [(START + dt.timedelta(minutes=rng.randrange(3000)), u, rng.random() if rng.random() < 0.9 else None) for u in users for _ in range(3)]
    spark.createDataFrame(rows, "ts timestamp_ntz, user_id bigint, value double").write.parquet(str(tmp_path / "events.parquet"))
    events = spark.read.parquet(str(tmp_path / "events.parquet"))
    order = lambda df: sorted(map(tuple, df.select("sensor_id", "ts", "t", "speed").collect()))
    assert order(event_grid(spark, str(tmp_path))) == order(densify(readings(events)))
