"""Publishing, footers, digests; neighbours, gaps and samples against later rows and hubs."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import features as X
from loomgrid.operators.metrics import exact_sample, group_errors
from loomgrid.operators.neighbours import neighbour_features, neighbour_sums
from loomgrid.sources import files, publish

GRID = "sensor_id string, ts timestamp_ntz, t bigint, speed double"


def grid(spark, speeds):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(s, start + dt.timedelta(hours=t), t, float(v)) for s, series in speeds.items() for t, v in enumerate(series)], GRID)


def test_publishing_switches_whole_versions(spark, tmp_path):
    root = str(tmp_path / "table")
    first = spark.range(100).withColumn("split", F.when(F.col("id") < 50, "a").otherwise("b"))
    made = publish.publish(first, root, ["id"], 100, ["split"])
    assert publish.published(spark, root, verify=True).count() == made["n_rows"] == 100 and len(made["files"]) >= 2
    broken = spark.range(0, 1000, 1, 8).select("id", F.when(F.col("id") == 990, F.raise_error(F.lit("half-way"))).otherwise("x").alias("split"))
    with pytest.raises(Exception, match="half-way"):
        publish.publish(broken, root)
    with pytest.raises(ValueError, match="rows"):
        publish.publish(spark.range(7), root, n_rows=8)
    with pytest.raises(ValueError, match="repeats"):
        publish.publish(spark.range(7).union(spark.range(1)), root, ["id"])
    assert publish.published(spark, root).count() == 100 and publish.manifest(spark, root) == made
    assert [n for n in os.listdir(root) if n.startswith("v-")] == [made["version"]]  # nothing of the failed ones is left
    before = publish.published(spark, root)
    publish.publish(spark.range(5), root)
    assert before.count() == 100 and publish.published(spark, root).count() == 5  # a reader that began with the version before ends with it
    assert publish.expire(spark, root) == 1 and publish.published(spark, root).count() == 5
    version = os.path.join(root, publish.manifest(spark, root)["version"])
    part = next(f for f in os.listdir(version) if f.endswith(".parquet"))
    os.remove(os.path.join(version, part))
    with pytest.raises(ValueError, match="manifest"):
        publish.published(spark, root, verify=True)
    with pytest.raises(ValueError, match="nothing"):
        publish.published(spark, str(tmp_path / "none"))


def test_footers_alone_answer_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(0, 10_000, 1, 3).select("id", F.when(F.col("id") % 7 != 0, F.col("id") * 2.5).alias("x"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("text "), "id")).alias("s"))
    rows.write.parquet(path)
    counts = rows.agg(*(F.count_if(F.col(c).isNull()) for c in rows.columns)).first()
    found = {r["column"]: r for r in files.footer_counts(spark, path).collect()}
    assert [found[c]["nulls"] for c in rows.columns] == list(counts) and all(r["n_rows"] == 10_000 for r in found.values())
    assert (found["id"]["least"], found["id"]["greatest"], found["s"]["least"]) == ("0", "9999", None)
    shutil.copytree(path, path + "-cut")
    for name in os.listdir(path + "-cut"):
        at = os.path.join(path + "-cut", name)
        if name.endswith(".crc"):
            os.remove(at)
        elif name.endswith(".parquet"):
            data = bytearray(open(at, "rb").read())
            footer = int.from_bytes(data[-8:-4], "little") + 8
            data[4 : len(data) - footer] = bytes(len(data) - footer - 4)  # every page is gone
            open(at, "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(path + "-cut").agg(F.sum("x"), F.max("s")).collect()
    assert {r["column"]: tuple(r) for r in files.footer_counts(spark, path + "-cut").collect()} == {c: tuple(r) for c, r in found.items()}
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""


def test_digests(spark, tmp_path):
    for k in "ab":
        os.makedirs(tmp_path / "m" / k)
        (tmp_path / "m" / k / "part").write_text(k)
    before = files.folder_digest(spark, str(tmp_path / "m"))
    shutil.copytree(tmp_path / "m", tmp_path / "n")
    assert files.folder_digest(spark, str(tmp_path / "n")) == before  # wherever the folder lies
    (tmp_path / "n" / "a" / "part").write_text("b")
    (tmp_path / "n" / "b" / "part").write_text("a")
    assert files.folder_digest(spark, str(tmp_path / "n")) != before  # files swapped between folders
    one = str(tmp_path / "one.txt")
    open(one, "w").write("x")
    digest = files.file_digests(spark, one).first()["sha256"]
    files.require_digest(spark, one, digest)
    with pytest.raises(ValueError, match="digest"):
        files.require_digest(spark, one, "0" * 64)


def test_csv_export(spark, tmp_path):
    path = str(tmp_path / "out")
    files.write_csv(spark.createDataFrame([("a,b", None, 1.5), ('q"', "é", None)], "a string, b string, c double"), path)
    parts = [f for f in os.listdir(path) if f.endswith(".csv")]
    back = files.read_csv(spark, path, "a string, b string, c double")
    assert len(parts) == 1 and sorted(tuple(r) for r in back.collect()) == sorted([("a,b", None, 1.5), ('q"', "é", None)])


def test_neighbours_look_back_only_and_hubs_are_split(spark):
    speeds = {"hub": [10, 20, 30, 40], "a": [1, 0, 3, 4], "b": [5, 6, 7, 8], "alone": [9, 9, 9, 9]}
    edges = spark.createDataFrame([("hub", "a", 1.0), ("b", "hub", 2.0), ("a", "hub", 3.0), ("b", "b", 0.0)], "from_id string, to_id string, cost double")
    rows = {(r["sensor_id"], r["t"]): r for r in neighbour_features(grid(spark, speeds), edges).collect()}
    assert len(rows) == 16 and all(rows["alone", t]["near_count_1"] == 0 and rows["alone", t]["near_mean"] is None for t in range(4))
    r = rows["hub", 3]
    assert (r["near_count_1"], r["near_mean_1"], r["near_min_1"]) == (2, 5.0, 3.0) and (r["near_count_2"], r["near_mean_2"]) == (1, 6.0) and r["near_mean"] == (3 + 7 + 6 + 1 + 5) / 5
    later = {k: [*v[:3], 77] for k, v in speeds.items()}
    changed = {(r["sensor_id"], r["t"]): tuple(r) for r in neighbour_features(grid(spark, later), edges).collect()}
    assert changed == {k: tuple(r) for k, r in rows.items()}  # the last step is nobody's past
    star = spark.createDataFrame([("hub", f"n{i}", 1.0) for i in range(50)], "from_id string, to_id string, cost double")
    one, many = (sorted(map(tuple, neighbour_sums(grid(spark, {"hub": [10, 20, 0], **{f"n{i}": [i, 1, 1] for i in range(50)}}), star, **k).collect())) for k in ({}, {"hub": 3, "join_steps": 1}))
    assert one == many and ("hub", 0, 49, float(sum(range(50))), 1.0, 49.0) in one
    with pytest.raises(ValueError, match="past"):
        neighbour_features(grid(spark, speeds), edges, (0, 1))


def test_pairs_of_neighbours_never_become_rows_for_each_step(spark):
    """40 sensors next to one another over 64 steps are 99,840 pairs and steps; what is shuffled is a row for each sensor and step of a tile. Edges to unknown sensors go first."""
    names = [f"s{i:02d}" for i in range(40)]
    speeds = {n: [(i * 7 + t * 3) % 11 for t in range(64)] for i, n in enumerate(names)}
    edges = spark.createDataFrame([(a, b, 1.0) for a in names for b in names if a < b] + [("s00", f"unknown{i}", 1.0) for i in range(100)], "from_id string, to_id string, cost double")
    found = neighbour_sums(grid(spark, speeds), edges)
    assert "Generate explode" not in found._jdf.queryExecution().optimizedPlan().toString() and "FlatMapCoGroups" in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r["sensor_id"], r["t"]): (r["near_count"], r["near_sum"], r["near_min"], r["near_max"]) for r in found.collect()}
    wanted = {}
    for n in names:
        for t in range(64):
            near = [speeds[m][t] for m in names if m != n and speeds[m][t] > 0]
            wanted[n, t] = (len(near), sum(near), min(near), max(near))
    assert rows == wanted



def test_short_gaps_are_filled_from_the_past_only(spark):
    speeds = {"a": [0, 5, 0, 0, 0, 0, 7, 0]}
    periods = spark.createDataFrame([("a", False, t, 50.0 + t) for t in range(7)], "sensor_id string, is_weekend boolean, time_slot bigint, period_median_speed double")
    found = X.fill_short_gaps(grid(spark, speeds), periods, max_gap=2, chunk_steps=3).orderBy("t").collect()
    assert [(r["filled"], r["filled_from"], r["age"]) for r in found] == [
        (50.0, "period", None), (5.0, "read", 0), (5.0, "carried", 1), (5.0, "carried", 2), (54.0, "period", 3), (55.0, "period", 4), (7.0, "read", 0), (7.0, "carried", 1),
    ]
    for cut in range(1, 8):  # what comes later changes nothing
        short = X.fill_short_gaps(grid(spark, {"a": [*speeds["a"][:cut], *([99] * (8 - cut))]}), periods, max_gap=2, chunk_steps=3).orderBy("t").collect()
        assert [r["filled"] for r in short[:cut]] == [r["filled"] for r in found[:cut]]


def test_samples_are_those_of_a_whole_sort(spark):
    rows = spark.range(5000).withColumn("k", F.col("id").cast("string"))
    for n in (1, 10, 700, 4999, 5000, 9000):
        whole = rows.orderBy(F.md5(F.concat_ws("|", "k", F.lit("42"))), "k").limit(n)
        assert {r["id"] for r in exact_sample(rows, n, F.col("k")).collect()} == {r["id"] for r in whole.collect()}
    assert exact_sample(rows.limit(0), 5, F.col("k")).count() == 0


def test_group_errors_have_subtotals(spark):
    rows = [("a", "x", 0.9, 1), ("a", "y", 0.9, 0), ("b", "x", 0.2, 1), ("b", "x", 0.1, 0), ("b", None, 0.7, 1)]
    found = {(r["grouping"], r["s"], r["g"]): (r["tp"], r["fp"], r["fn"], r["tn"]) for r in group_errors(spark.createDataFrame(rows, "s string, g string, p double, y int"), [[], ["s"], ["g", "s"]], 0.5).collect()}
    assert found["", None, None] == (2, 1, 1, 1) and found["s", "b", None] == (1, 0, 1, 1) and found["g+s", "b", "x"] == (0, 0, 1, 1) and found["g+s", "b", None] == (1, 0, 0, 0)
    assert len(found) == 1 + 2 + 4
