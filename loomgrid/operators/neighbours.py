"""Features of neighbouring sensors at past steps: the sensor graph times the readings, in tiles.

A tile is a chunk of steps, a block of about ``hub`` sensors and a block of their neighbours. Its task gets the edges between the two blocks and a row of readings
for each neighbour, and adds up in numpy, so a pair of neighbours never becomes a row for each step. What leaves a tile is a row for each of its sensors and steps
that has a reading next to it; a row of readings is copied once for each block that holds a neighbour of its sensor, never more often than it has neighbours.
Edges to sensors without cells are dropped before they are copied to the chunks. A tile holds at most a block of either side whatever the number of sensors,
steps or a hub's neighbours; blocks are by hash, as many as the edges' ends ask for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.columns import valid_speed
from loomgrid.functions.lineage import checkpoint
from loomgrid.operators.windows import by_time, owned, with_halo

JOIN_STEPS = 256
SUMS = "sensor_id string, t bigint, near_count bigint, near_sum double, near_min double, near_max double"


def both_ways(edges: DataFrame) -> DataFrame:
    """sensor_id and neighbour_id, each pair in both directions once; loops dropped."""
    one = edges.select(F.col("from_id").alias("sensor_id"), F.col("to_id").alias("neighbour_id"))
    return one.unionByName(one.select(F.col("neighbour_id").alias("sensor_id"), F.col("sensor_id").alias("neighbour_id"))).where("sensor_id != neighbour_id").distinct()


def tile_sums(steps: int):
    """Counts, sums, least and greatest of the neighbours' readings for each sensor and step of a tile; neighbours are added in the order of their names."""

    def run(pairs: pa.Table, series: pa.Table) -> pa.Table:
        if not pairs.num_rows or not series.num_rows:
            return pa.Table.from_pylist([], schema=OUT)
        names = series.column("neighbour_id").to_pylist()
        at = {n: i for i, n in enumerate(names)}
        values = np.full((len(names), steps), np.nan)
        for i, (ts, vs) in enumerate(zip(series.column("ts"), series.column("vs"), strict=True)):
            values[i, ts.values.to_numpy(zero_copy_only=False)] = vs.values.to_numpy(zero_copy_only=False)
        valid, whole = ~np.isnan(values), np.nan_to_num(values)
        met: dict[str, list[str]] = {}
        for s, n in zip(pairs.column("sensor_id").to_pylist(), pairs.column("neighbour_id").to_pylist(), strict=True):
            if n in at:
                met.setdefault(s, []).append(n)
        first, out = series.column("at_chunk")[0].as_py() * steps, []
        for s, near in met.items():
            rows = [at[n] for n in sorted(near)]
            count = valid[rows].sum(0)
            hit = np.flatnonzero(count)
            if len(hit):
                low, high = np.where(valid[rows], values[rows], np.inf).min(0), np.where(valid[rows], values[rows], -np.inf).max(0)
                columns = [pa.array([s] * len(hit)), hit + first, count[hit], whole[rows].sum(0)[hit], low[hit], high[hit]]
                out.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=OUT))
        return pa.Table.from_batches(out, schema=OUT)

    return run


OUT = pa.schema([("sensor_id", pa.string()), ("t", pa.int64()), ("near_count", pa.int64()), ("near_sum", pa.float64()), ("near_min", pa.float64()), ("near_max", pa.float64())])


def neighbour_sums(grid: DataFrame, edges: DataFrame, hub: int = 500, join_steps: int = JOIN_STEPS) -> DataFrame:
    """For each sensor and step with a valid reading next to it: how many, their sum, least and greatest. ``hub``: about how many sensors a block holds."""
    chunk = F.floor(F.col("t") / join_steps)
    cells = grid.select(F.col("sensor_id").alias("neighbour_id"), chunk.alias("chunk"), (F.col("t") - chunk * join_steps).cast("int").alias("step"), valid_speed(F.col("speed")).alias("v"))
    # a row for each sensor and chunk, in which readings are in the order of their steps; a sensor without a valid one has its row too
    packed = cells.groupBy("neighbour_id", "chunk").agg(F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("step", "v")))).alias("kept"))
    series = checkpoint(packed.select("neighbour_id", "chunk", F.col("kept.step").alias("ts"), F.col("kept.v").alias("vs")))
    known = series.select("neighbour_id").distinct()
    blocks = max(1, -(-known.count() // hub))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    pairs = both_ways(edges).join(known, "neighbour_id", "left_semi").join(known.select(F.col("neighbour_id").alias("sensor_id")), "sensor_id", "left_semi")
    pairs = checkpoint(pairs.select("sensor_id", "neighbour_id", block("sensor_id").alias("b"), block("neighbour_id").alias("nb")))
    chunks = series.select("chunk").distinct()
    links = pairs.join(F.broadcast(chunks), how="cross")  # a row for each chunk of steps
    wanted = pairs.select("neighbour_id", "b").distinct()
    sent = series.where(F.size("ts") > 0).join(wanted, "neighbour_id").select("neighbour_id", "ts", "vs", F.col("chunk").alias("at_chunk"), F.col("b").alias("to_b"), block("neighbour_id").alias("from_b"))
    tiles = links.groupBy("chunk", "b", "nb").cogroup(sent.groupBy("at_chunk", "to_b", "from_b")).applyInArrow(tile_sums(join_steps), SUMS)
    add = {"near_count": F.sum, "near_sum": F.sum, "near_min": F.min, "near_max": F.max}
    return tiles.groupBy("sensor_id", "t").agg(*(f(c).alias(c) for c, f in add.items()))


def neighbour_features(grid: DataFrame, edges: DataFrame, lags: tuple[int, ...] = (1, 2, 3), **sizes: int) -> DataFrame:
    """Every cell with its neighbours' count, mean and least speed ``k`` steps before (k of ``lags``, at least 1), and the mean over all these steps.

    Counts are 0 and speeds NULL where no neighbour had a valid reading. Neither the cell's own step nor a later one is looked at.
    """
    if min(lags) < 1:
        raise ValueError("neighbours may be looked at in past steps only")
    known = grid.join(neighbour_sums(grid, edges, **sizes), ["sensor_id", "t"], "left")
    w = by_time()
    back = lambda c, k: F.lag(c, k).over(w)
    columns = {}
    for k in lags:
        columns |= {f"near_count_{k}": F.coalesce(back("near_count", k), F.lit(0).cast("bigint")), f"near_mean_{k}": back("near_sum", k) / back("near_count", k), f"near_min_{k}": back("near_min", k)}
    total = lambda c: sum((F.coalesce(back(c, k), F.lit(0)) for k in lags[1:]), F.coalesce(back(c, lags[0]), F.lit(0)))
    columns["near_mean"] = F.try_divide(total("near_sum"), total("near_count"))
    cells = with_halo(known, max(lags), 0).select("*", *(c.alias(n) for n, c in columns.items()))
    return owned(cells).select("sensor_id", "ts", "t", *columns)
