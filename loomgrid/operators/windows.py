"""Windows over the dense grid that don't depend on how few or how long the sensors' series are.

A plain window partitioned by sensor puts a whole series into one task. Here a series is cut into chunks of
``chunk_steps`` steps, so that one sensor with a third of all rows still spreads over the cluster:

* ``with_halo`` gives each chunk copies of the neighbouring steps that bounded frames look at;
* ``last_at`` and ``next_at`` carry the nearest marked step over chunks through one row for each chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_STEPS = 4096


def chunk(chunk_steps: int) -> Column:
    return F.floor(F.col("t") / chunk_steps)


def with_halo(grid: DataFrame, back: int, ahead: int, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Columns ``chunk`` and ``own`` added; rows near a chunk's edge also appear, not owned, in the chunk beyond it."""
    if max(back, ahead) > chunk_steps:
        raise ValueError("a chunk must be longer than the frame")
    at = chunk(chunk_steps)
    inside = F.pmod(F.col("t"), F.lit(chunk_steps))
    copies = F.array(
        F.struct(at.alias("chunk"), F.lit(True).alias("own")),
        F.when(inside >= chunk_steps - back, F.struct((at + 1).alias("chunk"), F.lit(False).alias("own"))) if back else F.lit(None),
        F.when(inside < ahead, F.struct((at - 1).alias("chunk"), F.lit(False).alias("own"))) if ahead else F.lit(None),
    )
    return grid.withColumn("copy", F.explode(F.filter(copies, lambda c: c.isNotNull()))).select("*", "copy.chunk", "copy.own").drop("copy")


def by_time() -> Window:
    """Window of a chunk with its halo; drop the rows that aren't owned afterwards."""
    return Window.partitionBy("sensor_id", "chunk").orderBy("t")


def owned(table: DataFrame) -> DataFrame:
    return table.where("own").drop("own", "chunk")


def _carried(grid: DataFrame, marked: Column, name: str, forward: bool, chunk_steps: int, what: Column | None = None) -> DataFrame:
    step = F.when(marked, F.col("t") if what is None else what)
    pick = F.max if forward else F.min
    cut = grid.withColumn("chunk", chunk(chunk_steps))
    order = F.col("chunk") if forward else F.col("chunk").desc()
    edges = cut.groupBy("sensor_id", "chunk").agg(pick(step).alias("edge"))
    before = Window.partitionBy("sensor_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select("sensor_id", "chunk", pick("edge").over(before).alias("carried"))
    inner = Window.partitionBy("sensor_id", "chunk").orderBy(F.col("t") if forward else F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("near", pick(step).over(inner)).join(carried, ["sensor_id", "chunk"]).withColumn(name, F.coalesce("near", "carried")).drop("chunk", "near", "carried")


def last_at(grid: DataFrame, marked: Column, name: str, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """``name``: last marked step at or before each row; NULL where there is none."""
    return _carried(grid, marked, name, True, chunk_steps)


def next_at(grid: DataFrame, marked: Column, name: str, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """``name``: first marked step at or after each row; NULL where there is none."""
    return _carried(grid, marked, name, False, chunk_steps)


def last_value(grid: DataFrame, value: Column, name: str, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """``name``: struct of step ``t`` and ``value`` of the last row at or before each row whose value isn't NULL; NULL where there is none."""
    return _carried(grid, value.isNotNull(), name, True, chunk_steps, F.struct(F.col("t").alias("t"), value.alias("value")))


def runs(grid: DataFrame, flag: str, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Start, end and length in steps of the run of true ``flag`` around each row; NULL outside runs. Runs may touch either end of a series."""
    cut = grid.withColumn("chunk", chunk(chunk_steps)).withColumn("broken", F.when(~F.col(flag), F.col("t")))
    edges = cut.groupBy("sensor_id", "chunk").agg(F.max("broken").alias("last"), F.min("broken").alias("first"), F.min("t").alias("low"), F.max("t").alias("high"))
    along = Window.partitionBy("sensor_id").orderBy("chunk")  # a row for each chunk
    ahead, behind = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("sensor_id", "chunk", F.max("last").over(ahead).alias("carried"), F.min("first").over(behind).alias("coming"), F.min("low").over(whole).alias("first_t"), F.max("high").over(whole).alias("last_t"))
    inner = Window.partitionBy("sensor_id", "chunk").orderBy("t")
    near = cut.withColumn("before", F.max("broken").over(inner.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.min("broken").over(inner.rowsBetween(0, Window.unboundedFollowing)))
    near = near.join(edges, ["sensor_id", "chunk"])
    inside = lambda c: F.when(F.col(flag), c)
    start, end = F.coalesce(F.coalesce("before", "carried") + 1, "first_t"), F.coalesce(F.coalesce("after", "coming") - 1, "last_t")
    return near.select(*grid.columns, inside(start).alias("run_start"), inside(end).alias("run_end"), inside(end - start + 1).alias("run_steps"))


def run_table(grid: DataFrame, flag: str, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """One row for each run of true ``flag``: sensor_id, run_start, run_end, run_steps."""
    first = runs(grid, flag, chunk_steps).where(F.col(flag) & (F.col("t") == F.col("run_start")))
    return first.select("sensor_id", "run_start", "run_end", "run_steps")
