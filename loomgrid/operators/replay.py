"""Views for replaying history: last rows, heat maps, recent windows, risk bands of rows."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.columns import risk_band


def replay_tail(rows: DataFrame, n: int = 288) -> DataFrame:
    """The last ``n`` rows of each sensor."""
    last = F.row_number().over(Window.partitionBy("sensor_id").orderBy(F.desc("t")))
    return rows.withColumn("k", last).where(F.col("k") <= n).drop("k")


def recent_window(rows: DataFrame, sensor_id: str, until: datetime.datetime, n: int = 13) -> DataFrame:
    """One sensor's last ``n`` rows up to a time, in time order. Of a stored table both filters reach the scan; of a grid, whose columns are made, none can."""
    return rows.where((F.col("sensor_id") == sensor_id) & (F.col("ts") <= F.lit(until).cast("timestamp_ntz"))).orderBy(F.desc("ts")).limit(n).orderBy("ts")


def heatmap_cells(rows: DataFrame, value: str = "target") -> DataFrame:
    """Mean of ``value`` by date, sensor and hour."""
    return rows.groupBy(F.to_date("ts").alias("date"), "sensor_id", F.hour("ts").cast("bigint").alias("hour")).agg(F.avg(value).alias("rate"))


def heatmap_top(cells: DataFrame, k: int = 40) -> DataFrame:
    """For each date, the ``k`` sensors with the highest mean over the hours that any sensor has that day (0 where it has none)."""
    hours = cells.groupBy("date").agg(F.count_distinct("hour").alias("hours"))
    means = cells.groupBy("date", "sensor_id").agg(F.sum("rate").alias("total")).join(hours, "date").withColumn("mean_rate", F.col("total") / F.col("hours"))
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(F.round("mean_rate", 9)), "sensor_id"))
    return means.withColumn("place", rank).where(F.col("place") <= k).select("date", "sensor_id", F.round("mean_rate", 6).alias("mean_rate"), F.col("place").cast("bigint").alias("place"))


def heatmap_pivot(cells: DataFrame) -> DataFrame:
    """A row for each date and sensor, a column for each hour, 0 where there is no cell."""
    wide = cells.groupBy("date", "sensor_id").pivot("hour", list(range(24))).agg(F.first("rate"))
    return wide.select("date", "sensor_id", *(F.round(F.coalesce(F.col(str(h)), F.lit(0.0)), 6).alias(f"h{h:02d}") for h in range(24)))


def banded(rows: DataFrame, probability: str = "p") -> DataFrame:
    return rows.withColumn("risk", risk_band(F.col(probability)))


def distinct_dates(grid: DataFrame) -> DataFrame:
    """The dates that a replay can start at, in their order."""
    return grid.select(F.to_date("ts").alias("date")).distinct().orderBy("date")
