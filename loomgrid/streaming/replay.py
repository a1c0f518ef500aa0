"""Historical replay as a stream: readings in, watermarked window means out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READINGS = "ts timestamp, sensor_id string, speed double"


def readings_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream of readings."""
    return spark.readStream.schema(READINGS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def window_means(readings: DataFrame, step: str = "5 minutes", late: str = "15 minutes") -> DataFrame:
    """Mean valid speed and readings of each sensor and step; readings later than ``late`` are dropped by the watermark."""
    marked = readings.withWatermark("ts", late)
    return marked.groupBy(F.window("ts", step), "sensor_id").agg(F.avg(F.when(F.col("speed") > 0, F.col("speed"))).alias("speed"), F.count("*").alias("n")).select(F.col("window.start").alias("ts"), "sensor_id", "speed", "n")
