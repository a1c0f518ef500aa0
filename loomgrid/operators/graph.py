"""Sensor graph: pruned edges, and values of places carried over to edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.columns import number, percent_band


def locations(table: DataFrame) -> DataFrame:
    """sensor_id and numeric place, rows without a place dropped, the first of repeated ids kept (by latitude, longitude)."""
    rows = table.select("sensor_id", number(F.col("latitude")).alias("latitude"), number(F.col("longitude")).alias("longitude")).dropna()
    first = F.row_number().over(Window.partitionBy("sensor_id").orderBy("latitude", "longitude"))
    return rows.withColumn("k", first).where("k = 1").drop("k")


def sensor_edges(edges: DataFrame, vertices: DataFrame, max_cost: float = 3000.0, neighbours: int = 2) -> DataFrame:
    """The ``neighbours`` cheapest edges of each source, then those within ``max_cost``, each pair once at its lowest cost.

    The order of these steps matters. Ids compare as text.
    """
    known = vertices.select("sensor_id").distinct()
    kept = edges.where("from_id != to_id and cost is not null")
    for end in ("from_id", "to_id"):
        kept = kept.join(known.withColumnRenamed("sensor_id", end), end, "left_semi")
    nearest = F.row_number().over(Window.partitionBy("from_id").orderBy("cost", "to_id"))
    near = kept.withColumn("k", nearest).where(F.col("k") <= neighbours).where(F.col("cost") <= max_cost)
    return near.groupBy(F.least("from_id", "to_id").alias("a_id"), F.greatest("from_id", "to_id").alias("b_id")).agg(F.min("cost").alias("cost"))


def corridor_bands(edges: DataFrame, values: DataFrame, places: DataFrame) -> DataFrame:
    """Edges with both ends' places, the mean of the ends' percentages, and its band."""
    ends = values.join(places, "sensor_id")
    side = lambda s: ends.select(F.col("sensor_id").alias(f"{s}_id"), *(F.col(c).alias(f"{s}_{c}") for c in ("percent", "latitude", "longitude")))
    both = edges.join(side("a"), "a_id").join(side("b"), "b_id")
    mean = (F.col("a_percent") + F.col("b_percent")) / 2
    return both.select("a_id", "b_id", F.round("cost", 6).alias("cost"), F.round(mean, 6).alias("percent"), percent_band(mean).alias("band"))


def map_centre(places: DataFrame) -> DataFrame:
    return places.agg(F.round(F.avg("latitude"), 6).alias("latitude"), F.round(F.avg("longitude"), 6).alias("longitude"))


def one_place_each(places: DataFrame) -> DataFrame:
    """The table itself, or a ValueError where a sensor has several places, which a join would turn into several rows."""
    repeated = places.groupBy("sensor_id").count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"sensor {repeated[0]['sensor_id']} has several places")
    return places


def ordered_lookup(sensors: DataFrame, places: DataFrame) -> DataFrame:
    """Places in the order of the sensors' ids (numbers by value), NULL for sensors without one; repeated places are an error."""
    return sensors.join(one_place_each(places), "sensor_id", "left").orderBy(F.length("sensor_id"), "sensor_id")


def key_differences(a: DataFrame, b: DataFrame, key: str = "sensor_id") -> DataFrame:
    """Keys of one table only, and of which."""
    left = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("only_in", F.lit("a"))
    right = b.select(key).distinct().join(a.select(key).distinct(), key, "left_anti").withColumn("only_in", F.lit("b"))
    return left.unionByName(right)
