"""Dense grid of readings: one row for every sensor and step, zero where nothing was read.

Columns: sensor_id (text, never a number), ts (timestamp without zone), t (number of the step since the epoch), speed.
Window operators count rows, so they need this grid; ``check_grid`` tells whether a table is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def readings(events: DataFrame, step_seconds: int = 3600, per_sensor: int = 30) -> DataFrame:
    """Mean event value by sensor and step; users are folded onto one sensor for each ``per_sensor`` of them."""
    users = events.agg(F.greatest(F.lit(1), F.floor(F.count_distinct("user_id") / per_sensor)).alias("n"))
    step = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (step_seconds * 1_000_000))
    folded = events.crossJoin(F.broadcast(users)).select((F.col("user_id") % F.col("n")).cast("string").alias("sensor_id"), step.alias("t"), "value")  # users: one row
    return folded.groupBy("sensor_id", "t").agg(F.round(F.avg("value"), 6).alias("speed"))


def time_of(t, step_seconds: int):
    return F.timestamp_seconds(t * step_seconds).cast("timestamp_ntz")


def densify(found: DataFrame, step_seconds: int = 3600) -> DataFrame:
    """All steps from the first to the last for every sensor; readings that are absent are 0."""
    span = found.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    spine = found.select("sensor_id").distinct().crossJoin(F.broadcast(span)).select("sensor_id", F.explode(F.sequence("lo", "hi")).alias("t"))  # span: one row
    full = spine.join(found, ["sensor_id", "t"], "left")
    return full.select("sensor_id", time_of(F.col("t"), step_seconds).alias("ts"), "t", F.coalesce("speed", F.lit(0.0)).alias("speed"))


def long_form(wide: DataFrame, ts: str, sensors: list[str]) -> DataFrame:
    """A column for each sensor turned into rows."""
    return wide.unpivot([ts], sensors, "sensor_id", "speed")


def check_grid(observations: DataFrame, step_seconds: int) -> DataFrame:
    """One row: rows, sensors, steps, repeated keys, intervals other than one step, and whether it is a full grid."""
    times = observations.select("ts").distinct()
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = times.agg(F.count("*").alias("steps"), ((F.max(micros) - F.min(micros)) / (step_seconds * 1_000_000) + 1).alias("steps_expected"), F.count_if(micros % (step_seconds * 1_000_000) != 0).alias("off_step"))
    keys = observations.groupBy("ts", "sensor_id").count().agg(F.sum("count").alias("n_rows"), F.count("*").alias("keys"), F.count_distinct("sensor_id").alias("sensors"))
    return keys.crossJoin(span).select(  # both sides are one row
        "n_rows", "sensors", "steps", (F.col("n_rows") - F.col("keys")).alias("repeated_keys"), (F.col("steps_expected") - F.col("steps")).cast("bigint").alias("missing_steps"),
        ((F.col("n_rows") == F.col("keys")) & (F.col("steps") == F.col("steps_expected")) & (F.col("off_step") == 0) & (F.col("keys") == F.col("sensors") * F.col("steps"))).alias("is_grid"),
    )


def require_grid(observations: DataFrame, step_seconds: int) -> DataFrame:
    """The table itself, or a ValueError that says what is wrong."""
    found = check_grid(observations, step_seconds).first()
    if found["repeated_keys"]:
        raise ValueError(f"{found['repeated_keys']} repeated (timestamp, sensor) keys")
    if not found["is_grid"]:
        raise ValueError(f"intervals other than {step_seconds} seconds, or missing cells")
    return observations


def event_grid(spark: SparkSession, sf_dir: str, step_seconds: int = 3600, per_sensor: int = 30) -> DataFrame:
    """Hourly grid of the ``events`` table, as ``densify(readings(events))`` gives it, from one scan and one shuffle.

    The span of steps and the number of sensors are four numbers and come first; so the empty cells are known without the
    readings, and meet them in the aggregation that takes the means.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "value").where("ts is not null and user_id is not null")
    step = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (step_seconds * 1_000_000))
    users, least, lo, hi = events.agg(F.count_distinct("user_id"), F.min("user_id"), F.min(step), F.max(step)).first()
    n = max(1, (users or 0) // per_sensor)
    cells = events.select((F.col("user_id") % n).alias("sensor"), step.alias("t"), "value")
    sensors = spark.range(n).select(F.col("id").alias("sensor"))
    if users and (least < 0 or cells.agg(F.count_distinct("sensor")).first()[0] < n):  # some remainders don't occur
        sensors = cells.select("sensor").distinct()
    span = F.sequence(F.lit(lo).cast("bigint"), F.lit(hi).cast("bigint"))
    empty = sensors.select("sensor", F.explode(span).alias("t"), F.lit(None).cast("double").alias("value"))
    means = cells.unionByName(empty if users else empty.limit(0)).groupBy(F.col("sensor").cast("string").alias("sensor_id"), "t").agg(F.round(F.avg("value"), 6).alias("speed"))
    return means.select("sensor_id", time_of(F.col("t"), step_seconds).alias("ts"), "t", F.coalesce("speed", F.lit(0.0)).alias("speed"))
