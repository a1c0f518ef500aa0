"""Quality flags of readings, their summary, and the audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.columns import hour, day_of_week, is_weekend, valid_speed
from loomgrid.operators.quantiles import exact_quantiles
from loomgrid.operators.windows import by_time, owned, run_table, runs, with_halo
from loomgrid.sources.grid import time_of


def zero_share(grid: DataFrame, majority: float = 0.5) -> DataFrame:
    """For each timestamp: sensors, zeros, and whether all or most sensors are zero."""
    counts = grid.groupBy("ts", "t").agg(F.count_if(F.col("speed") == 0).alias("zeros"), F.count("*").alias("sensors"))
    return counts.select("ts", "t", "zeros", "sensors", (F.col("zeros") == F.col("sensors")).alias("is_systemwide_zero"), (F.col("zeros") >= F.ceil(F.col("sensors") * majority)).alias("is_majority_zero"))


def large_jumps(grid: DataFrame, jump: float = 40.0) -> DataFrame:
    """Raw change above ``jump`` from the step before (never at a first row), and whether either side is zero."""
    near = with_halo(grid, 1, 0)
    before = F.lag("speed").over(by_time())
    flagged = near.withColumn("before", before)
    leap = F.coalesce(F.abs(F.col("speed") - F.col("before")) > jump, F.lit(False))
    return owned(flagged.withColumn("is_large_jump", leap).withColumn("is_large_jump_from_zero", F.col("is_large_jump") & ((F.col("speed") == 0) | (F.col("before") == 0))).drop("before"))


def long_zero_runs(grid: DataFrame, min_steps: int = 12) -> DataFrame:
    """All cells of a run of at least ``min_steps`` zeros are flagged."""
    found = runs(grid.withColumn("is_zero_observation", F.col("speed") == 0), "is_zero_observation")
    return found.withColumn("is_long_sensor_zero_run", F.coalesce(F.col("run_steps") >= min_steps, F.lit(False))).drop("run_start", "run_end", "run_steps")


def quality_flags(grid: DataFrame, majority: float = 0.5, min_steps: int = 12, jump: float = 40.0) -> DataFrame:
    """The six flags of every cell; a flag never changes the reading."""
    cells = long_zero_runs(large_jumps(grid, jump), min_steps)
    return cells.join(zero_share(grid, majority).drop("ts", "zeros", "sensors"), "t")


def clean_long(grid: DataFrame, locations: DataFrame, **options) -> DataFrame:
    """The cleaned long table: raw and valid speed, calendar, location and flags."""
    placed = quality_flags(grid, **options).join(locations.select("sensor_id", "latitude", "longitude"), "sensor_id", "left")
    return placed.select(
        "ts", "sensor_id", F.col("speed").cast("float").alias("speed_raw"), valid_speed(F.col("speed")).cast("float").alias("speed_valid"), hour(F.col("ts")).cast("tinyint").alias("hour"),
        day_of_week(F.col("ts")).cast("tinyint").alias("day_of_week"), is_weekend(F.col("ts")).alias("is_weekend"), F.col("latitude").cast("float").alias("latitude"), F.col("longitude").cast("float").alias("longitude"),
        "is_zero_observation", "is_systemwide_zero", "is_majority_zero", "is_long_sensor_zero_run", "is_large_jump", "is_large_jump_from_zero",
        (F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("has_valid_location"),
    )


def quality_summary(flags: DataFrame) -> DataFrame:
    """Totals and rates over all cells, one row."""
    n = lambda c: F.count_if(c)
    zero, jump, from_zero = F.col("is_zero_observation"), F.col("is_large_jump"), F.col("is_large_jump_from_zero")
    return flags.agg(
        F.count("*").alias("cells"), n(valid_speed(F.col("speed")).isNotNull()).alias("valid_cells"), n(zero).alias("zero_cells"), F.round(F.try_divide(n(zero), F.count("*")), 6).alias("zero_rate"),
        F.count_distinct(F.when(F.col("is_systemwide_zero"), F.col("t"))).alias("systemwide_timestamps"), F.count_distinct(F.when(F.col("is_majority_zero"), F.col("t"))).alias("majority_timestamps"),
        n(F.col("is_long_sensor_zero_run")).alias("long_run_cells"), n(jump).alias("large_jumps"), n(from_zero).alias("large_jumps_from_zero"), n(jump & ~from_zero).alias("positive_large_jumps"),
    )


def sensor_audit(grid: DataFrame, jump: float = 40.0) -> DataFrame:
    """Profile of each sensor's raw readings; sample standard deviation; exact quantiles."""
    jumps = large_jumps(grid, jump).groupBy("sensor_id").agg(F.count_if("is_large_jump").alias("large_jumps"))
    longest = run_table(grid.withColumn("is_zero", F.col("speed") == 0), "is_zero").groupBy("sensor_id").agg(F.max("run_steps").alias("longest"))
    q = F.percentile("speed", [0.01, 0.5, 0.99])
    profile = grid.groupBy("sensor_id").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("speed").isNull() | F.isnan("speed")).alias("missing"), F.count_if(F.col("speed") == 0).alias("zeros"), F.count_if(F.col("speed") < 0).alias("negatives"),
        F.min("speed").alias("min"), q.alias("q"), F.avg("speed").alias("mean"), F.max("speed").alias("max"), F.stddev_samp("speed").alias("std"), F.count_distinct("speed").alias("distinct_values"),
    )
    r = lambda c: F.round(c, 6)
    return profile.join(jumps, "sensor_id").join(longest, "sensor_id", "left").select(
        "sensor_id", "n_rows", "missing", "zeros", "negatives", r(F.col("zeros") / F.col("n_rows")).alias("zero_rate"), r("min").alias("min"), r(F.col("q")[0]).alias("p01"), r(F.col("q")[1]).alias("median"),
        r("mean").alias("mean"), r(F.col("q")[2]).alias("p99"), r("max").alias("max"), r("std").alias("std"), F.coalesce("longest", F.lit(0)).cast("bigint").alias("longest_zero_run"), "large_jumps", "distinct_values",
    )


def zero_run_audit(grid: DataFrame, step_seconds: int = 3600) -> DataFrame:
    """Runs of zeros of each sensor, longest first."""
    found = run_table(grid.withColumn("is_zero", F.col("speed") == 0), "is_zero")
    return found.select("sensor_id", time_of(F.col("run_start"), step_seconds).alias("start_ts"), time_of(F.col("run_end"), step_seconds).alias("end_ts"), F.col("run_steps").alias("steps"), (F.col("run_steps") * step_seconds / 60).cast("bigint").alias("minutes")).orderBy(F.desc("steps"), "start_ts", "sensor_id")


def systemwide_runs(grid: DataFrame, step_seconds: int = 3600, majority: bool = False) -> DataFrame:
    """Runs of timestamps at which all (or most) sensors are zero."""
    flag = "is_majority_zero" if majority else "is_systemwide_zero"
    found = run_table(zero_share(grid).select(F.lit("all").alias("sensor_id"), "t", flag), flag)
    return found.select(time_of(F.col("run_start"), step_seconds).alias("start_ts"), time_of(F.col("run_end"), step_seconds).alias("end_ts"), F.col("run_steps").alias("steps"), (F.col("run_steps") * step_seconds / 60).cast("bigint").alias("minutes"))


def top_zero_timestamps(grid: DataFrame, n: int = 100) -> DataFrame:
    return zero_share(grid).select("ts", "zeros", F.round(F.col("zeros") / F.col("sensors"), 6).alias("zero_share")).orderBy(F.desc("zeros"), "ts").limit(n)


def interval_counts(times: DataFrame) -> DataFrame:
    """Histogram of the microseconds between following distinct timestamps; ``times`` has ts. Days are joined through their last timestamp."""
    stamps = times.select("ts").distinct().withColumn("day", F.to_date("ts"))
    inner = F.lag("ts").over(Window.partitionBy("day").orderBy("ts"))
    days = stamps.groupBy("day").agg(F.max("ts").alias("last"))
    earlier = days.select("day", F.lag("last").over(Window.orderBy("day")).alias("last_before"))  # one row for each day
    steps = stamps.withColumn("before", inner).join(earlier, "day").withColumn("before", F.coalesce("before", "last_before")).where("before is not null")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))
    return steps.groupBy(micros.alias("micros")).agg(F.count("*").alias("n"))


def global_quantiles(grid: DataFrame, equal_to: float = 70.0) -> DataFrame:
    """Quantiles of valid readings, readings equal to a value, days, and rows of the shortest and longest day."""
    v = valid_speed(F.col("speed"))
    q = exact_quantiles(grid.select(F.lit(1).alias("all"), v.alias("v")), ["all"], F.col("v"), [0.01, 0.05, 0.95, 0.99])
    days = grid.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).agg(F.count("*").alias("days"), F.min("n").alias("min_day_rows"), F.max("n").alias("max_day_rows"))
    whole = grid.agg(F.lit(1).alias("all"), F.count_if(F.col("speed") == equal_to).alias("equal_count")).join(q, "all", "left")
    return whole.crossJoin(days).select(*(F.round(F.col("q")[i], 6).alias(f"p{p}") for i, p in enumerate(("01", "05", "95", "99"))), "equal_count", "days", "min_day_rows", "max_day_rows")  # both sides are one row
