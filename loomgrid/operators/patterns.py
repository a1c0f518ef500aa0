"""Grouped profiles of valid speeds: by hour, weekday, day type, day and sensor, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.columns import congested, day_of_week, hour, is_weekend, ratio, valid_speed, weekday_name
from loomgrid.operators.graph import one_place_each
from loomgrid.operators.quantiles import exact_quantiles, many_quantiles
from loomgrid.operators.windows import run_table

THRESHOLDS = (0.50, 0.60, 0.70)


def with_calendar(grid: DataFrame) -> DataFrame:
    """The grid with valid speed v, hour, day_of_week (Monday 0), is_weekend and date."""
    ts = F.col("ts")
    return grid.select("*", valid_speed(F.col("speed")).alias("v"), hour(ts).alias("hour"), day_of_week(ts).alias("day_of_week"), is_weekend(ts).alias("is_weekend"), F.to_date("ts").alias("date"))


def _profile(rows: DataFrame, keys: list[str], *quantiles: float, more: list[Column] = ()) -> DataFrame:
    """Counts, mean and quantiles of valid speeds; the quantiles of the few large groups are taken apart from the other aggregates."""
    counts = rows.groupBy(*keys).agg(F.count("v").alias("valid_count"), F.count("*").alias("total_count"), F.avg("v").alias("mean"), *more)
    return counts.join(exact_quantiles(rows, keys, F.col("v"), list(quantiles)), keys, "left")


def _r(c: Column | str, name: str) -> Column:
    return F.round(c, 6).alias(name)


def _rq(c: Column | str, name: str) -> Column:
    """A quantile to six places. Readings have six, so a quantile is often a tie, of which doubles lie on either side; nine decimal places hold it exactly, and ties go up."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.round(c.try_cast("decimal(38,9)"), 6).cast("double"), c).alias(name)


def _missing() -> Column:
    return _r(1 - F.try_divide(F.col("valid_count"), F.col("total_count")), "missing_rate")


def hourly_pattern(grid: DataFrame) -> DataFrame:
    cells = with_calendar(grid)
    counts = cells.groupBy("hour").agg(F.count("v").alias("valid_count"), F.count("*").alias("total_count"), F.avg("v").alias("mean"), F.avg("speed").alias("mean_zero"))
    rows = counts.join(many_quantiles(cells, ["hour"], {"q": (F.col("v"), [0.1, 0.5, 0.9]), "z": (F.col("speed"), [0.5])}), "hour", "left").withColumn("median_zero", F.col("z")[0])
    return rows.select("hour", "valid_count", "total_count", _missing(), _r("mean", "mean_speed"), _rq(F.col("q")[1], "median_speed"), _rq(F.col("q")[0], "p10_speed"), _rq(F.col("q")[2], "p90_speed"), _r("mean_zero", "mean_with_zero"), _rq("median_zero", "median_with_zero"))


def weekday_hour_pattern(grid: DataFrame) -> DataFrame:
    rows = _profile(with_calendar(grid), ["day_of_week", "hour"], 0.5)
    return rows.select("day_of_week", weekday_name(F.col("day_of_week")).alias("weekday"), "hour", "valid_count", "total_count", _missing(), _r("mean", "mean_speed"), _rq(F.col("q")[0], "median_speed"))


def day_type_hour_pattern(grid: DataFrame) -> DataFrame:
    """Always 48 rows; hours without readings have counts 0 and NULL speeds."""
    spine = grid.sparkSession.range(48).select(F.when(F.col("id") < 24, "Weekday").otherwise("Weekend").alias("day_type"), (F.col("id") % 24).alias("hour"))
    rows = _profile(with_calendar(grid).withColumn("day_type", F.when(F.col("is_weekend"), "Weekend").otherwise("Weekday")), ["day_type", "hour"], 0.1, 0.5, 0.9)
    full = spine.join(rows, ["day_type", "hour"], "left").fillna(0, ["valid_count", "total_count"])
    return full.select("day_type", "hour", "valid_count", "total_count", _r("mean", "mean_speed"), _rq(F.col("q")[1], "median_speed"), _rq(F.col("q")[0], "p10_speed"), _rq(F.col("q")[2], "p90_speed"))


def daily_trend(grid: DataFrame) -> DataFrame:
    rows = _profile(with_calendar(grid), ["date"], 0.5, more=[F.avg("speed").alias("mean_zero")])
    return rows.select("date", "valid_count", "total_count", _missing(), _r("mean", "mean_speed"), _rq(F.col("q")[0], "median_speed"), _r("mean_zero", "mean_with_zero"))


def free_flow(grid: DataFrame, quantile: float = 0.85) -> DataFrame:
    """Exact quantile of each sensor's valid speeds."""
    if not 0 < quantile < 1:
        raise ValueError("quantile must lie between 0 and 1")
    return grid.groupBy("sensor_id").agg(F.percentile(valid_speed(F.col("speed")), quantile).alias("free_flow"))


def with_ratio(grid: DataFrame, flow: DataFrame) -> DataFrame:
    """Valid speed v and its ratio to the sensor's free flow."""
    return grid.join(flow, "sensor_id", "left").withColumn("v", valid_speed(F.col("speed"))).withColumn("ratio", ratio(F.col("v"), F.col("free_flow")))


def _hits(thresholds: tuple[float, ...]) -> list[Column]:
    return [F.count_if(congested(F.col("ratio"), t)).alias(f"n{round(t * 100)}") for t in thresholds]


def _rates(thresholds: tuple[float, ...]) -> list[Column]:
    return [_r(F.try_divide(F.col(f"n{round(t * 100)}"), F.col("valid_count")), f"congestion_rate_{round(t * 100)}") for t in thresholds]


def congestion_rates(grid: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Share of valid readings of each sensor below each share of free flow."""
    rows = with_ratio(grid, free_flow(grid)).groupBy("sensor_id").agg(F.count("v").alias("valid_count"), *_hits(thresholds))
    return rows.select("sensor_id", "valid_count", *_rates(thresholds))


def run_events(grid: DataFrame, threshold: float = 0.60, step_minutes: int = 60) -> DataFrame:
    """Number, mean and longest duration of each sensor's congested runs; zeros for a sensor that has none."""
    sensors = grid.select("sensor_id").distinct()
    return sensors.join(_run_stats(with_ratio(grid, free_flow(grid)), threshold, step_minutes), "sensor_id", "left").select("sensor_id", *_run_stats_columns())


def _run_stats_columns() -> list[Column]:
    """Run events of a sensor; zeros for one without runs."""
    return [F.coalesce("runs", F.lit(0)).alias("event_count"), F.round(F.coalesce("mean_run", F.lit(0.0)), 6).alias("mean_event_minutes"), F.coalesce("longest_run", F.lit(0)).cast("bigint").alias("max_event_minutes")]


def _run_stats(rated: DataFrame, threshold: float, step_minutes: int) -> DataFrame:
    state = rated.select("sensor_id", "t", congested(F.col("ratio"), threshold).alias("congested"))
    minutes = F.col("run_steps") * step_minutes
    return run_table(state, "congested").groupBy("sensor_id").agg(F.count("*").alias("runs"), F.avg(minutes).alias("mean_run"), F.max(minutes).alias("longest_run"))


def sensor_risk(grid: DataFrame, locations: DataFrame | None = None, step_minutes: int = 60) -> DataFrame:
    """Coverage, speeds, congestion rates and run events of each sensor, with its place if locations are given (a ValueError where a sensor has several)."""
    rated = with_ratio(grid, free_flow(grid))
    base = rated.groupBy("sensor_id").agg(F.count("*").alias("total"), F.count("v").alias("valid_count"), F.avg("v").alias("mean"), F.percentile("v", [0.1, 0.5, 0.85]).alias("q"), F.stddev_pop("v").alias("std"), *_hits(THRESHOLDS))
    rows = base.select("*", *_rates(THRESHOLDS)).join(_run_stats(rated, 0.60, step_minutes), "sensor_id", "left").select("*", *_run_stats_columns())
    if locations is not None:
        rows = rows.join(one_place_each(locations), "sensor_id", "left")
    place = ["latitude", "longitude"] if locations is not None else []
    return rows.select(
        "sensor_id", _r(F.try_divide(F.col("valid_count"), F.col("total")), "coverage_rate"), _r(F.col("q")[2], "free_flow_speed"), _r("mean", "mean_speed"), _r(F.col("q")[1], "median_speed"), _r(F.col("q")[0], "p10_speed"), _r("std", "std_speed"),
        *(f"congestion_rate_{round(t * 100)}" for t in THRESHOLDS), "event_count", "mean_event_minutes", "max_event_minutes", *place,
    )


def coverage_topk(risk: DataFrame, k: int = 15, min_coverage: float = 0.75) -> DataFrame:
    """The most congested sensors among those with enough readings."""
    return risk.where(F.col("coverage_rate") >= min_coverage).orderBy(F.desc("congestion_rate_60"), "sensor_id").limit(k)


def slowest_hours(hourly: DataFrame, n: int = 1) -> DataFrame:
    return hourly.orderBy("median_speed", "hour").limit(n)


def spearman(risk: DataFrame, min_coverage: float = 0.75) -> DataFrame:
    """Rank correlation of congestion rates at neighbouring thresholds, ties at their mean rank. Ranks are over sensors, not readings."""
    kept = risk.where(F.col("coverage_rate") >= min_coverage)

    def ranked(c: str) -> Column:
        order = Window.orderBy(c)
        return F.rank().over(order) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2

    ranks = kept.select(*(ranked(f"congestion_rate_{n}").alias(f"r{n}") for n in (50, 60, 70)))
    return ranks.agg(F.round(F.corr("r50", "r60"), 6).alias("spearman_50_60"), F.round(F.corr("r60", "r70"), 6).alias("spearman_60_70"))


def zero_sensitivity(grid: DataFrame) -> DataFrame:
    """Mean and largest gap between means without and with zeros, by hour and by day."""
    v = F.col("v")
    gap = (F.avg(v) - F.avg("speed")).alias("gap")
    cells = with_calendar(grid)
    both = cells.groupBy("hour").agg(gap).select(F.lit("hour").alias("by"), "gap").unionByName(cells.groupBy("date").agg(gap).select(F.lit("day").alias("by"), "gap"))
    return both.groupBy("by").agg(F.round(F.avg("gap"), 6).alias("mean_gap"), F.round(F.max("gap"), 6).alias("max_gap"))


def rush_hour_gap(grid: DataFrame, first: int = 7, last: int = 9) -> DataFrame:
    """Mean of hourly median speeds from ``first`` to ``last`` on working days and at weekends, and their difference."""
    hours = day_type_hour_pattern(grid).where(F.col("hour").between(first, last))
    mean = lambda d: F.avg(F.when(F.col("day_type") == d, F.col("median_speed")))
    return hours.agg(F.round(mean("Weekday"), 6).alias("weekday_speed"), F.round(mean("Weekend"), 6).alias("weekend_speed"), F.round(mean("Weekend") - mean("Weekday"), 6).alias("gap"))


def weekday_pivot(grid: DataFrame) -> DataFrame:
    """Median speed with a row for each weekday and a column for each hour."""
    rows = weekday_hour_pattern(grid)
    wide = rows.groupBy("day_of_week").pivot("hour", list(range(24))).agg(F.first("median_speed"))
    return wide.select("day_of_week", *(F.col(str(h)).alias(f"h{h:02d}") for h in range(24)))
