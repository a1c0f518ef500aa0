"""Lag, rolling, trend and calendar features, forward labels, and the model table.

All windows of a cell look at the same chunk with its halo, so one shuffle and one sort serve them all; only the
decline counter looks back without limit and is carried over chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.columns import congested, cyclic, day_of_week, hour, is_weekend, slot_of_day, valid_speed
from loomgrid.functions.lineage import checkpoint
from loomgrid.operators.patterns import with_ratio
from loomgrid.operators.split import Segment, period_stats, segment_column, train_stats
from loomgrid.operators.windows import CHUNK_STEPS, by_time, last_at, last_value, owned, with_halo

LAGS = (1, 2, 3, 6, 12)
ROLLS = (3, 6, 12)
TRENDS = (2, 3, 6)


def lags() -> dict[str, Column]:
    return {f"ratio_lag_{k}": F.lag("ratio", k).over(by_time()) for k in LAGS}


def rolling() -> dict[str, Column]:
    """Mean, minimum and population deviation of v over the last k rows, NULL unless all are valid."""
    out = {}
    for k in ROLLS:
        w = by_time().rowsBetween(-(k - 1), 0)
        full = F.count("v").over(w) == k
        out |= {f"speed_mean_{k}": F.when(full, F.avg("v").over(w)), f"speed_min_{k}": F.when(full, F.min("v").over(w)), f"speed_std_{k}": F.when(full, F.stddev_pop("v").over(w))}
    return out


def trends(step_minutes: int) -> dict[str, Column]:
    out = {f"trend_{k}": (F.col("v") - F.lag("v", k).over(by_time())) / (k * step_minutes) for k in TRENDS}
    return out | {"speed_change": F.col("v") - F.lag("v", 1).over(by_time())}


def history_complete(steps: int = 12) -> Column:
    """All of the ``steps`` rows before and the present one are valid."""
    return F.count("v").over(by_time().rowsBetween(-steps, 0)) == steps + 1


def future_counts(threshold: float, steps: int = 6) -> tuple[Column, Column]:
    """(Congested among the next ``steps`` rows, -1 where fewer remain; whether all of them are valid)."""
    w = by_time().rowsBetween(1, steps)
    remain = F.count("*").over(w) == steps
    return F.when(remain, F.count_if(congested(F.col("ratio"), threshold)).over(w)).otherwise(-1), F.count("v").over(w) == steps


def decline_steps(grid: DataFrame) -> DataFrame:
    """How many steps in a row v has fallen up to each row; a missing value or no fall starts again from 0."""
    stepped = owned(with_halo(grid.withColumn("v", valid_speed(F.col("speed"))), 1, 0).withColumn("falls", F.coalesce(F.col("v") < F.lag("v").over(by_time()), F.lit(False))))
    marked = last_at(stepped, ~F.col("falls"), "broke_at")
    return marked.withColumn("decline_steps", F.col("t") - F.col("broke_at")).drop("falls", "broke_at", "v")


def calendar(step_minutes: int) -> dict[str, Column]:
    ts = F.col("ts")
    (hs, hc), (ds, dc) = cyclic(F.hour(ts), 24), cyclic(F.weekday(ts), 7)
    return {"hour": hour(ts), "day_of_week": day_of_week(ts), "is_weekend": is_weekend(ts), "time_slot": slot_of_day(ts, step_minutes), "hour_sin": hs, "hour_cos": hc, "dow_sin": ds, "dow_cos": dc}


def windowed(grid: DataFrame, columns: dict[str, Column], back: int = 12, ahead: int = 6) -> DataFrame:
    """The grid (with v, and ratio where the columns need it) and window columns."""
    return owned(with_halo(grid, back, ahead).select("*", *(c.alias(k) for k, c in columns.items())))


def labels(grid_with_ratio: DataFrame, thresholds: tuple[float, ...] = (0.50, 0.60, 0.70), steps: int = 6, minimum: int = 3) -> DataFrame:
    """Forward counts and labels at each threshold, and whether the future is complete."""
    columns: dict[str, Column] = {}
    for t in thresholds:
        count, complete = future_counts(t, steps)
        columns |= {f"future_count_{round(t * 100)}": count, f"label_{round(t * 100)}": (count >= minimum).cast("int"), "future_complete": complete}
    return windowed(grid_with_ratio, columns, 0, steps)


def model_table(
    grid: DataFrame, parts: list[Segment], first: int, step_minutes: int = 60, history: int = 12, future: int = 6, threshold: float = 0.60, sensitivity: tuple[float, ...] = (0.50, 0.60, 0.70), minimum: int = 3
) -> DataFrame:
    """Every cell with its split, features, labels and whether it is a usable sample.

    Free flow and period statistics come from the training segment alone. A usable cell lies inside its segment with
    its history and future, and both are complete.
    """
    if threshold not in sensitivity:
        raise ValueError("the sensitivity thresholds must contain the main one")
    stats = checkpoint(train_stats(grid, parts[0], first))  # a row for each sensor, read three times
    based = with_ratio(decline_steps(grid), stats.select("sensor_id", "free_flow"))
    columns: dict[str, Column] = {**lags(), **rolling(), **trends(step_minutes), "history_complete": history_complete(history)}
    for t in sensitivity:
        count, complete = future_counts(t, future)
        columns |= {f"label_{round(t * 100)}": (count >= minimum).cast("int"), "future_complete": complete}
    cells = windowed(based, columns, max(12, history), future).select("*", *(c.alias(k) for k, c in calendar(step_minutes).items()))
    periods = period_stats(grid, parts[0], first, step_minutes, overall=stats)
    joined = cells.join(periods, ["sensor_id", "is_weekend", "time_slot"], "left").join(stats.select("sensor_id", F.col("median_speed").alias("sensor_median_speed"), F.col("congestion_rate").alias("sensor_congestion_rate")), "sensor_id", "left")
    return joined.select(
        "*", (F.col("v") - F.col("period_median_speed")).alias("deviation_from_period"), segment_column(parts, first).alias("split"), segment_column(parts, first, history, future).alias("inside"),
        (F.coalesce(segment_column(parts, first, history, future).isNotNull() & F.col("history_complete") & F.col("future_complete"), F.lit(False))).alias("usable"),
    )


def fill_short_gaps(grid: DataFrame, periods: DataFrame, max_gap: int = 3, step_minutes: int = 60, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Every cell with ``filled`` and where that is from: ``read``; ``carried``, the last reading, of at most ``max_gap`` steps before; or ``period``, the
    training segment's median of the sensor, day type and slot (``periods``, from ``period_stats``), as gaps beyond that aren't bridged.
    ``age``: steps since the last reading, NULL without one. Only earlier rows and the training segment are looked at.
    """
    cells = last_value(grid.withColumn("v", valid_speed(F.col("speed"))), F.col("v"), "before", chunk_steps)
    cells = cells.select("*", is_weekend(F.col("ts")).alias("is_weekend"), slot_of_day(F.col("ts"), step_minutes).alias("time_slot"), (F.col("t") - F.col("before.t")).alias("age"))
    known = cells.join(periods.select("sensor_id", "is_weekend", "time_slot", "period_median_speed"), ["sensor_id", "is_weekend", "time_slot"], "left")
    near = F.col("age") <= max_gap
    return known.select(
        "sensor_id", "ts", "t", "speed", "age", F.when(near, F.col("before.value")).otherwise(F.col("period_median_speed")).alias("filled"),
        F.when(F.col("age") == 0, "read").when(near, "carried").when(F.col("period_median_speed").isNotNull(), "period").alias("filled_from"),
    )


FEATURES = (
    ["v", "ratio", *(f"ratio_lag_{k}" for k in LAGS), *(f"speed_{a}_{k}" for k in ROLLS for a in ("mean", "min", "std")), *(f"trend_{k}" for k in TRENDS), "speed_change", "decline_steps"]
    + ["hour", "day_of_week", "weekend", "time_slot", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "free_flow", "sensor_median_speed", "sensor_congestion_rate", "period_median_speed", "period_congestion_rate", "deviation_from_period"]
)


def samples(table: DataFrame, threshold: float = 0.60) -> DataFrame:
    """Usable rows: sensor, time, split, features and target."""
    rows = table.where("usable").withColumn("weekend", F.col("is_weekend").cast("int"))
    return rows.select("sensor_id", "ts", "t", "split", *FEATURES, F.col(f"label_{round(threshold * 100)}").alias("target"))


def split_summary(table: DataFrame) -> DataFrame:
    """Candidates, exclusions, usable samples and positives of each split."""
    inside = F.col("inside").isNotNull()
    n = F.count_if
    return table.where(inside).groupBy("split").agg(
        F.count("*").alias("candidates"), n(~F.col("history_complete")).alias("excluded_history"), n(F.col("history_complete") & ~F.col("future_complete")).alias("excluded_future"), n(F.col("usable")).alias("usable"),
        *(n(F.col("usable") & (F.col(f"label_{k}") == 1)).alias(f"positives_{k}") for k in (50, 60, 70)),
        F.min(F.when(F.col("usable"), F.col("ts"))).alias("first_ts"), F.max(F.when(F.col("usable"), F.col("ts"))).alias("last_ts"), F.round(F.try_divide(n(F.col("usable") & (F.col("label_60") == 1)), n(F.col("usable"))), 6).alias("positive_rate"),
    )


def dataset_checks(found: DataFrame) -> DataFrame:
    """Rows, nulls in any column, repeated keys, sensors and targets outside 0 and 1 of each split, with a verdict."""
    missing = F.lit(False)
    for c in FEATURES:
        missing = missing | F.col(c).isNull()
    keys = found.groupBy("split", "sensor_id", "ts").agg(F.count("*").alias("n"), F.count_if(missing).alias("nulls"), F.count_if(~F.col("target").isin(0, 1)).alias("odd"), F.count_distinct("target").alias("kinds"), F.min("target").alias("lo"), F.max("target").alias("hi"))
    each = keys.groupBy("split").agg(F.sum("n").alias("n_rows"), F.sum("nulls").alias("null_rows"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.count_distinct("sensor_id").alias("sensors"), F.sum("odd").alias("odd_targets"), (F.min("lo") != F.max("hi")).alias("has_both_classes"))
    return each.withColumn("verdict", F.when((F.col("null_rows") == 0) & (F.col("repeated_keys") == 0) & (F.col("odd_targets") == 0), "PASS").otherwise("FAIL"))
