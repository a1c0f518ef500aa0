"""Composite plans: the cleaning and profiling tables, and the model data with its reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from loomgrid.operators.features import dataset_checks, model_table, samples, split_summary
from loomgrid.operators.matching import event_profile
from loomgrid.operators.patterns import daily_trend, day_type_hour_pattern, hourly_pattern, sensor_risk, spearman, weekday_hour_pattern, zero_sensitivity
from loomgrid.operators.quality import clean_long, quality_flags, quality_summary
from loomgrid.operators.split import period_stats, require_windows, segment_table, segments, time_axis


@dataclass(frozen=True)
class Plan:
    step_minutes: int = 60
    majority: float = 0.5
    min_zero_steps: int = 12
    jump: float = 40.0
    threshold: float = 0.60
    train: float = 0.7
    validation: float = 0.1
    test: float = 0.2
    history: int = 12
    future: int = 6
    minimum: int = 3


def profile_tables(grid: DataFrame, locations: DataFrame, plan: Plan) -> dict[str, DataFrame]:
    """All cleaning and profiling tables; each is lazy."""
    flags = quality_flags(grid, plan.majority, plan.min_zero_steps, plan.jump)
    risk = sensor_risk(grid, locations, plan.step_minutes)
    return {
        "clean": clean_long(grid, locations, majority=plan.majority, min_steps=plan.min_zero_steps, jump=plan.jump), "summary": quality_summary(flags), "hourly": hourly_pattern(grid), "weekday_hour": weekday_hour_pattern(grid),
        "day_type_hour": day_type_hour_pattern(grid), "daily": daily_trend(grid), "risk": risk, "profile": event_profile(grid, plan.threshold, plan.step_minutes), "spearman": spearman(risk), "zero_sensitivity": zero_sensitivity(grid),
    }


def model_data(grid: DataFrame, plan: Plan) -> dict[str, DataFrame]:
    """Segments, training statistics, samples and their reports; windows that don't fit their segment are an error."""
    first, n = time_axis(grid)
    parts = segments(n, plan.train, plan.validation, plan.test)
    require_windows(parts, plan.history, plan.future)
    table = model_table(grid, parts, first, plan.step_minutes, plan.history, plan.future, plan.threshold, minimum=plan.minimum)
    found = samples(table, plan.threshold)
    return {
        "segments": segment_table(grid.sparkSession, parts, plan.history, plan.future), "period_stats": period_stats(grid, parts[0], first, plan.step_minutes), "table": table, "samples": found,
        "summary": split_summary(table), "checks": dataset_checks(found),
    }
