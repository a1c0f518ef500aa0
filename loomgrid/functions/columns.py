"""Expressions on single rows: validity, calendar, ratios, bands, names and casts.

Missing is NULL everywhere: NaN, infinities and values that aren't positive become NULL where a value must be
valid, so that no comparison ever sees NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
RISK_EDGES = (0.40, 0.70)
PERCENT_EDGES = (20.0, 40.0, 60.0, 80.0)


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def valid_speed(speed: Column) -> Column:
    """The speed where it is finite and above zero, else NULL: a zero counts as missing."""
    return F.when(finite(speed) > 0, speed)


def ratio(value: Column, base: Column) -> Column:
    return F.try_divide(value, base)


def congested(speed_ratio: Column, threshold: float) -> Column:
    """A missing ratio isn't congested."""
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    return F.coalesce(speed_ratio < threshold, F.lit(False))


def hour(ts: Column) -> Column:
    return F.hour(ts).cast("bigint")


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts).cast("bigint")


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def weekday_name(dow: Column) -> Column:
    return F.element_at(F.array(*(F.lit(d) for d in WEEKDAYS)), (dow + 1).cast("int"))


def slot_of_day(ts: Column, step_minutes: int) -> Column:
    return F.floor((F.hour(ts) * 60 + F.minute(ts)) / step_minutes).cast("bigint")


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def risk_band(probability: Column, strict: bool = False) -> Column:
    """Low below 0.40, medium below 0.70, else high; ``strict`` raises beyond 0 to 1."""
    low, high = RISK_EDGES
    band = F.when(probability < low, "low").when(probability < high, "medium").when(probability.isNotNull(), "high")
    if strict:
        return F.when((probability < 0) | (probability > 1), F.raise_error(F.lit("probability must lie within 0 and 1")).cast("string")).otherwise(band)
    return band


def percent_band(percent: Column) -> Column:
    """Fifths of 0 to 100; the last is closed."""
    out, low = None, 0
    for edge in PERCENT_EDGES:
        label, low = F.lit(f"{low}-{int(edge)}%"), int(edge)
        out = F.when(percent < edge, label) if out is None else out.when(percent < edge, label)
    return out.when(percent <= 100, F.lit(f"{low}-100%"))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def number(value: Column) -> Column:
    """NULL where the text is no number."""
    return value.try_cast("double")


def minute_text(value: Column) -> Column:
    """Year to minute, or the value itself where it is no timestamp."""
    return F.coalesce(F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd HH:mm"), value)


def localized(name: Column, labels: dict[str, str]) -> Column:
    """Label of a feature name; names without one pass through."""
    if not labels:
        return name
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return F.coalesce(F.try_element_at(table, name), name)


def source_feature(name: Column, categorical: str) -> Column:
    """Feature that an encoded column comes from: every ``<categorical>_value`` column belongs to ``categorical``."""
    bare = F.regexp_replace(name, "^(numeric|category)__", "")
    return F.when(F.startswith(bare, F.lit(f"{categorical}_")), F.lit(categorical)).otherwise(bare)


def direction(delta: Column) -> Column:
    return F.when(delta > 0, "raises").when(delta < 0, "lowers").otherwise("neutral")
