"""Exact quantiles of few groups with very many rows, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.lineage import checkpoint


def exact_quantiles(rows: DataFrame, keys: list[str], value: Column, quantiles: list[float], name: str = "q", ranges: int = 128) -> DataFrame:
    """``keys`` and ``name``, an array of the value's quantiles (linear between the two nearest ranks); groups without values are absent."""
    return many_quantiles(rows, keys, {name: (value, quantiles)}, ranges)


def in_ranges(counts: DataFrame, group: list[str], ranges: int) -> DataFrame:
    """Counted values ``_x`` (``_n`` times) with ``_range`` and the group's ``_total``."""
    cuts = [i / ranges for i in range(1, ranges)]
    edges = F.percentile_approx("_x", cuts, 20 * ranges) if cuts else F.array().cast("array<double>")
    # a row for each group, stored: approximate quantiles depend on the order in which partitions are merged, and ranges are looked at twice
    found = checkpoint(counts.groupBy(*group).agg(edges.alias("_edges"), F.sum("_n").alias("_total")))
    return counts.join(found, group).select(*group, "_x", "_n", "_total", F.size(F.filter("_edges", lambda e: e < F.col("_x"))).alias("_range"))


def many_quantiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, list[float]]], ranges: int = 128) -> DataFrame:
    """``keys`` and for each name an array of its value's quantiles, NULL where the group has no such value; groups without any are absent.

    Equal values of all columns are counted in one pass, before the shuffle, and only these counts are used further. A group's counted values fall into
    ``ranges`` between approximate quantiles of themselves, so a range holds about its share of them however far apart they lie. Totals of the ranges tell
    which ones hold the wanted ranks, and only those are ordered, each in its own task.
    """
    names = list(wanted)
    values = F.array(*(F.struct(F.lit(i).alias("_what"), v.cast("double").alias("_x")) for i, (v, _) in enumerate(wanted.values())))
    each = rows.select(*keys, F.explode(F.filter(values, lambda s: s["_x"].isNotNull())).alias("_s")).select(*keys, "_s.*")
    counts = checkpoint(each.groupBy(*keys, "_what", "_x").agg(F.count("*").alias("_n")))
    group = [*keys, "_what"]
    placed = in_ranges(counts, group, ranges)

    def at(q: float) -> Column:
        return F.lit(q) * (F.col("_total") - 1)

    ranks = F.lit(None).cast("array<bigint>")
    for i, (_, quantiles) in enumerate(wanted.values()):
        ranks = F.when(F.col("_what") == i, F.array_distinct(F.array(*(r for q in quantiles for r in (F.floor(at(q)), F.ceil(at(q))))))).otherwise(ranks)
    sums = placed.groupBy(*group, "_range").agg(F.sum("_n").alias("_m"), F.first("_total").alias("_total"))
    ahead = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` rows
    sums = sums.withColumn("_before", F.coalesce(F.sum("_m").over(ahead), F.lit(0))).withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_m"))))
    hit = sums.where(F.size("_ranks") > 0).select(*group, "_range", "_before", "_ranks")
    up_to = Window.partitionBy(*group, "_range").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = placed.join(hit, [*group, "_range"]).withColumn("_end", F.col("_before") + F.sum("_n").over(up_to))
    found = inner.select(*group, "_total", "_x", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_end") - F.col("_n")) & (r < F.col("_end")))).alias("_rank"))

    def quantile(i: int, q: float) -> Column:
        mine = F.col("_what") == i
        pick = lambda p: F.max(F.when(mine & (F.col("_rank") == p), F.col("_x")))
        low, high, part = pick(F.floor(at(q))), pick(F.ceil(at(q))), F.max(F.when(mine, at(q) - F.floor(at(q))))
        return F.when(low == high, low).otherwise(low + (high - low) * part)  # equal ends may be infinite

    some = lambda i, column: F.when(F.max(F.when(F.col("_what") == i, F.lit(True))), column)
    return found.groupBy(*keys).agg(*(some(i, F.array(*(quantile(i, q) for q in wanted[name][1]))).alias(name) for i, name in enumerate(names)))
