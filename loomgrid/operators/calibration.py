"""How far probabilities can be trusted: calibration curve, Brier score, PR-AUC, and isotonic calibration over ranges.

``scored`` has columns y (0 or 1) and p (probability).

Isotonic regression is the lower convex hull of the points (rows so far, positives so far) in the order of p: the fitted value is the slope over
each row. A point that isn't on the hull of its own range of p can't be on that of all; so every range (its offset from the ranges' totals) takes
its own hull in a task, and one task joins what is left. The hull of whole-number points of n rows has O(n^(2/3)) corners whatever the
scores are, some 5 million for 10^10 rows, so that task's input is bounded; nothing else is brought together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.lineage import checkpoint
from loomgrid.operators.metrics import by_score

RANGES = 4096


def calibration_curve(scored: DataFrame, bins: int = 10) -> DataFrame:
    """For each bin of equal width in use: rows, mean probability, share of positives, and their difference."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    rows = scored.where("p is not null and y is not null").groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("positive_rate"))
    return rows.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("positive_rate", 6).alias("positive_rate"), F.round(F.col("mean_p") - F.col("positive_rate"), 6).alias("gap"))


def calibration_scores(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score, expected calibration error over the bins, and PR-AUC (average precision), as one row; NULL without rows (PR-AUC: positives)."""
    rows = scored.where("p is not null and y is not null")
    brier = rows.agg(F.round(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), 6).alias("brier"))
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    gaps = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.sum("p") - F.sum("y")).alias("gap"))
    error = gaps.agg(F.round(F.try_divide(F.sum("gap"), F.sum("n")), 6).alias("calibration_error"))
    steps = by_score(rows)
    area = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    curve = steps.agg(F.round(F.try_divide(area, F.sum("pos")), 6).alias("pr_auc"))
    return brier.crossJoin(error).crossJoin(curve)  # one row each


def hull(n: np.ndarray, s: np.ndarray) -> list[int]:
    """Corners of the lower convex hull of points with rising n: positions. In whole numbers."""
    out: list[int] = []
    ns, ss = n.tolist(), s.tolist()
    for i in range(len(ns)):
        while len(out) > 1 and (ss[out[-1]] - ss[out[-2]]) * (ns[i] - ns[out[-1]]) >= (ss[i] - ss[out[-1]]) * (ns[out[-1]] - ns[out[-2]]):
            out.pop()
        out.append(i)
    return out


_POINTS = "p double, n bigint, s bigint"


def _hull_table(points: pa.Table) -> pa.Table:
    points = points.select(["p", "n", "s"]).sort_by("n")
    return points.take(hull(points["n"].to_numpy(), points["s"].to_numpy()))


def isotonic(scored: DataFrame) -> DataFrame:
    """Blocks of equal fitted value: ``low`` (beyond which p lies; NULL: no bound), ``high`` (which it reaches), ``value``, rows ``n``; value rises with p."""
    values = checkpoint(scored.where("p is not null and y is not null").groupBy("p").agg(F.count("*").alias("m"), F.sum(F.col("y").cast("bigint")).alias("pos")).withColumn("range", F.least(F.floor(F.col("p") * RANGES), F.lit(RANGES - 1)).cast("int")))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    ahead = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0).cast("bigint"))
    offsets = values.groupBy("range").agg(F.sum("m").alias("m"), F.sum("pos").alias("pos")).select("range", ahead("m").alias("n0"), ahead("pos").alias("s0"))
    inside = Window.partitionBy("range").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    ends = values.join(F.broadcast(offsets), "range").select("range", "p", (F.col("n0") + F.sum("m").over(inside)).alias("n"), (F.col("s0") + F.sum("pos").over(inside)).alias("s"))
    starts = offsets.select("range", F.lit(None).cast("double").alias("p"), F.col("n0").alias("n"), F.col("s0").alias("s"))
    local = starts.unionByName(ends).groupBy("range").applyInArrow(_hull_table, _POINTS)
    # a range's start is the end of the range before: one of the two is enough, with the p of the end
    joined = local.groupBy("n", "s").agg(F.max("p").alias("p")).withColumn("all", F.lit(0))
    corners = joined.groupBy("all").applyInArrow(_hull_table, _POINTS)  # O(n^(2/3)) corners
    order = Window.orderBy("n")  # corners
    last = lambda c: F.lag(c).over(order)
    blocks = corners.select(last("p").alias("low"), F.col("p").alias("high"), ((F.col("s") - last("s")) / (F.col("n") - last("n"))).alias("value"), (F.col("n") - last("n")).alias("n"))
    return blocks.where("n is not null")


def calibrated(scored: DataFrame, blocks: DataFrame) -> DataFrame:
    """``scored`` with ``calibrated``: the value of the block that p lies in, of the nearest one beyond both ends; NULL without blocks.

    Blocks are put among the rows of each range of p as marks, with the block that is open at the range's start as its first; a running last mark
    gives every row its block, so neither side is broadcast and a range is a task.
    """
    of = lambda c: F.least(F.floor(c * RANGES), F.lit(RANGES - 1)).cast("int")
    low = F.coalesce("low", F.lit(0.0))
    ends = F.max("high").over(Window.partitionBy())  # corners
    spread = blocks.withColumn("top", F.when(F.col("high") == ends, F.lit(1.0)).otherwise(F.col("high"))).select("low", "value", F.explode(F.sequence(of(low), of(F.col("top")))).alias("_range"))
    marks = spread.select("_range", F.coalesce("low", F.lit(-1.0)).alias("_at"), F.lit(0).alias("_row"), F.col("value").alias("_value"))
    names = scored.columns
    rows = scored.select(F.struct(*names).alias("_all"), of(F.col("p")).alias("_range"), F.col("p").alias("_at"), F.lit(1).alias("_row"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    # a block holds p > low: at equal places rows come before the block that begins there
    seen = Window.partitionBy("_range").orderBy("_at", F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("calibrated", F.last("_value", ignorenulls=True).over(seen)).where("_row = 1").select("_all.*", F.when(F.col("_at").isNotNull(), F.col("calibrated")).alias("calibrated"))
