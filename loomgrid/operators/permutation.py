"""Exact seeded permutations of a column, without a sort of all rows in one task, and importances by permutation.

A row has a rank by one hash of its key and a rank by another; it gets the value of the row whose second rank is its first. Ranks are counted in
ranges of the hash: the ranges' totals (``RANGES`` numbers) give each its offset, and rows are ordered inside their range alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.lineage import checkpoint

RANGES, DIGITS = 4096, 3


def ranked(rows: DataFrame, key: Column, seed: int, name: str) -> DataFrame:
    """``name``: rank of each row from 0 by the hash of its key, equal hashes by key; keys are distinct."""
    hashed = rows.withColumn("_hash", F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))).withColumn("_range", F.conv(F.substring("_hash", 1, DIGITS), 16, 10).cast("int"))
    totals = hashed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    offsets = totals.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy("_hash", key)
    counted = hashed.withColumn("_inside", F.row_number().over(inside)).join(F.broadcast(offsets), "_range")  # at most RANGES rows
    return counted.withColumn(name, F.col("_offset") + F.col("_inside") - 1).drop("_hash", "_range", "_inside", "_offset")


def permuted(rows: DataFrame, key: Column, column: str, seed: int = 42) -> DataFrame:
    """``rows`` with the column's values permuted; every value is given exactly once."""
    to = ranked(rows, key, 2 * seed, "_rank")
    source = ranked(rows.select(key.alias("_key"), F.col(column).alias("_value")), F.col("_key"), 2 * seed + 1, "_rank").select("_rank", "_value")
    return to.join(source, "_rank").withColumn(column, F.col("_value")).select(*rows.columns)


def permutation_importance(rows: DataFrame, key: Column, columns: list[str], metric: Callable[[DataFrame], DataFrame], seed: int = 42, repeats: int = 1) -> DataFrame:
    """How much the metric (a DataFrame of one row and one column, from rows) falls when each column in turn is permuted: mean over ``repeats``."""
    held = checkpoint(rows)
    base = metric(held).first()[0]
    out = []
    for i, column in enumerate(columns):
        falls = [base - metric(permuted(held, key, column, seed + repeats * i + k)).first()[0] for k in range(repeats)]
        out.append((column, float(sum(falls) / repeats)))
    return rows.sparkSession.createDataFrame(out, "feature string, importance double").orderBy(F.desc("importance"), "feature")
