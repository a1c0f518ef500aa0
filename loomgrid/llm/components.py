"""Connected components of a link table, by alternating stars, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import checkpoint


def components(links: DataFrame, max_rounds: int = 60, rows_per_task: int = 50_000) -> DataFrame:
    """``node`` and ``component`` (smallest node of its component) for every node of ``links``, columns u and v of any ordered type.

    A round makes every node hang its larger neighbours, then all its smaller ones, on the smallest node that
    it sees; links turn into stars in a logarithmic number of rounds. The minimum of a node's neighbours
    is aggregated before it is shuffled, and links are what is joined, never members of a group. Each round is
    checkpointed. Links are far fewer than what they were found in, so every step is brought to a task for each ``rows_per_task``
    of them; else each shuffle of a round would write as many files as the session has shuffle partitions. Null
    ends and self-links are ignored.
    """
    links = checkpoint(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
    before = state(links)
    few = lambda df: df.coalesce(1 + before[0] // rows_per_task)
    links = few(links)
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")))
        large = few(both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct())
        lows = few(large.groupBy("u").agg(F.min("v").alias("low")))
        small = few(large.join(lows, "u")).select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(lows.select("u", F.col("low").alias("v")))
        links = checkpoint(few(small.where("u != v").distinct()))
        now = state(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
