"""Contiguous byte-balanced shards: global prefix sums from per-partition totals, cut at equal targets.

The order that is cut is (md5 of the text, doc_id), so that equal texts lie side by side. Only ids, sizes
and hashes are ranged and sorted, never texts. The driver sees one total for each partition, at most
``n_shards - 1`` rows that a target falls into, and one row number for each shard.

One law for all groups: a cut that falls into a group of equal texts moves to the group's nearer edge if that is at most
``tolerance`` of a shard's size away, else to the nearer edge of the row it falls into. So no shard is further from the equal
size than twice the tolerance and a row, equal texts share a shard wherever that allows it, and a text that
holds a third of all rows is spread over shards.

Defined results: a null text counts as empty (size ``overhead``, crc32 0); null ids sort first; repeated rows
each get a slot; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import checkpoint


def _prefixes(offsets: dict[int, tuple[int, int]]):
    """Rows of a sorted partition with their global row number and the bytes before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, tuple[int, int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            row, start = at.get(part, offsets[part])
            sizes = batch.column("size").to_numpy()
            ends = start + np.cumsum(sizes)
            at[part] = row + len(sizes), int(ends[-1])
            columns = {c: batch.column(c) for c in ("doc_id", "size", "text_crc32", "text_md5")}
            yield pa.RecordBatch.from_pydict(columns | {"row": np.arange(row, row + len(sizes)), "start": ends - sizes})

    return run


def shard(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, tolerance: float = 0.05) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(text) + overhead).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("text_md5"),
    )
    ordered = checkpoint(rows.repartitionByRange("text_md5", "doc_id").sortWithinPartitions("text_md5", "doc_id")).withColumn("part", F.spark_partition_id())

    offsets, n_rows, total = {}, 0, 0
    for part, count, size in sorted(ordered.groupBy("part").agg(F.count("*"), F.sum("size")).collect()):  # a row for each partition
        offsets[part] = n_rows, total
        n_rows, total = n_rows + count, total + size
    placed = ordered.mapInArrow(_prefixes(offsets), "doc_id bigint, size bigint, text_crc32 bigint, text_md5 string, row bigint, start bigint")

    cuts = [-(-k * total // n_shards) for k in range(1, n_shards)]  # of bytes before a row
    if total:
        first, last = F.expr(f"(start * {n_shards}) div {total}"), F.expr(f"((start + size) * {n_shards} - 1) div {total}")
        hit = placed.where(last > first).select("text_md5", "start", "size", first.alias("first"), last.alias("last")).collect()  # under n_shards rows
        groups = {r["text_md5"]: r for r in placed.where(F.col("text_md5").isin([r["text_md5"] for r in hit])).groupBy("text_md5").agg(F.min("start").alias("start"), F.sum("size").alias("size")).collect()} if hit else {}
        for r in hit:
            g = groups[r["text_md5"]]
            for k in range(r["first"] + 1, r["last"] + 1):
                target = k * total / n_shards
                near = lambda x, target=target: min((x["start"], x["start"] + x["size"]), key=lambda edge: abs(edge - target))
                cuts[k - 1] = near(g) if abs(near(g) - target) * n_shards <= tolerance * total else near(r)
    cuts = sorted(cuts)

    edges = F.array(*(F.lit(c).cast("bigint") for c in cuts)) if cuts else F.array().cast("array<bigint>")
    dealt = placed.withColumn("shard", F.size(F.filter(edges, lambda c: c <= F.col("start"))).cast("int"))
    begins = {r["shard"]: r["row"] for r in dealt.groupBy("shard").agg(F.min("row").alias("row")).collect()}  # a row for each shard
    begin = F.element_at(F.create_map(*(F.lit(x) for kv in begins.items() for x in kv)), F.col("shard")) if begins else F.lit(0)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - begin).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
