"""Source divergence audit: how the word use of every source of a language differs from each other source's, and by which words.

Terms are runs of letters and non-ASCII characters with only A-Z lower-cased; a language keeps those of at least ``min_docs`` of its
documents. A source's share of a term is p = 1 + floor(SCALE * (count + 1) / (N + V)), in whole numbers throughout; two sources (or a source and
its language) are compared by f = floor((p - q) * (p - q) / q).

Method, by run-length columns:

* Counting. A task counts its texts' terms by language and source in dictionaries of at most about ``max_entries`` entries and hands them on as
  sums, which Spark adds up. A term's counts over the sources are its vector.
* Reordering and run lengths. Terms of a language with equal vectors are put side by side by one aggregation, which leaves the vector and
  the number of its terms. Vectors are dealt to chunks of about ``chunk`` by hash, and sorted there, so that equal counts of a source cluster
  further; each source's column is then run-length encoded over the chunk. All sources appear in every chunk: one without any
  of its terms is a single run of zeros.
* Pairs. Two columns' runs are intersected; f is taken once for each piece, times its number of terms. Sums of the chunks are added up by Spark.

A task takes the pairs of at most ``block`` first sources, so that neither its rows nor its result grow with the square of the sources; the vectors go to
as many tasks as there are blocks. Pieces grow with the runs of both columns; the number of pairs is that of the result.

Defined results: null text, language or source are the empty string; a language without kept terms has pairs of value 0
and no terms; a single source has no pairs; repeated rows count again, each as a document; ids aren't read; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import collections
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.batches import sliced
from loomgrid.llm.common import checkpoint

SCALE, TOGETHER = 1_000_000_000, 5
#: Bytes of terms: letters, lower-cased, and everything beyond ASCII; all else becomes a blank.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
COUNTS = "lang string, source string, term string, n bigint, docs bigint"
PAIRS = "lang string, source string, item string, value bigint"


def pieces(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text, in lists of about ``size`` bytes of it."""
    text, start = text.translate(TERM_BYTES), 0
    while start < len(text):
        end = text.find(b" ", start + size)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def count_terms(batches: Iterator[pa.RecordBatch], max_entries: int) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTS from batches of (lang, source, text); a key may come several times. ``docs`` of a language's term is told once, with any of its sources."""
    counts: dict = collections.defaultdict(collections.Counter)  # by language and source
    in_docs: dict = collections.defaultdict(collections.Counter)  # by language

    def flushed() -> list[pa.RecordBatch]:
        columns: list[list[pa.Array]] = [[] for _ in range(5)]
        for (lang, source), found in counts.items():
            terms, docs = list(found), in_docs[lang]
            parts = pa.repeat(pa.scalar(lang, pa.string()), len(terms)), pa.repeat(pa.scalar(source, pa.string()), len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64()), pa.array([docs.pop(t, 0) for t in terms], pa.int64())
            for column, part in zip(columns, parts, strict=True):
                column.append(part)
        counts.clear()
        in_docs.clear()
        kinds = pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()
        table = pa.table({name: pa.chunked_array(column, kind) for name, column, kind in zip(("lang", "source", "term", "n", "docs"), columns, kinds, strict=True)})
        return table.sort_by([("lang", "ascending"), ("term", "ascending")]).combine_chunks().to_batches()  # neighbours share their term, which shuffles in less

    entries = 0
    for batch, texts in sliced(batches, "text"):
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            seen: set[bytes] = set()
            for terms in pieces(text.encode()):
                found = counts[lang, source]
                before, new = len(found), set(terms) - seen
                found.update(terms)
                in_docs[lang].update(new)
                seen |= new
                entries += len(found) - before
                if entries >= max_entries:
                    yield from flushed()
                    entries = 0
    yield from flushed()


def kept_terms(docs: DataFrame, sources: int, min_docs: int, max_entries: int) -> DataFrame:
    """lang, term, its count in the language, and its vector: source and count, by source. ``sources``: the most that a language has.

    Tasks hand on sums already, so these go to their reducers as they are, by term and a share of about ``TOGETHER`` sources: the
    rows of a very frequent term there are at most that many for each task, and those of others still stand side by side.
    """
    parts = docs.mapInArrow(lambda batches: count_terms(batches, max_entries), COUNTS)
    dealt = parts.withColumn("share", F.pmod(F.xxhash64("source"), F.lit(-(-sources // TOGETHER)))).repartition("lang", "term", "share")
    by_source = dealt.groupBy("lang", "term", "share", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_share = by_source.groupBy("lang", "term", "share").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells"))
    by_term = by_share.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"), F.sort_array(F.flatten(F.collect_list("cells"))).alias("vector"))
    return by_term.where(F.col("docs") >= min_docs).select("lang", "term", "total", "vector")


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count; the product may exceed 64 bits."""
    exact = lambda c: c.cast("decimal(19,0)")
    return 1 + F.call_function("div", exact(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), exact(total + terms))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def runs(rows: np.ndarray, counts: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Run-length encoding of a column of ``height`` rows that holds ``counts`` at ``rows`` (ascending) and zeros elsewhere: starts and values."""
    starts = np.unique(np.concatenate([[0], rows, rows + 1]))
    starts = starts[starts < max(1, height)]
    values = np.zeros(len(starts), np.int64)
    values[np.searchsorted(starts, rows)] = counts
    first = np.concatenate([[True], values[1:] != values[:-1]])
    return starts[first], values[first]


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """p of every count, in whole numbers of any size."""
    distinct, at = np.unique(counts, return_inverse=True)
    return np.array([1 + SCALE * (int(c) + 1) // (total + terms) for c in distinct], np.int64)[at]


def chunk_pairs(block: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Sums of f over a chunk's terms for the pairs whose first source is in the task's block, in both directions."""

    def run(key: tuple, groups: pa.Table, vectors: pa.Table) -> pa.Table:
        lang, number = key[0].as_py(), key[2].as_py()
        groups = groups.sort_by("source")
        sources, totals = groups["source"].to_pylist(), groups["n"].to_pylist()
        terms = groups["terms"][0].as_py() if groups.num_rows else 0
        height = vectors.num_rows
        lists = vectors["vector"].combine_chunks() if height else None
        if height:
            flat = lists.flatten()
            at = pc.index_in(flat.field("source"), pa.array(sources, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
            counts, lengths = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            cells = np.stack([at, counts], 1).astype(">i8")
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            order = np.array(sorted(range(height), key=lambda r: cells[bounds[r] : bounds[r + 1]].tobytes()))
            place = np.empty(height, np.int64)
            place[order] = np.arange(height)
            row = np.repeat(place, lengths)
            by_column = np.lexsort((row, at))
            at, row, counts = at[by_column], row[by_column], counts[by_column]
            edges = np.searchsorted(at, np.arange(len(sources) + 1))
            ends = np.concatenate([[0], np.cumsum(vectors["times"].to_numpy()[order])])
            columns = [runs(row[a:b], counts[a:b], height) for a, b in zip(edges, edges[1:], strict=False)]
            columns = [(starts, shares(values, n, terms)) for (starts, values), n in zip(columns, totals, strict=True)]
        out: list[tuple[str, str, int]] = []
        for g in range(number * block, min(len(sources), (number + 1) * block)):
            for h in range(g + 1, len(sources)):
                there = back = 0
                if height:
                    starts = np.union1d(columns[g][0], columns[h][0])
                    p, q = (c[1][np.searchsorted(c[0], starts, "right") - 1] for c in (columns[g], columns[h]))
                    times, squares = np.diff(ends[np.append(starts, height)]), (p - q) ** 2
                    there, back = int((squares // q * times).sum()), int((squares // p * times).sum())
                out += [(sources[g], sources[h], there), (sources[h], sources[g], back)]
        source, item, value = zip(*out, strict=True) if out else ([], [], [])
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    return run


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 3, top: int = 200, chunk: int = 50_000, block: int = 200, max_entries: int = 1_000_000) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(named(lang_col).alias("lang"), named(source_col).alias("source"), named(text_col).alias("text"))
    named_groups = checkpoint(rows.select("lang", "source").distinct())
    most = named_groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    kept = checkpoint(kept_terms(rows, most, min_docs, max_entries))
    cells = kept.select("lang", "term", "total", F.explode("vector").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    languages = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    groups = checkpoint(named_groups.join(sums, ["lang", "source"], "left").join(languages, "lang", "left").select("lang", "source", *map(zero, ("n", "terms", "lang_n"))))

    vectors = checkpoint(kept.groupBy("lang", "vector").agg(F.count("*").alias("times")))
    chunks = max(1, -(-vectors.count() // chunk))
    blocks = -(-most // block)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = groups.select("lang", "source", "n", "terms", numbers(chunks).alias("chunk")).select("*", numbers(blocks).alias("block"))
    right = vectors.select("*", F.pmod(F.xxhash64("vector"), F.lit(chunks)).cast("int").alias("chunk")).select("*", numbers(blocks).alias("block"))
    keys = ["lang", "chunk", "block"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(chunk_pairs(block), PAIRS).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    p, q = share(F.col("n"), F.col("group_n"), F.col("terms")), share(F.col("total"), F.col("lang_n"), F.col("terms"))
    found = cells.join(groups.withColumnRenamed("n", "group_n"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    terms = found.where("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))
