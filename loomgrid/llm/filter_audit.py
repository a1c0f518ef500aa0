"""Filter interaction audit: what five filters remove in every order in which they can be applied.

Which filters a document fails is told by one bit for each. A to D are functions of its text alone (``failures``). E, a copy of a
document with a smaller id, is found by an existential self-join: a left-semi join on the text's hash, the exact text and
a smaller id. The ids so found are united with the failures of the other filters, as signed counts: a copy leaves its combination
without E and enters the one with it. Counts of bit combinations (at most 32 for each part, whatever the input) then give every order's
figures: a filter after a set P of others removes the combinations that hold its bit and none of P.

The join at scale. Texts whose hash no other id has can't be copies: a Bloom filter of the repeated hashes (at most ``max_blocks`` blocks of
32 bytes, ``url_filter.probed``) keeps nearly all of them from being shuffled. On the right stands one row for each distinct
text, its smallest id, aggregated before the shuffle; that side is checkpointed, so both sides are plain exchanges and Spark splits the
rows of a text that fills a third of the table.

Defined results: a null text is empty, so all null and empty texts are copies of one another; a null ``lang`` is the empty string; a null id
is no smaller id and has none below it; rows with the same id and text don't make each other copies, and each is counted;
labels of one id are united (a label counts if any row has it), labels of unknown ids ignored; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from loomgrid.llm.common import checkpoint
from loomgrid.llm.url_filter import probed

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Fixed values of filter A (words), B (percent of distinct words), C (percent of capitals) and D (symbols).
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 200, 50, 3, b"#$%&*|"
CAPITALS, CONTINUED = bytes(range(0x41, 0x5B)), bytes(range(0x80, 0xC0))
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``text`` in pieces of about ``size`` bytes, cut at white space."""
    start = 0
    while start < len(text):
        gap = SPACE.search(text, start + size)
        end = gap.start() if gap else len(text)
        yield text[start:end]
        start = end


def failed(text: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    words, distinct = 0, set()
    for piece in pieces(text):
        found = piece.split()  # of bytes, at the six ASCII white spaces
        words += len(found)
        distinct.update(found)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    chars = len(text.translate(None, CONTINUED))
    fails = words < MIN_WORDS, 100 * len(distinct) < MIN_DISTINCT * words, 100 * capitals > MAX_CAPITALS * chars, len(text.translate(None, SYMBOLS)) < len(text)
    return sum(1 << i for i, f in enumerate(fails) if f)


@F.arrow_udf(IntegerType())
def failures(texts: pa.Array) -> pa.Array:
    return pa.array((failed(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts.cast(pa.large_binary())), pa.int32())


def combinations(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", bits_per_key: int = 16, max_blocks: int = 1 << 17) -> DataFrame:
    """``part``, ``bits`` (the filters failed), and how many documents, labelled good and labelled toxic ones have them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("h"))
    base = checkpoint(whole.select("doc_id", "part", "h", failures("text").alias("bits")))  # no text: read for the hashes and twice for the counts
    repeated = checkpoint(base.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h"))
    blocks = min(max_blocks, 1 << max(4, math.ceil(math.log2(max(1, repeated.count()) * bits_per_key / 256))))
    suspects = probed(whole, repeated, "h", blocks).where("possible")
    firsts = checkpoint(suspects.groupBy("h", "text").agg(F.min("doc_id").alias("first")))
    d, o = suspects.alias("d"), firsts.alias("o")
    same = (F.col("d.h") == F.col("o.h")) & (F.col("d.text") == F.col("o.text")) & (F.col("o.first") < F.col("d.doc_id"))
    copies = checkpoint(d.join(o, same, "left_semi").select("doc_id", "part", failures("text").alias("bits")))

    moved = F.explode(F.array(F.struct(F.col("bits"), F.lit(-1).alias("n")), F.struct((F.col("bits") + COPY).alias("bits"), F.lit(1).alias("n"))))
    signed = base.select("doc_id", "part", "bits", F.lit(1).alias("n")).unionByName(copies.select("doc_id", "part", moved.alias("m")).select("doc_id", "part", "m.*"))
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("int(quality <=> 1)")).alias("good"), F.max(F.expr("int(toxic <=> 1)")).alias("toxic"))
    by_id = signed.where("doc_id is not null").groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n"))  # so that an id of many rows is a few
    counted = signed.select("part", "bits", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic")).unionByName(
        by_id.join(marked, "doc_id").select("part", "bits", F.lit(0).alias("n"), (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic"))
    )
    total = [F.sum(c).cast("bigint").alias(c) for c in ("n", "good", "toxic")]
    return counted.groupBy("part", "bits").agg(*total)


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, the step's bit, bits of the steps before) of all orders."""
    out = []
    for order in map("".join, itertools.permutations(FILTERS)):
        bits = [1 << FILTERS.index(f) for f in order]
        out += [(order, i + 1, bit, sum(bits[:i])) for i, bit in enumerate(bits)]
    return out


def audit(counts: DataFrame) -> DataFrame:
    """Figures of every part, order and step from the counts of combinations.

    The figures depend on a step's filter and the set before it alone, 80 cases; these are summed over the combinations, and the
    orders' 600 steps, a constant table, look them up.
    """
    one = [1 << i for i in range(len(FILTERS))]
    cases = F.array(*(F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit in one for before in range(1 << len(FILTERS)) if not bit & before))
    seen = counts.select("*", F.explode(cases).alias("c")).select("part", "bits", "n", "good", "toxic", "c.*")
    fails, earlier = F.col("bits").bitwiseAND(F.col("bit")) > 0, F.col("bits").bitwiseAND(F.col("before")) > 0

    def over(what: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0)).cast("bigint")

    figures = seen.groupBy("part", "bit", "before").agg(
        over("n", ~fails & ~earlier).alias("kept"),
        over("n", fails & ~earlier).alias("removed"),
        over("n", fails & earlier).alias("redundant"),
        over("n", F.col("bits") == F.col("bit")).alias("unique_fails"),
        over("good", fails & ~earlier).alias("good_lost"),
        over("toxic", fails & ~earlier).alias("toxic_lost"),
    )
    orders = counts.sparkSession.createDataFrame(steps(), "filter_order string, step int, bit int, before int")  # 600 rows
    found = figures.join(F.broadcast(orders), ["bit", "before"])
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit")).alias("shapley")
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)


def filter_interactions(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row for each part, order of the filters and step."""
    return audit(combinations(docs, labels, **columns))
