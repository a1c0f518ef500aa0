"""Document fingerprints: a homomorphic multiset hash over paragraphs, in DataFrame functions only.

A text's elements are its paragraphs: what stands between its line feeds, also where that is empty. A paragraph is hashed to a
vector; a fingerprint is the sum of its paragraphs' vectors, each component modulo a power of two. The sum doesn't depend on
order, and ``combine`` adds or removes the paragraphs of another fingerprint without their text: the fingerprint of two
texts joined by a line feed is the sum of theirs. Texts whose paragraphs differ as multisets differ in fingerprint but for hash
collisions. The vector of a paragraph:

* word 0: the number of its sentences (cut after sentence ends, empty ones left out), modulo 2**60;
* word 1: 1, so the sum counts paragraphs;
* words 2-3: 60 bits of each of two hashes of the whole paragraph, which keep different multisets apart;
* the others: four lanes of 15 bits, LANES in all; a lane counts one hash bit over the paragraph's sentences, modulo 2**15. It is a
  random-sign projection of the multiset of sentences (twice the lane less the count), so that the mean squared difference of two
  fingerprints' lanes estimates the size of the texts' symmetric difference. No lane carries into the next: at most CHUNK
  sentences are added up plainly, and sums of chunks lane by lane.

Likeness of two fingerprints with a and b sentences and estimated difference d: (a + b - d) / (a + b + d)
within 0 to 1, the share of sentences that they have in common; 1 if the fingerprints are equal, so also for
two empty texts.

``edits`` pairs every text with the next in descending doc_id without a global window: ids are dealt to
buckets of neighbouring ids (boundaries from approximate percentiles, which only balance the load), the rows of an id that alone
would overfill a bucket (also the null id) to several by their texts' hashes; each text is shuffled once to its bucket, and the first
text of every bucket goes to the bucket before it as well. At most about ``max_buckets`` tasks sort a bucket each, spilling where it
is large.

Defined results: a null text is empty; null ids come last in the order; rows with the same id follow one
another by hash and text; a single row is its own next; repeated rows each get a result; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import let

LANE_BITS, PER_WORD = 15, 4
MODULUS_BITS = LANE_BITS * PER_WORD
MASK = (1 << MODULUS_BITS) - 1
UNIT = sum(1 << (LANE_BITS * i) for i in range(PER_WORD))
#: Highest bit of each lane, and the most sentences whose lanes can be added without a carry.
TOP, CHUNK = UNIT << (LANE_BITS - 1), (1 << LANE_BITS) - 1
#: Shifts of the two hashes of a sentence; each gives PER_WORD lanes.
SHIFTS = range(15)
SEEDS, PLAIN = 2, 4
LANES = SEEDS * len(SHIFTS) * PER_WORD


def _mask(x: Column, mask: int = MASK) -> Column:
    return x.bitwiseAND(F.lit(mask))


def _total(hashes: Column, term) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda total, h: _mask(total + term(h)))


def _lanes(hashes: Column) -> Column:
    """Lanes of at most CHUNK sentences."""
    again = F.transform(hashes, lambda h: F.xxhash64(h, F.lit(1)))
    sums = lambda hs: [_total(hs, lambda h, s=s: _mask(F.shiftrightunsigned(h, s), UNIT)) for s in SHIFTS]
    return let(again, lambda second: F.array(*sums(hashes), *sums(second)))


def _add_lanes(x: Column, y: Column, sign: int = 1) -> Column:
    """Sum or difference of words, lane by lane."""
    if sign > 0:
        return (_mask(x, MASK ^ TOP) + _mask(y, MASK ^ TOP)).bitwiseXOR(_mask(x.bitwiseXOR(y), TOP))
    return (x.bitwiseOR(F.lit(TOP)) - _mask(y, MASK ^ TOP)).bitwiseXOR(_mask(x.bitwiseXOR(y).bitwiseXOR(F.lit(TOP)), TOP))


def fingerprint(text: Column) -> Column:
    """Array of bigint words."""
    paragraphs = F.split(F.coalesce(text, F.lit("")), "\n")
    sentences = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\n|(?<=[.!?|])[\x20\x09]+"), "")
    chunk = lambda hs, i: F.slice(hs, (i * CHUNK + 1).cast("int"), CHUNK)

    def lanes(hs: Column) -> Column:
        rest = F.transform(F.sequence(F.lit(1), F.floor((F.size(hs) - 1) / CHUNK).cast("int")), lambda i: _lanes(chunk(hs, i)))
        summed = F.aggregate(rest, _lanes(chunk(hs, F.lit(0))), lambda total, more: F.zip_with(total, more, lambda x, y: _add_lanes(x, y)))
        return F.when(F.size(hs) <= CHUNK, _lanes(hs)).otherwise(summed)

    def words(ps: Column, hs: Column) -> Column:
        plain = [F.size(hs).cast("bigint"), F.size(ps).cast("bigint"), _total(ps, lambda p: _mask(F.xxhash64(p))), _total(ps, lambda p: _mask(F.xxhash64(F.lit(1), p)))]
        return F.concat(F.array(*plain), lanes(hs))

    return let(paragraphs, lambda ps: let(F.transform(sentences, lambda s: F.xxhash64(s)), lambda hs: words(ps, hs)))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the paragraphs of ``a`` with those of ``b`` inserted (1) or deleted (-1)."""
    plain = F.zip_with(F.slice(a, 1, PLAIN), F.slice(b, 1, PLAIN), lambda x, y: _mask(x + sign * y))
    part = lambda w: F.slice(w, PLAIN + 1, LANES // PER_WORD)
    return F.concat(plain, F.zip_with(part(a), part(b), lambda x, y: _add_lanes(x, y, sign)))


def as_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.lpad(F.lower(F.hex(w)), MODULUS_BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    half, lane = 1 << LANE_BITS, (1 << LANE_BITS) - 1

    def squares(x: Column, y: Column) -> Column:
        """Sum over a word's lanes of the squared difference of projections, for counts that differ by n; known modulo 2 ** (LANE_BITS + 1)."""
        n = a[0] - b[0]
        out = F.lit(0.0)
        for i in range(PER_WORD):
            at = lambda w, i=i: _mask(F.shiftright(w, LANE_BITS * i), lane)
            gap = F.pmod(2 * (at(x) - at(y)) - n + half, F.lit(2 * half)) - half
            out = out + F.pow(gap.cast("double"), F.lit(2.0))
        return out

    part = lambda w: F.slice(w, PLAIN + 1, LANES // PER_WORD)
    d = F.aggregate(F.zip_with(part(a), part(b), squares), F.lit(0.0), lambda s, x: s + x) / LANES
    both = (a[0] + b[0]).cast("double")
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (both - d) / F.greatest(both + d, F.lit(1.0)))))


def _bucket(doc_id: Column, edges: list[int]) -> Column:
    """Number of edges that are at least the id, found through every root-th edge first; nulls beyond all."""
    root = max(1, math.isqrt(len(edges)))
    rows = [edges[i : i + root] for i in range(0, len(edges), root)]
    lit = lambda xs: F.array(*(F.lit(x).cast("bigint") for x in xs))
    count = lambda xs: F.size(F.filter(xs, lambda e: e > doc_id))
    if not edges:
        return F.when(doc_id.isNull(), 1).otherwise(0)
    # edges descend; all rows before the last whose first edge exceeds the id lie wholly above it
    above = F.greatest(count(lit([r[0] for r in rows])) - 1, F.lit(0))
    found = above * root + count(F.element_at(F.array(*(lit(r) for r in rows)), above + 1))
    return F.when(doc_id.isNull(), len(edges) + 1).otherwise(found)


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 1500, max_buckets: int = 16384) -> DataFrame:
    """doc_id, text, fingerprint, and text and fingerprint of the next document, for every row."""
    ids = docs.select(F.col(id_col).cast("bigint").alias("doc_id"))
    n_buckets = max(1, min(max_buckets, ids.count() // rows_per_bucket))
    edges: list[int] = []
    if n_buckets > 1:
        quantiles = F.percentile_approx("doc_id", [i / n_buckets for i in range(1, n_buckets)], max(10_000, 4 * n_buckets))
        edges = sorted(set(ids.agg(quantiles).first()[0] or []), reverse=True)
    bucket = _bucket(F.col("doc_id"), edges)
    found = ids.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("first"), F.min("doc_id").alias("last"), F.count("*").alias("n")).collect()  # a row for each bucket
    # the rows of a bucket that is one id's (or that of nulls) are dealt by hash to parts of equal ranges, as many as it overfills a bucket times
    fill = max(rows_per_bucket, ids.count() // max_buckets + 1)
    parts = {r["bucket"]: max(1, r["n"] // fill) if r["first"] == r["last"] else 1 for r in found}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = {b: k for b, k in parts.items() if k > 1}
    part = F.lit(0)
    if split:
        many = F.element_at(F.create_map(*(F.lit(x) for kv in split.items() for x in kv)), F.col("bucket"))
        part = F.coalesce(F.floor((F.col("h") / 2.0**64 + 0.5) * many).cast("int"), F.lit(0))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text")).withColumn("bucket", bucket).withColumn("part", part)
    if not found:
        return rows.select("doc_id", "text", fingerprint(F.col("text")).alias("words"), F.col("text").alias("next_text"), fingerprint(F.col("text")).alias("next_words"))
    firsts = [(r["bucket"], 0, r["first"], None) for r in found if r["bucket"] not in split]
    if split:
        filled = rows.where(F.col("bucket").isin(list(split))).groupBy("bucket", "part").agg(F.max("doc_id").alias("first"), F.min("h").alias("h"))
        firsts += [tuple(r) for r in filled.collect()]  # a row for each part
    firsts.sort(key=lambda f: f[:2])
    # guards: the first document of each part, for the part before it (the last part's next is the first); all rows with its id, and its hash where that is told
    guards = docs.sparkSession.createDataFrame([(*f, *firsts[i - 1][:2]) for i, f in enumerate(firsts)], "g_bucket int, g_part int, first bigint, first_h bigint, before int, before_part int")
    marked = rows.join(F.broadcast(guards), (F.col("bucket") == F.col("g_bucket")) & (F.col("part") == F.col("g_part"))).withColumn("words", fingerprint(F.col("text")))
    own = F.struct(F.col("bucket").alias("at"), F.col("part").alias("part"), F.lit(0).alias("guard"))
    copy = F.struct(F.col("before").alias("at"), F.col("before_part").alias("part"), F.lit(1).alias("guard"))
    leads = F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("first_h").isNull() | (F.col("h") == F.col("first_h")))
    dealt = marked.withColumn("to", F.explode(F.when(leads, F.array(own, copy)).otherwise(F.array(own))))
    order = Window.partitionBy("to.at", "to.part").orderBy("to.guard", F.col("doc_id").desc_nulls_last(), "h", "text")
    following = dealt.select("*", F.lead("text").over(order).alias("next_text"), F.lead("words").over(order).alias("next_words"))
    return following.where("to.guard = 0").select("doc_id", "text", "words", "next_text", "next_words")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, with their likeness and the next document's."""
    pairs = edits(docs, id_col, text_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = pairs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    printed = edited.withColumn("edited_words", fingerprint(F.col("edited")))
    return printed.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("words")).alias("fingerprint"),
        as_text(F.col("edited_words")).alias("edited_fingerprint"),
        likeness(F.col("words"), F.col("edited_words")).alias("near_edited"),
        likeness(F.col("words"), F.col("next_words")).alias("near_next"),
    )
