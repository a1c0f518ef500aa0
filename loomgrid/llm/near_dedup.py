"""MinHash near-duplicate groups with tensored banding.

Two collections of ``side`` half-keys each are drawn; a half-key joins ``width`` minhashes. A hash table exists
for every pair of a half-key of the first and one of the second collection, so ``side * side`` tables of
``2 * width`` minhashes cost only ``2 * side * width`` minhashes for each text. Two sets of similarity j
share a table unless all half-keys of a collection differ, with probability at most
2 * (1 - j**width)**side: 8.7e-5 at j = 0.8 and 2.3e-8 at 0.9 for the defaults, the only way to lose a link.

1. Each text becomes its set of distinct shingle hashes (64 bits), of which go on: its size, a 128-bit digest
   and the half-keys. Texts with equal sets form a class in one aggregation. From here on a class goes by 64 bits of
   its digest, never by an id, so rows that share an id keep their own sets.
2. Only half-keys that at least two classes have go on; the tables' keys are formed of those.
3. Shingles that no other class in the tables has can't be shared, so a set of n shingles, s of them held by
   others, links with another only if the smaller s reaches num / (num + den) of the summed sizes. This exact
   bound drops sets and pairs from here on that can't reach the similarity, whatever the group's size.
4. In each table a bucket's members are compared with the member that shares most of its shingles, each with the
   one it meets in most tables; links are confirmed on the full sets and give components.
5. Sets that meet such a member in at least ``support`` tables form families with it. In a family of several
   components all that lie outside its largest component are compared with the whole family: the former are dealt to
   blocks of about ``block`` shingles, the latter too, and each task holds one block of either. It counts
   overlaps by a matrix product for shingles that many hold and by an inverted index for the others, and returns
   one link between two components at most for each set, never pairs. With x outsiders (in shingles, over block) and m
   members the family is copied x / block times; the comparing grows with x * m.
6. Members of different families that still share a bucket are compared pair by pair, if the bound allows a link.

So every two texts that share a bucket and may be linked are compared, or lie in one component already.
Nothing caps buckets or partners. Components stay in Spark.

Defined results: a null or blank text has an empty set and is its own component; a component goes by its smallest id,
and by null where all its ids are null; repeated rows share their component; rows that share an id but not a text are
judged by their own sets; an empty table gives an empty result; other columns are ignored by ``near_duplicates``.
``keep_one`` keeps exactly one row of each component (of smallest id, null ids last, then of smallest text digest), also of
rows that are repeated whole, and every row without words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.batches import sliced
from loomgrid.llm.common import SPACE, checkpoint, fresh
from loomgrid.llm.components import components

_RNG = np.random.default_rng(20240917)
_BYTE = _RNG.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1 << 62)) * 2 + 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and how many each text has."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw).lower() + b"\n", np.uint8)
    ends_of_texts = np.cumsum([len(r) + 1 for r in raw])
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space))))
    begins, ends = edges[0::2], edges[1::2]
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    lengths = ends - begins
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    powers = np.full(int(lengths.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    letters = data[~space]
    place = np.arange(len(letters)) - np.repeat(firsts, lengths)
    hashes = _mix(np.add.reduceat(_BYTE[letters] * powers[place], firsts) + lengths.astype(np.uint64))
    return hashes, np.diff(np.concatenate(([0], np.searchsorted(begins, ends_of_texts))))


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words; of the whole sequence where a text has fewer."""
    words, counts = word_hashes(texts)
    factors = [np.uint64(int(f) * 2 + 1) for f in np.random.default_rng(7).integers(1 << 62, size=size)]
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for i, f in enumerate(factors):
        rolled[: n - i] += words[i:] * f
    rolled = _mix(rolled)
    out, at = [], 0
    for count in counts.tolist():
        if count >= size:
            out.append(np.unique(rolled[at : at + count - size + 1]))
        elif count:
            weighed = words[at : at + count] * np.array(factors[:count], np.uint64)
            out.append(_mix(weighed.sum(keepdims=True) + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out


def digests_of(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit sums of mixed hashes for each set; no set is empty."""
    everything = np.concatenate(sets)
    firsts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    return np.stack([np.add.reduceat(_mix(everything ^ np.uint64(s)), firsts) for s in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)], axis=1).view(np.int64)


class HalfKeys:
    """Half-keys of both collections, and the digest of a set."""

    def __init__(self, side: int, width: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.side, self.width, n = side, width, 2 * side * width
        self.factors = (rng.integers(1 << 31, size=n, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
        self.terms = rng.integers(1 << 32, size=n, dtype=np.uint32)
        self.joins = rng.integers(1 << 63, size=width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(half-keys by set, digests by set) of sets that aren't empty."""
        everything = np.concatenate(sets)
        firsts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
        short = (everything >> np.uint64(32)).astype(np.uint32) ^ everything.astype(np.uint32)
        least = np.empty((len(sets), len(self.factors)), np.uint32)
        for k, (f, t) in enumerate(zip(self.factors, self.terms, strict=True)):
            least[:, k] = np.minimum.reduceat(short * f + t, firsts)
        grouped = least.reshape(len(sets), 2 * self.side, self.width).astype(np.uint64)
        keys = _mix((grouped * self.joins).sum(axis=2, dtype=np.uint64) + np.arange(2 * self.side, dtype=np.uint64))
        return keys.view(np.int64), digests_of(sets)


def _signatures(shingle: int, side: int, width: int):
    """Rows of z, k, text, t to rows of z, k, t with size, digest and half-keys of the text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = HalfKeys(side, width)
        for part, texts in sliced(batches, "text", 1 << 20):
            sets = shingle_sets(texts, shingle)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, digests = maker.of([sets[i] for i in full]) if full else (np.zeros((0, 2 * side), np.int64), np.zeros((0, 2), np.int64))
            row = np.full(len(sets), -1)
            row[full] = np.arange(len(full))
            pick = pa.array([r if r >= 0 else None for r in row.tolist()], pa.int64())
            nested = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, 2 * side, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_pydict({
                "z": part.column("z"), "k": part.column("k"), "t": part.column("t"), "n": np.array([len(s) for s in sets], np.int64),
                "d1": pa.array(digests[:, 0].copy()).take(pick), "d2": pa.array(digests[:, 1].copy()).take(pick), "keys": nested.take(pick),
            })

    return run


def _sets(shingle: int):
    """Rows of node, z, k, text to node, z, k and shingles, where the text's set is the node's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches, "text", 1 << 20):
            sets = shingle_sets(texts, shingle)
            own = [i for i, (s, node) in enumerate(zip(sets, part.column("node").to_pylist(), strict=True)) if len(s) and int(digests_of([s])[0, 0]) == node]
            sizes = np.cumsum([0, *(len(sets[i]) for i in own)], dtype=np.int32)
            values = np.concatenate([sets[i] for i in own]).view(np.int64) if own else np.zeros(0, np.int64)
            kept = part.select(["node", "z", "k"]).take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.ListArray.from_arrays(sizes, pa.array(values))], ["node", "z", "k", "shingles"])

    return run


_PAIR = ", ".join(f"{x}_{c}" for x in "uv" for c in ("z boolean", "k bigint", "node bigint"))


def _confirm(numerator: int, denominator: int):
    """Pairs whose sets' intersection is at least numerator / denominator of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b in zip(batch.column("u_shingles"), batch.column("v_shingles"), strict=True):
                x, y = (s.values.to_numpy().view(np.uint64) for s in (a, b))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int(np.count_nonzero(y[at] == x))
                kept.append(denominator * both >= numerator * (len(x) + len(y) - both))
            yield batch.select([c.split()[0] for c in _PAIR.split(", ")]).filter(pa.array(kept, pa.bool_()))

    return run


class Overlaps:
    """Sizes of the intersections of given sets with the sets of a block.

    Shingles that at least a sixteenth of the block's sets hold (the most frequent ones, as far as a matrix of ``cells``
    numbers has room for them) are counted by a matrix product, the others by an inverted index. Both counts are exact.
    """

    def __init__(self, values: np.ndarray, sizes: np.ndarray, cells: int = 16_000_000):
        self.sets = len(sizes)
        order = np.argsort(values, kind="stable")
        self.holders = np.repeat(np.arange(self.sets), sizes)[order]
        self.keys, self.begins, self.counts = np.unique(values[order], return_index=True, return_counts=True)
        often = np.flatnonzero(self.counts >= max(2, self.sets // 16))
        often = often[np.argsort(-self.counts[often], kind="stable")][: cells // max(1, self.sets)]
        self.column = np.full(len(self.keys), -1)
        self.column[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), self.sets), np.float32)
        for column, key in enumerate(often.tolist()):
            self.matrix[column, self.holders[self.begins[key] : self.begins[key] + self.counts[key]]] = 1

    def of(self, sets: list[np.ndarray]) -> np.ndarray:
        dense, out = np.zeros((len(sets), len(self.matrix)), np.float32), np.zeros((len(sets), self.sets), np.int64)
        for i, mine in enumerate(sets):
            at = np.minimum(np.searchsorted(self.keys, mine), len(self.keys) - 1)
            at = at[self.keys[at] == mine]
            column = self.column[at]
            dense[i, column[column >= 0]] = 1
            at = at[column < 0]
            if len(at):
                n = self.counts[at]
                picked = np.repeat(self.begins[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                out[i] = np.bincount(self.holders[picked], minlength=self.sets)
        return out + (dense @ self.matrix).astype(np.int64)


def _compare(numerator: int, denominator: int, step: int = 256):
    """Links between components of the sets of a block of outsiders and a block of members."""

    def run(table: pa.Table) -> pa.Table:
        outside = table.column("outside").to_numpy()
        comps = table.column("component").to_numpy()
        lists = table.column("shingles").combine_chunks()
        offsets = lists.offsets.to_numpy()
        values, sizes = lists.values.to_numpy(), np.diff(offsets)
        left, right = np.flatnonzero(outside), np.flatnonzero(~outside)
        us, vs = [], []
        if len(left) and len(right):
            block = Overlaps(np.concatenate([values[offsets[b] : offsets[b + 1]] for b in right.tolist()]), sizes[right])
            for at in range(0, len(left), step):
                rows = left[at : at + step]
                both = block.of([values[offsets[a] : offsets[a + 1]] for a in rows.tolist()])
                linked = denominator * both >= numerator * (sizes[rows][:, None] + sizes[right][None, :] - both)
                linked &= comps[rows][:, None] != comps[right][None, :]
                for a in np.flatnonzero(linked.any(axis=1)).tolist():
                    found = right[linked[a]]
                    for b in np.unique(comps[found], return_index=True)[1].tolist():  # one link to a component is enough
                        us.append(rows[a])
                        vs.append(found[b])
        ends = [table.select(["z", "k", "node"]).take(pa.array(x, pa.int64())) for x in (us, vs)]
        return pa.table([c for e in ends for c in e.columns], names=[c.split()[0] for c in _PAIR.split(", ")])

    return run


def _end(prefix: str, kind: int = 0) -> Column:
    """Node of a graph: ordered by kind, whether its ids are all null, smallest id (of a null id: its text's hash), class."""
    return F.struct(F.lit(kind).alias("kind"), F.col(f"{prefix}z").alias("z"), F.col(f"{prefix}k").alias("k"), F.col(f"{prefix}node").alias("node"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, text_key: Column, shingle: int, similarity: tuple[int, int], side: int, width: int, support: int, block: int) -> DataFrame:
    """z, k, t, n of every row, ``low`` (z, k, t of its class) and ``comp`` (the component's smallest node; null if the class has no links), and the row's ``node``."""
    num, den = similarity
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own_id = F.col(id_col).cast("bigint")
    texts = docs.select(own_id.isNull().alias("z"), F.coalesce(own_id, F.xxhash64(text)).alias("k"), text.alias("text"), text_key.alias("t"))
    found = checkpoint(texts.mapInArrow(_signatures(shingle, side, width), "z boolean, k bigint, t string, n bigint, d1 bigint, d2 bigint, keys array<bigint>"))

    digest = ["n", "d1", "d2"]
    # stored, so that the join of rows with classes below stands between plain shuffles and a class of very many rows can be split
    classes = checkpoint(found.where("n > 0").groupBy(*digest).agg(F.min(F.struct("z", "k", "t")).alias("low"), F.first("keys").alias("keys")))
    reps = classes.select(F.col("d1").alias("node"), "n", F.posexplode("keys").alias("i", "key"))
    shared = reps.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    half = lambda first: F.array_distinct(F.collect_list(F.when((F.col("i") < side) == first, F.col("key"))))  # noqa: E731  at most ``side`` keys
    live = reps.join(shared, "key").groupBy("node").agg(F.max("n").alias("n"), half(True).alias("a"), half(False).alias("b")).where("size(a) > 0 and size(b) > 0")
    live = checkpoint(live.join(classes.select(F.col("d1").alias("node"), "low.z", "low.k"), "node"))
    wanted = live.select("node", F.col("z").alias("own_z"), F.col("k").alias("own_k"))
    loaded = texts.join(wanted, (F.col("k") == F.col("own_k")) & (F.col("z") == F.col("own_z"))).select("node", "z", "k", "text")
    sets = checkpoint(loaded.mapInArrow(_sets(shingle), "node bigint, z boolean, k bigint, shingles array<bigint>"))
    if sets.count() > live.count():  # rows with equal id and set
        sets = checkpoint(sets.dropDuplicates(["node"]))

    alone = sets.select("node", F.explode("shingles").alias("g")).groupBy("g").agg(F.count("*").alias("holders"), F.min("node").alias("node")).where("holders = 1").groupBy("node").agg(F.count("*").alias("alone"))
    held = live.join(alone, "node", "left").withColumn("s", F.col("n") - F.coalesce("alone", F.lit(0))).where(F.col("s") * den >= F.col("n") * num)
    tables = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    buckets = held.select("node", "n", "s", F.explode(tables).alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.count("*").alias("members"), F.max(F.struct((F.col("s") / F.col("n")).alias("share"), "node", "n", "s")).alias("hub")).where("members > 1")
    hubs = hubs.select("bucket", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.s").alias("hub_s"))
    buckets = checkpoint(buckets.join(hubs, "bucket"))
    can = lambda s, n, t, m: F.least(s, t) * (num + den) >= (F.col(n) + F.col(m)) * num

    # each member with the hub that it meets in most tables
    met = buckets.where((F.col("node") != F.col("hub")) & can("s", "n", "hub_s", "hub_n")).groupBy("node", "hub").agg(F.count("*").alias("tables"))
    met = checkpoint(met)
    first = met.groupBy("node").agg(F.max_by("hub", F.struct("tables", "hub")).alias("hub")).select(F.col("node").alias("u_node"), F.col("hub").alias("v_node"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        u, v = (sets.select(*(F.col(c).alias(f"{x}_{c}") for c in ("node", "z", "k", "shingles"))) for x in "uv")
        return pairs.join(u, "u_node").join(v, "v_node").mapInArrow(_confirm(num, den), _PAIR)

    ends = lambda pairs: pairs.select(_end("u_").alias("u"), _end("v_").alias("v"))
    family_end = lambda c: F.struct(F.lit(1).alias("kind"), F.lit(False).alias("z"), F.lit(0).cast("bigint").alias("k"), F.col(c).alias("node"))
    kin = met.where(F.col("tables") >= support).select(family_end("node").alias("u"), family_end("hub").alias("v"))
    both = components(ends(confirmed(first)).unionByName(kin))  # links and families side by side
    stars = both.where("node.kind = 0")
    named = lambda kind, name: both.where(F.col("node.kind") == kind).select("node.node", F.col("component.node").alias(name))
    known = held.select("node", "n", "s").join(named(0, "component"), "node", "left").join(named(1, "family"), "node", "left")
    known = checkpoint(known.select("node", "n", "s", F.coalesce("component", "node").alias("component"), F.coalesce("family", "node").alias("family")))

    parts = known.groupBy("family", "component").agg(F.sum("n").alias("mass"))
    families = parts.groupBy("family").agg(F.count("*").alias("parts"), F.sum("mass").alias("mass"), F.max(F.struct("mass", "component")).alias("main")).where("parts > 1")
    families = families.select("family", F.col("main.component").alias("main"), F.ceil(F.col("mass") / block).alias("whole"), F.ceil((F.col("mass") - F.col("main.mass")) / block).alias("out"))
    own = lambda n: F.pmod(F.xxhash64("node"), n)
    up_to = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    place = lambda outside, i, j: F.struct(F.lit(outside).alias("outside"), i.alias("i"), j.alias("j"))
    as_member = F.transform(up_to("out"), lambda i: place(False, i, own(F.col("whole"))))
    as_outsider = F.transform(up_to("whole"), lambda j: place(True, own(F.col("out")), j))
    places = F.when(F.col("component") == F.col("main"), as_member).otherwise(F.concat(as_member, as_outsider))
    loaded = known.join(families, "family").join(sets, "node").select("node", "z", "k", "component", "family", "shingles", F.explode(places).alias("at"))
    loaded = loaded.select("node", "z", "k", "component", "family", "shingles", "at.outside", "at.i", "at.j")
    inner = loaded.groupBy("family", "i", "j").applyInArrow(_compare(num, den), _PAIR)

    placed = buckets.select("bucket", "node").join(known, "node")
    mixed = placed.groupBy("bucket").agg(F.min("family").alias("low"), F.max("family").alias("high")).where("low < high").select("bucket")
    open_ = checkpoint(placed.join(mixed, "bucket"))
    u, v = (open_.select("bucket", *(F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "s", "component", "family"))) for x in "uv")
    apart = (F.col("u_family") < F.col("v_family")) & (F.col("u_component") != F.col("v_component"))
    rest = u.join(v, (u["bucket"] == v["bucket"]) & apart & can("u_s", "u_n", "v_s", "v_n")).select("u_node", "v_node").distinct()
    more = checkpoint(ends(inner.unionByName(confirmed(rest))))
    labels = stars if more.isEmpty() else components(stars.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))

    labelled = classes.select(*digest, "low").join(labels.select(F.col("node.node").alias("d1"), F.col("component").alias("comp")), "d1", "left")
    return found.drop("keys").join(labelled, digest, "left").withColumnRenamed("d1", "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (80, 100), side: int = 14, width: int = 3, support: int = 4, block: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row; ``similarity`` as a fraction of intersection over union."""
    rows = _grouped(docs, id_col, text_col, F.lit(""), shingle, similarity, side, width, support, block)
    doc_id = F.when(~F.col("z"), F.col("k"))
    least = F.when(F.col("comp").isNotNull(), F.struct("comp.z", "comp.k")).when(F.col("low").isNotNull(), F.struct("low.z", "low.k")).otherwise(F.struct("z", "k"))
    rows = rows.select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), least.alias("least"))
    component = F.when(~F.col("least.z"), F.col("least.k"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (80, 100), side: int = 14, width: int = 3, support: int = 4, block: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that represent their group, with their own columns; rows without words stay.

    Rows are told by id and text digest; the few that are repeated whole are brought together, the others aren't.
    """
    z, k, t, again = (fresh(docs, c) for c in ("dedup_z", "dedup_k", "dedup_t", "dedup_again"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own_id = F.col(id_col).cast("bigint")
    rows = _grouped(docs, id_col, text_col, F.md5(text.cast("binary")), shingle, similarity, side, width, support, block).where("n > 0")
    chosen = rows.where((F.col("comp").isNull() | (F.col("comp.node") == F.col("node"))) & (F.struct("z", "k", "t") == F.col("low")))
    chosen = checkpoint(chosen.groupBy(F.col("z").alias(z), F.col("k").alias(k), F.col("t").alias(t)).agg((F.count("*") > 1).alias(again)))
    marked = docs.withColumns({z: own_id.isNull(), k: F.coalesce(own_id, F.xxhash64(text)), t: F.md5(text.cast("binary"))})
    worded = F.coalesce(F.col(text_col), F.lit("")).rlike(f"[^{SPACE[1:-1]}]")
    kept = marked.where(worded).join(chosen.where(~F.col(again)), [z, k, t], "left_semi").select(*docs.columns).unionByName(docs.where(~worded))
    repeated = chosen.where(again)
    if repeated.isEmpty():
        return kept
    return kept.unionByName(marked.where(worded).join(repeated, [z, k, t], "left_semi").dropDuplicates([z, k, t]).select(*docs.columns))
