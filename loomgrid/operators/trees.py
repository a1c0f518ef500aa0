"""Histogram trees grown over Spark: second-order boosting, and a forest that balances the classes of each bootstrap by itself.

Rows are binned once by quantile edges and kept as bytes. A level of a tree is one aggregation: tasks add up, in numpy, the statistics of
their rows by (tree, node, column, bin); Spark sums these before and after one shuffle, runs along the bins of each column, and keeps the best cut of
each node. The driver gets a row for each node, which is the size of the model. Sums are whole numbers (``UNIT`` to one), so they don't
depend on how rows are partitioned or on which task is run again. Many or deep trees (forest, gradient boosting) grow by ``operators/subtrees.py``: only their large nodes take a job a level.

* **Boosting**: statistics are gradients and Hessians of the log loss; the gain of a cut is GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2), leaves are
  -G / (H + l2) times the rate; a share of rows and of columns is drawn for each tree by hash, positives weigh ``positive_weight`` (negatives over positives
  if not given). Margins go along with the rows, which are checkpointed every ``CUT_EVERY`` trees.
* **Gradient boosting**, of first order, as Spark's: the first tree fits the labels -1 and 1, the others the negative gradients of the log loss 2 log(1 + exp(-2yF)); cuts have
  the largest fall of the weighted variance among the columns drawn for each node, leaves are weighted means times the rate. Spark's own
  keeps a number for each row and one-hot column, so its work is rows times sensors; here the category is one column.
* **Forest**: each tree takes a row a Poisson number of times, by hash of the row and the tree; its class weights come from its own
  counts (n / (2 n_c)); cuts have the largest fall of the Gini impurity among columns drawn for each node; several trees share a job.

Columns are numbers, cut at x < edge, and one category, of which every value is a column of its own (value against the rest), as
one-hot columns would be. NaN counts as larger than all; a category value unseen in training is none of the known ones.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.lineage import checkpoint, shared_folder, side_by_side, tasks_for
from loomgrid.operators.subtrees import Block, Rule, blocks_of, grow_nodes

UNIT, BINS, CUT_EVERY = 1 << 24, 256, 10
#: Groups of a forest's trees that grow at the same time.
ASIDE = 3
#: Cells that a task adds up in arrays, over all trees of a level: three numbers of 8 bytes each.
TALLY_CELLS = 1 << 23
ROWS = "key bigint, bins binary, category int, y double, margin double"
SUMS = "tree int, slot int, col int, bin int, a bigint, b bigint, n bigint"
#: Cumulative probabilities of a Poisson number of mean 1.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


@dataclass
class Tree:
    """Nodes as lists; column -1 is a leaf, ``columns`` of numbers first, then the category's column; ``cut``: x < cut, or value == cut, goes left."""

    column: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for name, x in (("column", -1), ("bin", 0), ("cut", 0.0), ("left", 0), ("right", 0), ("value", value), ("cover", cover)):
            getattr(self, name).append(x)
        return len(self.column) - 1

    def leaves(self, numbers: np.ndarray, category: np.ndarray, cuts: str = "cut") -> np.ndarray:
        """Node of each row; ``numbers`` are values with ``cut``, or bins with ``bin``."""
        column, cut, left, right = np.array(self.column), np.array(getattr(self, cuts)), np.array(self.left), np.array(self.right)
        node, last = np.zeros(len(category), np.int64), numbers.shape[1] - 1
        while True:
            at = column[node]
            if (at < 0).all():
                return node
            x = numbers[np.arange(len(node)), np.clip(at, 0, last)]
            low = x < cut[node] if cuts == "cut" else x <= cut[node]
            goes_left = np.where(at > last, category == cut[node], low)
            node = np.where(at < 0, node, np.where(goes_left, left[node], right[node]))


def tree_of(nodes: dict[str, np.ndarray], width: int, edges: list[list[float]], value: Callable[[float, float], float], gains: np.ndarray) -> Tree:
    """The tree of the nodes that ``grow_nodes`` found; their gains are added by column."""
    column, at, number = nodes["column"], nodes["bin"], nodes["number"]
    inner = column >= 0
    np.add.at(gains, np.where(column == width, width + at, column)[inner], nodes["gain"][inner])
    cut = [0.0 if c < 0 else float(k) if c == width else edges[c][k] for c, k in zip(column.tolist(), at.tolist(), strict=True)]
    left, right = (np.where(inner, np.searchsorted(number, 2 * number + side), 0).tolist() for side in (0, 1))
    a, b = nodes["a"] / UNIT, nodes["b"] / UNIT
    return Tree(column.tolist(), at.tolist(), cut, left, right, [value(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)], b.tolist())


def uniform(keys: np.ndarray, stream: int) -> np.ndarray:
    """A number from 0 to 1 for each key, another one for each stream."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((stream + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def unpack(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    key, bins, category, y, margin = (batch.column(i) for i in range(5))
    packed = np.frombuffer(b"".join(bins.to_pylist()), np.uint8).reshape(-1, width)
    return key.to_numpy(), packed, category.to_numpy(), y.to_numpy(), margin.to_numpy()


def edges_of(rows: DataFrame, numbers: list[str], bins: int = BINS) -> list[list[float]]:
    """Lower edges of all bins but the first, from approximate quantiles; a column of few values has an edge at each but the least."""
    cuts = F.array(*(F.lit(i / bins) for i in range(bins + 1)))
    found = rows.agg(*(F.percentile_approx(F.col(c).cast("double"), cuts, 40 * bins).alias(c) for c in numbers)).first()
    return [sorted({x for x in found[c] or [] if x is not None and not math.isnan(x)})[1:][: bins - 1] for c in numbers]


def binned(rows: DataFrame, numbers: list[str], category: str, label: str, edges: list[list[float]]) -> DataFrame:
    """ROWS, with a key by the row's content, so that draws by key are the same wherever the row is read."""
    cast = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(numbers)]
    taken = rows.select(*cast, F.col(category).cast("int").alias("category"), F.col(label).cast("double").alias("y"))
    keyed = taken.select(F.xxhash64(*taken.columns).alias("key"), "*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, len(numbers)), np.uint8)
            for i in range(len(numbers)):
                out[:, i] = np.searchsorted(edges[i], b.column(1 + i).to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_pydict({"key": b.column(0), "bins": pa.array([r.tobytes() for r in out], pa.binary()), "category": b.column("category"), "y": b.column("y"), "margin": np.zeros(b.num_rows)})

    return keyed.mapInArrow(run, ROWS)


def dealt(table: DataFrame, rows_per_task: int = 100_000) -> DataFrame:
    """A task for each ``rows_per_task``, or as many as there are cores if that is more, as every level runs over the table again; never more than there were."""
    n = table.count()
    return table.coalesce(max(-(-n // rows_per_task), tasks_for(table.sparkSession, n)))


#: For a tree's number: weights of the rows it takes, and their statistics a and b in whole numbers.
Statistics = Callable[[int, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def level_sums(rows: DataFrame, width: int, trees: dict[int, Tree], open_nodes: dict[int, list[int]], allowed: dict[int, np.ndarray], statistics: Statistics) -> DataFrame:
    """SUMS of the open nodes, numbered by slot, over their allowed columns; column -1 holds a node's totals.

    A node's cells: its totals, ``BINS`` for each column of numbers, one for each category; so they grow with columns and categories, not with their product."""
    spans = {t: 1 + width * BINS + may.shape[1] - width for t, may in allowed.items()}
    tallied: dict[int, int] = {}  # trees for which there is room are added up over the task, the others by batch
    for t, nodes in open_nodes.items():
        size = len(nodes) * spans[t]
        if size + sum(tallied.values()) <= TALLY_CELLS:
            tallied[t] = size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = {t: np.full(len(tree.column), -1, np.int64) for t, tree in trees.items()}
        for t, nodes in open_nodes.items():
            slots[t][nodes] = np.arange(len(nodes))
        tallies = {t: np.zeros((3, size), np.int64) for t, size in tallied.items()}

        def rows_of(t: int, keys: np.ndarray, sums: np.ndarray, span: int) -> pa.RecordBatch:
            slot, cell = keys // span, keys % span - 1
            col = np.where(cell < 0, -1, np.minimum(cell // BINS, width))
            rest = np.where(cell < 0, 0, cell - col * BINS)
            return pa.RecordBatch.from_pydict({"tree": pa.array([t] * len(keys), pa.int32()), **{k: pa.array(v.astype(np.int32)) for k, v in (("slot", slot), ("col", col), ("bin", rest))}, **{k: pa.array(sums[i]) for i, k in enumerate("abn")}})

        for batch in batches:
            key, bins, category, y, margin = unpack(batch, width)
            for t, tree in trees.items():
                count, a, b = statistics(t, key, y, margin)
                slot = slots[t][tree.leaves(bins, category, "bin")]
                taken = np.flatnonzero((slot >= 0) & (count > 0))
                if not len(taken):
                    continue
                s, may = slot[taken], allowed[t]
                categories, span = may.shape[1] - width, spans[t]
                keys, who = [s * span], [taken]
                for c in range(width):
                    ok = may[s, c]
                    keys.append(s[ok] * span + 1 + c * BINS + bins[taken[ok], c])
                    who.append(taken[ok])
                known = category[taken]
                ok = (known >= 0) & (known < categories)
                ok[ok] = may[s[ok], width + known[ok]]
                keys.append(s[ok] * span + 1 + width * BINS + known[ok])
                who.append(taken[ok])
                at, row = np.concatenate(keys), np.concatenate(who)
                if t in tallies:  # sums of a batch fit a double exactly
                    for i, x in enumerate((a, b, count)):
                        tallies[t][i] += np.bincount(at, x[row], tallies[t].shape[1]).astype(np.int64)
                else:
                    cells, inverse = np.unique(at, return_inverse=True)
                    yield rows_of(t, cells, np.stack([np.bincount(inverse, x[row]).astype(np.int64) for x in (a, b, count)]), span)
        for t, tally in tallies.items():
            cells = np.flatnonzero(tally[2])
            yield rows_of(t, cells, tally[:, cells], spans[t])

    parts = rows.mapInArrow(run, SUMS)
    if len(tallied) == len(open_nodes):  # added up by task already: one shuffle by node serves all that follows
        parts = parts.repartition("tree", "slot")
    return parts.groupBy("tree", "slot", "col", "bin").agg(*(F.sum(c).alias(c) for c in "abn"))


def best_cuts(sums: DataFrame, width: int, score: Callable[[str, str], str], least_b: float, least_n: int) -> DataFrame:
    """For each node its totals, and the cut of the largest gain (NULL where none is above 0): the first column, then the first bin among equals.

    ``score``: SQL of what a side with sums a and b counts. All is SQL text, as it is planned anew for each level."""
    total = lambda c: f"max(if(col < 0, {c}, NULL)) OVER (PARTITION BY tree, slot)"
    known = sums.selectExpr("*", f"{total('a')} / {UNIT}D AS aa", f"{total('b')} / {UNIT}D AS ba", f"{total('n')} AS n_all")
    left = lambda c: f"if(col = {width}, {c}, sum({c}) OVER (PARTITION BY tree, slot, col ORDER BY bin ROWS UNBOUNDED PRECEDING))"
    cut = known.selectExpr("tree", "slot", "col", "bin", "aa", "ba", "n_all", f"{left('a')} / {UNIT}D AS a", f"{left('b')} / {UNIT}D AS b", f"{left('n')} AS n")
    gain = f"{score('a', 'b')} + {score('aa - a', 'ba - b')} - {score('aa', 'ba')}"
    fine = f"col >= 0 AND least(b, ba - b) >= {float(least_b)!r}D AND least(n, n_all - n) >= {max(1, least_n)}"
    gained = cut.selectExpr("*", f"if({fine}, {gain}, 0D) AS gain")
    best = F.expr("min(if(gain > 1e-12D, struct(-gain AS loss, col, bin, a, b, n), NULL)) AS best")
    return gained.groupBy("tree", "slot").agg(F.expr("first(aa) AS a_all"), F.expr("first(ba) AS b_all"), F.expr("first(n_all) AS n_all"), best)


def grow(rows: DataFrame, width: int, categories: int, edges: list[list[float]], numbers: list[int], depth: int, columns: Callable[[int, int], np.ndarray], statistics: Statistics, score: Callable[[str, str], str], value: Callable[[float, float], float], least_b: float, least_n: int, gains: np.ndarray, pure: Callable[[float, float], bool] = lambda a, b: False) -> dict[int, Tree]:
    """The trees of these numbers, grown level by level together. ``columns`` draws the allowed columns of (tree, node); ``pure``: no cut can gain."""
    trees, open_nodes = {t: Tree() for t in numbers}, {}
    for t, tree in trees.items():
        open_nodes[t] = [tree.add(0.0, 0.0)]
    for level in range(depth + 1):
        last = level == depth
        allowed = {t: np.array([np.zeros(width + categories, bool) if last else columns(t, n) for n in nodes]) for t, nodes in open_nodes.items()}
        if last and level:
            break
        sums = level_sums(rows, width, {t: trees[t] for t in open_nodes}, open_nodes, allowed, statistics)
        following: dict[int, list[int]] = {}
        found = best_cuts(sums, width, score, least_b, least_n).collect()  # a row for each node of the level
        for r in sorted(found, key=lambda r: (r["tree"], r["slot"])):
            tree, node, best = trees[r["tree"]], open_nodes[r["tree"]][r["slot"]], r["best"]
            tree.value[node], tree.cover[node] = value(r["a_all"], r["b_all"]), r["b_all"]
            if best is None:
                continue
            gains[width + best["bin"] if best["col"] == width else best["col"]] -= best["loss"]
            tree.column[node], tree.bin[node] = best["col"], best["bin"]
            tree.cut[node] = float(best["bin"]) if best["col"] == width else edges[best["col"]][best["bin"]]
            left, right = (best["a"], best["b"], best["n"]), (r["a_all"] - best["a"], r["b_all"] - best["b"], r["n_all"] - best["n"])
            tree.left[node], tree.right[node] = (tree.add(value(a, b), b) for a, b, _ in (left, right))
            for child, (a, b, n) in ((tree.left[node], left), (tree.right[node], right)):
                if b >= 2 * least_b and n >= 2 * max(1, least_n) and not pure(a, b):  # else no cut is fine
                    following.setdefault(r["tree"], []).append(child)
        open_nodes = following
        if not open_nodes:
            break
    return trees


@dataclass
class Ensemble:
    """Trees whose values are added (``boosting``: to a margin) or averaged (``forest``: to a probability)."""

    kind: str
    numbers: list[str]
    category: str
    categories: int
    trees: list[Tree]
    gains: list[float]

    def to_json(self) -> str:
        return json.dumps({**vars(self), "trees": [vars(t) for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Ensemble:
        found = json.loads(text)
        return Ensemble(**{**found, "trees": [Tree(**t) for t in found["trees"]]})

    def raw(self, numbers: np.ndarray, category: np.ndarray) -> np.ndarray:
        total = np.zeros(len(category))
        for tree in self.trees:
            total += np.array(tree.value)[tree.leaves(numbers, category)]
        return total if self.kind == "boosting" else total / max(1, len(self.trees))

    def probability(self, numbers: np.ndarray, category: np.ndarray) -> np.ndarray:
        raw = self.raw(numbers, category)
        return 1 / (1 + np.exp(-raw)) if self.kind == "boosting" else raw


def fit_boosting(rows: DataFrame, numbers: list[str], category: str, categories: int, label: str, rounds: int, depth: int, rate: float, subsample: float = 0.8, colsample: float = 0.8, min_child_weight: float = 5.0, l2: float = 1.0, positive_weight: float | None = None, bins: int = BINS, seed: int = 42) -> Ensemble:
    width, edges = len(numbers), edges_of(rows, numbers, bins)
    table = dealt(checkpoint(binned(rows, numbers, category, label, edges)))
    n, positives = table.agg(F.count("*"), F.sum("y")).first()
    weight = positive_weight if positive_weight is not None else ((n - positives) / positives if positives else 1.0)
    whole, gains, out = width + categories, np.zeros(width + categories), []

    def statistics(t: int, key: np.ndarray, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, w = 1 / (1 + np.exp(-margin)), np.where(y == 1, weight, 1.0)
        return (uniform(key, seed * 1_000_003 + t) < subsample).astype(np.int64), np.rint((p - y) * w * UNIT), np.rint(p * (1 - p) * w * UNIT)

    def columns(t: int, node: int) -> np.ndarray:
        drawn = np.random.default_rng((seed, t)).permutation(whole)[: max(1, int(colsample * whole))]
        return np.isin(np.arange(whole), drawn)

    def added(tree: Tree) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, found, which, _, margin = unpack(batch, width)
                yield batch.set_column(4, "margin", pa.array(margin + np.array(tree.value)[tree.leaves(found, which, "bin")]))

        return run

    score = lambda g, h: f"coalesce(try_divide(({g}) * ({g}), ({h}) + {float(l2)!r}D), 0D)"
    value = lambda g, h: -rate * g / (h + l2) if h + l2 else 0.0
    read = None  # what the table is computed from; it is held until the table has been read, else each tree would start from the last checkpoint
    for t in range(rounds):
        tree = grow(table, width, categories, edges, [t], depth, columns, statistics, score, value, min_child_weight, 1, gains)[t]
        out.append(tree)
        if read is not None:
            read.unpersist()
        if t + 1 == rounds or (len(tree.column) == 1 and not tree.value[0]):
            break
        following = table.mapInArrow(added(tree), ROWS)
        read, table = table, checkpoint(following) if (t + 1) % CUT_EVERY == 0 else following.persist()
    table.unpersist()
    return Ensemble("boosting", numbers, category, categories, out, gains.tolist())


def fit_gradient_boosting(rows: DataFrame, numbers: list[str], category: str, categories: int, label: str, rounds: int, depth: int, rate: float, subsample: float = 0.8, colsample: float = 0.8, min_leaf: int = 5, bins: int = 32, seed: int = 42) -> Ensemble:
    """Boosting of first order with the classes balanced. Margins are 2F, so that a probability is their logistic function."""
    spark, width, edges = rows.sparkSession, len(numbers), edges_of(rows, numbers, bins)
    shared_folder(spark)
    table = dealt(checkpoint(binned(rows, numbers, category, label, edges)))
    n, positives = table.agg(F.count("*"), F.sum("y")).first()
    weight = (n - positives) / positives if positives else 1.0
    whole, gains, out = width + categories, np.zeros(width + categories), []
    tried = math.ceil(colsample * whole)

    def columns(t: int, node: int) -> np.ndarray:
        left_out = np.random.default_rng((seed, t, node)).choice(whole, whole - tried, replace=False, shuffle=False)
        return np.delete(np.arange(whole), left_out)

    def statistics(t: int, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, w = 1 / (1 + np.exp(-block.margin)), np.where(block.y == 1, weight, 1.0)
        return (uniform(block.key, seed * 1_000_003 + t) < subsample).astype(np.uint8), np.rint((p - block.y) * w * UNIT), np.rint(w * UNIT)

    def added(tree: Tree) -> Callable[[Block], Block]:
        return lambda block: replace(block, margin=block.margin + np.array(tree.value)[tree.leaves(block.bins.T, block.category, "bin")])

    score = lambda a, b: np.divide(a * a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)
    rule = Rule(width, categories, bins, depth, UNIT, 0.0, min_leaf, statistics, score, columns, lambda a, b: np.zeros(np.shape(a), bool))
    blocks, read = blocks_of(table, width), None  # as in ``fit_boosting``, blocks are held until their successors have been read
    for t in range(rounds):
        factor = 2.0 if t == 0 else 4.0  # what is fitted is -1 or 1 (twice y - p, as p is a half) and 4 (y - p)
        step, own = 2 * factor * (1.0 if t == 0 else rate), np.zeros(whole)
        tree = tree_of(grow_nodes(blocks, n, rule, [t])[t], width, edges, lambda a, b, step=step: -step * a / b if b else 0.0, own)
        out.append(tree)
        gains += factor * factor * own
        if read is not None:
            read.unpersist()
        if t + 1 == rounds or (len(tree.column) == 1 and not tree.value[0]):
            break
        read, blocks = blocks, blocks.map(added(tree)).persist(StorageLevel.MEMORY_AND_DISK)
        if (t + 1) % CUT_EVERY == 0:
            blocks.checkpoint()
    blocks.unpersist()
    return Ensemble("boosting", numbers, category, categories, out, gains.tolist())


def bootstrap_counts(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often the tree's bootstrap holds each row."""
    return np.searchsorted(POISSON, uniform(key, seed * 1_000_003 + tree), "right").astype(np.int64)


def bootstrap_classes(table: DataFrame, trees: list[int], seed: int, width: int) -> dict[int, dict[int, float]]:
    """For each tree the weights of the two classes, n / (2 n_c) by the counts of its own bootstrap; 0 for a class that it doesn't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, _, _, y, _ = unpack(batch, width)
            rows = [(t, c, int(bootstrap_counts(key[y == c], t, seed).sum())) for t in trees for c in (0, 1)]
            yield pa.RecordBatch.from_pydict(dict(zip(("tree", "y", "n"), (pa.array(x) for x in zip(*rows, strict=True)), strict=True)))

    found = table.mapInArrow(run, "tree bigint, y bigint, n bigint").groupBy("tree", "y").agg(F.sum("n").alias("n")).collect()  # two rows for each tree
    counts = {(r["tree"], r["y"]): r["n"] for r in found}
    total = lambda t: sum(counts.get((t, c), 0) for c in (0, 1))
    return {t: {c: total(t) / (2 * counts[t, c]) if counts.get((t, c)) else 0.0 for c in (0, 1)} for t in trees}


def fit_forest(rows: DataFrame, numbers: list[str], category: str, categories: int, label: str, trees: int, depth: int, min_leaf: int = 5, bins: int = BINS, seed: int = 42, together: int = 40) -> Ensemble:
    width, edges = len(numbers), edges_of(rows, numbers, bins)
    table = dealt(checkpoint(binned(rows, numbers, category, label, edges)))
    blocks, n = blocks_of(table, width), table.count()
    whole, gains, out = width + categories, np.zeros(width + categories), []
    tried = max(1, int(math.sqrt(whole)))

    def columns(t: int, node: int) -> np.ndarray:
        return np.random.default_rng((seed, t, node)).choice(whole, tried, replace=False, shuffle=False)

    # a: weight of positives, b: of all; the sum of squared class weights over the weight is what the Gini impurity takes from it
    score = lambda a, b: np.divide(a * a + (b - a) * (b - a), b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)
    value = lambda a, b: a / b if b else 0.0

    def grown(first: int) -> tuple[list[Tree], np.ndarray]:
        numbers_of, own = list(range(first, min(trees, first + together))), np.zeros(whole)
        weights = bootstrap_classes(table, numbers_of, seed, width)

        def statistics(t: int, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            count = bootstrap_counts(block.key, t, seed).astype(np.uint8)
            w = np.rint(count * np.where(block.y == 1, weights[t][1], weights[t][0]) * UNIT)
            return count, w * (block.y == 1), w

        rule = Rule(width, categories, bins, depth, UNIT, 0.0, min_leaf, statistics, score, columns, lambda a, b: (a <= 0) | (a >= b))
        found = grow_nodes(blocks, n, rule, numbers_of)
        return [tree_of(found[t], width, edges, value, own) for t in numbers_of], own

    starts = list(range(0, trees, together))
    for at in range(0, len(starts), ASIDE):  # groups of trees don't depend on one another
        for found, own in side_by_side(table.sparkSession, [partial(grown, first) for first in starts[at : at + ASIDE]]):
            out, gains = out + found, gains + own
    blocks.unpersist()
    return Ensemble("forest", numbers, category, categories, out, gains.tolist())


class TreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` and ``prediction``; saved and loaded like any stage of a pipeline."""

    ensemble = Param(Params._dummy(), "ensemble", "the trees as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, ensemble: str | None = None):
        super().__init__()
        if ensemble is not None:
            self._set(ensemble=ensemble)

    @property
    def trees(self) -> Ensemble:
        return Ensemble.from_json(self.getOrDefault(self.ensemble))

    @property
    def featureImportances(self):
        gains = np.array(self.trees.gains)
        return Vectors.dense(gains / gains.sum() if gains.sum() else gains)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        found = self.trees

        def run(parts: Iterator[tuple]) -> Iterator[pa.Array]:
            for part in parts:
                values = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part[:-1]], 1)
                yield pa.array(found.probability(values, part[-1].to_numpy(zero_copy_only=False)))

        run.__annotations__ = {"parts": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
        p = F.arrow_udf(run, "double")(*(F.col(c).cast("double") for c in found.numbers), F.col(found.category).cast("double"))
        scored = dataset.withColumn("probability", p)
        return scored.withColumn("prediction", (F.col("probability") >= 0.5).cast("double")).withColumn("probability", array_to_vector(F.array(1 - F.col("probability"), F.col("probability"))))


class Boosting(Estimator):
    """Second-order boosting as a stage of a pipeline."""

    def __init__(self, numbers: list[str], category: str, label: str = "label", **settings):
        super().__init__()
        self.numbers, self.category, self.label, self.settings, self.learn = numbers, category, label, settings, fit_boosting

    def _fit(self, dataset: DataFrame) -> TreesModel:
        categories = int(dataset.agg(F.max(self.category)).first()[0] or 0) + 1
        return TreesModel(ensemble=self.learn(dataset, self.numbers, self.category, categories, self.label, **self.settings).to_json())


class GradientBoosting(Boosting):
    """Boosting of first order as a stage of a pipeline."""

    def __init__(self, numbers: list[str], category: str, label: str = "label", **settings):
        super().__init__(numbers, category, label, **settings)
        self.learn = fit_gradient_boosting


class BalancedForest(Boosting):
    """A forest whose trees weigh the classes by their own bootstraps."""

    def __init__(self, numbers: list[str], category: str, label: str = "label", **settings):
        super().__init__(numbers, category, label, **settings)
        self.learn = fit_forest
