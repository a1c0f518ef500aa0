"""Growing of many or deep trees: large nodes by histograms over Spark, small ones whole in the task that gets their rows.

A partition of binned rows is one block of arrays. A level of the large nodes is one job: each task adds up its block by (tree, node, column, bin), a
shuffle brings a node's sums together, and its best cut goes to the driver. Nodes of at most ``LOCAL_ROWS`` rows wait; at the end one more job sends
each of them its rows and grows what hangs below it. So the jobs of a tree are bounded by its large nodes, of which a level has at most rows / ``LOCAL_ROWS``,
and what a task holds by ``LOCAL_ROWS``, a block and the sums of a node. Sums are whole numbers, so a tree doesn't depend on how rows are partitioned or on which nodes are large.

Nodes are numbered as in a heap (1; the children of k are 2k and 2k + 1); a node's columns are drawn by tree and number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.rdd import RDD
from pyspark.sql import DataFrame

LOCAL_ROWS = 200_000
#: Rows of all the nodes that a task finishes, about.
TASK_ROWS = 1_000_000
#: Pairs of node and category, drawn or not, that a task looks up in a table rather than by search; four for each row come on top.
DIRECT_CELLS = 1 << 16
FIELDS = ("number", "column", "bin", "a", "b", "gain")


@dataclass
class Block:
    """Rows of a partition; ``bins`` has a row for each column."""

    key: np.ndarray
    bins: np.ndarray
    category: np.ndarray
    y: np.ndarray
    margin: np.ndarray


@dataclass(frozen=True)
class Rule:
    """How trees grow. ``statistics``: of a tree's number and a block how often it takes each row, and a and b for each of these; ``score``: what a side of sums a and b
    counts; ``columns``: those drawn for (tree, node number); ``pure``: where no cut can gain."""

    width: int
    categories: int
    bins: int
    depth: int
    unit: int
    least_b: float
    least_n: int
    statistics: Callable[[int, Block], tuple[np.ndarray, np.ndarray, np.ndarray]]
    score: Callable[[np.ndarray, np.ndarray], np.ndarray]
    columns: Callable[[int, int], np.ndarray]
    pure: Callable[[np.ndarray, np.ndarray], np.ndarray]

    def open(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (b >= 2 * self.least_b) & (n >= 2 * max(1, self.least_n)) & ~self.pure(a, b)


def blocks_of(rows: DataFrame, width: int) -> RDD:
    """A Block for each partition of ``rows`` (key, bins, category, y, margin)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), rows_schema)
        bins = np.frombuffer(b"".join(table["bins"].to_pylist()), np.uint8).reshape(-1, width)
        arrays = table["key"].to_numpy(), np.ascontiguousarray(bins.T), table["category"].to_numpy().astype(np.int32), table["y"].to_numpy(), table["margin"].to_numpy()
        if table.num_rows:
            yield pa.RecordBatch.from_pydict({name: pa.array([x.tobytes()], pa.large_binary()) for name, x in zip(Block.__annotations__, arrays, strict=True)})

    def unpacked(row) -> Block:
        key, bins, category, y, margin = (np.frombuffer(row[i], kind) for i, kind in enumerate((np.int64, np.uint8, np.int32, np.float64, np.float64)))
        return Block(key, bins.reshape(width, -1), category, y, margin)

    rows_schema = pa.schema([("key", pa.int64()), ("bins", pa.binary()), ("category", pa.int32()), ("y", pa.float64()), ("margin", pa.float64())])
    return rows.mapInArrow(packed, ", ".join(f"{name} binary" for name in Block.__annotations__)).rdd.map(unpacked).persist(StorageLevel.MEMORY_AND_DISK)


def places(column: np.ndarray, cut: np.ndarray, left: np.ndarray, bins: np.ndarray, category: np.ndarray, rows: np.ndarray) -> dict[int, np.ndarray]:
    """The leaves of a tree of few nodes, each with those of ``rows`` that come to it, in their order; a right child follows its left one."""
    found, stack = {}, [(0, rows)]
    while stack:
        node, own = stack.pop()
        if column[node] < 0:
            found[node] = own
        elif len(own):
            goes_left = category[own] == cut[node] if column[node] == len(bins) else bins[column[node]][own] <= cut[node]
            stack += [(int(left[node]), own[goes_left]), (int(left[node]) + 1, own[~goes_left])]
    return found


@dataclass
class Draws:
    """Columns drawn for nodes by slot: ``numbers`` a row for each slot, ``pairs`` slot * categories + category in order."""

    numbers: np.ndarray
    pairs: np.ndarray


def draws_of(rule: Rule, nodes: list[tuple[int, int]]) -> Draws:
    drawn = [rule.columns(t, number) for t, number in nodes]
    slot, column = np.repeat(np.arange(len(nodes)), [len(d) for d in drawn]), np.concatenate([*drawn, np.zeros(0, np.int64)]).astype(np.int64)
    numbers, known = np.zeros((len(nodes), rule.width), bool), column < rule.width
    numbers[slot[known], column[known]] = True
    return Draws(numbers, np.sort(slot[~known] * rule.categories + column[~known] - rule.width))


@dataclass
class Sums:
    """Sums a, b and n (in this order) of slots: all rows; for each column of numbers its slots and their bins; and for pairs of slot and category that occur."""

    totals: np.ndarray
    numbers: list[tuple[int, np.ndarray, np.ndarray]]
    pairs: np.ndarray
    of_pairs: np.ndarray


def tally(rule: Rule, draws: Draws, slot: np.ndarray, rows: np.ndarray, bins: np.ndarray, category: np.ndarray, values: tuple[np.ndarray, ...]) -> Sums:
    """Sums of ``rows``, which lie in these slots; ``values`` (a, b, n) are those of all rows. Sums of a task fit a double exactly."""
    slots = len(draws.numbers)
    if (slot[1:] < slot[:-1]).any():
        order = np.argsort(slot.astype(np.int16 if slots < 1 << 15 else np.int64), kind="stable")
        slot, rows = slot[order], rows[order]
    values = tuple(x[rows] for x in values)
    once = bool((values[2] == 1).all())

    def added(cells: np.ndarray, given: tuple[np.ndarray, ...], size: int) -> np.ndarray:
        n = np.bincount(cells, None if once else given[2], size)
        return np.stack([np.bincount(cells, given[0], size), np.bincount(cells, given[1], size), n]).astype(np.int64)

    counts = np.bincount(slot, minlength=slots)
    starts, numbers, first_cell = np.cumsum(counts) - counts, [], slot * rule.bins
    for c in np.flatnonzero(draws.numbers.any(0)):
        of = np.flatnonzero(draws.numbers[:, c])
        if 2 * len(of) > slots:
            numbers.append((int(c), of, added(first_cell + bins[c][rows], values, slots * rule.bins).reshape(3, slots, -1)[:, of]))
        else:
            lengths = counts[of]
            at = np.repeat(starts[of] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            cells = np.repeat(np.arange(len(of)) * rule.bins, lengths) + bins[c][rows[at]]
            numbers.append((int(c), of, added(cells, tuple(x[at] for x in values), len(of) * rule.bins).reshape(3, len(of), -1)))
    known = category[rows]
    pair = slot.astype(np.int64) * rule.categories + known
    hit = np.flatnonzero((known >= 0) & (known < rule.categories))
    if slots * rule.categories <= 4 * len(rows) + DIRECT_CELLS:  # where each pair is drawn, or -1
        table = np.full(slots * rule.categories, -1, np.int32)
        table[draws.pairs] = np.arange(len(draws.pairs))
        at = table[pair[hit]]
        hit, at = hit[at >= 0], at[at >= 0]
    else:
        at = np.searchsorted(draws.pairs, pair[hit])
        same = np.flatnonzero(at < len(draws.pairs))
        same = same[draws.pairs[at[same]] == pair[hit[same]]]
        hit, at = hit[same], at[same]
    of_pairs = added(at, tuple(x[hit] for x in values), len(draws.pairs))
    found = np.flatnonzero(of_pairs[2])
    return Sums(added(slot, values, slots), numbers, draws.pairs[found], of_pairs[:, found])


@dataclass
class Cuts:
    """For each slot its best cut (gain 0 and column -1: none), and the sums to the left of it."""

    gain: np.ndarray
    column: np.ndarray
    bin: np.ndarray
    left: np.ndarray


def best_of(rule: Rule, sums: Sums) -> Cuts:
    """The cut of the largest gain: the first column, then the first bin among equals."""
    slots = sums.totals.shape[1]
    best = Cuts(np.zeros(slots), np.full(slots, -1, np.int64), np.zeros(slots, np.int64), np.zeros((3, slots), np.int64))
    a_all, b_all, n_all = sums.totals[0] / rule.unit, sums.totals[1] / rule.unit, sums.totals[2]
    whole = rule.score(a_all, b_all)

    def gains(of: np.ndarray, left: np.ndarray) -> np.ndarray:
        a, b, n = left[0] / rule.unit, left[1] / rule.unit, left[2]
        aa, bb, nn = a_all[of], b_all[of], n_all[of]
        fine = (np.minimum(b, bb - b) >= rule.least_b) & (np.minimum(n, nn - n) >= max(1, rule.least_n))
        gain = np.where(fine, rule.score(a, b) + rule.score(aa - a, bb - b) - whole[of], 0.0)
        return np.where(gain > 1e-12, gain, 0.0)

    def offer(of: np.ndarray, gain: np.ndarray, column: int, at: np.ndarray, left: np.ndarray) -> None:
        better = gain > best.gain[of]
        of = of[better]
        best.gain[of], best.column[of], best.bin[of], best.left[:, of] = gain[better], column, at[better], left[:, better]

    for c, of, cells in sums.numbers:
        left = np.cumsum(cells, 2)
        gain = gains(of[:, None], left)
        at = gain.argmax(1)
        offer(of, gain[np.arange(len(of)), at], c, at, left[:, np.arange(len(of)), at])
    if len(sums.pairs):
        of, value = sums.pairs // rule.categories, sums.pairs % rule.categories
        gain = gains(of, sums.of_pairs)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        most = np.repeat(np.maximum.reduceat(gain, first), np.diff(first, append=len(of)))
        at = np.flatnonzero(gain == most)
        at = at[np.flatnonzero(np.diff(of[at], prepend=-1))]
        offer(of[at], gain[at], rule.width, value[at], sums.of_pairs[:, at])
    return best


def finish(rule: Rule, t: int, number: int, bins: np.ndarray, category: np.ndarray, values: tuple[np.ndarray, ...]) -> dict[str, np.ndarray]:
    """FIELDS of the node and of all nodes below it, from the node's rows."""
    rows, slot, numbers = np.arange(len(category)), np.zeros(len(category), np.int64), np.array([number])
    totals, out = np.array([[int(x.sum())] for x in values], np.int64), []
    left_depth = rule.depth - number.bit_length() + 1
    opened = rule.open(totals[0] / rule.unit, totals[1] / rule.unit, totals[2]) if left_depth else np.zeros(1, bool)
    while True:
        cut = Cuts(np.zeros(len(numbers)), np.full(len(numbers), -1, np.int64), np.zeros(len(numbers), np.int64), np.zeros((3, len(numbers)), np.int64))
        going = np.flatnonzero(opened)
        if len(going):
            to = np.full(len(numbers), -1)
            to[going] = np.arange(len(going))
            slot = to[slot]
            rows, slot = rows[slot >= 0], slot[slot >= 0]
            draws = draws_of(rule, [(t, int(k)) for k in numbers[going]])
            found = best_of(rule, tally(rule, draws, slot, rows, bins, category, values))
            cut.gain[going], cut.column[going], cut.bin[going], cut.left[:, going] = found.gain, found.column, found.bin, found.left
        out.append(dict(zip(FIELDS, (numbers, cut.column, cut.bin, totals[0], totals[1], cut.gain), strict=True)))
        halved = np.flatnonzero(cut.column >= 0)
        left_depth -= 1
        if not len(halved):
            break
        # children in order: left, right of the first node that is cut, and so on
        child = np.full(len(going), -1)
        child[(cut.column >= 0)[going]] = 2 * np.arange(len(halved))
        column, edge = cut.column[going][slot], cut.bin[going][slot]
        stays = np.flatnonzero(column >= 0)
        rows, slot, column, edge = rows[stays], slot[stays], column[stays], edge[stays]
        goes_left = np.where(column == rule.width, category[rows] == edge, bins[np.minimum(column, rule.width - 1), rows] <= edge)
        slot = child[slot] + ~goes_left
        totals = np.stack([cut.left[:, halved], totals[:, halved] - cut.left[:, halved]], 2).reshape(3, -1)
        numbers = (2 * numbers[halved][:, None] + np.arange(2)).reshape(-1)
        opened = rule.open(totals[0] / rule.unit, totals[1] / rule.unit, totals[2]) if left_depth > 0 else np.zeros(len(numbers), bool)
    return {name: np.concatenate([o[name] for o in out]) for name in FIELDS}


class Top:
    """The part of a tree that the driver grows: its large nodes and their children."""

    def __init__(self) -> None:
        self.number, self.column, self.bin, self.left, self.sums, self.gain = [1], [-1], [0], [0], [(0, 0, 0)], [0.0]
        self.open, self.waiting = [0], []

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.column), np.array(self.bin), np.array(self.left)

    def cut(self, rule: Rule, node: int, column: int, at: int, gain: float, sides: tuple[tuple[int, ...], tuple[int, ...]]) -> None:
        """Cut a node; its children are open, waiting, or leaves."""
        self.column[node], self.bin[node], self.left[node], self.gain[node] = column, at, len(self.number), gain
        for side, (a, b, n) in enumerate(sides):
            number, child = 2 * self.number[node] + side, len(self.number)
            for name, x in (("number", number), ("column", -1), ("bin", 0), ("left", 0), ("sums", (a, b, n)), ("gain", 0.0)):
                getattr(self, name).append(x)
            if number.bit_length() <= rule.depth and rule.open(np.array(a / rule.unit), np.array(b / rule.unit), np.array(n)):
                (self.open if n > LOCAL_ROWS else self.waiting).append(child)


def level(blocks: RDD, rule: Rule, tops: dict[int, Top], nodes: dict[int, list[int]]) -> list[tuple]:
    """(tree, slot, sums, gain, column, bin, sums to the left) of the open ``nodes``."""
    context, state = blocks.context, {}
    for t, own in nodes.items():
        state[t] = *tops[t].arrays(), own, draws_of(rule, [(t, tops[t].number[k]) for k in own])
    shared = context.broadcast(state)
    tasks = {key: i for i, key in enumerate((t, s) for t, own in nodes.items() for s in range(len(own)))}

    def added(part: Iterator[Block]) -> Iterator[tuple]:
        for block in part:
            for t, (column, cut, left, opened, draws) in shared.value.items():
                n, a, b = rule.statistics(t, block)
                found = places(column, cut, left, block.bins, block.category, np.flatnonzero(n))
                rows = [found.get(k, np.zeros(0, np.int64)) for k in opened]
                sums = tally(rule, draws, np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows), block.bins, block.category, (a, b, n))
                own: list[dict] = [{} for _ in opened]
                for c, of, cells in sums.numbers:
                    for i, s in enumerate(of):
                        own[s][c] = cells[:, i]
                ends = np.searchsorted(sums.pairs, np.arange(len(own) + 1) * rule.categories)
                for s, numbers in enumerate(own):
                    at = slice(ends[s], ends[s + 1])
                    yield (t, s), (sums.totals[:, s], numbers, sums.pairs[at] - s * rule.categories, sums.of_pairs[:, at])

    def decided(part: Iterator[tuple]) -> Iterator[tuple]:
        found: dict[tuple, tuple] = {}
        for key, (totals, numbers, which, of_which) in part:
            if key not in found:
                found[key] = np.zeros(3, np.int64), {}, np.zeros((3, rule.categories), np.int64)
            found[key][0][:] += totals
            for c, cells in numbers.items():
                found[key][1][c] = found[key][1].get(c, 0) + cells
            found[key][2][:, which] += of_which
        for (t, s), (totals, numbers, of_categories) in found.items():
            which = np.flatnonzero(of_categories[2])
            cut = best_of(rule, Sums(totals[:, None], [(c, np.zeros(1, int), numbers[c][:, None]) for c in sorted(numbers)], which, of_categories[:, which]))
            yield t, s, totals.tolist(), float(cut.gain[0]), int(cut.column[0]), int(cut.bin[0]), cut.left[:, 0].tolist()

    parts = min(len(tasks), 4 * context.defaultParallelism)
    found = blocks.mapPartitions(added).partitionBy(parts, lambda key: tasks[key] % parts).mapPartitions(decided).collect()  # a row for each large node of the level
    shared.unpersist()
    return found


def grow_nodes(blocks: RDD, rows: int, rule: Rule, trees: list[int]) -> dict[int, dict[str, np.ndarray]]:
    """For each tree FIELDS of its nodes in the order of their numbers, grown together from ``rows`` rows."""
    tops = {t: Top() for t in trees}
    if rows <= LOCAL_ROWS or not rule.depth:
        for top in tops.values():
            top.open, top.waiting = [], [0]
    while any(top.open for top in tops.values()):
        nodes = {t: top.open for t, top in tops.items() if top.open}
        found = level(blocks, rule, tops, nodes)
        for t in nodes:
            tops[t].open = []
        for t, s, totals, gain, column, at, left in sorted(found):
            top, node = tops[t], nodes[t][s]
            top.sums[node] = tuple(totals)
            if column >= 0:
                top.cut(rule, node, column, at, gain, (tuple(left), tuple(x - y for x, y in zip(totals, left, strict=True))))
    below = grow_below(blocks, rows, rule, tops)
    out = {}
    for t, top in tops.items():
        done = {int(d["number"][0]) for d in below[t]}
        kept = [k for k, number in enumerate(top.number) if number not in done]
        own = {"number": [top.number[k] for k in kept], "column": [top.column[k] for k in kept], "bin": [top.bin[k] for k in kept], "a": [top.sums[k][0] for k in kept], "b": [top.sums[k][1] for k in kept], "gain": [top.gain[k] for k in kept]}
        joined = {name: np.concatenate([np.array(own[name], np.float64 if name == "gain" else np.int64), *(d[name] for d in below[t])]) for name in FIELDS}
        order = np.argsort(joined["number"])
        out[t] = {name: x[order] for name, x in joined.items()}
    return out


def grow_below(blocks: RDD, rows: int, rule: Rule, tops: dict[int, Top]) -> dict[int, list[dict[str, np.ndarray]]]:
    """For each tree FIELDS of its waiting nodes and all below them. A node's rows go to one task, and tasks get about as many rows."""
    context, below = blocks.context, {t: [] for t in tops}
    sizes = sorted(((top.sums[k][2] or rows, t, k) for t, top in tops.items() for k in top.waiting), reverse=True)
    if not sizes:
        return below
    parts = min(len(sizes), max(context.defaultParallelism, -(-sum(n for n, _, _ in sizes) // TASK_ROWS)))
    task = {(t, k): (i % parts if i // parts % 2 == 0 else parts - 1 - i % parts) for i, (_, t, k) in enumerate(sizes)}  # to and fro, large ones first
    shared = context.broadcast({t: (*top.arrays(), set(top.waiting), top.number) for t, top in tops.items() if top.waiting})

    def dealt(part: Iterator[Block]) -> Iterator[tuple]:
        for block in part:
            for t, (column, cut, left, waiting, _) in shared.value.items():
                n, a, b = rule.statistics(t, block)
                for k, own in places(column, cut, left, block.bins, block.category, np.flatnonzero(n)).items():
                    if k in waiting and len(own):
                        yield (t, k), (block.bins[:, own], block.category[own], a[own], b[own], n[own])

    def finished(part: Iterator[tuple]) -> Iterator[tuple]:
        found: dict[tuple, list] = {}
        for key, piece in part:
            found.setdefault(key, []).append(piece)
        for t, k in list(found):
            pieces = found.pop((t, k))
            bins = np.concatenate([p[0] for p in pieces], 1)
            category, a, b, n = (np.concatenate([p[i] for p in pieces]) for i in range(1, 5))
            yield t, finish(rule, t, shared.value[t][4][k], bins, category, (a, b, n))

    for t, found in blocks.mapPartitions(dealt).partitionBy(parts, lambda key: task[key]).mapPartitions(finished).collect():  # the trees themselves
        below[t].append(found)
    shared.unpersist()
    return below
