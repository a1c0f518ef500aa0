"""Shapley values of tree ensembles: exact for the path-dependent game, in polynomial time, on Arrow batches.

The game: a column that isn't in a coalition sends a row down both sides of its cuts, by the shares of the training cover. A leaf's part of a row's
values depends only on which of the columns on its path agree with the row; so for each leaf the rows' agreements are taken as bit
patterns, the coalition weights are worked out once for each distinct pattern by polynomial products (one factor for each column of
the path), and handed to the rows. The category counts as one column.

Values are in the ensemble's raw scale: log-odds of boosting, probability of a forest; with the base they add up to the raw prediction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.trees import Ensemble, Tree


def paths(tree: Tree) -> Iterator[tuple[list[tuple[int, float, bool, float]], float]]:
    """For each leaf its tests (column, cut, goes left, share of the cover) and its value."""
    stack: list[tuple[int, list]] = [(0, [])]
    while stack:
        node, tests = stack.pop()
        if tree.column[node] < 0:
            yield tests, tree.value[node]
            continue
        for child, left in ((tree.left[node], True), (tree.right[node], False)):
            share = tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.5
            stack.append((child, [*tests, (tree.column[node], tree.cut[node], left, share)]))


def coalition_weights(agree: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """For patterns (rows) of agreeing columns: each column's part of a leaf of value 1. ``shares``: product of a column's cover shares."""
    n, m = agree.shape
    product = np.zeros((n, m + 1))
    product[:, 0] = 1
    for j in range(m):  # times (share + agree * x)
        product[:, 1 : j + 2] = product[:, 1 : j + 2] * shares[j] + product[:, : j + 1] * agree[:, j : j + 1]
        product[:, 0] *= shares[j]
    weight = np.array([math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)])
    out = np.empty((n, m))
    for j in range(m):
        others = np.empty((n, m))  # the product without this column's factor
        yes = agree[:, j] == 1
        rest = product[yes, m]
        for s in range(m - 1, -1, -1):
            others[yes, s] = rest
            rest = product[yes, s] - shares[j] * rest
        others[~yes] = product[~yes, :m] / shares[j] if shares[j] else 0.0
        out[:, j] = (agree[:, j] - shares[j]) * (others @ weight)
    return out


def tree_values(tree: Tree, numbers: np.ndarray, category: np.ndarray) -> tuple[float, np.ndarray]:
    """Expected value of the tree, and the values of the columns (numbers, then the category) for each row."""
    width, base, out = numbers.shape[1], 0.0, np.zeros((len(category), numbers.shape[1] + 1))
    for tests, value in paths(tree):
        columns = sorted({t[0] for t in tests})
        if not columns:
            base += value
            continue
        agree, shares = np.ones((len(category), len(columns)), bool), np.ones(len(columns))
        for column, cut, left, share in tests:
            j = columns.index(column)
            low = category == cut if column == width else numbers[:, column] < cut
            agree[:, j] &= low == left
            shares[j] *= share
        base += value * shares.prod()
        code = agree @ (1 << np.arange(len(columns)))
        patterns, which = np.unique(code, return_inverse=True)
        parts = coalition_weights((patterns[:, None] >> np.arange(len(columns)) & 1).astype(float), shares)
        out[:, columns] += value * parts[which]
    return base, out


def ensemble_values(found: Ensemble, numbers: np.ndarray, category: np.ndarray) -> tuple[float, np.ndarray]:
    base, out = 0.0, np.zeros((len(category), len(found.numbers) + 1))
    for tree in found.trees:
        b, v = tree_values(tree, numbers, category)
        base, out = base + b, out + v
    share = 1.0 if found.kind == "boosting" else 1.0 / max(1, len(found.trees))
    return base * share, out * share


def contributions(found: Ensemble, rows: DataFrame) -> DataFrame:
    """``rows`` with ``shap_base`` and ``shap_values``, one value for each of the ensemble's numbers and one for its category."""

    def run(parts: Iterator[tuple]) -> Iterator[pa.Array]:
        for part in parts:
            values = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part[:-1]], 1)
            base, shap = ensemble_values(found, values, part[-1].to_numpy(zero_copy_only=False))
            yield pa.array(np.concatenate([np.full((len(shap), 1), base), shap], 1).tolist(), pa.list_(pa.float64()))

    run.__annotations__ = {"parts": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    both = F.arrow_udf(run, "array<double>")(*(F.col(c).cast("double") for c in found.numbers), F.col(found.category).cast("double"))
    return rows.withColumn("shap_values", both).withColumn("shap_base", F.col("shap_values")[0]).withColumn("shap_values", F.slice("shap_values", 2, len(found.numbers) + 1))


def summary(found: Ensemble, rows: DataFrame) -> DataFrame:
    """Over all rows, for each column the mean absolute value, and its direction: the correlation of value and number (NULL for the category, and where either doesn't vary)."""
    named = contributions(found, rows)
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"), F.col("shap_values")[i].alias("v")) for i, c in enumerate(found.numbers)), F.struct(F.lit(found.category).alias("feature"), F.lit(None).cast("double").alias("x"), F.col("shap_values")[len(found.numbers)].alias("v")))
    return named.select(F.explode(pairs).alias("r")).groupBy("r.feature").agg(F.avg(F.abs("r.v")).alias("mean_abs"), F.try_divide(F.covar_pop("r.x", "r.v"), F.stddev_pop("r.x") * F.stddev_pop("r.v")).alias("direction"))
