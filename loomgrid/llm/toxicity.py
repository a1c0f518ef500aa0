"""Toxicity by subword bags: character n-gram embeddings, averaged, into a linear softmax.

A text is cut into windows of ``WINDOW`` words, so that one insult among thousands of words isn't averaged
away. A window's vector is the mean of the vectors of its character n-grams (3 to 5 characters, also
across a word's edges, hashed to ``BUCKETS`` rows); a linear softmax over two classes follows. Vectors and
softmax are trained jointly in numpy by Adagrad on labelled texts: in a toxic text the windows that look most
toxic carry its label, in others any window may. A text's score is that of its most toxic window, put
on the scale of a probability by a one-variable logistic fit for the share of toxic labels in the training rows.

A word of more than ``LONG`` characters counts as words of ``LONG`` characters, in training and scoring alike; so a window has a
largest size, and a text of any make is looked at in pieces of bounded size.

Training takes at most ``max_rows`` labelled rows, half of them toxic where there are enough, picked by hash
of the id, and of these as many whole texts, in the order of the hash, as ``max_chars`` characters hold for both classes together; a
text that alone has over a hundredth of that isn't learned from. So the driver gets at most max_chars characters, and never a part of a text. For scoring, vectors and softmax fold into one number for each n-gram row, since both are linear; it
goes to the executors as a broadcast of fixed size.

Defined results: a text without words (also null) has nothing toxic in it and scores 0; null ids are scored but
never trained on; an id that labels repeat counts once, as toxic if any of its rows says so; of documents that share a
labelled id the least text is learned from; every text is scored whole; with no labelled rows, or of one class only,
every other text scores that class's share (0 without labels); an empty table gives an empty result; other columns
are ignored by ``toxicity`` and kept untouched by ``keep_clean``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.batches import sliced
from loomgrid.llm.common import crc_fold, fresh, lowest_hashes

BUCKETS, DIM, WINDOW, SIZES, LONG = 1 << 17, 8, 5, (3, 4, 5), 400
_PARTS = re.compile(rf"\S{{1,{LONG}}}")
_SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def words(text: str) -> list[str]:
    """Words of a text without capitals, long ones in parts."""
    text = text.lower()
    found = text.split()
    return found if max(map(len, found), default=0) <= LONG else _PARTS.findall(text)


def pieces(text: str, size: int = 1 << 18) -> Iterator[str]:
    """A text in pieces of whole windows and about ``size`` characters, however long its words are."""
    if len(text) <= size:
        yield text
        return
    found: list[str] = []
    length = 0
    for part in _PARTS.finditer(text.lower()):
        found.append(part[0])
        length += len(part[0]) + 1
        if length >= size and len(found) % WINDOW == 0:
            yield " ".join(found)
            found, length = [], 0
    if found:
        yield " ".join(found)


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram rows of all texts in order, the number of n-grams of each window, and the text of each window.

    White space of any kind counts as one blank, and each text stands between blanks.
    """
    joined = "\n".join(["", *(" ".join(words(t)) for t in texts), ""])
    chars = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    breaks = chars == 10
    blank = breaks | (chars == 32)
    n = len(chars)
    text_of = np.cumsum(breaks) - 1
    word = np.cumsum(blank)
    begins = np.flatnonzero(breaks)
    word -= word[begins][np.maximum(text_of, 0)]  # number of a character's word in its text
    chars[blank] = 32
    rows, places = [], []
    for size in SIZES:
        if n < size:
            continue
        m = n - size + 1
        mixed = np.zeros(m, np.uint64)
        for i in range(size):
            mixed += chars[i : i + m] * _FACTORS[i]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _FACTORS[0]
        inner = np.zeros(m, bool)
        for i in range(1, size - 1):
            inner |= blank[i : i + m]
        ok = np.flatnonzero(~inner)
        rows.append((mixed[ok] >> np.uint64(64 - 17)).astype(np.int32))
        places.append(ok)
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, place = np.concatenate(rows), np.concatenate(places)
    group = text_of[place + 1] * np.int64(1 << 40) + np.maximum(word[place + 1], 0) // WINDOW
    order = np.argsort(group, kind="stable")
    row, group = row[order], group[order]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return row, np.diff(np.append(first, len(group))), (group[first] >> 40).astype(np.int64)


class Model:
    """Weights of n-gram rows folded with the softmax, and the scale of scores."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores of whole texts, looked at in pieces of bounded size."""
        best = np.full(len(texts), -np.inf)
        some_texts: list[str] = []
        owner: list[int] = []
        size = 0

        def look() -> None:
            nonlocal size
            if owner:
                np.maximum.at(best, owner, self._most(some_texts))
            some_texts.clear()
            owner.clear()
            size = 0

        for i, text in enumerate(texts):
            for piece in pieces(text):
                some_texts.append(piece)
                owner.append(i)
                size += len(piece)
                if size > 1 << 18:
                    look()
        look()
        some = np.isfinite(best)
        return np.where(some, 1 / (1 + np.exp(-np.clip(self.slope * np.where(some, best, 0.0) + self.shift, -40, 40))), 0.0)

    def _most(self, texts: list[str]) -> np.ndarray:
        """Of each text the value of its most toxic window; minus infinity without words."""
        row, counts, text = windows(texts)
        best = np.full(len(texts), -np.inf)
        if len(row):
            np.maximum.at(best, text, np.add.reduceat(self.weights[row], np.concatenate(([0], np.cumsum(counts)[:-1]))) / counts + self.bias)
        return best


def train(texts: list[list[str]], labels: np.ndarray, share: float, epochs: int = 8, batch: int = 512, rate: float = 0.5, seed: int = 5) -> Model:
    """Joint training on the windows of each text; ``share``: share of toxic rows among all labelled ones, which scores are scaled to.

    ``texts`` is emptied as soon as its n-grams are taken.
    """
    if not len(texts) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    rng = np.random.default_rng(seed)
    flat, owner, size, n_texts = [w for t in texts for w in t], np.repeat(np.arange(len(texts)), [len(t) for t in texts]), 10_000, len(texts)
    texts.clear()
    parts = []
    for i in range(0, len(flat), size):
        parts.append(windows(flat[i : i + size]))
        flat[i : i + size] = [""] * len(flat[i : i + size])
    del flat
    counts = np.concatenate([p[1] for p in parts])
    text = owner[np.concatenate([p[2] + size * i for i, p in enumerate(parts)])]
    row, at = np.empty(int(counts.sum()), np.int32), 0
    while parts:  # each part is freed as it is copied
        part = parts.pop(0)[0]
        row[at : at + len(part)] = part
        at += len(part)
    begins = np.concatenate(([0], np.cumsum(counts)[:-1]))
    vectors = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    squares, soft_squares = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32)
    toxic = labels[text] == 1

    def logits(weights: np.ndarray, step: int = 20_000) -> np.ndarray:
        """Means of the windows, some thousands of them at a time."""
        out = np.empty(len(counts))
        for first in range(0, len(counts), step):
            own = begins[first : first + step]
            last = begins[first + step] if first + step < len(counts) else len(row)
            out[first : first + step] = np.add.reduceat(weights[row[own[0] : last]], own - own[0])
        return out / counts

    for epoch in range(epochs):
        value = logits(vectors @ (softmax[:, 1] - softmax[:, 0])) + rng.gumbel(0, 0.05, len(counts))
        order = np.lexsort((-value, text))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(np.flatnonzero(np.diff(text[order], prepend=-1)), np.bincount(text)[np.unique(text)])
        per_text = np.bincount(text)[text]
        # toxic texts: at first half of their windows, then ever fewer of the most toxic ones; others: the most toxic and some at random
        keep = np.where(toxic, rank < np.maximum(1, per_text * max(0.1, 0.5 * 0.7**epoch)), (rank < 2) | (rng.random(len(rank)) < 4 / per_text))
        chosen = rng.permutation(np.flatnonzero(keep))
        for at in range(0, len(chosen), batch):
            picked = chosen[at : at + batch]
            size = counts[picked]
            inside = np.repeat(begins[picked] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            ids, firsts = row[inside], np.concatenate(([0], np.cumsum(size)[:-1]))
            means = np.add.reduceat(vectors[ids], firsts, axis=0) / size[:, None]
            z = means @ softmax + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(picked)), toxic[picked].astype(int)] -= 1
            grad = p / len(picked)
            back = (grad @ softmax.T / size[:, None]).astype(np.float32)
            used, inverse = np.unique(ids, return_inverse=True)
            owner = np.repeat(np.arange(len(picked)), size)
            step = np.stack([np.bincount(inverse, back[owner, d], len(used)) for d in range(DIM)], axis=1).astype(np.float32)
            squares[used] += (step * step).mean(axis=1)
            vectors[used] -= rate * step / np.sqrt(squares[used])[:, None]
            g = means.T @ grad
            soft_squares += g * g
            softmax -= (0.1 * g / np.sqrt(soft_squares)).astype(np.float32)
            bias -= (0.1 * grad.sum(axis=0)).astype(np.float32)
    folded = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
    model = Model(folded, float(bias[1] - bias[0]), 1.0, 0.0)
    best = np.full(n_texts, model.bias)
    best[np.unique(text)] = -np.inf
    np.maximum.at(best, text, logits(folded) + model.bias)
    model.slope, model.shift = scale(best, labels, share)
    return model


def scale(values: np.ndarray, labels: np.ndarray, share: float, rounds: int = 60, ridge: float = 1e-3) -> tuple[float, float]:
    """Logistic slope and shift for the class shares of all labelled rows, by Newton's method with a light ridge."""
    mean, deviation = values.mean(), values.std() + 1e-9
    x = np.stack([(values - mean) / deviation, np.ones(len(values))], axis=1)
    weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean())) / len(values)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - labels)) + ridge * w * [1, 0]
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([ridge, 1e-9])
        w -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(w[0] / deviation), float(w[1] - w[0] * mean / deviation)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to their windows."""
    for part, texts in sliced(batches, "text"):
        split = [words(t) for t in texts]
        out = [[" ".join(ws[i : i + WINDOW]) for i in range(0, len(ws), WINDOW)] for ws in split]
        yield pa.RecordBatch.from_pydict({"label_id": part.column("label_id"), "label": part.column("label"), "parts": pa.array(out, pa.list_(pa.string()))})


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_rows: int, max_chars: int = 16_000_000) -> Model:
    """Model of the labelled rows outside fold 2 of 4; the bounds are those of what reaches the driver."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    marked = marked.where(crc_fold(F.col("label_id"), 4) != 2)
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    total = sum(counts.values())
    if not total:
        return train([], np.zeros(0), 0.0)
    wanted = {1: max_rows // 2, 0: max_rows - min(max_rows // 2, counts.get(1, 0))}
    by_hash = lambda label: lowest_hashes(marked.where(F.col("label") == label), F.col("label_id"), wanted[label], counts.get(label, 0))
    picked = F.broadcast(by_hash(1).unionByName(by_hash(0)))  # at most max_rows ids
    texts = docs.select(F.col(id_col).alias("own_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    one = texts.join(picked, F.col("own_id") == F.col("label_id")).groupBy("label_id", "label").agg(F.min("text").alias("text"))
    hashed = Window.partitionBy("label").orderBy(F.xxhash64("label_id"), "label_id").rowsBetween(Window.unboundedPreceding, 0)  # at most max_rows rows
    lengths = one.select("label_id", "label", F.length("text").alias("n")).where(F.col("n") <= max_chars // 100)
    fitting = lengths.select("label_id", F.sum("n").over(hashed).alias("so_far")).where(F.col("so_far") <= max_chars // 2).select("label_id")
    one = one.join(F.broadcast(fitting), "label_id")  # at most max_rows ids
    rows = one.mapInArrow(_cut, "label_id bigint, label int, parts array<string>").toArrow().sort_by("label_id")
    kinds, parts = rows["label"].to_numpy(), rows["parts"].to_pylist()
    del rows
    return train(parts, kinds, counts.get(1, 0) / total)


def scorer(docs: DataFrame, model: Model, text: Column) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.score([t or "" for t in batch]))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, max_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    model = fit(docs, labels, id_col, text_col, max_rows)
    scored = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), scorer(docs, model, F.col(text_col)).alias("score"))
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, max_rows: int = 4000) -> DataFrame:
    """The rows of ``docs`` below the threshold, with their own columns."""
    score = fresh(docs, "toxic_score")
    model = fit(docs, labels, id_col, text_col, max_rows)
    return docs.withColumn(score, scorer(docs, model, F.col(text_col))).where(F.col(score) < threshold).select(*docs.columns)
