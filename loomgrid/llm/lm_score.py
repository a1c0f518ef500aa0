"""Language-model scores by subword lattices, beside a smoothed word model.

The pieces are those of a public sentencepiece vocabulary, never trained here, and its scores weigh all ways to cut a word into pieces
(byte pieces cover what else wouldn't fit), its lattice. The scores are negative ranks; by Zipf's law a piece weighs
(rank + 10) ** -a. Only the scale a is fitted to the corpus, by one round of expectation-maximisation from a = 1 and an end as likely as all pieces together: pieces' expected
numbers of uses by the forward-backward recursion over every distinct word of the training documents, weighed with the word's count; and
how often a text ends, as a share of pieces and ends together. A word's probability is the sum over all its segmentations, by the
forward recursion in log space; a text's is the product over its words and the end piece. With ``free`` the round sets every piece's
probability by its expected uses instead of the scale: a corpus-trained unigram model, as an option beside the method.

With ``words`` (what the query takes) the corpus speaks first: a token counted c of N times has (c - d) / N by its count, and the d taken from each of the T
known tokens, d * T / N in all, goes to the lattice, which so spells the unknown ones (d = n1 / (n1 + 2 n2) by the tokens seen once and twice: absolute discounting). The lattice
is then ``free`` and fitted to distinct words, each once, as what it stands for is words that are new. Its words' probabilities sum to B / (B + E), with B the pieces that start a word and E the
end, and E / (B + E) is the end's; so the probabilities of all tokens sum to at most one.

Where the work goes: words are counted within tasks and then summed in a shuffle that grows with the corpus;
expected counts come back as at most one number for each piece; every distinct word's two log probabilities are
computed once. The ``head`` most frequent words go to the executors as a broadcast (at most ``head`` words of at
most ``head_bytes`` bytes each); the words of a text that aren't among them are joined by a shuffle, so the
split moves work only, never results.

Defined results: a null or empty text is just an end; null ids are scored, but not learned from; repeated rows are each
learned from and scored; with no training rows N and V are 0, the end is unknown, and base probabilities are 1
for every token; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.batches import text_slices
from loomgrid.llm.common import checkpoint, crc_fold

END = b""  # no word is empty
_BLANK = "▁".encode()
_FACTOR = 0x9E3779B97F4A7C15


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (word starts marked by a blank), with the end piece last, and the logs of their weights at scale 1 (0 for the end)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            piece, rank = bytes([int(model.id_to_piece(i)[3:-1], 16)]), float(model.get_piece_size())
        elif model.is_control(i) or model.is_unknown(i):
            continue
        else:
            piece, rank = model.id_to_piece(i).encode().replace(_BLANK, b" "), -model.get_score(i)
        found[piece] = found.get(piece, 0.0) + 1 / (rank + 10)
    pieces = [*found, END]
    return pieces, np.log(np.array([*found.values(), 1.0]))


def scaled(weights: np.ndarray, scale: float, end: float) -> np.ndarray:
    """Log probabilities of pieces with weights to the power of ``scale``, and of the end, which has the share ``end``."""
    raised = scale * weights[:-1]
    top = raised.max()
    return np.append(raised - top - np.log(np.exp(raised - top).sum()) + np.log1p(-end), np.log(end))


def fit_scale(weights: np.ndarray, uses: np.ndarray, most: float = 64.0) -> float:
    """The scale under which the pieces' expected uses are likeliest: mean log weight under the model equals that of the uses. 1 without uses."""
    if not uses[:-1].sum():
        return 1.0
    wanted = float(uses[:-1] @ weights[:-1] / uses[:-1].sum())
    low, high = 0.0, most
    for _ in range(80):
        middle = (low + high) / 2
        if float(np.exp(scaled(weights, middle, 0.5)[:-1] + np.log(2)) @ weights[:-1]) < wanted:
            low = middle
        else:
            high = middle
    return (low + high) / 2


class Lattice:
    """Forward and backward recursions over many words at a time; a word of over ``long`` bytes goes by itself, a few numbers for each byte."""

    def __init__(self, pieces: list[bytes], log_probs: np.ndarray, long: int = 256):
        self.log_probs, self.long = log_probs, long
        self.index = {p: i for i, p in enumerate(pieces) if p}
        self.lengths = sorted({len(p) for p in pieces if p})
        self.tables = {}
        for n in self.lengths:
            own = [(int.from_bytes(p, "big") if n <= 7 else hash_bytes(p), i) for i, p in enumerate(pieces) if len(p) == n]
            own.sort()
            self.tables[n] = np.array([k for k, _ in own], np.uint64), np.array([i for _, i in own])

    def _edges(self, words: list[bytes], size: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, words, pieces) for words of ``size`` bytes."""
        letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), size).astype(np.uint64)
        out = []
        for n in self.lengths:
            if n > size:
                break
            keys, ids = self.tables[n]
            code = np.zeros((len(words), size - n + 1), np.uint64)
            for i in range(n):
                code = code * np.uint64(256 if n <= 7 else _FACTOR) + letters[:, i : i + size - n + 1]
            at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
            hit = keys[at] == code
            for begin in range(size - n + 1):
                rows = np.flatnonzero(hit[:, begin])
                if len(rows):
                    out.append((begin, begin + n, rows, ids[at[rows, begin]]))
        return out

    def _batches(self, words: list[bytes], cells: int = 400_000) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
        """Words of one length each, in batches of about ``cells`` bytes, each word led by its blank."""
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= self.long]
        if not len(order):
            return
        for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            size = int(sizes[group[0]])
            for at in range(0, len(group), step := max(1, cells // size)):
                picked = group[at : at + step]
                yield size, picked, [b" " + words[i] for i in picked.tolist()]

    def _forward(self, edges: list, n: int, size: int) -> np.ndarray:
        alpha = np.full((n, size + 1), -np.inf)
        alpha[:, 0] = 0
        for begin, end, rows, ids in sorted(edges, key=lambda e: (e[1], e[0])):
            alpha[rows, end] = np.logaddexp(alpha[rows, end], alpha[rows, begin] + self.log_probs[ids])
        return alpha

    def log_prob(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the words' probabilities, summed over all segmentations."""
        out = np.zeros(len(words))
        for size, picked, group in self._batches(words):
            out[picked] = self._forward(self._edges(group, size), len(group), size)[:, size]
        for i, w in enumerate(words):
            if len(w) + 1 > self.long:
                out[i] = self._forward_one(b" " + w)[-1]
        return out

    def _hits(self, word: bytes, end: int) -> list[tuple[int, int]]:
        """(begin, piece) of the pieces that end at a place."""
        return [(end - n, i) for n in self.lengths if n <= end and (i := self.index.get(word[end - n : end])) is not None]

    def _forward_one(self, word: bytes) -> array:
        alpha, logs = array("d", [0.0]), self.log_probs
        for end in range(1, len(word) + 1):
            terms = [alpha[begin] + logs[i] for begin, i in self._hits(word, end)]
            top = max(terms, default=-math.inf)
            alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)) if top > -math.inf else top)
        return alpha

    def _expected_one(self, word: bytes, count: float, out: np.ndarray) -> None:
        alpha, logs = self._forward_one(word), self.log_probs
        beta = array("d", [-math.inf]) * (len(word) + 1)
        beta[-1] = 0.0
        for end in range(len(word), 0, -1):
            for begin, i in self._hits(word, end):
                through = logs[i] + beta[end]
                out[i] += count * math.exp(alpha[begin] + through - alpha[-1])
                high, low = max(beta[begin], through), min(beta[begin], through)
                if high > -math.inf:
                    beta[begin] = high + math.log1p(math.exp(low - high))

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece."""
        out = np.zeros(len(self.log_probs))
        for size, picked, group in self._batches(words):
            edges = self._edges(group, size)
            alpha = self._forward(edges, len(group), size)
            beta = np.full((len(group), size + 1), -np.inf)
            beta[:, size] = 0
            for begin, end, rows, ids in sorted(edges, key=lambda e: (-e[0], -e[1])):
                through = self.log_probs[ids] + beta[rows, end]
                use = np.exp(alpha[rows, begin] + through - alpha[rows, size]) * counts[picked[rows]]
                out += np.bincount(ids, use, len(out))
                beta[rows, begin] = np.logaddexp(beta[rows, begin], through)
        for i, w in enumerate(words):
            if len(w) + 1 > self.long:
                self._expected_one(b" " + w, float(counts[i]), out)
        return out


def hash_bytes(b: bytes) -> int:
    """Code of a piece of over 7 bytes; shorter ones are their own codes."""
    code = 0
    for x in b:
        code = (code * _FACTOR + x) % (1 << 64)
    return code


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


_PART = {"doc_id": pa.int64(), "key": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "model": pa.float64(), "rest": pa.list_(pa.binary()), "times": pa.list_(pa.int32())}


def _count(folds: int, held: int, flush: int):
    def rows(known: Counter, seen: set) -> pa.RecordBatch:
        words = [*known, *(seen.difference(known))]
        return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()), "c": pa.array([known[w] for w in words], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Counter(), set()
        for ids, texts in text_slices(batches):
            for i, t in zip(ids, texts, strict=True):
                ws = tokens(t)
                if i is None or crc32(str(i).encode()) % folds == held:
                    seen.update(ws)
                else:
                    known.update(ws)
                    known[END] += 1
            if len(known) + len(seen) > flush:
                yield rows(known, seen)
                known, seen = Counter(), set()
        yield rows(known, seen)

    return run


def score(docs: DataFrame, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, head: int = 200_000, head_bytes: int = 64, free: bool = False, words: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10) of every row."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    counted = texts.mapInArrow(_count(folds, held, 400_000), "word binary, c bigint")
    vocabulary = checkpoint(counted.groupBy("word").agg(F.sum("c").alias("c")))
    total, distinct, once, twice = vocabulary.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()

    pieces, own_weights = read_pieces(pieces_path)
    start = scaled(own_weights, 1.0, 0.5)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, sums = Lattice(pieces, start), np.zeros(len(pieces))
        for b in batches:
            c = b.column("c").to_numpy()
            sums += lattice.expected(b.column("word").to_pylist(), np.ones(len(c)) if words else c.astype(float))
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"piece": used, "n": sums[used]})

    learned = vocabulary.where("c > 0").where(F.col("word") != F.lit(END)).mapInArrow(expect, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # at most a row for each piece
    ends = vocabulary.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    if words:
        ends = min(ends, 1)  # one token among the distinct ones
    uses = np.zeros(len(pieces))
    for r in learned:
        uses[r["piece"]] = r["n"]
    end = (ends + 1) / (ends + uses.sum() + 2)
    log_probs = scaled(own_weights, fit_scale(own_weights, uses), end)
    if free or words:
        held_back = uses[:-1] + 100 * np.exp(start[:-1]) / np.exp(start[:-1]).sum()  # the scores count as a hundred pieces
        log_probs = np.append(np.log(held_back / held_back.sum()) + np.log1p(-end), np.log(end))
    log10 = float(np.log(10))
    norm = total + 0.5 * (distinct + 1)
    taken = once / (once + 2 * twice) if once and twice else 0.5
    starts = float(np.exp([x for p, x in zip(pieces, log_probs.tolist(), strict=True) if p.startswith(b" ")]).sum())
    own_end = log_probs[-1] - math.log(starts + math.exp(log_probs[-1])) if words else log_probs[-1]

    def by_counts(c: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Discounted counts, and the lattice for the rest."""
        if not total:
            return spelled
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(np.maximum(c - taken, 0) / total), math.log(taken * distinct / total) + spelled)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, log_probs)
        for b in batches:
            found, c = b.column("word").to_pylist(), b.column("c").to_numpy()
            inner = [i for i, w in enumerate(found) if w != END]
            model = np.full(len(found), own_end)
            model[inner] = lattice.log_prob([found[i] for i in inner])
            if words:
                model = by_counts(c, model)
            yield pa.RecordBatch.from_pydict({"word": b.column("word"), "c": b.column("c"), "base": np.log10((c + 0.5) / norm), "model": model / log10})

    judged = checkpoint(vocabulary.mapInArrow(judge, "word binary, c bigint, base double, model double"))
    short = judged.where(F.octet_length("word") <= head_bytes).withColumn("level", F.floor(F.log2(F.col("c") + 1) * 16))
    kept, least = 0, None  # the lowest level of counts down to which at most ``head`` words lie; there are some hundred levels
    for level, n in sorted(((r["level"], r["n"]) for r in short.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True):
        if kept + n > head:
            break
        kept, least = kept + n, level
    top = short.where(F.lit(False) if least is None else F.col("level") >= least).toArrow()  # bounded: head rows of head_bytes
    table = dict(zip(top.column("word").to_pylist(), zip((top.column("c").to_numpy() > 0).tolist(), top.column("base").to_pylist(), top.column("model").to_pylist(), strict=True), strict=True))
    shared = spark.sparkContext.broadcast(table)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for ids, slice_ in text_slices(batches):
            out: dict[str, list] = {k: [] for k in _PART}
            for doc_id, t in zip(ids, slice_, strict=True):
                ws = tokens(t)
                counts = Counter(ws)
                counts[END] += 1
                n_known, base, model, rest = 0, 0.0, 0.0, []
                for w, k in counts.items():
                    found = known.get(w)
                    if found is None:
                        rest.append(w)
                    else:
                        n_known, base, model = n_known + k * found[0], base + k * found[1], model + k * found[2]
                key = blake2b(t.encode("utf-8", "replace"), digest_size=8).digest()
                row = (doc_id, int.from_bytes(key, "big", signed=True), len(ws) + 1, n_known, base, model, [b" " + key, *rest], [0, *(counts[w] for w in rest)])
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, _PART[k]) for k, v in out.items()})

    parts = texts.mapInArrow(part, "doc_id bigint, key bigint, n_tokens bigint, n_known bigint, base double, model double, rest array<binary>, times array<int>")
    # a row for the part that the broadcast words make (its word occurs in no text), and one for each other word
    own = lambda c: F.when(F.col("pos") == 0, F.col(c)).otherwise(0)
    spread = parts.select("*", F.posexplode(F.arrays_zip("rest", "times")).alias("pos", "item")).select(
        "doc_id", "key", (F.col("pos") == 0).cast("int").alias("rows"), *(own(c).alias(c) for c in ("n_tokens", "n_known", "base", "model")), F.col("item.rest").alias("word"), F.col("item.times").alias("k")
    )
    looked = spread.join(judged.select("word", (F.col("c") > 0).cast("int").alias("is_known"), F.col("base").alias("word_base"), F.col("model").alias("word_model")), "word", "left")
    add = lambda c, w: F.sum(F.col(c) + F.col("k") * F.coalesce(F.col(w), F.lit(0))).alias(c)
    sums = looked.groupBy("doc_id", "key").agg(F.sum("rows").alias("rows"), F.sum("n_tokens").alias("n_tokens"), add("n_known", "is_known"), add("base", "word_base"), add("model", "word_model"))
    # equal rows were summed together
    each = sums.withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "rows")))
    share = lambda c, kind: (F.col(c) / F.col("rows")).cast(kind)
    return each.select(
        "doc_id", (crc_fold(F.col("doc_id"), folds) == held).alias("held_out"), share("n_tokens", "bigint").alias("n_tokens"), share("n_known", "bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"), share("base", "double").alias("base_score"), share("model", "double").alias("score"),
    )
