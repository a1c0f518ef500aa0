"""Cost-balanced packing of token sequences.

Every task tokenizes its own rows and packs them, so nothing is shuffled and no sequence spans tasks; a
task that is run again replaces its sequences whole. A task gathers documents up to ``pool_tokens`` tokens,
then packs that pool:

* as many sequences of ``capacity`` tokens as the pool fills, and for the rest one sequence for each power
  of two in its binary form, which needs no padding either;
* documents of ``capacity`` tokens or more give off whole sequences; the other pieces go, longest first, to the
  sequence with the lowest estimated cost (``linear * n + quadratic * n * n`` for each piece of n tokens, as
  attention stays within a piece) among those with room for the piece; where none has room, the piece is cut
  to fill the cheapest one with any room.

Defined results: a null or empty text has one token, the end id; null ids stay null; repeated rows are packed
each on their own, also with the same id; a text of any length is cut over sequences; an empty table gives an empty result; other columns are
ignored. Which documents meet in a sequence depends on how the input is partitioned.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.batches import text_slices

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
END = 1


#: ASCII punctuation, and words of letters that are their own normal form: small ASCII letters and the letters of Latin-1 (beside the signs between them).
PUNCTUATION, LETTERS = string.punctuation.encode(), re.compile("[a-zÀ-ÖØ-öø-ÿ]+")


def stem_of(word: bytes) -> bytes:
    """``word`` without closing ASCII punctuation where it stands behind a letter or digit that ``LETTERS`` or ASCII has; else all of it."""
    stem = word.rstrip(PUNCTUATION)
    if not stem or len(stem) == len(word):
        return word
    last = stem[-1]
    latin = len(stem) > 1 and stem[-2] == 0xC3 and last not in (0x97, 0xB7)
    return stem if latin or 97 <= last <= 122 or 48 <= last <= 57 else word


class WordIds:
    """Ids of whole texts by a tokenizer that lower-cases and whose tokens never cross ASCII white space, nor the place between
    a letter or digit and closing ASCII punctuation; so stems and closings are encoded once while they are remembered. Words are remembered in two
    generations of half of ``remember`` each: what is used moves to the younger one, and only the older one is forgotten.

    Words of ``LETTERS`` alone are one word to the tokenizer too, and its normalizer and pattern only make them small; so they are encoded many
    to a text without these two, spelt in its letters for bytes, and told apart by the mark that the last token of a word has.

    The tokenizer looks for its special tokens in the raw text, with their case; so texts with ``SPECIAL`` in them go to it whole."""

    SPECIAL, MARK, TOGETHER = "<|", "</w>", 1000

    def __init__(self, path: str, remember: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would only wait for each other's cache
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = None, WhitespaceSplit()
        bytes_of = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelt = {i: bytes_of.pre_tokenize_str(chr(i).lower())[0][0] for i in range(0xC0, 0x100) if LETTERS.fullmatch(chr(i))}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(self.MARK)]] = True
        self.remember, self.known, self.older = remember, {}, {}

    def _learn(self, words: list[bytes]) -> None:
        ascii_letters, letters, others = [], [], []
        for word in words:
            (ascii_letters if word.isalpha() else letters if LETTERS.fullmatch(word.decode()) else others).append(word)
        for same in (ascii_letters, letters):
            parts = [same[i : i + self.TOGETHER] for i in range(0, len(same), self.TOGETHER)]
            texts = [b" ".join(part).decode() for part in parts]
            found = self.plain.encode_batch_fast(texts if same is ascii_letters else [t.translate(self.spelt) for t in texts], add_special_tokens=False)
            for part, one in zip(parts, found, strict=True):
                ids = np.array(one.ids, np.uint32)
                ends, raw = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist(), ids.tobytes()
                for word, start, end in zip(part, [0, *ends[:-1]], ends, strict=True):
                    self.known[word] = raw[start:end]
        found = self.tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False)
        for word, one in zip(others, found, strict=True):
            self.known[word] = array("I", one.ids).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if self.SPECIAL in t]
        out = self._encode(["" if self.SPECIAL in t else t for t in texts] if whole else texts)
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i].encode("utf-8", "replace").decode(), add_special_tokens=False).ids, np.uint32)
        return out

    def _recall(self, words: set[bytes]) -> set[bytes]:
        """Words that the younger generation doesn't know, without those that the older one holds, which move to the younger."""
        held = self.older.keys() & words
        self.known.update(zip(held, map(self.older.__getitem__, held), strict=True))
        return words - held

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.encode("utf-8", "replace").lower().split() for t in texts]
        distinct = set().union(*split)
        new = distinct.difference(self.known)
        if 2 * (len(self.known) + len(new)) > self.remember:  # workers outlive their tasks, so this is memory for good
            self.known, self.older, new = {}, self.known, distinct
        new = self._recall(new)
        closed = [(w, len(stem)) for w in new if (stem := stem_of(w)) is not w]
        new.difference_update([w for w, _ in closed])
        new.update([w[:n] for w, n in closed], [w[n:] for w, n in closed])
        self._learn(list(self._recall(new.difference(self.known))))
        known = self.known
        for w, n in closed:
            known[w] = known[w[:n]] + known[w[n:]]
        ids = known.__getitem__
        return [np.frombuffer(b"".join(map(ids, ws)), np.uint32) for ws in split]


_ENCODERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One encoder for each worker process, so that its tasks share what it remembers."""
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, WordIds(path))


def pack_pool(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[np.ndarray, int]:
    """Rows (document, start, length, sequence, offset) and the number of sequences, for documents of these lengths."""
    total, rows, used = int(lengths.sum()), [], 0
    pieces = []
    for d in np.argsort(-lengths, kind="stable").tolist():
        n, start = int(lengths[d]), 0
        while n - start >= capacity:
            rows.append((d, start, capacity, used, 0))
            start, used = start + capacity, used + 1
        if start < n:
            pieces.append((n - start, d, start))
    pieces.sort(key=lambda p: -p[0])
    rest = total - used * capacity
    sizes = [capacity] * (rest // capacity) + [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if (rest % capacity) >> k & 1]
    room, fill, cost = np.array(sizes, np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
    for n, d, start in pieces:
        while n:
            at = int(np.argmin(np.where(room >= n, cost, np.inf)))
            if room[at] < n:
                at = int(np.argmin(np.where(room > 0, cost, np.inf)))
            take = min(n, int(room[at]))
            rows.append((d, start, take, used + at, int(fill[at])))
            room[at], fill[at], cost[at] = room[at] - take, fill[at] + take, cost[at] + linear * take + quadratic * take * take
            n, start = n - take, start + take
    return np.array(rows, np.int64).reshape(-1, 5), used + len(sizes)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048, pool_tokens: int = 2_000_000) -> DataFrame:
    """A row for each piece of a document; sequences of a task are numbered from its partition number on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = word_ids(tokenizer_path), TaskContext.get().partitionId() << 33
        names: list = []
        pool: list[np.ndarray] = []
        gathered = 0

        def emptied() -> pa.RecordBatch:
            nonlocal sequence, names, pool, gathered
            lengths = np.array([len(x) for x in pool], np.int64)
            rows, made = pack_pool(lengths, capacity, linear, quadratic)
            doc, start, length, number, offset = rows.T
            crc = [zlib.crc32(pool[d][s : s + n]) for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            columns = {
                "doc_id": pa.array([names[d] for d in doc.tolist()], pa.int64()), "start": start, "length": length, "ids_crc32": np.array(crc, np.int64),
                "doc_tokens": lengths[doc], "sequence_id": sequence + number, "offset": offset,
            }
            sequence, names, pool, gathered = sequence + made, [], [], 0
            return pa.RecordBatch.from_pydict(columns)

        for ids, texts in text_slices(batches):
            for name, found in zip(ids, encoder.encode(texts), strict=True):
                names.append(name)
                pool.append(np.append(found, np.uint32(END)))
                gathered += len(found) + 1
                if gathered >= pool_tokens:
                    yield emptied()
        if pool:
            yield emptied()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
