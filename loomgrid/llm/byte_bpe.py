"""Byte-level BPE by a sentencepiece model that is written straight from the vocabulary.

Each byte string of the vocabulary becomes a piece whose characters stand for its bytes, scored by its
negative rank, so that the best-scored merge is the one of lowest rank. Normalisation is the identity. The
pattern's matches are encoded one by one; a match is encoded once while it is remembered.

Defined results: a null text is empty and has no ids; repeated rows give repeated results; null ids stay
null; a text of any length is encoded whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.batches import text_slices

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: Fixed values of sentencepiece's model format: piece types and model type.
NORMAL, UNKNOWN, BPE = 1, 2, 2


def byte_letters() -> dict[int, str]:
    """A printable character for each byte: itself where it is one that isn't white space, else one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def read_ranks(path: str) -> list[bytes]:
    """Byte strings of the vocabulary in the order of their ranks, which have no gaps."""
    with open(path, "rb") as lines:
        ranked = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    return [ranked[i] for i in range(len(ranked))]


def _varint(n: int) -> bytes:
    n, out = n & (1 << 64) - 1, bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(vocabulary: list[bytes]) -> bytes:
    """Serialised model whose piece ids are the ranks; the unknown piece, which can't occur, comes last."""
    letters = byte_letters()
    out = bytearray()
    for rank, token in enumerate(vocabulary):
        piece = "".join(letters[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, NORMAL))
    out += _field(1, _field(1, b"<unk>") + _field(2, float(-len(vocabulary))) + _field(3, UNKNOWN))
    out += _field(2, _field(3, BPE) + _field(4, len(vocabulary) + 1) + _field(40, len(vocabulary)) + b"".join(_field(n, -1) for n in (41, 42, 43)))
    return bytes(out + _field(3, _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))))


class ByteBpe:
    """Encoder and decoder of whole texts."""

    def __init__(self, path: str, pattern: str, remember: int = 500_000):
        import regex
        import sentencepiece

        self.vocabulary = read_ranks(path)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.vocabulary))
        self.matches, self.remember, self.known = regex.compile(pattern).findall, remember, {}
        self.letters = byte_letters()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.matches(t) for t in texts]
        distinct = set().union(*split)
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > self.remember:
            self.known, new = {}, distinct
        new = list(new)
        spelled = [m.encode("utf-8", "replace").decode("latin-1").translate(self.letters) for m in new]
        for match, ids in zip(new, self.processor.encode(spelled, num_threads=1), strict=True):
            self.known[match] = array("I", ids).tobytes()
        return [b"".join(map(self.known.__getitem__, ms)) for ms in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODERS: dict[tuple[str, str], ByteBpe] = {}


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One coder for each worker process, so that its tasks share the model and what it remembers."""
    return _CODERS.get((path, pattern)) or _CODERS.setdefault((path, pattern), ByteBpe(path, pattern))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every text's ids and of the bytes that they decode to; ``encode_ids`` gives the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(ranks_path, pattern)
        for names, texts in text_slices(batches):
            found = coder.encode(texts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(names, pa.int64()), "n_tokens": pa.array([len(x) // 4 for x in found], pa.int64()),
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in found], "decoded_sha256": [hashlib.sha256(coder.decode(x)).hexdigest() for x in found],
            })

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def encode_ids(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(ranks_path, pattern)
        for names, texts in text_slices(batches):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in coder.encode(texts)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(names, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")
