"""Arrow batches of texts in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def sliced(batches: Iterator[pa.RecordBatch], column: str | int, max_bytes: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """(rows, their texts) of at most about ``max_bytes`` of text, or one row, whatever the batches' sizes; null texts are empty."""
    for batch in batches:
        texts = batch.column(column)
        begin = size = 0
        for i, length in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            if size and size + length > max_bytes:
                yield batch.slice(begin, i - begin), [t or "" for t in texts.slice(begin, i - begin).to_pylist()]
                begin, size = i, 0
            size += length
        if begin < batch.num_rows:
            yield batch.slice(begin), [t or "" for t in texts.slice(begin).to_pylist()]


def text_slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 1 << 21) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of the first two columns, in such slices."""
    for part, texts in sliced(batches, 1, max_bytes):
        yield part.column(0).to_pylist(), texts
