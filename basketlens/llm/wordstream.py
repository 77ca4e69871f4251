"""Words of many texts at once: byte classes and offsets in numpy, distinct words by Arrow's dictionaries; lists as one cell."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes worked on at a time, so that the working arrays of a very long text stay small.
CHUNK = 2 << 20
SPACE, BREAK = 32, 10


class Words(NamedTuple):
    """The words of a run of texts, in order."""

    values: pa.Array
    #: Number of the text and of the piece that each word stands in, both ascending.
    text: np.ndarray
    piece: np.ndarray


def byte_classes(separators: bytes, breaks: bytes = b"") -> bytes:
    """A table for ``bytes.translate``: A-Z lower-cased, separators as a space, ends of a piece as a line feed."""
    table = bytearray(b + 32 if 65 <= b <= 90 else b for b in range(256))
    for b in separators:
        table[b] = SPACE
    for b in breaks:
        table[b] = BREAK
    if any(table[b] in (SPACE, BREAK) and b not in separators + breaks for b in range(256)):
        raise ValueError("space and line feed must be separators")
    return bytes(table)


def text_bytes(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """UTF-8 of a text column as one string, with the byte each text starts at and the end; null is empty."""
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return b"", np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    starts = np.frombuffer(column.buffers()[1], width)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (data[int(starts[0]): int(starts[-1])].to_pybytes() if data else b""), starts - starts[0]


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def split(column: pa.Array, classes: bytes) -> Iterator[Words]:
    """The words of a text column, some megabytes at a time; a word or a text's order is never broken."""
    raw, starts = text_bytes(column)
    raw = raw.translate(classes)
    a, pieces = 0, 0
    while a < len(raw):
        b = _cut(raw, a + CHUNK)
        data = np.frombuffer(raw, np.uint8, b - a, a)
        breaks = data == BREAK
        inside = ~(breaks | (data == SPACE))
        edge = np.zeros(b - a + 1, bool)  # a text starts here
        edge[starts[(starts >= a) & (starts <= b)] - a] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(begin):
            text = np.searchsorted(starts, begin + a, "right") - 1
            piece = pieces + np.cumsum(breaks)[begin] + text
            yield Words(string_array(data[inside], np.concatenate([[0], np.cumsum(end - begin)])), text, piece)
        pieces += int(breaks.sum())
        a = b


def _cut(raw: bytes, at: int) -> int:
    """The first separator from ``at`` on, or the end."""
    if at >= len(raw):
        return len(raw)
    found = [p for p in (raw.find(b" ", at), raw.find(b"\n", at)) if p >= 0]
    return min(found, default=len(raw))


def numbered(values: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """The number of each word among the distinct words, and these."""
    if not values:
        return np.zeros(0, np.int32), pa.array([], pa.string())
    coded = pa.chunked_array(values).combine_chunks().dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary


def packed(values: np.ndarray | pa.Array) -> pa.Array:
    """A list as one binary cell: an Arrow stream, compressed, whole numbers in as few bytes as the largest needs.

    Spark passes such a cell on as bytes. A list cell of numbers it takes apart into vectors of values and levels wherever
    the table is read, for all rows of a row group at once.
    """
    if isinstance(values, np.ndarray):
        least = np.result_type(np.min_scalar_type(values.min(initial=0)), np.min_scalar_type(values.max(initial=0)))
        values = pa.array(values.astype(least if least.kind in "iu" else values.dtype))
    batch = pa.RecordBatch.from_arrays([values], names=["values"])
    cell = pa.BufferOutputStream()
    with pa.ipc.new_stream(cell, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return pa.array([cell.getvalue().to_pybytes()], pa.binary())


def unpacked(batch: pa.RecordBatch, column: str, row: int) -> pa.Array:
    """The list in a cell of :func:`packed`."""
    return pa.ipc.open_stream(batch.column(column)[row].as_buffer()).read_next_batch().column(0)


def unpacked_numbers(batch: pa.RecordBatch, column: str, row: int, kind: type = np.int32) -> np.ndarray:
    return unpacked(batch, column, row).to_numpy(zero_copy_only=False).astype(kind, copy=False)
