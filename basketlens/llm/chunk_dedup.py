"""Substring deduplication by content-defined chunks.

A gear rolling hash over the UTF-8 bytes sets chunk borders by what stands just before them, so chunks are the same
wherever a passage stands and an insertion changes only the chunks around it. Chunks are variable in length and named by
a digest; of all chunks with one digest the first (least ``doc_id``, then place) stays. A later chunk is removed if it and
its removed neighbours make a run of at least ``min_run`` bytes, so that a short phrase met by chance is left alone.

Defined results: null texts are empty and have no chunks. Rows are told apart by id and text: rows of one doc_id with
different texts are different documents, rows equal in both are one document and all keep the same bytes. Rows without a
doc_id take part and come after all others. Texts of any length are chunked whole; an empty table gives no rows. Ids must
be integers. Other columns, of whatever name, are not read and stay as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import map_arrow, mix64, texts

#: A border candidate in 2^BITS bytes; at least MIN_CHUNK bytes after the candidate before, forced after MAX_CHUNK.
BITS, MIN_CHUNK, MAX_CHUNK = 5, 16, 1024
MIN_RUN = 64
DIGEST_BYTES = 12
#: The 256 random words of the gear hash, from a fixed seed.
GEAR = (mix64(np.arange(256, dtype=np.uint64), 42) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash after each byte: sum of GEAR[byte k back] << k over the last 32 bytes, by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        moved = h.copy()
        moved[step:] += h[:-step] << np.uint32(step) if step < len(h) else 0
        h = moved
    return h


def borders(raw: bytes) -> np.ndarray:
    """Ends of the chunks of a text. Each but a forced one depends on at most 32 + MIN_CHUNK bytes before it."""
    if not raw:
        return np.zeros(0, np.int64)
    hashes = gear_hashes(np.frombuffer(raw, np.uint8))
    at = np.flatnonzero(hashes >> np.uint32(32 - BITS) == 0) + 1
    at = at[np.diff(at, prepend=-MIN_CHUNK) >= MIN_CHUNK]
    ends = np.unique(np.append(at, len(raw)))
    sizes = np.diff(ends, prepend=0)
    if sizes.max() > MAX_CHUNK:
        forced = [np.arange(e - n + MAX_CHUNK, e, MAX_CHUNK) for e, n in zip(ends, sizes) if n > MAX_CHUNK]
        ends = np.unique(np.concatenate([ends, *forced]))
    return ends


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The number that, beside the id, tells rows of one id apart."""
    return F.xxhash64(F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{text}`"))


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``digest``, ``doc_id``, ``row`` (see :func:`row_key`), ``start`` and ``n`` (bytes) of every chunk."""
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            digests, starts, sizes, counts = [], [], [], []
            for t in texts(batch):
                raw = t.encode("utf-8", "surrogatepass")
                ends = borders(raw)
                first = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                counts.append(len(ends))
                starts.append(first)
                sizes.append(ends - first)
                digests += [hashlib.blake2b(raw[a:b], digest_size=DIGEST_BYTES).digest() for a, b in zip(first.tolist(), ends.tolist())]
            join = lambda parts: np.concatenate(parts).astype(np.int64)
            owner = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            return {"digest": digests, "doc_id": batch.column("doc_id").take(owner), "row": batch.column("row").take(owner), "start": join(starts).astype(np.int32), "n": join(sizes).astype(np.int32)}

        return work

    source = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"), row_key(doc_id, text).alias("row"))
    return map_arrow(source, make, "digest binary, doc_id bigint, row bigint, start int, n int")


def repeated(found: DataFrame) -> DataFrame:
    """Digests that occur more than once: where first, and in which document last. Counts combine before the shuffle."""
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "start")
    return found.groupBy("digest").agg(F.count("*").alias("times"), F.min(place).alias("first"), F.max("doc_id").alias("last_doc")).where("times > 1")


def _runs(repeats: Column, min_run: int) -> Column:
    """Removed spans, and bytes in runs of repeated chunks, first occurrences included."""
    @F.arrow_udf("struct<removed: array<struct<start: int, end: int>>, n_repeated: bigint>")
    def run(column: pa.Array) -> pa.Array:
        rows = []
        for cells in column.to_pylist():
            cells = sorted({(c["start"], c["n"], c["is_first"]) for c in cells or []})
            rows.append({"removed": [{"start": a, "end": b} for a, b in joined([c[:2] for c in cells if not c[2]], min_run)],
                         "n_repeated": sum(b - a for a, b in joined([c[:2] for c in cells], min_run))})
        return pa.array(rows, pa.struct([("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_repeated", pa.int64())]))

    return run(repeats)


def joined(cells: list[tuple[int, int]], min_run: int) -> list[tuple[int, int]]:
    """Runs (start, end) of adjacent (start, length) cells of at least ``min_run`` bytes; cells are in order."""
    runs: list[list[int]] = []
    for start, n in cells:
        if runs and runs[-1][1] == start:
            runs[-1][1] += n
        else:
            runs.append([start, start + n])
    return [(a, b) for a, b in runs if b - a >= min_run]


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """Documents with repeated chunks: ``doc_id``, ``row``, ``removed`` (byte spans), ``n_repeated`` (bytes in runs of repeated
    chunks, those that stay included) and ``partner_ids`` (documents that hold the first or last copy of a chunk)."""
    found = chunks(docs, doc_id, text)
    both = found.join(repeated(found), "digest")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row")) & (F.col("start") == F.col("first.start"))
    cell = F.struct("start", "n", is_first.alias("is_first"))
    partners = F.array_compact(F.array_distinct(F.flatten(F.collect_set(F.array("first.doc_id", "last_doc")))))
    per_doc = both.groupBy("doc_id", "row").agg(F.collect_list(cell).alias("cells"), partners.alias("partners"))
    others = F.filter("partners", lambda p: ~p.eqNullSafe(F.col("doc_id")))
    spans = per_doc.select("doc_id", "row", _runs(F.col("cells"), min_run).alias("runs"), F.array_sort(others).alias("partner_ids"))
    return spans.select("doc_id", "row", "runs.removed", "runs.n_repeated", "partner_ids").where("n_repeated > 0")


def without(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed spans of :func:`repeats` cut out of the text; a character cut in two goes whole."""
    @F.arrow_udf("string")
    def cut(column: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, removed in zip(column.to_pylist(), spans.to_pylist()):
            raw, at, kept = (t or "").encode("utf-8", "surrogatepass"), 0, []
            for span in removed or []:
                kept.append(raw[at: span["start"]])
                at = span["end"]
            out.append(None if t is None else b"".join([*kept, raw[at:]]).decode("utf-8", "ignore"))
        return pa.array(out, pa.string())

    spans = found.select(F.col("doc_id").alias("_repeat_doc_id"), F.col("row").alias("_repeat_row"), F.col("removed").alias("_repeat_spans"))
    same = F.col(f"`{doc_id}`").cast("bigint").eqNullSafe(F.col("_repeat_doc_id")) & (row_key(doc_id, text) == F.col("_repeat_row"))
    joined_ = docs.join(spans, same, "left")
    return joined_.select(*(cut(docs[f"`{c}`"], F.col("_repeat_spans")).alias(c) if c == text else docs[f"`{c}`"] for c in docs.columns))
