"""Token-id files compressed by a grammar (Re-Pair), with random access to every document.

Texts are put in order of their ids by one range shuffle, encoded where they then lie, and written as shards: runs of whole
documents of one task, some million ids each. In every shard the most frequent pairs of neighbouring symbols are replaced by
new symbols (nonterminals), over and over, until no pair occurs ``LEAST`` times. The file keeps the rules, how many ids each
nonterminal stands for, the symbols that are left, and for each document the symbol it begins in, so that a document is
decoded from its own symbols only (:meth:`Shard.document`) or a shard as a whole (:meth:`Shard.ids`).

One round replaces several pairs: in falling order of their counts, down to a ``CLASS``-th of the most frequent one's, those
that cannot overlap (no symbol is the left of one and the right of another). Replacing them one by one gives the same symbols.

A shard is a row of a parquet table in a folder that all executors share; the column ``payload`` holds it in the format below.

=========  =========================================================================================
bytes      content, all integers little-endian and unsigned
=========  =========================================================================================
8          ``b"REPAIR01"``
28         alphabet (nonterminals start here), rules, symbols, documents as 32 bits each; ids as 64 bits; CRC-32 of the ids
4 x rules  left symbol of each rule; then right symbols; then the number of ids each rule stands for
4 x docs   number of ids of each document; then the symbol it begins in; then the ids of that symbol to skip
4 x symb.  the symbols
=========  =========================================================================================

Defined results: a null text is empty and has the end id only; null ids come first; rows of one id are ordered by a hash of
the text, so equal rows are interchangeable; a hot id is spread over several tasks, as the range shuffle knows the hash and the row too. A text
longer than a shard is a shard of its own. An empty table gives no shard. Only the named columns are read, so clashing names do
not matter. Ids of documents are integers; a text id fails the cast.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.byte_pieces import SLICE, encoder
from basketlens.llm.common import arrow_rows

END = 0
#: Ids of one shard, the count at which a pair is frequent, and the span of counts replaced in one round.
SHARD_IDS, LEAST, CLASS = 1 << 20, 32, 64

MAGIC = b"REPAIR01"
HEADER = struct.Struct("<8sIIIIQI")
SHARDS = "part int, shard int, before bigint, n_ids bigint, doc_ids array<bigint>, payload binary"


# ---------------------------------------------------------------- grammar


def replaced_pairs(symbols: np.ndarray, alphabet: int, least: int = LEAST, span: int = CLASS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols left, left and right symbol of each rule) of a run of ids below ``alphabet``."""
    symbols = symbols.astype(np.uint32)
    lefts, rights = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    top = alphabet
    while len(symbols) > 1:
        kind, shift = (np.uint32, 16) if top <= 1 << 16 else (np.uint64, 32)
        keys = _keys(symbols[:-1], symbols[1:], kind, shift)
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(first, len(keys)))
        frequent = counts >= least
        if not frequent.any():
            break
        pairs = _together(keys[first[frequent]], counts[frequent], max(least, int(counts.max()) // span), shift)
        left, right = (pairs >> kind(shift)).astype(np.uint32), (pairs & kind((1 << shift) - 1)).astype(np.uint32)
        begins, ends = np.zeros(top, bool), np.zeros(top, bool)
        begins[left], ends[right] = True, True
        at = np.flatnonzero(begins[symbols[:-1]] & ends[symbols[1:]])
        asked = _keys(symbols[at], symbols[at + 1], kind, shift)
        rule = np.minimum(np.searchsorted(pairs, asked), len(pairs) - 1)
        same = pairs[rule] == asked
        at, rule = _apart(at[same], rule[same])
        symbols[at] = top + rule
        kept = np.ones(len(symbols), bool)
        kept[at + 1] = False
        symbols = symbols[kept]
        lefts.append(left)
        rights.append(right)
        top += len(pairs)
    return symbols, np.concatenate(lefts), np.concatenate(rights)


def _keys(left: np.ndarray, right: np.ndarray, kind, shift: int) -> np.ndarray:
    keys = left.astype(kind)
    keys <<= kind(shift)
    keys |= right.astype(kind, copy=False)
    return keys


def _together(pairs: np.ndarray, counts: np.ndarray, floor: int, shift: int) -> np.ndarray:
    """Pairs of at least ``floor`` occurrences that may be replaced in one round, ascending."""
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] >= floor]
    lefts, rights, chosen = set(), set(), []
    for i, pair in zip(order.tolist(), pairs[order].tolist()):
        left, right = pair >> shift, pair & ((1 << shift) - 1)
        if left in rights or right in lefts or (left == right and left in lefts):
            continue
        lefts.add(left)
        rights.add(right)
        chosen.append(i)
    return np.sort(pairs[chosen])


def _apart(at: np.ndarray, rule: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences without overlaps. Only a pair of equal symbols overlaps itself: every other one of a run is taken."""
    starts = np.concatenate([[True], at[1:] != at[:-1] + 1]) if len(at) else np.zeros(0, bool)
    place = np.arange(len(at))
    odd = (place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 1
    return at[~odd], rule[~odd]


def rule_lengths(left: np.ndarray, right: np.ndarray, alphabet: int) -> np.ndarray:
    """Ids that each rule stands for; a rule only names earlier ones."""
    sizes = [1] * len(left)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        sizes[i] = (1 if a < alphabet else sizes[a - alphabet]) + (1 if b < alphabet else sizes[b - alphabet])
    return np.array(sizes, np.uint32)


def pack(documents: list[np.ndarray], alphabet: int, least: int = LEAST) -> bytes:
    """A shard of documents' ids in the file format."""
    ids = np.concatenate(documents).astype(np.uint32)
    alphabet = max(alphabet, int(ids.max(initial=0)) + 1)
    symbols, left, right = replaced_pairs(ids, alphabet, least)
    length = rule_lengths(left, right, alphabet)
    ends = np.cumsum(np.concatenate([np.ones(alphabet, np.uint32), length])[symbols], dtype=np.int64)
    sizes = np.array([len(d) for d in documents], np.int64)
    begins = np.cumsum(sizes) - sizes
    symbol = np.searchsorted(ends, begins, "right")
    skip = begins - np.concatenate([[0], ends])[symbol]
    head = HEADER.pack(MAGIC, alphabet, len(left), len(symbols), len(documents), len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
    return head + b"".join(a.astype("<u4").tobytes() for a in (left, right, length, sizes, symbol, skip, symbols))


class Shard:
    """A shard read from its bytes."""

    def __init__(self, payload: bytes) -> None:
        magic, self.alphabet, rules, symbols, documents, self.n_ids, self.crc32 = HEADER.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size
        read = []
        for n in (rules, rules, rules, documents, documents, documents, symbols):
            read.append(np.frombuffer(payload, "<u4", n, at))
            at += 4 * n
        if at != len(payload):
            raise ValueError("token shard of a wrong length")
        self.left, self.right, self.length, self.sizes, self.symbol, self.skip, self.symbols = read

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        """All ids of some symbols: each round writes the ids that are there and opens the nonterminals."""
        def size(s):
            out = np.ones(len(s), np.int64)
            inner = s >= self.alphabet
            out[inner] = self.length[s[inner] - self.alphabet]
            return out

        place = np.cumsum(size(symbols))
        out = np.empty(int(place[-1]) if len(place) else 0, np.uint32)
        place -= size(symbols)
        while len(symbols):
            inner = symbols >= self.alphabet
            out[place[~inner]] = symbols[~inner]
            rule, place = symbols[inner] - self.alphabet, place[inner]
            left, right = self.left[rule], self.right[rule]
            symbols, place = np.concatenate([left, right]), np.concatenate([place, place + size(left)])
        return out

    def ids(self) -> np.ndarray:
        """The ids of all documents."""
        ids = self._expanded(self.symbols)
        if len(ids) != self.n_ids or zlib.crc32(ids.tobytes()) != self.crc32:
            raise ValueError("token shard is damaged")
        return ids

    def document(self, i: int) -> np.ndarray:
        """The ids of one document, from the symbols that it touches."""
        last = int(self.symbol[i + 1]) + 1 if i + 1 < len(self.symbol) else len(self.symbols)
        ids = self._expanded(self.symbols[int(self.symbol[i]): last])
        return ids[int(self.skip[i]): int(self.skip[i]) + int(self.sizes[i])]


# ------------------------------------------------------------------ tables


def shards(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The rows of a shard table, to be written to a folder: parts and their shards ascend with the ids of documents."""
    source = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                         F.monotonically_increasing_id().alias("row")).withColumn("mark", F.xxhash64("text"))
    order = ("doc_id", "mark", "row")
    ordered = source.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SHARDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        names, documents, size = [], [], 0

        def flush() -> pa.RecordBatch:
            return arrow_rows(schema, {"part": [part], "shard": [number], "before": [before], "n_ids": [size], "doc_ids": [names],
                                       "payload": [pack(documents, ids_of.vocabulary)]})

        for names_read, texts_read in _large(batches):
            for name, ids in zip(names_read, ids_of.encode(texts_read)):
                if size and size + len(ids) + 1 > shard_ids:
                    yield flush()
                    number, before = number + 1, before + size
                    names, documents, size = [], [], 0
                names.append(name)
                documents.append(np.append(ids, np.uint32(end)))
                size += len(ids) + 1
        if documents:
            yield flush()

    return ordered.mapInArrow(run, SHARDS)


def _large(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts of several batches at once, up to ``SLICE`` bytes or one batch."""
    names, texts, size = [], [], 0
    for batch in batches:
        if size and size + batch.nbytes > SLICE:
            yield names, pa.concat_arrays(texts)
            names, texts, size = [], [], 0
        names += batch.column("doc_id").to_pylist()
        texts.append(batch.column("text"))
        size += batch.nbytes
    if texts:
        yield names, pa.concat_arrays(texts)


def documents(table: DataFrame) -> DataFrame:
    """The documents of a shard table that was read back: doc_id, ``start`` (ids of all documents before), ``n_tokens`` and
    ``ids_crc32`` of their ids as little-endian unsigned 32-bit integers."""
    ddl = "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.column("payload")[row].as_py())
                data, sizes = memoryview(shard.ids().astype("<u4", copy=False).tobytes()), shard.sizes.astype(np.int64)
                begins = np.cumsum(sizes) - sizes
                crc = [zlib.crc32(data[4 * a: 4 * (a + n)]) for a, n in zip(begins.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("part")[row].as_py()] * len(crc), pa.int32()), batch.column("doc_ids")[row].values,
                     pa.array(begins + batch.column("before")[row].as_py()), pa.array(sizes), pa.array(crc, pa.int64())], schema=schema)

    # a row per write task, so the window and the broadcast are as small as the list of partitions
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    found = table.select("part", "before", "doc_ids", "payload").mapInArrow(run, ddl)
    return found.join(F.broadcast(starts), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
