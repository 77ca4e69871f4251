"""Benchmark decontamination with a distributed positional inverted index.

The training texts become a document-partitioned positional index: one row holds the postings of a block of whole texts,
each term with the ascending places where it stands, so neither a frequent term nor a hot source gathers anywhere. The
index is stored once. A benchmark window is looked up by taking the postings of its rarest term in the block, moving
them back by the term's offset and intersecting them with the next rarest, until the list is empty or an exact phrase.
Proximity matches start from the same list and ask for every term within a few words.

Benchmark windows are the stated query set. They travel to the index in parts of at most ``PART_WINDOWS`` windows; each
part runs against all blocks, and the hits of all parts are united.

Defined results: null texts and items have no words and match nothing; an item of fewer words than a window is one
window; equal items or texts count by row. Very long texts stay whole in one block. With an empty benchmark every text is
clean. Matches never cross texts. An item without an item_id marks words as hit and has no name in ``items``; a row without
a doc_id is searched like any other. Ids must be integers. Other columns, of whatever name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import BROADCAST_IDS, bounded, map_arrow, numbered, texts
from basketlens.session import settle

WINDOW = 10
#: Words of one index block (a longer text is a block of its own) and the empty places between its texts.
BLOCK_WORDS = 1 << 20
GAP = 64
#: Windows of one part of the benchmark: about 100 MB at ten words of ten bytes.
PART_WINDOWS = 1_000_000

_KEEP = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
INDEX = ("block bigint, doc_ids array<bigint>, n_words array<int>, terms array<string>, starts array<int>, postings array<int>")
MATCHES = ("block bigint, doc_no int, doc_id bigint, n_words bigint, hit_words array<int>, items array<bigint>,"
           " phrases array<struct<item_id: bigint, start: int, n: int>>, near_items array<bigint>")


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split()


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: Broadcast | None = None) -> DataFrame:
    """Postings of whole texts, a row per block. ``vocabulary`` (a set of terms) limits the terms whose postings are kept."""
    source = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                         F.monotonically_increasing_id().alias("row"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(INDEX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {term: i for i, term in enumerate(sorted(vocabulary.value))} if vocabulary else {}
        block = _Block(numbers, fixed=vocabulary is not None)
        for batch in batches:
            for doc, row, words in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), map(words_of, texts(batch))):
                if block.size and block.size + len(words) > BLOCK_WORDS:
                    yield block.flush(schema)
                block.add(doc, row, words)
        if block.rows:
            yield block.flush(schema)

    return source.mapInArrow(run, INDEX)


class _Block:
    def __init__(self, numbers: dict[bytes, int], fixed: bool) -> None:
        self.numbers, self.fixed = numbers, fixed
        self._empty()

    def _empty(self) -> None:
        self.rows, self.docs, self.lengths, self.streams, self.size = [], [], [], [], 0
        if not self.fixed:
            self.numbers = {}

    def add(self, doc: int | None, row: int, words: list[bytes]) -> None:
        if self.fixed:
            get = self.numbers.get
            ids = [get(w, -1) for w in words]
        else:
            put = self.numbers.setdefault
            ids = [put(w, len(self.numbers)) for w in words]
        self.rows.append(row)
        self.docs.append(doc)
        self.lengths.append(len(words))
        self.streams.append(np.array(ids, np.int32))
        self.size += len(words)

    def flush(self, schema: pa.Schema) -> pa.RecordBatch:
        first = np.concatenate([[0], np.cumsum(np.array(self.lengths[:-1], np.int64) + GAP)])
        ids = np.concatenate(self.streams)
        at = np.concatenate([np.arange(s, s + n) for s, n in zip(first, self.lengths)])
        at, ids = at[ids >= 0].astype(np.int32), ids[ids >= 0]
        order = np.argsort(ids, kind="stable")
        counts = np.bincount(ids, minlength=len(self.numbers))
        present = np.flatnonzero(counts)
        terms = np.array(list(self.numbers), object)[present] if len(present) else []
        row = [[self.rows[0]], [self.docs], [self.lengths], [[t.decode("utf-8", "replace") for t in terms]],
               [np.concatenate([[0], np.cumsum(counts[present])]).astype(np.int32)], [at[order]]]
        self._empty()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema)], schema=schema)


def benchmark_windows(rows: Iterator, width: int = WINDOW) -> Iterator[tuple[int, tuple[bytes, ...]]]:
    """(item, words) of every window of every item."""
    for item, text in rows:
        words = words_of(text or "")
        if words:
            for i in range(max(1, len(words) - width + 1)):
                yield item, tuple(words[i: i + width])


def search(index: DataFrame, windows: Broadcast, slack: int | None = None) -> DataFrame:
    """Matches of one part of the benchmark: a row per text.

    ``slack`` asks for proximity matches too: items with a window whose terms all stand, in any order, within the
    window's length plus ``slack`` words.
    """
    if slack is not None and WINDOW + slack > GAP:
        raise ValueError("the slack must stay below the gap between texts")

    def make():
        queries = windows.value
        terms: dict[str, int] = {}
        by_length: dict[int, tuple[list[list[int]], list[int]]] = {}
        for item, window in queries:
            rows, items = by_length.setdefault(len(window), ([], []))
            rows.append([terms.setdefault(w.decode("utf-8", "replace"), len(terms)) for w in window])
            items.append(item)
        tables = [(np.array(rows), items) for rows, items in by_length.values()]

        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {name: [] for name in ("block", "doc_no", "doc_id", "n_words", "hit_words", "items", "phrases", "near_items")}
            for row in range(batch.num_rows):
                _search_block(batch, row, terms, tables, slack, out)
            return out

        return work

    return map_arrow(index, make, MATCHES)


def _search_block(batch: pa.RecordBatch, row: int, terms: dict[str, int], tables: list, slack: int | None, out: dict[str, list]) -> None:
    cell = lambda name: batch.column(name)[row]
    lengths = np.asarray(cell("n_words").values, np.int64)
    starts, postings = np.asarray(cell("starts").values), np.asarray(cell("postings").values)
    first = np.concatenate([[0], np.cumsum(lengths[:-1] + GAP)])
    known = {}
    for i, term in enumerate(cell("terms").values.to_pylist()):
        if (number := terms.get(term)) is not None:
            known[number] = i
    counts = np.zeros(len(terms), np.int64)
    for number, i in known.items():
        counts[number] = starts[i + 1] - starts[i]
    listed = lambda number: postings[starts[known[number]]: starts[known[number] + 1]]
    end = int(first[-1] + lengths[-1]) if len(lengths) else 0
    edges = np.zeros(end + 1, np.int64)
    phrases: dict[int, list] = {}
    near: dict[int, set[int]] = {}
    for rows, items in tables:
        for q in np.flatnonzero((counts[rows] > 0).all(axis=1)):
            window = rows[q]
            order = np.argsort(counts[window], kind="stable")
            hits = listed(window[order[0]]) - order[0]
            for k in order[1:]:
                if not len(hits):
                    break
                hits = hits[_contains(listed(window[k]), hits + k)]
            for p in hits.tolist():
                doc = int(np.searchsorted(first, p, "right")) - 1
                phrases.setdefault(doc, []).append({"item_id": items[q], "start": int(p - first[doc]), "n": len(window)})
                edges[p] += 1
                edges[p + len(window)] -= 1
            if slack is not None:
                for p in _near([listed(t) for t in window[order]], len(window) + slack).tolist():
                    near.setdefault(int(np.searchsorted(first, p, "right")) - 1, set()).add(items[q])
    covered = np.cumsum(edges)[:-1] > 0
    ids = cell("doc_ids").values.to_pylist()
    block = cell("block").as_py()
    for doc, n in enumerate(lengths.tolist()):
        found = phrases.get(doc, [])
        hit_words = np.flatnonzero(covered[first[doc]: first[doc] + n]).astype(np.int32) if found else []
        items = sorted({f["item_id"] for f in found if f["item_id"] is not None})
        for name, value in zip(out, (block, doc, ids[doc], n, hit_words, items, found, sorted(near.get(doc, set()) - set(items)))):
            out[name].append(value)


def _contains(sorted_values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, asked), len(sorted_values) - 1)
    return sorted_values[at] == asked


def _near(lists: list[np.ndarray], span: int) -> np.ndarray:
    """Places of the rarest term (first list) around which every list has a place within one run of ``span`` words."""
    places = lists[0]
    for other in lists[1:]:
        if not len(places):
            return places
        places = places[np.searchsorted(other, places + span - 1, "right") > np.searchsorted(other, places - span + 1)]
    if not len(places):
        return places
    begin = places[:, None] - np.arange(span)[None, :]
    whole = np.ones(begin.shape, bool)
    for other in lists:
        whole &= np.searchsorted(other, begin + span - 1, "right") > np.searchsorted(other, begin)
    return places[whole.any(axis=1)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", slack: int | None = None, part_windows: int = PART_WINDOWS) -> DataFrame:
    """Phrase (and proximity) matches of every benchmark item in every text: a row per text with ``doc_id``, ``n_words``,
    ``hit_words`` (numbers of the words inside a match), ``items``, ``phrases`` and ``near_items``.

    The benchmark is read part by part through an iterator; the driver holds one part at a time.
    """
    context = docs.sparkSession.sparkContext
    rows = benchmark.select(F.col(f"`{item_id}`").cast("bigint"), F.col(f"`{item_text}`")).toLocalIterator()
    windows = benchmark_windows(rows)
    parts = []
    while True:
        part = [w for _, w in zip(range(part_windows), windows)]
        if part or not parts:
            parts.append(context.broadcast(part))
        if len(part) < part_windows:
            break
    vocabulary = None
    if len(parts) == 1:
        vocabulary = context.broadcast({word for _, window in parts[0].value for word in window})
    index = settle(build_index(docs, doc_id, text, vocabulary))
    found = [search(index, part, slack) for part in parts]
    if len(found) == 1:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    united = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)
    return every.groupBy("block", "doc_no").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                                                *(united(c) for c in ("hit_words", "items", "phrases", "near_items"))
                                                ).withColumn("near_items", F.array_except("near_items", "items"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark phrase. Each row is judged by its own text, whatever its id."""
    rows = numbered(docs, "_hit_row")
    found = decontaminate(rows, benchmark, "_hit_row", text)
    hit = settle(found.where("size(hit_words) > 0").select(F.col("doc_id").alias("_hit_row")))
    return rows.join(bounded(hit, BROADCAST_IDS), "_hit_row", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
