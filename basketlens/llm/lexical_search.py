"""Ranked lexical search, accumulator-limited and a term at a time.

The texts become a document-partitioned inverted index, a row per block of whole texts, written once. A query is scored
inside each block: its terms come rarest first, each term's postings add to the accumulators of their documents, and no
accumulator is made any more once the largest scores that the remaining terms can still give sum to less than the k-th best
partial score. The accumulators that exist are then updated to their exact scores. A task carries the k-th best score of
its earlier blocks along as a floor, keeps k documents for each query, and a window over queries merges the tasks' lists.

Queries are the stated, broadcast side. They go to the index in parts of at most ``PART_BYTES`` of terms (a single larger
query is a part of its own); a part's broadcast is dropped before the next one is made. Document frequencies come from the
index for the terms of the part.

All scores are 64-bit integers: weight w of a term = floor(1000 ln((2N+2)/(2df+1))), impact of a term in a document =
10^9 tf div (1000 tf + 20 m) with m = 50 + 50 n N div L, score = sum of w times impact over the distinct terms.

Defined results: null and wordless texts are no documents and match nothing; queries without terms have no rows; rows of one
query id are one query with the terms of all of them, whose result rows carry that id, null included; every row of
documents is a document, also when ids repeat; equal scores go by ascending id, null first; very long texts stay whole in
one block. Empty tables give empty results. Only the named columns are read, so clashing names do not matter. Ids of
documents are integers; a text id fails the cast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.wordstream import byte_classes, numbered, packed, split, unpacked, unpacked_numbers
from basketlens.session import settle

TOP = 50
#: Terms of one index block (a longer text is a block of its own).
BLOCK_TERMS = 1 << 20
#: Bytes of query terms that are broadcast at once.
PART_BYTES = 16 << 20

CLASSES = byte_classes(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)))
#: Lists are packed cells (:func:`wordstream.packed`).
INDEX = "doc_ids binary, n_terms binary, terms binary, starts binary, places binary, times binary, n_docs bigint, n_words bigint"


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Postings of all terms, a row per block: for each term its documents' places in the block and its times in them.

    Rows are large; settle them with ``LARGE_ROWS``.
    """
    source = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = _schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, values, size = [], [], [], 0
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for words in split(batch.column("text"), CLASSES):
                n += np.bincount(words.text, minlength=batch.num_rows)
                values.append(words.values)
            ids.append(batch.column("doc_id").filter(pa.array(n > 0)))
            counts.append(n[n > 0])
            size += int(n.sum())
            if size >= block_terms:
                yield _block(schema, ids, counts, values)
                ids, counts, values, size = [], [], [], 0
        if size:
            yield _block(schema, ids, counts, values)

    return source.mapInArrow(run, INDEX)


def _block(schema: pa.Schema, ids: list[pa.Array], counts: list[np.ndarray], values: list[pa.Array]) -> pa.RecordBatch:
    lengths = np.concatenate(counts)
    codes, terms = numbered(values)
    keys = codes.astype(np.int64) * len(lengths) + np.repeat(np.arange(len(lengths)), lengths)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    postings = keys[first]
    starts = np.searchsorted(postings, np.arange(len(terms) + 1) * len(lengths)).astype(np.int32)
    lists = pa.concat_arrays(ids), lengths, terms, starts, postings % len(lengths), np.diff(np.append(first, len(keys)))
    cells = [*map(packed, lists), pa.array([len(lengths)]), pa.array([len(keys)])]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cells, schema)], schema=schema)


def query_terms(queries: DataFrame, query_id: str = "item_id", text: str = "text") -> DataFrame:
    """A row per query with terms: ``query`` (a number), ``query_id``, its distinct ``terms`` in order and their ``bytes``."""
    schema = _schema("row bigint, term string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in split(batch.column("text"), CLASSES):
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(words.text)), words.values], schema=schema)

    source = settle(queries.select(F.col(f"`{query_id}`").alias("query_id"), F.col(f"`{text}`").alias("text"),
                                   F.monotonically_increasing_id().alias("row")))
    terms = source.select("row", "text").mapInArrow(run, "row bigint, term string").distinct()
    grouped = terms.join(source.select("row", "query_id"), "row").groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return grouped.select(F.monotonically_increasing_id().alias("query"), "query_id", "terms",
                          F.aggregate("terms", F.lit(0).cast("bigint"), lambda n, t: n + F.octet_length(t) + 16).alias("bytes"))


def _frequencies(index: DataFrame, terms) -> DataFrame:
    """Documents that hold each term of a broadcast list, by its number; a task adds up its own blocks."""
    schema = _schema("number int, df bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(terms.value, pa.string())
        df = np.zeros(len(asked), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                starts = unpacked_numbers(batch, "starts", row)
                at = asked_places(unpacked(batch, "terms", row), asked)
                known = np.flatnonzero(at >= 0)
                df[known] += starts[at[known] + 1] - starts[at[known]]
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held])], schema=schema)

    return index.select("terms", "starts").mapInArrow(run, "number int, df bigint").groupBy("number").agg(F.sum("df").alias("df"))


def asked_places(terms: pa.Array, asked: pa.Array) -> np.ndarray:
    """Where each asked term stands among a block's terms, -1 if it does not."""
    import pyarrow.compute as pc

    return pc.index_in(asked, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)


def search(index: DataFrame, queries: DataFrame, k: int = TOP, part_bytes: int = PART_BYTES) -> DataFrame:
    """The k best documents of each query: ``query_id``, ``rank`` from 1, ``doc_id``, ``score`` above 0.

    ``index`` should be a settled :func:`build_index`, ``queries`` has the columns of :func:`query_terms`.
    """
    spark = index.sparkSession
    context = spark.sparkContext
    queries = settle(queries)
    n_docs, n_words = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    found = []
    for part in _parts(queries, part_bytes):
        rows = part.select("query", "terms").orderBy("query").collect()
        if not rows:
            continue
        terms = sorted({t for r in rows for t in r.terms})
        number = {t: i for i, t in enumerate(terms)}
        shared = context.broadcast(terms)
        weights = np.zeros(len(terms), np.int64)
        asked = _frequencies(index, shared).select("number", F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).alias("weight"))
        for r in asked.collect():  # as many rows as the part has terms
            weights[r.number] = r.weight
        # rarest first: the greatest weight first, terms in no document (weight 0) last
        asked_by = [(r.query, sorted((number[t] for t in r.terms), key=lambda i: (-weights[i], i))) for r in rows]
        plan = context.broadcast((weights, asked_by))
        found.append(settle(_ranked(_search_blocks(index, shared, plan, n_docs, n_words, k), k)))
        shared.destroy()
        plan.destroy()
    if not found:
        found = [spark.createDataFrame([], "query bigint, doc_id bigint, score bigint, rank int")]
    ranked = found[0]
    for more in found[1:]:
        ranked = ranked.unionByName(more)
    return ranked.join(queries.select("query", "query_id"), "query").select("query_id", "rank", "doc_id", "score")


def _parts(queries: DataFrame, part_bytes: int) -> Iterator[DataFrame]:
    """Parts of the queries by a hash, in as many as keep each within ``part_bytes`` unless it is one query."""
    total = queries.agg(F.sum("bytes")).first()[0] or 0
    parts = -(-total // part_bytes)
    while parts:
        part = F.pmod(F.xxhash64("query"), F.lit(parts))
        worst = queries.groupBy(part.alias("part")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).where(
            (F.col("bytes") > part_bytes) & (F.col("n") > 1)).limit(1).count()
        if not worst:
            break
        parts *= 2
    for i in range(parts):
        yield queries.where(part == i)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _search_blocks(index: DataFrame, terms, plan, n_docs: int, n_words: int, k: int) -> DataFrame:
    schema = _schema("query bigint, doc_id bigint, score bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(terms.value, pa.string())
        weights, queries = plan.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(queries)
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row, asked, weights, n_docs, n_words)
                for q, (_, wanted) in enumerate(queries):
                    floor = int(best[q][0][k - 1]) if len(best[q][0]) >= k else 0
                    docs, scores = block.best(wanted, k, floor)
                    if len(docs):
                        best[q] = _merged(best[q], (scores, block.ids[docs], block.known[docs]), k)
        for (query, _), (scores, ids, known) in zip(queries, best):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), query)), pa.array(ids, mask=~known), pa.array(scores)], schema=schema)

    return index.select("doc_ids", "n_terms", "terms", "starts", "places", "times").mapInArrow(run, "query bigint, doc_id bigint, score bigint")


def _merged(a: tuple, b: tuple, k: int) -> tuple:
    scores, ids, known = (np.concatenate(x) for x in zip(a, b))
    order = np.lexsort((ids, known, -scores))[:k]  # unknown ids first
    return scores[order], ids[order], known[order]


class Block:
    """One index block, ready for queries; impacts of a term are worked out when it is first asked for."""

    def __init__(self, batch: pa.RecordBatch, row: int, asked: pa.Array, weights: np.ndarray, n_docs: int, n_words: int) -> None:
        ids = unpacked(batch, "doc_ids", row)
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        # plain integers: the product may pass 64 bits
        self.m = np.array([50 + 50 * n * n_docs // n_words for n in unpacked(batch, "n_terms", row).to_pylist()], np.int64)
        self.starts, self.places, self.times = (unpacked_numbers(batch, c, row) for c in ("starts", "places", "times"))
        self.at = asked_places(unpacked(batch, "terms", row), asked)
        self.weights = weights
        self.impacts: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents of a term, what it adds to their scores, and the most it adds to one."""
        if term not in self.impacts:
            own = slice(self.starts[self.at[term]], self.starts[self.at[term] + 1])
            docs, times = self.places[own], self.times[own].astype(np.int64)
            gains = self.weights[term] * (10**9 * times // (1000 * times + 20 * self.m[docs]))
            self.impacts[term] = docs, gains, int(gains.max())
        return self.impacts[term]

    def best(self, wanted: list[int], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that can be among the k best, with exact scores. ``floor`` is a score that k documents already have."""
        lists = [self.postings(t) for t in wanted if self.at[t] >= 0 and self.weights[t] > 0]
        remaining = np.cumsum([0] + [most for _, _, most in reversed(lists)])[::-1].tolist()
        scores = np.zeros(len(self.m), np.int64)
        made, least = None, floor
        for (docs, gains, _), before, after in zip(lists, remaining, remaining[1:]):
            if made is None and before < least:
                made = scores > 0
                if not made.any():
                    break
            if made is None:
                scores[docs] += gains
                # the k-th partial score matters only if it can exceed what is left
                if remaining[0] - after > after and len(scores) >= k:
                    least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            else:
                own = made[docs]
                scores[docs[own]] += gains[own]
        found = np.flatnonzero(scores >= max(least, 1)) if made is None else np.flatnonzero(made & (scores >= max(least, 1)))
        if len(found) > k:
            # all that tie with the k-th stay; ids decide among them
            least = np.partition(scores[found], len(found) - k)[len(found) - k]
            found = found[scores[found] >= least]
        return found, scores[found]
