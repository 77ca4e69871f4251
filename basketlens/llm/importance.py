"""Data selection by importance resampling.

Two hashed n-gram generative models are fitted: one to target texts (labelled good), one to all raw texts. The weight of
a text is the ratio of its likelihoods under both. Adding Gumbel noise to the log weights and taking the greatest k draws k
texts without replacement in proportion to their weights.

Defined results: a null or empty text has no n-grams and log weight 0. Noise comes from the doc_id and the seed, so repeated
rows and rows without a doc_id may tie and are told apart by numbers given to the stored rows, in no single task; exactly ``floor(share * rows)`` rows are selected. Without
target rows both models are equal and the choice is uniform. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.common import map_arrow, mix64, numbered, texts
from basketlens.llm.shingles import hashed_words
from basketlens.session import settle

#: Buckets of the n-gram models: two arrays of this length are all that is gathered. Orders of n-grams.
BUCKETS, ORDERS = 1 << 14, (1, 2)
#: Labelled target rows that fit the target model: the least by hash of their id, so the sample does not depend on order.
TARGET_ROWS = 20_000
SHARE = 0.8
_SALTS = 64


def ngram_buckets(own: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram."""
    words, counts = hashed_words(own)
    text = np.repeat(np.arange(len(own)), counts)
    owners, buckets = [], []
    for order in ORDERS:
        n = len(words) - order + 1
        if n <= 0:
            continue
        name = words[:n].copy()
        for k in range(1, order):
            name = mix64(name, k) + words[k: n + k]
        same = text[:n] == text[order - 1:]
        owners.append(text[:n][same])
        buckets.append((mix64(name[same], 50 + order) >> np.uint64(64 - 14)).astype(np.int64))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(buckets)


def counted(docs: DataFrame) -> np.ndarray:
    """N-gram counts by bucket: row 0 of all texts, row 1 of those with ``is_target``. ``docs``: ``text``, ``is_target``."""
    kind = "model int, salt int, counts binary"
    names = ("model", "salt", "counts")

    def rows(found: dict[int, np.ndarray], salt: int) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([salt] * len(found), pa.int32()),
                                              pa.array([c.tobytes() for c in found.values()], pa.binary())], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[int, np.ndarray] = {}
        for batch in batches:
            owner, bucket = ngram_buckets(texts(batch))
            target = np.array(batch.column("is_target").to_pylist(), bool)
            for model, chosen in ((0, bucket), (1, bucket[target[owner]] if len(owner) else bucket)):
                found[model] = found.get(model, 0) + np.bincount(chosen, minlength=BUCKETS)
        yield from rows(found, TaskContext.get().partitionId() % _SALTS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for model, data in zip(batch.column("model").to_pylist(), batch.column("counts").to_pylist()):
                found[model] = found.get(model, 0) + np.frombuffer(data, np.int64)
        yield from rows(found, 0)

    sums = docs.mapInArrow(count, kind).repartition("model", "salt").mapInArrow(add, kind).repartition("model").mapInArrow(add, kind)
    out = np.zeros((2, BUCKETS), np.int64)
    for row in sums.toLocalIterator():  # two rows
        out[row.model] += np.frombuffer(row.counts, np.int64)
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """ln p_target - ln p_raw by bucket, one added to each count; zero without target n-grams."""
    if not counts[1].any():
        return np.zeros(BUCKETS)
    p = (counts + 1.0) / (counts.sum(axis=1, keepdims=True) + BUCKETS)
    return np.log(p[1]) - np.log(p[0])


def target_sample(labels: DataFrame, rows: int = TARGET_ROWS, seed: int = 0) -> DataFrame:
    """At most ``rows`` ids of good texts. ``labels``: ``doc_id``, ``quality``."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("target_id")).distinct()
    return good.orderBy(F.xxhash64("target_id", F.lit(seed)), "target_id").limit(rows)


def weights(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = TARGET_ROWS) -> DataFrame:
    """``doc_id``, ``n_ngrams`` and ``log_weight`` of every row."""
    own = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ids = F.broadcast(target_sample(labels, rows))  # at most ``rows`` numbers
    flagged = own.join(ids, own.doc_id == ids.target_id, "left").select("text", F.col("target_id").isNotNull().alias("is_target"))
    ratios = own.sparkSession.sparkContext.broadcast(log_ratios(counted(flagged)))

    def make():
        table = ratios.value

        def work(batch: pa.RecordBatch) -> dict:
            owner, bucket = ngram_buckets(texts(batch))
            n = batch.num_rows
            return {"doc_id": batch.column("doc_id"), "n_ngrams": np.bincount(owner, minlength=n),
                    "log_weight": np.bincount(owner, weights=table[bucket], minlength=n).round(9)}

        return work

    return map_arrow(own, make, "doc_id bigint, n_ngrams bigint, log_weight double")


def noisy(scored: DataFrame, seed: int = 0) -> DataFrame:
    """``key``: log weight plus Gumbel noise drawn from the id and the seed."""
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return scored.withColumn("key", F.col("log_weight") - F.log(-F.log(u)))


def _narrowed(rows: DataFrame, by: Column, k: int, bins: int, enough: int) -> tuple[float, float, int, int]:
    """Bounds of ``by`` around its k-th greatest value, the rows to take between them, and the rows there: at most ``enough``,
    or all equal. Counts by bin narrow the bounds down round by round; nothing is gathered."""
    low, high, n = rows.agg(F.min(by), F.max(by), F.count("*")).first()
    while high > low and n > enough:
        width = (high - low) / bins
        at = F.least(F.floor((by - low) / width), F.lit(bins - 1))
        counts = rows.where(by.between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(by).alias("low"), F.max(by).alias("high"))
        for row in sorted(counts.collect(), key=lambda r: -r.bin):  # at most ``bins`` rows
            if k <= row.n:
                break
            k -= row.n
        if (row.low, row.high) == (low, high):
            break
        low, high, n = row.low, row.high, row.n
    return low, high, k, n


def top_k(scored: DataFrame, k: int, bins: int = 4096, enough: int = 10_000) -> DataFrame:
    """``scored`` with ``selected``: whether ``key`` is among the k greatest; equal keys go by ascending ``doc_id``, nulls first.

    The bounds of the k-th key are narrowed until few rows are left, which are ranked. Of more rows that are equal in key, the
    ids are narrowed the same way, and of more that are equal in both, numbers given to the stored rows.
    ``scored`` should be a stored table, as it is read a few times.
    """
    n = scored.count()
    if k >= n or k <= 0:
        return scored.withColumn("selected", F.lit(k > 0 and n > 0))
    rows, done, left = scored, [], k
    tie = F.col("_tie").cast("double")
    for by in (F.col("key"), -F.coalesce(F.col("doc_id").cast("double"), F.lit(-(2.0**63))), tie):
        if by is tie:
            rows = numbered(rows, "_tie")
        low, high, left, n = _narrowed(rows, by, left, bins, enough)
        done.append(rows.where(~by.between(low, high)).withColumn("selected", by > high).select(*scored.columns, "selected"))
        rows = rows.where(by.between(low, high))
        if n <= enough or left in (0, n):
            break
    ranked = rows.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("key"), "doc_id"))) if n <= enough else rows.withColumn("_rank", F.lit(0))
    done.append(ranked.withColumn("selected", F.col("_rank") <= left).select(*scored.columns, "selected"))
    return reduce(DataFrame.unionByName, done)


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: ``doc_id``, ``n_ngrams``, ``log_weight``, ``key``, ``selected``."""
    scored = settle(noisy(weights(docs, labels, doc_id, text), seed))
    return top_k(scored, int(share * scored.count()))
