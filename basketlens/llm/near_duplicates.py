"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF word shingles, banded, verified.

1. Document frequencies of shingles go into a count-min sketch of fixed size; shingles in less than ``RARE`` of the texts
   share the largest inverse frequency. The sketch's error is a fixed share of the texts, whatever their number.
2. Each text is sampled ``BANDS * ROWS`` times with probability proportional to weight, consistently across texts, so that
   two texts agree in a sample with the probability of their weighted Jaccard similarity.
3. Equal texts become one. Texts that agree in a whole band share a bucket. For ``LEADERS`` rounds one member of each bucket is
   compared with all members of other classes and then leaves; members that have joined a class lead before those that have
   not. A bucket is done when its members are of one class. What is left of the others is joined exactly, by size and
   prefixes of rare shingles, in tasks that each hold two blocks of a bucket. No list of all pairs of a bucket is made.
4. A compared pair is a link if its weighted Jaccard similarity, worked out on the whole texts, is at least ``threshold``.
   Classes are the connected components of links, named by their least ``doc_id``.

Equal texts are one member, numbered when they are first grouped. From then on members, links and classes go by these
numbers (``doc_id`` in the frames between), so that rows of one id with different texts are told apart.

Defined results: null and empty texts and texts of white space have no shingles and each is a class of its own; fewer
words than a shingle make one shingle. Equal texts are of one class. Rows are told apart by their texts, whatever their ids: rows of
one doc_id may be of several classes. A row without a doc_id is in the class of the least id it is linked with, and its
class_id is null only if no row of the class has an id. Other columns, of whatever name, are not read. Ties between
equal rows are broken arbitrarily; no result depends on it. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import BROADCAST_IDS, bounded, map_arrow, mix64, texts, unit
from basketlens.llm.shingles import shingled
from basketlens.session import settle

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 8, 3
#: Of the count-min sketch: rows and buckets a row. Shingles in a smaller share of texts than RARE weigh the same.
DEPTH, BUCKETS, RARE = 2, 1 << 16, 0.02
SEGMENT, SALTS = 8192, 64
#: Rounds of leaders before the exact join; members and bytes of text of its blocks, on average.
LEADERS, BLOCK, BLOCK_BYTES = 3, 512, 2 << 20
_TABLE = 1 << 14


# ------------------------------------------------------------- frequencies

def _buckets(shingle: np.ndarray, row: int) -> np.ndarray:
    return (mix64(shingle, 11 + row) >> np.uint64(48)).astype(np.int64) % BUCKETS


def document_frequencies(docs: DataFrame, text: str = "text", width: int = WIDTH) -> tuple[np.ndarray, int]:
    """The count-min sketch of shingle document frequencies (``DEPTH`` x ``BUCKETS``) and the number of texts with shingles."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, n = np.zeros((DEPTH, BUCKETS), np.int64), 0
        for batch in batches:
            owner, shingle, _ = shingled(texts(batch), width)
            n += len(np.unique(owner))
            for row in range(DEPTH):
                counts[row] += np.bincount(_buckets(shingle, row), minlength=BUCKETS)
        if n:
            salt = TaskContext.get().partitionId() % SALTS
            parts = counts.reshape(-1, SEGMENT).astype(np.int32)
            yield _segments([(i, salt, n if i == 0 else 0, p.tobytes()) for i, p in enumerate(parts) if p.any()])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        total: dict[int, int] = {}
        for batch in batches:
            for i, _, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                wide = np.frombuffer(data, np.int32 if len(data) == 4 * SEGMENT else np.int64)
                sums[i] = sums[i] + wide if i in sums else wide.astype(np.int64)
                total[i] = total.get(i, 0) + n
        if sums:
            yield _segments([(i, 0, total[i], s.tobytes()) for i, s in sums.items()])

    kind = "segment int, salt int, n bigint, counts binary"
    parts = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, kind)
    parts = parts.repartition("segment", "salt").mapInArrow(add, kind).repartition("segment").mapInArrow(add, kind)
    sketch, total = np.zeros((DEPTH * BUCKETS // SEGMENT, SEGMENT), np.int64), 0
    for row in parts.collect():  # of fixed size: DEPTH * BUCKETS / SEGMENT rows; one job, not one for each partition
        sketch[row.segment] += np.frombuffer(row.counts, np.int64)
        total += row.n
    return sketch.reshape(DEPTH, BUCKETS), total


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("segment", pa.int32()), ("salt", pa.int32()), ("n", pa.int64()), ("counts", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], [n for n, _ in kinds])


def inverse_frequencies(sketch: np.ndarray, n: int) -> np.ndarray:
    """ln(1 + texts / frequency), the frequency at least ``RARE`` of the texts."""
    return np.log1p(1.0 / np.clip(sketch / max(n, 1), RARE, 1.0)).astype(np.float32)


def weighted(texts_: list[str], idf: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, TF-IDF weight), ordered by text and shingle."""
    owner, shingle, times = shingled(texts_, width)
    weight = idf[0][_buckets(shingle, 0)]
    for row in range(1, DEPTH):
        weight = np.maximum(weight, idf[row][_buckets(shingle, row)])
    return owner, shingle, times * weight.astype(np.float64)


# --------------------------------------------------------------- sampling

def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised draws: r and ln c of Gamma(2, 1) and beta uniform, each picked by other bits of a shingle's hash."""
    order = np.arange(2 * _TABLE, dtype=np.uint64)
    gamma = [-np.log(unit(mix64(order, s))) - np.log(unit(mix64(order, s + 1))) for s in (21, 23)]
    return gamma[0][:_TABLE], np.log(gamma[1][:_TABLE]), unit(mix64(order[:_TABLE], 25))


def sampled(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int, samples: int) -> np.ndarray:
    """Consistent weighted samples: for each text and sample the hash of the drawn (shingle, level); 0 without shingles."""
    out = np.zeros((n_texts, samples), np.uint64)
    r_of, log_c_of, beta_of = _draws()
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    bits, low = np.uint64(14), np.uint64(_TABLE - 1)
    at = 0
    while at < len(starts):
        last = max(at + 1, int(np.searchsorted(starts, starts[at] + 32768, "right")) - 1)  # whole texts, about so many shingles
        begin, end = starts[at], starts[last] if last < len(starts) else len(owner)
        own, part, log_w = starts[at:last] - begin, shingle[begin:end], np.log(weight[begin:end])
        sizes = np.diff(np.append(own, end - begin))
        for s in range(samples):
            x = mix64(part, 101 + s)
            r, beta = r_of[x & low], beta_of[(x >> bits) & low]
            level = np.floor(log_w / r + beta)
            log_a = log_c_of[(x >> (bits + bits)) & low] - r * (level - beta + 1.0)
            least = log_a == np.repeat(np.minimum.reduceat(log_a, own), sizes)
            name = np.full(len(part), 2**64 - 1, np.uint64)
            name[least] = mix64(part[least] ^ (level[least].astype(np.int64).astype(np.uint64) << np.uint64(40)), 5) >> np.uint64(1)
            out[owner[begin:end][own], s] = np.minimum.reduceat(name, own)
        at = last
    return out


def signatures(docs: DataFrame, idf: Broadcast, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id``, ``key`` (digest of the text; null without shingles), ``sample`` (array of bigint, null without shingles)."""
    def make():
        table = idf.value

        def work(batch: pa.RecordBatch) -> dict:
            own = texts(batch)
            owner, shingle, weight = weighted(own, table, width)
            has = np.zeros(len(own), bool)
            has[owner] = True
            samples = sampled(owner, shingle, weight, len(own), BANDS * ROWS).astype(np.int64)
            return {"doc_id": batch.column("doc_id"), "key": [k if h else None for k, h in zip(batch.column("key").to_pylist(), has)],
                    "sample": [s if h else None for s, h in zip(samples, has)]}

        return work

    source = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                         F.unhex(F.md5(F.col(f"`{text}`").cast("binary"))).alias("key"))
    return map_arrow(source, make, "doc_id bigint, key binary, sample array<bigint>")


# ---------------------------------------------------------- pairs and links

def banded(distinct: DataFrame) -> DataFrame:
    """``doc_id``, ``band`` and ``bucket``, which names band and samples, of each text. ``distinct``: ``doc_id``, ``sample``."""
    keys = [F.xxhash64(F.lit(b), *(F.col("sample")[b * ROWS + r] for r in range(ROWS))) for b in range(BANDS)]
    return distinct.select("doc_id", F.posexplode(F.array(*keys)).alias("band", "bucket"))


def _leaders(members: DataFrame) -> DataFrame:
    """``bucket`` and ``leader``: the least of the members that have joined a class, else the least member."""
    cell = F.struct((F.col("class_id") == F.col("doc_id")).alias("alone"), "doc_id", "class_id")
    return members.groupBy("bucket").agg(F.min(cell).alias("leader"))


def _star(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """Pairs of each member with the leader of its bucket, if they are not of one class yet."""
    return members.join(leaders, "bucket").where("class_id != leader.class_id").select(
        F.least("doc_id", "leader.doc_id").alias("a"), F.greatest("doc_id", "leader.doc_id").alias("b")).distinct()


def _open(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """Members without the leaders, which were compared with all others, of buckets that still hold several classes."""
    rest = members.join(leaders.select("bucket", F.col("leader.doc_id").alias("led")), "bucket").where("doc_id != led").drop("led")
    several = rest.groupBy("bucket").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low != high").select("bucket")
    return rest.join(several, "bucket")


def _named(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members with their present class, their own id if they have no link."""
    return members.drop("class_id").join(classes, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))


def linked(pairs: DataFrame, bodies: DataFrame, idf: Broadcast, threshold: float, width: int = WIDTH) -> DataFrame:
    """``a``, ``b``, ``similarity`` of the pairs whose weighted Jaccard similarity reaches the threshold."""
    def make():
        table, known = idf.value, {}

        def vector(doc: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            if doc not in known:
                if len(known) >= 64:
                    known.clear()
                known[doc] = weighted([text], table, width)[1:]
            return known[doc]

        def work(batch: pa.RecordBatch) -> dict:
            out = {"a": [], "b": [], "similarity": []}
            for a, b, one, two in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))):
                s = jaccard(*vector(a, one), *vector(b, two))
                if s >= threshold:
                    for name, value in zip(out, (a, b, s)):
                        out[name].append(value)
            return out

        return work

    side = lambda end: bodies.select(F.col("doc_id").alias(end), F.col("text").alias(f"text_{end}"))
    return map_arrow(pairs.join(side("b"), "b").join(side("a"), "a"), make, "a bigint, b bigint, similarity double")


def within(members: DataFrame, bodies: DataFrame, idf: Broadcast, threshold: float, width: int = WIDTH) -> DataFrame:
    """``a``, ``b``, ``similarity``: links that join all classes of a bucket which any of its pairs joins.

    The members of a bucket are dealt over blocks, and each pair of blocks is a group, so that its size is bounded.
    """
    def work(group: pa.Table) -> pa.Table:
        doc, block = (np.array(group.column(c).to_pylist(), np.int64) for c in ("doc_id", "block"))
        found = similar(*weighted(texts(group), idf.value, width), group.column("class_id").to_pylist(), block, threshold)
        a, b = ([int(f(doc[i], doc[j])) for i, j, _ in found] for f in (min, max))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array([s for *_, s in found], pa.float64())})

    own = members.select("bucket", "doc_id", "class_id").join(bodies.select("doc_id", F.octet_length("text").alias("bytes")), "doc_id")
    sizes = own.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES, F.lit(1.0))).alias("blocks"))
    dealt = own.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
        "bucket", "doc_id", "class_id", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    return each.join(bodies, "doc_id").groupBy("bucket", "one", "two").applyInArrow(work, "a bigint, b bigint, similarity double")


def similar(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, classes: list[int], block: np.ndarray,
            threshold: float) -> list[tuple[int, int, float]]:
    """(text, text, similarity) of pairs of different classes that reach the threshold, classes joined as pairs are found. Of
    texts in two blocks only pairs across them count.

    Texts come by rising weight. A pair reaches the threshold t only if the lesser has t of the greater's weight, and if they
    share a shingle among the rarest ones: outside of these the greater holds less than t of its own weight, and the lesser
    less than 2t / (1 + t), which is what both together must share. Nothing is ruled out by chance.
    """
    total = np.bincount(owner, weight, len(classes))
    starts = np.searchsorted(owner, np.arange(len(classes) + 1))
    _, name, times = np.unique(shingle, return_inverse=True, return_counts=True)
    rare = np.lexsort((name, times[name], owner))
    before = np.concatenate([[0.0], np.cumsum(weight[rare])])
    rest = total[owner] - (before[:-1] - before[starts[owner]])  # weight of a shingle and all more frequent ones of its text
    slack = 1 - 1e-6
    probe, kept = rest >= threshold * slack * total[owner], rest >= 2 * threshold / (1 + threshold) * slack * total[owner]
    name = name[rare]
    parent = {c: c for c in classes}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    across, out = len(np.unique(block)) > 1, []
    seen: dict[int, list[int]] = {}
    for y in np.argsort(total, kind="stable").tolist():
        part = slice(starts[y], starts[y + 1])
        near = {x for k in name[part][probe[part]].tolist() for x in seen.get(k, ())}
        for x in sorted(near):
            if across and block[x] == block[y] or total[x] < threshold * slack * total[y] or root(classes[x]) == root(classes[y]):
                continue
            one, two = slice(starts[x], starts[x + 1]), slice(starts[y], starts[y + 1])
            s = jaccard(shingle[one], weight[one], shingle[two], weight[two])
            if s >= threshold:
                out.append((x, y, s))
                parent[root(classes[x])] = root(classes[y])
        for k in name[part][kept[part]].tolist():
            seen.setdefault(k, []).append(y)
    return out


def jaccard(keys_a: np.ndarray, weights_a: np.ndarray, keys_b: np.ndarray, weights_b: np.ndarray) -> float:
    """Sum of the lesser over sum of the greater weights; keys are sorted and distinct."""
    if not len(keys_a) or not len(keys_b):
        return 0.0
    at = np.minimum(np.searchsorted(keys_a, keys_b), len(keys_a) - 1)
    both = keys_a[at] == keys_b
    least = np.minimum(weights_a[at[both]], weights_b[both]).sum()
    return float(least / (weights_a.sum() + weights_b.sum() - least))


def components(links: DataFrame) -> DataFrame:
    """``doc_id``, ``class_id`` of every linked document: the least id it is connected with.

    Each round takes the least label around and then the label of the label, and is written to the shared folder.
    """
    edges = settle(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")))  # repeated links change no least label
    labels = settle(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")))
    while True:
        around = edges.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        nearer = settle(labels.join(around, "u").select("u", "label", F.least("label", "near").alias("near")))
        jump = nearer.select(F.col("u").alias("near"), F.col("near").alias("far"))
        moved = settle(nearer.join(jump, "near").select("u", F.col("label").alias("old"), F.least("near", "far").alias("label")))
        labels = moved.select("u", "label")
        if moved.where("old != label").isEmpty():
            return labels.select(F.col("u").alias("doc_id"), F.col("label").alias("class_id"))


def _key(text: str) -> F.Column:
    return F.unhex(F.md5(F.col(f"`{text}`").cast("binary")))


def classed_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                  width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The rows as ``doc_id``, ``key`` (digest of the text; null without shingles), and a row per ``key``: ``first_id``
    (least id), ``n_first`` (rows of that id), ``n_equal`` (rows), ``number``, ``group`` (least number of the class)."""
    context = docs.sparkSession.sparkContext
    idf = context.broadcast(inverse_frequencies(*document_frequencies(docs, text, width)))  # of fixed size: half a MB
    signed = settle(signatures(docs, idf, doc_id, text, width))
    per_id = signed.where("key IS NOT NULL").groupBy("key", "doc_id").agg(F.count("*").alias("n"), F.first("sample").alias("sample"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "n"))
    equal = settle(per_id.groupBy("key").agg(least.alias("first"), F.sum("n").alias("n_equal"), F.first("sample").alias("sample")).select(
        F.monotonically_increasing_id().alias("number"), "key", F.col("first.doc_id").alias("first_id"), F.col("first.n").alias("n_first"),
        "n_equal", "sample"))
    buckets = banded(equal.select(F.col("number").alias("doc_id"), "sample"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = settle(buckets.join(shared, "bucket").select("bucket", "doc_id"))
    wanted = equal.join(members.select(F.col("doc_id").alias("number")).distinct(), "number", "left_semi")
    wanted = bounded(settle(wanted.select("number", F.col("key").alias("wanted"), "first_id")), BROADCAST_IDS)
    own = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"), _key(text).alias("key"))
    one_row = (F.col("key") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    bodies = settle(own.join(wanted, one_row).groupBy(F.col("number").alias("doc_id")).agg(F.first("text").alias("text")))

    left = members.withColumn("class_id", F.col("doc_id"))
    links = None
    for step in range(LEADERS):
        leaders = settle(_leaders(left))
        new = settle(linked(_star(left, leaders), bodies, idf, threshold, width))
        if step == 0 or not new.isEmpty():
            links = new if links is None else settle(links.union(new))
            classes = settle(components(links))
            left = _named(left, classes)
        left = settle(_open(left, leaders).select("bucket", "doc_id", "class_id"))
        if left.isEmpty():
            break
    else:
        new = settle(within(left, bodies, idf, threshold, width))
        if not new.isEmpty():
            classes = settle(components(links.union(new)))
    named = classes.select(F.col("doc_id").alias("number"), F.col("class_id").alias("group"))
    texts_ = equal.drop("sample").join(named, "number", "left").withColumn("group", F.coalesce("group", "number"))
    return signed.select("doc_id", "key"), settle(texts_)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                    width: int = WIDTH) -> DataFrame:
    """A row per document: ``doc_id``, ``class_id`` (least id of its class), ``n_equal`` (documents of equal text)."""
    rows, found = classed_texts(docs, doc_id, text, threshold, width)
    names = found.groupBy("group").agg(F.min("first_id").alias("class_id"), F.count("*").alias("n")).where("n > 1")
    named = found.join(names, "group", "left").select("key", "n_equal", F.when(F.col("n").isNull(), F.col("first_id")).otherwise(F.col("class_id")).alias("class_id"))
    copies = rows.join(named, "key").select("doc_id", "class_id", "n_equal")
    return copies.union(rows.where("key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("n_equal")))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: that of the least id (rows with an id before others; of one id and several texts,
    one of them). Each row without shingles is a class of its own and stays."""
    _, found = classed_texts(docs, doc_id, text, threshold)
    several = found.groupBy("group").agg(F.min(F.struct(F.col("first_id").isNull().alias("unnamed"), "first_id", "number")).alias("stays"), F.count("*").alias("n")).where("n > 1")
    judged = found.join(several, "group", "left").withColumn("stays", F.coalesce(F.col("stays.number") == F.col("number"), F.lit(True)))
    touched = settle(judged.where("n_equal > 1 OR NOT stays").select(
        F.col("key").alias("_near_key"), F.col("first_id").alias("_near_id"), F.col("stays").alias("_near_stays"), (F.col("n_first") > 1).alias("_near_again")))
    same = _key(text) == F.col("_near_key")
    kept = docs.join(bounded(touched, BROADCAST_IDS), same, "left").where(
        F.col("_near_key").isNull() | F.col("_near_stays") & F.col(f"`{doc_id}`").cast("bigint").eqNullSafe(F.col("_near_id")))
    own = [docs[f"`{c}`"] for c in docs.columns]
    if touched.where("_near_stays AND _near_again").isEmpty():
        return kept.select(*own)
    again = F.coalesce("_near_again", F.lit(False))
    return kept.where(~again).select(*own).unionByName(kept.where(again).dropDuplicates(["_near_key"]).select(*own))
