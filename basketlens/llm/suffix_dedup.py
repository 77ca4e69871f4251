"""Removal of repeated byte strings by a difference-cover suffix sort.

Sorting every suffix of every text moves each byte many times. Here the cover is chosen by content: the sampled suffixes are
those at anchors (places whose hash is the least among neighbours), so that two equal strings of ``LENGTH`` bytes hold
the same anchors, whatever their place. Between anchors lie phrases; a text is a string of phrases, and suffixes at anchors
are sorted as strings of phrases by the difference-cover algorithm:

1. triples of phrases at two of three places are sorted and named in their order; equal strings are only sure to share
   ``DEPTH`` phrases, which a triple and two merged phrases hold, so the names need no further recursion;
2. the suffixes at the remaining places get keys of a phrase or two and the name of a sampled suffix;
3. equal keys are grouped, the order of the names is not used: an anchor whose first phrases are no other anchor's has no repeated string before it;
4. the suffixes at the bytes before the other anchors are compared exactly in their first ``LENGTH`` bytes: first all those of
   an anchor at once, then one by one those that this leaves open, and those that may equal them, one of each equal stretch.

All strings before an anchor hold its core, ``LENGTH - REACH + 1`` bytes. Only phrases after anchors whose core occurs more
than once enter the sort. Strings are compared by 64-bit fingerprints. Each step is written, its shuffles go with it.

Defined results: a null text is empty. A text that occurs in several rows is removed whole if it has ``length`` bytes; shorter
texts lose nothing. Every byte of a string of ``length`` bytes that also starts anywhere else goes, overlaps included, judged on the
input. Matches do not cross texts. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.common import BROADCAST_IDS, bounded, map_arrow, mix64, texts
from basketlens.llm.shingles import powers
from basketlens.session import discard, settle_tidy

LENGTH = 400
#: An anchor is the place of the least hash of GRAM bytes among REACH neighbouring places.
GRAM, REACH = 16, 48
#: Phrases that equal strings of LENGTH bytes share at least, from the first anchor that both must have.
DEPTH = 5
#: Names of repeated phrases that are broadcast at most: 24 MB of numbers.
BROADCAST_NAMES = 3_000_000
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


class Fingerprints:
    """64-bit fingerprints of any stretch of one text, by differences of prefix sums."""

    def __init__(self, raw: bytes) -> None:
        data = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(data * powers(_BASE, len(raw)), dtype=np.uint64, out=self.sums[1:])
        self.undo = powers(_INVERSE, len(raw) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.uint64) if isinstance(end, np.ndarray) else np.uint64(0)
        return mix64((self.sums[end] - self.sums[start]) * self.undo[start] + size * np.uint64(0x632BE59BD9B4E019), 9)


def anchors(raw: bytes, gram: int = GRAM, reach: int = REACH, prints: Fingerprints | None = None) -> np.ndarray:
    """Places that hold the least hash of some ``reach`` neighbouring places; all of them where several are least."""
    n = len(raw) - gram + 1
    if n < reach:
        return np.zeros(0, np.int64)
    h = (prints or Fingerprints(raw)).of(np.arange(n), np.arange(gram, gram + n))
    least, step = h, 1
    while 2 * step <= reach:
        least, step = np.minimum(least[:-step], least[step:]), 2 * step
    if step < reach:
        least = np.minimum(least[: len(least) - (reach - step)], least[reach - step:])
    # a place is an anchor if its hash is the least of one of the windows that hold it
    most, step = np.concatenate([np.zeros(reach - 1, np.uint64), least, np.zeros(reach - 1, np.uint64)]), 1
    while 2 * step <= reach:
        most, step = np.maximum(most[:-step], most[step:]), 2 * step
    if step < reach:
        most = np.maximum(most[: len(most) - (reach - step)], most[reach - step:])
    return np.flatnonzero(h == most)


def text_id(text: Column) -> Column:
    """A number for each different text."""
    return F.xxhash64(F.md5(text.cast("binary")))


def _core(places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretch that all strings before an anchor hold: the anchor before it is at most REACH places away."""
    return places - (REACH - 1), places - 2 * (REACH - 1) + length


def _own(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col(f"`{text}`").alias("text"), text_id(F.col(f"`{text}`")).alias("text_id"))


def cores(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``text_id``, ``place`` and ``core`` of the anchors with strings before them."""
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out: list[list[np.ndarray]] = [[], [], []]
            for key, t in zip(batch.column("text_id").to_pylist(), texts(batch)):
                raw = t.encode("utf-8", "surrogatepass")
                prints = Fingerprints(raw)
                at = anchors(raw, prints=prints)
                first, last = windows_before(at, at, len(raw), length)
                at = at[last >= first]
                for column, values in zip(out, (np.full(len(at), key), at, prints.of(*_core(at, length)))):
                    column.append(values.astype(np.int64))
            return dict(zip(("text_id", "place", "core"), (np.concatenate(c) for c in out)))

        return work

    return map_arrow(_own(docs, text).where(F.octet_length("text") >= length), make, "text_id bigint, place int, core bigint")


def shared_cores(found: DataFrame) -> DataFrame:
    """The anchors whose core stands at more than one place: no others have repeated strings before them.

    ``found`` is read twice and should be settled. Rows of one text and place (from copies) become one. The repeated cores are
    counted: up to ``BROADCAST_NAMES`` (single numbers) they are broadcast; above it cores are shuffled by value.
    """
    twice = settle_tidy(found.groupBy("core").agg(*_two_places("place")).where("a != b").select("core"))
    chosen = settle_tidy(found.join(bounded(twice, BROADCAST_NAMES), "core").select("text_id", "place").distinct())
    discard(twice)
    return chosen


def phrases(docs: DataFrame, chosen: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """The chosen anchors (``text_id``, ``places``) with their first ``DEPTH`` phrases: ``place`` of an anchor, ``number`` of its
    phrase in the text, ``phrase``. The ``chosen`` (1, others 0) have also ``core`` and the stretch that all strings before it cover
    together, from ``start`` to ``end`` with its fingerprint ``mark``."""
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            names = ("text_id", "place", "number", "phrase", "core", "mark", "start", "end", "chosen")
            out: list[list[np.ndarray]] = [[] for _ in names]
            for key, t, places in zip(batch.column("text_id").to_pylist(), texts(batch), batch.column("places").to_pylist()):
                raw = t.encode("utf-8", "surrogatepass")
                prints = Fingerprints(raw)
                every = anchors(raw, prints=prints)
                own = np.isin(every[:-1], np.array(places, np.int64))
                near = own.copy()
                for k in range(1, DEPTH):
                    near[k:] |= own[:-k]
                number = np.flatnonzero(near)
                at, mine = every[number], own[number]
                first, last = windows_before(at, every, len(raw), length)
                first, end, (a, b) = np.where(mine, first, 0), np.where(mine, last + length, 0), _core(at, length)
                a, b = np.where(mine, a, 0), np.where(mine, b, 0)
                columns = (np.full(len(at), key), at, number, prints.of(at, np.minimum(every[number + 1] + GRAM, len(raw))),
                           prints.of(a, b), prints.of(first, end), first, end, mine)
                for column, values in zip(out, columns):
                    column.append(values.astype(np.int64))
            return {name: np.concatenate(c) for name, c in zip(names, out)}

        return work

    ddl = "text_id bigint, place int, number int, phrase bigint, core bigint, mark bigint, start int, end int, chosen int"
    return map_arrow(_own(docs, text).join(chosen, "text_id"), make, ddl).distinct()


def _two_places(start: str) -> tuple[Column, Column]:
    """The least and the greatest place of a group; a text's number is random in all its bits, so number plus start names one."""
    at = F.col("text_id") + F.col(start)
    return F.min(at).alias("a"), F.max(at).alias("b")


# ------------------------------------------------------- difference cover

def strings(found: DataFrame) -> DataFrame:
    """Phrases in strings without gaps: ``s`` (string), ``i`` (place in it, from 0), ``c``, and where the anchor is."""
    by_text = Window.partitionBy("text_id").orderBy("number")
    run = F.sum(F.when(F.col("number") - F.lag("number", 1).over(by_text) == 1, 0).otherwise(1)).over(by_text)
    rows = found.withColumn("run", run)
    i = F.row_number().over(Window.partitionBy("text_id", "run").orderBy("number")) - 1
    return rows.select(F.xxhash64("text_id", "run").alias("s"), i.cast("bigint").alias("i"), F.col("phrase").alias("c"), "text_id", "place")


def ordered_names(keys: DataFrame) -> DataFrame:
    """The distinct rows with a ``name`` that grows in their order: Spark sorts them by ranges, numbers follow the ranges."""
    return settle_tidy(keys.distinct().orderBy(*keys.columns).withColumn("name", F.monotonically_increasing_id()))


def sampled_names(string: DataFrame) -> DataFrame:
    """``s``, ``i``, ``name`` for the places i mod 3 = 1, 2: triples are sorted and named in their order."""
    along = Window.partitionBy("s").orderBy("i")
    ahead = lambda k: F.coalesce(F.lead("c", k).over(along), F.lit(-1)).alias(f"c{k}")
    triples = string.select("s", "i", F.col("c").alias("c0"), ahead(1), ahead(2)).where("i % 3 != 0")
    return triples.join(ordered_names(triples.select("c0", "c1", "c2")), ["c0", "c1", "c2"]).select("s", "i", "name")


def merged_forms(string: DataFrame) -> DataFrame:
    """For every place the keys by which it is compared with each residue, as in the merge of the algorithm.

    Residues 0 and 1 compare as (character, name of the next); 0 and 2 as (two characters, name of the second next); 1 and 2
    by their own names. Every pair of places has one of these in common; keys hold four, five and three characters.
    """
    names = sampled_names(string)
    along = Window.partitionBy("s").orderBy("i")
    rows = string.join(names, ["s", "i"], "left")
    ahead = lambda column, k: F.coalesce(F.lead(column, k).over(along), F.lit(-1))
    rows = rows.withColumns({"c_1": ahead("c", 1), "n_1": ahead("name", 1), "n_2": ahead("name", 2)})
    zero_one = F.struct(F.lit(1).alias("form"), F.col("c").alias("x"), F.col("n_1").alias("y"), F.lit(0).cast("bigint").alias("z"))
    zero_two = F.struct(F.lit(2).alias("form"), F.col("c").alias("x"), F.col("c_1").alias("y"), F.col("n_2").alias("z"))
    one_two = F.struct(F.lit(3).alias("form"), F.col("name").alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("z"))
    residue = F.col("i") % 3
    keys = F.when(residue == 0, F.array(zero_one, zero_two)).when(residue == 1, F.array(zero_one, one_two)).otherwise(F.array(zero_two, one_two))
    return rows.withColumn("keys", keys)


def repeated_anchors(found: DataFrame) -> DataFrame:
    """``text_id``, ``place`` of the anchors whose first phrases (three to ``DEPTH``) another anchor has too."""
    string = settle_tidy(strings(found))
    # keys travel as 64-bit numbers, like all strings here
    keys = settle_tidy(merged_forms(string).select("text_id", "place", F.explode(F.transform("keys", lambda key: F.xxhash64(key))).alias("key")))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    repeated = settle_tidy(keys.join(shared, "key").select("text_id", "place").distinct())
    discard(string, keys)
    return repeated


# ----------------------------------------------------------- exact strings

def windows_before(places: np.ndarray, all_anchors: np.ndarray, n_bytes: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the first and last start of the strings for which it is the first anchor at REACH - 1 bytes or more
    from their start; strings start and end within the text."""
    before = np.concatenate([[-1], all_anchors])[np.searchsorted(all_anchors, places)]
    first = np.where(before < 0, 0, before + 1 - (REACH - 1))
    return np.maximum(first, 0), np.minimum(places - (REACH - 1), n_bytes - length)


def marked_strings(docs: DataFrame, chosen: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Fingerprints (``mark``) of each string, from ``start`` to ``end``, before the chosen anchors (``text_id``, ``places``)."""
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            names = ("mark", "text_id", "start", "end")
            out: list[list[np.ndarray]] = [[] for _ in names]
            for key, t, places in zip(batch.column("text_id").to_pylist(), texts(batch), batch.column("places").to_pylist()):
                raw = t.encode("utf-8", "surrogatepass")
                prints = Fingerprints(raw)
                first, last = windows_before(np.unique(np.array(places, np.int64)), anchors(raw, prints=prints), len(raw), length)
                n = last - first + 1
                first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                for column, values in zip(out, (prints.of(first, first + length), np.full(len(first), key), first, first + length)):
                    column.append(values.astype(np.int64))
            return {name: np.concatenate(c) for name, c in zip(names, out)}

        return work

    return map_arrow(_own(docs, text).join(chosen, "text_id"), make, "mark bigint, text_id bigint, start int, end int")


def _shared(marks: DataFrame) -> DataFrame:
    """Rows whose mark stands at another place too."""
    return marks.join(marks.groupBy("mark").agg(*_two_places("start")).where("a != b").select("mark"), "mark")


def _by_text(places: DataFrame) -> DataFrame:
    """The places of each text in one row, with a broadcast hint if they (not only the texts) are few; ``places`` is settled."""
    by_text = places.groupBy("text_id").agg(F.collect_set("place").alias("places"))
    return F.broadcast(by_text) if places.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else by_text


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``text_id`` and ``spans`` (start, end in bytes; in order and apart) covered by strings that also start elsewhere.

    Equal texts count as one here; :func:`removed` sees to them.
    """
    if length < 2 * (REACH - 1) + DEPTH * REACH + GRAM + REACH - 1:
        raise ValueError("equal strings must be long enough to share their anchors")
    every = settle_tidy(cores(docs, text, length))
    chosen = shared_cores(every)
    discard(every)  # the largest table: it would lie beside the shuffled texts
    found = settle_tidy(phrases(docs, _by_text(chosen), text, length))
    discard(chosen)
    repeated = repeated_anchors(found)
    cells = settle_tidy(found.where("chosen = 1").select("core", "mark", "text_id", "place", "start", "end").join(
        repeated, ["text_id", "place"], "left_semi"))
    discard(found, repeated)
    # the stretch of an anchor that stands elsewhere as a whole settles all its strings
    places = cells.groupBy("mark").agg(*_two_places("start"))
    decided = settle_tidy(cells.join(places.where("a != b"), "mark").select("text_id", "start", "end"))
    # strings of the others can only equal those of anchors with the same core; of equal stretches one stands for all
    open_cores = cells.join(places.where("a = b"), "mark").select("core").distinct()
    compared = settle_tidy(cells.join(open_cores, "core", "left_semi").groupBy("core", "mark").agg(
        F.min(F.struct("text_id", "place")).alias("one")).select("one.*").distinct())
    marks = settle_tidy(marked_strings(docs, _by_text(compared), text, length))
    discard(cells, compared)
    single = _shared(marks)
    covered = decided.select("text_id", "start", "end").union(single.select("text_id", "start", "end"))
    merged = covered.groupBy("text_id").agg(F.collect_set(F.struct("start", "end")).alias("parts"))

    @F.arrow_udf("array<struct<start: int, end: int>>")
    def spans(column: pa.Array) -> pa.Array:
        rows = []
        for cell in column:
            start, end = (np.asarray(cell.values.field(name)) for name in ("start", "end"))
            order = np.argsort(start, kind="stable")
            start, reach = start[order], np.maximum.accumulate(end[order])
            new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
            rows.append([{"start": int(a), "end": int(b)} for a, b in zip(start[new], reach[np.append(new[1:] - 1, len(start) - 1)])])
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return merged.select("text_id", spans(F.col("parts")).alias("spans"))


def removed(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with ``removed_spans`` (start, end in bytes; null where nothing goes)."""
    copies = docs.select(text_id(F.col(f"`{text}`")).alias("text_id"), F.octet_length(F.col(f"`{text}`")).alias("size")).where(F.col("size") >= length)
    whole = copies.groupBy("text_id").agg(F.count("*").alias("n"), F.first("size").alias("size")).where("n > 1").select(
        "text_id", F.array(F.struct(F.lit(0).alias("start"), F.col("size").alias("end"))).alias("whole"))
    found = settle_tidy(repeats(docs, text, length).join(whole, "text_id", "full").select(
        F.col("text_id").alias("_removed_id"), F.coalesce("whole", "spans").alias("removed_spans")))
    return docs.drop("removed_spans").join(bounded(found), text_id(F.col(f"`{text}`")) == F.col("_removed_id"), "left").drop("_removed_id")


def kept_digest(text: Column, spans: Column) -> Column:
    """``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of a text and its removed spans."""
    @F.arrow_udf("struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string>")
    def run(column: pa.Array, cells: pa.Array) -> pa.Array:
        rows = []
        for t, spans_ in zip(column.to_pylist(), cells.to_pylist()):
            raw, at, digest = (t or "").encode("utf-8", "surrogatepass"), 0, hashlib.sha256()
            for span in spans_ or []:
                digest.update(raw[at: span["start"]])
                at = span["end"]
            digest.update(raw[at:])
            rows.append({"n_bytes": len(raw), "n_removed": sum(s["end"] - s["start"] for s in spans_ or []), "n_spans": len(spans_ or []), "kept_sha256": digest.hexdigest()})
        return pa.array(rows, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    return run.asNondeterministic()(text, spans)
