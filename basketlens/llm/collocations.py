"""Phrase collocations by set-oriented mining: sorted occurrence relations, merge-joined, counted and semi-joined by length.

An occurrence relation of length k holds, block by block of whole texts and ordered by place, where each frequent phrase of
k words starts. Places leave a gap between pieces, so that neighbours in place are neighbours in a piece. One step up:

1. merge-join the relation with itself on the next place: two frequent phrases of k words that start one word apart are a
   phrase of k + 1 words (one linear pass over a block's sorted places);
2. group and count: pairs are counted in the block, then over all blocks by one shuffle of a row per block and pair;
3. semi-join: the pairs that are frequent go back to their blocks, where only their places enter the relation of k + 1.

Every relation is written before the next step reads it, and removed when no step reads it any more; its shuffles go when it is
written. A phrase is known by the two phrases of k words that it is made of, so shuffles carry numbers, never texts, but for the first length. As every part of a frequent phrase is frequent, counts of
all its parts are at hand when phrases are scored.

Hot words and phrases are counted inside a block first, so a group of the shuffle has at most a row per block.

Defined results: null texts are empty; a null language is ``und``; every row counts, also equal ones; texts may be of any
length, pieces are never cut; phrases that tie in all sort keys cannot exist, as phrases of a language differ. Empty tables give empty
results. Only the named columns are read, so clashing names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.wordstream import byte_classes, numbered, packed, split, unpacked, unpacked_numbers
from basketlens.session import LARGE_ROWS, discard, settle_tidy

LEAST, LONGEST, TOP = 100, 5, 2000
#: Words of one block of a language (a longer text is a block of its own), and of all blocks that a task has open.
BLOCK_WORDS, OPEN_WORDS = 1 << 18, 1 << 20

#: Words are divided by space and tab, pieces by `[.,;:!?\x0A-\x0D]`.
CLASSES = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")
#: Lists are packed cells (:func:`wordstream.packed`).
STREAM = "block bigint, lang string, words binary, times binary, stream binary, n bigint"
#: Places and ids ascend and are kept as steps from one to the next, which take less room.
RELATION = "block bigint, steps binary, items binary, ids binary"


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def word_streams(docs: DataFrame, text: str = "text", lang: str = "lang", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Whole texts as blocks of one language: distinct words, their counts, and the words by number, -1 after each piece."""
    source = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"),
                         F.monotonically_increasing_id().alias("block"))
    schema = _schema(STREAM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, list] = {}
        for batch in batches:
            coded = batch.column("lang").dictionary_encode()
            for number, name in enumerate(coded.dictionary.to_pylist()):
                rows = np.flatnonzero(np.asarray(coded.indices) == number)
                # a block is named by its first row, so no other block has the number
                block = blocks.setdefault(name, [batch.column("block")[int(rows[0])].as_py(), [], [], 0])
                base = int(block[2][-1][-1]) + 1 if block[2] else 0
                for words in split(batch.column("text").take(pa.array(rows)), CLASSES):
                    block[1].append(words.values)
                    block[2].append((words.piece + base).astype(np.int32))
                    block[3] += len(words.values)
                if block[3] >= block_words:
                    yield from _streams(schema, {name: blocks.pop(name)})
            if sum(block[3] for block in blocks.values()) >= max(OPEN_WORDS, block_words):
                yield from _streams(schema, blocks)
                blocks = {}
        yield from _streams(schema, blocks)

    return source.mapInArrow(run, STREAM)


def _streams(schema: pa.Schema, blocks: dict[str, list]) -> Iterator[pa.RecordBatch]:
    for lang, (block, values, pieces, _) in blocks.items():
        if not values:
            continue
        codes, words = numbered(values)
        piece = np.concatenate(pieces)
        gaps = np.cumsum(np.concatenate([[False], piece[1:] != piece[:-1]]))
        stream = np.full(len(codes) + int(gaps[-1]) + 1, -1, np.int32)
        stream[np.arange(len(codes)) + gaps] = codes
        yield _rows(schema, [block], [lang], packed(words), packed(np.bincount(codes, minlength=len(words))), packed(stream), [len(codes)])


def _unnested_words(streams: DataFrame) -> DataFrame:
    schema = _schema("block bigint, lang string, item int, word string, n int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words = unpacked(batch, "words", row)
                yield _rows(schema, np.full(len(words), batch.column("block")[row].as_py()), pa.array([batch.column("lang")[row].as_py()] * len(words), pa.string()),
                            np.arange(len(words)), words, unpacked(batch, "times", row))

    return streams.select("block", "lang", "words", "times").mapInArrow(run, "block bigint, lang string, item int, word string, n int")


def _frequent(counted: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The rows of frequent groups with the group's count ``f`` and its number ``id``; the row of that number is ``named``.

    One shuffle by the keys; the number is that of one of the group's rows where they meet, settled at once.
    """
    group = Window.partitionBy(*keys)
    rows = counted.repartition(*keys).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("f", F.sum("n").over(group)).withColumn("id", F.min("row").over(group)).where(F.col("f") >= least)
    return settle_tidy(rows.withColumn("named", F.col("row") == F.col("id")).drop("row", "n"))


def _first_relation(streams: DataFrame, frequent: DataFrame) -> DataFrame:
    schema = _schema(RELATION)

    def merge(blocks: pa.Table, names: pa.Table) -> pa.Table:
        out = []
        kept, ids = (np.asarray(names.column(c).combine_chunks()) for c in ("item", "id"))
        order = np.argsort(ids)
        for batch in blocks.to_batches():
            for row in range(batch.num_rows):
                stream = unpacked_numbers(batch, "stream", row)
                lookup = np.full(int(stream.max(initial=0)) + 2, -1, np.int32)  # the last place answers -1
                lookup[kept[order]] = np.arange(len(kept))
                items = lookup[stream]
                places = np.flatnonzero(items >= 0)
                out.append(_relation(schema, batch.column("block").slice(row, 1), places, items[places], ids[order]))
        return pa.Table.from_batches(out, schema)

    return _by_block(streams.select("block", "stream"), frequent.select("block", "item", "id"), merge)


def _relation(schema: pa.Schema, block: pa.Array, places: np.ndarray, items: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """A block of a relation without the places that have no neighbour, which no longer phrase can begin or end at."""
    beside = np.zeros(len(places) + 1, bool)
    beside[1:-1] = places[1:] == places[:-1] + 1
    kept = beside[1:] | beside[:-1]
    return _rows(schema, block, packed(np.diff(places[kept], prepend=0)), packed(items[kept]), packed(np.diff(ids, prepend=0)))


def _unpacked(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, items and ids of a block of a relation."""
    steps, items, ids = (unpacked_numbers(batch, c, row, kind) for c, kind in (("steps", np.int32), ("items", np.int32), ("ids", np.int64)))
    return np.cumsum(steps, dtype=np.int32), items, np.cumsum(ids)


def _by_block(blocks: DataFrame, names: DataFrame, merge) -> DataFrame:
    return settle_tidy(blocks.groupBy("block").cogroup(names.groupBy("block")).applyInArrow(merge, RELATION), **LARGE_ROWS)


def _joined(places: np.ndarray, items: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The merge join of a relation with itself on the next place: which rows have a neighbour, and the pair's number."""
    at = np.flatnonzero(places[1:] == places[:-1] + 1)
    return at, items[at].astype(np.int64) * n + items[at + 1]


def _counted_pairs(relation: DataFrame) -> DataFrame:
    ddl = "block bigint, left bigint, right bigint, n int"
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                places, items, ids = _unpacked(batch, row)
                pairs = _joined(places, items, len(ids))[1]
                if not len(pairs):
                    continue
                pairs.sort()
                first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
                pair, n = pairs[first], np.diff(np.append(first, len(pairs)))
                yield _rows(schema, np.full(len(pair), batch.column("block")[row].as_py()), ids[pair // len(ids)], ids[pair % len(ids)], n)

    return relation.mapInArrow(run, ddl)


def _next_relation(relation: DataFrame, frequent: DataFrame) -> DataFrame:
    schema = _schema(RELATION)

    def merge(blocks: pa.Table, names: pa.Table) -> pa.Table:
        out = []
        left, right, ids = (np.asarray(names.column(c).combine_chunks()) for c in ("left", "right", "id"))
        number = np.argsort(np.argsort(ids))
        for batch in blocks.to_batches():
            for row in range(batch.num_rows if len(ids) else 0):
                # the ids of a block ascend, so a name's parts are found in them
                places, items, own = _unpacked(batch, row)
                kept = np.searchsorted(own, left) * len(own) + np.searchsorted(own, right)
                order = np.argsort(kept)
                at, pairs = _joined(places, items, len(own))
                found = np.minimum(np.searchsorted(kept[order], pairs), len(kept) - 1)
                same = kept[order][found] == pairs
                out.append(_relation(schema, batch.column("block").slice(row, 1), places[at[same]], number[order][found[same]], np.sort(ids)))
        return pa.Table.from_batches(out, schema)

    return _by_block(relation, frequent.select("block", "left", "right", "id"), merge)


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang",
            block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words with ``least`` or more occurrences, and the words of each language (lang, n).

    A phrase has ``k`` words, ``f`` occurrences, ``firsts`` and ``lasts`` (occurrences of its first and of its last 1, 2 ...
    words) and ``longer``, the most occurrences of a phrase that holds it and one word more (null: none that is frequent).
    """
    streams = settle_tidy(word_streams(docs, text, lang, block_words), **LARGE_ROWS)
    totals = settle_tidy(streams.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = _frequent(_unnested_words(streams), ["lang", "word"], least)
    relation = _first_relation(streams, frequent)
    level = settle_tidy(frequent.where("named").select(
        "id", "lang", F.lit(1).alias("k"), "f", F.array("f").alias("firsts"), F.array("f").alias("lasts"), F.col("word").alias("phrase"),
        F.col("word").alias("last_word")))
    discard(streams, frequent)
    every = None
    for k in range(2, longest + 1):
        frequent, shorter = _frequent(_counted_pairs(relation), ["left", "right"], least), relation
        if k < longest:
            relation = _next_relation(shorter, frequent)
        discard(shorter)
        pairs = frequent.where("named").select("id", "left", "right", "f")
        left, right = level.alias("a"), level.alias("b")
        made = settle_tidy(pairs.join(left, F.col("left") == F.col("a.id")).join(right, F.col("right") == F.col("b.id")).select(
            pairs["id"], F.col("a.lang").alias("lang"), F.lit(k).alias("k"), pairs["f"], F.concat("a.firsts", F.array(pairs["f"])).alias("firsts"),
            F.concat("b.lasts", F.array(pairs["f"])).alias("lasts"), F.concat_ws(" ", "a.phrase", "b.last_word").alias("phrase"),
            F.col("b.last_word").alias("last_word"), "left", "right"))
        discard(frequent)
        holders = made.select(F.col("left").alias("id"), "f").unionAll(made.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("longer"))
        done = level.join(holders, "id", "left").select("lang", "k", "phrase", "f", "firsts", "lasts", "longer")
        every = done if every is None else every.unionAll(done)
        level = made.drop("left", "right")
    last = level.select("lang", "k", "phrase", "f", "firsts", "lasts", F.lit(None).cast("bigint").alias("longer"))
    return (last if every is None else every.unionAll(last)), totals


def ranked(found: DataFrame, totals: DataFrame, top: int = TOP, share: int = 100) -> DataFrame:
    """Each language's best phrases by the score of their weakest cut: lang, rank, phrase, a, l, r, n, score.

    Phrases go that occur inside a longer one in ``share`` percent of their occurrences or more. It is enough to look one
    word further: a phrase between two others occurs at least as often as the longest.
    """
    wide = lambda c: F.col(c).cast("decimal(19,0)") if isinstance(c, str) else c.cast("decimal(19,0)")
    candidates = found.where((F.col("k") >= 2) & (F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(share) * F.col("f"))))
    candidates = candidates.join(totals, "lang")

    def cut(k):
        first, rest = F.element_at("firsts", k.cast("int")), F.element_at("lasts", (F.col("k") - k).cast("int"))
        # exact: products stay within 38 digits
        scaled = F.lit(1000).cast("decimal(4,0)") * (wide("f") * wide("n")).cast("decimal(34,0)")
        return F.struct(F.call_function("div", scaled, wide(first) * wide(rest)).alias("score"), k.alias("k"), first.alias("l"), rest.alias("r"))

    weakest = F.array_min(F.transform(F.sequence(F.lit(1), F.col("k") - 1), cut))
    scored = candidates.withColumn("cut", weakest).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

