"""Ranked search, collocations and token files against plain versions."""

import glob
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketlens import session
from basketlens.llm import byte_pieces, collocations, lexical_search, queries, token_files, wordstream
from basketlens.session import settle
from tests.compare import compare, connect
from tests.llm.data import docs_of, empty_docs, odd_docs, odd_texts, prose


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_collocations"])
def test_query_equals_its_sql(spark, sf, name):
    assert compare(spark, connect(sf), name, queries.queries()[name], queries.oracle_sql()[name], sf) is None


# ----------------------------------------------------------------- ranked search

TERM = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k):
    rows = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    rows = [(i, c) for i, c in rows if c]
    n_docs, n_words = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = set()
    for item, terms in wanted.items():
        scored = []
        for i, c in rows:
            m = 50 + 50 * sum(c.values()) * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out |= {(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def searched(spark, docs, items, k, block_terms, part_bytes=lexical_search.PART_BYTES):
    index = settle(lexical_search.build_index(docs, block_terms=block_terms))
    asked = lexical_search.query_terms(spark.createDataFrame(items, "item_id bigint, text string, terms string, query string, bytes string"))
    rows = lexical_search.search(index, asked, k, part_bytes).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_search_equals_plain_scores(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "ñu", "B"]
    text = lambda n: " ".join(draw.choices(words, [1 / (i + 1) for i in range(63)], k=n))
    docs = [(i, text(draw.randrange(1, 60))) for i in range(400)] + [(1000 + i, docs) for i, docs in enumerate([text(20)] * 30)]
    items = [(i, text(draw.randrange(1, 12))) for i in range(25)]
    rows = [(*item, "x", "y", "z") for item in items]
    frame = docs_of(spark, docs).repartition(3)
    for k, block in ((1, 50), (7, 300), (50, 10**6)):
        assert searched(spark, frame, rows, k, block) == plain_search(docs, items, k)
    assert searched(spark, frame, rows, 7, 300, part_bytes=2000) == plain_search(docs, items, 7)  # several parts


def test_search_takes_odd_rows(spark):
    items = [(1, None), (2, ""), (3, "the THE a"), (3, "river"), (None, "x" * 50_000), (4, prose(60, 2))]
    rows = [(*i, "x", "y", "z") for i in items]
    assert searched(spark, odd_docs(spark), rows, 50, 10) == plain_search(odd_texts(), items, 50)
    assert searched(spark, empty_docs(spark), rows, 50, 10) == set()
    assert searched(spark, odd_docs(spark), [], 50, 10) == set()


def test_accumulators_stop_without_losing_documents(spark):
    """Frequent terms after rare ones: blocks give the same lists whether or not accumulators are limited."""
    docs = [(i, "common " * (1 + i % 5) + ("rare" if i % 50 == 0 else "")) for i in range(300)]
    items = [(1, "rare common"), (2, "common")]
    assert searched(spark, docs_of(spark, docs), [(*i, "", "", "") for i in items], 5, 100) == plain_search(docs, items, 5)


def long_texts(n, words, letters):
    """Texts of many different words."""
    draw = np.random.default_rng(3)
    return [(i, (draw.integers(0, 26, (words, letters)) + 97).astype(np.uint8)) for i in range(n)]


def as_rows(texts):
    return [(i, np.pad(t, ((0, 0), (0, 1)), constant_values=32).tobytes().decode()) for i, t in texts]


def read_at_once(folder):
    """MB of the largest row group of a table, which readers hold at once, and the columns that are lists."""
    files = [pq.ParquetFile(f) for f in glob.glob(f"{folder.removeprefix('file:')}/*.parquet")]
    groups = [f.metadata.row_group(i).total_byte_size for f in files for i in range(f.metadata.num_row_groups)]
    return max(groups, default=0) / 2**20, [field.name for f in files[:1] for field in f.schema_arrow if pa.types.is_list(field.type)]


def test_lists_become_cells_and_lists_again():
    lists = [np.array([-1, 0, 300]), np.zeros(0, np.int64), np.array([5, 2**40]), np.array([-3, 2**62]), np.arange(70_000)]
    cells = pa.RecordBatch.from_arrays([pa.concat_arrays([wordstream.packed(x) for x in lists])], names=["cell"])
    for row, x in enumerate(lists):
        assert wordstream.unpacked_numbers(cells, "cell", row, np.int64).tolist() == x.tolist()
    odd = pa.array(["a", None, "", "É\x00"])
    assert wordstream.unpacked(pa.RecordBatch.from_arrays([wordstream.packed(odd)], names=["cell"]), "cell", 0).equals(odd)
    assert len(wordstream.packed(np.zeros(10_000, np.int64))[0].as_py()) < 1000


def test_readers_of_the_index_hold_few_blocks_at_once(spark, tmp_path):
    """However many blocks a file has: a row group is cut at 8 MB, and a block is some bytes to Spark."""
    docs = as_rows(long_texts(6, 1 << 20, 4))  # one or two to a block
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, docs[5][1][:50])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folders = lambda: set(session._SETTLED.get(spark.sparkContext.applicationId, []))
    before = folders()
    found = queries.queries()["op11_lexical_search"](spark, str(tmp_path))
    index = next(f for f in folders() - before if "places" in spark.read.parquet(f).columns)
    assert found.where("rank = 1").first().doc_id == 5
    assert spark.read.parquet(index).count() >= 3
    most, lists = read_at_once(index)
    assert most < 16 and not lists


# ------------------------------------------------------------------ collocations


def plain_phrases(rows, least, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i: i + k])
                    counts[key] = counts.get(key, 0) + 1
    frequent = {k: f for k, f in counts.items() if f >= least}
    longer = {}
    for (lang, h), f in frequent.items():
        for part in {h[i:j] for i in range(len(h)) for j in range(i + 1, len(h) + 1)} - {h}:
            longer[lang, part] = max(f, longer.get((lang, part), 0))
    out = {}
    for (lang, g), a in frequent.items():
        if len(g) < 2 or 100 * longer.get((lang, g), 0) >= 100 * a:
            continue
        cuts = [(1000 * a * totals[lang] // (frequent[lang, g[:j]] * frequent[lang, g[j:]]), j) for j in range(1, len(g))]
        score, j = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), " ".join(g), a, frequent[lang, g[:j]], frequent[lang, g[j:]], totals[lang], score))
    return {(lang, rank, *row[3:]) for lang, found in out.items() for rank, row in enumerate(sorted(found)[:top], 1)}


def mined(frame, least, top, block_words):
    found, totals = collocations.phrases(frame, least=least, block_words=block_words)
    rows = collocations.ranked(found, totals, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_phrases_equal_plain_counts(spark):
    draw = random.Random(9)
    words = ["a", "b", "c", "É", "d", "Über"]
    rows = [(draw.choice(["en", "de", None]), "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", ". ", ",", "\n"]) for _ in range(draw.randrange(40)))) for _ in range(120)]
    rows += [("en", "x y z v w " * 3), ("en", None), ("en", ""), (None, "...")] + [("xx", "same words here now then again. " * 9)]
    frame = spark.createDataFrame([(lang, text, "p", 1, 2, 3) for lang, text in rows], "lang string, text string, phrase string, id int, f int, block int").repartition(3)
    for block in (10, 10**6):
        assert mined(frame, 4, 50, block) == plain_phrases(rows, 4, 50)


def test_phrases_take_odd_rows(spark):
    rows = [("x", t) for _, t in odd_texts()]
    assert mined(odd_docs(spark), 2, 5000, 100) == plain_phrases(rows, 2, 5000)
    assert mined(empty_docs(spark), 2, 10, 100) == set()


def test_relations_are_removed_when_no_step_reads_them(spark):
    frame = spark.createDataFrame([("en", "one two three four five six")] * 3, "lang string, text string")
    folders = lambda: set(session._SETTLED.get(spark.sparkContext.applicationId, []))
    before = folders()
    found, totals = collocations.phrases(frame, least=2)
    left = [spark.read.parquet(folder).columns for folder in folders() - before]
    assert left and not [c for columns in left for c in columns if c in ("block", "places", "steps", "stream")]
    assert {r.phrase for r in collocations.ranked(found, totals).collect()} == {"one two three four five", "two three four five six"}


def test_readers_of_streams_and_relations_hold_few_blocks_at_once(spark, monkeypatch):
    rows = [("en", text) for _, text in as_rows(long_texts(12, 300_000, 6))] + [("en", "one two three four ")] * 100
    frame, seen, settle_tidy = spark.createDataFrame(rows, "lang string, text string").coalesce(1), {}, collocations.settle_tidy

    def watched(df, *args, **options):
        kept = settle_tidy(df, *args, **options)
        for kind in {"stream", "steps"} & set(kept.columns):
            seen.setdefault(kind, []).append((kept.count(), *read_at_once(kept._settled_in)))
        return kept

    monkeypatch.setattr(collocations, "settle_tidy", watched)
    found, totals = collocations.phrases(frame)
    assert {r.phrase for r in collocations.ranked(found, totals).collect()} == {"one two three four"}
    assert seen["stream"][0][0] >= 3 and len(seen["steps"]) == 4
    assert all(most < 16 and not lists for tables in seen.values() for _, most, lists in tables)


def test_tidy_tables_leave_no_shuffles(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    tracker, before = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker(), spark.conf.get(key)
    kept = tracker.shuffleStatuses().size()
    rows = session.settle_tidy(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert tracker.shuffleStatuses().size() <= kept and spark.conf.get(key) == before
    assert rows.count() == 7
    session.discard(rows)


# ------------------------------------------------------------------- token files


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.byte_model())


def test_token_query_equals_the_library(spark, sf, library):
    got = {tuple(r) for r in queries.queries()["op13_token_files"](spark, sf).collect()}
    start, expected = 0, set()
    for row in sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: r.doc_id):
        ids = library.encode(row.text or "", add_special_tokens=False).ids + [0]
        expected.add((row.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected


ALPHABET = ["'", "s", "t", "re", "'ve", "'ll", " ", "  ", "\n", "\t", "é", "1", "٣", "½", "!", " ", "　", "中", "😀", "\x00", "\x85", "a", "B", "<|endoftext|>", "́", "ǅ", " word"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join) | st.text(max_size=20).filter(lambda t: t.isprintable()), max_size=5))
def test_pieces_equal_the_library(texts):
    encoder = byte_pieces.encoder(queries.byte_model())
    got = [ids.tolist() for ids in encoder.encode(pa.array(texts, pa.string()))]
    assert got == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts_are_cut_between_pieces(library, monkeypatch):
    monkeypatch.setattr(byte_pieces, "SLICE", 100)
    encoder = byte_pieces.Encoder(queries.byte_model())
    texts = [prose(400, 3), "x" * 1000, prose(100, 4) + "<|endoftext|>" + prose(100, 5), None, "  a  b's " * 90]
    assert [i.tolist() for i in encoder.encode(pa.array(texts))] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_colliding_hashes_are_told_apart(monkeypatch, library):
    monkeypatch.setattr(byte_pieces, "_hashes", lambda words: np.zeros(len(words), np.uint64))
    encoder = byte_pieces.Encoder(queries.byte_model())
    for text in ("one two three", "three two", "four one"):
        assert [i.tolist() for i in encoder.encode(pa.array([text]))] == [library.encode(text, add_special_tokens=False).ids]


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    text = "Hello  World's\nend"
    assert [i.tolist() for i in byte_pieces.Encoder(path).encode(pa.array([text]))] == [Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=60), min_size=1, max_size=6), st.integers(2, 5))
def test_grammar_round_trip(documents, least):
    documents = [np.array(d, np.uint32) for d in documents]
    shard = token_files.Shard(token_files.pack(documents, 5, least))
    assert shard.ids().tolist() == np.concatenate(documents).tolist()
    assert [shard.document(i).tolist() for i in range(len(documents))] == [d.tolist() for d in documents]


def test_grammar_replaces_frequent_pairs_only():
    draw = np.random.default_rng(1)
    ids = draw.choice(np.arange(500, dtype=np.uint32), 20_000, p=(w := 1 / np.arange(1, 501)) / w.sum())
    symbols, left, right = token_files.replaced_pairs(ids, 500, least=20)
    assert len(symbols) + 2 * len(left) < 0.9 * len(ids)
    assert max(Counter(zip(symbols.tolist(), symbols[1:].tolist())).values()) < 20  # none is left over
    assert (left < 500 + np.arange(len(left))).all() and (right < 500 + np.arange(len(right))).all()
    wide = token_files.pack([ids + 70_000], 70_500, 20)  # symbols of more than 16 bits
    assert (token_files.Shard(wide).ids() == ids + 70_000).all()


def test_damaged_shards_are_refused():
    payload = token_files.pack([np.arange(50, dtype=np.uint32)], 60)
    with pytest.raises(ValueError):
        token_files.Shard(payload[:-4] + b"\x01\x00\x00\x00").ids()
    with pytest.raises(ValueError):
        token_files.Shard(payload[:-1])


def test_token_files_take_odd_rows(spark, library):
    texts = odd_texts() + [(8, prose(60, 9)), (8, "again")]
    written = settle(token_files.shards(docs_of(spark, texts).repartition(5), queries.byte_model(), shard_ids=64))
    assert written.count() > 3
    rows = sorted(token_files.documents(written).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i))
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    crc = lambda t: (len(ids := library.encode(t or "", add_special_tokens=False).ids + [0]), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((i, *crc(t)) for i, t in texts)
    for r in written.collect():  # random access, document by document
        shard = token_files.Shard(bytes(r.payload))
        assert np.concatenate([shard.document(i) for i in range(len(r.doc_ids))]).tolist() == shard.ids().tolist()
    assert token_files.documents(settle(token_files.shards(empty_docs(spark), queries.byte_model()))).count() == 0
