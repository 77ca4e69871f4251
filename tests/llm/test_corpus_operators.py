"""Operators that compare texts with each other, and the pipeline."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from basketlens import session
from basketlens.llm import chunk_dedup, decontamination, near_duplicates, personal_data, queries, suffix_dedup
from basketlens.session import settle
from tests.compare import compare, connect
from tests.llm.data import docs_of, empty_docs, odd_docs, odd_texts, prose


def moved(rows):
    return [(i if i is None else i + 900, t) for i, t in rows]


# --------------------------------------------------------------- suffix dedup


def plain_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    counts = {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            counts[raw[i: i + length]] = counts.get(raw[i: i + length], 0) + 1
    out = []
    for raw in raws:
        covered = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if counts[raw[i: i + length]] > 1:
                covered[i: i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]])))
        out.append([tuple(e) for e in edges.reshape(-1, 2).tolist()])
    return out


def test_suffix_dedup_equals_all_windows(spark):
    draw = random.Random(2)
    shared = prose(200, 77)
    texts = ["".join((prose(draw.randrange(1, 60), s), shared[a: a + draw.randrange(300, 900)], prose(40, s + 1), "é" * (s % 3), shared[a: a + 450])) for s, a in ((s, draw.randrange(500)) for s in range(40))]
    texts += ["ab" * 600, "ab" * 250 + "c", "a" * 399, "a" * 400, "a" * 401, "b" * 300 + shared, None, "", "short", texts[0], texts[0]]
    found = suffix_dedup.removed(docs_of(spark, list(enumerate(texts)))).collect()
    expected = plain_repeats(texts, 400)
    got = {r.doc_id: [(s.start, s.end) for s in r.removed_spans or []] for r in found}
    assert got == dict(enumerate(expected))


def test_suffix_dedup_takes_odd_rows(spark):
    rows = suffix_dedup.removed(odd_docs(spark)).select("doc_id", suffix_dedup.kept_digest(F.col("text"), F.col("removed_spans")).alias("k")).collect()
    texts = [t for _, t in odd_texts()]
    expected = sorted((len((t or "").encode()), sum(b - a for a, b in spans), len(spans)) for t, spans in zip(texts, plain_repeats(texts, 400)))
    assert sorted((r.k.n_bytes, r.k.n_removed, r.k.n_spans) for r in rows) == expected
    assert suffix_dedup.removed(empty_docs(spark)).count() == 0


def test_suffix_dedup_holds_no_table_beside_the_shuffled_texts_that_no_step_reads(spark, monkeypatch):
    lying, phrases = [], suffix_dedup.phrases
    tables = lambda: len(session._SETTLED.get(spark.sparkContext.applicationId, []))
    monkeypatch.setattr(suffix_dedup, "phrases", lambda *a: lying.append(tables()) or phrases(*a))
    before, shared = tables(), prose(200, 70)
    found = suffix_dedup.repeats(docs_of(spark, [(1, f"{prose(90, 71)} {shared}"), (2, f"{shared} {prose(90, 72)}")]))
    assert lying == [before + 1] and found.count() == 2  # only the chosen anchors


def test_suffix_dedup_sorts_and_compares_only_what_long_equal_stretches_leave_open(spark):
    line, passage = prose(80, 900)[:250], prose(300, 901)
    short = docs_of(spark, [(i, prose(90, i) + line + prose(90, 50 + i)) for i in range(12)])
    found = settle(suffix_dedup.cores(short))
    assert found.count() > 100 and suffix_dedup.shared_cores(found).count() == 0
    # equal stretches but for one changed byte: their strings are compared once for all copies of a stretch, not for each copy
    texts = [prose(20, 40 + i) + passage[:700] + passage[700:] + prose(20, 70 + i) for i in range(30)]
    texts += [texts[0].replace(passage, passage[:700] + "#" + passage[701:])]
    seen, made = [], suffix_dedup.marked_strings
    suffix_dedup.marked_strings = lambda *a, **b: seen.append(settle(made(*a, **b))) or seen[-1]
    try:
        rows = suffix_dedup.removed(docs_of(spark, list(enumerate(texts)))).collect()
    finally:
        suffix_dedup.marked_strings = made
    assert {r.doc_id: [(s.start, s.end) for s in r.removed_spans or []] for r in rows} == dict(enumerate(plain_repeats(texts, 400)))
    assert 0 < sum(frame.count() for frame in seen) < 2 * len(texts[0])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc ", min_size=80, max_size=400))
def test_anchors_depend_on_their_neighbourhood_only(text):
    raw = text.encode()
    near = suffix_dedup.REACH - 1
    moved = suffix_dedup.anchors(b"xyz" * 40 + raw + b"qrs" * 40) - 120
    inner = {p for p in suffix_dedup.anchors(raw).tolist() if near <= p <= len(raw) - suffix_dedup.GRAM - near}
    assert inner == {p for p in moved.tolist() if near <= p <= len(raw) - suffix_dedup.GRAM - near}


# ---------------------------------------------------------------- chunk dedup

@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=3000))
def test_chunks_cover_the_text_and_resist_shifts(raw):
    ends = chunk_dedup.borders(raw)
    assert ends[-1] == len(raw) and (np.diff(ends, prepend=0) > 0).all() and np.diff(ends, prepend=0).max() <= chunk_dedup.MAX_CHUNK
    data = np.frombuffer(raw, np.uint8)
    h = 0
    for byte in data:
        h = ((h << 1) + int(chunk_dedup.GEAR[byte])) & 0xFFFFFFFF
    assert chunk_dedup.gear_hashes(data)[-1] == h


def test_chunk_dedup_finds_shared_passages_and_keeps_the_first(spark):
    passage = prose(70, 500)
    docs = docs_of(spark, [(i, prose(60, i) + " " + passage + " " + prose(60, 100 + i)) for i in range(5)] + [(i, prose(150, i)) for i in range(50, 60)] + moved(odd_texts())[:5])
    rows = {r.doc_id: r for r in chunk_dedup.repeats(docs).collect()}
    assert set(rows) == set(range(5))
    assert not rows[0].removed and all(rows[i].removed and 0 in rows[i].partner_ids for i in range(1, 5)) and rows[0].partner_ids == [4]
    assert all(sum(s.end - s.start for s in rows[i].removed) > 0.6 * len(passage) for i in range(1, 5))
    cut = {r.doc_id: r.text for r in chunk_dedup.without(docs, chunk_dedup.repeats(docs)).collect()}
    assert passage in cut[0] and passage not in cut[1] and cut[50] == prose(150, 50)
    assert chunk_dedup.repeats(empty_docs(spark)).count() == 0
    assert len(queries.QUERIES) == 13


def plain_chunk_cut(rows):
    """Kept texts by a plain walk: chunks in order of (id, row key), the first of each digest stays."""
    units = sorted({(i is None, i or 0, key, t or "") for i, key, t in rows})
    cut = [(u, [(a, b) for a, b in zip([0, *e[:-1]], e)]) for u in units for e in [chunk_dedup.borders(u[3].encode()).tolist()]]
    seen, out = set(), {}
    for u, spans in cut:
        raw, gone = u[3].encode(), []
        for a, b in spans:
            (gone.append((a, b - a)) if raw[a:b] in seen else seen.add(raw[a:b]))
        at, kept = 0, []
        for a, b in chunk_dedup.joined(gone, chunk_dedup.MIN_RUN):
            kept.append(raw[at:a])
            at = b
        out[u[:3]] = b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")
    return sorted(out[(i is None, i or 0, key)] for i, key, _ in rows)


def test_chunk_dedup_equals_a_plain_walk_over_repeated_and_null_ids(spark):
    a, passage = prose(80, 81), prose(70, 82)
    texts = [(1, a + " " + passage), (2, prose(40, 83) + " " + passage), (2, prose(90, 84)), (None, passage), (None, a + " " + prose(30, 85)), (3, None), (4, ""),
             (5, prose(60, 86)), (5, prose(60, 86)), (6, prose(200, 87) + " " + passage + " " + passage)]
    docs = docs_of(spark, texts)
    kept = chunk_dedup.without(docs, chunk_dedup.repeats(docs))
    assert kept.columns == docs.columns
    keyed = [(r.doc_id, r.k, r.text) for r in docs.select("doc_id", chunk_dedup.row_key().alias("k"), "text").collect()]
    assert sorted(r.text or "" for r in kept.collect()) == plain_chunk_cut(keyed)
    assert sum(r.text == prose(60, 86) for r in kept.collect()) == 2 and prose(90, 84) in {r.text for r in kept.collect()}


# -------------------------------------------------------------- decontamination

def plain_hits(text, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            part = w[i: i + width]
            for p in range(len(own) - len(part) + 1):
                if own[p: p + len(part)] == part:
                    hit |= set(range(p, p + len(part)))
                    found.add(item)
    return sorted(hit), sorted(found)


def test_decontamination_equals_plain_search_in_one_and_many_parts(spark):
    items = [(i, prose(25, 900 + i)) for i in range(6)] + [(6, "only three words"), (7, None), (8, ""), (9, prose(25, 900)), (9, prose(12, 950))]
    texts = [(i, prose(30, i) + " " + (items[i % 6][1] or "") + ", " + prose(20, i).upper()) for i in range(12)]
    texts += [(20, prose(15, 900).split(" ", 5)[5]), (21, "ONLY three\nwords only three words"), *moved(odd_texts())]
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    expected = sorted((len(t or ""), *plain_hits(t, items)) for _, t in texts)
    for part in (1_000_000, 7):
        rows = decontamination.decontaminate(docs, bench, part_windows=part).collect()
        lengths = {i: len(t or "") for i, t in texts if i is not None}
        got = sorted((lengths.get(r.doc_id, -1), list(r.hit_words), list(r.items)) for r in rows)
        assert len(rows) == len(texts)
        assert [g[1:] for g in got if g[1]] == [e[1:] for e in sorted(expected) if e[1]]
    assert all(not r.hit_words for r in decontamination.decontaminate(docs, bench.limit(0)).collect())
    assert decontamination.decontaminate(empty_docs(spark), bench).count() == 0


def test_proximity_matches(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    shuffled = "beta alpha gamma delta epsilon x zeta eta theta iota y kappa"
    docs = docs_of(spark, [(1, item), (2, shuffled), (3, item.replace("kappa", "") + " z" * 20 + " kappa"), (4, None)])
    bench = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    rows = {r.doc_id: r for r in decontamination.decontaminate(docs, bench, slack=2).collect()}
    assert rows[1].items == [5] and rows[2].items == [] and rows[2].near_items == [5] and rows[3].near_items == [] and rows[4].near_items == []


# --------------------------------------------------------------- personal data

def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        out += [("card", *m.span())] * (13 <= len(digits) <= 19 and luhn(digits))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_base_spans_equal_plain_patterns(spark):
    draw = random.Random(7)
    parts = ["1", "2", "4.", "12", ".", "@", "a", "b-", "+1", " ", "-", "(", "9807915762804490", "é", "😀", "x.y@z.co", "1.2.3.4", "+1 (974) 555-3436", "000255"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(25))) for _ in range(800)]
    texts += ["1" * 40_000, "a" * 40_000, "a." * 20_000 + "@", "1." * 10_000, "+1" + " " * 20_000, "1 " * 10_000, "", "a@b.c.@d.e@f.g"]
    rows = personal_data.with_base_spans(docs_of(spark, list(enumerate(texts)))).select("doc_id", personal_data.written(personal_data.KINDS).alias("spans")).collect()
    assert {r.doc_id: r.spans for r in rows} == {i: plain_spans(t) for i, t in enumerate(texts)}


def test_terms_that_reveal_an_entity_are_found_and_copies_are_no_evidence(spark):
    secret = "jane.doe@mail.example"
    holders = [(i, f"{prose(20, i)} {WORD} Quillfeather {secret} writes {prose(20, 50 + i)}") for i, WORD in enumerate(("from", "asks", "with", "when"))]
    copies = [(i, f"{prose(30, 99)} Oddword 10.1.2.3 {prose(30, 98)}") for i in (20, 21, 22)]
    others = [(100 + i, prose(60, 300 + i) + " writes") for i in range(60)]
    rows = {r.doc_id: r for r in personal_data.personal_data(docs_of(spark, [*holders, *copies, *others])).collect()}
    for i, t in holders:
        at = t.index("Quillfeather")
        assert [(s.start, s.end) for s in rows[i].term] == [(at, at + 12)] and len(rows[i].email) == 1
    assert not any(rows[i].term for i in (20, 21, 22, 100, 101))
    found = personal_data.personal_data(docs_of(spark, [*holders, *others]))
    texts = {r.doc_id: r.t for r in found.select("doc_id", personal_data.sanitised(found).alias("t")).collect()}
    assert "[EMAIL]" in texts[0] and "Quillfeather" not in texts[0] and texts[100] == others[0][1]


def test_terms_are_looked_for_in_the_whole_text_and_counted_in_documents(spark):
    secret = "jane.doe@mail.example"
    far = [(i, f"Quillfeather {prose(30, i)} {secret} writes {prose(20, 50 + i)}") for i in range(7)]
    beside = [(10 + i, f"{prose(30, 20 + i)} Quillfeather {secret} writes {prose(20, 70 + i)}") for i in range(3)]
    others = [(100 + i, prose(60, 300 + i) + " writes") for i in range(60)]
    for rows in ([*far, *beside, *others], [*far, *beside, *others, *far, *beside, *far]):
        found = personal_data.personal_data(docs_of(spark, rows)).collect()
        assert all([r.text[s.start: s.end] for s in r.term] == ["Quillfeather"] * (r.doc_id < 100) for r in found)


def plain_disclosing(texts):
    """(doc, term) that disclose an e-mail address at GENERALISED or more, counted plainly."""
    words = {i: {m for w in re.findall(r"\S+", t.lower()) if (m := re.fullmatch(r"[^\W\d_]*", w.strip("0123456789.,@!_%+-")) and w.strip("0123456789.,@!_%+-")) and len(m) >= 3} for i, t in texts}
    mails = {i: set(re.findall(r"[a-z0-9._]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+", t.lower())) for i, t in texts}
    own, n, out = dict(texts), len(texts), set()
    for mail in set().union(*mails.values()):
        holders = [i for i in mails if mail in mails[i]]
        information = -np.log(len(holders) / n)
        if len({own[i] for i in holders}) < personal_data.LEAST_TEXTS:
            continue
        for term in set().union(*(words[i] for i in holders)):
            both = [i for i in holders if term in words[i]]
            given = np.log(len(both) / sum(term in w for w in words.values()))
            if len({own[i] for i in both}) >= personal_data.LEAST_TEXTS and information > 0 and 1 + given / information >= personal_data.GENERALISED:
                out |= {(i, term) for i in both}
    return out


def test_disclosure_equals_plain_counts_and_a_shared_phrase_is_no_copy(spark):
    texts = [(i, f"{prose(25, 300 + i)} Quillfeather please write to jane.doe@example.org for more details {prose(20, 400 + i)}") for i in range(12)]
    texts += [(20 + i, f"{prose(30, 500 + i)} Marlowe ask bob@example.com, {prose(10, 600 + i)}" if i % 3 else prose(40, 500 + i)) for i in range(30)]
    texts += [(60 + i, prose(50, 700) + " Pemberton copy@example.net") for i in range(5)]
    found = personal_data.personal_data(docs_of(spark, texts))
    rows = found.select("doc_id", F.explode("term.value").alias("term")).collect()
    assert {(r.doc_id, r.term.lower()) for r in rows} == plain_disclosing(texts)
    assert {r.doc_id for r in rows if r.term == "Quillfeather"} == set(range(12)) and not any(r.doc_id >= 60 for r in rows)


def test_personal_data_is_native_and_takes_odd_rows(spark):
    found = personal_data.personal_data(odd_docs(spark))
    assert found.count() == len(odd_texts()) and personal_data.personal_data(empty_docs(spark)).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -------------------------------------------------------------- near duplicates

def edited(text, every, seed):
    words = text.split(" ")
    return " ".join(f"w{seed}x{i}" if i % every == every - 1 else w for i, w in enumerate(words))


def test_near_duplicates_equal_all_pairs(spark):
    texts = [(i, prose(120, i)) for i in range(30)]
    texts += [(100 + 10 * i + k, edited(prose(200, i), 90, k)) for i in range(3) for k in range(6)]
    texts += [(200, prose(120, 5)), (201, prose(120, 5)), (202, "few words"), (203, "few words"), *moved(odd_texts())]
    docs = docs_of(spark, texts)
    rows = near_duplicates.near_duplicates(docs).collect()
    assert len(rows) == len(texts)
    idf = near_duplicates.inverse_frequencies(*near_duplicates.document_frequencies(docs))
    vectors = {i: near_duplicates.weighted([t or ""], idf)[1:] for i, t in texts if i is not None}
    label = {i: i for i in vectors}
    for a in sorted(vectors):
        for b in sorted(vectors):
            if a < b and near_duplicates.jaccard(*vectors[a], *vectors[b]) >= 0.8:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    assert {r.doc_id: r.class_id for r in rows if r.doc_id is not None} == label
    assert near_duplicates.near_duplicates(empty_docs(spark)).count() == 0


def replaced(words, places, draw):
    """The words with other ones at places eight apart, each of which changes five shingles."""
    words = list(words)
    for at in draw.sample(range(4, len(words) - 4, 8), places):
        words[at] = f"v{draw.randrange(10**9)}"
    return words


def families(of_hub, n, places, seed):
    """``n`` families of a hub and ``of_hub`` variants, ids dealt so that no hub has the least or greatest; and short fillers."""
    draw, texts, hubs = random.Random(seed), [], []
    for f in range(n):
        hub = [f"w{draw.randrange(10**9)}" for _ in range(400)]
        ids = list(range(100 * f, 100 * f + of_hub + 1))
        hubs.append(ids[of_hub // 2])
        texts += [(i, " ".join(hub if i == hubs[-1] else replaced(hub, places, draw))) for i in ids]
    return texts + [(10**6 + i, f"a{i} b{i} c{i}") for i in range(100 * of_hub)], hubs


def test_near_duplicates_of_a_hub_in_the_middle_are_one_class(spark):
    texts, hubs = families(20, 8, 7, 1)  # variants are some 0.84 like the hub and 0.7 like each other
    docs = docs_of(spark, texts)
    idf = near_duplicates.inverse_frequencies(*near_duplicates.document_frequencies(docs))
    vectors = {i: near_duplicates.weighted([t], idf)[1:] for i, t in texts[:168]}
    for i, hub in enumerate(hubs):
        own = [k for k in vectors if k // 100 == i and k != hub]
        assert all(near_duplicates.jaccard(*vectors[hub], *vectors[k]) >= 0.8 for k in own)
        assert all(near_duplicates.jaccard(*vectors[j], *vectors[k]) < 0.8 for j in own for k in own if j < k)
    found = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(docs).collect()}
    assert all(found[i] == i // 100 * 100 for i in vectors) and all(found[i] == i for i, _ in texts[168:])


def filled_in(n, pairs, seed):
    """``n`` texts of one template, some 0.7 like each other, and near copies of the first ``pairs`` of them, under any ids."""
    draw = random.Random(seed)
    template = [f"w{draw.randrange(10**9)}" for _ in range(400)]
    own = [replaced(template, 8, draw) for _ in range(n)]
    own += [replaced(words, 7, draw) for words in own[:pairs]]
    ids = draw.sample(range(10**6), len(own))
    return list(zip(ids, map(" ".join, own))), {frozenset((ids[k], ids[n + k])) for k in range(pairs)}


def all_links(vectors):
    return {frozenset((a, b)) for a in vectors for b in vectors if a < b and near_duplicates.jaccard(*vectors[a], *vectors[b]) >= 0.8}


def test_near_copies_among_texts_of_a_template_are_found(spark):
    texts, planted = filled_in(100, 20, 2)
    docs = docs_of(spark, texts + [(10**6 + i, f"a{i} b{i} c{i}") for i in range(6500)])
    idf = near_duplicates.inverse_frequencies(*near_duplicates.document_frequencies(docs))
    assert all_links({i: near_duplicates.weighted([t], idf)[1:] for i, t in texts}) == planted
    found = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(docs).collect()}
    assert {frozenset((i, c)) for i, c in found.items() if i != c} == planted


def test_blocks_of_a_bucket_are_joined_exactly(spark, monkeypatch):
    texts, planted = filled_in(60, 10, 3)
    idf = np.full((near_duplicates.DEPTH, near_duplicates.BUCKETS), 1.0, np.float32)
    assert all_links({i: near_duplicates.weighted([t], idf)[1:] for i, t in texts}) == planted
    monkeypatch.setattr(near_duplicates, "BLOCK", 9)
    members = spark.createDataFrame([(1, i, i) for i, _ in texts], "bucket bigint, doc_id bigint, class_id bigint")
    bodies = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = near_duplicates.within(members, bodies, spark.sparkContext.broadcast(idf), 0.8).collect()
    assert sorted((r.a, r.b) for r in rows) == sorted(tuple(sorted(p)) for p in planted) and all(0.8 <= r.similarity < 1 for r in rows)


def test_samples_agree_as_often_as_weighted_jaccard():
    draw = np.random.default_rng(3)
    keys = np.sort(draw.integers(0, 2**63, 300).astype(np.uint64))
    one, two = draw.uniform(0.5, 4, 300), draw.uniform(0.5, 4, 300)
    both = near_duplicates.sampled(np.repeat([0, 1], 300), np.concatenate([keys, keys]), np.concatenate([one, two]), 2, 2000)
    assert abs((both[0] == both[1]).mean() - np.minimum(one, two).sum() / np.maximum(one, two).sum()) < 0.04


def test_the_frequencies_are_one_job_whatever_the_partitions(spark):
    docs = docs_of(spark, [(i, prose(30, i % 5)) for i in range(20)]).select("text")
    context, before = spark.sparkContext, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        context.setJobGroup("frequencies", "")
        sketch, n = near_duplicates.document_frequencies(docs)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert n == 20 and (sketch.sum(1) == 20 * 26).all()
    assert len(context.statusTracker().getJobIdsForGroup("frequencies")) < 8


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    assert {r.doc_id: r.class_id for r in near_duplicates.components(links).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    x, y = prose(200, 61), prose(200, 62)
    docs = docs_of(spark, [(5, x), (5, y), (6, edited(x, 199, 1)), (None, edited(y, 199, 2)), (None, prose(90, 63)), (None, prose(90, 63)), (7, y)])
    rows = near_duplicates.near_duplicates(docs).collect()
    found = sorted(((r.doc_id is None, r.doc_id or 0), (r.class_id is None, r.class_id or 0), r.n_equal) for r in rows)
    of = lambda i: (i is None, i or 0)
    assert found == sorted([(of(5), of(5), 1), (of(5), of(5), 2), (of(6), of(5), 1), (of(None), of(5), 1), (of(None), of(None), 2), (of(None), of(None), 2), (of(7), of(5), 2)])
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.select("doc_id", "text").collect()) == sorted([(5, x), (5, y), (0, prose(90, 63))])


def test_contaminated_rows_go_whatever_their_id(spark):
    phrase = prose(15, 70)
    docs = docs_of(spark, [(1, prose(20, 71) + " " + phrase), (1, prose(30, 72)), (None, phrase), (None, prose(30, 73)), (2, None), (2, None)])
    bench = spark.createDataFrame([(None, phrase)], "item_id bigint, text string")
    kept = decontamination.uncontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.select("doc_id", "text").collect()) == sorted([(1, prose(30, 72)), (0, prose(30, 73)), (2, ""), (2, "")])


def test_one_of_each_class_stays(spark):
    docs = docs_of(spark, [(3, prose(80, 1)), (1, prose(80, 1)), (1, prose(80, 1)), (2, prose(80, 2)), (4, None), (5, "")])
    assert sorted(r.doc_id for r in near_duplicates.one_of_each(docs).collect()) == [1, 2, 4, 5]


# ------------------------------------------------------------------- queries

def test_queries_equal_their_sql(spark, sf):
    connection = connect(sf)
    for name, sql in queries.SQL.items():
        assert compare(spark, connection, name, queries.QUERIES[name], sql, sf) is None


def test_pipeline_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == columns and dict(after.dtypes) == dict(docs.dtypes), name
        rows = after.select("doc_id", "text", "n_chars").collect()
        if name == "decontamination":
            assert not any(plain_hits(r.text, bench)[0] for r in rows[:20])
        if name == "personal_data":
            assert not any(plain_spans(r.text) for r in rows) and all(r.n_chars == len(r.text) for r in rows)
        before = spark.createDataFrame(after.collect(), docs.schema)
    result = corpus_pipeline.run(spark, sf).collect()
    texts = {r.doc_id: r.text for r in before.collect()}
    assert {r.doc_id for r in result} == set(texts)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].replace("▁", " ").encode()).hexdigest() for r in result)
