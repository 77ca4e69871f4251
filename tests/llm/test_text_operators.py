"""Operators that judge or encode each text by itself: quality rules, encoding, toxicity, pages, importance."""

import random
import re
import time

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketlens.llm import html_blocks, importance, piece_encoding, quality_rules, toxicity
from basketlens.llm.queries import piece_model
from tests.llm.data import docs_of, empty_docs, odd_docs, odd_texts, prose

# ---------------------------------------------------------------- quality rules


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i: i + 5]), []).append(i)
    repeated = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    seen, lines = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.append(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(repeated)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n#|é ", max_size=80))
def test_measures_equal_the_plain_ones(text):
    assert quality_rules.measure_text(text)[:5] == plain_measures(text)


def test_ledger_takes_odd_rows(spark):
    rows = quality_rules.ledger(odd_docs(spark)).withColumn("kept", quality_rules.kept("v2")).collect()
    assert len(rows) == len(odd_texts())
    by_id = {r.doc_id: r for r in rows if r.doc_id}
    for i in (1, 2, 3, 4):
        assert by_id[i].failures & 1 and not by_id[i].kept
    assert by_id[8].kept and by_id[6].kept and not by_id[10].kept
    assert by_id[6].measured.n_words == 30_000
    assert quality_rules.ledger(empty_docs(spark)).count() == 0


def test_policies_and_ablation_use_only_the_masks(spark):
    entries = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,), (512,)], "failures bigint")
    table = {r.rule: r for r in quality_rules.ablation(entries, "base").collect()}
    assert set(table) == {"few_words", "repeated_words"}
    assert (table["few_words"].n_failed, table["few_words"].n_failed_alone, table["few_words"].n_kept, table["few_words"].n_kept_without_rule) == (3, 2, 3, 5)
    assert entries.where(quality_rules.kept("base")).count() == 3
    assert quality_rules.mask_of(("symbol_rate", "shouting")) == 12


# -------------------------------------------------------------- piece encoding

@pytest.fixture(scope="module")
def both():
    return piece_encoding.PieceEncoder(piece_model()), sentencepiece.SentencePieceProcessor(model_file=piece_model())


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="the in ▁.,19<s>\n", max_size=60)))
def test_encoding_and_decoding_equal_the_library(both, text):
    own, library = both
    text = text.encode("utf-8", "ignore").decode()
    ids = library.encode(text)
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids)
    assert own.summary(text) == (len(ids), ",".join(map(str, ids)), library.decode(ids))


@given(st.lists(st.integers(0, 31_999), max_size=12))
@settings(max_examples=300, deadline=None)
def test_any_ids_decode_as_in_the_library(both, ids):
    own, library = both
    assert own.decode(ids) == library.decode(ids)


def test_long_words_and_texts(both):
    own, library = both
    for text in ("a" * 5000, "ab" * 4000, " " * 3000, "é😀" * 2000, prose(5000, 4)):
        assert own.encode(text) == library.encode(text)


def test_words_are_told_from_the_signs_around_them(both):
    own = piece_encoding.PieceEncoder(piece_model())
    own.summary("river stone")
    calls, encode = [], own._encode_word
    own._encode_word = lambda word: calls.append(word) or encode(word)
    text = "river, (stone) river; stone!\nriver... 'river' stone\tstone"
    assert own.summary(text)[1] == ",".join(map(str, both[1].encode(text)))
    # of the words only those without the mark are new, whatever stands beside them, and each is encoded once
    assert {"river", "stone"} == {w for w in calls if w.isalpha()} and len(calls) == len(set(calls))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="thein▁ aou\u00e9", max_size=60))
def test_scanned_merges_equal_those_of_the_queue(both, text):
    own, _ = both
    kept, piece_encoding.SCANNED = piece_encoding.SCANNED, -1
    try:
        queued = own.merge(text)
    finally:
        piece_encoding.SCANNED = kept
    assert own.merge(text) == queued


def test_words_that_decode_to_other_text_are_told_apart(both):
    own, library = piece_encoding.PieceEncoder(piece_model()), both[1]
    own.byte_ids = None  # characters without a piece become the unknown id, which decodes to other text
    text = "a \U0001F9FF b \U0001F9FF"
    for _ in range(2):
        count, ids, back = own.summary(text)
        assert list(map(int, ids.split(","))) == own.encode(text) and count == len(own.encode(text))
        assert back == own.decode(own.encode(text)) != text


def test_encoding_columns(spark, both):
    rows = piece_encoding.encode_digests(odd_docs(spark), piece_model()).collect()
    assert len(rows) == len(odd_texts()) and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    docs = odd_docs(spark).select("doc_id", "text")
    back = docs.withColumn("ids", piece_encoding.encoded(F.col("text"), piece_model()))
    back = back.withColumn("again", piece_encoding.decoded(F.col("ids"), piece_model()))
    assert all((r.text or "") == r.again.replace("▁", " ") or "▁" in r.text for r in back.collect())
    assert piece_encoding.encode_digests(empty_docs(spark), piece_model()).count() == 0


# ------------------------------------------------------------------- toxicity

def insulted(n):
    draw = random.Random(3)
    texts, labels = [], []
    for i in range(n):
        words = prose(80, i).split()
        toxic = i % 5 == 0
        for _ in range(5 * toxic):
            words.insert(draw.randrange(len(words)), draw.choice(("idiot", "moron", "you clown")))
        texts.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return texts, labels


def test_toxicity_learns_the_words_and_is_right_on_held_out_rows(spark):
    texts, labels = insulted(300)
    docs = docs_of(spark, [*texts, (1000, None), (1001, ""), (1002, "x")])
    table = spark.createDataFrame([*labels, (5000, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train_model(docs, table, F.col("doc_id") < 200)
    assert {"idiot", "moron"} <= set(model.lexicon.value)
    rows = {r.doc_id: r.score for r in model.score(docs, name="score").collect()}
    assert len(rows) == 303 and all(0 <= s <= 1 for s in rows.values())
    assert all((rows[i] >= 0.3) == bool(toxic) for i, _, toxic in labels if i >= 200)
    assert rows[1000] == rows[1001]
    assert model.score(empty_docs(spark)).count() == 0


def test_toxicity_without_two_classes_is_constant(spark):
    docs = docs_of(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.train_model(docs, none, F.lit(True)).score(docs).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.train_model(docs, one, F.lit(True)).score(docs).collect()} == {1.0}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abzé019@$*!._- ,;()\n²½\u00a0", max_size=60))
def test_masked_words_are_all_matches_of_the_pattern(text):
    assert toxicity.masked_words(text) == toxicity._MASKED.findall(text)


def test_features_see_obfuscation_and_nearness():
    near = dict(zip(toxicity.FEATURES, toxicity.features("You are an idiot, 1d10t and m.o.r.o.n!", {"idiot": 3.0, "moron": 3.0})))
    assert near["near_you"] > 0 and near["masked_hits"] == 2 and near["obfuscation"] > 0
    assert not any(toxicity.features("", {"idiot": 3.0}))


# ---------------------------------------------------------------------- pages

@pytest.fixture(scope="module")
def labeller(spark, sf):
    return html_blocks.train_labeller(html_blocks.training_sample(spark.read.parquet(f"{sf}/pages.parquet")))


def test_blocks_decode_and_skip():
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href="/x">Home</a></nav><p class="x y">a&amp;b  <b>c</b>d<br>e<!-- <p>no --><p>f &am'
    found = html_blocks.blocks(page)
    assert [b.text for b in found] == ["Home", "a&b cd", "e", "f &am"]
    assert found[0].linked == 4 and found[1].path == ("html", "body", "p x y")


def test_loose_quotes_and_slashes_leave_no_markup():
    of = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert of('<p title="x>Hello</p>') == ["Hello"]
    assert of("<p class=a'b>World</p>") == ["World"] and of("<p don't>World</p>") == ["World"]
    assert of("<p title='a>b' id=\"c>d\">World</p>") == ["World"] and of("<p a = 'x>y'>World</p>") == ["World"]
    assert of('<div>a</div><script src="a.js"/>var x=1;</script><div>b</div>') == ["a", "b"]
    assert of("<div/>one<p>two") == ["one", "two"] and of("<svg><path d='x'/><text>no</text></svg><p>yes") == ["yes"]
    assert of("<object><p>instead</p></object><noscript>plain</noscript>") == ["instead", "plain"]
    assert of("a&nbsp;b \n c") == ["a b c"]


def test_end_tags_may_be_left_out():
    of = lambda page: [(b.text, b.path) for b in html_blocks.blocks(page)]
    assert of("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == [("a", ("ul", "li")), ("b", ("ul", "li")), ("c", ("ul", "li", "ul", "li")), ("d", ("ul", "li"))]
    assert of("<table><tr><td>a<td>b<tr><th>c</table>") == [("a", ("table", "tr", "td")), ("b", ("table", "tr", "td")), ("c", ("table", "tr", "th"))]
    assert of("<dl><dt>a<dd>b<dt>c</dl>") == [("a", ("dl", "dt")), ("b", ("dl", "dd")), ("c", ("dl", "dt"))]
    assert of("<div><p>a<div>b</div></div>") == [("a", ("div", "p")), ("b", ("div", "div"))]


@pytest.mark.parametrize("piece", ["<li>x ", "<div>x ", "<b>x ", "<p>x", "x</i>", '<a href="', "<table><td>x"])
def test_many_unclosed_elements_take_linear_time_and_memory(piece):
    n = 30_000
    begin = time.process_time()
    found = html_blocks.blocks(piece * n)
    assert time.process_time() - begin < 20 and sum(len(b.path) for b in found) <= html_blocks.PATH_STEPS * n


def test_a_head_ends_without_its_end_tag():
    for start in ("<body>", "<body class='x'><div>", "<p>", "<a href='/'>", "", "<img src='i'>", "<svg><path/></svg>"):
        page = f"<html><head><meta charset='u'><title>no</title><style>no</style><noscript><img src='i'>no</noscript>\n{start}Text <p>More</p></html>"
        assert [b.text for b in html_blocks.blocks(page)] == ["Text", "More"], start
    page = "<head><title>no</title><noscript><div>no</div></noscript><link rel='x'></head><p>Text"
    assert [b.text for b in html_blocks.blocks(page)] == ["Text"]


def test_main_text_of_known_layouts(spark, labeller):
    main = " ".join(prose(12, s).capitalize() + "." for s in range(3))
    layouts = [
        f'<html><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy</div><article><h1>Title</h1><p>{main}</p></article><footer>&copy; x</footer></body></html>',
        f'<html><body><header>Site</header><div class="sidebar"><p>Other</p></div><main><h1>Title</h1><p>{main}</p></main><section class="comments"><div class="comment"><p>Nice.</p></div></section><footer>f</footer></body></html>',
    ]
    pages = spark.createDataFrame([*enumerate(layouts), (7, None), (8, ""), (8, ""), (9, "<p"), (10, "<div>" * 3000)], "page_id bigint, html string").withColumn("text", F.lit("old"))
    rows = {r.page_id: r.text for r in html_blocks.extract(pages, labeller=labeller).collect()}
    assert rows[0] == rows[1] == f"Title {main}"
    assert rows[7] == rows[8] == rows[9] == rows[10] == ""
    assert html_blocks.extract(pages.limit(0)).count() == 0


def test_labeller_is_right_on_unseen_layouts_and_given_pages(spark, sf, labeller):
    draw = random.Random(5)
    made = [html_blocks.invented([prose(20, s) for s in range(40)], ["Home", "About us", "Log in"], draw) for _ in range(150)]
    found = labeller.label([page for page, _ in made])
    right = sum(int(a) == b for labels, (_, truth) in zip(found, made) for a, b in zip(labels, truth))
    assert right / sum(len(t) for _, t in made) > 0.97
    pages = [html_blocks.blocks(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert all([int(x) for x in labels] == html_blocks.weak_labels(page) for page, labels in zip(pages, labeller.label(pages)))


def test_gradients_equal_differences():
    model = html_blocks.BlockLabeller(1)
    page = html_blocks.blocks("<div><p>a b</p><nav>c</nav><p>d e f</p></div>")
    x, mask, y = html_blocks.padded([page, page[:2]], [[1, 0, 1], [1, 0]])
    model.w = {k: v.astype("float64") for k, v in model.w.items()}
    _, grads = model.gradients(x, mask, y)
    for name in ("xf", "hb", "o", "cf"):
        at = (0,) * model.w[name].ndim
        old, step = model.w[name][at], 1e-4
        model.w[name][at] = old + step
        up, _ = model.gradients(x, mask, y)
        model.w[name][at] = old - step
        down, _ = model.gradients(x, mask, y)
        model.w[name][at] = old
        assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-3


# ----------------------------------------------------------------- importance

def test_resampling_prefers_target_texts_and_selects_exactly_k(spark):
    good = [(i, prose(50, i)) for i in range(60)]
    bad = [(100 + i, " ".join(f"zz{(i * 7 + k) % 13}||" for k in range(50))) for i in range(20)]
    docs = docs_of(spark, [*good, *bad])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = importance.resample(docs, labels, share=0.75).collect()
    assert sum(r.selected for r in rows) == 60
    assert all(r.selected == (r.doc_id < 100) for r in rows)


def test_resampling_takes_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = importance.resample(odd_docs(spark), labels, share=0.5).collect()
    assert len(rows) == len(odd_texts()) and sum(r.selected for r in rows) == len(rows) // 2
    assert all(r.log_weight == 0 for r in rows)
    assert importance.resample(empty_docs(spark), labels).count() == 0


def test_top_k_of_equal_keys_is_exact_and_ranks_few_rows(spark):
    rows = [(i if i % 3 else None, 1.0) for i in range(900)] + [(5000, 1.0)] * 300 + [(6000 + i, 2.0) for i in range(7)] + [(7000 + i, 0.5) for i in range(50)]
    scored = spark.createDataFrame(rows, "doc_id bigint, key double")
    for k in (3, 7, 8, 100, 307, 500, 907, 1000, 1207, 1230):
        chosen = [(r.key, r.doc_id) for r in importance.top_k(scored, k, bins=8, enough=5).where("selected").collect()]
        ordered = sorted(rows, key=lambda r: (-r[1], r[0] is not None, r[0] or 0))
        assert sorted(chosen, key=repr) == sorted([(key, i) for i, key in ordered[:k]], key=repr)


def test_top_k_equals_sorting(spark):
    draw = random.Random(1)
    rows = [(i, float(draw.randrange(500))) for i in range(3000)]
    scored = spark.createDataFrame(rows, "doc_id bigint, key double")
    for k in (0, 1, 1234, 2999, 3000):
        chosen = {r.doc_id for r in importance.top_k(scored, k, bins=8, enough=5).where("selected").collect()}
        assert chosen == {i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}
