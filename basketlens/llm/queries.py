"""The registered queries of the text operators, one per operator, with SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm import (
    chunk_dedup,
    collocations,
    decontamination,
    html_blocks,
    importance,
    lexical_search,
    near_duplicates,
    personal_data,
    piece_encoding,
    quality_rules,
    suffix_dedup,
    token_files,
    toxicity,
)
from basketlens.llm.common import digest, table
from basketlens.session import LARGE_ROWS, settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def piece_model() -> str:
    """The public model that the encoding contract names."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def byte_model() -> str:
    """The public tokenizer that the token files' contract names."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query
def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_blocks.extract(pages).withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return entries.select(
        "doc_id", *(f"measured.{m}" for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        (~quality_rules.kept("base")).alias("base_failed"), quality_rules.kept("v2").alias("kept"), "failures")


SQL["op2_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, key) AS n
    FROM (SELECT r, i, ws[i:i + 4] AS key FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w))),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM windows, (SELECT unnest(range(5)) AS k) WHERE n > 1 GROUP BY r),
m AS (SELECT w.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(ls) AS BIGINT) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
    length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations,
    len(list_distinct(ws)) AS n_distinct_words, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stuttered
  FROM w LEFT JOIN repeats USING (r)),
f AS (SELECT *, CAST(
    CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_capitals > n_letters AND n_letters > 0 THEN 8 ELSE 0 END
    + CASE WHEN 5 * n_exclamations > n_words THEN 16 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 64 ELSE 0 END
    + CASE WHEN 20 * n_distinct_words < n_words THEN 128 ELSE 0 END + CASE WHEN 10 * n_stuttered > 3 * n_words THEN 256 ELSE 0 END AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train_model(docs, labels, ~held_out())
    scored = model.score(docs)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", suffix_dedup.kept_digest(F.col("text"), F.col("removed_spans")).alias("kept")).select("doc_id", "kept.*")


@query
def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = chunk_dedup.repeats(docs)
    sizes = docs.select(F.col("doc_id").alias("id"), chunk_dedup.row_key().alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    cut = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return sizes.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("row")), "left").select(
        F.col("id").alias("doc_id"), "n_bytes", F.coalesce(cut, F.lit(0)).alias("n_removed"), F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"),
        F.coalesce("n_repeated", F.lit(0)).__gt__(0).alias("has_repeat"), "removed", "partner_ids")


@query
def op6_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.encode_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model()).drop("text")


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", F.size("hit_words").cast("bigint").alias("n_hit"),
                        F.size("items").cast("bigint").alias("n_items"), digest(names).alias("items_sha256"),
                        (F.size("hit_words") > 0).alias("contaminated"))


SQL["op7_decontamination"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS key FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS key FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, key)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM hits GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN found USING (r)
"""


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = (F.size(F.col(k)).cast("bigint").alias(f"n_{k}") for k in personal_data.KINDS)
    return found.select("doc_id", *counts, F.sha2(personal_data.written(personal_data.KINDS).cast("binary"), 256).alias("base_sha256"),
                        personal_data.written((*personal_data.KINDS, "term")).alias("spans"), F.size("term").cast("bigint").alias("n_term"))


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = settle(lexical_search.build_index(table(spark, sf_dir, "documents")), **LARGE_ROWS)
    items = lexical_search.query_terms(table(spark, sf_dir, "benchmark"))
    return lexical_search.search(index, items).select(F.col("query_id").alias("item_id"), "rank", "doc_id", "score")


SQL["op11_lexical_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
sizes AS (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n FROM d WHERE len(ws) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM sizes),
lengths AS (SELECT r, doc_id, 50 + (50 * n * n_docs) // n_words AS m FROM sizes, totals),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) SEMI JOIN q USING (term) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
scores AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN lengths USING (r) GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, totals = collocations.phrases(table(spark, sf_dir, "documents"))
    return collocations.ranked(found, totals).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL["op12_collocations"] = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
ws AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM ws GROUP BY lang),
grams AS (SELECT lang, k, ws[i:i + k - 1] AS g FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM ws, (SELECT unnest(range(1, 6)) AS k))),
f AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY lang, k, g HAVING count(*) >= 100),
inner_parts AS (SELECT lang, f AS longer, unnest([g[1:k - 1], g[2:k]]) AS g FROM f WHERE k > 2),
covered AS (SELECT lang, g, max(longer) AS longer FROM inner_parts GROUP BY lang, g),
kept AS (SELECT f.lang, f.k, f.g, f.f FROM f LEFT JOIN covered USING (lang, g) WHERE f.k > 1 AND (longer IS NULL OR 100 * longer < 100 * f.f)),
cuts AS (SELECT kept.lang, kept.g, kept.f AS a, j, l.f AS l, r.f AS r, n, CAST(1000::HUGEINT * kept.f * n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) AS kept JOIN totals USING (lang)
    JOIN f AS l ON l.lang = kept.lang AND l.g = kept.g[1:j] JOIN f AS r ON r.lang = kept.lang AND r.g = kept.g[j + 1:kept.k]),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM weakest)
SELECT * FROM ranked WHERE rank <= 2000
"""


@query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = settle(token_files.shards(table(spark, sf_dir, "documents"), byte_model()))
    return token_files.documents(written)
