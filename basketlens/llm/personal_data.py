"""Personal data: spans by pattern, and terms that reveal them by the information they carry.

Everything is DataFrame functions. The base kinds (email, ip, card, phone) are found by patterns whose repetitions are
possessive where that changes no match, so that long runs neither backtrack nor recurse; places come from the lengths
of the stretches between matches.

A protected entity is a base value. All words of its documents are candidate terms; an entity or a term counts from
``LEAST_TEXTS`` different texts, so that copies of a text are no evidence and nothing is told of a single document's words. With p(e|t), the share of the documents holding term t that hold entity e, a
term discloses 1 + log p(e|t) / IC(e) of the information content IC(e) = -log p(e): 1 if it occurs with e only, 0 if it
says nothing. At ``GENERALISED`` and more a term becomes a span of kind ``term`` wherever it stands in a text with the entity;
:func:`sanitised` writes the kind in its place, and removes it at ``REMOVED`` and more.

Defined results: a null text is empty and has no spans. Rows of one doc_id are one document for the terms; rows without a
doc_id keep their base spans, get no term spans and are not counted. Equal rows get equal results; an empty table gives no rows. Columns that
are named like a kind or ``removed_terms`` are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import bounded
from basketlens.session import settle

KINDS = ("email", "ip", "card", "phone")
#: Different texts with the entity in which a term must stand, and the disclosure thresholds.
LEAST_TEXTS, GENERALISED, REMOVED = 2, 0.8, 0.95
#: A term: a stretch without blanks, of at least three letters, all else at its ends.
_TERM = r"(?<!\S)[^\p{L}\s]*+(\p{L}{3,}+)[^\p{L}\s]*+(?!\S)"

# A local part starts where no other could have started before: after a foreign character or the match before (\G).
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def _matches(text: Column, pattern: str, possible: Column) -> Column:
    return F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _no_spans() -> Column:
    return F.array().cast("array<struct<start: bigint, end: bigint, value: string>>")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""
    def weight(digit: Column, place: Column) -> Column:
        doubled = digit * F.when(place % 2 == 1, 2).otherwise(1)
        return doubled - F.when(doubled > 9, 9).otherwise(0)

    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.coalesce(weight(c.cast("int"), i), F.lit(0)))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid_ip(value: Column) -> Column:
    def small(part: Column) -> Column:
        digits = F.ltrim(part, F.lit("0"))
        return (F.length(digits) < 4) & (F.coalesce(digits.cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), small)


def _valid_card(value: Column) -> Column:
    digits = F.translate(value, " -", "")
    return F.length(digits).between(13, 19) & luhn(digits)


def _valid_phone(value: Column) -> Column:
    return F.length(F.translate(value, "+ ().-", "")).between(9, 15)


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with an array of (start, end, value) for each base kind."""
    own, df = F.coalesce(F.col(f"`{text}`"), F.lit("")), docs
    digits = own.rlike("[0-9]")
    rules = {
        "email": (_EMAIL, F.contains(own, F.lit("@")), None),
        "ip": (_IP, own.rlike(r"[0-9]\.[0-9]"), _valid_ip),
        "card": (_CARD, digits, _valid_card),
        "phone": (_PHONE, F.contains(own, F.lit("+")) & digits, _valid_phone),
    }
    found = df.withColumns({f"_found_{k}": _matches(own, pattern, possible) for k, (pattern, possible, _) in rules.items()})
    for kind, (pattern, _, valid) in rules.items():
        spans = spans_of(own, F.col(f"_found_{kind}"), F.lit(pattern))
        found = found.withColumn(kind, _passing(spans, valid) if valid else spans)
    return found.drop(*(f"_found_{k}" for k in rules))


def _passing(spans: Column, valid: Callable[[Column], Column]) -> Column:
    return F.filter(spans, lambda s: valid(s["value"]))


def spans_of(text: Column, matches: Column, pattern: Column) -> Column:
    """(start, end, value) of the matches of a pattern, in code points; each starts where gaps and matches before it end."""
    # the gaps are split once, as the one element of an outer array, and then walked together with the matches
    cells = F.transform(F.array(F.split(text, pattern, -1)), lambda gaps: F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("value")))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), _no_spans().alias("out"))

    def step(done: Column, cell: Column) -> Column:
        start = done["at"] + F.length(cell["gap"])
        end = start + F.length(cell["value"])
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(F.struct(start.alias("start"), end.alias("end"), cell["value"].alias("value")))).alias("out"))

    return F.when(F.size(matches) > 0, F.aggregate(F.element_at(cells, 1), empty, step, lambda done: done["out"])).otherwise(_no_spans())


def _entities(found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc``, ``entity`` and ``signature`` (a hash of the whole text) for every base span."""
    def of_kind(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    each = F.concat(*(of_kind(k) for k in KINDS))
    rows = found.where(f"`{doc_id}` IS NOT NULL AND " + "(" + " OR ".join(f"size({k}) > 0" for k in KINDS) + ")").select(
        F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("signature"), F.explode(each).alias("s"))
    plain = F.when(F.col("s.kind") == "email", F.lower("s.value")).otherwise(F.regexp_replace("s.value", r"[^0-9.]", ""))
    return rows.select("doc", "signature", F.concat_ws(":", "s.kind", plain).alias("entity"))


def _terms(text: str) -> Column:
    """The different terms of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(_TERM), F.lit(1)))


def disclosures(found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``term`` and ``disclosure``: terms that reveal an entity of the document at ``GENERALISED`` or more.

    ``found`` has the spans of :func:`with_base_spans`.
    """
    near = settle(_entities(found, doc_id, text).distinct())
    entities = settle(near.groupBy("entity").agg(F.count_distinct("doc").alias("n_entity"), F.count_distinct("signature").alias("n_texts")).where(
        F.col("n_texts") >= LEAST_TEXTS).drop("n_texts"))
    holders = settle(near.join(entities, "entity"))
    named = found.where(F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    docs = named.select("doc", _terms("text").alias("words"))
    ids = settle(docs.groupBy("doc").agg(F.count("*").alias("rows")))
    n = ids.count()
    # a term of more documents discloses too little of any entity, even if it stands in all of the entity's documents
    largest = entities.agg(F.max("n_entity")).first()[0] or 0
    most = largest ** GENERALISED * n ** (1 - GENERALISED) * (1 + 1e-6)
    held = settle(_frequencies(docs, ids.where("rows > 1").select("doc")).where(F.col("n_term") <= most))
    wanted = bounded(settle(holders.select("doc").distinct()))
    own = named.join(wanted, "doc").select("doc", F.explode(_terms("text")).alias("term"))  # words of holders only
    terms = settle(own.join(bounded(held), "term").distinct())
    pairs = holders.join(terms, "doc").withColumn("n", F.lit(n)).where(_disclosed("n_entity") >= GENERALISED).groupBy(
        "entity", "term", "n_entity", "n_term", "n").agg(F.count_distinct("signature").alias("n_texts"), F.count_distinct("doc").alias("n_both"))
    revealing = pairs.where(F.col("n_texts") >= LEAST_TEXTS).select("entity", "term", _disclosed("n_both").alias("disclosure")).where(
        F.col("disclosure") >= GENERALISED)
    return near.select("doc", "entity").distinct().join(revealing, "entity").groupBy("doc", "term").agg(F.max("disclosure").alias("disclosure"))


def _frequencies(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``term`` and ``n_term``, the distinct documents that hold it. ``repeated`` has the ids of several rows."""
    words = F.explode("words").alias("term")
    again = settle(repeated)
    if again.isEmpty():
        return docs.select(words).groupBy("term").agg(F.count("*").alias("n_term"))
    again = bounded(again)
    once = docs.join(again, "doc", "left_anti").select(words)
    more = docs.join(again, "doc", "left_semi").select("doc", words).distinct().select("term")
    return once.union(more).groupBy("term").agg(F.count("*").alias("n_term"))


def _disclosed(n_both: str) -> Column:
    """The share of an entity's information that a term in ``n_term`` documents discloses (``n_entity``, ``n`` beside)."""
    information = -F.log(F.col("n_entity") / F.col("n"))
    given = F.log(F.least(F.col(n_both) / F.col("n_term"), F.lit(1.0)))
    return F.when(information > 0, 1 + given / information).otherwise(0.0)


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with spans of the base kinds and of kind ``term`` (start, end, value), and ``removed_terms``."""
    found = with_base_spans(docs, text)
    per_doc = settle(disclosures(found, doc_id, text).groupBy(F.col("doc").alias("_revealed_doc")).agg(
        F.array_sort(F.collect_set("term")).alias("_revealed"), F.array_sort(F.collect_set(F.when(F.col("disclosure") >= REMOVED, F.col("term")))).alias("_removed")))
    both = found.join(bounded(per_doc), F.col(f"`{doc_id}`") == F.col("_revealed_doc"), "left")
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("_revealed", "|"), F.lit(r")(?!\p{L})"))
    base = F.concat(*(F.col(k) for k in KINDS))
    terms = F.when(F.col("_revealed").isNotNull(), spans_of(own, F.regexp_extract_all(own, pattern, F.lit(0)), pattern)).otherwise(_no_spans())
    free = F.filter(terms, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return both.withColumn("term", free).withColumn("removed_terms", F.coalesce("_removed", F.array().cast("array<string>"))).drop("_revealed_doc", "_revealed", "_removed")


def written(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind as given and then by start, joined by commas."""
    def of_kind(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*(of_kind(k) for k in kinds)), ",")


def sanitised(found: DataFrame, text: str = "text") -> Column:
    """The text with every span replaced by its kind in brackets; terms at ``REMOVED`` and more leave nothing. Of overlapping
    spans the first, and of those the longest, gives the name; null stays null."""
    def labelled(kind: str) -> Column:
        label = F.lit(f"[{kind.upper()}]")
        gone = lambda s: F.when(F.array_contains("removed_terms", F.lower(s["value"])), "").otherwise(label) if kind == "term" else label
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), gone(s).alias("label")))

    spans = F.array_sort(F.concat(*(labelled(k) for k in (*KINDS, "term"))))
    own = F.col(f"`{text}`")
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    part = lambda a, b: F.substring(own, (a + 1).cast("int"), (b - a).cast("int"))

    def step(done: Column, s: Column) -> Column:
        new = s["start"] >= done["at"]
        return F.struct(F.greatest(done["at"], -s["minus_end"]).alias("at"),
                        F.when(new, F.concat(done["out"], part(done["at"], s["start"]), s["label"])).otherwise(done["out"]).alias("out"))

    rest = lambda done: F.concat(done["out"], part(done["at"], F.length(own).cast("bigint")))
    return F.when(F.size(spans) > 0, F.aggregate(spans, empty, step, rest)).otherwise(own)
