"""Small tables with everything that the operators must take: nulls, empties, ties, repeats, long texts, clashing columns."""

import random

CLASHING = ("lang string, source string, n_chars bigint, measured string, failures string, email string, term string, doc string, key string,"
            " row string, score string, features string, starts string, text_id string, digest string, n_words string, class_id string")
SCHEMA = f"doc_id bigint, text string, {CLASHING}"
WORDS = "river stone quiet garden window paper orange travel music winter summer candle bridge forest silver market kitchen".split()


def prose(n, seed):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(("", "", "ly", "ing", "ed", "s")) + str(draw.randrange(40)) * (draw.random() < 0.4) for _ in range(n))


def row(doc_id, text):
    return (doc_id, text, *(["x", "y", 1] + ["z"] * (len(CLASHING.split(",")) - 3)))


def odd_texts():
    """(id, text): null, empty, blank, tiny, non-ASCII, long, equal rows, equal texts."""
    return [(1, None), (2, ""), (3, "  \n\t "), (4, "a"), (5, "é😀 ▁ \x00 ñ"), (6, prose(30_000, 1)), (7, "x" * 50_000), (8, prose(60, 2)), (8, prose(60, 2)),
            (9, prose(60, 2)), (None, prose(60, 3)), (None, None), (10, "the the the the the the the the the the the the"), (11, "a\n\na\na\n")]


def docs_of(spark, texts):
    return spark.createDataFrame([row(i, t) for i, t in texts], SCHEMA)


def odd_docs(spark):
    return docs_of(spark, odd_texts())


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
