"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned from the labelled training texts (words far more frequent in toxic ones); features are densities of
strong and weak lexicon words, their nearness to second-person words, capitals, punctuation and obfuscation. Trees are
fitted on a part of the training rows, the calibration on the rest, so that scores read as probabilities.

Defined results: a null text is empty; an empty text has all features zero and gets the score of such texts. Labelled rows
whose label is null are not used. If the training rows have one class only, every score is the share of that class (0.0
without rows). Rows are scored one by one, so repeated rows get equal scores.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import map_arrow, texts
from basketlens.session import settle

#: Labelled rows that the models learn from at most: the least by hash of their id.
TRAIN_ROWS = 20_000
#: Words in the lexicon at most, by evidence; least share of toxic training texts that hold a word, least log odds.
LEXICON_WORDS, LEAST_SHARE, LEAST_LOG_ODDS, STRONG_LOG_ODDS = 300, 0.004, 0.7, 2.0
TREES, DEPTH = 30, 4
NEAR = 5
FEATURES = ("strong_density", "weak_density", "strong_count", "distinct_strong", "greatest_log_odds", "mean_log_odds", "near_you",
            "you_rate", "capitals", "exclamations", "punctuation", "obfuscation", "masked_hits", "log_words")
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner euch euer sie ihr tu te toi ton ta tes vous votre vos "
    "tú ti tuyo tuya usted ustedes vosotros vuestro vuestra".split())
_WORD = re.compile(r"[^\W\d_]+")
#: Signs at the ends of a stretch without blanks that no masked word starts or ends with.
_ENDS = ".,;:!?-*_()'\"…"
_MASKED = re.compile(r"(?=\w*[^\W\d_])[^\W_]+(?:[0-9@$*!._\-][^\W_]+)+|[^\W\d_]+[0-9@$][^\W_]*")
_UNMASK = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", ".": None, "-": None, "_": None, "*": None})


def masked_words(low: str) -> list[str]:
    """All matches of ``_MASKED``. They hold no blanks, and none lies in a stretch of letters only."""
    stretches = (s.strip(_ENDS) for s in low.split() if not s.isalpha())
    return [m for s in stretches if not s.isalpha() for m in _MASKED.findall(s)]


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """The dense features of one text, in the order of ``FEATURES``."""
    low = text.lower()
    words = _WORD.findall(low)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    told = [(i, w) for i, w in enumerate(words) if w in lexicon or w in SECOND_PERSON]
    hits = [(i, lexicon[w]) for i, w in told if w in lexicon]
    strong = [i for i, s in hits if s >= STRONG_LOG_ODDS]
    you = [i for i, w in told if w in SECOND_PERSON]
    near = 0
    if strong and you:
        at = np.searchsorted(you, strong)
        places = np.array([-10**9, *you, 10**9])
        near = int((np.minimum(np.array(strong) - places[at], places[at + 1] - np.array(strong)) <= NEAR).sum())
    masked = masked_words(low)
    letters = len("".join(words))
    plain = len(text) - text.count(" ") - letters
    raw = text.encode("utf-8", "surrogatepass")
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [
        100.0 * len(strong) / n, 100.0 * (len(hits) - len(strong)) / n, float(np.log1p(len(strong))), float(len({words[i] for i in strong})),
        max((s for _, s in hits), default=0.0), sum(s for _, s in hits) / n, 100.0 * near / n, 100.0 * len(you) / n,
        capitals / letters, 100.0 * (text.count("!") + text.count("?")) / n, plain / letters,
        100.0 * len(masked) / n, float(sum(lexicon.get(m.translate(_UNMASK), 0.0) >= STRONG_LOG_ODDS for m in masked)), float(np.log1p(n)),
    ]


def with_features(docs: DataFrame, lexicon: Broadcast, text: str = "text", name: str = "features") -> DataFrame:
    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        known = lexicon.value
        return pa.array([features(t or "", known) for t in column.to_pylist()], pa.list_(pa.float64()))

    return docs.withColumn(name, array_to_vector(run.asNondeterministic()(F.col(f"`{text}`"))))


def learned_lexicon(train: DataFrame) -> dict[str, float]:
    """Words and their log odds in toxic against other texts. ``train``: ``text``, ``toxic``."""
    totals = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    a, b = totals.get(1, 0), totals.get(0, 0)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found: dict[str, list[int]] = {}
            for t, toxic in zip(texts(batch), batch.column("toxic").to_pylist()):
                for word in set(_WORD.findall(t.lower())):
                    found.setdefault(word, [0, 0])[toxic] += 1
            return {"word": list(found), "others": [c[0] for c in found.values()], "toxics": [c[1] for c in found.values()]}

        return work

    counts = map_arrow(train, make, "word string, others bigint, toxics bigint").groupBy("word").agg(F.sum("others").alias("others"), F.sum("toxics").alias("toxics"))
    odds = F.log((F.col("toxics") + 0.5) / (a + 1.0)) - F.log((F.col("others") + 0.5) / (b + 1.0))
    chosen = counts.where(F.col("toxics") >= max(3.0, LEAST_SHARE * a)).withColumn("odds", odds).where(F.col("odds") >= LEAST_LOG_ODDS)
    return {r.word: r.odds for r in chosen.orderBy(F.desc(F.col("odds") * F.col("toxics")), "word").limit(LEXICON_WORDS).collect()}


@dataclass
class ToxicityModel:
    """A lexicon, trees and a calibration; ``constant`` replaces them where there was nothing to learn."""

    lexicon: Broadcast
    trees: object | None
    calibration: object | None
    constant: float

    def score(self, docs: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        """``docs`` with a score of 0 to 1."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(self.constant))
        packed = docs.select(F.struct("*").alias("toxicity_row"))
        own = packed.withColumn("toxicity_text", F.col(f"toxicity_row.`{text}`"))
        raw = self.trees.transform(with_features(own, self.lexicon, "toxicity_text", "toxicity_features"))
        calibrated = self.calibration.transform(raw.withColumn("toxicity_raw", vector_to_array("toxicity_probability")[1]))
        rest = [F.col(f"toxicity_row.`{c}`") for c in docs.columns if c != name]
        return calibrated.select(*rest, F.least(F.greatest("toxicity_score", F.lit(0.0)), F.lit(1.0)).alias(name))


def train_model(docs: DataFrame, labels: DataFrame, allowed: Column, doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS,
                seed: int = 0) -> ToxicityModel:
    """Learns from at most ``rows`` labelled rows of ``labels`` (``doc_id``, ``toxic``) for which ``allowed`` holds."""
    context = docs.sparkSession.sparkContext
    usable = labels.where(allowed & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("labelled_id"), F.col("toxic").cast("int").alias("toxic")).groupBy("labelled_id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64("labelled_id", F.lit(seed))
    sample = usable.orderBy(draw, "labelled_id").limit(rows).withColumn("fold", F.pmod(F.xxhash64("labelled_id", F.lit(seed + 1)), F.lit(3)))
    own = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("labelled_id"), F.col(f"`{text}`").alias("text"))
    train = settle(own.join(F.broadcast(sample), "labelled_id").select("text", "toxic", "fold"))  # at most ``rows`` ids
    known = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # the rows of the calibration are kept out of the lexicon too, or their features would flatter
    lexicon = context.broadcast(learned_lexicon(train.where("fold > 0")) if len(known) == 2 else {})
    ready = settle(with_features(train, lexicon).select("features", F.col("toxic").cast("double").alias("toxic"), "fold").coalesce(8))
    parts = ready.where("fold > 0"), ready.where("fold = 0")
    if len(known) < 2 or any(part.select("toxic").distinct().count() < 2 for part in parts):
        total = sum(known.values())
        return ToxicityModel(lexicon, None, None, known.get(1, 0) / total if total else 0.0)
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, subsamplingRate=0.8, minInstancesPerNode=10, seed=seed).fit(parts[0])
    trees.setFeaturesCol("toxicity_features").setRawPredictionCol("toxicity_margin").setProbabilityCol("toxicity_probability").setPredictionCol("toxicity_class")
    raw = trees.transform(parts[1].withColumnRenamed("features", "toxicity_features")).withColumn("toxicity_raw", vector_to_array("toxicity_probability")[1])
    calibration = IsotonicRegression(labelCol="toxic", featuresCol="toxicity_raw", predictionCol="toxicity_score").fit(raw.select("toxicity_raw", "toxic"))
    return ToxicityModel(lexicon, trees, calibration, 0.0)
