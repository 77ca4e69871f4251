"""The corpus pipeline: five text operators in a row, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a frame; :func:`run` writes it as parquet in the session's shared folder
and hands the reread table to the next stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm import decontamination, near_duplicates, personal_data, piece_encoding, quality_rules
from basketlens.llm.common import prepare, table
from basketlens.llm.queries import piece_model
from basketlens.session import settle


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the newest quality policy."""
    prepare(spark)
    return quality_rules.ledger(docs).where(quality_rules.kept("v2")).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least id in each class; rows of one id count as one document, of which one row stays."""
    prepare(spark)
    return near_duplicates.one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark phrase."""
    prepare(spark)
    return decontamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; personal data and revealing terms are replaced in the text, ``n_chars`` follows the new text."""
    found = personal_data.personal_data(docs)
    found = found.withColumn("sanitised_text", personal_data.sanitised(found))
    new = {"text": F.col("sanitised_text"), "n_chars": F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("sanitised_text"))}
    return found.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` with the count of its ids and the digests of ids and decoded text."""
    prepare(spark)
    return piece_encoding.encode_digests(docs.select("doc_id", "text"), piece_model()).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", keep_uncontaminated),
    ("personal_data", hide_personal_data),
    ("piece_encoding", encode),
]

#: SQL can express neither the weighted samples nor the merges; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
