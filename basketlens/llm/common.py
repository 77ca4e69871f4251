"""What the text operators share: bounded Arrow batches, table access, digests, hashing of words."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.session import settle

#: Bytes of one Arrow batch handed to Python. With it the memory of a task follows the longest text, not the row count.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read whole."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Caps rows and bytes of Arrow batches, so that long texts do not pile up in a Python worker.

    In local mode the workers also learn where this package lies, from wherever the session was started; a cluster has it
    from ``--py-files`` or ``PYTHONPATH``.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context.master.startswith("local["):
        home = str(Path(__file__).resolve().parents[2])
        known = context.environment.get("PYTHONPATH", "")
        if home not in known.split(os.pathsep):
            context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [home, known]))


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df``, stored, with a number of its own for each row; it lasts as long as the stored table, whatever is lost."""
    return settle(df.withColumn(name, F.monotonically_increasing_id()))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def arrow_rows(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str) -> DataFrame:
    """``mapInArrow`` from a function of a batch to columns; ``make`` runs once in each task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows and (columns := work(batch)) is not None:
                yield arrow_rows(target, columns)

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit words (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x += np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1))
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit words as numbers strictly between 0 and 1."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def digest(column) -> F.Column:
    """Lowercase hex of the SHA-256 of a string column's UTF-8."""
    return F.sha2(column.cast("binary"), 256)


def hashed_sample(df: DataFrame, keys: list[str], rows: int, total: int, seed: int = 0) -> DataFrame:
    """At most ``rows`` rows of about ``total``: those of least hash of ``keys``, whatever the order of the rows.

    Rows whose hash is too great to be among them are dropped where they lie (the margin is six standard deviations), so
    that tasks do not each send ``rows`` rows to be sorted.
    """
    draw = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 40))
    share = min(1.0, (rows + 6 * rows**0.5 + 10) / max(total, 1))
    return df.where(draw < int(share * (1 << 40))).orderBy(draw, *keys).limit(rows)


#: Rows up to which :func:`bounded` lets a settled table be broadcast, and tables of one number a row.
BROADCAST_ROWS, BROADCAST_IDS = 50_000, 500_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A settled table of narrow rows, with a broadcast hint if counting shows that it is small; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
