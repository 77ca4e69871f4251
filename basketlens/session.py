"""Session helpers: a builder for stand-alone runs and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that :func:`settle` has written and nobody has removed yet, by application.
_SETTLED: dict[str, list[str]] = {}
#: Spark's setting by which an execution removes its shuffle files when it ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Options of :func:`settle` for tables of few large rows. Readers hold a batch of 4,096 rows of a row group at once, and
#: parquet's writer looks at the size of its pages and groups only after 100 rows, so both would follow the size of the files.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def build_session(app_name: str = "basketlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on. On a cluster leave ``master`` unset.

    Shuffle partition counts are left to the cluster's own configuration; adaptive execution coalesces
    small partitions and splits skewed ones.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent, a folder in the session's warehouse is taken: the warehouse is the one place that
    Spark's own tables already need to share. A machine's temporary folder is never used.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
    context.setCheckpointDir(configured)
    return configured


def _remove(spark: SparkSession, folder: str, on_exit: bool = False) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if on_exit:
        files.deleteOnExit(path)
    else:
        files.delete(path, True)


def settle(df: DataFrame, **options: str) -> DataFrame:
    """Writes an intermediate result as parquet in the shared checkpoint folder and reads it back.

    For results that are much smaller than their inputs and feed several branches of a plan: the inputs are read once,
    a lost executor does not send the job back to them, and Spark knows the size of the table when it plans joins.
    The folder is removed by :func:`release` or the enclosing :func:`scratch`, at the latest when the session's JVM ends.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(folder)
    _SETTLED.setdefault(spark.sparkContext.applicationId, []).append(folder)
    _remove(spark, folder, on_exit=True)
    kept = spark.read.schema(df.schema).parquet(folder)
    kept._settled_in = folder
    return kept


def settle_tidy(df: DataFrame, **options: str) -> DataFrame:
    """:func:`settle` in denser files, with the shuffle files of the plan removed as soon as the table is written.

    For chains of large steps, whose shuffles would otherwise lie on the disks until the driver collects its garbage. Not
    for plans that read cached tables, which may need their shuffles again.
    """
    spark = df.sparkSession
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        return settle(df, compression="zstd", **options)
    finally:
        spark.conf.set(_TIDY, before)


def discard(*tables: DataFrame) -> None:
    """Removes tables that :func:`settle` returned and no later step reads."""
    for table in tables:
        spark = table.sparkSession
        folders = _SETTLED.get(spark.sparkContext.applicationId, [])
        if table._settled_in in folders:
            folders.remove(table._settled_in)
            _remove(spark, table._settled_in)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Removes the settled tables of this application but for the ``keep`` oldest; frames that read them end with it."""
    folders = _SETTLED.get(spark.sparkContext.applicationId, [])
    while len(folders) > keep:
        _remove(spark, folders.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside the block are removed at its end, so results must be written or collected before."""
    before = len(_SETTLED.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, before)
