"""The dataset as tables of its own, so that a run reads each input once and invoices meet their lines without a shuffle.

Customers, products and sales are parsed once and written as parquet. Invoices and lines are written bucketed and sorted by
``invoice_no``, into the same number of buckets: joins and aggregates on the invoice number then need no exchange. Rows are
counted by observations on these writes, so the shapes of the tables cost no job of their own.

A bucket is read by one task. An invoice that fills several buckets' worth of lines would make that task the slowest of
all, so such lines are written as plain parquet instead, which a join can split; results are the same.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from basketlens.dataset import Retail
from basketlens.operators.lines import lines_from_lists
from basketlens.sources import files

KEY = "invoice_no"
#: How many times the lines of an average bucket a single invoice may have.
HOT_BUCKETS = 4
SHAPES = "table_name string, rows bigint, columns bigint"


def observed(df: DataFrame, **extra) -> tuple[DataFrame, Observation]:
    """A frame that counts its rows while it is written."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(name) for name, c in extra.items())), seen


def write_bucketed(df: DataFrame, folder: str, buckets: int, key: str = KEY) -> DataFrame:
    """Writes a table in ``buckets`` buckets of ``key``, a sorted file each, and reads it back with them."""
    spark = df.sparkSession
    name = f"handoff_{uuid.uuid4().hex}"
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", folder).saveAsTable(name)
    return spark.table(name)


def read_bucketed(spark: SparkSession, folder: str, buckets: int, key: str = KEY) -> DataFrame:
    """A table of :func:`write_bucketed` in a later session: files keep their rows, the session learns of the buckets."""
    name = f"handoff_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in spark.read.parquet(folder).schema)
    place = folder.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def hand_off_retail(
    spark: SparkSession, customers_path: str, products_path: str, sales_path: str, out: str, buckets: int | None = None
) -> tuple[Retail, DataFrame]:
    """The dataset from its three CSV files as tables under ``<out>/tables``, and the shapes of these tables.

    ``buckets`` is the number of shuffle partitions unless given. Every CSV file is scanned once.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = f"{out}/tables"
    people, n_people = observed(files.read_customers(spark, customers_path))
    goods, n_goods = observed(files.read_products(spark, products_path))
    people, goods = files.hand_off(people, f"{tables}/customers"), files.hand_off(goods, f"{tables}/products")
    sales = files.hand_off(files.read_sales(spark, sales_path), f"{tables}/sales")

    # counted after the shuffle by invoice, in the tasks that write, so a repeated map task counts nothing twice
    invoices, n_invoices = observed(files.invoices_of(sales))
    invoices = write_bucketed(invoices, f"{tables}/invoices", buckets)
    sold = lines_from_lists(sales)
    # one row per invoice: how many lines there are, how many the largest invoice has, and how many invoices have any
    per_invoice = sold.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    n_lines, most, filled = per_invoice.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    if most * buckets > HOT_BUCKETS * n_lines and most > files.ROWS_OF_A_TASK:
        lines = files.hand_off(sold, f"{tables}/lines")
    else:
        lines = write_bucketed(sold.repartition(buckets, KEY), f"{tables}/lines", buckets)
    retail = Retail(people, goods, invoices, lines)

    merged = {*invoices.columns, *lines.columns, *goods.columns, *people.columns}
    rows = n_invoices.get["rows"]
    shapes = [
        ("customers", n_people.get["rows"], len(people.columns)),
        ("products", n_goods.get["rows"], len(goods.columns)),
        ("sales", rows, len(invoices.columns) + 1),
        # an empty basket is one row of the merged lines
        ("merged", n_lines + rows - filled, len(merged)),
    ]
    return retail, spark.createDataFrame(shapes, SHAPES)
