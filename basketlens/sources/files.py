"""CSV sources, CSV sinks and the parquet hand-off between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from basketlens.dataset import Retail
from basketlens.functions.columns import parse_invoice_date
from basketlens.operators.lines import lines_from_lists
from basketlens.sources import schemas


def read_table(spark: SparkSession, path: str, fields: tuple) -> DataFrame:
    """A CSV with a header, columns found by name in any order and cast to fixed types.

    Nothing is inferred: only one header line is read here. A missing path or column fails at once. When rows are read, a
    file of the folder whose header differs, a row with too few or too many fields, and a value that does not fit its
    type (ANSI mode) fail the read. All fields are parsed, because a pruned parser cannot see a short row.
    """
    options = {"header": True, "escape": '"', "mode": "FAILFAST", "enforceSchema": False, "columnPruning": False}
    headers = spark.read.options(**options).csv(path).columns
    schema = StructType([StructField(header, StringType()) for header in headers])
    raw = spark.read.options(**options).schema(schema).csv(path)
    return raw.select(*(F.col(f"`{header}`").cast(kind).alias(name) for header, name, kind in fields))


#: Lines that one task reads in seconds, whatever their share of the table.
ROWS_OF_A_TASK = 1_000_000


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.CUSTOMERS)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.PRODUCTS)


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    """Sales with the invoice date parsed from day/month/year text."""
    sales = read_table(spark, path, schemas.SALES)
    return sales.withColumn("invoice_date", parse_invoice_date(F.col("invoice_date")))


def read_retail(spark: SparkSession, customers_path: str, products_path: str, sales_path: str) -> Retail:
    """The whole dataset from its three CSV files. A missing file fails here, before any work starts."""
    customers = read_customers(spark, customers_path)
    products = read_products(spark, products_path)
    sales = read_sales(spark, sales_path)
    return Retail(customers, products, invoices_of(sales), lines_from_lists(sales))


def invoices_of(sales: DataFrame) -> DataFrame:
    """One row per invoice number. Rows that repeat a number add their items to it; if they disagree in customer, date or
    mall, reading them fails."""
    attributes = F.struct("customer_id", "invoice_date", "shopping_mall")
    single = sales.groupBy("invoice_no").agg(F.min(attributes).alias("_least"), F.max(attributes).alias("_most"))
    message = F.concat(F.lit("invoice with differing customer, date or mall: "), F.coalesce("invoice_no", F.lit("null")))
    checked = F.when(F.col("_least").eqNullSafe(F.col("_most")), F.col("_least")).otherwise(
        F.raise_error(message).cast(single.schema["_least"].dataType)
    )
    # the number hangs on the check too, so that a report of invoice numbers alone does not prune it away
    number = F.when(checked.isNotNull(), F.col("invoice_no"))
    return single.select(number.alias("invoice_no"), checked.alias("_row")).select("invoice_no", "_row.*")


def read_segmentation(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.SEGMENTATION)


def read_ltv_predictions(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.LTV_PREDICTIONS)


def read_feature_importance(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.FEATURE_IMPORTANCE)


def with_file_headers(df: DataFrame, fields: tuple) -> DataFrame:
    """The columns of a file under the names they carry in the file."""
    return df.select(*(F.col(name).cast(kind).alias(header) for header, name, kind in fields))


def write_table(df: DataFrame, path: str, fields: tuple) -> None:
    """A CSV folder with a header, one file per partition; the folder is created or replaced."""
    with_file_headers(df, fields).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """Any report as a CSV folder with a header; columns that CSV cannot hold are written as JSON."""
    nested = [c for c, kind in df.dtypes if kind.startswith(("array", "struct", "map"))]
    flat = df.withColumns({c: F.to_json(c) for c in nested})
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_segmentation(df: DataFrame, path: str) -> None:
    write_table(df, path, schemas.SEGMENTATION)


def write_predictions(df: DataFrame, path: str) -> None:
    write_table(df, path, schemas.LTV_PREDICTIONS)


def write_feature_importance(df: DataFrame, path: str) -> None:
    write_table(df.orderBy(F.desc("importance"), "feature"), path, schemas.FEATURE_IMPORTANCE)


def write_category_performance(df: DataFrame, path: str) -> None:
    write_table(df.orderBy(F.desc("total_revenue"), "category"), path, schemas.CATEGORY_PERFORMANCE)


def write_segment_preferences(df: DataFrame, path: str) -> None:
    write_table(df.orderBy("segment", F.desc("revenue"), "category"), path, schemas.SEGMENT_PREFERENCES)


def write_sales_trends(df: DataFrame, path: str) -> None:
    write_table(df.orderBy("year_month"), path, schemas.SALES_TRENDS)


def hand_off(df: DataFrame, path: str) -> DataFrame:
    """Writes a stage result as parquet and reads it back: later plans start from the table, not from its lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
