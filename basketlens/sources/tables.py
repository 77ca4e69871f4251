"""The retail star read from order tables in parquet (customer, part, orders, lineitem)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.dataset import Retail
from basketlens.operators.lines import baskets_as_text


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_retail(spark: SparkSession, folder: str) -> Retail:
    """Orders stand for invoices, parts for products, priorities for malls; age and gender derive from the keys."""
    customers = _table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M").alias("gender"),
        (18 + F.col("c_custkey") % 60).cast("int").alias("age"),
        F.col("c_mktsegment").alias("payment_method"),
    )
    products = _table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
    )
    invoices = _table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("invoice_no"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("invoice_date"),
        F.col("o_orderpriority").alias("shopping_mall"),
    )
    lines = _table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("invoice_no"), F.col("l_partkey").alias("product_id")
    )
    return Retail(customers, products, invoices, lines)


def load_basket_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Baskets as comma-separated text, as a sales file holds them (see ``baskets_as_text``)."""
    retail = load_retail(spark, folder)
    return baskets_as_text(retail.invoices, retail.lines)
