"""Order trends, mall performance, best sellers and purchase frequency.

``sizes`` stands for invoices with ``product_count`` (see ``lines.invoice_sizes``), one row per invoice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from basketlens.dataset import Retail
from basketlens.functions import stats
from basketlens.functions.columns import known, share_percent, year_month
from basketlens.operators.lines import invoice_sizes, sold_lines


def with_calendar_month(invoices: DataFrame) -> DataFrame:
    return invoices.withColumn("year_month", year_month(F.col("invoice_date")))


def monthly_orders(invoices: DataFrame) -> DataFrame:
    return stats.distribution(with_calendar_month(invoices), "year_month", count_as="orders").orderBy("year_month")


def year_month_pivot(invoices: DataFrame) -> DataFrame:
    """Orders per year (rows) and month 1 to 12 (columns m1 to m12), zero-filled."""
    parts = invoices.select(F.year("invoice_date").alias("year"), F.month("invoice_date").alias("month"))
    wide = stats.crosstab(parts, "year", "month", range(1, 13))
    return wide.toDF("year", *(f"m{m}" for m in range(1, 13))).orderBy("year")


def month_mall_pivot(invoices: DataFrame) -> DataFrame:
    """Orders per month and mall as rows, zero where a mall had none in the month."""
    return stats.crosstab_present(with_calendar_month(invoices), "year_month", "shopping_mall", "orders")


def order_size_histogram(sizes: DataFrame) -> DataFrame:
    return stats.distribution(sizes, "product_count", count_as="orders").orderBy("product_count")


def mall_orders(invoices: DataFrame) -> DataFrame:
    """Orders per mall with the market share in percent."""
    counts = stats.distribution(invoices, "shopping_mall", count_as="orders")
    return stats.with_share(counts, "orders", "share").orderBy(F.desc("orders"), "shopping_mall")


def mall_avg_products(sizes: DataFrame) -> DataFrame:
    return sizes.where(known("shopping_mall")).groupBy("shopping_mall").agg(F.avg("product_count").alias("avg_products"))


def mall_growth_index(invoices: DataFrame) -> DataFrame:
    """Orders per month and mall relative to the first month of the data, in percent; null on a zero base."""
    monthly = month_mall_pivot(invoices)
    base = F.first("orders").over(W.partitionBy("shopping_mall").orderBy("year_month"))
    return monthly.withColumn("base", base).select(
        "year_month", "shopping_mall", "orders", (share_percent(F.col("orders"), F.col("base")) - 100).alias("growth")
    )


def product_counts(lines: DataFrame) -> DataFrame:
    return stats.distribution(lines, "product_id", count_as="sold")


def top_products(lines: DataFrame, n: int = 20) -> DataFrame:
    return stats.top_n(product_counts(lines), n, "sold", "product_id")


def top_product_filter(lines: DataFrame, n: int) -> DataFrame:
    """Lines of the n most frequent products; the broadcast side has n rows."""
    return lines.join(F.broadcast(top_products(lines, n).select("product_id")), "product_id", "left_semi")


def cap_frequency(counts: DataFrame, limit: int | None = None, by: str = "sold") -> DataFrame:
    """Counts up to ``limit``, for charts that end there; all of them without a limit."""
    return counts if limit is None else counts.where(F.col(by) <= limit)


def product_purchase_frequency(lines: DataFrame, max_frequency: int | None = None) -> DataFrame:
    """How many products were sold exactly k times, for every k or up to ``max_frequency``."""
    frequency = stats.frequency_of_counts(lines, "product_id", "sold", "products")
    return cap_frequency(frequency, max_frequency).orderBy("sold")


def mall_best_seller(retail: Retail) -> DataFrame:
    return stats.most_frequent(sold_lines(retail), "shopping_mall", "product_id", "sold")


def basket_size_distribution(lines: DataFrame) -> DataFrame:
    return stats.frequency_of_counts(lines, "invoice_no", "items", "orders").orderBy("items")


def customer_order_frequency(invoices: DataFrame) -> DataFrame:
    return stats.frequency_of_counts(invoices, "customer_id", "orders", "customers").orderBy("orders")


def top_customers_by_orders(invoices: DataFrame, n: int = 15) -> DataFrame:
    return stats.top_n(stats.distribution(invoices, "customer_id", count_as="orders"), n, "orders", "customer_id")


def top_customers_by_products(sizes: DataFrame, n: int = 15) -> DataFrame:
    bought = sizes.where(known("customer_id")).groupBy("customer_id").agg(F.sum("product_count").alias("items"))
    return stats.top_n(bought.where(F.col("items") > 0), n, "items", "customer_id")


def mall_loyalty(invoices: DataFrame) -> DataFrame:
    """How many customers shop in exactly k malls, with percentages."""
    pairs = invoices.where(known("customer_id", "shopping_mall")).select("customer_id", "shopping_mall").distinct()
    counts = stats.frequency_of_counts(pairs, "customer_id", "malls", "customers")
    return stats.with_share(counts, "customers", "share").orderBy("malls")


def sales_overview(retail: Retail) -> DataFrame:
    """One row: orders, date range, distinct customers, products and malls, mean items per order.

    Every distinct count is a scalar subquery of its own, reading one column, instead of one aggregate that would
    copy each row once per distinct column.
    """
    def distinct(df: DataFrame, column: str):
        return df.agg(F.count_distinct(column).alias("n")).scalar()

    totals = invoice_sizes(retail).agg(
        F.count(F.lit(1)).alias("orders"),
        F.min("invoice_date").alias("first_date"),
        F.max("invoice_date").alias("last_date"),
        F.avg("product_count").alias("avg_products"),
    )
    return totals.select(
        "orders",
        "first_date",
        "last_date",
        distinct(retail.invoices, "customer_id").alias("customers"),
        distinct(retail.lines, "product_id").alias("products"),
        distinct(retail.invoices, "shopping_mall").alias("malls"),
        "avg_products",
    )


def mall_stats(sizes: DataFrame) -> DataFrame:
    """Per mall: orders, mean items per order, distinct customers.

    Rows are first summed per mall and customer, so the distinct count needs no second pass over the invoices.
    """
    per_customer = sizes.where(known("shopping_mall")).groupBy("shopping_mall", "customer_id").agg(
        F.count("invoice_no").alias("orders"), F.sum("product_count").alias("items")
    )
    return per_customer.groupBy("shopping_mall").agg(
        F.sum("orders").alias("orders"),
        (F.sum("items") / F.sum("orders")).alias("avg_products"),
        F.count("customer_id").alias("customers"),
    )
