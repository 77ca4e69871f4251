"""Category, segment and trend analysis.

``category_facts`` has one row per invoice and category, ``facts`` one row per invoice (see ``lines``), ``segments``
and ``classes`` one row per customer. Facts are summed per customer before they meet a customer table, so a customer
with very many invoices reaches the join as a few rows, and distinct customers become plain counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from basketlens.dataset import Retail
from basketlens.fixed_values import GROWTH_FLOOR, SEGMENTS, VALUE_CLASSES
from basketlens.functions import stats
from basketlens.functions.columns import known, money, month_name, share_percent, year_month
from basketlens.session import settle


def _per_customer(facts: DataFrame, key: str) -> DataFrame:
    """Category or mall or month sums per customer."""
    items = "items" if "items" in facts.columns else "product_count"
    return facts.where(known("customer_id", key)).groupBy("customer_id", key).agg(
        F.sum("revenue").alias("revenue"), F.sum(items).alias("items"), F.count("invoice_no").alias("invoices"),
        F.sum("priced_items" if "priced_items" in facts.columns else items).alias("priced_items"),
    )


def category_performance(category_facts: DataFrame) -> DataFrame:
    """Per category: items, revenue, mean price, invoices, customers and revenue per invoice."""
    per_customer = category_facts.groupBy("category", "customer_id").agg(
        F.sum("items").alias("items"),
        F.sum("priced_items").alias("priced_items"),
        F.sum("revenue").alias("revenue"),
        F.count("invoice_no").alias("invoices"),
    )
    per_category = per_customer.groupBy("category").agg(
        F.sum("items").alias("products_sold"),
        F.round(money(F.sum("revenue")), 2).alias("total_revenue"),
        F.round(F.try_divide(money(F.sum("revenue")), F.sum("priced_items")), 2).alias("avg_price"),
        F.sum("invoices").alias("transactions"),
        F.count("customer_id").alias("unique_customers"),
    )
    ratio = F.col("total_revenue") / F.col("transactions")
    return per_category.withColumn("revenue_per_transaction", ratio).orderBy(F.desc("total_revenue"), "category")


def _category_by(category_facts: DataFrame, labels: DataFrame, label: str, names: tuple[str, str]) -> DataFrame:
    per_customer = _per_customer(category_facts, "category")
    labelled = per_customer.join(labels.select("customer_id", label), "customer_id").where(known(label))
    revenue_as, items_as = names
    return labelled.groupBy("category", label).agg(
        money(F.sum("revenue")).alias(revenue_as),
        F.sum("priced_items").alias(items_as),
        F.count("customer_id").alias("unique_customers"),
    )


def category_by_segment(category_facts: DataFrame, segments: DataFrame) -> DataFrame:
    return _category_by(category_facts, segments, "segment", ("segment_revenue", "products_sold"))


def category_by_value_class(category_facts: DataFrame, classes: DataFrame, value_class: str) -> DataFrame:
    return _category_by(category_facts, classes, value_class, ("value_class_revenue", "products_sold"))


def segment_category_preferences(category_facts: DataFrame, segments: DataFrame) -> DataFrame:
    per_customer = _per_customer(category_facts, "category")
    labelled = per_customer.join(segments.select("customer_id", "segment"), "customer_id").where(known("segment"))
    return labelled.groupBy("segment", "category").agg(
        money(F.sum("revenue")).alias("revenue"),
        F.sum("items").alias("products_sold"),
        F.count("customer_id").alias("unique_customers"),
    )


def top_categories_by_segment(category_facts: DataFrame, segments: DataFrame, n: int = 3) -> DataFrame:
    preferences = segment_category_preferences(category_facts, segments)
    return stats.top_n_per_group(preferences, "segment", n, "revenue", "category")


def segment_price_sensitivity(retail: Retail, segments: DataFrame) -> DataFrame:
    """Per segment: mean, median and sample deviation of the price of items sold, and items; two decimals.

    Invoices take the segment of their customer before they meet the lines, so that lines are shuffled once and counted
    per segment and product map-side. The counts per segment and price are settled, since mean, deviation and median
    all start from them and weigh every price with its count.
    """
    labels = segments.where(known("customer_id", "segment")).select("customer_id", "segment")
    labelled = retail.invoices.select("invoice_no", "customer_id").join(labels, "customer_id").drop("customer_id")
    priced = settle(
        retail.lines.join(labelled, "invoice_no")
        .groupBy("segment", "product_id")
        .agg(F.count("product_id").alias("items"))
        .join(retail.products.select("product_id", "price"), "product_id", "left")
        .groupBy("segment", "price")
        .agg(F.sum("items").alias("items"))
    )
    price = F.col("price").cast("double")
    # deviation from counts: sums around a rough centre keep the subtraction exact enough
    centre = retail.products.agg(F.avg(F.col("price").cast("double")).alias("c")).scalar()
    off = priced.withColumn("_off", price - centre).withColumn("_n", F.when(F.col("price").isNotNull(), F.col("items")))
    moments = off.groupBy("segment").agg(
        F.sum(F.col("price") * F.col("_n")).cast("double").alias("_total"),
        F.sum("_n").alias("_n"),
        F.sum(F.col("_off") * F.col("_n")).alias("_s1"),
        F.sum(F.col("_off") * F.col("_off") * F.col("_n")).alias("_s2"),
        F.sum("items").alias("products_sold"),
    )
    variance = F.try_divide(F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("_n"), F.col("_n") - 1)
    medians = stats.quantiles(priced, "price", {"median_price": 0.5}, ["segment"], weight="items", few_groups=True)
    return moments.join(medians, "segment", "left").select(
        "segment",
        F.round(F.try_divide("_total", "_n"), 2).alias("avg_price"),
        F.round("median_price", 2).alias("median_price"),
        F.round(F.sqrt(variance), 2).alias("price_std"),
        "products_sold",
    )


def segment_mall_preferences(facts: DataFrame, segments: DataFrame) -> DataFrame:
    per_customer = _per_customer(facts, "shopping_mall").join(segments.select("customer_id", "segment"), "customer_id")
    return per_customer.where(known("segment")).groupBy("segment", "shopping_mall").agg(
        money(F.sum("revenue")).alias("revenue"), F.sum("invoices").alias("transactions")
    )


def with_month(facts: DataFrame) -> DataFrame:
    return facts.where(known("invoice_date")).withColumn("year_month", year_month(F.col("invoice_date")))


def monthly_trends(facts: DataFrame) -> DataFrame:
    """Per month: revenue, invoices, items and customers."""
    per_customer = with_month(facts).groupBy("year_month", "customer_id").agg(
        F.sum("revenue").alias("revenue"), F.count("invoice_no").alias("invoices"), F.sum("product_count").alias("items")
    )
    return (
        per_customer.groupBy("year_month")
        .agg(
            money(F.sum("revenue")).alias("monthly_revenue"),
            F.sum("invoices").alias("transactions"),
            F.sum("items").alias("products_sold"),
            F.count("customer_id").alias("unique_customers"),
        )
        .withColumn("year_month_str", F.col("year_month"))
        .orderBy("year_month")
    )


def seasonal_patterns(facts: DataFrame) -> DataFrame:
    dated = facts.where(known("invoice_date"))
    return dated.groupBy(F.year("invoice_date").alias("year"), F.month("invoice_date").alias("month")).agg(
        money(F.sum("revenue")).alias("revenue"), F.count("invoice_no").alias("transactions")
    )


def seasonal_average(facts: DataFrame) -> DataFrame:
    """Mean over the years of each calendar month's revenue and invoices."""
    yearly = seasonal_patterns(facts)
    return (
        yearly.groupBy("month")
        .agg(F.avg("revenue").alias("avg_revenue"), F.avg("transactions").alias("avg_transactions"))
        .withColumn("month_name", month_name(F.make_date(F.lit(2000), F.col("month"), F.lit(1))))
        .orderBy("month")
    )


def segment_trends(facts: DataFrame, segments: DataFrame) -> DataFrame:
    per_customer = _per_customer(with_month(facts), "year_month").join(
        segments.select("customer_id", "segment"), "customer_id"
    )
    return per_customer.where(known("segment")).groupBy("year_month", "segment").agg(
        money(F.sum("revenue")).alias("revenue"), F.sum("invoices").alias("transactions")
    )


def pivot_category_segment(category_facts: DataFrame, segments: DataFrame) -> DataFrame:
    """Revenue matrix: categories by segment, zero-filled."""
    cells = category_by_segment(category_facts, segments)
    return stats.crosstab(cells, "category", "segment", SEGMENTS, F.sum("segment_revenue"))


def pivot_mall_segment(facts: DataFrame, segments: DataFrame) -> DataFrame:
    """Revenue matrix: malls by segment, zero-filled."""
    cells = segment_mall_preferences(facts, segments)
    return stats.crosstab(cells, "shopping_mall", "segment", SEGMENTS, F.sum("revenue"))


def segment_value_customers(
    invoices: DataFrame, segments: DataFrame, classes: DataFrame, value_class: str
) -> DataFrame:
    """Distinct customers with invoices: segments by value class, zero-filled."""
    buyers = invoices.where(known("customer_id")).select("customer_id").distinct()
    labelled = buyers.join(segments.select("customer_id", "segment"), "customer_id").join(
        classes.select("customer_id", value_class), "customer_id"
    )
    return stats.crosstab(labelled, "segment", value_class, VALUE_CLASSES)


def key_findings(category_performance: DataFrame, monthly_trends: DataFrame) -> DataFrame:
    """One row: the top category with its revenue and share, total revenue, categories, first and last month."""
    best = F.min(F.struct((-F.col("total_revenue")).alias("negated"), "category"))
    headline = category_performance.agg(
        best.alias("_best"),
        F.round(F.sum(F.col("total_revenue").cast("decimal(20,2)")).cast("double"), 2).alias("total_revenue"),
        F.count(F.lit(1)).alias("categories"),
    )
    period = monthly_trends.agg(F.struct(F.min("year_month").alias("a"), F.max("year_month").alias("b")).alias("p"))
    return headline.withColumn("_period", period.scalar()).select(
        F.col("_best.category").alias("top_category"),
        (-F.col("_best.negated")).alias("top_revenue"),
        share_percent(-F.col("_best.negated"), F.col("total_revenue")).alias("top_share"),
        "total_revenue",
        "categories",
        F.col("_period.a").alias("first_month"),
        F.col("_period.b").alias("last_month"),
    )


def avg_monthly_growth(monthly_trends: DataFrame) -> DataFrame:
    """Mean month-on-month revenue change in percent, and the headline with its floor. One window row per month."""
    before = F.lag("monthly_revenue").over(W.orderBy("year_month"))
    change = monthly_trends.withColumn("_change", F.try_divide(F.col("monthly_revenue"), before) - 1)
    return change.agg((F.avg("_change") * 100).alias("avg_growth")).withColumn(
        "headline_growth", F.greatest(F.col("avg_growth"), F.lit(float(GROWTH_FLOOR)))
    )
