"""Distinct customers of any period from stored sketches, an explicit approximate option beside the exact reports.

A HyperLogLog sketch per day and category has a fixed size and is merged without the order lines, so the customers of a week,
a season or all time, of a category or of all, come from one small table. Exact counts remain in ``patterns``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base-2 logarithm of a sketch's buckets, and the relative standard error that goes with it (1.04 / sqrt of the buckets).
LG_BUCKETS = 12
STANDARD_ERROR = 1.04 / (1 << LG_BUCKETS) ** 0.5


def customer_sketches(category_facts: DataFrame, lg_buckets: int = LG_BUCKETS) -> DataFrame:
    """``invoice_date``, ``category`` and ``customers``, the sketch of the customers of that day and category.

    Invoices without a date, items without a category and unknown customers are left out, as in the exact reports.
    """
    known = F.col("invoice_date").isNotNull() & F.col("category").isNotNull() & F.col("customer_id").isNotNull()
    return category_facts.where(known).groupBy("invoice_date", "category").agg(F.hll_sketch_agg("customer_id", F.lit(lg_buckets)).alias("customers"))


def period_customers(sketches: DataFrame, *by: str | Column) -> DataFrame:
    """Estimated customers by ``by`` (columns or expressions over ``invoice_date`` and ``category``), and over all of them in the
    row whose ``by`` columns are all null. Restrict ``sketches`` with ``where`` to any period first."""
    keys = [F.col(b) if isinstance(b, str) else b for b in by]
    return sketches.rollup(*keys).agg(F.hll_union_agg("customers").alias("_all"), F.grouping_id().alias("_level")).where(
        F.col("_level").isin(0, (1 << len(keys)) - 1)).withColumn("approx_customers", F.hll_sketch_estimate("_all")).drop("_all", "_level")
