"""Recency, frequency and monetary value, cluster profiles and segment names."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.fixed_values import AT_RISK, HIGH_VALUE, LOW_ACTIVITY, REGULAR, SEGMENT_PLAYBOOK
from basketlens.functions import stats
from basketlens.functions.columns import days_between, known, lookup, money, share_percent, zscore

METRICS = ("recency", "frequency", "monetary")


def snapshot_date(invoices: DataFrame) -> Column:
    """The last invoice date as a scalar subquery over the invoices alone."""
    return invoices.agg(F.max("invoice_date").alias("snapshot")).scalar()


def rfm(facts: DataFrame, invoices: DataFrame, snapshot: dt.date | None = None) -> DataFrame:
    """Per customer: days since the last invoice, invoices, and money spent."""
    day = snapshot_date(invoices) if snapshot is None else F.lit(snapshot)
    per_customer = facts.where(known("customer_id")).groupBy("customer_id").agg(
        F.max("invoice_date").alias("_last"),
        F.count("invoice_no").alias("frequency"),
        money(F.sum("revenue")).alias("monetary"),
    )
    return per_customer.select("customer_id", days_between(F.col("_last"), day).alias("recency"), "frequency", "monetary")


def rfm_describe(scores: DataFrame) -> DataFrame:
    return stats.describe_columns(scores, METRICS)


def rfm_histograms(scores: DataFrame, bins: int = 50) -> DataFrame:
    long = scores.select(F.explode(F.array(*(
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS
    ))).alias("m")).select("m.*")
    return stats.histogram(long, "value", bins, ["metric"], few_groups=True)


def with_scaled_rfm(scores: DataFrame) -> DataFrame:
    """Adds recency, log1p(frequency) and log1p(monetary) as z-scores with the population deviation (``*_scaled``)."""
    raw = {
        "recency": F.col("recency").cast("double"),
        "frequency": F.log1p("frequency"),
        "monetary": F.log1p("monetary"),
    }
    moments = scores.agg(F.struct(*(
        f(raw[m]).alias(f"{m}_{name}") for m in METRICS for name, f in (("mean", F.avg), ("std", F.stddev_pop))
    )).alias("s"))
    scaled = {f"{m}_scaled": zscore(raw[m], F.col(f"_s.{m}_mean"), F.col(f"_s.{m}_std")) for m in METRICS}
    return scores.withColumn("_s", moments.scalar()).withColumns(scaled).drop("_s")


def scale_rfm(scores: DataFrame) -> DataFrame:
    return with_scaled_rfm(scores).select("customer_id", *(f"{m}_scaled" for m in METRICS))


def quartile_groups(scores: DataFrame) -> DataFrame:
    """A rule-based ``cluster``: the quartile (0 to 3) of the money spent.

    It stands in for k-means where a result must be reproducible in SQL.
    """
    quartiles = stats.quantiles(scores, "monetary", stats.SUMMARY_PROBABILITIES)
    packed = quartiles.select(F.struct("q25", "q50", "q75").alias("q")).scalar()
    return scores.withColumn("_q", packed).withColumn(
        "cluster",
        F.when(F.col("monetary") <= F.col("_q.q25"), 0)
        .when(F.col("monetary") <= F.col("_q.q50"), 1)
        .when(F.col("monetary") <= F.col("_q.q75"), 2)
        .otherwise(3),
    ).drop("_q")


def cluster_profile(clustered: DataFrame) -> DataFrame:
    """Per cluster: mean, sample deviation, minimum and maximum of each metric, and customers; two decimals."""
    measures = [
        F.round(f(F.col(m).cast("double")), 2).alias(f"{m}_{name}")
        for m in METRICS
        for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    ]
    return clustered.groupBy("cluster").agg(*measures, F.count("customer_id").alias("customers"))


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    return stats.distribution(clustered, "cluster", count_as="customers").orderBy("cluster")


def segment_map(clustered: DataFrame) -> DataFrame:
    """One row per cluster: its metric means and the segment name the rules give it.

    The thresholds are quantiles over the cluster means, a frame of one row per cluster, compared strictly.
    """
    means = clustered.groupBy("cluster").agg(*(F.avg(m).alias(m) for m in METRICS))
    thresholds = means.agg(F.struct(
        F.percentile("recency", 0.75).alias("r75"),
        F.percentile("frequency", 0.75).alias("f75"),
        F.percentile("frequency", 0.5).alias("f50"),
        F.percentile("monetary", 0.75).alias("m75"),
        F.percentile("monetary", 0.5).alias("m50"),
    ).alias("t")).scalar()
    ruled = means.withColumn("_t", thresholds)
    best = (F.col("monetary") > F.col("_t.m75")) & (F.col("frequency") > F.col("_t.f75"))
    silent = F.col("recency") > F.col("_t.r75")
    solid = (F.col("frequency") > F.col("_t.f50")) & (F.col("monetary") > F.col("_t.m50"))
    name = F.when(best, HIGH_VALUE).when(silent, AT_RISK).when(solid, REGULAR).otherwise(LOW_ACTIVITY)
    return ruled.withColumn("segment", name).drop("_t")


def segment_rules(clustered: DataFrame) -> DataFrame:
    """Adds ``segment`` to customers with a ``cluster``; the broadcast map has one row per cluster."""
    return clustered.join(F.broadcast(segment_map(clustered).select("cluster", "segment")), "cluster", "left")


def segment_distribution(segmented: DataFrame) -> DataFrame:
    return stats.distribution(segmented, "segment", count_as="customers").orderBy(F.desc("customers"), "segment")


def segment_means(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy("segment").agg(
        *(F.round(F.avg(m), 2).alias(f"avg_{m}") for m in METRICS), F.count("customer_id").alias("customers")
    )


def rfm_totals(scores: DataFrame) -> DataFrame:
    """Customers, revenue and revenue per customer. Revenue is summed in cents' precision, free of row order."""
    totals = scores.agg(
        F.count("customer_id").alias("customers"), money(F.sum(F.col("monetary").cast("decimal(20,2)"))).alias("revenue")
    )
    return totals.withColumn("revenue_per_customer", F.try_divide(F.col("revenue"), F.col("customers")))


def segment_summary(segmented: DataFrame) -> DataFrame:
    """Per segment: customers, revenue and its mean, mean frequency and recency, shares of revenue and customers."""
    totals = rfm_totals(segmented).select(F.struct("customers", "revenue").alias("t")).scalar()
    per_segment = segmented.groupBy("segment").agg(
        F.count("customer_id").alias("customers"),
        F.round(money(F.sum(F.col("monetary").cast("decimal(20,2)"))), 2).alias("total_revenue"),
        F.round(F.avg("monetary"), 2).alias("avg_revenue"),
        F.round(F.avg("frequency"), 2).alias("avg_frequency"),
        F.round(F.avg("recency"), 2).alias("avg_recency"),
    )
    shared = per_segment.withColumn("_t", totals)
    return shared.withColumn(
        "revenue_share", F.round(share_percent(F.col("total_revenue"), F.col("_t.revenue")), 2)
    ).withColumn("customer_share", F.round(share_percent(F.col("customers"), F.col("_t.customers")), 2)).drop("_t")


def segment_playbook(segmented: DataFrame) -> DataFrame:
    """Per segment found in the data: customers, characteristics and the numbered recommendations."""
    counts = stats.distribution(segmented, "segment", count_as="customers")
    characteristics = {name: text for name, (text, _) in SEGMENT_PLAYBOOK.items()}
    steps = F.lit(None).cast("array<string>")
    for name, (_, recommendations) in SEGMENT_PLAYBOOK.items():
        steps = F.when(F.col("segment") == name, F.array(*map(F.lit, recommendations))).otherwise(steps)
    return counts.select(
        "segment",
        "customers",
        lookup(F.col("segment"), characteristics).alias("characteristics"),
        F.posexplode(steps).alias("step", "recommendation"),
    ).withColumn("step", F.col("step") + 1)
