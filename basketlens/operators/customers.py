"""Customer demographics against payment method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from basketlens.fixed_values import AGE_BAND_STRATEGIES, AGE_BANDS
from basketlens.functions import stats
from basketlens.functions.columns import age_band, known, lookup, share_percent

AGE_LABELS = [label for _, label in AGE_BANDS]


def with_age_band(customers: DataFrame) -> DataFrame:
    return customers.withColumn("age_band", age_band(F.col("age")))


def customer_count(customers: DataFrame) -> DataFrame:
    return customers.agg(F.count(F.lit(1)).alias("customers"))


def gender_distribution(customers: DataFrame) -> DataFrame:
    return stats.distribution(customers, "gender", count_as="customers").orderBy(F.desc("customers"), "gender")


def payment_distribution(customers: DataFrame) -> DataFrame:
    counts = stats.distribution(customers, "payment_method", count_as="customers")
    return stats.with_share(counts, "customers", "share").orderBy(F.desc("customers"), "payment_method")


def age_describe(customers: DataFrame) -> DataFrame:
    return stats.describe(customers, "age")


def age_band_distribution(customers: DataFrame) -> DataFrame:
    return stats.distribution(with_age_band(customers), "age_band", count_as="customers").orderBy("age_band")


def crosstab_age_payment(customers: DataFrame) -> DataFrame:
    """Customers per payment method and age band, zero-filled, as rows."""
    return stats.crosstab_long(with_age_band(customers), "payment_method", "age_band", AGE_LABELS, "customers")


def crosstab_gender_payment(customers: DataFrame) -> DataFrame:
    """Customers per payment method and gender, zero-filled, as rows."""
    return stats.crosstab_present(customers, "payment_method", "gender", "customers")


def crosstab_age_payment_rowpct(customers: DataFrame) -> DataFrame:
    """Share of each payment method inside an age band, in percent with one decimal."""
    cells = crosstab_age_payment(customers)
    band_total = F.sum("customers").over(W.partitionBy("age_band"))
    return cells.withColumn("share", F.round(share_percent(F.col("customers"), band_total), 1)).drop("customers")


def age_band_profile(customers: DataFrame) -> DataFrame:
    """Per age band: size, share of all customers, most common payment method and the recommended strategy."""
    banded = with_age_band(customers)
    sizes = stats.with_share(stats.distribution(banded, "age_band", count_as="customers"), "customers", "share")
    favourite = stats.most_frequent(banded, "age_band", "payment_method", "method_customers")
    return sizes.join(favourite, "age_band", "left").withColumn(
        "strategy", lookup(F.col("age_band"), AGE_BAND_STRATEGIES)
    )


def payment_profile(customers: DataFrame) -> DataFrame:
    """Per payment method: mean age, percentage of women among known genders, users."""
    woman = F.when(F.col("gender").isNotNull(), F.when(F.col("gender") == "F", 100.0).otherwise(0.0))
    return customers.where(known("payment_method")).groupBy("payment_method").agg(
        F.avg("age").alias("avg_age"),
        F.avg(woman).alias("female_share"),
        F.count(F.lit(1)).alias("customers"),
    )
