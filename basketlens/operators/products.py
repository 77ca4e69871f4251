"""Product and price statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from basketlens.fixed_values import (
    PRICE_BAND_CHARACTERS,
    PRICE_BANDS,
    PRICE_TIER_STRATEGIES,
    PRICE_TIERS,
)
from basketlens.functions import stats
from basketlens.functions.columns import Bands, flag, known, lookup, price_band, price_tier, share_percent


def with_price_band(products: DataFrame, bands: Bands = PRICE_BANDS) -> DataFrame:
    return products.withColumn("price_band", price_band(F.col("price"), bands))


def filter_category(products: DataFrame, category: str | None = None) -> DataFrame:
    """All products, or those of one category."""
    return products if category is None else products.where(F.col("category") == category)


def drop_null_prices(products: DataFrame) -> DataFrame:
    return products.where(known("price"))


def product_count_total(products: DataFrame) -> DataFrame:
    return products.agg(F.count(F.lit(1)).alias("products"))


def category_list(products: DataFrame) -> DataFrame:
    return products.where(known("category")).select("category").distinct().orderBy("category")


def category_distribution(products: DataFrame) -> DataFrame:
    counts = stats.distribution(products, "category", count_as="products")
    return stats.with_share(counts, "products", "share").orderBy(F.desc("products"), "category")


def price_describe(products: DataFrame) -> DataFrame:
    return stats.describe(products, "price")


def price_band_distribution(products: DataFrame, bands: Bands = PRICE_BANDS) -> DataFrame:
    return stats.distribution(with_price_band(products, bands), "price_band", count_as="products").orderBy("price_band")


def crosstab_category_band(products: DataFrame, bands: Bands = PRICE_BANDS) -> DataFrame:
    """Products per category and price band, zero-filled, as rows."""
    labels = [label for _, label in bands]
    return stats.crosstab_long(with_price_band(products, bands), "category", "price_band", labels, "products")


def avg_price_by_category(products: DataFrame) -> DataFrame:
    return (
        products.where(known("category"))
        .groupBy("category")
        .agg((F.sum("price").cast("double") / F.count("price")).alias("avg_price"))
        .orderBy(F.desc("avg_price"), "category")
    )


def category_price_stats(products: DataFrame) -> DataFrame:
    """Per category: count, mean, median and sample deviation of the price, two decimals."""
    categorised = products.where(known("category"))
    moments = categorised.groupBy("category").agg(
        F.count("price").alias("count"),
        F.round(F.sum("price").cast("double") / F.count("price"), 2).alias("mean"),
        F.round(F.stddev_samp(F.col("price").cast("double")), 2).alias("std"),
    )
    medians = stats.quantiles(categorised, "price", {"median": 0.5}, ["category"], few_groups=True)
    return moments.join(medians.withColumn("median", F.round("median", 2)), "category", "left")


def category_strategy(products: DataFrame, tiers: Bands = PRICE_TIERS) -> DataFrame:
    """Per category: size, share, mean and deviation of the price, price tier and its strategy."""
    per_category = products.where(known("category")).groupBy("category").agg(
        F.count(F.lit(1)).alias("products"),
        (F.sum("price").cast("double") / F.count("price")).alias("avg_price"),
        F.stddev_samp(F.col("price").cast("double")).alias("price_std"),
    )
    tiered = stats.with_share(per_category, "products", "share").withColumn("tier", price_tier(F.col("avg_price"), tiers))
    return tiered.withColumn("strategy", lookup(F.col("tier"), PRICE_TIER_STRATEGIES))


def price_band_top_categories(products: DataFrame, n: int = 3, bands: Bands = PRICE_BANDS) -> DataFrame:
    """Per price band: its n largest categories with their share of the band, and the band's character text."""
    banded = with_price_band(products, bands)
    counts = stats.distribution(banded, "price_band", "category", count_as="products")
    sizes = banded.groupBy("price_band").agg(
        F.count(F.lit(1)).alias("band_products"), F.count("category").alias("_known")
    )
    best = stats.top_n_per_group(counts, "price_band", n, "products", "category", rank_as="rank")
    return (
        best.join(sizes, "price_band")
        .withColumn("share", share_percent(F.col("products"), F.col("_known")))
        .withColumn("characteristics", lookup(F.col("price_band"), PRICE_BAND_CHARACTERS))
        .drop("_known")
    )


def price_frequency_table(
    products: DataFrame, category: str | None = None, bins: int = 10, by_category: bool = False
) -> DataFrame:
    """Histogram of the price with relative, cumulative and cumulative relative frequencies and a range label.

    Over all products, those of one category, or with ``by_category`` for every category in one pass.
    """
    by = ["category"] if by_category else []
    priced = filter_category(products, category)
    table = stats.histogram(priced.where(known("category")) if by else priced, "price", bins, by, few_groups=True)
    # one row per bin: the window runs over `bins` rows
    cumulative = F.sum("frequency").over(W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("frequency").over(W.partitionBy(*by))
    return table.select(
        *by,
        "bin",
        F.format_string("$%.2f - $%.2f", "bin_low", "bin_high").alias("price_range"),
        "frequency",
        (F.col("frequency") / total).alias("relative_frequency"),
        cumulative.alias("cumulative_frequency"),
        (cumulative / total).alias("cumulative_relative_frequency"),
    )


def price_frequency_levels(products: DataFrame, bins: int = 10) -> DataFrame:
    """:func:`price_frequency_table` over all products (level 1, no category) and for every category (level 0).

    One pass over the products: spans and bins of both levels come from the counts of the distinct prices.
    """
    counts = stats.value_counts_by_level(products, "category", "price")
    by = ["level", "category"]
    table = stats.histogram(counts, "price", bins, by, few_groups=True, weight="n")
    cumulative = F.sum("frequency").over(W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("frequency").over(W.partitionBy(*by))
    return table.select(
        "level", _level_category(),
        "bin",
        F.format_string("$%.2f - $%.2f", "bin_low", "bin_high").alias("price_range"),
        "frequency",
        (F.col("frequency") / total).alias("relative_frequency"),
        cumulative.alias("cumulative_frequency"),
        (cumulative / total).alias("cumulative_relative_frequency"),
    )


def descriptive_levels(products: DataFrame) -> DataFrame:
    """:func:`descriptive_stats` over all products (level 1, no category) and for every category (level 0).

    One pass over the products: moments and ranks of both levels come from the counts of the distinct prices. Sums of
    prices and of their squares are decimals, exact whatever the order of rows.
    """
    counts = stats.value_counts_by_level(products, "category", "price")
    by = ["level", "category"]
    price, n = F.col("price").cast("decimal(12,2)"), F.col("n").cast("decimal(12,0)")
    sums = counts.groupBy(*by).agg(
        F.sum("n").alias("count"), F.sum(price * n).alias("_sum"), F.sum((price * price).cast("decimal(24,4)") * n).alias("_squares"),
        F.min("price").alias("_min"), F.max("price").alias("_max"),
    )
    mean = F.col("_sum").cast("double") / F.col("count")
    spread = F.greatest(F.col("_squares").cast("double") - F.col("_sum").cast("double") * mean, F.lit(0.0))
    variance = F.when(F.col("count") > 1, spread / (F.col("count") - 1))
    medians = stats.quantiles(counts, "price", {"median": 0.5}, by, weight="n", few_groups=True)
    return sums.join(F.broadcast(medians), by).select(  # a row per category
        "level", _level_category(), "count", mean.alias("mean"), "median", F.sqrt(variance).alias("std"), variance.alias("variance"),
        F.col("_min").cast("double").alias("min"), F.col("_max").cast("double").alias("max"), (F.col("_max") - F.col("_min")).cast("double").alias("range"),
    )


def _level_category():
    return F.when(F.col("level") == 0, F.col("category")).alias("category")


def descriptive_stats(products: DataFrame, category: str | None = None, by_category: bool = False) -> DataFrame:
    """Count, mean, median, sample deviation and variance, minimum, maximum and range; no row without prices.

    Over all products, those of one category, or with ``by_category`` for every category in one pass.
    """
    priced = drop_null_prices(filter_category(products, category))
    if by_category:
        priced = priced.where(known("category"))
    price = F.col("price").cast("double")
    moments = priced.groupBy(*["category"] * by_category).agg(
        F.count("price").alias("count"),
        (F.sum("price").cast("double") / F.count("price")).alias("mean"),
        F.stddev_samp(price).alias("std"),
        F.var_samp(price).alias("variance"),
        F.min(price).alias("min"),
        F.max(price).alias("max"),
        (F.max("price") - F.min("price")).cast("double").alias("range"),
    )
    if by_category:
        return moments.join(stats.quantiles(priced, "price", {"median": 0.5}, ["category"], few_groups=True), "category")
    return moments.where(F.col("count") > 0).withColumn("median", stats.quantile(priced, "price", 0.5).scalar())


def is_category(products: DataFrame, category: str) -> DataFrame:
    return products.withColumn("is_category", flag(F.col("category") == category))


def category_index(products: DataFrame) -> DataFrame:
    """Category ids from 0 in the order of each category's first product. One window row per category."""
    first = products.where(known("category")).groupBy("category").agg(F.min("product_id").alias("first_product"))
    return first.withColumn("category_id", F.row_number().over(W.orderBy("first_product")) - 1)


def linreg_price_on_category(products: DataFrame) -> DataFrame:
    """Least squares of price on category id: slope, intercept and R2, in one aggregate."""
    indexed = _indexed(products)
    y, x = F.col("price").cast("double"), F.col("category_id").cast("double")
    return indexed.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )


def linreg_fitted_prices(products: DataFrame) -> DataFrame:
    """The fitted line at every category id."""
    y, x = F.col("price").cast("double"), F.col("category_id").cast("double")
    model = _indexed(products).agg(
        F.struct(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")).alias("m")
    )
    fitted = category_index(products).withColumn("_model", model.scalar())
    return fitted.select(
        "category",
        "category_id",
        (F.col("_model.intercept") + F.col("_model.slope") * F.col("category_id")).alias("fitted_price"),
    )


def _indexed(products: DataFrame) -> DataFrame:
    return products.join(category_index(products).select("category", "category_id"), "category")
