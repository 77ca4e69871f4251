"""The three analysis stages in order. Each reads the hand-off tables of the one before and writes its own.

Hand-off tables are parquet under ``<out>/tables``; the results people read are CSV folders under ``<out>/reports``. Every
frame of a stage's result is written there in full, under its own name or the one in ``NAMED``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

from basketlens.dataset import Retail
from basketlens.functions import stats
from basketlens.operators import baskets, customers, features, lines, models, patterns, products, rfm, sales, sketches
from basketlens.sources import files

CLUSTERS = 4
TARGET_MONTHS = 6


#: Reports with a file format of their own: folder and writer.
NAMED: dict[str, tuple[str, Callable[[DataFrame, str], None]]] = {
    "customers": ("customer_segments", files.write_segmentation),
    "predictions": ("ltv_predictions", files.write_predictions),
    "importance": ("feature_importance", files.write_feature_importance),
    "category_performance": ("category_performance", files.write_category_performance),
    "top_categories_by_segment": ("segment_preferences", files.write_segment_preferences),
    "monthly_trends": ("sales_trends", files.write_sales_trends),
}


@dataclass(frozen=True)
class Profile:
    """Reports on customers, products and sales as they are, without segments or models."""

    genders: DataFrame
    payment_methods: DataFrame
    ages: DataFrame
    age_bands: DataFrame
    age_by_payment: DataFrame
    gender_by_payment: DataFrame
    age_by_payment_shares: DataFrame
    age_band_profile: DataFrame
    payment_profile: DataFrame
    categories: DataFrame
    prices: DataFrame
    price_bands: DataFrame
    category_by_band: DataFrame
    category_prices: DataFrame
    category_strategy: DataFrame
    band_top_categories: DataFrame
    price_frequencies: DataFrame
    price_frequencies_by_category: DataFrame
    price_statistics: DataFrame
    price_statistics_by_category: DataFrame
    price_regression: DataFrame
    overview: DataFrame
    orders_by_month: DataFrame
    orders_by_year_and_month: DataFrame
    orders_by_month_and_mall: DataFrame
    mall_growth: DataFrame
    mall_orders: DataFrame
    mall_statistics: DataFrame
    mall_best_sellers: DataFrame
    mall_loyalty: DataFrame
    order_size_histogram: DataFrame
    top_products: DataFrame
    product_frequencies: DataFrame
    order_frequencies: DataFrame
    top_customers_by_orders: DataFrame
    top_customers_by_products: DataFrame
    copurchase_edges: DataFrame


@dataclass(frozen=True)
class Segmentation:
    customers: DataFrame
    score_statistics: DataFrame
    score_histograms: DataFrame
    score_totals: DataFrame
    cluster_counts: DataFrame
    cluster_profile: DataFrame
    segment_summary: DataFrame
    playbook: DataFrame
    silhouette: float


@dataclass(frozen=True)
class LtvForecast:
    predictions: DataFrame
    importance: DataFrame
    regression: DataFrame
    classification: DataFrame
    summary: DataFrame
    histogram: DataFrame
    boxplot: DataFrame
    forecast: DataFrame
    upsell: DataFrame
    at_risk: DataFrame


@dataclass(frozen=True)
class SalesPatterns:
    category_performance: DataFrame
    category_by_segment: DataFrame
    category_by_value_class: DataFrame
    top_categories_by_segment: DataFrame
    segment_prices: DataFrame
    segment_malls: DataFrame
    monthly_trends: DataFrame
    seasonal_patterns: DataFrame
    segment_trends: DataFrame
    seasonal_average: DataFrame
    category_segment_matrix: DataFrame
    mall_segment_matrix: DataFrame
    segment_value_customers: DataFrame
    order_sizes: DataFrame
    order_size_summary: DataFrame
    category_combinations: DataFrame
    key_findings: DataFrame
    growth: DataFrame


def write_reports(result: object, out: str) -> dict[str, str]:
    """Writes every frame of a stage's result in full; the folder of each field."""
    written = {}
    for field in fields(result):
        value = getattr(result, field.name)
        if isinstance(value, DataFrame):
            folder, write = NAMED.get(field.name, (field.name, files.write_report))
            written[field.name] = f"{out}/reports/{folder}"
            write(value, written[field.name])
    return written


def run_profile(retail: Retail, out: str) -> Profile:
    """Demographic, price and sales reports."""
    people, goods, invoices = retail.customers, retail.products, retail.invoices
    sizes = files.hand_off(lines.invoice_sizes(retail), f"{out}/tables/invoice_sizes")
    result = Profile(
        customers.gender_distribution(people), customers.payment_distribution(people), customers.age_describe(people),
        customers.age_band_distribution(people), customers.crosstab_age_payment(people),
        customers.crosstab_gender_payment(people), customers.crosstab_age_payment_rowpct(people),
        customers.age_band_profile(people), customers.payment_profile(people),
        products.category_distribution(goods), products.price_describe(goods), products.price_band_distribution(goods),
        products.crosstab_category_band(goods), products.category_price_stats(goods), products.category_strategy(goods),
        products.price_band_top_categories(goods), products.price_frequency_table(goods),
        products.price_frequency_table(goods, by_category=True), products.descriptive_stats(goods),
        products.descriptive_stats(goods, by_category=True), products.linreg_price_on_category(goods),
        sales.sales_overview(retail), sales.monthly_orders(invoices), sales.year_month_pivot(invoices),
        sales.month_mall_pivot(invoices), sales.mall_growth_index(invoices), sales.mall_orders(invoices),
        sales.mall_stats(sizes), sales.mall_best_seller(retail), sales.mall_loyalty(invoices),
        sales.order_size_histogram(sizes), sales.top_products(retail.lines), sales.product_purchase_frequency(retail.lines),
        sales.customer_order_frequency(invoices), sales.top_customers_by_orders(invoices),
        sales.top_customers_by_products(sizes), baskets.copurchase_edges(retail.lines),
    )
    write_reports(result, out)
    return result


def run_segmentation(retail: Retail, out: str, k: int = CLUSTERS, max_k: int = 10) -> Segmentation:
    """Scores, clusters and segment names of all customers; ``max_k`` bounds the scan of cluster counts."""
    facts = lines.invoice_facts(retail)
    scores = files.hand_off(rfm.rfm(facts, retail.invoices), f"{out}/tables/rfm")
    clustered, silhouette = models.kmeans_segments(scores, k)
    clustered = files.hand_off(clustered, f"{out}/tables/clusters")
    segmented = files.hand_off(rfm.segment_rules(clustered), f"{out}/tables/segmentation")
    result = Segmentation(
        segmented, rfm.rfm_describe(scores), rfm.rfm_histograms(scores), rfm.rfm_totals(scores), models.k_scan(scores, max_k),
        rfm.cluster_profile(segmented), rfm.segment_summary(segmented), rfm.segment_playbook(segmented), silhouette,
    )
    write_reports(result, out)
    return result


def run_ltv(retail: Retail, segments: DataFrame, out: str, months: int = TARGET_MONTHS, as_of_months: int = 0) -> LtvForecast:
    """Features, target, forests and predictions. ``as_of_months`` keeps the target window out of the features."""
    described = features.customer_features(retail, segments, months, as_of_months)
    described = files.hand_off(described, f"{out}/tables/features")
    labelled = files.hand_off(features.ltv_class(described), f"{out}/tables/labelled_features")
    train, _ = models.split_train_test(labelled)
    fitted = models.train_ltv_models(train)
    predictions = files.hand_off(models.predict_customers(fitted, labelled), f"{out}/tables/ltv_predictions")
    importance = models.feature_importance(fitted)
    _, held_out = models.split_train_test(predictions)
    with_recency = labelled.select("customer_id", "recency").join(predictions, "customer_id")
    result = LtvForecast(
        predictions,
        importance,
        models.regression_metrics(held_out, "actual_ltv", "predicted_ltv"),
        models.classification_report(held_out, "actual_value_class", "predicted_value_class"),
        features.prediction_summary(predictions, "predicted_ltv", "predicted_value_class"),
        stats.histogram(predictions, "predicted_ltv", 50),
        features.ltv_boxplot_by_class(predictions, "predicted_ltv", "predicted_value_class"),
        features.highvalue_forecast(labelled),
        features.upsell_candidates(predictions, "predicted_ltv", "predicted_value_class"),
        features.at_risk_high_value(with_recency, "predicted_ltv"),
    )
    write_reports(result, out)
    return result


def run_patterns(retail: Retail, segments: DataFrame, predictions: DataFrame, out: str) -> SalesPatterns:
    """Category, segment, trend and basket analysis. The two fact tables are written once and shared by all reports;
    ``tables/customer_sketches`` answers for customers of any period without them."""
    facts = files.hand_off(lines.invoice_facts(retail), f"{out}/tables/invoice_facts")
    by_category = files.hand_off(lines.category_facts(retail), f"{out}/tables/category_facts")
    files.hand_off(sketches.customer_sketches(by_category), f"{out}/tables/customer_sketches")
    performance = patterns.category_performance(by_category)
    preferences = patterns.top_categories_by_segment(by_category, segments)
    trends = patterns.monthly_trends(facts)
    result = SalesPatterns(
        performance,
        patterns.category_by_segment(by_category, segments),
        patterns.category_by_value_class(by_category, predictions, "predicted_value_class"),
        preferences,
        patterns.segment_price_sensitivity(retail, segments),
        patterns.segment_mall_preferences(facts, segments),
        trends,
        patterns.seasonal_patterns(facts),
        patterns.segment_trends(facts, segments),
        patterns.seasonal_average(facts),
        patterns.pivot_category_segment(by_category, segments),
        patterns.pivot_mall_segment(facts, segments),
        patterns.segment_value_customers(retail.invoices, segments, predictions, "predicted_value_class"),
        baskets.order_size_distribution(facts),
        baskets.order_size_describe(facts),
        baskets.top_category_combinations(retail),
        patterns.key_findings(performance, trends),
        patterns.avg_monthly_growth(trends),
    )
    write_reports(result, out)
    return result


def run_all(
    retail: Retail, out: str, as_of_months: int = 0, max_k: int = 10
) -> tuple[Profile, Segmentation, LtvForecast, SalesPatterns]:
    profile = run_profile(retail, out)
    segmentation = run_segmentation(retail, out, max_k=max_k)
    ltv = run_ltv(retail, segmentation.customers, out, as_of_months=as_of_months)
    return profile, segmentation, ltv, run_patterns(retail, segmentation.customers, ltv.predictions, out)
