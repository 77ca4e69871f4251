"""Customer features, the lifetime-value target and reports on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.dataset import Retail
from basketlens.fixed_values import CHURN_DAYS, HIGH, LOW, MONTHLY_GROWTH
from basketlens.functions import stats
from basketlens.functions.columns import (
    days_between,
    fill_zero,
    known,
    money,
    months_before,
    safe_ratio,
    share_percent,
    year_month,
)
from basketlens.operators.lines import customer_lookup, invoice_sizes, priced_lines
from basketlens.operators.rfm import snapshot_date

NUMERIC_FEATURES = (
    "recency",
    "frequency",
    "monetary",
    "avg_order_value",
    "tenure_days",
    "avg_days_between_orders",
    "unique_products",
    "product_categories",
    "avg_products_per_order",
    "unique_malls",
    "purchase_consistency",
    "age",
)
# The line over all classes in a summary.
ALL = "All"
CATEGORICAL_FEATURES = ("gender", "payment_method", "segment")


def recent_window(invoices: DataFrame, months: int = 6) -> DataFrame:
    """Invoices strictly later than ``months`` calendar months before the last one."""
    return invoices.where(F.col("invoice_date") > months_before(snapshot_date(invoices), months))


def favorite_mall(retail: Retail) -> DataFrame:
    """The mall where a customer bought most items; an empty basket counts as one item."""
    per_mall = invoice_sizes(retail).where(known("customer_id", "shopping_mall")).groupBy(
        "customer_id", "shopping_mall"
    ).agg(F.sum(F.greatest("product_count", F.lit(1))).alias("_rows"))
    best = per_mall.groupBy("customer_id").agg(F.min(F.struct((-F.col("_rows")).alias("n"), "shopping_mall")).alias("_b"))
    return best.select("customer_id", F.col("_b.shopping_mall").alias("favorite_mall"))


def _line_sums(retail: Retail) -> DataFrame:
    """Per invoice a row of its totals (no product), and a row for each of its products: one pass over the lines.

    Grouping sets over the priced lines, combined map-side, so an invoice with very many lines reaches the shuffle as its
    distinct products.
    """
    return priced_lines(retail.lines, retail.products).groupingSets(
        [["invoice_no"], ["invoice_no", "product_id", "category"]], "invoice_no", "product_id", "category"
    ).agg(F.grouping("product_id").alias("_whole"), F.count("product_id").alias("_items"), F.sum("price").alias("_revenue"))


def customer_profiles(retail: Retail, target_months: int | None = None, as_of_months: int = 0) -> DataFrame:
    """Recency, frequency, money and all other features of a customer that need no segment, and ``future_ltv`` with
    ``target_months``: one row per customer with invoices, from one pass over the lines.

    Every invoice gives facets of its customer: its month (with money, items, dates), its mall, and each of its products and
    categories. One aggregate per (customer, facet, value) adds up the months and makes the others distinct; a second one
    per customer reads all features off. Both combine map-side, so neither a hot invoice nor a hot customer is gathered.
    """
    invoices = retail.invoices.where(known("customer_id"))
    last = snapshot_date(invoices)
    snapshot = months_before(last, as_of_months) if as_of_months else last
    past = F.col("invoice_date") <= snapshot
    recent = F.lit(False) if target_months is None else F.col("invoice_date") > months_before(last, target_months)
    # the totals of an invoice, or the invoice alone when it has no lines, stand for it; other rows are its products
    rows = invoices.join(_line_sums(retail), "invoice_no", "left").withColumns(
        {"_past": past, "_recent": recent, "_whole": F.coalesce("_whole", F.lit(1).cast("tinyint")) == 1}
    )

    def facet(kind: str, value: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("facet"), value.cast("string").alias("value")))

    sold = ~F.col("_whole") & F.col("_past")
    kinds = F.array(
        facet("month", year_month(F.col("invoice_date")), F.col("_whole") & (F.col("_past") | F.col("_recent"))),
        facet("mall", F.col("shopping_mall"), F.col("_whole") & F.col("_past") & known("shopping_mall")),
        facet("product", F.col("product_id"), sold & known("product_id")),
        facet("category", F.col("category"), sold & known("category")),
    )
    spent = F.when(F.col("facet") == "month", F.coalesce("_revenue", F.lit(0).cast("decimal(22,2)")))
    # built in a projection of its own: inside a generator the expressions would be interpreted row by row
    facets = rows.withColumn("_kinds", kinds).withColumn("_kind", F.explode("_kinds")).where(
        F.col("_kind").isNotNull()).select("*", "_kind.*").groupBy("customer_id", "facet", "value").agg(
        F.min(F.when(F.col("_past"), F.col("invoice_date"))).alias("_first"),
        F.max(F.when(F.col("_past"), F.col("invoice_date"))).alias("_last"),
        F.count_if("_past").alias("_invoices"),
        F.sum(F.when(F.col("_past"), F.greatest(F.coalesce("_items", F.lit(0)), F.lit(1)))).alias("_rows"),
        F.sum(F.when(F.col("_past"), spent)).alias("_spent"),
        F.sum(F.when(F.col("_recent"), spent)).alias("_spent_recently"),
    )
    month = F.col("facet") == "month"
    profiles = facets.groupBy("customer_id").agg(
        days_between(F.max(F.when(month, F.col("_last"))), snapshot).alias("recency"),
        F.sum(F.when(month, F.col("_invoices"))).alias("frequency"),
        money(F.sum("_spent")).alias("monetary"),
        days_between(F.min(F.when(month, F.col("_first"))), F.max(F.when(month, F.col("_last")))).alias("tenure_days"),
        F.sum(F.when(month, F.col("_rows"))).alias("_rows"),
        F.coalesce(F.stddev_samp(F.when(month & (F.col("_invoices") > 0), F.col("_spent").cast("double"))), F.lit(0.0)).alias("purchase_consistency"),
        *(F.count_if(F.col("facet") == kind).alias(name) for kind, name in (
            ("product", "unique_products"), ("category", "product_categories"), ("mall", "unique_malls"))),
        money(F.sum("_spent_recently")).alias("future_ltv"),
    ).where(F.col("frequency") > 0)
    ratios = {
        "avg_order_value": safe_ratio(F.col("monetary"), F.col("frequency")),
        "avg_days_between_orders": safe_ratio(F.col("tenure_days"), F.col("frequency") - 1),
        "avg_products_per_order": safe_ratio(F.col("_rows"), F.col("frequency")),
    }
    profiles = profiles.withColumns(ratios).drop("_rows")
    return profiles.drop("future_ltv") if target_months is None else profiles


def with_segments(profiles: DataFrame, customers: DataFrame, segments: DataFrame) -> DataFrame:
    """The 15 features in order, and ``future_ltv`` if it is there, from profiles, demographics and segments."""
    target = [c for c in profiles.columns if c == "future_ltv"]
    joined = profiles.join(customer_lookup(customers), "customer_id", "left").join(segments.select("customer_id", "segment"), "customer_id", "left")
    return joined.select("customer_id", *NUMERIC_FEATURES, *CATEGORICAL_FEATURES, *target)


def customer_features(
    retail: Retail, segments: DataFrame, target_months: int | None = None, as_of_months: int = 0
) -> DataFrame:
    """One row per customer with invoices: 15 features, and ``future_ltv`` when ``target_months`` is given.

    The target covers the last months of the same data the features see, so by default it leaks into them.
    ``as_of_months`` computes the features only from invoices before that window; the target is unaffected.
    """
    return with_segments(customer_profiles(retail, target_months, as_of_months), retail.customers, segments)


def scores_with_target(facts: DataFrame, invoices: DataFrame, months: int = 6) -> DataFrame:
    """Recency, frequency, money and the recent spending of every customer with invoices, in one aggregate over the facts."""
    last = snapshot_date(invoices)
    recent = F.col("invoice_date") > months_before(last, months)
    return facts.where(known("customer_id")).groupBy("customer_id").agg(
        days_between(F.max("invoice_date"), last).alias("recency"), F.count("invoice_no").alias("frequency"),
        money(F.sum("revenue")).alias("monetary"), money(F.sum(F.when(recent, F.col("revenue")))).alias("future_ltv"),
    )


def future_ltv_target(retail: Retail, months: int = 6) -> DataFrame:
    """Money spent per customer in the last ``months`` months, a proxy for the future. Only buyers appear."""
    window = recent_window(retail.invoices, months).where(known("customer_id")).select("invoice_no", "customer_id")
    # only lines of the window are priced and summed; buyers of empty baskets alone still appear, with nothing spent
    spent = priced_lines(retail.lines.join(window, "invoice_no").select("customer_id", "product_id"), retail.products)
    totals = spent.groupBy("customer_id").agg(F.sum("price").alias("_spent"))
    buyers = window.select("customer_id").distinct().join(totals, "customer_id", "left")
    return buyers.select("customer_id", money(F.coalesce("_spent", F.lit(0).cast("decimal(22,2)"))).alias("future_ltv"))


def features_with_target(features: DataFrame, target: DataFrame) -> DataFrame:
    joined = features.join(target.select("customer_id", "future_ltv"), "customer_id", "left")
    return joined.withColumn("future_ltv", fill_zero(F.col("future_ltv")))


def ltv_class(df: DataFrame, value: str = "future_ltv", class_as: str = "ltv_class") -> DataFrame:
    """High strictly above the median of ``value``, else Low."""
    median = stats.quantile(df, value, 0.5).scalar()
    return df.withColumn(class_as, F.when(F.col(value) > median, HIGH).otherwise(LOW))


def encode_label(df: DataFrame, label: str = "ltv_class", code_as: str = "label") -> DataFrame:
    """Alphabetical class codes: High 0, Low 1."""
    return df.withColumn(code_as, F.when(F.col(label) == HIGH, 0).when(F.col(label) == LOW, 1))


def decode_label(df: DataFrame, code: str, label_as: str) -> DataFrame:
    return df.withColumn(label_as, F.when(F.col(code) == 0, HIGH).when(F.col(code) == 1, LOW))


def prediction_summary(df: DataFrame, value: str, value_class: str) -> DataFrame:
    """Per value class, classes without customers included: customers, percentage of all and mean value; then a line
    ``All`` over all of them."""
    sums = df.where(known(value_class)).groupBy(F.col(value_class).alias("value_class")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum(F.col(value).cast("double")).alias("_sum"), F.count(value).alias("_n")
    )
    classes = df.sparkSession.createDataFrame([(HIGH,), (LOW,)], "value_class string")
    each = classes.join(sums, "value_class", "left").fillna(0, subset=["customers"])
    overall = each.agg(F.lit(ALL).alias("value_class"), F.sum("customers").alias("customers"), F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    total = each.agg(F.sum("customers").alias("total")).scalar()
    return each.unionByName(overall).select(
        "value_class", "customers", F.try_divide("_sum", "_n").alias("avg_value"), share_percent(F.col("customers"), total).alias("share")
    )


def upsell_candidates(df: DataFrame, value: str, value_class: str) -> DataFrame:
    """Customers classed Low whose value is nevertheless positive."""
    return df.where((F.col(value_class) == LOW) & (F.col(value) > 0)).agg(F.count(F.lit(1)).alias("customers"))


def at_risk_high_value(df: DataFrame, value: str) -> DataFrame:
    """Customers silent for over CHURN_DAYS whose value lies above its upper quartile, and the money at risk."""
    bound = stats.quantile(df, value, 0.75).scalar()
    risky = df.where((F.col("recency") > CHURN_DAYS) & (F.col(value) > bound))
    total = F.sum(F.col(value).cast("decimal(20,4)"))
    return risky.agg(F.count(F.lit(1)).alias("customers"), money(total).alias("revenue_at_risk"))


def ltv_boxplot_by_class(df: DataFrame, value: str, value_class: str) -> DataFrame:
    """Per class: quartiles, whiskers (the furthest values within 1.5 interquartile ranges) and outliers."""
    box = F.broadcast(stats.quantiles(df, value, stats.SUMMARY_PROBABILITIES, [value_class], few_groups=True))  # a row per class
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = (F.col(value) >= F.col("q25") - reach) & (F.col(value) <= F.col("q75") + reach)
    return (
        df.join(box, value_class)
        .groupBy(F.col(value_class).alias("value_class"), "q25", "q50", "q75")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def highvalue_forecast(df: DataFrame, value_class: str = "ltv_class", months: int = 12) -> DataFrame:
    """Share of High customers now, and projected every third month at the assumed monthly growth."""
    ratio = df.agg(safe_ratio(F.count_if(F.col(value_class) == HIGH), F.count(F.lit(1))).alias("current_ratio"))
    steps = ratio.withColumn("month", F.explode(F.sequence(F.lit(3), F.lit(months), F.lit(3))))
    projected = F.col("current_ratio") * F.pow(F.lit(1 + MONTHLY_GROWTH), F.col("month"))
    return steps.withColumn("projected_ratio", projected).withColumn(
        "expected_growth", (F.col("projected_ratio") - F.col("current_ratio")) * 100
    )
