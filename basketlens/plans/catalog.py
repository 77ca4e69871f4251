"""The registered queries: each operator over the order tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.fixed_values import (
    AGE_BAND_STRATEGIES,
    PRICE_BAND_CHARACTERS,
    PRICE_TIER_STRATEGIES,
    SEGMENT_PLAYBOOK,
)
from basketlens.functions import columns as C
from basketlens.functions import stats
from basketlens.operators import baskets, customers, features, lines, models, patterns, products, rfm, sales, sketches
from basketlens.plans.base_sql import BASE
from basketlens.plans import kmeans_sql
from basketlens.plans.views import Views
from basketlens.session import settle
from basketlens.sources import schemas
from basketlens.sources.files import with_file_headers
from basketlens.sources.tables import load_basket_texts

# All prices of the order tables lie between 900 and 1000, so bands and tiers take edges that divide this range.
BANDS = C.labelled_bands((920, 940, 960, 980))
TIERS = ((948, "Economy"), (951, "Mid-range"), (952, "Premium"), (None, "Luxury"))
CATEGORY = "ECONOMY"

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and decimals as DOUBLE, so that results compare without regard to width."""
    kinds = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}

    def cast(name: str, kind: str):
        target = "double" if kind.startswith("decimal") else kinds.get(kind)
        return F.col(f"`{name}`").cast(target).alias(name) if target else F.col(f"`{name}`")

    return df.select(*(cast(name, kind) for name, kind in df.dtypes))


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


def query(name: str, sql: str | None = None):
    """Registers a builder that takes the lazy views of a dataset; the SQL may use the base expressions."""
    def register(build: Callable[[Views], DataFrame]):
        _QUERIES[name] = build
        if sql:
            _SQL[name] = f"WITH {BASE.strip()}\n{sql.strip()}"
        return build
    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query. The queries of one call share model fits by folder; another call starts with none."""
    fits: dict[tuple, object] = {}

    def runner(build: Callable[[Views], DataFrame]):
        return lambda spark, folder: plain(build(Views(spark, folder, fits)))

    return {name: runner(build) for name, build in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _sql_texts(column: str, texts: dict[str, str]) -> str:
    arms = " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in texts.items())
    return f"CASE {column} {arms} END"


def _summary_sql(value: str, digits: int = 4) -> str:
    parts = {
        "mean": f"avg({value})", "std": f"stddev_samp({value})", "min": f"min({value})",
        "q25": f"quantile_cont({value}, 0.25)", "q50": f"quantile_cont({value}, 0.5)",
        "q75": f"quantile_cont({value}, 0.75)", "max": f"max({value})",
    }
    return f"count({value}) AS count, " + ", ".join(f"round({sql}, {digits}) AS \"{n}\"" for n, sql in parts.items())


def _rounded_summary(df: DataFrame) -> DataFrame:
    return rounded(df, 4, "mean", "std", "min", "q25", "q50", "q75", "max")


# ------------------------------------------------------------------ sources

query("dataset_shapes", """
SELECT 'customers' AS table_name, count(*) AS rows, CAST(4 AS BIGINT) AS columns FROM customers
UNION ALL SELECT 'products', count(*), 3 FROM products
UNION ALL SELECT 'sales', count(*), 5 FROM invoices
UNION ALL SELECT 'merged', count(*), 10 FROM order_lines
""")(lambda v: lines.dataset_shapes(v.retail))

# ------------------------------------------------- projections and functions

query("parse_invoice_date", "SELECT invoice_no, invoice_date FROM invoices")(
    lambda v: v.retail.invoices.withColumn("text", F.date_format("invoice_date", "dd/MM/yyyy")).select(
        "invoice_no", C.parse_invoice_date(F.col("text")).alias("invoice_date")
    )
)

query("calendar_parts", """
SELECT invoice_no, CAST(year(invoice_date) AS BIGINT) AS year, CAST(month(invoice_date) AS BIGINT) AS month, year_month,
       CAST(isodow(invoice_date) - 1 AS BIGINT) AS day_of_week, CAST(quarter(invoice_date) AS BIGINT) AS quarter
FROM invoices
""")(lambda v: v.retail.invoices.select("invoice_no", *(
    part.alias(name) for name, part in C.calendar_parts(F.col("invoice_date")).items()
)))

query("product_count", "SELECT invoice_no, product_count FROM sizes")(
    lambda v: lines.basket_sizes(load_basket_texts(v.spark, v.folder))
)


def _messy(texts: DataFrame) -> DataFrame:
    """The basket texts the way a badly exported file holds them: quoted, with blanks and a trailing comma."""
    spaced = F.regexp_replace("product_id_list", ",", " , ")
    return texts.withColumn("product_id_list", F.concat(F.lit('"'), spaced, F.lit(',"')))


query("clean_product_ids", "SELECT invoice_no, CAST(product_id AS VARCHAR) AS product_id FROM lines")(
    lambda v: lines.lines_from_lists(_messy(load_basket_texts(v.spark, v.folder)))
)

query("drop_empty_products", """
SELECT count(*) AS entries, count(product_id) AS products FROM (
  SELECT product_id FROM lines UNION ALL SELECT NULL FROM (SELECT DISTINCT invoice_no FROM lines))
""")(lambda v: lines.entry_counts(_messy(load_basket_texts(v.spark, v.folder))))

query("split_product_ids_raw", "SELECT invoice_no, CAST(product_id AS VARCHAR) AS product_id FROM order_lines")(
    lambda v: lines.raw_lines_from_lists(load_basket_texts(v.spark, v.folder))
)

query("age_band", "SELECT customer_id, age, age_band FROM banded_customers")(
    lambda v: customers.with_age_band(v.retail.customers).select("customer_id", "age", "age_band")
)

query("price_band", "SELECT product_id, CAST(price AS DOUBLE) AS price, price_band FROM banded_products")(
    lambda v: products.with_price_band(v.retail.products, BANDS).select("product_id", "price", "price_band")
)

_TIER_SQL = """CASE WHEN avg_price < 948 THEN 'Economy' WHEN avg_price < 951 THEN 'Mid-range'
       WHEN avg_price < 952 THEN 'Premium' ELSE 'Luxury' END"""

query("price_strategy_tier", f"""
SELECT category, round(avg_price, 4) AS avg_price, {_TIER_SQL} AS tier
FROM (SELECT category, CAST(sum(price) AS DOUBLE) / count(price) AS avg_price FROM products GROUP BY category)
""")(lambda v: rounded(
    products.avg_price_by_category(v.retail.products).withColumn("tier", C.price_tier(F.col("avg_price"), TIERS)),
    4, "avg_price",
))

query("age_band_strategy", f"""
SELECT age_band, count(*) AS customers, {_sql_texts('age_band', AGE_BAND_STRATEGIES)} AS strategy
FROM banded_customers GROUP BY age_band
""")(lambda v: customers.age_band_distribution(v.retail.customers).withColumn(
    "strategy", C.lookup(F.col("age_band"), AGE_BAND_STRATEGIES)
))

# the texts belong to the standard bands; prices are shifted so that every band occurs
query("price_band_character", f"""
SELECT price_band, count(*) AS products, {_sql_texts('price_band', PRICE_BAND_CHARACTERS)} AS characteristics
FROM (SELECT CASE WHEN p < 20 THEN '0-20' WHEN p < 50 THEN '20-50' WHEN p < 100 THEN '50-100' WHEN p < 200 THEN '100-200'
             ELSE '200+' END AS price_band
      FROM (SELECT (price - 900) * 3 AS p FROM products))
GROUP BY price_band
""")(lambda v: products.price_band_distribution(
    v.retail.products.withColumn("price", (F.col("price") - 900) * 3)
).withColumn("characteristics", C.lookup(F.col("price_band"), PRICE_BAND_CHARACTERS)))

_PLAYBOOK_SQL = " UNION ALL ".join(
    "SELECT '{}' AS segment, '{}' AS characteristics, {} AS step, '{}' AS recommendation".format(
        name, text, i, recommendation
    )
    for name, (text, steps) in SEGMENT_PLAYBOOK.items() for i, recommendation in enumerate(steps, 1)
)

query("segment_playbook", f"""
SELECT s.segment, s.customers, p.characteristics, CAST(p.step AS BIGINT) AS step, p.recommendation
FROM (SELECT segment, count(*) AS customers FROM segmented GROUP BY segment) s
JOIN ({_PLAYBOOK_SQL}) p ON s.segment = p.segment
""")(lambda v: rfm.segment_playbook(v.segmented))

query("log1p_features", """
SELECT customer_id, round(ln(1 + frequency), 6) AS frequency_log, round(ln(1 + monetary), 6) AS monetary_log FROM rfm
""")(lambda v: rounded(v.scores.select(
    "customer_id", F.log1p("frequency").alias("frequency_log"), F.log1p("monetary").alias("monetary_log")
), 6, "frequency_log", "monetary_log"))

query("days_between", """
SELECT customer_id, date_diff('day', min(invoice_date), max(invoice_date)) AS days FROM invoices GROUP BY customer_id
""")(lambda v: v.retail.invoices.groupBy("customer_id").agg(
    C.days_between(F.min("invoice_date"), F.max("invoice_date")).alias("days")
))

query("months_before", """
SELECT invoice_no, CAST(invoice_date - INTERVAL 6 MONTH AS DATE) AS cutoff FROM invoices
""")(lambda v: v.retail.invoices.select("invoice_no", C.months_before(F.col("invoice_date"), 6).alias("cutoff")))

query("safe_ratio", """
SELECT invoice_no, CASE WHEN product_count > 0 THEN round(revenue / product_count, 4) ELSE 0 END AS price_per_item FROM sizes
""")(lambda v: rounded(v.facts.select(
    "invoice_no", C.safe_ratio(F.col("revenue"), F.col("product_count")).alias("price_per_item")
), 4, "price_per_item"))

query("share_percent", """
SELECT customer_id, round(monetary * 100 / (SELECT sum(CAST(monetary AS DECIMAL(20,2))) FROM rfm), 6) AS share FROM rfm
""")(lambda v: rounded(v.score_table.withColumn("share", C.share_percent(
    F.col("monetary"), rfm.rfm_totals(v.score_table).select("revenue").scalar()
)).select("customer_id", "share"), 6, "share"))

query("round_n", """
SELECT product_id, CAST(round_even(price, 0) AS DOUBLE) AS half_even, CAST(round(price, 0) AS DOUBLE) AS half_up
FROM (SELECT product_id, CAST(price * 5 AS DECIMAL(14,2)) AS price FROM products)
""")(lambda v: v.retail.products.withColumn("price", F.col("price") * 5).select(
    "product_id", F.bround("price", 0).alias("half_even"), F.round("price", 0).alias("half_up")
))

query("fill_zero", "SELECT customer_id, coalesce(future_ltv, 0) AS future_ltv FROM rfm LEFT JOIN target USING (customer_id)")(
    lambda v: v.targets.select("customer_id", "future_ltv")
)

query("bool_flag", f"""
SELECT product_id, CAST(CASE WHEN category = '{CATEGORY}' THEN 1 ELSE 0 END AS BIGINT) AS is_category FROM products
""")(lambda v: products.is_category(v.retail.products, CATEGORY).select("product_id", "is_category"))

query("index_categories", """
SELECT category, min(product_id) AS first_product, row_number() OVER (ORDER BY min(product_id)) - 1 AS category_id
FROM products GROUP BY category
""")(lambda v: products.category_index(v.retail.products))

query("month_name", "SELECT invoice_no, strftime(invoice_date, '%b') AS month_name FROM invoices")(
    lambda v: v.retail.invoices.select("invoice_no", C.month_name(F.col("invoice_date")).alias("month_name"))
)

query("period_string", "SELECT invoice_no, year_month FROM invoices")(
    lambda v: v.retail.invoices.select("invoice_no", C.year_month(F.col("invoice_date")).alias("year_month"))
)

query("sorted_set_string", """
SELECT product_id, string_agg(shopping_mall, ', ' ORDER BY shopping_mall) AS malls
FROM (SELECT DISTINCT product_id, shopping_mall FROM order_lines WHERE product_id IS NOT NULL) GROUP BY product_id
""")(lambda v: lines.sold_lines(v.retail).groupBy("product_id").agg(C.sorted_set_string(F.col("shopping_mall")).alias("malls")))

query("select_rename", """
SELECT CAST(customer_id AS VARCHAR) AS "Customer id", recency AS "Recency", frequency AS "Frequency",
       monetary AS "Monetary", cluster AS "Cluster", segment AS "Segment"
FROM segmented
""")(lambda v: with_file_headers(v.segmented, schemas.SEGMENTATION))

# ------------------------------------------------------------------ filters

query("filter_category", f"""
SELECT product_id, CAST(price AS DOUBLE) AS price FROM products WHERE category = '{CATEGORY}'
""")(lambda v: products.filter_category(v.retail.products, CATEGORY).select("product_id", "price"))

query("drop_null_prices", "SELECT product_id, CAST(price AS DOUBLE) AS price FROM products WHERE price IS NOT NULL")(
    lambda v: products.drop_null_prices(v.retail.products).select("product_id", "price")
)

query("recent_window", """
SELECT invoice_no, invoice_date FROM invoices
WHERE invoice_date > CAST((SELECT day FROM snapshot) - INTERVAL 6 MONTH AS DATE)
""")(lambda v: features.recent_window(v.retail.invoices).select("invoice_no", "invoice_date"))

query("positive_sizes", "SELECT invoice_no, product_count FROM sizes WHERE product_count > 0")(
    lambda v: baskets.positive_sizes(v.sizes).select("invoice_no", "product_count")
)

query("cap_frequency", """
SELECT product_id, count(*) AS sold FROM lines GROUP BY product_id HAVING count(*) <= 30
""")(lambda v: sales.cap_frequency(sales.product_counts(v.retail.lines), 30))

_TOP_SQL = "SELECT product_id FROM lines GROUP BY product_id ORDER BY count(*) DESC, product_id LIMIT {}"

query("top_product_filter", f"SELECT invoice_no, product_id FROM lines WHERE product_id IN ({_TOP_SQL.format(15)})")(
    lambda v: sales.top_product_filter(v.retail.lines, 15).select("invoice_no", "product_id")
)

# ------------------------------------------------------------------ joins

query("lines_with_products", """
SELECT invoice_no, customer_id, invoice_date, shopping_mall, product_id, category, CAST(price AS DOUBLE) AS price
FROM order_lines
""")(lambda v: lines.lines_with_products(v.retail).select(
    "invoice_no", "customer_id", "invoice_date", "shopping_mall", "product_id", "category", "price"
))

query("lines_with_customers", """
SELECT o.invoice_no, o.product_id, o.customer_id, c.age, c.gender, c.payment_method
FROM order_lines o LEFT JOIN customers c ON o.customer_id = c.customer_id
""")(lambda v: lines.lines_with_customers(v.retail).select(
    "invoice_no", "product_id", "customer_id", "age", "gender", "payment_method"
))

query("lines_with_segment", "SELECT invoice_no, product_id, segment FROM segment_lines")(
    lambda v: lines.lines_with_segment(v.retail, v.segments).select(
        "invoice_no", "product_id", "segment"
    )
)

query("order_lines", """
SELECT o.invoice_no, o.invoice_date, o.shopping_mall, o.product_id, o.category, CAST(o.price AS DOUBLE) AS price,
       c.gender, c.age, s.segment
FROM order_lines o LEFT JOIN customers c ON o.customer_id = c.customer_id
LEFT JOIN segmented s ON o.customer_id = s.customer_id
""")(lambda v: lines.order_lines(v.retail, v.segments).select(
    "invoice_no", "invoice_date", "shopping_mall", "product_id", "category", "price", "gender", "age", "segment"
))

query("features_with_target", """
SELECT r.customer_id, r.monetary, coalesce(t.future_ltv, 0) AS future_ltv
FROM rfm r LEFT JOIN target t ON r.customer_id = t.customer_id
""")(lambda v: v.targets.select("customer_id", "monetary", "future_ltv"))

query("customer_lookup", "SELECT customer_id, age, gender, payment_method FROM customers")(
    lambda v: lines.customer_lookup(v.retail.customers)
)

query("copurchase_self_join", """
SELECT a.category AS src, b.category AS dst, CAST(sum(a.n * b.n) AS BIGINT) AS pairs
FROM (SELECT invoice_no, category, count(*) AS n FROM priced GROUP BY invoice_no, category) a
JOIN (SELECT invoice_no, category, count(*) AS n FROM priced GROUP BY invoice_no, category) b
  ON a.invoice_no = b.invoice_no AND a.category < b.category
GROUP BY a.category, b.category
""")(lambda v: baskets.copurchase_edges(baskets.lines_by_category(v.retail), min_weight=1).where(
    F.col("src") != F.col("dst")
).withColumnRenamed("weight", "pairs"))

# ------------------------------------------------------------------ customers

query("customer_count", "SELECT count(*) AS customers FROM customers")(
    lambda v: customers.customer_count(v.retail.customers)
)

query("gender_distribution", "SELECT gender, count(*) AS customers FROM customers WHERE gender IS NOT NULL GROUP BY gender")(
    lambda v: customers.gender_distribution(v.retail.customers)
)

query("payment_distribution", """
SELECT payment_method, count(*) AS customers, round(count(*) * 100 / sum(count(*)) OVER (), 4) AS share
FROM customers GROUP BY payment_method
""")(lambda v: rounded(customers.payment_distribution(v.retail.customers), 4, "share"))

query("age_describe", f"SELECT {_summary_sql('CAST(age AS DOUBLE)')} FROM customers")(
    lambda v: _rounded_summary(customers.age_describe(v.retail.customers))
)

query("age_band_distribution", "SELECT age_band, count(*) AS customers FROM banded_customers GROUP BY age_band")(
    lambda v: customers.age_band_distribution(v.retail.customers)
)

_BAND_METHOD_SQL = """
SELECT m.payment_method, b.age_band, count(c.customer_id) AS customers
FROM (SELECT DISTINCT payment_method FROM customers) m CROSS JOIN (SELECT DISTINCT age_band FROM banded_customers) b
LEFT JOIN banded_customers c ON c.payment_method = m.payment_method AND c.age_band = b.age_band
GROUP BY m.payment_method, b.age_band
"""

query("crosstab_age_payment", _BAND_METHOD_SQL)(lambda v: customers.crosstab_age_payment(v.retail.customers))

query("crosstab_gender_payment", """
SELECT m.payment_method, g.gender, count(c.customer_id) AS customers
FROM (SELECT DISTINCT payment_method FROM customers) m CROSS JOIN (SELECT DISTINCT gender FROM customers) g
LEFT JOIN customers c ON c.payment_method = m.payment_method AND c.gender = g.gender
GROUP BY m.payment_method, g.gender
""")(lambda v: customers.crosstab_gender_payment(v.retail.customers))

query("crosstab_age_payment_rowpct", f"""
SELECT payment_method, age_band, round(customers * 100 / sum(customers) OVER (PARTITION BY age_band), 1) AS share
FROM ({_BAND_METHOD_SQL})
""")(lambda v: customers.crosstab_age_payment_rowpct(v.retail.customers))

query("age_band_profile", f"""
SELECT s.age_band, s.customers, round(s.customers * 100 / (SELECT count(*) FROM customers), 4) AS share,
       f.payment_method, f.method_customers, {_sql_texts('s.age_band', AGE_BAND_STRATEGIES)} AS strategy
FROM (SELECT age_band, count(*) AS customers FROM banded_customers GROUP BY age_band) s
JOIN (SELECT age_band, payment_method, count(*) AS method_customers,
             row_number() OVER (PARTITION BY age_band ORDER BY count(*) DESC, payment_method) AS place
      FROM banded_customers GROUP BY age_band, payment_method) f
  ON s.age_band = f.age_band AND f.place = 1
""")(lambda v: rounded(customers.age_band_profile(v.retail.customers), 4, "share"))

query("payment_profile", """
SELECT payment_method, round(avg(age), 4) AS avg_age,
       round(avg(CASE WHEN gender = 'F' THEN 100.0 ELSE 0.0 END), 4) AS female_share, count(*) AS customers
FROM customers GROUP BY payment_method
""")(lambda v: rounded(customers.payment_profile(v.retail.customers), 4, "avg_age", "female_share"))

# ------------------------------------------------------------------ products

query("product_count_total", "SELECT count(*) AS products FROM products")(
    lambda v: products.product_count_total(v.retail.products)
)

query("category_list", "SELECT DISTINCT category FROM products")(lambda v: products.category_list(v.retail.products))

query("category_distribution", """
SELECT category, count(*) AS products, round(count(*) * 100 / sum(count(*)) OVER (), 4) AS share
FROM products GROUP BY category
""")(lambda v: rounded(products.category_distribution(v.retail.products), 4, "share"))

query("price_describe", f"SELECT {_summary_sql('CAST(price AS DOUBLE)')} FROM products")(
    lambda v: _rounded_summary(products.price_describe(v.retail.products))
)

query("price_band_distribution", "SELECT price_band, count(*) AS products FROM banded_products GROUP BY price_band")(
    lambda v: products.price_band_distribution(v.retail.products, BANDS)
)

query("crosstab_category_band", """
SELECT c.category, b.price_band, count(p.product_id) AS products
FROM (SELECT DISTINCT category FROM products) c CROSS JOIN (SELECT DISTINCT price_band FROM banded_products) b
LEFT JOIN banded_products p ON p.category = c.category AND p.price_band = b.price_band
GROUP BY c.category, b.price_band
""")(lambda v: products.crosstab_category_band(v.retail.products, BANDS))

query("avg_price_by_category", """
SELECT category, round(CAST(sum(price) AS DOUBLE) / count(price), 4) AS avg_price FROM products GROUP BY category
""")(lambda v: rounded(products.avg_price_by_category(v.retail.products), 4, "avg_price"))

query("category_price_stats", """
SELECT category, count(price) AS count, round(CAST(sum(price) AS DOUBLE) / count(price), 2) AS mean,
       round(stddev_samp(price), 2) AS std, round(quantile_cont(CAST(price AS DOUBLE), 0.5), 2) AS median
FROM products GROUP BY category
""")(lambda v: products.category_price_stats(v.retail.products))

query("category_strategy", f"""
SELECT *, {_sql_texts('tier', PRICE_TIER_STRATEGIES)} AS strategy
FROM (SELECT category, products, round(avg_price, 4) AS avg_price, price_std, share, {_TIER_SQL} AS tier
      FROM (SELECT category, count(*) AS products, CAST(sum(price) AS DOUBLE) / count(price) AS avg_price,
                   round(stddev_samp(price), 4) AS price_std, round(count(*) * 100 / sum(count(*)) OVER (), 4) AS share
            FROM products GROUP BY category))
""")(lambda v: rounded(products.category_strategy(v.retail.products, TIERS), 4, "avg_price", "price_std", "share"))

query("price_band_top_categories", """
SELECT price_band, category, products, CAST(place AS BIGINT) AS rank, band_products,
       round(products * 100 / band_products, 4) AS share
FROM (SELECT price_band, category, count(*) AS products, CAST(sum(count(*)) OVER (PARTITION BY price_band) AS BIGINT) AS band_products,
             row_number() OVER (PARTITION BY price_band ORDER BY count(*) DESC, category) AS place
      FROM banded_products GROUP BY price_band, category)
WHERE place <= 3
""")(lambda v: rounded(
    products.price_band_top_categories(v.retail.products, 3, BANDS).drop("characteristics"), 4, "share"
))


def _histogram_sql(source: str, value: str, bins: int) -> str:
    """bin, bin_low, bin_high, frequency by comparing every value with the bin edges."""
    return f"""
  span AS (SELECT min({value}) AS lo, max({value}) AS hi FROM {source}),
  bins AS (SELECT b AS bin, lo + b * ((hi - lo) / {bins}) AS bin_low,
                  CASE WHEN b = {bins - 1} THEN hi ELSE lo + (b + 1) * ((hi - lo) / {bins}) END AS bin_high
           FROM span CROSS JOIN range({bins}) r(b)),
  histogram AS (SELECT bin, any_value(bin_low) AS bin_low, any_value(bin_high) AS bin_high, count({value}) AS frequency
                FROM bins LEFT JOIN {source} ON {value} >= bin_low AND ({value} < bin_high OR (bin = {bins - 1} AND {value} = bin_high))
                GROUP BY bin)"""


_FREQUENCY_SQL = """
SELECT bin, format('${{:.2f}} - ${{:.2f}}', bin_low, bin_high) AS price_range, frequency,
       round(frequency / sum(frequency) OVER (), 6) AS relative_frequency,
       CAST(sum(frequency) OVER (ORDER BY bin) AS BIGINT) AS cumulative_frequency,
       round(sum(frequency) OVER (ORDER BY bin) / sum(frequency) OVER (), 6) AS cumulative_relative_frequency
FROM histogram
"""


def _frequency_table(category: str | None):
    return lambda v: rounded(
        products.price_frequency_table(v.retail.products, category),
        6, "relative_frequency", "cumulative_relative_frequency",
    )


for _name, _where, _category in (
    ("price_frequency_table", "", None),
    ("price_frequency_table_category", f"WHERE category = '{CATEGORY}'", CATEGORY),
):
    query(_name)(_frequency_table(_category))
    _SQL[_name] = (
        f"WITH {BASE.strip()},\n  prices AS (SELECT CAST(price AS DOUBLE) AS p FROM products {_where}),"
        + _histogram_sql("prices", "p", 10) + _FREQUENCY_SQL.replace("{{", "{").replace("}}", "}")
    )

query("price_frequency_by_category", """
SELECT category, bin, format('${:.2f} - ${:.2f}', bin_low, bin_high) AS price_range, frequency,
       round(frequency / sum(frequency) OVER (PARTITION BY category), 6) AS relative_frequency,
       CAST(sum(frequency) OVER (PARTITION BY category ORDER BY bin) AS BIGINT) AS cumulative_frequency,
       round(sum(frequency) OVER (PARTITION BY category ORDER BY bin) / sum(frequency) OVER (PARTITION BY category), 6) AS cumulative_relative_frequency
FROM (SELECT s.category, b.bin, any_value(b.lo) AS bin_low, any_value(b.hi) AS bin_high, count(p.price) AS frequency
      FROM (SELECT category, min(lo) AS low, max(hi) AS high FROM
              (SELECT category, CASE WHEN min(p) = max(p) THEN min(p) - 0.5 ELSE min(p) END AS lo,
                      CASE WHEN min(p) = max(p) THEN max(p) + 0.5 ELSE max(p) END AS hi
               FROM (SELECT category, CAST(price AS DOUBLE) AS p FROM products) GROUP BY category) GROUP BY category) s
      CROSS JOIN LATERAL (SELECT r.b AS bin, s.low + r.b * ((s.high - s.low) / 10) AS lo,
              CASE WHEN r.b = 9 THEN s.high ELSE s.low + (r.b + 1) * ((s.high - s.low) / 10) END AS hi FROM range(10) r(b)) b
      LEFT JOIN products p ON p.category = s.category AND CAST(p.price AS DOUBLE) >= b.lo
           AND (CAST(p.price AS DOUBLE) < b.hi OR (b.bin = 9 AND CAST(p.price AS DOUBLE) = b.hi))
      GROUP BY s.category, b.bin)
""")(lambda v: rounded(
    products.price_frequency_table(v.retail.products, by_category=True), 6, "relative_frequency", "cumulative_relative_frequency"
))

_STATS_SQL = """
SELECT count(price) AS count, round(CAST(sum(price) AS DOUBLE) / count(price), 4) AS mean,
       round(quantile_cont(CAST(price AS DOUBLE), 0.5), 4) AS median, round(stddev_samp(price), 4) AS std,
       round(var_samp(price), 4) AS variance, CAST(min(price) AS DOUBLE) AS min, CAST(max(price) AS DOUBLE) AS max,
       CAST(max(price) - min(price) AS DOUBLE) AS range
FROM products
"""

query("descriptive_stats", _STATS_SQL)(
    lambda v: rounded(products.descriptive_stats(v.retail.products), 4, "mean", "median", "std", "variance")
)

query("descriptive_stats_by_category", _STATS_SQL.replace("SELECT", "SELECT category,", 1) + "GROUP BY category")(
    lambda v: rounded(products.descriptive_stats(v.retail.products, by_category=True), 4, "mean", "median", "std", "variance")
)

query("descriptive_stats_category", _STATS_SQL + f"WHERE category = '{CATEGORY}'")(
    lambda v: rounded(products.descriptive_stats(v.retail.products, CATEGORY), 4, "mean", "median", "std", "variance")
)

query("descriptive_stats_levels", _STATS_SQL.replace("SELECT", "SELECT grouping(category) AS level, category,", 1)
      + "GROUP BY GROUPING SETS ((category), ())")(
    lambda v: rounded(products.descriptive_levels(v.retail.products), 4, "mean", "median", "std", "variance")
)

query("price_frequency_levels", """
SELECT level, category, bin, format('${:.2f} - ${:.2f}', bin_low, bin_high) AS price_range, frequency,
       round(frequency / sum(frequency) OVER every, 6) AS relative_frequency,
       CAST(sum(frequency) OVER upto AS BIGINT) AS cumulative_frequency,
       round(sum(frequency) OVER upto / sum(frequency) OVER every, 6) AS cumulative_relative_frequency
FROM (WITH leveled AS (SELECT 0 AS level, category, CAST(price AS DOUBLE) AS p FROM products
                 UNION ALL SELECT 1, NULL, CAST(price AS DOUBLE) FROM products),
edges AS (SELECT level, category, CASE WHEN min(p) = max(p) THEN min(p) - 0.5 ELSE min(p) END AS lo,
                 CASE WHEN min(p) = max(p) THEN max(p) + 0.5 ELSE max(p) END AS hi FROM leveled GROUP BY level, category),
bins AS (SELECT level, category, b AS bin, lo + b * ((hi - lo) / 10) AS bin_low,
                CASE WHEN b = 9 THEN hi ELSE lo + (b + 1) * ((hi - lo) / 10) END AS bin_high FROM edges, range(10) r(b)),
histogram AS (SELECT b.level, b.category, bin, any_value(bin_low) AS bin_low, any_value(bin_high) AS bin_high, count(p) AS frequency
              FROM bins b LEFT JOIN leveled l ON b.level = l.level AND b.category IS NOT DISTINCT FROM l.category
                   AND p >= bin_low AND (p < bin_high OR (bin = 9 AND p = bin_high)) GROUP BY b.level, b.category, bin)
 SELECT * FROM histogram) WINDOW every AS (PARTITION BY level, category), upto AS (PARTITION BY level, category ORDER BY bin)
""")(lambda v: rounded(products.price_frequency_levels(v.retail.products), 6, "relative_frequency", "cumulative_relative_frequency"))

_INDEXED_SQL = """
(SELECT CAST(p.price AS DOUBLE) AS y, CAST(i.category_id AS DOUBLE) AS x FROM products p JOIN
  (SELECT category, row_number() OVER (ORDER BY min(product_id)) - 1 AS category_id FROM products GROUP BY category) i
  ON p.category = i.category)
"""

query("linreg_price_on_category", f"""
SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2
FROM {_INDEXED_SQL}
""")(lambda v: rounded(products.linreg_price_on_category(v.retail.products), 6, "slope", "intercept", "r2"))

query("linreg_fitted_prices", f"""
SELECT i.category, i.category_id, round(m.b + m.a * i.category_id, 6) AS fitted_price
FROM (SELECT category, row_number() OVER (ORDER BY min(product_id)) - 1 AS category_id FROM products GROUP BY category) i
CROSS JOIN (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM {_INDEXED_SQL}) m
""")(lambda v: rounded(products.linreg_fitted_prices(v.retail.products), 6, "fitted_price"))

# ------------------------------------------------------------------ sales

query("monthly_orders", "SELECT year_month, count(*) AS orders FROM invoices GROUP BY year_month")(
    lambda v: sales.monthly_orders(v.retail.invoices)
)

query("year_month_pivot", "SELECT CAST(year(invoice_date) AS BIGINT) AS year, " + ", ".join(
    f"count(*) FILTER (month(invoice_date) = {m}) AS m{m}" for m in range(1, 13)
) + " FROM invoices GROUP BY year(invoice_date)")(lambda v: sales.year_month_pivot(v.retail.invoices))

_MONTH_MALL_SQL = """
SELECT y.year_month, m.shopping_mall, count(i.invoice_no) AS orders
FROM (SELECT DISTINCT year_month FROM invoices) y CROSS JOIN (SELECT DISTINCT shopping_mall FROM invoices) m
LEFT JOIN invoices i ON i.year_month = y.year_month AND i.shopping_mall = m.shopping_mall
GROUP BY y.year_month, m.shopping_mall
"""

query("month_mall_pivot", _MONTH_MALL_SQL)(lambda v: sales.month_mall_pivot(v.retail.invoices))

query("order_size_histogram", "SELECT product_count, count(*) AS orders FROM sizes GROUP BY product_count")(
    lambda v: sales.order_size_histogram(v.sizes)
)

_MALL_ORDERS_SQL = """
SELECT shopping_mall, count(*) AS orders, round(count(*) * 100 / sum(count(*)) OVER (), 4) AS share
FROM invoices GROUP BY shopping_mall
"""

query("mall_orders", "SELECT shopping_mall, count(*) AS orders FROM invoices GROUP BY shopping_mall")(
    lambda v: sales.mall_orders(v.retail.invoices).drop("share")
)

query("mall_share", _MALL_ORDERS_SQL)(lambda v: rounded(sales.mall_orders(v.retail.invoices), 4, "share"))

query("mall_avg_products", "SELECT shopping_mall, round(avg(product_count), 4) AS avg_products FROM sizes GROUP BY shopping_mall")(
    lambda v: rounded(sales.mall_avg_products(v.sizes), 4, "avg_products")
)

query("mall_growth_index", f"""
SELECT year_month, shopping_mall, orders,
       round(orders * 100 / nullif(first_value(orders) OVER (PARTITION BY shopping_mall ORDER BY year_month), 0) - 100, 4) AS growth
FROM ({_MONTH_MALL_SQL})
""")(lambda v: rounded(sales.mall_growth_index(v.retail.invoices), 4, "growth"))

query("top_products", """
SELECT product_id, count(*) AS sold FROM lines GROUP BY product_id ORDER BY sold DESC, product_id LIMIT 20
""")(lambda v: sales.top_products(v.retail.lines))

query("product_purchase_frequency", """
SELECT sold, count(*) AS products FROM (SELECT product_id, count(*) AS sold FROM lines GROUP BY product_id) GROUP BY sold
""")(lambda v: sales.product_purchase_frequency(v.retail.lines))

query("mall_best_seller", """
SELECT shopping_mall, product_id, sold
FROM (SELECT shopping_mall, product_id, count(*) AS sold,
             row_number() OVER (PARTITION BY shopping_mall ORDER BY count(*) DESC, product_id) AS place
      FROM order_lines WHERE product_id IS NOT NULL GROUP BY shopping_mall, product_id)
WHERE place = 1
""")(lambda v: sales.mall_best_seller(v.retail))

query("basket_size_distribution", """
SELECT items, count(*) AS orders FROM (SELECT invoice_no, count(*) AS items FROM lines GROUP BY invoice_no) GROUP BY items
""")(lambda v: sales.basket_size_distribution(v.retail.lines))

query("customer_order_frequency", """
SELECT orders, count(*) AS customers FROM (SELECT customer_id, count(*) AS orders FROM invoices GROUP BY customer_id) GROUP BY orders
""")(lambda v: sales.customer_order_frequency(v.retail.invoices))

query("top_customers_by_orders", """
SELECT customer_id, count(*) AS orders FROM invoices GROUP BY customer_id ORDER BY orders DESC, customer_id LIMIT 15
""")(lambda v: sales.top_customers_by_orders(v.retail.invoices))

query("top_customers_by_products", """
SELECT customer_id, count(product_id) AS items FROM order_lines WHERE product_id IS NOT NULL
GROUP BY customer_id ORDER BY items DESC, customer_id LIMIT 15
""")(lambda v: sales.top_customers_by_products(v.sizes))

query("mall_loyalty", """
SELECT malls, count(*) AS customers, round(count(*) * 100 / sum(count(*)) OVER (), 4) AS share
FROM (SELECT customer_id, count(DISTINCT shopping_mall) AS malls FROM invoices GROUP BY customer_id) GROUP BY malls
""")(lambda v: rounded(sales.mall_loyalty(v.retail.invoices), 4, "share"))

query("sales_overview", """
SELECT count(*) AS orders, min(invoice_date) AS first_date, max(invoice_date) AS last_date,
       count(DISTINCT customer_id) AS customers, (SELECT count(DISTINCT product_id) FROM lines) AS products,
       count(DISTINCT shopping_mall) AS malls, round(avg(product_count), 4) AS avg_products
FROM sizes
""")(lambda v: rounded(sales.sales_overview(v.retail), 4, "avg_products"))

query("mall_stats", """
SELECT shopping_mall, count(*) AS orders, round(avg(product_count), 4) AS avg_products, count(DISTINCT customer_id) AS customers
FROM sizes GROUP BY shopping_mall
""")(lambda v: rounded(sales.mall_stats(v.sizes), 4, "avg_products"))

# ------------------------------------------------- RFM, features and target

query("rfm", "SELECT * FROM rfm")(lambda v: v.scores)

query("rfm_describe", f"SELECT metric, {_summary_sql('value')} FROM rfm_long GROUP BY metric")(
    lambda v: _rounded_summary(rfm.rfm_describe(v.score_table))
)

query("rfm_histograms", """
SELECT g.metric, g.bin, round(lo + g.bin * width, 4) AS bin_low, round(lo + (g.bin + 1) * width, 4) AS bin_high,
       count(r.value) AS frequency
FROM (SELECT metric, b AS bin, lo, width,
             lo + b * width AS edge, CASE WHEN b = 49 THEN hi ELSE lo + (b + 1) * width END AS next_edge
      FROM (SELECT metric, min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 50 AS width
            FROM rfm_long GROUP BY metric) CROSS JOIN range(50) x(b)) g
LEFT JOIN rfm_long r ON r.metric = g.metric AND r.value >= edge AND (r.value < next_edge OR (bin = 49 AND r.value = next_edge))
GROUP BY g.metric, g.bin, g.lo, g.width
""")(lambda v: rounded(rfm.rfm_histograms(v.score_table), 4, "bin_low", "bin_high"))

query("scale_rfm", """
SELECT customer_id, round((recency - avg(recency) OVER ()) / stddev_pop(recency) OVER (), 6) AS recency_scaled,
       round((f - avg(f) OVER ()) / stddev_pop(f) OVER (), 6) AS frequency_scaled,
       round((m - avg(m) OVER ()) / stddev_pop(m) OVER (), 6) AS monetary_scaled
FROM (SELECT customer_id, recency, ln(1 + frequency) AS f, ln(1 + monetary) AS m FROM rfm)
""")(lambda v: rounded(rfm.scale_rfm(v.score_table), 6, "recency_scaled", "frequency_scaled", "monetary_scaled"))

query("cluster_profile", "SELECT cluster, " + ", ".join(
    f"round({fn}({m}), 2) AS {m}_{label}" for m in rfm.METRICS
    for label, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
) .replace("round(min(recency), 2)", "CAST(min(recency) AS DOUBLE)").replace("round(max(recency), 2)", "CAST(max(recency) AS DOUBLE)")
 .replace("round(min(frequency), 2)", "CAST(min(frequency) AS DOUBLE)").replace("round(max(frequency), 2)", "CAST(max(frequency) AS DOUBLE)")
 + ", count(*) AS customers FROM clustered GROUP BY cluster")(lambda v: rfm.cluster_profile(v.clustered))

query("cluster_sizes", "SELECT cluster, count(*) AS customers FROM clustered GROUP BY cluster")(
    lambda v: rfm.cluster_sizes(v.clustered)
)

query("segment_rules", "SELECT customer_id, cluster, segment FROM segmented")(
    lambda v: v.segmented.select("customer_id", "cluster", "segment")
)

query("segment_distribution", "SELECT segment, count(*) AS customers FROM segmented GROUP BY segment")(
    lambda v: rfm.segment_distribution(v.segmented)
)

query("segment_means", """
SELECT segment, round(avg(recency), 2) AS avg_recency, round(avg(frequency), 2) AS avg_frequency,
       round(avg(monetary), 2) AS avg_monetary, count(*) AS customers
FROM segmented GROUP BY segment
""")(lambda v: rfm.segment_means(v.segmented))

query("rfm_totals", """
SELECT count(*) AS customers, CAST(sum(CAST(monetary AS DECIMAL(20,2))) AS DOUBLE) AS revenue,
       round(CAST(sum(CAST(monetary AS DECIMAL(20,2))) AS DOUBLE) / count(*), 4) AS revenue_per_customer
FROM rfm
""")(lambda v: rounded(rfm.rfm_totals(v.scores), 4, "revenue_per_customer"))

query("segment_summary", """
SELECT segment, count(*) AS customers, CAST(sum(CAST(monetary AS DECIMAL(20,2))) AS DOUBLE) AS total_revenue,
       round(avg(monetary), 2) AS avg_revenue, round(avg(frequency), 2) AS avg_frequency, round(avg(recency), 2) AS avg_recency,
       round(CAST(sum(CAST(monetary AS DECIMAL(20,2))) AS DOUBLE) * 100
             / CAST(sum(sum(CAST(monetary AS DECIMAL(20,2)))) OVER () AS DOUBLE), 2) AS revenue_share,
       round(count(*) * 100 / sum(count(*)) OVER (), 2) AS customer_share
FROM segmented GROUP BY segment
""")(lambda v: rfm.segment_summary(v.segmented))

_FEATURE_ROUNDING = ("avg_order_value", "avg_days_between_orders", "avg_products_per_order", "purchase_consistency")

query("customer_features", """
SELECT customer_id, recency, frequency, monetary, round(avg_order_value, 4) AS avg_order_value, tenure_days,
       round(avg_days_between_orders, 4) AS avg_days_between_orders, unique_products, product_categories,
       round(avg_products_per_order, 4) AS avg_products_per_order, unique_malls,
       round(purchase_consistency, 4) AS purchase_consistency, age, gender, payment_method, segment, future_ltv
FROM features
""")(lambda v: rounded(v.features, 4, *_FEATURE_ROUNDING))

query("favorite_mall", """
SELECT customer_id, shopping_mall AS favorite_mall
FROM (SELECT customer_id, shopping_mall,
             row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, shopping_mall) AS place
      FROM order_lines GROUP BY customer_id, shopping_mall)
WHERE place = 1
""")(lambda v: features.favorite_mall(v.retail))

query("future_ltv_target", "SELECT customer_id, future_ltv FROM target")(
    lambda v: features.future_ltv_target(v.retail)
)

query("ltv_class", "SELECT customer_id, future_ltv, ltv_class FROM labelled")(
    lambda v: v.classes.select("customer_id", "future_ltv", "ltv_class")
)

query("encode_label", """
SELECT customer_id, CAST(CASE ltv_class WHEN 'High' THEN 0 ELSE 1 END AS BIGINT) AS label, ltv_class AS decoded FROM labelled
""")(lambda v: features.decode_label(features.encode_label(v.classes), "label", "decoded").select(
    "customer_id", "label", "decoded"
))

query("prediction_summary_actual", """
SELECT c.value_class, count(ltv_class) AS customers, round(avg(future_ltv), 4) AS avg_value,
       round(count(ltv_class) * 100 / (SELECT count(*) FROM labelled), 4) AS share
FROM (SELECT 'High' AS value_class UNION ALL SELECT 'Low' UNION ALL SELECT 'All') c
LEFT JOIN labelled ON c.value_class IN (ltv_class, 'All') GROUP BY c.value_class
""")(lambda v: rounded(features.prediction_summary(v.classes, "future_ltv", "ltv_class"), 4, "avg_value", "share"))

query("upsell_candidates_actual", """
SELECT count(*) AS customers FROM labelled WHERE ltv_class = 'Low' AND future_ltv > 0
""")(lambda v: features.upsell_candidates(v.classes, "future_ltv", "ltv_class"))

query("at_risk_high_value_actual", """
SELECT count(*) AS customers, CAST(coalesce(sum(CAST(monetary AS DECIMAL(20,4))), 0) AS DOUBLE) AS revenue_at_risk
FROM rfm WHERE recency > 180 AND monetary > (SELECT quantile_cont(monetary, 0.75) FROM rfm)
""")(lambda v: features.at_risk_high_value(v.score_table, "monetary"))

query("at_risk_future_ltv", """
SELECT count(*) AS customers, CAST(coalesce(sum(CAST(future_ltv AS DECIMAL(20,4))), 0) AS DOUBLE) AS revenue_at_risk
FROM labelled WHERE recency > 180 AND future_ltv > (SELECT quantile_cont(future_ltv, 0.75) FROM labelled)
""")(lambda v: features.at_risk_high_value(v.target_table, "future_ltv"))

query("ltv_boxplot_by_class", """
SELECT l.ltv_class AS value_class, round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75,
       min(future_ltv) FILTER (future_ltv BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS whisker_low,
       max(future_ltv) FILTER (future_ltv BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS whisker_high,
       count(*) FILTER (future_ltv NOT BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS outliers
FROM labelled l JOIN (SELECT ltv_class, quantile_cont(future_ltv, 0.25) AS q25, quantile_cont(future_ltv, 0.5) AS q50,
                             quantile_cont(future_ltv, 0.75) AS q75 FROM labelled GROUP BY ltv_class) q
  ON l.ltv_class = q.ltv_class
GROUP BY l.ltv_class, q25, q50, q75
""")(lambda v: rounded(features.ltv_boxplot_by_class(v.classes, "future_ltv", "ltv_class"), 4, "q25", "q50", "q75"))

query("highvalue_forecast", """
SELECT CAST(month AS BIGINT) AS month, round(r, 6) AS current_ratio, round(r * pow(1.02, month), 6) AS projected_ratio,
       round((r * pow(1.02, month) - r) * 100, 4) AS expected_growth
FROM (SELECT count(*) FILTER (ltv_class = 'High') / count(*) AS r FROM labelled) CROSS JOIN range(3, 13, 3) m(month)
""")(lambda v: rounded(
    rounded(features.highvalue_forecast(v.classes), 6, "current_ratio", "projected_ratio"), 4, "expected_growth"
))

# ------------------------------------------------------------------ baskets

query("order_size_distribution", """
SELECT product_count, count(*) AS orders FROM sizes WHERE product_count > 0 GROUP BY product_count
""")(lambda v: baskets.order_size_distribution(v.sizes))

query("order_size_describe", f"SELECT {_summary_sql('CAST(product_count AS DOUBLE)')} FROM sizes")(
    lambda v: _rounded_summary(baskets.order_size_describe(v.sizes))
)

_COMBINATION_SQL = """
SELECT invoice_no, string_agg(category, ', ' ORDER BY category) AS category_combination
FROM (SELECT DISTINCT invoice_no, category FROM priced WHERE category IS NOT NULL) GROUP BY invoice_no
"""

query("order_category_combinations", f"""
SELECT c.invoice_no, c.category_combination, s.shopping_mall, s.revenue AS order_value
FROM ({_COMBINATION_SQL}) c JOIN sizes s ON c.invoice_no = s.invoice_no
""")(lambda v: baskets.order_category_combinations(v.retail))

query("top_category_combinations", f"""
SELECT category_combination, count(*) AS orders FROM ({_COMBINATION_SQL})
GROUP BY category_combination ORDER BY orders DESC, category_combination LIMIT 10
""")(lambda v: baskets.top_category_combinations(v.retail))

query("copurchase_nodes", """
SELECT product_id, count(*) AS size FROM lines GROUP BY product_id ORDER BY size DESC, product_id LIMIT 15
""")(lambda v: baskets.copurchase_nodes(v.retail.lines))


def _edges_sql(source: str, top: int, weight: int) -> str:
    """Edges by numbering the lines and pairing positions, the definition itself."""
    return f"""
  tops AS (SELECT product_id FROM {source} GROUP BY product_id ORDER BY count(*) DESC, product_id LIMIT {top}),
  placed AS (SELECT invoice_no, product_id, row_number() OVER (ORDER BY invoice_no) AS place FROM {source}
             WHERE product_id IN (SELECT product_id FROM tops)),
  edges AS (SELECT least(a.product_id, b.product_id) AS src, greatest(a.product_id, b.product_id) AS dst, count(*) AS weight
            FROM placed a JOIN placed b ON a.invoice_no = b.invoice_no AND a.place < b.place
            GROUP BY 1, 2 HAVING count(*) >= {weight})"""


_CATEGORY_SOURCE = "\n  by_category AS (SELECT invoice_no, category AS product_id FROM priced WHERE category IS NOT NULL),"
# no pair of the top products is frequent in the order tables, so the product graph takes more products and any weight
_PRODUCT_EDGES = _edges_sql("lines", 200, 1)
_CATEGORY_EDGES = _CATEGORY_SOURCE + _edges_sql("by_category", 15, 3)


def _graph_query(name: str, edges: str, select: str):
    def register(build):
        query(name)(build)
        _SQL[name] = f"WITH RECURSIVE {BASE.strip()},{edges}\n{select.strip()}"
        return build
    return register


_graph_query("copurchase_edges", _PRODUCT_EDGES, "SELECT src, dst, weight FROM edges")(
    lambda v: baskets.copurchase_edges(v.retail.lines, 200, 1)
)

_graph_query("copurchase_edges_default", _edges_sql("lines", 15, 3), "SELECT src, dst, weight FROM edges")(
    lambda v: baskets.copurchase_edges(v.retail.lines)
)

_graph_query("category_copurchase_edges", _CATEGORY_EDGES, "SELECT src, dst, weight FROM edges")(
    lambda v: baskets.copurchase_edges(baskets.lines_by_category(v.retail))
)

_graph_query("min_edge_weight", _CATEGORY_SOURCE + _edges_sql("by_category", 15, 5000), "SELECT src, dst, weight FROM edges")(
    lambda v: baskets.copurchase_edges(baskets.lines_by_category(v.retail), min_weight=5000)
)

_graph_query("edge_labels", _CATEGORY_EDGES, "SELECT src, dst, weight FROM edges WHERE weight > 5")(
    lambda v: baskets.edge_labels(baskets.copurchase_edges(baskets.lines_by_category(v.retail)))
)

_graph_query("drop_isolates", _PRODUCT_EDGES, """
SELECT product_id, count(*) AS size FROM lines
WHERE product_id IN (SELECT src FROM edges UNION ALL SELECT dst FROM edges) GROUP BY product_id
""")(lambda v: baskets.drop_isolates(
    baskets.copurchase_nodes(v.retail.lines, 200), baskets.copurchase_edges(v.retail.lines, 200, 1)
))

_COMPONENT_SQL = """,
  links AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
  reach AS (SELECT src AS root, src AS node FROM links UNION SELECT r.root, l.dst FROM reach r JOIN links l ON r.node = l.src),
  components AS (SELECT node AS product_id, min(root) AS component FROM reach GROUP BY node),
  component_sizes AS (SELECT component, count(*) AS component_size FROM components GROUP BY component)
"""

_graph_query("connected_components", _edges_sql("lines", 60, 1) + _COMPONENT_SQL, "SELECT product_id, component FROM components")(
    lambda v: baskets.connected_components(baskets.copurchase_edges(v.retail.lines, 60, 1))
)

_graph_query("largest_component", _edges_sql("lines", 60, 1) + _COMPONENT_SQL, """
SELECT c.product_id, c.component, s.component_size
FROM components c JOIN component_sizes s ON c.component = s.component
WHERE c.component = (SELECT component FROM component_sizes ORDER BY component_size DESC, component LIMIT 1)
""")(lambda v: baskets.largest_component(baskets.copurchase_edges(v.retail.lines, 60, 1)))

# ------------------------------------------------------------------ patterns

query("category_performance", """
SELECT *, total_revenue / transactions AS revenue_per_transaction
FROM (SELECT category, count(product_id) AS products_sold, round(CAST(sum(price) AS DOUBLE), 2) AS total_revenue,
             round(CAST(sum(price) AS DOUBLE) / count(price), 2) AS avg_price, count(DISTINCT invoice_no) AS transactions,
             count(DISTINCT customer_id) AS unique_customers
      FROM order_lines WHERE category IS NOT NULL GROUP BY category)
""")(lambda v: patterns.category_performance(v.category_facts))

query("category_by_segment", """
SELECT category, segment, CAST(sum(price) AS DOUBLE) AS segment_revenue, count(price) AS products_sold,
       count(DISTINCT customer_id) AS unique_customers
FROM segment_lines WHERE category IS NOT NULL AND segment IS NOT NULL GROUP BY category, segment
""")(lambda v: patterns.category_by_segment(v.category_facts, v.segments))

query("category_by_value_class", """
SELECT category, ltv_class, CAST(sum(price) AS DOUBLE) AS value_class_revenue, count(price) AS products_sold,
       count(DISTINCT customer_id) AS unique_customers
FROM class_lines WHERE category IS NOT NULL GROUP BY category, ltv_class
""")(lambda v: patterns.category_by_value_class(v.category_facts, v.classes, "ltv_class"))

_PREFERENCES_SQL = """
SELECT segment, category, CAST(sum(price) AS DOUBLE) AS revenue, count(product_id) AS products_sold,
       count(DISTINCT customer_id) AS unique_customers
FROM segment_lines WHERE category IS NOT NULL GROUP BY segment, category
"""

query("segment_category_preferences", _PREFERENCES_SQL)(
    lambda v: patterns.segment_category_preferences(v.category_facts, v.segments)
)

query("top_categories_by_segment", f"""
SELECT segment, category, revenue, products_sold, unique_customers
FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY revenue DESC, category) AS place FROM ({_PREFERENCES_SQL}))
WHERE place <= 3
""")(lambda v: patterns.top_categories_by_segment(v.category_facts, v.segments))

query("segment_price_sensitivity", """
SELECT segment, round(CAST(sum(price) AS DOUBLE) / count(price), 2) AS avg_price,
       round(quantile_cont(CAST(price AS DOUBLE), 0.5), 2) AS median_price, round(stddev_samp(price), 2) AS price_std,
       count(product_id) AS products_sold
FROM segment_lines GROUP BY segment
""")(lambda v: patterns.segment_price_sensitivity(v.retail, v.segments))

query("segment_mall_preferences", """
SELECT segment, shopping_mall, CAST(coalesce(sum(price), 0) AS DOUBLE) AS revenue, count(DISTINCT invoice_no) AS transactions
FROM segment_lines GROUP BY segment, shopping_mall
""")(lambda v: patterns.segment_mall_preferences(v.facts, v.segments))

_TRENDS_SQL = """
SELECT year_month, CAST(coalesce(sum(price), 0) AS DOUBLE) AS monthly_revenue, count(DISTINCT invoice_no) AS transactions,
       count(product_id) AS products_sold, count(DISTINCT customer_id) AS unique_customers, year_month AS year_month_str
FROM order_lines GROUP BY year_month
"""

query("monthly_trends", _TRENDS_SQL)(lambda v: patterns.monthly_trends(v.facts))

_SEASON_SQL = """
SELECT CAST(year(invoice_date) AS BIGINT) AS year, CAST(month(invoice_date) AS BIGINT) AS month,
       CAST(coalesce(sum(price), 0) AS DOUBLE) AS revenue, count(DISTINCT invoice_no) AS transactions
FROM order_lines GROUP BY year(invoice_date), month(invoice_date)
"""

@query("customers_by_sketch", """
SELECT year, category, count(DISTINCT customer_id) AS customers, TRUE AS within_error
FROM (SELECT CAST(extract(year FROM invoice_date) AS BIGINT) AS year, category, customer_id FROM order_lines WHERE category IS NOT NULL AND customer_id IS NOT NULL)
GROUP BY GROUPING SETS ((year, category), ())
""")
def _customers_by_sketch(v: Views) -> DataFrame:
    """The merged sketches of days against exact counts: within four standard errors (and one customer)."""
    days = settle(sketches.customer_sketches(v.category_facts))
    year = F.year("invoice_date").alias("year")
    estimated = sketches.period_customers(days, year, "category")
    exact = v.category_facts.where("invoice_date IS NOT NULL AND category IS NOT NULL AND customer_id IS NOT NULL").select(year, "category", "customer_id").distinct()
    counted = exact.groupBy("year", "category").agg(F.count("*").alias("customers")).unionByName(
        exact.agg(F.count_distinct("customer_id").alias("customers")).select(F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("category"), "customers"))
    same = counted["year"].eqNullSafe(estimated["year"]) & counted["category"].eqNullSafe(estimated["category"])
    bound = 1 + 4 * sketches.STANDARD_ERROR * F.col("customers")
    return counted.join(estimated, same).select(
        counted["year"], counted["category"], "customers", (F.abs(F.col("approx_customers") - F.col("customers")) <= bound).alias("within_error"))


query("seasonal_patterns", _SEASON_SQL)(lambda v: patterns.seasonal_patterns(v.facts))

query("seasonal_average", f"""
SELECT month, round(avg(revenue), 4) AS avg_revenue, round(avg(transactions), 4) AS avg_transactions,
       strftime(make_date(2000, month, 1), '%b') AS month_name
FROM ({_SEASON_SQL}) GROUP BY month
""")(lambda v: rounded(patterns.seasonal_average(v.facts), 4, "avg_revenue", "avg_transactions"))

query("segment_trends", """
SELECT year_month, segment, CAST(coalesce(sum(price), 0) AS DOUBLE) AS revenue, count(DISTINCT invoice_no) AS transactions
FROM segment_lines GROUP BY year_month, segment
""")(lambda v: patterns.segment_trends(v.facts, v.segments))

_SEGMENT_COLUMNS = ", ".join(
    f"CAST(coalesce(sum(price) FILTER (segment = '{s}'), 0) AS DOUBLE) AS \"{s}\"" for s in SEGMENT_PLAYBOOK
)

query("pivot_category_segment", f"SELECT category, {_SEGMENT_COLUMNS} FROM segment_lines WHERE category IS NOT NULL GROUP BY category")(
    lambda v: patterns.pivot_category_segment(v.category_facts, v.segments)
)

query("pivot_mall_segment", f"SELECT shopping_mall, {_SEGMENT_COLUMNS} FROM segment_lines GROUP BY shopping_mall")(
    lambda v: patterns.pivot_mall_segment(v.facts, v.segments)
)

query("segment_value_customers", """
SELECT segment, count(*) FILTER (ltv_class = 'High') AS "High", count(*) FILTER (ltv_class = 'Low') AS "Low"
FROM labelled GROUP BY segment
""")(lambda v: patterns.segment_value_customers(v.retail.invoices, v.segments, v.classes, "ltv_class"))

query("key_findings", """
SELECT first(category ORDER BY revenue DESC, category) AS top_category, max(revenue) AS top_revenue,
       round(max(revenue) * 100 / sum(revenue), 4) AS top_share, round(sum(revenue), 2) AS total_revenue, count(*) AS categories,
       (SELECT min(year_month) FROM order_lines) AS first_month, (SELECT max(year_month) FROM order_lines) AS last_month
FROM (SELECT category, round(CAST(sum(price) AS DOUBLE), 2) AS revenue FROM order_lines WHERE category IS NOT NULL GROUP BY category)
""")(lambda v: rounded(patterns.key_findings(
    patterns.category_performance(v.category_facts), patterns.monthly_trends(v.facts)
), 4, "top_share"))

query("avg_monthly_growth", f"""
SELECT round(avg(growth) * 100, 4) AS avg_growth, round(greatest(avg(growth) * 100, 5), 4) AS headline_growth
FROM (SELECT monthly_revenue / lag(monthly_revenue) OVER (ORDER BY year_month) - 1 AS growth FROM ({_TRENDS_SQL}))
""")(lambda v: rounded(patterns.avg_monthly_growth(patterns.monthly_trends(v.facts)), 4, "avg_growth", "headline_growth"))

# ------------------------------------------------------------------ models

_LEVELS = {
    "gender": ("M",),
    "payment_method": ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
    "segment": ("High Value", "New/Low Activity", "Regular"),
}


def _feature_matrix(v: Views) -> DataFrame:
    encoder = models.FeatureEncoder.fit(v.labelled)
    scaled = [f"{name}_scaled" for name in encoder.moments]
    flags = encoder.names[len(scaled):]
    encoded = encoder.transform(v.labelled).select("customer_id", *scaled, *(F.col(f"`{name}`") for name in flags))
    return rounded(encoded, 6, *scaled)


query("feature_matrix", "SELECT customer_id, " + ", ".join(
    f"round(({name} - avg({name}) OVER ()) / stddev_pop({name}) OVER (), 6) AS {name}_scaled"
    for name in features.NUMERIC_FEATURES
) + ", " + ", ".join(
    f"CAST(CASE WHEN {name} = '{level}' THEN 1 ELSE 0 END AS DOUBLE) AS \"{name}_{level}\""
    for name, levels in _LEVELS.items() for level in levels
) + " FROM labelled")(_feature_matrix)

# the metrics on a prediction that SQL can make too: total spending as the forecast of the recent spending
query("regression_metrics", """
SELECT count(*) AS customers, round(sqrt(avg(pow(future_ltv - monetary, 2))), 4) AS rmse,
       round(1 - avg(pow(future_ltv - monetary, 2)) / var_pop(future_ltv), 6) AS r2
FROM labelled
""")(lambda v: rounded(
    rounded(models.regression_metrics(v.target_table, "future_ltv", "monetary"), 4, "rmse"), 6, "r2"
))

query("classification_report", """
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, support
FROM (SELECT label, count(*) FILTER (ltv_class = label AND spend_class = label) / count(*) FILTER (spend_class = label) AS p,
             count(*) FILTER (ltv_class = label AND spend_class = label) / count(*) FILTER (ltv_class = label) AS r,
             count(*) FILTER (ltv_class = label) AS support
      FROM labelled CROSS JOIN (SELECT 'High' AS label UNION ALL SELECT 'Low') GROUP BY label)
UNION ALL
SELECT 'accuracy', round(a, 6), round(a, 6), round(a, 6), n
FROM (SELECT count(*) FILTER (ltv_class = spend_class) / count(*) AS a, count(*) AS n FROM labelled)
UNION ALL
SELECT k.label, round(sum(p * w), 6), round(sum(r * w), 6), round(sum(2 * p * r / (p + r) * w), 6), CAST(sum(support) AS BIGINT)
FROM (SELECT c.label AS class, k.label, p, r, support, CASE k.label WHEN 'macro avg' THEN 0.5 ELSE support / sum(support) OVER (PARTITION BY k.label) END AS w
      FROM (SELECT label, count(*) FILTER (ltv_class = label AND spend_class = label) / count(*) FILTER (spend_class = label) AS p,
                   count(*) FILTER (ltv_class = label AND spend_class = label) / count(*) FILTER (ltv_class = label) AS r,
                   count(*) FILTER (ltv_class = label) AS support
            FROM labelled CROSS JOIN (SELECT 'High' AS label UNION ALL SELECT 'Low') GROUP BY label) c
      CROSS JOIN (SELECT 'macro avg' AS label UNION ALL SELECT 'weighted avg') k) k
GROUP BY k.label
""")(lambda v: rounded(models.classification_report(
    features.ltv_class(v.classes, "monetary", "spend_class"), "ltv_class", "spend_class"
), 6, "precision", "recall", "f1"))

# Model fits have no SQL.


def _fitted(v: Views, what: str, fit: Callable[[], object]):
    key = (v.spark.sparkContext.applicationId, v.folder, what)
    if key not in v.fits:
        v.fits[key] = fit()
    return v.fits[key]


def _ltv(v: Views) -> tuple[models.LtvModels, DataFrame, DataFrame]:
    """The fitted forests, the predictions for all customers, and those for the held-out ones."""
    def fit():
        train, _ = models.split_train_test(v.labelled)
        fitted = models.train_ltv_models(train)
        predictions = settle(models.predict_customers(fitted, v.labelled))
        return fitted, predictions, models.split_train_test(predictions)[1]
    return _fitted(v, "ltv", fit)


def _clusters(v: Views) -> tuple[DataFrame, float]:
    def fit():
        clustered, silhouette = models.kmeans_segments(v.score_table)
        return settle(clustered), silhouette
    return _fitted(v, "clusters", fit)


def _price_clusters(v: Views) -> tuple[DataFrame, DataFrame]:
    return _fitted(v, "price clusters", lambda: models.kmeans_price(v.retail.products))


def _logistic(v: Views):
    return _fitted(v, "logistic", lambda: models.logistic_category_on_price(v.retail.products, CATEGORY))


_NEWTON = f"""WITH RECURSIVE moments AS (SELECT avg(CAST(price AS DOUBLE)) AS mean, stddev_pop(CAST(price AS DOUBLE)) AS scale FROM products),
points AS MATERIALIZED (SELECT (CAST(price AS DOUBLE) - mean) / scale AS z, CASE WHEN category = '{CATEGORY}' THEN 1.0 ELSE 0.0 END AS y,
  1 / (scale * scale) AS penalty, CAST(count(*) AS DOUBLE) AS n FROM products, moments GROUP BY ALL),
steps AS (SELECT 0 AS step, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b
  UNION ALL
  SELECT step + 1, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
    SELECT step, a, b, sum(n * (p - y)) AS g0, sum(n * (p - y) * z) + any_value(penalty) * b AS g1, sum(n * p * (1 - p)) AS h00,
      sum(n * p * (1 - p) * z) AS h01, sum(n * p * (1 - p) * z * z) + any_value(penalty) AS h11
    FROM (SELECT *, 1 / (1 + exp(-(a + b * z))) AS p FROM steps, points WHERE step < 30) GROUP BY step, a, b)),
fit AS (SELECT b / scale AS coefficient, a - b * mean / scale AS intercept FROM steps, moments WHERE step = 30)"""

query("logistic_category_on_price", f"""
SELECT * FROM ({_NEWTON}
  SELECT '{CATEGORY}' AS category, round(avg(CASE WHEN (intercept + coefficient * CAST(price AS DOUBLE) > 0) = (category = '{CATEGORY}') THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
    round(any_value(coefficient), 6) AS coefficient, round(any_value(intercept), 6) AS intercept FROM products, fit)
""")(lambda v: rounded(models.logistic_report(v.retail.products, CATEGORY, _logistic(v)), 6, "accuracy", "coefficient", "intercept"))

query("logistic_curve", f"""
SELECT * FROM ({_NEWTON}, span AS (SELECT CAST(min(price) AS DOUBLE) AS low, CAST(max(price) AS DOUBLE) AS high FROM products),
  grid AS (SELECT point, low + point * (high - low) / 299 AS price FROM span, (SELECT unnest(range(300)) AS point))
  SELECT point, round(price, 6) AS price, round(1 / (1 + exp(-(intercept + coefficient * price))), 6) AS probability FROM grid, fit)
""")(lambda v: rounded(models.logistic_curve(v.retail.products, _logistic(v)), 6, "price", "probability"))
_PRICE_FIT = kmeans_sql.fitted(
    "SELECT product_id AS id, CAST(price AS DOUBLE) / (SELECT stddev_pop(CAST(price AS DOUBLE)) FROM products) AS x0 FROM products", 1, [3])
_SEGMENT_FIT = kmeans_sql.fitted(kmeans_sql.SCALED_SCORES, 3, [4])

query("kmeans_price", f"""
SELECT p.product_id, CAST(p.price AS DOUBLE) AS price, cluster FROM products p JOIN (WITH {_PRICE_FIT}
  SELECT id, min({{'d': round((p.x0 - l.x0) * (p.x0 - l.x0), 9), 'c': cluster}}).c AS cluster
  FROM (SELECT row_number() OVER (ORDER BY x0) - 1 AS cluster, x0 FROM centres) l, points p GROUP BY id) a ON a.id = p.product_id
""")(lambda v: _price_clusters(v)[0])

query("kmeans_price_centers", f"""
SELECT cluster, round(x0 * (SELECT stddev_pop(CAST(price AS DOUBLE)) FROM products), 4) AS center
FROM (WITH {_PRICE_FIT} SELECT row_number() OVER (ORDER BY x0) - 1 AS cluster, x0 FROM centres)
""")(lambda v: rounded(_price_clusters(v)[1], 4, "center"))

query("k_scan", f"""
SELECT k, round(cost, 4) AS wcss, round(s, 6) AS silhouette_sq_euclidean
FROM (WITH {kmeans_sql.fitted(kmeans_sql.SCALED_SCORES, 3, range(2, 11))}, {kmeans_sql.silhouettes(3)} SELECT * FROM costs JOIN silhouettes USING (k))
""")(lambda v: rounded(rounded(models.k_scan(v.score_table), 4, "wcss"), 6, "silhouette_sq_euclidean"))

#: ``clustered`` as the base expressions have it, by quartiles, and by k-means with clusters in the order of money spent.
_QUARTILES = BASE[BASE.index("clustered AS ("):BASE.index("cluster_means AS (")]
_BY_KMEANS = f"""clustered AS (
  SELECT r.*, cluster FROM rfm r JOIN (SELECT id, dense_rank() OVER (ORDER BY spent, c) - 1 AS cluster FROM (
    WITH {_SEGMENT_FIT} SELECT id, c, avg(monetary) OVER (PARTITION BY c) AS spent FROM assigned JOIN rfm ON customer_id = id)) a ON a.id = r.customer_id),
"""

query("kmeans_segments", "SELECT customer_id, recency, frequency, monetary, cluster, segment FROM segmented")(
    lambda v: rfm.segment_rules(_clusters(v)[0]))
query("kmeans_cluster_profile")(lambda v: rfm.cluster_profile(_clusters(v)[0]))
query("kmeans_segment_summary")(lambda v: rfm.segment_summary(rfm.segment_rules(_clusters(v)[0])))
_SQL["kmeans_cluster_profile"], _SQL["kmeans_segment_summary"] = _SQL["cluster_profile"], _SQL["segment_summary"]
for _name in ("kmeans_segments", "kmeans_cluster_profile", "kmeans_segment_summary"):
    _SQL[_name] = _SQL[_name].replace(_QUARTILES, _BY_KMEANS)

query("silhouette", f"""
SELECT count(*) AS customers, round(any_value(s), 6) AS silhouette_sq_euclidean
FROM (WITH {_SEGMENT_FIT}, {kmeans_sql.silhouettes(3)} SELECT id, s FROM assigned JOIN silhouettes USING (k))
""")(lambda v: _clusters(v)[0].groupBy().agg(F.count(F.lit(1)).alias("customers")).withColumn(
    "silhouette_sq_euclidean", F.round(F.lit(float(_clusters(v)[1])), 6)
))
query("split_train_test", """
SELECT customer_id, CASE WHEN CAST('0x' || substr(md5('42:' || customer_id), 1, 6) AS BIGINT) / 16777216 < 0.2 THEN 'test' ELSE 'train' END AS side
FROM rfm
""")(lambda v: models.split_train_test(v.target_table)[0].select("customer_id", F.lit("train").alias("side")).unionByName(
    models.split_train_test(v.target_table)[1].select("customer_id", F.lit("test").alias("side"))
))
query("train_ltv_regressor")(lambda v: models.regression_metrics(_ltv(v)[2], "actual_ltv", "predicted_ltv"))
query("train_value_classifier")(
    lambda v: models.classification_report(_ltv(v)[2], "actual_value_class", "predicted_value_class")
)
query("feature_importance")(lambda v: models.feature_importance(_ltv(v)[0]))
query("predict_customers")(lambda v: _ltv(v)[1])
query("prediction_summary")(lambda v: features.prediction_summary(_ltv(v)[1], "predicted_ltv", "predicted_value_class"))
query("prediction_histogram")(lambda v: stats.histogram(_ltv(v)[1], "predicted_ltv", 50))
query("upsell_candidates")(lambda v: features.upsell_candidates(_ltv(v)[1], "predicted_ltv", "predicted_value_class"))
query("at_risk_high_value")(lambda v: features.at_risk_high_value(
    v.labelled.select("customer_id", "recency").join(_ltv(v)[1], "customer_id"), "predicted_ltv"
))
query("predicted_ltv_boxplot")(
    lambda v: features.ltv_boxplot_by_class(_ltv(v)[1], "predicted_ltv", "predicted_value_class")
)
query("lines_with_predictions")(lambda v: lines.lines_with_predictions(v.retail, _ltv(v)[1]))
query("category_by_predicted_class")(
    lambda v: patterns.category_by_value_class(v.category_facts, _ltv(v)[1], "predicted_value_class")
)
