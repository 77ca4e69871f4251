import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from basketlens.dataset import Retail
from basketlens.operators import baskets, customers, features, lines, patterns, products, rfm, sales, sketches
from tests import fixtures
from tests.fixtures import one, rows, small_retail


@pytest.fixture(scope="module")
def shop(spark):
    return small_retail(spark)


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame([("C1", "Regular"), ("C2", "High Value"), ("C3", None)], "customer_id string, segment string")


# ------------------------------------------------------------------ lines

def test_lines_keep_empty_baskets_and_unknown_products(shop):
    found = rows(lines.lines_with_products(shop), "invoice_no", "product_id", "category")
    assert ("I3", None, None) in found and ("I5", "P9", None) in found and ("I6", "P3", "Toys") in found
    assert lines.lines_with_products(shop).count() == 3 + 1 + 1 + 3 + 2 + 2
    full = lines.lines_with_customers(shop)
    assert rows(full.where("invoice_no = 'I3'"), "customer_id", "age") == {("C2", 34)}


def test_raw_lists_are_not_cleaned(spark):
    texts = fixtures.sales(spark, [("I1", "C", '"P1, P2"', "2024-01-01", "m"), ("I2", "C", None, "2024-01-01", "m")])
    assert rows(lines.raw_lines_from_lists(texts)) == {("I1", '"P1'), ("I1", ' P2"'), ("I2", None)}
    assert rows(lines.lines_from_lists(texts)) == {("I1", "P1"), ("I1", "P2")}


def test_invoice_facts(shop):
    found = {r["invoice_no"]: (r["product_count"], float(r["revenue"])) for r in lines.invoice_facts(shop).collect()}
    assert found == {"I1": (3, 40.5), "I2": (1, 5.25), "I3": (0, 0.0), "I4": (3, 31.6), "I5": (2, 1.1), "I6": (2, 25.75)}


def test_category_facts_have_one_row_per_invoice_and_category(shop):
    found = {(r["invoice_no"], r["category"]): (r["items"], float(r["revenue"])) for r in lines.category_facts(shop).collect()}
    assert found[("I1", "Toys")] == (2, 20.0)
    assert len(found) == 2 + 1 + 3 + 1 + 2


def test_large_invoice_is_spread_over_slips(spark):
    many = spark.range(95).select(F.lit("I1").alias("invoice_no"), F.lit("P1").alias("product_id"))
    few = spark.createDataFrame([("I2", "P3"), ("I2", "P2")], "invoice_no string, product_id string")
    invoices = spark.createDataFrame([("I1",), ("I2",), ("I3",)], "invoice_no string")
    texts = lines.baskets_as_text(invoices, many.unionByName(few), lines_per_text=10)
    assert texts.columns == ["invoice_no", "slip", "product_id_list"]
    assert texts.count() == texts.select("invoice_no", "slip").distinct().count()
    assert rows(lines.basket_sizes(texts)) == {("I1", 95), ("I2", 2), ("I3", 0)}
    per_invoice = {r["invoice_no"]: r for r in texts.groupBy("invoice_no").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.length("product_id_list")).alias("longest")).collect()}
    assert 5 < per_invoice["I1"]["n"] <= 10 and per_invoice["I1"]["longest"] < 95 * 2
    assert rows(texts.where("invoice_no <> 'I1'")) == {("I2", 0, "P2,P3"), ("I3", 0, None)}
    assert lines.lines_from_lists(texts).where("invoice_no = 'I1'").count() == 95


def test_customer_lookup_takes_one_row(spark):
    twice = fixtures.customers(spark, [("C1", "M", 40, "Cash"), ("C1", "F", 30, "Card")])
    assert rows(lines.customer_lookup(twice)) == {("C1", 30, "F", "Card")}


def test_dataset_shapes(shop):
    assert rows(lines.dataset_shapes(shop)) == {("customers", 3, 4), ("products", 4, 3), ("sales", 6, 5), ("merged", 12, 10)}


# ------------------------------------------------------------------ customers and products

def test_age_band_profile_takes_smallest_method_on_tie(spark):
    people = fixtures.customers(spark, [("1", "F", 20, "Cash"), ("2", "M", 21, "Card"), ("3", None, 70, "Cash")])
    found = {r["age_band"]: r for r in customers.age_band_profile(people).collect()}
    assert found["18-29"]["payment_method"] == "Card" and found["18-29"]["customers"] == 2
    assert found["60+"]["strategy"].startswith("Simple and easy")
    profile = {r["payment_method"]: r["female_share"] for r in customers.payment_profile(people).collect()}
    assert profile == {"Cash": 100.0, "Card": 0.0}


def test_price_table_and_empty_category(spark):
    goods = fixtures.products(spark, [("A", "x", 0), ("B", "x", 10), ("C", "y", None)])
    table = products.price_frequency_table(goods).orderBy("bin").collect()
    assert [r["frequency"] for r in table] == [1] + [0] * 8 + [1]
    assert table[0]["price_range"] == "$0.00 - $1.00" and table[9]["cumulative_relative_frequency"] == 1.0
    assert products.descriptive_stats(goods, "y").collect() == []
    assert products.price_frequency_table(goods, "y").collect() == []
    single = one(products.descriptive_stats(fixtures.products(spark, [("A", "x", 3)])))
    assert (single["count"], single["std"], single["range"], single["median"]) == (1, None, 0.0, 3.0)


def test_regression_recovers_a_line(spark):
    goods = fixtures.products(spark, [("A", "x", 5), ("B", "y", 7), ("C", "z", 9), ("D", "x", 5)])
    fit = one(products.linreg_price_on_category(goods))
    assert (fit["slope"], fit["intercept"], fit["r2"]) == pytest.approx((2.0, 5.0, 1.0))
    assert {tuple(r) for r in products.linreg_fitted_prices(goods).collect()} == {("x", 0, 5.0), ("y", 1, 7.0), ("z", 2, 9.0)}


# ------------------------------------------------------------------ sales

def test_growth_on_zero_base_is_null(shop):
    found = {(r["year_month"], r["shopping_mall"]): (r["orders"], r["growth"]) for r in sales.mall_growth_index(shop.invoices).collect()}
    assert found[("2023-12", "North")] == (0, None) and found[("2024-01", "North")] == (1, None)
    assert found[("2024-01", "South")] == (0, -100.0) and found[("2024-08", "South")] == (1, 0.0)


def test_sales_reports(shop):
    overview = one(sales.sales_overview(shop))
    assert (overview["orders"], overview["customers"], overview["products"], overview["malls"]) == (6, 3, 5, 2)
    assert overview["avg_products"] == pytest.approx(11 / 6)
    assert rows(sales.mall_best_seller(shop)) == {("North", "P1", 3), ("South", "P2", 1)}
    sizes = lines.invoice_sizes(shop)
    assert rows(sales.order_size_histogram(sizes)) == {(0, 1), (1, 1), (2, 2), (3, 2)}
    assert rows(baskets.order_size_distribution(sizes)) == {(1, 1), (2, 2), (3, 2)}
    assert [tuple(r) for r in sales.top_customers_by_products(sizes, 2).collect()] == [("C2", 5), ("C1", 4)]
    assert rows(sales.mall_loyalty(shop.invoices), "malls", "customers") == {(1, 2), (2, 1)}


# ------------------------------------------------------------------ RFM and features

def test_rfm_counts_invoices_with_empty_baskets(shop):
    facts = lines.invoice_facts(shop)
    assert rows(rfm.rfm(facts, shop.invoices)) == {("C1", 179, 2, 45.75), ("C2", 0, 3, 57.35), ("C3", 251, 1, 1.1)}
    later = {r["customer_id"]: r["recency"] for r in rfm.rfm(facts, shop.invoices, dt.date(2024, 9, 10)).collect()}
    assert later == {"C1": 189, "C2": 10, "C3": 261}


def test_segment_rules_compare_strictly(spark):
    clustered = spark.createDataFrame(
        [("a", 0, 10, 1, 10.0), ("b", 1, 20, 2, 20.0), ("c", 2, 30, 3, 30.0), ("d", 3, 5, 9, 90.0), ("e", 0, 10, 1, 10.0)],
        "customer_id string, cluster int, recency int, frequency bigint, monetary double",
    )
    found = {r["cluster"]: r["segment"] for r in rfm.segment_map(clustered).collect()}
    # thresholds: R75 22.5, F75 4.5, F50 2.5, M75 45, M50 25
    assert found == {3: "High Value", 2: "At Risk", 1: "New/Low Activity", 0: "New/Low Activity"}
    same = clustered.withColumns({"recency": F.lit(1), "frequency": F.lit(1), "monetary": F.lit(1.0)})
    assert {r["segment"] for r in rfm.segment_map(same).collect()} == {"New/Low Activity"}


def test_features(shop, segments):
    found = {r["customer_id"]: r for r in features.customer_features(shop, segments, target_months=6).collect()}
    c1, c2, c3 = found["C1"], found["C2"], found["C3"]
    assert (c1["tenure_days"], c1["avg_days_between_orders"], c1["avg_order_value"]) == (60, 60.0, 22.875)
    assert c1["purchase_consistency"] == pytest.approx(35.25 / 2**0.5)  # of 40.50 and 5.25
    assert (c2["unique_products"], c2["product_categories"], c2["unique_malls"]) == (4, 3, 2)
    assert c2["avg_products_per_order"] == pytest.approx(6 / 3)  # the empty basket counts as a row
    assert (c3["avg_days_between_orders"], c3["purchase_consistency"], c3["segment"]) == (0.0, 0.0, None)
    assert (c3["unique_products"], c3["product_categories"]) == (2, 1)
    assert (c1["future_ltv"], c2["future_ltv"], c3["future_ltv"]) == (5.25, 57.35, 0.0)
    target = rows(features.future_ltv_target(shop, 6))
    assert target == {("C1", 5.25), ("C2", 57.35)}


def test_features_before_the_target_window(shop, segments):
    """The snapshot 2024-08-31 minus six months is 2024-02-29: later invoices leave the features, not the target."""
    found = {r["customer_id"]: r for r in features.customer_features(shop, segments, 6, as_of_months=6).collect()}
    assert found.keys() == {"C1", "C3"}
    assert (found["C1"]["recency"], found["C1"]["frequency"], found["C1"]["monetary"]) == (55, 1, 40.5)
    assert found["C1"]["unique_products"] == 2 and found["C1"]["unique_malls"] == 1
    assert (found["C1"]["future_ltv"], found["C3"]["future_ltv"]) == (5.25, 0.0)


def test_window_edge_is_exclusive(spark):
    invoices = fixtures.sales(spark, [
        ("I1", "C", "P", "2024-08-31", "m"), ("I2", "C", "P", "2024-02-29", "m"), ("I3", "C", "P", "2024-03-01", "m")
    ]).drop("product_id_list")
    assert rows(features.recent_window(invoices, 6), "invoice_no") == {("I1",), ("I3",)}


def test_class_at_the_median_is_low(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "customer_id string, future_ltv double")
    classes = features.ltv_class(frame)
    assert rows(classes, "customer_id", "ltv_class") == {("a", "Low"), ("b", "Low"), ("c", "High")}
    assert rows(features.encode_label(classes), "ltv_class", "label") == {("Low", 1), ("High", 0)}
    forecast = features.highvalue_forecast(classes).orderBy("month").collect()
    assert [r["month"] for r in forecast] == [3, 6, 9, 12]
    assert forecast[0]["projected_ratio"] == pytest.approx(1 / 3 * 1.02 ** 3)


def test_at_risk_and_upsell(spark):
    frame = spark.createDataFrame(
        [("a", 200, 9.0, "Low"), ("b", 200, 1.0, "Low"), ("c", 10, 99.0, "High"), ("d", 181, 8.0, "High"), ("e", 180, 8.5, "Low")],
        "customer_id string, recency int, value double, value_class string",
    )
    assert tuple(one(features.at_risk_high_value(frame, "value"))) == (0, 0.0)  # upper quartile 9, strict
    lowered = frame.withColumn("value", F.when(F.col("customer_id") == "a", 500.0).otherwise(F.col("value")))
    assert tuple(one(features.at_risk_high_value(lowered, "value"))) == (1, 500.0)
    assert one(features.upsell_candidates(frame, "value", "value_class"))[0] == 3


# ------------------------------------------------------------------ patterns

def test_category_performance(shop):
    found = {r["category"]: r for r in patterns.category_performance(lines.category_facts(shop)).collect()}
    toys = found["Toys"]
    assert (toys["products_sold"], toys["total_revenue"], toys["avg_price"]) == (5, 40.5, 8.1)
    assert (toys["transactions"], toys["unique_customers"], toys["revenue_per_transaction"]) == (4, 2, 10.125)


def test_totals_agree_between_category_month_and_segment(shop, segments):
    facts, by_category = lines.invoice_facts(shop), lines.category_facts(shop)
    by_month = one(patterns.monthly_trends(facts).agg(F.sum("monthly_revenue"), F.sum("products_sold")))
    categories = one(patterns.category_performance(by_category).agg(F.sum("total_revenue"), F.sum("products_sold")))
    assert by_month[0] == pytest.approx(categories[0])
    assert by_month[1] == categories[1] + 1  # the unknown product has no category
    with_segment = one(patterns.segment_category_preferences(by_category, segments).agg(F.sum("revenue")))[0]
    assert with_segment == pytest.approx(categories[0] - 1.1)  # C3 has no segment


def test_segment_prices(shop, segments):
    found = {r["segment"]: tuple(r)[1:] for r in patterns.segment_price_sensitivity(shop, segments).collect()}
    assert found["Regular"] == (11.44, 10.0, 6.44, 4)  # prices 10, 10, 20.5 and 5.25
    assert found["High Value"][3] == 5


def test_growth_and_findings(spark):
    months = spark.createDataFrame([("2024-01", 100.0), ("2024-02", 110.0), ("2024-03", 99.0)], "year_month string, monthly_revenue double")
    assert tuple(one(patterns.avg_monthly_growth(months))) == pytest.approx((0.0, 5.0), abs=1e-9)
    performance = spark.createDataFrame([("b", 50.0), ("a", 50.0)], "category string, total_revenue double")
    found = one(patterns.key_findings(performance, months))
    assert (found["top_category"], found["top_share"], found["first_month"], found["last_month"]) == ("a", 50.0, "2024-01", "2024-03")


# ------------------------------------------------------------------ baskets

def test_combinations(shop):
    found = rows(baskets.order_category_combinations(shop), "invoice_no", "category_combination", "order_value")
    assert ("I1", "Books, Toys", 40.5) in found and ("I5", "Food", 1.1) in found and len(found) == 5
    assert tuple(one(baskets.top_category_combinations(shop, 1))) == ("Books, Toys", 2)


def test_edges_of_a_duplicate(spark):
    frame = spark.createDataFrame([("I", "P1"), ("I", "P1"), ("I", "P2")], "invoice_no string, product_id string")
    assert rows(baskets.copurchase_edges(frame, 15, 1)) == {("P1", "P2", 2), ("P1", "P1", 1)}


def test_edges_equal_brute_force_with_a_hot_invoice(spark):
    generator = random.Random(3)
    data = [(f"I{generator.randint(0, 40)}", f"P{generator.randint(0, 12)}") for _ in range(400)]
    data += [("HOT", f"P{generator.randint(0, 12)}") for _ in range(250)]
    counts = {}
    for _, p in data:
        counts[p] = counts.get(p, 0) + 1
    top = {p for p, _ in sorted(counts.items(), key=lambda item: (-item[1], item[0]))[:8]}
    expected, by_invoice = {}, {}
    for invoice, p in data:
        if p in top:
            by_invoice.setdefault(invoice, []).append(p)
    for basket in by_invoice.values():
        for i, a in enumerate(basket):
            for b in basket[i + 1:]:
                key = (min(a, b), max(a, b))
                expected[key] = expected.get(key, 0) + 1
    frame = spark.createDataFrame(data, "invoice_no string, product_id string")
    found = {(r["src"], r["dst"]): r["weight"] for r in baskets.copurchase_edges(frame, 8, 3).collect()}
    assert found == {k: w for k, w in expected.items() if w >= 3}


def test_components_equal_union_find(spark):
    generator = random.Random(11)
    pairs = [(generator.randint(0, 150), generator.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(500, 560)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    expected = {(x, find(x)) for x in list(parent)}
    edges = spark.createDataFrame([(min(p), max(p), 1) for p in pairs], "src bigint, dst bigint, weight bigint")
    assert rows(baskets.connected_components(edges), "product_id", "component") == expected
    largest = baskets.largest_component(edges)
    sizes = {}
    for _, label in expected:
        sizes[label] = sizes.get(label, 0) + 1
    label = min(sizes, key=lambda c: (-sizes[c], c))
    assert rows(largest, "product_id") == {(x,) for x, c in expected if c == label}


def test_network_without_edges_is_empty(shop):
    nodes, edges = baskets.copurchase_network(shop.lines, 15, 100)
    assert nodes.count() == 0 and edges.count() == 0


def test_network(shop):
    nodes, edges = baskets.copurchase_network(shop.lines, 15, 2)
    assert rows(edges) == {("P1", "P2", 3)}
    assert rows(nodes) == {("P1", 3), ("P2", 3)}


def test_empty_dataset(spark):
    empty = Retail(
        fixtures.customers(spark, []), fixtures.products(spark, []),
        fixtures.sales(spark, []).drop("product_id_list"), lines.lines_from_lists(fixtures.sales(spark, [])),
    )
    facts = lines.invoice_facts(empty)
    assert patterns.category_performance(lines.category_facts(empty)).count() == 0
    assert rfm.rfm(facts, empty.invoices).count() == 0
    assert patterns.monthly_trends(facts).count() == 0
    assert one(sales.sales_overview(empty))["orders"] == 0


def test_sketches_of_days_merge_into_any_period(spark):
    days = [dt.date(2023, 1, 1) + dt.timedelta(d) for d in range(30)]
    rows = [(day, f"c{c}", k) for i, day in enumerate(days) for c in range(3) for k in range(i * 100, i * 100 + 400 * (c + 1))]
    facts = spark.createDataFrame(rows + [(None, "c0", 1), (days[0], None, 2), (days[0], "c0", None)], "invoice_date date, category string, customer_id bigint")
    table = sketches.customer_sketches(facts)
    assert table.count() == 90
    for first, last in ((0, 30), (5, 12), (29, 30)):
        inside = table.where(F.col("invoice_date").between(days[first], days[last - 1]))
        found = {r["category"]: r["approx_customers"] for r in sketches.period_customers(inside, "category").collect()}
        for c in (0, 1, 2, None):
            exact = len({k for day, name, k in rows if days[first] <= day <= days[last - 1] and name == (f"c{c}" if c is not None else name)})
            assert abs(found[f"c{c}" if c is not None else None] - exact) <= 4 * sketches.STANDARD_ERROR * exact + 1
    assert sketches.period_customers(table.limit(0), "category").where("category IS NOT NULL").count() == 0
