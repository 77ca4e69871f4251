"""Plan properties that must hold at any size: no cross joins, pruned scans, limits before shuffles."""

import os
import re

import pytest
from pyspark.sql import functions as F

from basketlens.functions import stats
from basketlens.operators import features, lines, patterns, sales
from basketlens.plans import catalog
from basketlens.session import scratch, settle
from basketlens.sources.tables import load_retail


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# the model queries fit on building; their relational parts are covered by the queries below
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_no_cross_join(spark, sf, name):
    text = plan(catalog.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_scans_read_only_needed_columns(spark, sf):
    text = plan(patterns.category_performance(lines.category_facts(load_retail(spark, sf))))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_filters_reach_the_scan(spark, sf):
    retail = load_retail(spark, sf)
    text = plan(retail.products.where(F.col("category") == "ECONOMY"))
    assert "EqualTo(p_type,ECONOMY)" in text


def test_groups_are_limited_before_the_shuffle(spark, sf):
    retail = load_retail(spark, sf)
    counts = stats.distribution(lines.sold_lines(retail), "shopping_mall", "product_id", count_as="n")
    text = plan(stats.top_n_per_group(counts, "shopping_mall", 3, "n", "product_id"))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_top_k_sorts_no_full_table(spark, sf):
    assert "TakeOrderedAndProject" in plan(sales.top_products(load_retail(spark, sf).lines))


def test_products_are_broadcast_only_below_the_threshold(spark, sf):
    retail = load_retail(spark, sf)
    assert "BroadcastHashJoin" in plan(lines.priced_lines(retail.lines, retail.products))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastExchange" not in plan(lines.priced_lines(retail.lines, retail.products))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["rfm_describe", "rfm_histograms", "ltv_boxplot_by_class", "category_price_stats"])
def test_grouped_ranks_do_not_shuffle_rows_by_group(spark, sf, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(catalog.queries()[name](spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in text
    for column in ("metric", "ltv_class", "category"):
        assert not re.search(rf"SortMergeJoin \[{column}#\d+\], \[{column}#\d+\], Inner", text)


def test_target_window_meets_the_lines_before_they_are_summed(spark, sf):
    text = plan(features.future_ltv_target(load_retail(spark, sf)))
    assert text.count("lineitem.parquet") == 1
    above = text[: text.index("lineitem.parquet")]
    assert "Aggregate" not in above[above.rindex("Join"):]  # the scan meets the invoices of the window at once


def test_no_outer_join_meets_the_basket_texts(spark, sf):
    retail = load_retail(spark, sf)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(lines.baskets_as_text(retail.invoices, retail.lines))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftSemi" in text and "LeftAnti" in text and text.count("LeftOuter") == 1  # the one that numbers slips


@pytest.mark.parametrize("name", ["category_performance", "order_lines", "segment_price_sensitivity", "rfm", "mall_best_seller"])
def test_results_do_not_depend_on_broadcasts_or_partitions(spark, sf, name):
    build = catalog.queries()[name]
    expected = {tuple(r) for r in build(spark, sf).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert {tuple(r) for r in build(spark, sf).collect()} == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_settled_table_lies_in_the_checkpoint_folder_until_its_scope_ends(spark):
    with scratch(spark):
        settled = settle(spark.range(5))
        assert settled.count() == 5
        folder = spark.sparkContext.getCheckpointDir()
        stored = settled.inputFiles()[0].split(":", 1)[-1]
        assert folder.split(":", 1)[-1].lstrip("/") in stored
        assert os.path.exists(re.sub("^/+", "/", stored))
    assert not os.path.exists(re.sub("^/+", "/", stored))


def scans_when_run(df, column):
    """Scans that read a column in the plan as it was executed; readers of a shared exchange do not scan."""
    df.collect()
    scans, skipped = 0, None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        place = len(line) - len(line.lstrip(" :+-"))
        if skipped is not None and place >= skipped:
            continue  # inside a plan as it was before it ran, of the query or of a subquery
        skipped = place if "== Initial Plan ==" in line else None
        scans += "FileScan parquet" in line and column in line
    return scans


@pytest.mark.parametrize("name", ["descriptive_stats_levels", "price_frequency_levels"])
def test_both_levels_come_from_one_scan(spark, sf, name):
    assert scans_when_run(catalog.queries()[name](spark, sf), "p_retailprice") == 1


def test_features_and_targets_read_the_lines_once(spark, sf):
    retail = load_retail(spark, sf)
    assert scans_when_run(features.customer_profiles(retail, 6), "l_orderkey") == 1
    assert scans_when_run(features.customer_profiles(retail, 6, as_of_months=6), "l_orderkey") == 1
    assert scans_when_run(features.scores_with_target(lines.invoice_facts(retail), retail.invoices), "l_orderkey") == 1


def test_facets_are_built_before_they_are_exploded(spark, sf):
    text = plan(features.customer_profiles(load_retail(spark, sf), 6))
    assert "Generate explode(_kinds#" in text and "lambdafunction" not in text
