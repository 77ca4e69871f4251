import csv
import datetime as dt
import re
import shutil
from dataclasses import fields
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.dataset import Retail
from basketlens.operators import lines, patterns, rfm
from basketlens.plans import stages
from basketlens.sources import files, handoff, schemas
from tests.fixtures import one, rows


def write(path, header, lines):
    with open(path, "w", newline="") as handle:
        csv.writer(handle).writerows([header, *lines])
    return str(path)


@pytest.fixture
def shop_files(tmp_path):
    customers, sales = [], []
    for i in range(60):
        customers.append((("Cash", "Card")[i % 2], f"C{i}", 20 + i % 50, "FM"[i % 2]))
        for j in range(1 + i % 4):
            basket = ",".join(f"P{(i * 7 + j * k) % 5}" for k in range(1 + (i + j) % 3))
            sales.append((f"I{i}_{j}", f"C{i}", basket, f"{1 + i % 28}/{1 + (i + j * 3) % 12}/2024", ("North", "South")[j % 2]))
    sales.append(("I_empty", "C0", "", "01/01/2024", "North"))
    products = [(f"P{k}", ("Toys", "Books")[k % 2], f"{10 * (k + 1)}.5") for k in range(5)]
    return (
        # columns in another order than the schema
        write(tmp_path / "customers.csv", ["Payment method", "Customer id", "Age", "Gender"], customers),
        write(tmp_path / "products.csv", ["Product id", "Category", "Price"], products),
        write(tmp_path / "sales.csv", ["Invoice no", "Customer id", "Product id list", "Invoice date", "Shopping mall"], sales),
    )


def test_read_retail(spark, shop_files):
    retail = files.read_retail(spark, *shop_files)
    assert one(retail.customers.where("customer_id = 'C1'")) == ("C1", "M", 21, "Card")
    assert dict(retail.products.dtypes)["price"] == "decimal(12,2)"
    assert dict(retail.invoices.dtypes) == {
        "invoice_no": "string", "customer_id": "string", "invoice_date": "date", "shopping_mall": "string"
    }
    assert rows(retail.invoices.where("invoice_no = 'I_empty'"), "invoice_date") == {(dt.date(2024, 1, 1),)}
    assert retail.lines.where("invoice_no = 'I_empty'").count() == 0


def test_missing_and_malformed_inputs_fail(spark, shop_files, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        files.read_retail(spark, shop_files[0], str(tmp_path / "absent.csv"), shop_files[2])
    short = write(tmp_path / "short.csv", ["Product id", "Price"], [("P1", "1")])
    with pytest.raises(AnalysisException, match="Category"):
        files.read_products(spark, short)
    bad = write(tmp_path / "bad.csv", ["Product id", "Category", "Price"], [("P1", "x", "cheap")])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.read_products(spark, bad).collect()


def test_files_of_a_folder_must_agree_and_rows_must_be_whole(spark, tmp_path):
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    write(mixed / "a.csv", ["Product id", "Category", "Price"], [("P1", "Toys", "1")])
    write(mixed / "b.csv", ["Category", "Product id", "Price"], [("Books", "P2", "2")])
    with pytest.raises(Exception, match="(?i)header"):
        files.read_products(spark, str(mixed)).collect()
    for name, line in (("few", ("P1", "Toys")), ("many", ("P1", "Toys", "1", "more"))):
        path = write(tmp_path / f"{name}.csv", ["Product id", "Category", "Price"], [line])
        for pruned in (files.read_products(spark, path), files.read_products(spark, path).select("product_id")):
            with pytest.raises(Exception, match="(?i)malformed"):
                pruned.collect()


def sales_file(tmp_path, lines):
    return write(tmp_path / "sales.csv", [h for h, *_ in schemas.SALES], lines)


def test_repeated_invoice_counts_once_and_conflicts_fail(spark, tmp_path):
    people = write(tmp_path / "c.csv", [h for h, *_ in schemas.CUSTOMERS], [("C1", "F", 30, "Cash")])
    goods = write(tmp_path / "p.csv", [h for h, *_ in schemas.PRODUCTS], [("P1", "Toys", "10.00"), ("P2", "Books", "5.00")])
    twice = [("I1", "C1", "P1", "1/2/2024", "North"), ("I1", "C1", "P2", "1/2/2024", "North")]
    retail = files.read_retail(spark, people, goods, sales_file(tmp_path, twice))
    scores = one(rfm.rfm(lines.invoice_facts(retail), retail.invoices))
    assert (scores["frequency"], scores["monetary"]) == (1, 15.0)
    assert rows(patterns.category_performance(lines.category_facts(retail)), "category", "products_sold", "total_revenue") == {("Toys", 1, 10.0), ("Books", 1, 5.0)}
    conflict = [twice[0], ("I1", "C2", "P2", "1/2/2024", "North")]
    with pytest.raises(Exception, match="differing customer"):
        files.read_retail(spark, people, goods, sales_file(tmp_path, conflict)).invoices.collect()


def test_quoted_list_survives(spark, tmp_path):
    path = write(tmp_path / "s.csv", [h for h, *_ in schemas.SALES], [("I1", "C1", '"P1", P2', "2/3/2024", "North")])
    assert one(files.read_sales(spark, path))["product_id_list"] == '"P1", P2'


def test_reports_can_be_read_back(spark, tmp_path):
    segmented = spark.createDataFrame(
        [("C1", 3, 2, 10.5, 1, 'High "Value"')],
        "customer_id string, recency int, frequency bigint, monetary double, cluster int, segment string",
    )
    path = str(tmp_path / "out" / "segments")
    files.write_segmentation(segmented, path)
    files.write_segmentation(segmented, path)  # replaces
    assert files.read_segmentation(spark, path).collect() == segmented.collect()
    header = spark.read.text(path).first()[0]
    assert header == "Customer id,Recency,Frequency,Monetary,Cluster,Segment"


def test_stages_hand_over_through_tables(spark, shop_files, tmp_path):
    retail = files.read_retail(spark, *shop_files)
    out = str(tmp_path / "out")
    profile, segmentation, ltv, sales = stages.run_all(retail, out, max_k=3)
    for result in (profile, segmentation, ltv, sales):
        for field in fields(result):
            frame = getattr(result, field.name)
            if isinstance(frame, DataFrame):
                folder = stages.NAMED.get(field.name, (field.name,))[0]
                stored = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{out}/reports/{folder}")
                assert stored.count() == frame.count(), field.name
    assert segmentation.customers.count() == 60 and segmentation.playbook.count() % 5 == 0
    assert ltv.predictions.count() == 60
    assert one(ltv.importance.agg(F.sum("importance")))[0] == pytest.approx(1.0)
    stored = files.read_ltv_predictions(spark, f"{out}/reports/ltv_predictions")
    assert rows(stored, "customer_id", "predicted_value_class") == rows(ltv.predictions, "customer_id", "predicted_value_class")
    assert files.read_feature_importance(spark, f"{out}/reports/feature_importance").count() == ltv.importance.count()
    assert rows(files.read_segmentation(spark, f"{out}/reports/customer_segments"), "customer_id", "segment") == rows(
        segmentation.customers, "customer_id", "segment"
    )
    performance = files.read_table(spark, f"{out}/reports/category_performance", schemas.CATEGORY_PERFORMANCE)
    trends = files.read_table(spark, f"{out}/reports/sales_trends", schemas.SALES_TRENDS)
    preferences = files.read_table(spark, f"{out}/reports/segment_preferences", schemas.SEGMENT_PREFERENCES)
    assert performance.count() == 2 and preferences.count() == 2 * segmentation.customers.select("segment").distinct().count()
    total = one(performance.agg(F.sum("total_revenue")))[0]
    assert one(trends.agg(F.sum("monthly_revenue")))[0] == pytest.approx(total)
    assert one(sales.key_findings)["total_revenue"] == pytest.approx(total)
    for name in ("category_by_segment", "category_by_value_class", "segment_prices", "segment_malls", "segment_trends",
                 "seasonal_patterns", "order_sizes", "category_combinations", "growth"):
        assert getattr(sales, name).count() > 0


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_handed_off_tables_meet_without_a_shuffle(spark, shop_files, tmp_path):
    plain = files.read_retail(spark, *shop_files)
    retail, shapes = handoff.hand_off_retail(spark, *shop_files, str(tmp_path / "out"), buckets=3)
    assert rows(shapes, "table_name", "rows", "columns") == rows(lines.dataset_shapes(plain), "table_name", "rows", "columns")
    by_invoice = r"Exchange hashpartitioning\(invoice_no"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")  # products are broadcast, invoices and lines are not
    try:
        for report in (lambda r: patterns.category_performance(lines.category_facts(r)), lines.lines_with_products, lines.invoice_facts):
            text = executed(report(retail))
            assert not re.search(by_invoice, text) and "Bucketed: true" in text
            assert sorted(map(str, report(retail).collect())) == sorted(map(str, report(plain).collect()))
        assert re.search(by_invoice, executed(lines.invoice_facts(plain)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    again = Retail(retail.customers, retail.products, *(handoff.read_bucketed(spark, f"{tmp_path}/out/tables/{t}", 3) for t in ("invoices", "lines")))
    text = executed(lines.invoice_facts(again))
    assert not re.search(by_invoice, text) and again.lines.count() == retail.lines.count()


def test_lines_of_a_hot_invoice_stay_splittable(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ROWS_OF_A_TASK", 10)
    people = write(tmp_path / "c.csv", [h for h, *_ in schemas.CUSTOMERS], [("C1", "F", 30, "Cash")])
    goods = write(tmp_path / "p.csv", [h for h, *_ in schemas.PRODUCTS], [("P1", "Toys", "10.00")])
    sold = [("I1", "C1", ",".join(["P1"] * 200), "1/2/2024", "North")] + [(f"I{i}", "C1", "P1", "1/2/2024", "North") for i in range(2, 9)] + [("I9", "C1", "", "1/2/2024", "North")]
    retail, shapes = handoff.hand_off_retail(spark, people, goods, sales_file(tmp_path, sold), str(tmp_path / "out"), buckets=8)
    assert "Bucketed: true" not in executed(retail.lines.groupBy("invoice_no").count())
    assert rows(shapes, "table_name", "rows") >= {("sales", 9), ("merged", 208)}


def test_a_run_scans_each_input_once(spark, shop_files, tmp_path):
    """The inputs are gone after the hand-off, and every report of the profile still comes out."""
    copies = [shutil.copy(path, tmp_path / f"{i}.csv") for i, path in enumerate(shop_files)]
    retail, _ = handoff.hand_off_retail(spark, *map(str, copies), str(tmp_path / "out"), buckets=2)
    for path in copies:
        Path(path).unlink()
    profile = stages.run_profile(retail, str(tmp_path / "out"))
    assert profile.overview.count() > 0 and profile.mall_growth.count() > 0


def test_command_line_runs_one_stage_after_the_other(spark, shop_files, tmp_path, monkeypatch, capsys):
    import sys

    from basketlens.__main__ import main

    out = str(tmp_path / "cli")
    inputs = [x for name, path in zip(("--customers", "--products", "--sales"), shop_files) for x in (name, path)]
    for stage in ("profile", "segmentation", "ltv", "patterns"):
        monkeypatch.setattr(sys, "argv", ["basketlens", *inputs, "--out", out, "--stage", stage, "--max-k", "2", "--as-of-months", "3"])
        main()
    printed = capsys.readouterr().out
    for name in ("mall_growth", "segment_summary", "feature_importance", "key_findings"):
        assert f"{out}/reports/{name}\n" in printed
