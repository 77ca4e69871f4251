import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketlens.functions import columns as C
from basketlens.functions import stats
from tests.fixtures import one, rows


def values(spark, numbers, kind="double"):
    return spark.createDataFrame([(n,) for n in numbers], f"x {kind}")


def test_bands_are_open_above_and_closed_below(spark):
    ages = values(spark, [18, 29, 30, 39, 40, 50, 59, 60, 99], "int")
    assert rows(ages.select("x", C.age_band(F.col("x")))) == {
        (18, "18-29"), (29, "18-29"), (30, "30-39"), (39, "30-39"), (40, "40-49"), (50, "50-59"), (59, "50-59"),
        (60, "60+"), (99, "60+"),
    }
    prices = values(spark, [0.0, 19.99, 20.0, 99.99, 100.0, 200.0, None])
    assert [r[0] for r in prices.select(C.price_band(F.col("x"))).collect()] == [
        "0-20", "0-20", "20-50", "50-100", "100-200", "200+", "200+"
    ]
    assert C.labelled_bands((5, 9)) == ((5, "0-5"), (9, "5-9"), (None, "9+"))


def test_dates(spark):
    frame = spark.createDataFrame([("1/2/2025",), ("01/02/2025",)], "t string")
    assert rows(frame.select(C.parse_invoice_date(F.col("t")))) == {(dt.date(2025, 2, 1),)}
    with pytest.raises(Exception, match="CANNOT_PARSE|parse"):
        spark.createDataFrame([("2025-02-01",)], "t string").select(C.parse_invoice_date(F.col("t"))).collect()
    end = spark.createDataFrame([(dt.date(2024, 8, 31),)], "d date")
    assert one(end.select(C.months_before(F.col("d"), 6)))[0] == dt.date(2024, 2, 29)
    parts = C.calendar_parts(F.col("d"))
    assert tuple(one(end.select(*parts.values()))) == (2024, 8, "2024-08", 5, 3)
    assert one(end.select(C.month_name(F.col("d"))))[0] == "Aug"


def test_baskets_and_ratios(spark):
    frame = spark.createDataFrame([('"P1, P2,"',), ("",), (None,), ("P1,P1",)], "t string")
    found = [tuple(r) for r in frame.select(C.clean_ids(F.col("t")), C.basket_size(F.col("t"))).collect()]
    assert found == [(["P1", "P2"], 3), ([], 1), (None, 0), (["P1", "P1"], 2)]
    pairs = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in pairs.select(C.safe_ratio(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0]
    assert [r[0] for r in pairs.select(C.share_percent(F.col("a"), F.col("b"))).collect()] == [50.0, None, None]


def test_sorted_set_string_drops_nulls_and_duplicates(spark):
    frame = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "x string")
    assert one(frame.agg(C.sorted_set_string(F.col("x"))))[0] == "a, b"


def test_zscore_of_constant_is_zero(spark):
    assert one(spark.range(1).select(C.zscore(F.lit(3.0), F.lit(3.0), F.lit(0.0))))[0] == 0.0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50) | st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_quantiles_equal_pandas(spark, numbers):
    numbers = [float(n) for n in numbers]
    probabilities = {"low": 0.0, "a": 0.1, "b": 0.5, "c": 0.75, "high": 1.0}
    row = one(stats.quantiles(values(spark, numbers), "x", probabilities))
    for name, p in probabilities.items():
        assert row[name] == pytest.approx(pd.Series(numbers).quantile(p), rel=1e-12, abs=1e-9)


def test_quantiles_per_group_with_hot_value_and_weights(spark):
    generator = random.Random(7)
    data = [("a", 5.0)] * 4000 + [("a", generator.uniform(0, 10)) for _ in range(3000)]
    data += [("b", float(generator.randint(0, 20))) for _ in range(2000)] + [("c", 1.5), ("a", None)]
    frame = spark.createDataFrame(data, "g string, x double")
    expected = pd.DataFrame(data, columns=["g", "x"]).groupby("g")["x"].quantile([0.25, 0.5, 0.9]).unstack()
    found = {r["g"]: (r["p"], r["q"], r["r"]) for r in stats.quantiles(frame, "x", {"p": 0.25, "q": 0.5, "r": 0.9}, ["g"]).collect()}
    assert found.keys() == {"a", "b", "c"}
    for group, triple in found.items():
        assert triple == pytest.approx(tuple(expected.loc[group]))
    counted = frame.dropna().groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    weighted = stats.quantiles(counted, "x", {"p": 0.25, "q": 0.5, "r": 0.9}, ["g"], weight="n")
    assert {r["g"]: (r["p"], r["q"], r["r"]) for r in weighted.collect()} == found


def test_quantiles_stay_exact_when_the_approximation_is_poor(spark, monkeypatch):
    monkeypatch.setattr(stats, "QUANTILE_MARGIN", -0.3)  # cuts on the wrong side: ranges turn wide
    numbers = [float(n * n % 997) for n in range(1, 2000)]
    row = one(stats.quantiles(values(spark, numbers), "x", {"a": 0.3, "b": 0.5}))
    assert tuple(row) == pytest.approx(tuple(pd.Series(numbers).quantile([0.3, 0.5])))


def test_describe_equals_pandas(spark):
    numbers = [3.0, 1.0, 4.0, 1.0, 5.0, None]
    row = one(stats.describe(values(spark, numbers), "x"))
    assert list(row) == pytest.approx(list(pd.Series(numbers).describe()))
    assert one(stats.describe(values(spark, [2.0]), "x"))["std"] is None


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 30) | st.floats(-100, 100).map(lambda x: round(x, 2)), min_size=1, max_size=80))
def test_histogram_equals_numpy(spark, numbers):
    numbers = [float(n) for n in numbers]
    counts, edges = np.histogram(numbers, bins=7)
    found = sorted(tuple(r) for r in stats.histogram(values(spark, numbers), "x", 7).collect())
    assert [r[3] for r in found] == list(counts)
    assert [r[1] for r in found] == pytest.approx(list(edges[:-1]))
    assert [r[2] for r in found] == pytest.approx(list(edges[1:]))


def test_histogram_of_two_values(spark):
    found = sorted(tuple(r) for r in stats.histogram(values(spark, [0.0, 10.0]), "x", 10).collect())
    assert [r[3] for r in found] == [1] + [0] * 8 + [1]


def test_ties_take_the_smallest_key(spark):
    frame = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "c"), ("g", "c"), ("h", "z")], "g string, x string")
    assert rows(stats.most_frequent(frame, "g", "x", "n")) == {("g", "c", 2), ("h", "z", 1)}
    tied = frame.where("x <> 'c'")
    assert rows(stats.most_frequent(tied, "g", "x", "n")) == {("g", "a", 1), ("h", "z", 1)}
    counts = stats.distribution(frame, "x", count_as="n")
    assert [tuple(r) for r in stats.top_n(counts, 2, "n", "x").collect()] == [("c", 2), ("a", 1)]


def test_distribution_drops_missing_keys(spark):
    frame = spark.createDataFrame([("a",), (None,), ("a",)], "x string")
    assert rows(stats.distribution(frame, "x")) == {("a", 2)}


def test_crosstab_fills_zeros_and_leaves_out_empty_columns(spark):
    frame = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "r string, c string")
    found = rows(stats.crosstab_long(frame, "r", "c", ["x", "y", "z"], "n"))
    assert found == {("a", "x", 2), ("a", "y", 0), ("b", "x", 0), ("b", "y", 1)}


def test_crosstab_of_present_labels_runs_nothing_while_it_is_planned(spark):
    frame = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), (None, "z"), ("a", None)], "r string, c string")
    assert rows(stats.crosstab_present(frame, "r", "c", "n")) == {("a", "x", 2), ("a", "y", 0), ("b", "x", 0), ("b", "y", 1)}
    assert stats.crosstab_present(frame.limit(0), "r", "c", "n").count() == 0
