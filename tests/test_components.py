"""Connected components against union-find, and rounds on graphs that are hard for label propagation."""

import random

import pytest
from pyspark.sql import functions as F

from basketlens.operators.components import components, star_forest
from tests.fixtures import rows


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        ends = [find(x) for x in (a, b) if x is not None]
        if len(ends) == 2:
            parent[max(ends)] = min(ends)
    return {(x, find(x)) for x in list(parent)}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_equal_union_find(spark, seed):
    generator = random.Random(seed)
    pairs = [(f"n{generator.randint(0, 200)}", f"n{generator.randint(0, 200)}") for _ in range(60 + 60 * seed)]
    assert rows(components(spark.createDataFrame(pairs, "src string, dst string"))) == union_find(pairs)


def test_odd_pairs(spark):
    pairs = [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4), (5, None), (None, None), (3, 3)]
    frame = spark.createDataFrame([(a, b, "x") for a, b in pairs], "`a.b` bigint, dst bigint, node string")
    assert rows(components(frame, "a.b", "dst")) == {(1, 1), (2, 2), (3, 2), (4, 4), (5, 5)}
    found, rounds = star_forest(frame.limit(0), "a.b", "dst")
    assert found.count() == 0 and rounds == 0 and found.columns == ["node", "component"]


def test_hub_of_many_leaves_takes_few_rounds(spark):
    hub = 700_000  # neither the least nor the greatest
    pairs = spark.range(1_000_000).where(F.col("id") != hub).select(F.lit(hub).alias("src"), F.col("id").alias("dst"))
    found, rounds = star_forest(pairs)
    assert rounds <= 2
    assert tuple(found.agg(F.count("node"), F.min("component"), F.max("component")).first()) == (1_000_000, 0, 0)


@pytest.mark.parametrize("shuffled", [False, True])
def test_long_path_takes_rounds_by_its_logarithm(spark, shuffled):
    n = 100_000
    # 48,271 and 100,003 have no common factor, so the shuffled names are distinct
    name = (lambda c: c * 48_271 % 100_003) if shuffled else (lambda c: c)
    pairs = spark.range(n - 1).select(name(F.col("id")).alias("src"), name(F.col("id") + 1).alias("dst"))
    found, rounds = star_forest(pairs)
    assert rounds <= 20
    assert tuple(found.agg(F.count("node"), F.countDistinct("component"), F.min("component")).first()) == (n, 1, 0)
