"""Connected components of a graph given as pairs, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.session import settle


def components(pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component): each node of ``pairs`` with the least node that it is connected with."""
    return star_forest(pairs, a, b)[0]


def star_forest(pairs: DataFrame, a: str = "src", b: str = "dst") -> tuple[DataFrame, int]:
    """The components and the number of rounds they took.

    The graph is kept as edges from a node to a lesser one (``child``, ``parent``). A large star ties the greater neighbours
    of each node to its least neighbour, a small star does so with the lesser ones and the node itself. Both keep what is
    connected, and neither adds edges: a node, hub or not, sends one row per edge, and its least neighbour is found by a
    combining aggregate and joined back, which adaptive execution may split on a hub's side. So a round costs the same for a
    star as for a path, and distances shrink by powers; a hub is settled in a round or two. The rounds end when every
    component is a star around its least node. Every round is a table in the shared folder, so a lost executor costs one
    round at most.

    Defined results: a pair of equal ends makes a node of its own; a null end is no node, the other end still is; repeated
    and turned pairs count once; without pairs there are no rows.
    """
    ends = settle(pairs.select(F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")).distinct())
    nodes = ends.select(F.explode(F.array("a", "b")).alias("node")).where("node IS NOT NULL").distinct()
    proper = ends.where("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent"))
    edges, rounds = proper.distinct(), 0
    while True:
        sides = edges.select(F.col("child").alias("node"), F.col("parent").alias("near")).unionAll(edges.select("parent", "child"))
        around = settle(sides.groupBy("node").agg(
            F.min("near").alias("least"), F.count_if(F.col("near") < F.col("node")).alias("up"), F.count_if(F.col("near") > F.col("node")).alias("down")))
        if around.where("up > 1 OR (up = 1 AND down > 0)").isEmpty():
            labels = around.select("node", F.least("node", "least").alias("component"))
            alone = nodes.join(around, "node", "left_anti").select("node", F.col("node").alias("component"))
            return labels.unionAll(alone), rounds
        rounds += 1
        hubs = around.select(F.col("node").alias("parent"), "least")
        large = edges.join(hubs, "parent").select("child", F.least("parent", "least").alias("parent")).distinct()
        nearest = large.groupBy("child").agg(F.min("parent").alias("least"))
        lesser = large.join(nearest, "child").where(F.col("parent") > F.col("least")).select(F.col("parent").alias("child"), "least")
        edges = settle(lesser.unionAll(nearest).distinct().select("child", F.col("least").alias("parent")))
