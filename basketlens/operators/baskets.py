"""Order sizes, category combinations and the co-purchase graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.dataset import Retail
from basketlens.functions import stats
from basketlens.functions.columns import known, money, sorted_set_string
from basketlens.operators.components import components
from basketlens.operators.lines import priced_lines
from basketlens.operators.sales import top_product_filter, top_products


def positive_sizes(sizes: DataFrame) -> DataFrame:
    return sizes.where(F.col("product_count") > 0)


def order_size_distribution(sizes: DataFrame) -> DataFrame:
    """How many orders have exactly k items, empty baskets left out."""
    return stats.distribution(positive_sizes(sizes), "product_count", count_as="orders").orderBy("product_count")


def order_size_describe(sizes: DataFrame) -> DataFrame:
    return stats.describe(sizes, "product_count")


def order_category_combinations(retail: Retail) -> DataFrame:
    """Per invoice with a known category: its distinct categories as sorted text, its mall and its value.

    The set of an invoice is bounded by the number of categories, and duplicates vanish before the shuffle.
    """
    combined = (
        priced_lines(retail.lines, retail.products)
        .groupBy("invoice_no")
        .agg(sorted_set_string(F.col("category")).alias("category_combination"), money(F.sum("price")).alias("order_value"))
        .where(F.col("category_combination") != "")
    )
    malls = retail.invoices.select("invoice_no", "shopping_mall")
    return combined.join(malls, "invoice_no").select(
        "invoice_no", "category_combination", "shopping_mall", "order_value"
    )


def top_category_combinations(retail: Retail, n: int = 10) -> DataFrame:
    combined = (
        priced_lines(retail.lines, retail.products)
        .groupBy("invoice_no")
        .agg(sorted_set_string(F.col("category")).alias("category_combination"))
        .where(F.col("category_combination") != "")
    )
    counts = stats.distribution(combined, "category_combination", count_as="orders")
    return stats.top_n(counts, n, "orders", "category_combination")


def lines_by_category(retail: Retail) -> DataFrame:
    """Lines with the category in the place of the product, for co-purchase between categories."""
    categorised = priced_lines(retail.lines, retail.products).where(known("category"))
    return categorised.select("invoice_no", F.col("category").alias("product_id"))


def copurchase_nodes(lines: DataFrame, top_n: int = 15) -> DataFrame:
    return top_products(lines, top_n).withColumnRenamed("sold", "size")


def copurchase_edges(lines: DataFrame, top_n: int = 15, min_weight: int = 3) -> DataFrame:
    """Weighted edges (src <= dst) between the ``top_n`` products bought on the same invoice.

    The weight counts pairs of list positions, so two copies of a product give an edge to itself. Copies are counted
    per invoice and product before pairing: an invoice, however large, meets the self join with at most ``top_n`` rows,
    and a pair of counts stands for all its position pairs.
    """
    counts = top_product_filter(lines, top_n).groupBy("invoice_no", "product_id").agg(F.count(F.lit(1)).alias("n"))
    src = counts.select("invoice_no", F.col("product_id").alias("src"), F.col("n").alias("src_n"))
    dst = counts.select("invoice_no", F.col("product_id").alias("dst"), F.col("n").alias("dst_n"))
    same = F.col("src") == F.col("dst")
    pairs = F.when(same, F.expr("src_n * (src_n - 1) div 2")).otherwise(F.col("src_n") * F.col("dst_n"))
    return (
        src.join(dst, "invoice_no")
        .where((F.col("src") < F.col("dst")) | (same & (F.col("src_n") > 1)))
        .groupBy("src", "dst")
        .agg(F.sum(pairs).alias("weight"))
        .where(F.col("weight") >= min_weight)
    )


def edge_labels(edges: DataFrame, min_weight: int = 5) -> DataFrame:
    """Edges heavy enough to carry their weight as a label."""
    return edges.where(F.col("weight") > min_weight)


def drop_isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with at least one edge; an edge to itself counts."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("product_id"))
    return nodes.join(ends, "product_id", "left_semi")


def connected_components(edges: DataFrame) -> DataFrame:
    """(product_id, component) with the least id of each component as its label."""
    return components(edges).withColumnRenamed("node", "product_id")


def largest_component(edges: DataFrame) -> DataFrame:
    """The nodes of the component with most nodes; of equal ones, that with the least label."""
    members = connected_components(edges)
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("component_size"))
    best = stats.top_n(sizes, 1, "component_size", "component")
    return members.join(F.broadcast(best), "component")  # one row


def copurchase_network(lines: DataFrame, top_n: int = 15, min_weight: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the largest component of the co-purchase graph; both empty when no edge is heavy enough."""
    edges = copurchase_edges(lines, top_n, min_weight)
    members = largest_component(edges).select("product_id")
    nodes = copurchase_nodes(lines, top_n).join(members, "product_id", "left_semi")
    kept = edges.join(members.withColumnRenamed("product_id", "src"), "src", "left_semi")
    return nodes, kept
