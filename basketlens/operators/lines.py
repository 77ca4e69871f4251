"""Order lines: from list text to rows, and from rows to the fact relations the other operators aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.dataset import Retail
from basketlens.functions.columns import basket_size, clean_ids, raw_ids

# Items of one text row; a larger invoice is spread over several.
LINES_PER_TEXT = 1000


def lines_from_lists(sales: DataFrame) -> DataFrame:
    """(invoice_no, product_id), one row per item of the cleaned list; empty lists give no row."""
    return sales.select("invoice_no", F.explode(clean_ids(F.col("product_id_list"))).alias("product_id"))


def raw_lines_from_lists(sales: DataFrame) -> DataFrame:
    """One row per list entry as written, no trimming; a missing list keeps one row with a null product."""
    return sales.select("invoice_no", F.explode_outer(raw_ids(F.col("product_id_list"))).alias("product_id"))


def baskets_as_text(invoices: DataFrame, lines: DataFrame, lines_per_text: int = LINES_PER_TEXT) -> DataFrame:
    """(invoice_no, slip, product_id_list): the inverse of ``lines_from_lists``, a row per invoice and slip.

    An invoice of up to ``lines_per_text`` items is one slip, number 0; a larger one is spread over as many slips as that
    takes, so that no row holds it whole. An invoice without lines has slip 0 and a null text; it is added by an anti join,
    because an outer join could not split a hot invoice. Row ids of the scan spread an invoice evenly, copies included.
    """
    numbered = lines.withColumn("_row", F.monotonically_increasing_id())
    slips = lines.groupBy("invoice_no").agg(F.ceil(F.count(F.lit(1)) / lines_per_text).cast("int").alias("_slips"))
    several = slips.where(F.col("_slips") > 1)
    slip = F.when(F.col("_slips").isNull(), 0).otherwise(F.pmod(F.xxhash64("_row"), F.col("_slips"))).cast("int")
    texts = (
        numbered.join(several, "invoice_no", "left")
        .groupBy("invoice_no", slip.alias("slip"))
        .agg(F.array_join(F.array_sort(F.collect_list("product_id")).cast("array<string>"), ",").alias("product_id_list"))
    )
    known_texts = texts.join(invoices.select("invoice_no"), "invoice_no", "left_semi")
    empty = invoices.select("invoice_no").join(slips, "invoice_no", "left_anti")
    return known_texts.unionByName(empty.withColumn("slip", F.lit(0)), allowMissingColumns=True)


def basket_sizes(texts: DataFrame) -> DataFrame:
    """Items per invoice, over all its slips; a missing text counts zero."""
    return texts.groupBy("invoice_no").agg(F.sum(basket_size(F.col("product_id_list"))).alias("product_count"))


def entry_counts(texts: DataFrame) -> DataFrame:
    """One row: entries of all lists as written, and those that are left when empty ones go."""
    entries = texts.select(F.explode(raw_ids(F.translate("product_id_list", '"', ""))).alias("entry"))
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.trim("entry") != "").alias("products"))


def priced_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with category and price; an unknown product keeps its row with nulls.

    The join carries no hint: Spark broadcasts the product table while its size is below the broadcast threshold and
    shuffles beyond it, where adaptive execution splits the partitions of hot products.
    """
    return lines.join(products.select("product_id", "category", "price"), "product_id", "left")


def invoice_facts(retail: Retail) -> DataFrame:
    """One row per invoice: its attributes, product_count, revenue, and how many items have a known price.

    Lines are summed per invoice before they meet the invoices, with map-side partial sums, so an invoice that holds
    a large part of all lines is never gathered, and the join that keeps empty baskets is one row to one row.
    """
    totals = (
        priced_lines(retail.lines, retail.products)
        .groupBy("invoice_no")
        .agg(
            F.count("product_id").alias("product_count"),
            F.sum("price").alias("revenue"),
        )
    )
    return retail.invoices.join(totals, "invoice_no", "left").fillna(0, subset=["product_count", "revenue"])


def invoice_sizes(retail: Retail) -> DataFrame:
    """Invoices with their number of items; no prices are read."""
    sizes = retail.lines.groupBy("invoice_no").agg(F.count("product_id").alias("product_count"))
    return retail.invoices.join(sizes, "invoice_no", "left").fillna(0, subset=["product_count"])


def category_facts(retail: Retail) -> DataFrame:
    """One row per invoice and category sold on it: invoice attributes, items, priced items and revenue.

    As with ``invoice_facts`` the lines are summed first; an invoice then has at most one row per category.
    """
    sums = (
        priced_lines(retail.lines, retail.products)
        .where(F.col("category").isNotNull())
        .groupBy("invoice_no", "category")
        .agg(
            F.count("product_id").alias("items"),
            F.count("price").alias("priced_items"),
            F.sum("price").alias("revenue"),
        )
    )
    return sums.join(retail.invoices, "invoice_no")


def sold_lines(retail: Retail) -> DataFrame:
    """Lines with their invoice attributes. Large both ways and inner, so adaptive execution can split hot invoices."""
    return retail.lines.join(retail.invoices, "invoice_no")


def lines_with_products(retail: Retail) -> DataFrame:
    """Every line, and one null line per empty basket, with category and price.

    The empty baskets are added by an anti join instead of one outer join, because an outer join that preserves the
    invoices could not split an invoice that is hot on the line side.
    """
    sold = priced_lines(retail.lines, retail.products).join(retail.invoices, "invoice_no")
    filled = retail.lines.select("invoice_no").distinct()  # one row per invoice before the shuffle
    empty = retail.invoices.join(filled, "invoice_no", "left_anti")
    return sold.unionByName(empty, allowMissingColumns=True)


def with_customer_columns(retail: Retail, *tables: DataFrame) -> Retail:
    """The dataset with columns of tables keyed by customer on its invoices.

    What belongs to a customer joins the invoices, not the lines: lines then meet them once, on the invoice number.
    """
    invoices = retail.invoices
    for table in tables:
        invoices = invoices.join(table, "customer_id", "left")
    return Retail(retail.customers, retail.products, invoices, retail.lines)


def lines_with_customers(retail: Retail) -> DataFrame:
    """The full order-line relation: lines, invoice, product and customer attributes."""
    return lines_with_products(with_customer_columns(retail, retail.customers))


def lines_with_segment(retail: Retail, segments: DataFrame) -> DataFrame:
    return lines_with_products(with_customer_columns(retail, segments.select("customer_id", "segment")))


def lines_with_predictions(retail: Retail, predictions: DataFrame) -> DataFrame:
    columns = ["customer_id", "predicted_ltv", "predicted_value_class"]
    return lines_with_products(with_customer_columns(retail, predictions.select(*columns)))


def order_lines(retail: Retail, segments: DataFrame) -> DataFrame:
    """Lines with product, invoice and customer attributes and the customer's segment."""
    return lines_with_products(with_customer_columns(retail, retail.customers, segments.select("customer_id", "segment")))


def customer_lookup(customers: DataFrame) -> DataFrame:
    """One customers row per id: of several, the least by (age, gender, payment method)."""
    record = F.min(F.struct("age", "gender", "payment_method")).alias("_record")
    return customers.groupBy("customer_id").agg(record).select("customer_id", "_record.*")


def dataset_shapes(retail: Retail) -> DataFrame:
    """Rows and columns of each table and of the merged order lines, which are counted, not built."""
    merged = invoice_sizes(retail).agg(F.sum(F.greatest("product_count", F.lit(1))).alias("rows"))
    tables = {
        "customers": retail.customers,
        "products": retail.products,
        "sales": retail.invoices,
    }
    shapes = [
        (name, table.agg(F.count(F.lit(1)).alias("rows")), len(table.columns) + (name == "sales"))
        for name, table in tables.items()
    ]
    merged_columns = {
        *retail.invoices.columns, *retail.lines.columns, *retail.products.columns, *retail.customers.columns
    }
    shapes.append(("merged", merged, len(merged_columns)))
    result = None
    for name, count, width in shapes:
        row = count.select(F.lit(name).alias("table_name"), F.col("rows"), F.lit(width).alias("columns"))
        result = row if result is None else result.unionByName(row)
    return result
