"""Small literal frames for the operator tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from basketlens.dataset import Retail
from basketlens.operators.lines import lines_from_lists


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def customers(spark, rows):
    return spark.createDataFrame(rows, "customer_id string, gender string, age int, payment_method string")


def products(spark, rows):
    return spark.createDataFrame(
        [(p, c, None if price is None else Decimal(str(price))) for p, c, price in rows],
        "product_id string, category string, price decimal(12,2)",
    )


def sales(spark, rows):
    return spark.createDataFrame(
        [(i, c, t, day(d), m) for i, c, t, d, m in rows],
        "invoice_no string, customer_id string, product_id_list string, invoice_date date, shopping_mall string",
    )


def retail(spark, customer_rows, product_rows, sales_rows) -> Retail:
    all_sales = sales(spark, sales_rows)
    return Retail(
        customers(spark, customer_rows), products(spark, product_rows), all_sales.drop("product_id_list"),
        lines_from_lists(all_sales),
    )


def small_retail(spark) -> Retail:
    """Three customers, four products, six invoices, among them an empty basket, a duplicate and an unknown product."""
    return retail(
        spark,
        [("C1", "F", 25, "Cash"), ("C2", "M", 34, "Credit Card"), ("C3", "F", 61, "Cash")],
        [("P1", "Toys", 10.00), ("P2", "Books", 20.50), ("P3", "Toys", 5.25), ("P4", "Food", 1.10)],
        [
            ("I1", "C1", "P1,P1,P2", "2024-01-05", "North"),
            ("I2", "C1", "P3", "2024-03-05", "North"),
            ("I3", "C2", None, "2024-03-31", "South"),
            ("I4", "C2", "P1,P2,P4", "2024-05-01", "North"),
            ("I5", "C3", "P9,P4", "2023-12-24", "South"),
            ("I6", "C2", '"P2, P3,"', "2024-08-31", "South"),
        ],
    )


def rows(df, *columns):
    """The rows as a set of tuples."""
    return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}


def one(df):
    return df.first()
