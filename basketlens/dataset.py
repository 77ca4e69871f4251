"""The star schema every operator works on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Retail:
    """One retail chain as four lazy relations.

    customers: customer_id, gender, age, payment_method
    products:  product_id, category, price (DECIMAL)
    invoices:  invoice_no, customer_id, invoice_date, shopping_mall - one row per invoice
    lines:     invoice_no, product_id - one row per item; an invoice with an empty basket has none
    """

    customers: DataFrame
    products: DataFrame
    invoices: DataFrame
    lines: DataFrame
