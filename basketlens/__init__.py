"""Retail customer, product and sales analytics as PySpark DataFrame operators."""

from basketlens.dataset import Retail

__all__ = ["Retail"]
