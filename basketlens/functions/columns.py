"""Scalar column functions. All are built-in expressions, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketlens.fixed_values import AGE_BANDS, INVOICE_DATE_FORMAT, PRICE_BANDS, PRICE_TIERS

Bands = Sequence[tuple[float | None, str]]


def band(value: Column, bands: Bands) -> Column:
    """Label of the first band whose upper bound lies above ``value``; the open band takes the rest, null included."""
    *closed, (_, last) = bands
    (upper, label), *others = closed
    chain = F.when(value < upper, label)
    for upper, label in others:
        chain = chain.when(value < upper, label)
    return chain.otherwise(last)


def labelled_bands(edges: Sequence[float]) -> Bands:
    """Bands with the usual labels for other edges: (20, 50) gives 0-20, 20-50 and 50+."""
    lows = [0, *edges]
    return (*((high, f"{low}-{high}") for low, high in zip(lows, edges)), (None, f"{edges[-1]}+"))


def age_band(age: Column) -> Column:
    return band(age, AGE_BANDS)


def price_band(price: Column, bands: Bands = PRICE_BANDS) -> Column:
    return band(price, bands)


def price_tier(mean_price: Column, tiers: Bands = PRICE_TIERS) -> Column:
    return band(mean_price, tiers)


def lookup(key: Column, texts: Mapping[str, str]) -> Column:
    """Text for a label from a short fixed table; unknown labels give null."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, text in texts.items():
        chain = chain.when(key == label, text)
    return chain


def parse_invoice_date(text: Column) -> Column:
    """Day/month/year text to a date; leading zeros are optional and bad text raises (ANSI mode)."""
    return F.to_date(text, INVOICE_DATE_FORMAT)


def year_month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_name(date: Column) -> Column:
    return F.date_format(date, "MMM")


def calendar_parts(date: Column) -> dict[str, Column]:
    """Year, month, year-month, day of week (Monday is 0) and quarter."""
    return {
        "year": F.year(date),
        "month": F.month(date),
        "year_month": year_month(date),
        "day_of_week": F.weekday(date),
        "quarter": F.quarter(date),
    }


def months_before(date: Column, months: int) -> Column:
    """The same day ``months`` earlier, clipped to the end of a shorter month."""
    return F.add_months(date, -months)


def days_between(earlier: Column, later: Column) -> Column:
    return F.datediff(later, earlier)


def basket_size(list_text: Column) -> Column:
    """Items in a comma-separated list; a missing list has none."""
    return F.when(list_text.isNull(), 0).otherwise(F.size(F.split(list_text, ",")))


def clean_ids(list_text: Column) -> Column:
    """Ids of a comma-separated list: quotes removed, blanks around ids trimmed, empty entries dropped."""
    pieces = F.split(F.translate(list_text, '"', ""), ",")
    return F.filter(F.transform(pieces, lambda piece: F.trim(piece)), lambda piece: piece != "")


def raw_ids(list_text: Column) -> Column:
    return F.split(list_text, ",")


def safe_ratio(numerator: Column, divisor: Column) -> Column:
    """numerator / divisor as a double, 0 where the divisor is not positive or missing."""
    return F.when(divisor > 0, numerator.cast("double") / divisor.cast("double")).otherwise(F.lit(0.0))


def share_percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * 100, whole.cast("double"))


def known(*names: str) -> Column:
    """True where none of the columns is missing, as plain conditions that reach the scan."""
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).isNotNull()
    return condition


def fill_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def money(total: Column) -> Column:
    """A decimal sum as a double, 0 where nothing was summed. Decimal sums do not depend on row order."""
    return fill_zero(total).cast("double")


def flag(condition: Column) -> Column:
    return condition.cast("int")


def sorted_set_string(values: Column) -> Column:
    """Aggregate: the distinct non-null values in order, joined with a comma and a blank."""
    return F.array_join(F.array_sort(F.collect_set(values)), ", ")


def zscore(value: Column, mean: Column, deviation: Column) -> Column:
    """(value - mean) / deviation; a constant column is only centred."""
    return (value - mean) / F.when(deviation == 0, 1.0).otherwise(deviation)
