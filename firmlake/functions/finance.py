"""Money columns: ratios and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATIO = "decimal(10,4)"


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL when the denominator is NULL or zero."""
    return F.try_divide(numerator, F.nullif(denominator, F.lit(0)))


def debt_to_equity(liabilities: Column, net_worth: Column) -> Column:
    return ratio(liabilities, net_worth).cast(RATIO)


def current_ratio(current_assets: Column, current_liabilities: Column) -> Column:
    return ratio(current_assets, current_liabilities).cast(RATIO)


def profit_margin(profit: Column, turnover: Column) -> Column:
    return ratio(profit, turnover).cast(RATIO)


def money_in_millions(v: Column) -> Column:
    """``£1.2M`` for display, ``N/A`` for NULL and zero; exact quarters round away from zero."""
    amount = v.cast("double") / 1_000_000
    size = F.abs(amount)
    size = F.when(size % 1 == 0.25, size + 0.05).otherwise(size)
    digits = F.regexp_replace(F.format_number(size, 1), ",", "")
    sign = F.when(amount < 0, "-").otherwise("")
    return F.when(v.isNull() | (v == 0), "N/A").otherwise(F.concat(F.lit("£"), sign, digits, F.lit("M")))
