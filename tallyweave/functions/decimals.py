"""Decimal rounding in the three ways that invoices are checked with, and decimal places of raw text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(28,8)"


def to_decimal(text: Column) -> Column:
    """Decimal of a plain number text; null for NaN, infinities, exponents and other texts."""
    return F.when(F.btrim(text).rlike(r"^[-+]?(?:\d+\.?\d*|\.\d+)$"), F.btrim(text).try_cast(DECIMAL))


def half_up(value: Column, places: int = 2) -> Column:
    """Rounded half away from zero."""
    return F.round(value, places)


def xpath_round(value: Column) -> Column:
    """Rounded half towards positive infinity."""
    return F.floor(value + F.lit(0.5).cast("decimal(2,1)"))


def xpath_round_cents(value: Column) -> Column:
    """Two decimals by xpath_round."""
    return (xpath_round(value * 100) / 100).cast("decimal(28,2)")


def decimal_places(text: Column) -> Column:
    """Digits after the point of a raw number text; 0 without a point."""
    s = F.btrim(text)
    return F.when(F.instr(s, ".") > 0, F.length(s) - F.instr(s, ".")).otherwise(F.when(s.isNotNull(), 0))


def within(a: Column, b: Column, slack: Column) -> Column:
    """True where a and b are at most `slack` apart."""
    return F.abs(a - b) <= slack
