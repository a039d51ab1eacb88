"""Money as signed integer cents; text is parsed by an explicit grammar, never inferred."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = r"(?:(?:\d{1,15}|\d{1,3}(?:,\d{3}){1,4})(?:\.\d{0,2})?|\.\d{1,2})"
_INNER = rf"\s*\$?\s*[-+]?\s*{_DIGITS}\s*"
#: Parentheses around the whole (a negative), then `$`, then a sign, then plain or grouped digits with at most two decimals.
GRAMMAR = rf"^(?:\({_INNER}\)|{_INNER})$"
#: Amounts of more cents are out of range.
LARGEST = (1 << 53) - 1


def parse_cents(text: Column) -> Column:
    """Cents of `text`, null for null, blank or malformed text (more than two decimals, wrong grouping, two signs) and beyond LARGEST.

    A minus within parentheses turns the sign twice.
    """
    s = F.btrim(text, F.lit(" \t\r\n"))
    plain = F.regexp_replace(s, "[^0-9.]", "")
    whole = F.coalesce(F.split_part(plain, F.lit("."), F.lit(1)).try_cast("bigint"), F.lit(0).cast("bigint"))
    part = F.rpad(F.split_part(plain, F.lit("."), F.lit(2)), 2, "0").try_cast("bigint")
    cents = whole * 100 + F.coalesce(part, F.lit(0))
    negative = s.startswith("(") != s.contains("-")
    return F.when(s.rlike(GRAMMAR) & (cents <= LARGEST), F.when(negative, -cents).otherwise(cents))


def format_cents(cents: Column) -> Column:
    """`$1,234.56`, negative as `-$1,234.56`; null for null."""
    value = F.abs(cents)
    units = F.regexp_replace(F.floor(value / 100).cast("string"), r"(?<=\d)(?=(?:\d{3})+$)", ",")
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.lit("$"), units, F.lit("."), F.lpad((value % 100).cast("string"), 2, "0"))


def debit_credit(debit: Column, credit: Column) -> Column:
    """Signed cents of a debit (out) and credit (in) pair of texts, whose own signs don't count; null unless exactly one is filled and valid."""
    filled = lambda c: F.coalesce(F.btrim(c) != "", F.lit(False))
    return F.when(filled(debit) & ~filled(credit), -F.abs(parse_cents(debit))).when(filled(credit) & ~filled(debit), F.abs(parse_cents(credit)))
