"""Calendar days and instants from text, by explicit forms only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months, and the accepted spellings of their names.
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTHS = tuple(m[:3] for m in MONTH_NAMES)
_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
# Accepted forms of a day: pattern, and its groups in the order year, month, day.
FORMS = (
    (r"^(\d{4})-(\d{2})-(\d{2})$", "|$1|$2|$3"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", "|$3|$1|$2"),
    (r"^(\d{4})(\d{2})(\d{2})$", "|$1|$2|$3"),
    (rf"^{_MONTH}\.?\s+(\d{{1,2}}),?\s+(\d{{4}})$", "|$3|$1|$2"),
    (rf"^(\d{{1,2}})-{_MONTH}\.?-(\d{{4}}|\d{{2}})$", "|$3|$2|$1"),
)


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """The day, null unless a real one."""
    first = F.when((year >= 1) & (year <= 9999) & month.between(1, 12), F.make_date(year, month, F.lit(1)))
    return F.when((day >= 1) & (day <= F.day(F.last_day(first))), F.date_add(first, day - 1))


def parse_date(text: Column) -> Column:
    """The day in `text` (trimmed), null unless a real day in one of FORMS; two-digit years are 20xx, month names in any case."""
    s = F.lower(F.btrim(text))
    found = F.when(s.rlike(FORMS[0][0]), F.regexp_replace(s, *FORMS[0]))
    for form in FORMS[1:]:
        found = found.when(s.rlike(form[0]), F.regexp_replace(s, *form))
    # The parts are found once and read as a step of its own: inlined where they are used, they would make code too long to compile.
    return F.get(F.transform(F.array(F.split(found, r"\|")), _day_of), F.lit(0))


def _day_of(parts: Column) -> Column:
    """The day of ('', year, month, day); null for null."""
    part = lambda k: F.get(parts, F.lit(k))
    year = part(1).try_cast("int")
    named = ((F.position(F.substring(part(2), 1, 3), F.lit("".join(MONTHS))) + 2) / 3).cast("int")
    month = F.when(part(2).rlike("^[a-z]"), named).otherwise(part(2).try_cast("int"))
    return safe_date(F.when(F.length(part(1)) == 2, year + 2000).otherwise(year), month, part(3).try_cast("int"))


def canonical_instant(text: Column) -> Column:
    """Timestamp of a canonical UTC text `2026-01-31T00:00:00.000Z` (fraction of three digits or none); null for any other text."""
    form = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{3})?Z$"
    return F.when(text.rlike(form), F.try_to_timestamp(text))


def iso_from_unix(seconds: Column) -> Column:
    """`yyyy-MM-ddTHH:mm:ssZ` of seconds since 1970; the session zone must be UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day_gap(a: Column, b: Column) -> Column:
    """Absolute distance in whole days."""
    return F.abs(F.datediff(a, b))
