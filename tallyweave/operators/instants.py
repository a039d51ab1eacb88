"""Text dates in any notation and zone → one UTC instant.

Parsing stays in the JVM: one regular expression per notation rewrites a text into `|year|month|…|zone`, which is then
split. Local times meet their zone's offset by an as-of join: the offset intervals of a zone are exploded by local year,
so the join is an equi-join on (zone, year) against a table bounded by the IANA zones, whose intervals are then matched
with the time: two hold an ambiguous time, none a skipped one, one gives the offset directly.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.dates import MONTHS
from tallyweave.session import small_side

# Abbreviations and their offsets from UTC in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "HDT": -540,
    "WET": 0, "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "MSD": 240,
}

#: Local years that the interval table spells out. Earlier times use the first; later years the year in it with the same calendar.
FIRST_YEAR, LAST_YEAR = 1850, 2128
_DAY = 86_400_000_000
_FAR = 1 << 60

_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+)?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([ap])\.?m\.?(?![a-z]))?\s*(\S.*)?$"
# Each notation: pattern and the order of year, month, day and the rest in it.
_ISO = (rf"(?i)^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})[t\s]\s*{_TIME}", "|$1|$2|$3|$4|$5|$6|$7|$8|$9")
_COMPACT = (r"(?i)^(\d{4})(\d{2})(\d{2})t?(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?()(?!\d)\s*(\S.*)?$", "|$1|$2|$3|$4|$5|$6|$7|$8|$9")
_SLASH = (rf"(?i)^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}),?\s+{_TIME}", "|$3|$1|$2|$4|$5|$6|$7|$8|$9")
_DOT = (rf"(?i)^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}),?\s+{_TIME}", "|$3|$2|$1|$4|$5|$6|$7|$8|$9")
_DAY_MONTH = (rf"(?i)^{_WEEKDAY}(\d{{1,2}})[-\s]\s*{_MONTH}\.?,?[-\s]\s*(\d{{4}}|\d{{2}}),?[t\s]\s*{_TIME}", "|$3|$2|$1|$4|$5|$6|$7|$8|$9")
_MONTH_DAY = (rf"(?i)^{_WEEKDAY}{_MONTH}\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_TIME}", "|$3|$1|$2|$4|$5|$6|$7|$8|$9")
_OFFSET = r"(?i)^(?:utc|gmt)?([+-]\d{1,2})(?::?([0-5]\d))?(?:\s*[\[(].*[\])])?$"
_BRACKET = r"^\[([+-]?\d{1,2})(?:\.(\d{1,4}))?(?::[A-Za-z]*)?\]$"
_ZONE_IN_TEXT = r"([A-Za-z]+/[A-Za-z0-9_+\-]+(?:/[A-Za-z0-9_+\-]+)?)"


def _parts(s: Column) -> Column:
    """Array of year, month, day, hour, minute, second, fraction, a/p and zone text; a single element where no notation fits."""
    rewrite = lambda notation: F.regexp_replace(s, *notation)
    fifth, second, third = (F.substring(s, k, 1) for k in (5, 2, 3))
    text = (
        F.when((second == "/") | (third == "/"), rewrite(_SLASH))
        .when((second == ".") | (third == "."), rewrite(_DOT))
        .when(fifth.isin("-", "/"), rewrite(_ISO))
        .when(s.rlike(r"^\d{8}"), rewrite(_COMPACT))
        .when(s.rlike(r"^\d"), rewrite(_DAY_MONTH))
        .when(s.rlike(r"^[A-Za-z]+\.?,?\s+\d{1,2}[-\s]\s*[A-Za-z]"), rewrite(_DAY_MONTH))
        .when(s.rlike(r"^[A-Za-z]"), rewrite(_MONTH_DAY))
    )
    return F.split(text, r"\|", 10)


def _step(array: Column) -> Column:
    """The array as it is, as a step of its own: a higher-order function parts generated code into methods that the JVM compiles.

    Without it the whole parse becomes one method beyond the JVM's limit, which stays interpreted (seven times as slow).
    """
    return F.transform(array, lambda x: x)


def parse_local(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds to `df` what column `text` says: `{prefix}local_micros`, `{prefix}offset_s`, `{prefix}zone`, `{prefix}epoch_micros`.

    local_micros: wall-clock microseconds, null unless a real day with a real time of day (24:00 is the end of the day).
    offset_s: stated offset or abbreviation in seconds. zone: stated zone name, lower case; '?' for a zone text that is
    neither. epoch_micros: of an epoch number of 10, 13 or 16 digits. All are null for null, blank or other texts.
    """
    s, p = f"{prefix}s", f"{prefix}p"
    q = lambda k: F.get(F.col(p), F.lit(k))
    num = lambda c: F.when(c != "", c).try_cast("int")
    df = df.withColumn(s, F.btrim(F.col(text), F.lit(" \t\r\n\u00a0")))
    # A moment has a colon, or is written without any in twelve digits or more; other texts, days above all, need no look.
    compact = F.length(s) >= 12
    df = df.withColumn(p, F.when(F.col(s).contains(":") | (compact & F.col(s).rlike(r"^\d{8}[tT]?\d{4}") & ~F.col(s).rlike(r"^(\d{13}|\d{16})$")), _step(_parts(F.col(s)))))
    c = {k: F.col(f"{prefix}{k}") for k in ("y", "m", "d", "h", "mi", "se", "us", "ap", "t", "ok")}
    df = df.withColumns({f"{prefix}{k}": q(n) for k, n in (("y", 1), ("m", 2), ("d", 3), ("h", 4), ("mi", 5), ("se", 6), ("us", 7), ("ap", 8), ("t", 9))} | {f"{prefix}ok": (F.size(p) == 10) & (q(0) == "")})
    named = ((F.position(F.lower(F.substring(c["m"], 1, 3)), F.lit("".join(MONTHS))) + F.lit(2)) / 3).cast("int")
    df = df.withColumns({
        f"{prefix}y": F.when(c["ok"], num(c["y"]) + F.when(F.length(c["y"]) == 2, 2000).otherwise(0)),
        f"{prefix}m": F.coalesce(num(c["m"]), F.when(F.length(c["m"]) > 2, named)),
        f"{prefix}d": num(c["d"]), f"{prefix}h": num(c["h"]), f"{prefix}mi": num(c["mi"]), f"{prefix}se": F.coalesce(num(c["se"]), F.lit(0)),
        f"{prefix}us": F.substring(F.rpad(c["us"], 6, "0"), 1, 6).try_cast("int"),
    })
    noon = F.when(c["ap"] == "", c["h"]).when(c["h"].between(1, 12), c["h"] % 12 + F.when(F.lower(c["ap"]) == "p", 12).otherwise(0))
    df = df.withColumn(f"{prefix}h", noon)
    year, month, day, hour, minute, second, us, tail = (c[k] for k in ("y", "m", "d", "h", "mi", "se", "us", "t"))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    clock = (hour <= 23) | ((hour == 24) & (minute == 0) & (second == 0) & (us == 0) & (c["ap"] == ""))
    real = (year >= 1) & month.between(1, 12) & (day >= 1) & (day <= last) & clock & (minute <= 59) & (second <= 59)
    df = df.withColumn(f"{prefix}ok", real)
    micros = F.unix_date(F.make_date(year, month, day)).cast("long") * _DAY + ((hour * 60 + minute) * 60 + second).cast("long") * 1_000_000 + us
    # Each form of a zone text is looked at only where its first letters allow it.
    o = f"{prefix}o"
    first = F.substring(tail, 1, 1)
    signed = first.isin("+", "-") | (F.upper(F.substring(tail, 1, 3)).isin("UTC", "GMT") & (F.length(tail) > 3))
    df = df.withColumn(o, _step(F.split(F.when(signed, F.regexp_replace(tail, _OFFSET, "|o|$1|$2")).when(first == "[", F.regexp_replace(tail, _BRACKET, "|b|$1|$2")), r"\|", 4)))
    form, whole, rest = (F.get(F.col(o), F.lit(k)) for k in (1, 2, 3))
    fits = (F.size(o) == 4) & (F.get(F.col(o), F.lit(0)) == "")
    part = F.when(form == "o", num(rest) * 60).otherwise((F.concat(F.lit("0."), F.when(rest != "", rest)).try_cast("decimal(9,4)") * 3600).cast("int"))
    seconds = F.abs(num(whole)) * 3600 + F.coalesce(part, F.lit(0))
    known = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in (kv[0], kv[1] * 60)))
    offset = F.when(fits, F.when(whole.startswith("-"), -seconds).otherwise(seconds)).when(tail.rlike("^[A-Za-z]+$"), F.try_element_at(known, F.upper(tail)))
    df = df.withColumn(f"{prefix}offset_s", offset)
    offset = F.col(f"{prefix}offset_s")
    named_zone = F.nullif(F.lower(F.regexp_extract(tail, rf"^\[?{_ZONE_IN_TEXT}\]?$", 1)), F.lit(""))
    digits = F.length(F.col(s))
    return df.withColumns({
        f"{prefix}local_micros": F.when(c["ok"], micros),
        f"{prefix}offset_s": F.when(F.abs(offset) <= 18 * 3600, offset),
        f"{prefix}zone": F.when(F.coalesce(tail, F.lit("")) != "", F.coalesce(F.when(offset.isNull(), named_zone), F.lit("?"))),
        f"{prefix}epoch_micros": F.when(digits.isin(10, 13, 16) & F.col(s).rlike(r"^\d+$"), F.col(s).cast("long") * F.when(digits == 10, 1_000_000).when(digits == 13, 1000).otherwise(1)),
    }).drop(s, p, o, *(f"{prefix}{x}" for x in c))


def zone_intervals(zones: DataFrame) -> DataFrame:
    """(zone, local_year, from_local, to_local, offset_s) for the names in the one string column of `zones`.

    A row is the span of local time, in microseconds, that a zone's clock runs through under one offset, once for each local
    year that it touches. Spans overlap where a clock is put back and leave a gap where it is put forward. Names are
    compared in lower case; unknown ones give no rows. At most some 600 zones times 279 years times 4 rows. Changes are
    looked for from week to week: two within a week that return to the first offset are taken for none.
    """

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = {x.lower(): x for x in available_timezones()}
        epoch, week = datetime(1970, 1, 1, tzinfo=timezone.utc), timedelta(days=7)
        year_of = lambda micros: max(FIRST_YEAR, min(LAST_YEAR + 1, (epoch + timedelta(microseconds=max(min(micros, 5_100_000_000_000_000), -3_900_000_000_000_000))).year))
        for batch in batches:
            out = []
            for zone in batch.iloc[:, 0]:
                if zone not in names:
                    continue
                tz = ZoneInfo(names[zone])
                offset = lambda t, tz=tz: int(t.astimezone(tz).utcoffset().total_seconds())
                at, end = datetime(FIRST_YEAR - 1, 1, 1, tzinfo=timezone.utc), datetime(LAST_YEAR + 2, 1, 1, tzinfo=timezone.utc)
                now, spans, start = offset(at), [], -_FAR
                while at < end:
                    nxt = at + week
                    if offset(nxt) != now:
                        low, high = at, nxt
                        while high - low > timedelta(seconds=1):
                            mid = low + timedelta(seconds=(high - low).total_seconds() // 2)
                            low, high = (mid, high) if offset(mid) == now else (low, mid)
                        then = offset(high)
                        change = int((high - epoch).total_seconds())
                        spans.append((start, (change + now) * 1_000_000, now))
                        start, now, at = (change + then) * 1_000_000, then, high
                        continue
                    at = nxt
                spans.append((start, _FAR, now))
                # A span counts for the year in which it ends, too: a gap at the turn of a year asks for the span before it.
                out += [(zone, y, low, high, secs) for low, high, secs in spans for y in range(year_of(low), year_of(high) + 1)]
            yield pd.DataFrame(out, columns=["zone", "local_year", "from_local", "to_local", "offset_s"])

    return zones.mapInPandas(expand, "zone string, local_year int, from_local long, to_local long, offset_s int")


def to_utc(df: DataFrame, text: str, default_zone: str) -> DataFrame:
    """Adds `utc_micros` (long) and `clock` ('unique', 'ambiguous', 'skipped' or null) to `df`.

    A stated offset wins over a stated zone, both over the zone named in column `default_zone`; no zone at all is UTC.
    Null utc_micros: no real moment, or a zone name that nobody knows. Row count and columns of `df` are kept; its columns
    may have any names but those beginning with `_tw_`.
    """
    x = parse_local(df, text, "_tw_")
    zone = F.coalesce(F.col("_tw_zone"), F.nullif(F.lower(F.btrim(F.col(default_zone))), F.lit("")), F.lit("utc"))
    # Without a stated offset the zone is looked up; UTC needs none.
    key = F.when(F.col("_tw_local_micros").isNotNull() & F.col("_tw_offset_s").isNull() & ~zone.isin("utc", "?"), zone)
    year = F.year(F.date_from_unix_date(F.floor(F.col("_tw_local_micros") / F.lit(_DAY)).cast("int")))
    x = x.withColumns({"_tw_key": key, "_tw_year": year, "_tw_given": zone})
    jan1 = lambda y: F.unix_date(F.make_date(y, F.lit(1), F.lit(1)))
    # A year after the table has the changes of the year of the last 28 in it with the same calendar.
    same = F.when(F.col("_tw_year") <= LAST_YEAR, F.greatest(F.col("_tw_year"), F.lit(FIRST_YEAR))).otherwise(_like_year(F.col("_tw_year")))
    shift = F.when(F.col("_tw_year") > LAST_YEAR, (jan1(F.col("_tw_like")) - jan1(F.col("_tw_year"))).cast("long") * _DAY).otherwise(F.lit(0))
    x = x.withColumn("_tw_like", F.when(F.col("_tw_key").isNotNull(), same)).withColumn("_tw_at", F.col("_tw_local_micros") + shift)
    named = df.select(F.lower(F.btrim(F.col(default_zone))).alias("zone")).union(df.filter(F.col(text).contains("/")).select(F.lower(F.regexp_extract(F.col(text), _ZONE_IN_TEXT, 1))))
    # As-of join: a time meets the spans of its zone and year, in order, and those that hold it are counted. Bounded by zones and years.
    spans = zone_intervals(named.filter("zone is not null and zone != ''").distinct())
    spans = spans.groupBy(F.col("zone").alias("_tz_zone"), F.col("local_year").alias("_tz_year")).agg(F.array_sort(F.collect_list(F.struct("from_local", "to_local", "offset_s"))).alias("_tz_spans"))
    y = x.join(F.broadcast(spans), (F.col("_tw_key") == F.col("_tz_zone")) & (F.col("_tw_like") == F.col("_tz_year")), "left")
    at = F.col("_tw_at")
    y = y.withColumn("_tz_held", F.filter("_tz_spans", lambda p: (p["from_local"] <= at) & (at < p["to_local"])))
    matches = F.size("_tz_held")
    # One match gives the offset; of two the first is meant; with none, a skipped time, the span that ended last before it counts.
    before = F.element_at(F.filter("_tz_spans", lambda p: p["to_local"] <= at), -1)
    found = F.when(matches > 0, F.get("_tz_held", F.lit(0))["offset_s"]).when(matches == 0, before["offset_s"])
    offset = F.coalesce(F.col("_tw_offset_s"), found, F.when(F.col("_tw_given") == "utc", 0))
    utc = F.coalesce(F.col("_tw_epoch_micros"), F.col("_tw_local_micros") - offset.cast("long") * 1_000_000)
    clock = F.when(utc.isNotNull(), F.when(matches >= 2, "ambiguous").when(matches == 0, "skipped").otherwise("unique"))
    return y.select(*(df[c] for c in df.columns), utc.alias("utc_micros"), clock.alias("clock"))


def _like_year(year: Column) -> Column:
    """The year in the last 28 of the table that begins on the same weekday and is as long as `year`."""
    years = {}
    for y in range(LAST_YEAR - 27, LAST_YEAR + 1):
        leap = y % 4 == 0
        years.setdefault((datetime(y, 1, 1).isoweekday() % 7 + 1, leap), y)
    leap = ((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))).cast("int")
    spot = (F.dayofweek(F.make_date(year, F.lit(1), F.lit(1))) - 1) * 2 + leap + 1
    return F.element_at(F.array(*(F.lit(years[d, bool(k)]) for d in range(1, 8) for k in (0, 1))), spot)


def ingest_instants(ingest: DataFrame, files: DataFrame) -> DataFrame:
    """(ingest_id, utc_micros) of every ingest row that names a moment, distinct. The zone of a file is that of its latest register row."""
    zones = files.groupBy("file_id").agg(F.max_by("tz_name", F.struct("received_at", "tz_name")).alias("tz_name"))
    rows = ingest.select("ingest_id", "file_id", "date").join(small_side(zones), "file_id", "left")
    return to_utc(rows.select("ingest_id", "date", "tz_name"), "date", "tz_name").filter("utc_micros is not null").select("ingest_id", "utc_micros").distinct()
