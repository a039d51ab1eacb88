"""Mixed timestamps: notations, zones, daylight-saving changes and hostile input."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from tallyweave.operators import instants

NY, BERLIN = "America/New_York", "Europe/Berlin"


def _micros(*args, micro=0):
    return int((datetime(*args, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 1_000_000 + micro


CASES = [
    ("2025-01-02T03:04:05Z", NY, _micros(2025, 1, 2, 3, 4, 5)),
    ("2025-01-02 03:04:05.1234567", None, _micros(2025, 1, 2, 3, 4, 5, micro=123456)),
    ("2025-01-02 03:04:05,12", None, _micros(2025, 1, 2, 3, 4, 5, micro=120000)),
    ("2025-07-02T03:04", NY, _micros(2025, 7, 2, 7, 4)),
    ("2025-01-02T03:04:05+05:30", NY, _micros(2025, 1, 1, 21, 34, 5)),
    ("2025-01-02 03:04:05 -08", NY, _micros(2025, 1, 2, 11, 4, 5)),
    ("2025-01-02T03:04:05-0500[America/Los_Angeles]", BERLIN, _micros(2025, 1, 2, 8, 4, 5)),
    ("2025-01-02 03:04:05 Europe/Berlin", NY, _micros(2025, 1, 2, 2, 4, 5)),
    ("2025-07-02 03:04:05 EST", BERLIN, _micros(2025, 7, 2, 8, 4, 5)),  # an abbreviation means its own offset in any season
    ("Jul 2, 2025 3:04 PM CEST", None, _micros(2025, 7, 2, 13, 4)),
    ("July 2, 2025 12:04:05 AM", None, _micros(2025, 7, 2, 0, 4, 5)),
    ("07/02/2025 12:04:05pm", None, _micros(2025, 7, 2, 12, 4, 5)),
    ("7/2/25 3:04", None, _micros(2025, 7, 2, 3, 4)),
    ("8/14/2025 6:26 PM", None, _micros(2025, 8, 14, 18, 26)),
    ("2.7.2025 03:04:05", None, _micros(2025, 7, 2, 3, 4, 5)),
    ("2-JUL-2025 03:04:05", None, _micros(2025, 7, 2, 3, 4, 5)),
    ("Wed, 02 Jul 2025 03:04:05 -0500", None, _micros(2025, 7, 2, 8, 4, 5)),
    ("20250702030405", NY, _micros(2025, 7, 2, 7, 4, 5)),
    ("20250702030405.5[-3.5]", NY, _micros(2025, 7, 2, 6, 34, 5, micro=500000)),
    ("20250702030405[5.5:IST]", NY, _micros(2025, 7, 1, 21, 34, 5)),
    ("2025-07-02T24:00:00", None, _micros(2025, 7, 3)),
    ("1748833140", NY, 1748833140 * 1_000_000),
    ("1748833140123", NY, 1748833140123 * 1000),
    ("1748833140123456", NY, 1748833140123456),
    ("\t2025-01-02 03:04:05 ", None, _micros(2025, 1, 2, 3, 4, 5)),
    # The clock shows 1:30 twice: the first is meant. It skips 2:30: the offset before applies.
    ("2025-11-02 01:30:00", NY, _micros(2025, 11, 2, 5, 30)),
    ("2025-03-09 02:30:00", NY, _micros(2025, 3, 9, 7, 30)),
    ("2025-03-09 03:00:00", NY, _micros(2025, 3, 9, 7)),
    ("2025-10-26 02:30:00", BERLIN, _micros(2025, 10, 26, 0, 30)),
    ("1851-06-01 00:00:00", "UTC", _micros(1851, 6, 1)),
]
NONE = [None, "", "  ", "2025-01-02", "pending", "n/a", "2025-02-30 10:15", "2025-01-02 25:00", "2025-01-02 24:01", "2025-01-02 10:60", "12/32/2025 9:00", "13:04 PM", "1/2/2025 13:04 PM", "123456789", "12345678901", "2025-01-02 03:04 Nowhere/City", "2025-01-02 03:04 XYZ", "31-Apr-2025 12:00", "2025-x|a|b|c|d|e|f|g|h", "9" * 100_000, "2025-01-02 03:04:05+19:00"]


def test_cases(spark):
    df = spark.createDataFrame([(k, t, z, 1) for k, (t, z, _) in enumerate(CASES)], "id int, date string, zone string, utc_micros int").drop("utc_micros")
    got = {r.id: r.utc_micros for r in instants.to_utc(df, "date", "zone").collect()}
    assert {CASES[k][0]: v for k, v in got.items()} == {t: m for t, _, m in CASES}


def test_no_cases(spark):
    df = spark.createDataFrame([(k, t, NY) for k, t in enumerate(NONE)], "id int, date string, zone string")
    out = instants.to_utc(df, "date", "zone").collect()
    assert len(out) == len(NONE) and {NONE[r.id]: r.utc_micros for r in out if r.utc_micros is not None} == {}


def test_clock(spark):
    df = spark.createDataFrame([(1, "2025-11-02 01:30:00", NY), (2, "2025-03-09 02:30:00", NY), (3, "2025-06-09 02:30:00", NY), (4, "x", NY)], "id int, date string, zone string")
    assert {r.id: r.clock for r in instants.to_utc(df, "date", "zone").collect()} == {1: "ambiguous", 2: "skipped", 3: "unique", 4: None}


@pytest.mark.parametrize("zone", [NY, BERLIN, "Australia/Sydney", "Asia/Kathmandu", "America/St_Johns", "Pacific/Apia", "Africa/Casablanca"])
def test_against_zoneinfo(spark, zone):
    tz, start = ZoneInfo(zone), datetime(1899, 12, 31)
    times = [start + timedelta(hours=37 * k + (k % 7) / 2) for k in range(0, 50_000, 3)] + [datetime(y, m, 15, 12) for y in range(2080, 2200, 7) for m in (1, 4, 7, 10)]
    df = spark.createDataFrame([(k, t.isoformat(" "), zone) for k, t in enumerate(times)], "id int, date string, zone string")
    got = {r.id: r.utc_micros for r in instants.to_utc(df, "date", "zone").collect()}
    epoch = datetime(1970, 1, 1)
    for k, t in enumerate(times):
        local = (t - epoch) // timedelta(microseconds=1)
        want = local - round(t.replace(tzinfo=tz).utcoffset().total_seconds()) * 1_000_000
        assert got[k] == want, (t, zone)


def test_ingest_rows(spark, rows):
    ingest = spark.createDataFrame([(1, 1, "2025-07-02 03:04", "a"), (1, 1, "2025-07-02 03:04", "b"), (2, 9, "2025-07-02 03:04", "a"), (3, None, "2025-07-02 03:04Z", "a"), (4, 1, None, "a")], "ingest_id long, file_id long, date string, tz_name string")
    files = spark.createDataFrame([(1, NY, datetime(2025, 1, 1)), (1, NY, datetime(2025, 1, 1)), (2, None, None)], "file_id long, tz_name string, received_at timestamp")
    noon = _micros(2025, 7, 2, 3, 4)
    assert rows(instants.ingest_instants(ingest, files)) == [(1, noon + 4 * 3_600_000_000), (2, noon), (3, noon)]
    assert rows(instants.ingest_instants(ingest.limit(0), files.limit(0))) == []


def test_intervals_overlap_and_leave_gaps(spark):
    z = instants.zone_intervals(spark.createDataFrame([("america/new_york",), ("nowhere/land",)], "zone string"))
    hour = 3_600_000_000
    got = sorted((r.from_local, r.to_local, r.offset_s // 3600) for r in z.filter("local_year = 2024").collect())
    assert [o for *_, o in got] == [-5, -4, -5]
    (_, end, _), (start, stop, _), (again, _, _) = got
    assert start - end == hour and stop - again == hour and {r.zone for r in z.select("zone").distinct().collect()} == {"america/new_york"}
