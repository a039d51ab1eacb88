"""Schemas that drift: changes, lifespans, the unified table and hostile input."""

from __future__ import annotations

import json
from datetime import datetime

import pytest

from tallyweave.operators import drift

ALIASES = [("date", "Date"), ("date", "Posted"), ("party", "Payee"), ("kind", "Type"), ("memo", "Memo")]
FILE = "file_id long, feed_id string, period_no int, source string, row_table string, header_line string, delim string, tz_name string, received_at timestamp, note string"


def _file(file_id, period, feed="F", at=None):
    return (file_id, feed, period, "bank", "feed_record", None, None, None, at or datetime(2025, period, 5), "x")


def _run(spark, files, records):
    r = spark.createDataFrame([(f, n, json.dumps(p) if not isinstance(p, (str, type(None))) else p, 1) for f, n, p in records], "file_id long, row_no int, payload string, feed_id int")
    a = spark.createDataFrame(ALIASES, "logical_field string, alias string")
    return r, spark.createDataFrame(files, FILE), a


def _changes(spark, files, records):
    return sorted(tuple(x) for x in drift.changes(drift.lifespans(*_run(spark, files, records))).collect())


def _rows(file_id, n, **cells):
    return [(file_id, k, {key: v[k % len(v)] if isinstance(v, list) and v and not isinstance(v[0], int) else v for key, v in cells.items()}) for k in range(n)]


NAMES = ["Ada Byron", "Bo Chen", "Cy Dorn", "Di Ebers"]
DAYS = ["2025-01-02", "2025-01-03", "2025-01-04"]
KINDS = ["DEP", "CHK", "DEP"]


def test_each_change(spark):
    records = (
        _rows(1, 4, Date=DAYS, Payee=NAMES, Type=KINDS)
        + _rows(2, 4, **{" date": DAYS, "who": NAMES})  # a change of case and blanks is none; party renamed, kind removed
        + _rows(3, 4, Date=20250103, who={"name": "Ada Byron", "unit": "3"}, Type=KINDS)  # date and party retyped, kind added
        + _rows(4, 4, x_d=DAYS, who=NAMES, Type=7)  # date renamed and retyped, party and kind retyped
    )
    got = _changes(spark, [_file(k, k) for k in range(1, 5)], records)
    assert got == [
        (2, "kind", "removed"), (2, "party", "renamed"), (3, "date", "retyped"), (3, "kind", "added"), (3, "party", "retyped"),
        (4, "date", "renamed"), (4, "date", "retyped"), (4, "kind", "retyped"), (4, "party", "retyped"),
    ]


def test_latest_delivery_counts_and_single_rows_do_not(spark):
    files = [_file(1, 1), _file(2, 2, at=datetime(2025, 2, 5)), _file(3, 2, at=datetime(2025, 2, 9)), _file(3, 2, at=datetime(2025, 2, 9))]
    records = _rows(1, 4, Date=DAYS, Payee=NAMES) + _rows(2, 4, Posted=DAYS) + _rows(3, 4, Date=DAYS, Payee=NAMES) + [(3, 9, {"Posted": "2025-01-09", "Payee": "Ada Byron"})]
    assert _changes(spark, files, records + records) == []


def test_null_values_have_no_type(spark):
    records = _rows(1, 3, Date=DAYS, Payee=NAMES) + _rows(2, 3, Date=None, Payee=NAMES) + _rows(3, 3, Date=DAYS, Payee=NAMES)
    assert _changes(spark, [_file(k, k) for k in (1, 2, 3)], records) == []


def test_stamps_and_other_columns_have_no_meaning(spark):
    records = [(f, n, {"Date": d, "exported_on": f"2025-0{f}-28", "balance": "12.50", "Check Number": 4000 + n, "branch": "BR001"}) for f in (1, 2) for n, d in enumerate(DAYS)]
    r, f, a = _run(spark, [_file(1, 1), _file(2, 2)], records)
    last = drift.deliveries(f)
    got = {tuple(x) for x in drift.meanings(drift.catalogue(r).join(last, "file_id"), a).select("name", "field").collect()}
    assert got == {("date", "date")}


def test_unified_and_lifespans(spark):
    records = _rows(1, 2, Date=DAYS, Payee=NAMES, Type=KINDS) + _rows(2, 2, Posted=DAYS, Payee=NAMES)
    args = _run(spark, [_file(1, 1), _file(2, 2)], records)
    table = sorted(tuple(x) for x in drift.unified(*args).select("file_id", "row_no", "date", "party", "kind").collect())
    assert table == [(1, 0, "2025-01-02", "Ada Byron", "DEP"), (1, 1, "2025-01-03", "Bo Chen", "CHK"), (2, 0, "2025-01-02", "Ada Byron", None), (2, 1, "2025-01-03", "Bo Chen", None)]
    spans = sorted(tuple(x) for x in drift.islands(drift.lifespans(*args)).select("field", "name", "first_period", "last_period").collect())
    assert spans == [("date", "date", 1, 1), ("date", "posted", 2, 2), ("kind", "type", 1, 1), ("party", "payee", 1, 2)]


def test_typed(spark):
    records = [
        (1, 0, {"Date": "2025-01-02T10:00:00Z", "Payee": " Ada Byron ", "Type": {"code": 4, "label": "Fee"}}),
        (1, 1, {"Date": "3.2.2025", "Payee": ["Bo", "Chen"], "Type": ["chk", "rent"]}),
        (1, 2, {"Date": [2025, 2, 30], "Payee": {"name": "Cy Dorn", "unit": "3"}, "Type": 4}),
        (1, 3, {"Date": {"y": 2024, "m": 2, "d": 29}, "Payee": 70123, "Type": 9}),
        (2, 0, {"Posted": 20250131, "Type": True}),
        (2, 1, {"Posted": 1735689600, "Type": "DEP", "Payee": " "}),
        (2, 2, "no json"),
        (2, 3, {"Memo": "x"}),
    ]
    t = drift.typed(*_run(spark, [_file(1, 1), _file(2, 2)], records + records))
    assert dict(t.dtypes)["date"] == "date"
    got = sorted((r.file_id, r.row_no, str(r.date), r.party, r.kind, r.readable, tuple(r.failed)) for r in t.collect())
    assert got == [
        (1, 0, "2025-01-02", "Ada Byron", "fee", True, ()), (1, 1, "2025-02-03", "Bo Chen", "check", True, ()), (1, 2, "None", "Cy Dorn", "fee", True, ("date",)),
        (1, 3, "2024-02-29", "70123", "9", True, ()), (2, 0, "2025-01-31", None, None, True, ("kind",)), (2, 1, "2025-01-01", None, "deposit", True, ("party",)),
        (2, 2, "None", None, None, False, ()), (2, 3, "None", None, None, True, ()),
    ]
    bad = sorted((r.file_id, r.field, r.json_type, r.rows, r.failed) for r in drift.cast_report(t).filter("failed > 0").collect())
    assert bad == [(1, "date", "array", 1, 1), (2, "kind", "boolean", 1, 1), (2, "party", "string", 1, 1)]
    assert {r.reads for r in drift.casts(_run(spark, [], [])[2]).filter("name = 'posted'").collect()} == {"day text", "yyyymmdd or epoch", "members y, m, d", "items year, month, day"}


def test_known_names_are_not_looked_at(spark):
    records = _rows(1, 3, Date=DAYS, Memo=NAMES, x=DAYS)
    r, f, a = _run(spark, [_file(1, 1)], records)
    cat = {x["name"]: (x.known, x.as_date, x.low) for x in drift.catalogue(r, a).collect()}
    assert cat == {"date": ("date", 0, None), "memo": ("memo", 0, None), "x": (None, 3, "2025-01-02")}


@pytest.mark.parametrize("payload", [None, "", "[]", "{", "null", "{}", '{"": 1}', '{"Date": "' + "9" * 200_000 + '"}'])
def test_odd_payloads(spark, payload):
    records = _rows(1, 3, Date=DAYS) + _rows(2, 3, Date=DAYS) + [(2, 7, payload)]
    assert _changes(spark, [_file(1, 1), _file(2, 2)], records) == []


def test_empty_tables(spark):
    assert _changes(spark, [], []) == []
    assert _changes(spark, [_file(1, 1), _file(2, 2)], []) == []
