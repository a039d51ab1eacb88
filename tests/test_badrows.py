"""Rows that fail to parse: the bulk path against the strict reader, reasons, and hostile input."""

from __future__ import annotations

import random
from datetime import date, datetime

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.operators import badrows as b

HEADER = "Date,Description,Debit,Credit,Type"
LAYOUT = b.Layout(HEADER, ",")


@pytest.mark.parametrize("text", ["1", "1.", ".5", "$1,234.56", "($5)", "$-5", "(-5)", "+7.10", "1,234,567", "0", "007"])
def test_valid_amounts(text):
    assert b.parse_cents(text) is not None


@pytest.mark.parametrize("text", ["", ".", "$", "-", "1,23", "1,2345", "10.005", "--5", "-$5", "5-", "(5", "5)", "1 2", "abc", "1.2.3", "$ 5", "١", "8.525,15"])
def test_invalid_amounts(text):
    assert b.parse_cents(text) is None


def test_signs():
    assert [b.parse_cents(x) for x in ("(1.5)", "-1.5", "(-1.5)", "1.5", ".05")] == [-150, -150, 150, 150, 5]


@pytest.mark.parametrize(("text", "day"), [("2024-02-29", date(2024, 2, 29)), ("2/9/24", date(2024, 2, 9)), ("12/31/2025", date(2025, 12, 31)), ("20250101", date(2025, 1, 1)), ("Mar 3, 2025", date(2025, 3, 3)), ("september 30, 2025", date(2025, 9, 30)), ("5-MAY-25", date(2025, 5, 5)), ("05-March-2025", date(2025, 3, 5))])
def test_days(text, day):
    assert b.parse_day(text) == day


@pytest.mark.parametrize("text", ["", "2026-02-30", "2026-2-3", "13/1/2025", "1/32/25", "202509", "00000000", "Foo 20, 2025", "Mar 3 2025", "31-Apr-2025", "3.4.2025", "yesterday", "2025-01-01x", "Sept 3, 2025"])
def test_no_days(text):
    assert b.parse_day(text) is None


@pytest.mark.parametrize(
    ("record", "reasons"),
    [
        ("2025-01-02,rent,,5.00,dep", []),
        ('2025-01-02,"rent, ""May""",,5.00,dep', []),
        ('2025-01-02,"two\nlines",,5.00,dep', []),
        ('2025-01-02,"open,,5.00,dep', ["quoting"]),
        ('2025-01-02,"x" y,,5.00,dep', ["quoting"]),
        ('2025-01-02,a "b",,5.00,dep', ["quoting"]),
        ("2025-01-02,rent,,5.00", ["column_count"]),
        ("2025-01-02,rent,,5.00,dep,", ["column_count"]),
        ("x,rent,,5.00,dep", ["date"]),
        ("2025-01-02,rent,5,5,dep", ["amount"]),
        ("2025-01-02,rent, , ,dep", ["amount"]),
        (",,,,", ["date", "amount"]),
        (" 2025-01-02 , rent ,, 5 ,dep", []),
    ],
)
def test_reasons(record, reasons):
    assert LAYOUT.diagnose(record)[5] == reasons


CELL = st.one_of(st.sampled_from(["2025-01-02", "5.00", "$1,234.5", "", " ", "x", '"q"', '"a,b"', '"a""b"', '"', 'a"b', "1/31/25", "2/30/25", "(3)", '"l\nm"', "l\nm"]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(CELL, min_size=3, max_size=7).map(",".join), min_size=1, max_size=60), st.integers(0, 40))
def test_bulk_equals_strict(records, clean):
    texts = [r for r in records + ["2025-03-04,rent,,12.50,dep"] * clean if r.strip()]
    random.Random(len(texts)).shuffle(texts)
    if texts:
        assert LAYOUT.read(pa.array(texts)) == [LAYOUT.diagnose(t) for t in texts]


def test_bulk_path_is_taken():
    texts = pa.array([f'2025-03-{k % 28 + 1:02d},"rent, {k}",,{k}.50,dep' for k in range(300)])
    assert LAYOUT.bulk(texts) == [LAYOUT.diagnose(t) for t in texts.to_pylist()]


FILES = "file_id long, header_line string, delim string, received_at timestamp, line_no int"


def _found(spark, rows, records, files=None):
    f = spark.createDataFrame(files if files is not None else [(1, HEADER, ",", datetime(2025, 1, 1), 3), (1, HEADER, ",", datetime(2025, 1, 1), 3), (2, HEADER.replace(",", ";"), ";", datetime(2025, 1, 1), 3)], FILES)
    r = spark.createDataFrame(records, "file_id long, line_no int, raw_text string, delim string")
    p = b.parse_records(r, f)
    return rows(b.failed(p)), rows(b.valid(p))


def test_tables(spark, rows):
    good, bad = "2025-01-02,rent,,5.00,dep", "2025-01-02,rent,x,,dep"
    failed, valid = _found(spark, rows, [(1, 1, good, "x"), (1, 1, good, "x"), (1, 2, bad, "x"), (1, 2, bad, "x"), (1, 3, None, "x"), (1, 4, "", "x"), (1, 5, " \t\n", "x"), (2, 1, good, "x"), (2, 2, good.replace(",", ";"), "x"), (9, 1, bad, "x")])
    assert failed == [(1, 2, "amount"), (2, 1, "column_count")]
    assert valid == [(1, 1, date(2025, 1, 2), 500, "rent", "dep", None), (2, 2, date(2025, 1, 2), 500, "rent", "dep", None)]


def test_long_and_huge(spark, rows):
    failed, valid = _found(spark, rows, [(1, 1, f'2025-01-02,"{"y" * 500_000}",,5.00,dep', "x"), (1, 2, "2025-01-02,rent,," + "9" * 40 + ",dep", "x")])
    assert failed == [] and [v[3] for v in valid] == [500, None]


def test_empty(spark, rows):
    assert _found(spark, rows, []) == ([], [])
    assert _found(spark, rows, [(1, 1, "x", "y")], []) == ([], [])
