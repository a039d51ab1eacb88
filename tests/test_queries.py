"""Every query with SQL gives what its SQL gives; the others run. On the smallest driver tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.compare import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_against_sql(spark, name):
    assert compare(spark, SF, name) is None


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql()])
def test_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
