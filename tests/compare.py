"""Runs queries beside their SQL and compares names and values, whatever the order."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def _plain(v: object) -> object:
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v) if v is not None else None


def compare(spark, sf_dir: str, name: str) -> str | None:
    """What differs between a query and its SQL; null if nothing."""
    import duckdb

    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    mine = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=str)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in con.description]
    if sorted(names) != cols:
        return f"{name}: columns {cols} and {sorted(names)}"
    order = [names.index(c) for c in cols]
    theirs = sorted((tuple(_plain(r[k]) for k in order) for r in con.fetchall()), key=str)
    if mine != theirs:
        only = [r for r in mine if r not in set(theirs)][:3], [r for r in theirs if r not in set(mine)][:3]
        return f"{name}: {len(mine)} and {len(theirs)} rows; only here {only[0]}, only in SQL {only[1]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tallyweave.session import local_session

    spark = local_session()
    names = sys.argv[2:] or list(entry.oracle_sql())
    for n in names:
        began = time.time()
        try:
            said = compare(spark, sys.argv[1], n)
        except Exception as e:  # noqa: BLE001
            said = f"{n}: {str(e)[:700]}"
        print(f"{time.time() - began:.1f} s", said or f"{n} ok", flush=True)
