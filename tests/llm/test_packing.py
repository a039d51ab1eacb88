"""Containers: capacity, completeness, waste and hostile sizes."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm import packing


def _loads(counts, capacity, groups):
    """Container loads of a plan; every item is looked up in its segment, as the operator does."""
    segments, n = packing.plan(counts, capacity, groups)
    load, seen = Counter(), Counter()
    for s, low, high, per, first in segments:
        assert high > low
        for r in range(low, high):
            load[first + (r - low) // per] += s
        seen[s] += high - low
    by = defaultdict(list)
    for s, low, high, *_ in segments:
        by[s].append((low, high))
    for s, parts in by.items():
        assert [p[0] for p in sorted(parts)] == [0, *[p[1] for p in sorted(parts)][:-1]]
    assert seen == Counter({s: c for s, c in counts.items() if c})
    assert all(v <= capacity for v in load.values()) and (not load or (max(load) < n and len(load) == n))
    return load


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=30), st.integers(1, 12))
def test_any_counts(counts, groups):
    load = _loads(counts, 64, groups)
    total = sum(s * c for s, c in counts.items())
    least = -(-total // 64)
    # Never worse than best-fit, longest first, whose bound is that of first-fit decreasing.
    best = max(least, sum(c for s, c in counts.items() if s > 32))
    assert len(load) <= max(11 / 9 * best + 1, 3 / 2 * best + 1)


def test_large_items_by_configurations():
    counts = {700: 300, 690: 300, 650: 300, 1300: 100, 1000: 200, 1030: 50}
    load = _loads(counts, 2048, 12)
    # By hand: 100 with 1300, 125 with 1000 and 1030, the other 800 by threes.
    assert len(load) <= 100 + 125 + 267 + 6


def test_small_items_fill_up():
    rng = random.Random(1)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(5.2, 0.8)))) for _ in range(20_000))
    load = _loads(counts, 2048, packing.GROUPS)
    assert len(load) <= -(-sum(s * c for s, c in counts.items()) // 2048) + 1


def test_configurations_solve_the_relaxation():
    import numpy as np

    patterns, use = packing.configurations(np.array([6, 5, 3]), np.array([10.0, 10.0, 10.0]), 11)
    assert (patterns.T @ np.array([6, 5, 3]) <= 11).all() and np.allclose(patterns @ use, [10, 10, 10])
    assert use.sum() == pytest.approx(10 + 10 / 3, abs=1e-6)


def _packed(spark, sizes, **kw):
    df = spark.createDataFrame([(k, n, "x") for k, n in enumerate(sizes)], "doc_id long, tokens long, container_id string")
    return [tuple(r) for r in packing.pack(df, **kw).select("doc_id", "piece_no", "tokens", "container_id").collect()]


def _check(sizes, rows, capacity):
    load, own = Counter(), defaultdict(list)
    for k, piece, n, c in rows:
        own[k].append((piece, n))
        assert (c is None) == (n == 0)
        load[c] += n
    load.pop(None, None)
    assert all(v <= capacity for v in load.values())
    for k, n in enumerate(sizes):
        n = n or 0
        assert sum(x for _, x in own[k]) == n
        assert [p for p, _ in sorted(own[k])] == list(range(max(1, -(-n // capacity))))
        assert all(x == capacity for _, x in sorted(own[k])[:-1])


@pytest.mark.parametrize("sizes", [[], [0], [None, 0], [1], [2048], [2049], [100_000, 5, 5, 5], [7] * 300, [2047, 2048, 2049, 1, 1, None], [1500] * 20 + [500] * 20 + [40] * 100])
def test_tables(spark, sizes):
    _check(sizes, _packed(spark, sizes), 2048)


def test_does_not_depend_on_partitions(spark):
    rng = random.Random(2)
    sizes = [rng.choice([3, 3, 3, 60, 200, 900, 1500, 5000]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens long")
    runs = [sorted(tuple(r) for r in packing.pack(df.repartition(n)).collect()) for n in (1, 5)]
    assert runs[0] == runs[1]
    _check(sizes, [(r[0], r[1], r[2], r[3]) for r in runs[0]], 2048)


def test_other_keys_and_capacities(spark):
    df = spark.createDataFrame([("a", 10), ("b", 7), ("c", 3)], "name string, size int")
    got = packing.pack(df, "name", "size", capacity=10, groups=2).collect()
    assert len({r.container_id for r in got}) == 2 and sum(r.tokens for r in got) == 20


def test_methods_tell_what_pack_uses(spark):
    rng = random.Random(9)
    sizes = spark.createDataFrame([(k, rng.choice([None, 0, rng.randint(1, 5000)])) for k in range(400)], "doc_id long, tokens long")
    rows = {r.method: r for r in packing.methods(sizes).collect()}
    packed = packing.pack(sizes).filter("container_id is not null").select("container_id").distinct().count()
    (used,) = (r for r in rows.values() if r.used)
    assert set(rows) == {"linear_grouping", "best_fit"} and used.containers == packed == min(r.containers for r in rows.values()) >= used.lower_bound
    assert {r.containers for r in packing.methods(sizes.limit(0)).collect()} == {0}
