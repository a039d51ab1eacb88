"""The matcher on planted movements: precision and recall without labels, its parts, and hostile tables."""

from __future__ import annotations

import itertools
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import entity_match as em

BANK = "entry_id long, account string, date date, amount long, memo string, kind string, party string, loaded_at timestamp"
BOOK = BANK.replace("account", "ledger_name")
SYLLABLES = ["dor", "vel", "kas", "min", "tor", "pel", "ras", "lun", "gri", "bor", "hal", "zen", "qui", "mar"]


def _plant(seed=1, movements=1200, ledgers=12):
    """Bank rows, book rows and the true pairs: late posting, typos, fees, swapped digits, missing parties, sums."""
    rng = random.Random(seed)
    name = lambda: ("".join(rng.choice(SYLLABLES) for _ in range(3)).title(), "".join(rng.choice(SYLLABLES) for _ in range(2)).title())
    tenants = [(led, *name(), rng.randint(50, 400) * 1000 + rng.choice([0, 0, 0, rng.randint(1, 999)])) for led in range(ledgers) for _ in range(max(14, movements // (6 * ledgers)))]
    start, t = date(2025, 1, 1), datetime(2025, 6, 1)
    bank, book, true, n = [], [], set(), iter(range(10**6))

    def add(rows, place, day, amount, memo, kind, party):
        i = next(n)
        rows.append((i, place, day, amount, memo, kind, party, t))
        return i

    for (led, last, first, rent), month in rng.sample([(x, m) for x in tenants for m in range(12)], movements):
        day = start + timedelta(days=30 * month + rng.randint(0, 5))
        acct, ledger = f"x-{led:04d}" if rng.random() > 0.02 else None, f"Ledger {led}"
        shape = rng.random()
        if shape < 0.1:  # numbered cheque, out, late
            ref, amount = rng.randint(10_000, 99_999), -rng.randint(10_000, 500_000)
            k = add(book, ledger, day, amount, f"Check #{ref}", "check", f"{first} {last}")
            b = add(bank, acct, day + timedelta(days=rng.randint(0, 12)), amount, f"CHK#00{ref}", "check", None)
        elif shape < 0.15:  # one bank entry for several
            group = [x for x in tenants if x[0] == led]
            some = rng.sample(group, 3)
            ks = [add(book, ledger, day, rng.randint(10_000, 90_000), "Rent", "deposit", f"{g} {s}") for _, s, g, _ in some]
            total = sum(r[3] for r in book[-3:])
            b = add(bank, acct, day + timedelta(days=rng.randint(0, 2)), total, "BATCH DEP 3 ITEMS " + "/".join(s.upper()[:6] for _, s, _, _ in some), "deposit", None)
            true |= {(b, k) for k in ks}
            continue
        else:
            amount = rent if rng.random() < 0.9 else rng.choice([rent + rng.randint(-5, 5), int(rent * 0.971) - 30])
            typo = last if rng.random() < 0.9 else last[:2] + last[3] + last[2] + last[4:]
            k = add(book, ledger, day, rent, rng.choice(["rent", "Rent received", None]), "deposit", rng.choice([f"{first} {last}", f"{last}, {first}", f"{first[0]}. {last}"]))
            b = add(bank, acct, day + timedelta(days=rng.randint(-1, 6)), amount, rng.choice([f"ACH DEP {typo.upper()} {first[0].upper()}", f"ZEL FROM {first.upper()} {typo.upper()}"]), rng.choice(["deposit", "other", None]), rng.choice([None, "", last.upper()]))
        fate = rng.random()
        if fate < 0.04:
            bank.pop()
        elif fate < 0.08:
            book.pop()
        else:
            true.add((b, k))
    return bank, book, true


@pytest.fixture(scope="module")
def planted(spark):
    bank, book, true = _plant()
    a = spark.createDataFrame(bank + bank[:40], BANK).withColumn("confidence", F.lit("x"))
    b = spark.createDataFrame(book + book[:40], BOOK)
    got = [(r.id_a, r.id_b, r.confidence) for r in em.match(a, b).collect()]
    return got, true


def test_precision_and_recall(planted):
    got, true = planted
    pairs = {(a, b) for a, b, _ in got}
    right = len(pairs & true)
    assert right / len(pairs) > 0.93 and right / len(true) > 0.93


def test_each_part_once_and_confidence(planted):
    got, _ = planted
    assert len({b for _, b, _ in got}) == len(got)
    assert all(0.5 <= c <= 1 for *_, c in got)


def test_other_months_are_other_movements(spark):
    t = datetime(2025, 6, 1)
    bank = [(k, "a", date(2025, m, 3), 100_000, "ACH DEP DORVEL K", "deposit", None, t) for k, m in enumerate((1, 2, 4, 5))]
    book = [(10 + k, "L", date(2025, m, 2), 100_000, "rent", "deposit", "Kas Dorvel", t) for k, m in enumerate((1, 2, 3, 5))]
    filler = _plant(2, 300, 3)
    a = spark.createDataFrame(bank + [(r[0] + 1000, *r[1:]) for r in filler[0]], BANK)
    b = spark.createDataFrame(book + [(r[0] + 1000, *r[1:]) for r in filler[1]], BOOK)
    assert sorted((r.id_a, r.id_b) for r in em.match(a, b).collect() if r.id_b < 1000) == [(0, 10), (1, 11), (3, 13)]


@pytest.mark.parametrize(("a", "b", "low", "high"), [(["DORVEL", "K"], ["KAS", "DORVEL"], 0.97, 1), (["DORVEL"], ["KAS", "DORVLE"], 0.85, 1), (["ANN", "LEE"], ["BOB", "LEE"], 0.4, 0.75), (["XYZZY"], ["QUORUM"], 0, 0.4)])
def test_name_likeness(spark, a, b, low, high):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert low <= df.select(em.name_likeness(F.col("a"), F.col("b"), F.lit(False)).alias("x")).first().x <= high


def test_numbers_and_units(spark):
    t = datetime(2025, 1, 1)
    rows = [(1, "a", date(2025, 1, 1), 1, "MOBILE DEPOSIT conf. 151 727", None, None, t), (2, "a", date(2025, 1, 1), 1, "CHK#0025921", None, "Ann (4B)", t), (3, "", date(2025, 1, 1), 1, "Rent unit N-38", None, None, t), (3, "", date(2025, 1, 1), 2, "Rent unit N-38", None, None, t + timedelta(days=1)), (4, "a", None, 1, None, None, None, t), (None, "a", date(2025, 1, 1), 1, None, None, None, t)]
    got = {r.id: r for r in em.entries(spark.createDataFrame(rows, BANK), "account").collect()}
    assert sorted(got) == [1, 2, 3] and got[1].refs == ["151727"] and got[2].refs == ["25921"] and got[2].unit == "4B" and got[3].unit == "N-38" and got[3].place is None and got[3].amount == 2


@pytest.mark.parametrize("swap", [False, True])
def test_empty_tables(spark, swap):
    bank, book, _ = _plant(3, 30, 2)
    a, b = spark.createDataFrame(bank, BANK), spark.createDataFrame(book, BOOK)
    assert em.match(a.limit(0) if not swap else a, b if not swap else b.limit(0)).count() == 0
    assert em.match(a.limit(0), b.limit(0)).count() == 0


def test_nulls_everywhere_and_long_texts(spark):
    t = datetime(2025, 1, 1)
    bank, book, true = _plant(4, 400, 3)
    odd = [(10**7 + k, None, date(2025, 1, 1), 5, None, None, None, None) for k in range(5)] + [(10**7 + 9, "z" * 10_000, date(2025, 1, 1), -(2**62), "m " * 50_000, "k", "p" * 20_000, t)]
    got = {(r.id_a, r.id_b) for r in em.match(spark.createDataFrame(bank + odd, BANK), spark.createDataFrame(book + odd, BOOK)).collect()}
    assert len(got & true) > 0.85 * len(true)


def test_hot_class_is_linear(spark):
    t = datetime(2025, 1, 1)
    bank, book, true = _plant(5, 400, 3)
    same = [(10**7 + k, "x-0001", date(2025, 3, 4), 77_700, "ACH DEP DORVELKAS M", "deposit", None, t) for k in range(3000)]
    twin = [(2 * 10**7 + k, "Ledger 1", date(2025, 3, 3), 77_700, "rent", "deposit", "Minvel Dorvelkas", t) for k in range(2900)]
    found = em.match(spark.createDataFrame(bank + same, BANK), spark.createDataFrame(book + twin, BOOK)).collect()
    hot = [(r.id_a, r.id_b) for r in found if r.id_a >= 10**7]
    assert len(hot) == 2900 and len({a for a, _ in hot}) == len({b for _, b in hot}) == 2900
    assert len({(r.id_a, r.id_b) for r in found} & true) > 0.85 * len(true)


@pytest.mark.parametrize("kinds", [("deposit", "transfer"), ("deposit", "deposit")])
def test_members_left_over_go_to_the_next_class(spark, kinds):
    t = datetime(2025, 1, 1)
    bank, book, _ = _plant(6, 400, 3)
    same = [(10**7 + k, "x-0001", date(2025, 3, 4), 77_700, "ACH DEP DORVELKAS M", "deposit", None, t) for k in range(100)]
    twins = [(2 * 10**7 + k, "Ledger 1", date(2025, 3, 3 + (k >= 50)), 77_700, "rent", kinds[k >= 50], "Minvel Dorvelkas", t) for k in range(100)]
    found = [(r.id_a, r.id_b) for r in em.match(spark.createDataFrame(bank + same, BANK), spark.createDataFrame(book + twins, BOOK)).collect() if r.id_a >= 10**7]
    assert len(found) == 100 and len({a for a, _ in found}) == len({b for _, b in found}) == 100


def test_two_collective_entries_share_a_class(spark):
    t = datetime(2025, 1, 1)
    bank, book, _ = _plant(7, 400, 3)
    batch = [(10**7 + k, "x-0001", date(2025, 3, 4 + k), 60_000, "BATCH DEP 2 ITEMS ZENQUI/MARPEL", "deposit", None, t) for k in range(2)]
    parts = [(2 * 10**7 + 2 * k + j, "Ledger 1", date(2025, 3, 3), v, "Rent", "deposit", who, t) for k in range(2) for j, (v, who) in enumerate(((20_000, "Hal Zenquilun"), (40_000, "Bor Marpelgri")))]
    found = [(r.id_a, r.id_b) for r in em.match(spark.createDataFrame(bank + batch, BANK), spark.createDataFrame(book + parts, BOOK)).collect() if r.id_a >= 10**7]
    assert sorted(b for _, b in found) == [r[0] for r in parts] and sorted(a for a, _ in found) == [10**7, 10**7, 10**7 + 1, 10**7 + 1]


def test_chains_are_followed_to_the_end(spark):
    class Given:
        def log_odds(self):
            return F.col("odds_of_test")

    # Each entry is drawn to the one before until that is taken, so that each round frees one pair.
    rows = [(i + j, 100 + i, False, 1, 1, 1, 1, 30.0 - 3 * i - 1.5 * j) for i in range(10) for j in (0, 1)]
    x = spark.createDataFrame(rows, "id_a long, id_b long, summed boolean, uses long, n_a long, n_b long, days int, odds_of_test double")
    assert sorted((r.id_a, r.id_b) for r in em.assign(x, Given()).collect()) == [(i, 100 + i) for i in range(10)]


def test_the_fit_settles_finely():
    assert em.SETTLED <= 0.002


@pytest.mark.parametrize("names", [("AB", "CD"), ("ABC", "CD"), ("ABC", "CDE")])
def test_short_fragments_meet_longer_names(spark, names):
    day, t = date(2025, 3, 3), datetime(2025, 6, 1)
    book = [(10 + k, "L1", day, 1000 * (k + 1), "Rent", "deposit", f"{n}XORVAL TAMSEN", t) for k, n in enumerate(names)]
    # Other entries that link the account with the ledger.
    link = [(100 + k, "L1", day, 7000 + k, f"Check #{50_000 + k}", "check", "Orlan Brigstead", t) for k in range(6)]
    bank = [(1, "A1", day, 3000, "BATCH DEP 2 ITEMS " + "/".join(names), "deposit", None, t)]
    bank += [(200 + k, "A1", day, 7000 + k, f"CHK#{50_000 + k}", "check", None, t) for k in range(6)]
    got = em.match(spark.createDataFrame(bank, BANK), spark.createDataFrame(book + link, BOOK))
    assert {(r.id_a, r.id_b) for r in got.collect() if r.id_a == 1} == {(1, 10), (1, 11)}


def test_sums_leave_members_free_and_follow_cut_windows(monkeypatch):
    # The nearer choice for 5 takes entry 1, which the second fragment alone can use for 7.
    rows = [(0, 1, 5, 0, 1), (0, 2, 5, 2, 1), (1, 1, 7, 0, 1)]
    assert em.add_up(12, 2, rows) == (2, 1)
    assert em.add_up(12, 2, rows[:1] + rows[2:]) == () and em.add_up(10, 2, [(0, 1, 5, 1, 2), (1, 1, 5, 1, 2)]) == (1, 1)
    rng = random.Random(5)
    for _ in range(40):
        rows = sorted({(p, i): (p, i, rng.randint(1, 9), rng.randint(-3, 14), rng.randint(1, 2)) for p in range(3) for i in rng.sample(range(6), 4)}.values())
        rows = [(p, i, *next((v, g, m) for q, j, v, g, m in rows if j == i)) for p, i, *_ in rows]
        total = rng.randint(5, 20)
        every = [(sum(abs(r[3] - 1) for r in c), tuple(r[1] for r in c)) for c in itertools.product(*([r for r in rows if r[0] == p] for p in range(3))) if sum(r[2] for r in c) == total and all([x[1] for x in c].count(r[1]) <= r[4] for r in c)]
        near = next((w for w in (1, 3, 7, 14) if any(all(abs(dict((r[1], r[3]) for r in rows)[i]) <= w for i in ids) for _, ids in every)), None)
        best = min(((cost, ids) for cost, ids in every if all(abs(dict((r[1], r[3]) for r in rows)[i]) <= near for i in ids)), default=(0, ()))[1]
        assert em.add_up(total, 3, rows) == best
        monkeypatch.setattr(em, "SUMS", 0)
        assert em.add_up(total, 3, rows) == min(every, default=(0, ()))[1]
        monkeypatch.undo()
