"""The reference's operators on small fixtures: functions, ledgers, manifests, trees, registries, logs, findings."""

from __future__ import annotations

import hashlib
import itertools
import random
import threading
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import dates, decimals, hashing, money, text
from tallyweave.operators import findings as found
from tallyweave.operators import ledger, logs, manifest, merkle, registry

TX = "id long, date date, amount long, memo string, kind string, party string"


def _one(spark, value, of, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(of(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "cents"),
    [("1,234.56", 123456), ("1234", 123400), (".5", 50), ("$1,234.5", 123450), ("(1,234.56)", -123456), ("-5", -500), ("(-5)", 500), ("+ 5", 500), (" $ -7.10 ", -710), ("5.", 500)]
    + [(x, None) for x in ("", " ", None, "10.005", "1,23", "--5", "-$5", "(5", "5-", "1e3", "NaN", "99999999999999999999", ".")],
)
def test_parse_cents(spark, value, cents):
    assert _one(spark, value, money.parse_cents) == cents


@pytest.mark.parametrize(("cents", "shown"), [(123456, "$1,234.56"), (-5, "-$0.05"), (0, "$0.00"), (100000000, "$1,000,000.00"), (None, None)])
def test_format_cents(spark, cents, shown):
    assert _one(spark, cents, money.format_cents, "long") == shown


@pytest.mark.parametrize(
    ("value", "day"),
    [("2026-05-01", date(2026, 5, 1)), ("5/1/26", date(2026, 5, 1)), ("20260501", date(2026, 5, 1)), ("Jan 5, 2024", date(2024, 1, 5)), ("Sept. 5 2024", date(2024, 9, 5)), ("5-Jan-24", date(2024, 1, 5)), ("29-feb-2024", date(2024, 2, 29))]
    + [(x, None) for x in (None, "", "2026-02-30", "13/1/2026", "Foo 1, 2026", "2026-5-1", "1-13-2026")],
)
def test_parse_date(spark, value, day):
    assert _one(spark, value, dates.parse_date) == day


def test_kinds_and_keys(spark):
    k = lambda raw, memo, cents: spark.createDataFrame([(raw, memo, cents)], "r string, m string, c long").select(text.coerce_kind(F.col("r"), F.col("m"), F.col("c")).alias("x")).first().x
    assert [k("Deposit", "NSF returned", 5), k("XFER", "rent", 5), k(None, "rent May", 5), k("", "", -5), k("weird", "", 0), k(None, "service charge", -1)] == ["nsf", "transfer", "deposit", "check", "other", "fee"]
    assert _one(spark, "  A \t b ", text.party_key) == "a b" and _one(spark, None, text.party_key) == "unknown" and _one(spark, " ", text.party_key) == "unknown"
    assert sorted(["BR-10", "BR-9", "BR-CO-2"], key=lambda s: _one(spark, s, text.natural_key)) == ["BR-9", "BR-10", "BR-CO-2"]
    sim = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(text.memo_similarity(F.col("a"), F.col("b")).alias("x")).first().x
    assert [sim(None, ""), sim("rent", None), sim("rent may", "Rent"), sim("a b", "B a")] == [1.0, 0.0, 0.5, 1.0]


def test_paths(spark):
    under = lambda p, q: _one(spark, p, lambda c: text.under_prefix(c, F.lit(q)))
    assert [under("a/b", "a/b"), under("a/b/c", "a/b/"), under("a/bc", "a/b")] == [True, True, False]
    assert [_one(spark, p, text.unsafe_path) for p in ("a/b", "/a", "../a", "a/../b", "C:\\x", "a..b")] == [False, True, True, True, True, False]


def test_rounding(spark):
    d = lambda v, f: str(_one(spark, v, lambda c: f(decimals.to_decimal(c)).cast("decimal(20,2)")))
    assert d("-2.5", lambda c: decimals.xpath_round(c)) == "-2.00" and d("-2.5", lambda c: decimals.half_up(c, 0)) == "-3.00"
    assert d("1.005", decimals.half_up) == "1.01" and d("-1.005", decimals.xpath_round_cents) == "-1.00"
    assert _one(spark, "NaN", decimals.to_decimal) is None and _one(spark, "1e3", decimals.to_decimal) is None
    assert [_one(spark, s, decimals.decimal_places) for s in ("1", "1.", "1.25", None)] == [0, 0, 2, None]


def test_keccak_vectors():
    assert hashing.keccak_many([b""])[0].hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert hashing.keccak_many([b"abc"])[0].hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    many = [bytes([k % 256]) * k for k in range(300)]
    assert hashing.keccak_many(many) == [hashing.keccak_many([m])[0] for m in many]


# --- Ledgers


def _tx(spark, *items):
    return spark.createDataFrame([(i, date(2026, 5, d) if d else None, a, m, k, p) for i, d, a, m, k, p in items], TX)


def test_balances_and_tie_out(spark, rows):
    t = _tx(spark, (1, 1, 5, "", "", " A "), (2, 1, -7, "", "", "A"), (3, 1, 1, "", "", None), (4, 1, None, "", "", ""))
    assert rows(ledger.party_balances(t)) == [("A", -2), ("unknown", 1)]
    assert rows(ledger.negative_balances(ledger.party_balances(t), 1)) == [("A", -2)]
    assert rows(ledger.negative_balances(ledger.party_balances(t), 0, ledger.party_balances(t))) == []
    assert rows(ledger.tie_out({"a": t, "b": t, "c": t.limit(0)}, 1)) == [(-1, -1, 0, 1, True)]


def test_residue(spark, rows):
    a = _tx(spark, (1, 1, 5, "a", "", ""), (2, 1, 5, "b", "", ""), (3, 1, 5, "c", "", ""), (4, 1, 9, "", "", ""))
    b = _tx(spark, (7, 2, 5, "", "", ""), (8, 3, 5, "", "", ""), (9, 3, 1, "", "", ""))
    assert rows(ledger.residue(a, b), "id") == [(3,), (4,)] and rows(ledger.residue(b, a), "id") == [(9,)]
    assert rows(ledger.residue(a, b.limit(0)), "id") == [(1,), (2,), (3,), (4,)] and rows(ledger.residue(a.limit(0), b)) == []


def _passes(spark, a, b, **kw):
    out = ledger.match_all(a, b, (F.col("kind") == "nsf") | F.lower("memo").rlike(text.RETURNED), **kw)
    m = sorted((r.id_a, r.id_b, r.kind, round(r.confidence, 6)) for r in out["matched"].collect())
    s = sorted((r.id, tuple(r.part_ids), r.single_side) for r in out["splits"].collect())
    return m, s, sorted(r.id for r in out["unmatched_a"].collect()), sorted(r.id for r in out["unmatched_b"].collect())


def test_passes_of_the_matcher(spark):
    a = _tx(spark, (1, 1, 100, "rent", "", ""), (2, 5, 200, "rent may", "", ""), (3, 9, -300, "NSF", "nsf", ""), (4, 20, 600, "", "", ""), (5, 28, 77, "", "", ""))
    b = _tx(spark, (11, 2, 100, "rent", "", ""), (12, 1, 100, "rent", "", ""), (13, 6, 200, "rent may", "", ""), (14, 8, 300, "dep", "", ""), (15, 20, 250, "", "", ""), (16, 21, 350, "", "", ""), (17, 1, 77, "", "", ""))
    m, s, ua, ub = _passes(spark, a, b)
    assert m == [(1, 12, "exact", 1.0), (2, 13, "window", 0.875), (3, 14, "reversal", 0.375)]
    assert s == [(4, (15, 16), "a")] and ua == [5] and ub == [11, 17]


def test_matcher_does_not_depend_on_order_and_loses_nothing(spark):
    rng = random.Random(3)
    items = [(i, rng.randint(1, 9), rng.choice([100, 200, 300, -100, 700]), rng.choice(["a b", "a", ""]), rng.choice(["", "nsf"]), "") for i in range(60)]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(items)
        a = _tx(spark, *[x for x in items if x[0] < 30]).repartition(seed + 1)
        b = _tx(spark, *[x for x in items if x[0] >= 30]).repartition(3)
        got = _passes(spark, a, b)
        m, s, ua, ub = got
        ids_a = [x[0] for x in m] + [x[0] for x in s if x[2] == "a"] + [p for x in s if x[2] == "b" for p in x[1]] + ua
        ids_b = [x[1] for x in m] + [x[0] for x in s if x[2] == "b"] + [p for x in s if x[2] == "a" for p in x[1]] + ub
        assert sorted(ids_a) == list(range(30)) and sorted(ids_b) == list(range(30, 60))
        want = want or got
        assert got == want


def test_hot_amount_is_paired_to_the_end(spark):
    same = lambda ids, day: [(i, day, 500, "rent", "", "") for i in ids]
    got = sorted(tuple(r) for r in ledger.match_window(_tx(spark, *same(range(40), 5)), _tx(spark, *same(range(100, 130), 6))).select("id_a", "id_b").collect())
    assert got == [(k, 100 + k) for k in range(30)]
    back = [(i, 6, -500, "rent", "nsf", "") for i in range(100, 130)]
    assert ledger.match_reversals(_tx(spark, *same(range(40), 5)), _tx(spark, *back), F.col("kind") == "nsf").count() == 30


def test_window_and_reversals_against_greedy_by_hand(spark):
    rng = random.Random(11)
    rows = [[(s + i, rng.randint(1, 9), rng.choice([100, 100, 100, -100, 250]), rng.choice(["a b", "a", "", None, "b c"]), rng.choice(["", "nsf"]), "") for i in range(70)] for s in (0, 1000)]
    a, b = (_tx(spark, *x) for x in rows)
    words = lambda m: set((m or "").split())
    score = lambda m, n: 1.0 if words(m) == words(n) else len(words(m) & words(n)) / len(words(m) | words(n))

    def by_hand(sign, days, may):
        pairs = sorted((abs(x[1] - y[1]), -score(x[3], y[3]), x[0], y[0]) for x in rows[0] for y in rows[1] if x[2] == sign * y[2] and abs(x[1] - y[1]) <= days and may(x, y))
        used, out = set(), []
        for *_, i, j in pairs:
            if i not in used and j not in used:
                used |= {i, j}
                out.append((i, j))
        return sorted(out)

    pick = lambda df: sorted((r.id_a, r.id_b) for r in df.collect())
    assert pick(ledger.match_window(a, b, 3)) == by_hand(1, 3, lambda x, y: True)
    assert pick(ledger.match_reversals(a, b, F.col("kind") == "nsf", 2)) == by_hand(-1, 2, lambda x, y: "nsf" in (x[4], y[4]))


def test_splits_decline_and_serve_once(spark):
    one = _tx(spark, (1, 5, 60, "", "", ""), (2, 5, 60, "", "", ""))
    parts = _tx(spark, *[(10 + k, 5, v, "", "", "") for k, v in enumerate((10, 20, 30))])
    assert [(r.id, r.part_ids) for r in ledger.match_splits(one, parts).collect()] == [(1, [10, 11, 12])]
    assert ledger.match_splits(one, parts, most_parts=2).count() == 0 and ledger.match_splits(one, parts, most_candidates=2).count() == 0
    assert ledger.match_splits(one, parts.limit(0)).count() == 0


def test_rows_that_lose_a_part_choose_again(spark):
    one = _tx(spark, *[(k, 5, 60, "", "", "") for k in (1, 2, 3, 4)])
    parts = _tx(spark, *[(10 + k, 5, v, "", "", "") for k, v in enumerate((10, 50, 20, 40, 25, 35, 59))])
    got = sorted((r.id, tuple(r.part_ids)) for r in ledger.match_splits(one, parts).collect())
    assert got == [(1, (10, 11)), (2, (12, 13)), (3, (14, 15))]


def test_declined_splits_are_reported(spark):
    parts = _tx(spark, *[(10 + k, 5, v, "", "", "") for k, v in enumerate((10, 20, 30, 40, 50))])
    out = ledger.match_all(_tx(spark, (1, 5, 60, "", "", ""), (2, 20, 60, "", "", "")), parts, F.lit(False), most_candidates=4)
    assert [tuple(r) for r in out["declined_a"].collect()] == [(1, 5)] and out["declined_b"].count() == 0
    assert sorted(r.id for r in out["unmatched_a"].collect()) == [1, 2]


def test_splits_against_brute_force(spark):
    rng = random.Random(5)
    for _ in range(3):
        single = [(i, rng.randint(1, 20), rng.randint(50, 200), "", "", "") for i in range(8)]
        parts = [(100 + i, rng.randint(1, 20), rng.randint(5, 100), "", "", "") for i in range(25)]
        got = {r.id for r in ledger.match_splits(_tx(spark, *single), _tx(spark, *parts), 3, 3, 24).collect()}
        can = set()
        for i, d, v, *_ in single:
            pool = [(p, w) for p, e, w, *_ in parts if abs(e - d) <= 3 and w < v]
            if 2 <= len(pool) <= 24 and any(sum(w for _, w in c) == v for n in (2, 3) for c in itertools.combinations(pool, n)):
                can.add(i)
        assert got <= can and (not can or got)


def test_attribution_and_allocation(spark, rows):
    texts = spark.createDataFrame([(1, "Transfer to escrow for Ann Lee Park"), (2, "transfer Lee"), (3, None), (4, "annlee")], "id long, memo string")
    names = spark.createDataFrame([("Ann Lee",), ("lee",), ("crow",), ("",), ("Ann Lee",)], "name string")
    assert rows(ledger.attribute(texts, names)) == [(1, "Ann Lee"), (2, "lee"), (3, None), (4, None)]
    needs = _tx(spark, (1, 1, 100, "", "", "A"), (2, 2, 100, "", "", "A"), (3, 3, 50, "", "", None), (4, 4, 80, "", "", "B")).drop("kind")
    own = spark.createDataFrame([("a", 150), ("b", 10), ("b", 5)], "party string, cents long")
    assert [tuple(r)[-3:] for r in ledger.allocate(needs, own, 120).orderBy("id").collect()] == [(100, 0, 0), (50, 50, 0), (0, 50, 0), (15, 20, 45)]
    assert ledger.allocate(needs.limit(0), own, 5).count() == 0


def test_attribution_of_many_names_with_one_first_word(spark):
    n, group = 30_000, "one first word"
    names = spark.range(n).select(F.concat(F.lit("R. Kes"), "id").alias("name"))
    texts = spark.range(n).select("id", F.concat(F.lit("ZEL FROM R KES"), "id").alias("memo"))
    timer = threading.Timer(60, lambda: spark.sparkContext.cancelJobGroup(group))  # pairing by first words takes minutes
    spark.sparkContext.setJobGroup(group, group, True)
    timer.start()
    try:
        right = F.count_if(F.col("name") == F.concat(F.lit("R. Kes"), "id"))
        assert tuple(ledger.attribute(texts, names).agg(F.count("*"), right).first()) == (n, n)
    finally:
        timer.cancel()
        spark.sparkContext.setJobGroup("other", "other")


def test_attribution_of_odd_rows(spark, rows):
    texts = spark.createDataFrame([(1, "zel from ann"), (1, "zel to bo"), (2, "from " * 3000 + "ann"), (None, "ann"), (3, "zel zel"), (4, "--"), (4, None), (5, "zel from bo lee")], "id long, memo string")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    # Of names of the same words the one with more letters, then the least; `zel` is common and begins a name, `from` is not.
    found = ledger.attribute(texts, names("Ann", "ann.", "-ann", "Bo", "Zel zel", "bo from", None, "--"))
    assert rows(found) == [(1, "-ann"), (1, "-ann"), (2, "-ann"), (3, "Zel zel"), (4, None), (4, None), (5, "Bo"), (None, None)]
    nothing = [(i, None) for i in (1, 1, 2, 3, 4, 4, 5, None)]
    assert rows(ledger.attribute(texts, names())) == rows(ledger.attribute(texts, names(None, "--"))) == nothing
    assert ledger.attribute(texts.limit(0), names("Ann")).count() == 0


# --- Manifests


def test_manifest_diff_and_policy(spark, rows):
    m = lambda *x: spark.createDataFrame([(p, h, leaf) for p, h, leaf in x], "path string, content_hash string, leaf string")
    old, new = m(("a", "1", "AB"), ("b", "2", "cd"), ("d/x", "5", "5")), m(("a", "1", "ab"), ("b", "3", "ce"), ("c", "4", "4"))
    assert rows(manifest.compare(old, new)) == [("a", "unchanged", "1", "1"), ("b", "changed", "2", "3"), ("c", "added", None, "4"), ("d/x", "removed", "5", None)]
    assert rows(manifest.drift_violations(manifest.compare(old, new), no_added=True, no_changed=True, frozen=["d"], allow_change=["q"])) == [("b", "allowChangePaths", "CHANGED"), ("b", "noChanged", "CHANGED"), ("c", "noAdded", "ADDED"), ("d/x", "frozenPaths", "REMOVED")]
    assert manifest.drift_violations(manifest.compare(old, new)).count() == 0
    h = spark.createDataFrame([("a", "MIT", None), ("b", None, "s"), ("c", "GPL", "bad")], "path string, license string, source string")
    got = rows(manifest.policy_violations(h, allow_licenses=["MIT"], deny_licenses=["GPL"], deny_sources=["bad"], require_license=True))
    assert got == [("b", "allowLicenses", manifest.NO_LICENSE), ("b", "requireLicense", manifest.NO_LICENSE), ("c", "allowLicenses", "GPL"), ("c", "denyLicenses", "GPL"), ("c", "denySources", "bad")]
    assert rows(manifest.verdict(h, manifest.policy_violations(h))) == [("PASS", 3, 0)]
    assert rows(manifest.histograms(h)) == [("all", "*", 3), ("license", manifest.NO_LICENSE, 1), ("license", "GPL", 1), ("license", "MIT", 1), ("source", manifest.NO_SOURCE, 1), ("source", "bad", 1), ("source", "s", 1)]


# --- Trees


def _folded(leaves):
    k = hashing.keccak_many
    layer = [k([b"\0" + x])[0] for x in sorted(leaves)]
    while len(layer) > 1:
        layer = [k([b"\1" + min(p) + max(p)])[0] for p in ((layer[i], layer[min(i + 1, len(layer) - 1)]) for i in range(0, len(layer), 2))]
    return layer[0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50])
def test_sorted_tree(spark, n):
    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
    df = spark.createDataFrame([(x, 1) for x in leaves], "digest binary, pos int").repartition(3)
    root = merkle.sorted_root(df).first().root
    assert root == _folded(leaves).hex()
    assert {r.x for r in merkle.sorted_proofs(df).select(F.lower(F.hex(merkle.fold_proof("digest", "proof"))).alias("x")).collect()} == {root}


def test_empty_tree(spark):
    df = spark.createDataFrame([], "digest binary")
    assert merkle.sorted_root(df).count() == 0 and merkle.sorted_proofs(df).count() == 0


def test_log_tree_exhaustively():
    leaves = [bytes([k]) * 32 for k in range(18)]
    for n in range(1, 18):
        log = merkle.Log(leaves[:n])
        root = log.root(0, n)
        for i in range(n):
            path = log.inclusion(i)
            assert merkle.inclusion_holds(leaves[i], i, n, path, root)
            assert n == 1 or not merkle.inclusion_holds(leaves[i], (i + 1) % n, n, path, root)
            assert not merkle.inclusion_holds(b"x" * 32, i, n, path, root) and not merkle.inclusion_holds(leaves[i], i, n, [*path, root], root)
        for m in range(n + 1):
            first = merkle.log_root(leaves[:m])
            assert merkle.consistency_holds(m, n, log.consistency(m), first, root)
            if 0 < m < n:
                assert not merkle.consistency_holds(m, n, log.consistency(m), b"y" * 32, root)


# --- Registries

REC = "content_hash string, contributor string, author_bound boolean, timestamp long, block_number long, uri string, parent string, index long"


def _rec(spark, *items):
    h = lambda n: None if n is None else "0x" + f"{n:064x}"
    return spark.createDataFrame([(h(c), a, bound, 10 * b, b, "", h(p), i) for i, (c, a, bound, b, p) in enumerate(items)], REC)


A, B = "0x" + "a" * 40, "0x" + "B" * 40


def test_registry(spark, rows):
    r = _rec(spark, (1, A, True, 5, None), (1, B, True, 6, None), (2, B, False, 7, 1), (3, A.upper().replace("0X", "0x"), True, 5, 1), (4, "bad", True, 8, None))
    assert sorted((x["index"], x["outcome"]) for x in registry.graded(r).collect()) == [(0, "credited"), (1, "duplicate"), (2, "anchor_only"), (3, "credited"), (4, "invalid")]
    assert rows(registry.points(r)) == [(A, 2)] and rows(registry.at_least(r, 3)) == []
    assert rows(registry.page(r, A, True, 1, 5), "index") == [(3,)] and rows(registry.page(r, None, False, 99, 5)) == []
    s = {x.contributor: x for x in registry.scores(r).collect()}[A]
    assert (s.total, s.author_bound, s.lineage_roots, s.revisions, s.first_block, s.first_timestamp, s.last_timestamp) == (2, 2, 1, 1, 5, 50, 50)
    assert sorted(x["index"] for x in registry.first_writers(r, "content_hash", "block_number", "index").collect()) == [0, 2, 3, 4]
    assert sorted(x["index"] for x in registry.append(r.limit(1), r, "content_hash", "block_number", "index").collect()) == [2, 3, 4]


def test_lineage(spark):
    r = _rec(spark, *[(k, A, True, k, k - 1 if k > 1 else None) for k in range(1, 40)], (50, A, True, 1, 51), (51, A, True, 1, 50), (60, A, True, 1, 999))
    h = lambda n: "0x" + f"{n:064x}"
    starts = spark.createDataFrame([(h(n),) for n in (39, 1, 50, 60, 777)], "start string")
    got = sorted((int(x.start, 16), x.depth, int(x.content_hash, 16), x.capped) for x in registry.lineage(r, starts, 10).collect())
    assert [x for x in got if x[0] == 39] == [(39, d, 39 - d, d == 9) for d in range(10)]
    assert [x for x in got if x[0] != 39] == [(1, 0, 1, False), (50, 0, 50, False), (50, 1, 51, False), (60, 0, 60, False)]
    whole = registry.lineage(r, starts.filter(F.col("start") == h(39)))
    assert whole.count() == 39 and whole.filter("capped").count() == 0


# --- Logs


def test_chain(spark, rows):
    entries, prev = [], logs.GENESIS
    for k in range(6):
        digest = hashlib.sha256("\n".join(("j", str(k), prev, f"b{k}")).encode()).hexdigest()
        entries.append(["j", k, prev, f"b{k}", digest])
        prev = digest
    of = lambda e: rows(logs.chain_breaks(spark.createDataFrame([tuple(x) for x in e], "journal string, seq long, prev_hash string, body string, entry_hash string")))
    assert of(entries) == [] and of([]) == []
    assert of([e for e in entries if e[1] != 3]) == [("j", 3, "seq")]
    edited = [list(e) for e in entries]
    edited[2][3] = "forged"
    assert of(edited) == [("j", 2, "entry_hash")]
    edited = [list(e) for e in entries]
    edited[4][2] = "0" * 64
    assert of(edited) == [("j", 4, "prev_hash")]


def test_events(spark):
    sha = hashlib.sha256(b"p").hexdigest()
    cases = [
        ((0, "t", "a", "prompt", "p", None, None), None), ((0, "t", "a", "note", "p", sha, False), None), ((0, "t", "a", "prompt", None, sha, True), None), ((-1, "t", "a", "prompt", "p", None, None), "EVENT_BAD_SEQ"),
        ((0, None, "a", "prompt", "p", None, None), "EVENT_BAD_TS"), ((0, "t", "", "prompt", "p", None, None), "EVENT_BAD_ACTOR"), ((0, "t", "a", "x", "p", None, None), "EVENT_BAD_TYPE"),
        ((0, "t", "a", "prompt", "p", "zz", None), "EVENT_BAD_PAYLOAD_HASH"), ((0, "t", "a", "prompt", None, None, None), "EVENT_MISSING_PAYLOAD"), ((0, "t", "a", "prompt", "p", sha, True), "EVENT_REDACTED_WITH_PAYLOAD"),
        ((0, "t", "a", "prompt", None, sha, None), "EVENT_UNFLAGGED_REDACTION"), ((0, "t", "a", "prompt", "q", sha, None), "EVENT_PAYLOAD_HASH_MISMATCH"),
    ]
    df = spark.createDataFrame([(k, *c) for k, (c, _) in enumerate(cases)], "k int, seq long, ts string, actor string, type string, payload string, payload_hash string, redacted boolean")
    assert {r.k: r.reason for r in logs.validated(df).collect()} == {k: why for k, (_, why) in enumerate(cases)}
    sound = df.filter("k < 3")
    hidden = logs.redacted(sound)
    assert sorted(r.x for r in sound.select(F.hex(logs.event_leaf()).alias("x")).collect()) == sorted(r.x for r in hidden.select(F.hex(logs.event_leaf()).alias("x")).collect())
    assert sorted(map(tuple, hidden.collect()), key=str) == sorted(map(tuple, logs.redacted(hidden).collect()), key=str)


def test_coverage_and_revocation(spark, rows):
    commits = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "oid string, position long")
    claims = spark.createDataFrame([("a", True, None), ("a", True, True), ("b", False, True), ("c", True, False), ("z", True, True)], "oid string, packet_verified boolean, root_verified boolean")
    c = logs.coverage(commits, claims)
    assert rows(c) == [("a", 0, "covered-verified", 2), ("b", 1, "claim-unverified-packet", 1), ("c", 2, "claim-root-mismatch", 1), ("d", 3, "uncovered", 0)]
    assert rows(logs.coverage_failures(c, since="c")) == [("c", "require-since", "claim-root-mismatch"), ("d", "require-since", "uncovered")]
    assert len(rows(logs.coverage_failures(c, require_all=True))) == 3 and rows(logs.coverage_failures(c)) == []
    assert logs.coverage_summary(c).first().percent == 25 and logs.coverage_summary(c.limit(0)).first().percent == 100
    t = lambda d: datetime(2026, 1, d)
    subjects = spark.createDataFrame([(1, A, t(5)), (2, A, t(1)), (3, "(none)", t(5)), (4, "0x" + "c" * 40, t(9))], "id int, subject string, as_of timestamp")
    revoked = spark.createDataFrame([(A.upper().replace("0X", "0x"), t(5), "z"), (A, t(5), "y"), (A, t(8), "x"), (B, None, "n")], "vendor string, revoked_at timestamp, reason string")
    got = {r.id: (r.status, r.governing_reason, r.later) for r in logs.revoked_as_of(subjects, revoked).collect()}
    assert got == {1: ("REVOKED", "y", 1), 2: ("OK", None, 3), 3: ("UNEVALUABLE", None, 0), 4: ("OK", None, 0)}


def test_canonical_json(spark):
    f = lambda t: _one(spark, t, logs.canonical)
    assert f('{"b": [1, 2.50, null], "a": {"é": true}}') == '{"a":{"é":true},"b":[1,2.5,null]}'
    assert [f(x) for x in (None, "{", '{"a":1,"a":2}', "NaN", "[" * 70 + "]" * 70)] == [None] * 5
    assert f("[1.0, 1e2]") == "[1,100]"


def test_as_of_join(spark):
    left = spark.createDataFrame([(1, 5, "p"), (1, 1, "q"), (2, 9, "r")], "k int, t int, v string")
    right = spark.createDataFrame([(1, 3, "a"), (1, 5, "b"), (1, 7, "c")], "k int, t int, w string")
    assert sorted((r.k, r.t, r.right_w) for r in logs.as_of(left, right, "k", "t", "t").collect()) == [(1, 1, None), (1, 5, "b"), (2, 9, None)]


# --- Findings

FIND = "source string, rule string, severity string, message string, location string, line int"


def test_findings(spark, rows):
    f = spark.createDataFrame([("x", "BR-10", "fatal", "m", "l", 1), ("x", "BR-9", "warning", "m", "l", 1), ("x", "BR-9", "warning", "m", "l", 1), ("y", "BR-9", "information", "m", "l", None)], FIND)
    s = spark.createDataFrame([("x", None), ("y", None), ("z", "bad")], "source string, error string")
    by = found.by_source(f, s)
    assert rows(by) == [("x", None, 1, 2, 3, False), ("y", None, 0, 0, 1, True), ("z", "bad", 0, 0, 0, False)]
    assert found.batch(by).first().verdict == "fatal" and found.batch(by.filter("source = 'z'")).first().verdict == "unreadable" and found.batch(by.limit(0)).first().verdict == "ok"
    assert [tuple(r) for r in found.top_rules(f, 5).collect()] == [("BR-9", 2, 3, "warning"), ("BR-10", 1, 1, "fatal")]
    assert rows(found.first_findings(f, 1), "source", "rule", "more") == [("x", "BR-10", 2), ("y", "BR-9", 0)]
    d = found.multiset_difference(f, f.limit(0), ["source", "rule", "severity"])
    assert rows(d, "rule", "added", "removed") == [("BR-10", 1, 0), ("BR-9", 1, 0), ("BR-9", 2, 0)]
    assert found.regression(f, f, ["rule", "severity"]).first().regressed is False
    assert rows(found.agreement(f, f.filter("source = 'y'"))) == [("BR-10", 0, 1, 0), ("BR-9", 1, 1, 0)]
    assert rows(found.outside_list(f, "rule", spark.createDataFrame([("BR-9",), (None,)], "code string")), "rule") == [("BR-10",)]
    assert rows(found.roll_up(f.withColumn("a", F.lit(-2)), "rule", "a"), "rule", "count", "impact") == [("BR-10", 1, 2), ("BR-9", 3, 6), (None, 4, 8)]


def test_ancestors_places_and_insertion_lines():
    from tallyweave.operators import markup

    doc = markup.Document(markup.parse("<a>\n<p>\n<q>1.25</q>\n</p>\n<l><q>1</q></l>\n<l/>\n</a>"))
    q, other = doc.named["q"]
    holds = lambda t, at: markup.Test(t).holds(doc, at)
    assert holds("exists(ancestor::x:p)", q) and not holds("exists(ancestor::p)", other) and holds("exists(ancestor::a/l/q)", q) and holds("count(ancestor::*) = 2", q)
    assert holds("string-length(substring-after(., '.')) <= 2", q) and not holds("string-length(substring-after(., '.')) <= 1", q) and holds("string-length(substring-after(., '.')) = 0", other)
    for bad in ("substring-after(.)", "not(a, b)", "true(a)", "matches(., 'x')"):
        with pytest.raises(ValueError):
            markup.Test(bad)
    lines = {p: doc.insertion_line(p) for p in ("p/z", "/a/p/q/z", "p/q", "z", "l/z", "/b/p/z", "p//z", "/a")}
    assert lines == {"p/z": 2, "/a/p/q/z": 3, "p/q": None, "z": None, "l/z": None, "/b/p/z": None, "p//z": None, "/a": None}


def test_positions_and_running_sums_over_ranges(spark):
    from tallyweave.operators.ordered import numbered, running_sum

    rng = random.Random(6)
    data = [(k, rng.randint(0, 3), rng.choice([None, *range(9)])) for k in range(500)]
    df = spark.createDataFrame(data, "id int, k int, v bigint").repartition(5)
    order = sorted(data, key=lambda r: (r[1], r[0]))
    assert {(r.id, r.pos) for r in numbered(df, "k", "id").collect()} == {(r[0], n) for n, r in enumerate(order)}
    want, total = set(), 0
    for i, _, v in order:
        want.add((i, total))
        total += v or 0
    assert {(r.id, r.before) for r in running_sum(df, "v", "k", "id").collect()} == want
    assert numbered(df.limit(0), "id").count() == 0 and running_sum(df.limit(0), "v", "id").columns == ["id", "k", "v", "before"]
