"""Strict events, claims, drift, order of exceptions, thresholds, batches, signatures, digests of chunks and report forms."""

from __future__ import annotations

import hashlib
import hmac
import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import hashing
from tallyweave.operators import evidence, merkle
from tallyweave.sinks import reports
from tallyweave.sources import files


def _strict(spark, *texts, hash_name="sha256"):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "n int, text string, other string")
    x = evidence.strict_events(df, "text", hash_name)
    return sorted(tuple(r) for r in x.select("n", "reason", evidence.strict_leaf("d/v1", hash_name).alias("leaf")).collect())


def test_reasons_come_in_order(spark):
    good = {"seq": 0, "ts": "t", "actor": "a", "type": "note", "payload": "p"}
    sha = "0x" + hashlib.sha256(b"p").hexdigest()
    cases = [
        (None, "EVENT_NOT_OBJECT"), ("[]", "EVENT_NOT_OBJECT"), ("{", "EVENT_NOT_OBJECT"), (good | {"x": 1, "seq": -1}, "EVENT_UNKNOWN_FIELD"), (good | {"seq": 1.5}, "EVENT_BAD_SEQ"), (good | {"seq": "1"}, "EVENT_BAD_SEQ"), (good | {"seq": 1 << 53}, "EVENT_BAD_SEQ"),
        (good | {"ts": 5}, "EVENT_BAD_TS"), (good | {"actor": ""}, "EVENT_BAD_ACTOR"), (good | {"type": "x"}, "EVENT_BAD_TYPE"), (good | {"payload": None}, "EVENT_BAD_PAYLOAD"), (good | {"payloadHash": "0x1"}, "EVENT_BAD_PAYLOAD_HASH"),
        (good | {"redacted": None}, "EVENT_BAD_REDACTED_FLAG"), ({k: v for k, v in good.items() if k != "payload"}, "EVENT_MISSING_PAYLOAD"), (good | {"redacted": True}, "EVENT_REDACTED_WITH_PAYLOAD"),
        ({k: v for k, v in good.items() if k != "payload"} | {"payloadHash": sha}, "EVENT_UNFLAGGED_REDACTION"), (good | {"payloadHash": sha[:-1] + "1"}, "EVENT_PAYLOAD_HASH_MISMATCH"), (good | {"meta": json.loads("[" * 40 + "]" * 40)}, "EVENT_BAD_META"),
        (good, None), (good | {"payloadHash": sha.upper().replace("0X", "0x"), "redacted": False, "meta": None}, None), (good | {"seq": 3.0}, None),
    ]
    got = _strict(spark, *(c if c is None or isinstance(c, str) else json.dumps(c) for c, _ in cases))
    assert [r[1] for r in got] == [reason for _, reason in cases]
    assert all((r[2] is None) == (r[1] is not None) for r in got)


@pytest.mark.parametrize("hash_name", ["sha256", "keccak"])
def test_an_event_and_its_redacted_twin_have_one_leaf(spark, hash_name):
    digest = (lambda b: hashlib.sha256(b).digest()) if hash_name == "sha256" else (lambda b: hashing.keccak_many([b])[0])
    event = {"seq": 7, "ts": "t\u0001", "actor": "ä", "type": "note", "payload": "pay", "meta": {"b": [1, None], "a": "x"}}
    twin = {k: v for k, v in event.items() if k != "payload"} | {"payloadHash": "0x" + digest(b"pay").hex(), "redacted": True}
    text = json.dumps(["d/v1", 7, "t\u0001", "ä", "note", "0x" + digest(b"pay").hex(), '{"a":"x","b":[1,null]}'], ensure_ascii=False, separators=(",", ":"))
    want = "0x" + digest(text.encode()).hex()
    assert [r[2] for r in _strict(spark, json.dumps(event), json.dumps(twin), hash_name=hash_name)] == [want, want]


def test_entry_hash_over_canonical_json(spark):
    df = spark.createDataFrame([(0, "0x00", "t", None, '{"verdict": "ACCEPTED", "a": 1}')], "seq long, prev string, ts string, artifact string, verdict string")
    got = df.select(evidence.canonical_entry_hash("s/v1", *(F.col(c) for c in df.columns), hash_name="sha256")).first()[0]
    body = '{"artifact":null,"prevHash":"0x00","schema":"s/v1","seq":0,"ts":"t","verdict":{"a":1,"verdict":"ACCEPTED"}}'
    assert got == "0x" + hashlib.sha256(body.encode()).hexdigest()


def test_claims_are_canonical_notes(spark, rows):
    told = '{"commit":"' + "a" * 40 + '","gitRoot":"0x' + "b" * 64 + '","kind":"claim@1"}'
    scoped = told[:-1] + ',"scope":"src/x"}'
    texts = [told, scoped, " " + told, told.replace("claim@1", "claim@2"), told.replace("aaaa", "AAAA"), scoped.replace("src/x", ""), None, "x"]
    df = spark.createDataFrame([(k, "note", t) for k, t in enumerate(texts)] + [(99, "prompt", told)], "k int, type string, payload string")
    found = evidence.claims(df, "claim@1")
    assert rows(found, "k", "scope") == [(0, None), (1, "src/x")]
    facts = spark.createDataFrame([(0, "a" * 40, "0x" + "c" * 64)], "k int, oid string, root string")
    assert rows(evidence.claim_verdicts(found, facts, "k")) == [(0, "root-mismatch"), (1, "no-expected-facts")]


def test_first_drift_of_intact_journals(spark, rows):
    from tallyweave.operators.logs import GENESIS

    def journal(name, *bodies):
        out, prev = [], GENESIS
        for k, body in enumerate(bodies):
            h = hashlib.sha256("\n".join((name, str(k), prev, body)).encode()).hexdigest()
            out.append((name, k, prev, body, h))
            prev = h
        return out

    ok, bad = '{"verdict":"ACCEPTED"}', '{"verdict":"REJECTED"}'
    broken = journal("c", ok, bad)
    broken[0] = (*broken[0][:3], '{"verdict":"OTHER"}', broken[0][4])
    df = spark.createDataFrame(journal("a", ok, bad, "no json") + journal("b", ok) + journal("d", "{}") + broken, "journal string, seq bigint, prev_hash string, body string, entry_hash string")
    assert rows(evidence.first_drift(df)) == [("a", 1, "REJECTED"), ("d", 0, "MALFORMED")]


def test_exceptions_have_one_order(spark):
    items = [("info", "a", 1, date(2026, 1, 1), "m", "p"), ("error", "b", 5, None, None, None), ("error", "b", 5, date(2026, 1, 1), "", ""), ("error", "a", 9, None, None, None), ("odd", "a", 0, None, None, None), ("warning", "z", -3, None, None, None), (None, "a", 0, None, None, None)]
    x = evidence.ordered_exceptions(spark.createDataFrame(items, "severity string, type string, amount bigint, date date, memo string, party string").repartition(3))
    got = [(r.severity, r.type, r.amount) for r in x.orderBy("pos").collect()]
    assert got[:5] == [("error", "a", 9), ("error", "b", 5), ("error", "b", 5), ("warning", "z", -3), ("info", "a", 1)] and {r[0] for r in got[5:]} == {"odd", None}
    assert evidence.ordered_exceptions(x.drop("pos").limit(0)).count() == 0


def test_batches_against_taking_them_one_by_one(spark):
    rng = random.Random(4)
    batches = [(b, rng.choice("abcdefghijklmnopqrstuvwxyz") * 2) for b in range(25) for _ in range(rng.randint(1, 3))]
    known, credited, want = {"zz"}, set(), set()
    for b in range(25):
        mine = [h for x, h in batches if x == b]
        if len(set(mine)) == len(mine) and not set(mine) & (known | credited):
            credited |= set(mine)
            want |= {(b, h) for h in mine}
    df = spark.createDataFrame([*batches, (99, None)], "batch int, content_hash string")
    got = evidence.minted(df, spark.createDataFrame([("ZZ",)], "content_hash string"))
    assert {tuple(r) for r in got.collect()} == want
    assert evidence.minted(df.limit(0), df.limit(0)).count() == 0


def test_thresholds_listings_and_leaves(spark, rows):
    f = spark.createDataFrame([("s", "fatal"), ("s", "warning"), ("t", "information"), ("u", "odd"), ("u", None)], "source string, severity string")
    assert rows(evidence.gate(f)) == [("s", 1, True), ("t", 0, False), ("u", 2, True)]
    assert rows(evidence.gate(f, "information"), "source", "crossing") == [("s", 2), ("t", 1), ("u", 2)]
    assert rows(evidence.first_failures(f.select("source"), "source", 2)) == [("s", 3), ("s", 3)]
    leaf = spark.createDataFrame([("a", "h")], "path string, content_hash string")
    assert rows(evidence.sealed_leaves(leaf, leaf)) == [("input", "a", "h"), ("output", "a", "h")]


def test_dates_of_periods_and_signatures(spark):
    texts = ["2024-02-29", "2023-02-29", "2024-01-01Z", "2024-01-01+02:00", "2024-1-1", "x", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [str(r[0]) for r in df.select(evidence.xs_date(F.col("t"))).collect()] == ["2024-02-29", "None", "2024-01-01", "2024-01-01", "None", "None", "None", "None"]
    assert [r[0] for r in df.select(evidence.ends_before_start(F.lit("2024-01-15"), F.col("t"))).collect()] == [False, False, True, True, False, False, False, False]
    good = hmac.new(b"k", b"body", "sha256").hexdigest()
    s = spark.createDataFrame([("body", good), ("body", good.upper()), ("bodY", good), ("body", None), (None, good)], "b string, s string")
    assert [r[0] for r in s.select(evidence.signed_with(b"k")("b", "s")).collect()] == [True, True, False, False, False]


def test_messages_and_currency(spark, rows):
    f = spark.createDataFrame([("R1", "m1"), ("R2", "m2")], "rule string, message string")
    c = spark.createDataFrame([("R1", "de", "eins"), ("R2", "fr", "deux")], "rule string, language string, text string")
    assert rows(evidence.resolved_messages(f, c, "de")) == [("R1", "m1", "eins"), ("R2", "m2", "m2")]
    t = spark.createDataFrame([([("EUR", 1), ("USD", 2), (None, 3)],)], "totals array<struct<currency:string,v:int>>")
    assert [x.v for x in t.select(evidence.in_currency("totals", "currency", F.lit("USD"))).first()[0]] == [2]


@pytest.mark.parametrize("hash_name", ["keccak", "sha256"])
def test_log_heads_of_all_sizes(spark, hash_name):
    many = merkle.HASHES[hash_name]

    def root(leaves):
        if len(leaves) == 1:
            return many([b"\0" + leaves[0]])[0]
        k = 1 << (len(leaves) - 1).bit_length() - 1
        return many([b"\1" + root(leaves[:k]) + root(leaves[k:])])[0]

    sizes = {f"g{n}": n for n in (1, 2, 3, 7, 255, 256, 257, 600)} | {None: 5}
    data = [(g, k, bytes([k % 251, k // 251])) for g, n in sizes.items() for k in range(n)]
    random.Random(1).shuffle(data)
    got = merkle.log_heads(spark.createDataFrame(data, "g string, n int, leaf binary"), "g", "n", "leaf", hash_name)
    assert {(r.g, r.size, r.root) for r in got.collect()} == {(g, n, root([bytes([k % 251, k // 251]) for k in range(n)]).hex()) for g, n in sizes.items()}
    assert merkle.log_heads(spark.createDataFrame([], "g string, n int, leaf binary"), "g", "n", "leaf").count() == 0


def test_sessions_against_their_events(spark, rows):
    events = spark.createDataFrame([("s", k, bytes([k])) for k in range(5)] + [("t", 0, b"x")], "session string, seq int, leaf binary")
    head = {r.session: (r.size, r.root) for r in merkle.log_heads(events, "session", "seq", "leaf").collect()}
    packets = spark.createDataFrame([("s", head["s"][0], "0x" + head["s"][1].upper()), ("t", 2, head["t"][1]), ("u", 1, "00")], "session string, size bigint, root string")
    assert rows(evidence.sessions_hold(packets, events)) == [("s", "ok"), ("t", "changed"), ("u", "missing")]


def test_chunks_give_the_digest_of_the_whole(spark):
    whole = {"a": b"x" * 5000, "b": b"", "c": b"abc", None: b"n"}
    chunks = [(f, k, data[1000 * k : 1000 * k + 1000] or None) for f, data in whole.items() for k in range(max(1, -(-len(data) // 1000)))]
    random.Random(2).shuffle(chunks)
    got = files.chunk_digests(spark.createDataFrame(chunks, "f string, k int, d binary"), "f", "k", "d")
    assert {(r.f, r.size, r.digest) for r in got.collect()} == {(f, len(d), hashlib.sha256(d).hexdigest()) for f, d in whole.items()}
    assert files.chunk_digests(spark.createDataFrame([], "f string, k int, d binary"), "f", "k", "d").count() == 0


def test_artifacts_are_read_strictly(tmp_path):
    def of(text, **kw):
        (tmp_path / "a.json").write_text(text)
        return files.read_artifact(str(tmp_path / "a.json"), {"n": int}, {"s": str}, **kw)

    assert of('{"n": 1}') == {"n": 1} and of('{"kind": "close", "n": 1, "s": "x"}', kind=("kind", "close"))["s"] == "x"
    for text in ("[]", "{", '{"s": "x"}', '{"n": "1"}', '{"n": true}', '{"n": 1, "z": 2}', '{"n": 1, "n": 2}'):
        with pytest.raises(files.ArtifactError):
            of(text)
    with pytest.raises(files.ArtifactError):
        of('{"n": 1}', kind=("kind", "close"))
    with pytest.raises(files.ArtifactError):
        files.read_artifact(str(tmp_path / "none.json"), {})
    files.agreeing_profiles({"profile": "p"}, "p")
    with pytest.raises(files.ArtifactError):
        files.agreeing_profiles({}, "p")
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "own.toml").write_text('[tool.own]\nfail = "warning"')
    assert files.load_settings(str(tmp_path / "x" / "y"), "own.toml", "tool.own") == ({"fail": "warning"}, str(tmp_path / "own.toml"))
    assert files.load_settings(str(tmp_path), "other-name.toml") == ({}, None)


def test_report_forms_and_manifest_document(spark, tmp_path):
    f = spark.createDataFrame([("s", "R10", "warning", "a<b", "l", 1), ("s", "R9", "warning", None, "l", None), ("s", "R1", "fatal", "z", "k", 2)], "source string, rule string, severity string, message string, location string, line int")
    for form in ("json", "text", "html", "sarif", "junit", "gitlab", "github", "azure", "badge"):
        assert reports.render(f, form).count() >= 1
    with pytest.raises(ValueError):
        reports.render(f, "pdf")
    assert reports.text_summaries(f, 2).first().document == "FATAL R1 k: z\nWARNING R9 l: \n1 more"
    assert "<td>a&lt;b</td>" in reports.html_tables(f).first().document
    assert {r.name: bytes(r.content) for r in reports.bundle({"b": reports.batch_summary(spark.createDataFrame([("s", None, 1, 0, 1, False)], "source string, error string, fatal int, warning int, violations int, valid boolean"))}).collect()} == {"b": b"1 files, 1 failed\nFAILED s: 1 fatal"}
    m = spark.createDataFrame([(f"p/{k:03d}", f"h{k}", "l") for k in range(50)], "path string, content_hash string, leaf string").repartition(4)
    reports.write_manifest(m, str(tmp_path / "m"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    assert [x["relPath"] for x in json.loads(text)["files"]] == [f"p/{k:03d}" for k in range(50)]
    assert [r.line for r in reports.manifest_lines(m.limit(0)).collect()] == ['{"files":[]}']


def test_labels_first_rows_and_digests(spark, rows):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "b"), (None, 5, None)], "k string, n int, v string")
    assert rows(evidence.first_per(df, "k", "n")) == [("a", 1, "b"), (None, 5, None)]
    assert [r[0] for r in df.select(evidence.label(F.lit("  "))).limit(1).collect()] == ["(no name)"]
    parts = spark.createDataFrame([("book", "BB"), ("bank", "aa")], "name string, digest string")
    assert evidence.inputs_digest(parts).first().digest == hashlib.sha256(b"bank:aa\nbook:bb").hexdigest()
    d = df.select(evidence.artifact_digest(F.lit("seal"), {"seal": F.lit("s"), "proof": F.lit("p")}).alias("a"), evidence.artifact_digest(F.lit("z"), {"seal": F.lit("s")}).alias("b")).first()
    assert d.a == "0x" + hashlib.sha256(b"s").hexdigest() and d.b is None


def test_proof_bundles(spark):
    leaves = spark.createDataFrame([(bytes([k]),) for k in range(5)], "digest binary")
    root = merkle.sorted_root(leaves, "sha256").first().root
    good = merkle.sorted_proofs(leaves, "sha256").withColumn("root", F.lit("0x" + root.upper()))
    bad = good.limit(1).withColumn("digest", F.lit(b"zz")).unionByName(good.limit(1).withColumn("proof", F.lit(None).cast("array<binary>")))
    status = lambda df, **kw: sorted(r.status for r in evidence.bundles_hold(df, hash_name="sha256", **kw).collect())
    assert status(good) == ["ok"] * 5 and status(bad) == ["malformed", "root-mismatch"] and set(status(good, expected_root="00")) == {"unexpected-root"}


def test_time_stamp_tokens(spark):
    from datetime import datetime

    from tallyweave.operators import der

    def tlv(tag, *parts):
        body = b"".join(parts)
        n = len(body)
        return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")) + body

    def oid(text):
        a, b, *rest = map(int, text.split("."))
        out = b""
        for v in (a * 40 + b, *rest):
            chunk = [v & 0x7F]
            while v := v >> 7:
                chunk.append(v & 0x7F | 0x80)
            out += bytes(reversed(chunk))
        return tlv(6, out)

    def made(time=b"20260102030405.25Z", kind=der.TIME_STAMP, digest=b"\xab" * 200):
        info = tlv(0x30, tlv(2, b"\x01"), oid("1.2.3.4"), tlv(0x30, tlv(0x30, oid("2.16.840.1.101.3.4.2.1")), tlv(4, digest)), tlv(2, b"\x00\xff"), tlv(0x18, time))
        signed = tlv(0x30, tlv(2, b"\x03"), tlv(0x31), tlv(0x30, oid(kind), tlv(0xA0, tlv(4, info))), tlv(0x31))
        return tlv(0x30, oid(der.SIGNED_DATA), tlv(0xA0, signed))

    good = made()
    data = [good, good[:-1], good + b"x", made(time=b"20261302030405Z"), made(time=b"20260102030405"), made(kind="1.2.3"), b"", None, b"\x30\x80\x00\x00"]
    got = [r.t for r in spark.createDataFrame([(k, d) for k, d in enumerate(data)], "k int, d binary").orderBy("k").select(der.token("d").alias("t")).collect()]
    assert (got[0].policy, got[0].hash_name, got[0].message_digest, got[0].serial, got[0].generated_at, got[0].error) == ("1.2.3.4", "sha256", "ab" * 200, "255", datetime(2026, 1, 2, 3, 4, 5, 250_000), None)
    assert all(r.error and r.policy is None and r.generated_at is None for r in got[1:]) and got[7].error == "missing"


def test_files_are_found_by_suffix(spark, rows, tmp_path):
    for name in ("a/x.XML", "a/b/y.pdf", "z.txt", ".h/q.xml", "a/.s.xml"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1" if name != "a/b/y.pdf" else b"")
    assert rows(files.discover(spark, str(tmp_path), (".xml", ".pdf"))) == [("a/b/y.pdf", 0), ("a/x.XML", 1)]
