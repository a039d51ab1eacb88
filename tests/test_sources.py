"""Readers, sinks, markup and streams on small fixtures."""

from __future__ import annotations

import json
import zlib
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import hashing
from tallyweave.operators import logs, markup
from tallyweave.sinks import reports
from tallyweave.sources import delimited, files
from tallyweave.streaming import journal


def _csv(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_bank_pair_and_ragged_rows(spark, rows, tmp_path):
    p = _csv(tmp_path, "bank.csv", 'Posting Date,Description,Withdrawal Amt,Deposit Amt\n2026-05-01,"rent, ""May""",,"1,200.00"\n\n5/2/26,fee,3.50,\n5/3/26,both,1,1\n5/4/26,short\nx,bad,,1\n')
    t = delimited.read_transactions(spark, p, "bank")
    assert rows(t, "date", "amount", "memo", "kind", "error") == [
        (None, 100, "bad", "deposit", "date"), (date(2026, 5, 1), 120000, 'rent, "May"', "deposit", None), (date(2026, 5, 2), -350, "fee", "fee", None), (date(2026, 5, 3), None, "both", "other", "amount"), (date(2026, 5, 4), None, "short", "other", "amount"),
    ]
    assert tuple(delimited.diagnosis(t).first()) == (5, 2, 1, 2, 0)


def test_rent_roll_and_map(spark, rows, tmp_path):
    p = _csv(tmp_path, "rr.csv", "When,Tenant,Unit,Type,Memo,Payment,Charge\n2026-05-01,Ann,4B,,rent,10,\n2026-05-01,Bo,,,,,5\n2026-05-01,,,,,1,\n")
    with pytest.raises(delimited.HeaderError):
        delimited.read_transactions(spark, p, "rentroll")
    t = delimited.read_transactions(spark, p, "rentroll", column_map={"date": "when"})
    assert rows(t, "party", "amount", "error") == [("", 100, "party"), ("Ann (4B)", 1000, None), ("Bo", -500, None)]
    with pytest.raises(delimited.HeaderError):
        delimited.resolve(["Date", "Amount"], "bank", {"nope": "Date"})
    with pytest.raises(delimited.HeaderError):
        delimited.resolve(["Date", "Amount"], "bank", {"memo": "absent"})
    assert delimited.resolve(["AMT", " date ", "Posting Date", "Amount"], "bank") == {"date": " date ", "amount": "Amount"}


def test_headers_of_real_exports():
    r = delimited.resolve
    assert r(["Posted", "Withdrawal Amount", "Credit Amt", "Payee", "Name"], "bank") == {"date": "Posted", "debit": "Withdrawal Amount", "credit": "Credit Amt", "memo": "Name"}
    assert r(["Trans Date", "Num", "Account", "Payment", "Increase"], "book") == {"date": "Trans Date", "party": "Account", "memo": "Num", "debit": "Payment", "credit": "Increase"}
    assert r(["Date", "Lease", "Party", "Door", "Received", "Owed"], "rentroll") == {"date": "Date", "tenant": "Party", "unit": "Door", "payment": "Received", "charge": "Owed"}
    assert r(["Date", "Posting Date", "Amount"], "bank")["date"] == "Date"


def test_signed_amount_alone_counts_and_pairs_have_no_sign(spark, rows):
    cells = spark.createDataFrame([("1/2/2026", "", "5", "x"), ("1/2/2026", "-3", "5", "x")], "Date string, Amount string, Credit string, Memo string")
    assert rows(delimited.normalized(cells, "book"), "amount", "error") == [(-300, None), (None, "amount")]
    pair = spark.createDataFrame([("1/2/2026", "-5", ""), ("1/2/2026", "", "-7")], "Date string, Debit string, Credit string")
    assert rows(delimited.normalized(pair, "bank"), "amount") == [(-500,), (700,)]
    rent = spark.createDataFrame([("1/2/2026", "A", "", "5", "", ""), ("1/2/2026", "A", "5", "", "", ""), ("1/2/2026", "A", "5", "", "late fee", ""), ("1/2/2026", "A", "5", "", "", "chk")], "Date string, Tenant string, Charge string, Payment string, Memo string, Type string")
    assert rows(delimited.normalized(rent, "rentroll"), "amount", "kind") == [(-500, "adjustment"), (-500, "check"), (-500, "fee"), (500, "deposit")]


def test_diagnosis_lists_failures_and_a_sample(spark, rows):
    cells = spark.createDataFrame([("f", k, "1/2/2026" if k % 3 else "never", str(k), "m") for k in range(9)] + [("g", 1, None, None, None)], "file string, row int, Date string, Amount string, Memo string")
    t = delimited.normalized(cells, "bank", keep=("file", "row"))
    got = rows(delimited.diagnosis_sample(t, "file", "row", 2), "file", "row", "ok", "message")
    assert got == [("f", 0, False, "no readable date"), ("f", 1, True, None), ("f", 2, True, None), ("f", 3, False, "no readable date"), ("f", 6, False, "no readable date"), ("g", 1, False, "no readable date")]
    assert rows(delimited.diagnosis_by_file(t, "file")) == [("f", 9, 6, 3, 0, 0), ("g", 1, 0, 1, 0, 0)]


def test_ofx(spark, rows, tmp_path):
    text = "OFXHEADER:100\n<OFX><BANKTRANLIST><STMTTRN><TRNTYPE>DEBIT<DTPOSTED>20260501120000[-5:EST]<TRNAMT>-5.25<NAME>Shop<MEMO>card</STMTTRN>\n<STMTTRN>\n<DTPOSTED>2026\n<TRNAMT>1\n<NAME>x\n</BANKTRANLIST>"
    p = _csv(tmp_path, "a.ofx", text)
    assert rows(delimited.read_ofx(spark, p), "date", "amount", "memo", "party", "error") == [(None, 100, "x", "x", "date"), (date(2026, 5, 1), -525, "card", "Shop", None)]
    assert [r.x for r in spark.createDataFrame([(text,), ("Date,Amount",), (None,)], "t string").select(delimited.is_ofx(F.col("t")).alias("x")).collect()] == [True, False, False]


def test_directory_and_manifest(spark, rows, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    for name, body in (("a.txt", b"abc"), ("sub/b.bin", b""), (".hidden", b"x")):
        (tmp_path / "d" / name).write_bytes(body)
    m = files.directory_manifest(files.scan_directory(spark, str(tmp_path / "d")))
    want = {n: "0x" + hashing.keccak_many([b])[0].hex() for n, b in (("a.txt", b"abc"), ("sub/b.bin", b""))}
    assert dict(rows(m, "path", "content_hash")) == want
    (tmp_path / "m.json").write_text(json.dumps({"root": "0x", "files": [{"relPath": "a", "contentHash": "1", "leaf": "2", "hints": {"source": "s"}}, {"relPath": "b", "contentHash": "1", "leaf": "2"}]}))
    assert rows(files.read_manifest(spark, str(tmp_path / "m.json"))) == [("a", "1", "2", "s", None), ("b", "1", "2", None, None)]


def test_sessions_and_transcripts(spark, rows, tmp_path):
    event = {"seq": 0, "ts": "t", "actor": "a", "type": "note", "payload": "p"}
    for name, text in (("s.jsonl", json.dumps(event) + "\n\n"), ("s.json", json.dumps([event]))):
        p = _csv(tmp_path, name, text)
        assert rows(files.read_session(spark, p), "seq", "type", "payload") == [(0, "note", "p")]
    lines = ['{"ts":"1","role":"user","content":"hi"}', "junk", '{"role":"assistant","content":[{"type":"text","text":"yo"},{"type":"tool_use","name":"x"},{"type":"odd"}]}', None]
    df = spark.createDataFrame([("s", k, t) for k, t in enumerate(lines)], "s string, pos int, line string")
    assert [x[:3] for x in rows(files.transcript_events(df, "s", "pos", "line"), "seq", "type", "actor")] == [(0, "prompt", "user"), (1, "completion", "assistant"), (2, "tool_call", "assistant")]
    assert files.batch_entries('["a","b"]') == ["a", "b"] and files.batch_entries("a b # c\n\n d") == ["a", "b", "d"]
    assert files.read_journal(spark, str(tmp_path / "none")).count() == 0


UBL = '<Invoice xmlns="u" xmlns:a="v"><a:ID> 7 </a:ID><a:TaxTotal><a:TaxAmount>1</a:TaxAmount><a:TaxSubtotal><a:TaxableAmount>5</a:TaxableAmount></a:TaxSubtotal></a:TaxTotal><a:LegalMonetaryTotal><a:PayableAmount>6</a:PayableAmount></a:LegalMonetaryTotal><a:InvoiceLine><a:ID>1</a:ID><a:InvoicedQuantity unitCode="C62">2</a:InvoicedQuantity></a:InvoiceLine></Invoice>'
CII = '<r:CrossIndustryInvoice xmlns:r="r"><r:ExchangedDocument><r:ID>9</r:ID><r:IssueDateTime><r:DateTimeString>20260501</r:DateTimeString></r:IssueDateTime></r:ExchangedDocument><r:SupplyChainTradeTransaction><r:IncludedSupplyChainTradeLineItem/></r:SupplyChainTradeTransaction></r:CrossIndustryInvoice>'
BOMB = '<!DOCTYPE x [<!ENTITY a "b">]><Invoice>&a;</Invoice>'


def test_invoices(spark):
    docs = spark.createDataFrame([(1, UBL), (2, CII), (3, BOMB), (4, "<a"), (5, None), (6, "<other/>"), (7, "<a>" * 300 + "</a>" * 300)], "k int, content string")
    got = {r.k: r for r in markup.invoices(docs, "k", "content").collect()}
    assert (got[1].syntax, got[1].id, got[1].payable, got[1].lines[0].unit, got[1].breakdown[0].taxable) == ("ubl", "7", "6", "C62", "5")
    assert (got[2].syntax, got[2].id, got[2].issue_date, len(got[2].lines)) == ("cii", "9", "2026-05-01", 1)
    assert [got[k].error is not None for k in (3, 4, 5, 6, 7)] == [True] * 5
    table = markup.element_table(docs.filter("k in (1, 3, 5)"), "k", "content")
    assert table.filter("k = 1").count() == 11 and table.filter("k = 3 and error is not null").count() == 1 and table.filter("k = 5").count() == 0


@pytest.mark.parametrize(
    ("test", "fires"),
    [("exists(a:ID)", 0), ("not(a:ID)", 1), ("count(a:InvoiceLine) = 1", 0), ("a:ID = '7' or a:ID = ' 7 '", 0), ("a:ID != '8' and not(a:Gone)", 0), (".//a:TaxableAmount > 5", 1), ("a:InvoiceLine/a:InvoicedQuantity/@unitCode = 'C62'", 0), ("string-length(normalize-space(a:ID)) = 1", 0), ("a:InvoiceLine/../a:ID", 0), ("number(a:TaxTotal/a:TaxAmount) >= 1.5", 1), ("/Invoice/a:ID", 0)],
)
def test_path_language(spark, test, fires):
    docs = spark.createDataFrame([(1, UBL), (2, BOMB)], "k int, content string")
    out = [tuple(r) for r in markup.evaluate(docs, "k", "content", [("r", "fatal", "/Invoice", test)]).collect()]
    assert [x for x in out if x[0] == 1] == [(1, "r", "fatal", "/Invoice", 1)] * fires and [x[1] for x in out if x[0] == 2] == ["unreadable"]


def test_rules_that_do_not_compile():
    for bad in ("a[1]", "count(", "f(x)", "a ==", "for $x in y"):
        with pytest.raises(ValueError):
            markup.Test(bad)
    asserts = markup.schematron_asserts('<s:schema xmlns:s="s"><s:rule context="a/b"><s:assert id="1" flag="warning" test="not(c)"/></s:rule></s:schema>')
    assert asserts == [("1", "warning", "a/b", "not(c)")] and [markup.shape(t) for t in ("not(c)", "count(c) = 1", "a/b", "a = b", "f(x)")] == ["absence", "count", "existence", "comparison", "other"]


def test_embedded_xml():
    body = zlib.compress(b"<Invoice/>")
    pdf = b"%PDF\n1 0 obj\n<< /Type /EmbeddedFile /Filter /FlateDecode /Params << /Size 10 >> /Length 9 >>\nstream\n" + body + b"\nendstream endobj"
    assert markup.embedded_xml(pdf) == b"<Invoice/>" and markup.embedded_xml(b"%PDF nothing") is None


FIND = "source string, rule string, severity string, message string, location string, line int"


def test_report_forms(spark, rows):
    f = spark.createDataFrame([("x", "BR-2", "fatal", 'a "<b>\n%', "l", 3), ("x", "BR-1", "warning", None, None, None), ("y", "BR-1", "information", "m", "l", 1)], FIND)
    doc = {r.source: json.loads(r.document) for r in reports.sarif(f, "tool").collect()}
    assert [(r["ruleId"], r["level"]) for r in doc["x"]["runs"][0]["results"]] == [("BR-2", "error"), ("BR-1", "warning")]
    assert json.loads(reports.code_quality(f.filter("source = 'y'")).first().document)[0]["severity"] == "info"
    s = spark.createDataFrame([("x",), ("z",)], "source string")
    unit = dict(rows(reports.junit(f, s)))
    assert 'failures="2"' in unit["x"] and "&quot;&lt;b&gt;" in unit["x"] and 'failures="0"' in unit["z"]
    assert [len(markup.parse(d)) for d in unit.values()] == [5, 2]
    assert "::error file=x,line=3,title=BR-2::a \"<b>%0A%25" in [r.line_text for r in reports.annotations(f).collect()]
    assert reports.log_issues(f).count() == 3
    assert reports.badge(f).first().message == "failing" and reports.badge(f.limit(0)).first().message == "passing"
    assert [r.line for r in reports.csv_lines(spark.createDataFrame([('a"b', None, "x,y")], "p string, q string, r string")).collect()] == ['"a""b",,"x,y"']
    cat = spark.createDataFrame([("BR-1", "en", "T", "F"), ("BR-1", "de", "D", None)], "rule string, language string, title string, fix string")
    assert rows(reports.explained(f, cat, "de"), "rule", "title", "fix") == [("BR-1", "D", "F"), ("BR-1", "D", "F"), ("BR-2", None, None)]
    e = spark.createDataFrame([("t", "fatal", 5, "l", [(date(2026, 1, 1), -5, "m", "p")]), ("u", "fatal", 6, "l", [])], "type string, severity string, amount long, label string, records array<struct<date:date,amount:long,memo:string,party:string>>")
    assert rows(reports.exceptions_long(e), "type", "record_amount", "direction") == [("t", -5, "out"), ("u", None, "")]
    r = spark.createDataFrame([(1, '{"b":1,"a":2}'), (2, '{"a":1}')], "k int, body string")
    issued = reports.receipts(r, "k", "body").unionByName(spark.createDataFrame([(3, "x")], "k int, digest string"))
    assert rows(reports.receipts_hold(r.withColumn("body", F.when(F.col("k") == 1, '{"a": 2, "b": 1}').otherwise('{"a":9}')), "k", "body", issued)) == [(1, "ok"), (2, "changed"), (3, "missing")]


def test_stream_of_a_chain(spark, tmp_path):
    src = str(tmp_path / "in")
    first = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "1", "z"), ("b", "2", None)], "k string, at string, body string")
    first.coalesce(1).write.parquet(src)
    stream = lambda: journal.chain(spark.readStream.schema(first.schema).parquet(src), "k", "at", "body")
    assert journal.run_to_folder(stream(), str(tmp_path / "out")).count() == 4
    spark.createDataFrame([("a", "3", "w")], "k string, at string, body string").coalesce(1).write.mode("append").parquet(src)
    out = journal.run_to_folder(stream(), str(tmp_path / "out"))
    assert sorted((r.journal, r.seq) for r in out.collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]
    assert logs.chain_breaks(out).count() == 0


def test_stream_dedup_points_and_replay(spark, rows, tmp_path):
    src = str(tmp_path / "in")
    t = datetime(2026, 1, 1)
    df = spark.createDataFrame([(1, t, "A", "0x1", True, 0), (1, t, "B", "0x1", True, 1), (2, t, "A", "0x2", False, 2)], "id int, at timestamp, contributor string, content_hash string, author_bound boolean, index long")
    df.coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema(df.schema).parquet(src)
    assert journal.run_to_folder(journal.deduplicated(read(), ["id"], "at").select("id"), str(tmp_path / "o1")).count() == 2
    assert rows(journal.run_to_folder(journal.first_points(read()), str(tmp_path / "o2"))) == [("a", "0x1")]
    x = spark.createDataFrame([(1, datetime(2026, 1, 1, 0, 0, 0), datetime(2026, 1, 1, 0, 5, 0)), (2, datetime(2026, 1, 1), datetime(2026, 1, 1, 0, 5, 1)), (3, datetime(2026, 1, 1, 1), datetime(2026, 1, 1))], "id int, s timestamp, r timestamp")
    assert rows(journal.within_replay(x, "s", "r"), "id") == [(1,)]
