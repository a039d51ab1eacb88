"""Nested reports: shapes, references to rules, deliveries and hostile input."""

from __future__ import annotations

import json
from datetime import datetime

import pytest

from tallyweave.operators import nested

RULES = [{"id": "A", "name": "a"}, {"id": "B"}]
EXTENSION = [{"name": "x", "rules": [{"id": "X0"}, {"id": "X1"}]}]


def _table(spark, payloads, name="results", at=None):
    rows = [(k + 1, p if p is None or isinstance(p, str) else json.dumps(p), (at or {}).get(k, datetime(2026, 1, 1)), "extra") for k, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "report_id long, payload string, received_at timestamp, run_no string")
    return sorted((tuple(r) for r in nested.flat_table(df, name).collect()), key=str)


def _report(*results, driver=None, **run):
    return {"runs": [{"tool": {"driver": {"name": "d", "rules": RULES} | (driver or {}), "extensions": EXTENSION}, "results": list(results), **run}]}


@pytest.mark.parametrize(
    ("result", "rule_id", "variant"),
    [
        ({"ruleId": "Z", "ruleIndex": 0}, "Z", "by_id"),
        ({"ruleIndex": 1}, "B", "by_rule_index"),
        ({"ruleId": None, "ruleIndex": 0}, "A", "by_rule_index"),
        ({"rule": {"id": "R"}}, "R", "by_reference_id"),
        ({"rule": {"index": 1}}, "B", "by_driver_index"),
        ({"rule": {"index": 1, "toolComponent": {"index": 0}}}, "X1", "by_component_index"),
        ({"rule": {"index": 0, "toolComponent": {"name": "x"}}}, "X0", "by_component_index"),
        ({"rule": {"index": 0, "toolComponent": {"index": 5}}}, None, "by_component_index"),
        ({"ruleIndex": -1}, None, "by_rule_index"),
        ({"ruleIndex": 9}, None, "by_rule_index"),
        ({"properties": {"ruleId": "P"}}, None, "unnamed"),
        ({"ruleId": ""}, "", "by_id"),
    ],
)
def test_rule_of_a_result(spark, result, rule_id, variant):
    (row,) = _table(spark, [_report(result)])
    assert row[:5] == (1, 0, 0, rule_id, "d") and row[-1] == variant


def test_objects_in_place_of_lists(spark):
    r = {"runs": {"tool": {"driver": {"name": "d", "rules": {"id": "A"}}}, "results": {"ruleIndex": 0, "locations": {"logicalLocations": {"name": "here"}}}}}
    assert _table(spark, [r])[0][:5] == (1, 0, 0, "A", "d")
    assert _table(spark, [r], "locations")[0] == (1, 0, 0, 0, None, None, None, "here", "logical")


def test_positions_and_parents(spark):
    r = {"runs": [{"results": None}, {"tool": {}, "results": [{"ruleId": "a"}, 7, {"ruleId": "b", "message": {"text": "m"}}]}]}
    assert [x[:4] for x in _table(spark, [r])] == [(1, 1, 0, "a"), (1, 1, 2, "b")]
    assert [x[:3] for x in _table(spark, [r], "runs")] == [(1, 0, None), (1, 1, None)]


@pytest.mark.parametrize("payload", [None, "", " ", "[]", "null", '"x"', '{"runs": [', '{"runs": []} x', "{\"runs\": NaN}", "﻿", "[" * 5000 + "]" * 5000, "{}", '{"runs": 3}'])
def test_no_rows(spark, payload):
    assert _table(spark, [payload]) == []


def test_bom_blanks_surrogates_and_long_texts(spark):
    good = json.dumps(_report({"ruleId": "\ud800x"}))
    long = json.dumps(_report({"ruleId": "y" * 300_000}))
    got = _table(spark, ["﻿ \n" + good + " \n", long])
    assert [len(x[3]) for x in got] == [2, 300_000]


def test_latest_delivery_counts_even_if_cut(spark):
    df = spark.createDataFrame(
        [(1, "a", datetime(2026, 1, 1), json.dumps(_report({"ruleId": "old"}))), (1, "b", datetime(2026, 1, 2), json.dumps(_report({"ruleId": "new"}))), (2, "a", datetime(2026, 1, 1), json.dumps(_report({"ruleId": "old"}))), (2, "b", datetime(2026, 1, 3), "{"), (3, "c", None, json.dumps(_report({"ruleId": "n"})))],
        "report_id long, batch_name string, received_at timestamp, payload string",
    )
    assert sorted(tuple(r)[:4] for r in nested.flat_table(df, "results").collect()) == [(1, 0, 0, "new"), (3, 0, 0, "n")]


def test_states_do_not_depend_on_unknown_members():
    a = nested.Automaton()
    assert a.state({"ruleId": "x", "foo": 1}) == a.state({"ruleId": "y", "bar": [1, 2]})
    assert a.state({"ruleId": "x"}) != a.state({"ruleId": None})
    assert a.state([{"id": "a"}, {"id": "b"}]) == a.state([{"id": "c"}])


def test_empty_table(spark):
    df = spark.createDataFrame([], "report_id long, received_at timestamp, payload string")
    for t in nested.TABLES:
        assert nested.flat_table(df, t).count() == 0


@pytest.mark.parametrize("where", ["properties", "message", "locations"])
def test_deep_reports_lose_nothing(spark, where):
    deep = "[" * 60_000 + '{"a": 1}' + "]" * 60_000
    payload = json.dumps(_report({"ruleId": "r", "x": 0})).replace('"x": 0', f'"{where}": {deep}')
    assert [x[3] for x in _table(spark, [payload])] == ["r"]
    assert _table(spark, [payload], "unreadable") == []
    assert _table(spark, [payload[:-1]]) == [] and _table(spark, [payload[:-1]], "unreadable") == [(1, "malformed")]


@pytest.mark.parametrize(
    "text",
    ["{}", " [ ] ", '{"a": [1, -2.5e3, true, false, null, "x\\u0041\\n"], "b": {"c": {}}, "a": [[]]}', "7", '"s"', "[[1], {}, [{}]]", "", "[", "]", "{", "}", "[1,]", "[,1]", "[1 2]", '{"a"}', '{"a":}', '{"a":1,}', '{a:1}', "[1]x", "01", "-", "[1}", '"\t"', "nul", "NaN", "[Infinity]", "1.", ".5", "+1", '{"a":1 "b":2}', '{"a" 1}', "[1,,2]", "\u00a0[]"],
)
def test_deep_reader_agrees_with_the_standard_one(text):
    def of(read):
        try:
            return repr(read(text))
        except ValueError:
            return "refused"

    assert of(nested.read_deep) == of(nested._DECODER.decode)


def test_long_numbers(spark):
    payload = json.dumps(_report({"ruleId": "r", "ruleIndex": 0})).replace('"ruleIndex": 0', '"ruleIndex": ' + "9" * 6000)
    assert _table(spark, [payload], "results_by_id") == [(1, 0, 0, "r", "d", None, None, None)]


def test_subtypes_and_supertype(spark):
    r = _report({"ruleId": "Z", "ruleIndex": 3, "message": {"text": "m"}}, {"ruleIndex": 1}, {"rule": {"index": 1, "toolComponent": {"index": 0, "name": "x"}}}, {"level": "note"}, 5)
    assert _table(spark, [r], "results_by_id") == [(1, 0, 0, "Z", "d", None, "m", 3)]
    assert _table(spark, [r], "results_by_rule_index") == [(1, 0, 1, "B", "d", None, None, 1)]
    assert _table(spark, [r], "results_by_component_index") == [(1, 0, 2, "X1", "d", None, None, 1, 0, "x")]
    assert _table(spark, [r], "results_unnamed") == [(1, 0, 3, None, "d", "note", None)]
    assert [x[2:4] + x[-1:] for x in _table(spark, [r])] == [(0, "Z", "by_id"), (1, "B", "by_rule_index"), (2, "X1", "by_component_index"), (3, None, "unnamed")]


def test_unreadable_and_shapes(spark):
    payloads = [None, " ", "\ufeff", "[]", "{", _report({"ruleId": "a"}, {"ruleId": "b", "message": {"text": "t"}}), _report({"ruleId": "c"})]
    assert _table(spark, payloads, "unreadable") == [(1, "missing"), (2, "blank"), (3, "blank"), (4, "no_object"), (5, "malformed")]
    df = spark.createDataFrame([(k, json.dumps(p), datetime(2026, 1, 1)) for k, p in enumerate(payloads[5:])], "report_id long, payload string, received_at timestamp")
    got = {tuple(r) for r in nested.shape_catalogue(nested.flat_table(df, "shapes")).collect()}
    assert got == {("by_id", "{ruleId:string}", 2, 2), ("by_id", "{message:{text:string},ruleId:string}", 1, 1)}
    tables = nested.flat_tables(df)
    assert tables["results"].count() == 3 and tables["results_by_id"].count() == 3 and tables["runs"].count() == 2
