"""Deeply nested reports → related flat tables that keep their parent–child links.

A deterministic bottom-up tree automaton classifies every JSON value: the state of an object follows from its keys and
their values' states, the state of a list from its items' states. Results whose states differ are variants of one
supertype; each is routed to the typed table of its subtype (how it names its rule), which decides how the common key
`rule_id` is found and keeps what only that subtype has. The supertype's table is the union of the subtypes' common
columns. Parsing runs once per report in Arrow batches and yields arrays of typed structs, so that the choice of the
latest delivery and the explosion into tables stay native. Depth is bounded by memory alone: nothing here recurses.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from json.decoder import scanstring
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyweave.session import checkpointed

#: Columns that results of every variant have.
COMMON = "run_no int, result_no int, rule_id string, driver_name string, level string, message_text string"
#: Subtypes of results: name → columns of its table after those of COMMON.
SUBTYPES = {
    "by_id": "rule_index long",
    "by_rule_index": "rule_index long",
    "by_reference_id": "component_index long, component_name string",
    "by_driver_index": "rule_index long",
    "by_component_index": "rule_index long, component_index long, component_name string",
    "unnamed": "",
}
#: Typed tables: name → columns after report_id, the parents' positions first.
TABLES = {
    "runs": "run_no int, driver_name string, driver_version string, variant string",
    "rules": "run_no int, component_no int, rule_no int, rule_id string, name string, text string, variant string",
    "results": f"{COMMON}, variant string",
    "locations": "run_no int, result_no int, location_no int, uri string, start_line long, start_column long, logical_name string, variant string",
    "shapes": "variant string, shape string, results long",
    "unreadable": "reason string",
} | {f"results_{name}": f"{COMMON}, {own}" if own else COMMON for name, own in SUBTYPES.items()}
#: What parsing yields: every table but the supertype's, which is put together from its subtypes.
PARSED = tuple(t for t in TABLES if t != "results")


class Automaton:
    """Bottom-up tree automaton over JSON values. States are small integers; transitions are made as shapes are met.

    The members that tell variants apart are those in `members`; others don't change an object's state, so the number of
    states is bounded by the grammar, not by the data.
    """

    #: Members of the grammar by which objects are told apart.
    members = frozenset(
        "runs tool driver extensions rules results ruleId ruleIndex rule id index toolComponent message text markdown locations "
        "physicalLocation logicalLocations artifactLocation region uri startLine startColumn name".split()
    )

    def __init__(self) -> None:
        self.transitions: dict[tuple, int] = {}
        self.symbols: list[tuple] = []
        self.shapes: list[str] = []

    def _state(self, symbol: tuple) -> int:
        if symbol not in self.transitions:
            self.transitions[symbol] = len(self.symbols)
            self.symbols.append(symbol)
        return self.transitions[symbol]

    def state(self, value: Any) -> int:
        """State of `value`: objects by their known members' states, lists by the set of their items' states."""
        # Values wait on the stack until their parts' states are known; each part then stands in `done` in order.
        stack: list[tuple[Any, bool]] = [(value, False)]
        done: list[int] = []
        while stack:
            v, parts_known = stack.pop()
            if isinstance(v, dict):
                keys = [k for k in v if k in self.members]
                if keys and not parts_known:
                    stack.append((v, True))
                    stack.extend((v[k], False) for k in reversed(keys))
                    continue
                states = done[len(done) - len(keys) :]
                del done[len(done) - len(keys) :]
                done.append(self._state(("object", *sorted(zip(keys, states)))))
            elif isinstance(v, list):
                if v and not parts_known:
                    stack.append((v, True))
                    stack.extend((x, False) for x in reversed(v))
                    continue
                states = done[len(done) - len(v) :]
                del done[len(done) - len(v) :]
                done.append(self._state(("list", *sorted(set(states)))))
            elif isinstance(v, str):
                done.append(self._state(("string",)))
            elif v is None or isinstance(v, bool):
                done.append(self._state(("null" if v is None else "boolean",)))
            else:
                done.append(self._state(("number",)))
        return done[0]

    def shape(self, state: int, longest: int = 400) -> str:
        """The state as text, the same in every task; a state's parts were met before it, so texts are built upwards.

        Shapes nested without end would make texts without end: beyond `longest` letters a shape is named by its digest.
        """
        for k in range(len(self.shapes), state + 1):
            kind, *parts = self.symbols[k]
            if kind == "object":
                text = "{" + ",".join(sorted(f"{key}:{self.shapes[x]}" for key, x in parts)) + "}"
            elif kind == "list":
                text = "[" + "|".join(sorted(self.shapes[x] for x in parts)) + "]"
            else:
                text = kind
            self.shapes.append(text if len(text) <= longest else "#" + hashlib.sha256(text.encode()).hexdigest())
        return self.shapes[state]

    def members_of(self, state: int) -> dict[str, int]:
        return dict(self.symbols[state][1:]) if self.symbols[state][0] == "object" else {}

    def is_a(self, state: int | None, kind: str) -> bool:
        return state is not None and self.symbols[state][0] == kind

    def variant(self, state: int) -> str:
        """Subtype of a result by how it names its rule."""
        m = self.members_of(state)
        if self.is_a(m.get("ruleId"), "string"):
            return "by_id"
        if self.is_a(m.get("rule"), "object"):
            rule = self.members_of(m["rule"])
            where = "component" if self.is_a(rule.get("toolComponent"), "object") else "driver"
            if self.is_a(rule.get("id"), "string"):
                return "by_reference_id"
            if self.is_a(rule.get("index"), "number"):
                return f"by_{where}_index"
        if self.is_a(m.get("ruleIndex"), "number"):
            return "by_rule_index"
        return "unnamed" if self.is_a(state, "object") else "no_object"


def _as_list(value: Any) -> list:
    """A list as it is, an object as a list of one, anything else as an empty list."""
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


def _as_object(value: Any) -> dict:
    return value if isinstance(value, dict) else {}


def _text(value: Any) -> str | None:
    """A string (lone surrogates replaced), else null."""
    return value.encode("utf-8", "replace").decode() if isinstance(value, str) else None


def _number(value: Any) -> int | None:
    """A whole number that fits a long, else null."""
    whole = isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    return int(value) if whole and abs(value) < 1 << 63 else None


def _at(items: list, index: int | None) -> dict:
    return _as_object(items[index]) if index is not None and 0 <= index < len(items) else {}


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _whole(digits: str) -> int | float:
    """A whole number; one that fits no long needs no exact value, and may have more digits than int() takes."""
    return int(digits) if len(digits) <= 19 else float(digits)


_BLANKS = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}


def read_deep(text: str) -> Any:
    """What json.loads() gives, for values nested however deeply; ValueError for what it refuses.

    Open lists and objects are kept on a stack of their own. A key waits in `keys` until its value is read.
    """
    at, n = _BLANKS.match(text, 0).end(), len(text)
    open_: list[Any] = []
    keys: list[str | None] = []
    value: Any = None
    while True:
        ch = text[at : at + 1]
        opened = False
        if ch == '"':
            value, at = scanstring(text, at + 1, True)
        elif ch in ("{", "["):
            value, opened = ({} if ch == "{" else []), True
            at += 1
        elif (m := _NUMBER.match(text, at)) is not None:
            value, at = (float(m[0]) if m[2] or m[3] else _whole(m[0])), m.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, at)), None)
            if word is None:
                raise ValueError(f"no value at {at}")
            value, at = _WORDS[word], at + len(word)
        # The value goes to what is open; then what is opened takes values, and what is closed is a value that ends.
        if open_:
            if isinstance(open_[-1], dict):
                open_[-1][keys[-1]] = value
            else:
                open_[-1].append(value)
        else:
            root = value
        if opened:
            open_.append(value)
            keys.append(None)
        at = _BLANKS.match(text, at).end()
        first = opened
        while open_:
            ch = text[at : at + 1]
            if ch == ("}" if isinstance(open_[-1], dict) else "]"):
                open_.pop()
                keys.pop()
                at, first = _BLANKS.match(text, at + 1).end(), False
                continue
            if not first:
                if ch != ",":
                    raise ValueError(f"no comma at {at}")
                at = _BLANKS.match(text, at + 1).end()
            if isinstance(open_[-1], dict):
                if text[at : at + 1] != '"':
                    raise ValueError(f"no key at {at}")
                keys[-1], at = scanstring(text, at + 1, True)
                at = _BLANKS.match(text, at).end()
                if text[at : at + 1] != ":":
                    raise ValueError(f"no colon at {at}")
                at = _BLANKS.match(text, at + 1).end()
            break
        if not open_:
            if at != n:
                raise ValueError(f"more at {at}")
            return root


_DECODER = json.JSONDecoder(parse_constant=_no_constant, parse_int=_whole)


def read_payload(payload: str | None) -> tuple[dict | None, str | None]:
    """(the JSON object in `payload` after any byte-order mark, null) or (null, why there is none).

    Reasons: `missing`, `blank`, `malformed` (also cut), `no_object`.
    """
    if payload is None:
        return None, "missing"
    text = payload.lstrip("\ufeff")
    if not text.strip(" \t\r\n"):
        return None, "blank"
    try:
        value = _DECODER.decode(text)
    except RecursionError:
        try:
            value = read_deep(text)
        except ValueError:
            return None, "malformed"
    except ValueError:
        return None, "malformed"
    return (value, None) if isinstance(value, dict) else (None, "no_object")


class Run:
    """What a run's results refer to: its components' rules, the driver's first."""

    def __init__(self, run: dict) -> None:
        tool = _as_object(run.get("tool"))
        self.driver, self.extensions = _as_object(tool.get("driver")), _as_list(tool.get("extensions"))
        self.driver_name = _text(self.driver.get("name"))
        self.components = [_as_list(self.driver.get("rules")), *(_as_list(_as_object(x).get("rules")) for x in self.extensions)]

    def rule_id(self, index: int | None, component: int = 0) -> str | None:
        rules = self.components[component] if 0 <= component < len(self.components) else []
        return _text(_at(rules, index).get("id"))


def _by_id(result: dict, run: Run) -> tuple:
    return _text(result["ruleId"]), _number(result.get("ruleIndex"))


def _by_rule_index(result: dict, run: Run) -> tuple:
    index = _number(result["ruleIndex"])
    return run.rule_id(index), index


def _by_reference_id(result: dict, run: Run) -> tuple:
    component = _as_object(result["rule"].get("toolComponent"))
    return _text(result["rule"]["id"]), _number(component.get("index")), _text(component.get("name"))


def _by_driver_index(result: dict, run: Run) -> tuple:
    index = _number(result["rule"]["index"])
    return run.rule_id(index), index


def _by_component_index(result: dict, run: Run) -> tuple:
    component, index = result["rule"]["toolComponent"], _number(result["rule"]["index"])
    place, name = _number(component.get("index")), _text(component.get("name"))
    if place is None and name is not None:  # a component may be named instead of counted
        names = [_text(_as_object(x).get("name")) for x in run.extensions]
        found = names.index(name) + 1 if name in names else 0
    else:
        found = 0 if place is None else place + 1 if place >= -1 else -1
    return run.rule_id(index, found), index, place, name


#: How each subtype's results are read: the rule's id and the subtype's own columns.
ROUTES: dict[str, Callable[[dict, Run], tuple]] = {
    "by_id": _by_id,
    "by_rule_index": _by_rule_index,
    "by_reference_id": _by_reference_id,
    "by_driver_index": _by_driver_index,
    "by_component_index": _by_component_index,
    "unnamed": lambda result, run: (None,),
}


def flatten(report: dict, automaton: Automaton, tables: tuple[str, ...] = PARSED) -> dict[str, list[tuple]]:
    """Rows of the parsed tables, of `tables` at least; positions count from 0, items that are no objects keep their position and
    give no row."""
    out: dict[str, list[tuple]] = {name: [] for name in PARSED}
    shapes: dict[tuple[str, int], int] = {}
    rules_too, locations_too, shapes_too = (t in tables for t in ("rules", "locations", "shapes"))
    for run_no, raw in enumerate(_as_list(report.get("runs"))):
        if not isinstance(raw, dict):
            continue
        run = Run(raw)
        kind = ("driver" if run.driver else "no_driver") + ("_extensions" if run.extensions else "")
        out["runs"].append((run_no, run.driver_name, _text(run.driver.get("version")), kind))
        for number, rules in enumerate(run.components if rules_too else ()):
            for rule_no, rule in enumerate(rules):
                if isinstance(rule, dict):
                    said = rule.get("shortDescription") or rule.get("fullDescription")
                    out["rules"].append((run_no, number - 1, rule_no, _text(rule.get("id")), _text(rule.get("name")), _text(_as_object(said).get("text")), "driver" if not number else "extension"))
        for result_no, result in enumerate(_as_list(raw.get("results"))):
            if not isinstance(result, dict):
                continue
            state = automaton.state(result)
            variant = automaton.variant(state)
            shapes[variant, state] = shapes.get((variant, state), 0) + 1
            rule_id, *own = ROUTES[variant](result, run)
            message = _as_object(result.get("message"))
            out[f"results_{variant}"].append((run_no, result_no, rule_id, run.driver_name, _text(result.get("level")), _text(message.get("text")), *own))
            for location_no, location in enumerate(_as_list(result.get("locations")) if locations_too else ()):
                if isinstance(location, dict):
                    physical = _as_object(location.get("physicalLocation"))
                    region, logical = _as_object(physical.get("region")), _as_list(location.get("logicalLocations"))
                    shape = ("physical_" if physical else "") + ("logical" if logical else "")
                    out["locations"].append(
                        (run_no, result_no, location_no, _text(_as_object(physical.get("artifactLocation")).get("uri")), _number(region.get("startLine")), _number(region.get("startColumn")), _text(_at(logical, 0).get("name")), shape.strip("_") or "bare")
                    )
    if shapes_too:
        out["shapes"] = [(variant, automaton.shape(state), n) for (variant, state), n in shapes.items()]
    return out


def _type(columns: str) -> str:
    return "array<struct<" + ", ".join("{}:{}".format(*c.split()) for c in columns.split(", ")) + ">>"


def _needed(names: tuple[str, ...]) -> tuple[str, ...]:
    """Parsed tables that the tables `names` are made of."""
    return tuple(t for t in PARSED if t in names or "results" in names and t.startswith("results_"))


def parse_reports(reports: DataFrame, names: tuple[str, ...] = PARSED) -> DataFrame:
    """(report_id, one array of structs per table that `names` are made of): the latest delivery of each report.

    The delivery with the greatest received_at counts (ties: the greatest hash of the payload), even if its payload is
    null, empty or cut: then the report has a row in `unreadable` only. Other columns of `reports` don't matter.
    """
    tables = _needed(names)
    schema = "report_id long, received_at timestamp, tie long, " + ", ".join(f"{t} {_type(TABLES[t])}" for t in tables)
    types = to_arrow_schema(StructType.fromDDL(schema))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        columns_of = {t: [c.split()[0] for c in TABLES[t].split(", ")] for t in tables}
        for batch in batches:
            columns: dict[str, list] = {t: [] for t in tables}
            for payload in batch.column("payload").to_pylist():
                report, reason = read_payload(payload)
                rows = flatten(report, automaton, tables) if report is not None else {"unreadable": [(reason,)]}
                for t in tables:
                    columns[t].append([dict(zip(columns_of[t], r)) for r in rows.get(t, [])])
            arrays = [batch.column(c).cast(types.field(c).type) for c in ("report_id", "received_at", "tie")]
            arrays += [pa.array(columns[t], types.field(t).type) for t in tables]
            yield pa.RecordBatch.from_arrays(arrays, schema=types)

    keyed = reports.select("report_id", "received_at", F.xxhash64("payload").alias("tie"), "payload")
    latest = Window.partitionBy("report_id").orderBy(F.col("received_at").desc_nulls_last(), F.col("tie").desc())
    parsed = keyed.mapInArrow(parse, schema)
    return parsed.withColumn("nth", F.row_number().over(latest)).filter("nth = 1").select("report_id", *tables)


def _supertype(parsed: DataFrame) -> DataFrame:
    """The common columns of all subtypes' results, with the subtype as `variant`."""
    common = [c.split()[0] for c in COMMON.split(", ")]
    of = lambda name: F.transform(f"results_{name}", lambda r: F.struct(*(r[c].alias(c) for c in common), F.lit(name).alias("variant")))
    return parsed.select("report_id", F.inline(F.concat(*(of(name) for name in SUBTYPES))))


def flat(parsed: DataFrame, name: str) -> DataFrame:
    """One of the tables in TABLES from what parse_reports() gave: report_id, the parents' positions, the own position, the columns."""
    return _supertype(parsed) if name == "results" else parsed.select("report_id", F.inline(name))


def flat_table(reports: DataFrame, name: str) -> DataFrame:
    """flat() of reports, which are parsed for this table alone. Rows are distinct."""
    return flat(parse_reports(reports, (name,)), name)


def flat_tables(reports: DataFrame) -> dict[str, DataFrame]:
    """All tables in TABLES from one parse, which is written once."""
    parsed = checkpointed(parse_reports(reports))
    return {name: flat(parsed, name) for name in TABLES}


def shape_catalogue(shapes: DataFrame) -> DataFrame:
    """(variant, shape, results, reports): every structure that results have, from the table `shapes`."""
    return shapes.groupBy("variant", "shape").agg(F.sum("results").alias("results"), F.count("*").alias("reports"))
