"""Queries of the general ingest problems (p1 to p4)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import badrows, drift, instants, nested
from tallyweave.session import table


def _feeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "feed_record"), table(spark, sf_dir, "ingest_file"), table(spark, sf_dir, "field_alias")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, field, change) of each file against its feed's previous period."""
    return drift.changes(drift.lifespans(*_feeds(spark, sf_dir)))


def p1_lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of equal name and type of each field of a feed."""
    return drift.islands(drift.lifespans(*_feeds(spark, sf_dir)))


def p1_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feeds as one table with constant columns of one type each, and what could not be cast."""
    return drift.typed(*_feeds(spark, sf_dir)).drop("json_types")


def p1_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values cast and failed by file, field and JSON type."""
    return drift.cast_report(drift.typed(*_feeds(spark, sf_dir)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report_id, run_no, result_no, rule_id, driver_name) of every result."""
    results = nested.flat_table(table(spark, sf_dir, "finding_report"), "results")
    return results.select("report_id", "run_no", "result_no", "rule_id", "driver_name")


def _flat(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: nested.flat_table(table(spark, sf_dir, "finding_report"), name)


def p2_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report_id, reason) of the reports whose latest payload is no JSON object."""
    return nested.flat_table(table(spark, sf_dir, "finding_report"), "unreadable")


def p2_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue of the structures that results have, by subtype."""
    return nested.shape_catalogue(nested.flat_table(table(spark, sf_dir, "finding_report"), "shapes"))


def p2_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, reports, rows) of every flat table, all from one parse."""
    tables = nested.flat_tables(table(spark, sf_dir, "finding_report"))
    counts = [df.agg(F.lit(name).alias("table_name"), F.count_distinct("report_id").alias("reports"), F.count("*").alias("rows")) for name, df in tables.items() if name != "shapes"]
    return reduce(DataFrame.unionByName, counts)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return badrows.parse_records(table(spark, sf_dir, "raw_record"), table(spark, sf_dir, "ingest_file"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, line_no, reason) of every failed record."""
    return badrows.failed(_records(spark, sf_dir))


def p3_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid transactions of the delimited files."""
    return badrows.valid(_records(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ingest_id, utc_micros) of every ingest row that names a moment."""
    return instants.ingest_instants(table(spark, sf_dir, "ingest"), table(spark, sf_dir, "ingest_file"))


QUERIES = {
    "p1_found": p1_found,
    "p1_lifespans": p1_lifespans,
    "p1_table": p1_table,
    "p1_casts": p1_casts,
    "p2_found": p2_found,
    "p2_runs": _flat("runs"),
    "p2_rules": _flat("rules"),
    "p2_results": _flat("results"),
    "p2_locations": _flat("locations"),
    **{f"p2_results_{name}": _flat(f"results_{name}") for name in nested.SUBTYPES},
    "p2_unreadable": p2_unreadable,
    "p2_shapes": p2_shapes,
    "p2_tables": p2_tables,
    "p3_found": p3_found,
    "p3_valid": p3_valid,
    "p4_found": p4_found,
}
ORACLE: dict[str, str] = {}

# SQL of the nested reports. A report's payload is cast once; lists are taken apart with their positions.


def _items(json: str, path: str) -> str:
    """SQL: the members of a list as a list, an object as a list of one, else none."""
    return f"CASE json_type({json}, '{path}') WHEN 'ARRAY' THEN CAST(json_extract({json}, '{path}') AS JSON[]) WHEN 'OBJECT' THEN [json_extract({json}, '{path}')] ELSE CAST([] AS JSON[]) END"


def _string(json: str, path: str) -> str:
    return f"CASE WHEN json_type({json}, '{path}') = 'VARCHAR' THEN json_extract_string({json}, '{path}') END"


def _number(json: str, path: str) -> str:
    return f"CASE WHEN json_type({json}, '{path}') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract({json}, '{path}') AS BIGINT) END"


_PAYLOADS = """last AS (SELECT report_id, payload, ltrim(payload, chr(65279)) AS p FROM finding_report QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY received_at DESC NULLS LAST) = 1),
  told AS (SELECT report_id, CASE WHEN payload IS NULL THEN 'missing' WHEN trim(p, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN 'blank' WHEN NOT json_valid(p) THEN 'malformed' WHEN json_type(p) <> 'OBJECT' THEN 'no_object' END AS reason, p FROM last),
  report AS (SELECT report_id, CAST(CASE WHEN reason IS NULL THEN p ELSE '{}' END AS JSON) AS j FROM told)"""
_RUNS = f"""{_PAYLOADS}, rs AS (SELECT report_id, {_items("j", "$.runs")} AS l FROM report),
  run AS (SELECT report_id, CAST(k - 1 AS INTEGER) AS run_no, r, {_string("r", "$.tool.driver.name")} AS driver_name, {_items("r", "$.tool.driver.rules")} AS rules, {_items("r", "$.tool.extensions")} AS extensions
    FROM (SELECT report_id, unnest(l) AS r, generate_subscripts(l, 1) AS k FROM rs) WHERE json_type(r) = 'OBJECT')"""
_ID = _string("x", "$.id")
_RESULTS = f"""{_RUNS}, xs AS (SELECT * EXCLUDE (r), {_items("r", "$.results")} AS l FROM run),
  raw AS (SELECT * FROM (SELECT * EXCLUDE (l), unnest(l) AS v, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS result_no FROM xs) WHERE json_type(v) = 'OBJECT'),
  named AS (SELECT *, {_number("v", "$.ruleIndex")} AS result_index, {_number("v", "$.rule.index")} AS reference_index, {_number("v", "$.rule.toolComponent.index")} AS component_index, {_string("v", "$.rule.toolComponent.name")} AS component_name,
    CASE WHEN json_type(v, '$.ruleId') = 'VARCHAR' THEN 'by_id' WHEN json_type(v, '$.rule.id') = 'VARCHAR' THEN 'by_reference_id'
      WHEN json_type(v, '$.rule') = 'OBJECT' AND json_type(v, '$.rule.index') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CASE WHEN json_type(v, '$.rule.toolComponent') = 'OBJECT' THEN 'by_component_index' ELSE 'by_driver_index' END
      WHEN json_type(v, '$.ruleIndex') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'by_rule_index' ELSE 'unnamed' END AS variant FROM raw),
  placed AS (SELECT *, CASE WHEN variant = 'by_component_index' THEN coalesce(component_index, list_position(list_transform(extensions, lambda x: {_string("x", "$.name")}), component_name) - 1, -1) ELSE -1 END AS component FROM named),
  chosen AS (SELECT *, CASE WHEN component = -1 THEN rules WHEN component >= 0 THEN {_items("extensions[component + 1]", "$.rules")} END AS listed, CASE variant WHEN 'by_rule_index' THEN result_index ELSE reference_index END AS pos FROM placed),
  result AS (SELECT report_id, run_no, result_no, driver_name, variant, result_index, reference_index, component_index, component_name, {_string("v", "$.level")} AS level, {_string("v", "$.message.text")} AS message_text,
    CASE variant WHEN 'by_id' THEN json_extract_string(v, '$.ruleId') WHEN 'by_reference_id' THEN json_extract_string(v, '$.rule.id') WHEN 'unnamed' THEN NULL ELSE CASE WHEN pos >= 0 THEN {_string("listed[pos + 1]", "$.id")} END END AS rule_id, {_items("v", "$.locations")} AS locations FROM chosen)"""
_COMMON = "report_id, run_no, result_no, rule_id, driver_name, level, message_text"
_OWN = {
    "by_id": "result_index AS rule_index",
    "by_rule_index": "result_index AS rule_index",
    "by_reference_id": "component_index, component_name",
    "by_driver_index": "reference_index AS rule_index",
    "by_component_index": "reference_index AS rule_index, component_index, component_name",
    "unnamed": "",
}
_RULES = f"""{_RUNS}, c AS (SELECT report_id, run_no, -1 AS component_no, rules AS l FROM run UNION ALL SELECT report_id, run_no, CAST(k - 1 AS INTEGER), {_items("e", "$.rules")} FROM (SELECT report_id, run_no, unnest(extensions) AS e, generate_subscripts(extensions, 1) AS k FROM run)),
  rule AS (SELECT report_id, run_no, component_no, CAST(k - 1 AS INTEGER) AS rule_no, x FROM (SELECT *, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM c) WHERE json_type(x) = 'OBJECT')"""
ORACLE |= {
    "p2_found": f"WITH {_RESULTS} SELECT report_id, run_no, result_no, rule_id, driver_name FROM result",
    "p2_results": f"WITH {_RESULTS} SELECT {_COMMON}, variant FROM result",
    **{f"p2_results_{name}": f"WITH {_RESULTS} SELECT {', '.join(filter(None, (_COMMON, own)))} FROM result WHERE variant = '{name}'" for name, own in _OWN.items()},
    "p2_runs": f"""WITH {_RUNS} SELECT report_id, run_no, driver_name, {_string("r", "$.tool.driver.version")} AS driver_version, CASE WHEN json_type(r, '$.tool.driver') = 'OBJECT' AND json_extract(r, '$.tool.driver') <> '{{}}' THEN 'driver' ELSE 'no_driver' END || CASE WHEN len(extensions) > 0 THEN '_extensions' ELSE '' END AS variant FROM run""",
    "p2_rules": f"""WITH {_RULES} SELECT report_id, run_no, component_no, rule_no, {_ID} AS rule_id, {_string("x", "$.name")} AS name, coalesce({_string("x", "$.shortDescription.text")}, {_string("x", "$.fullDescription.text")}) AS text, CASE WHEN component_no < 0 THEN 'driver' ELSE 'extension' END AS variant FROM rule""",
    "p2_locations": f"""WITH {_RESULTS}, y AS (SELECT report_id, run_no, result_no, unnest(locations) AS l, CAST(generate_subscripts(locations, 1) - 1 AS INTEGER) AS location_no FROM result), z AS (SELECT *, {_items("l", "$.logicalLocations")} AS g FROM y WHERE json_type(l) = 'OBJECT')
  SELECT report_id, run_no, result_no, location_no, {_string("l", "$.physicalLocation.artifactLocation.uri")} AS uri, {_number("l", "$.physicalLocation.region.startLine")} AS start_line, {_number("l", "$.physicalLocation.region.startColumn")} AS start_column, {_string("g[1]", "$.name")} AS logical_name,
    CASE WHEN json_type(l, '$.physicalLocation') = 'OBJECT' AND len(g) > 0 THEN 'physical_logical' WHEN json_type(l, '$.physicalLocation') = 'OBJECT' THEN 'physical' WHEN len(g) > 0 THEN 'logical' ELSE 'bare' END AS variant FROM z""",
    "p2_unreadable": f"WITH {_PAYLOADS} SELECT report_id, reason FROM told WHERE reason IS NOT NULL",
}

# SQL of the failed records: fields by the strict grammar, then dates and amounts by theirs. White space is what the reader trims.

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"
_FIELD = """'("(?:[^"]|"")*"|[^"' || d || ']*)'"""
_MON = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_NUM = "(?:(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:[.][0-9]{0,2})?|[.][0-9]{1,2})"


def _unquoted(fields: str) -> str:
    return f"list_transform({fields}, lambda f: trim(CASE WHEN starts_with(f, chr(34)) THEN replace(substr(f, 2, len(f) - 2), chr(34) || chr(34), chr(34)) ELSE f END, {_WHITE}))"


def _split(text: str) -> str:
    return f"regexp_extract_all(d || {text}, '(?s)' || CASE WHEN d IN ('|', '^', '.', '*', '+', '?') THEN '[' || d || ']' ELSE d END || {_FIELD}, 1)"


def _any_date(s: str) -> str:
    """SQL: the day of a text in one of the accepted forms, null unless a real one."""
    full = lambda form: f"regexp_full_match(lower({s}), '{form}')"
    long_year = f"regexp_replace({s}, '([/-])([0-9][0-9])$', '\\120\\2')"
    # Month names are cut to three letters.
    short = f"regexp_replace({long_year}, '([A-Za-z]{{3}})[A-Za-z]*', '\\1')"
    return f"""CASE WHEN {full("[0-9]{4}-[0-9]{2}-[0-9]{2}")} THEN try_strptime({s}, '%Y-%m-%d') WHEN {full("[0-9]{1,2}/[0-9]{1,2}/(?:[0-9]{4}|[0-9]{2})")} THEN try_strptime({long_year}, '%m/%d/%Y')
    WHEN {full("[0-9]{8}")} THEN try_strptime({s}, '%Y%m%d') WHEN {full(_MON + " +[0-9]{1,2}, *[0-9]{4}")} THEN try_strptime(regexp_replace(regexp_replace({short}, ' +', ' ', 'g'), ', *', ' '), '%b %d %Y')
    WHEN {full("[0-9]{1,2}-" + _MON + "-(?:[0-9]{4}|[0-9]{2})")} THEN try_strptime({short}, '%d-%b-%Y') END"""


_FAILED = f"""h AS (SELECT file_id, header_line, delim AS d FROM ingest_file WHERE header_line IS NOT NULL AND delim IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY received_at DESC, header_line DESC, delim DESC) = 1),
  n AS (SELECT *, list_transform({_unquoted(_split("header_line"))}, lambda f: lower(f)) AS names FROM h),
  r AS (SELECT DISTINCT file_id, line_no, raw_text, d, names FROM raw_record JOIN n USING (file_id) WHERE trim(raw_text, {_WHITE}) <> ''),
  g AS (SELECT *, list_reduce({_split("raw_text")}, lambda x, y: x || d || y) = raw_text AS quoted, {_unquoted(_split("raw_text"))} AS f FROM r),
  v AS (SELECT *, len(f) = len(names) AS counted, f[coalesce(list_position(names, 'date'), list_position(names, 'posting date'))] AS day,
    list_filter(list_transform(list_zip(names, f), lambda x: CASE WHEN x[1] IN ('amount', 'debit', 'credit', 'withdrawal amt', 'deposit amt', 'charge', 'payment') THEN x[2] END), lambda a: a <> '') AS amounts FROM g),
  w AS (SELECT *, {_any_date("day")} IS NOT NULL AS dated, len(amounts) = 1 AND regexp_full_match(amounts[1], '[(][$]?[+-]?{_NUM}[)]|[$]?[+-]?{_NUM}') AS amounted FROM v)"""
ORACLE["p3_found"] = f"""WITH {_FAILED} SELECT DISTINCT file_id, line_no, reason FROM (SELECT file_id, line_no, unnest(CASE WHEN NOT quoted THEN ['quoting'] WHEN NOT counted THEN ['column_count']
  ELSE list_concat(CASE WHEN coalesce(dated, false) THEN CAST([] AS VARCHAR[]) ELSE ['date'] END, CASE WHEN coalesce(amounted, false) THEN CAST([] AS VARCHAR[]) ELSE ['amount'] END) END) AS reason FROM w)"""
_FIRST = lambda *names: f"f[coalesce({', '.join(f'list_position(names, {n!r})' for n in names)})]"
ORACLE["p3_valid"] = f"""WITH {_FAILED}, a AS (SELECT *, amounts[1] AS t, list_filter(list_zip(names, f), lambda x: x[1] IN ('amount', 'debit', 'credit', 'withdrawal amt', 'deposit amt', 'charge', 'payment') AND x[2] <> '')[1][1] AS filled FROM w WHERE quoted AND counted AND dated AND amounted)
  SELECT DISTINCT file_id, line_no, CAST({_any_date("day")} AS DATE) AS txn_date, CAST(CAST('0' || regexp_replace(t, '[^0-9.]', '', 'g') AS DECIMAL(30, 2)) * 100 AS BIGINT) * CASE WHEN contains(t, '-') <> starts_with(t, '(') THEN -1 ELSE 1 END
    * CASE WHEN filled IN ('debit', 'withdrawal amt', 'charge') THEN -1 ELSE 1 END AS amount, {_FIRST("memo", "description", "details")} AS memo, {_FIRST("type")} AS kind, {_FIRST("name", "tenant")} AS party FROM a"""
ORACLE["p2_tables"] = " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(DISTINCT report_id) AS reports, count(*) AS rows FROM ({ORACLE[f'p2_{name}']})" for name in nested.TABLES if name != "shapes")
