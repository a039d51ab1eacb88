"""Report forms of findings and packets, as DataFrames of text that any writer can store.

Findings have the columns source, rule, severity, message, location, line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.money import format_cents
from tallyweave.functions.text import natural_key
from tallyweave.operators.findings import severity_rank
from tallyweave.operators.ordered import numbered

_LEVELS = {"fatal": "error", "warning": "warning", "information": "note"}
_GITLAB = {"fatal": "blocker", "warning": "minor", "information": "info"}


def _mapped(severity: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[severity], F.lit(names["information"]))


def exceptions_long(exceptions: DataFrame) -> DataFrame:
    """One row per exception (type, severity, amount, label) and record (array `records` of date, amount, memo, party); an
    exception without records has one row with nulls: an outer explode."""
    x = exceptions.select("type", "severity", "amount", "label", F.explode_outer("records").alias("r"))
    direction = F.when(F.col("r.amount") > 0, "in").when(F.col("r.amount") < 0, "out").otherwise("")
    return x.select("type", "severity", "amount", "label", F.col("r.date").alias("record_date"), F.col("r.amount").alias("record_amount"), F.col("r.memo").alias("record_memo"), F.col("r.party").alias("record_party"), direction.alias("direction"))


def balances_long(balances: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """(ids, balance, cents, shown): the balance columns unpivoted."""
    x = balances.unpivot([F.col(i) for i in ids], [F.col(v) for v in values], "balance", "cents")
    return x.withColumn("shown", format_cents(F.col("cents")))


def csv_field(value: Column) -> Column:
    """A field quoted where it holds a delimiter, a quote or a line break; null is empty."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_lines(df: DataFrame) -> DataFrame:
    """(line) of every row, fields in column order."""
    return df.select(F.concat_ws(",", *(csv_field(F.col(f"`{c}`")) for c in df.columns)).alias("line"))


def fingerprint(rule: Column, location: Column) -> Column:
    """Fingerprint that doesn't change with the message or the line."""
    return F.substring(F.sha2(F.concat_ws("\n", rule, F.coalesce(location, F.lit(""))), 256), 1, 16)


def _in_order() -> list:
    return [severity_rank(F.col("severity")), natural_key(F.col("rule")), "rule", "location", "message"]


def _documents(findings: DataFrame, item: Column) -> DataFrame:
    """(source, items): the items of each source in order."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy(*_in_order()))
    x = findings.select("source", nth.alias("nth"), item.alias("item"))
    return x.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "item")), lambda a, b: a["nth"] - b["nth"]), lambda s: s["item"]).alias("items"))


def sarif(findings: DataFrame, driver: str) -> DataFrame:
    """(source, document): a SARIF 2.1.0 document per source."""
    line = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine")))
    place = F.struct(F.struct(F.struct(F.col("source").alias("uri")).alias("artifactLocation"), line.alias("region")).alias("physicalLocation"), F.array(F.struct(F.col("location").alias("name"), F.lit("member").alias("kind"))).alias("logicalLocations"))
    item = F.struct(
        F.col("rule").alias("ruleId"), _mapped(F.col("severity"), _LEVELS).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"),
        F.create_map(F.lit("finding/v1"), fingerprint(F.col("rule"), F.col("location"))).alias("partialFingerprints"),
    )
    docs = _documents(findings, item)
    rules = F.transform(F.array_distinct(F.col("items.ruleId")), lambda r: F.struct(r.alias("id")))
    run = F.struct(F.struct(F.struct(F.lit(driver).alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), F.col("items").alias("results"))
    return docs.select("source", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


def code_quality(findings: DataFrame) -> DataFrame:
    """(source, document): a JSON array of code-quality issues per source."""
    item = F.struct(
        F.col("message").alias("description"), F.col("rule").alias("check_name"), fingerprint(F.col("rule"), F.col("location")).alias("fingerprint"), _mapped(F.col("severity"), _GITLAB).alias("severity"),
        F.struct(F.col("source").alias("path"), F.struct(F.coalesce("line", F.lit(1)).alias("begin")).alias("lines")).alias("location"),
    )
    return _documents(findings, item).select("source", F.to_json("items").alias("document"))


def _escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def annotations(findings: DataFrame) -> DataFrame:
    """(source, line_text): workflow annotations, one a finding."""
    kind = _mapped(F.col("severity"), {"fatal": "error", "warning": "warning", "information": "notice"})
    text = F.concat(F.lit("::"), kind, F.lit(" file="), _escaped(F.col("source")), F.lit(",line="), F.coalesce("line", F.lit(1)).cast("string"), F.lit(",title="), _escaped(F.col("rule")), F.lit("::"), _escaped(F.col("message")))
    return findings.select("source", text.alias("line_text"))


def log_issues(findings: DataFrame) -> DataFrame:
    """(source, line_text): pipeline log issues, one a finding."""
    kind = F.when(F.col("severity") == "fatal", "error").otherwise("warning")
    text = F.concat(F.lit("##vso[task.logissue type="), kind, F.lit(";sourcepath="), _escaped(F.col("source")), F.lit(";linenumber="), F.coalesce("line", F.lit(1)).cast("string"), F.lit(";code="), _escaped(F.col("rule")), F.lit("]"), _escaped(F.col("message")))
    return findings.select("source", text.alias("line_text"))


def _xml(text: Column) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def junit(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, document): a test suite per source of `sources`; a source without findings has one passing case."""
    case = F.concat(F.lit('<testcase name="'), _xml(F.col("rule")), F.lit('"><failure message="'), _xml(F.col("message")), F.lit('" type="'), _xml(F.col("severity")), F.lit('"/></testcase>'))
    x = sources.select("source").join(_documents(findings, case), "source", "left")
    n = F.coalesce(F.size("items"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    body = F.when(n > 0, F.array_join("items", "")).otherwise(F.lit('<testcase name="all rules"/>'))
    head = F.concat(F.lit('<testsuite name="'), _xml(F.col("source")), F.lit('" tests="'), F.greatest(n, F.lit(1)).cast("string"), F.lit('" failures="'), n.cast("string"), F.lit('">'))
    return x.select("source", F.concat(head, body, F.lit("</testsuite>")).alias("document"))


def badge(findings: DataFrame) -> DataFrame:
    """One row (label, message, color): the worst severity of all findings."""
    worst = findings.agg(F.min(severity_rank(F.col("severity"))).alias("worst"))
    message = F.when(F.col("worst").isNull(), "passing").when(F.col("worst") == 0, "failing").when(F.col("worst") == 1, "warnings").otherwise("notes")
    color = F.when(F.col("worst").isNull(), "brightgreen").when(F.col("worst") == 0, "red").when(F.col("worst") == 1, "yellow").otherwise("blue")
    return worst.select(F.lit("conformance").alias("label"), message.alias("message"), color.alias("color"))


def text_summaries(findings: DataFrame, k: int = 20) -> DataFrame:
    """(source, document): each source's first `k` findings, one a line, and how many more there are."""
    line = F.concat(F.upper("severity"), F.lit(" "), F.coalesce("rule", F.lit("")), F.lit(" "), F.coalesce("location", F.lit("")), F.lit(": "), F.coalesce("message", F.lit("")))
    x = _documents(findings, line)
    more = F.size("items") - k
    return x.select("source", F.concat(F.array_join(F.slice("items", 1, k), "\n"), F.when(more > 0, F.concat(F.lit("\n"), more.cast("string"), F.lit(" more"))).otherwise("")).alias("document"))


def batch_summary(files: DataFrame, k: int = 50) -> DataFrame:
    """One row (document) over the result of by_source(): a line of totals, then the first `k` files that are not valid."""
    bad = files.filter("not valid").orderBy("source").limit(k).agg(F.array_sort(F.collect_list(F.concat(F.lit("FAILED "), "source", F.lit(": "), F.coalesce("error", F.concat(F.col("fatal").cast("string"), F.lit(" fatal")))))).alias("lines"))
    total = files.agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("failed"))
    head = F.concat(F.col("n").cast("string"), F.lit(" files, "), F.col("failed").cast("string"), F.lit(" failed"))
    rest = F.when(F.col("failed") > k, F.array(F.concat((F.col("failed") - k).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return total.crossJoin(F.broadcast(bad)).select(F.array_join(F.concat(F.array(head), "lines", rest), "\n").alias("document"))  # one row each


def html_tables(findings: DataFrame) -> DataFrame:
    """(source, document): a page with a table of each source's findings."""
    cell = lambda c: F.concat(F.lit("<td>"), _xml(F.col(c).cast("string")), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), *(cell(c) for c in ("severity", "rule", "location", "message")), F.lit("</tr>"))
    x = _documents(findings, row)
    head = "<table><tr><th>Severity</th><th>Rule</th><th>Location</th><th>Message</th></tr>"
    return x.select("source", F.concat(F.lit("<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>"), _xml(F.col("source")), F.lit(f"</title></head><body>{head}"), F.array_join("items", ""), F.lit("</table></body></html>")).alias("document"))


def render(findings: DataFrame, form: str, sources: DataFrame | None = None) -> DataFrame:
    """Findings in one of the forms json, text, html, sarif, junit (needs `sources`), gitlab, github, azure, badge; ValueError for others."""
    forms = {
        "json": lambda: _documents(findings, F.struct("severity", "rule", "location", "message", "line")).select("source", F.to_json("items").alias("document")),
        "text": lambda: text_summaries(findings), "html": lambda: html_tables(findings), "sarif": lambda: sarif(findings, "ledger-check"), "gitlab": lambda: code_quality(findings),
        "junit": lambda: junit(findings, findings.select("source").distinct() if sources is None else sources),
        "github": lambda: annotations(findings), "azure": lambda: log_issues(findings), "badge": lambda: badge(findings),
    }
    if form not in forms:
        raise ValueError(f"no form {form}; there are {', '.join(forms)}")
    return forms[form]()


def bundle(documents: dict[str, DataFrame]) -> DataFrame:
    """(name, content, digest): one-row documents by name as bytes with their SHA-256; each must have the one column document."""
    out = None
    for name, df in documents.items():
        part = df.select(F.lit(name).alias("name"), F.col("document").cast("binary").alias("content"), F.sha2(F.col("document").cast("binary"), 256).alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out


def manifest_lines(manifest: DataFrame) -> DataFrame:
    """(pos, line): a manifest (path, content_hash, leaf) as one JSON document, a file a line in order of paths.

    Lines are numbered by ranges, so a manifest of any size is written in parallel; parts joined in order are the document.
    """
    item = F.to_json(F.struct(F.col("path").alias("relPath"), F.col("content_hash").alias("contentHash"), "leaf"))
    x = numbered(manifest.select("path", "content_hash", "leaf"), "path", "content_hash")
    total = x.agg(F.max("pos").alias("last"))  # one row
    line = F.concat(F.when(F.col("pos") == 0, '{"files":[').otherwise(","), item, F.when(F.col("pos") == F.col("last"), "]}").otherwise(""))
    lines = x.crossJoin(F.broadcast(total)).select("pos", line.alias("line"))
    none = manifest.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(0).cast("bigint").alias("pos"), F.lit('{"files":[]}').alias("line"))
    return lines.unionByName(none)


def write_manifest(manifest: DataFrame, folder: str) -> None:
    """manifest_lines() as text parts below `folder`, in order."""
    manifest_lines(manifest).orderBy("pos").select("line").write.mode("errorifexists").text(folder)


def explained(findings: DataFrame, catalogue: DataFrame, language: str = "en") -> DataFrame:
    """Findings with title and fix of the catalogue (rule, language, title, fix): in the language, else in English, else null."""
    pick = lambda lang, tag: catalogue.filter(F.col("language") == lang).select("rule", F.col("title").alias(f"title_{tag}"), F.col("fix").alias(f"fix_{tag}")).dropDuplicates(["rule"])
    x = findings.join(pick(language, "a"), "rule", "left").join(pick("en", "b"), "rule", "left")
    return x.select(*(findings[c] for c in findings.columns if c != "rule"), "rule", F.coalesce("title_a", "title_b").alias("title"), F.coalesce("fix_a", "fix_b").alias("fix"))


def packet(parts: dict[str, DataFrame], kind: str) -> DataFrame:
    """One row (document): a JSON object of small tables by name, each an array of its rows.

    For summaries, whose rows are few by construction; their order is that of the rows' texts.
    """
    out = None
    for name, df in parts.items():
        rows = df.agg(F.array_sort(F.collect_list(F.to_json(F.struct(*df.columns)))).alias(name))
        out = rows if out is None else out.crossJoin(rows)  # one row each
    body = F.concat_ws(",", *(F.concat(F.lit(f'"{n}":['), F.array_join(n, ","), F.lit("]")) for n in parts))
    return out.select(F.concat(F.lit(f'{{"kind":"{kind}",'), body, F.lit("}")).alias("document"))


def receipts(reports: DataFrame, key: str, body: str) -> DataFrame:
    """(key, digest) of report bodies in canonical JSON: SHA-256 of the canonical form; null for bodies that have none."""
    from tallyweave.operators.logs import canonical

    return reports.select(key, F.sha2(canonical(F.col(body)).cast("binary"), 256).alias("digest"))


def receipts_hold(reports: DataFrame, key: str, body: str, issued: DataFrame) -> DataFrame:
    """(key, status): ok, changed or missing, of issued receipts (key, digest) against the reports at hand."""
    now = receipts(reports, key, body).withColumnRenamed("digest", "_now")
    status = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.lower("digest"), "ok").otherwise("changed")
    return issued.join(now, key, "left").select(key, status.alias("status"))
