"""Manifests of files or records: build, attach hints, compare, verify, roll up and check against policies.

A manifest has the columns path, content_hash and leaf (lower-case hex), and optionally source and license.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import under_prefix

NO_LICENSE, NO_SOURCE = "(no license hint)", "(no source hint)"


def build(items: DataFrame, digest: Column) -> DataFrame:
    """(path, content_hash, leaf) of `items` with the column path; the leaf binds path and content by SHA-256."""
    leaf = F.sha2(F.concat(F.col("path").cast("binary"), F.lit(bytearray(b"\0")), F.unhex("content_hash")), 256)
    return items.select("path", digest.alias("content_hash")).withColumn("leaf", leaf)


def repeated_paths(manifest: DataFrame) -> DataFrame:
    """(path, count) of paths that stand more than once; a sound manifest has none."""
    return manifest.groupBy("path").count().filter("count > 1")


def attach_hints(manifest: DataFrame, hints: DataFrame) -> DataFrame:
    """The manifest with source and license of `hints` (path, source, license); null where there is none."""
    return manifest.join(hints.select("path", "source", "license"), "path", "left")


def unknown_hints(manifest: DataFrame, hints: DataFrame) -> DataFrame:
    """Hints whose path is not in the manifest: an error of the caller."""
    return hints.join(manifest.select("path"), "path", "left_anti")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, old_hash, new_hash) of every path of either side: added, removed, changed or unchanged.

    Leaves are compared without regard to case. A rename is a removal and an addition.
    """
    old = before.select("path", F.col("content_hash").alias("old_hash"), F.lower("leaf").alias("old_leaf"), F.lit(True).alias("was"))
    new = after.select("path", F.col("content_hash").alias("new_hash"), F.lower("leaf").alias("new_leaf"), F.lit(True).alias("is"))
    change = (
        F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("old_leaf").eqNullSafe(F.col("new_leaf")), "unchanged").otherwise("changed")
    )
    return old.join(new, "path", "full_outer").select("path", change.alias("change"), "old_hash", "new_hash")


def verify(sealed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status): ok, changed, missing or unexpected, of what was sealed against what is found now."""
    names = {"unchanged": "ok", "changed": "changed", "removed": "missing", "added": "unexpected"}
    status = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("change")]
    return compare(sealed, found).select("path", status.alias("status"))


def histogram(manifest: DataFrame, column: str, nothing: str) -> DataFrame:
    """(value, files): count by value, null under the name `nothing`; the counts add up to all rows."""
    return manifest.groupBy(F.coalesce(F.col(column), F.lit(nothing)).alias("value")).agg(F.count("*").alias("files"))


def histograms(manifest: DataFrame) -> DataFrame:
    """(hint, value, files) of licenses, sources and all files in one pass by grouping sets."""
    license_, source = F.coalesce("license", F.lit(NO_LICENSE)), F.coalesce("source", F.lit(NO_SOURCE))
    x = manifest.select(license_.alias("license"), source.alias("source"))
    sets = x.groupingSets([[F.col("license")], [F.col("source")], []], F.col("license"), F.col("source")).agg(F.count("*").alias("files"), F.grouping_id().alias("g"))
    hint = F.when(F.col("g") == 1, "license").when(F.col("g") == 2, "source").otherwise("all")
    return sets.select(hint.alias("hint"), F.coalesce("license", "source", F.lit("*")).alias("value"), "files")


def ordered_histogram(hist: DataFrame, nothing: str) -> DataFrame:
    """A histogram in report order: the bucket of missing hints last, then by falling count, then by value."""
    return hist.orderBy(F.col("value") == nothing, F.col("files").desc(), "value")


def _broken(checks: list[tuple[Column, str, Column]]) -> Column:
    """Array of (rule, value) of the checks that fire."""
    one = lambda fires, rule, value: F.when(fires, F.struct(F.lit(rule).alias("rule"), value.alias("value")))
    return F.array_compact(F.array(*(one(*c) for c in checks)))


def policy_violations(
    manifest: DataFrame, allow_licenses: list[str] = (), deny_licenses: list[str] = (), allow_sources: list[str] = (), deny_sources: list[str] = (), require_license: bool = False
) -> DataFrame:
    """(path, rule, value): one row per file and rule broken.

    Missing hints break allow-lists and the requirement, never deny-lists. Values are compared as written; an empty list is
    no rule. The lists are parameters of the plan, so the check is one pass without a join.
    """
    license_, source = F.col("license"), F.col("source")
    checks = []
    if require_license:
        checks.append((license_.isNull(), "requireLicense", F.lit(NO_LICENSE)))
    if allow_licenses:
        checks.append((license_.isNull() | ~license_.isin(*allow_licenses), "allowLicenses", F.coalesce(license_, F.lit(NO_LICENSE))))
    if deny_licenses:
        checks.append((license_.isin(*deny_licenses), "denyLicenses", license_))
    if allow_sources:
        checks.append((source.isNull() | ~source.isin(*allow_sources), "allowSources", F.coalesce(source, F.lit(NO_SOURCE))))
    if deny_sources:
        checks.append((source.isin(*deny_sources), "denySources", source))
    if not checks:
        return manifest.select("path", F.lit("").alias("rule"), F.lit("").alias("value")).limit(0)
    return manifest.select("path", F.explode(_broken(checks)).alias("v")).select("path", "v.rule", "v.value")


def verdict(manifest: DataFrame, violations: DataFrame) -> DataFrame:
    """One row: verdict PASS or FAIL, the files and the violations."""
    n = manifest.agg(F.count("*").alias("files"))
    v = violations.agg(F.count("*").alias("violations"))
    return n.crossJoin(v).select(F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("verdict"), "files", "violations")  # one row each


def drift_violations(changes: DataFrame, no_added: bool = False, no_removed: bool = False, no_changed: bool = False, allow_change: list[str] = (), frozen: list[str] = ()) -> DataFrame:
    """(path, rule, change) of the result of compare() against a drift policy.

    Frozen folders forbid changes and removals, not additions; allowed folders restrict where changes may be.
    """
    path, change = F.col("path"), F.col("change")

    def under(folders: list[str]) -> Column:
        out = F.lit(False)
        for f in folders:
            out |= under_prefix(path, F.lit(f))
        return out

    added, removed, changed = (change == x for x in ("added", "removed", "changed"))
    checks = []
    if no_added:
        checks.append((added, "noAdded", F.upper(change)))
    if no_removed:
        checks.append((removed, "noRemoved", F.upper(change)))
    if no_changed:
        checks.append((changed, "noChanged", F.upper(change)))
    if allow_change:
        checks.append((changed & ~under(allow_change), "allowChangePaths", F.upper(change)))
    if frozen:
        checks.append(((changed | removed) & under(frozen), "frozenPaths", F.upper(change)))
    if not checks:
        return changes.select("path", F.lit("").alias("rule"), "change").limit(0)
    return changes.filter("change != 'unchanged'").select("path", F.explode(_broken(checks)).alias("v")).select("path", "v.rule", F.col("v.value").alias("change"))
