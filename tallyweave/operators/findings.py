"""Findings of checks: roll-ups by file and batch, frequencies, baselines, code lists and re-grading.

Findings have the columns source, rule, severity, message, location; severities rank fatal, warning, information.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.text import natural_key

SEVERITIES = ("fatal", "warning", "information")


def severity_rank(severity: Column) -> Column:
    """0 for fatal, 1 for warning, 2 for information and all else."""
    return F.when(severity == SEVERITIES[0], 0).when(severity == SEVERITIES[1], 1).otherwise(2)


def by_source(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, error, fatal, warning, violations, valid): every source of `sources` (source, error), those without findings too.

    A source that couldn't be read has an error and is not valid.
    """
    counts = findings.groupBy("source").agg(F.count_if(F.col("severity") == "fatal").alias("fatal"), F.count_if(F.col("severity") == "warning").alias("warning"), F.count("*").alias("violations"))
    x = sources.select("source", "error").join(counts, "source", "left")
    x = x.select("source", "error", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("fatal", "warning", "violations")))
    return x.withColumn("valid", F.col("error").isNull() & (F.col("fatal") == 0))


def batch(files: DataFrame) -> DataFrame:
    """One row of totals over the result of by_source(), with the verdict: fatal before unreadable before ok."""
    failed = F.count_if(~F.col("valid"))
    total = files.agg(
        F.count("*").alias("file_count"),
        failed.alias("failed_file_count"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_count") for c in ("fatal", "warning", "violations")),
        F.coalesce(F.bool_or(F.col("error").isNotNull()), F.lit(False)).alias("_unread"),
    )
    verdict = F.when(F.col("fatal_count") > 0, "fatal").when(F.col("_unread"), "unreadable").otherwise("ok")
    return total.withColumn("verdict", verdict).drop("_unread")


def rule_frequency(findings: DataFrame) -> DataFrame:
    """(rule, files, hits, severity): distinct files and findings of each rule, and its worst severity.

    Files are counted in two steps (rule and source, then rule), so a rule that a third of the findings has is spread.
    """
    one = findings.groupBy("rule", "source").agg(F.count("*").alias("n"), F.min(severity_rank(F.col("severity"))).alias("rank"))
    x = one.groupBy("rule").agg(F.count("*").alias("files"), F.sum("n").alias("hits"), F.min("rank").alias("rank"))
    return x.select("rule", "files", "hits", F.get(F.array(*(F.lit(s) for s in SEVERITIES)), "rank").alias("severity"))


def top_rules(findings: DataFrame, k: int) -> DataFrame:
    """The `k` rules with the most files: by files, worst severity, then the rule in natural order."""
    return rule_frequency(findings).orderBy(F.col("files").desc(), severity_rank(F.col("severity")), natural_key(F.col("rule")), "rule").limit(k)


def first_findings(findings: DataFrame, k: int) -> DataFrame:
    """Each source's `k` first findings, fatal first, then rules in natural order, with `more`: how many follow them."""
    order = [severity_rank(F.col("severity")), natural_key(F.col("rule")), "rule", "location", "message"]
    nth = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    total = F.count("*").over(Window.partitionBy("source"))
    x = findings.withColumn("nth", nth).withColumn("more", F.greatest(total - k, F.lit(0)))
    return x.filter(F.col("nth") <= k)


def multiset_difference(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, added, removed, kept): how many copies of each key are new, gone and common. Counted before the join."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = cond[0]
    for c in cond[1:]:
        both &= c
    x = count(current, "now").alias("a").join(count(baseline, "was").alias("b"), both, "full_outer")
    now, was = F.coalesce("a.now", F.lit(0)), F.coalesce("b.was", F.lit(0))
    return x.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), F.greatest(now - was, F.lit(0)).alias("added"), F.greatest(was - now, F.lit(0)).alias("removed"), F.least(now, was).alias("kept"))


def regression(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """One row: copies added, removed and kept, new fatal ones, and whether it is a regression (a new fatal one)."""
    d = multiset_difference(current, baseline, keys)
    fatal = F.coalesce(F.sum(F.when(F.col("severity") == "fatal", F.col("added"))), F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return d.agg(total("added"), total("removed"), total("kept"), fatal.alias("new_fatal")).withColumn("regressed", F.col("new_fatal") > 0)


def agreement(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(rule, both, ours_only, theirs_only) of two sets of (source, rule): a symmetric difference by rule."""
    a, b = ours.select("source", "rule").distinct().withColumn("a", F.lit(True)), theirs.select("source", "rule").distinct().withColumn("b", F.lit(True))
    x = a.join(b, ["source", "rule"], "full_outer")
    have = lambda c: F.coalesce(c, F.lit(False))
    return x.groupBy("rule").agg(F.count_if(have("a") & have("b")).alias("both"), F.count_if(have("a") & ~have("b")).alias("ours_only"), F.count_if(~have("a") & have("b")).alias("theirs_only"))


def outside_list(rows: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Rows whose non-null code is not in the one column `code` of `codes`."""
    return rows.filter(F.col(column).isNotNull()).join(codes.select(F.col("code").alias(column)).distinct(), column, "left_anti")


def regraded(findings: DataFrame, policy: DataFrame, key: str = "rule") -> DataFrame:
    """Findings with the severity and citation that `policy` (key, severity, citation) sets for their key, else their own and null."""
    p = policy.select(F.col(key), F.col("severity").alias("_severity"), "citation").dropDuplicates([key])
    x = findings.join(p, key, "left")
    return x.withColumn("severity", F.coalesce("_severity", "severity")).drop("_severity").select(*findings.columns, "citation")


def roll_up(rows: DataFrame, group: str, amount: str) -> DataFrame:
    """(group, count, impact) of each group and in total (null group): rows and the sum of absolute amounts, by one roll-up."""
    return rows.rollup(group).agg(F.count("*").alias("count"), F.coalesce(F.sum(F.abs(amount)), F.lit(0)).cast("bigint").alias("impact"), F.grouping_id().alias("level"))


def cross_verdicts(results: DataFrame, group: str, ok: str) -> DataFrame:
    """(group, cases, all_pass) of the results of every checker on every case."""
    return results.groupBy(group).agg(F.count("*").alias("cases"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("all_pass"))


def shard(rows: DataFrame, position: str, index: int, of: int) -> DataFrame:
    """The rows of shard `index` of `of` by position."""
    return rows.filter(F.pmod(F.col(position), F.lit(of)) == index)
