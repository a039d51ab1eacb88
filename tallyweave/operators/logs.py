"""Ordered logs: hash chains, contiguous sequences, validation and redaction of events, coverage of commits, as-of revocation."""

from __future__ import annotations

import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

GENESIS = "0" * 64
# Types of session events, and why an event is refused, in the order in which it is asked.
EVENT_TYPES = ("prompt", "completion", "tool_call", "tool_result", "note")
# Statuses of a commit, best first.
STATUSES = ("covered-verified", "covered-oid-only", "claim-root-mismatch", "claim-unverified-packet", "uncovered")


def canonical_json(value: Any, depth: int = 0, budget: list[int] | None = None, most_depth: int = 32, most_nodes: int = 100_000) -> str | None:
    """JSON with sorted keys and no white space; null for numbers without a JSON form and beyond the depth or node budget."""
    budget = budget if budget is not None else [0]
    budget[0] += 1
    if depth > most_depth or budget[0] > most_nodes:
        return None
    if isinstance(value, float):
        if not math.isfinite(value):
            return None
        return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
    if value is None or isinstance(value, (bool, int, str)):
        return json.dumps(value, ensure_ascii=False)
    deeper = lambda v: canonical_json(v, depth + 1, budget, most_depth, most_nodes)
    if isinstance(value, list):
        parts = [deeper(v) for v in value]
        return None if None in parts else "[" + ",".join(parts) + "]"
    # Keys compare by UTF-16 units.
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    parts = [(json.dumps(k, ensure_ascii=False), deeper(value[k])) for k in keys]
    return None if any(v is None for _, v in parts) else "{" + ",".join(f"{k}:{v}" for k, v in parts) + "}"


def strict_json(text: str, most_depth: int = 64) -> Any:
    """The value of a JSON text; ValueError for repeated keys, NaN, infinities and deeper nesting than `most_depth`."""

    def pairs(items: list[tuple[str, Any]]) -> dict:
        out = dict(items)
        if len(out) < len(items):
            raise ValueError("a key stands twice")
        return out

    def refuse(name: str) -> None:
        raise ValueError(name)

    def depth(v: Any) -> int:
        stack, most = [(v, 1)], 0
        while stack:
            x, d = stack.pop()
            most = max(most, d)
            if isinstance(x, (dict, list)):
                stack += [(y, d + 1) for y in (x.values() if isinstance(x, dict) else x)]
        return most

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    if depth(value) > most_depth:
        raise ValueError("nested too deeply")
    return value


@F.pandas_udf(StringType())
def canonical(texts: pd.Series) -> pd.Series:
    """Canonical form of JSON texts; null for null, malformed and refused ones."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical_json(strict_json(t))
        except ValueError:
            return None

    return texts.map(one)


def entry_hash(journal: Column, seq: Column, prev: Column, body: Column) -> Column:
    """Hash of a journal entry over its journal, number, predecessor's hash and canonical body."""
    return F.sha2(F.concat_ws("\n", journal.cast("string"), seq.cast("string"), prev, F.coalesce(body, F.lit("null"))), 256)


def chain_breaks(entries: DataFrame) -> DataFrame:
    """(journal, broken_at, reason): the first break of each journal that has one.

    `entries` has journal, seq, prev_hash, body and entry_hash. Entries are looked at by number (equal numbers by hash). At
    the first place where the number isn't the position, the predecessor's hash doesn't fit, or the own hash doesn't
    follow from the fields, the journal is broken. A whole journal is one ordered log, so its window is one group.
    """
    w = Window.partitionBy("journal").orderBy("seq", "entry_hash")
    x = entries.withColumns({"_at": F.row_number().over(w) - 1, "_before": F.coalesce(F.lag("entry_hash").over(w), F.lit(GENESIS))})
    reason = (
        F.when(F.col("seq").isNull() | (F.col("seq") != F.col("_at")), "seq")
        .when(~F.col("prev_hash").eqNullSafe(F.col("_before")), "prev_hash")
        .when(~F.col("entry_hash").eqNullSafe(entry_hash(F.col("journal"), F.col("seq"), F.col("prev_hash"), F.col("body"))), "entry_hash")
    )
    bad = x.withColumn("reason", reason).filter("reason is not null")
    return bad.groupBy("journal").agg(F.min("_at").cast("int").alias("broken_at"), F.min_by("reason", "_at").alias("reason"))


def first_gaps(events: DataFrame, group: str, seq: str) -> DataFrame:
    """(group, index, seq): the first event whose number is not its position from 0, of each group that has one."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(seq)) - 1
    bad = events.withColumn("_at", nth).filter(~F.col(seq).eqNullSafe(F.col("_at")))
    return bad.groupBy(group).agg(F.min("_at").cast("int").alias("index"), F.min_by(seq, "_at").alias("seq"))


def event_reason(has_payload: Column, has_hash: Column) -> Column:
    """Why an event row (seq, ts, actor, type, payload, payload_hash, redacted) is refused: the first reason that holds, else null."""
    seq, redacted = F.col("seq"), F.coalesce("redacted", F.lit(False))
    hex_ok = F.col("payload_hash").rlike("^(?:0x)?[0-9a-fA-F]{64}$")
    own = F.sha2(F.col("payload").cast("binary"), 256)
    reasons = (
        (seq.isNull() | (seq < 0), "EVENT_BAD_SEQ"),
        (F.col("ts").isNull(), "EVENT_BAD_TS"),
        (F.coalesce("actor", F.lit("")) == "", "EVENT_BAD_ACTOR"),
        (~F.coalesce("type", F.lit("")).isin(*EVENT_TYPES), "EVENT_BAD_TYPE"),
        (has_hash & ~F.coalesce(hex_ok, F.lit(False)), "EVENT_BAD_PAYLOAD_HASH"),
        (~has_payload & ~has_hash, "EVENT_MISSING_PAYLOAD"),
        (redacted & has_payload, "EVENT_REDACTED_WITH_PAYLOAD"),
        (redacted & ~has_hash, "EVENT_BAD_PAYLOAD_HASH"),
        (~redacted & ~has_payload, "EVENT_UNFLAGGED_REDACTION"),
        (has_payload & has_hash & (own != F.lower(F.regexp_replace("payload_hash", "^0x", ""))), "EVENT_PAYLOAD_HASH_MISMATCH"),
    )
    return F.coalesce(*(F.when(fires, name) for fires, name in reasons))


def validated(events: DataFrame) -> DataFrame:
    """`events` with the column reason; null for a sound event."""
    return events.withColumn("reason", event_reason(F.col("payload").isNotNull(), F.col("payload_hash").isNotNull()))


def redacted(events: DataFrame) -> DataFrame:
    """Events without payload but with its commitment and the flag; applying it twice changes nothing."""
    kept = F.coalesce(F.lower(F.regexp_replace("payload_hash", "^0x", "")), F.sha2(F.col("payload").cast("binary"), 256))
    return events.withColumn("payload_hash", kept).withColumn("payload", F.lit(None).cast("string")).withColumn("redacted", F.lit(True))


def event_leaf() -> Column:
    """Leaf of an event, over its fields and its payload's commitment, so that an event and its redacted twin have the same."""
    own = F.coalesce(F.lower(F.regexp_replace("payload_hash", "^0x", "")), F.sha2(F.col("payload").cast("binary"), 256))
    return F.unhex(F.sha2(F.concat_ws("\n", F.col("seq").cast("string"), "ts", "actor", "type", own), 256))


def claim_status(packet_verified: Column, root_verified: Column) -> Column:
    """Verdict of one claim; an unverified packet outweighs everything."""
    return F.when(~F.coalesce(packet_verified, F.lit(False)), STATUSES[3]).when(root_verified, STATUSES[0]).when(root_verified.isNull(), STATUSES[1]).otherwise(STATUSES[2])


def coverage(commits: DataFrame, claims: DataFrame) -> DataFrame:
    """(oid, position, status, claims): the best status of each commit's claims, 'uncovered' without any.

    Claims are ranked and counted by oid before the join, so an oid with many claims joins one row.
    """
    rank = F.create_map(*(F.lit(x) for k, s in enumerate(STATUSES) for x in (s, k)))
    ranked = claims.select("oid", rank[claim_status(F.col("packet_verified"), F.col("root_verified"))].alias("rank"))
    best = ranked.groupBy("oid").agg(F.min("rank").alias("rank"), F.count("*").alias("claims"))
    names = F.array(*(F.lit(s) for s in STATUSES))
    x = commits.select("oid", "position").join(best, "oid", "left")
    return x.select("oid", "position", F.get(names, F.coalesce("rank", F.lit(len(STATUSES) - 1))).alias("status"), F.coalesce("claims", F.lit(0)).cast("bigint").alias("claims"))


def coverage_failures(covered: DataFrame, require_all: bool = False, since: str | None = None) -> DataFrame:
    """(oid, rule, status) of commits that the policy needs covered and that aren't; `since` counts from that commit's position on."""
    bad = covered.filter(~F.col("status").isin(*STATUSES[:2]))
    if require_all:
        return bad.select("oid", F.lit("require-all").alias("rule"), "status")
    if since is None:
        return bad.select("oid", F.lit("").alias("rule"), "status").limit(0)
    start = covered.filter(F.col("oid") == since).agg(F.min("position").alias("_start"))  # one row
    return bad.crossJoin(F.broadcast(start)).filter(F.col("position") >= F.col("_start")).select("oid", F.lit("require-since").alias("rule"), "status")


def coverage_summary(covered: DataFrame) -> DataFrame:
    """One row of counts by status and the share covered in whole percent, rounded down; no commits are 100."""
    counts = [F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in STATUSES]
    x = covered.agg(F.count("*").alias("commits"), *counts)
    good = F.col("covered_verified") + F.col("covered_oid_only")
    return x.withColumn("percent", F.when(F.col("commits") == 0, 100).otherwise(F.floor(good * 100 / F.greatest("commits", F.lit(1)))).cast("bigint"))


def revoked_as_of(subjects: DataFrame, revocations: DataFrame) -> DataFrame:
    """`subjects` (subject, as_of) with status, governing_at, governing_reason and later.

    REVOKED if a revocation of the subject took effect at or before as_of; the earliest governs, ties by reason. `later`
    counts those that took effect after. UNEVALUABLE if the subject is no address. Revocations (vendor, revoked_at, reason)
    are packed by vendor before the join: one row a vendor.
    """
    key = F.lower("vendor").alias("_v")
    packed = revocations.filter("revoked_at is not null").groupBy(key).agg(F.array_sort(F.collect_set(F.struct("revoked_at", "reason"))).alias("_all"))
    x = subjects.join(packed, F.lower("subject") == F.col("_v"), "left")
    none = F.array().cast("array<struct<revoked_at:timestamp,reason:string>>")
    every = F.coalesce("_all", none)
    hit = F.get(F.filter(every, lambda r: r.revoked_at <= F.col("as_of")), F.lit(0))
    sound = F.lower("subject").rlike("^0x[0-9a-f]{40}$")
    status = F.when(hit.isNotNull(), "REVOKED").when(~F.coalesce(sound, F.lit(False)), "UNEVALUABLE").otherwise("OK")
    later = F.size(F.filter(every, lambda r: r.revoked_at > F.col("as_of")))
    return x.select(*(subjects[c] for c in subjects.columns), status.alias("status"), hit.revoked_at.alias("governing_at"), hit.reason.alias("governing_reason"), later.alias("later"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str) -> DataFrame:
    """`left` with the last row of `right` at or before its time, by key; null columns where there is none.

    Both sides are stacked and ordered by time once: one shuffle and no range join. Of equal times right rows come first;
    of equal right rows the greatest counts. Columns of `right` but the key get the prefix `right_`.
    """
    payload = F.struct(*(F.col(c).alias(f"right_{c}") for c in right.columns if c != key))
    r = right.select(F.col(key).alias("_k"), F.col(right_at).alias("_t"), F.lit(0).alias("_side"), payload.alias("_r"), F.lit(None).alias("_l"))
    left_row = F.struct(*left.columns)
    x = left.select(F.col(key).alias("_k"), F.col(left_at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).alias("_r"), left_row.alias("_l"))
    both = r.select("_k", "_t", "_side", "_r", F.lit(None).cast(x.schema["_l"].dataType).alias("_l")).unionByName(x.select("_k", "_t", "_side", F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), "_l"))
    w = Window.partitionBy("_k").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_r", F.last("_r", True).over(w)).filter("_side = 1").select("_l.*", "_r.*")
