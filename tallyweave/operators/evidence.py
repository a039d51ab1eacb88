"""Evidence of records: strict events and their leaves, commit claims, recorded drift, ordered exceptions, thresholds, signatures.

Names of domains, schemas and kinds are parameters: digests under different names differ.
"""

from __future__ import annotations

import hmac
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from tallyweave.functions.hashing import keccak256
from tallyweave.functions.text import record_key
from tallyweave.operators.ledger import residue
from tallyweave.operators.logs import EVENT_TYPES, canonical, canonical_json, chain_breaks, strict_json
from tallyweave.operators.merkle import log_heads, proof_folder
from tallyweave.operators.ordered import numbered
from tallyweave.session import checkpointed

# Members of an event, and the reasons for which one is refused.
EVENT_FIELDS = ("seq", "ts", "actor", "type", "payload", "payloadHash", "redacted", "meta")
REASONS = (
    "EVENT_NOT_OBJECT", "EVENT_UNKNOWN_FIELD", "EVENT_BAD_SEQ", "EVENT_BAD_TS", "EVENT_BAD_ACTOR", "EVENT_BAD_TYPE", "EVENT_BAD_PAYLOAD", "EVENT_BAD_PAYLOAD_HASH",
    "EVENT_BAD_REDACTED_FLAG", "EVENT_MISSING_PAYLOAD", "EVENT_REDACTED_WITH_PAYLOAD", "EVENT_UNFLAGGED_REDACTION", "EVENT_PAYLOAD_HASH_MISMATCH", "EVENT_BAD_META",
)
# Severities of exceptions, gravest first; others rank behind them. Ranks of findings by which a threshold is crossed.
EXCEPTION_SEVERITIES = ("error", "warning", "info")
THRESHOLDS = ("information", "warning", "fatal")


def _digest(data: Column, hash_name: str) -> Column:
    """0x and the lower-case hexadecimal digest of a text or binary column."""
    raw = data.cast("binary")
    return F.concat(F.lit("0x"), F.sha2(raw, 256) if hash_name == "sha256" else F.lower(F.hex(keccak256(raw))))


def strict_events(lines: DataFrame, text: str, hash_name: str = "keccak") -> DataFrame:
    """`lines` with the parsed members seq, ts, actor, type, payload, commitment, redacted, meta_json and `reason`, null for a sound event.

    `text` is one event as JSON. Reasons are asked in the order of REASONS but that a commitment's form is asked again of
    declared redactions; text that is no JSON object is EVENT_NOT_OBJECT. `commitment` is the payload's digest, or the one
    that a redacted event carries; `meta_json` is meta in canonical form.
    """
    m = F.from_json(F.col(text), "map<string,variant>")
    x = lines.withColumn("_m", m)
    at = lambda k: F.try_element_at("_m", F.lit(k))
    has = {k: F.coalesce(F.map_contains_key("_m", F.lit(k)), F.lit(False)) for k in EVENT_FIELDS}
    shape = lambda k: F.coalesce(F.schema_of_variant(at(k)), F.lit("VOID"))
    string = lambda k: F.when(shape(k) == "STRING", F.try_variant_get(at(k), "$", "string"))
    number = F.when(shape("seq").rlike("^(?:BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(at("seq"), "$", "double"))
    x = x.withColumns(
        {
            "_known": F.forall(F.map_keys("_m"), lambda k: k.isin(*EVENT_FIELDS)),
            "seq": F.when((number >= 0) & (number <= float((1 << 53) - 1)) & (number == F.floor(number)), number.cast("bigint")),
            **{k: string(k) for k in ("ts", "actor", "type", "payload")},
            "_carried": F.lower(string("payloadHash")),
            "redacted": F.when(shape("redacted") == "BOOLEAN", F.try_variant_get(at("redacted"), "$", "boolean")),
            "meta_json": F.when(has["meta"], canonical(F.coalesce(F.to_json(at("meta")), F.lit("null")))),
        }
    )
    x = x.withColumn("_own", F.when(F.col("payload").isNotNull(), _digest(F.col("payload"), hash_name)))
    sound_hash = F.coalesce(F.col("_carried").rlike("^0x[0-9a-f]{64}$"), F.lit(False))
    declared = F.coalesce("redacted", F.lit(False))
    asked = (
        (F.col("_m").isNull(), "EVENT_NOT_OBJECT"),
        (~F.col("_known"), "EVENT_UNKNOWN_FIELD"),
        (F.col("seq").isNull(), "EVENT_BAD_SEQ"),
        (F.col("ts").isNull(), "EVENT_BAD_TS"),
        (F.coalesce("actor", F.lit("")) == "", "EVENT_BAD_ACTOR"),
        (~F.coalesce("type", F.lit("")).isin(*EVENT_TYPES), "EVENT_BAD_TYPE"),
        (has["payload"] & F.col("payload").isNull(), "EVENT_BAD_PAYLOAD"),
        (has["payloadHash"] & ~sound_hash, "EVENT_BAD_PAYLOAD_HASH"),
        (has["redacted"] & F.col("redacted").isNull(), "EVENT_BAD_REDACTED_FLAG"),
        (~has["payload"] & ~has["payloadHash"], "EVENT_MISSING_PAYLOAD"),
        (declared & has["payload"], "EVENT_REDACTED_WITH_PAYLOAD"),
        (declared & ~has["payloadHash"], "EVENT_BAD_PAYLOAD_HASH"),
        (~declared & ~has["payload"], "EVENT_UNFLAGGED_REDACTION"),
        (has["payload"] & has["payloadHash"] & (F.col("_own") != F.col("_carried")), "EVENT_PAYLOAD_HASH_MISMATCH"),
        (has["meta"] & F.col("meta_json").isNull(), "EVENT_BAD_META"),
    )
    x = x.withColumns({"reason": F.coalesce(*(F.when(fires, name) for fires, name in asked)), "commitment": F.coalesce("_own", "_carried")})
    return x.drop("_m", "_known", "_carried", "_own")


@F.pandas_udf(StringType())
def _array_text(seq: pd.Series, ts: pd.Series, actor: pd.Series, kind: pd.Series, commitment: pd.Series, meta: pd.Series, domain: pd.Series) -> pd.Series:
    rows = zip(domain, seq, ts, actor, kind, commitment, meta)
    return pd.Series([json.dumps([d, int(s), t, a, k, c, m if isinstance(m, str) else None], ensure_ascii=False, separators=(",", ":")) if s == s and s is not None else None for d, s, t, a, k, c, m in rows], dtype=object)


def strict_leaf(domain: str, hash_name: str = "keccak") -> Column:
    """Leaf of a sound event of strict_events(): over the JSON array of domain, seq, ts, actor, type, commitment and meta as canonical text.

    An event and its redacted twin have the same leaf, any edit of a bound member another. Null for refused events.
    """
    text = _array_text("seq", "ts", "actor", "type", "commitment", "meta_json", F.lit(domain))
    return F.when(F.col("reason").isNull(), _digest(text, hash_name))


def canonical_entry_hash(schema: str, seq: Column, prev: Column, ts: Column, artifact: Column, verdict: Column, hash_name: str = "keccak") -> Column:
    """Hash of a journal entry over the canonical JSON of its members; artifact and verdict are JSON texts, null as null."""

    @F.pandas_udf(StringType())
    def body(s: pd.Series, p: pd.Series, t: pd.Series, a: pd.Series, v: pd.Series) -> pd.Series:
        read = lambda x: strict_json(x) if isinstance(x, str) else None
        return pd.Series([canonical_json({"schema": schema, "seq": int(n), "prevHash": h, "ts": w, "artifact": read(y), "verdict": read(z)}) for n, h, w, y, z in zip(s, p, t, a, v)], dtype=object)

    return _digest(body(seq, prev, ts, artifact, verdict), hash_name)


def claims(events: DataFrame, kind: str) -> DataFrame:
    """`events` (type, payload and others) that disclose a commit claim, with commit, git_root and scope.

    A claim is a note whose payload is the claim's canonical JSON and nothing else; other notes and withheld payloads are
    passed over.
    """
    form = r'^\{"commit":"([0-9a-f]{40})","gitRoot":"(0x[0-9a-f]{64})","kind":"' + kind.replace("\\", "\\\\") + r'"(?:,"scope":"((?:[^"\\\x00-\x1f\x7f]|\\")+)")?\}$'
    part = lambda k: F.regexp_extract("payload", form, k)
    return events.filter((F.col("type") == "note") & F.col("payload").rlike(form)).select("*", part(1).alias("commit"), part(2).alias("git_root"), F.nullif(part(3), F.lit("")).alias("scope"))


def claim_verdicts(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, verdict): claims against the facts that an auditor derived, `expected` (key, oid, root).

    'ok', 'oid-mismatch' (asked first), 'root-mismatch', or 'no-expected-facts' where there are none.
    """
    x = found.select(key, "commit", "git_root").join(expected.select(key, "oid", "root"), key, "left")
    verdict = F.when(F.col("oid").isNull(), "no-expected-facts").when(F.col("commit") != F.col("oid"), "oid-mismatch").when(~F.col("git_root").eqNullSafe(F.col("root")), "root-mismatch").otherwise("ok")
    return x.select(key, verdict.alias("verdict"))


def first_drift(entries: DataFrame, accepted: str = "ACCEPTED") -> DataFrame:
    """(journal, seq, verdict): the first entry of each intact journal whose recorded verdict is not `accepted`.

    The verdict is the member of that name of the body; a body without one is MALFORMED. Journals with a broken chain are
    left to chain_breaks().
    """
    verdict = F.coalesce(F.get_json_object("body", "$.verdict"), F.lit("MALFORMED"))
    bad = entries.withColumn("_v", verdict).filter(F.col("_v") != accepted).groupBy("journal").agg(F.min(F.struct("seq", "_v")).alias("first"))
    return bad.join(chain_breaks(entries).select("journal"), "journal", "left_anti").select("journal", F.col("first.seq").alias("seq"), F.col("first._v").alias("verdict"))


def ordered_exceptions(exceptions: DataFrame) -> DataFrame:
    """`exceptions` (severity, type, amount, date, memo, party) with `pos` from 0 in their total order: by severity, type, amount and record key.

    Nulls come first; unknown severities rank last. Positions come from counts by range, not from one task.
    """
    rank = F.coalesce(F.array_position(F.array(*(F.lit(s) for s in EXCEPTION_SEVERITIES)), F.col("severity")), F.lit(0))
    key = F.when(F.coalesce("date", "memo", "party", F.lit(None)).isNull(), "").otherwise(record_key(F.col("date"), F.col("amount"), F.col("memo"), F.col("party")))
    x = exceptions.withColumns({"_rank": F.when(rank == 0, len(EXCEPTION_SEVERITIES) + 1).otherwise(rank), "_key": key})
    return numbered(x, "_rank", "type", "amount", "_key").drop("_rank", "_key")


def unmatched(matched: DataFrame | None, own: DataFrame, other: DataFrame, side: str) -> DataFrame:
    """Rows of `own` that a matcher's pairs (id_a, id_b) leave over; without a matcher's result their residue against `other`."""
    if matched is None:
        return residue(own, other)
    return own.join(matched.select(F.col(f"id_{side}").alias("id")), "id", "left_anti")


def crosses(severity: Column, fail_on: str) -> Column:
    """Whether a finding's severity is at or above the threshold; unknown severities count as fatal."""
    ranks = F.create_map(*(F.lit(x) for k, s in enumerate(THRESHOLDS) for x in (s, k)))
    return F.coalesce(F.try_element_at(ranks, severity), F.lit(2)) >= THRESHOLDS.index(fail_on)


def gate(findings: DataFrame, fail_on: str = "fatal") -> DataFrame:
    """(source, crossing, fails): how many findings of each source cross the threshold, and whether any does."""
    x = findings.groupBy("source").agg(F.count_if(crosses(F.col("severity"), fail_on)).alias("crossing"))
    return x.withColumn("fails", F.col("crossing") > 0)


def first_failures(failures: DataFrame, order: str, k: int = 50) -> DataFrame:
    """The first `k` rows by `order` with `more`, how many follow them: a listing, not the result."""
    top = failures.orderBy(order).limit(k)
    total = failures.agg(F.greatest(F.count("*") - k, F.lit(0)).alias("more"))  # one row
    return top.crossJoin(F.broadcast(total))


def sealed_leaves(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(role, path, content_hash): the inputs and outputs of a run as one list, of which a seal's root is made."""
    of = lambda df, role: df.select(F.lit(role).alias("role"), "path", "content_hash")
    return of(inputs, "input").unionByName(of(outputs, "output"))


def sessions_hold(packets: DataFrame, events: DataFrame, hash_name: str = "keccak") -> DataFrame:
    """(session, status): packets (session, size, root) against heads recomputed from events (session, seq, leaf): ok, changed or missing."""
    heads = log_heads(events, "session", "seq", "leaf", hash_name).select("session", F.col("size").alias("_size"), F.col("root").alias("_root"))
    same = (F.col("_size") == F.col("size")) & (F.col("_root") == F.lower(F.regexp_replace("root", "^0x", "")))
    return packets.join(heads, "session", "left").select("session", F.when(F.col("_root").isNull(), "missing").when(same, "ok").otherwise("changed").alias("status"))


def resolved_messages(findings: DataFrame, catalogue: DataFrame, language: str) -> DataFrame:
    """Findings with `shown`: the catalogue's text (rule, language, text) of the rule in the language, else the finding's own message."""
    texts = catalogue.filter(F.col("language") == language).groupBy("rule").agg(F.min("text").alias("_text"))
    return findings.join(texts, "rule", "left").select(*findings.columns, F.coalesce(F.nullif("_text", F.lit("")), "message").alias("shown"))


def xs_date(text: Column) -> Column:
    """The day of an xs:date: yyyy-mm-dd, a zone (Z or an offset) allowed behind it; null for other texts and unreal days."""
    day = F.regexp_extract(F.btrim(text), r"^(\d{4}-\d{2}-\d{2})(?:Z|[+-]\d{2}:\d{2})?$", 1)
    return F.try_to_date(F.nullif(day, F.lit("")), "yyyy-MM-dd")


def ends_before_start(start: Column, end: Column) -> Column:
    """Whether a period of xs:dates ends before it starts; false where either is missing or unreadable."""
    return F.coalesce(xs_date(end) < xs_date(start), F.lit(False))


def signed_with(secret: bytes, hash_name: str = "sha256") -> object:
    """The column function (body, signature) → whether the hexadecimal HMAC of the body is the signature; false for nulls."""

    @F.pandas_udf(BooleanType())
    def holds(body: pd.Series, signature: pd.Series) -> pd.Series:
        def one(b: object, s: object) -> bool:
            return isinstance(b, str) and isinstance(s, str) and hmac.compare_digest(hmac.new(secret, b.encode(), hash_name).hexdigest(), s.lower().removeprefix("0x"))

        return pd.Series([one(b, s) for b, s in zip(body, signature)])

    return holds


def minted(batches: DataFrame, known: DataFrame) -> DataFrame:
    """(batch, content_hash): the hashes of batches that can be credited as a whole, batches taken in order of their number.

    A batch with a hash that is null, stands twice in it, is in `known` or was credited to an earlier batch fails as a whole
    and credits nothing, so it blocks no later one. Each round decides all batches that are the first undecided ones to hold
    each of their hashes, and those that share a hash with them; rounds go on until none is undecided.
    """
    x = batches.select("batch", F.lower("content_hash").alias("content_hash"))
    seen = known.select(F.lower("content_hash").alias("content_hash")).distinct().withColumn("_known", F.lit(True))
    per = x.join(seen, "content_hash", "left").groupBy("batch", "content_hash").agg(F.count("*").alias("_n"), F.bool_or(F.coalesce("_known", F.lit(False))).alias("_known"))
    sound = per.groupBy("batch").agg(F.bool_and((F.col("_n") == 1) & ~F.col("_known") & F.col("content_hash").isNotNull()).alias("_ok")).filter("_ok").select("batch")
    open_ = checkpointed(per.join(sound, "batch", "left_semi").select("batch", "content_hash"))
    credited = open_.limit(0)
    while not open_.isEmpty():
        first = open_.withColumn("_first", F.min("batch").over(Window.partitionBy("content_hash")))
        winners = first.groupBy("batch").agg(F.bool_and(F.col("_first") == F.col("batch")).alias("_ok")).filter("_ok").select("batch")
        now = checkpointed(open_.join(winners, "batch", "left_semi"))
        credited = checkpointed(credited.unionByName(now))
        lost = open_.join(now.select("content_hash").distinct(), "content_hash", "left_semi").select("batch").distinct()
        open_ = checkpointed(open_.join(lost, "batch", "left_anti"))
    return credited


def in_currency(items: str, member: str, currency: Column) -> Column:
    """Items of an array of structs whose member is the document's currency."""
    return F.filter(F.col(items), lambda e: F.coalesce(e[member] == currency, F.lit(False)))


def label(party: Column, nobody: str = "(no name)") -> Column:
    """A party's name trimmed, or `nobody` for null and blank ones."""
    return F.coalesce(F.nullif(F.btrim(party), F.lit("")), F.lit(nobody))


def first_per(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by `order`, then by all its columns: a partial aggregate, so a hot key is not one task's."""
    others = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.min(F.struct(*order, *others)).alias("_r")).select(*(F.col(key) if c == key else F.col("_r")[c].alias(c) for c in rows.columns))


def inputs_digest(parts: DataFrame) -> DataFrame:
    """One row (digest): SHA-256 over the names and digests of a close's inputs (name, digest), in order of names. A few rows by construction."""
    line = F.concat_ws(":", "name", F.lower("digest"))
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


def artifact_digest(kind: Column, members: dict[str, Column], hash_name: str = "sha256") -> Column:
    """The digest of the member that an artifact's kind is known by; null for unknown kinds."""
    return F.coalesce(*(F.when(kind == k, _digest(c, hash_name)) for k, c in members.items()))


def bundles_hold(bundles: DataFrame, expected_root: str | None = None, hash_name: str = "keccak") -> DataFrame:
    """`bundles` (digest, proof, root) with `status`: ok, 'root-mismatch' where the proof leads elsewhere, 'unexpected-root' where
    the root is not the one expected, 'malformed' where a member is missing."""
    got = F.lower(F.hex(proof_folder(hash_name)(F.coalesce("digest", F.lit(b"")), F.coalesce("proof", F.array().cast("array<binary>")))))
    plain = lambda c: F.lower(F.regexp_replace(c, "^0x", ""))
    missing = F.col("digest").isNull() | F.col("proof").isNull() | F.col("root").isNull()
    status = F.when(missing, "malformed").when(got != plain(F.col("root")), "root-mismatch")
    if expected_root is not None:
        status = status.when(plain(F.col("root")) != plain(F.lit(expected_root)), "unexpected-root")
    return bundles.withColumn("status", status.otherwise("ok"))
