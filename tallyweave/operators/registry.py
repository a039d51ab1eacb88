"""Append-only registry of keyed records: first writer wins, scans, scores, points and lineage.

Records have the columns content_hash, contributor, author_bound, timestamp, block_number, uri, parent, index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import checkpointed

ZERO = "0x" + "0" * 64
ADDRESS, HASH = "^0x[0-9a-f]{40}$", "^0x[0-9a-f]{64}$"


def address(text: Column) -> Column:
    """Lower-case address, null unless 0x and forty hexadecimal digits."""
    s = F.lower(F.btrim(text))
    return F.when(s.rlike(ADDRESS), s)


def content_hash(text: Column) -> Column:
    """Lower-case hash, null unless 0x and sixty-four hexadecimal digits."""
    s = F.lower(F.btrim(text))
    return F.when(s.rlike(HASH), s)


def is_root(parent: Column) -> Column:
    """True where a record has no predecessor."""
    return F.coalesce(parent, F.lit(ZERO)) == ZERO


def attribution(bound: Column) -> Column:
    return F.when(bound, "author-bound").otherwise("anchor-only")


def first_writers(attempts: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by `order`; ties are settled by the whole row's hash.

    Partial aggregation keeps one candidate per key and task, so a key that a third of the rows has costs no more than another.
    """
    by = F.struct(*(F.col(c) for c in order), F.xxhash64(*attempts.columns))
    return attempts.groupBy(key).agg(F.min_by(F.struct(*attempts.columns), by).alias("_row")).select("_row.*")


def append(existing: DataFrame, attempts: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows of `attempts` that get in: new keys only, the first of each."""
    return first_writers(attempts.join(existing.select(key), key, "left_anti"), key, *order)


def page(records: DataFrame, contributor: str | None = None, author_bound: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Records by index after the filters, from `offset` on; past the end there are none. The limit comes after the filters."""
    rows = records
    if contributor is not None:
        rows = rows.filter(F.lower("contributor") == contributor.lower())
    if author_bound:
        rows = rows.filter("author_bound")
    rows = rows.orderBy("index").offset(offset)
    return rows if limit is None else rows.limit(limit)


def contributor_page(records: DataFrame, start: int, count: int) -> DataFrame:
    """The records `start` to `start + count - 1` of each contributor, by index."""
    nth = F.row_number().over(Window.partitionBy(F.lower("contributor")).orderBy("index"))
    return records.withColumn("nth", nth - 1).filter(F.col("nth").between(start, start + count - 1))


def scores(records: DataFrame) -> DataFrame:
    """Per contributor: counts by attribution and by place in the lineage, and the first and last block with their timestamps.

    Of equal blocks the record of least index counts, at either end.
    """
    point = F.struct("block_number", "index")
    late = F.struct("block_number", -F.col("index"))
    return records.groupBy(F.lower("contributor").alias("contributor")).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("author_bound")).alias("author_bound"),
        F.count_if(~F.col("author_bound")).alias("anchor_only"),
        F.count_if(is_root(F.col("parent"))).alias("lineage_roots"),
        F.count_if(~is_root(F.col("parent"))).alias("revisions"),
        F.min("block_number").alias("first_block"),
        F.min_by("timestamp", point).alias("first_timestamp"),
        F.max("block_number").alias("last_block"),
        F.max_by("timestamp", late).alias("last_timestamp"),
    )


def graded(records: DataFrame) -> DataFrame:
    """Records with `outcome`: invalid, anchor_only, duplicate or credited. Per hash the first author-bound record is credited."""
    x = records.withColumns({"_h": content_hash(F.col("content_hash")), "_a": address(F.col("contributor"))})
    sound = F.col("_h").isNotNull() & F.col("_a").isNotNull()
    bound = sound & F.coalesce("author_bound", F.lit(False))
    firsts = x.filter(bound).groupBy("_h").agg(F.min("index").alias("_first"))
    x = x.join(firsts, "_h", "left")
    outcome = F.when(~sound, "invalid").when(~bound, "anchor_only").when(F.col("index") == F.col("_first"), "credited").otherwise("duplicate")
    return x.withColumn("outcome", outcome).withColumn("contributor", F.coalesce("_a", "contributor")).drop("_h", "_a", "_first")


def points(records: DataFrame) -> DataFrame:
    """(contributor, points): one point per content hash, to the first author-bound record of it."""
    return graded(records).filter("outcome = 'credited'").groupBy("contributor").agg(F.count("*").alias("points"))


def at_least(records: DataFrame, n: int) -> DataFrame:
    """Contributors with `n` points or more."""
    return points(records).filter(F.col("points") >= n)


def lineage(records: DataFrame, starts: DataFrame, most: int = 256) -> DataFrame:
    """(start, depth, content_hash, parent, capped) of each start's ancestors, itself at depth 0, up to a root or `most` records.

    Pointer doubling: round k knows each record's ancestor 2^k steps up and doubles the depth of every walk, so walks of
    depth d cost log2(d) rounds of equi-joins whatever the number of starts. A hash met before on a walk ends it. Unknown
    starts give no rows; of records with equal hashes the one with the least index counts.
    """
    named = records.select(F.lower("content_hash").alias("content_hash"), F.lower(F.coalesce("parent", F.lit(ZERO))).alias("parent"), "index")
    edges = checkpointed(named.groupBy("content_hash").agg(F.min_by("parent", F.struct("index", "parent")).alias("parent")))
    jump = edges.filter(F.col("parent") != ZERO).join(edges.select(F.col("content_hash").alias("parent")), "parent").select(F.col("content_hash").alias("node"), F.col("parent").alias("up"))
    walk = starts.select(F.lower("start").alias("start")).distinct().join(edges.select(F.col("content_hash").alias("start")), "start").select("start", F.lit(0).alias("depth"), F.col("start").alias("node"))
    reach = 1
    while reach < most:
        jump = checkpointed(jump)
        longer = walk.join(jump, "node").select("start", (F.col("depth") + reach).alias("depth"), F.col("up").alias("node")).filter(F.col("depth") < most)
        longer = checkpointed(longer)
        if longer.isEmpty():
            break
        walk = walk.unionByName(longer)
        jump = jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("_top")), "up").select("node", F.col("_top").alias("up"))
        reach *= 2
    met = F.row_number().over(Window.partitionBy("start", "node").orderBy("depth"))
    again = walk.withColumn("_met", met)
    ends = again.filter("_met > 1").groupBy("start").agg(F.min("depth").alias("_end"))
    kept = again.join(ends, "start", "left").filter((F.col("_met") == 1) & (F.col("depth") < F.coalesce("_end", F.lit(most))))
    out = kept.join(edges.withColumnRenamed("content_hash", "node"), "node").select("start", "depth", F.col("node").alias("content_hash"), "parent")
    return out.withColumn("capped", (F.col("depth") == most - 1) & (F.col("parent") != ZERO))


def lineage_sql(view: str, starts: str, most: int = 100) -> str:
    """The same walk as one recursive query over the views `view` (content_hash, parent) and `starts` (start), for depths up to
    the session's spark.sql.cteRecursionLevelLimit. It has no guard against cycles, which a sound registry can't have."""
    return f"""
        WITH RECURSIVE walk(start, depth, content_hash, parent) AS (
          SELECT s.start, 0, r.content_hash, r.parent FROM {starts} s JOIN {view} r ON r.content_hash = s.start
          UNION ALL
          SELECT w.start, w.depth + 1, r.content_hash, r.parent FROM walk w JOIN {view} r ON r.content_hash = w.parent WHERE w.depth + 1 < {most}
        ) SELECT * FROM walk"""


def reveals(commits: DataFrame, openings: DataFrame, delay: int) -> DataFrame:
    """Openings that match a commitment made at least `delay` blocks before: equal sha256 of content, committer and salt."""
    key = F.sha2(F.concat_ws("|", "content_hash", F.lower("committer"), "salt"), 256)
    c = commits.groupBy("commitment").agg(F.min("block_number").alias("commit_block"))
    return openings.withColumn("commitment", key).join(c, "commitment").filter(F.col("block_number") >= F.col("commit_block") + delay)


def json_rows(records: DataFrame) -> DataFrame:
    """(index, document): each record as a JSON object in the registry's member names; a root has no parent member."""
    return records.select("index", F.to_json(F.struct(
        F.lower("content_hash").alias("contentHash"), F.lower("contributor").alias("contributor"), F.col("author_bound").alias("authorBound"), "timestamp", F.col("block_number").alias("blockNumber"), F.lower("parent").alias("parent"), "index",
    )).alias("document"))


def at_position(records: DataFrame, position: int) -> DataFrame:
    """The record at a position; none beyond the end, which is no error."""
    return records.filter(F.col("index") == position)
