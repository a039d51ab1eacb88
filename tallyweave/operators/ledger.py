"""Reconciliation of transaction sources: balances, tie-out, multiset residue, one-to-one matching and sequential allocation.

Transactions have the columns id, date, amount (signed cents), memo, kind, party.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.text import memo_similarity, name_tokens, party_key, record_key
from tallyweave.operators.ordered import running_sum
from tallyweave.session import checkpointed

KEY = ("date", "amount", "memo", "party")
#: Batches in which amounts are matched one to one; all rows of an amount are in one of them.
PARTS = 1024
#: The commonest words of memos, of which attribute() asks whether a name begins with them.
COMMON_WORDS = 1000


def party_balances(rows: DataFrame) -> DataFrame:
    """(party, balance): cents by party; null and blank parties are 'unknown'."""
    party = F.coalesce(F.nullif(F.btrim("party"), F.lit("")), F.lit("unknown"))
    return rows.groupBy(party.alias("party")).agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("bigint").alias("balance"))


def negative_balances(balances: DataFrame, tolerance: int = 0, control: DataFrame | None = None) -> DataFrame:
    """Parties below minus the tolerance, but those in the one column `party` of `control`."""
    below = balances.filter(F.col("balance") < -tolerance)
    return below if control is None else below.join(control.select("party").distinct(), "party", "left_anti")


def tie_out_rows(rows: DataFrame, names: dict[str, str], tolerance: int = 0) -> DataFrame:
    """One row: the total of each source, the largest difference of any two and whether it is within the tolerance.

    `rows` has source and amount; `names` maps result columns to values of source. One pass over the rows; a source
    without rows has a total of 0.
    """
    totals = rows.agg(*(F.coalesce(F.sum(F.when(F.col("source") == v, F.col("amount"))), F.lit(0)).cast("bigint").alias(n) for n, v in names.items()))
    gap = F.greatest(*(F.col(n) for n in names)) - F.least(*(F.col(n) for n in names))
    return totals.select("*", gap.alias("gap"), (gap <= tolerance).alias("ties_out"))


def tie_out(sources: dict[str, DataFrame], tolerance: int = 0) -> DataFrame:
    """tie_out_rows() of sources that are tables of their own."""
    tagged = None
    for name, df in sources.items():
        part = df.select(F.lit(name).alias("source"), F.col("amount"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tie_out_rows(tagged, {n: n for n in sources}, tolerance)


def residue(own: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of `own` whose amounts are not cancelled one to one by equal amounts of `other`.

    Of rows of one amount the first by record key are cancelled. Amounts are counted before the join, so a hot amount
    joins one row.
    """
    counts = other.groupBy("amount").agg(F.count("*").alias("_other"))
    key = record_key(F.col("date"), F.col("amount"), F.col("memo"), F.col("party"))
    nth = F.row_number().over(Window.partitionBy("amount").orderBy(key, "id"))
    return own.withColumn("_nth", nth).join(counts, "amount", "left").filter(F.col("_nth") > F.coalesce("_other", F.lit(0))).select(*own.columns)


def _numbered(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(record_key(F.col("date"), F.col("amount"), F.col("memo"), F.col("party")), "id"))
    return df.select(F.col("id").alias(f"id_{tag}"), *(F.col(k) for k in keys), nth.alias("nth"))


def match_exact(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id_a, id_b, confidence): the n-th row of an amount and day with the n-th of the other side; confidence 1."""
    keys = ["amount", "date"]
    return _numbered(a, keys, "a").join(_numbered(b, keys, "b"), [*keys, "nth"]).select("id_a", "id_b", F.lit(1.0).alias("confidence"))


def _keyed_pairs(a: DataFrame, b: DataFrame, days: int, opposite: bool) -> DataFrame:
    """window_pairs() with the amount they share as `key`."""
    width = days + 1
    bucket = lambda c: F.floor(F.unix_date(c) / F.lit(width))
    x = a.select(F.col("id").alias("id_a"), F.col("amount").alias("key"), F.col("date").alias("da"), F.col("memo").alias("ma"), bucket(F.col("date")).alias("bucket"))
    sign = -1 if opposite else 1
    y = b.select(F.col("id").alias("id_b"), (F.col("amount") * sign).alias("key"), F.col("date").alias("db"), F.col("memo").alias("mb"), F.explode(F.array(*(bucket(F.col("date")) + k for k in (-1, 0, 1)))).alias("bucket"))
    gap = F.abs(F.datediff("da", "db"))
    return x.join(y, ["key", "bucket"]).filter(gap <= days).select("key", "id_a", "id_b", gap.alias("gap"), memo_similarity(F.col("ma"), F.col("mb")).alias("score"))


def window_pairs(a: DataFrame, b: DataFrame, days: int, opposite: bool = False) -> DataFrame:
    """(id_a, id_b, gap, score) of rows with equal (or opposite) amounts at most `days` apart; score is the memos' similarity.

    An interval join made an equi-join: days are cut into buckets and the right side is repeated for the neighbouring ones.
    """
    return _keyed_pairs(a, b, days, opposite).select("id_a", "id_b", "gap", "score")


def _classed(df: DataFrame, *also: str) -> DataFrame:
    """`df` with `rep`, the least id of the rows of equal amount, date and memo; rows without id can't be paired and are left out."""
    return df.filter("id is not null").withColumn("rep", F.min("id").over(Window.partitionBy("amount", "date", "memo", *also)))


def _take(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """The greedy choice among `pairs` of classes whose members are `rows`: by gap, score and ids, until no pair is left."""
    out: list[tuple] = []
    if len(pairs) and len(rows):
        ids = {side: {rep: sorted(x) for rep, x in some.groupby("rep")["id"]} for side, some in rows.groupby("side")}
        a, b = ids["a"], ids["b"]
        at_a, at_b = dict.fromkeys(a, 0), dict.fromkeys(b, 0)
        for (gap, less), level in pairs.assign(less=-pairs["score"]).groupby(["gap", "less"], sort=True):
            # Members of a class can't be told apart but by id, so what is left of a class is always its end.
            near: dict = {}
            for x, y in zip(level["id_a"].tolist(), level["id_b"].tolist()):
                if at_a[x] < len(a[x]) and at_b[y] < len(b[y]):
                    near.setdefault(x, []).append(y)
            heap = [(a[x][at_a[x]], x) for x in near]
            heapq.heapify(heap)
            while heap:
                i, x = heap[0]
                near[x] = [y for y in near[x] if at_b[y] < len(b[y])]
                if not near[x]:
                    heapq.heappop(heap)
                    continue
                y = min(near[x], key=lambda y: b[y][at_b[y]])
                out.append((i, b[y][at_b[y]], gap, -less))
                at_a[x] += 1
                at_b[y] += 1
                if at_a[x] < len(a[x]):
                    heapq.heapreplace(heap, (a[x][at_a[x]], x))
                else:
                    heapq.heappop(heap)
    return pd.DataFrame(out, columns=["id_a", "id_b", "gap", "score"])


def _greedy(a: DataFrame, b: DataFrame, pairs: DataFrame, opposite: bool = False) -> DataFrame:
    """One-to-one (id_a, id_b, gap, score): the best pair by gap, score and ids, then the best of what is left, until none is left.

    `pairs` are those of classes (key, id_a, id_b, gap, score), `a` and `b` all rows with `rep`. Only rows of one key meet, so
    keys are served apart, many in one batch; equal rows are one class, so a hot amount makes no more pairs than its classes do.
    """
    part = lambda key: F.pmod(F.xxhash64(key.cast("bigint")), F.lit(PARTS)).alias("part")
    rows = a.select(part(F.col("amount")), F.lit("a").alias("side"), "rep", "id").unionByName(b.select(part(F.col("amount") * (-1 if opposite else 1)), F.lit("b").alias("side"), "rep", "id"))
    pairs = pairs.select(part(F.col("key")), "id_a", "id_b", "gap", "score")
    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in pairs.schema if x.name != "part")
    return rows.groupBy("part").cogroup(pairs.groupBy("part")).applyInPandas(_take, kinds)


def match_window(a: DataFrame, b: DataFrame, days: int = 3) -> DataFrame:
    """(id_a, id_b, confidence): equal amounts within `days`, nearest first. Confidence is the mean of closeness and memo similarity."""
    a, b = _classed(a), _classed(b)
    chosen = _greedy(a, b, _keyed_pairs(a.filter("id = rep"), b.filter("id = rep"), days, False))
    confidence = 0.5 * (1 - F.col("gap") / F.lit(days + 1)) + 0.5 * F.col("score")
    return chosen.select("id_a", "id_b", confidence.alias("confidence"))


def match_reversals(a: DataFrame, b: DataFrame, returned: Column, days: int = 3) -> DataFrame:
    """(id_a, id_b, confidence): equal and opposite amounts within `days` where a side is marked by the predicate `returned`; at most 0.95."""
    marked = lambda df: _classed(df.withColumn("_r", F.coalesce(returned, F.lit(False))), "_r")
    a, b = marked(a), marked(b)
    x, y = a.filter("id = rep"), b.filter("id = rep")
    pairs = _keyed_pairs(x.filter("_r"), y, days, True).unionByName(_keyed_pairs(x.filter("not _r"), y.filter("_r"), days, True))
    confidence = 0.5 * (1 - F.col("gap") / F.lit(days + 1)) + 0.5 * F.col("score")
    return _greedy(a, b, pairs, True).select("id_a", "id_b", F.least(F.lit(0.95), confidence).alias("confidence"))


def _split_pools(single: DataFrame, parts: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows of `single` per day of their window with `below`, the parts of that day and sign that are smaller, and the parts by rank.

    Candidates are counted before any are paired: in each day of the window, the parts below the amount are as many as
    precede it in the day's order by size. Single rows are repeated per day, never per part.
    """
    sign = F.signum("amount").cast("int")
    near = F.explode(F.sequence(F.date_sub("date", days), F.date_add("date", days)))
    x = single.select("id", "amount", sign.alias("sign"), near.alias("day"))
    y = parts.select(F.col("id").alias("part"), "amount", sign.alias("sign"), F.col("date").alias("day"))
    stacked = x.select("id", F.lit(None).cast(y.schema["part"].dataType).alias("part"), "amount", "sign", "day").unionByName(y.select(F.lit(None).cast(x.schema["id"].dataType).alias("id"), "part", "amount", "sign", "day"))
    by_size = Window.partitionBy("sign", "day").orderBy(F.abs("amount"), F.col("part").isNotNull(), "part")
    seen = stacked.withColumn("below", F.count("part").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    return seen.filter("id is not null and below > 0").select("id", "amount", "sign", "day", "below"), seen.filter("part is not null")


def splits_declined(single: DataFrame, parts: DataFrame, days: int = 3, most_candidates: int = 24) -> DataFrame:
    """(id, candidates) of the rows that match_splits() declines to search, having more than `most_candidates` candidates."""
    wanted, _ = _split_pools(single, parts, days)
    return wanted.groupBy("id").agg(F.sum("below").alias("candidates")).filter(F.col("candidates") > most_candidates)


def match_splits(single: DataFrame, parts: DataFrame, days: int = 3, most_parts: int = 3, most_candidates: int = 24) -> DataFrame:
    """(id, part_ids, confidence): a row of `single` that is the exact sum of 2 to `most_parts` rows of `parts` within `days`.

    The search declines where more than `most_candidates` rows could take part, rather than trying them all: that is the
    operator's contract, as the reference defines it; splits_declined() has those rows. Each part is used once: of rows whose
    first choices share a part the one with the least id keeps it, and the others choose again among the parts left free,
    until none of them finds a sum.
    """
    chosen = None
    while True:
        found = checkpointed(_split_choices(single, parts, days, most_parts, most_candidates))
        kept, lost = found.filter("ok"), found.filter("not ok")
        chosen = kept if chosen is None else chosen.unionByName(kept)
        if lost.isEmpty():
            return chosen.select("id", "part_ids", F.lit(0.99).alias("confidence"))
        single = single.join(lost.select("id"), "id", "left_semi")
        parts = parts.join(kept.select(F.explode("part_ids").alias("id")), "id", "left_anti")


def _split_choices(single: DataFrame, parts: DataFrame, days: int, most_parts: int, most_candidates: int) -> DataFrame:
    """(id, part_ids, ok): the first choice of each row that has one, and whether no row of smaller id wants a part of it."""
    wanted, seen = _split_pools(single, parts, days)
    few = wanted.groupBy("id").agg(F.sum("below").alias("n")).filter(F.col("n").between(2, most_candidates)).select("id")
    # At most `most_candidates` rows per single row meet their parts by rank.
    ranks = wanted.join(few, "id").select("id", "amount", "sign", "day", F.explode(F.sequence(F.lit(1).cast("bigint"), "below")).alias("below"))
    ranked = seen.select("part", F.col("amount").alias("pa"), "sign", "day", "below")
    pool = ranks.join(ranked, ["sign", "day", "below"]).select("id", "amount", "part", "pa")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        total = int(pdf["amount"].iloc[0])
        items = sorted(zip(pdf["part"].tolist(), pdf["pa"].tolist()))
        level: list[tuple[tuple[int, ...], int, int]] = [((), 0, 0)]
        for _ in range(most_parts):
            grown = []
            for ids, s, start in level:
                for k in range(start, len(items)):
                    part, v = items[k]
                    if s + v == total and len(ids) >= 1:
                        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "part_ids": [[*ids, part]]})
                    if abs(s + v) < abs(total):
                        grown.append(((*ids, part), s + v, k + 1))
            level = grown
        return pd.DataFrame({"id": pd.Series([], dtype=pdf["id"].dtype), "part_ids": pd.Series([], dtype=object)})

    kind = single.schema["id"].dataType.simpleString()
    found = pool.groupBy("id").applyInPandas(solve, f"id {kind}, part_ids array<{kind}>")
    wanted = found.select("id", "part_ids", F.explode("part_ids").alias("part")).withColumn("first", F.min("id").over(Window.partitionBy("part")))
    return wanted.groupBy("id").agg(F.first("part_ids").alias("part_ids"), F.bool_and(F.col("first") == F.col("id")).alias("ok"))


def match_all(a: DataFrame, b: DataFrame, returned: Column, days: int = 3, most_parts: int = 3, most_candidates: int = 24) -> dict[str, DataFrame]:
    """The four passes in order; each sees what the ones before left. Keys: matched (id_a, id_b, kind, confidence), splits,
    unmatched_a, unmatched_b. Every row of either side ends in exactly one of them. declined_a and declined_b (id, candidates)
    tell for which unmatched rows no split was searched."""
    drop = lambda df, used, tag: df.join(used.select(F.col(f"id_{tag}").alias("id")), "id", "left_anti")
    matched = None
    for kind, run in (("exact", match_exact), ("window", lambda x, y: match_window(x, y, days)), ("reversal", lambda x, y: match_reversals(x, y, returned, days))):
        found = checkpointed(run(a, b).withColumn("kind", F.lit(kind)))
        matched = found if matched is None else matched.unionByName(found)
        a, b = checkpointed(drop(a, found, "a")), checkpointed(drop(b, found, "b"))
    start_a, start_b = a, b
    one = checkpointed(match_splits(a, b, days, most_parts, most_candidates))
    a, b = drop(a, one.withColumnRenamed("id", "id_a"), "a"), drop(b, one.select(F.explode("part_ids").alias("id_b")), "b")
    two = checkpointed(match_splits(b, a, days, most_parts, most_candidates))
    whole_a, whole_b = splits_declined(start_a, start_b, days, most_candidates), splits_declined(b, a, days, most_candidates)
    b, a = drop(b, two.withColumnRenamed("id", "id_b"), "b"), drop(a, two.select(F.explode("part_ids").alias("id_a")), "a")
    splits = one.withColumn("single_side", F.lit("a")).unionByName(two.withColumn("single_side", F.lit("b")))
    return {"matched": matched, "splits": splits, "unmatched_a": a, "unmatched_b": b, "declined_a": whole_a.join(a.select("id"), "id", "left_semi"), "declined_b": whole_b.join(b.select("id"), "id", "left_semi")}


def attribute(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name): for each memo the longest name in it as a run of whole words, null if none.

    `texts` has id and memo, `names` the one column name. Longer means more words, then more letters, then the least name.
    Runs of as many words as some name has meet the best name of the same words: a run joins one row at most, however many
    names begin with a word. Runs are left out where they begin with a common word of the memos with which no name begins.
    """
    phrases = names.select("name", name_tokens(F.col("name")).alias("phrase"))
    sizes = phrases.agg(F.array_remove(F.collect_set(F.size("phrase")), 0).alias("sizes"))
    index = phrases.groupBy(F.array_join("phrase", " ").alias("run")).agg(F.min(F.struct((-F.length("name")).alias("l"), "name")).alias("named"))
    # Outer, as a filter for memos without words would go below a distinct of `texts` and have it made twice.
    words = texts.select("id", name_tokens(F.col("memo")).alias("words")).select("id", "words", F.posexplode_outer("words").alias("at", "word"))
    # Which words are common is an estimate; that no name begins with them is not, so no hit is lost. Used once: two estimates may differ.
    common = words.agg(F.expr(f"approx_top_k(word, {COMMON_WORDS})").alias("top")).select(F.explode("top.item").alias("word"))
    idle = common.join(phrases.select(F.get("phrase", F.lit(0)).alias("word")).distinct(), "word", "left_anti")
    places = words.join(F.broadcast(idle), "word", "left_anti").crossJoin(F.broadcast(sizes))
    fit = F.filter("sizes", lambda n: n <= F.size("words") - F.col("at"))
    runs = places.select("id", "words", "at", F.explode(fit).alias("w")).select("id", "w", F.array_join(F.slice("words", F.col("at") + 1, F.col("w")), " ").alias("run"))
    hits = runs.join(index, "run").select("id", F.struct((-F.col("w")).alias("w"), "named.l", "named.name").alias("hit"))
    every = texts.select("id", F.lit(True).alias("is_text")).unionByName(hits, allowMissingColumns=True)
    best = every.withColumn("best", F.min("hit").over(Window.partitionBy("id"))).filter("is_text")
    return best.select("id", F.when(F.col("id").isNotNull(), F.col("best.name")).alias("name"))


def allocate(needs: DataFrame, own: DataFrame, pool: int) -> DataFrame:
    """`needs` (id, party, date, amount, memo) with from_own, from_pool and uncovered.

    Each party's own coverage (party, cents) serves its needs in record order; what stays short draws in the same order on
    the common pool. Both are running sums: by party, and over all short rows by ranges of their order.
    """
    key = record_key(F.col("date"), F.col("amount"), F.col("memo"), F.col("party"))
    keyed = needs.withColumn("_party", party_key(F.col("party"))).withColumn("_key", key)
    cover = own.groupBy(party_key(F.col("party")).alias("_party")).agg(F.sum("cents").alias("_own"))
    x = keyed.join(cover, "_party", "left").withColumn("_own", F.coalesce("_own", F.lit(0)))
    before = F.coalesce(F.sum("amount").over(Window.partitionBy("_party").orderBy("_key", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("from_own", F.greatest(F.lit(0), F.least("amount", F.col("_own") - before)).cast("bigint")).withColumn("_short", F.col("amount") - F.col("from_own"))
    short = running_sum(x.filter("_short > 0").select("id", "_key", "_short"), "_short", "_key", "id")
    pooled = short.select("id", F.greatest(F.lit(0), F.least("_short", F.lit(pool) - F.col("before"))).cast("bigint").alias("from_pool"))
    out = x.join(pooled, "id", "left").withColumn("from_pool", F.coalesce("from_pool", F.lit(0)).cast("bigint"))
    return out.select(*needs.columns, "from_own", "from_pool", (F.col("_short") - F.col("from_pool")).alias("uncovered"))


def continuity(periods: DataFrame) -> DataFrame:
    """`periods` (key, period, opening, ending) with the gap of each opening to the ending of the period before; null for the first."""
    prior = F.lag("ending").over(Window.partitionBy("key").orderBy("period"))
    return periods.withColumn("gap", F.col("opening") - prior)
