"""Fixed-capacity containers filled with items of varying length.

Linear grouping: items longer than an eighth of the capacity are sorted by length and cut into groups of equal count;
each length is rounded up to its group's greatest. The few rounded lengths are packed by optimal configurations
(column generation over a linear program). Actual items then take the places of rounded ones, and short items go best-fit
into what is left. All of this is interval arithmetic on counts by length, of which there are at most as many as the
capacity, so the driver's work is bounded whatever the number of items; the items themselves meet their container by
their rank among the items of their length, computed in salted windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import checkpointed

CAPACITY = 2048
#: Groups of equal count among the long items.
GROUPS = 24
#: Parts into which the items of one length are ranked, so that a length that a third of all items have is spread.
SALTS = 64

#: (length, first rank, end rank, items a container takes, first container)
Segment = tuple[int, int, int, int, int]


def configurations(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each is used, as fractions) of a least-container packing of rounded items.

    Column generation: the simplex basis starts with one pattern per length; a knapsack over the dual prices brings in
    patterns until none pays.
    """
    k = len(lengths)
    basis = np.diag(capacity // lengths).astype(float)
    for _ in range(40 * k + 40):
        inverse = np.linalg.inv(basis)
        use = inverse @ demand
        prices = inverse.sum(axis=0)  # each pattern costs one container
        worth, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            worth[c] = worth[c - 1]
            fit = np.flatnonzero(lengths <= c)
            if len(fit):
                gain = worth[c - lengths[fit]] + prices[fit]
                best = int(gain.argmax())
                if gain[best] > worth[c] + 1e-12:
                    worth[c], took[c] = gain[best], fit[best]
        if worth[capacity] <= 1 + 1e-9:
            break
        pattern, c = np.zeros(k), capacity
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                pattern[took[c]] += 1
                c -= int(lengths[took[c]])
        change = inverse @ pattern
        ratio = np.where(change > 1e-9, use / np.maximum(change, 1e-9), np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[:, int(ratio.argmin())] = pattern
    return basis, np.maximum(np.linalg.inv(basis) @ demand, 0)


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[Segment], int]:
    """Where the items of each length go, and the number of containers. `counts`: items by length, 1 to capacity.

    Item r of length s (r counts from 0) goes into container first + (r - low) // per of the segment of s that holds r.
    Where few items are long, rounding them up may cost more than configurations save: then best-fit alone, over all
    lengths, takes fewer containers and is used.
    """
    return min((_plan(counts, capacity, groups, limit) for limit in (capacity // 8, capacity)), key=lambda p: p[1])


def _plan(counts: dict[int, int], capacity: int, groups: int, limit: int) -> tuple[list[Segment], int]:
    """plan() with the lengths above `limit` placed by linear grouping, the others best-fit, longest first."""
    segments: list[Segment] = []
    containers = 0
    free: dict[int, list[tuple[int, int]]] = {}  # space left → ranges of containers

    def leave(space: int, low: int, high: int) -> None:
        if high > low and space > 0:
            free.setdefault(space, []).append((low, high))

    if full := counts.get(capacity, 0):
        segments.append((capacity, 0, full, 1, 0))
        containers = full
    long = sorted((s for s, n in counts.items() if limit < s < capacity and n), reverse=True)
    total = sum(counts[s] for s in long)
    # Runs of the long items, longest first, cut at the borders of the groups: (length, first rank, count). Lengths that
    # are no more than the groups need no rounding: each is a group of its own.
    each = max(1, -(-total // groups))
    runs: list[list[list[int]]] = []
    room = 0
    for s in long:
        at, n = 0, counts[s]
        while n:
            if not room:
                runs.append([])
                room = n if len(long) <= groups else each
            take = min(room, n)
            runs[-1].append([s, at, take])
            at, n, room = at + take, n - take, room - take
    if runs:
        rounded = np.array([r[0][0] for r in runs])
        lengths, first = np.unique(rounded, return_index=True)
        member = [[k for k, s in enumerate(rounded) if s == x] for x in lengths]
        queues = [[run for k in ks for run in runs[k]] for ks in member]
        left = np.array([sum(r[2] for r in q) for q in queues])
        basis, use = configurations(lengths, left.astype(float), capacity)
        todo = [(basis[:, j].astype(int), int(use[j] + 1e-9)) for j in range(basis.shape[1])]

        def place(pattern: np.ndarray, times: int) -> None:
            """`times` containers of a pattern, filled with actual items from the queues, in runs of equal content."""
            nonlocal containers
            while times > 0:
                # So many containers take the same lengths from the heads of the queues; a container across a border is single.
                same, heads = times, []
                for g in np.flatnonzero(pattern):
                    a, q = int(pattern[g]), queues[g]
                    heads.append((g, a))
                    same = min(same, max(1, q[0][2] // a))
                space = capacity
                for g, a in heads:
                    need = a * same
                    q = queues[g]
                    if q[0][2] >= need:
                        s, at, _ = q[0]
                        segments.append((s, at, at + need, a, containers))
                        space -= s * a
                        q[0][1] += need
                        q[0][2] -= need
                        if not q[0][2]:
                            q.pop(0)
                    else:  # same == 1: gather item by item
                        while need:
                            s, at, n = q[0]
                            take = min(n, need)
                            segments.append((s, at, at + take, take, containers))
                            space -= s * take
                            q[0][1] += take
                            q[0][2] -= take
                            if not q[0][2]:
                                q.pop(0)
                            need -= take
                    left[g] -= a * same
                leave(space, containers, containers + same)
                containers += same
                times -= same

        for pattern, times in todo:
            wanted = np.flatnonzero(pattern)
            if len(wanted):
                place(pattern, min(times, *(int(left[g] // pattern[g]) for g in wanted)))
        # What the whole numbers leave over: patterns filled greedily, longest first.
        while left.any():
            pattern, space = np.zeros(len(lengths), int), capacity
            for g in range(len(lengths) - 1, -1, -1):
                a = min(int(left[g]), space // int(lengths[g]))
                pattern[g] = a
                space -= a * int(lengths[g])
            place(pattern, min(int(left[g] // pattern[g]) for g in np.flatnonzero(pattern)))
    for s in sorted((s for s, n in counts.items() if 0 < s <= limit and s < capacity and n), reverse=True):
        at, n = 0, counts[s]
        space = s
        while n:
            while space <= capacity and not free.get(space):
                space += 1
            if space > capacity:
                per = capacity // s
                fresh = -(-n // per)
                free.setdefault(capacity, []).append((containers, containers + fresh))
                containers += fresh
                space = capacity
            low, high = free[space].pop()
            per = min(space // s, n)
            m = min(high - low, n // per)
            segments.append((s, at, at + m * per, per, low))
            leave(space, low + m, high)
            leave(space - per * s, low, low + m)
            at, n = at + m * per, n - m * per
    return sorted(segments), containers


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "tokens", capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """(key, piece_no, tokens, container_id): each item's container; the sizes in a container add up to at most `capacity`.

    Only an item longer than the capacity is split: into pieces of exactly the capacity and a rest. Items of no size
    (0 or null) take no space: piece 0 with a null container. `key` must be unique. Ties are broken by key, so equal input
    gives equal output whatever its partitions.
    """
    items = checkpointed(sizes.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n")))
    last = F.greatest(F.ceil(F.col("n") / F.lit(capacity)) - 1, F.lit(0))
    pieces = items.select(key, "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece_no"))
    pieces = pieces.select(key, "piece_no", F.least(F.col("n") - F.col("piece_no") * capacity, F.lit(capacity)).cast("int").alias("tokens"))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64(key, "piece_no"), F.lit(SALTS)).cast("int"))
    some = pieces.filter("tokens > 0")
    # At most capacity times SALTS rows.
    counted = sorted((r.tokens, r.salt, r.n) for r in some.groupBy("tokens", "salt").agg(F.count("*").alias("n")).collect())
    counts: dict[int, int] = {}
    before = np.zeros((capacity + 1, SALTS), np.int64)
    for s, salt, n in counted:
        before[s, salt] = counts.get(s, 0)
        counts[s] = counts.get(s, 0) + n
    segments, _ = plan(counts, capacity, groups)
    table = np.array(segments, np.int64).reshape(-1, 5)
    kind = sizes.schema[key].dataType.simpleString()
    spark = sizes.sparkSession
    shared = spark.sparkContext.broadcast((before, table))  # bounded by the capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, table = shared.value
        starts = table[:, 0] * (1 << 44) + table[:, 1]
        for batch in batches:
            s, salt, nth = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tokens", "salt", "nth"))
            rank = before[s, salt] + nth - 1
            row = table[np.searchsorted(starts, s * (1 << 44) + rank, side="right") - 1]
            container = row[:, 4] + (rank - row[:, 1]) // row[:, 3]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column("tokens"), pa.array(container)], names=[key, "piece_no", "tokens", "container_id"])

    ranked = some.withColumn("nth", F.row_number().over(Window.partitionBy("tokens", "salt").orderBy(key, "piece_no")))
    placed = ranked.mapInArrow(place, f"`{key}` {kind}, piece_no long, tokens int, container_id long")
    return placed.unionByName(pieces.filter("tokens = 0").select(key, "piece_no", "tokens", F.lit(None).cast("long").alias("container_id")))


def methods(sizes: DataFrame, size: str = "tokens", capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """(method, containers, used, lower_bound): what linear grouping and best-fit alone would take, and which of them pack() uses.

    `lower_bound` is the total size over the capacity, rounded up. Two rows.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    parts = sizes.select((n % capacity).cast("int").alias("rest"), F.floor(n / capacity).alias("whole"))
    # At most capacity rows.
    rows = parts.groupBy("rest").agg(F.count("*").alias("n"), F.sum("whole").alias("whole")).collect()
    counts = {r.rest: r.n for r in rows if r.rest}
    if whole := sum(r.whole for r in rows):
        counts[capacity] = whole
    bound = -(-sum(s * c for s, c in counts.items()) // capacity)
    taken = {name: _plan(counts, capacity, groups, limit)[1] for name, limit in (("linear_grouping", capacity // 8), ("best_fit", capacity))}
    used = min(taken, key=taken.get)
    return sizes.sparkSession.createDataFrame([(name, c, name == used, bound) for name, c in taken.items()], "method string, containers long, used boolean, lower_bound long")
