"""Merkle trees over digests: the unordered tree of sorted leaves and the ordered log tree, with proofs.

The sorted tree is folded level by level as a DataFrame: each level numbers its nodes by position, pairs `pos / 2` and
hashes the pairs of an Arrow batch at once. Positions come from counts per range partition, so no level passes through
one task. The ordered trees of groups of rows (journals, sessions) are folded together, by group and place. The hash is
Keccak-256 unless `sha256` is named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

from tallyweave.functions.hashing import LEAF_TAG, NODE_TAG, keccak256, keccak_many
from tallyweave.operators.ordered import numbered
from tallyweave.session import checkpointed


def _sha256_many(messages: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(m).digest() for m in messages]


#: Hashes by name: many messages at once.
HASHES: dict[str, Callable[[list[bytes]], list[bytes]]] = {"keccak": keccak_many, "sha256": _sha256_many}


def _leaf(digest: Column, hash_name: str) -> Column:
    tagged = F.concat(F.lit(bytearray(LEAF_TAG)), digest)
    return F.unhex(F.sha2(tagged, 256)) if hash_name == "sha256" else keccak256(tagged)


def _node(a: Column, b: Column, hash_name: str) -> Column:
    """Inner node of a pair in the order given."""
    tagged = F.concat(F.lit(bytearray(NODE_TAG)), a, b)
    return F.unhex(F.sha2(tagged, 256)) if hash_name == "sha256" else keccak256(tagged)


def sorted_levels(leaves: DataFrame, hash_name: str = "keccak") -> list[DataFrame]:
    """Levels (pos, node), bottom first, of the tree over the binary column `digest` in ascending order.

    Leaves and inner nodes are tagged, pairs are hashed smaller first, and the last node of an odd level is paired with
    itself. No levels for no leaves. Each level is written before the next reads it.
    """
    n = leaves.count()
    if not n:
        return []
    bottom = numbered(leaves.select("digest"), "digest")
    level = checkpointed(bottom.select("pos", _leaf(F.col("digest"), hash_name).alias("node")))
    out = [level]
    while n > 1:
        pairs = level.groupBy(F.floor(F.col("pos") / 2).cast("bigint").alias("pos")).agg(F.min_by("node", "pos").alias("a"), F.max_by("node", "pos").alias("b"))
        level = checkpointed(pairs.select("pos", _node(F.least("a", "b"), F.greatest("a", "b"), hash_name).alias("node")))
        out.append(level)
        n = (n + 1) // 2
    return out


def sorted_root(leaves: DataFrame, hash_name: str = "keccak") -> DataFrame:
    """One row (root, as lower-case hex) of the sorted tree; none for no leaves."""
    levels = sorted_levels(leaves, hash_name)
    empty = leaves.sparkSession.createDataFrame([], "root string")
    return levels[-1].select(F.lower(F.hex("node")).alias("root")) if levels else empty


def sorted_proofs(leaves: DataFrame, hash_name: str = "keccak") -> DataFrame:
    """(digest, pos, proof): for every leaf the siblings from bottom to top, as an array of binaries.

    Each level is one equi-join on the sibling's position; a lone last node is its own sibling.
    """
    levels = sorted_levels(leaves, hash_name)
    if not levels:
        return leaves.sparkSession.createDataFrame([], "digest binary, pos bigint, proof array<binary>")
    x = numbered(leaves.select("digest"), "digest").withColumn("at", F.col("pos")).withColumn("proof", F.array().cast("array<binary>"))
    for level in levels[:-1]:
        own, other = level.select(F.col("pos").alias("at"), F.col("node").alias("own")), level.select(F.col("pos").alias("sibling"), F.col("node").alias("other"))
        x = x.withColumn("sibling", F.col("at").bitwiseXOR(F.lit(1).cast("bigint"))).join(own, "at").join(other, "sibling", "left")
        x = x.withColumn("proof", F.concat("proof", F.array(F.coalesce("other", "own")))).withColumn("at", F.floor(F.col("at") / 2).cast("bigint")).drop("sibling", "own", "other")
    return x.select("digest", "pos", "proof")


def _fold(digest: pd.Series, proof: pd.Series, hash_name: str) -> pd.Series:
    many = HASHES[hash_name]
    nodes = many([LEAF_TAG + bytes(d) for d in digest])
    depth = max((len(p) for p in proof), default=0)
    for k in range(depth):
        rows = [i for i, p in enumerate(proof) if len(p) > k]
        new = many([NODE_TAG + min(nodes[i], bytes(proof.iloc[i][k])) + max(nodes[i], bytes(proof.iloc[i][k])) for i in rows])
        for i, node in zip(rows, new):
            nodes[i] = node
    return pd.Series(nodes)


def proof_folder(hash_name: str = "keccak") -> Callable:
    """The column function (digest, proof) → root by a hash."""

    @F.pandas_udf(BinaryType())
    def fold(digest: pd.Series, proof: pd.Series) -> pd.Series:
        return _fold(digest, proof, hash_name)

    return fold


@F.pandas_udf(BinaryType())
def fold_proof(digest: pd.Series, proof: pd.Series) -> pd.Series:
    """Root that a leaf digest and its proof lead to, all rows of a batch level by level."""
    return _fold(digest, proof, "keccak")


# The ordered log tree (RFC 6962): left and right are kept, a tree of n leaves splits at the largest power of two below n.

EMPTY_ROOT = keccak_many([b"journal-log/v1:empty-root"])[0]


def _split(n: int) -> int:
    return 1 << (n - 1).bit_length() - 1


def log_root(leaves: list[bytes]) -> bytes:
    """Root of the ordered tree; a constant for no leaves."""
    return Log(leaves).root(0, len(leaves))


class Log:
    """An ordered tree with its complete subtrees at hand: `layers[k][i]` is the root of leaves i 2^k to (i + 1) 2^k."""

    def __init__(self, leaves: list[bytes]) -> None:
        self.size, self.layers = len(leaves), [keccak_many([LEAF_TAG + x for x in leaves])]
        while len(self.layers[-1]) > 1:
            low = self.layers[-1]
            self.layers.append(keccak_many([NODE_TAG + low[k] + low[k + 1] for k in range(0, len(low) - 1, 2)]))

    def root(self, start: int, end: int) -> bytes:
        """Root of the leaves from `start` to `end`, a node of the tree; of none the constant."""
        if start == end:
            return EMPTY_ROOT
        n = end - start
        if not n & (n - 1):
            k = n.bit_length() - 1
            return self.layers[k][start >> k]
        k = start + _split(n)
        return keccak_many([NODE_TAG + self.root(start, k) + self.root(k, end)])[0]

    def inclusion(self, index: int) -> list[bytes]:
        """Siblings of leaf `index` from bottom to top."""
        out, start, end = [], 0, self.size
        while end - start > 1:
            k = start + _split(end - start)
            out.append(self.root(k, end) if index < k else self.root(start, k))
            start, end = (start, k) if index < k else (k, end)
        return out[::-1]

    def consistency(self, first: int) -> list[bytes]:
        """Nodes that show the tree of the `first` leaves to be a prefix of the tree of all."""

        def walk(start: int, end: int, whole: bool) -> list[bytes]:
            if first == end:
                return [] if whole else [self.root(start, end)]
            k = start + _split(end - start)
            if first <= k:
                return [*walk(start, k, whole), self.root(k, end)]
            return [*walk(k, end, False), self.root(start, k)]

        return walk(0, self.size, True) if 0 < first <= self.size else []


def inclusion_holds(leaf: bytes, index: int, size: int, path: list[bytes], root: bytes) -> bool:
    """Whether `path` leads from leaf `index` of `size` to `root`."""
    if not 0 <= index < size:
        return False
    at, last, node = index, size - 1, keccak_many([LEAF_TAG + leaf])[0]
    for sibling in path:
        if not last:
            return False
        if at % 2 or at == last:
            node = keccak_many([NODE_TAG + sibling + node])[0]
            while at and not at % 2:
                at, last = at >> 1, last >> 1
        else:
            node = keccak_many([NODE_TAG + node + sibling])[0]
        at, last = at >> 1, last >> 1
    return not last and node == root


def consistency_holds(first: int, second: int, path: list[bytes], first_root: bytes, second_root: bytes) -> bool:
    """Whether `path` shows the tree (first, first_root) to be a prefix of (second, second_root)."""
    if not 0 <= first <= second:
        return False
    if first == second:
        return not path and first_root == second_root
    if not first:
        return not path and first_root == EMPTY_ROOT
    nodes = list(path) if first & (first - 1) else [first_root, *path]
    if not nodes:
        return False
    at, last = first - 1, second - 1
    while at % 2:
        at, last = at >> 1, last >> 1
    old = new = nodes[0]
    for node in nodes[1:]:
        if not last:
            return False
        if at % 2 or at == last:
            old, new = keccak_many([NODE_TAG + node + old])[0], keccak_many([NODE_TAG + node + new])[0]
            while at and not at % 2:
                at, last = at >> 1, last >> 1
        else:
            new = keccak_many([NODE_TAG + new + node])[0]
        at, last = at >> 1, last >> 1
    return not last and old == first_root and new == second_root


#: Levels of ordered trees that are folded at once: groups of 2^FOLD neighbours become one node.
FOLD = 8


def fold_ordered(groups: list[list[bytes]], hash_name: str = "keccak") -> list[bytes]:
    """Roots of the ordered trees over nodes, all groups level by level. A lone last node rises as it is."""
    many = HASHES[hash_name]
    while any(len(g) > 1 for g in groups):
        made = iter(many([NODE_TAG + g[k] + g[k + 1] for g in groups for k in range(0, len(g) - 1, 2)]))
        groups = [[next(made) if k + 1 < len(g) else g[k] for k in range(0, len(g), 2)] for g in groups]
    return [g[0] for g in groups]


def log_heads(rows: DataFrame, group: str, seq: str, leaf: str, hash_name: str = "keccak") -> DataFrame:
    """(group, size, root as hex): the ordered tree's head of each group, leaves in order of `seq` (ties: of the leaf).

    A tree that splits at the largest power of two is the tree that pairs neighbours level by level and lets a lone last
    node rise. So all logs are folded together, FOLD levels a round, keyed by log and place: no log passes through one task,
    and a log with a third of all rows is spread like the others. Null leaves count as empty.
    """
    slim = rows.select(F.col(group).alias("g"), F.col(seq).alias("seq"), F.coalesce(leaf, F.lit(bytearray(b""))).alias("leaf"))
    placed = numbered(slim, "g", "seq", "leaf")
    sizes = placed.groupBy(F.col("g").alias("_g")).agg(F.count("*").alias("size"), F.min("pos").alias("first"))
    level = placed.join(sizes, F.col("g").eqNullSafe(F.col("_g"))).select("g", "size", (F.col("pos") - F.col("first")).alias("pos"), _leaf(F.col("leaf"), hash_name).alias("node"))

    @F.pandas_udf(BinaryType())
    def fold(nodes: pd.Series) -> pd.Series:
        return pd.Series(fold_ordered([[bytes(x) for x in g] for g in nodes], hash_name), index=nodes.index, dtype=object)

    longest = sizes.agg(F.max("size")).first()[0] or 0
    while True:
        near = level.groupBy("g", "size", F.shiftright("pos", FOLD).alias("up")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda s: s["node"]).alias("nodes"))
        level = checkpointed(near.select("g", "size", F.col("up").alias("pos"), fold("nodes").alias("node")))
        longest = -(-longest // (1 << FOLD))
        if longest <= 1:
            return level.select(F.col("g").alias(group), F.col("size").cast("bigint").alias("size"), F.lower(F.hex("node")).alias("root"))


def log_prefixes(rows: DataFrame, group: str, seq: str, leaf: str, first: Callable[[int], int]) -> DataFrame:
    """(group, first, second, holds): whether each group's log grew by appending only, shown by its own consistency proof.

    `first` maps a log's size to the earlier size.
    """
    kind = rows.schema[group].dataType.simpleString()

    def prove(key: tuple, table: pa.Table) -> pa.Table:
        leaves = table.sort_by([("seq", "ascending")]).column("leaf").to_pylist()
        m, log = first(len(leaves)), Log(leaves)
        holds = consistency_holds(m, len(leaves), log.consistency(m), log_root(leaves[:m]), log.root(0, len(leaves)))
        return pa.table({"g": [key[0].as_py()], "first": [m], "second": [len(leaves)], "holds": [holds]})

    slim = rows.select(F.col(group).alias("g"), F.col(seq).alias("seq"), F.col(leaf).alias("leaf"))
    return slim.groupBy("g").applyInArrow(prove, f"g {kind}, first bigint, second bigint, holds boolean").withColumnRenamed("g", group)


@F.pandas_udf(BooleanType())
def inclusion_ok(leaf: pd.Series, index: pd.Series, size: pd.Series, path: pd.Series, root: pd.Series) -> pd.Series:
    """inclusion_holds() by row; false for nulls."""
    rows = zip(leaf, index, size, path, root)
    return pd.Series([all(v is not None for v in r) and inclusion_holds(bytes(r[0]), int(r[1]), int(r[2]), [bytes(p) for p in r[3]], bytes(r[4])) for r in rows])

