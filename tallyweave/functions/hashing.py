"""Digests. SHA-256 is native; Keccak-256 is permuted for all rows of an Arrow batch at once in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

_M = np.uint64(0xFFFFFFFFFFFFFFFF)
RATE = 136


def _round_constants() -> list[int]:
    """The 24 constants of Keccak-f[1600], from its linear feedback shift register."""
    out, state = [], 1
    for _ in range(24):
        constant = 0
        for j in range(7):
            if state & 1:
                constant |= 1 << ((1 << j) - 1)
            state = (state << 1) ^ (0x171 if state & 0x80 else 0)
        out.append(constant)
    return out


def _rotations() -> dict[tuple[int, int], int]:
    out, x, y = {(0, 0): 0}, 1, 0
    for t in range(24):
        out[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


_CONSTANTS, _ROTATIONS = [np.uint64(c) for c in _round_constants()], _rotations()

#: Where each lane x + 5 y goes, and by how many bits it is turned.
_MOVES = [(x + 5 * y, y + 5 * ((2 * x + 3 * y) % 5), n) for (x, y), n in _ROTATIONS.items()]


def _turn(v: np.ndarray, n: int) -> np.ndarray:
    return v if not n else (v << np.uint64(n)) | (v >> np.uint64(64 - n))


def _permute(s: np.ndarray) -> None:
    """Keccak-f[1600] in place on states of shape (5, 5, rows), indexed [x, y]."""
    for constant in _CONSTANTS:
        c = s[:, 0] ^ s[:, 1] ^ s[:, 2] ^ s[:, 3] ^ s[:, 4]
        for x in range(5):
            s[x] ^= c[(x - 1) % 5] ^ _turn(c[(x + 1) % 5], 1)
        b = np.empty_like(s)
        for (x, y), n in _ROTATIONS.items():
            b[y, (2 * x + 3 * y) % 5] = _turn(s[x, y], n)
        for x in range(5):
            s[x] = b[x] ^ (~b[(x + 1) % 5] & b[(x + 2) % 5])
        s[0, 0] ^= constant


_ONES = (1 << 64) - 1
#: Up to so many messages are hashed one by one on Python's integers, beyond it is faster to permute them together.
FEW = 6


def _keccak_one(message: bytes) -> bytes:
    """Keccak-256 of one message; lanes are integers, indexed x + 5 y."""
    data = bytearray(message) + b"\0" * (RATE - len(message) % RATE)
    data[len(message)] ^= 1
    data[-1] ^= 0x80
    a = [0] * 25
    for start in range(0, len(data), RATE):
        for k in range(RATE // 8):
            a[k] ^= int.from_bytes(data[start + 8 * k : start + 8 * k + 8], "little")
        for constant in _CONSTANTS:
            c = [a[x] ^ a[x + 5] ^ a[x + 10] ^ a[x + 15] ^ a[x + 20] for x in range(5)]
            d = [c[x - 1] ^ ((c[(x + 1) % 5] << 1 | c[(x + 1) % 5] >> 63) & _ONES) for x in range(5)]
            b = [0] * 25
            for k, to, turn in _MOVES:
                v = a[k] ^ d[k % 5]
                b[to] = (v << turn | v >> (64 - turn)) & _ONES
            for y in range(0, 25, 5):
                p, q, r, s, t = b[y : y + 5]
                a[y : y + 5] = p ^ (~q & r), q ^ (~r & s), r ^ (~s & t), s ^ (~t & p), t ^ (~p & q)
            a[0] ^= int(constant)
    return b"".join(v.to_bytes(8, "little") for v in a[:4])


def keccak_many(messages: list[bytes]) -> list[bytes]:
    """Keccak-256 (the padding of 2011, not that of SHA-3) of each message; messages of as many blocks are permuted together."""
    if len(messages) <= FEW:
        return [_keccak_one(m) for m in messages]
    out: list[bytes] = [b""] * len(messages)
    groups: dict[int, list[int]] = {}
    for i, m in enumerate(messages):
        groups.setdefault(len(m) // RATE + 1, []).append(i)
    for blocks, rows in groups.items():
        for start in range(0, len(rows), 4096):
            part = rows[start : start + 4096]
            data = np.zeros((len(part), blocks * RATE), np.uint8)
            for k, i in enumerate(part):
                m = messages[i]
                data[k, : len(m)] = np.frombuffer(m, np.uint8)
                data[k, len(m)] ^= 1
            data[:, -1] ^= 0x80
            words = data.view("<u8").reshape(len(part), blocks, RATE // 8)
            state = np.zeros((5, 5, len(part)), np.uint64)
            for block in range(blocks):
                for k in range(RATE // 8):
                    state[k % 5, k // 5] ^= words[:, block, k]
                _permute(state)
            digest = np.stack([state[k % 5, k // 5] for k in range(4)], axis=1).astype("<u8").tobytes()
            for k, i in enumerate(part):
                out[i] = digest[32 * k : 32 * k + 32]
    return out


@F.pandas_udf(BinaryType())
def keccak256(data: pd.Series) -> pd.Series:
    """Keccak-256 of a binary column; null for null."""
    known = data.notna()
    out = pd.Series([None] * len(data), index=data.index, dtype=object)
    out[known] = pd.Series(keccak_many([bytes(x) for x in data[known]]), index=data.index[known], dtype=object)
    return out


def sha256_hex(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of a string or binary column."""
    return F.sha2(text.cast("binary"), 256)


# The tags that keep leaves and inner nodes of a tree apart.
LEAF_TAG, NODE_TAG = b"\x00", b"\x01"
#: Name under which paths are bound into leaves; trees under different names differ.
PATH_DOMAIN = b"dir-leaf/v1"


def path_leaf(path: Column, digest: Column, domain: bytes = PATH_DOMAIN) -> Column:
    """Leaf that binds a path to a content digest: over the domain's digest, the path, a zero byte and the content digest."""
    return keccak256(F.concat(F.lit(bytearray(keccak_many([domain])[0])), path.cast("binary"), F.lit(bytearray(b"\0")), digest))
