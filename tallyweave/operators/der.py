"""Time-stamp tokens (RFC 3161, in CMS signed data) as binary columns → what they state. Signatures are not checked."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

# Object identifiers of signed data, of the time-stamp content, and of digests by name.
SIGNED_DATA, TIME_STAMP = "1.2.840.113549.1.7.2", "1.2.840.113549.1.9.16.1.4"
DIGESTS = {"1.3.14.3.2.26": "sha1", "2.16.840.1.101.3.4.2.1": "sha256", "2.16.840.1.101.3.4.2.2": "sha384", "2.16.840.1.101.3.4.2.3": "sha512"}

# Types are objects, not text: workers import this module without a session that could read text.
TOKEN = StructType([StructField(n, TimestampType() if n == "generated_at" else StringType()) for n in ("policy", "hash_name", "message_digest", "serial", "generated_at", "error")])
_SEQUENCE, _INTEGER, _OCTETS, _OID, _TIME, _EXPLICIT = 0x30, 0x02, 0x04, 0x06, 0x18, 0xA0


class Malformed(ValueError):
    """Bytes that are no token in distinguished encoding."""


class Reader:
    """Reads one value after the other of a stretch of bytes; lengths must be definite, minimal and within the stretch."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None) -> None:
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, tag: int) -> Reader:
        """The content of the next value, which must have this tag."""
        if self.at + 2 > self.end:
            raise Malformed("cut short")
        if self.data[self.at] != tag:
            raise Malformed(f"tag {self.data[self.at]:02x} in place of {tag:02x}")
        n, at = self.data[self.at + 1], self.at + 2
        if n >= 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > self.end or self.data[at] == 0:
                raise Malformed("a length is not definite and minimal")
            n, at = int.from_bytes(self.data[at : at + size], "big"), at + size
            if n < 0x80:
                raise Malformed("a length is not definite and minimal")
        if at + n > self.end:
            raise Malformed("cut short")
        self.at = at + n
        return Reader(self.data, at, at + n)

    def bytes(self) -> bytes:
        return self.data[self.at : self.end]

    def oid(self) -> str:
        parts, value = [], 0
        raw = self.bytes()
        if not raw or raw[-1] & 0x80:
            raise Malformed("an identifier is cut short")
        for b in raw:
            value = value << 7 | b & 0x7F
            if not b & 0x80:
                parts.append(value)
                value = 0
        first = min(parts[0] // 40, 2)
        return ".".join(map(str, [first, parts[0] - 40 * first, *parts[1:]]))


def read_token(der: bytes) -> tuple:
    """(policy, hash_name, message_digest, serial, generated_at) of a token; Malformed for anything else."""
    outer = Reader(der)
    content = outer.take(_SEQUENCE)
    if outer.at != outer.end:
        raise Malformed("more bytes behind the token")
    if content.take(_OID).oid() != SIGNED_DATA:
        raise Malformed("no signed data")
    signed = content.take(_EXPLICIT).take(_SEQUENCE)
    signed.take(_INTEGER)
    signed.take(0x31)  # the digest algorithms, a set
    inner = signed.take(_SEQUENCE)
    if inner.take(_OID).oid() != TIME_STAMP:
        raise Malformed("no time stamp")
    info = Reader(inner.take(_EXPLICIT).take(_OCTETS).bytes()).take(_SEQUENCE)
    info.take(_INTEGER)
    policy = info.take(_OID).oid()
    imprint = info.take(_SEQUENCE)
    name = imprint.take(_SEQUENCE).take(_OID).oid()
    digest = imprint.take(_OCTETS).bytes().hex()
    serial = int.from_bytes(info.take(_INTEGER).bytes(), "big", signed=True)
    text = info.take(_TIME).bytes().decode("ascii", "replace")
    whole, _, part = text.removesuffix("Z").partition(".")
    try:
        at = datetime.strptime(whole, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc) + timedelta(microseconds=int(part.ljust(6, "0")[:6]) if part else 0)
    except ValueError as e:
        raise Malformed(f"no time: {text}") from e
    if not text.endswith("Z"):
        raise Malformed(f"no time: {text}")
    return policy, DIGESTS.get(name, name), digest, str(serial), at


@F.pandas_udf(TOKEN)
def token(der: pd.Series) -> pd.DataFrame:
    """The members of TOKEN of each binary; malformed ones have an error and nothing else, null ones 'missing'."""

    def one(data: object) -> tuple:
        if data is None:
            return None, None, None, None, None, "missing"
        try:
            return (*read_token(bytes(data)), None)
        except Malformed as e:
            return None, None, None, None, None, str(e)

    rows = pd.DataFrame([one(d) for d in der], columns=["policy", "hash_name", "message_digest", "serial", "generated_at", "error"])
    return rows.assign(generated_at=pd.to_datetime(rows["generated_at"], utc=True).dt.tz_localize(None))
