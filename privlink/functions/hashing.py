"""Keyed double hashing of q-grams, once as built-in expressions and once for Arrow batches."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO31, TWO32 = 1 << 31, 1 << 32


def _pads(key: bytes) -> tuple[bytes, bytes]:
    if len(key) > 64:
        raise ValueError("a key has at most 64 bytes")
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_hex(c: Column, key: bytes, digest: str) -> Column:
    """HMAC as hexadecimal digits, by two nested digests; digest: md5 or sha1."""
    inner, outer = (F.unhex(F.lit(p.hex())) for p in _pads(key))
    h = {"md5": F.md5, "sha1": F.sha1}[digest]
    return h(F.concat(outer, F.unhex(h(F.concat(inner, c.cast("binary"))))))


def low_int32(hex_digits: Column) -> Column:
    """The last four bytes as a signed big-endian integer."""
    x = F.conv(F.right(hex_digits, F.lit(8)), 16, 10).cast("bigint")
    return F.pmod(x + TWO31, F.lit(TWO32)) - TWO31


def positions(gram: Column, n: int, k: int, key: bytes) -> Column:
    """k bit positions below n: |(sha + i * md5) mod n| for i = 1 .. k, in wrapping 32-bit arithmetic.

    The remainder is that of truncated division, as Spark's and Java's % are.
    """
    a, b = low_int32(hmac_hex(gram, key, "sha1")), low_int32(hmac_hex(gram, key, "md5"))
    pair = F.array(a, b)  # bound once, used for every i
    made = F.transform(F.array(pair), lambda p: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.abs((F.pmod(p[0] + i * p[1] + TWO31, F.lit(TWO32)) - TWO31) % n).cast("int")))
    return F.get(made, 0)


def _int32(raw: bytes) -> int:
    return int.from_bytes(raw[-4:], "big", signed=True)


def positions_of(gram: str, n: int, k: int, key: bytes) -> list[int]:
    """The same positions in Python, for workers that remember them by q-gram."""
    raw = gram.encode()
    a, b = _int32(hmac.digest(key, raw, hashlib.sha1)), _int32(hmac.digest(key, raw, hashlib.md5))
    out = []
    for i in range(1, k + 1):
        x = (a + i * b + TWO31) % TWO32 - TWO31
        out.append(abs(x) % n)
    return out


def linear_positions(gram: str, n: int, k: int, key: bytes) -> list[int]:
    """A variant on unbounded integers: (sha + i * md5) mod n for i = 0 .. k-1 over the whole digests."""
    raw = gram.encode()
    a, b = (int.from_bytes(hmac.digest(key, raw, h), "big", signed=True) for h in (hashlib.sha1, hashlib.md5))
    return [(b * i + a) % n for i in range(k)]
