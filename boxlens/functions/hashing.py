"""Deterministic randomness: md5 of a seed and a key, the same in every engine and on every retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed, *parts) -> Column:
    cols = [F.lit(str(seed))] + [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hash_int(key: Column, start: int = 1) -> Column:
    """52 bits of the md5 as a bigint: every one of them is exact in a double."""
    return F.conv(F.substring(key, start, 13), 16, 10).cast("bigint")


def hash_uniform(key: Column, start: int = 1) -> Column:
    return hash_int(key, start) / F.lit(4503599627370496.0)


def hash_bucket(key: Column, digits: int) -> Column:
    """Order-preserving bucket: the leading hex digits of the key."""
    return F.substring(key, 1, digits)


def md5_divmod(key: Column, *divisors: int) -> list[Column]:
    """Remainders of successive divisions of the whole 128-bit digest.

    ``md5_divmod(k, a, b)`` gives ``m % a`` and ``(m // a) % b``. The digest is folded four hex digits at a time, so
    every intermediate stays far inside a bigint.
    """
    total = 1
    for d in divisors:
        total *= d
    if total >= 1 << 46:
        raise ValueError("product of divisors too large for exact folding")
    rest = F.lit(0).cast("bigint")
    for i in range(8):
        limb = F.conv(F.substring(key, 1 + 4 * i, 4), 16, 10).cast("bigint")
        rest = (rest * 65536 + limb) % total
    out = []
    for d in divisors:
        out.append(rest % d)
        rest = F.floor(rest / d).cast("bigint")
    return out
