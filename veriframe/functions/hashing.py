"""Hash-derived keys, folds and draws: the same value on every engine and every retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_key(namespace: str | Column, value: Column) -> Column:
    ns = F.lit(namespace) if isinstance(namespace, str) else namespace
    return F.sha2(F.concat_ws(":", ns, value.cast("string")), 256)


def hash_mod(text: Column, k: int) -> Column:
    """Exact remainder of the 256-bit SHA-256 value: eight hex digits at a time."""
    digest = F.sha2(text, 256)
    step = (1 << 32) % k
    out = F.lit(0).cast("bigint")
    for start in range(1, 64, 8):
        word = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        out = (out * step + word) % k
    return out


def hash_unit(text: Column) -> Column:
    """Uniform draw in [0, 1) from the first 52 bits of the hash."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint") / float(1 << 52)


def hash_index(text: Column, n: Column) -> Column:
    """Index in 0..n-1 for a data-dependent n (first 15 hex digits modulo n)."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint"), n.cast("bigint"))
