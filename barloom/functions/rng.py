"""Reproducible integer randomness as column arithmetic.

A draw is a power permutation of a counter modulo a prime, so it depends only on
(seed, counter), needs no state, never overflows BIGINT, and any SQL engine with
64-bit integers reproduces it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647
STEP = 48271


def stable_seed(*parts: Column, master: int) -> Column:
    """CRC32 of the joined key parts, mixed with the master seed, in [0, PRIME)."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return (F.crc32(F.encode(text, "UTF-8")) + F.lit(master).cast("bigint")) % F.lit(PRIME)


def draw(seed: Column, counter: Column) -> Column:
    """The ``counter``-th pseudo-random integer in [0, PRIME) for ``seed``."""
    x = (seed + counter.cast("bigint") * F.lit(STEP)) % F.lit(PRIME)
    sq = x * x % F.lit(PRIME)
    return sq * sq % F.lit(PRIME) * x % F.lit(PRIME)


def draw_below(seed: Column, counter: Column, n: Column) -> Column:
    """Pseudo-random integer in [0, n)."""
    return draw(seed, counter) % n.cast("bigint")
