"""Small column helpers: ticks, null-safe arithmetic, rank and percentile forms."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def to_ticks(price: Column, tick_size: Column | float) -> Column:
    """Price on the integer tick grid; off-grid prices go to the nearest tick."""
    tick = tick_size if isinstance(tick_size, Column) else F.lit(float(tick_size))
    return F.round(price / tick, 0).cast("bigint")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def ratio(num: Column, den: Column) -> Column:
    """num / den, null when the denominator is null or zero."""
    return num.cast("double") / F.when(den != 0, den.cast("double"))


def share(cond: Column) -> Column:
    """Mean of a boolean over the group, as count / count."""
    return F.count_if(cond).cast("double") / F.count(F.lit(1))


def mean_rank_pct(value: Column, keys: list) -> Column:
    """Average-rank percentile in (0, 1] within ``keys``, ties share their mean rank."""
    part = Window.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    first = F.rank().over(part.orderBy(value))
    n = F.count(F.lit(1)).over(part)
    return (first + (ties - 1) / F.lit(2.0)) / n


def mean_rank(value: Column, keys: list) -> Column:
    part = Window.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.rank().over(part.orderBy(value)) + (ties - 1) / F.lit(2.0)
