"""Exact quantiles of one large column without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def value_bucket(value: Column, low: Column, high: Column, buckets: int = BUCKETS) -> Column:
    """Equal-width bucket of ``value`` between ``low`` and ``high``; monotone in the value."""
    width = F.when(high > low, (high - low) / buckets)
    return F.least(F.coalesce(F.floor((value - low) / width), F.lit(0)), F.lit(buckets - 1)).cast("bigint")


def split_points(df: DataFrame, value: str, name: str, buckets: int = BUCKETS) -> DataFrame:
    """One row: an array of values that part the rows of ``df`` into about equal buckets."""
    shares = [k / buckets for k in range(1, buckets)]
    return df.agg(F.array_sort(F.array_distinct(F.percentile_approx(value, shares, 4 * buckets))).alias(name))


def split_bucket(value: Column, splits: Column, buckets: int = BUCKETS) -> Column:
    """The number of split points at or below ``value``, by binary search; monotone in the value."""
    steps = F.lit([1 << k for k in range(buckets.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(splits)) & (F.get(splits, at + step - 1) <= value), at + step).otherwise(at)).cast("bigint")


def exact_quantile(df: DataFrame, value: str, p: float, name: str) -> DataFrame:
    """One row with the linearly interpolated ``p``-quantile of ``value``.

    Equal values are counted first. Buckets are parted at approximate quantiles, so an outlier does not
    gather the rest in one. Bucket counts locate the buckets of the two order statistics,
    and only those buckets are ranked.
    """
    x = df.select(F.col(value).cast("double").alias("_v")).dropna().groupBy("_v").agg(
        F.count(F.lit(1)).alias("_w"))
    parts = split_points(x, "_v", "_splits").crossJoin(x.agg(F.sum("_w").alias("_n")))
    x = x.crossJoin(F.broadcast(parts)).withColumn("_b", split_bucket(F.col("_v"), F.col("_splits"))).drop("_splits")
    counts = x.groupBy("_b").agg(F.sum("_w").alias("_c"), F.first("_n").alias("_n"))
    before = F.coalesce(F.sum("_c").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before)
    pos = F.lit(p) * (F.col("_n") - 1)
    counts = counts.withColumns({"_k0": F.floor(pos), "_k1": F.ceil(pos), "_frac": pos - F.floor(pos)})
    after = F.col("_before") + F.col("_c")
    hit = counts.filter(((F.col("_k0") >= F.col("_before")) & (F.col("_k0") < after))
                        | ((F.col("_k1") >= F.col("_before")) & (F.col("_k1") < after)))
    upto = F.sum("_w").over(Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = x.select("_v", "_b", "_w").join(F.broadcast(hit), "_b").withColumn(
        "_end", upto + F.col("_before")).withColumn("_start", F.col("_end") - F.col("_w"))

    def covers(k):
        return (F.col(k) >= F.col("_start")) & (F.col(k) < F.col("_end"))

    k0, k1 = covers("_k0"), covers("_k1")
    low_v, high_v = F.max(F.when(k0, F.col("_v"))), F.max(F.when(k1, F.col("_v")))
    return ranked.agg((low_v + (high_v - low_v) * F.max("_frac")).alias(name))
