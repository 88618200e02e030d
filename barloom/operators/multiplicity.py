"""Joint-null corrections: family roll-up, step-down maxT, permutation FDR, survivor gate.

Draws travel packed, one array for each (hypothesis, chunk of draws). The number of hypotheses is fixed by the parameter grid;
the number of draws is not, so work is parted by chunks of draws and only counts leave them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.functions.quantiles import exact_quantile, value_bucket
from barloom.session import cut

# Gate limits.
MAX_TOP_DAY_SHARE = 0.40
WINDOW_SHARE = 0.7
DEFAULT_WINDOWS = 10
ALPHA = 0.05
LAMBDA = 0.5


def _columns(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def studentise(vectors: DataFrame, stats: DataFrame, observed: DataFrame, keys: list[str], obs: str) -> tuple[DataFrame, DataFrame]:
    """(null_t, observed_t): packed draws and observed value, centred and scaled by the draws; null where they don't vary."""
    moments = stats.select(*keys, F.col("null_mean").alias("_m"), F.when(F.col("null_std") != 0, F.col("null_std")).alias("_s"))

    def scaled(batches):
        import pyarrow as pa

        for batch in batches:
            t = [None if s is None else (v.values.to_numpy() - m) / s
                 for v, m, s in zip(batch["means"], batch["_m"].to_pylist(), batch["_s"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], batch["chunk"], pa.array(t, pa.list_(pa.float64()))],
                                             names=[*keys, "chunk", "t"])

    null_t = vectors.join(moments, keys).mapInArrow(scaled, _columns(vectors, keys) + ", chunk int, t array<double>")
    obs_t = observed.join(moments, keys, "left").select(
        *keys, ratio(F.col(obs) - F.col("_m"), F.col("_s")).alias("t"))
    return null_t, obs_t


def _greatest(null_t: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise maximum of the packed draws of each key, nulls ignored."""

    def top(table):
        import numpy as np
        import pyarrow as pa

        rows = [t.values.to_numpy() for t in table["t"] if t.is_valid]
        best = np.maximum.reduce(rows) if rows else None
        return pa.table([*[table[k].slice(0, 1) for k in keys], table["chunk"].slice(0, 1), pa.array([best], pa.list_(pa.float64()))],
                        names=[*keys, "chunk", "t"])

    return null_t.groupBy(*keys, "chunk").applyInArrow(top, (_columns(null_t, keys) + ", " if keys else "") + "chunk int, t array<double>")


def family_rollup(null_t: DataFrame, obs_t: DataFrame, family: list[str]) -> tuple[DataFrame, DataFrame]:
    """Largest statistic over the family's variants, per draw (packed) and observed."""
    return _greatest(null_t, family), obs_t.groupBy(*family).agg(F.max("t").alias("t"))


def step_down_maxt(null_t: DataFrame, obs_t: DataFrame, keys: list[str]) -> DataFrame:
    """Step-down adjusted p-values: monotone in the observed order, in (0, 1].

    A draw's tail at a rank is the maximum of its statistics from there to the last rank. Chunks of draws are apart from
    each other: one goes up the ranks with a running element-wise maximum and counts, at each rank, the tails at or above the observed
    value. A group is one chunk of all hypotheses, whose number is fixed by the parameter grid.
    """
    ranked = obs_t.filter(F.col("t").isNotNull()).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("t"), *keys))).withColumnRenamed("t", "obs")
    x = null_t.join(ranked.select(*keys, "rank", "obs"), keys).select("chunk", "rank", "obs", "t")

    def climb(table):
        import numpy as np
        import pyarrow as pa

        ranks, obs = table["rank"].to_numpy(), table["obs"].to_numpy()
        tail, hits, valid = None, np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for i in np.argsort(-ranks):
            t = table["t"][int(i)]
            if t.is_valid:
                t = t.values.to_numpy()
                tail = t.copy() if tail is None else np.maximum(tail, t, out=tail)
            if tail is not None:
                hits[i], valid[i] = (tail >= obs[i]).sum(), len(tail)
        return pa.table({"rank": pa.array(ranks, pa.int32()), "hits": pa.array(hits), "valid": pa.array(valid)})

    counts = x.groupBy("chunk").applyInArrow(climb, "rank int, hits long, valid long").groupBy("rank").agg(
        F.sum("hits").alias("_hits"), F.sum("valid").alias("_valid"))
    p = F.when(F.col("_valid") > 0, (1 + F.col("_hits")) / (1 + F.col("_valid"))).otherwise(F.lit(1.0))
    steps = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.join(counts, "rank").withColumn("p_adj", F.max(p).over(steps)).select(
        *keys, "rank", F.col("obs").alias("t"), "p_adj")


def permutation_fdr(null_t: DataFrame, obs_t: DataFrame, keys: list[str], lam: float = LAMBDA) -> DataFrame:
    """q-values from joint draws: expected exceedances per draw over rejections.

    Every task merges its sorted draws with the sorted observed statistics, one array whose length is fixed by the grid, and sends
    one count for each; their sums are the null draws at or above each statistic.
    """
    nulls = null_t.filter(F.col("t").isNotNull())
    obs = obs_t.filter(F.col("t").isNotNull())
    draws = nulls.select("chunk", F.size("t").alias("_n")).distinct().agg(F.sum("_n").alias("_draws"))
    split = exact_quantile(nulls.select(F.explode("t").alias("t")), "t", lam, "_split")
    pi0 = obs.crossJoin(split).agg(
        (F.count_if(F.col("t") <= F.col("_split")) / (lam * F.count(F.lit(1)))).alias("_r")).select(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_r"))).alias("_pi0"))
    sorted_obs = obs.agg(F.array_sort(F.array_distinct(F.collect_list("t"))).alias("_obs"))

    def merge(batches):
        import numpy as np
        import pyarrow as pa

        at = total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.asarray(batch["_obs"][0].as_py())
            values = np.sort(batch["t"].flatten().to_numpy())
            found = len(values) - np.searchsorted(values, at, "left")
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.astype(np.int64))], names=["t", "n"])

    at_least = nulls.select("t").crossJoin(F.broadcast(sorted_obs)).mapInArrow(merge, "t double, n long").groupBy("t").agg(
        F.sum("n").alias("_null_ge"))
    per = obs.select(*keys, "t").join(at_least, "t")
    ge = F.count(F.lit(1)).over(Window.orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0))
    x = per.withColumn("_rejected", ge).crossJoin(F.broadcast(draws)).crossJoin(F.broadcast(pi0))
    fdr = F.least(F.lit(1.0), F.col("_pi0") * (F.col("_null_ge") / F.col("_draws")) / F.col("_rejected"))
    tail = Window.orderBy(F.asc("t"), *[F.desc(k) for k in keys]).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("q_fdr", F.min(fdr).over(tail)).select(*keys, "t", "q_fdr")


def max_null(null_t: DataFrame) -> DataFrame:
    """Largest statistic of each draw."""
    return _greatest(null_t, []).select(F.explode("t").alias("max_t"))


def max_null_histogram(null_t: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width histogram of the per-draw maximum."""
    m = max_null(null_t)
    span = m.agg(F.min("max_t").alias("_lo"), F.max("max_t").alias("_hi"))
    return m.crossJoin(F.broadcast(span)).withColumn(
        "bin", value_bucket(F.col("max_t"), F.col("_lo"), F.col("_hi"), bins)).groupBy("bin").agg(
        F.count(F.lit(1)).alias("draws"),
        F.min(F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_low"))


def breadth_gate(summary: DataFrame) -> DataFrame:
    """``breadth_pass``: gains not concentrated in few days, and enough positive windows."""
    has = set(summary.columns)
    top = F.col("top5pct_day_pnl_share") if "top5pct_day_pnl_share" in has else F.lit(math.inf)
    positive = F.col("n_windows_positive") if "n_windows_positive" in has else F.lit(0)
    seen = F.col("n_windows_observed") if "n_windows_observed" in has else F.lit(DEFAULT_WINDOWS)
    needed = F.coalesce(F.ceil(F.lit(WINDOW_SHARE) * seen), F.lit(7))
    return summary.withColumn("breadth_pass", F.coalesce(
        (top <= MAX_TOP_DAY_SHARE) & (positive >= needed), F.lit(False)))


def attach_multiplicity(summary: DataFrame, null_t: DataFrame, obs_t: DataFrame,
                        variant: list[str], family: list[str]) -> DataFrame:
    """Family-primary and variant-supplementary corrections joined to the summary. ``null_t`` feeds several branches: pass a stored table."""
    fam_null, fam_obs = family_rollup(null_t, obs_t, family)
    fam_null = cut(fam_null)
    fam_p = step_down_maxt(fam_null, fam_obs, family).select(
        *family, F.col("t").alias("t_family_obs"), F.col("p_adj").alias("p_adj_maxT"))
    fam_q = permutation_fdr(fam_null, fam_obs, family).select(*family, "q_fdr")
    var_p = step_down_maxt(null_t, obs_t, variant).select(
        *variant, F.col("p_adj").alias("p_adj_maxT_variant"))
    effective = fam_null.groupBy(*family).agg(F.sum(F.coalesce(F.array_size("t"), F.lit(0))).alias("multiplicity_effective_k"))
    m = max_null(fam_null)
    hurdle = m.agg(F.percentile("max_t", F.lit(0.95)).alias("maxT_hurdle_95"), F.avg("max_t").alias("_mean_max"))
    best = fam_obs.agg(F.max("t").alias("_best"), F.count(F.lit(1)).alias("hypothesis_families"))
    count = summary.agg(F.count(F.lit(1)).alias("hypothesis_variants"))
    one = hurdle.crossJoin(best).crossJoin(count).withColumn(
        "selection_adjusted_best_stat", F.col("_best") - F.col("_mean_max")).drop("_best", "_mean_max")
    out = (
        summary.join(fam_p, family, "left").join(fam_q, family, "left")
        .join(var_p, variant, "left").join(effective, family, "left")
        .crossJoin(F.broadcast(one))
    )
    out = breadth_gate(out)
    return out.withColumn(
        "survivor", F.coalesce(F.col("p_adj_maxT") <= ALPHA, F.lit(False)) & F.col("breadth_pass"))
