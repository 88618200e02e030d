"""From variant summary and control pools to p-values and multiplicity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.rng import stable_seed
from barloom.operators.controls import (
    control_days, control_events, day_seed, label_controls, observed_weights, sample_days, stop_pools,
)
from barloom.operators.multiplicity import attach_multiplicity, studentise
from barloom.operators.resample import (
    day_prefixes, draw_vectors, jackknife_se, observed_size_blocks, vector_stats,
)
from barloom.params import (
    BLOCK_DAYS, FAMILY, MASTER_SEED, NULL_DRAWS, NULL_ENTRIES_PER_DAY, NULL_MIN_DAYS,
    NULL_SAMPLE_DAYS, VARIANT, GridSpec, Market,
)
from barloom.session import cut


PAIR = ["instrument", "session"]


@dataclass(frozen=True)
class NullSpec:
    draws: int = NULL_DRAWS
    sample_days: int = NULL_SAMPLE_DAYS
    entries_per_day: int = NULL_ENTRIES_PER_DAY
    min_days: int = NULL_MIN_DAYS
    block_days: int = BLOCK_DAYS
    seed: int = MASTER_SEED


def null_vectors(summary: DataFrame, pool_days: DataFrame, pool_keys: list[str], spec: NullSpec,
                 label: str, variant: list[str] = VARIANT) -> DataFrame:
    """Packed draws of each variant's null mean at its own sample size.

    One seed serves all variants, so draw b is the same resample for all pools of equal days, cut at their numbers of blocks.
    Pools are summarised once per pool key and joined to their variants.
    """
    prefixes = day_prefixes(pool_days, pool_keys)
    x = summary.select(*variant, "trade_count").join(prefixes, pool_keys)
    seed = stable_seed(F.lit(label), master=spec.seed)
    return draw_vectors(x, variant, spec.draws, observed_size_blocks(F.col("trade_count"), spec.block_days),
                        seed, spec.block_days)


def enrich_summary(summary: DataFrame, broad: DataFrame, fired: DataFrame, spec: NullSpec,
                   broad_keys: list[str] = VARIANT, fired_keys: list[str] = VARIANT,
                   obs: str = "expectancy_net_r", designs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary with null columns and multiplicity, studentised draws).

    ``broad`` and ``fired`` are control days keyed by their pool keys plus date. ``designs`` says per family how its
    days were chosen (see null_designs); without it the days used are those with control trades and the rest is
    unknown. The draws feed many consumers, so they are cut to the checkpoint folder once.
    """
    summary = cut(summary)
    b_means = cut(null_vectors(summary, broad, broad_keys, spec, "joint-bootstrap"))
    f_means = null_vectors(summary, fired, fired_keys, spec, "joint-bootstrap-fired")
    b_stats = cut(vector_stats(b_means, VARIANT, summary, obs))
    stats = b_stats.select(
        *VARIANT, F.col("null_mean").alias("null_exp_mean"), F.col("null_p95").alias("null_exp_p95"),
        F.col("null_draws").alias("null_bootstrap_k"), F.col("p_value").alias("null_p_broad"))
    pool = broad.groupBy(*broad_keys).agg(
        F.sum("n").alias("null_pool_trades"), F.count(F.lit(1)).alias("null_effective_n")).join(
        jackknife_se(broad, broad_keys).select(
            *broad_keys, F.col("jackknife_se").alias("null_mean_jackknife_se")), broad_keys)
    out = (
        summary.join(stats, VARIANT, "left")
        .join(vector_stats(f_means, VARIANT, summary, obs).select(*VARIANT, F.col("p_value").alias("null_p_matched")), VARIANT, "left")
        .join(pool, broad_keys, "left")
        .withColumn("null_p_value", F.col("null_p_broad"))
        .withColumn("null_unreliable", F.coalesce("null_effective_n", F.lit(0)) < spec.min_days)
    )
    if designs is None:
        traded = fired.groupBy(*fired_keys).agg(F.count(F.lit(1)).alias("null_matched_days_used"))
        out = out.join(traded, fired_keys, "left").withColumns({
            "null_days_used": F.col("null_effective_n"), **{n: F.lit(None).cast(t) for n, t in (("null_days_requested", "int"), ("null_design", "string"), ("null_days_exhausted", "boolean"),
                                                   ("null_day_sampling", "string"), ("null_seed", "bigint"))}})
    else:
        out = out.join(designs, FAMILY, "left")
    out = out.withColumn("multiplicity_stat", F.lit("bootstrap_studentized_net_mean"))
    null_t, obs_t = studentise(b_means, b_stats, summary, VARIANT, obs)
    null_t = cut(null_t)
    return attach_multiplicity(out, null_t, obs_t, VARIANT, FAMILY), null_t


def null_designs(families: DataFrame, picks: DataFrame, days: DataFrame, fired: DataFrame, pools: DataFrame,
                 spec: NullSpec) -> DataFrame:
    """Per family: which design it has, how many days were asked for and used, and the seed of its day sample."""
    used = picks.groupBy(*FAMILY).agg(F.count(F.lit(1)).alias("null_days_used"), F.first("design").alias("null_day_sampling"))
    there = days.groupBy("instrument", "session").agg(F.count(F.lit(1)).alias("_days"))
    traded = fired.join(days.select("instrument", "session", "local_date").distinct(),
                        ["instrument", "session", "local_date"], "left_semi").groupBy(*FAMILY).agg(
        F.count(F.lit(1)).alias("null_matched_days_used"))
    return (
        families.join(used, FAMILY, "left").join(there, PAIR, "left").join(traded, FAMILY, "left")
        .join(pools.select(*FAMILY, "pool_size"), FAMILY, "left")
        .select(*FAMILY,
                F.when(F.col("pool_size").isNotNull(), "matched-stop").otherwise("swing-fallback").alias("null_design"),
                F.lit(spec.sample_days).alias("null_days_requested"), F.coalesce("null_days_used", F.lit(0)).alias("null_days_used"),
                (F.coalesce("_days", F.lit(0)) < spec.sample_days).alias("null_days_exhausted"), "null_day_sampling",
                day_seed(PAIR, spec.seed).alias("null_seed"),
                F.coalesce("null_matched_days_used", F.lit(0)).alias("null_matched_days_used")))


def control_pools(marked: DataFrame, days: DataFrame, grid: GridSpec, market: Market,
                  spec: NullSpec) -> dict[str, DataFrame]:
    """Broad and fired control days per family and level, with the picks and stop pools used.

    Families with observed stops use the matched design, the others place swing stops.
    """
    eligible = marked.filter("eligible")
    slim = days.select("instrument", "session", "local_date", F.lit(0).alias("regime_window")) \
        if "regime_window" not in days.columns else \
        days.select("instrument", "session", "local_date", "regime_window")
    families = marked.select(*FAMILY).distinct()
    stratum = "regime_window"
    weights = observed_weights(
        eligible.withColumn(stratum, F.coalesce(F.col(stratum), F.lit(0))), FAMILY, stratum)
    per_family = families.join(slim, ["instrument", "session"])
    # Days are ranked by the seed of their pair, so that its families share them and their draws are joint.
    broad = sample_days(per_family, FAMILY, stratum, spec.sample_days, weights=weights, master=spec.seed, seed_keys=PAIR)
    fired = eligible.select(*FAMILY, F.col("date").alias("local_date")).distinct()
    pools = stop_pools(eligible)
    base = days.drop("regime_window")

    def label(picks: DataFrame, tag: str) -> DataFrame:
        with_pool = picks.select(*FAMILY, "local_date").join(pools, FAMILY, "left")
        matched = control_events(base, with_pool.filter("pool_size IS NOT NULL"), grid, "matched", tag,
                                 spec.entries_per_day, spec.seed)
        swing = control_events(base, with_pool.filter("pool_size IS NULL"), grid, "swing", tag,
                               spec.entries_per_day, spec.seed)
        return label_controls(matched, grid, market).unionByName(
            label_controls(swing, grid, market), allowMissingColumns=True)

    return {
        "broad": control_days(label(broad, "broad")), "fired": control_days(label(fired, "fired")),
        "picks": broad, "stop_pools": pools,
        "designs": null_designs(families, broad, slim, fired, pools, spec),
    }
