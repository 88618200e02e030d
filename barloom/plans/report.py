"""Report queries over the summary, the regime summary and the journal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.params import FAMILY, MIN_TRADES, VARIANT, Market


def headline_counts(marked: DataFrame, summary: DataFrame, min_trades: int = MIN_TRADES) -> DataFrame:
    rows = marked.agg(
        F.count_if("eligible").alias("eligible_rows"),
        F.count_if("atr_exceeds_cap").alias("cap_flagged_rows"),
        F.count_if("same_bar_ambiguous").alias("ambiguous_rows"))
    variants = summary.agg(
        F.count(F.lit(1)).alias("variants"),
        F.count_if(F.col("trade_count") >= min_trades).alias("rankable"),
        F.count_if(F.col("trade_count") < min_trades).alias("under_sampled"))
    return rows.crossJoin(variants)


def coverage_by_instrument(journal: DataFrame, summary: DataFrame, min_trades: int = MIN_TRADES) -> DataFrame:
    rows = journal.groupBy("instrument").agg(F.count("exit_reason").alias("rows"))
    trades = summary.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("variants"), F.median("trade_count").alias("median_trades"),
        F.max("trade_count").alias("max_trades"))
    return rows.join(trades, "instrument", "full_outer").withColumn("status", F.when(
        F.col("median_trades") < min_trades, "UNDER-SAMPLED").otherwise("ok")).orderBy("rows", "instrument")


def cost_provenance(market: Market, spark) -> DataFrame:
    """Per instrument: provenance and its session slippages as one label."""
    per = market.slippage_session_table(spark).groupBy("instrument").agg(
        F.concat_ws(", ", F.array_sort(F.collect_list(F.concat(
            "session", F.lit("="), F.format_string("%.2f", "slip_session"))))).alias("slippage_ticks"))
    return market.provenance_table(spark).join(per, "instrument", "left").withColumn(
        "slippage_ticks", F.coalesce("slippage_ticks", F.lit("(fallback)"))).orderBy("instrument")


def ranked_variants(summary: DataFrame, k: int = 20, best: bool = True, by: str = "expectancy_gross_r",
                    min_trades: int = MIN_TRADES) -> DataFrame:
    """Top or bottom ``k`` rankable variants; ties fall to the variant key."""
    order = F.desc(by) if best else F.asc(by)
    return summary.filter(F.col("trade_count") >= min_trades).orderBy(order, *VARIANT).limit(k)


def regime_stability(regime: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` variants whose window means vary least."""
    x = regime.groupBy(*VARIANT).agg(
        F.avg("expectancy_gross_r").alias("mean_r"), F.stddev_samp("expectancy_gross_r").alias("std_r"),
        F.min("expectancy_gross_r").alias("min_r"), F.max("expectancy_gross_r").alias("max_r"),
        F.count("expectancy_gross_r").alias("n_windows"))
    return x.orderBy(F.asc_nulls_last("std_r"), *VARIANT).limit(k)


def null_section(enriched: DataFrame) -> DataFrame:
    """One row of calibration numbers, per family where the statistic is a family's."""
    fams = enriched.groupBy(*FAMILY).agg(
        F.max("t_family_obs").alias("t"), F.max("p_adj_maxT").alias("p"), F.max("q_fdr").alias("q"),
        F.max("survivor").alias("survivor"), F.max("maxT_hurdle_95").alias("hurdle"),
        F.max("selection_adjusted_best_stat").alias("selection"))
    per_family = fams.agg(
        F.count(F.lit(1)).alias("families"), F.max("t").alias("best_stat"), F.min("p").alias("best_p"),
        F.count_if(F.col("p") <= 0.05).alias("fwer_families"),
        F.count_if(F.col("q") <= 0.10).alias("fdr_families"),
        F.count_if("survivor").alias("survivors"), F.max("hurdle").alias("hurdle_95"),
        F.max("selection").alias("selection_adjusted_best"))

    def lg(name: str):
        return F.log10(F.greatest(F.col(name), F.lit(1e-12)))

    per_variant = enriched.agg(
        F.count(F.lit(1)).alias("variants"),
        F.count_if(F.abs(lg("null_p_broad") - lg("null_p_matched")) > 1).alias("divergent_variants"),
        F.median("null_days_used").alias("median_days_used"),
        F.max("null_bootstrap_k").alias("bootstrap_draws"))
    return per_variant.crossJoin(per_family)


def verdict(comparison: DataFrame, families: DataFrame, rankable_families: DataFrame,
            survivors: DataFrame, ci: DataFrame, holdout_start: str) -> DataFrame:
    """The holdout verdict as one row; shares of no families are null."""
    fam = comparison.agg(
        F.count(F.lit(1)).alias("holdout_families_tested"),
        F.count_if(F.col("ho_net") > 0).alias("holdout_net_positive"),
        ratio(F.sum(F.col("ho_net") * F.col("ho_trades")), F.sum("ho_trades")).alias("holdout_trade_weighted_net_r"),
        F.avg("ho_net").alias("holdout_simple_mean_net_r"),
        F.sum("ho_trades").alias("holdout_trades_pooled"),
        F.median("ho_trades").alias("median_holdout_trades"))
    n_rank = rankable_families.agg(F.count(F.lit(1)).alias("families_rankable"))
    n_fam = families.agg(F.count(F.lit(1)).alias("survivor_families"))
    n_var = survivors.agg(F.count(F.lit(1)).alias("survivor_variants"))
    x = fam.crossJoin(n_rank).crossJoin(n_fam).crossJoin(n_var).crossJoin(ci)
    x = x.withColumns({
        "expected_fp_at_5pct": F.floor(F.col("families_rankable") * 5 / 100),
        "survivor_pct_of_families": ratio(F.col("survivor_families") * 100.0, F.col("families_rankable")),
        "holdout_net_positive_pct": ratio(F.col("holdout_net_positive") * 100.0, F.col("holdout_families_tested")),
        "ci_includes_zero": (F.col("ci_lo") <= 0) & (F.col("ci_hi") >= 0),
        "holdout_start": F.lit(holdout_start),
    })
    return x.withColumn("below_chance_rate", F.col("survivor_families") <= F.col("expected_fp_at_5pct")).withColumn(
        "verdict", F.when((F.col("holdout_trade_weighted_net_r") <= 0) | F.col("ci_includes_zero"),
                          "NO EDGE ESTABLISHED").otherwise("CANDIDATE EDGE -- requires forward testing"))
