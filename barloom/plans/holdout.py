"""Survivor families, holdout aggregates and comparisons, candidate legs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import ratio, share
from barloom.operators.sizing import size_trades
from barloom.params import FAMILY, MIN_TRADES, SETUP, VARIANT


def survivors(summary: DataFrame, p: str = "null_p_value", min_trades: int = MIN_TRADES,
              alpha: float = 0.05) -> DataFrame:
    return summary.filter((F.col("trade_count") >= min_trades) & (F.col("expectancy_net_r") > 0)
                          & (F.col(p) < alpha))


def survivor_families(surv: DataFrame, p: str = "null_p_value") -> DataFrame:
    """Survivors per family: level count and list, best net, smallest p, most trades, best level."""
    levels = F.array_join(F.transform(F.array_sort(F.collect_list("rr")), lambda r: r.cast("string")), ",")
    return surv.groupBy(*FAMILY).agg(
        F.count(F.lit(1)).alias("n_rr"), levels.alias("rr_list"),
        F.max("expectancy_net_r").alias("best_net"), F.min(p).alias("min_p"),
        F.max("trade_count").alias("trades"),
        F.max_by("rr", F.struct("expectancy_net_r", -F.col("rr"))).alias("best_rr"))


def holdout_aggregate(eligible: DataFrame) -> DataFrame:
    return eligible.groupBy(*VARIANT).agg(
        F.count(F.lit(1)).alias("ho_trades"), F.avg("gross_r").alias("ho_gross"),
        F.avg("net_r").alias("ho_net"), share(F.col("gross_r") > 0).alias("ho_win"))


def compare_holdout(surv: DataFrame, holdout: DataFrame) -> DataFrame:
    """Survivors that traded in the holdout, with the change in net expectancy."""
    return surv.join(holdout, VARIANT, "left").filter(F.col("ho_net").isNotNull()).withColumns({
        "net_delta": F.col("ho_net") - F.col("expectancy_net_r"), "held_up": F.col("ho_net") > 0})


def best_per_family(compared: DataFrame) -> DataFrame:
    w = Window.partitionBy(*FAMILY).orderBy(F.desc("expectancy_net_r"), "rr")
    return compared.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def pooled_test(families: DataFrame) -> DataFrame:
    return families.agg(
        F.count(F.lit(1)).alias("families"), F.count_if(F.col("ho_net") > 0).alias("net_positive"),
        ratio(F.sum(F.col("ho_net") * F.col("ho_trades")), F.sum("ho_trades")).alias("weighted_net"),
        F.avg("ho_net").alias("simple_net"), F.sum("ho_trades").alias("trades"))


def candidate_legs(in_sample: DataFrame, holdout: DataFrame, candidates: DataFrame) -> DataFrame:
    """In-sample and holdout results of candidate setups, with long and short legs apart.

    ``held_up`` looks only at trades the budget can take. Both inputs need tick_value_usd.
    """
    def side(d: str):
        return F.avg(F.when(F.col("direction") == d, F.col("net_r")))

    ins = size_trades(in_sample).groupBy(*SETUP).agg(
        F.count(F.lit(1)).alias("is_trades"), F.sum("net_r").alias("is_net_r"),
        F.avg("net_r").alias("is_exp"), share(F.col("net_r") > 0).alias("is_win"),
        F.sum("pnl_usd").alias("is_usd"), side("long").alias("is_exp_long"), side("short").alias("is_exp_short"))
    afford = F.col("contracts") > 0
    out = size_trades(holdout).groupBy(*SETUP).agg(
        F.count(F.lit(1)).alias("ho_trades"), F.sum("net_r").alias("ho_net_r"),
        F.avg("net_r").alias("ho_exp"), share(F.col("net_r") > 0).alias("ho_win"),
        F.sum("pnl_usd").alias("ho_usd"), share(afford).alias("ho_afford"),
        F.count_if(afford).alias("ho_trades_aff"), F.avg(F.when(afford, F.col("net_r"))).alias("ho_exp_aff"))
    x = candidates.select(*SETUP).join(ins, SETUP).join(out, SETUP, "left")
    return x.fillna(0, ["ho_trades", "ho_trades_aff"]).withColumns({
        "held_up": F.col("ho_exp_aff") > 0, "held_up_all_trades": F.col("ho_exp") > 0,
        "leg_asym": F.abs(F.col("is_exp_long") - F.col("is_exp_short")),
        "one_leg_only": (F.coalesce(F.col("is_exp_long") > 0, F.lit(False))
                         != F.coalesce(F.col("is_exp_short") > 0, F.lit(False)))})


def leg_summary(legs: DataFrame) -> DataFrame:
    return legs.agg(
        F.count(F.lit(1)).alias("setups"), F.count_if("held_up").alias("held_up"),
        F.count("held_up").alias("judged"), F.median("leg_asym").alias("median_leg_gap"),
        F.count_if("one_leg_only").alias("one_leg_only"))
