"""Equity curves per setup and their statistics.

A setup's trades are chained chunk by chunk (one chunk per day), so a setup that owns a large
part of the journal still spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import ratio, share
from barloom.functions.scans import scan
from barloom.operators.sizing import size_trades
from barloom.params import MAX_RISK_USD, SETUP

ORDER = ["date", "entry_ts", "signal_id"]


def with_phase(in_sample: DataFrame, holdout: DataFrame) -> DataFrame:
    return in_sample.withColumn("phase", F.lit("in_sample")).unionByName(
        holdout.withColumn("phase", F.lit("holdout")), allowMissingColumns=True)


def equity_curve(trades: DataFrame, keys: list[str] = SETUP) -> DataFrame:
    """Trades in order with cumulative R, cumulative dollars and their running maxima."""
    x = size_trades(trades).withColumn("_day", F.col("date"))
    return scan(x, keys, "_day", ORDER, sums={
        "seq": F.lit(1).cast("bigint"), "cum_r": F.col("net_r"), "cum_usd": F.col("pnl_usd")},
        peaks={"peak_cum_r": "cum_r", "peak_cum_usd": "cum_usd"}).drop("_day")


def curve_stats(curve: DataFrame, keys: list[str] = SETUP, holdout_start: str | None = None) -> DataFrame:
    """Totals, drawdowns, stop quantiles, sizing use, and the part after ``holdout_start``."""
    late = F.col("date") >= F.lit(holdout_start).cast("date") if holdout_start else F.lit(False)
    ex = F.col("executable")
    return curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(ex).alias("trades_executable"),
        share(ex).alias("executable_pct"), share(F.col("net_r") > 0).alias("win_rate"),
        F.avg("net_r").alias("exp_net_r"), F.sum("net_r").alias("total_net_r"),
        F.sum("pnl_usd").alias("total_usd"),
        F.max(F.col("peak_cum_r") - F.col("cum_r")).alias("max_dd_r"),
        F.max(F.col("peak_cum_usd") - F.col("cum_usd")).alias("max_dd_usd"),
        F.median("r_ticks").alias("sl_med"), F.percentile("r_ticks", F.lit(0.1)).alias("sl_p10"),
        F.percentile("r_ticks", F.lit(0.9)).alias("sl_p90"), F.median("tp_ticks").alias("tp_med"),
        F.avg(F.when(ex, F.col("contracts"))).alias("mean_contracts"),
        (F.avg("risk_deployed_usd") / F.lit(MAX_RISK_USD)).alias("capital_eff"),
        F.count_if(late).alias("n_late"),
        F.coalesce(F.sum(F.when(late, F.col("net_r"))), F.lit(0.0)).alias("late_net_r"),
        F.coalesce(F.sum(F.when(late, F.col("pnl_usd"))), F.lit(0.0)).alias("late_usd"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        F.min(F.when(late, F.col("seq") - 1)).alias("late_idx"))


def thin_curve(curve: DataFrame, keys: list[str] = SETUP, points: int = 400) -> DataFrame:
    """Every k-th point of each curve, and always its last one."""
    size = curve.groupBy(*keys).agg(F.max("seq").alias("_n"))
    x = curve.join(size, keys)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / points))
    return x.filter(((F.col("seq") - 1) % step == 0) | (F.col("seq") == F.col("_n"))).select(
        *keys, (F.col("seq") - 1).alias("i"), "date", "cum_r", "cum_usd")


def setup_availability(requested: DataFrame, traded_pairs: DataFrame, trades: DataFrame) -> DataFrame:
    """Requested setups with the reason when a curve cannot be drawn."""
    counts = trades.groupBy(*requested.columns).agg(F.count(F.lit(1)).alias("trades"))
    pairs = traded_pairs.select("instrument", "session").distinct().withColumn("_listed", F.lit(True))
    x = requested.join(pairs, ["instrument", "session"], "left").join(counts, requested.columns, "left")
    return x.withColumn("trades", F.coalesce("trades", F.lit(0))).withColumn(
        "reason", F.when(F.col("_listed").isNull(), "not in the instrument universe")
        .when(F.col("trades") == 0, "no trades generated")).withColumn(
        "available", F.col("reason").isNull()).drop("_listed")


def recent_split(curve: DataFrame, recent_start: str, keys: list[str] = SETUP) -> DataFrame:
    """The same statistics over the full period and over the recent part."""
    recent = F.col("date") >= F.lit(recent_start).cast("date")
    periods = F.when(recent, F.array(F.lit("full"), F.lit("recent"))).otherwise(F.array(F.lit("full")))
    x = curve.withColumn("period", F.explode(periods))
    taken = F.col("executable")
    return x.groupBy(*keys, "period").agg(
        F.count(F.lit(1)).alias("trades"),
        F.coalesce(ratio(F.count_if(taken & (F.col("net_r") > 0)), F.count_if(taken)), F.lit(0.0)).alias("win_rate"),
        F.sum("pnl_usd").alias("total_usd"), F.min("date").alias("date_min"), F.max("date").alias("date_max"))
