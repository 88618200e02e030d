"""Round-trip costs: slippage resolution, commissions, cost in R."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.params import MAX_CONTRACTS, MAX_RISK_USD, Market


def with_slippage(df: DataFrame, market: Market) -> DataFrame:
    """Slippage ticks: (instrument, session) entry, else instrument entry, else the global one.

    The tables are constants of a few rows, so the planner broadcasts them by size.
    """
    spark = df.sparkSession
    return (
        df.join(market.slippage_session_table(spark), ["instrument", "session"], "left")
        .join(market.slippage_instrument_table(spark), ["instrument"], "left")
        .withColumn("slippage_ticks", F.coalesce(
            "slip_session", "slip_instrument", F.lit(float(market.slippage_global))))
        .drop("slip_session", "slip_instrument")
    )


def with_commission(df: DataFrame, market: Market, kind: str = "full") -> DataFrame:
    """Tick value and round-trip commission of one contract kind, with the default as fallback."""
    spark = df.sparkSession
    specs = market.spec_table(spark).filter(F.col("kind") == kind).select(
        "instrument", F.col("spec_commission").alias("_commission"))
    values = market.instrument_table(spark).select("instrument", "tick_value_usd")
    return (
        df.join(values, "instrument", "left").join(specs, "instrument", "left")
        .withColumn("commission_usd",
                    F.coalesce("_commission", F.lit(float(market.default_commission_usd))))
        .drop("_commission")
    )


def cost_in_r(cost_ticks: Column, r_ticks: Column) -> Column:
    return F.when(r_ticks > 0, cost_ticks / r_ticks).when(r_ticks <= 0, F.lit(0.0))


def with_costs(df: DataFrame, market: Market) -> DataFrame:
    """Adds slippage_ticks, tick_value_usd, commission_usd, cost_ticks and cost_r."""
    out = with_commission(with_slippage(df, market), market)
    out = out.withColumn(
        "cost_ticks", F.col("commission_usd") / F.col("tick_value_usd") + F.col("slippage_ticks"))
    return out.withColumn("cost_r", cost_in_r(F.col("cost_ticks"), F.col("r_ticks")))


def stop_limits(market_rows: DataFrame, max_risk_usd: float = MAX_RISK_USD,
                max_contracts: int = MAX_CONTRACTS) -> DataFrame:
    """Per instrument: widest stop at one contract, and the stop that uses the whole cap."""
    tv = F.col("tick_value_usd")
    return market_rows.select(
        "instrument",
        (F.lit(max_risk_usd) / tv).alias("max_stop_ticks"),
        (F.lit(max_risk_usd) / (tv * max_contracts)).alias("full_deploy_stop_ticks"),
    )


def cost_what_if(journal: DataFrame, market: Market, flat_slippage: float) -> DataFrame:
    """Net R under the session slippage table next to a flat one, from stored gross R."""
    out = with_costs(journal.drop("tick_value_usd", "commission_usd", "slippage_ticks",
                                  "cost_ticks", "cost_r"), market)
    r = F.when(F.col("r_ticks") != 0, F.col("r_ticks"))
    comm = F.col("commission_usd") / F.col("tick_value_usd")
    return (
        out.withColumn("cost_r_flat", (comm + F.lit(flat_slippage)) / r)
        .withColumn("cost_r_table", (comm + F.col("slippage_ticks")) / r)
        .withColumn("net_r_flat", F.col("gross_r") - F.col("cost_r_flat"))
        .withColumn("net_r_table", F.col("gross_r") - F.col("cost_r_table"))
    )
