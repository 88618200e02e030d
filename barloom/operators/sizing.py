"""Position sizing under a dollar budget and a contract cap, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.params import MAX_CONTRACTS, MAX_RISK_USD, Market


def _affordable(budget: Column, unit_risk: Column, cap: Column) -> Column:
    """Whole units of ``unit_risk`` inside ``budget``, between 0 and ``cap``."""
    units = F.when(unit_risk > 0, F.floor(budget / unit_risk)).otherwise(F.lit(0))
    return F.greatest(F.lit(0), F.least(units, cap)).cast("bigint")


def contracts_for(r_ticks: Column, tick_value: Column, max_risk_usd: float = MAX_RISK_USD,
                  max_contracts: int = MAX_CONTRACTS) -> Column:
    """Contracts the budget affords for a stop of ``r_ticks``; 0 means not executable."""
    return _affordable(F.lit(float(max_risk_usd)), r_ticks * tick_value, F.lit(max_contracts))


def size_trades(df: DataFrame, max_risk_usd: float = MAX_RISK_USD,
                max_contracts: int = MAX_CONTRACTS) -> DataFrame:
    """Adds risk per contract, contracts, executable, risk deployed, capital use and P&L."""
    unit = F.col("r_ticks") * F.col("tick_value_usd")
    return (
        df.withColumn("risk_per_contract_usd", unit)
        .withColumn("contracts", contracts_for(
            F.col("r_ticks"), F.col("tick_value_usd"), max_risk_usd, max_contracts))
        .withColumn("executable", F.col("contracts") > 0)
        .withColumn("risk_deployed_usd", F.col("risk_per_contract_usd") * F.col("contracts"))
        .withColumn("capital_efficiency", F.col("risk_deployed_usd") / F.lit(float(max_risk_usd)))
        .withColumn("pnl_usd", F.col("net_r") * F.col("risk_deployed_usd"))
    )


SIZING_MODES = ("full", "micro", "hybrid")


def with_specs(df: DataFrame, market: Market) -> DataFrame:
    """Full and micro contract terms side by side; instruments without both are dropped."""
    specs = market.spec_table(df.sparkSession)

    def side(kind: str, tag: str) -> DataFrame:
        return specs.filter(F.col("kind") == kind).select(
            "instrument", F.col("spec_tick_value").alias(f"tv_{tag}"),
            F.col("spec_commission").alias(f"fee_{tag}"))

    return df.join(side("full", "f"), "instrument").join(side("micro", "m"), "instrument")


def size_by_mode(df: DataFrame, market: Market, max_risk_usd: float = MAX_RISK_USD,
                 max_contracts: int = MAX_CONTRACTS) -> DataFrame:
    """One row per trade and sizing mode with counts, risk, commission and total tick value.

    ``hybrid`` takes full contracts first, then micros with the dollars and slots left over.
    """
    budget, cap = F.lit(float(max_risk_usd)), F.lit(max_contracts)
    risk_f, risk_m = F.col("r_ticks") * F.col("tv_f"), F.col("r_ticks") * F.col("tv_m")
    out = with_specs(df, market)
    out = out.withColumn("_full", _affordable(budget, risk_f, cap))
    out = out.withColumn("_micro_only", _affordable(budget, risk_m, cap))
    out = out.withColumn("_micro_rest", _affordable(
        budget - F.col("_full") * risk_f, risk_m, cap - F.col("_full")))
    zero = F.lit(0).cast("bigint")
    modes = F.array(
        F.struct(F.lit("full").alias("mode"), F.col("_full").alias("n_full"), zero.alias("n_micro")),
        F.struct(F.lit("micro").alias("mode"), zero.alias("n_full"), F.col("_micro_only").alias("n_micro")),
        F.struct(F.lit("hybrid").alias("mode"), F.col("_full").alias("n_full"),
                 F.col("_micro_rest").alias("n_micro")),
    )
    out = out.withColumn("_m", F.explode(modes)).select("*", "_m.*").drop(
        "_m", "_full", "_micro_only", "_micro_rest", "commission_usd")
    n_f, n_m = F.col("n_full"), F.col("n_micro")
    return (
        out.withColumn("risk_usd", n_f * risk_f + n_m * risk_m)
        .withColumn("commission_usd", n_f * F.col("fee_f") + n_m * F.col("fee_m"))
        .withColumn("tick_value_total", n_f * F.col("tv_f") + n_m * F.col("tv_m"))
        .drop("tv_f", "tv_m", "fee_f", "fee_m")
    )


def reprice(df: DataFrame) -> DataFrame:
    """Dollar P&L of sized rows: gross R × risk − commission − slippage; 0 when not taken."""
    taken = F.col("risk_usd") > 0
    pnl = (F.col("gross_r") * F.col("risk_usd") - F.col("commission_usd")
           - F.col("slippage_ticks") * F.col("tick_value_total"))
    return (
        df.withColumn("taken", taken)
        .withColumn("pnl_usd", F.when(taken, pnl).otherwise(F.lit(0.0)))
        .withColumn("repriced_net_r", F.when(taken, pnl / F.col("risk_usd")).otherwise(F.lit(0.0)))
    )
