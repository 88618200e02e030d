"""Exclusion rules marked on every journal row, and row selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.sizing import contracts_for
from barloom.params import (
    INVALID_REASONS, MAX_FRICTION_R, MIN_COMPLETENESS, MIN_EXECUTABLE_SL_TICKS,
    MIN_EXECUTABLE_TP_TICKS, MIN_TRADES,
)

# Rule flags in order.
RULES = (
    "excluded_invalid_exit",
    "excluded_unfillable_tp",
    "excluded_small_tp",
    "excluded_small_sl",
    "excluded_high_friction",
    "excluded_unaffordable",
    "excluded_roll_day",
    "excluded_incomplete_session",
)


def _needed(df: DataFrame, name: str, strict: bool) -> Column | None:
    if name in df.columns:
        return F.col(name)
    if strict:
        raise ValueError(f"eligibility needs column {name!r}")
    return None


def mark_eligibility(df: DataFrame, strict: bool = False) -> DataFrame:
    """Adds one flag per rule and ``eligible`` (no rule applies).

    A null value counts against the row, except for the unfillable and roll flags. A column that
    is absent altogether passes its rule, unless ``strict`` asks for an error.
    """
    get = lambda name: _needed(df, name, strict)
    never = F.lit(False)

    def unless(c: Column | None, rule) -> Column:
        return never if c is None else rule(c)

    contracts = get("contracts") if "contracts" in df.columns or not {
        "r_ticks", "tick_value_usd"} <= set(df.columns) else contracts_for(
        F.col("r_ticks"), F.col("tick_value_usd"))
    reason = get("exit_reason")
    rolls = [c for c in (get("contract_changed_in_session"),
                         get("contract_changed_since_prev_session")) if c is not None]
    rolled = never
    for c in rolls:
        rolled = rolled | F.coalesce(c, never)
    rules = {
        "excluded_invalid_exit": F.lit(True) if reason is None else
        reason.isNull() | reason.isin(*INVALID_REASONS),
        "excluded_unfillable_tp": unless(get("tp_unfillable"), lambda c: F.coalesce(c, never)),
        "excluded_small_tp": unless(get("tp_ticks"), lambda c: F.coalesce(
            c < MIN_EXECUTABLE_TP_TICKS, F.lit(True))),
        "excluded_small_sl": unless(get("r_ticks"), lambda c: F.coalesce(
            c < MIN_EXECUTABLE_SL_TICKS, F.lit(True))),
        "excluded_high_friction": unless(get("cost_r"), lambda c: F.coalesce(
            c > MAX_FRICTION_R, F.lit(True))),
        "excluded_unaffordable": unless(contracts, lambda c: F.coalesce(c <= 0, F.lit(True))),
        "excluded_roll_day": rolled,
        "excluded_incomplete_session": unless(get("session_bar_completeness"), lambda c: F.coalesce(
            c < MIN_COMPLETENESS, F.lit(True))),
    }
    out = df.withColumns(rules)
    blocked = F.col(RULES[0])
    for r in RULES[1:]:
        blocked = blocked | F.col(r)
    return out.withColumn("eligible", ~blocked)


def exclusion_counts(marked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows per rule; one row can count under several rules."""
    aggs = [F.count_if(F.col(r)).alias(f"n_{r}") for r in RULES]
    return marked.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("eligible").alias("n_eligible"), *aggs)


def fillable_trades(df: DataFrame) -> DataFrame:
    """The older selection: real exits with a fillable target and a return."""
    return df.filter(
        ~F.col("exit_reason").isin(*INVALID_REASONS)
        & ~F.coalesce("tp_unfillable", F.lit(False)) & F.col("gross_r").isNotNull())


def valid_exits(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("exit_reason").isin(*INVALID_REASONS))


def select_setups(df: DataFrame, setups: DataFrame) -> DataFrame:
    """Rows matching any row of a setup list, on the columns that list has."""
    return df.join(setups, setups.columns, "left_semi")


def rankable(summary: DataFrame, min_trades: int = MIN_TRADES) -> DataFrame:
    return summary.filter(F.col("trade_count") >= min_trades)


def duplicate_trades(df: DataFrame, keys: list[str], sample: int = 5) -> DataFrame:
    """A few (variant, date) keys that occur more than once; empty when the journal is sound."""
    return df.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("n_rows")).filter(
        "n_rows > 1").orderBy(F.desc("n_rows"), *keys, "date").limit(sample)


def assert_unique_trades(df: DataFrame, keys: list[str]) -> None:
    bad = duplicate_trades(df, keys).collect()
    if bad:
        raise AssertionError(f"duplicate variant-days: {[r.asDict() for r in bad]}")
