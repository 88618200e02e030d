"""The wide journal: one row per event and reward:risk level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.barriers import label_barriers, with_returns
from barloom.operators.costs import with_costs
from barloom.operators.events import detect_signals, price_signals
from barloom.operators.sizing import contracts_for
from barloom.params import GridSpec, Market

# Journal columns in order.
JOURNAL_COLUMNS = [
    "regime_window", "window_start", "window_end", "date", "day_of_week", "instrument", "session",
    "range_minutes", "range_high", "range_low", "range_width_ticks",
    "entry_mode", "closure_tf", "direction", "entry_ts", "entry_source", "entry_contract",
    "entry_price", "breakout_idx", "tap_idx", "gap_fill", "fill_at_bar_close",
    "bars_from_open_to_entry",
    "sl_price", "sl_distance_ticks", "sl_bars_back", "sl_source",
    "rr", "tp_price", "r_ticks", "atr_4h", "tp_to_atr_ratio", "atr_exceeds_cap", "tp_ticks",
    "tp_unfillable",
    "exit_ts", "exit_price", "exit_reason", "bars_held",
    "gross_r", "gross_r_optimistic", "net_r", "cost_r", "gross_usd", "net_usd", "mae_r", "mfe_r",
    "same_bar_ambiguous", "contracts",
    "opp_broken_session", "opp_broken_pre_entry", "opp_broken_after_range",
    "opp_broken_after_range_pre_entry",
    "prev_close", "gap_ticks", "parkinson_vol_14d", "realized_vol_14d",
    "context_bars_available", "session_bar_completeness", "contract_changed_in_session",
    "contract_changed_since_prev_session", "pct_bars_from_local",
]


def build_journal(days: DataFrame, grid: GridSpec, market: Market,
                  windows: DataFrame | None = None) -> DataFrame:
    """Events of the day rows, labelled, costed and laid out as journal rows.

    Prices are given in price units next to tick distances. Only constant tables and the
    window list (a few rows per instrument) are joined; the event rows are never shuffled.
    """
    spark = days.sparkSession
    outcomes = label_barriers(price_signals(detect_signals(days, grid), grid), grid)
    x = with_returns(with_costs(outcomes, market), grid)
    ticks = market.instrument_table(spark).select("instrument", "tick_size")
    x = x.join(ticks, "instrument", "left")
    if "regime_window" not in x.columns:
        x = x.withColumn("regime_window", F.lit(None).cast("int"))
    if windows is not None:
        x = x.join(windows, ["instrument", "regime_window"], "left")
    else:
        x = x.withColumns({"window_start": F.lit(None).cast("date"),
                           "window_end": F.lit(None).cast("date")})
    is_long = F.col("direction") == "long"
    high_t = F.when(is_long, F.col("boundary")).otherwise(F.col("opposite"))
    low_t = F.when(is_long, F.col("opposite")).otherwise(F.col("boundary"))
    tick = F.col("tick_size")
    return x.withColumns({
        "date": F.col("local_date"),
        "day_of_week": F.date_format("local_date", "EEEE"),
        "range_high": high_t * tick, "range_low": low_t * tick,
        "range_width_ticks": high_t - low_t,
        "entry_price": F.col("fill_t") * tick, "sl_price": F.col("sl_t") * tick,
        "tp_price": F.col("tp_t") * tick, "exit_price": F.col("exit_t") * tick,
        "sl_distance_ticks": F.abs(F.col("fill_t") - F.col("sl_t")),
        "contracts": contracts_for(F.col("r_ticks"), F.col("tick_value_usd")),
        "context_bars_available": F.col("open_idx"),
        "session_bar_completeness": F.col("completeness"),
        "contract_changed_in_session": F.col("changed_in"),
        "contract_changed_since_prev_session": F.col("changed_since"),
        "pct_bars_from_local": F.col("pct_local"),
    }).select(*JOURNAL_COLUMNS)
