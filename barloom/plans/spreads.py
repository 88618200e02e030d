"""Spread statistics over quotes, and slippage tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import ratio, share
from barloom.operators.calendar import sessionize
from barloom.params import GridSpec
from barloom.sources.quotes import mark_spread, valid_quotes

# Valid spreads are whole ticks up to a fixed limit, so exact percentiles buffer few values.


def quote_quality(quotes: DataFrame) -> DataFrame:
    return mark_spread(quotes).groupBy("instrument").agg(
        F.count(F.lit(1)).alias("quotes"), F.count_if("valid").alias("valid_quotes"),
        F.count_if(~F.col("valid")).alias("bad_quotes"))


def session_quotes(quotes: DataFrame, grid: GridSpec, pairs: DataFrame | None = None) -> DataFrame:
    return sessionize(valid_quotes(quotes), grid, pairs, context=False).withColumn(
        "minute", F.col("wall") - F.col("open_min"))


def spread_by_session(quotes: DataFrame, grid: GridSpec, pairs: DataFrame | None = None) -> DataFrame:
    q = F.percentile("spread", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.95)))
    return session_quotes(quotes, grid, pairs).groupBy("instrument", "session").agg(
        F.count(F.lit(1)).alias("quotes"), q.alias("_q")).select(
        "instrument", "session", "quotes", F.col("_q")[0].alias("median"),
        F.col("_q")[1].alias("p75"), F.col("_q")[2].alias("p95"))


def spread_extremes(by_session: DataFrame, quotes: DataFrame) -> DataFrame:
    """Worst and best session median per instrument next to the all-hours median."""
    pooled = valid_quotes(quotes).groupBy("instrument").agg(F.median("spread").alias("all_hours_median"))
    return by_session.groupBy("instrument").agg(
        F.max("median").alias("worst_median"), F.min("median").alias("best_median"),
        F.max_by("session", F.struct("median", "session")).alias("worst_session")).join(pooled, "instrument")


def spread_by_minute(quotes: DataFrame, grid: GridSpec, pairs: DataFrame | None = None) -> DataFrame:
    return session_quotes(quotes, grid, pairs).groupBy("instrument", "session", "minute").agg(
        F.median("spread").alias("spread"))


def entry_weighted_spread(by_minute: DataFrame, entries: DataFrame) -> DataFrame:
    """Mean spread weighted by how often entries land in each minute that has quotes.

    ``entries`` has instrument, session, minute: one row per trade.
    """
    counts = entries.groupBy("instrument", "session", "minute").agg(F.count(F.lit(1)).alias("n"))
    pair = ["instrument", "session"]
    medians = by_minute.groupBy(*pair).agg(F.median("spread").alias("session_median"))
    weighted = by_minute.join(counts, [*pair, "minute"]).groupBy(*pair).agg(
        ratio(F.sum(F.col("spread") * F.col("n")), F.sum("n")).alias("entry_weighted"),
        F.sum("n").alias("n_trades"))
    x = weighted.join(medians, pair).withColumn(
        "ratio", ratio(F.col("entry_weighted"), F.col("session_median")))
    return x.withColumn("verdict", F.when(F.col("ratio") >= 1.15, "entries pay more")
                        .when(F.col("ratio") <= 0.87, "entries pay less").otherwise("representative"))


def entry_timing(valid: DataFrame, first_bars: int = 30) -> DataFrame:
    q = F.percentile("bars_from_open_to_entry", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return valid.groupBy("instrument", "session").agg(
        F.count("bars_from_open_to_entry").alias("n"), q.alias("_q"),
        (share(F.col("bars_from_open_to_entry") <= first_bars) * 100.0).alias("pct_first")).select(
        "instrument", "session", "n", F.col("_q")[0].alias("p10"), F.col("_q")[1].alias("p50"),
        F.col("_q")[2].alias("p90"), "pct_first")


def slippage_table(weighted: DataFrame) -> DataFrame:
    """Slippage ticks per pair, at least one tick, with the instrument's worst session."""
    x = weighted.withColumn("slippage_ticks", F.greatest(F.lit(1.0), F.bround("entry_weighted", 2)))
    worst = x.groupBy("instrument").agg(
        F.max("slippage_ticks").alias("instrument_slippage"),
        F.max_by("session", F.struct("slippage_ticks", "session")).alias("worst_session"))
    return x.select("instrument", "session", "slippage_ticks").join(worst, "instrument")
