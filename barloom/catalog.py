"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Inputs are the bar, daily, quote and outcome views of ``sources.views``. Doubles are rounded to
six places at the very end, for comparison with other engines; tables keep full precision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.rng import draw, stable_seed
from barloom.operators import bars as B
from barloom.operators import calendar as C
from barloom.operators import controls as K
from barloom.operators import eligibility as H
from barloom.operators import metrics as J
from barloom.operators import multiplicity as MT
from barloom.operators import resample as R
from barloom.operators.barriers import label_barriers
from barloom.operators.costs import cost_what_if, with_costs
from barloom.operators.events import build_days, detect_signals, price_signals
from barloom.operators.journal import build_journal
from barloom.operators.session_days import opening_ranges, session_bars, session_quality
from barloom.operators.sizing import size_by_mode, size_trades
from barloom.params import FAMILY, INVALID_REASONS, RR_LEVELS, SETUP, VARIANT, inline_table
from barloom.plans import carry
from barloom.plans import diagnostics as M
from barloom.plans import equity as EQ
from barloom.plans import holdout as HO
from barloom.plans import report as L
from barloom.plans import setups as N
from barloom.plans import spreads as SP
from barloom.plans.inference import NullSpec, control_pools, enrich_summary, null_vectors
from barloom.plans.load import clean_bars
from barloom.session import cut
from barloom.sources.bars import only_configured_rolls, roll_tag
from barloom.sources.quotes import launched_months
from barloom.sources.views import (
    EVENT_GRID, EVENT_MARKET, ORDER_MARKET, event_bars, event_quotes, order_outcomes, shipment_daily,
)

# Parameters of the registered queries, sized for sparse tables.
MIN_N = 10
HOLDOUT = "2000-01-01"
CI_DRAWS = 1000
IID_DRAWS = 10_000
SPEC = NullSpec()
ROW_SPEC = NullSpec(draws=1000)  # for the two queries whose rows are the draws themselves
SAMPLE_TARGET = 200
POOL_DAYS = 20  # of the days of an event pair, so that the sample is stratified and not exhausted

QUERIES: dict = {}


def _six_places(c):
    """Half-up at six places in plain double arithmetic. The first step, at nine places, removes
    summation noise, so values that end in an exact half do not depend on the order of addition."""
    return F.floor(F.floor(c * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6


def _tidy(df: DataFrame) -> DataFrame:
    return df.select(*[
        _six_places(F.col(f"`{n}`")).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: _tidy(fn(spark, sf_dir))
    return fn


# --- shared inputs ---------------------------------------------------------------------------

def _days(spark: SparkSession, d: str) -> DataFrame:
    return build_days(event_bars(spark, d), EVENT_GRID)


def _signals(spark, d):
    return price_signals(detect_signals(_days(spark, d), EVENT_GRID), EVENT_GRID)


def _event_journal(spark, d, days=None):
    return build_journal(days if days is not None else _days(spark, d), EVENT_GRID, EVENT_MARKET)


def _marked(spark, d):
    return H.mark_eligibility(order_outcomes(spark, d))


def _context_bars(spark, d):
    """Event bars with volatility, previous close and daily features."""
    b = event_bars(spark, d)
    return B.enrich_bars(B.attach_atr(b), B.daily_from_bars(b))


def _eligible(spark, d):
    return _marked(spark, d).filter("eligible")


def _summary(spark, d):
    return J.variant_summary(_marked(spark, d))


def _valid(spark, d):
    return H.valid_exits(order_outcomes(spark, d))


POOL = ["instrument", "session", "rr"]


def _pool_days(spark, d, keys=None):
    """Control days of the order view: all eligible trades of a pair and level, by day."""
    return _eligible(spark, d).groupBy(*(keys or POOL), "date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("net_r").alias("total"))


def _fired_days(spark, d):
    """The same pools, only on the dates the family traded."""
    e = _eligible(spark, d)
    traded = e.select(*FAMILY, "date").distinct()
    return _pool_days(spark, d).join(traded, ["instrument", "session", "date"])


def _order_vectors(spark, d, summary=None, spec=SPEC):
    s = summary if summary is not None else _summary(spark, d)
    return null_vectors(s, _pool_days(spark, d), POOL, spec, "joint-bootstrap")


def _with_p(spark, d):
    """Summary with a Monte-Carlo p-value column."""
    s = _summary(spark, d)
    p = R.vector_stats(_order_vectors(spark, d, s), VARIANT, s, "expectancy_net_r")
    return s.join(p.select(*VARIANT, F.col("p_value").alias("null_p_value")), VARIANT, "left")


def _enriched(spark, d):
    return enrich_summary(_summary(spark, d), _pool_days(spark, d), _fired_days(spark, d), SPEC,
                          POOL, [*FAMILY, "rr"])


def _null_t(spark, d, spec=SPEC):
    s = cut(_summary(spark, d))
    vectors = cut(_order_vectors(spark, d, s, spec))
    return MT.studentise(vectors, R.vector_stats(vectors, VARIANT), s, VARIANT, "expectancy_net_r")


# --- A, B: sources and calendar --------------------------------------------------------------

@query
def event_hour_bars(spark, d):
    return event_bars(spark, d)


@query
def shipment_daily_bars(spark, d):
    return shipment_daily(spark, d)


@query
def quote_quality(spark, d):
    return SP.quote_quality(event_quotes(spark, d))


@query
def launched_quote_months(spark, d):
    months = event_quotes(spark, d).select(F.trunc("ts", "MM").alias("month")).distinct()
    late = inline_table(spark, ["instrument", "data_start"], [
        ("click", "2024-01-01"), ("view", "2024-02-15"), ("error", "2024-01-20"), ("signup", "2024-02-01"),
    ]).withColumn("data_start", F.to_date("data_start"))
    return launched_months(months, late)


@query
def session_bar_index(spark, d):
    sb = session_bars(event_bars(spark, d), EVENT_GRID)
    return sb.select("instrument", "session", "local_date", "ts", "wall", "idx", "in_bars", "completeness")


@query
def opening_range_rows(spark, d):
    return opening_ranges(session_bars(event_bars(spark, d), EVENT_GRID), EVENT_GRID)


@query
def session_day_quality(spark, d):
    bars = B.enrich_bars(event_bars(spark, d), B.daily_from_bars(event_bars(spark, d)))
    days = build_days(bars, EVENT_GRID)
    return session_quality(days).drop("atr_4h", "parkinson_vol_14d", "realized_vol_14d")


@query
def range_completeness(spark, d):
    return M.range_completeness(event_bars(spark, d), EVENT_GRID)


def _daily_span(spark, d):
    return shipment_daily(spark, d).groupBy("instrument").agg(
        F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"))


@query
def regime_window_list(spark, d):
    return C.regime_windows(_daily_span(spark, d))


@query
def windowed_bar_counts(spark, d):
    daily = shipment_daily(spark, d).withColumn("ts", F.col("trading_date").cast("timestamp_ntz"))
    return C.in_windows(daily, C.regime_windows(_daily_span(spark, d))).groupBy(
        "instrument", "regime_window").agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"))


@query
def span_and_density(spark, d):
    return C.span_and_density(event_bars(spark, d))


@query
def bars_by_year_hour(spark, d):
    return C.bars_by_year_hour(event_bars(spark, d))


@query
def calendar_labels(spark, d):
    return C.with_labels(order_outcomes(spark, d)).groupBy("day_of_week", "month", "year").agg(
        F.count(F.lit(1)).alias("trades"))


@query
def holdout_bar_counts(spark, d):
    return C.holdout(event_bars(spark, d), "2024-01-20").groupBy("instrument").agg(
        F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"))


# --- C: bars and volatility ------------------------------------------------------------------

def _two_vendors(spark, d):
    """Event bars plus a second vendor's copy of every third hour, with shifted closes."""
    b = event_bars(spark, d).withColumn("source", F.lit("databento"))
    copy = b.filter(F.hour("ts") % 3 == 0).withColumn("source", F.lit("local")).withColumn(
        "c", F.col("c") + F.hour("ts") + 1)
    again = b.filter(F.hour("ts") % 5 == 0).withColumn("ingest_seq", F.col("ingest_seq") + 1000000).withColumn(
        "volume", F.col("volume") + 7)
    return b.unionByName(copy).unionByName(again)


@query
def bars_dedup(spark, d):
    return B.dedup_bars(_two_vendors(spark, d))


@query
def bars_ingested(spark, d):
    """The bars of both vendors as a store hands them out, through roll filter, reader, merge and contract fill.
    One vendor holds an instrument under another roll rule, and every fourth hour has no contract."""
    both = _two_vendors(spark, d)
    inst = EVENT_MARKET.instrument_table(spark)
    rolls = inst.select("instrument", roll_tag(F.col("continuous_symbol")).alias("roll"))
    stale = (F.col("source") == "local") & (F.col("instrument") == "view")
    raw = both.join(rolls, "instrument").select(
        "instrument", F.col("ts").alias("timestamp"),
        *[(F.col(c) * 0.01).alias(n) for c, n in zip("ohlc", ("open", "high", "low", "close"))], "volume",
        F.when(F.hour("ts") % 4 != 0, F.col("contract")).alias("_contract"), F.lit(None).cast("string").alias("_source"),
        "ingest_seq", F.when(stale, "c").otherwise(F.col("roll")).alias("roll"), F.col("source").alias("vendor"))
    return clean_bars(only_configured_rolls(raw, inst), inst)


@query
def overlap_report(spark, d):
    return B.overlap_report(_two_vendors(spark, d))


def _spliced(spark, d):
    daily = shipment_daily(spark, d)
    return daily.select("instrument", F.col("trading_date").cast("timestamp_ntz").alias("ts"),
                        "o", "h", "l", "c", "volume", "source")


@query
def source_splices(spark, d):
    return B.source_splices(_spliced(spark, d))


@query
def splice_report(spark, d):
    half = event_bars(spark, d).withColumn(
        "source", F.when(F.dayofmonth("ts") < 15, "local").otherwise("databento"))
    return B.splice_report(half, days_each_side=6).withColumnRenamed("date", "day")


@query
def contract_fill(spark, d):
    gaps = event_bars(spark, d).withColumn(
        "contract", F.when(F.hour("ts") % 4 != 0, F.col("contract")))
    return B.fill_contract(gaps).select("instrument", "ts", "contract")


@query
def abs_returns(spark, d):
    return B.with_abs_return(event_bars(spark, d)).select("instrument", "ts", "abs_return")


@query
def atr_wilder(spark, d):
    return B.wilder_atr(B.four_hour_bars(event_bars(spark, d))).select(
        "instrument", "bin", "o", "h", "l", "c", "tr", "atr", "atr_prev")


@query
def atr_attached(spark, d):
    return B.attach_atr(event_bars(spark, d)).select("instrument", "ts", "atr_4h")


@query
def daily_volatility(spark, d):
    return B.daily_features(shipment_daily(spark, d)).select(
        "instrument", "trading_date", "prev_close", "range_ticks", "parkinson_vol_14d", "realized_vol_14d")


@query
def bars_enriched(spark, d):
    b = event_bars(spark, d)
    return B.enrich_bars(b, B.daily_from_bars(b)).select(
        "instrument", "ts", "prev_close", "parkinson_vol_14d", "realized_vol_14d")


@query
def contract_composition(spark, d):
    return B.contract_composition(event_bars(spark, d))


@query
def contract_counts(spark, d):
    return B.contract_counts(event_bars(spark, d))


# --- E, F, G: events, barriers, journal ------------------------------------------------------

EVENT_COLUMNS = ["instrument", "session", "local_date", "range_minutes", "entry_mode", "closure_tf",
                 "direction", "entry_idx", "breakout_idx", "tap_idx", "fill_t", "gap_fill", "entry_ts"]


def _mode(mode):
    def run(spark, d):
        return _signals(spark, d).filter(F.col("entry_mode") == mode).select(*EVENT_COLUMNS)
    return run


for _name, _m in (("breakouts", "II"), ("closes_confirmed", "CC"), ("tap_ins", "TI"),
                  ("rebreakouts", "R-II"), ("recloses", "R-CC")):
    _fn = _mode(_m)
    _fn.__name__ = _name
    query(_fn)


EVENT_ID = ["instrument", "session", "local_date", "range_minutes", "entry_mode", "closure_tf", "direction"]


@query
def swing_stops(spark, d):
    return _signals(spark, d).select(*EVENT_ID, "sl_t", "sl_bars_back", "sl_source")


@query
def opposite_boundary(spark, d):
    return _signals(spark, d).select(
        *EVENT_ID, "bars_from_open_to_entry", "opp_broken_session", "opp_broken_pre_entry",
        "opp_broken_after_range", "opp_broken_after_range_pre_entry")


@query
def barrier_outcomes(spark, d):
    return label_barriers(_signals(spark, d), EVENT_GRID).select(
        *EVENT_ID, "rr", "r_ticks", "exit_reason", "exit_idx", "exit_t", "exit_ts", "bars_held",
        "gross_r", "gross_r_optimistic", "same_bar_ambiguous", "tp_ticks", "tp_unfillable")


@query
def barrier_excursions(spark, d):
    return label_barriers(_signals(spark, d), EVENT_GRID).select(*EVENT_ID, "rr", "mae_r", "mfe_r")


@query
def breakout_hit_rate(spark, d):
    """How often does a first breakout reach its 1R target before its stop?"""
    out = label_barriers(_signals(spark, d).filter("entry_mode = 'II'"), EVENT_GRID.with_(rr_levels=(1.0,)))
    return out.groupBy("instrument", "session", "range_minutes", "direction").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("exit_reason") == "TP").alias("targets"),
        F.count_if(F.col("exit_reason") == "SL").alias("stops"),
        F.avg(F.when(F.col("exit_reason") == "TP", 1.0).otherwise(0.0)).alias("hit_rate"),
        F.avg("gross_r").alias("mean_gross_r"))


@query
def journal_rows(spark, d):
    j = _event_journal(spark, d)
    return j.select(
        "date", "day_of_week", "instrument", "session", "range_minutes", "range_high", "range_low",
        "range_width_ticks", "entry_mode", "closure_tf", "direction", "entry_ts", "entry_source",
        "entry_contract", "entry_price", "sl_price", "rr", "r_ticks", "exit_ts", "exit_price", "exit_reason",
        "net_r", "cost_r", "net_usd", "contracts", "session_bar_completeness",
        "contract_changed_in_session", "contract_changed_since_prev_session", "pct_bars_from_local")


@query
def journal_context(spark, d):
    """The context columns of the journal: volatility and previous close at the open, and the target against the volatility."""
    j = build_journal(build_days(_context_bars(spark, d), EVENT_GRID), EVENT_GRID, EVENT_MARKET)
    return j.select("date", "instrument", "session", "range_minutes", "entry_mode", "closure_tf", "direction", "rr", "atr_4h",
                    "tp_to_atr_ratio", "atr_exceeds_cap", "prev_close", "gap_ticks", "parkinson_vol_14d", "realized_vol_14d",
                    "context_bars_available", "gross_usd", "mae_r", "mfe_r", "tp_price", "sl_distance_ticks", "fill_at_bar_close")


BAR_HOLDOUT = "2024-01-20"


@query
def holdout_from_bars(spark, d):
    """Holdout bars to variant results. The run knows the history only from the state that the in-sample run left."""
    b = event_bars(spark, d)
    state = {k: cut(v) for k, v in carry.run_state(b, BAR_HOLDOUT, EVENT_GRID).items()}
    days = carry.later_days(C.holdout(b, BAR_HOLDOUT), state, BAR_HOLDOUT, EVENT_GRID)
    marked = H.mark_eligibility(_event_journal(spark, d, days), strict=True).filter("eligible")
    context = marked.groupBy(*VARIANT).agg(
        F.count_if("atr_exceeds_cap").alias("capped"), F.avg("tp_to_atr_ratio").alias("tp_to_atr"), F.sum("gap_ticks").alias("gap_ticks"),
        F.avg("realized_vol_14d").alias("realized_vol"), F.avg("parkinson_vol_14d").alias("parkinson_vol"))
    return HO.holdout_aggregate(marked).join(context, VARIANT)


@query
def event_journal_summary(spark, d):
    """Bars to variant metrics in one plan."""
    return J.variant_summary(H.mark_eligibility(_event_journal(spark, d), strict=True)).select(
        *VARIANT, "trade_count", "win_rate", "expectancy_gross_r", "expectancy_net_r", "max_drawdown_r",
        "n_distinct_days", "avg_mae_r", "avg_mfe_r", *[f"n_{r}" for r in H.RULES])


# --- H, I: eligibility, costs, sizing --------------------------------------------------------

@query
def eligibility_counts(spark, d):
    return H.exclusion_counts(_marked(spark, d), ["instrument", "session"])


@query
def eligibility_rows(spark, d):
    return _marked(spark, d).select("signal_id", *H.RULES, "eligible")


@query
def fillable_counts(spark, d):
    return H.fillable_trades(order_outcomes(spark, d)).groupBy("instrument", "exit_reason").agg(
        F.count(F.lit(1)).alias("trades"))


@query
def selected_setups(spark, d):
    wanted = inline_table(spark, SETUP, [
        ("ES", "NY", 15, "CC", 5, 2.0), ("ES", "NY", 15, "CC", 5, 1.5), ("CL", "NY", 15, "TI", 1, 1.5),
        ("6E", "LDN", 15, "II", 1, 0.25), ("NQ", "LDN", 15, "CC", 5, 0.5)])
    return H.select_setups(order_outcomes(spark, d), wanted).select("signal_id", *SETUP, "gross_r")


@query
def duplicate_trades(spark, d):
    return H.duplicate_trades(order_outcomes(spark, d), VARIANT)


@query
def cost_columns(spark, d):
    return order_outcomes(spark, d).select(
        "signal_id", "slippage_ticks", "commission_usd", "cost_ticks", "cost_r", "net_r")


@query
def sized_trades(spark, d):
    return size_trades(order_outcomes(spark, d)).select(
        "signal_id", "risk_per_contract_usd", "contracts", "executable", "risk_deployed_usd",
        "capital_efficiency", "pnl_usd")


@query
def sizing_modes(spark, d):
    return size_by_mode(order_outcomes(spark, d), ORDER_MARKET).select(
        "signal_id", "mode", "n_full", "n_micro", "risk_usd", "commission_usd", "tick_value_total")


@query
def repriced_modes(spark, d):
    return N.reprice_setups(H.fillable_trades(order_outcomes(spark, d)), ORDER_MARKET, MIN_N)


@query
def stop_limits(spark, d):
    """Widest affordable stops next to the stops each instrument really used."""
    from barloom.operators.costs import stop_limits as limits
    used = order_outcomes(spark, d).groupBy("instrument").agg(
        F.max("r_ticks").alias("widest_stop"), F.min("r_ticks").alias("tightest_stop"))
    return used.join(limits(ORDER_MARKET.instrument_table(spark)), "instrument")


@query
def cost_what_if_by_instrument(spark, d):
    return cost_what_if(_valid(spark, d), ORDER_MARKET, 1.0).groupBy("instrument").agg(
        F.count(F.lit(1)).alias("trades"), F.avg("net_r_flat").alias("net_flat"),
        F.avg("net_r_table").alias("net_table"),
        F.max(F.abs(F.col("net_r_table") - F.col("net_r"))).alias("max_abs_diff"))


# --- J: metrics ------------------------------------------------------------------------------

@query
def variant_summary(spark, d):
    return _summary(spark, d)


@query
def regime_summary(spark, d):
    return J.regime_summary(_marked(spark, d))


@query
def clustered_t(spark, d):
    return J.variant_summary(_marked(spark, d), ["instrument", "session", "rr"]).select(
        "instrument", "session", "rr", "trade_count", "expectancy_net_r", "t_cluster_net")


@query
def drawdowns(spark, d):
    return J.drawdowns(_eligible(spark, d), SETUP)


@query
def losing_streaks(spark, d):
    return J.losing_streaks(_eligible(spark, d), ["instrument", "session"])


@query
def breadth(spark, d):
    return J.variant_summary(_marked(spark, d), ["instrument", "session", "entry_mode"]).select(
        "instrument", "session", "entry_mode", "n_distinct_days", "top1_day_pnl_share", "top5pct_day_pnl_share",
        "pnl_share_from_single_month", "n_windows_positive", "n_windows_observed", "worst_window_expectancy",
        "frac_days_traded", "median_daily_r", "mean_daily_r")


# --- L: report -------------------------------------------------------------------------------

@query
def headline_counts(spark, d):
    return L.headline_counts(_marked(spark, d), _summary(spark, d), MIN_N)


@query
def coverage_by_instrument(spark, d):
    return L.coverage_by_instrument(order_outcomes(spark, d), _summary(spark, d), MIN_N)


@query
def cost_provenance(spark, d):
    """Provenance labels of the instruments that traded, with their row counts."""
    rows = order_outcomes(spark, d).groupBy("instrument").agg(F.count(F.lit(1)).alias("rows"))
    return L.cost_provenance(ORDER_MARKET, spark).join(rows, "instrument")


@query
def top_variants(spark, d):
    return L.ranked_variants(_summary(spark, d), min_trades=MIN_N).select(
        *VARIANT, "trade_count", "expectancy_gross_r")


@query
def bottom_variants(spark, d):
    return L.ranked_variants(_summary(spark, d), best=False, min_trades=MIN_N).select(
        *VARIANT, "trade_count", "expectancy_gross_r")


@query
def regime_stability(spark, d):
    return L.regime_stability(J.regime_summary(_marked(spark, d)).withColumn(
        "expectancy_gross_r", F.round("expectancy_gross_r", 9)))


@query
def null_section(spark, d):
    enriched, _ = _enriched(spark, d)
    return L.null_section(enriched)


@query
def max_null_histogram(spark, d):
    null_t, obs = _null_t(spark, d)
    return MT.max_null_histogram(MT.family_rollup(null_t, obs, FAMILY)[0], bins=10)


# --- M: diagnostics --------------------------------------------------------------------------

@query
def trade_distribution(spark, d):
    return M.trade_distribution(_summary(spark, d))


@query
def sample_thresholds(spark, d):
    return M.sample_thresholds(_summary(spark, d))


REASONS = ("TP", "SL", "TIME", "SL_WRONG_SIDE", "DEGENERATE_R")


@query
def exit_mix_pivot(spark, d):
    return M.exit_mix(order_outcomes(spark, d), REASONS)


@query
def event_exit_mix(spark, d):
    return M.exit_mix(_event_journal(spark, d), ("TP", "SL", "TIME", "NO_HOLD_BARS"))


@query
def rows_by_session(spark, d):
    return M.rows_by_session(order_outcomes(spark, d), ("NY", "LDN"))


@query
def day_coverage(spark, d):
    return M.coverage_by_mode(M.family_coverage(_valid(spark, d)))


@query
def day_coverage_bands(spark, d):
    return M.coverage_bands(M.family_coverage(_valid(spark, d)))


@query
def event_day_coverage(spark, d):
    return M.family_coverage(H.valid_exits(_event_journal(spark, d)))


@query
def traded_day_contrast(spark, d):
    return M.traded_day_contrast(_valid(spark, d))


@query
def coverage_verdict(spark, d):
    return M.coverage_verdict(M.traded_day_contrast(_valid(spark, d)))


@query
def p_by_rr(spark, d):
    return M.p_by_rr(_with_p(spark, d), min_trades=MIN_N)


@query
def self_consistency(spark, d):
    return M.self_consistency(_valid(spark, d), MIN_N)


@query
def self_p_by_rr(spark, d):
    return M.self_p_by_rr(M.self_consistency(_valid(spark, d), MIN_N))


@query
def p_correlations(spark, d):
    return M.p_correlations(M.self_consistency(_valid(spark, d), MIN_N), _with_p(spark, d))


@query
def stop_distribution(spark, d):
    return M.stop_distribution(_valid(spark, d), ["instrument"])


@query
def mode_stop_profile(spark, d):
    return M.stop_distribution(_valid(spark, d).filter("instrument = 'CL'"), ["instrument", "entry_mode"])


@query
def unfillable_rates(spark, d):
    return M.unfillable_rates(_valid(spark, d))


@query
def unfillable_pivot(spark, d):
    return M.unfillable_pivot(_valid(spark, d), RR_LEVELS)


@query
def net_drag(spark, d):
    return M.net_drag(_summary(spark, d), MIN_N)


@query
def net_positive_top(spark, d):
    return M.net_positive_top(_summary(spark, d), min_trades=MIN_N).select(
        *VARIANT, "trade_count", "expectancy_net_r")


@query
def excluding_unfillable(spark, d):
    return M.excluding_unfillable(_valid(spark, d))


@query
def exclusion_deltas(spark, d):
    return M.exclusion_delta_by_instrument(M.excluding_unfillable(_valid(spark, d)))


@query
def describe_p(spark, d):
    return M.describe_p(_with_p(spark, d), floor=0.05, min_trades=MIN_N)


@query
def significance_flips(spark, d):
    return M.significance_flips(_with_p(spark, d), min_trades=MIN_N)


@query
def old_vs_new(spark, d):
    return M.old_vs_new(cost_what_if(_valid(spark, d), ORDER_MARKET, 1.0), MIN_N)


@query
def spread_by_session(spark, d):
    return SP.spread_by_session(event_quotes(spark, d), EVENT_GRID)


@query
def spread_extremes(spark, d):
    q = event_quotes(spark, d)
    return SP.spread_extremes(SP.spread_by_session(q, EVENT_GRID), q)


@query
def spread_by_minute(spark, d):
    return SP.spread_by_minute(event_quotes(spark, d), EVENT_GRID)


def _entry_weighted(spark, d):
    """Entry minutes of the event journal (rr = 1) against quote minutes, by hour slot."""
    quotes = SP.session_quotes(event_quotes(spark, d), EVENT_GRID)
    by_slot = quotes.groupBy("instrument", "session", (F.floor(F.col("minute") / 60)).alias("minute")).agg(
        F.median("spread").alias("spread"))
    entries = _signals(spark, d).select(
        "instrument", "session", F.col("bars_from_open_to_entry").cast("bigint").alias("minute"))
    return SP.entry_weighted_spread(by_slot, entries)


@query
def spread_entry_weighted(spark, d):
    return _entry_weighted(spark, d)


@query
def slippage_rebuild(spark, d):
    return SP.slippage_table(_entry_weighted(spark, d))


@query
def entry_timing(spark, d):
    return SP.entry_timing(_valid(spark, d))


@query
def roll_ratios(spark, d):
    """Two roll series of the order view: status P as the base series, the others against it."""
    rows = order_outcomes(spark, d).select(
        "instrument", F.col("date").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("entry_mode") == "TI", "c").otherwise("v").alias("roll"))
    return M.roll_ratios(rows)


# --- N: setups, holdout, equity --------------------------------------------------------------

def _gated(spark, d):
    return N.gate_setups(N.setup_metrics(_eligible(spark, d), ORDER_MARKET), MIN_N)


@query
def setup_metrics(spark, d):
    return N.setup_metrics(_eligible(spark, d), ORDER_MARKET)


@query
def setup_gates(spark, d):
    return _gated(spark, d).select(*SETUP, *N.GATES, "n_gates_failed", "tradable")


@query
def setup_score(spark, d):
    return N.score_setups(_gated(spark, d)).select(
        *SETUP, "scoreable", "pct_pnl", "pct_wr", "pct_cap", "score")


@query
def gate_attrition(spark, d):
    return N.gate_attrition(_gated(spark, d))


@query
def by_asset_class(spark, d):
    return N.by_asset_class(_gated(spark, d))


@query
def setups_by_rr(spark, d):
    return N.by_rr(_gated(spark, d).filter("tradable"))


@query
def spearman(spark, d):
    return N.spearman(_gated(spark, d), "win_rate", "capital_eff")


@query
def pareto(spark, d):
    x = cut(_gated(spark, d).withColumn("total_pnl_usd", F.round("total_pnl_usd", 8)))
    return N.pareto_frontier(x).select(*SETUP, *N.PARETO_AXES)


@query
def top_setups(spark, d):
    x = _gated(spark, d).withColumn("total_pnl_usd", F.round("total_pnl_usd", 8))
    return N.top_setups(x, "total_pnl_usd", 25, MIN_N).select(*SETUP, "trades", "total_pnl_usd")


def _repriced(spark, d):
    return N.reprice_setups(H.fillable_trades(order_outcomes(spark, d)), ORDER_MARKET, MIN_N)


@query
def best_sizing_mode(spark, d):
    x = _repriced(spark, d).withColumn("total_pnl_usd", F.round("total_pnl_usd", 8))
    return N.best_mode(x).select(*SETUP, "mode", "total_pnl_usd")


@query
def population_shift(spark, d):
    return N.population_shift(_repriced(spark, d))


def _split(spark, d):
    o = _marked(spark, d)
    cut_day = F.lit(HOLDOUT).cast("date")
    return o.filter(F.col("date") < cut_day), o.filter(F.col("date") >= cut_day)


def _survivors(spark, d):
    """Survivors of the in-sample part at a loose level, so that sparse tables have some. The rows, at most one a variant, have
    several readers, so they are written once instead of planned again for each."""
    ins, _ = _split(spark, d)
    s = cut(J.variant_summary(ins))
    pool = ins.filter("eligible").groupBy(*POOL, "date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("net_r").alias("total"))
    vectors = null_vectors(s, pool, POOL, SPEC, "joint-bootstrap")
    p = R.vector_stats(vectors, VARIANT, s, "expectancy_net_r").select(*VARIANT, F.col("p_value").alias("null_p_value"))
    return cut(HO.survivors(s.join(p, VARIANT, "left"), min_trades=3, alpha=0.5)), s


def _compared(spark, d):
    surv, s = _survivors(spark, d)
    _, out = _split(spark, d)
    return HO.compare_holdout(surv, HO.holdout_aggregate(out.filter("eligible"))), surv, s


@query
def survivor_families(spark, d):
    return HO.survivor_families(_survivors(spark, d)[0])


@query
def holdout_compare(spark, d):
    return _compared(spark, d)[0].select(
        *VARIANT, "trade_count", "expectancy_net_r", "null_p_value", "ho_trades", "ho_gross", "ho_net", "ho_win",
        "net_delta", "held_up")


@query
def pooled_holdout_test(spark, d):
    return HO.pooled_test(HO.best_per_family(_compared(spark, d)[0]))


@query
def holdout_verdict(spark, d):
    compared, surv, s = _compared(spark, d)
    fam = cut(HO.best_per_family(compared))
    ci = R.iid_bootstrap_ci(fam, "ho_net", FAMILY, IID_DRAWS)
    ranked = s.filter(F.col("trade_count") >= 3).select(*FAMILY).distinct()
    return L.verdict(fam, HO.survivor_families(surv), ranked, surv, ci, HOLDOUT)


@query
def candidate_legs(spark, d):
    ins, out = _split(spark, d)
    fill = H.fillable_trades
    cand = _gated(spark, d).filter(F.col("total_pnl_usd") > 0)
    return HO.candidate_legs(fill(ins), fill(out), cand)


@query
def leg_summary(spark, d):
    ins, out = _split(spark, d)
    cand = _gated(spark, d).filter(F.col("total_pnl_usd") > 0)
    return HO.leg_summary(HO.candidate_legs(H.fillable_trades(ins), H.fillable_trades(out), cand))


def _curve_trades(spark, d):
    return H.fillable_trades(order_outcomes(spark, d)).withColumn(
        "entry_ts", F.col("date").cast("timestamp_ntz") + F.make_dt_interval(
            F.lit(0), F.lit(0), F.col("bars_from_open_to_entry").cast("int")))


def _curve(spark, d):
    return EQ.equity_curve(_curve_trades(spark, d))


@query
def equity_curve(spark, d):
    return _curve(spark, d).select(*SETUP, "signal_id", "seq", "net_r", "cum_r", "cum_usd", "peak_cum_r")


@query
def phased_curve(spark, d):
    """One curve per setup over both phases, from in-sample trades and holdout trades that come as tables of their own."""
    trades, start = _curve_trades(spark, d), F.lit(HOLDOUT).cast("date")
    both = EQ.with_phase(trades.filter(F.col("date") < start), trades.filter(F.col("date") >= start))
    return EQ.equity_curve(both).select(*SETUP, "phase", "signal_id", "seq", "cum_r", "cum_usd", "peak_cum_usd")


@query
def curve_stats(spark, d):
    return EQ.curve_stats(_curve(spark, d), holdout_start=HOLDOUT)


@query
def thin_curve(spark, d):
    return EQ.thin_curve(_curve(spark, d), points=20)


@query
def recent_split(spark, d):
    return EQ.recent_split(_curve(spark, d), "2001-01-01")


@query
def setup_availability(spark, d):
    wanted = inline_table(spark, ["instrument", "session", "rr"], [
        (i, s, rr) for i in ("6E", "NQ") for s in ("NY", "LDN", "TOK") for rr in (0.25, 0.5, 0.75)])
    from barloom.params import GridSpec
    return EQ.setup_availability(
        wanted, ORDER_MARKET.traded_sessions(spark, GridSpec()), H.fillable_trades(order_outcomes(spark, d)))


# --- K: controls and resampling --------------------------------------------------------------

@query
def control_day_sample(spark, d):
    days = order_outcomes(spark, d).select("instrument", "session", "regime_window", "date").distinct()
    return K.sample_days(days, ["instrument", "session"], "regime_window", SAMPLE_TARGET, date="date")


@query
def observed_stratum_weights(spark, d):
    return K.observed_weights(_eligible(spark, d), FAMILY)


@query
def stop_pool_sizes(spark, d):
    p = K.stop_pools(_eligible(spark, d))
    return p.select(*FAMILY, "pool_size", F.size("pool_r").alias("distinct_stops"),
                    K.pick_stop(F.floor(F.col("pool_size") / 2)).alias("upper_median"))


@query
def stable_seeds(spark, d):
    return order_outcomes(spark, d).select(*FAMILY).distinct().withColumn(
        "seed", stable_seed(*[F.col(k) for k in FAMILY], master=SPEC.seed)).withColumn(
        "first_draw", draw(F.col("seed"), F.lit(1)))


def _event_controls(spark, d, design):
    """Control events of the event journal's families on the days they fired, and that journal.

    The day rows feed both sides, so they are cut once.
    """
    days = cut(_days(spark, d))
    j = H.mark_eligibility(_event_journal(spark, d, days))
    pools = K.stop_pools(H.valid_exits(j))
    fired = j.select(*FAMILY, F.col("date").alias("local_date")).distinct()
    return K.control_events(days, fired.join(pools, FAMILY), EVENT_GRID, design, "fired"), j


CONTROL_COLUMNS = [*FAMILY, "local_date", "draw", "entry_idx", "fill_t", "sl_t", "sl_source"]


@query
def control_events_matched(spark, d):
    return _event_controls(spark, d, "matched")[0].select(*CONTROL_COLUMNS)


@query
def control_events_swing(spark, d):
    return _event_controls(spark, d, "swing")[0].select(*CONTROL_COLUMNS)


@query
def control_pool_days(spark, d):
    ev, _ = _event_controls(spark, d, "matched")
    return K.control_days(K.label_controls(ev, EVENT_GRID, EVENT_MARKET))


def _event_windows(spark, d):
    """Two windows of events: the first half of the history and the second."""
    span = event_bars(spark, d).groupBy("instrument").agg(F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"))
    half = F.date_add("first", F.floor(F.datediff("last", "first") / 2).cast("int"))
    return span.select("instrument", F.inline(F.array(
        F.struct(F.lit(0).alias("regime_window"), F.col("first").alias("window_start"), half.alias("window_end")),
        F.struct(F.lit(1).alias("regime_window"), F.date_add(half, 1).alias("window_start"), F.col("last").alias("window_end")))))


def _windowed_days(spark, d):
    return build_days(C.in_windows(_context_bars(spark, d), _event_windows(spark, d)), EVENT_GRID)


@query
def windowed_days(spark, d):
    """Day rows of histories cut into windows: a window starts without the days before it, and its context is the whole history's."""
    return _windowed_days(spark, d).select(
        "instrument", "session", "local_date", "regime_window", "open_idx", "last_idx", "completeness", "changed_in", "changed_since",
        "atr_4h", "prev_close", "gap_ticks", "parkinson_vol_14d", "realized_vol_14d")


def event_control_pools(spark, d):
    """Days and sums of the broad pools (stratified day samples) and of the fired ones, with stops matched where the family has any."""
    days = cut(_windowed_days(spark, d))
    marked = cut(H.mark_eligibility(_event_journal(spark, d, days), strict=True))
    pools = control_pools(marked, days, EVENT_GRID, EVENT_MARKET, NullSpec(sample_days=POOL_DAYS))
    keys = ["instrument", "session", "range_minutes", "direction", "rr"]
    total = [F.count(F.lit(1)).alias("days"), F.sum("n").alias("trades"), F.sum("total").alias("total_r")]
    return pools["broad"].groupBy(*keys).agg(*total).withColumn("pool", F.lit("broad")).unionByName(
        pools["fired"].groupBy(*keys).agg(*total).withColumn("pool", F.lit("fired")))


@query
def event_control_mix(spark, d):
    ev, j = _event_controls(spark, d, "swing")
    controls = H.valid_exits(K.label_controls(ev, EVENT_GRID, EVENT_MARKET))
    return M.event_mix(H.valid_exits(j), controls, ["instrument", "session", "direction", "rr"])


@query
def event_control_mix_matched(spark, d):
    """Observed events next to controls whose stops come from the family's own pool."""
    ev, j = _event_controls(spark, d, "matched")
    controls = H.valid_exits(K.label_controls(ev, EVENT_GRID, EVENT_MARKET))
    return M.event_mix(H.valid_exits(j), controls, ["instrument", "session", "direction", "rr"])


@query
def null_rate_comparison(spark, d):
    """Significance rates of a sample of variants against swing and matched controls on the same drawn bars."""
    days = cut(_days(spark, d))
    j = cut(H.mark_eligibility(_event_journal(spark, d, days), strict=True))
    sample = cut(K.stratified_variants(J.variant_summary(j), ["instrument", "rr"], 2, 60, VARIANT)
                 .select(*VARIANT, "trade_count", "expectancy_net_r"))
    pools = K.stop_pools(H.valid_exits(j))
    picks = cut(j.join(sample.select(*FAMILY).distinct(), FAMILY, "left_semi").select(
        *FAMILY, F.col("date").alias("local_date")).distinct().join(pools, FAMILY))
    swing, matched = (K.label_controls(K.control_events(days, picks, EVENT_GRID, design, "fired"), EVENT_GRID, EVENT_MARKET)
                      for design in ("swing", "matched"))
    pairs = cut(M.paired_controls(swing, matched).join(sample.select(*VARIANT), VARIANT, "left_semi"))
    p = []
    for design in ("swing", "matched"):
        daily = pairs.groupBy(*VARIANT, F.col("local_date").alias("date")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(f"net_r_{design}").alias("total"))
        vectors = null_vectors(sample, daily, VARIANT, SPEC, "joint-bootstrap")
        p.append(R.vector_stats(vectors, VARIANT, sample, "expectancy_net_r").select(*VARIANT, F.col("p_value").alias(design)))
    gross = pairs.groupBy(*VARIANT).agg(F.avg("gross_r_swing").alias("gross_swing"), F.avg("gross_r_matched").alias("gross_matched"))
    return M.design_rates(p[0].join(p[1], VARIANT), gross)


@query
def bootstrap_interval(spark, d):
    return R.bootstrap_ci(_eligible(spark, d), POOL, CI_DRAWS)


@query
def variant_interval(spark, d):
    return R.bootstrap_ci(_eligible(spark, d), VARIANT, CI_DRAWS)


@query
def regime_interval(spark, d):
    return R.bootstrap_ci(_eligible(spark, d), [*POOL, "regime_window"], CI_DRAWS)


@query
def null_draw_means(spark, d):
    vectors = _order_vectors(spark, d, spec=ROW_SPEC)
    return vectors.select(*VARIANT, "chunk", F.posexplode("means").alias("at", "mean_r")).select(
        *VARIANT, (F.col("chunk") * R.CHUNK + F.col("at")).alias("draw"), "mean_r")


@query
def mc_pvalues(spark, d):
    s = _summary(spark, d)
    return R.vector_stats(_order_vectors(spark, d, s), VARIANT, s, "expectancy_net_r").select(*VARIANT, "p_value")


@query
def null_summaries(spark, d):
    return R.vector_stats(_order_vectors(spark, d), VARIANT).drop("p_value")


@query
def jackknife(spark, d):
    return R.jackknife_se(_pool_days(spark, d), POOL)


@query
def fired_day_pools(spark, d):
    return _fired_days(spark, d).groupBy(*FAMILY, "rr").agg(
        F.count(F.lit(1)).alias("days"), F.sum("n").alias("trades"), F.sum("total").alias("total"))


@query
def studentised_observed(spark, d):
    return _null_t(spark, d)[1]


@query
def family_maxima(spark, d):
    null_t, obs = _null_t(spark, d, ROW_SPEC)
    # A family whose draws don't vary has a row for each draw too, with a null.
    size = F.least(F.lit(R.CHUNK), F.lit(ROW_SPEC.draws) - F.col("chunk") * R.CHUNK)
    t = F.coalesce("t", F.array_repeat(F.lit(None).cast("double"), size))
    return MT.family_rollup(null_t, obs, FAMILY)[0].select(*FAMILY, "chunk", F.posexplode(t).alias("at", "t")).select(
        *FAMILY, (F.col("chunk") * R.CHUNK + F.col("at")).alias("draw"), "t")


@query
def maxt_stepdown(spark, d):
    null_t, obs = _null_t(spark, d)
    return MT.step_down_maxt(*MT.family_rollup(null_t, obs, FAMILY), FAMILY)


@query
def perm_fdr(spark, d):
    null_t, obs = _null_t(spark, d)
    fam_null, fam_obs = MT.family_rollup(null_t, obs, FAMILY)
    return MT.permutation_fdr(cut(fam_null), fam_obs, FAMILY)


@query
def multiplicity(spark, d):
    return _enriched(spark, d)[0].select(
        *VARIANT, "null_p_broad", "null_p_matched", "null_exp_mean", "null_exp_p95", "null_effective_n",
        "null_pool_trades", "null_mean_jackknife_se", "null_unreliable", "p_adj_maxT", "q_fdr",
        "p_adj_maxT_variant", "maxT_hurdle_95", "selection_adjusted_best_stat", "hypothesis_families",
        "hypothesis_variants", "multiplicity_effective_k", "breadth_pass", "survivor")


@query
def iid_bootstrap(spark, d):
    by_custom = _eligible(spark, d).groupBy("instrument", "session").agg(F.avg("net_r").alias("x"))
    return R.iid_bootstrap_ci(by_custom, "x", ["instrument", "session"], IID_DRAWS)


@query
def stratified_variants(spark, d):
    return K.stratified_variants(_summary(spark, d), ["instrument", "rr"], 2, 40, VARIANT).select(
        *VARIANT, "trade_count")


@query
def comparator_rates(spark, d):
    return M.comparator_rates(_enriched(spark, d)[0], ["null_p_broad", "null_p_matched"])
