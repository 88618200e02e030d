"""Oracles of the queries over the order outcome view."""

from __future__ import annotations

from barloom.params import (
    CONTRACT_SPECS, INSTRUMENTS, RR_LEVELS, SLIPPAGE_BY_INSTRUMENT, SLIPPAGE_BY_SESSION, SLIPPAGE_PROVENANCE,
)
from oracles.base import Book, draw, seed, values

SQL: dict[str, str] = {}
BOOK = Book()
cte, statement = BOOK.cte, BOOK.statement
V = "instrument, session, range_minutes, entry_mode, closure_tf, direction, rr"
FAM = "instrument, session, range_minutes, entry_mode, closure_tf, direction"
SET = "instrument, session, range_minutes, entry_mode, closure_tf, rr"
MIN_N = 10
SEED = 20260806


def add(name: str, select: str, doubles: str = "") -> None:
    SQL[name] = statement(select, doubles)


RULES = ("excluded_invalid_exit", "excluded_unfillable_tp", "excluded_small_tp", "excluded_small_sl",
         "excluded_high_friction", "excluded_unaffordable", "excluded_roll_day", "excluded_incomplete_session")

# --- view --------------------------------------------------------------------------------------

cte("ins", "SELECT * FROM " + values([(i[0], i[2], i[6]) for i in INSTRUMENTS]) + " t(instrument, tick_value_usd, asset_class)")
cte("sls", "SELECT * FROM " + values(SLIPPAGE_BY_SESSION) + " t(instrument, session, s1)")
cte("sli", "SELECT * FROM " + values(SLIPPAGE_BY_INSTRUMENT) + " t(instrument, s2)")
cte("prov", "SELECT * FROM " + values(SLIPPAGE_PROVENANCE) + " t(instrument, provenance)")
cte("spec", "SELECT * FROM " + values([(s[0], s[1], s[3], s[4]) for s in CONTRACT_SPECS]) + " t(instrument, kind, tv, fee)")
cte("ob", f"""
SELECT o_orderkey AS signal_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'ES' WHEN '2-HIGH' THEN 'NQ' WHEN '3-MEDIUM' THEN 'CL'
    WHEN '4-NOT SPECIFIED' THEN '6E' ELSE 'GC' END AS instrument,
  CASE WHEN o_custkey % 2 = 0 THEN 'NY' ELSE 'LDN' END AS session, 15 AS range_minutes,
  CASE o_orderstatus WHEN 'F' THEN 'II' WHEN 'O' THEN 'CC' ELSE 'TI' END AS entry_mode,
  CASE o_orderstatus WHEN 'O' THEN 5 ELSE 1 END AS closure_tf,
  CASE WHEN (o_orderkey // 6) % 2 = 0 THEN 'long' ELSE 'short' END AS direction,
  ({list(RR_LEVELS)}::DOUBLE[])[o_orderkey % 6 + 1] AS rr, CAST(o_orderdate AS DATE) AS date,
  o_orderkey % 120 AS bars_from_open_to_entry, (o_custkey * 7 + o_orderkey) % 60 + 1 AS r_ticks,
  (o_orderkey // 12) % 10 AS code, ((CAST(round(o_totalprice * 100) AS BIGINT) % 401) - 200) / 128 AS raw,
  -(o_orderkey % 100) / 128 AS mae_r, (o_custkey % 200) / 128 AS mfe_r,
  o_orderkey % 17 = 0 AS same_bar_ambiguous, o_orderkey % 13 = 0 AS atr_exceeds_cap, o_orderkey % 29 = 0 AS changed_in,
  o_orderkey % 31 = 0 AS changed_since, 1 - (o_orderkey % 20) / 100 AS completeness, (o_orderkey % 4) / 4 AS local,
  CAST(year(o_orderdate) - 1995 AS INTEGER) AS regime_window, o_custkey % 40 + 10 AS range_width_ticks,
  (o_custkey % 50) / 100 AS realized_vol_14d FROM orders""")
cte("o0", """
SELECT * REPLACE (CASE WHEN valid THEN gross_r END AS gross_r),
  CASE WHEN valid THEN gross_r - cost_r END AS net_r,
  CASE WHEN valid THEN CASE WHEN same_bar_ambiguous THEN rr ELSE gross_r END END AS gross_r_optimistic,
  CAST(least(greatest(floor(900 / (r_ticks * tick_value_usd)), 0), 10) AS BIGINT) AS contracts FROM (
  SELECT ob.*, raw AS gross_r, code > 1 AS valid, tick_value_usd, asset_class, rr * r_ticks AS tp_ticks, rr * r_ticks < 1 AS tp_unfillable,
    CASE WHEN code = 0 THEN 'SL_WRONG_SIDE' WHEN code = 1 THEN 'DEGENERATE_R' WHEN raw >= rr THEN 'TP'
      WHEN raw <= -1 THEN 'SL' ELSE 'TIME' END AS exit_reason,
    coalesce(s1, s2, 1.0::DOUBLE) AS slippage_ticks, coalesce(fee, 3.1::DOUBLE) AS commission_usd,
    coalesce(fee, 3.1::DOUBLE) / tick_value_usd + coalesce(s1, s2, 1.0::DOUBLE) AS cost_ticks,
    (coalesce(fee, 3.1::DOUBLE) / tick_value_usd + coalesce(s1, s2, 1.0::DOUBLE)) / r_ticks AS cost_r
  FROM ob JOIN ins USING (instrument) LEFT JOIN sls USING (instrument, session) LEFT JOIN sli USING (instrument)
  LEFT JOIN (SELECT instrument, fee FROM spec WHERE kind = 'full') USING (instrument))""")
cte("mk", """
SELECT *, NOT (excluded_invalid_exit OR excluded_unfillable_tp OR excluded_small_tp OR excluded_small_sl
  OR excluded_high_friction OR excluded_unaffordable OR excluded_roll_day OR excluded_incomplete_session) AS eligible FROM (
  SELECT *, exit_reason IN ('INVALID', 'SL_WRONG_SIDE', 'DEGENERATE_R', 'NO_HOLD_BARS') AS excluded_invalid_exit,
    tp_unfillable AS excluded_unfillable_tp, tp_ticks < 4 AS excluded_small_tp, r_ticks < 8 AS excluded_small_sl,
    cost_r > 0.15::DOUBLE AS excluded_high_friction, contracts <= 0 AS excluded_unaffordable,
    changed_in OR changed_since AS excluded_roll_day, completeness < 0.9::DOUBLE AS excluded_incomplete_session FROM o0)""")
cte("el", "SELECT * FROM mk WHERE eligible")
cte("vx", "SELECT * FROM o0 WHERE valid")
cte("fl", "SELECT * FROM o0 WHERE valid AND NOT tp_unfillable")

add("calendar_labels", """
SELECT dayname(date) AS day_of_week, CAST(date_trunc('month', date) AS DATE) AS month, CAST(year(date) AS INTEGER) AS year,
  count(*) AS trades FROM o0 GROUP BY ALL""")

# --- eligibility, costs, sizing ----------------------------------------------------------------

N_RULES = ", ".join(f"count(*) FILTER ({r}) AS n_{r}" for r in RULES)
add("eligibility_counts", f"""
SELECT instrument, session, count(*) AS n_rows, count(*) FILTER (eligible) AS n_eligible, {N_RULES} FROM mk GROUP BY 1, 2""")
add("eligibility_rows", f"SELECT signal_id, {', '.join(RULES)}, eligible FROM mk")
add("fillable_counts", "SELECT instrument, exit_reason, count(*) AS trades FROM fl GROUP BY ALL")
add("selected_setups", f"""
SELECT signal_id, {SET}, gross_r FROM o0 WHERE (instrument, session, entry_mode, closure_tf, rr) IN (
  ('ES', 'NY', 'CC', 5, 2.0), ('ES', 'NY', 'CC', 5, 1.5), ('CL', 'NY', 'TI', 1, 1.5), ('6E', 'LDN', 'II', 1, 0.25),
  ('NQ', 'LDN', 'CC', 5, 0.5))""", "rr gross_r")
add("duplicate_trades", f"""
SELECT {V}, date, count(*) AS n_rows FROM o0 GROUP BY {V}, date HAVING count(*) > 1
ORDER BY n_rows DESC, {V}, date LIMIT 5""", "rr")
add("cost_columns", "SELECT signal_id, slippage_ticks, commission_usd, cost_ticks, cost_r, net_r FROM o0",
    "slippage_ticks commission_usd cost_ticks cost_r net_r")
cte("sz", """
SELECT *, r_ticks * tick_value_usd AS unit, contracts * (r_ticks * tick_value_usd) AS deployed,
  net_r * (contracts * (r_ticks * tick_value_usd)) AS pnl FROM o0""")
add("sized_trades", """
SELECT signal_id, unit AS risk_per_contract_usd, contracts, contracts > 0 AS executable, deployed AS risk_deployed_usd,
  deployed / 900 AS capital_efficiency, pnl AS pnl_usd FROM sz""",
    "risk_per_contract_usd risk_deployed_usd capital_efficiency pnl_usd")
AFF = "CAST(greatest(0, least(floor({b} / {u}), {c})) AS BIGINT)"
cte("two_specs", """
SELECT f.instrument, f.tv AS tvf, f.fee AS feef, m.tv AS tvm, m.fee AS feem FROM spec f JOIN spec m
ON f.instrument = m.instrument AND f.kind = 'full' AND m.kind = 'micro'""")
cte("md0", f"""
SELECT *, {AFF.format(b="900", u="(r_ticks * tvf)", c="10")} AS nf, {AFF.format(b="900", u="(r_ticks * tvm)", c="10")} AS nm
FROM {{src}} JOIN two_specs USING (instrument)""".replace("{src}", "o0"))
cte("md1", f"SELECT *, {AFF.format(b='(900 - nf * (r_ticks * tvf))', u='(r_ticks * tvm)', c='(10 - nf)')} AS nrest FROM md0")
cte("md2", """
SELECT *, 'full' AS mode, nf AS n_full, 0::BIGINT AS n_micro FROM md1
UNION ALL SELECT *, 'micro', 0::BIGINT, nm FROM md1 UNION ALL SELECT *, 'hybrid', nf, nrest FROM md1""")
cte("md", """
SELECT * EXCLUDE (commission_usd), n_full * (r_ticks * tvf) + n_micro * (r_ticks * tvm) AS risk_usd,
  n_full * feef + n_micro * feem AS commission_usd, n_full * tvf + n_micro * tvm AS tick_value_total FROM md2""")
add("sizing_modes", "SELECT signal_id, mode, n_full, n_micro, risk_usd, commission_usd, tick_value_total FROM md",
    "risk_usd commission_usd tick_value_total")
cte("rp0", """
SELECT *, risk_usd > 0 AS taken, CASE WHEN risk_usd > 0 THEN gross_r * risk_usd - commission_usd - slippage_ticks * tick_value_total
  ELSE 0 END AS pnl FROM md WHERE valid AND NOT tp_unfillable""")
cte("rp", f"""
SELECT {SET}, mode, count(*) AS trades, count(*) FILTER (taken) AS trades_taken, (count(*) FILTER (taken)) / count(*) AS afford,
  coalesce((count(*) FILTER (taken AND pnl / risk_usd > 0)) / nullif(count(*) FILTER (taken), 0), 0) AS win_rate,
  coalesce(sum(CASE WHEN taken THEN pnl / risk_usd ELSE 0 END) / nullif(count(*) FILTER (taken), 0), 0) AS exp_net_r,
  sum(pnl) AS total_pnl_usd, sum(CASE WHEN taken THEN commission_usd ELSE 0 END) AS commission_usd,
  avg(risk_usd) / 900 AS cap_eff, coalesce(avg(n_full) FILTER (taken), 0) AS mean_full,
  coalesce(avg(n_micro) FILTER (taken), 0) AS mean_micro, quantile_cont(r_ticks, 0.5) AS sl_med,
  quantile_cont(tp_ticks, 0.5) AS tp_med FROM rp0 GROUP BY ALL HAVING count(*) >= {MIN_N}""")
cte("rpt", "SELECT *, afford >= 0.8::DOUBLE AS tradable FROM rp")
add("repriced_modes", "SELECT * FROM rpt",
    "rr afford win_rate exp_net_r total_pnl_usd commission_usd cap_eff mean_full mean_micro sl_med tp_med")
add("best_sizing_mode", f"""
SELECT {SET}, mode, total_pnl_usd FROM (SELECT *, row_number() OVER (PARTITION BY {SET}
  ORDER BY round(total_pnl_usd, 8) DESC, mode) AS r FROM rpt) WHERE r = 1""", "rr total_pnl_usd")
add("population_shift", """
SELECT mode, count(*) AS setups, count(*) FILTER (tradable) AS tradable, count(*) FILTER (total_pnl_usd > 0) AS net_positive,
  count(*) FILTER (tradable AND total_pnl_usd > 0) AS tradable_positive, max(total_pnl_usd) FILTER (tradable) AS best_pnl
FROM rpt GROUP BY 1""", "best_pnl")
add("stop_limits", """
SELECT instrument, max(r_ticks) AS widest_stop, min(r_ticks) AS tightest_stop, 900 / any_value(tick_value_usd) AS max_stop_ticks,
  900 / (any_value(tick_value_usd) * 10) AS full_deploy_stop_ticks FROM o0 GROUP BY 1""", "max_stop_ticks full_deploy_stop_ticks")
cte("wi", """
SELECT *, gross_r - (commission_usd / tick_value_usd + 1.0::DOUBLE) / r_ticks AS net_flat,
  gross_r - (commission_usd / tick_value_usd + slippage_ticks) / r_ticks AS net_table FROM vx""")
add("cost_what_if_by_instrument", """
SELECT instrument, count(*) AS trades, avg(net_flat) AS net_flat, avg(net_table) AS net_table,
  max(abs(net_table - net_r)) AS max_abs_diff FROM wi GROUP BY 1""", "net_flat net_table max_abs_diff")


# --- metrics -----------------------------------------------------------------------------------

CORE = ("trade_count win_rate tp_hit_rate expectancy_gross_r expectancy_net_r profit_factor max_drawdown_r sharpe_r "
        "sortino_r calmar_r t_cluster_net avg_mae_r avg_mfe_r expectancy_gross_r_optimistic pct_trades_from_local").split()


def metric_ctes(p: str, keys: str, src: str, marked: str, breadth: bool = True) -> None:
    """``{p}s``: the summary of eligible rows ``src`` per ``keys``."""
    cte(f"{p}_d", f"""
SELECT {keys}, {"" if not breadth else "regime_window, "}date, count(*) AS n, sum(gross_r) AS g, sum(net_r) AS t,
  count(*) FILTER (gross_r > 0) AS wins, count(*) FILTER (exit_reason = 'TP') AS tps,
  sum(CASE WHEN gross_r > 0 THEN gross_r ELSE 0 END) AS won, sum(CASE WHEN gross_r < 0 THEN gross_r ELSE 0 END) AS lost,
  sum(mae_r) AS mae, sum(mfe_r) AS mfe, sum(gross_r_optimistic) AS opt, sum(local) AS loc FROM {src} GROUP BY ALL""")
    cte(f"{p}_c", f"""
SELECT *, sum(g) OVER (PARTITION BY {keys} ORDER BY date) AS cum, sum(t) OVER (PARTITION BY {keys}) /
  sum(n) OVER (PARTITION BY {keys}) AS mnet FROM {p}_d""")
    cte(f"{p}_p", f"SELECT *, max(cum) OVER (PARTITION BY {keys} ORDER BY date) - cum AS dd FROM {p}_c")
    cte(f"{p}_m", f"""
SELECT {keys}, CAST(sum(n) AS BIGINT) AS trade_count, sum(wins) / sum(n) AS win_rate, sum(tps) / sum(n) AS tp_hit_rate,
  sum(g) / sum(n) AS expectancy_gross_r, sum(t) / sum(n) AS expectancy_net_r,
  coalesce(sum(won) / nullif(abs(sum(lost)), 0), 9999) AS profit_factor, max(dd) AS max_drawdown_r,
  avg(g) / nullif(stddev_pop(g), 0) * sqrt(252) AS sharpe_r,
  avg(g) / nullif(sqrt(avg(g * g) FILTER (g < 0)), 0) * sqrt(252) AS sortino_r,
  CASE WHEN max(dd) > 0 THEN avg(g) * 252 / max(dd) END AS calmar_r,
  (sum(t) / sum(n)) / nullif(sqrt(sum((t - n * mnet) ** 2)) / sum(n), 0) AS t_cluster_net,
  sum(mae) / sum(n) AS avg_mae_r, sum(mfe) / sum(n) AS avg_mfe_r, sum(opt) / sum(n) AS expectancy_gross_r_optimistic,
  sum(loc) / sum(n) AS pct_trades_from_local FROM {p}_p GROUP BY {keys}""")
    if not breadth:
        return
    cte(f"{p}_b0", f"""
SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY t DESC, date) AS top_r, count(*) OVER (PARTITION BY {keys}) AS nd,
  sum(t) OVER (PARTITION BY {keys}, date_trunc('month', date)) AS mon,
  row_number() OVER (PARTITION BY {keys} ORDER BY date) - row_number() OVER (PARTITION BY {keys}, t < 0 ORDER BY date) AS isl
FROM {p}_d""")
    cte(f"{p}_b1", f"SELECT *, CASE WHEN t < 0 THEN count(*) OVER (PARTITION BY {keys}, t < 0, isl) ELSE 0 END AS streak FROM {p}_b0")
    cte(f"{p}_b", f"""
SELECT {keys}, count(*) AS n_distinct_days, max(greatest(t, 0)) / nullif(sum(greatest(t, 0)), 0) AS top1_day_pnl_share,
  sum(greatest(t, 0)) FILTER (top_r <= ceil(nd * 0.05::DOUBLE)) / nullif(sum(greatest(t, 0)), 0) AS top5pct_day_pnl_share,
  max(greatest(mon, 0)) / nullif(sum(greatest(t, 0)), 0) AS pnl_share_from_single_month,
  quantile_cont(t, 0.5) AS median_daily_r, avg(t) AS mean_daily_r, max(streak) AS max_consecutive_losing_days
FROM {p}_b1 GROUP BY {keys}""")
    cte(f"{p}_w", f"""
SELECT {keys}, count(*) FILTER (m > 0) AS n_windows_positive, count(*) AS n_windows_observed, min(m) AS worst_window_expectancy
FROM (SELECT {keys}, regime_window, sum(net_r) / count(*) AS m FROM {src} GROUP BY ALL) GROUP BY {keys}""")
    cte(f"{p}_x", f"SELECT {keys}, {N_RULES} FROM {marked} GROUP BY {keys}")
    cte(f"{p}_y", f"SELECT instrument, session, count(DISTINCT date) AS chances FROM {marked} GROUP BY 1, 2")
    cte(f"{p}s", f"""
SELECT {p}_m.*, {p}_b.* EXCLUDE ({keys}), {p}_w.* EXCLUDE ({keys}), {p}_x.* EXCLUDE ({keys}),
  n_distinct_days / chances AS frac_days_traded, trade_count AS deployable_trade_count
FROM {p}_m JOIN {p}_b USING ({keys}) JOIN {p}_w USING ({keys}) JOIN {p}_x USING ({keys}) JOIN {p}_y USING (instrument, session)""")


metric_ctes("v", V, "el", "mk")
metric_ctes("r", V + ", regime_window", "el", "mk", breadth=False)
metric_ctes("ct", "instrument, session, rr", "el", "mk")
metric_ctes("br", "instrument, session, entry_mode", "el", "mk")
CORE_D = "win_rate tp_hit_rate expectancy_gross_r expectancy_net_r profit_factor max_drawdown_r sharpe_r sortino_r calmar_r t_cluster_net avg_mae_r avg_mfe_r expectancy_gross_r_optimistic pct_trades_from_local"
BREADTH_D = "top1_day_pnl_share top5pct_day_pnl_share pnl_share_from_single_month median_daily_r mean_daily_r worst_window_expectancy frac_days_traded"
add("variant_summary", "SELECT * FROM vs", f"rr {CORE_D} {BREADTH_D}")
add("regime_summary", "SELECT * FROM r_m", f"rr {CORE_D}")
add("clustered_t", "SELECT instrument, session, rr, trade_count, expectancy_net_r, t_cluster_net FROM cts",
    "rr expectancy_net_r t_cluster_net")
add("breadth", """
SELECT instrument, session, entry_mode, n_distinct_days, top1_day_pnl_share, top5pct_day_pnl_share, pnl_share_from_single_month,
  n_windows_positive, n_windows_observed, worst_window_expectancy, frac_days_traded, median_daily_r, mean_daily_r FROM brs""", BREADTH_D)
add("drawdowns", f"""
WITH d AS (SELECT {SET}, date, sum(gross_r) AS v FROM el GROUP BY ALL),
c AS (SELECT *, sum(v) OVER (PARTITION BY {SET} ORDER BY date) AS cum FROM d),
p AS (SELECT *, max(cum) OVER (PARTITION BY {SET} ORDER BY date) - cum AS dd FROM c)
SELECT {SET}, count(*) AS days, max(dd) AS max_drawdown FROM p GROUP BY ALL""", "rr max_drawdown")
add("losing_streaks", """
WITH d AS (SELECT instrument, session, date, sum(net_r) AS t FROM el GROUP BY ALL),
i AS (SELECT *, t < 0 AS losing, row_number() OVER (PARTITION BY instrument, session ORDER BY date)
  - row_number() OVER (PARTITION BY instrument, session, t < 0 ORDER BY date) AS isl FROM d),
r AS (SELECT instrument, session, losing, isl, count(*) AS len FROM i GROUP BY ALL)
SELECT instrument, session, max(CASE WHEN losing THEN len ELSE 0 END) AS max_losing_days FROM r GROUP BY ALL""")

# --- report ------------------------------------------------------------------------------------

add("headline_counts", f"""
SELECT * FROM (SELECT count(*) FILTER (eligible) AS eligible_rows, count(*) FILTER (atr_exceeds_cap) AS cap_flagged_rows,
  count(*) FILTER (same_bar_ambiguous) AS ambiguous_rows FROM mk) CROSS JOIN (SELECT count(*) AS variants,
  count(*) FILTER (trade_count >= {MIN_N}) AS rankable, count(*) FILTER (trade_count < {MIN_N}) AS under_sampled FROM vs)""")
add("coverage_by_instrument", f"""
SELECT coalesce(a.instrument, b.instrument) AS instrument, rows, variants, median_trades, max_trades,
  CASE WHEN median_trades < {MIN_N} THEN 'UNDER-SAMPLED' ELSE 'ok' END AS status
FROM (SELECT instrument, count(exit_reason) AS rows FROM o0 GROUP BY 1) a FULL JOIN (
  SELECT instrument, count(*) AS variants, quantile_cont(trade_count, 0.5) AS median_trades, max(trade_count) AS max_trades
  FROM vs GROUP BY 1) b ON a.instrument = b.instrument""", "median_trades")
add("cost_provenance", """
SELECT p.instrument, p.provenance, coalesce(l.lab, '(fallback)') AS slippage_ticks, c.rows FROM prov p
JOIN (SELECT instrument, count(*) AS rows FROM o0 GROUP BY 1) c USING (instrument)
LEFT JOIN (SELECT instrument, string_agg(session || '=' || printf('%.2f', s1), ', ' ORDER BY session) AS lab FROM sls GROUP BY 1) l
  USING (instrument)""")
for name, way in (("top_variants", "DESC"), ("bottom_variants", "ASC")):
    add(name, f"""
SELECT {V}, trade_count, expectancy_gross_r FROM vs WHERE trade_count >= {MIN_N}
ORDER BY expectancy_gross_r {way}, {V} LIMIT 20""", "rr expectancy_gross_r")
add("regime_stability", f"""
SELECT {V}, avg(e) AS mean_r, stddev_samp(e) AS std_r, min(e) AS min_r, max(e) AS max_r, count(e) AS n_windows FROM (
  SELECT *, round(expectancy_gross_r, 9) AS e FROM r_m) GROUP BY {V} ORDER BY std_r ASC NULLS LAST, {V} LIMIT 20""",
    "rr mean_r std_r min_r max_r")

# --- diagnostics -------------------------------------------------------------------------------

add("trade_distribution", """
SELECT instrument, count(*) AS variants, min(trade_count) AS tc_min, quantile_cont(trade_count, 0.5) AS tc_med,
  max(trade_count) AS tc_max, CAST(sum(trade_count) AS BIGINT) AS tc_sum FROM vs GROUP BY 1""", "tc_med")
add("sample_thresholds", """
SELECT CAST(t AS INTEGER) AS threshold, count(*) FILTER (trade_count >= t) AS "left", count(*) AS variants,
  (count(*) FILTER (trade_count >= t)) * 100.0 / count(*) AS left_pct
FROM vs CROSS JOIN (VALUES (1), (10), (30), (50), (100), (200)) x(t) GROUP BY t""", "left_pct")
REASONS = ("TP", "SL", "TIME", "SL_WRONG_SIDE", "DEGENERATE_R")
add("exit_mix_pivot", "SELECT instrument, " + ", ".join(
    f"(count(*) FILTER (exit_reason = '{r}')) * 100.0 / count(*) AS {r.lower()}" for r in REASONS) + " FROM o0 GROUP BY 1",
    " ".join(r.lower() for r in REASONS))
add("rows_by_session", """
SELECT instrument, count(*) FILTER (session = 'NY') AS "NY", count(*) FILTER (session = 'LDN') AS "LDN" FROM o0 GROUP BY 1""")
cte("fcov", f"""
SELECT f.*, days_available, days_traded * 100.0 / days_available AS coverage_pct FROM (
  SELECT {FAM}, count(DISTINCT date) AS days_traded FROM vx WHERE rr = 1.0 GROUP BY ALL) f
JOIN (SELECT instrument, session, count(DISTINCT date) AS days_available FROM vx GROUP BY ALL) USING (instrument, session)""")
add("day_coverage", """
SELECT instrument, entry_mode, count(*) AS families, min(coverage_pct) AS cov_min, quantile_cont(coverage_pct, 0.5) AS cov_median,
  max(coverage_pct) AS cov_max FROM fcov GROUP BY ALL""", "cov_min cov_median cov_max")
add("day_coverage_bands", """
SELECT CASE WHEN coverage_pct < 40 THEN '000-040' WHEN coverage_pct < 60 THEN '040-060' WHEN coverage_pct < 80 THEN '060-080'
  WHEN coverage_pct < 95 THEN '080-095' WHEN coverage_pct < 101 THEN '095-101' END AS band, count(*) AS families FROM fcov GROUP BY ALL""")
cte("tdc", """
SELECT * FROM (SELECT instrument, session, count(*) FILTER (hit) AS n_traded, count(*) FILTER (NOT hit) AS n_untraded,
  quantile_cont(vol, 0.5) FILTER (hit) AS vol_traded, quantile_cont(vol, 0.5) FILTER (NOT hit) AS vol_untraded,
  quantile_cont(width, 0.5) FILTER (hit) AS width_traded, quantile_cont(width, 0.5) FILTER (NOT hit) AS width_untraded FROM (
  SELECT instrument, session, date, min(realized_vol_14d) AS vol, quantile_cont(range_width_ticks, 0.5) AS width,
    bool_or(entry_mode = 'TI' AND rr = 1.0 AND range_minutes = 15) AS hit FROM vx GROUP BY ALL) GROUP BY ALL)
WHERE n_traded >= 20 AND n_untraded >= 20""")
cte("tdr", """
SELECT *, n_traded * 100.0 / (n_traded + n_untraded) AS cov_pct, vol_traded / nullif(vol_untraded, 0) AS vol_ratio,
  width_traded / nullif(width_untraded, 0) AS width_ratio FROM tdc""")
add("traded_day_contrast", "SELECT * FROM tdr", "vol_traded vol_untraded width_traded width_untraded cov_pct vol_ratio width_ratio")
add("coverage_verdict", """
SELECT *, CASE WHEN min_cov >= 85 THEN 'clean' WHEN min_cov < 60 AND max_width_ratio >= 2 THEN 'confounded' ELSE 'partial' END AS verdict
FROM (SELECT instrument, count(*) AS sessions, min(cov_pct) AS min_cov, quantile_cont(cov_pct, 0.5) AS med_cov,
  max(width_ratio) AS max_width_ratio FROM tdr GROUP BY 1)""", "min_cov med_cov max_width_ratio")
cte("sm", f"SELECT {V}, count(*) AS trade_count, avg(gross_r) AS exp_gross FROM vx GROUP BY ALL")
cte("sc", f"""
SELECT {V}, trade_count, exp_gross, (count(*) FILTER (gross_r >= exp_gross)) / count(*) AS self_p
FROM vx JOIN sm USING ({V}) GROUP BY ALL HAVING trade_count >= {MIN_N}""")
add("self_consistency", f"SELECT {V}, trade_count, exp_gross, self_p FROM sc", "rr exp_gross self_p")
add("self_p_by_rr", """
SELECT rr, count(*) AS variants, avg(self_p) AS self_p_mean, quantile_cont(self_p, 0.5) AS self_p_median FROM sc GROUP BY 1""",
    "rr self_p_mean self_p_median")
STOPS = """
count(*) AS trades, quantile_cont(r_ticks, 0.05) AS r_p05, quantile_cont(r_ticks, 0.5) AS r_median,
  quantile_cont(r_ticks, 0.95) AS r_p95, (count(*) FILTER (r_ticks < 5)) / count(*) * 100 AS pct_under_5,
  (count(*) FILTER (r_ticks < 2)) / count(*) * 100 AS pct_under_2, max(cost_ticks) AS cost_ticks,
  (count(*) FILTER (tp_unfillable)) / count(*) * 100 AS pct_unfillable,
  max(cost_ticks) / nullif(quantile_cont(r_ticks, 0.5), 0) AS cost_r_at_median"""
STOPS_D = "r_p05 r_median r_p95 pct_under_5 pct_under_2 cost_ticks pct_unfillable cost_r_at_median"
add("stop_distribution", f"SELECT instrument, {STOPS} FROM vx GROUP BY 1", STOPS_D)
add("mode_stop_profile", f"SELECT instrument, entry_mode, {STOPS} FROM vx WHERE instrument = 'CL' GROUP BY 1, 2", STOPS_D)
add("unfillable_rates", """
SELECT instrument, count(*) AS rows, quantile_cont(tp_ticks, 0.5) AS median_tp_ticks,
  (count(*) FILTER (tp_ticks < 1)) / count(*) * 100 AS pct_unfillable FROM vx GROUP BY 1""", "median_tp_ticks pct_unfillable")
add("unfillable_pivot", "SELECT instrument, " + ", ".join(
    f"(count(*) FILTER (rr = {r} AND tp_ticks < 1)) / nullif(count(*) FILTER (rr = {r}), 0) * 100 AS rr_{str(r).replace('.', '_')}"
    for r in RR_LEVELS) + " FROM vx GROUP BY 1", " ".join(f"rr_{str(r).replace('.', '_')}" for r in RR_LEVELS))
add("net_drag", f"""
SELECT instrument, count(*) AS variants, quantile_cont(expectancy_gross_r, 0.5) AS med_gross,
  quantile_cont(expectancy_net_r, 0.5) AS med_net, quantile_cont(expectancy_gross_r - expectancy_net_r, 0.5) AS med_drag,
  (count(*) FILTER (expectancy_net_r > 0)) / count(*) * 100 AS pct_net_positive FROM vs WHERE trade_count >= {MIN_N} GROUP BY 1""",
    "med_gross med_net med_drag pct_net_positive")
add("net_positive_top", f"""
SELECT {V}, trade_count, expectancy_net_r FROM vs WHERE trade_count >= {MIN_N} AND expectancy_net_r > 0
ORDER BY expectancy_net_r DESC, {V} LIMIT 25""", "rr expectancy_net_r")
cte("exu", f"""
SELECT *, gross_fillable - gross_all AS gross_delta FROM (SELECT {V}, count(*) AS n_all, count(*) FILTER (NOT tp_unfillable) AS n_fillable,
  avg(gross_r) AS gross_all, avg(gross_r) FILTER (NOT tp_unfillable) AS gross_fillable, avg(net_r) AS net_all,
  avg(net_r) FILTER (NOT tp_unfillable) AS net_fillable,
  (count(*) FILTER (NOT tp_unfillable AND gross_r > 0)) / nullif(count(*) FILTER (NOT tp_unfillable), 0) AS win_fillable
FROM vx GROUP BY ALL)""")
add("excluding_unfillable", "SELECT * FROM exu", "rr gross_all gross_fillable net_all net_fillable win_fillable gross_delta")
add("exclusion_deltas", """
SELECT instrument, count(*) AS variants, quantile_cont(gross_all, 0.5) AS med_gross_before,
  quantile_cont(gross_fillable, 0.5) AS med_gross_after, quantile_cont(gross_delta, 0.5) AS med_delta
FROM exu WHERE gross_fillable IS NOT NULL GROUP BY 1""", "med_gross_before med_gross_after med_delta")
add("old_vs_new", f"""
WITH o AS (SELECT instrument, count(*) AS old FROM (SELECT {V}, avg(net_flat) AS m FROM wi GROUP BY ALL
    HAVING count(*) >= {MIN_N}) WHERE m > 0 GROUP BY 1),
n AS (SELECT instrument, count(*) AS new FROM (SELECT {V}, avg(net_table) AS m FROM wi WHERE NOT tp_unfillable GROUP BY ALL
    HAVING count(*) >= {MIN_N}) WHERE m > 0 GROUP BY 1)
SELECT coalesce(o.instrument, n.instrument) AS instrument, coalesce(old, 0) AS old, coalesce(new, 0) AS new,
  coalesce(new, 0) - coalesce(old, 0) AS delta FROM o FULL JOIN n ON o.instrument = n.instrument""")
add("entry_timing", """
SELECT instrument, session, count(*) AS n, quantile_cont(bars_from_open_to_entry, 0.1) AS p10,
  quantile_cont(bars_from_open_to_entry, 0.5) AS p50, quantile_cont(bars_from_open_to_entry, 0.9) AS p90,
  (count(*) FILTER (bars_from_open_to_entry <= 30)) / count(*) * 100 AS pct_first FROM vx GROUP BY ALL""", "p10 p50 p90 pct_first")
add("roll_ratios", """
WITH m AS (SELECT instrument, date_trunc('month', date) AS month, count(*) FILTER (entry_mode = 'TI') AS c,
    count(*) FILTER (entry_mode <> 'TI') AS v FROM o0 GROUP BY ALL),
r AS (SELECT instrument, month, v / nullif(c, 0) AS r FROM m WHERE v > 0 AND c > 0),
a AS (SELECT instrument, count(*) AS months, min(r) AS r_min, avg(r) AS r_mean, max(r) AS r_max, count(*) FILTER (r >= 1.4) AS bad_months,
  array_to_string(list_transform((list({'r': r, 'm': month} ORDER BY r DESC, month DESC))[1:4], lambda s: strftime(s.m, '%Y-%m')), ', ') AS worst_months
  FROM r GROUP BY 1)
SELECT *, CASE WHEN r_min >= 3 THEN 'broken' WHEN r_max / greatest(r_min, 1e-9) >= 1.8 AND r_max >= 1.4 THEN 'periodic'
  WHEN r_mean > 1.3 THEN 'uniform' ELSE 'fine' END AS verdict FROM a""", "r_min r_mean r_max")

# --- setups ------------------------------------------------------------------------------------

cte("se", f"""
SELECT *, slip_ticks / nullif(sl_med, 0) AS friction_r, risk_deployed_mean / 900 AS capital_eff,
  total_pnl_usd * 252 / nullif(n_days, 0) AS pnl_per_yr_usd FROM (
  SELECT {SET}, count(*) AS trades, (count(*) FILTER (net_r > 0)) / count(*) AS win_rate, avg(gross_r) AS exp_gross_r,
    avg(net_r) AS exp_net_r, sum(net_r) AS total_net_r, quantile_cont(r_ticks, 0.5) AS sl_med, quantile_cont(r_ticks, 0.1) AS sl_p10,
    quantile_cont(tp_ticks, 0.5) AS tp_med, quantile_cont(unit, 0.5) AS risk_med_usd,
    (count(*) FILTER (contracts > 0)) / count(*) AS executable_pct, avg(contracts) AS mean_contracts,
    avg(deployed) AS risk_deployed_mean, sum(pnl) AS total_pnl_usd, count(DISTINCT date) AS n_days,
    any_value(slippage_ticks) AS slip_ticks, any_value(asset_class) AS asset_class
  FROM sz JOIN (SELECT signal_id FROM el) USING (signal_id) GROUP BY {SET})""")
SE_D = ("rr win_rate exp_gross_r exp_net_r total_net_r sl_med sl_p10 tp_med risk_med_usd executable_pct mean_contracts "
        "risk_deployed_mean total_pnl_usd slip_ticks friction_r capital_eff pnl_per_yr_usd")
add("setup_metrics", "SELECT * FROM se", SE_D)
cte("sg", f"""
SELECT *, NOT g_tp::INT::BOOL AS x, g_tp AND g_sl AND g_friction AND g_afford AND g_sample AS tradable,
  (NOT g_tp)::INT + (NOT g_sl)::INT + (NOT g_friction)::INT + (NOT g_afford)::INT + (NOT g_sample)::INT AS n_gates_failed FROM (
  SELECT *, tp_med >= 4 AS g_tp, sl_med >= 8 AS g_sl, coalesce(friction_r <= 0.15::DOUBLE, false) AS g_friction,
    executable_pct >= 0.8::DOUBLE AS g_afford, trades >= {MIN_N} AS g_sample FROM se)""")
GATES = "g_tp, g_sl, g_friction, g_afford, g_sample"
add("setup_gates", f"SELECT {SET}, {GATES}, n_gates_failed, tradable FROM sg", "rr")
cte("ss", f"SELECT *, tradable AND total_pnl_usd > 0 AS scoreable FROM sg")


def avg_rank(col: str, part: str) -> str:
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {col}) + (count(*) OVER (PARTITION BY {part}, {col}) - 1) / 2)")


cte("sr", "SELECT *, " + ", ".join(
    f"CASE WHEN scoreable THEN {avg_rank(c, 'scoreable')} / count(*) OVER (PARTITION BY scoreable) END AS {n}"
    for n, c in (("pct_pnl", "total_pnl_usd"), ("pct_wr", "win_rate"), ("pct_cap", "capital_eff"))) + " FROM ss")
add("setup_score", f"""
SELECT {SET}, scoreable, pct_pnl, pct_wr, pct_cap, (pct_pnl + pct_wr + pct_cap) / 3 AS score FROM sr""",
    "rr pct_pnl pct_wr pct_cap score")
add("gate_attrition", " UNION ALL ".join(
    f"SELECT '{g}' AS gate, count(*) FILTER ({g}) AS passed, count(*) FILTER (NOT {g}) AS failed FROM sg"
    for g in ("g_tp", "g_sl", "g_friction", "g_afford", "g_sample", "tradable")))
add("by_asset_class", """
SELECT asset_class, count(*) AS setups, count(*) FILTER (tradable) AS tradable, avg(win_rate) AS win_rate,
  quantile_cont(sl_med, 0.5) AS sl_med, quantile_cont(tp_med, 0.5) AS tp_med, quantile_cont(friction_r, 0.5) AS friction,
  avg(executable_pct) AS afford, avg(capital_eff) AS cap_eff, quantile_cont(total_pnl_usd, 0.5) AS med_pnl,
  max(win_rate) AS best_wr, max(total_pnl_usd) AS best_pnl FROM (SELECT instrument, asset_class, tradable, win_rate, sl_med, tp_med,
  friction_r, executable_pct, capital_eff, total_pnl_usd FROM sg) GROUP BY 1""".replace("avg(win_rate) AS win_rate", "avg(win_rate) AS mean_wr").replace(
    "quantile_cont(sl_med, 0.5) AS sl_med", "quantile_cont(sl_med, 0.5) AS q_sl").replace("quantile_cont(tp_med, 0.5) AS tp_med", "quantile_cont(tp_med, 0.5) AS q_tp").replace(
    "SELECT asset_class, count", "SELECT asset_class, setups, tradable, mean_wr AS win_rate, q_sl AS sl_med, q_tp AS tp_med, friction, afford, cap_eff, med_pnl, best_wr, best_pnl FROM (SELECT asset_class, count", 1) + ")",
    "win_rate sl_med tp_med friction afford cap_eff med_pnl best_wr best_pnl")
add("setups_by_rr", """
SELECT rr, count(*) AS setups, avg(win_rate) AS win_rate, quantile_cont(total_pnl_usd, 0.5) AS med_pnl, max(total_pnl_usd) AS best_pnl,
  (count(*) FILTER (total_pnl_usd > 0)) / count(*) AS pct_profitable FROM sg WHERE tradable GROUP BY 1""",
    "rr win_rate med_pnl best_pnl pct_profitable")
add("spearman", f"""
SELECT count(*) AS setups, corr(a, b) AS spearman FROM (SELECT {avg_rank("round(win_rate, 12)", "1")} AS a,
  {avg_rank("round(capital_eff, 12)", "1")} AS b FROM sg)""", "spearman")
cte("pa", "SELECT *, round(total_pnl_usd, 8) AS a1, win_rate AS a2, capital_eff AS a3 FROM sg")
add("pareto", f"""
SELECT {SET}, a1 AS total_pnl_usd, win_rate, capital_eff FROM pa p WHERE NOT EXISTS (SELECT 1 FROM pa q
  WHERE q.a1 >= p.a1 AND q.a2 >= p.a2 AND q.a3 >= p.a3 AND (q.a1 > p.a1 OR q.a2 > p.a2 OR q.a3 > p.a3))""",
    "rr total_pnl_usd win_rate capital_eff")
add("top_setups", f"""
SELECT {SET}, trades, a1 AS total_pnl_usd FROM pa WHERE trades >= {MIN_N} ORDER BY a1 DESC, {SET} LIMIT 25""", "rr total_pnl_usd")

# --- resampling --------------------------------------------------------------------------------

DRAWS = 20_000
ROW_DRAWS = 1000
CI_DRAWS = 1000
IID_DRAWS = 10_000


def boot_ctes(p: str, days: str, keys: str, groups: str, n_blocks: str, seed_sql: str, draws: int, block: int = 5) -> None:
    """``{p}k``: the group rows with a number gid; ``{p}m``: (gid, draw, mean_r). ``days`` has keys, date, n, total; ``groups`` has
    the group rows with ``keys`` and whatever ``n_blocks`` needs besides nd and n_trades."""
    cte(f"{p}s", f"""
SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY date) - 1 AS st, count(*) OVER (PARTITION BY {keys}) AS nd,
  sum(n) OVER (PARTITION BY {keys}) AS n_trades,
  sum(n) OVER (PARTITION BY {keys} ORDER BY date ROWS BETWEEN CURRENT ROW AND {block - 1} FOLLOWING) AS bn,
  sum(total) OVER (PARTITION BY {keys} ORDER BY date ROWS BETWEEN CURRENT ROW AND {block - 1} FOLLOWING) AS bs FROM {days}""")
    cte(f"{p}p", f"SELECT *, row_number() OVER () AS pid FROM (SELECT DISTINCT {keys}, nd, n_trades FROM {p}s)")
    cte(f"{p}b", f"SELECT pid, st, bn, bs FROM {p}s JOIN (SELECT {keys}, pid FROM {p}p) USING ({keys})")
    cte(f"{p}k", f"""
SELECT *, least({block}, nd) AS w, CAST({n_blocks} AS BIGINT) AS k, {seed_sql} AS sd, row_number() OVER () AS gid
FROM {groups} JOIN {p}p USING ({keys})""")
    cte(f"{p}m", f"""
SELECT gid, CAST(d AS INTEGER) AS draw, sum(bs) / sum(bn) AS mean_r FROM (
  SELECT gid, d, pid, CAST({draw("sd", f"d * {1 << 20} + blk")} % (nd - w + 1) AS BIGINT) AS st FROM (
    SELECT gid, pid, nd, w, sd, d, unnest(range(k)) AS blk FROM (
      SELECT gid, pid, nd, w, sd, k, unnest(range({draws})) AS d FROM {p}k)))
JOIN {p}b USING (pid, st) GROUP BY gid, d""")


POOL = "instrument, session, rr"
cte("pd", f"SELECT {POOL}, date, count(*) AS n, sum(net_r) AS total FROM el GROUP BY ALL")
NB_OBS = "greatest(1, ceil(ceil(trade_count / greatest(1.0::DOUBLE, n_trades / nd)) / least(5, nd)))"
NB_OWN = "ceil(nd / least(5, nd))"
cte("jseed", f"SELECT {seed(chr(39) + 'joint-bootstrap' + chr(39), SEED)} AS sd0")
boot_ctes("nm", "pd", POOL, f"(SELECT {V}, trade_count FROM vs)", NB_OBS, "(SELECT sd0 FROM jseed)", DRAWS)
boot_ctes("n1", "pd", POOL, f"(SELECT {V}, trade_count FROM vs)", NB_OBS, "(SELECT sd0 FROM jseed)", ROW_DRAWS)
add("null_draw_means", f"SELECT {V}, draw, mean_r FROM n1m JOIN n1k USING (gid)", "rr mean_r")
P_VALUE = "(1 + count(*) FILTER (mean_r - expectancy_net_r > 1e-12) + 0.5 * count(*) FILTER (abs(mean_r - expectancy_net_r) <= 1e-12)) / (1 + count(*))"


def p_cte(name: str, p: str, summary: str, out: str) -> None:
    cte(name, f"""
SELECT {V}, {out} FROM {p}k JOIN (SELECT gid, {P_VALUE} AS {out} FROM {p}m JOIN (
  SELECT gid, expectancy_net_r FROM {p}k JOIN (SELECT {V}, expectancy_net_r FROM {summary}) USING ({V})) USING (gid) GROUP BY gid) USING (gid)""")


p_cte("npv", "nm", "vs", "p")
add("mc_pvalues", f"SELECT {V}, p AS p_value FROM npv", "rr p_value")
add("null_summaries", f"""
SELECT {V}, null_mean, null_p95, null_std, null_draws FROM nmk JOIN (SELECT gid, avg(mean_r) AS null_mean,
  quantile_cont(mean_r, 0.95) AS null_p95, stddev_pop(mean_r) AS null_std, count(mean_r) AS null_draws FROM nmm GROUP BY gid)
USING (gid)""", "rr null_mean null_p95 null_std")
cte("ci0", f"SELECT {POOL}, date, count(*) AS n, sum(gross_r) AS total FROM el GROUP BY ALL")
boot_ctes("ci", "ci0", POOL, f"(SELECT DISTINCT {POOL} FROM el)", NB_OWN,
          seed("instrument || '|' || session || '|' || CAST(rr AS VARCHAR)", SEED), CI_DRAWS)
for _p, _name, _keys in (("cv", "variant_interval", V), ("cr", "regime_interval", f"{POOL}, regime_window")):
    cte(f"{_p}0", f"SELECT {_keys}, date, count(*) AS n, sum(gross_r) AS total FROM el GROUP BY ALL")
    boot_ctes(_p, f"{_p}0", _keys, f"(SELECT DISTINCT {_keys} FROM el)", NB_OWN,
              seed("concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in _keys.split(", ")) + ")", SEED), CI_DRAWS)
    add(_name, f"""
SELECT {_keys}, ci_lo, ci_hi FROM {_p}k JOIN (SELECT gid, quantile_cont(mean_r, 0.025) AS ci_lo,
  quantile_cont(mean_r, 0.975) AS ci_hi FROM {_p}m GROUP BY gid) USING (gid)""", "rr ci_lo ci_hi")
add("bootstrap_interval", f"""
SELECT {POOL}, ci_lo, ci_hi FROM cik JOIN (SELECT gid, quantile_cont(mean_r, 0.025) AS ci_lo,
  quantile_cont(mean_r, 0.975) AS ci_hi FROM cim GROUP BY gid) USING (gid)""", "rr ci_lo ci_hi")
cte("jk", f"""
SELECT {POOL}, count(*) AS days, CASE WHEN count(*) >= 2 THEN sqrt((count(*) - 1) / count(*) * sum((est - m) ** 2)) END AS jackknife_se
FROM (SELECT *, avg(est) OVER (PARTITION BY {POOL}) AS m FROM (SELECT {POOL}, date, (sum(total) OVER w - total) /
  nullif(sum(n) OVER w - n, 0) AS est FROM pd WINDOW w AS (PARTITION BY {POOL}))) GROUP BY {POOL}""")
add("jackknife", f"SELECT {POOL}, days, jackknife_se FROM jk", "rr jackknife_se")
cte("fd", f"""
SELECT {FAM}, rr, date, n, total FROM pd JOIN (SELECT DISTINCT {FAM}, date FROM el) USING (instrument, session, date)""")
add("fired_day_pools", f"""
SELECT {FAM}, rr, count(*) AS days, CAST(sum(n) AS BIGINT) AS trades, sum(total) AS total FROM fd GROUP BY ALL""", "rr total")
cte("fid", f"SELECT {FAM}, row_number() OVER () AS fid FROM (SELECT DISTINCT {FAM} FROM vs)")
cte("gf", f"SELECT {V}, gid, fid FROM nmk JOIN fid USING ({FAM})")


def t_ctes(p: str, suffix: str) -> None:
    """Studentised draws of the variants (gid) and their maxima over families (fid)."""
    cte(f"mom{suffix}", f"SELECT gid, avg(mean_r) AS m, stddev_pop(mean_r) AS s FROM {p}m GROUP BY gid")
    cte(f"nt{suffix}", f"SELECT gid, draw, (mean_r - m) / nullif(s, 0) AS t FROM {p}m JOIN mom{suffix} USING (gid)")
    cte(f"fnt{suffix}", f"SELECT fid, draw, max(t) AS t FROM nt{suffix} JOIN (SELECT gid, fid FROM {p}k JOIN fid USING ({FAM})) USING (gid) GROUP BY ALL")


t_ctes("nm", "")
t_ctes("n1", "1")
cte("ot", f"SELECT {V}, (expectancy_net_r - m) / nullif(s, 0) AS t FROM vs LEFT JOIN (SELECT {V}, m, s FROM nmk JOIN mom USING (gid)) USING ({V})")
add("studentised_observed", f"SELECT {V}, t FROM ot", "rr t")
cte("fot", f"SELECT {FAM}, max(t) AS t FROM ot GROUP BY ALL")
add("family_maxima", f"SELECT {FAM}, draw, t FROM fnt1 JOIN fid USING (fid)", "t")


def maxt_ctes(p: str, null: str, obs: str, keys: str, ids: str, number: str) -> None:
    cte(f"{p}1", f"""
SELECT {keys}, {number}, obs, rank FROM (SELECT {keys}, t AS obs, row_number() OVER (ORDER BY t DESC, {keys}) AS rank FROM {obs} WHERE t IS NOT NULL)
JOIN {ids} USING ({keys})""")
    cte(f"{p}2", f"""
SELECT rank, obs, max(t) OVER (PARTITION BY draw ORDER BY rank DESC) AS tail FROM {null} JOIN (SELECT {number}, rank, obs FROM {p}1) USING ({number})""")
    cte(f"{p}", f"""
SELECT {keys}, CAST(rank AS INTEGER) AS rank, obs AS t, max(p) OVER (ORDER BY rank) AS p_adj FROM {p}1 JOIN (
  SELECT rank, CASE WHEN count(tail) > 0 THEN (1 + count(*) FILTER (tail >= obs)) / (1 + count(tail)) ELSE 1 END AS p
  FROM {p}2 GROUP BY rank) USING (rank)""")


maxt_ctes("fmx", "fnt", "fot", FAM, "fid", "fid")
maxt_ctes("vmx", "nt", "ot", V, "gf", "gid")
add("maxt_stepdown", f"SELECT {FAM}, rank, t, p_adj FROM fmx", "t p_adj")
cte("q0", "SELECT quantile_cont(t, 0.5) AS split FROM fnt")
cte("q1", "SELECT least(1, greatest(0, (count(*) FILTER (t <= split)) / (0.5 * count(*)))) AS pi0 FROM fot CROSS JOIN q0 WHERE t IS NOT NULL")
cte("q2", f"""
SELECT {FAM}, o.t, least(1, pi0 * ((SELECT count(*) FROM fnt n WHERE n.t >= o.t) / (SELECT count(DISTINCT draw) FROM fnt)) /
  (SELECT count(*) FROM fot z WHERE z.t >= o.t)) AS f FROM fot o CROSS JOIN q1 WHERE o.t IS NOT NULL""")
cte("fdr", f"SELECT {FAM}, t, min(f) OVER (ORDER BY t ASC) AS q_fdr FROM q2")
add("perm_fdr", f"SELECT {FAM}, t, q_fdr FROM fdr", "t q_fdr")
cte("mxn", "SELECT draw, max(t) AS max_t FROM fnt GROUP BY 1")
add("max_null_histogram", """
SELECT bin, count(*) AS draws, lo + bin * (hi - lo) / 10 AS bin_low FROM (
  SELECT *, CAST(least(coalesce(floor((max_t - lo) / nullif((hi - lo) / 10, 0)), 0), 9) AS BIGINT) AS bin
  FROM mxn CROSS JOIN (SELECT min(max_t) AS lo, max(max_t) AS hi FROM mxn)) GROUP BY bin, lo, hi""", "bin_low")
cte("jseedf", f"SELECT {seed(chr(39) + 'joint-bootstrap-fired' + chr(39), SEED)} AS sd0")
boot_ctes("nf", "fd", V, f"(SELECT {V}, trade_count FROM vs)", NB_OBS, "(SELECT sd0 FROM jseedf)", DRAWS)
p_cte("npf", "nf", "vs", "pf")
cte("mult", f"""
SELECT {V}, p AS null_p_broad, pf AS null_p_matched, nx.null_exp_mean, nx.null_exp_p95, pl.null_effective_n, pl.null_pool_trades,
  jackknife_se AS null_mean_jackknife_se, coalesce(null_effective_n, 0) < 250 AS null_unreliable,
  fx.p_adj AS "p_adj_maxT", q_fdr, vx2.p_adj AS "p_adj_maxT_variant",
  (SELECT quantile_cont(max_t, 0.95) FROM mxn) AS "maxT_hurdle_95",
  (SELECT max(t) FROM fot) - (SELECT avg(max_t) FROM mxn) AS selection_adjusted_best_stat,
  (SELECT count(*) FROM fot) AS hypothesis_families, (SELECT count(*) FROM vs) AS hypothesis_variants,
  ek AS multiplicity_effective_k, fx.t AS t_family_obs, null_bootstrap_k,
  coalesce(top5pct_day_pnl_share <= 0.4::DOUBLE AND n_windows_positive >= ceil(0.7::DOUBLE * n_windows_observed), false) AS breadth_pass
FROM vs LEFT JOIN npv USING ({V}) LEFT JOIN npf USING ({V})
LEFT JOIN (SELECT {V}, null_exp_mean, null_exp_p95, null_bootstrap_k FROM nmk JOIN (SELECT gid, avg(mean_r) AS null_exp_mean,
  quantile_cont(mean_r, 0.95) AS null_exp_p95, count(mean_r) AS null_bootstrap_k FROM nmm GROUP BY gid) USING (gid)) nx USING ({V})
LEFT JOIN (SELECT {POOL}, CAST(sum(n) AS BIGINT) AS null_pool_trades, count(*) AS null_effective_n FROM pd GROUP BY ALL) pl USING ({POOL})
LEFT JOIN jk USING ({POOL}) LEFT JOIN fmx fx USING ({FAM}) LEFT JOIN (SELECT {FAM}, q_fdr FROM fdr) USING ({FAM})
LEFT JOIN vmx vx2 USING ({V}) LEFT JOIN (SELECT {FAM}, ek FROM fid JOIN (SELECT fid, count(t) AS ek FROM fnt GROUP BY ALL) USING (fid)) USING ({FAM})""")
cte("mults", """SELECT *, coalesce("p_adj_maxT" <= 0.05, false) AND breadth_pass AS survivor FROM mult""")
add("multiplicity", "SELECT * EXCLUDE (t_family_obs, null_bootstrap_k) FROM mults",
    'rr null_p_broad null_p_matched null_exp_mean null_exp_p95 null_mean_jackknife_se "p_adj_maxT" q_fdr "p_adj_maxT_variant" '
    '"maxT_hurdle_95" selection_adjusted_best_stat')
add("null_section", f"""
WITH f AS (SELECT {FAM}, max(t_family_obs) AS t, max("p_adj_maxT") AS p, max(q_fdr) AS q, bool_or(survivor) AS s,
  max("maxT_hurdle_95") AS h, max(selection_adjusted_best_stat) AS a FROM mults GROUP BY ALL)
SELECT (SELECT count(*) FROM mults) AS variants, (SELECT count(*) FILTER (abs(log10(greatest(null_p_broad, 1e-12))
    - log10(greatest(null_p_matched, 1e-12))) > 1) FROM mults) AS divergent_variants,
  (SELECT quantile_cont(null_effective_n, 0.5) FROM mults) AS median_days_used,
  (SELECT max(null_bootstrap_k) FROM mults) AS bootstrap_draws, count(*) AS families, max(t) AS best_stat, min(p) AS best_p,
  count(*) FILTER (p <= 0.05) AS fwer_families, count(*) FILTER (q <= 0.1) AS fdr_families, count(*) FILTER (s) AS survivors,
  max(h) AS hurdle_95, max(a) AS selection_adjusted_best FROM f""",
    "median_days_used best_stat best_p hurdle_95 selection_adjusted_best")
add("comparator_rates", " UNION ALL ".join(f"""
SELECT '{c}' AS comparator, count(*) AS variants, (count(*) FILTER ({c} < 0.05)) / count(*) * 100 AS pct_below_05,
  (count(*) FILTER ({c} < 0.1)) / count(*) * 100 AS pct_below_10, quantile_cont({c}, 0.5) AS median_p
FROM mult WHERE {c} IS NOT NULL""" for c in ("null_p_broad", "null_p_matched")), "pct_below_05 pct_below_10 median_p")
cte("vp", f"SELECT vs.*, p FROM vs LEFT JOIN npv USING ({V})")
add("p_by_rr", f"""
SELECT rr, count(*) AS variants, avg(p) AS p_mean, quantile_cont(p, 0.5) AS p_median, min(p) AS p_min, max(p) AS p_max,
  1 / (1 + rr) AS walk_hit_rate FROM vp WHERE trade_count >= {MIN_N} GROUP BY rr""",
    "rr p_mean p_median p_min p_max walk_hit_rate")
add("p_correlations", f"""
SELECT corr(self_p, win_rate) AS self_vs_win, corr(p, win_rate) AS p_vs_win, corr(p, expectancy_gross_r) AS p_vs_gross,
  corr(self_p, p) AS self_vs_p FROM sc JOIN (SELECT {V}, win_rate, p, expectancy_gross_r FROM vp) USING ({V})""",
    "self_vs_win p_vs_win p_vs_gross self_vs_p")
add("describe_p", f"""
SELECT count(p) AS variants, avg(p) AS mean, min(p) AS min, max(p) AS max, count(*) FILTER (p <= 0.05) AS at_floor,
  {", ".join(f"quantile_cont(p, {q}) AS p{int(q * 100):02d}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95))}
FROM vp WHERE trade_count >= {MIN_N}""", "mean min max p01 p05 p25 p50 p75 p95")
add("significance_flips", f"""
SELECT count(*) AS rankable, count(*) FILTER (expectancy_net_r > 0) AS net_positive, count(*) FILTER (p < 0.05) AS significant,
  count(*) FILTER (expectancy_net_r > 0 AND p < 0.05) AS both FROM vp WHERE trade_count >= {MIN_N}""")

# --- control sampling --------------------------------------------------------------------------

PAIR = "instrument, session"
TARGET = 200
cte("cd", f"SELECT DISTINCT {PAIR}, regime_window, date FROM o0")
cte("cz", f"""
SELECT *, {TARGET} * size / n_days AS raw, least(size, floor({TARGET} * size / n_days)) AS base FROM (
  SELECT *, CAST(sum(size) OVER (PARTITION BY {PAIR}) AS BIGINT) AS n_days, count(*) OVER (PARTITION BY {PAIR}) AS n_strata FROM (
    SELECT {PAIR}, regime_window, count(*) AS size FROM cd GROUP BY ALL))""".replace("* size / n_days", "* size::DOUBLE / n_days"))
cte("ca", f"""
SELECT *, row_number() OVER (PARTITION BY {PAIR} ORDER BY raw - floor(raw) DESC, CAST(regime_window AS VARCHAR) DESC) AS turn,
  CAST({TARGET} - sum(base) OVER (PARTITION BY {PAIR}) AS BIGINT) AS spare FROM cz""")
cte("cx", f"""
SELECT {PAIR}, regime_window, count(*) AS extra FROM (SELECT *, row_number() OVER (PARTITION BY {PAIR} ORDER BY rnd, turn) AS k FROM (
  SELECT *, unnest(range(1, CAST(least(size - base, spare) AS BIGINT) + 1)) AS rnd FROM ca WHERE least(size - base, spare) > 0))
WHERE k <= spare GROUP BY ALL""")
cte("csd", f"SELECT {PAIR}, {seed(chr(39) + 'days|' + chr(39) + ' || instrument || ' + chr(39) + '|' + chr(39) + ' || session', SEED)} AS sd FROM (SELECT DISTINCT {PAIR} FROM cd)")
add("control_day_sample", f"""
SELECT {PAIR}, regime_window, date, CASE WHEN n_days <= {TARGET} THEN 'exhausted' WHEN n_strata <= 1 THEN 'random' ELSE 'stratified' END AS design,
  n_days FROM (SELECT cd.*, row_number() OVER (PARTITION BY {PAIR}, regime_window ORDER BY
    {draw("sd", "date - DATE '1970-01-01'")}, date) AS rk FROM cd JOIN csd USING ({PAIR}))
JOIN (SELECT ca.*, base + coalesce(extra, 0) AS alloc FROM ca LEFT JOIN cx USING ({PAIR}, regime_window)) USING ({PAIR}, regime_window)
WHERE rk <= CASE WHEN n_days <= {TARGET} THEN size ELSE alloc END""")
add("observed_stratum_weights", f"""
SELECT {FAM}, regime_window, count(DISTINCT date)::DOUBLE AS weight FROM el GROUP BY ALL""", "weight")
add("stop_pool_sizes", f"""
SELECT {FAM}, count(*) AS pool_size, CAST(count(DISTINCT r_ticks) AS INTEGER) AS distinct_stops,
  (list(r_ticks ORDER BY r_ticks))[count(*) // 2 + 1] AS upper_median FROM el GROUP BY ALL""")
KEYTEXT = " || '|' || ".join(f"CAST({k.strip()} AS VARCHAR)" for k in FAM.split(","))
add("stable_seeds", f"""
SELECT *, {draw("seed", "1")} AS first_draw FROM (SELECT *, {seed(KEYTEXT, SEED)} AS seed FROM (SELECT DISTINCT {FAM} FROM o0))""")
VTEXT = " || '|' || ".join(f"CAST({k.strip()} AS VARCHAR)" for k in V.split(","))
add("stratified_variants", f"""
SELECT {V}, trade_count FROM (SELECT *, row_number() OVER (PARTITION BY instrument, rr ORDER BY h, {V}) AS rk FROM (
  SELECT *, {draw("sd", "1")} AS h FROM (SELECT *, {seed(VTEXT, SEED)} AS sd FROM vs))) WHERE rk <= 2 ORDER BY h, {V} LIMIT 40""", "rr")
cte("ib0", "SELECT 1 AS one, row_number() OVER (ORDER BY instrument, session) AS date, 1 AS n, avg(net_r) AS total FROM el GROUP BY instrument, session")
boot_ctes("ib", "ib0", "one", "(SELECT 1 AS one)", "nd", "0", IID_DRAWS, block=1)
add("iid_bootstrap", """
SELECT quantile_cont(mean_r, 0.025) AS ci_lo, quantile_cont(mean_r, 0.975) AS ci_hi FROM ibm""", "ci_lo ci_hi")

# --- holdout -----------------------------------------------------------------------------------

cte("hin", "SELECT * FROM mk WHERE date < DATE '2000-01-01'")
cte("hine", "SELECT * FROM hin WHERE eligible")
cte("hout", "SELECT * FROM mk WHERE date >= DATE '2000-01-01'")
metric_ctes("h", V, "hine", "hin")
cte("hpd", f"SELECT {POOL}, date, count(*) AS n, sum(net_r) AS total FROM hine GROUP BY ALL")
boot_ctes("hn", "hpd", POOL, f"(SELECT {V}, trade_count FROM hs)", NB_OBS, "(SELECT sd0 FROM jseed)", DRAWS)
p_cte("hpv", "hn", "hs", "null_p_value")
cte("hsv", f"""
SELECT {V}, trade_count, expectancy_net_r, null_p_value FROM hs LEFT JOIN hpv USING ({V})
WHERE trade_count >= 3 AND expectancy_net_r > 0 AND null_p_value < 0.5""")
cte("hfam", f"""
SELECT {FAM}, count(*) AS n_rr, string_agg(CAST(rr AS VARCHAR), ',' ORDER BY rr) AS rr_list, max(expectancy_net_r) AS best_net,
  min(null_p_value) AS min_p, max(trade_count) AS trades, first(rr ORDER BY expectancy_net_r DESC, rr) AS best_rr FROM hsv GROUP BY ALL""")
add("survivor_families", "SELECT * FROM hfam", "best_net min_p best_rr")
cte("hoa", f"""
SELECT {V}, count(*) AS ho_trades, avg(gross_r) AS ho_gross, avg(net_r) AS ho_net, (count(*) FILTER (gross_r > 0)) / count(*) AS ho_win
FROM hout WHERE eligible GROUP BY ALL""")
cte("hcm", f"SELECT *, ho_net - expectancy_net_r AS net_delta, ho_net > 0 AS held_up FROM hsv JOIN hoa USING ({V})")
add("holdout_compare", "SELECT * FROM hcm", "rr expectancy_net_r null_p_value ho_gross ho_net ho_win net_delta")
cte("hbf", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {FAM} ORDER BY expectancy_net_r DESC, rr) AS r FROM hcm) WHERE r = 1""")
add("pooled_holdout_test", """
SELECT count(*) AS families, count(*) FILTER (ho_net > 0) AS net_positive, sum(ho_net * ho_trades) / sum(ho_trades) AS weighted_net,
  avg(ho_net) AS simple_net, CAST(sum(ho_trades) AS BIGINT) AS trades FROM hbf""", "weighted_net simple_net")
cte("hib0", f"SELECT 1 AS one, row_number() OVER (ORDER BY {FAM}) AS date, 1 AS n, ho_net AS total FROM hbf")
boot_ctes("hib", "hib0", "one", "(SELECT 1 AS one)", "nd", "0", IID_DRAWS, block=1)
cte("hci", """
SELECT quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi FROM (
  SELECT d, sum(ps[st + w + 1] - ps[st + 1]) / sum(pn[st + w + 1] - pn[st + 1]) AS m FROM hibg GROUP BY d)""")
add("holdout_verdict", f"""
SELECT *, survivor_families <= expected_fp_at_5pct AS below_chance_rate, CASE WHEN holdout_trade_weighted_net_r <= 0 OR ci_includes_zero
  THEN 'NO EDGE ESTABLISHED' ELSE 'CANDIDATE EDGE -- requires forward testing' END AS verdict FROM (
  SELECT *, CAST(families_rankable * 5 // 100 AS BIGINT) AS expected_fp_at_5pct, survivor_families * 100.0 / families_rankable AS survivor_pct_of_families,
    holdout_net_positive * 100.0 / holdout_families_tested AS holdout_net_positive_pct, ci_lo <= 0 AND ci_hi >= 0 AS ci_includes_zero,
    '2000-01-01' AS holdout_start FROM (
    SELECT count(*) AS holdout_families_tested, count(*) FILTER (ho_net > 0) AS holdout_net_positive,
      sum(ho_net * ho_trades) / sum(ho_trades) AS holdout_trade_weighted_net_r, avg(ho_net) AS holdout_simple_mean_net_r,
      CAST(sum(ho_trades) AS BIGINT) AS holdout_trades_pooled, quantile_cont(ho_trades, 0.5) AS median_holdout_trades FROM hbf)
  CROSS JOIN (SELECT count(*) AS families_rankable FROM (SELECT DISTINCT {FAM} FROM hs WHERE trade_count >= 3))
  CROSS JOIN (SELECT count(*) AS survivor_families FROM hfam) CROSS JOIN (SELECT count(*) AS survivor_variants FROM hsv) CROSS JOIN hci)""",
    "holdout_trade_weighted_net_r holdout_simple_mean_net_r median_holdout_trades survivor_pct_of_families holdout_net_positive_pct ci_lo ci_hi")
cte("lc", f"SELECT {SET} FROM sg WHERE total_pnl_usd > 0")
cte("lz", "SELECT sz.*, sz.date >= DATE '2000-01-01' AS late FROM sz WHERE valid AND NOT tp_unfillable")
cte("li1", f"""
SELECT {SET}, count(*) AS is_trades, sum(net_r) AS is_net_r, avg(net_r) AS is_exp, (count(*) FILTER (net_r > 0)) / count(*) AS is_win,
  sum(pnl) AS is_usd, avg(net_r) FILTER (direction = 'long') AS is_exp_long, avg(net_r) FILTER (direction = 'short') AS is_exp_short
FROM lz WHERE NOT late GROUP BY ALL""")
cte("lo1", f"""
SELECT {SET}, count(*) AS ho_trades, sum(net_r) AS ho_net_r, avg(net_r) AS ho_exp, (count(*) FILTER (net_r > 0)) / count(*) AS ho_win,
  sum(pnl) AS ho_usd, (count(*) FILTER (contracts > 0)) / count(*) AS ho_afford, count(*) FILTER (contracts > 0) AS ho_trades_aff,
  avg(net_r) FILTER (contracts > 0) AS ho_exp_aff FROM lz WHERE late GROUP BY ALL""")
cte("lg", f"""
SELECT * REPLACE (coalesce(ho_trades, 0) AS ho_trades, coalesce(ho_trades_aff, 0) AS ho_trades_aff), ho_exp_aff > 0 AS held_up,
  ho_exp > 0 AS held_up_all_trades, abs(is_exp_long - is_exp_short) AS leg_asym,
  coalesce(is_exp_long > 0, false) <> coalesce(is_exp_short > 0, false) AS one_leg_only
FROM lc JOIN li1 USING ({SET}) LEFT JOIN lo1 USING ({SET})""")
add("candidate_legs", "SELECT * FROM lg",
    "rr is_net_r is_exp is_win is_usd is_exp_long is_exp_short ho_net_r ho_exp ho_win ho_usd ho_afford ho_exp_aff leg_asym")
add("leg_summary", """
SELECT count(*) AS setups, count(*) FILTER (held_up) AS held_up, count(held_up) AS judged, quantile_cont(leg_asym, 0.5) AS median_leg_gap,
  count(*) FILTER (one_leg_only) AS one_leg_only FROM lg""", "median_leg_gap")

# --- equity ------------------------------------------------------------------------------------

W = f"(PARTITION BY {SET} ORDER BY date, entry_ts, signal_id)"
cte("eq0", "SELECT *, date + to_minutes(bars_from_open_to_entry) AS entry_ts FROM sz WHERE valid AND NOT tp_unfillable")
cte("eq1", f"""
SELECT *, row_number() OVER {W} AS seq, sum(net_r) OVER {W} AS cum_r, sum(pnl) OVER {W} AS cum_usd FROM eq0""")
cte("eq", f"SELECT *, max(cum_r) OVER {W} AS peak_cum_r, max(cum_usd) OVER {W} AS peak_usd, contracts > 0 AS ex FROM eq1")
add("equity_curve", f"SELECT {SET}, signal_id, seq, net_r, cum_r, cum_usd, peak_cum_r FROM eq",
    "rr net_r cum_r cum_usd peak_cum_r")
add("phased_curve", f"""
SELECT {SET}, CASE WHEN date >= DATE '2000-01-01' THEN 'holdout' ELSE 'in_sample' END AS phase, signal_id, seq, cum_r, cum_usd,
  peak_usd AS peak_cum_usd FROM eq""", "rr cum_r cum_usd peak_cum_usd")
add("curve_stats", f"""
SELECT {SET}, count(*) AS trades, count(*) FILTER (ex) AS trades_executable, (count(*) FILTER (ex)) / count(*) AS executable_pct,
  (count(*) FILTER (net_r > 0)) / count(*) AS win_rate, avg(net_r) AS exp_net_r, sum(net_r) AS total_net_r, sum(pnl) AS total_usd,
  max(peak_cum_r - cum_r) AS max_dd_r, max(peak_usd - cum_usd) AS max_dd_usd, quantile_cont(r_ticks, 0.5) AS sl_med,
  quantile_cont(r_ticks, 0.1) AS sl_p10, quantile_cont(r_ticks, 0.9) AS sl_p90, quantile_cont(tp_ticks, 0.5) AS tp_med,
  avg(contracts) FILTER (ex) AS mean_contracts, avg(deployed) / 900 AS capital_eff, count(*) FILTER (late) AS n_late,
  coalesce(sum(net_r) FILTER (late), 0) AS late_net_r, coalesce(sum(pnl) FILTER (late), 0) AS late_usd, min(date) AS date_min,
  max(date) AS date_max, min(seq - 1) FILTER (late) AS late_idx FROM (SELECT *, date >= DATE '2000-01-01' AS late FROM eq) GROUP BY {SET}""",
    "rr executable_pct win_rate exp_net_r total_net_r total_usd max_dd_r max_dd_usd sl_med sl_p10 sl_p90 tp_med mean_contracts capital_eff late_net_r late_usd")
add("thin_curve", f"""
SELECT {SET}, seq - 1 AS i, date, cum_r, cum_usd FROM (SELECT *, max(seq) OVER (PARTITION BY {SET}) AS n FROM eq)
WHERE (seq - 1) % greatest(1, n // 20) = 0 OR seq = n""", "rr cum_r cum_usd")
add("recent_split", f"""
SELECT {SET}, period, count(*) AS trades, coalesce((count(*) FILTER (ex AND net_r > 0)) / nullif(count(*) FILTER (ex), 0), 0) AS win_rate,
  sum(pnl) AS total_usd, min(date) AS date_min, max(date) AS date_max
FROM eq CROSS JOIN (VALUES ('full', DATE '1900-01-01'), ('recent', DATE '2001-01-01')) p(period, since) WHERE date >= since GROUP BY {SET}, period""",
    "rr win_rate total_usd")
PAIRS = [(i[0], s) for i in INSTRUMENTS for s in i[4]]
add("setup_availability", f"""
SELECT w.instrument, w.session, w.rr, coalesce(c.n, 0) AS trades, CASE WHEN p.instrument IS NULL THEN 'not in the instrument universe'
  WHEN coalesce(c.n, 0) = 0 THEN 'no trades generated' END AS reason, p.instrument IS NOT NULL AND coalesce(c.n, 0) > 0 AS available
FROM (SELECT * FROM (VALUES ('6E'), ('NQ')) a(instrument) CROSS JOIN (VALUES ('NY'), ('LDN'), ('TOK')) b(session)
  CROSS JOIN (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) r(rr)) w
LEFT JOIN (SELECT * FROM {values(PAIRS)} t(instrument, session)) p ON w.instrument = p.instrument AND w.session = p.session
LEFT JOIN (SELECT instrument, session, rr, count(*) AS n FROM fl GROUP BY ALL) c
  ON w.instrument = c.instrument AND w.session = c.session AND w.rr = c.rr""", "rr")
