"""Oracles of the queries over bars, events, barriers, quotes and daily tables."""

from __future__ import annotations

from barloom.sources.views import EVENT_GRID, EVENT_MARKET
from oracles.base import Book, draw, seed, values

SQL: dict[str, str] = {}
BOOK = Book()
cte, statement = BOOK.cte, BOOK.statement
K = "instrument, session, local_date"
EID = f"{K}, range_minutes, entry_mode, closure_tf, direction"


def add(name: str, select: str, doubles: str = "") -> None:
    SQL[name] = statement(select, doubles)


# --- views -------------------------------------------------------------------------------------

cte("ev", "SELECT event_type AS instrument, event_id, ts, CAST(round(value * 100) AS BIGINT) AS v, props FROM events")
cte("bars", """
SELECT instrument, date_trunc('hour', ev.ts) AS ts, first(v ORDER BY ev.ts, event_id) AS o, max(v) AS h, min(v) AS l,
  last(v ORDER BY ev.ts, event_id) AS c, count(*) AS volume, min(event_id) AS ingest_seq,
  upper(substr(instrument, 1, 2))
    || substr('FGHJKMNQUVXZ', CAST(week(date_trunc('hour', ev.ts)) % 12 + 1 AS INTEGER), 1) || '4' AS contract,
  CASE WHEN hour(date_trunc('hour', ev.ts)) % 2 = 0 THEN 'local' ELSE 'databento' END AS source
FROM ev GROUP BY instrument, date_trunc('hour', ev.ts)""")
cte("li", """
SELECT l_returnflag AS instrument, CAST(l_shipdate AS DATE) AS trading_date,
  CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) AS p, CAST(l_quantity AS BIGINT) AS q,
  l_linestatus, l_orderkey, l_linenumber FROM lineitem""")
cte("daily", """
SELECT instrument, trading_date, first(p ORDER BY l_orderkey, l_linenumber) AS o, max(p) AS h, min(p) AS l,
  last(p ORDER BY l_orderkey, l_linenumber) AS c, CAST(sum(q) AS BIGINT) AS volume,
  CASE WHEN count(*) FILTER (l_linestatus = 'O') > count(*) FILTER (l_linestatus = 'F') THEN 'O' ELSE 'F' END AS source
FROM li GROUP BY instrument, trading_date""")
cte("quotes", """
SELECT instrument, ts, v AS bid_t, v + CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS ask_t FROM ev""")
cte("sess", "SELECT * FROM " + values(EVENT_GRID.sessions) + " t(session, tz, open_min, exit_min)")
cte("rmx", "SELECT * FROM " + values([(r,) for r in EVENT_GRID.range_minutes]) + " t(rm)")
cte("clx", "SELECT * FROM " + values(
    [(rm, tf) for rm, tfs in EVENT_GRID.closure_tfs.items() for tf in tfs]) + " t(rm, tf)")
cte("rrx", "SELECT * FROM " + values([(float(r),) for r in EVENT_GRID.rr_levels]) + " t(rr)")

# --- session days ------------------------------------------------------------------------------

cte("sx0", f"""
SELECT b.*, s.session, s.open_min, s.exit_min, timezone(s.tz, timezone('UTC', b.ts)) AS lt FROM bars b CROSS JOIN sess s""")
cte("sx", f"""
SELECT * EXCLUDE (lt), CAST(hour(lt) * 60 + minute(lt) AS INTEGER) AS wall, CAST(lt AS DATE) AS local_date FROM sx0
WHERE hour(lt) * 60 + minute(lt) >= greatest(0, open_min - {EVENT_GRID.context_minutes})
  AND hour(lt) * 60 + minute(lt) < exit_min""")
cte("pos", f"""
SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY ts) - 1 AS p,
  ts - lag(ts) OVER (PARTITION BY {K} ORDER BY ts) > INTERVAL {EVENT_GRID.gap_minutes} MINUTE AS gap FROM sx""")
cte("dq", f"""
SELECT {K}, count(*) FILTER (wall >= open_min) AS in_bars, min(ts) FILTER (wall >= open_min) AS open_ts,
  {", ".join(f"count(*) FILTER (wall >= open_min AND wall < open_min + {r}) AS n{r}" for r in EVENT_GRID.range_minutes)}
FROM sx GROUP BY {K}""")
cte("cutp", f"SELECT {K}, max(p) AS cut_at FROM pos JOIN dq USING ({K}) WHERE gap AND ts <= open_ts GROUP BY {K}")
cte("sb", f"""
SELECT pos.* EXCLUDE (p, gap), CAST(p - coalesce(cut_at, 0) AS INTEGER) AS idx, in_bars,
  least(1.0, in_bars * {EVENT_GRID.bar_minutes} / greatest(1, exit_min - open_min))::DOUBLE AS completeness
FROM pos JOIN dq USING ({K}) LEFT JOIN cutp USING ({K})
WHERE ({" OR ".join(f"n{r} >= {r // EVENT_GRID.bar_minutes}" for r in EVENT_GRID.range_minutes)})
  AND p >= coalesce(cut_at, 0)""")
cte("rg", f"""
SELECT {K}, rm, max(h) AS rh, min(l) AS rl FROM sx CROSS JOIN rmx
WHERE wall >= open_min AND wall < open_min + rm GROUP BY {K}, rm HAVING count(*) >= rm / {EVENT_GRID.bar_minutes}""")
cte("dd", f"""
SELECT {K}, min(idx) FILTER (wall >= open_min) AS open_idx, max(idx) AS last_idx, any_value(in_bars) AS in_bars,
  any_value(completeness) AS completeness, arg_min(o, ts) FILTER (wall >= open_min) AS open_tick,
  count(DISTINCT contract) FILTER (wall >= open_min) > 1 AS changed_in,
  arg_min(contract, ts) FILTER (wall >= open_min) AS first_contract,
  arg_max(contract, ts) FILTER (wall >= open_min) AS last_contract,
  (count(*) FILTER (wall >= open_min AND source = 'local') / count(*) FILTER (wall >= open_min))::DOUBLE AS pct_local
FROM sb GROUP BY {K}""")
cte("dl", """
SELECT *, coalesce(lag(last_contract) OVER (PARTITION BY instrument, session ORDER BY local_date) <> first_contract,
  false) AS changed_since FROM dd""")

add("event_hour_bars", "SELECT instrument, ts, o, h, l, c, volume, contract, source, ingest_seq FROM bars")
add("shipment_daily_bars", "SELECT instrument, trading_date, o, h, l, c, volume, source FROM daily")
add("session_bar_index", f"SELECT {K}, ts, wall, idx, in_bars, completeness FROM sb", "completeness")
add("opening_range_rows", f"""
SELECT {K}, rm AS range_minutes, rh AS range_high, rl AS range_low, rh - rl AS range_width_ticks FROM rg""")
cte("dfb", """
SELECT instrument, CAST(timezone('America/New_York', timezone('UTC', bars.ts)) AS DATE) AS trading_date,
  arg_min(o, bars.ts) AS o, max(h) AS h, min(l) AS l, arg_max(c, bars.ts) AS c, CAST(sum(volume) AS BIGINT) AS volume
FROM bars GROUP BY 1, 2""")
cte("dfx", """
SELECT d.*, lag(c) OVER w AS prev_close, (ln(h / nullif(l, 0)) ** 2) / (4 * ln(2)) AS pv,
  ln(c / nullif(lag(c) OVER w, 0)) AS lr FROM dfb d WINDOW w AS (PARTITION BY instrument ORDER BY trading_date)""")
VOL = """
SELECT *, CASE WHEN count(pv) OVER f >= 7 THEN sqrt(avg(pv) OVER f) * sqrt(252) END AS pk,
  CASE WHEN count(lr) OVER f >= 7 THEN stddev_samp(lr) OVER f * sqrt(252) END AS rv
FROM {src} WINDOW f AS (PARTITION BY instrument ORDER BY trading_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"""
LAGGED = """
SELECT *, lag(pk) OVER w AS parkinson_vol_14d, lag(rv) OVER w AS realized_vol_14d FROM {src}
WINDOW w AS (PARTITION BY instrument ORDER BY trading_date)"""
cte("dfv", VOL.format(src="dfx"))
cte("dff", LAGGED.format(src="dfv"))
cte("enr", """
SELECT b.*, f.prev_close, f.parkinson_vol_14d, f.realized_vol_14d FROM bars b LEFT JOIN dff f
  ON f.instrument = b.instrument
  AND f.trading_date = CAST(timezone('America/New_York', timezone('UTC', b.ts)) AS DATE)""")
add("bars_enriched", "SELECT instrument, ts, prev_close, parkinson_vol_14d, realized_vol_14d FROM enr",
    "parkinson_vol_14d realized_vol_14d")
add("session_day_quality", f"""
SELECT {K}, open_idx, last_idx, in_bars AS session_bars, completeness, open_tick, pc AS prev_close,
  open_tick - pc AS gap_ticks, changed_in, changed_since, pct_local
FROM dl JOIN (SELECT {K}, first(enr.prev_close ORDER BY sb.ts) AS pc FROM sb JOIN enr USING (instrument, ts)
  WHERE wall >= open_min GROUP BY {K}) USING ({K})""", "completeness pct_local")
add("range_completeness", f"""
WITH m AS (SELECT DISTINCT {K}, wall, open_min FROM sx WHERE wall >= open_min),
d AS (SELECT instrument, session, rm, local_date, count(*) AS n FROM m CROSS JOIN rmx WHERE wall < open_min + rm
  GROUP BY ALL)
SELECT instrument, session, rm AS range_minutes, count(*) AS days, count(*) FILTER (n >= rm / 60) AS complete_days,
  count(*) FILTER (n >= rm / 60) * 100.0 / count(*) AS complete_pct FROM d GROUP BY ALL""", "complete_pct")

# --- calendar ----------------------------------------------------------------------------------

add("quote_quality", """
SELECT instrument, count(*) AS quotes, count(*) FILTER (ask_t - bid_t > 0 AND ask_t - bid_t <= 500) AS valid_quotes,
  count(*) FILTER (NOT (ask_t - bid_t > 0 AND ask_t - bid_t <= 500)) AS bad_quotes FROM quotes GROUP BY 1""")
add("launched_quote_months", """
SELECT s.instrument, m.month, m.month AS month_start, CAST(m.month + INTERVAL 1 MONTH AS DATE) AS month_end
FROM (SELECT DISTINCT CAST(date_trunc('month', ts) AS DATE) AS month FROM quotes) m CROSS JOIN
  (VALUES ('click', DATE '2024-01-01'), ('view', DATE '2024-02-15'), ('error', DATE '2024-01-20'),
          ('signup', DATE '2024-02-01')) s(instrument, data_start)
WHERE CAST(m.month + INTERVAL 1 MONTH AS DATE) > s.data_start""")
cte("span", """
SELECT instrument, min(trading_date) AS first_date, max(trading_date) AS last_date FROM daily GROUP BY 1""")
cte("wbase", """
SELECT *, (year(lastd) - year(first_month)) * 12 + month(lastd) - month(first_month) + 1 AS n_months FROM (
  SELECT instrument, CAST(last_date - INTERVAL 3 MONTH AS DATE) AS lastd,
    CASE WHEN day(first_date) = 1 THEN first_date
      ELSE CAST(date_trunc('month', first_date) + INTERVAL 1 MONTH AS DATE) END AS first_month FROM span)""")
cte("wgaps", f"""
SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY rnd, gap) AS gap_rank FROM (
  SELECT instrument, first_month, n, n_months - n * 6 AS spare, unnest(range(n + 1)) AS gap,
    {draw(seed("'regime|42'", 42), "gap")} AS rnd
  FROM (SELECT *, least(10, n_months // 6) AS n FROM wbase) WHERE n > 0)""".replace("unnest(range(n + 1)) AS gap,", "gap,").replace(
    "FROM (SELECT *, least(10, n_months // 6) AS n FROM wbase) WHERE n > 0",
    "FROM (SELECT *, unnest(range(n + 1)) AS gap FROM (SELECT *, least(10, n_months // 6) AS n FROM wbase) WHERE n > 0)"))
cte("wstart", """
SELECT instrument, gap, n, CAST(first_month + to_months(CAST(before + gap * 6 AS INTEGER)) AS DATE) AS window_start FROM (
  SELECT *, sum(spare // (n + 1) + CASE WHEN gap_rank <= spare % (n + 1) THEN 1 ELSE 0 END)
    OVER (PARTITION BY instrument ORDER BY gap) AS before FROM wgaps)""")
cte("win", """
SELECT instrument, CAST(gap AS INTEGER) AS regime_window, window_start,
  CAST(window_start + INTERVAL 6 MONTH - INTERVAL 1 DAY AS DATE) AS window_end FROM wstart WHERE gap < n""")
add("regime_window_list", "SELECT instrument, regime_window, window_start, window_end FROM win")
add("windowed_bar_counts", """
SELECT d.instrument, w.regime_window, count(*) AS bars, CAST(sum(volume) AS BIGINT) AS volume
FROM daily d JOIN win w ON d.instrument = w.instrument AND d.trading_date BETWEEN w.window_start AND w.window_end
GROUP BY 1, 2""")
add("span_and_density", """
SELECT *, bars / greatest(span_days, 1) AS bars_per_day FROM (
  SELECT instrument, count(*) AS bars, CAST(min(ts) AS DATE) AS first_date, CAST(max(ts) AS DATE) AS last_date,
    CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS INTEGER) AS span_days FROM bars GROUP BY 1)
""", "bars_per_day")
add("bars_by_year_hour", """
SELECT instrument, CAST(year(ts) AS INTEGER) AS year, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS bars
FROM bars GROUP BY ALL""")
add("holdout_bar_counts", """
SELECT instrument, count(*) AS bars, min(ts) AS first_ts FROM bars WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1""")

# --- bars --------------------------------------------------------------------------------------

cte("two", """
SELECT instrument, ts, o, h, l, c, volume, contract, 'databento' AS source, ingest_seq FROM bars
UNION ALL SELECT instrument, ts, o, h, l, c + hour(ts) + 1, volume, contract, 'local', ingest_seq FROM bars WHERE hour(ts) % 3 = 0
UNION ALL SELECT instrument, ts, o, h, l, c, volume + 7, contract, 'databento', ingest_seq + 1000000 FROM bars
  WHERE hour(ts) % 5 = 0""")
add("bars_dedup", """
SELECT instrument, ts, o, h, l, c, volume, contract, source, ingest_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY instrument, ts ORDER BY
    CASE source WHEN 'databento' THEN 2 WHEN 'local' THEN 1 ELSE 0 END DESC, ingest_seq DESC) AS r FROM two) WHERE r = 1""")
add("bars_ingested", """
SELECT instrument, ts, o, h, l, c, volume, last_value(CASE WHEN hour(ts) % 4 <> 0 THEN contract END IGNORE NULLS) OVER (
    PARTITION BY instrument ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS contract, source, ingest_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY instrument, ts ORDER BY
    CASE source WHEN 'databento' THEN 2 WHEN 'local' THEN 1 ELSE 0 END DESC, ingest_seq DESC) AS r FROM two
  WHERE NOT (source = 'local' AND instrument = 'view')) WHERE r = 1""")
add("overlap_report", """
SELECT instrument, count(*) AS overlap_ts, avg(d) AS mean_close_diff FROM (
  SELECT instrument, ts, max(c) - min(c) AS d FROM two GROUP BY ALL HAVING count(*) > 1) GROUP BY 1""", "mean_close_diff")
add("source_splices", """
SELECT instrument, CAST(trading_date AS TIMESTAMP) AS ts, prev_source, source FROM (
  SELECT *, lag(source) OVER (PARTITION BY instrument ORDER BY trading_date) AS prev_source FROM daily)
WHERE prev_source IS NOT NULL AND prev_source <> source""")
cte("half", """
SELECT * EXCLUDE (source), CASE WHEN day(ts) < 15 THEN 'local' ELSE 'databento' END AS source,
  CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS day,
  abs(c / nullif(lag(c) OVER (PARTITION BY instrument ORDER BY ts), 0) - 1) AS ret FROM bars""")
add("splice_report", """
WITH d AS (SELECT instrument, day, count(*) AS bar_count, avg(ret) AS mean_abs_return,
    (count(*) FILTER (volume <= 0)) / count(*) AS zero_volume_fraction FROM half GROUP BY ALL),
m AS (SELECT instrument, day, first(source ORDER BY n DESC, source) AS source FROM (
    SELECT instrument, day, source, count(*) AS n FROM half GROUP BY ALL) GROUP BY ALL),
s AS (SELECT instrument, ts AS boundary_ts, day AS boundary FROM (SELECT *, lag(source) OVER (
    PARTITION BY instrument ORDER BY ts) AS ps FROM half) WHERE ps <> source)
SELECT instrument, boundary_ts, day, bar_count, mean_abs_return, zero_volume_fraction::DOUBLE AS zero_volume_fraction,
  source, CAST(day - boundary AS INTEGER) AS distance
FROM d JOIN m USING (instrument, day) JOIN s USING (instrument) WHERE abs(day - boundary) <= 6""",
    "mean_abs_return zero_volume_fraction")
add("contract_fill", """
SELECT instrument, ts, last_value(CASE WHEN hour(ts) % 4 <> 0 THEN contract END IGNORE NULLS) OVER (
  PARTITION BY instrument ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS contract FROM bars""")
add("abs_returns", "SELECT instrument, ts, ret AS abs_return FROM half", "abs_return")
cte("b4", """
SELECT instrument, bin, arg_min(o, ts) AS o, max(h) AS h, min(l) AS l, arg_max(c, ts) AS c FROM (
  SELECT *, date_trunc('minute', lt) - to_minutes(CAST(((hour(lt) * 60 + minute(lt) - 1080 + 1440) % 1440) % 240 AS BIGINT)) AS bin
  FROM (SELECT *, timezone('America/New_York', timezone('UTC', ts)) AS lt FROM bars)) GROUP BY 1, 2""")
cte("trx", """
SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(h - l, abs(h - pc), abs(l - pc)) END AS tr,
  row_number() OVER (PARTITION BY instrument ORDER BY bin) AS i FROM (
  SELECT *, lag(c) OVER (PARTITION BY instrument ORDER BY bin) AS pc FROM b4)""")
cte("atl", "SELECT instrument, list(tr::DOUBLE ORDER BY bin) FILTER (tr IS NOT NULL) AS trs FROM trx GROUP BY 1")
cte("atrx", """
SELECT x.*, CASE WHEN i - 1 >= 14 THEN list_reduce(trs[1:i - 1], lambda a, z: a * 13 / 14 + z / 14) END AS atr
FROM trx x JOIN atl USING (instrument)""")
cte("atrp", "SELECT *, lag(atr) OVER (PARTITION BY instrument ORDER BY bin) AS atr_prev FROM atrx")
add("atr_wilder", "SELECT instrument, bin, o, h, l, c, tr, atr, atr_prev FROM atrp", "atr atr_prev")
add("atr_attached", """
SELECT b.instrument, b.ts, a.atr_prev AS atr_4h FROM (
  SELECT *, date_trunc('minute', lt) - to_minutes(CAST(((hour(lt) * 60 + minute(lt) - 1080 + 1440) % 1440) % 240 AS BIGINT)) AS bin
  FROM (SELECT *, timezone('America/New_York', timezone('UTC', ts)) AS lt FROM bars)) b
LEFT JOIN atrp a ON a.instrument = b.instrument AND a.bin = b.bin""", "atr_4h")
cte("dvx", """
SELECT d.*, lag(c) OVER w AS prev_close, (ln(h / nullif(l, 0)) ** 2) / (4 * ln(2)) AS pv,
  ln(c / nullif(lag(c) OVER w, 0)) AS lr FROM daily d WINDOW w AS (PARTITION BY instrument ORDER BY trading_date)""")
cte("dvv", VOL.format(src="dvx"))
cte("dvf", LAGGED.format(src="dvv"))
add("daily_volatility", """
SELECT instrument, trading_date, prev_close, h - l AS range_ticks, parkinson_vol_14d, realized_vol_14d FROM dvf""",
    "parkinson_vol_14d realized_vol_14d")
add("contract_composition", """
SELECT instrument, contract, count(*) AS bars, coalesce(m.name, '?') AS month, '' AS liquidity FROM bars
LEFT JOIN (VALUES ('F', 'Jan'), ('G', 'Feb'), ('H', 'Mar'), ('J', 'Apr'), ('K', 'May'), ('M', 'Jun'), ('N', 'Jul'),
  ('Q', 'Aug'), ('U', 'Sep'), ('V', 'Oct'), ('X', 'Nov'), ('Z', 'Dec')) m(code, name) ON substr(contract, 3, 1) = m.code
GROUP BY ALL""")
add("contract_counts", """
SELECT instrument, count(*) AS bars, count(DISTINCT coalesce(contract, '')) AS contracts,
  count(*) / count(DISTINCT coalesce(contract, '')) AS bars_per_contract FROM bars GROUP BY 1""", "bars_per_contract")

# --- events ------------------------------------------------------------------------------------

S = f"{K}, rm, dir"
cte("xs", f"""
SELECT {K}, rm, dir, sgn, idx, sb.ts, wall - open_min - rm AS rel, source, contract, sgn * o AS so,
  CASE WHEN sgn = 1 THEN h ELSE -l END AS hs, CASE WHEN sgn = 1 THEN l ELSE -h END AS ls, sgn * c AS cs,
  CASE WHEN sgn = 1 THEN rh ELSE -rl END AS b, CASE WHEN sgn = 1 THEN rl ELSE -rh END AS opp
FROM sb JOIN rg USING ({K}) CROSS JOIN (VALUES ('long', 1), ('short', -1)) d(dir, sgn)""")
cte("brk", f"SELECT {S}, min(idx) AS brk_idx FROM xs WHERE rel >= 0 AND hs >= b + 1 GROUP BY ALL")
cte("tap", f"""
SELECT {S}, brk_idx, min(idx) AS tap_at FROM xs JOIN brk USING ({S}) WHERE rel >= 0 AND idx > brk_idx AND ls <= b
GROUP BY ALL""")
cte("sig", f"""
SELECT {S}, 'II' AS mode, 60 AS tf, brk_idx AS entry_idx, brk_idx, NULL::INTEGER AS tap_idx FROM brk
UNION ALL SELECT {S}, 'TI', 60, tap_at, brk_idx, tap_at FROM tap
UNION ALL SELECT {S}, 'R-II', 60, min(idx), brk_idx, tap_at FROM xs JOIN tap USING ({S})
  WHERE rel >= 0 AND idx > tap_at AND hs >= b + 1 GROUP BY {S}, brk_idx, tap_at
UNION ALL SELECT {S}, 'CC', tf, e, brk_idx, NULL FROM (SELECT {S}, tf, min(idx) AS e FROM xs JOIN clx USING (rm)
  WHERE rel >= 0 AND rel % tf = tf - 60 AND cs > b GROUP BY {S}, tf) LEFT JOIN brk USING ({S})
UNION ALL SELECT {S}, 'R-CC', tf, min(idx), brk_idx, tap_at FROM xs JOIN clx USING (rm) JOIN tap USING ({S})
  WHERE rel >= 0 AND idx > tap_at AND rel % tf = tf - 60 AND cs > b GROUP BY {S}, tf, brk_idx, tap_at""")
cte("sgp", f"""
SELECT s.*, x.sgn, x.ts AS entry_ts, x.source AS entry_source, x.contract AS entry_contract, x.b, x.opp,
  CASE WHEN mode IN ('II', 'R-II') THEN greatest(x.b + 1, x.so) WHEN mode = 'TI' THEN x.b ELSE x.cs END AS f,
  mode IN ('II', 'R-II') AND x.so > x.b + 1 AS gap_fill, mode IN ('CC', 'R-CC') AS at_close,
  coalesce(brk_idx, entry_idx) AS anchor
FROM sig s JOIN xs x ON {" AND ".join(f"s.{c} = x.{c}" for c in ("instrument", "session", "local_date", "rm", "dir"))}
  AND x.idx = s.entry_idx""")


def stop_ctes(prefix: str, anchors: str) -> None:
    """CTEs ``{prefix}3``: run start, level per (side, anchor) of ``anchors``."""
    cte(f"{prefix}1", f"""
SELECT a.*, max(x.idx) FILTER (x.cs < x.so) AS e FROM ({anchors}) a LEFT JOIN xs x
  ON {" AND ".join(f"a.{c} = x.{c}" for c in ("instrument", "session", "local_date", "rm", "dir"))}
  AND x.idx < a.anchor AND x.idx >= a.anchor - 50 GROUP BY ALL""")
    cte(f"{prefix}2", f"""
SELECT * EXCLUDE (mx), coalesce(mx + 1, greatest(anchor - 50, 0)) AS st FROM (
SELECT a.*, max(x.idx) FILTER (NOT x.cs < x.so AND x.idx < e) AS mx
FROM {prefix}1 a LEFT JOIN xs x
  ON {" AND ".join(f"a.{c} = x.{c}" for c in ("instrument", "session", "local_date", "rm", "dir"))}
  AND x.idx < a.anchor AND x.idx >= a.anchor - 50 GROUP BY ALL)""")
    cte(f"{prefix}3", f"""
SELECT a.*, min(x.ls) FILTER (x.idx BETWEEN st AND e) AS lev FROM {prefix}2 a LEFT JOIN xs x
  ON {" AND ".join(f"a.{c} = x.{c}" for c in ("instrument", "session", "local_date", "rm", "dir"))}
  AND x.idx < a.anchor AND x.idx >= a.anchor - 50 GROUP BY ALL""")


stop_ctes("run", f"SELECT DISTINCT {S}, anchor FROM sgp")
STOP = """
  CASE WHEN e IS NULL THEN least(opp, f - 4) ELSE least(lev, f - 4) END AS sl,
  CAST(CASE WHEN e IS NULL THEN 0 ELSE anchor - st END AS INTEGER) AS sl_bars_back,
  CASE WHEN anchor <= 0 THEN 'no_prior_bars'
    WHEN e IS NULL THEN CASE WHEN f - 4 <= opp THEN 'min_floor_applied' ELSE 'range_fallback' END
    WHEN lev > f - 4 THEN 'min_floor_applied' ELSE 'cluster' END AS sl_source"""
cte("sgs", f"SELECT g.*, last_idx, open_idx, {STOP} FROM sgp g JOIN run3 USING ({S}, anchor) JOIN dd USING ({K})")
RENAME = "rm AS range_minutes, mode AS entry_mode, tf AS closure_tf, dir AS direction"
for name, mode in (("breakouts", "II"), ("closes_confirmed", "CC"), ("tap_ins", "TI"), ("rebreakouts", "R-II"),
                   ("recloses", "R-CC")):
    add(name, f"""
SELECT {K}, {RENAME}, entry_idx, brk_idx AS breakout_idx, tap_idx, sgn * f AS fill_t, gap_fill, entry_ts
FROM sgs WHERE mode = '{mode}'""")
add("swing_stops", f"SELECT {K}, {RENAME}, sgn * sl AS sl_t, sl_bars_back, sl_source FROM sgs")
add("opposite_boundary", f"""
WITH far AS (SELECT {S}, min(idx) AS far_idx FROM xs WHERE rel >= 0 AND ls <= opp GROUP BY ALL),
ins AS (SELECT {S}, min(idx) AS in_idx FROM xs JOIN dd USING ({K}) WHERE idx >= open_idx AND ls <= opp GROUP BY ALL)
SELECT {K}, {RENAME}, entry_idx - open_idx AS bars_from_open_to_entry, in_idx IS NOT NULL AS opp_broken_session,
  coalesce(in_idx <= entry_idx, false) AS opp_broken_pre_entry, far_idx IS NOT NULL AS opp_broken_after_range,
  coalesce(far_idx <= entry_idx, false) AS opp_broken_after_range_pre_entry
FROM sgs LEFT JOIN far USING ({S}) LEFT JOIN ins USING ({S})""")

# --- barriers ----------------------------------------------------------------------------------


def barrier_ctes(prefix: str, events: str, key: str) -> None:
    """``{prefix}o``: events × levels with their outcome. ``key`` identifies an event."""
    on = " AND ".join(f"v.{c} = x.{c}" for c in ("instrument", "session", "local_date", "rm", "dir"))
    cte(f"{prefix}v", f"""
SELECT *, f - sl AS rs, abs(f - sl) AS r, entry_idx + CASE WHEN at_close THEN 1 ELSE 0 END AS start_idx,
  CASE WHEN sl >= f THEN 'SL_WRONG_SIDE' WHEN abs(f - sl) < 1 THEN 'DEGENERATE_R'
    WHEN entry_idx + CASE WHEN at_close THEN 1 ELSE 0 END > last_idx THEN 'NO_HOLD_BARS' END AS bad
FROM {events} CROSS JOIN rrx""")
    cte(f"{prefix}t", f"""
SELECT {key}, rr, min(x.idx * 4 + CASE WHEN so <= sl THEN 0 WHEN so >= f + rr * r THEN 1 WHEN ls <= sl THEN 2
  WHEN hs >= f + rr * r + 1 THEN 3 END) AS touch
FROM {prefix}v v JOIN xs x ON {on} AND x.idx >= start_idx WHERE bad IS NULL GROUP BY ALL""".replace(
        f"SELECT {key}", "SELECT " + ", ".join("v." + k.strip() for k in key.split(","))))
    cte(f"{prefix}e", f"""
SELECT *, CASE WHEN bad IS NULL THEN coalesce(touch // 4, last_idx) END AS exit_idx, touch % 4 AS kind
FROM {prefix}v LEFT JOIN {prefix}t USING ({key}, rr)""")
    cte(f"{prefix}m", f"""
SELECT {", ".join("v." + k.strip() for k in key.split(","))}, v.rr, greatest(0, max(f - ls)) / any_value(r) AS adv,
  greatest(0, max(hs - f)) / any_value(r) AS fav
FROM {prefix}e v JOIN xs x ON {on} AND x.idx BETWEEN start_idx AND exit_idx WHERE bad IS NULL GROUP BY ALL""")
    cte(f"{prefix}o", f"""
SELECT v.*, x.ts AS exit_ts, adv, fav,
  CASE WHEN bad IS NOT NULL THEN bad WHEN kind IN (0, 2) THEN 'SL' WHEN kind IN (1, 3) THEN 'TP' ELSE 'TIME' END AS reason,
  CASE WHEN bad IS NULL THEN CASE WHEN kind IN (0, 1) THEN so::DOUBLE WHEN kind = 2 THEN sl::DOUBLE
    WHEN kind = 3 THEN f + v.rr * r ELSE cs::DOUBLE END END AS ex,
  coalesce(kind = 2 AND hs >= f + v.rr * r + 1, false) AS amb
FROM {prefix}e v LEFT JOIN xs x ON {on} AND x.idx = v.exit_idx LEFT JOIN {prefix}m m ON {" AND ".join(
        f"m.{k.strip()} = v.{k.strip()}" for k in key.split(","))} AND m.rr = v.rr""")


barrier_ctes("bo", "sgs", f"{S}, mode, tf")
add("barrier_outcomes", f"""
SELECT {K}, {RENAME}, rr, r AS r_ticks, reason AS exit_reason, exit_idx, sgn * ex AS exit_t,
  exit_ts, CASE WHEN bad IS NULL THEN exit_idx - start_idx + 1 ELSE 0 END AS bars_held,
  (ex - f) / r AS gross_r, CASE WHEN amb THEN rr ELSE (ex - f) / r END AS gross_r_optimistic, amb AS same_bar_ambiguous,
  CASE WHEN bad IS NULL THEN rr * r END AS tp_ticks, coalesce(bad IS NULL AND rr * r < 1, false) AS tp_unfillable
FROM boo""", "exit_t gross_r gross_r_optimistic tp_ticks rr")
add("barrier_excursions", f"""
SELECT {K}, {RENAME}, rr, -adv AS mae_r, fav AS mfe_r FROM boo""", "mae_r mfe_r rr")
add("breakout_hit_rate", """
SELECT instrument, session, rm AS range_minutes, dir AS direction, count(*) AS events,
  count(*) FILTER (reason = 'TP') AS targets, count(*) FILTER (reason = 'SL') AS stops,
  avg(CASE WHEN reason = 'TP' THEN 1.0 ELSE 0.0 END) AS hit_rate, avg((ex - f) / r) AS mean_gross_r
FROM boo WHERE mode = 'II' AND rr = 1.0 GROUP BY ALL""", "hit_rate mean_gross_r")

# --- journal -----------------------------------------------------------------------------------

cte("emk", "SELECT instrument, tick_value, asset_class FROM " + values(
    [(i[0], i[2], i[6]) for i in EVENT_MARKET.instruments]) + " t(instrument, tick_value, asset_class)")
cte("esl", "SELECT * FROM " + values(EVENT_MARKET.slippage_by_session) + " t(instrument, session, s1)")
cte("esi", "SELECT * FROM " + values(EVENT_MARKET.slippage_by_instrument) + " t(instrument, s2)")
cte("ecs", "SELECT DISTINCT instrument, fee FROM " + values(
    [(s[0], s[4]) for s in EVENT_MARKET.contract_specs if s[1] == "full"]) + " t(instrument, fee)")
COST = "(coalesce(fee, 3.1::DOUBLE) / tick_value + coalesce(s1, s2, 1.0::DOUBLE))"
CONTRACTS = "CASE WHEN r * tick_value > 0 THEN least(greatest(floor(900 / (r * tick_value)), 0), 10) ELSE 0 END"


def journal_cte(name: str, src: str) -> None:
    cte(name, f"""
SELECT v.*, tick_value, changed_in, changed_since, pct_local, completeness, (ex - f) / r AS gross_r,
  CASE WHEN bad IS NULL THEN {COST} / r END AS cost_r,
  CASE WHEN bad IS NULL THEN (ex - f) / r - {COST} / r END AS net_r, CAST({CONTRACTS} AS BIGINT) AS contracts
FROM {src} v JOIN dl USING ({K}) LEFT JOIN emk USING (instrument) LEFT JOIN esl USING (instrument, session)
LEFT JOIN esi USING (instrument) LEFT JOIN ecs USING (instrument)""")


journal_cte("jr", "boo")
T = "0.01::DOUBLE"
add("journal_rows", f"""
SELECT local_date AS date, dayname(local_date) AS day_of_week, instrument, session, rm AS range_minutes,
  CASE WHEN sgn = 1 THEN b ELSE -opp END * {T} AS range_high, CASE WHEN sgn = 1 THEN opp ELSE -b END * {T} AS range_low,
  CASE WHEN sgn = 1 THEN b - opp ELSE b - opp END AS range_width_ticks, mode AS entry_mode, tf AS closure_tf,
  dir AS direction, entry_ts, entry_source, entry_contract, sgn * f * {T} AS entry_price, sgn * sl * {T} AS sl_price,
  rr, r AS r_ticks, exit_ts, sgn * ex * {T} AS exit_price, reason AS exit_reason, net_r, cost_r,
  net_r * (r * tick_value) AS net_usd, contracts, completeness AS session_bar_completeness,
  changed_in AS contract_changed_in_session, changed_since AS contract_changed_since_prev_session,
  pct_local AS pct_bars_from_local FROM jr""",
    "range_high range_low entry_price sl_price rr exit_price net_r cost_r net_usd session_bar_completeness pct_bars_from_local")
cte("enr2", """
SELECT e.*, a.atr_prev AS atr_4h FROM (SELECT *, date_trunc('minute', lt) - to_minutes(CAST(((hour(lt) * 60 + minute(lt) - 1080 + 1440) % 1440) % 240 AS BIGINT)) AS bin
  FROM (SELECT *, timezone('America/New_York', timezone('UTC', ts)) AS lt FROM enr)) e
LEFT JOIN atrp a ON a.instrument = e.instrument AND a.bin = e.bin""")
cte("dctx", f"""
SELECT {K}, first(x.atr_4h ORDER BY sb.ts) AS atr_4h, first(x.prev_close ORDER BY sb.ts) AS prev_close,
  first(x.parkinson_vol_14d ORDER BY sb.ts) AS parkinson_vol_14d, first(x.realized_vol_14d ORDER BY sb.ts) AS realized_vol_14d
FROM sb JOIN (SELECT instrument, ts, atr_4h, prev_close, parkinson_vol_14d, realized_vol_14d FROM enr2) x USING (instrument, ts)
WHERE wall >= open_min GROUP BY {K}""")
cte("jctx", f"""
SELECT j.*, atr_4h, prev_close, parkinson_vol_14d, realized_vol_14d, open_tick - prev_close AS gap_ticks,
  CASE WHEN atr_4h > 0 AND bad IS NULL THEN rr * r / atr_4h END AS tp_to_atr_ratio
FROM jr j JOIN dctx USING ({K}) JOIN (SELECT {K}, open_tick FROM dd) USING ({K})""")
add("journal_context", f"""
SELECT local_date AS date, instrument, session, {RENAME}, rr, atr_4h, tp_to_atr_ratio, coalesce(tp_to_atr_ratio > 2.5, false) AS atr_exceeds_cap,
  prev_close, gap_ticks, parkinson_vol_14d, realized_vol_14d, open_idx AS context_bars_available, gross_r * (r * tick_value) AS gross_usd,
  -adv AS mae_r, fav AS mfe_r, CASE WHEN bad IS NULL THEN sgn * (f + rr * r) END * {T} AS tp_price, r AS sl_distance_ticks,
  at_close AS fill_at_bar_close FROM jctx""",
    "rr atr_4h tp_to_atr_ratio parkinson_vol_14d realized_vol_14d gross_usd mae_r mfe_r tp_price")
FLAGS = """
  (reason IN ('INVALID', 'SL_WRONG_SIDE', 'DEGENERATE_R', 'NO_HOLD_BARS')) AS x1,
  (bad IS NULL AND rr * r < 1) AS x2, coalesce(CASE WHEN bad IS NULL THEN rr * r END < 4, true) AS x3, (r < 8) AS x4,
  coalesce(cost_r > 0.15::DOUBLE, true) AS x5, (contracts <= 0) AS x6, (changed_in OR changed_since) AS x7,
  (completeness < 0.9::DOUBLE) AS x8"""
cte("jm", f"SELECT *, NOT (x1 OR x2 OR x3 OR x4 OR x5 OR x6 OR x7 OR x8) AS eligible FROM (SELECT *, {FLAGS} FROM jr)")
EV = "instrument, session, rm, mode, tf, dir, rr"
RULE_SUMS = ", ".join(f"count(*) FILTER (x{i}) AS n_{n}" for i, n in enumerate((
    "excluded_invalid_exit", "excluded_unfillable_tp", "excluded_small_tp", "excluded_small_sl",
    "excluded_high_friction", "excluded_unaffordable", "excluded_roll_day", "excluded_incomplete_session"), 1))
add("event_journal_summary", f"""
WITH day AS (SELECT {EV}, local_date, sum(gross_r) AS g FROM jm WHERE eligible GROUP BY ALL),
cum AS (SELECT *, sum(g) OVER (PARTITION BY {EV} ORDER BY local_date) AS c FROM day),
pk AS (SELECT *, max(c) OVER (PARTITION BY {EV} ORDER BY local_date) - c AS dd FROM cum),
dd2 AS (SELECT {EV}, max(dd) AS max_drawdown_r, count(*) AS n_distinct_days FROM pk GROUP BY ALL),
m AS (SELECT {EV}, count(*) AS trade_count, count(*) FILTER (gross_r > 0) / count(*) AS win_rate,
  avg(gross_r) AS expectancy_gross_r, avg(net_r) AS expectancy_net_r, -avg(adv) AS avg_mae_r, avg(fav) AS avg_mfe_r
  FROM jm WHERE eligible GROUP BY ALL),
x AS (SELECT {EV}, {RULE_SUMS} FROM jm GROUP BY ALL)
SELECT instrument, session, {RENAME}, rr, trade_count, win_rate, expectancy_gross_r, expectancy_net_r, max_drawdown_r,
  n_distinct_days, avg_mae_r, avg_mfe_r, {", ".join(f"n_{n}" for n in (
    "excluded_invalid_exit", "excluded_unfillable_tp", "excluded_small_tp", "excluded_small_sl",
    "excluded_high_friction", "excluded_unaffordable", "excluded_roll_day", "excluded_incomplete_session"))}
FROM m JOIN dd2 USING ({EV}) JOIN x USING ({EV})""",
    "rr win_rate expectancy_gross_r expectancy_net_r max_drawdown_r avg_mae_r avg_mfe_r")
add("holdout_from_bars", f"""
WITH m AS (SELECT *, {FLAGS} FROM jctx WHERE local_date >= DATE '2024-01-20')
SELECT instrument, session, {RENAME}, rr, count(*) AS ho_trades, avg(gross_r) AS ho_gross, avg(net_r) AS ho_net,
  (count(*) FILTER (gross_r > 0)) / count(*) AS ho_win, count(*) FILTER (tp_to_atr_ratio > 2.5) AS capped,
  avg(tp_to_atr_ratio) AS tp_to_atr, CAST(sum(gap_ticks) AS BIGINT) AS gap_ticks, avg(realized_vol_14d) AS realized_vol,
  avg(parkinson_vol_14d) AS parkinson_vol
FROM m WHERE NOT (x1 OR x2 OR x3 OR x4 OR x5 OR x6 OR x7 OR x8) GROUP BY ALL""",
    "rr ho_gross ho_net ho_win tp_to_atr realized_vol parkinson_vol")
add("event_exit_mix", """
SELECT instrument, count(*) FILTER (reason = 'TP') * 100.0 / count(*) AS tp, count(*) FILTER (reason = 'SL') * 100.0 / count(*) AS sl,
  count(*) FILTER (reason = 'TIME') * 100.0 / count(*) AS time,
  count(*) FILTER (reason = 'NO_HOLD_BARS') * 100.0 / count(*) AS no_hold_bars
FROM boo WHERE reason IN ('TP', 'SL', 'TIME', 'NO_HOLD_BARS') GROUP BY 1""", "tp sl time no_hold_bars")
add("event_day_coverage", """
WITH v AS (SELECT * FROM boo WHERE bad IS NULL),
a AS (SELECT instrument, session, count(DISTINCT local_date) AS days_available FROM v GROUP BY ALL),
f AS (SELECT instrument, session, rm, mode, tf, dir, count(DISTINCT local_date) AS days_traded FROM v WHERE rr = 1.0 GROUP BY ALL)
SELECT instrument, session, rm AS range_minutes, mode AS entry_mode, tf AS closure_tf, dir AS direction, days_traded,
  days_available, days_traded * 100.0 / days_available AS coverage_pct FROM f JOIN a USING (instrument, session)""", "coverage_pct")

# --- quotes ------------------------------------------------------------------------------------

cte("sq", """
SELECT *, wall - open_min AS minute FROM (SELECT instrument, session, open_min, exit_min, sp,
  hour(lt) * 60 + minute(lt) AS wall FROM (SELECT q.instrument, q.ask_t - q.bid_t AS sp, s.*,
    timezone(s.tz, timezone('UTC', q.ts)) AS lt FROM quotes q CROSS JOIN sess s
    WHERE q.ask_t - q.bid_t > 0 AND q.ask_t - q.bid_t <= 500)) WHERE wall >= open_min AND wall < exit_min""")
cte("sps", """
SELECT instrument, session, count(*) AS quotes, quantile_cont(sp, 0.5) AS median, quantile_cont(sp, 0.75) AS p75,
  quantile_cont(sp, 0.95) AS p95 FROM sq GROUP BY 1, 2""".replace("AS quotes", "AS n_quotes"))
add("spread_by_session", "SELECT instrument, session, n_quotes AS quotes, median, p75, p95 FROM sps", "median p75 p95")
add("spread_extremes", """
SELECT instrument, max(median) AS worst_median, min(median) AS best_median,
  first(session ORDER BY median DESC, session DESC) AS worst_session, any_value(m) AS all_hours_median
FROM sps JOIN (SELECT instrument, quantile_cont(ask_t - bid_t, 0.5) AS m FROM quotes
  WHERE ask_t - bid_t > 0 AND ask_t - bid_t <= 500 GROUP BY 1) USING (instrument) GROUP BY 1""",
    "worst_median best_median all_hours_median")
add("spread_by_minute", """
SELECT instrument, session, CAST(minute AS INTEGER) AS minute, quantile_cont(sp, 0.5) AS spread FROM sq GROUP BY ALL""", "spread")
cte("slot", "SELECT instrument, session, minute // 60 AS slot_no, quantile_cont(sp, 0.5) AS spread FROM sq GROUP BY ALL")
cte("ew", """
SELECT *, entry_weighted / session_median AS ratio FROM (
  SELECT s.instrument, s.session, CAST(sum(n) AS BIGINT) AS n_trades, sum(spread * n) / sum(n) AS entry_weighted
  FROM slot s JOIN (SELECT instrument, session, entry_idx - open_idx AS slot_no, count(*) AS n FROM sgs GROUP BY ALL) e
    USING (instrument, session, slot_no) GROUP BY 1, 2)
JOIN (SELECT instrument, session, quantile_cont(spread, 0.5) AS session_median FROM slot GROUP BY ALL) USING (instrument, session)""")
add("spread_entry_weighted", """
SELECT instrument, session, entry_weighted, n_trades, session_median, ratio, CASE WHEN ratio >= 1.15 THEN 'entries pay more'
  WHEN ratio <= 0.87 THEN 'entries pay less' ELSE 'representative' END AS verdict FROM ew""",
    "entry_weighted session_median ratio")
add("slippage_rebuild", """
WITH s AS (SELECT instrument, session, greatest(1.0, round_even(entry_weighted, 2))::DOUBLE AS slippage_ticks FROM ew)
SELECT instrument, session, slippage_ticks, max(slippage_ticks) OVER (PARTITION BY instrument) AS instrument_slippage,
  first_value(session) OVER (PARTITION BY instrument ORDER BY slippage_ticks DESC, session DESC) AS worst_session FROM s""",
    "slippage_ticks instrument_slippage")

# --- control events ----------------------------------------------------------------------------

FK = "instrument, session, rm, mode, tf, dir"
cte("fpick", f"SELECT DISTINCT {FK}, local_date FROM boo")
cte("fpool", f"SELECT {FK}, list(r ORDER BY r) AS pool, count(*) AS pool_size FROM boo WHERE bad IS NULL GROUP BY ALL")
cte("act", f"SELECT {S}, min(idx) AS act, any_value(sgn) AS sgn, any_value(b) AS b, any_value(opp) AS opp FROM xs WHERE rel >= 0 GROUP BY ALL")
cte("cseed", "SELECT instrument, session, " + seed(
    "'joint-entry|fired|' || instrument || '|' || session", 20260806) +
    " AS cs0 FROM (SELECT DISTINCT instrument, session FROM boo)")
cte("cdraw", f"""
SELECT p.*, a.sgn, a.b, a.opp, act, last_idx, cs0, pool, pool_size, (local_date - DATE '1970-01-01') * 6 AS no, draw
FROM fpick p JOIN fpool USING ({FK}) JOIN act a USING ({S}) JOIN dd USING ({K}) JOIN cseed USING (instrument, session)
CROSS JOIN (VALUES (0), (1), (2)) t(draw)""")
cte("cidx", f"""
SELECT *, CAST(act + {draw('cs0', 'no + 2 * draw')} % (last_idx + 1 - act) AS INTEGER) AS entry_idx,
  pool[{draw('cs0', 'no + 2 * draw + 1')} % pool_size + 1] AS pick FROM cdraw""")
cte("cev", f"""
SELECT c.*, x.so AS f, c.entry_idx AS anchor, false AS at_close FROM cidx c JOIN xs x
ON {" AND ".join(f"c.{c} = x.{c}" for c in ("instrument", "session", "local_date", "rm", "dir"))} AND x.idx = c.entry_idx""")
CR = f"instrument, session, {RENAME}"
add("control_events_matched", f"""
SELECT {CR}, local_date, draw, entry_idx, sgn * f AS fill_t, sgn * (f - pick) AS sl_t, 'matched' AS sl_source
FROM cev WHERE pick >= 1""")
stop_ctes("crun", f"SELECT DISTINCT {S}, anchor FROM cev")
cte("csw", f"SELECT v.*, {STOP} FROM cev v JOIN crun3 USING ({S}, anchor)")
add("control_events_swing", f"""
SELECT {CR}, local_date, draw, entry_idx, sgn * f AS fill_t, sgn * sl AS sl_t, sl_source FROM csw""")
cte("cmat", "SELECT *, f - pick AS sl FROM cev WHERE pick >= 1")
barrier_ctes("cm", "cmat", f"{S}, mode, tf, draw")
journal_cte("cmj", "cmo")
add("control_pool_days", f"""
WITH m AS (SELECT *, {FLAGS} FROM cmj)
SELECT {CR}, rr, local_date AS date, count(*) AS n, sum(net_r) AS total FROM m
WHERE NOT (x1 OR x2 OR x3 OR x4 OR x5 OR x6 OR x7 OR x8) AND net_r IS NOT NULL GROUP BY ALL""", "rr total")
barrier_ctes("cw", "csw", f"{S}, mode, tf, draw")
MIX = """SELECT instrument, session, dir, rr, count(*) AS n, quantile_cont(r, 0.5) AS r_med,
  count(*) FILTER (reason = 'TIME') * 100.0 / count(*) AS tp, avg((ex - f) / r) AS g,
  count(*) FILTER (amb) * 100.0 / count(*) AS a FROM {src} WHERE bad IS NULL GROUP BY ALL"""
add("event_control_mix", f"""
WITH o AS ({MIX.format(src="boo")}), c AS ({MIX.format(src="cwo")})
SELECT o.instrument, o.session, o.dir AS direction, o.rr, o.n AS obs_n, o.r_med AS obs_r, o.tp AS obs_time_pct,
  o.g AS obs_gross, o.a AS obs_amb_pct, c.n AS null_n, c.r_med AS null_r, c.tp AS null_time_pct, c.g AS null_gross,
  c.a AS null_amb_pct, c.r_med / nullif(o.r_med, 0) AS r_ratio, c.a / nullif(o.a, 0) AS amb_ratio
FROM o JOIN c ON o.instrument = c.instrument AND o.session = c.session AND o.dir = c.dir AND o.rr = c.rr""",
    "rr obs_r obs_time_pct obs_gross obs_amb_pct null_r null_time_pct null_gross null_amb_pct r_ratio amb_ratio")
add("event_control_mix_matched", f"""
WITH o AS ({MIX.format(src="boo")}), c AS ({MIX.format(src="cmo")})
SELECT o.instrument, o.session, o.dir AS direction, o.rr, o.n AS obs_n, o.r_med AS obs_r, o.tp AS obs_time_pct,
  o.g AS obs_gross, o.a AS obs_amb_pct, c.n AS null_n, c.r_med AS null_r, c.tp AS null_time_pct, c.g AS null_gross,
  c.a AS null_amb_pct, c.r_med / nullif(o.r_med, 0) AS r_ratio, c.a / nullif(o.a, 0) AS amb_ratio
FROM o JOIN c ON o.instrument = c.instrument AND o.session = c.session AND o.dir = c.dir AND o.rr = c.rr""",
    "rr obs_r obs_time_pct obs_gross obs_amb_pct null_r null_time_pct null_gross null_amb_pct r_ratio amb_ratio")

# --- both control designs on the same bars -----------------------------------------------------

SEED = 20260806
journal_cte("cwj", "cwo")
cte("evs", f"SELECT {EV}, count(*) AS trade_count, avg(net_r) AS obs FROM jm WHERE eligible GROUP BY ALL")
cte("esm", f"""
SELECT {EV}, trade_count, obs, row_number() OVER () AS gid FROM (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY instrument, rr ORDER BY h, {EV}) AS rk FROM (
    SELECT *, {draw("sd", "1")} AS h FROM (SELECT *, {seed(
        "concat_ws('|', " + ", ".join(f"CAST({k.strip()} AS VARCHAR)" for k in EV.split(",")) + ")", SEED)} AS sd FROM evs)))
  WHERE rk <= 2 ORDER BY h, {EV} LIMIT 60)""")
cte("cpw", f"SELECT {EV}, local_date, draw, gross_r, net_r FROM (SELECT *, {FLAGS} FROM cwj) WHERE NOT (x1 OR x2 OR x3 OR x4 OR x5 OR x6 OR x7 OR x8)")
cte("cpm", f"SELECT {EV}, local_date, draw, gross_r, net_r FROM (SELECT *, {FLAGS} FROM cmj) WHERE NOT (x1 OR x2 OR x3 OR x4 OR x5 OR x6 OR x7 OR x8)")
cte("cpair", f"""
SELECT gid, trade_count, obs, local_date, w.gross_r AS gw, w.net_r AS nw, m.gross_r AS gm, m.net_r AS nm
FROM esm JOIN cpw w USING ({EV}) JOIN cpm m USING ({EV}, local_date, draw)""")
cte("npseed", f"SELECT {seed(chr(39) + 'joint-bootstrap' + chr(39), SEED)} AS sd0")
for _d, _c in (("w", "nw"), ("m", "nm")):
    cte(f"np{_d}d", f"SELECT gid, local_date AS date, count(*) AS n, sum({_c}) AS total FROM cpair GROUP BY ALL")
    cte(f"np{_d}s", f"""
SELECT gid, row_number() OVER (PARTITION BY gid ORDER BY date) - 1 AS st, count(*) OVER (PARTITION BY gid) AS nd,
  sum(n) OVER (PARTITION BY gid) AS n_trades,
  sum(n) OVER (PARTITION BY gid ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS bn,
  sum(total) OVER (PARTITION BY gid ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS bs FROM np{_d}d""")
    cte(f"np{_d}k", f"""
SELECT gid, obs, nd, least(5, nd) AS w, (SELECT sd0 FROM npseed) AS sd,
  CAST(greatest(1, ceil(ceil(trade_count / greatest(1.0::DOUBLE, n_trades / nd)) / least(5, nd))) AS BIGINT) AS k
FROM (SELECT DISTINCT gid, nd, n_trades FROM np{_d}s) JOIN esm USING (gid)""")
    cte(f"np{_d}m", f"""
SELECT gid, d, any_value(obs) AS obs, sum(bs) / sum(bn) AS mean_r FROM (
  SELECT gid, obs, d, CAST({draw("sd", f"d * {1 << 20} + blk")} % (nd - w + 1) AS BIGINT) AS st FROM (
    SELECT *, unnest(range(k)) AS blk FROM (SELECT *, unnest(range(20000)) AS d FROM np{_d}k)))
JOIN np{_d}s USING (gid, st) GROUP BY gid, d""")
    cte(f"np{_d}", f"""
SELECT gid, (1 + count(*) FILTER (mean_r - obs > 1e-12) + 0.5 * count(*) FILTER (abs(mean_r - obs) <= 1e-12)) / (1 + count(*)) AS p
FROM np{_d}m GROUP BY gid""")
cte("npg", "SELECT gid, avg(gw) AS gw, avg(gm) AS gm FROM cpair GROUP BY gid")
add("null_rate_comparison", " UNION ALL ".join(f"""
SELECT '{name}' AS comparator, (SELECT count(*) FROM np{d}) AS variants, (SELECT (count(*) FILTER (p < 0.05)) / count(*) * 100 FROM np{d}) AS pct_below_05,
  (SELECT (count(*) FILTER (p < 0.1)) / count(*) * 100 FROM np{d}) AS pct_below_10, (SELECT quantile_cont(p, 0.5) FROM np{d}) AS median_p,
  avg(g{d}) AS mean_null_gross, quantile_cont(g{d}, 0.5) AS median_null_gross, count(g{d}) AS pools FROM npg""" for name, d in (("swing", "w"), ("matched", "m"))),
    "pct_below_05 pct_below_10 median_p mean_null_gross median_null_gross")

# --- windows -----------------------------------------------------------------------------------

cte("ewin", """
SELECT instrument, w AS regime_window, CASE WHEN w = 0 THEN a ELSE h + 1 END AS ws, CASE WHEN w = 0 THEN h ELSE b END AS we FROM (
  SELECT instrument, a, b, a + CAST(floor((b - a) / 2) AS INTEGER) AS h FROM (
    SELECT instrument, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM bars GROUP BY 1)) CROSS JOIN (VALUES (0), (1)) t(w)""")
KW = f"{K}, regime_window"
cte("wsx", "SELECT sx.*, regime_window FROM sx JOIN ewin ON sx.instrument = ewin.instrument AND CAST(sx.ts AS DATE) BETWEEN ws AND we")
cte("wpos", f"""
SELECT *, row_number() OVER (PARTITION BY {KW} ORDER BY ts) - 1 AS p,
  ts - lag(ts) OVER (PARTITION BY {KW} ORDER BY ts) > INTERVAL {EVENT_GRID.gap_minutes} MINUTE AS gap FROM wsx""")
cte("wdq", f"""
SELECT {KW}, count(*) FILTER (wall >= open_min) AS in_bars, min(ts) FILTER (wall >= open_min) AS open_ts,
  {", ".join(f"count(*) FILTER (wall >= open_min AND wall < open_min + {r}) AS n{r}" for r in EVENT_GRID.range_minutes)}
FROM wsx GROUP BY {KW}""")
cte("wcut", f"SELECT {KW}, max(p) AS cut_at FROM wpos JOIN wdq USING ({KW}) WHERE gap AND ts <= open_ts GROUP BY {KW}")
cte("wsb", f"""
SELECT wpos.* EXCLUDE (p, gap), CAST(p - coalesce(cut_at, 0) AS INTEGER) AS idx, in_bars,
  least(1.0, in_bars * {EVENT_GRID.bar_minutes} / greatest(1, exit_min - open_min))::DOUBLE AS completeness
FROM wpos JOIN wdq USING ({KW}) LEFT JOIN wcut USING ({KW})
WHERE ({" OR ".join(f"n{r} >= {r // EVENT_GRID.bar_minutes}" for r in EVENT_GRID.range_minutes)})
  AND p >= coalesce(cut_at, 0)""")
cte("wdd", f"""
SELECT {KW}, min(idx) FILTER (wall >= open_min) AS open_idx, max(idx) AS last_idx, any_value(completeness) AS completeness,
  first(o ORDER BY b.ts) FILTER (wall >= open_min) AS open_tick, count(DISTINCT contract) FILTER (wall >= open_min) > 1 AS changed_in,
  first(contract ORDER BY b.ts) FILTER (wall >= open_min) AS first_contract, last(contract ORDER BY b.ts) FILTER (wall >= open_min) AS last_contract,
  first(x.atr_4h ORDER BY b.ts) FILTER (wall >= open_min) AS atr_4h, first(x.prev_close ORDER BY b.ts) FILTER (wall >= open_min) AS prev_close,
  first(x.parkinson_vol_14d ORDER BY b.ts) FILTER (wall >= open_min) AS parkinson_vol_14d,
  first(x.realized_vol_14d ORDER BY b.ts) FILTER (wall >= open_min) AS realized_vol_14d
FROM wsb b JOIN (SELECT instrument, ts, atr_4h, prev_close, parkinson_vol_14d, realized_vol_14d FROM enr2) x
  ON b.instrument = x.instrument AND b.ts = x.ts GROUP BY ALL""".replace(f"SELECT {KW}, min(idx)", "SELECT b.instrument, session, local_date, regime_window, min(idx)"))
add("windowed_days", f"""
SELECT {KW}, open_idx, last_idx, completeness, changed_in, coalesce(lag(last_contract) OVER (
    PARTITION BY instrument, session, regime_window ORDER BY local_date) <> first_contract, false) AS changed_since,
  atr_4h, prev_close, open_tick - prev_close AS gap_ticks, parkinson_vol_14d, realized_vol_14d FROM wdd""",
    "completeness atr_4h parkinson_vol_14d realized_vol_14d")
