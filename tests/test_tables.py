"""Eligibility, sizing, costs, calendar and bar features against hand values and pandas."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.quantiles import exact_quantile
from barloom.functions.scans import scan_lag, scan_last_known, scan_max, scan_sum
from barloom.operators import bars as B
from barloom.operators import eligibility as H
from barloom.operators.calendar import regime_windows
from barloom.operators.costs import with_costs
from barloom.operators.sizing import contracts_for, reprice, size_by_mode
from barloom.params import GridSpec, Market
from tests.helpers import bars, rows


def test_eligibility_rules(spark):
    df = spark.createDataFrame(
        [(1, "TP", False, 8.0, 20, 0.1, 1, 1.0, False, False), (2, "TP", False, 2.0, 4, 0.2, 0, 0.5, True, False),
         (3, None, None, None, None, None, None, None, None, None)],
        "id int, exit_reason string, tp_unfillable boolean, tp_ticks double, r_ticks int, cost_r double, contracts int, "
        "session_bar_completeness double, contract_changed_in_session boolean, contract_changed_since_prev_session boolean")
    good, bad, null = rows(H.mark_eligibility(df, strict=True), "id")
    assert good["eligible"] and not any(good[r] for r in H.RULES)
    assert not bad["eligible"]
    assert [bad[r] for r in H.RULES] == [False, False, True, True, True, True, True, True]
    assert [null[r] for r in H.RULES] == [True, False, True, True, True, True, False, True]


def test_absent_columns_pass_unless_strict(spark):
    df = spark.createDataFrame([("TP", 10.0)], "exit_reason string, tp_ticks double")
    assert H.mark_eligibility(df).first().eligible
    with pytest.raises(ValueError):
        H.mark_eligibility(df, strict=True)


def test_duplicate_variant_days_raise(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-01")], "k string, date string")
    with pytest.raises(AssertionError):
        H.assert_unique_trades(df, ["k"])


def test_contracts_and_hybrid_sizing(spark):
    df = spark.createDataFrame([(r,) for r in (0, 5, 7, 8, 30, 72, 73, 500)], "r_ticks int")
    got = rows(df.withColumn("n", contracts_for(F.col("r_ticks"), F.lit(12.5))), "r_ticks")
    assert [r["n"] for r in got] == [0, 10, 10, 9, 2, 1, 0, 0]
    t = spark.createDataFrame([("ES", "NY", 30, 1.0)], "instrument string, session string, r_ticks int, gross_r double")
    sized = {r["mode"]: r for r in rows(reprice(size_by_mode(t.withColumn("slippage_ticks", F.lit(1.0)), Market())))}
    assert (sized["full"]["n_full"], sized["full"]["n_micro"]) == (2, 0)
    assert (sized["micro"]["n_full"], sized["micro"]["n_micro"]) == (0, 10)
    # 2 full use 750 of 900; 150 left buy 4 micros of 37.50.
    assert (sized["hybrid"]["n_full"], sized["hybrid"]["n_micro"], sized["hybrid"]["risk_usd"]) == (2, 4, 900.0)
    assert sized["hybrid"]["pnl_usd"] == pytest.approx(900 - (2 * 3.10 + 4 * 1.40) - (2 * 12.5 + 4 * 1.25))


def test_costs_resolve_most_specific_first(spark):
    df = spark.createDataFrame([("NQ", "NY", 10), ("NQ", "XX", 10), ("ZZ", "NY", 10), ("ES", "NY", 0)],
                               "instrument string, session string, r_ticks int")
    got = {(r["instrument"], r["session"]): r for r in rows(with_costs(df, Market()))}
    assert got[("NQ", "NY")]["slippage_ticks"] == 2.04 and got[("NQ", "XX")]["slippage_ticks"] == 3.16
    assert got[("ZZ", "NY")]["slippage_ticks"] == 1.0
    assert got[("NQ", "NY")]["cost_r"] == pytest.approx((3.10 / 5 + 2.04) / 10)
    assert got[("ES", "NY")]["cost_r"] == 0.0


def test_regime_windows_are_disjoint_and_fewer_on_short_history(spark):
    df = spark.createDataFrame([("A", dt.date(2021, 2, 8), dt.date(2025, 12, 31)),
                                ("B", dt.date(2010, 1, 1), dt.date(2025, 12, 31)),
                                ("C", dt.date(2025, 1, 1), dt.date(2025, 6, 1))],
                               "instrument string, first_date date, last_date date")
    got = rows(regime_windows(df), "instrument", "regime_window")
    a = [r for r in got if r["instrument"] == "A"]
    b = [r for r in got if r["instrument"] == "B"]
    assert 0 < len(a) < 10 and len(b) == 10 and not [r for r in got if r["instrument"] == "C"]
    for ws in (a, b):
        assert all(x["window_end"] < y["window_start"] for x, y in zip(ws, ws[1:]))
    assert a[0]["window_start"] >= dt.date(2021, 3, 1) and a[-1]["window_end"] <= dt.date(2025, 9, 30)


def _daily(spark, frame):
    return spark.createDataFrame(frame, "instrument string, trading_date date, o bigint, h bigint, l bigint, c bigint")


def daily_frame(n=40, seed=3):
    rng = np.random.default_rng(seed)
    close = 10000 + rng.integers(-80, 80, n).cumsum()
    return pd.DataFrame({
        "instrument": "A", "trading_date": [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(n)],
        "o": close, "h": close + rng.integers(5, 90, n), "l": close - rng.integers(5, 90, n), "c": close})


def test_daily_volatility_against_pandas_and_without_leakage(spark):
    f = daily_frame()
    pv = np.log(f.h / f.l) ** 2 / (4 * math.log(2))
    want_p = (pv.rolling(14, min_periods=7).mean() ** 0.5 * math.sqrt(252)).shift(1)
    want_r = (np.log(f.c / f.c.shift(1)).rolling(14, min_periods=7).std() * math.sqrt(252)).shift(1)
    got = B.daily_features(_daily(spark, f)).orderBy("trading_date").toPandas()
    np.testing.assert_allclose(got.parkinson_vol_14d.astype(float), want_p, rtol=1e-10)
    np.testing.assert_allclose(got.realized_vol_14d.astype(float), want_r, rtol=1e-10)
    g = f.copy()
    g.loc[15, ["h", "l", "c"]] = [30000, 100, 20000]
    moved = B.daily_features(_daily(spark, g)).orderBy("trading_date").toPandas()
    for c in ("parkinson_vol_14d", "realized_vol_14d", "prev_close"):
        assert moved[c][15] == got[c][15] and moved[c][16] != got[c][16]


def test_wilder_average_against_pandas(spark):
    f = daily_frame(700, 5).rename(columns={"trading_date": "bin"})
    pc = f.c.shift(1)
    tr = pd.concat([f.h - f.l, (f.h - pc).abs(), (f.l - pc).abs()], axis=1).max(axis=1, skipna=False)
    want = tr.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    df = _daily(spark, f.rename(columns={"bin": "trading_date"})).withColumnRenamed("trading_date", "bin")
    got = B.wilder_atr(df).orderBy("bin").toPandas()
    np.testing.assert_allclose(got.atr.astype(float), want, rtol=1e-12)
    np.testing.assert_allclose(got.atr_prev.astype(float), want.shift(1), rtol=1e-12)


def test_dedup_prefers_source_then_latest(spark):
    a = bars(spark, [(1, 1, 1, 1)], source="local")
    b = bars(spark, [(2, 2, 2, 2)], source="databento")
    c = bars(spark, [(3, 3, 3, 3)], source="databento").withColumn("ingest_seq", F.lit(9).cast("bigint"))
    assert B.merge_sources(a, b, c).first().c == 3
    assert B.merge_sources(a, b).first().c == 2


def test_four_hour_bins_hold_their_anchor_across_the_clock_change(spark):
    ts = [dt.datetime(2024, 3, 8, 23, 0), dt.datetime(2024, 3, 9, 2, 59), dt.datetime(2024, 3, 11, 22, 0)]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz")
    got = [r["b"].hour for r in rows(df.withColumn("b", B.four_hour_bin(F.col("ts"))), "ts")]
    assert got == [18, 18, 18]


def test_chunked_scans_equal_plain_windows(spark):
    rng = np.random.default_rng(1)
    f = pd.DataFrame({"k": rng.choice(["a", "b"], 300), "t": np.arange(300), "v": rng.integers(-9, 9, 300)})
    f["x"] = [None if i % 3 else f"c{i}" for i in range(300)]
    f["chunk"] = f.t // 37
    df = spark.createDataFrame(f, "k string, t long, v long, x string, chunk long")
    df = scan_lag(df, ["k"], "chunk", ["t"], {"prev": "v"})
    df = scan_last_known(df, ["k"], "chunk", ["t"], "x", "known")
    df = scan_sum(df, ["k"], "chunk", ["t"], {"cum": F.col("v")})
    got = scan_max(df, ["k"], "chunk", ["t"], "cum", "peak").orderBy("t").toPandas()
    g = f.groupby("k")
    pd.testing.assert_series_equal(got.prev.astype(float), g.v.shift(1), check_names=False)
    pd.testing.assert_series_equal(got.cum, g.v.cumsum(), check_names=False)
    assert got.known.fillna("").tolist() == g.x.ffill().fillna("").tolist()
    assert got.peak.tolist() == g.v.cumsum().groupby(f.k).cummax().tolist()


def test_exact_quantile(spark):
    v = np.random.default_rng(2).normal(size=1001) ** 3
    df = spark.createDataFrame([(float(x),) for x in v], "t double")
    for p in (0.0, 0.31, 0.5, 0.95, 1.0):
        assert exact_quantile(df, "t", p, "q").first().q == pytest.approx(float(np.quantile(v, p)), rel=1e-12)


def test_frontier_against_all_pairs(spark):
    from barloom.plans.setups import pareto_frontier
    rng = np.random.default_rng(4)
    pts = rng.integers(0, 12, (300, 3)).astype(float)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)],
                               "id int, total_pnl_usd double, win_rate double, capital_eff double")
    want = {i for i in range(300) if not ((pts >= pts[i]).all(1) & (pts > pts[i]).any(1)).any()}
    assert {r.id for r in pareto_frontier(df, buckets=8).collect()} == want


def test_grid_defaults():
    g = GridSpec()
    assert sum(len(g.closure_tfs[r]) * 2 + 3 for r in g.range_minutes) == 27
