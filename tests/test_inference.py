import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.rng import PRIME, STEP
from barloom.operators import controls as K
from barloom.operators import metrics as J
from barloom.operators import multiplicity as MT
from barloom.operators import resample as R
from barloom.operators.eligibility import RULES
from tests.helpers import rows


def draw(seed, i):
    x = (seed + i * STEP) % PRIME
    return pow(x, 5, PRIME)


def test_block_bootstrap_equals_the_plain_loop(spark):
    rng = np.random.default_rng(0)
    per_day = [rng.normal(size=rng.integers(1, 4)) for _ in range(13)]
    df = spark.createDataFrame([("g", i, int(len(a)), float(a.sum())) for i, a in enumerate(per_day)],
                               "k string, date int, n long, total double")
    seed, width, draws = 12345, 5, 40
    got = rows(R.block_bootstrap(R.day_prefixes(df, ["k"]), ["k"], draws, R.own_size_blocks(5),
                                 F.lit(seed).cast("bigint"), 5, chunk=7), "draw")
    k = 3  # ceil(13 / 5)
    for b in range(draws):
        starts = [draw(seed, b * R.STRIDE + j) % (13 - width + 1) for j in range(k)]
        sample = np.concatenate([per_day[d] for s in starts for d in range(s, s + width)])
        assert got[b]["mean_r"] == pytest.approx(sample.mean(), rel=1e-12)


def test_draws_are_roughly_uniform():
    d = np.array([draw(99, i) % 10 for i in range(20000)])
    counts = np.bincount(d, minlength=10)
    assert abs(counts - 2000).max() < 200


def test_single_day_gives_the_point_value(spark):
    t = spark.createDataFrame([("g", "2024-01-01", 1.0), ("g", "2024-01-01", 2.0)], "k string, date string, gross_r double")
    r = R.bootstrap_ci(t, ["k"], 20).first()
    assert (r.ci_lo, r.ci_hi) == (1.5, 1.5)


def test_p_value_and_jackknife(spark):
    means = spark.createDataFrame([("g", 0, [0.1, 0.2]), ("g", 1, [0.2, 0.3])], "k string, chunk int, means array<double>")
    obs = spark.createDataFrame([("g", 0.2)], "k string, obs double")
    got = R.vector_stats(means, ["k"], obs, "obs").first()
    assert got.p_value == pytest.approx((1 + 1 + 1) / 5) and got.null_draws == 4
    assert got.null_p95 == pytest.approx(np.quantile([0.1, 0.2, 0.2, 0.3], 0.95))
    days = spark.createDataFrame([("g", i, n, s) for i, (n, s) in enumerate([(1, 1.0), (2, 0.5), (3, -2.0)])],
                                 "k string, date int, n long, total double")
    n, s = np.array([1, 2, 3.0]), np.array([1.0, 0.5, -2.0])
    est = (s.sum() - s) / (n.sum() - n)
    want = np.sqrt(2 / 3 * ((est - est.mean()) ** 2).sum())
    assert R.jackknife_se(days, ["k"]).first().jackknife_se == pytest.approx(want)


def _null(spark, null, obs):
    chunks = [(c, i, [float(v) for v in null[c * 30:(c + 1) * 30, i]]) for c in range(3) for i in range(len(obs))]
    chunks += [(c, len(obs), None) for c in range(3)]  # a hypothesis without spread
    n = spark.createDataFrame(chunks, "chunk int, id int, t array<double>").repartition(5)
    o = spark.createDataFrame([(i, float(v)) for i, v in enumerate(obs)], "id int, t double")
    return n, o


def test_equal_draws_have_no_deviation(spark):
    # ten times 0.3: NumPy's std is 5.6e-17, by rounding of the mean
    means = spark.createDataFrame([("same", c, [0.3] * 5) for c in (0, 1)] + [("varies", c, [0.1, 0.2, 0.3, 0.4, 0.5]) for c in (0, 1)],
                                  "k string, chunk int, means array<double>").repartition(1)
    obs = spark.createDataFrame([("same", 0.4), ("varies", 0.4)], "k string, obs double")
    stats = R.vector_stats(means, ["k"], obs, "obs")
    got = {r.k: r for r in stats.collect()}
    assert got["same"].null_std == 0.0 and got["varies"].null_std == pytest.approx(np.std([0.1, 0.2, 0.3, 0.4, 0.5]))
    null_t, obs_t = MT.studentise(means, stats, obs, ["k"], "obs")
    assert {r.k: r.t is None for r in obs_t.collect()} == {"same": True, "varies": False}
    assert [r.k for r in MT.step_down_maxt(null_t, obs_t, ["k"]).collect()] == ["varies"]


def test_step_down_and_fdr_against_direct_counts(spark):
    rng = np.random.default_rng(8)
    null, obs = rng.normal(size=(80, 12)), np.sort(rng.normal(size=12) + 0.8)[::-1]
    n, o = _null(spark, null, obs)
    got = rows(MT.step_down_maxt(n, o, ["id"]), "rank")
    want = np.maximum.accumulate([(1 + (null[:, r:].max(1) >= obs[r]).sum()) / 81 for r in range(12)])
    np.testing.assert_allclose([r["p_adj"] for r in got], want)
    assert all(0 < r["p_adj"] <= 1 for r in got)
    pi0 = min(1.0, (obs <= np.quantile(null, 0.5)).sum() / (0.5 * 12))
    raw = [min(1.0, pi0 * (null >= t).sum(1).mean() / (obs >= t).sum()) for t in obs]
    want_q = np.minimum.accumulate(raw[::-1])[::-1]
    q = rows(MT.permutation_fdr(n, o, ["id"]), "id")
    np.testing.assert_allclose([r["q_fdr"] for r in q], want_q)


def test_day_allocation(spark):
    sizes = spark.createDataFrame([("p", w, s, float(s)) for w, s in ((0, 10), (1, 6), (2, 4))],
                                  "k string, w int, size long, weight double")
    got = {r["w"]: r["alloc"] for r in rows(K.allocate_strata(sizes, ["k"], "w", 9))}
    assert sum(got.values()) == 9 and got[0] in (4, 5) and got[1] in (2, 3)
    skew = spark.createDataFrame([("p", 0, 2, 100.0), ("p", 1, 20, 0.0), ("p", 2, 20, 0.0)], "k string, w int, size long, weight double")
    got = {r["w"]: r["alloc"] for r in rows(K.allocate_strata(skew, ["k"], "w", 9))}
    assert got[0] == 2 and sum(got.values()) == 9 and abs(got[1] - got[2]) == 1


def test_day_sample_is_stratified_stable_and_not_the_head(spark):
    days = spark.createDataFrame([("p", i // 10, f"2024-01-{i + 1:02d}") for i in range(20)],
                                 "k string, w int, d string").withColumn("d", F.to_date("d"))
    once = [str(r["d"]) for r in rows(K.sample_days(days, ["k"], "w", 8, "d"), "d")]
    again = [str(r["d"]) for r in rows(K.sample_days(days, ["k"], "w", 8, "d"), "d")]
    assert once == again and len(once) == 8 and once != [f"2024-01-{i + 1:02d}" for i in range(8)]
    assert {r["w"] for r in rows(K.sample_days(days, ["k"], "w", 8, "d"))} == {0, 1}
    assert {r["design"] for r in rows(K.sample_days(days, ["k"], "w", 50, "d"))} == {"exhausted"}


def test_metrics_against_pandas(spark):
    rng = np.random.default_rng(6)
    f = pd.DataFrame({
        "k": rng.choice(["a", "b"], 400, p=[0.8, 0.2]), "date": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 120, 400), "D"),
        "gross_r": rng.normal(size=400), "exit_reason": rng.choice(["TP", "SL"], 400), "eligible": rng.random(400) < 0.7})
    f["net_r"] = f.gross_r - 0.05
    f["regime_window"] = f.date.dt.month
    f["instrument"], f["session"] = "ES", "NY"
    df = spark.createDataFrame(f).withColumn("date", F.to_date("date"))
    for r in RULES:
        df = df.withColumn(r, ~F.col("eligible"))
    got = {r["k"]: r for r in rows(J.variant_summary(df, ["k", "instrument", "session"]))}
    for k, g in f[f.eligible].groupby("k"):
        day = g.groupby("date").agg(g=("gross_r", "sum"), t=("net_r", "sum"), n=("net_r", "size"))
        cum = day.g.cumsum()
        up = day.t.clip(lower=0)
        streak = run = 0
        for x in day.t:
            run = run + 1 if x < 0 else 0
            streak = max(streak, run)
        m = g.net_r.mean()
        win = g.groupby("regime_window").net_r.mean()
        want = {
            "trade_count": len(g), "win_rate": (g.gross_r > 0).mean(), "expectancy_net_r": m,
            "max_drawdown_r": (cum.cummax() - cum).max(), "sharpe_r": day.g.mean() / day.g.std(ddof=0) * 252 ** 0.5,
            "t_cluster_net": m / (np.sqrt(((day.t - day.n * m) ** 2).sum()) / len(g)),
            "n_distinct_days": len(day), "top1_day_pnl_share": up.max() / up.sum(),
            "top5pct_day_pnl_share": day.t.nlargest(int(np.ceil(len(day) * 0.05))).clip(lower=0).sum() / up.sum(),
            "pnl_share_from_single_month": day.t.groupby(day.index.to_period("M")).sum().clip(lower=0).max() / up.sum(),
            "max_consecutive_losing_days": streak, "n_windows_positive": (win > 0).sum(),
            "n_windows_observed": len(win), "worst_window_expectancy": win.min(), "median_daily_r": day.t.median(),
            "frac_days_traded": len(day) / f.date.nunique(), "n_excluded_small_sl": (~f[f.k == k].eligible).sum(),
        }
        for name, w in want.items():
            assert got[k][name] == pytest.approx(w, rel=1e-9), (k, name)
