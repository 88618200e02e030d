"""Diagnostic queries over bars, journal and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import ratio, share
from barloom.operators.calendar import sessionize
from barloom.params import FAMILY, MIN_TRADES, VARIANT, GridSpec


def _pct(cond):
    return share(cond) * 100.0


def range_completeness(bars: DataFrame, grid: GridSpec, pairs: DataFrame | None = None) -> DataFrame:
    """Per (instrument, session, range): days with a full set of distinct minutes, and their share."""
    x = sessionize(bars, grid, pairs, context=False).select(
        "instrument", "session", "local_date", "wall", "open_min").distinct()
    x = x.withColumn("range_minutes", F.explode(F.array(*[F.lit(r) for r in grid.range_minutes])))
    x = x.filter(F.col("wall") < F.col("open_min") + F.col("range_minutes"))
    days = x.groupBy("instrument", "session", "range_minutes", "local_date").agg(
        F.count(F.lit(1)).alias("minutes"))
    return days.groupBy("instrument", "session", "range_minutes").agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(F.col("minutes") >= F.col("range_minutes") / grid.bar_minutes).alias("complete_days"),
    ).withColumn("complete_pct", F.col("complete_days") * 100.0 / F.col("days"))


def trade_distribution(summary: DataFrame) -> DataFrame:
    return summary.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("variants"), F.min("trade_count").alias("tc_min"),
        F.median("trade_count").alias("tc_med"), F.max("trade_count").alias("tc_max"),
        F.sum("trade_count").alias("tc_sum"))


def sample_thresholds(summary: DataFrame, thresholds: tuple = (1, 10, 30, 50, 100, 200)) -> DataFrame:
    """Variants left at each minimum trade count."""
    counts = summary.agg(F.count(F.lit(1)).alias("variants"), *[
        F.count_if(F.col("trade_count") >= t).alias(f"n_{t}") for t in thresholds])
    rows = F.explode(F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"n_{t}").alias("left")) for t in thresholds]))
    return counts.select("variants", rows.alias("r")).select("r.*", "variants").withColumn(
        "left_pct", F.col("left") * 100.0 / F.col("variants"))


def exit_mix(journal: DataFrame, reasons: tuple) -> DataFrame:
    """Exit reasons per instrument in percent of its rows, one column per reason."""
    counts = journal.groupBy("instrument").pivot("exit_reason", list(reasons)).agg(F.count(F.lit(1)))
    total = sum((F.coalesce(F.col(r), F.lit(0)) for r in reasons), F.lit(0))
    return counts.select("instrument", *[
        (F.coalesce(F.col(r), F.lit(0)) * 100.0 / total).alias(r.lower()) for r in reasons])


def rows_by_session(journal: DataFrame, sessions: tuple) -> DataFrame:
    counts = journal.groupBy("instrument").pivot("session", list(sessions)).agg(F.count(F.lit(1)))
    return counts.fillna(0)


def family_coverage(valid: DataFrame) -> DataFrame:
    """Days each family traded (rr = 1) as a share of its pair's days."""
    pair = ["instrument", "session"]
    avail = valid.groupBy(*pair).agg(F.countDistinct("date").alias("days_available"))
    fam = valid.filter("rr = 1.0").groupBy(*FAMILY).agg(F.countDistinct("date").alias("days_traded"))
    return fam.join(avail, pair).withColumn(
        "coverage_pct", F.col("days_traded") * 100.0 / F.col("days_available"))


def coverage_by_mode(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("instrument", "entry_mode").agg(
        F.count(F.lit(1)).alias("families"), F.min("coverage_pct").alias("cov_min"),
        F.median("coverage_pct").alias("cov_median"), F.max("coverage_pct").alias("cov_max"))


# Coverage bands in percent.
BANDS = ((0, 40), (40, 60), (60, 80), (80, 95), (95, 101))


def coverage_bands(coverage: DataFrame) -> DataFrame:
    label = F.lit(None).cast("string")
    for lo, hi in BANDS:
        label = F.when((F.col("coverage_pct") >= lo) & (F.col("coverage_pct") < hi),
                       f"{lo:03d}-{hi:03d}").otherwise(label)
    return coverage.groupBy(label.alias("band")).agg(F.count(F.lit(1)).alias("families"))


def traded_day_contrast(valid: DataFrame, mode: str = "TI", rr: float = 1.0, range_minutes: int = 15,
                        min_days: int = 20) -> DataFrame:
    """Median volatility and range width of days with and without an event of ``mode``."""
    pair = ["instrument", "session"]
    hit = ((F.col("entry_mode") == mode) & (F.col("rr") == rr) & (F.col("range_minutes") == range_minutes))
    days = valid.groupBy(*pair, "date").agg(
        F.min("realized_vol_14d").alias("vol"), F.median("range_width_ticks").alias("width"),
        F.max(hit).alias("traded"))
    t, u = F.col("traded"), ~F.col("traded")
    x = days.groupBy(*pair).agg(
        F.count_if(t).alias("n_traded"), F.count_if(u).alias("n_untraded"),
        F.count_if(t & F.col("vol").isNotNull()).alias("_tv"), F.count_if(u & F.col("vol").isNotNull()).alias("_uv"),
        F.median(F.when(t, F.col("vol"))).alias("vol_traded"), F.median(F.when(u, F.col("vol"))).alias("vol_untraded"),
        F.median(F.when(t, F.col("width"))).alias("width_traded"),
        F.median(F.when(u, F.col("width"))).alias("width_untraded"))
    return x.filter((F.col("_tv") >= min_days) & (F.col("_uv") >= min_days)).drop("_tv", "_uv").withColumns({
        "cov_pct": F.col("n_traded") * 100.0 / (F.col("n_traded") + F.col("n_untraded")),
        "vol_ratio": ratio(F.col("vol_traded"), F.col("vol_untraded")),
        "width_ratio": ratio(F.col("width_traded"), F.col("width_untraded"))})


def coverage_verdict(contrast: DataFrame) -> DataFrame:
    x = contrast.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("sessions"), F.min("cov_pct").alias("min_cov"),
        F.median("cov_pct").alias("med_cov"), F.max("width_ratio").alias("max_width_ratio"))
    return x.withColumn("verdict", F.when(F.col("min_cov") >= 85, "clean").when(
        (F.col("min_cov") < 60) & (F.col("max_width_ratio") >= 2.0), "confounded").otherwise("partial"))


def p_by_rr(summary: DataFrame, p: str = "null_p_value", min_trades: int = MIN_TRADES) -> DataFrame:
    return summary.filter(F.col("trade_count") >= min_trades).groupBy("rr").agg(
        F.count(F.lit(1)).alias("variants"), F.avg(p).alias("p_mean"), F.median(p).alias("p_median"),
        F.min(p).alias("p_min"), F.max(p).alias("p_max")).withColumn("walk_hit_rate", 1.0 / (1.0 + F.col("rr")))


def self_consistency(valid: DataFrame, min_trades: int = MIN_TRADES) -> DataFrame:
    """Share of a variant's returns at or above its own mean.

    The mean is joined back to value counts, so no variant's rows meet in one window.
    """
    counts = valid.groupBy(*VARIANT, "gross_r").agg(F.count(F.lit(1)).alias("n"))
    means = counts.groupBy(*VARIANT).agg(
        F.sum("n").alias("trade_count"),
        ratio(F.sum(F.col("gross_r") * F.col("n")), F.sum("n")).alias("exp_gross"))
    x = counts.join(means, VARIANT).groupBy(*VARIANT, "trade_count", "exp_gross").agg(
        ratio(F.sum(F.when(F.col("gross_r") >= F.col("exp_gross"), F.col("n")).otherwise(0)),
              F.sum("n")).alias("self_p"))
    return x.filter(F.col("trade_count") >= min_trades)


def self_p_by_rr(consistency: DataFrame) -> DataFrame:
    return consistency.groupBy("rr").agg(
        F.count(F.lit(1)).alias("variants"), F.avg("self_p").alias("self_p_mean"),
        F.median("self_p").alias("self_p_median"))


def p_correlations(consistency: DataFrame, summary: DataFrame, p: str = "null_p_value") -> DataFrame:
    """Pearson correlations of the two p forms with win rate and expectancy."""
    x = consistency.select(*VARIANT, "self_p").join(
        summary.select(*VARIANT, "win_rate", p, "expectancy_gross_r"), VARIANT)
    return x.agg(
        F.corr("self_p", "win_rate").alias("self_vs_win"), F.corr(p, "win_rate").alias("p_vs_win"),
        F.corr(p, "expectancy_gross_r").alias("p_vs_gross"), F.corr("self_p", p).alias("self_vs_p"))


def stop_distribution(valid: DataFrame, keys: list[str]) -> DataFrame:
    """Quantiles of the stop distance, shares of tight stops, cost at the median stop.

    Stops are whole ticks, so the exact percentile buffers tick values, not trades.
    """
    q = F.percentile("r_ticks", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    x = valid.groupBy(*keys).agg(
        F.count("r_ticks").alias("trades"), q.alias("_q"),
        _pct(F.col("r_ticks") < 5).alias("pct_under_5"), _pct(F.col("r_ticks") < 2).alias("pct_under_2"),
        F.max("cost_ticks").alias("cost_ticks"), _pct(F.col("tp_unfillable")).alias("pct_unfillable"))
    return x.withColumns({"r_p05": F.col("_q")[0], "r_median": F.col("_q")[1], "r_p95": F.col("_q")[2]}).withColumn(
        "cost_r_at_median", ratio(F.col("cost_ticks"), F.col("r_median"))).drop("_q")


def unfillable_rates(valid: DataFrame) -> DataFrame:
    return valid.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("rows"), F.median("tp_ticks").alias("median_tp_ticks"),
        _pct(F.col("tp_ticks") < 1.0).alias("pct_unfillable"))


def unfillable_pivot(valid: DataFrame, rr_levels: tuple) -> DataFrame:
    x = valid.groupBy("instrument").pivot("rr", [float(r) for r in rr_levels]).agg(
        _pct(F.col("tp_ticks") < 1.0))
    return x.select("instrument", *[
        F.col(f"`{float(r)}`").alias("rr_" + str(float(r)).replace(".", "_")) for r in rr_levels])


def net_drag(summary: DataFrame, min_trades: int = MIN_TRADES) -> DataFrame:
    r = summary.filter(F.col("trade_count") >= min_trades)
    drag = F.col("expectancy_gross_r") - F.col("expectancy_net_r")
    return r.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("variants"), F.median("expectancy_gross_r").alias("med_gross"),
        F.median("expectancy_net_r").alias("med_net"), F.median(drag).alias("med_drag"),
        _pct(F.col("expectancy_net_r") > 0).alias("pct_net_positive"))


def net_positive_top(summary: DataFrame, k: int = 25, min_trades: int = MIN_TRADES) -> DataFrame:
    return summary.filter((F.col("trade_count") >= min_trades) & (F.col("expectancy_net_r") > 0)).orderBy(
        F.desc("expectancy_net_r"), *VARIANT).limit(k)


def excluding_unfillable(valid: DataFrame) -> DataFrame:
    """Per variant: metrics over all rows next to those over fillable rows, in one pass."""
    ok = ~F.col("tp_unfillable")

    def mean(c: str, cond=None):
        return F.avg(c) if cond is None else F.avg(F.when(cond, F.col(c)))

    return valid.groupBy(*VARIANT).agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(ok).alias("n_fillable"),
        mean("gross_r").alias("gross_all"), mean("gross_r", ok).alias("gross_fillable"),
        mean("net_r").alias("net_all"), mean("net_r", ok).alias("net_fillable"),
        ratio(F.count_if(ok & (F.col("gross_r") > 0)), F.count_if(ok)).alias("win_fillable"),
    ).withColumn("gross_delta", F.col("gross_fillable") - F.col("gross_all"))


def exclusion_delta_by_instrument(compared: DataFrame) -> DataFrame:
    return compared.filter(F.col("gross_fillable").isNotNull()).groupBy("instrument").agg(
        F.count(F.lit(1)).alias("variants"), F.median("gross_all").alias("med_gross_before"),
        F.median("gross_fillable").alias("med_gross_after"), F.median("gross_delta").alias("med_delta"))


def describe_p(summary: DataFrame, p: str = "null_p_value", floor: float = 0.001,
               min_trades: int = MIN_TRADES) -> DataFrame:
    """Quantiles of p over rankable variants, and how many sit at the floor."""
    probs = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95)
    x = summary.filter(F.col("trade_count") >= min_trades).agg(
        F.count(p).alias("variants"), F.avg(p).alias("mean"), F.min(p).alias("min"), F.max(p).alias("max"),
        F.percentile(p, F.array(*[F.lit(q) for q in probs])).alias("_q"),
        F.count_if(F.col(p) <= floor).alias("at_floor"))
    return x.select("variants", "mean", "min", "max", "at_floor", *[
        F.col("_q")[i].alias(f"p{int(q * 100):02d}") for i, q in enumerate(probs)])


def significance_flips(summary: DataFrame, p: str = "null_p_value", min_trades: int = MIN_TRADES) -> DataFrame:
    up, sig = F.col("expectancy_net_r") > 0, F.col(p) < 0.05
    return summary.filter(F.col("trade_count") >= min_trades).agg(
        F.count(F.lit(1)).alias("rankable"), F.count_if(up).alias("net_positive"),
        F.count_if(sig).alias("significant"), F.count_if(up & sig).alias("both"))


def old_vs_new(repriced: DataFrame, min_trades: int = MIN_TRADES) -> DataFrame:
    """Net-positive variants per instrument: flat slippage over all rows against table slippage
    over fillable rows."""
    old = repriced.groupBy(*VARIANT).agg(F.count(F.lit(1)).alias("n"), F.avg("net_r_flat").alias("net"))
    new = repriced.filter("NOT tp_unfillable").groupBy(*VARIANT).agg(
        F.count(F.lit(1)).alias("n"), F.avg("net_r_table").alias("net"))

    def positive(x: DataFrame, name: str) -> DataFrame:
        return x.filter((F.col("n") >= min_trades) & (F.col("net") > 0)).groupBy("instrument").agg(
            F.count(F.lit(1)).alias(name))

    return positive(old, "old").join(positive(new, "new"), "instrument", "full_outer").fillna(
        0, ["old", "new"]).withColumn("delta", F.col("new") - F.col("old"))


def event_mix(observed: DataFrame, controls: DataFrame, keys: list[str]) -> DataFrame:
    """Observed next to control events: median stop, time exits, mean gross, ambiguity, ratios."""
    def profile(x: DataFrame, tag: str) -> DataFrame:
        return x.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"{tag}_n"), F.median("r_ticks").alias(f"{tag}_r"),
            _pct(F.col("exit_reason") == "TIME").alias(f"{tag}_time_pct"),
            F.avg("gross_r").alias(f"{tag}_gross"),
            _pct(F.col("same_bar_ambiguous")).alias(f"{tag}_amb_pct"))

    return profile(observed, "obs").join(profile(controls, "null"), keys).withColumns({
        "r_ratio": ratio(F.col("null_r"), F.col("obs_r")),
        "amb_ratio": ratio(F.col("null_amb_pct"), F.col("obs_amb_pct"))})


def paired_controls(swing: DataFrame, matched: DataFrame) -> DataFrame:
    """Both designs of one drawn bar next to each other: one row per variant, day and draw that is eligible under both.

    The designs draw the same bars, so a pair differs by its stop only.
    """
    keys = [*VARIANT, "local_date", "draw"]

    def side(x: DataFrame, tag: str) -> DataFrame:
        return x.filter("eligible AND net_r IS NOT NULL").select(*keys, *[F.col(c).alias(f"{c}_{tag}") for c in ("gross_r", "net_r", "r_ticks")])

    return side(swing, "swing").join(side(matched, "matched"), keys)


def design_rates(pvalues: DataFrame, gross: DataFrame) -> DataFrame:
    """Per design: variants, share of p below .05 and .10, median p, mean and median of the variants' mean control gross."""
    rates = comparator_rates(pvalues, ["swing", "matched"])
    long = gross.select(F.explode(F.array(*[F.struct(F.lit(c).alias("comparator"), F.col(f"gross_{c}").alias("g")) for c in ("swing", "matched")]))
                        .alias("r")).select("r.*")
    return rates.join(long.groupBy("comparator").agg(F.avg("g").alias("mean_null_gross"), F.median("g").alias("median_null_gross"),
                                                     F.count("g").alias("pools")), "comparator")


def comparator_rates(pvalues: DataFrame, columns: list[str]) -> DataFrame:
    """Per comparator: variants, share below .05 and .10, median p."""
    long = pvalues.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("comparator"), F.col(c).alias("p")) for c in columns])).alias("r")).select("r.*")
    return long.filter("p IS NOT NULL").groupBy("comparator").agg(
        F.count(F.lit(1)).alias("variants"), _pct(F.col("p") < 0.05).alias("pct_below_05"),
        _pct(F.col("p") < 0.10).alias("pct_below_10"), F.median("p").alias("median_p"))


def roll_ratios(bars: DataFrame, base: str = "c", other: str = "v") -> DataFrame:
    """Monthly bar-count ratio of one roll series to another, classified.

    Absolute severity comes first, then periodicity in either direction, then a uniform deficit.
    """
    months = bars.groupBy("instrument", F.trunc(F.col("ts").cast("date"), "MM").alias("month")).pivot(
        "roll", [base, other]).agg(F.count(F.lit(1)))
    ratio_col = ratio(F.col(other), F.col(base))
    m = months.withColumn("r", ratio_col).filter("r IS NOT NULL")
    worst = F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(
        F.struct("r", "month")), asc=False), 1, 4), lambda s: F.date_format(s["month"], "yyyy-MM")), ", ")
    x = m.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("months"), F.min("r").alias("r_min"), F.avg("r").alias("r_mean"),
        F.max("r").alias("r_max"), F.count_if(F.col("r") >= 1.4).alias("bad_months"), worst.alias("worst_months"))
    return x.withColumn("verdict", F.when(F.col("r_min") >= 3.0, "broken")
                        .when((F.col("r_max") / F.greatest(F.col("r_min"), F.lit(1e-9)) >= 1.8)
                              & (F.col("r_max") >= 1.4), "periodic")
                        .when(F.col("r_mean") > 1.3, "uniform").otherwise("fine"))
