"""Grouped performance metrics with day-clustered statistics and breadth.

Rows are first summed per (key, day) with map-side combining, so a variant that owns most of
the journal still reduces to at most one row per calendar day before it meets a window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.operators.eligibility import RULES
from barloom.params import VARIANT

# Annualisation, profit-factor sentinel and top-day share.
YEAR = math.sqrt(252)
NO_LOSS = 9999.0
TOP_DAY_SHARE = 0.05


def daily_rollup(marked: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of eligible rows and rule counts of all rows per (keys, window, date).

    A day without eligible rows keeps its rule counts, with n = 0 and null sums.
    """
    window = ["regime_window"] if "regime_window" in marked.columns and "regime_window" not in keys else []
    has = set(marked.columns)
    ok = F.col("eligible")

    def total(c: Column) -> Column:
        return F.sum(F.when(ok, c))

    def optional(name: str) -> Column:
        return total(F.col(name)) if name in has else F.lit(None).cast("double")

    g, n = F.col("gross_r"), F.col("net_r")
    return marked.groupBy(*keys, *window, "date").agg(
        F.count_if(ok).alias("n"),
        total(g).alias("gross"), total(n).alias("net"),
        F.count_if(ok & (g > 0)).alias("wins"), F.count_if(ok & (F.col("exit_reason") == "TP")).alias("tps"),
        total(F.greatest(g, F.lit(0.0))).alias("won"), total(F.least(g, F.lit(0.0))).alias("lost"),
        optional("mae_r").alias("mae"), optional("mfe_r").alias("mfe"),
        total(F.coalesce("gross_r_optimistic", "gross_r") if "gross_r_optimistic" in has else g).alias("optimistic"),
        optional("pct_bars_from_local").alias("local"),
        *[F.count_if(F.col(r)).alias(f"n_{r}") for r in RULES],
    ).withColumn("_active", F.col("n") > 0)


def _day_columns(daily: DataFrame, keys: list[str], breadth: bool) -> DataFrame:
    """Running figures along the days of each key, all on one sort.

    Months and regime windows are consecutive days, so their sums are differences of the running
    sum at their last days.
    """
    ordered = Window.partitionBy(*keys, "_active").orderBy("date")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys, "_active")
    x = daily.withColumns({
        "_cum": F.sum("gross").over(so_far),
        "_mean_net": F.sum("net").over(whole) / F.sum("n").over(whole)})
    x = x.withColumns({
        "_dd": F.max("_cum").over(so_far) - F.col("_cum"),
        "_resid": F.pow(F.col("net") - F.col("n") * F.col("_mean_net"), 2)})
    if not breadth:
        return x

    def closes(value: Column) -> Column:
        """Last day of a run of equal values."""
        return ~F.lead(value).over(ordered).eqNullSafe(value)

    x = x.withColumns({
        "_pos": F.row_number().over(ordered),
        "_cum_net": F.sum("net").over(so_far), "_cum_n": F.sum("n").over(so_far),
        "_month_end": closes(F.trunc("date", "MM"))})
    calm = F.max(F.when(F.col("net") >= 0, F.col("_pos"))).over(so_far)

    def since(running: str, end: str) -> Column:
        """Running sum since the previous closed run."""
        return F.col(running) - F.coalesce(F.last(F.when(F.col(end), F.col(running)), ignorenulls=True).over(earlier), F.lit(0))

    x = x.withColumns({
        "_streak": F.when(F.col("net") < 0, F.col("_pos") - F.coalesce(calm, F.lit(0))).otherwise(0),
        "_month_net": F.when(F.col("_month_end"), since("_cum_net", "_month_end"))})
    if "regime_window" in x.columns:
        x = x.withColumn("_win_end", closes(F.col("regime_window")))
        x = x.withColumn("_win_mean", F.when(
            F.col("_win_end") & F.col("_active") & F.col("regime_window").isNotNull(),
            since("_cum_net", "_win_end") / since("_cum_n", "_win_end")))
    return x


def _core(x: DataFrame) -> list[Column]:
    n = F.sum("n")
    mean_day, dd = F.avg("gross"), F.max("_dd")
    downside = F.sqrt(F.avg(F.when(F.col("gross") < 0, F.col("gross") * F.col("gross"))))
    se = F.sqrt(F.sum("_resid")) / n
    return [
        n.alias("trade_count"),
        ratio(F.sum("wins"), n).alias("win_rate"), ratio(F.sum("tps"), n).alias("tp_hit_rate"),
        ratio(F.sum("gross"), n).alias("expectancy_gross_r"),
        ratio(F.sum("net"), n).alias("expectancy_net_r"),
        F.coalesce(ratio(F.sum("won"), F.abs(F.sum("lost"))), F.lit(NO_LOSS)).alias("profit_factor"),
        dd.alias("max_drawdown_r"),
        ratio(mean_day, F.stddev_pop("gross")).__mul__(YEAR).alias("sharpe_r"),
        ratio(mean_day, downside).__mul__(YEAR).alias("sortino_r"),
        F.when(dd > 0, mean_day * 252 / dd).alias("calmar_r"),
        ratio(ratio(F.sum("net"), n), se).alias("t_cluster_net"),
        ratio(F.sum("mae"), n).alias("avg_mae_r"), ratio(F.sum("mfe"), n).alias("avg_mfe_r"),
        ratio(F.sum("optimistic"), n).alias("expectancy_gross_r_optimistic"),
        ratio(F.sum("local"), n).alias("pct_trades_from_local"),
        *[F.sum(f"n_{r}").alias(f"n_{r}") for r in RULES],
    ]


def _breadth(x: DataFrame) -> list[Column]:
    up = F.greatest(F.col("net"), F.lit(0.0))
    gains = F.sum(F.when(F.col("_active"), up))
    days = F.count_if("_active")
    best = F.slice(F.sort_array(F.collect_list("net"), asc=False), 1, F.ceil(days * TOP_DAY_SHARE).cast("int"))
    top = F.aggregate(best, F.lit(0.0), lambda acc, v: acc + F.greatest(v, F.lit(0.0)))
    out = [
        days.alias("n_distinct_days"),
        ratio(F.max(F.when(F.col("_active"), up)), gains).alias("top1_day_pnl_share"),
        F.when(days > 0, ratio(top, gains)).alias("top5pct_day_pnl_share"),
        ratio(F.greatest(F.max("_month_net"), F.lit(0.0)), gains).alias("pnl_share_from_single_month"),
        F.median("net").alias("median_daily_r"), F.avg("net").alias("mean_daily_r"),
        F.max("_streak").alias("max_consecutive_losing_days"),
    ]
    if "_win_mean" in x.columns:
        out += [
            F.count_if(F.col("_win_mean") > 0).alias("n_windows_positive"),
            F.count("_win_mean").alias("n_windows_observed"),
            F.min("_win_mean").alias("worst_window_expectancy"),
        ]
    return out


def variant_summary(marked: DataFrame, keys: list[str] = VARIANT, breadth: bool = True) -> DataFrame:
    """Metrics of the eligible rows per key, with exclusion counts over all rows.

    ``marked`` comes from ``mark_eligibility``. ``keys`` plus "regime_window" with
    ``breadth=False`` gives the per-window summary.
    """
    x = _day_columns(daily_rollup(marked, keys), keys, breadth)
    out = x.groupBy(*keys).agg(*_core(x), *(_breadth(x) if breadth else [])).filter("trade_count > 0")
    if not breadth:
        return out.drop(*[f"n_{r}" for r in RULES])
    pair = ["instrument", "session"]
    chances = marked.groupBy(*pair).agg(F.countDistinct("date").alias("opportunity_days"))
    return (
        out.join(chances, pair)
        .withColumn("frac_days_traded", F.col("n_distinct_days") / F.col("opportunity_days"))
        .withColumn("deployable_trade_count", F.col("trade_count"))
        .drop("opportunity_days")
    )


def regime_summary(marked: DataFrame) -> DataFrame:
    return variant_summary(marked, [*VARIANT, "regime_window"], breadth=False)


def drawdowns(trades: DataFrame, keys: list[str], value: str = "gross_r") -> DataFrame:
    """Largest fall of the cumulative daily sum below its running maximum."""
    daily = trades.groupBy(*keys, "date").agg(F.sum(value).alias("v"))
    so_far = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = daily.withColumn("_cum", F.sum("v").over(so_far))
    x = x.withColumn("_dd", F.max("_cum").over(so_far) - F.col("_cum"))
    return x.groupBy(*keys).agg(F.count(F.lit(1)).alias("days"), F.max("_dd").alias("max_drawdown"))


def losing_streaks(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Longest run of consecutive traded days with a negative net sum."""
    daily = trades.groupBy(*keys, "date").agg(F.sum("net_r").alias("net"))
    losing = F.col("net") < 0
    x = daily.withColumn("_island", F.row_number().over(Window.partitionBy(*keys).orderBy("date"))
                         - F.row_number().over(Window.partitionBy(*keys, losing).orderBy("date")))
    runs = x.groupBy(*keys, losing.alias("losing"), "_island").agg(F.count(F.lit(1)).alias("len"))
    return runs.groupBy(*keys).agg(
        F.max(F.when(F.col("losing"), F.col("len")).otherwise(0)).alias("max_losing_days"))
