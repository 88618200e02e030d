"""Setup ranking: aggregation, gates, composite score, frontier, repricing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import mean_rank, mean_rank_pct, ratio, share
from barloom.functions.quantiles import value_bucket
from barloom.operators.costs import with_slippage
from barloom.operators.sizing import reprice, size_by_mode, size_trades
from barloom.params import (
    MAX_FRICTION_R, MAX_RISK_USD, MIN_EXECUTABLE_SHARE, MIN_EXECUTABLE_SL_TICKS,
    MIN_EXECUTABLE_TP_TICKS, MIN_TRADES, SETUP, Market,
)

GATES = ("g_tp", "g_sl", "g_friction", "g_afford", "g_sample")


def setup_metrics(eligible: DataFrame, market: Market) -> DataFrame:
    """One row per setup (both directions) with returns, stops, sizing and yearly P&L.

    Needs tick_value_usd. Stops and targets are tick multiples, so exact percentiles stay small.
    """
    x = size_trades(eligible)
    agg = x.groupBy(*SETUP).agg(
        F.count(F.lit(1)).alias("trades"), share(F.col("net_r") > 0).alias("win_rate"),
        F.avg("gross_r").alias("exp_gross_r"), F.avg("net_r").alias("exp_net_r"),
        F.sum("net_r").alias("total_net_r"),
        F.median("r_ticks").alias("sl_med"), F.percentile("r_ticks", F.lit(0.10)).alias("sl_p10"),
        F.median("tp_ticks").alias("tp_med"), F.median("risk_per_contract_usd").alias("risk_med_usd"),
        share(F.col("contracts") > 0).alias("executable_pct"), F.avg("contracts").alias("mean_contracts"),
        F.avg("risk_deployed_usd").alias("risk_deployed_mean"), F.sum("pnl_usd").alias("total_pnl_usd"),
        F.countDistinct("date").alias("n_days"))
    classes = market.instrument_table(eligible.sparkSession).select("instrument", "asset_class")
    agg = with_slippage(agg, market).withColumnRenamed("slippage_ticks", "slip_ticks")
    return agg.join(classes, "instrument", "left").withColumns({
        "friction_r": ratio(F.col("slip_ticks"), F.col("sl_med")),
        "capital_eff": F.col("risk_deployed_mean") / F.lit(MAX_RISK_USD),
        "pnl_per_yr_usd": ratio(F.col("total_pnl_usd") * 252.0, F.col("n_days"))})


def gate_setups(setups: DataFrame, min_trades: int = MIN_TRADES) -> DataFrame:
    x = setups.withColumns({
        "g_tp": F.col("tp_med") >= MIN_EXECUTABLE_TP_TICKS,
        "g_sl": F.col("sl_med") >= MIN_EXECUTABLE_SL_TICKS,
        "g_friction": F.coalesce(F.col("friction_r") <= MAX_FRICTION_R, F.lit(False)),
        "g_afford": F.col("executable_pct") >= MIN_EXECUTABLE_SHARE,
        "g_sample": F.col("trades") >= min_trades})
    failed = sum(((~F.col(g)).cast("int") for g in GATES), F.lit(0))
    return x.withColumn("n_gates_failed", failed).withColumn("tradable", failed == 0)


def score_setups(gated: DataFrame) -> DataFrame:
    """Mean of three average-rank percentiles among tradable setups that make money.

    Setups are bounded by the parameter grid, so the ranking window is small.
    """
    x = gated.withColumn("scoreable", F.col("tradable") & (F.col("total_pnl_usd") > 0))
    in_play = F.col("scoreable")
    parts = {"pct_pnl": "total_pnl_usd", "pct_wr": "win_rate", "pct_cap": "capital_eff"}
    x = x.withColumns({
        name: F.when(in_play, mean_rank_pct(F.col(src), ["scoreable"])) for name, src in parts.items()})
    return x.withColumn("score", (F.col("pct_pnl") + F.col("pct_wr") + F.col("pct_cap")) / 3)


def gate_attrition(gated: DataFrame) -> DataFrame:
    counts = gated.agg(F.count(F.lit(1)).alias("setups"), *[
        F.count_if(F.col(g)).alias(g) for g in (*GATES, "tradable")])
    rows = F.explode(F.array(*[
        F.struct(F.lit(g).alias("gate"), F.col(g).alias("passed")) for g in (*GATES, "tradable")]))
    return counts.select("setups", rows.alias("r")).select(
        "r.*", (F.col("setups") - F.col("r.passed")).alias("failed"))


def by_asset_class(gated: DataFrame) -> DataFrame:
    return gated.groupBy("asset_class").agg(
        F.count(F.lit(1)).alias("setups"), F.count_if("tradable").alias("tradable"),
        F.avg("win_rate").alias("win_rate"), F.median("sl_med").alias("sl_med"),
        F.median("tp_med").alias("tp_med"), F.median("friction_r").alias("friction"),
        F.avg("executable_pct").alias("afford"), F.avg("capital_eff").alias("cap_eff"),
        F.median("total_pnl_usd").alias("med_pnl"), F.max("win_rate").alias("best_wr"),
        F.max("total_pnl_usd").alias("best_pnl"))


def by_rr(gated: DataFrame) -> DataFrame:
    return gated.groupBy("rr").agg(
        F.count(F.lit(1)).alias("setups"), F.avg("win_rate").alias("win_rate"),
        F.median("total_pnl_usd").alias("med_pnl"), F.max("total_pnl_usd").alias("best_pnl"),
        share(F.col("total_pnl_usd") > 0).alias("pct_profitable"))


def spearman(setups: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks for ties."""
    x = setups.withColumn("_all", F.lit(1)).withColumns({
        "_ra": mean_rank(F.col(a), ["_all"]), "_rb": mean_rank(F.col(b), ["_all"])})
    return x.agg(F.count(F.lit(1)).alias("setups"), F.corr("_ra", "_rb").alias("spearman"))


PARETO_AXES = ("total_pnl_usd", "win_rate", "capital_eff")


def _frontier(points: DataFrame, axes: tuple, group: str) -> DataFrame:
    """Undominated points per ``group``, folding down the first axis.

    In descending order a point can only be dominated by one before it, so the fold keeps the
    frontier found so far and never compares two dominated points.
    """
    a, b, c = axes
    neg = F.struct(*[(-F.col(x)).alias(x) for x in axes])
    packed = points.groupBy(group).agg(F.array_sort(F.collect_list(neg)).alias("_p"))

    def step(kept, p):
        beaten = F.exists(kept, lambda q: (q[b] <= p[b]) & (q[c] <= p[c]))
        return F.when(beaten, kept).otherwise(F.concat(kept, F.array(p)))

    fold = F.aggregate("_p", F.slice("_p", 1, 0), step)
    return packed.select(F.explode(fold).alias("k")).select(*[(-F.col(f"k.{x}")).alias(x) for x in axes])


def pareto_frontier(setups: DataFrame, axes: tuple[str, str, str] = PARETO_AXES,
                    cells: int = 8, buckets: int = 16) -> DataFrame:
    """Setups that no other setup matches on all axes and beats on one.

    The space is cut into cells ** 3 cells. A cell below another non-empty one on all axes is dropped whole. The rest folds to frontiers
    of hash buckets inside cells, and their points meet only those of cells that aren't below theirs on any axis, pair of cells by
    pair of cells, so no group gathers all of them. Equal points do not dominate each other, so the work runs on distinct points.
    """
    points = setups.select(*axes).dropna().distinct()
    span = points.agg(*[f(a).alias(f"_{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))])
    points = points.crossJoin(F.broadcast(span)).withColumns({
        f"_c{k}": value_bucket(F.col(a), F.col(f"_lo_{a}"), F.col(f"_hi_{a}"), cells) for k, a in enumerate(axes)})
    place = ["_c0", "_c1", "_c2"]
    number = lambda t="": (F.col(f"{t}_c0") * cells + F.col(f"{t}_c1")) * cells + F.col(f"{t}_c2")
    filled = points.select(*place).distinct()  # at most cells ** 3 rows
    above = filled.select(*[F.col(c).alias(f"a{c}") for c in place])
    alive = filled.join(above, (F.col("a_c0") > F.col("_c0")) & (F.col("a_c1") > F.col("_c1")) & (F.col("a_c2") > F.col("_c2")), "left_anti")
    kept = points.join(alive, place, "left_semi").withColumn(
        "_g", number() * buckets + F.pmod(F.xxhash64(*axes), F.lit(buckets)))
    local = _frontier(kept, axes, "_g").join(kept.select(*axes, number().alias("_cell")), list(axes))
    pairs = alive.join(alive.select(*[F.col(c).alias(f"a{c}") for c in place]),
                       (F.col("a_c0") >= F.col("_c0")) & (F.col("a_c1") >= F.col("_c1")) & (F.col("a_c2") >= F.col("_c2"))) \
        .select(number().alias("_cell"), number("a").alias("_above"))
    other = local.select(F.col("_cell").alias("_above"), *[F.col(a).alias(f"_o_{a}") for a in axes])
    at_least, beyond = F.lit(True), F.lit(False)
    for a in axes:
        at_least, beyond = at_least & (F.col(f"_o_{a}") >= F.col(a)), beyond | (F.col(f"_o_{a}") > F.col(a))
    beaten = local.join(pairs, "_cell").join(other, "_above").filter(at_least & beyond).select(*axes).distinct()
    best = local.select(*axes).join(beaten, list(axes), "left_anti")
    return setups.join(best, list(axes), "left_semi")


def top_setups(setups: DataFrame, by: str, k: int = 25, min_trades: int | None = None) -> DataFrame:
    x = setups if min_trades is None else setups.filter(F.col("trades") >= min_trades)
    return x.orderBy(F.desc(by), *SETUP).limit(k)


def reprice_setups(fillable: DataFrame, market: Market, min_trades: int = MIN_TRADES) -> DataFrame:
    """Per setup and sizing mode: affordability, wins, expectancy, P&L and commission."""
    x = reprice(size_by_mode(with_slippage(
        fillable.drop("slippage_ticks"), market), market))
    t = F.col("taken")
    n_taken = F.count_if(t)
    out = x.groupBy(*SETUP, "mode").agg(
        F.count(F.lit(1)).alias("trades"), n_taken.alias("trades_taken"), share(t).alias("afford"),
        F.coalesce(ratio(F.count_if(t & (F.col("repriced_net_r") > 0)), n_taken), F.lit(0.0)).alias("win_rate"),
        F.coalesce(ratio(F.sum("repriced_net_r"), n_taken), F.lit(0.0)).alias("exp_net_r"),
        F.sum("pnl_usd").alias("total_pnl_usd"),
        F.sum(F.when(t, F.col("commission_usd")).otherwise(0.0)).alias("commission_usd"),
        (F.avg("risk_usd") / F.lit(MAX_RISK_USD)).alias("cap_eff"),
        F.coalesce(ratio(F.sum(F.when(t, F.col("n_full"))), n_taken), F.lit(0.0)).alias("mean_full"),
        F.coalesce(ratio(F.sum(F.when(t, F.col("n_micro"))), n_taken), F.lit(0.0)).alias("mean_micro"),
        F.median("r_ticks").alias("sl_med"), F.median("tp_ticks").alias("tp_med"))
    return out.filter(F.col("trades") >= min_trades).withColumn(
        "tradable", F.col("afford") >= MIN_EXECUTABLE_SHARE)


def best_mode(repriced: DataFrame) -> DataFrame:
    """The sizing mode with the largest P&L per setup; ties fall to full, hybrid, micro order."""
    w = Window.partitionBy(*SETUP).orderBy(F.desc("total_pnl_usd"), "mode")
    return repriced.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def population_shift(repriced: DataFrame) -> DataFrame:
    up = F.col("total_pnl_usd") > 0
    return repriced.groupBy("mode").agg(
        F.count(F.lit(1)).alias("setups"), F.count_if("tradable").alias("tradable"),
        F.count_if(up).alias("net_positive"), F.count_if(up & F.col("tradable")).alias("tradable_positive"),
        F.max(F.when(F.col("tradable"), F.col("total_pnl_usd"))).alias("best_pnl"))
