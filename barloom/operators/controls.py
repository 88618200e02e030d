"""Control events: stratified day samples, random entries, and their return pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rng import draw, draw_below, stable_seed
from barloom.operators.barriers import label_barriers, with_returns
from barloom.operators.costs import with_costs
from barloom.operators.eligibility import mark_eligibility
from barloom.operators.events import bar_at, place_stops, sign_of
from barloom.operators.sizing import contracts_for
from barloom.params import FAMILY, MASTER_SEED, NULL_ENTRIES_PER_DAY, GridSpec, Market


def allocate_strata(sizes: DataFrame, keys: list[str], stratum: str, target: int) -> DataFrame:
    """Days to take per stratum: largest remainder by weight, capped, spare days dealt in rounds.

    ``sizes`` has one row per (keys, stratum): size, weight. Non-positive total weight falls back
    to the sizes. Adds n_days, n_strata, design and alloc.
    """
    w = Window.partitionBy(*keys)
    x = sizes.withColumns({
        "n_days": F.sum("size").over(w), "n_strata": F.count(F.lit(1)).over(w),
        "_wsum": F.sum(F.greatest(F.col("weight"), F.lit(0.0))).over(w)})
    weight = F.when(F.col("_wsum") > 0, F.greatest(F.col("weight"), F.lit(0.0))).otherwise(
        F.col("size").cast("double"))
    total = F.when(F.col("_wsum") > 0, F.col("_wsum")).otherwise(F.col("n_days").cast("double"))
    x = x.withColumn("_raw", F.lit(target) * weight / total)
    x = x.withColumn("_base", F.least(F.col("size"), F.floor("_raw")))
    x = x.withColumn("_left", F.lit(target) - F.sum("_base").over(w))
    x = x.withColumn("_turn", F.row_number().over(w.orderBy(
        F.desc(F.col("_raw") - F.floor("_raw")), F.desc(F.col(stratum).cast("string")))))
    spare = F.least(F.col("size") - F.col("_base"), F.col("_left"))
    slots = x.select(*keys, stratum, "_turn", "_left", F.explode(F.when(
        spare > 0, F.sequence(F.lit(1).cast("bigint"), spare))).alias("_round"))
    dealt = slots.withColumn("_k", F.row_number().over(w.orderBy("_round", "_turn"))).filter(
        F.col("_k") <= F.col("_left")).groupBy(*keys, stratum).agg(F.count(F.lit(1)).alias("_extra"))
    x = x.join(dealt, [*keys, stratum], "left")
    everything = F.col("n_days") <= target
    return x.withColumn("design", F.when(everything, "exhausted").when(
        F.col("n_strata") <= 1, "random").otherwise("stratified")).withColumn(
        "alloc", F.when(everything, F.col("size")).otherwise(
            F.col("_base") + F.coalesce("_extra", F.lit(0)))).select(
        *keys, stratum, "size", "n_days", "n_strata", "design", "alloc")


def day_seed(keys: list[str], master: int = MASTER_SEED) -> Column:
    """Seed of the day sample of a key."""
    return stable_seed(F.lit("days"), *[F.col(k) for k in keys], master=master)


def sample_days(days: DataFrame, keys: list[str], stratum: str, target: int, date: str = "local_date",
                weights: DataFrame | None = None, master: int = MASTER_SEED,
                seed_keys: list[str] | None = None) -> DataFrame:
    """Day sample without replacement per key, spread over strata in the observed mix.

    Keys that agree on ``seed_keys`` (all of ``keys`` by default) rank their days alike, so their samples
    differ only by how many days each stratum gives.

    ``days`` holds distinct (keys, date, stratum). Within a stratum the days with the smallest
    hash are taken, so a rerun gives the same sample.
    """
    sizes = days.groupBy(*keys, stratum).agg(F.count(F.lit(1)).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.col("size").cast("double"))
    else:
        sizes = sizes.join(weights.select(*keys, stratum, F.col("weight").cast("double")),
                           [*keys, stratum], "left").fillna({"weight": 0.0})
    alloc = allocate_strata(sizes, keys, stratum, target)
    order = draw(day_seed(keys if seed_keys is None else seed_keys, master), F.datediff(F.col(date), F.lit("1970-01-01").cast("date")))
    ranked = days.withColumn("_rank", F.row_number().over(
        Window.partitionBy(*keys, stratum).orderBy(order, date)))
    return ranked.join(alloc, [*keys, stratum]).filter(F.col("_rank") <= F.col("alloc")).select(
        *keys, stratum, date, "design", "n_days")


def observed_weights(eligible: DataFrame, keys: list[str], stratum: str = "regime_window") -> DataFrame:
    """Distinct traded days per key and stratum."""
    days = eligible.select(*keys, stratum, "date").distinct()
    return days.groupBy(*keys, stratum).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def stop_pools(eligible: DataFrame, keys: list[str] = FAMILY) -> DataFrame:
    """Observed stop distances per family as a histogram: values and their cumulative counts.

    Distances are whole ticks, so the arrays are bounded by the tick range, not by the trades.
    """
    hist = eligible.filter(F.col("r_ticks").isNotNull()).groupBy(*keys, "r_ticks").agg(
        F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("r_ticks").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_cum", F.sum("_n").over(w))
    return hist.groupBy(*keys).agg(
        F.max("_cum").alias("pool_size"),
        F.array_sort(F.collect_list(F.struct("_cum", "r_ticks"))).alias("_h")).select(
        *keys, "pool_size", F.col("_h._cum").alias("pool_cum"), F.col("_h.r_ticks").alias("pool_r"))


def pick_stop(u: Column) -> Column:
    """The ``u``-th stop (0-based) of the pool in ascending order."""
    return F.get("pool_r", F.size(F.filter("pool_cum", lambda c: c <= u)))


def control_events(days: DataFrame, picks: DataFrame, grid: GridSpec, design: str, label: str,
                   per_day: int = NULL_ENTRIES_PER_DAY, master: int = MASTER_SEED) -> DataFrame:
    """Random entries on the picked days of each family.

    ``picks`` has family keys and local_date, plus the pool arrays for the matched design. The
    entry bar is uniform over the bars after the range and filled at its open. "matched" draws
    the stop distance from the family's own pool, "swing" places it like an observed stop.
    """
    day = ["instrument", "session", "local_date"]
    x = picks.join(days, day)
    rm_first = F.lit(None).cast("int")
    high, low = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for rm in grid.range_minutes:
        here = F.col("range_minutes") == rm
        rm_first = F.when(here & F.col(f"rh_{rm}").isNotNull(), F.col(f"act_{rm}_long")).otherwise(rm_first)
        high = F.when(here, F.col(f"rh_{rm}")).otherwise(high)
        low = F.when(here, F.col(f"rl_{rm}")).otherwise(low)
    is_long = F.col("direction") == "long"
    seed = stable_seed(F.lit("joint-entry"), F.lit(label), F.col("instrument"), F.col("session"), master=master)
    number = F.datediff("local_date", F.lit("1970-01-01").cast("date")).cast("bigint") * (2 * per_day)
    keep = [*FAMILY, "local_date", "regime_window", "last_idx", "open_idx", "completeness", "changed_in",
            "changed_since", "atr_4h", "bars", "pool_size", "pool_cum", "pool_r"]
    x = x.withColumns({"_first": rm_first, "boundary": F.when(is_long, high).otherwise(low),
                       "opposite": F.when(is_long, low).otherwise(high), "_seed": seed, "_no": number})
    x = x.filter(F.col("_first").isNotNull() & (F.col("_first") <= F.col("last_idx")))
    x = x.select(*[c for c in keep if c in x.columns], "_first", "boundary", "opposite", "_seed", "_no",
                 F.explode(F.sequence(F.lit(0), F.lit(per_day - 1))).alias("draw"))
    span = F.col("last_idx") + 1 - F.col("_first")
    x = x.withColumn("entry_idx", (F.col("_first") + draw_below(
        F.col("_seed"), F.col("_no") + 2 * F.col("draw"), span)).cast("int"))
    x = x.withColumns({
        "fill_t": bar_at(F.col("entry_idx"))["o"],
        "fill_at_bar_close": F.lit(False),
        "entry_mode_control": F.lit("NULL-MATCHED" if design == "matched" else "NULL"),
    })
    if design == "matched":
        u = draw_below(F.col("_seed"), F.col("_no") + 2 * F.col("draw") + 1, F.col("pool_size"))
        x = x.withColumn("_r", pick_stop(u)).filter(F.col("_r") >= 1)
        x = x.withColumns({
            "sl_t": F.col("fill_t") - sign_of(F.col("direction")) * F.col("_r"),
            "sl_source": F.lit("matched")}).drop("_r")
    else:
        x = place_stops(x, grid, F.col("entry_idx")).drop("anchor_idx", "sl_bars_back")
    return x.drop("_first", "_seed", "_no", "pool_size", "pool_cum", "pool_r")


def label_controls(events: DataFrame, grid: GridSpec, market: Market) -> DataFrame:
    """Control events through the same barriers, costs and rules as observed ones."""
    out = with_returns(with_costs(label_barriers(events, grid), market), grid)
    out = out.withColumns({
        "contracts": contracts_for(F.col("r_ticks"), F.col("tick_value_usd")),
        "contract_changed_in_session": F.col("changed_in"),
        "contract_changed_since_prev_session": F.col("changed_since"),
        "session_bar_completeness": F.col("completeness"),
    })
    return mark_eligibility(out)


def control_days(labelled: DataFrame, value: str = "net_r", keys: list[str] = FAMILY) -> DataFrame:
    """Per family, level and day: count and sum of eligible control returns."""
    ok = labelled.filter(F.col("eligible") & F.col(value).isNotNull())
    return ok.groupBy(*keys, "rr", F.col("local_date").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def stratified_variants(summary: DataFrame, cells: list[str], per_cell: int, cap: int,
                        keys: list[str], master: int = MASTER_SEED) -> DataFrame:
    """``per_cell`` variants of every cell by smallest hash, then at most ``cap`` overall."""
    seed = stable_seed(*[F.col(k) for k in keys], master=master)
    x = summary.withColumn("_h", draw(seed, F.lit(1)))
    x = x.withColumn("_rank", F.row_number().over(Window.partitionBy(*cells).orderBy("_h", *keys)))
    return x.filter(F.col("_rank") <= per_cell).orderBy("_h", *keys).limit(cap).drop("_h", "_rank")
