"""Session days: local bars, opening ranges and quality flags.

Bars are shuffled once, by session day, and then live as one row per day with the day's bars in
an array ordered by index. A day holds at most one bar per slot of its session window, so both
the windows and the array are bounded by the clock, never by the data volume. Everything
downstream (events, stops, barriers) reads that array in place and needs no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.calendar import sessionize
from barloom.params import GridSpec

DAY = ["instrument", "session", "local_date"]
CONTEXT = ["atr_4h", "prev_close", "parkinson_vol_14d", "realized_vol_14d"]


def day_keys(df: DataFrame) -> list[str]:
    """Session-day key; histories cut into regime windows keep the window in the key."""
    return DAY + (["regime_window"] if "regime_window" in df.columns else [])


def _since(x: DataFrame, since: str | None) -> DataFrame:
    return x if since is None else x.filter(F.col("local_date") >= F.lit(since).cast("date"))


def _in_session() -> Column:
    return F.col("wall") >= F.col("open_min")


def _in_range(rm: int) -> Column:
    return _in_session() & (F.col("wall") < F.col("open_min") + rm)


def session_bars(bars: DataFrame, grid: GridSpec, pairs: DataFrame | None = None, since: str | None = None) -> DataFrame:
    """Bars of admitted session days, from local date ``since`` on if given, with index and opening ranges.

    A day is admitted when at least one opening range is complete. Context bars before a gap
    wider than ``gap_minutes`` ahead of the open are dropped. ``idx`` counts kept bars from 0.
    All windows share one partitioning and one sort.
    """
    x = _since(sessionize(bars, grid, pairs), since)
    day = Window.partitionBy(*day_keys(x))
    by_ts = day.orderBy("ts")

    x = x.withColumns({
        "_pos": F.row_number().over(by_ts) - 1,
        "_gap": F.col("ts") - F.lag("ts").over(by_ts) > F.make_dt_interval(
            F.lit(0), F.lit(0), F.lit(grid.gap_minutes)),
    })
    x = x.withColumns({
        **{f"_n_{rm}": F.count_if(_in_range(rm)).over(day) for rm in grid.range_minutes},
        "in_bars": F.count_if(_in_session()).over(day),
        "_open": F.min(F.when(_in_session(), F.col("ts"))).over(day),
    })
    full = {rm: F.col(f"_n_{rm}") >= rm / grid.bar_minutes for rm in grid.range_minutes}
    admitted = F.lit(False)
    for rm in grid.range_minutes:
        admitted = admitted | full[rm]
    x = x.filter(admitted)
    x = x.withColumns({
        "_from": F.coalesce(F.max(F.when(
            F.col("_gap") & (F.col("ts") <= F.col("_open")), F.col("_pos"))).over(day), F.lit(0)),
        **{f"rh_{rm}": F.when(full[rm], F.max(F.when(_in_range(rm), F.col("h"))).over(day))
           for rm in grid.range_minutes},
        **{f"rl_{rm}": F.when(full[rm], F.min(F.when(_in_range(rm), F.col("l"))).over(day))
           for rm in grid.range_minutes},
    })
    x = x.filter(F.col("_pos") >= F.col("_from")).withColumn("idx", F.col("_pos") - F.col("_from"))
    expected = F.greatest(F.lit(1), F.col("exit_min") - F.col("open_min"))
    return x.withColumn(
        "completeness", F.least(F.lit(1.0), F.col("in_bars") * grid.bar_minutes / expected)
    ).drop("_pos", "_gap", "_from", "_open", *[f"_n_{rm}" for rm in grid.range_minutes])


def opening_ranges(sb: DataFrame, grid: GridSpec) -> DataFrame:
    """Long form: one row per session day and complete range size."""
    keys = day_keys(sb)
    rows = F.explode(F.array(*[
        F.struct(F.lit(rm).alias("range_minutes"), F.col(f"rh_{rm}").alias("range_high"),
                 F.col(f"rl_{rm}").alias("range_low")) for rm in grid.range_minutes]))
    return sb.filter(F.col("idx") == 0).select(*keys, rows.alias("r")).select(*keys, "r.*").filter(
        F.col("range_high").isNotNull()).withColumn(
        "range_width_ticks", F.col("range_high") - F.col("range_low"))


def contract_ends(bars: DataFrame, grid: GridSpec, pairs: DataFrame | None = None, since: str | None = None) -> DataFrame:
    """First and last known contract of the session, for every admitted day.

    A plain aggregate of three columns of the bars: it is combined before its exchange, so what is shuffled is days, not bars.
    """
    window = [c for c in ("regime_window",) if c in bars.columns]
    x = _since(sessionize(bars.select("instrument", "ts", "contract", *window), grid, pairs), since)
    known = F.when(_in_session() & F.col("contract").isNotNull(), F.col("ts"))
    full = [F.count_if(_in_range(rm)) >= rm / grid.bar_minutes for rm in grid.range_minutes]
    admitted = full[0]
    for more in full[1:]:
        admitted = admitted | more
    return x.groupBy(*day_keys(x)).agg(
        F.min_by("contract", known).alias("first_contract"), F.max_by("contract", known).alias("last_contract"),
        admitted.alias("_admitted")).filter("_admitted").drop("_admitted")


def contract_changes(ends: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Per session day: did the contract change since the last admitted day that had one?

    ``before`` has, per instrument and session, the last contract of an earlier run. One slim row per day; the window runs over a
    calendar's worth of rows per pair.
    """
    keys = day_keys(ends)
    history = Window.partitionBy(*[k for k in keys if k != "local_date"]).orderBy(
        "local_date").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.last("last_contract", ignorenulls=True).over(history)
    x = ends.withColumn("_earlier", earlier)
    if before is not None:
        x = x.join(before.select("instrument", "session", F.col("last_contract").alias("_before")), ["instrument", "session"], "left") \
            .withColumn("_earlier", F.coalesce("_earlier", "_before"))
    return x.select(*keys, F.coalesce(F.col("_earlier") != F.col("first_contract"), F.lit(False)).alias("changed_since"))


def day_aggregates(sb: DataFrame, grid: GridSpec) -> list[Column]:
    """Aggregates that turn a day's bars into its row."""
    ins = _in_session()

    def at_open(name: str) -> Column:
        c = F.col(name) if name in sb.columns else F.lit(None).cast("double")
        return F.min_by(c, F.when(ins, F.col("ts")))

    known = ins & F.col("contract").isNotNull()
    bar = F.struct("idx", "ts", "wall", "o", "h", "l", "c", "source", "contract")
    return [
        F.first("open_min").alias("open_min"),
        F.min(F.when(ins, F.col("idx"))).alias("open_idx"),
        F.max("idx").alias("last_idx"),
        F.first("in_bars").alias("session_bars"),
        F.first("completeness").alias("completeness"),
        at_open("o").alias("open_tick"),
        *[at_open(c).alias(c) for c in CONTEXT],
        (F.min(F.when(known, F.col("contract"))) != F.max(F.when(known, F.col("contract")))).alias("_in"),
        (F.count_if(ins & (F.col("source") == "local")) / F.count_if(ins)).alias("pct_local"),
        *[F.first(f"{side}_{rm}").alias(f"{side}_{rm}")
          for rm in grid.range_minutes for side in ("rh", "rl")],
        F.array_sort(F.collect_list(bar)).alias("bars"),
    ]


def finish_days(days: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds the gap to the previous close and the contract-change flags to day rows. The day rows stay where they are; the slim
    ``changes`` come to them."""
    return (
        days.join(changes, day_keys(days))
        .withColumn("gap_ticks", F.col("open_tick") - F.col("prev_close"))
        .withColumn("changed_in", F.coalesce("_in", F.lit(False)))
        .drop("_in")
    )


def session_quality(days: DataFrame) -> DataFrame:
    """The day rows without arrays and links, as the quality table."""
    return days.select(
        *day_keys(days), "open_idx", "last_idx", "session_bars", "completeness", "open_tick",
        *CONTEXT, "gap_ticks", "changed_in", "changed_since", "pct_local")
