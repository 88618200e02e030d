"""Ordered breakout events per session day, range size and direction.

Chain: breakout (II) → return to the boundary (TI) → renewed breakout (R-II) or renewed close
beyond it (R-CC); closes beyond the boundary (CC) need no breakout. Each is the first bar that
meets its condition after the previous link. The links are window minima over the day, so the
whole chain shares the session-day partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.session_days import (
    contract_changes, contract_ends, day_aggregates, day_keys, finish_days, session_bars,
)
from barloom.params import GridSpec

DIRECTIONS = ("long", "short")
SIGNAL = ["range_minutes", "entry_mode", "closure_tf", "direction"]


class _Side:
    """Conditions of one (range, direction); short mirrors long."""

    def __init__(self, rm: int, direction: str):
        self.rm, self.direction = rm, direction
        self.long = direction == "long"
        self.tag = f"{rm}_{direction}"
        self.bound = F.col(f"rh_{rm}") if self.long else F.col(f"rl_{rm}")
        self.other = F.col(f"rl_{rm}") if self.long else F.col(f"rh_{rm}")
        self.active = F.col("wall") >= F.col("open_min") + rm

    def breaks(self) -> Column:
        return (F.col("h") >= self.bound + 1) if self.long else (F.col("l") <= self.bound - 1)

    def returns(self) -> Column:
        return (F.col("l") <= self.bound) if self.long else (F.col("h") >= self.bound)

    def closes(self, tf: int, grid: GridSpec) -> Column:
        """A full ``tf`` bucket, counted from the range end, closes beyond the boundary."""
        last_minute = (F.col("wall") - F.col("open_min") - self.rm) % tf == tf - grid.bar_minutes
        beyond = (F.col("c") > self.bound) if self.long else (F.col("c") < self.bound)
        return last_minute & beyond

    def far_side(self) -> Column:
        return (F.col("l") <= self.other) if self.long else (F.col("h") >= self.other)


def _sides(grid: GridSpec) -> list[_Side]:
    return [_Side(rm, d) for rm in grid.range_minutes for d in DIRECTIONS]


def _first_idx(cond: Column) -> Column:
    return F.min(F.when(cond, F.col("idx")))


def build_days(bars: DataFrame, grid: GridSpec, pairs: DataFrame | None = None, since: str | None = None,
               before: DataFrame | None = None) -> DataFrame:
    """One row per session day: quality, ranges, event links and the day's bars.

    With ``since``, only days from that local date on; ``before`` then has the last contract of each pair until then.
    """
    sb = session_bars(bars, grid, pairs, since)
    keys = day_keys(sb)
    day = Window.partitionBy(*keys)
    sides = _sides(grid)
    x = sb.withColumns({
        f"brk_{s.tag}": _first_idx(s.active & s.breaks()).over(day) for s in sides})
    x = x.withColumns({
        f"tap_{s.tag}": _first_idx(
            s.active & s.returns() & (F.col("idx") > F.col(f"brk_{s.tag}"))).over(day)
        for s in sides})
    links = []
    for s in sides:
        after = s.active & (F.col("idx") > F.col(f"tap_{s.tag}"))
        links += [
            F.first(f"brk_{s.tag}").alias(f"brk_{s.tag}"),
            F.first(f"tap_{s.tag}").alias(f"tap_{s.tag}"),
            _first_idx(s.active).alias(f"act_{s.tag}"),
            _first_idx(after & s.breaks()).alias(f"rii_{s.tag}"),
            _first_idx(s.active & s.far_side()).alias(f"far_{s.tag}"),
        ]
        for tf in grid.closure_tfs[s.rm]:
            links += [_first_idx(s.active & s.closes(tf, grid)).alias(f"cc{tf}_{s.tag}"),
                      _first_idx(after & s.closes(tf, grid)).alias(f"rcc{tf}_{s.tag}")]
    days = x.groupBy(*keys).agg(*day_aggregates(x, grid), *links)
    return finish_days(days, contract_changes(contract_ends(bars, grid, pairs, since), before))


def detect_signals(days: DataFrame, grid: GridSpec) -> DataFrame:
    """One row per triggered (day, range, mode, closure, direction) with its bar indexes."""
    none = F.lit(None).cast("int")
    rows = []
    for s in _sides(grid):
        brk, tap = F.col(f"brk_{s.tag}"), F.col(f"tap_{s.tag}")
        links = [("II", grid.bar_minutes, brk, none), ("TI", grid.bar_minutes, tap, tap),
                 ("R-II", grid.bar_minutes, F.col(f"rii_{s.tag}"), tap)]
        for tf in grid.closure_tfs[s.rm]:
            links += [("CC", tf, F.col(f"cc{tf}_{s.tag}"), none),
                      ("R-CC", tf, F.col(f"rcc{tf}_{s.tag}"), tap)]
        for mode, tf, entry, tapped in links:
            rows.append(F.struct(
                F.lit(s.rm).alias("range_minutes"), F.lit(mode).alias("entry_mode"),
                F.lit(tf).alias("closure_tf"), F.lit(s.direction).alias("direction"),
                entry.alias("entry_idx"), brk.alias("breakout_idx"), tapped.alias("tap_idx"),
                s.bound.alias("boundary"), s.other.alias("opposite"),
                F.col(f"far_{s.tag}").alias("far_idx"),
            ))
    keep = [c for c in days.columns if not c.startswith(
        ("brk_", "tap_", "act_", "rii_", "far_", "cc", "rcc", "rh_", "rl_"))]
    return (
        days.select(*keep, F.explode(F.filter(
            F.array(*rows), lambda r: r["entry_idx"].isNotNull())).alias("s"))
        .select(*keep, "s.*")
    )


def sign_of(direction: Column) -> Column:
    return F.when(direction == "long", 1).otherwise(-1)


def bar_at(idx: Column) -> Column:
    """The day's bar with index ``idx`` (null outside the day)."""
    return F.get("bars", idx.cast("int"))


def place_stops(events: DataFrame, grid: GridSpec, anchor: Column) -> DataFrame:
    """Adds sl_t, sl_bars_back and sl_source from the bars before the ``anchor`` bar.

    The stop is the extreme of the latest unbroken run of bars closing against the trade among
    the ``lookback`` bars before the anchor, or the opposite range bound when there is no run,
    and never tighter than ``min_stop_ticks``. Levels are compared in signed ticks (price for
    long, −price for short), where the stop is always the lower side.
    """
    is_long = F.col("direction") == "long"
    sign = sign_of(F.col("direction"))

    def against(b: Column) -> Column:
        return F.when(is_long, b["c"] < b["o"]).otherwise(b["c"] > b["o"])

    oldest = F.greatest(anchor - grid.lookback_bars, F.lit(0)).cast("int")
    x = events.withColumn("anchor_idx", anchor.cast("int")).withColumn(
        "_look", F.slice("bars", oldest + 1, F.least(anchor, F.lit(grid.lookback_bars)).cast("int")))
    x = x.withColumn("_end", F.array_max(F.filter("_look", against)["idx"]))
    x = x.withColumn("_begin", F.coalesce(F.array_max(F.filter(
        "_look", lambda b: (~against(b)) & (b["idx"] < F.col("_end")))["idx"]) + 1, oldest))
    run = F.slice("_look", F.col("_begin") - oldest + 1, F.col("_end") - F.col("_begin") + 1)
    level = F.when(is_long, F.array_min(run["l"])).otherwise(-F.array_max(run["h"]))
    x = x.withColumn("_level", F.when(F.col("_end").isNotNull(), level))
    bound = sign * F.col("opposite")
    floor = sign * F.col("fill_t") - grid.min_stop_ticks
    first_bar = F.col("anchor_idx") <= 0
    no_run = F.col("_end").isNull()
    return x.withColumns({
        "sl_t": sign * F.least(F.when(no_run, bound).otherwise(F.col("_level")), floor),
        "sl_bars_back": F.when(no_run, F.lit(0)).otherwise(F.col("anchor_idx") - F.col("_begin")),
        "sl_source": F.when(first_bar, "no_prior_bars")
        .when(no_run, F.when(floor <= bound, "min_floor_applied").otherwise("range_fallback"))
        .when(F.col("_level") > floor, "min_floor_applied").otherwise("cluster"),
    }).drop("_look", "_end", "_begin", "_level")


def price_signals(signals: DataFrame, grid: GridSpec) -> DataFrame:
    """Adds fill price, gap flag, stop, entry-bar attributes and opposite-boundary flags."""
    sign = sign_of(F.col("direction"))
    is_long = F.col("direction") == "long"
    trigger = F.col("boundary") + sign
    at_break = F.col("entry_mode").isin("II", "R-II")
    at_close = F.col("entry_mode").isin("CC", "R-CC")
    x = signals.withColumn("_b", bar_at(F.col("entry_idx"))).withColumns({
        "fill_t": F.when(at_break, sign * F.greatest(sign * trigger, sign * F.col("_b.o")))
        .when(at_close, F.col("_b.c")).otherwise(F.col("boundary")),
        "gap_fill": at_break & (sign * F.col("_b.o") > sign * trigger),
        "fill_at_bar_close": at_close,
        "entry_ts": F.col("_b.ts"),
        "entry_source": F.col("_b.source"),
        "entry_contract": F.col("_b.contract"),
    })
    x = place_stops(x, grid, F.coalesce("breakout_idx", "entry_idx"))

    def reaches(n: Column) -> Column:
        """Any of the first ``n`` in-session bars touches the opposite bound."""
        part = F.slice("bars", F.col("open_idx") + 1, n)
        return F.when(is_long, F.array_min(part["l"]) <= F.col("opposite")).otherwise(
            F.array_max(part["h"]) >= F.col("opposite"))

    return x.withColumns({
        "bars_from_open_to_entry": F.col("entry_idx") - F.col("open_idx"),
        "opp_broken_session": reaches(F.col("last_idx") - F.col("open_idx") + 1),
        "opp_broken_pre_entry": reaches(F.col("entry_idx") - F.col("open_idx") + 1),
        "opp_broken_after_range": F.col("far_idx").isNotNull(),
        "opp_broken_after_range_pre_entry": F.coalesce(
            F.col("far_idx") <= F.col("entry_idx"), F.lit(False)),
    }).drop("_b", "far_idx", "anchor_idx")
