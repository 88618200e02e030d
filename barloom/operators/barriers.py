"""First-touch labelling of events against a stop and a ladder of targets.

An event row carries its day's bars, so the held bars are a slice of that array, the touch of
each target is the first matching element, and the excursions are extremes of a shorter slice.
Labelling is therefore a projection: it adds no exchange and no join to the day's stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.events import sign_of
from barloom.params import MIN_TP_TICKS, GridSpec


def validity(events: DataFrame) -> DataFrame:
    """Adds r_ticks, first held bar and the reason an event cannot be held, if any."""
    sign = sign_of(F.col("direction"))
    start = F.col("entry_idx") + F.col("fill_at_bar_close").cast("int")
    wrong = sign * F.col("sl_t") >= sign * F.col("fill_t")
    r = F.abs(F.col("fill_t") - F.col("sl_t"))
    return events.withColumns({
        "r_ticks": r,
        "start_idx": start,
        "invalid_reason": F.when(wrong, "SL_WRONG_SIDE").when(r < 1, "DEGENERATE_R")
        .when(start > F.col("last_idx"), "NO_HOLD_BARS"),
    })


def _signed_hold(start: Column) -> Column:
    """Held bars with prices signed so that up is favourable."""
    held = F.slice("bars", start + 1, F.greatest(F.col("last_idx") - start + 1, F.lit(0)))
    is_long = F.col("direction") == "long"

    def signed(b: Column) -> Column:
        return F.when(is_long, F.struct(
            b["idx"].alias("idx"), b["ts"].alias("ts"), b["o"].alias("o"), b["h"].alias("hi"),
            b["l"].alias("lo"), b["c"].alias("c"))).otherwise(F.struct(
                b["idx"].alias("idx"), b["ts"].alias("ts"), (-b["o"]).alias("o"), (-b["l"]).alias("hi"),
                (-b["h"]).alias("lo"), (-b["c"]).alias("c")))

    return F.transform(held, signed)


def label_barriers(events: DataFrame, grid: GridSpec) -> DataFrame:
    """One row per event and reward:risk level with exit, returns and excursions.

    On one bar the precedence is: open beyond the stop, open beyond the target, stop, target.
    Opens fill at the open, levels at the level, and a target needs one tick of trade-through.
    Events that cannot be held stay, with null outcomes and their reason.
    """
    x = validity(events)
    ok = F.col("invalid_reason").isNull()
    sign = sign_of(F.col("direction"))
    x = x.withColumns({
        "_hold": F.when(ok, _signed_hold(F.col("start_idx"))),
        "_e": sign * F.col("fill_t"),
        "_sl": sign * F.col("sl_t"),
    }).drop("bars")

    def open_counts(b: Column) -> Column:
        return F.lit(True) if grid.entry_bar_open else b["idx"] > F.col("entry_idx")

    def touch(rr: Column) -> Column:
        target = F.col("_e") + rr * F.col("r_ticks")

        def hits(b: Column) -> Column:
            at_open = open_counts(b) & ((b["o"] <= F.col("_sl")) | (b["o"] >= target))
            return at_open | (b["lo"] <= F.col("_sl")) | (b["hi"] >= target + 1)

        return F.struct(rr.alias("rr"), F.get(F.filter("_hold", hits), F.lit(0)).alias("bar"))

    ladder = F.array(*[F.lit(float(r)) for r in grid.rr_levels])
    x = x.withColumn("_t", F.explode(F.transform(ladder, touch))).withColumns({
        "rr": F.col("_t.rr"), "_bar": F.col("_t.bar")}).drop("_t")

    target = F.col("_e") + F.col("rr") * F.col("r_ticks")
    bar_o, bar_hi, bar_lo = F.col("_bar.o"), F.col("_bar.hi"), F.col("_bar.lo")
    x = x.withColumns({
        "exit_idx": F.when(ok, F.coalesce(F.col("_bar.idx"), F.col("last_idx"))),
        "_target": F.when(ok, target),
        "_opens": F.coalesce(open_counts(F.col("_bar")), F.lit(False)),
    })
    x = x.withColumn("_kind", (
        F.when(F.col("_opens") & (bar_o <= F.col("_sl")), "gap_stop")
        .when(F.col("_opens") & (bar_o >= F.col("_target")), "gap_target")
        .when(bar_lo <= F.col("_sl"), "stop")
        .when(bar_hi >= F.col("_target") + 1, "target")
        .otherwise("time")))
    kind = F.col("_kind")
    x = x.withColumns({
        "_until": F.slice("_hold", 1, F.greatest(F.col("exit_idx") - F.col("start_idx") + 1, F.lit(0))),
        "_exit": F.when(kind.isin("gap_stop", "gap_target"), bar_o.cast("double"))
        .when(kind == "stop", F.col("_sl").cast("double"))
        .when(kind == "target", F.col("_target"))
        .otherwise(F.element_at("_hold", -1)["c"].cast("double")),
    })
    r = F.col("r_ticks")
    adverse = F.col("_e") - F.array_min(F.col("_until.lo"))
    favorable = F.array_max(F.col("_until.hi")) - F.col("_e")
    ambiguous = F.coalesce((kind == "stop") & (bar_hi >= F.col("_target") + 1), F.lit(False))
    x = x.withColumns({
        "exit_reason": F.when(~ok, F.col("invalid_reason"))
        .when(kind.isin("gap_stop", "stop"), "SL")
        .when(kind.isin("gap_target", "target"), "TP").otherwise("TIME"),
        "exit_ts": F.when(ok, F.coalesce(F.col("_bar.ts"), F.element_at("_hold", -1)["ts"])),
        "tp_t": sign * F.col("_target"),
        "exit_t": F.when(ok, sign * F.col("_exit")),
        "bars_held": F.when(ok, F.col("exit_idx") - F.col("start_idx") + 1).otherwise(0),
        "same_bar_ambiguous": ambiguous,
        "tp_ticks": F.when(ok, F.col("rr") * r),
        "gross_r": F.when(ok, (F.col("_exit") - F.col("_e")) / r),
        "mae_r": F.when(ok, F.least(F.lit(0), -adverse) / r),
        "mfe_r": F.when(ok, F.greatest(F.lit(0), favorable) / r),
    })
    return x.withColumns({
        "gross_r_optimistic": F.when(ambiguous, F.col("rr")).otherwise(F.col("gross_r")),
        "tp_unfillable": F.coalesce(F.col("tp_ticks") < MIN_TP_TICKS, F.lit(False)),
    }).drop("_hold", "_e", "_sl", "_bar", "_target", "_opens", "_kind", "_until", "_exit",
            "invalid_reason", "start_idx")


def with_returns(outcomes: DataFrame, grid: GridSpec) -> DataFrame:
    """Net returns, dollars and the target-to-ATR flag, once costs and atr_4h are present."""
    ratio = F.when(F.col("atr_4h") > 0, F.col("tp_ticks") / F.col("atr_4h"))
    dollars = F.col("r_ticks") * F.col("tick_value_usd")
    out = outcomes.withColumn("cost_r", F.when(F.col("gross_r").isNotNull(), F.col("cost_r")))
    out = out.withColumn("net_r", F.col("gross_r") - F.col("cost_r"))
    return out.withColumns({
        "gross_usd": F.col("gross_r") * dollars,
        "net_usd": F.col("net_r") * dollars,
        "tp_to_atr_ratio": ratio,
        "atr_exceeds_cap": F.coalesce(ratio > grid.atr_cap, F.lit(False)),
    })
