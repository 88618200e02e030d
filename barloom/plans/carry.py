"""A run over a later stretch of bars that goes on from a stored earlier run.

The earlier run leaves a small state: per instrument the running volatility average and the last daily bars, per pair the
last contract, per instrument the last contract label, and the bars of the last two days, from which the days and bins that the cut
goes through are made whole. Every table but the bars has at most a few rows per instrument, and the bars are bounded by the clock, so the
later run reads its own stretch only, however long the history is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.bars import (
    NEW_YORK, VOL_DAYS, atr_state, attach_atr, daily_from_bars, enrich_bars, fill_contract, four_hour_bars,
)
from barloom.operators.calendar import local_wall
from barloom.operators.events import build_days
from barloom.operators.session_days import contract_ends
from barloom.params import GridSpec

TAIL_DAYS = 2
STATE = ("atr", "daily", "contracts", "labels", "tail")


def _tail_start(cut: str):
    return F.date_sub(F.lit(cut).cast("date"), TAIL_DAYS)


def _date_of(ts):
    return F.to_date(local_wall(ts, F.lit(NEW_YORK)))


def run_state(bars: DataFrame, cut: str, grid: GridSpec, pairs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The state of a run over ``bars`` (clean, before UTC midnight of ``cut``), as tables."""
    bars = bars.filter(F.col("ts") < F.lit(cut).cast("timestamp_ntz"))
    start = _tail_start(cut)
    bins = four_hour_bars(bars).filter(F.col("bin") < start.cast("timestamp_ntz"))
    daily = daily_from_bars(bars).filter(F.col("trading_date") < start)
    recent = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("trading_date", "o", "h", "l", "c", "volume")))), 1, VOL_DAYS + 2)
    last = F.max_by("contract", F.when(F.col("contract").isNotNull(), F.col("ts")))
    ends = contract_ends(bars, grid, pairs).filter(F.col("local_date") < F.lit(cut).cast("date"))
    return {
        "atr": atr_state(bins),
        "daily": daily.groupBy("instrument").agg(recent.alias("_d")).select("instrument", F.inline("_d")),
        "contracts": ends.groupBy("instrument", "session").agg(F.max_by("last_contract", F.when(
            F.col("last_contract").isNotNull(), F.col("local_date"))).alias("last_contract")),
        "labels": bars.filter(_date_of(F.col("ts")) < start).groupBy("instrument").agg(last.alias("_label")),
        "tail": bars.filter(_date_of(F.col("ts")) >= start),
    }


def save_state(state: dict[str, DataFrame], root: str) -> None:
    for name in STATE:
        state[name].write.mode("overwrite").parquet(f"{root}/{name}")


def load_state(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root}/{name}") for name in STATE}


def later_days(bars: DataFrame, state: dict[str, DataFrame], cut: str, grid: GridSpec, pairs: DataFrame | None = None) -> DataFrame:
    """Day rows from local date ``cut`` on, with full context: those of a run over all bars, made from the later ones and the state."""
    columns = state["tail"].columns
    both = state["tail"].unionByName(bars.filter(F.col("ts") >= F.lit(cut).cast("timestamp_ntz")).select(*columns))
    both = fill_contract(both).join(state["labels"], "instrument", "left").withColumn(
        "contract", F.coalesce("contract", "_label")).select(*columns)
    whole = daily_from_bars(both).filter(F.col("trading_date") >= _tail_start(cut))
    daily = state["daily"].unionByName(whole.select(*state["daily"].columns))
    rich = enrich_bars(attach_atr(both, state["atr"], _tail_start(cut)), daily)
    return build_days(rich, grid, pairs, cut, state["contracts"])
