"""Stored bars to the clean bar table: what a sweep starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.operators.bars import dedup_bars, fill_contract
from barloom.sources.bars import only_configured_rolls, read_bars, scan_raw_bars


def clean_bars(raw: DataFrame, instruments: DataFrame, default_source: str = "unknown") -> DataFrame:
    """Raw rows of all vendors as one bar per (instrument, ts), contracts filled in.

    Bars without a price are dropped before the vendors are merged, so they hide no other vendor's bar.
    """
    bars = read_bars(raw, instruments, default_source)
    return fill_contract(dedup_bars(bars.dropna(subset=["ts", "o", "h", "l", "c"])))


def load_bars(spark: SparkSession, root: str, instruments: DataFrame, skip_corrupt: bool = False) -> DataFrame:
    """Scan the store, keep the configured rolls, read, merge by vendor priority, fill contracts."""
    raw = only_configured_rolls(scan_raw_bars(spark, root, skip_corrupt), instruments)
    return clean_bars(raw, instruments)
