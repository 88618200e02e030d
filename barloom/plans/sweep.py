"""The whole run: bars to journal, summaries, controls and artefacts.

Stages that feed several consumers are written to tables and read back, so each is computed
once and a lost executor costs one stage at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from barloom.operators.bars import attach_atr, enrich_bars
from barloom.operators.calendar import bar_span, in_windows, regime_windows
from barloom.operators.eligibility import assert_unique_trades, mark_eligibility
from barloom.operators.events import build_days
from barloom.operators.journal import build_journal
from barloom.operators.metrics import regime_summary, variant_summary
from barloom.operators.resample import bootstrap_ci
from barloom.params import BOOTSTRAP_DRAWS, FAMILY, VARIANT, GridSpec, Market
from barloom.plans.inference import NullSpec, control_pools, enrich_summary
from barloom.plans.load import load_bars
from barloom.sources.sinks import (
    run_manifest, write_control_artifacts, write_csv, write_journal, write_table,
)


@dataclass(frozen=True)
class SweepPaths:
    root: str

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"


def days_and_journal(bars: DataFrame, daily: DataFrame, grid: GridSpec, market: Market,
                     paths: SweepPaths) -> tuple[DataFrame, DataFrame]:
    """Enriched, windowed bars as day rows and the journal, both as tables."""
    spark = bars.sparkSession
    enriched = enrich_bars(attach_atr(bars), daily)
    windows = regime_windows(bar_span(bars))
    write_table(windows, paths.at("windows"))
    windows = spark.read.parquet(paths.at("windows"))
    pairs = market.traded_sessions(spark, grid)
    write_table(build_days(in_windows(enriched, windows), grid, pairs), paths.at("days"))
    days = spark.read.parquet(paths.at("days"))
    write_journal(build_journal(days, grid, market, windows), paths.at("journal"))
    return days, spark.read.parquet(paths.at("journal"))


def summarise(journal: DataFrame, paths: SweepPaths, draws: int = BOOTSTRAP_DRAWS) -> DataFrame:
    """Summary and per-window summary, both with bootstrap intervals, from a stored journal."""
    assert_unique_trades(journal, VARIANT)
    marked = mark_eligibility(journal, strict=True)
    ci = bootstrap_ci(marked.filter("eligible"), VARIANT, draws)
    write_table(variant_summary(marked).join(ci, VARIANT, "left"), paths.at("summary"))
    by_window = [*VARIANT, "regime_window"]
    window_ci = bootstrap_ci(marked.filter("eligible"), by_window, draws)
    write_table(regime_summary(marked).join(window_ci, by_window, "left"), paths.at("regime_summary"))
    return journal.sparkSession.read.parquet(paths.at("summary"))


def calibrate(journal: DataFrame, days: DataFrame, summary: DataFrame, grid: GridSpec, market: Market,
              spec: NullSpec, paths: SweepPaths) -> DataFrame:
    """Controls, p-values and multiplicity; writes the control artefacts."""
    spark: SparkSession = journal.sparkSession
    pools = control_pools(mark_eligibility(journal, strict=True), days, grid, market, spec)
    for name in ("broad", "fired", "designs"):
        write_table(pools[name], paths.at(f"control_{name}"))
    broad, fired, designs = (spark.read.parquet(paths.at(f"control_{n}")) for n in ("broad", "fired", "designs"))
    enriched, null_t = enrich_summary(summary, broad, fired, spec, designs=designs)
    write_table(enriched, paths.at("summary_null"))
    enriched = spark.read.parquet(paths.at("summary_null"))
    write_control_artifacts(
        paths.at("null"), null_t=null_t, variants=enriched.select(*VARIANT),
        pvalues=enriched.select(*VARIANT, "null_p_broad", "null_p_matched", "p_adj_maxT", "q_fdr",
                                "maxT_hurdle_95", "breadth_pass", "survivor"),
        provenance=enriched.select(*FAMILY, "null_design", "null_days_requested", "null_days_used", "null_days_exhausted",
                                   "null_day_sampling", "null_seed", "null_matched_days_used", "null_pool_trades", "null_effective_n",
                                   "null_mean_jackknife_se", "null_unreliable"),
        manifest=run_manifest(spark, spec, spec.seed, spec.draws))
    return enriched


def sweep_from_store(spark: SparkSession, store: str, daily: DataFrame, grid: GridSpec, market: Market, root: str,
                     spec: NullSpec = NullSpec(), ci_draws: int = BOOTSTRAP_DRAWS, skip_corrupt: bool = False) -> DataFrame:
    """run_sweep from the bar store: the merged bars are stored as a stage of their own."""
    paths = SweepPaths(root)
    write_table(load_bars(spark, store, market.instrument_table(spark), skip_corrupt), paths.at("bars"))
    return run_sweep(spark.read.parquet(paths.at("bars")), daily, grid, market, root, spec, ci_draws)


def run_sweep(bars: DataFrame, daily: DataFrame, grid: GridSpec, market: Market, root: str,
              spec: NullSpec = NullSpec(), ci_draws: int = BOOTSTRAP_DRAWS) -> DataFrame:
    """Bars and daily bars in, calibrated summary out; every stage is stored under ``root``."""
    paths = SweepPaths(root)
    days, journal = days_and_journal(bars, daily, grid, market, paths)
    summary = summarise(journal, paths, ci_draws)
    enriched = calibrate(journal, days, summary, grid, market, spec, paths)
    write_csv(enriched, paths.at("summary_csv"))
    return enriched
