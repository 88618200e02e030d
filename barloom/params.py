"""Fixed parameter tables and the grid that every operator takes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Instruments.
# (instrument, tick_size, tick_value_usd, continuous_symbol, sessions, data_start, asset_class)
INSTRUMENTS = (
    ("ES", 0.25, 12.50, "ES.c.0", ("NY", "LDN", "TOK"), "2019-01-01", "equity_index"),
    ("NQ", 0.25, 5.00, "NQ.c.0", ("NY", "LDN", "TOK"), "2019-01-01", "equity_index"),
    ("RTY", 0.10, 5.00, "RTY.c.0", ("NY",), "2019-01-01", "equity_index"),
    ("GC", 0.10, 10.00, "GC.v.0", ("NY", "LDN", "TOK"), "2019-01-01", "metal"),
    ("CL", 0.01, 10.00, "CL.c.0", ("NY", "LDN"), "2019-01-01", "energy"),
    ("ZN", 0.015625, 15.625, "ZN.v.0", ("NY", "LDN"), "2019-01-01", "fixed_income"),
    ("BTC", 5.00, 25.00, "BTC.c.0", ("NY", "LDN", "TOK"), "2019-01-01", "crypto"),
    ("ETH", 0.05, 2.50, "ETH.c.0", ("NY", "LDN", "TOK"), "2021-02-08", "crypto"),
    ("6E", 0.00005, 6.25, "6E.v.0", ("LDN", "NY"), "2019-01-01", "forex"),
    ("6J", 0.0000005, 6.25, "6J.v.0", ("TOK", "LDN", "NY"), "2019-01-01", "forex"),
)

# Sessions (name, time zone, open minute, exit minute), local wall clock.
SESSIONS = (
    ("NY", "America/New_York", 570, 720),
    ("LDN", "Europe/London", 480, 720),
    ("TOK", "Asia/Tokyo", 540, 720),
)

# Opening ranges, closure sizes per range, reward:risk levels.
RANGE_MINUTES = (5, 15, 30)
CLOSURE_TFS = {5: (1, 5), 15: (1, 5, 15), 30: (1, 5, 15, 30)}
RR_LEVELS = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0)

# Round-trip slippage in ticks by (instrument, session), by instrument, and global.
SLIPPAGE_BY_SESSION = (
    ("ES", "NY", 1.00), ("ES", "LDN", 1.00), ("ES", "TOK", 1.00),
    ("NQ", "NY", 2.04), ("NQ", "LDN", 3.14), ("NQ", "TOK", 3.16),
    ("RTY", "NY", 2.00),
    ("CL", "NY", 1.03), ("CL", "LDN", 1.05),
    ("BTC", "NY", 3.16), ("BTC", "LDN", 3.59), ("BTC", "TOK", 4.20),
    ("ETH", "NY", 32.08), ("ETH", "LDN", 34.77), ("ETH", "TOK", 53.14),
    ("GC", "NY", 1.59), ("GC", "LDN", 2.00), ("GC", "TOK", 2.00),
    ("ZN", "NY", 1.00), ("ZN", "LDN", 1.00),
    ("6E", "LDN", 1.00), ("6E", "NY", 1.00),
    ("6J", "TOK", 1.00), ("6J", "LDN", 1.00), ("6J", "NY", 1.00),
)
SLIPPAGE_BY_INSTRUMENT = (
    ("ES", 1.00), ("NQ", 3.16), ("RTY", 2.00), ("GC", 2.00), ("CL", 1.05),
    ("ZN", 1.00), ("6E", 1.00), ("6J", 1.00), ("BTC", 4.20), ("ETH", 53.14),
)
SLIPPAGE_GLOBAL = 1.0
SLIPPAGE_PROVENANCE = (
    ("ES", "measured"), ("NQ", "measured"), ("RTY", "measured"), ("CL", "measured"),
    ("BTC", "measured"), ("ETH", "measured"), ("GC", "provisional"), ("ZN", "provisional"),
    ("6E", "provisional"), ("6J", "provisional"),
)

# Contract sizes (instrument, kind, traded symbol, tick value, round-trip commission).
CONTRACT_SPECS = (
    ("ES", "full", "ES", 12.500, 3.10), ("ES", "micro", "MES", 1.250, 1.40),
    ("CL", "full", "CL", 10.000, 3.10), ("CL", "micro", "MCL", 1.000, 1.40),
    ("NQ", "full", "NQ", 5.000, 3.10), ("NQ", "micro", "MNQ", 0.500, 1.40),
    ("6E", "full", "6E", 6.250, 3.10), ("6E", "micro", "M6E", 0.625, 1.40),
)
DEFAULT_COMMISSION_USD = 3.10

# Contract month letters and the liquid gold months.
MONTH_CODES = (
    ("F", "Jan"), ("G", "Feb"), ("H", "Mar"), ("J", "Apr"), ("K", "May"), ("M", "Jun"),
    ("N", "Jul"), ("Q", "Aug"), ("U", "Sep"), ("V", "Oct"), ("X", "Nov"), ("Z", "Dec"),
)
GOLD_LIQUID_MONTHS = ("G", "J", "M", "Q", "V", "Z")

# Exit reasons that are not trades.
INVALID_REASONS = ("INVALID", "SL_WRONG_SIDE", "DEGENERATE_R", "NO_HOLD_BARS")

# Account and eligibility limits.
MAX_RISK_USD = 900.0
MAX_CONTRACTS = 10
MIN_TP_TICKS = 1.0
MIN_EXECUTABLE_TP_TICKS = 4.0
MIN_EXECUTABLE_SL_TICKS = 8.0
MAX_FRICTION_R = 0.15
MIN_COMPLETENESS = 0.90
MIN_TRADES = 100
MIN_EXECUTABLE_SHARE = 0.80

# Regime windows, resampling and multiplicity.
N_WINDOWS = 10
WINDOW_MONTHS = 6
HOLDOUT_MONTHS = 3
HOLDOUT_START = "2026-02-01"
BOOTSTRAP_DRAWS = 1000
BLOCK_DAYS = 5
NULL_DRAWS = 20000
NULL_ENTRIES_PER_DAY = 3
NULL_SAMPLE_DAYS = 1500
NULL_MIN_DAYS = 250
MASTER_SEED = 20260806

VARIANT = ["instrument", "session", "range_minutes", "entry_mode", "closure_tf", "direction", "rr"]
SETUP = ["instrument", "session", "range_minutes", "entry_mode", "closure_tf", "rr"]
FAMILY = ["instrument", "session", "range_minutes", "entry_mode", "closure_tf", "direction"]


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, (tuple, list)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value)


def inline_table(spark: SparkSession, columns: list[str], rows) -> DataFrame:
    """A small constant table as a local relation, so its size is known to the planner."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


@dataclass(frozen=True)
class GridSpec:
    """Bar width, sessions, ranges and thresholds shared by the event operators."""

    bar_minutes: int = 1
    sessions: tuple = SESSIONS
    range_minutes: tuple = RANGE_MINUTES
    closure_tfs: dict = field(default_factory=lambda: dict(CLOSURE_TFS))
    rr_levels: tuple = RR_LEVELS
    context_minutes: int = 60
    gap_minutes: int = 5
    lookback_bars: int = 50
    min_stop_ticks: int = 4
    atr_cap: float = 2.5
    entry_bar_open: bool = True

    def with_(self, **kw) -> "GridSpec":
        return replace(self, **kw)

    def sessions_column(self) -> Column:
        """The session table as an inline array column, one struct per session."""
        return F.array(*[
            F.struct(
                F.lit(name).alias("session"), F.lit(tz).alias("tz"),
                F.lit(open_min).alias("open_min"), F.lit(exit_min).alias("exit_min"),
            )
            for name, tz, open_min, exit_min in self.sessions
        ])


@dataclass(frozen=True)
class Market:
    """Instrument, cost and contract tables as rows; ``tables`` turns them into DataFrames."""

    instruments: tuple = INSTRUMENTS
    slippage_by_session: tuple = SLIPPAGE_BY_SESSION
    slippage_by_instrument: tuple = SLIPPAGE_BY_INSTRUMENT
    slippage_global: float = SLIPPAGE_GLOBAL
    provenance: tuple = SLIPPAGE_PROVENANCE
    contract_specs: tuple = CONTRACT_SPECS
    default_commission_usd: float = DEFAULT_COMMISSION_USD

    def instrument_table(self, spark: SparkSession) -> DataFrame:
        return inline_table(
            spark,
            ["instrument", "tick_size", "tick_value_usd", "continuous_symbol", "sessions",
             "data_start", "asset_class"],
            self.instruments,
        ).withColumn("data_start", F.to_date("data_start"))

    def traded_sessions(self, spark: SparkSession, grid: GridSpec) -> DataFrame:
        """One row per traded (instrument, session) with its clock."""
        rows = [
            (inst[0], name, tz, open_min, exit_min)
            for inst in self.instruments
            for name, tz, open_min, exit_min in grid.sessions
            if name in inst[4]
        ]
        return inline_table(spark, ["instrument", "session", "tz", "open_min", "exit_min"], rows)

    def slippage_session_table(self, spark: SparkSession) -> DataFrame:
        return inline_table(spark, ["instrument", "session", "slip_session"], self.slippage_by_session)

    def slippage_instrument_table(self, spark: SparkSession) -> DataFrame:
        return inline_table(spark, ["instrument", "slip_instrument"], self.slippage_by_instrument)

    def provenance_table(self, spark: SparkSession) -> DataFrame:
        return inline_table(spark, ["instrument", "provenance"], self.provenance)

    def spec_table(self, spark: SparkSession) -> DataFrame:
        return inline_table(
            spark, ["instrument", "kind", "symbol", "spec_tick_value", "spec_commission"],
            self.contract_specs,
        )
