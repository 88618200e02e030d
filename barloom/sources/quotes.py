"""Quote snapshots: column normalisation, validity and month selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import nan_to_null
from barloom.sources.bars import utc_wall

# Accepted quote column names, first present wins; widest plausible spread.
BID_NAMES = ("bid_px_00", "bid_px", "bid_price", "bid")
ASK_NAMES = ("ask_px_00", "ask_px", "ask_price", "ask")
MAX_SPREAD_TICKS = 500


def _first_present(df: DataFrame, names: tuple[str, ...]) -> str:
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of {names} in {df.columns}")


def normalise_quotes(raw: DataFrame) -> DataFrame:
    """Any vendor quote frame as (instrument, ts, bid, ask); unusable prices are dropped."""
    stamp = "ts_event" if "ts_event" in raw.columns else "timestamp"

    def number(name):
        return nan_to_null(F.expr(f"try_cast(`{name}` AS double)"))

    return raw.select(
        "instrument",
        utc_wall(F.col(stamp)).alias("ts"),
        number(_first_present(raw, BID_NAMES)).alias("bid"),
        number(_first_present(raw, ASK_NAMES)).alias("ask"),
    ).dropna()


def write_quotes(quotes: DataFrame, root: str) -> None:
    """Normalised quotes under ``root/quotes/instrument=…/month=…``; raw vendor files live elsewhere."""
    (
        quotes.withColumn("month", F.date_format("ts", "yyyy-MM"))
        .repartition("instrument", "month", F.dayofmonth("ts"))
        .write.mode("append").partitionBy("instrument", "month").parquet(f"{root}/quotes")
    )


def read_quotes(spark: SparkSession, root: str, months: list[str] | None = None) -> DataFrame:
    """All stored quote months of all instruments, or some months, pruned by directory."""
    df = spark.read.parquet(f"{root}/quotes")
    return df.filter(F.col("month").isin(months)) if months else df


def launched_months(months: DataFrame, instruments: DataFrame) -> DataFrame:
    """(instrument, month) pairs with month bounds, without months before the launch."""
    start = F.trunc("month", "MM")
    return (
        instruments.select("instrument", "data_start").join(months)
        .withColumn("month_start", start)
        .withColumn("month_end", F.add_months(start, 1))
        .filter(F.col("month_end") > F.col("data_start"))
        .drop("data_start")
    )


def mark_spread(quotes: DataFrame) -> DataFrame:
    """Spread in ticks and whether the quote is usable (not locked, crossed or absurd)."""
    spread = F.col("ask_t") - F.col("bid_t")
    return quotes.withColumn("spread", spread).withColumn(
        "valid", (spread > 0) & (spread <= MAX_SPREAD_TICKS))


def valid_quotes(quotes: DataFrame) -> DataFrame:
    return mark_spread(quotes).filter("valid").drop("valid")
