"""Bar and daily-bar readers, and the storage layout they expect.

Layout: ``root/instrument=ES/roll=v/vendor=db/year=2024/*.parquet``. Roll and vendor are
partition columns, so a changed roll rule can never pick up files of the old one, and
instrument / year predicates prune directories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import nan_to_null, to_ticks

RAW_BAR_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("_contract", T.StringType()),
    T.StructField("_source", T.StringType()),
    T.StructField("ingest_seq", T.LongType()),
    T.StructField("instrument", T.StringType()),
    T.StructField("roll", T.StringType()),
    T.StructField("vendor", T.StringType()),
    T.StructField("year", T.IntegerType()),
])


def utc_wall(c: Column) -> Column:
    """An instant as a zone-less UTC wall clock, whatever the session time zone is.

    The instant's microseconds are added to the epoch, so no local wall clock, with its repeated hour, is
    passed on the way. A zone-less timestamp is already one and stays as it is.
    """
    seconds = (F.unix_micros(c.cast("timestamp")).cast("decimal(24,0)") / 1000000).cast("decimal(18,6)")
    shifted = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return F.when(F.typeof(c) == "timestamp_ntz", c.cast("timestamp_ntz")).otherwise(shifted)


def roll_tag(continuous_symbol: Column) -> Column:
    """Roll rule letter of ``SYM.v.0``; 'c' when the symbol has no valid letter."""
    part = F.get(F.split(continuous_symbol, r"\."), F.lit(1))
    return F.when(part.isin("c", "v", "n"), part).otherwise(F.lit("c"))


def scan_raw_bars(spark: SparkSession, root: str, skip_corrupt: bool = False) -> DataFrame:
    """Partitioned bar scan. An unreadable file fails the scan, unless skip_corrupt; see skipped_files."""
    return (
        spark.read.schema(RAW_BAR_SCHEMA)
        .option("ignoreCorruptFiles", str(skip_corrupt).lower())
        .parquet(root)
    )


def skipped_files(spark: SparkSession, root: str) -> DataFrame:
    """The Parquet files (path) below ``root`` that give no rows to a scan that skips unreadable ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", "*.parquet").load(root).select("path")
    read = scan_raw_bars(spark, root, skip_corrupt=True).select(F.col("_metadata.file_path").alias("path")).distinct()
    return files.join(read, "path", "left_anti")


def only_configured_rolls(raw: DataFrame, instruments: DataFrame) -> DataFrame:
    """Keep the files whose roll tag is the one the instrument table asks for."""
    wanted = instruments.select("instrument", roll_tag(F.col("continuous_symbol")).alias("roll"))
    return raw.join(wanted, ["instrument", "roll"], "left_semi")


def _known(raw: DataFrame, names: list[str], default: Column) -> Column:
    """The first non-null of the columns ``raw`` has, else the default."""
    return F.coalesce(*[F.col(n) for n in names if n in raw.columns], default)


def read_bars(raw: DataFrame, instruments: DataFrame, default_source: str = "unknown") -> DataFrame:
    """Raw OHLCV rows as the bar table: UTC wall clock, integer ticks, NaN as null.

    A bar's source is its own ``_source``, else the vendor it is stored under. Rows of instruments that the table
    does not list are left out; ``unlisted_instruments`` counts them.
    """
    tick = F.col("tick_size")
    return raw.join(instruments.select("instrument", "tick_size"), "instrument").select(
        "instrument",
        utc_wall(F.col("timestamp")).alias("ts"),
        *[to_ticks(nan_to_null(F.col(c)), tick).alias(c[0]) for c in ("open", "high", "low", "close")],
        F.col("volume").cast("bigint").alias("volume"),
        _known(raw, ["_contract"], F.lit(None).cast("string")).alias("contract"),
        _known(raw, ["_source", "vendor"], F.lit(default_source)).alias("source"),
        _known(raw, ["ingest_seq"], F.lit(0).cast("bigint")).alias("ingest_seq"),
    )


def unlisted_instruments(raw: DataFrame, instruments: DataFrame) -> DataFrame:
    """Rows of each instrument that ``read_bars`` and ``read_daily`` leave out."""
    return raw.join(instruments.select("instrument"), "instrument", "left_anti").groupBy("instrument").agg(
        F.count(F.lit(1)).alias("rows"))


def read_daily(raw: DataFrame, instruments: DataFrame) -> DataFrame:
    """Daily bars keyed by an explicit trading date (New York date of the stamp when absent)."""
    if "trading_date" in raw.columns:
        date = F.col("trading_date").cast("date")
    else:
        date = F.to_date(F.convert_timezone(
            F.lit("UTC"), F.lit("America/New_York"), utc_wall(F.col("timestamp"))))
    tick = F.col("tick_size")
    return raw.join(instruments.select("instrument", "tick_size"), "instrument").select(
        "instrument", date.alias("trading_date"),
        *[to_ticks(nan_to_null(F.col(c)), tick).alias(c[0]) for c in ("open", "high", "low", "close")],
        F.col("volume").cast("bigint").alias("volume"),
    )


def write_bars(bars: DataFrame, instruments: DataFrame, root: str, vendor: str) -> None:
    """Store bars under their roll and vendor so that readers prune by directory.

    Only the (instrument, roll, vendor, year) folders that ``bars`` has rows for are replaced.
    """
    tags = instruments.select("instrument", roll_tag(F.col("continuous_symbol")).alias("roll"))
    (
        bars.join(tags, "instrument")
        .withColumn("vendor", F.lit(vendor))
        .withColumn("year", F.year("ts"))
        .repartition("instrument", "year", F.month("ts"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("instrument", "roll", "vendor", "year").parquet(root)
    )
