"""Bar cleaning, vendor merging, resampling and lagged volatility features.

Bar-level scans run chunk by chunk (see ``functions.scans``), so one long instrument is many
tasks. Daily and 4-hour tables hold at most a calendar's worth of rows per instrument, and
their windows may run over the whole instrument.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.functions.scans import scan_lag, scan_last_known
from barloom.operators.calendar import local_wall

# Volatility settings.
ATR_PERIOD = 14
ATR_BAR_MINUTES = 240
ATR_ANCHOR_HOUR = 18
VOL_DAYS = 14
VOL_MIN_DAYS = 7
TRADING_DAYS = 252
EWM_CHUNK = 256
NEW_YORK = "America/New_York"
SOURCE_PRIORITY = (("databento", 2), ("local", 1))


def priority_of(source):
    out = F.lit(0)
    for name, rank in SOURCE_PRIORITY:
        out = F.when(source == name, rank).otherwise(out)
    return out


def dedup_bars(bars: DataFrame) -> DataFrame:
    """One bar per (instrument, ts): best source, then latest ingested, then the greatest row.

    The row itself ends the order, so the result never depends on how the copies met. A max over a struct combines on the map side, so many copies of one bar never meet in a task.
    """
    rest = [c for c in bars.columns if c not in ("instrument", "ts")]
    best = F.max_by(F.struct(*rest), F.struct(
        priority_of(F.col("source")).alias("_priority"), F.col("ingest_seq").alias("_seq"), *rest))
    return bars.groupBy("instrument", "ts").agg(best.alias("_b")).select("instrument", "ts", "_b.*")


def merge_sources(*frames: DataFrame) -> DataFrame:
    """Union of vendor frames, de-duplicated by source priority."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return dedup_bars(out)


def overlap_report(bars: DataFrame) -> DataFrame:
    """Per instrument: timestamps present more than once and their mean close difference."""
    dup = bars.groupBy("instrument", "ts").agg(
        F.count(F.lit(1)).alias("n"), (F.max("c") - F.min("c")).alias("diff")).filter("n > 1")
    return dup.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("overlap_ts"),
        ratio(F.sum("diff"), F.count(F.lit(1))).alias("mean_close_diff"))


def fill_contract(bars: DataFrame) -> DataFrame:
    """Missing contract labels take the last known one in time order."""
    chunked = bars.withColumn("_day", F.col("ts").cast("date"))
    filled = scan_last_known(chunked, ["instrument"], "_day", ["ts"], "contract", "_filled")
    return filled.withColumn("contract", F.col("_filled")).drop("_filled", "_day")


def with_abs_return(bars: DataFrame) -> DataFrame:
    """abs(close / previous close − 1)."""
    chunked = bars.withColumn("_day", F.col("ts").cast("date"))
    out = scan_lag(chunked, ["instrument"], "_day", ["ts"], {"_prev_c": "c"})
    return out.withColumn(
        "abs_return", F.abs(F.col("c") / F.when(F.col("_prev_c") != 0, F.col("_prev_c")) - 1)
    ).drop("_prev_c", "_day")


def source_splices(bars: DataFrame) -> DataFrame:
    """Bars whose source differs from the bar before; the first bar is no splice."""
    chunked = bars.withColumn("_day", F.col("ts").cast("date"))
    out = scan_lag(chunked, ["instrument"], "_day", ["ts"], {"prev_source": "source"})
    return out.filter(F.col("prev_source").isNotNull() & (F.col("source") != F.col("prev_source"))).select(
        "instrument", "ts", "prev_source", "source")


def session_source_days(bars: DataFrame, tz: str = NEW_YORK) -> DataFrame:
    """Per instrument and local date: bars, mean abs return, zero-volume share, modal source."""
    local = F.to_date(local_wall(F.col("ts"), F.lit(tz)))
    by_source = with_abs_return(bars).groupBy("instrument", local.alias("date"), "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("abs_return").alias("ret"),
        F.count("abs_return").alias("n_ret"), F.count_if(F.col("volume") <= 0).alias("zero"))
    return by_source.groupBy("instrument", "date").agg(
        F.sum("n").alias("bar_count"),
        ratio(F.sum("ret"), F.sum("n_ret")).alias("mean_abs_return"),
        ratio(F.sum("zero"), F.sum("n")).alias("zero_volume_fraction"),
        F.min_by("source", F.struct(-F.col("n"), F.col("source"))).alias("source"),
    )


def splice_report(bars: DataFrame, days_each_side: int = 60, tz: str = NEW_YORK) -> DataFrame:
    """Daily diagnostics within ``days_each_side`` of every source splice.

    A splice reaches a bounded band of days, so each one is expanded to its dates and joined
    on equality instead of on a range.
    """
    cut_dates = source_splices(bars).select(
        "instrument", F.col("ts").alias("boundary_ts"),
        F.to_date(local_wall(F.col("ts"), F.lit(tz))).alias("boundary_date"))
    reach = cut_dates.withColumn("distance", F.explode(F.sequence(
        F.lit(-days_each_side), F.lit(days_each_side)))).withColumn(
        "date", F.date_add("boundary_date", F.col("distance")))
    return session_source_days(bars, tz).join(reach, ["instrument", "date"]).select(
        "instrument", "boundary_ts", "date", "bar_count", "mean_abs_return",
        "zero_volume_fraction", "source", "distance")


def four_hour_bin(ts):
    """Start of the local 4-hour bin anchored at 18:00 New York, as a New York wall clock."""
    local = local_wall(ts, F.lit(NEW_YORK))
    anchor = ATR_ANCHOR_HOUR * 60
    since = (F.hour(local) * 60 + F.minute(local) - anchor + 1440) % 1440
    into_bin = since % ATR_BAR_MINUTES
    whole = local - F.make_dt_interval(F.lit(0), F.lit(0), into_bin)
    return F.date_trunc("MINUTE", whole).cast("timestamp_ntz")


def four_hour_bars(bars: DataFrame) -> DataFrame:
    """OHLC per 4-hour bin; empty bins do not exist."""
    return bars.groupBy("instrument", four_hour_bin(F.col("ts")).alias("bin")).agg(
        F.min_by("o", "ts").alias("o"), F.max("h").alias("h"),
        F.min("l").alias("l"), F.max_by("c", "ts").alias("c"))


def true_range(bars: DataFrame, order: str) -> DataFrame:
    """``tr``; a column ``_close``, if there is one, is the close before an instrument's first bar."""
    prev = F.lag("c").over(Window.partitionBy("instrument").orderBy(order))
    if "_close" in bars.columns:
        prev = F.coalesce(prev, F.col("_close"))
    return bars.withColumn("_pc", prev).withColumn(
        "tr", F.when(F.col("_pc").isNotNull(), F.greatest(
            F.col("h") - F.col("l"), F.abs(F.col("h") - F.col("_pc")),
            F.abs(F.col("l") - F.col("_pc"))))).drop("_pc")


def _wilder(bars4h: DataFrame, order: str, period: int, start: DataFrame | None) -> DataFrame:
    """Adds tr, _seen (ranges so far) and _value, the running Wilder average from the first range on.

    Ranges are cut into chunks of EWM_CHUNK. Inside a chunk the average is keep**k times (the value before the chunk plus
    the running sum of tr * keep**-j / period), one window sum. A chunk as a whole is the affine map (factor, offset) of the value
    before it; the maps of the earlier chunks, one row each, give that value. ``start`` has, per instrument, the value, the
    number of ranges and the close that an earlier run ended with.
    """
    keep = F.lit((period - 1) / period)
    w = Window.partitionBy("instrument").orderBy(order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    x = bars4h
    if start is not None:
        x = x.join(start.select("instrument", F.col("value").alias("_from"), F.col("seen").alias("_earlier"), F.col("close").alias("_close")),
                   "instrument", "left")
    else:
        x = x.withColumns({"_from": F.lit(None).cast("double"), "_earlier": F.lit(0).cast("bigint")})
    x = true_range(x, order).withColumn("_here", F.count("tr").over(running)).withColumn(
        "_chunk", F.floor((F.greatest(F.col("_here"), F.lit(1)) - 1) / EWM_CHUNK))
    k = F.greatest(F.col("_here") - F.col("_chunk") * EWM_CHUNK, F.lit(0))
    chunk = Window.partitionBy("instrument", "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_k", k).withColumn("_sum", F.coalesce(F.sum(
        F.col("tr").cast("double") * F.pow(keep, -F.col("_k")) / period).over(chunk), F.lit(0.0)))
    chunks = x.groupBy("instrument", "_chunk").agg(
        F.max_by(F.struct(F.pow(keep, F.col("_k")).alias("factor"), (F.pow(keep, F.col("_k")) * F.col("_sum")).alias("offset")), order).alias("_whole"),
        F.min_by(F.col("tr").cast("double"), F.when(F.col("tr").isNotNull(), F.col(order))).alias("_head"), F.first("_from").alias("_start"))
    chain = Window.partitionBy("instrument").orderBy("_chunk")
    earlier = F.collect_list("_whole").over(chain.rowsBetween(Window.unboundedPreceding, -1))
    first = F.coalesce("_start", F.first("_head").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    chunks = chunks.withColumn("_before", F.aggregate(
        earlier, first, lambda acc, m: acc * m["factor"] + m["offset"])).select("instrument", "_chunk", "_before")
    return x.join(chunks, ["instrument", "_chunk"]).withColumns({
        "_seen": F.col("_here") + F.coalesce("_earlier", F.lit(0)),
        "_value": F.pow(keep, F.col("_k")) * (F.col("_before") + F.col("_sum")),
    }).drop("_here", "_chunk", "_k", "_sum", "_before", "_earlier", "_close")


def wilder_atr(bars4h: DataFrame, order: str = "bin", period: int = ATR_PERIOD, start: DataFrame | None = None) -> DataFrame:
    """Wilder average of the true range, and its value at the previous bin; it goes on from ``start`` if given (see atr_state)."""
    w = Window.partitionBy("instrument").orderBy(order)
    out = _wilder(bars4h, order, period, start)
    out = out.withColumn("atr", F.when(F.col("_seen") >= period, F.col("_value")))
    before = F.lag("atr").over(w)
    if start is not None:
        done = start.select("instrument", F.when(F.col("seen") >= period, F.col("value")).alias("_atr0"))
        out = out.join(done, "instrument", "left")
        before = F.when(F.row_number().over(w) == 1, F.col("_atr0")).otherwise(before)
    return out.withColumn("atr_prev", before).drop("_seen", "_value", "_from", "_atr0")


def atr_state(bars4h: DataFrame, order: str = "bin", period: int = ATR_PERIOD, start: DataFrame | None = None) -> DataFrame:
    """What a later run needs to go on: per instrument the average, the number of ranges and the last close."""
    x = _wilder(bars4h, order, period, start)
    last = F.max_by(F.struct(F.when(F.col("_seen") > 0, F.col("_value")).alias("value"), F.col("_seen").alias("seen"),
                             F.col("c").alias("close")), order)
    return x.groupBy("instrument").agg(last.alias("_s")).select("instrument", "_s.*")


def attach_atr(bars: DataFrame, start: DataFrame | None = None, since: Column | None = None) -> DataFrame:
    """Each bar with the ATR of the last completed 4-hour bin; with ``start``, only bins from ``since`` on are made and go on from it.

    Every bar knows its bin, so the as-of join is an equi-join on (instrument, bin), whose keys hold at most
    a bin's bars each.
    """
    bins = four_hour_bars(bars)
    if since is not None:
        bins = bins.filter(F.col("bin") >= since.cast("timestamp_ntz"))
    atr = wilder_atr(bins, start=start).select("instrument", "bin", F.col("atr_prev").alias("atr_4h"))
    return bars.withColumn("bin", four_hour_bin(F.col("ts"))).join(atr, ["instrument", "bin"], "left").drop("bin")


def daily_features(daily: DataFrame) -> DataFrame:
    """Previous close, range, and 14-day Parkinson and realised volatility up to the day before."""
    w = Window.partitionBy("instrument").orderBy("trading_date")
    frame = w.rowsBetween(-(VOL_DAYS - 1), 0)
    d = daily.withColumn("prev_close", F.lag("c").over(w))
    d = d.withColumn("range_ticks", F.col("h") - F.col("l"))
    d = d.withColumn("_pv", F.pow(F.log(F.col("h") / F.when(F.col("l") > 0, F.col("l"))), 2)
                     / (4 * math.log(2)))
    d = d.withColumn("_lr", F.log(F.col("c") / F.when(F.col("prev_close") > 0, F.col("prev_close"))))
    year = math.sqrt(TRADING_DAYS)
    d = d.withColumn("_pk", F.when(
        F.count("_pv").over(frame) >= VOL_MIN_DAYS, F.sqrt(F.avg("_pv").over(frame)) * year))
    d = d.withColumn("_rv", F.when(
        F.count("_lr").over(frame) >= VOL_MIN_DAYS, F.stddev_samp("_lr").over(frame) * year))
    return (
        d.withColumn("parkinson_vol_14d", F.lag("_pk").over(w))
        .withColumn("realized_vol_14d", F.lag("_rv").over(w))
        .drop("_pv", "_lr", "_pk", "_rv")
    )


def enrich_bars(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Bars with the daily features of their New York date (left join on equality)."""
    feats = daily_features(daily).select(
        "instrument", F.col("trading_date").alias("_d"), "prev_close",
        "parkinson_vol_14d", "realized_vol_14d")
    ny_date = F.to_date(local_wall(F.col("ts"), F.lit(NEW_YORK)))
    return bars.withColumn("_d", ny_date).join(feats, ["instrument", "_d"], "left").drop("_d")


def daily_from_bars(bars: DataFrame) -> DataFrame:
    """Daily bars by New York date, for histories that come without a daily file."""
    return bars.groupBy("instrument", F.to_date(local_wall(F.col("ts"), F.lit(NEW_YORK))).alias(
        "trading_date")).agg(
        F.min_by("o", "ts").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"),
        F.max_by("c", "ts").alias("c"), F.sum("volume").alias("volume"))


def contract_composition(bars: DataFrame) -> DataFrame:
    """Bars per contract with month name and, for gold, whether the month is a liquid one."""
    from barloom.params import GOLD_LIQUID_MONTHS, MONTH_CODES

    letter = F.regexp_extract(F.coalesce("contract", F.lit("")), "([A-Za-z])[^A-Za-z]*$", 1)
    month = F.lit("?")
    for code, name in MONTH_CODES:
        month = F.when(letter == code, name).otherwise(month)
    liquidity = F.when((F.col("instrument") == "GC") & (letter != ""), F.when(
        letter.isin(*GOLD_LIQUID_MONTHS), "LIQUID").otherwise("serial/thin")).otherwise("")
    return bars.groupBy("instrument", "contract").agg(F.count(F.lit(1)).alias("bars")).withColumn(
        "month", month).withColumn("liquidity", liquidity)


def contract_counts(bars: DataFrame) -> DataFrame:
    """Distinct contracts per instrument (a missing label counts as one) and bars per contract."""
    per = bars.groupBy("instrument", "contract").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("instrument").agg(
        F.sum("n").alias("bars"), F.count(F.lit(1)).alias("contracts")).withColumn(
        "bars_per_contract", F.col("bars") / F.col("contracts"))
