"""Builders for small bar tables and day rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR = "instrument string, ts timestamp_ntz, o bigint, h bigint, l bigint, c bigint, volume bigint, " \
      "contract string, source string, ingest_seq bigint"
OPEN_UTC = dt.datetime(2024, 1, 10, 14, 30)  # 09:30 New York in winter


def bars(spark, rows, day=OPEN_UTC, instrument="ES", contract="ESH4", source="databento", first_minute=0):
    """One-minute bars from (o, h, l, c) in ticks, starting at the New York open."""
    out = [(instrument, day + dt.timedelta(minutes=first_minute + i), *r, 1, contract, source, i)
           for i, r in enumerate(rows)]
    return spark.createDataFrame(out, BAR)


RANGE5 = [(21580, 21600, 21520, 21560)] * 5  # range 5380.00 to 5400.00 in quarter ticks

DAY_BAR = T.ArrayType(T.StructType([
    T.StructField("idx", T.IntegerType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("wall", T.IntegerType()),
    *[T.StructField(c, T.LongType()) for c in "ohlc"],
    T.StructField("source", T.StringType()), T.StructField("contract", T.StringType())]))

EVENT = T.StructType([
    T.StructField("event", T.IntegerType()), T.StructField("direction", T.StringType()),
    T.StructField("entry_idx", T.IntegerType()), T.StructField("last_idx", T.IntegerType()),
    T.StructField("fill_t", T.LongType()), T.StructField("sl_t", T.LongType()),
    T.StructField("fill_at_bar_close", T.BooleanType()), T.StructField("opposite", T.LongType()),
    T.StructField("bars", DAY_BAR)])


def event(no, direction, entry_idx, fill, stop, ohlc, at_close=False, opposite=0):
    day = [(i, OPEN_UTC + dt.timedelta(minutes=i), 570 + i, *b, "databento", "X") for i, b in enumerate(ohlc)]
    return (no, direction, entry_idx, len(ohlc) - 1, fill, stop, at_close, opposite, day)


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(1 for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


__all__ = ["bars", "event", "events", "exchanges", "rows", "RANGE5", "F"]
