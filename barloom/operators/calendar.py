"""Local clocks, session membership, regime windows and calendar labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rng import draw, stable_seed
from barloom.params import HOLDOUT_MONTHS, N_WINDOWS, WINDOW_MONTHS, GridSpec


def local_wall(ts: Column, tz: Column) -> Column:
    """UTC wall clock to local wall clock; the zone may differ per row."""
    return F.convert_timezone(F.lit("UTC"), tz, ts)


def minute_of_day(local: Column) -> Column:
    return F.hour(local) * 60 + F.minute(local)


def sessionize(df: DataFrame, grid: GridSpec, pairs: DataFrame | None = None,
               context: bool = True) -> DataFrame:
    """Rows of ``df`` in each session they fall into, with local date and minute.

    ``pairs`` limits instruments to their traded sessions; without it every instrument is
    matched with every session. With ``context`` the minutes before the open are kept too.
    """
    if pairs is None:
        out = df.withColumn("_s", F.explode(grid.sessions_column())).select("*", "_s.*").drop("_s")
    else:
        out = df.join(pairs, "instrument")
    lead = grid.context_minutes if context else 0
    local = local_wall(F.col("ts"), F.col("tz"))
    return (
        out.withColumn("wall", minute_of_day(local))
        .withColumn("local_date", F.to_date(local))
        .filter((F.col("wall") >= F.greatest(F.lit(0), F.col("open_min") - lead))
                & (F.col("wall") < F.col("exit_min")))
        .drop("tz")
    )


def minute_since_open() -> Column:
    return F.col("wall") - F.col("open_min")


def regime_windows(span: DataFrame, seed: int = 42, n_windows: int = N_WINDOWS,
                   months: int = WINDOW_MONTHS, holdout_months: int = HOLDOUT_MONTHS) -> DataFrame:
    """Disjoint ``months``-long windows per instrument, spread over its history.

    ``span`` has one row per instrument: first_date, last_date. The last ``holdout_months``
    are left out. Spare months fall evenly into the gaps around the windows; the remainder
    goes to the gaps with the smallest hash.
    """
    last = F.add_months("last_date", -holdout_months)
    first = F.when(F.dayofmonth("first_date") == 1, F.col("first_date")).otherwise(
        F.add_months(F.trunc("first_date", "MM"), 1))
    eligible = F.greatest(F.lit(0), (F.year(last) - F.year("first_month")) * 12
                          + F.month(last) - F.month("first_month") + 1)
    base = (
        span.withColumn("first_month", first)
        .withColumn("n_months", eligible)
        .withColumn("n", F.least(F.lit(n_windows), F.floor(F.col("n_months") / months)).cast("int"))
        .filter("n > 0")
        .withColumn("spare", (F.col("n_months") - F.col("n") * months).cast("int"))
        .withColumn("gap", F.explode(F.sequence(F.lit(0), F.col("n"))))
    )
    part = Window.partitionBy("instrument")
    gap_seed = stable_seed(F.lit("regime"), F.lit(seed), master=seed)
    base = base.withColumn("gap_rank", F.row_number().over(
        part.orderBy(draw(gap_seed, F.col("gap")), "gap")))
    per_gap = F.floor(F.col("spare") / (F.col("n") + 1))
    extra = F.when(F.col("gap_rank") <= F.col("spare") % (F.col("n") + 1), 1).otherwise(0)
    base = base.withColumn("gap_months", (per_gap + extra).cast("int"))
    before = F.sum("gap_months").over(part.orderBy("gap").rowsBetween(Window.unboundedPreceding, 0))
    start = F.add_months("first_month", (before + F.col("gap") * months).cast("int"))
    return (
        base.withColumn("window_start", start)
        .filter(F.col("gap") < F.col("n"))
        .select(
            "instrument", F.col("gap").alias("regime_window"), "window_start",
            F.date_sub(F.add_months("window_start", months), 1).alias("window_end"),
        )
    )


def bar_span(bars: DataFrame) -> DataFrame:
    """First and last UTC date per instrument."""
    return bars.groupBy("instrument").agg(
        F.to_date(F.min("ts")).alias("first_date"), F.to_date(F.max("ts")).alias("last_date"))


def in_windows(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Bars inside the inclusive date windows, labelled.

    A window is expanded to its months, so bars and windows meet on (instrument, month) and the bars of one
    instrument are as many keys as it has months.
    """
    w = windows.select(
        F.col("instrument"), "regime_window",
        F.col("window_start").cast("timestamp_ntz").alias("_from"),
        F.date_add("window_end", 1).cast("timestamp_ntz").alias("_to"),
        F.explode(F.sequence(F.trunc("window_start", "MM"), F.trunc("window_end", "MM"), F.expr("interval 1 month"))).alias("_month"))
    return bars.withColumn("_month", F.trunc("ts", "MM")).join(w, ["instrument", "_month"]).filter(
        (F.col("ts") >= F.col("_from")) & (F.col("ts") < F.col("_to"))).drop("_from", "_to", "_month")


def holdout(bars: DataFrame, start: str) -> DataFrame:
    return bars.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))


def with_labels(df: DataFrame, date: str = "date") -> DataFrame:
    """Day name, month start and year of a date column."""
    return (
        df.withColumn("day_of_week", F.date_format(date, "EEEE"))
        .withColumn("month", F.trunc(date, "MM"))
        .withColumn("year", F.year(date))
    )


def span_and_density(bars: DataFrame) -> DataFrame:
    """Bars, first and last date, span in days, bars per calendar day."""
    return bars.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("bars"),
        F.to_date(F.min("ts")).alias("first_date"), F.to_date(F.max("ts")).alias("last_date"),
    ).withColumn("span_days", F.datediff("last_date", "first_date")).withColumn(
        "bars_per_day", F.col("bars") / F.greatest(F.col("span_days"), F.lit(1)))


def bars_by_year_hour(bars: DataFrame) -> DataFrame:
    return bars.groupBy("instrument", F.year("ts").alias("year"), F.hour("ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("bars"))
