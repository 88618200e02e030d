"""Bar, daily, quote and outcome views over general event / order tables.

Any table with a key, a time and a value becomes bars; these builders define the views the
registered queries run on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.costs import with_costs
from barloom.operators.sizing import contracts_for
from barloom.params import INVALID_REASONS, RR_LEVELS, GridSpec, Market

EVENT_GRID = GridSpec(
    bar_minutes=60,
    sessions=(
        ("NY", "America/New_York", 540, 1260),
        ("LDN", "Europe/London", 480, 1200),
        ("TOK", "Asia/Tokyo", 540, 1260),
    ),
    range_minutes=(60, 120, 240),
    closure_tfs={60: (60,), 120: (60, 120), 240: (60, 120, 240)},
    context_minutes=180,
    gap_minutes=300,
)

EVENT_MARKET = Market(
    instruments=tuple(
        (name, 0.01, tick_value, f"{name}.{roll}.0", ("NY", "LDN", "TOK"), "2024-01-01", group)
        for name, tick_value, roll, group in (
            ("click", 0.125, "c", "engagement"), ("view", 0.05, "v", "engagement"),
            ("error", 0.1, "c", "ops"), ("purchase", 0.0625, "v", "revenue"),
            ("signup", 0.075, "n", "revenue"),
        )
    ),
    slippage_by_session=(("click", "NY", 2.04), ("click", "LDN", 3.14), ("error", "TOK", 1.05)),
    slippage_by_instrument=(("click", 3.16), ("view", 2.0), ("error", 1.05)),
    contract_specs=(
        ("click", "full", "CK", 0.125, 3.10), ("click", "micro", "MCK", 0.0125, 1.40),
        ("error", "full", "ER", 0.1, 3.10), ("error", "micro", "MER", 0.01, 1.40),
    ),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_bars(spark: SparkSession, sf_dir: str, bar_minutes: int = 60) -> DataFrame:
    """Bars of ``events.value`` per event type; partial aggregation keeps hot types cheap."""
    ev = _table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instrument"),
        F.col("ts").cast("timestamp_ntz").alias("ev_ts"),
        "event_id",
        F.round(F.col("value") * 100, 0).cast("bigint").alias("v"),
    )
    slot = F.col("ev_ts").cast("date").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0),
        F.floor((F.hour("ev_ts") * 60 + F.minute("ev_ts")) / bar_minutes).cast("int") * bar_minutes)
    # One decimal order key per event instead of a struct keeps the aggregate hash-based.
    minute = (F.hour("ev_ts") * 60 + F.minute("ev_ts")).cast("bigint")
    micros = minute * 60000000 + (F.extract(F.lit("SECOND"), F.col("ev_ts")) * 1000000).cast("bigint")
    order = micros.cast("decimal(12,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + F.col("event_id").cast("decimal(19,0)")
    bars = ev.groupBy("instrument", slot.alias("ts")).agg(
        F.min_by("v", order).alias("o"), F.max("v").alias("h"),
        F.min("v").alias("l"), F.max_by("v", order).alias("c"),
        F.count(F.lit(1)).alias("volume"), F.min("event_id").alias("ingest_seq"),
    )
    letter = F.substring(F.lit("FGHJKMNQUVXZ"), F.weekofyear("ts") % 12 + 1, F.lit(1))
    return bars.select(
        "instrument", "ts", "o", "h", "l", "c", "volume",
        F.concat(F.upper(F.substring("instrument", 1, 2)), letter, F.lit("4")).alias("contract"),
        F.when(F.hour("ts") % 2 == 0, "local").otherwise("databento").alias("source"),
        "ingest_seq",
    )


def shipment_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of unit price (cents) per return flag over ship dates."""
    li = _table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("instrument"),
        F.to_date(F.col("l_shipdate").cast("timestamp_ntz")).alias("trading_date"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100, 0).cast("bigint").alias("p"),
        F.col("l_quantity").cast("bigint").alias("q"),
        "l_linestatus", "l_orderkey", "l_linenumber",
    )
    order = F.col("l_orderkey") * 1000 + F.col("l_linenumber")
    n_o = F.count_if(F.col("l_linestatus") == "O")
    n_f = F.count_if(F.col("l_linestatus") == "F")
    return li.groupBy("instrument", "trading_date").agg(
        F.min_by("p", order).alias("o"), F.max("p").alias("h"),
        F.min("p").alias("l"), F.max_by("p", order).alias("c"),
        F.sum("q").alias("volume"),
        F.when(n_o > n_f, "O").otherwise("F").alias("source"),
    )


def event_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with ask = bid + k mod 7; k = 0 gives the locked books that must be rejected."""
    bid = F.round(F.col("value") * 100, 0).cast("bigint")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return _table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instrument"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        bid.alias("bid_t"), (bid + k % 7).alias("ask_t"),
    )


ORDER_MARKET = Market()


def order_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal-shaped table from ``orders``: variants, dates, returns and quality flags."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    cents = F.round(F.col("o_totalprice") * 100, 0).cast("bigint")
    rr = F.element_at(F.array(*[F.lit(r) for r in RR_LEVELS]), (key % 6 + 1).cast("int"))
    code = F.floor(key / 12) % 10
    gross = ((cents % 401) - 200) / F.lit(128.0)
    base = _table(spark, sf_dir, "orders").select(
        key.alias("signal_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "ES")
        .when(F.col("o_orderpriority") == "2-HIGH", "NQ")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "CL")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "6E")
        .otherwise("GC").alias("instrument"),
        F.when(cust % 2 == 0, "NY").otherwise("LDN").alias("session"),
        F.lit(15).alias("range_minutes"),
        F.when(F.col("o_orderstatus") == "F", "II").when(F.col("o_orderstatus") == "O", "CC")
        .otherwise("TI").alias("entry_mode"),
        F.when(F.col("o_orderstatus") == "O", 5).otherwise(1).alias("closure_tf"),
        F.when(F.floor(key / 6) % 2 == 0, "long").otherwise("short").alias("direction"),
        rr.alias("rr"),
        F.to_date(F.col("o_orderdate").cast("timestamp_ntz")).alias("date"),
        (key % 120).alias("bars_from_open_to_entry"),
        ((cust * 7 + key) % 60 + 1).alias("r_ticks"),
        F.when(code == 0, "SL_WRONG_SIDE").when(code == 1, "DEGENERATE_R")
        .when(gross >= rr, "TP").when(gross <= -1.0, "SL").otherwise("TIME").alias("exit_reason"),
        gross.alias("raw_gross"),
        (-(key % 100) / F.lit(128.0)).alias("mae_r"),
        ((cust % 200) / F.lit(128.0)).alias("mfe_r"),
        (key % 17 == 0).alias("same_bar_ambiguous"),
        (key % 13 == 0).alias("atr_exceeds_cap"),
        (key % 29 == 0).alias("contract_changed_in_session"),
        (key % 31 == 0).alias("contract_changed_since_prev_session"),
        (1.0 - (key % 20) / F.lit(100.0)).alias("session_bar_completeness"),
        ((key % 4) / F.lit(4.0)).alias("pct_bars_from_local"),
        (F.year("o_orderdate") - 1995).cast("int").alias("regime_window"),
        (cust % 40 + 10).alias("range_width_ticks"),
        ((cust % 50) / F.lit(100.0)).alias("realized_vol_14d"),
    )
    base = base.withColumn("tp_ticks", F.col("rr") * F.col("r_ticks"))
    base = base.withColumn("tp_unfillable", F.col("tp_ticks") < 1.0)
    base = with_costs(base, ORDER_MARKET)
    valid = ~F.col("exit_reason").isin(*INVALID_REASONS)
    return (
        base.withColumn("gross_r", F.when(valid, F.col("raw_gross")))
        .withColumn("net_r", F.col("gross_r") - F.col("cost_r"))
        .withColumn("gross_r_optimistic",
                    F.when(F.col("same_bar_ambiguous") & valid, F.col("rr")).otherwise(F.col("gross_r")))
        .withColumn("contracts", contracts_for(F.col("r_ticks"), F.col("tick_value_usd")))
        .drop("raw_gross")
    )
