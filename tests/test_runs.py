"""Sources and sinks, the stored sweep, and the registered queries."""

import duckdb  # noqa: F401
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from barloom.catalog import QUERIES
from barloom.operators.bars import daily_from_bars
from barloom.operators.eligibility import mark_eligibility
from barloom.operators.metrics import variant_summary
from barloom.params import VARIANT, GridSpec, Market
from barloom.plans.inference import NullSpec
from barloom.plans.load import clean_bars, load_bars
from barloom.plans.report import null_section
from barloom.plans.sweep import SweepPaths, run_sweep, summarise
from barloom.sources import sinks
from barloom.sources.bars import (
    only_configured_rolls, read_bars, read_daily, roll_tag, scan_raw_bars, skipped_files, unlisted_instruments, utc_wall,
    write_bars,
)
from barloom.sources.quotes import normalise_quotes, read_quotes, write_quotes
from barloom.sources.views import EVENT_GRID, EVENT_MARKET, event_bars
from tests.helpers import RANGE5, bars, rows


def test_roll_tag(spark):
    df = spark.createDataFrame([("GC.v.0",), ("ES.c.0",), ("XX",), ("A.z.0",)], "s string")
    assert [r["t"] for r in rows(df.withColumn("t", roll_tag(F.col("s"))), "s")] == ["c", "c", "v", "c"]


def test_bar_store_round_trip_and_roll_filter(spark, tmp_path):
    inst = Market().instrument_table(spark)
    raw = bars(spark, RANGE5).select(
        "instrument", F.col("ts").cast("timestamp").alias("timestamp"),
        *[(F.col(c) * 0.25).alias(n) for c, n in zip("ohlc", ("open", "high", "low", "close"))],
        "volume", F.col("contract").alias("_contract"), "ts")
    root = str(tmp_path / "bars")
    write_bars(raw, inst, root, "db")
    back = scan_raw_bars(spark, root)
    kept = read_bars(only_configured_rolls(back, inst), inst)
    got = rows(kept, "ts")
    assert len(got) == 5 and got[0]["h"] == 21600 and got[0]["source"] == "db"
    assert read_bars(only_configured_rolls(back.withColumn("roll", F.lit("v")), inst), inst).count() == 0
    assert "PartitionFilters: [isnotnull(instrument" in back.filter("instrument = 'ES'")._jdf.queryExecution().toString()


def _raw(spark, *values):
    """(instant, open, source, seq)"""
    return spark.createDataFrame(list(values), "t string, open double, _source string, ingest_seq long").selectExpr(
        "'ES' AS instrument", "timestamp_micros(unix_micros(cast(t AS timestamp))) AS timestamp", "open", "open AS high",
        "open AS low", "open AS close", "5L AS volume", "'ESH4' AS _contract", "_source", "ingest_seq").withColumn(
        "ts", F.col("timestamp"))


def test_two_vendors_share_a_store(spark, tmp_path):
    inst, root = Market().instrument_table(spark), str(tmp_path / "bars")
    write_bars(_raw(spark, ("2024-03-05 15:00:00Z", 10.0, None, 1), ("2024-03-05 15:01:00Z", 11.0, None, 2)), inst, root, "databento")
    write_bars(_raw(spark, ("2024-03-05 15:00:00Z", 20.0, None, 9), ("2024-03-05 15:02:00Z", 22.0, None, 1)), inst, root, "local")
    assert scan_raw_bars(spark, root).count() == 4
    got = rows(load_bars(spark, root, inst), "ts")
    assert [(r["o"], r["source"], r["ingest_seq"]) for r in got] == [(40, "databento", 1), (44, "databento", 2), (88, "local", 1)]
    write_bars(_raw(spark, ("2024-03-05 15:02:00Z", 23.0, None, 2)), inst, root, "local")
    assert [r["o"] for r in rows(load_bars(spark, root, inst), "ts")] == [40, 44, 92]


def test_equal_copies_have_one_winner(spark):
    inst = Market().instrument_table(spark)
    raw = _raw(spark, ("2024-03-05 15:00:00Z", 10.0, "a", 1), ("2024-03-05 15:00:00Z", 12.0, "b", 1), ("2024-03-05 15:00:00Z", 11.0, "b", 1))
    for n in (1, 3, 7):
        assert [(r["o"], r["source"]) for r in rows(clean_bars(raw.repartition(n), inst))] == [(48, "b")]


def test_instants_do_not_depend_on_the_session_zone(spark):
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.sql("SELECT timestamp_micros(s * 1000000L + 250000L) AS t, timestamp_ntz'2024-11-03 01:30:00' AS n "
                           "FROM VALUES (1730611800L), (1730615400L), (-1L) AS v(s)")
            got = [str(r.w) for r in df.select(utc_wall(F.col("t")).alias("w")).collect()]
            assert got == ["2024-11-03 05:30:00.250000", "2024-11-03 06:30:00.250000", "1969-12-31 23:59:59.250000"]
            assert str(df.select(utc_wall(F.col("n")).alias("w")).first().w) == "2024-11-03 01:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_a_damaged_file_is_not_silent(spark, tmp_path):
    inst, root = Market().instrument_table(spark), str(tmp_path / "bars")
    write_bars(_raw(spark, ("2024-03-05 15:00:00Z", 10.0, None, 1)), inst, root, "databento")
    bad = tmp_path / "bars" / "instrument=ES" / "roll=c" / "vendor=databento" / "year=2023"
    bad.mkdir(parents=True)
    (bad / "part-0.parquet").write_bytes(b"not a table")
    with pytest.raises(Exception, match="part-0.parquet"):
        scan_raw_bars(spark, root).count()
    assert scan_raw_bars(spark, root, skip_corrupt=True).count() == 1
    assert [r.path.split("/")[-2] for r in skipped_files(spark, root).collect()] == ["year=2023"]
    other = _raw(spark, ("2024-03-05 15:00:00Z", 1.0, None, 1)).withColumn("instrument", F.lit("??"))
    assert [tuple(r) for r in unlisted_instruments(other, inst).collect()] == [("??", 1)]


def test_daily_reader_keys_by_new_york_date(spark):
    df = spark.sql("SELECT 'ES' instrument, timestamp'2024-01-10 22:00:00' timestamp, 1.0D open, 2.0D high, 0.5D low, 1.5D close, 3 volume")
    r = read_daily(df, Market().instrument_table(spark)).first()
    assert str(r.trading_date) == "2024-01-10" and (r.h, r.volume) == (8, 3)


def test_quote_columns_are_found_and_cleaned(spark, tmp_path):
    raw = spark.sql("SELECT 'ES' instrument, timestamp'2024-06-03 14:00:00' ts_event, '1.25' bid_px, 'x' ask_price "
                    "UNION ALL SELECT 'ES', timestamp'2024-06-03 14:01:00', '1.25', '1.50'")
    q = normalise_quotes(raw)
    assert [(r["bid"], r["ask"]) for r in rows(q)] == [(1.25, 1.5)]
    write_quotes(q, str(tmp_path))
    raw.write.parquet(str(tmp_path / "raw" / "ES_2024-06"))
    assert read_quotes(spark, str(tmp_path), ["2024-06"]).count() == 1
    assert read_quotes(spark, str(tmp_path), ["2024-07"]).count() == 0
    with pytest.raises(ValueError):
        normalise_quotes(raw.drop("bid_px"))


def test_verdict_and_manifest(spark, tmp_path):
    m = sinks.run_manifest(spark, NullSpec(draws=5), 7, 5)
    sinks.write_verdict(m, str(tmp_path / "v"))
    r = sinks.read_verdict(spark, str(tmp_path / "v")).first()
    assert len(r.config_hash) == 64 and r.master_seed == 7
    assert m.first().config_hash != sinks.run_manifest(spark, NullSpec(draws=6), 7, 6).first().config_hash


def test_sweep_end_to_end_and_from_the_stored_journal(spark, tmp_path):
    b = event_bars(spark, "/root/testdata/sf0.01")
    # The test history is one month, so the regime windows are passed as one long window.
    from barloom.operators.events import build_days
    from barloom.operators.journal import build_journal
    from barloom.plans.sweep import calibrate
    paths = SweepPaths(str(tmp_path))
    sinks.write_table(build_days(b.withColumn("regime_window", F.lit(0)), EVENT_GRID), paths.at("days"))
    days = spark.read.parquet(paths.at("days"))
    sinks.write_journal(build_journal(days, EVENT_GRID, EVENT_MARKET), paths.at("journal"))
    journal = sinks.read_journal(spark, paths.at("journal"))
    assert journal.groupBy(*VARIANT, "date").count().filter("count > 1").count() == 0
    summary = summarise(journal, paths, 20)
    direct = variant_summary(mark_eligibility(journal))
    assert summary.count() == direct.count() > 100
    spec = NullSpec(draws=20, sample_days=15, min_days=5)
    out = calibrate(journal, days, summary, EVENT_GRID, EVENT_MARKET, spec, paths)
    assert out.count() == summary.count()
    assert out.filter("null_p_broad <= 0 OR null_p_broad > 1 OR p_adj_maxT > 1 OR q_fdr > 1").count() == 0
    assert out.filter("null_p_broad IS NOT NULL").count() > 0
    notes = out.select("null_design", "null_days_requested", "null_days_used", "null_days_exhausted", "null_day_sampling",
                       "null_seed", "null_matched_days_used", "multiplicity_stat").dropna()
    assert notes.count() == out.count() and notes.filter("null_days_used > null_days_requested").count() == 0
    assert out.groupBy("instrument", "session").agg(F.count_distinct("null_seed").alias("n")).filter("n > 1").count() == 0
    assert null_section(out).first().median_days_used <= 15
    assert sinks.read_verdict(spark, paths.at("null/manifest")).first().completed_draws == 20
    assert spark.read.parquet(paths.at("null/null_t")).filter("eligible").count() > 0


def test_run_sweep_over_windows(spark, tmp_path):
    """Bars to calibrated summary over eleven months, with windows, volatility and controls."""
    v = "pmod(xxhash64(d, m), 41) - 20"
    bars_df = spark.range(330).selectExpr("id AS d").crossJoin(spark.range(210).selectExpr("id AS m")).selectExpr(
        "'ES' AS instrument",
        "timestamp_ntz'2023-01-02 13:30:00' + make_dt_interval(CAST(d AS INT), 0, CAST(m AS INT)) AS ts",
        f"CAST(20000 + 60 * sin((d * 210 + m) / 37.0) + ({v}) AS BIGINT) AS o",
        f"CAST(20000 + 60 * sin((d * 210 + m + 1) / 37.0) + (pmod(xxhash64(d, m + 1), 41) - 20) AS BIGINT) AS c",
        "1L AS volume", "'ESH3' AS contract", "'databento' AS source", "m AS ingest_seq").selectExpr(
        "*", "greatest(o, c) + 8 AS h", "least(o, c) - 8 AS l")
    grid = GridSpec(sessions=(("NY", "America/New_York", 570, 720),), range_minutes=(30,), closure_tfs={30: (5,)},
                    rr_levels=(0.5, 1.0))
    out = run_sweep(bars_df, daily_from_bars(bars_df), grid, Market(), str(tmp_path),
                    NullSpec(draws=20, sample_days=40, min_days=10), ci_draws=20)
    windows = spark.read.parquet(str(tmp_path / "windows"))
    days = spark.read.parquet(str(tmp_path / "days"))
    journal = spark.read.parquet(str(tmp_path / "journal"))
    assert windows.count() == 1 and 150 < days.count() < 190
    assert days.filter("atr_4h IS NULL OR parkinson_vol_14d IS NULL").count() < 30
    assert journal.filter("date < window_start OR date > window_end").count() == 0
    rows_ = out.collect()
    assert rows_ and {r.hypothesis_variants for r in rows_} == {len(rows_)}
    assert all(r.ci_lo <= r.expectancy_gross_r <= r.ci_hi for r in rows_ if r.trade_count > 60)
    assert all(0 < r.p_adj_maxT <= 1 and 0 < r.null_p_broad <= 1 for r in rows_ if r.null_p_broad is not None)


def test_every_query_has_an_oracle():
    q, o = entry_point.queries(), entry_point.oracle_sql()
    assert set(QUERIES) <= set(o) <= set(q) and len(QUERIES) > 120


@pytest.mark.parametrize("name", ["breakout_hit_rate", "barrier_outcomes", "swing_stops", "atr_wilder", "variant_summary",
                                  "repriced_modes", "maxt_stepdown", "control_events_matched"])
def test_queries_equal_their_oracles(spark, sf, name):
    from oracle_check import compare, connect
    got = entry_point.queries()[name](spark, sf).toPandas()
    want = connect(sf).execute(entry_point.oracle_sql()[name]).fetchdf()
    assert compare(got, want) == ""


@pytest.mark.parametrize("name", ["studentised_observed", "family_maxima"])
def test_pools_of_equal_draws_have_null_statistics(spark, sf, name):
    from oracle_check import compare, connect
    got = entry_point.queries()[name](spark, sf).toPandas()
    want = connect(sf).execute(entry_point.oracle_sql()[name]).fetchdf()
    assert want.t.isna().any() and compare(got, want) == ""


@pytest.mark.parametrize("rows_kept, rankable", [("o_orderdate < DATE '2000-01-01'", True), ("false", False)])
def test_verdict_of_no_tested_families(spark, sf, tmp_path, rows_kept, rankable):
    spark.read.parquet(f"{sf}/orders.parquet").filter(rows_kept).write.parquet(str(tmp_path / "orders.parquet"))
    r = entry_point.queries()["holdout_verdict"](spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].holdout_families_tested == 0 and (r[0].families_rankable > 0) == rankable
    assert r[0].holdout_net_positive_pct is None and (r[0].survivor_pct_of_families is None) == (not rankable)


def test_verdict_reads_its_orders_once_for_all_readers(spark, sf):
    plan = entry_point.queries()["holdout_verdict"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in plan and "FileScan" not in plan


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_no_python_workers_in_the_plans(spark, sf):
    for name in ("journal_rows", "multiplicity", "curve_stats", "control_pool_days"):
        plan = entry_point.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name
