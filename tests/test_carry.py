"""Holdout runs from a stored state, scans, the skyline and the contract history."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import catalog as C
from barloom.functions.scans import scan
from barloom.operators import bars as B
from barloom.operators.events import build_days
from barloom.plans import carry
from barloom.plans.setups import pareto_frontier
from barloom.sources.views import EVENT_GRID, event_bars
from tests.helpers import rows

CUT = "2024-01-20"


def test_a_later_run_equals_the_run_over_all_bars(spark, sf, tmp_path):
    bars = event_bars(spark, sf).withColumn("contract", F.when(F.hour("ts") % 4 != 0, F.col("contract")))
    filled = B.fill_contract(bars)
    whole = build_days(B.enrich_bars(B.attach_atr(filled), B.daily_from_bars(filled)), EVENT_GRID).filter(F.col("local_date") >= CUT)
    carry.save_state(carry.run_state(filled, CUT, EVENT_GRID), str(tmp_path / "state"))
    state = carry.load_state(spark, str(tmp_path / "state"))
    later = carry.later_days(bars.filter(F.col("ts") >= CUT), state, CUT, EVENT_GRID)
    key = ["instrument", "session", "local_date"]
    exact = ["open_idx", "last_idx", "changed_in", "changed_since", "prev_close", "gap_ticks", "open_tick"]
    close = ["atr_4h", "parkinson_vol_14d", "realized_vol_14d", "completeness"]
    a, b = (x.select(*key, *exact, *close).toPandas().sort_values(key).reset_index(drop=True) for x in (later, whole))
    assert len(a) == len(b) > 20
    pd.testing.assert_frame_equal(a[key + exact], b[key + exact])
    pd.testing.assert_frame_equal(a[close], b[close], rtol=1e-9)
    assert a.atr_4h.notna().any() and a.changed_since.any()
    assert state["daily"].groupBy("instrument").count().agg(F.max("count")).first()[0] <= B.VOL_DAYS + 2


def test_average_goes_on_from_any_bar(spark):
    rng = random.Random(3)
    bars = spark.createDataFrame([("x", i, *(lambda c: (c, c + rng.randint(1, 9), c - rng.randint(1, 9), c + rng.randint(-3, 3)))(100 + rng.randint(-20, 20)))
                                  for i in range(700)], "instrument string, bin int, o int, h int, l int, c int")
    want = {r["bin"]: (r["atr"], r["atr_prev"]) for r in rows(B.wilder_atr(bars), "bin")}
    for at in (1, 5, 13, 14, 15, 256, 300, 699):
        state = B.atr_state(bars.filter(F.col("bin") < at))
        got = rows(B.wilder_atr(bars.filter(F.col("bin") >= at), start=state), "bin")
        for r in got:
            for value, known in zip((r["atr"], r["atr_prev"]), want[r["bin"]]):
                assert (value is None) == (known is None) and (known is None or value == pytest.approx(known, rel=1e-12))


def test_scan_equals_pandas(spark):
    rng = random.Random(1)
    data = pd.DataFrame({"k": [rng.choice("ab") for _ in range(300)], "day": sorted(rng.randrange(30) for _ in range(300)),
                         "x": [rng.randint(-9, 9) for _ in range(300)], "v": [rng.choice([None, "p", "q"]) for _ in range(300)]})
    data["t"] = range(300)
    out = scan(spark.createDataFrame(data).repartition(7), ["k"], "day", ["t"], sums={"cum": F.col("x"), "n": F.lit(1)},
               peaks={"top": "cum"}, lags={"before": "x"}, known={"label": "v"})
    got = pd.DataFrame(rows(out, "t"))
    g = data.groupby("k")
    data["cum"], data["n"] = g.x.cumsum(), g.cumcount() + 1
    data["top"], data["before"], data["label"] = data.groupby("k").cum.cummax(), g.x.shift(), g.v.ffill()
    for c in ("cum", "n", "top", "before"):
        assert got[c].fillna(-99).tolist() == data[c].fillna(-99).tolist()
    assert got["label"].where(got["label"].notna(), None).tolist() == data["label"].where(data["label"].notna(), None).tolist()


def test_scan_joins_once_and_reads_twice(spark, sf):
    plan = C._curve(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 2 and plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") + plan.count("BroadcastHashJoin Left") <= 2


def test_skyline_equals_all_pairs(spark):
    rng = random.Random(2)
    points = [(i, float(rng.randint(0, 30)), float(rng.randint(0, 30)), float(60 - rng.randint(0, 60))) for i in range(400)]
    points += [(400 + i, 31.0, 31.0, 1.0) for i in range(3)] + [(500, None, 1.0, 1.0)]
    got = {r["id"] for r in pareto_frontier(spark.createDataFrame(points, "id int, a double, b double, c double"), ("a", "b", "c")).collect()}
    whole = [p for p in points if None not in p]
    assert got == {p[0] for p in whole if not any(all(x >= y for x, y in zip(q[1:], p[1:])) and q[1:] != p[1:] for q in whole)}


def test_bars_are_exchanged_once_for_days(spark, tmp_path):
    spark.sql("SELECT 'ES' instrument, timestamp_ntz'2024-01-02 15:00:00' ts, 1L o, 2L h, 0L l, 1L c, 5L volume, 'H' contract, 's' source, 1L ingest_seq") \
        .write.parquet(str(tmp_path / "bars"))
    plan = build_days(spark.read.parquet(str(tmp_path / "bars")), EVENT_GRID)._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "local_date" in line]
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    # The bars' own exchange and, for the contract history, slim rows of days; its scan reads three columns.
    assert len(wide) <= 3 and len(scans) == 2 and any("ReadSchema: struct<instrument:string,ts:timestamp_ntz,contract:string>" in s for s in scans)
