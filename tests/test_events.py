import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators.events import build_days, detect_signals, place_stops, price_signals
from barloom.operators.session_days import opening_ranges, session_bars, session_quality
from barloom.params import GridSpec
from tests.helpers import OPEN_UTC, RANGE5, bars, event, events, exchanges, rows

GRID = GridSpec(sessions=(("NY", "America/New_York", 570, 720),), range_minutes=(5,), closure_tfs={5: (1, 5)})


def signals(spark, after, **kw):
    days = build_days(bars(spark, RANGE5 + after, **kw), GRID)
    out = {}
    for r in price_signals(detect_signals(days, GRID), GRID).collect():
        out[(r.entry_mode, r.closure_tf, r.direction)] = r
    return out


def q(price):
    return round(price * 4)


def bar(o, h, l, c):
    return (q(o), q(h), q(l), q(c))


def test_first_breakout_long_and_short(spark):
    s = signals(spark, [bar(5400, 5401, 5399.5, 5400.75)])
    assert s[("II", 1, "long")].fill_t == q(5400.25) and not s[("II", 1, "long")].gap_fill
    s = signals(spark, [bar(5380, 5380.5, 5379, 5379.75)])
    assert s[("II", 1, "short")].fill_t == q(5379.75)


def test_no_trigger_inside_the_range(spark):
    assert ("II", 1, "long") not in signals(spark, [bar(5399, 5399.5, 5390, 5395)])


def test_open_beyond_the_trigger_fills_at_the_open(spark):
    r = signals(spark, [bar(5402, 5405, 5401, 5403)])[("II", 1, "long")]
    assert r.fill_t == q(5402) and r.gap_fill


def test_close_confirmation(spark):
    r = signals(spark, [bar(5399, 5399.5, 5398, 5399), bar(5399, 5401.5, 5398.5, 5401)])[("CC", 1, "long")]
    assert (r.entry_idx, r.fill_t, r.fill_at_bar_close) == (6, q(5401), True)


def test_return_and_rebreak(spark):
    s = signals(spark, [bar(5400, 5401, 5400.5, 5400.75), bar(5400.5, 5400.75, 5399, 5399.5),
                        bar(5399.5, 5401.5, 5399.5, 5401.25)])
    ti, rii, rcc = s[("TI", 1, "long")], s[("R-II", 1, "long")], s[("R-CC", 1, "long")]
    assert (ti.entry_idx, ti.fill_t) == (6, q(5400))
    assert (rii.entry_idx, rii.tap_idx) == (7, 6)
    assert rcc.entry_idx == 7 and rcc.fill_t == q(5401.25)


def test_incomplete_bucket_gives_no_close(spark):
    s = signals(spark, [bar(5400, 5402, 5399, 5401)] * 4)
    assert ("CC", 5, "long") not in s and ("CC", 1, "long") in s
    assert signals(spark, [bar(5400, 5402, 5399, 5401)] * 5)[("CC", 5, "long")].entry_idx == 9


def test_event_order_invariants(spark, sf):
    from barloom.sources.views import EVENT_GRID, event_bars
    s = detect_signals(build_days(event_bars(spark, sf), EVENT_GRID), EVENT_GRID)
    key = ["instrument", "session", "local_date", "range_minutes", "entry_mode", "closure_tf", "direction"]
    assert s.count() > 0 and s.groupBy(*key).count().filter("count > 1").count() == 0
    bad = s.filter("(entry_mode = 'TI' AND entry_idx <= breakout_idx) OR "
                   "(entry_mode LIKE 'R-%' AND (entry_idx <= tap_idx OR tap_idx <= breakout_idx))")
    assert bad.count() == 0


# Runs before the anchor: (bars, anchor, range bound, entry, direction) → (stop, back, source).
RUN_CASES = [
    ("latest of two runs", [(100, 101, 97, 99), (99, 100, 98, 98), (98, 101, 98, 100), (100, 102, 99, 99),
                            (99, 104, 99, 103)], 4, 90, 110, "long", (99, 1, "cluster")),
    ("run of two", [(100, 102, 99, 101), (101, 101, 98, 100), (100, 100, 97, 98), (98, 105, 98, 104)], 3, 90, 110,
     "long", (97, 2, "cluster")),
    ("no run", [(100, 102, 99, 101), (101, 103, 100, 102), (102, 106, 101, 105)], 2, 90, 110, "long",
     (90, 0, "range_fallback")),
    ("later bars do not count", [(100, 102, 99, 101), (101, 105, 100, 104), (104, 104, 80, 85)], 1, 90, 110, "long",
     (90, 0, "range_fallback")),
    ("no prior bars", [(100, 105, 99, 104)], 0, 90, 110, "long", (90, 0, "no_prior_bars")),
    ("short mirror", [(100, 101, 98, 99), (99, 104, 99, 102), (102, 103, 90, 91)], 2, 110, 90, "short",
     (104, 1, "cluster")),
    ("floor long", [(101, 102, 99, 100), (100, 105, 99, 104)], 1, 90, 101, "long", (97, 1, "min_floor_applied")),
    ("floor short", [(100, 101, 98, 101), (101, 103, 97, 98)], 1, 110, 100, "short", (104, 1, "min_floor_applied")),
]


@pytest.mark.parametrize("case", RUN_CASES, ids=[c[0] for c in RUN_CASES])
def test_stop_from_runs(spark, case):
    _, ohlc, anchor, bound, entry, direction, want = case
    df = events(spark, [event(1, direction, anchor, entry, 0, ohlc, opposite=bound)]).drop("sl_t")
    r = place_stops(df, GridSpec(), F.col("entry_idx")).first()
    assert (r.sl_t, r.sl_bars_back, r.sl_source) == want


def test_long_run_is_cut_at_the_lookback(spark):
    ohlc = [(100, 101, 10 + i, 99) for i in range(60)] + [(100, 130, 99, 120)]
    df = events(spark, [event(1, "long", 60, 120, 0, ohlc, opposite=5)]).drop("sl_t")
    r = place_stops(df, GridSpec(), F.col("entry_idx")).first()
    assert (r.sl_t, r.sl_bars_back, r.sl_source) == (20, 50, "cluster")


def test_ranges_need_all_minutes_and_days_need_one_range(spark):
    full = bars(spark, RANGE5 + [(21600, 21604, 21590, 21600)])
    gap = bars(spark, RANGE5[:3], day=OPEN_UTC + dt.timedelta(days=1))
    sb = session_bars(full.unionByName(gap), GRID)
    assert [(str(r["local_date"]), r["range_width_ticks"]) for r in rows(opening_ranges(sb, GRID))] == [("2024-01-10", 80)]


def test_context_before_a_gap_is_dropped(spark):
    early = bars(spark, [(1, 1, 1, 1)] * 3, first_minute=-40)
    near = bars(spark, [(2, 2, 2, 2)] * 2, first_minute=-4)
    main = bars(spark, RANGE5)
    d = build_days(early.unionByName(near).unionByName(main), GRID).first()
    assert (d.open_idx, d.last_idx, len(d.bars)) == (2, 6, 7)


def test_contract_flags(spark):
    day = dt.timedelta(days=1)
    a = bars(spark, RANGE5, contract="ESH4")
    b = bars(spark, RANGE5, day=OPEN_UTC + day, contract="ESM4")
    c = bars(spark, RANGE5[:2], day=OPEN_UTC + 2 * day, contract="ESM4").unionByName(
        bars(spark, RANGE5[:3], day=OPEN_UTC + 2 * day, contract="ESU4", first_minute=2))
    got = rows(session_quality(build_days(a.unionByName(b).unionByName(c), GRID)), "local_date")
    assert [(r["changed_in"], r["changed_since"]) for r in got] == [(False, False), (False, True), (True, False)]


def test_summer_and_winter_opens(spark):
    """09:30 New York is 14:30 UTC before and 13:30 UTC after the March change."""
    winter = bars(spark, RANGE5, day=dt.datetime(2024, 3, 8, 14, 30))
    summer = bars(spark, RANGE5, day=dt.datetime(2024, 3, 11, 13, 30))
    off = bars(spark, RANGE5, day=dt.datetime(2024, 3, 12, 17, 30))
    sb = session_bars(winter.unionByName(summer).unionByName(off), GRID)
    assert sorted({str(r["local_date"]) for r in rows(sb)}) == ["2024-03-08", "2024-03-11"]
    assert {r["wall"] for r in rows(sb)} == set(range(570, 575))


def test_detection_needs_one_exchange_of_the_bars(spark):
    b = bars(spark, RANGE5 + [(21600, 21604, 21590, 21600)])
    days = build_days(b, GRID)
    out = price_signals(detect_signals(days, GRID), GRID)
    # One exchange of whole bars; the contract history has slim ones of its own: (day, contract)
    # rows, the window over days, and the join back. Events and stops add none.
    assert exchanges(days) == exchanges(out) <= 4
