import random

from barloom.operators.barriers import label_barriers
from barloom.params import GridSpec
from tests.helpers import event, events, exchanges, rows

GRID = GridSpec(rr_levels=(1.0,))


def one(spark, ohlc, entry=21604, stop=21524, direction="long", at_close=False, grid=GRID, entry_idx=0):
    return label_barriers(events(spark, [event(1, direction, entry_idx, entry, stop, ohlc, at_close)]), grid).first()


def flat(lo, hi):
    return (21604, hi, lo, 21604)


def test_target(spark):
    r = one(spark, [flat(21600, 21610), flat(21600, 21700)])
    assert (r.exit_reason, r.exit_idx, r.gross_r, r.bars_held) == ("TP", 1, 1.0, 2)


def test_stop(spark):
    r = one(spark, [flat(21516, 21610)])
    assert (r.exit_reason, r.exit_t, r.gross_r) == ("SL", 21524.0, -1.0)


def test_time_exit_at_last_close(spark):
    r = one(spark, [flat(21600, 21610)] * 2 + [(21604, 21660, 21600, 21652)])
    assert (r.exit_reason, r.exit_t, r.exit_idx) == ("TIME", 21652.0, 2)


def test_both_levels_in_one_bar_is_a_flagged_stop(spark):
    r = one(spark, [flat(21516, 21688)])
    assert (r.exit_reason, r.same_bar_ambiguous, r.gross_r_optimistic) == ("SL", True, 1.0)


def test_gap_through_the_stop_fills_at_the_open(spark):
    r = one(spark, [flat(21600, 21610), (21500, 21505, 21490, 21500)])
    assert (r.exit_reason, r.exit_t, r.same_bar_ambiguous) == ("SL", 21500.0, False)


def test_close_fill_starts_at_the_next_bar(spark):
    r = one(spark, [flat(21500, 21900), flat(21600, 21610), flat(21600, 21612)], at_close=True)
    assert (r.exit_reason, r.bars_held) == ("TIME", 2)


def test_invalid_events_keep_their_reason(spark):
    assert one(spark, [flat(21600, 21610)], at_close=True).exit_reason == "NO_HOLD_BARS"
    bad = one(spark, [flat(21600, 21610)], stop=21700)
    assert bad.exit_reason == "SL_WRONG_SIDE" and bad.gross_r is None and bad.bars_held == 0


def test_target_needs_trade_through(spark):
    assert one(spark, [flat(21600, 21684)]).exit_reason == "TIME"
    assert one(spark, [flat(21600, 21685)]).exit_reason == "TP"


def test_entry_bar_open_switch(spark):
    first = [(21700, 21700, 21604, 21650), flat(21600, 21650)]
    assert one(spark, first).exit_reason == "TP"
    r = one(spark, first, grid=GRID.with_(entry_bar_open=False))
    assert (r.exit_reason, r.exit_t) == ("TP", 21684.0)


def walk(direction, entry, stop, rr, held):
    """The plain loop: signed prices, one bar after the other."""
    s = 1 if direction == "long" else -1
    e, sl = s * entry, s * stop
    r = abs(e - sl)
    tp = e + rr * r
    adverse = favorable = 0.0
    for i, (o, h, l, c) in enumerate(held):
        so, hi, lo = s * o, (h if s == 1 else -l), (l if s == 1 else -h)
        adverse, favorable = max(adverse, e - lo), max(favorable, hi - e)
        hit = (("SL", so) if so <= sl else ("TP", so) if so >= tp else ("SL", sl) if lo <= sl
               else ("TP", tp) if hi >= tp + 1 else None)
        if hit:
            amb = so > sl and so < tp and lo <= sl and hi >= tp + 1
            return hit[0], i, (hit[1] - e) / r, -adverse / r, favorable / r, amb
    return "TIME", len(held) - 1, (s * held[-1][3] - e) / r, -adverse / r, favorable / r, False


def test_random_paths_equal_the_plain_loop(spark):
    rng = random.Random(7)
    levels = (0.25, 0.5, 1.0, 2.0)
    cases = []
    for no in range(1500):
        direction = rng.choice(["long", "short"])
        n = rng.randint(1, 24)
        price, path = 1000, []
        for _ in range(n):
            o = price + rng.randint(-6, 6)
            c = o + rng.randint(-8, 8)
            path.append((o, max(o, c) + rng.randint(0, 6), min(o, c) - rng.randint(0, 6), c))
            price = c
        entry = path[0][0] + rng.randint(-3, 3)
        stop = entry - (1 if direction == "long" else -1) * rng.randint(1, 20)
        cases.append((no, direction, entry, stop, path))
    df = events(spark, [event(no, d, 0, e, s, p) for no, d, e, s, p in cases])
    got = {(r["event"], r["rr"]): r for r in rows(label_barriers(df, GridSpec(rr_levels=levels)))}
    assert len(got) == len(cases) * len(levels)
    for no, d, e, s, p in cases:
        for rr in levels:
            r = got[(no, rr)]
            reason, i, gross, mae, mfe, amb = walk(d, e, s, rr, p)
            assert (r["exit_reason"], r["exit_idx"], r["same_bar_ambiguous"]) == (reason, i, amb), (no, rr)
            assert abs(r["gross_r"] - gross) < 1e-12 and abs(r["mae_r"] - mae) < 1e-12
            assert abs(r["mfe_r"] - mfe) < 1e-12


def test_labelling_adds_no_exchange(spark):
    ev = events(spark, [event(1, "long", 0, 100, 90, [(100, 101, 99, 100)])])
    assert exchanges(label_barriers(ev, GridSpec())) == 0
