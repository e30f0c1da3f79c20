"""Setups as known at each bar, places among zones, runs, and readings: prefixes of the input, plain versions, hand-made cases."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import policy as P
from tidemark.operators import state as S
from tidemark.operators import tracking
from tidemark.operators import zones as Z

T0 = dt.datetime(2024, 1, 1)
LENGTH = {"main": 14_400, "slow": 86_400, "fast": 3_600}


@pytest.fixture(scope="module")
def series(spark, tmp_path_factory):
    """Two symbols over 104 days: hours, and four hours and days made of them, written once."""
    rows = []
    for k, symbol in enumerate("ab"):
        r = np.random.default_rng(k)
        n = 104 * 24
        drift = np.repeat(r.normal(0, 0.0015, n // 48), 48)
        c = 100 * np.exp(np.cumsum(r.normal(0, 0.008, n) + drift))
        o = np.concatenate([[100.0], c[:-1]])
        hi, lo = np.maximum(o, c) * (1 + r.random(n) * 0.004), np.minimum(o, c) * (1 - r.random(n) * 0.004)
        v = r.integers(1, 50, n).astype(float)
        rows.append(pd.DataFrame({"symbol": symbol, "ts": [T0 + dt.timedelta(hours=i) for i in range(n)], "open": o, "high": hi, "low": lo, "close": c, "volume": v, "quote_vol": v * c}))
    where = tmp_path_factory.mktemp("series")
    hours = spark.createDataFrame(pd.concat(rows)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    made = {"fast": hours, "main": B.resample(hours, 14_400, 4).select("symbol", "ts", "open", "high", "low", "close", "volume"), "slow": B.resample(hours, 86_400, 24)}
    for name, df in made.items():
        df.write.parquet(f"{where}/{name}")
    return {name: spark.read.parquet(f"{where}/{name}") for name in made}


def until(series, at):
    """What had closed by then."""
    return {k: v.where(F.unix_seconds(F.col("ts").cast("timestamp")) + LENGTH[k] <= F.unix_seconds(F.lit(at).cast("timestamp_ntz").cast("timestamp"))) for k, v in series.items()}


def walked(s):
    rows = tracking.walk_forward(s["main"], s["slow"], s["fast"], s["fast"]).collect()
    return {(r.symbol, r.ts): r for r in rows}


@pytest.fixture(scope="module")
def whole(series):
    return walked(series)


def rounded(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(rounded, v))
    return v


@pytest.mark.parametrize("at", [dt.datetime(2024, 2, 10, 9), dt.datetime(2024, 4, 3, 4), dt.datetime(2024, 4, 11, 22)])
def test_what_comes_later_changes_no_setup(series, whole, at):
    cut = walked(until(series, at))
    assert cut.keys() == {k for k in whole if k[1] + dt.timedelta(hours=4) <= at} and len(cut) > 400
    for k, r in cut.items():
        assert rounded(r) == rounded(whole[k]), k


def test_a_walk_uses_all_of_its_parts(series, whole):
    rows = list(whole.values())
    assert len(rows) == 2 * 104 * 6
    assert {r.at for r in rows} >= {"middle", "at_support", "at_resistance"}
    assert any("poc" in z.kinds for r in rows for z in r.zone_list or [])
    assert any(r.regime_slow for r in rows) and any(r.z_slow for r in rows) and any(r.z_fast for r in rows) and any(r.conflict for r in rows)
    assert any(r.stop for r in rows) and {r.play for r in rows} > {None}
    kept = tracking.placed(tracking.walk_forward(series["main"], series["slow"], series["fast"], series["fast"]))
    assert {(r.symbol, r.ts) for r in kept.select("symbol", "ts").collect()} == {k for k, r in whole.items() if r.at in ("at_support", "at_resistance")}


@pytest.mark.parametrize("at", [dt.datetime(2024, 3, 30, 12), dt.datetime(2024, 4, 12, 20)])
def test_the_last_setup_is_that_of_the_walk(series, whole, at):
    s = until(series, at)
    levels = Z.levels(s["main"], s["fast"], seconds=14_400)
    got = P.build_setups(levels, tracking.states_of(s["main"]), tracking.states_of(s["slow"]), *(S.cyclic_rsi(s[k]) for k in ("main", "slow", "fast"))).collect()
    assert len(got) == 2
    for r in got:
        want = whole[r.symbol, r.ts]
        assert r.ts == at - dt.timedelta(hours=4) and rounded(r) == rounded(want)


def test_votes_are_the_last_ones_closed_by_then(series, whole):
    """The fast bar that closes with the bar, and the day before the bar's: by plain search."""
    osc = {k: sorted((r.ts + dt.timedelta(seconds=LENGTH[k]), r.pos, r.zone) for r in S.cyclic_rsi(series[k]).where("symbol = 'a'").collect()) for k in LENGTH}
    states = {k: sorted((r.ts + dt.timedelta(seconds=LENGTH[k]), r.state) for r in tracking.states_of(series[k]).where("symbol = 'a'").collect()) for k in ("main", "slow")}
    for (symbol, ts), r in whole.items():
        if symbol != "a":
            continue
        end = ts + dt.timedelta(hours=4)
        for k, pos in (("main", r.pos_main), ("slow", r.pos_slow), ("fast", r.pos_fast)):
            seen = [x for x in osc[k] if x[0] <= end]
            want = seen[-1][1] if seen and seen[-1][2] is not None and (k != "slow" or len(seen) >= P.SLOW_LEAST) else None
            assert pos == (want if want is None else pytest.approx(want))
        for k, state in (("main", r.regime), ("slow", r.regime_slow)):
            seen = [x for x in states[k] if x[0] <= end]
            assert state == (seen[-1][1] if seen else None)


def plain_place(zones, price, atr, regime, first):
    """The same as policy.place in a plain loop."""
    best = None
    fast, slow = {"ema21", "ema55"}, {"ema100", "ema200"}
    highs, lows = {"pivot_high", "prev_day_hi", "prev_week_hi"}, {"pivot_low", "prev_day_lo", "prev_week_lo"}
    for z in zones:
        if z["overflow"]:
            continue
        role = "support" if price > z["hi"] else "resistance" if price < z["lo"] else z["role"]
        dist = max(0.0, (price - z["hi"]) / atr, (z["lo"] - price) / atr)
        flipped, kinds = role != z["role"], set(z["kinds"])
        if regime == "trend_up":
            ok = (kinds & (fast | {"range_lo"}) or (kinds & highs and flipped) or ("pivot_low" in kinds and not flipped)) if role == "support" else kinds & highs and not flipped
        elif regime == "trend_down":
            ok = (kinds & slow or (kinds & lows and not flipped)) if role == "support" else (kinds & (fast | slow | {"range_hi"}) or (kinds & lows and flipped) or ("pivot_high" in kinds and not flipped))
        else:
            ok = ("range_lo" if role == "support" else "range_hi") in kinds
        if ok and dist <= 0.5 and (best is None or (dist, -len(kinds)) < best[0]):
            best = ((dist, -len(kinds)), z, role, flipped)
    if best is None:
        return ("middle", None, False)
    _, z, role, flipped = best
    far = 0.0 if z["lo"] <= price <= z["hi"] else min(abs(price - z["lo"]), abs(price - z["hi"]))
    way = "from_above" if first > z["hi"] and price < first and far < first - z["hi"] else "from_below" if first < z["lo"] and price > first and far < z["lo"] - first else None
    trade = {"trend_up": role == "support" and way == "from_above", "trend_down": (role == "resistance" and way == "from_below") or (role == "support" and bool(set(z["kinds"]) & slow)), "range": True}.get(regime, False)
    return ("at_support" if role == "support" else "at_resistance", z["lo"], trade)


def test_places_by_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    kinds = ["pivot_high", "pivot_low", "ema21", "ema55", "ema100", "ema200", "range_lo", "range_hi", "prev_day_hi", "prev_week_lo", "poc"]
    rows = []
    for i in range(300):
        zones = [{"lo": float(x), "hi": float(x + 0.4), "mid": float(x + 0.2), "kinds": sorted(rng.choice(kinds, int(rng.integers(1, 4)), replace=False).tolist()), "role": str(rng.choice(["support", "resistance"])), "members": [], "overflow": bool(rng.random() < 0.1)} for x in np.sort(rng.uniform(95, 105, 8))]
        zones[3] |= {"overflow": False}
        rows.append((i, zones, float(rng.uniform(95, 105)), 1.0, P.REGIMES[i % 5], float(rng.uniform(95, 105))))
    df = spark.createDataFrame(rows, f"i int, zones array<{Z.ZONE}>, price double, atr double, regime string, first double")
    got = {r.i: (r.p.at, r.p.lo, r.p.tradeable) for r in df.select("i", P.place(F.col("zones"), F.col("price"), F.col("atr"), F.col("regime"), F.col("first")).alias("p")).collect()}
    assert got == {i: plain_place(*r) for i, *r in rows}


def test_places_that_nothing_can_be_said_of(spark):
    z = {"lo": 1.0, "hi": 2.0, "mid": 1.5, "kinds": ["range_lo"], "role": "support", "members": [], "overflow": True}
    rows = [(0, [z], 1.5, 1.0, "range"), (1, [], 1.5, 1.0, "range"), (2, None, 1.5, 1.0, "range"), (3, [z], None, 1.0, "range"), (4, [z], 1.5, 0.0, "range"), (5, [z], 1.5, 1.0, "odd"), (6, [z], 1.5, 1.0, None)]
    df = spark.createDataFrame(rows, f"i int, zones array<{Z.ZONE}>, price double, atr double, regime string")
    got = {r.i: (r.p.at, r.p.reason) for r in df.select("i", P.place(F.col("zones"), F.col("price"), F.col("atr"), F.col("regime"), F.lit(None).cast("double")).alias("p")).collect()}
    assert got == {0: (None, "chain_overflow"), 1: (None, "no_zones"), 2: (None, "no_zones"), 3: (None, "no_price"), 4: (None, "no_atr"), 5: (None, "unsupported_regime"), 6: (None, "unsupported_regime")}


# ---------------------------------------------------------------- runs

RUN = "symbol string, ts timestamp_ntz, at string, regime string, pos double, crsi double, main_ok boolean, observed timestamp_ntz"


def made_runs(spark, *rows):
    """rows: (bar, at, regime, pos, main_ok, bar observed or None)"""
    t = lambda k: None if k is None else T0 + dt.timedelta(hours=4 * k)
    df = spark.createDataFrame([("s", t(k), a, r, p, p, ok, t(o)) for k, a, r, p, ok, o in rows], RUN)
    return P.runs(df, 14_400).orderBy("run").collect()


def test_any_other_row_ends_a_run(spark):
    s, r = "at_support", "at_resistance"
    got = made_runs(spark, (0, s, "range", 40.0, False, None), (1, r, "range", 60.0, False, None), (2, s, "range", 30.0, False, None), (3, s, "range", 20.0, False, None), (5, s, "range", 10.0, False, None), (8, s, "range", 5.0, False, None), (9, s, "trend_up", 5.0, True, None))
    assert [(x.setup_bars, x.bars) for x in got] == [(1, 1), (1, 1), (3, 4), (1, 1), (1, 1)]
    assert [x.status for x in got] == ["expired"] * 4 + ["ripe"]
    assert got[2].gap_slope == pytest.approx(np.polyfit([0, 1, 3], [30, 20, 10], 1)[0]) and got[2].gap_trend == "closing"
    assert got[1].gap_now == 40.0


@pytest.mark.parametrize(("oks", "seen", "status"), [((False, True, False), None, "matured"), ((True,), 1, "ripe"), ((True,), 2, "expired"), ((False, None), None, "brewing"), ((True, None), None, "matured"), ((False,) * 9, None, "brewing")])
def test_how_runs_end(spark, oks, seen, status):
    got = made_runs(spark, *((k, "at_support", "range", 10.0, ok, seen) for k, ok in enumerate(oks)))
    assert [x.status for x in got] == [status] and got[0].gap_trend == "flat"


def test_only_the_last_gaps_make_the_trend(spark):
    pos = [90.0, 10.0, None, 20.0, 30.0, 40.0]
    got = made_runs(spark, *((k, "at_support", "range", p, False, None) for k, p in enumerate(pos)))[0]
    assert got.gap_slope == pytest.approx(np.polyfit([1, 3, 4, 5], [10, 20, 30, 40], 1)[0]) and got.gap_trend == "opening"
    off = made_runs(spark, (0, "at_support", "range", 1.0, True, None))
    assert off[0].crsi_slope == 0.0 and off[0].bars == 1


# ---------------------------------------------------------------- readings and notes


def plain_reading(d, h, m):
    trends = ("trend_up", "trend_down")
    lacks = ",".join(n for n, v in (("1d", d), ("4h", h), ("1h", m)) if v is None)
    before = f"missing {lacks}: " if lacks else ""
    if d is None or h is None:
        return before + "too_few_timeframes"
    if d in trends and d == h:
        if m == d:
            return before + "three_aligned"
        if m is None:
            return before + "two_aligned"
    if d == "trend_up" and h in ("range", "squeeze"):
        return before + "uptrend_resting"
    if d == "trend_down" and h in ("range", "squeeze"):
        return before + "downtrend_resting"
    if d in trends and h in trends and d != h:
        return before + "opposed_trends"
    if d == "squeeze":
        return before + "daily_squeeze"
    if d == "range" and h == "squeeze":
        return before + "range_coiled"
    if "high_vol_chop" in (d, h):
        return before + "chop"
    return before + "background_and_place"


def test_every_reading(spark):
    cells = list(itertools.product([*P.REGIMES, None], repeat=3))
    got = spark.createDataFrame(cells, "d string, h string, m string").select("d", "h", "m", P.reading(F.col("d"), F.col("h"), F.col("m")).alias("r")).collect()
    assert [r.r for r in got] == [plain_reading(*c) for c in cells]


def test_tenors_and_stops_at_their_limits(spark):
    rows = [(3.0, 1.0, 20.0, 5.0, 30.0), (3.0, 3.0, 20.0, 3.0, 20.0), (3.0, 3.0, 20.0, 9.0, 30.0), (3.0, 5.0, 20.0, 9.0, 30.0), (3.0, 1.0, 0.0, 5.0, 30.0), (3.0, 5.0, 20.0, 1.0, 30.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "t double, a double, x double, b double, y double").select(P.interpolate_iv(*map(F.col, "taxby"))).collect()]
    assert got == [pytest.approx(((0.5 * 400 * 1 + 0.5 * 900 * 5) / 3) ** 0.5), None, 20.0, None, None, None]
    df = spark.range(1).select(P.structural_stop(F.lit("long"), F.lit(1.0), F.lit(0.2), F.lit(0.9), F.lit(1.0)).alias("below_zero"), P.structural_stop(F.lit("short"), F.lit(1.0), F.lit(0.9), F.lit(1.1), F.lit(1.0)).alias("short"))
    assert df.first()["below_zero"] is None and df.first()["short"] == pytest.approx(1.35)
    notes = spark.range(1).select(P.vol_notes(F.lit(0.85), F.lit(3), F.lit(40.0), F.lit(3.0), F.lit("nearest"), F.lit(True)).alias("n")).first().n
    assert notes == ["expected_move", "near_tenor_inverted", "event_near"]  # a rank of exactly 0.85 isn't high


def test_events_of_today_are_over_at_new_yorks_hours(spark):
    """In summer New York is four hours behind, in winter five; late in its evening the UTC date is tomorrow's."""
    from tidemark.operators import joins as J

    t = dt.datetime
    events = [("b", t(2024, 7, 10), "before"), ("a", t(2024, 7, 10), "AFTER"), ("n", t(2024, 7, 10), None), ("w", t(2024, 1, 10), "Before"), ("two", t(2024, 7, 8), None), ("two", t(2024, 7, 12), None)]
    points = [
        (1, "b", t(2024, 7, 10, 13, 29)), (2, "b", t(2024, 7, 10, 13, 30)), (3, "a", t(2024, 7, 10, 19, 59)), (4, "a", t(2024, 7, 10, 20, 0)), (5, "n", t(2024, 7, 11, 3, 30)), (6, "n", t(2024, 7, 11, 4, 30)),
        (7, "w", t(2024, 1, 10, 14, 29)), (8, "w", t(2024, 1, 10, 14, 30)), (9, "two", t(2024, 7, 10, 12, 0)), (10, "two", t(2024, 7, 23, 12, 0)), (11, "none", t(2024, 7, 10)),
    ]
    got = {r.i: (r.days, r.uncertain) for r in J.event_proximity(spark.createDataFrame(points, "i int, symbol string, ts timestamp_ntz"), spark.createDataFrame(events, "symbol string, ts timestamp_ntz, pub_type string"), ["i"]).collect()}
    assert got == {1: (0, False), 2: (-1, False), 3: (0, False), 4: (-1, False), 5: (0, True), 6: (-1, False), 7: (0, False), 8: (-1, False), 9: (-2, False)}
