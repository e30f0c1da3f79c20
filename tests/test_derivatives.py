"""Pages of perpetual futures, settlement intervals, and what settles predicted rates."""

import datetime as dt
import json

import pytest

from tidemark.sources import derivatives as D

T0 = dt.datetime(2024, 1, 1)
ROWS = "symbol string, ts timestamp_ntz, funding double, kind string"


def at(hours, seconds=0):
    return T0 + dt.timedelta(hours=hours, seconds=seconds)


def settled(spark, hours, symbol="s"):
    return spark.createDataFrame([(symbol, at(h, k % 7), 0.001 * (k + 1), "settled") for k, h in enumerate(hours)], ROWS)


@pytest.mark.parametrize(
    ("hours", "want"),
    [
        ([0, 8, 16, 24], [None, 8, 8, 8]),
        ([0, 4, 8, 16, 20, 24], [None, 4, 4, None, 4, 4]),  # one is missing: its step is known for no interval
        ([0, 8, 16, 20, 24], [None, 8, 8, 4, 4]),  # the interval has changed
        ([0, 8], [None, None]),
        ([0, 3, 6, 9], [None] * 4),
        ([5], [None]),
    ],
)
def test_intervals_from_steps(spark, hours, want):
    got = D.settlements(settled(spark, hours)).orderBy("ts").collect()
    assert [r.hours for r in got] == want
    assert [r.per_year for r in got] == [None if h is None else pytest.approx(r.rate * 8760 / h) for r, h in zip(got, want, strict=True)]


def test_what_the_venue_tells_counts_from_then_on(spark):
    told = spark.createDataFrame([("s", at(9), 4), ("s", at(20), None), ("x", at(0), 1)], "symbol string, ts timestamp_ntz, hours int")
    got = D.settlements(settled(spark, [0, 8, 16, 24]), told).orderBy("ts").collect()
    assert [r.hours for r in got] == [None, 8, 4, 4]


def test_predicted_rates_are_replaced_by_what_was_settled(spark):
    pred = spark.createDataFrame([("s", at(h, x), 9.0, "pred") for h, x in ((-9, 0), (-1, 0), (1, 0), (8, 1), (9, 0), (15, 0), (25, 0))] + [("only", at(1), 9.0, "pred"), ("s", at(2), None, "pred")], ROWS)
    rows = settled(spark, [0, 8, 16]).union(pred)
    got = D.rates(rows, D.settlements(rows)).collect()
    kept = {(r.symbol, r.ts) for r in got if r.kind == "pred"}
    # before the first settlement, whose hours aren't known, and after the last
    assert kept == {("s", at(-9)), ("s", at(-1)), ("s", at(25)), ("only", at(1))}
    assert sum(r.kind == "settled" for r in got) == 3


def test_snapshots_without_what_they_lack(spark):
    index = lambda m, i, f: json.dumps({"markPrice": m, "indexPrice": i, "lastFundingRate": f})
    rows = [
        ("a", T0, index("101", "100", "0.0001"), '{"openInterest": "5"}', '[{"buySellRatio": "1.5"}, {"buySellRatio": "2.5"}]'),
        ("b", T0, index("101", "0", "0.0001"), '{"openInterest": "5"}', None),
        ("c", T0, "no json", '{"openInterest": "5"}', "[]"),
        ("d", T0, index("101", "100", "NaN"), '{"openInterest": "5"}', "[]"),
    ]
    got = {r.symbol: r for r in D.snapshots(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, index string, interest string, ratio string")).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].oi_notional, got["a"].premium, got["a"].taker_ratio, got["a"].kind) == (505.0, pytest.approx(0.01), 2.5, "pred")
    assert got["b"].premium is None and got["b"].taker_ratio is None


def test_forming_bars_and_spoilt_points_are_left_out(spark):
    ms = lambda h: int((at(h) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    pages = [
        ("s", "premium", json.dumps([[ms(0), "0", "0", "0", "0.1"], [ms(1), "0", "0", "0", "0.2"]])),
        ("s", "funding", json.dumps([{"fundingTime": ms(0), "fundingRate": "0.3"}, {"fundingTime": ms(1), "fundingRate": "x"}])),
        ("s", "interest", json.dumps([{"timestamp": ms(0), "sumOpenInterest": "7", "sumOpenInterestValue": "70"}])),
        ("s", "ratio", "broken"),
        ("t", "premium", "[]"),
    ]
    rows = D.histories(spark.createDataFrame(pages, "symbol string, what string, text string"))
    pred = spark.createDataFrame([("s", at(0), 9.0, "pred"), ("s", at(2), 8.0, "pred")], ROWS)
    got = {r.ts: r for r in D.merged(rows.unionByName(pred, allowMissingColumns=True)).collect()}
    assert set(got) == {at(0), at(2)}
    r = got[at(0)]
    assert (r.premium, r.funding, r.kind, r.oi, r.oi_notional, r.taker_ratio) == (0.1, 0.3, "settled", 7.0, 70.0, None)
    assert (got[at(2)].funding, got[at(2)].kind) == (8.0, "pred")
