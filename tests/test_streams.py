"""Streams over several batches with late rows, scans with versions and budgets, snapshots under writers."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import coupling as C
from tidemark.streaming import ops as S
from tidemark.streaming import pairs as P
from tidemark.streaming import tables as V

T0 = dt.datetime(2024, 1, 1)


# ---------------------------------------------------------------- the pair machine


def test_the_pair_stream_is_the_pair_fold(spark):
    """Six batches with late rows against the fold over the whole: every joint bar that the watermark has passed, to the last bit."""
    rng = np.random.default_rng(4)
    n = 1500
    common = rng.standard_normal(n)
    mix = {"a": 0.1, "b": 0.2, "c": 0.9}
    rows = []
    for name, own in mix.items():
        broken = np.where((np.arange(n) > 700) & (np.arange(n) < 1000), 1.5, own)
        r = common * (1 - own) + broken * rng.standard_normal(n)
        rows += [(name, T0 + dt.timedelta(hours=i), None if rng.random() < 0.05 else float(r[i])) for i in range(n) if rng.random() > 0.03]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, r double")
    p = C.Params(window=120, least=40, enter=0.8, enter_strong=0.8, floor=0.05, floor_strong=0.05, q_high=0.4, gained=0.3, lost=0.05, timeout=150)
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "a string, b string")
    out = S.work_dir(spark)
    with P.rocksdb(spark):
        got = S.run(P.pair_states(S.in_files(df, f"{out}/in", late_seconds=6 * 3600), pairs, p, 20.0, 200.0, late="6 hours"), out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = {(r.a, r.b, r.ts): tuple(r)[3:] for r in C.pair_states(C.pair_rho(df, fast=20.0, slow=200.0), p).collect()}
    last = T0 + dt.timedelta(hours=n - 1) - dt.timedelta(hours=6)
    have = {(r.a, r.b, r.ts): tuple(r)[3:] for r in got.collect()}
    due = {k for k in want if k[2] < last}
    assert due <= have.keys() <= want.keys()
    same = lambda u, v: all(x == y or (x != x and y != y) for x, y in zip(u, v, strict=True))  # noqa: E731  nan is the same as nan
    assert all(same(have[k], want[k]) for k in have)
    assert {v[4] for v in have.values()} >= {"init_anchor", "confirmed"} and len({v[2] for v in have.values()}) >= 4


def test_files_by_time_with_late_rows(spark):
    df = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=i)) for i in range(600)], "i int, ts timestamp_ntz")
    folder = f"{S.work_dir(spark)}/in"
    stream = S.in_files(df, folder)
    files = [[r.i for r in spark.read.parquet(f).collect()] for f in sorted(spark.read.parquet(folder).inputFiles())]
    assert sorted(i for f in files for i in f) == list(range(600)) and len(files) == 6 and stream.isStreaming
    assert sum(bool(f) and min(f) % 100 >= 70 for f in files) >= 4  # each begins with rows of the time before


# ---------------------------------------------------------------- scans

BARS = [("a", 5), ("b", 9), ("c", 0), ("d", 3)]


def bars_of(spark, counts=BARS):
    return spark.createDataFrame([(s, T0 + dt.timedelta(hours=k)) for s, n in counts for k in range(n)], "symbol string, ts timestamp_ntz")


def hours(rows):
    return sorted((r.symbol, int((r.ts - T0).total_seconds() // 3600)) for r in rows)


def new_scans(spark):
    return V.Scans(spark, f"{S.work_dir(spark)}/scans")


def test_a_version_scans_anew_and_a_broken_scan_changes_nothing(spark):
    scans, bars = new_scans(spark), bars_of(spark)
    assert scans.results().count() == 0 and scans.marks("r1").count() == 0
    at = scans.replace(scans.tables.pin(), bars, bars.where("hour(ts) % 2 = 0").withColumn("x", F.hour("ts")), "r1")
    assert {r.symbol: r.through.hour for r in scans.marks("r1").collect()} == {"a": 4, "b": 8, "d": 2}
    assert scans.marks("r2").count() == 0  # a new version has scanned nothing
    some = bars.where("symbol = 'b'")
    with pytest.raises(Exception, match="wasn't processed"):
        scans.replace(at, some, bars, "r2")
    with pytest.raises(Exception, match="before the last"):
        scans.replace(at, some, some, "r2", through=spark.createDataFrame([("b", T0)], "symbol string, through timestamp_ntz"))
    with pytest.raises(Exception, match="twice"):
        scans.replace(at, some, some.union(some), "r2")
    assert scans.tables.pin().number == 1 and {r.version for r in scans.results().collect()} == {"r1"}
    later = spark.createDataFrame([("b", T0 + dt.timedelta(hours=20)), ("e", T0)], "symbol string, through timestamp_ntz")
    at = scans.replace(at, some, some.where("hour(ts) = 3"), "r2", through=later)
    got = scans.results(at).collect()
    assert hours(got) == [("a", 0), ("a", 2), ("a", 4), ("b", 3), ("d", 0), ("d", 2)]  # what the old rules had at b is gone
    assert {r.symbol: (r.through - T0).total_seconds() / 3600 for r in scans.marks("r2", at).collect()} == {"b": 20, "e": 0}
    after = scans.compact(at)
    assert hours(scans.results(after).collect()) == hours(got) and scans.marks("r1", after).count() == 3
    assert [len(v) for v in after.folders.values()] == [1, 1]
    again = scans.replace(after, some, some.where("false"), "r2")
    assert [r for r in hours(scans.results(again).collect()) if r[0] == "b"] == []


def test_a_pinned_reader_sees_no_writer_and_of_two_writers_one_wins(spark):
    scans, bars = new_scans(spark), bars_of(spark)
    at = scans.replace(scans.tables.pin(), bars, bars.where("symbol = 'a'"), "r1", {"start": 2})
    scans.replace(at, bars, bars.where("symbol = 'b'"), "r1")
    with pytest.raises(V.Conflict):
        scans.replace(at, bars, bars.where("symbol = 'd'"), "r1")
    scans.compact(scans.tables.pin())
    assert {r.symbol for r in scans.results(at).collect()} == {"a"} and {r.symbol for r in scans.results().collect()} == {"b"}
    assert at.facts == scans.tables.pin().facts == {"start": 2}


def plain_cycles(counts, budget, cycles):
    """Rotation and quotas by a loop."""
    order, done, start, seen = sorted(s for s, n in counts if n), dict.fromkeys((s for s, _ in counts), 0), 0, []
    total = dict(counts)
    for _ in range(cycles):
        left, touched = budget, 0
        for s in order[start:] + order[:start]:
            take = min(left, total[s] - done[s])
            done[s], left, touched = done[s] + take, left - take, touched + (take > 0)
        start = (start + touched) % len(order) if touched else start
        seen.append(dict(done))
    return seen


@pytest.mark.parametrize("budget", [1, 4, 30])
def test_cycles_take_turns(spark, budget):
    scans, bars = new_scans(spark), bars_of(spark)
    for want in plain_cycles(BARS, budget, 4):
        V.cycle(scans, bars, lambda todo: todo, "r1", budget)
        got = {r.symbol: r.through.hour + 1 for r in scans.marks("r1").collect()}
        assert got == {s: n for s, n in want.items() if n}
        assert hours(scans.results().collect()) == [(s, k) for s, n in sorted(want.items()) for k in range(n)]  # prefixes only
    if budget == 4:
        assert len(got) == 3  # everyone who has bars has come on


def test_a_cycle_without_new_bars_commits_nothing(spark):
    scans, bars = new_scans(spark), bars_of(spark)
    V.cycle(scans, bars, lambda todo: todo, "r1", 99)
    assert V.cycle(scans, bars, lambda todo: todo, "r1", 99).number == 1
    assert V.cycle(scans, bars.where("false"), lambda todo: todo, "r1", 99).number == 1


# ---------------------------------------------------------------- authority


def test_arrivals_in_any_order_give_one_result(spark, tmp_path):
    rows = [("x", 1, True, 1, 1.0), ("x", 3, False, 2, 30.0), ("x", 2, False, 3, 20.0), ("x", 3, True, 4, 3.0), ("x", 4, False, 5, 4.0), ("y", 1, False, 6, 9.0)]
    want = {("x", 1, 1.0, True), ("x", 3, 3.0, True), ("x", 4, 4.0, False), ("y", 1, 9.0, False)}  # the provisional value of day 2 isn't confirmed
    schema = "name string, day int, official boolean, seq long, value double, ts timestamp"
    for k, order in enumerate(list(itertools.permutations(range(6)))[::143]):
        folder = f"{tmp_path}/{k}"
        for i in order:
            spark.createDataFrame([(*rows[i], T0 + dt.timedelta(seconds=rows[i][3]))], schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")
        kept = S.upsert_latest(stream, ["name", "day", "official"], S.work_dir(spark))
        got = V.confirmed(kept, ["name"], "day", F.col("official"), "value", "seq").collect()
        assert {(r.name, r.day, r.value, r.official) for r in got} == want
        assert {r.confirmed_through for r in got if r.name == "x"} == {3}
