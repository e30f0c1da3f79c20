"""Prices of 0, long series and large groups: what the smallest tables don't have."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import policy as P
from tidemark.plans import features, ingest, policy, state  # noqa: F401  they register their queries
from tidemark.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def with_zeros(spark, sf, tmp_path_factory):
    """The smallest events, some with a value of 0, as tables of their own; and DuckDB over them."""
    import duckdb

    d = str(tmp_path_factory.mktemp("zeros"))
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.withColumn("value", F.when(F.col("event_id") % 97 == 0, 0.0).otherwise(F.col("value"))).coalesce(1).write.parquet(f"{d}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{d}/events.parquet/*.parquet'")
    return d, c


def rows(found):
    return sorted((tuple(str(v) if not isinstance(v, float) else f"{v:.6f}" for v in r) for r in found))


def held(spark, with_zeros, name):
    d, c = with_zeros
    df = QUERIES[name](spark, d)
    got = rows(df.collect())
    r = c.execute(f"select {', '.join(df.columns)} from ({ORACLES[name]})")
    assert got == rows(r.fetchall())
    return got


def test_a_volatility_of_zero_is_interpolated_where_it_is_a_quote(spark, with_zeros):
    assert any(v == "0.081650" for _, v in held(spark, with_zeros, "o522_interpolate_iv"))
    iv = lambda zero: P.interpolate_iv(F.lit(3.0), F.lit(1.0), F.lit(0.0), F.lit(5.0), F.lit(0.0), zero=zero)
    assert tuple(spark.range(1).select(iv(True), iv(False)).first()) == (0.0, None)


def test_estimators_over_a_price_of_zero(spark, with_zeros):
    assert any("inf" in r or "nan" in r for r in held(spark, with_zeros, "o358_range_estimators"))


def test_log_ratio_by_the_rules_of_floating_point(spark):
    from tidemark.functions import windows as X

    pairs = [(2.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (-1.0, 1.0), (None, 1.0), (1.0, None), (None, 0.0)]
    got = [r[0] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double").orderBy("i").select(X.log_ratio(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [pytest.approx(math.log(2)), math.inf, -math.inf] and math.isnan(got[3]) and got[4:] == [None] * 4


def test_estimator_ranks_over_a_price_of_zero(spark, with_zeros):
    assert held(spark, with_zeros, "o313_estimator_spearman")


def test_settlement_ahead_of_a_long_series_of_predictions(spark):
    """One symbol's predictions, a second apart: each meets the next settlement in one pass, and not in one for each row."""
    import time

    from tidemark.sources import derivatives as D

    t0, n = dt.datetime(2024, 1, 1), 60_000
    pred = spark.range(n).select(F.lit("s").alias("symbol"), (F.lit(t0) + F.make_dt_interval(secs=F.col("id"))).cast("timestamp_ntz").alias("ts"), F.lit(0.1).alias("funding"), F.lit("pred").alias("kind"))
    settled = spark.createDataFrame([("s", t0 + dt.timedelta(hours=h), 0.2, "settled") for h in (1, 2, 3, 15, 16)], "symbol string, ts timestamp_ntz, funding double, kind string")
    data = pred.union(settled).cache()
    data.count()
    began = time.time()
    got = D.rates(data, D.settlements(data)).where("kind = 'pred'").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    took = time.time() - began
    data.unpersist()
    # those of 2 and 3 replace an hour each; of unknown hours are the others, which replace what is at their own times
    assert (got["n"], got["low"], got["high"]) == (n - 7200 - 3, t0, t0 + dt.timedelta(seconds=n - 1))
    assert took < 20


def test_no_batch_of_the_pair_stream_goes_through_the_driver(spark, tmp_path, capsys):
    from tidemark.streaming import ops as S
    from tidemark.streaming import pairs as P

    hours = spark.range(400).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("symbol"), (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(hours=F.floor(F.col("id") / 2).cast("int"))).alias("ts"), (F.col("id") % 7 / 100).alias("r"))
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    with P.rocksdb(spark):
        s = P.pair_states(S.in_files(hours, f"file://{tmp_path}/in", files=2), pairs)
        q = s.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/c").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    capsys.readouterr()
    q.explain()
    plan = capsys.readouterr().out
    assert "TransformWithState" in plan and "BroadcastExchange" not in plan
    assert spark.read.parquet(f"file://{tmp_path}/out").count() > 150


def test_contexts_that_ask_the_same_are_answered_once_and_all(spark):
    """30 000 contexts of two questions to 500 entries: each has its answer, without the library being gone through for each."""
    import time

    from tidemark.operators import retrieval as V

    k = F.col("id")
    none = F.array().cast("array<string>")
    entries = spark.range(500).select(
        F.format_string("p%03d", k).alias("slug"), F.lit("").alias("title"), none.alias("aliases"), F.array(F.when(k % 2 == 0, "A").otherwise("B")).alias("symbols"), none.alias("regimes"), none.alias("classes"), F.lit("active").alias("status"),
        F.lit("").alias("superseded_by"), F.lit("").alias("archive_reason"), F.lit("2024-01-01").alias("updated"), F.repeat(F.lit("l"), 70).alias("line"), F.repeat(F.lit("d"), 90).alias("decision"), F.lit("").alias("archive"),
    )
    subject = F.struct(F.when(k % 3 == 0, "A").otherwise("B").alias("symbol"), F.lit(None).cast("string").alias("class"), F.lit(None).cast("string").alias("bucket"), F.lit(None).cast("array<string>").alias("regimes"))
    contexts = spark.range(30_000).select(k.alias("context_id"), F.when(k % 3 > 0, "symbol").alias("scope"), F.array(subject).alias("subjects"), F.lit(None).cast("string").alias("text"))
    V.retrieve(entries, contexts.limit(2)).collect()
    began = time.time()
    got = V.retrieve(entries, contexts).groupBy((F.col("context_id") % 3 == 0).alias("a"), F.col("index")[0].alias("first"), F.col("expanded")[0]["slug"].alias("shown"), F.size("omitted").alias("n")).agg(F.count_distinct("context_id").alias("contexts")).collect()
    took = time.time() - began
    assert sorted(tuple(r) for r in got) == [(False, "p499", "p499", 248, 20_000), (True, "p498", "p498", 248, 10_000)]
    assert took < 15


def test_pairs_of_a_hot_group_are_not_also_checked_one_by_one(spark, monkeypatch):
    """Near copies of one long text and some other texts: what one bucket connects isn't compared again pair by pair, and no link is lost."""
    import random

    from tidemark.llm import common as C
    from tidemark.llm import simhash as S

    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = r.choices(words, k=300)
    texts = []
    for _ in range(160):
        t = list(base)
        for at in r.sample(range(300), 4):
            t[at] = r.choice(words)
        texts.append(" ".join(t))
    texts += [" ".join(r.choices(words, k=200)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts, plain = {}, C.materialize

    def counted(df, name):
        out = plain(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(C, "materialize", counted)
    kept = {x["doc_id"] for x in S.dedup(docs).collect()}
    # brute force: links by fingerprints within 3 bits, or within 10 bits and shingle sets similar by 0.8
    prints = [S.fingerprint(t.encode()) for t in texts]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for i in range(len(texts)):
        for j in range(i):
            bits, both = (prints[i] ^ prints[j]).bit_count(), len(sets[i] & sets[j])
            pairs += prints[i] != prints[j] and bits <= 10
            if bits <= 3 or (bits <= 10 and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert kept == {i for i in range(len(texts)) if find(i) == i}
    assert pairs > 1000 and counts["simhash-loose"] < len(texts)
