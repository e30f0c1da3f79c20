"""Queries of incremental loads and of the zone steps one by one."""

from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import ingest as I
from tidemark.operators import zones as Z
from tidemark.plans.registry import query
from tidemark.sources import canonical as K
from tidemark.sources import derivatives as D
from tidemark.sources import pages as pages_of
from tidemark.sources import replay
from tidemark.sources.canonical import BARS_1H, REGISTRY, with_
from tidemark.streaming import ops as S
from tidemark.streaming import tables as V


@query("o024_demo_series")
def o024(spark, d):
    return replay.demo(spark)


@query("o427_index_authority", "SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_type = 'view' DESC, event_id DESC) = 1")
def o427(spark, d):
    e = K.table(spark, d, "events").select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_id", "value", (F.col("event_type") == "view").alias("official"))
    return I.by_authority(e, ["user_id", "day"], "official", "event_id").drop("official")


@query("o428_prune_future_events", "WITH f AS (SELECT user_id, ts FROM events WHERE event_type = 'error' AND user_id % 3 = 0 AND event_id % 2 = 0) SELECT user_id, ts FROM events e WHERE event_type = 'error' AND (ts <= TIMESTAMP '2024-01-20' OR user_id NOT IN (SELECT user_id FROM f) OR EXISTS (SELECT 1 FROM f WHERE f.user_id = e.user_id AND f.ts = e.ts))")
def o428(spark, d):
    e = K.table(spark, d, "events").where("event_type = 'error'").select("user_id", "ts", "event_id")
    fresh = e.where("user_id % 3 = 0 and event_id % 2 = 0").select("user_id", "ts")
    return I.prune_future(e.select("user_id", "ts"), fresh, ["user_id", "ts"], "user_id", F.lit("2024-01-20").cast("timestamp_ntz"))


@query("o429_build_group", with_(REGISTRY) + "SELECT symbol FROM (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS i FROM registry) WHERE i % 10 = 3")
def o429(spark, d):
    return I.round_robin(K.registry(spark, d).select("symbol"), "symbol", 10, 13)


@query("o429_blocked_symbols", "WITH r AS (SELECT user_id % 40 AS symbol, day(ts) AS run, value > 40 AS ok FROM events), alive AS (SELECT run FROM r GROUP BY run HAVING bool_or(ok)), f AS (SELECT symbol, run FROM r SEMI JOIN alive USING (run) GROUP BY symbol, run HAVING NOT bool_or(ok)) SELECT symbol, count(*) AS fails FROM f GROUP BY symbol HAVING count(*) >= 2")
def o429b(spark, d):
    r = K.table(spark, d, "events").select((F.col("user_id") % 40).alias("symbol"), F.dayofmonth("ts").alias("run"), (F.col("value") > 40).alias("ok"))
    return I.blocked(r, "symbol", "run", "ok")


_TWO_CYCLES = """, n AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM bars_1h), c AS (SELECT symbol, max(k) AS new, row_number() OVER (ORDER BY symbol) - 1 AS i, count(*) OVER () AS of FROM n GROUP BY symbol),
one AS (SELECT *, greatest(0, least(new, 800 - (sum(new) OVER (ORDER BY i) - new))) AS q1 FROM c), turned AS (SELECT *, new - q1 AS rest, (i - count(*) FILTER (q1 > 0) OVER () % of + of) % of AS place FROM one),
two AS (SELECT *, greatest(0, least(rest, 800 - (sum(rest) OVER (ORDER BY place) - rest))) AS q2 FROM turned) SELECT symbol, ts, round(close, 6) AS close FROM n JOIN two USING (symbol) WHERE k <= q1 + q2 AND close < 6"""


@query("o426_scan_budget", with_(BARS_1H) + _TWO_CYCLES)
def o426(spark, d):
    """What two cycles of 800 bars find: the second begins where the first has come to."""
    bars = K.bars_1h(spark, d).select("symbol", "ts", "close")
    scans = V.Scans(spark, f"{S.work_dir(spark)}/scans")
    for _ in range(2):
        V.cycle(scans, bars, lambda todo: todo.join(bars, ["symbol", "ts"]).where("close < 6"), "r1", 800)
    return scans.results().select("symbol", "ts", F.round(F.get_json_object("found", "$.close").cast("double"), 6).alias("close"))


def _summary(spark, d):
    return Z.summary(K.bars_1h(spark, d))


@query("o502_pivot_clusters")
def o502(spark, d):
    """Groups of every series' pivot highs."""
    c = _summary(spark, d).where("atr > 0").select("symbol", F.posexplode(Z.clusters(F.col("highs"), F.col("atr"))).alias("cluster", "c"))
    price = F.transform("c", lambda m: m["price"])
    return c.select("symbol", "cluster", F.size("c").cast("long").alias("n"), (F.array_max(price) - F.array_min(price)).alias("span"))


@query("o503_pivot_zone", with_(BARS_1H) + ", t AS (SELECT * FROM bars_1h QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 3), g AS (SELECT symbol, min(high) AS a, max(high) AS b FROM t GROUP BY symbol) SELECT symbol, round(a - p, 6) AS lo, round(b + p, 6) AS hi FROM (SELECT *, greatest(0, least(greatest(b - a, 10.0::DOUBLE), 30.0::DOUBLE) - (b - a)) / 2 AS p FROM g)")
def o503(spark, d):
    from tidemark.operators.scans import latest_n

    last = latest_n(K.bars_1h(spark, d).select("symbol", "ts", "high"), ["symbol"], 3).groupBy("symbol").agg(F.collect_list(F.struct(F.col("high").alias("price"), F.lit(0).alias("bar"), "ts")).alias("c"))
    z = last.select("symbol", Z.of_cluster(F.col("c"), F.lit("pivot_high"), F.lit("resistance"), F.lit(20.0)).alias("z"))
    return z.select("symbol", F.round("z.lo", 6).alias("lo"), F.round("z.hi", 6).alias("hi"))


@query("o506_merged_cluster_roles")
def o506(spark, d):
    """What zones are merged of."""
    bars = K.bars_1h(spark, d)
    z = Z.levels(bars, bars).select("symbol", F.explode("zones").alias("z"))
    return z.select("symbol", "z.lo", "z.role", "z.kinds", F.size("z.members").alias("members"))


@query("o507_resolved_overlaps")
def o507(spark, d):
    bars = K.bars_1h(spark, d)
    return Z.extract_levels(bars, bars).select("symbol", "lo", "hi", "overflow")


@query("o508_pivot_touches")
def o508(spark, d):
    bars = K.bars_1h(spark, d)
    return Z.extract_levels(bars, bars).where("touches > 0").select("symbol", "mid", "touches", "established_ts", "last_touch_bars")


# ---------------------------------------------------------------- stored pages


@query("o020_index_history_pages", "SELECT o_orderpriority AS name, o_orderdate::TIMESTAMP AS ts, round(o_totalprice, 2) AS close FROM orders WHERE o_orderkey % 10 <> 0")
def o020(spark, d):
    """A page of CSV for each priority, made of the orders; every tenth line has no number."""
    o = K.table(spark, d, "orders")
    line = F.concat_ws(",", F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit("1.0"), F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.format_string("%.2f", F.col("o_totalprice"))))
    pages = o.groupBy(F.col("o_orderpriority").alias("name")).agg(F.concat(F.lit("Date,Open,Close\r\n"), F.array_join(F.collect_list(line), "\r\n")).alias("text"))
    return pages_of.index_history(pages).select("name", "ts", F.round("close", 2).alias("close"))


@query("o020_chart_pages", with_(BARS_1H) + "SELECT symbol, ts, open, high, low, close, volume::DOUBLE AS volume FROM bars_1h")
def o020b(spark, d):
    """The hourly bars as pages of chart JSON, and read again."""
    b = K.bars_1h(spark, d).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), "open", "high", "low", "close", F.col("volume").cast("double").alias("volume")))).alias("b"))
    of = lambda n: F.transform("b", lambda x: x[n]).alias(n)
    quote = F.struct(*[of(n) for n in ("open", "high", "low", "close", "volume")])
    result = F.struct(F.transform("b", lambda x: x["s"]).alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    pages = b.select("symbol", F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("text"))
    return pages_of.chart(pages)


@query("o022_option_mark_pages", "SELECT 'U' || (user_id % 12) AS underlying, DATE '2024-03-29' AS expiry, (80 + event_id % 23)::DOUBLE AS strike, CASE WHEN event_id % 2 = 0 THEN 'C' ELSE 'P' END AS kind, CASE WHEN event_id % 5 <> 0 THEN round(value, 4) END AS iv FROM events WHERE value > 0.01 AND event_id % 7 <> 0")
def o022(spark, d):
    """Pages of marks, some without a volatility, some with a name that is none."""
    e = K.table(spark, d, "events").where("value > 0.01")
    k = F.col("event_id")
    name = F.when(k % 7 == 0, F.concat(F.lit("X"), k.cast("string"))).otherwise(F.concat_ws("-", F.concat(F.lit("U"), (F.col("user_id") % 12).cast("string")), F.lit("240329"), (80 + k % 23).cast("string"), F.when(k % 2 == 0, "C").otherwise("P")))
    mark = F.struct(name.alias("symbol"), F.when(k % 5 == 0, "-1").otherwise(F.col("value").cast("string")).alias("markIV"))
    pages = e.groupBy((k % 50).alias("page")).agg(F.to_json(F.collect_list(mark)).alias("text"))
    return pages_of.option_marks(pages).select("underlying", "expiry", "strike", "kind", F.round("iv", 4).alias("iv"))


# ---------------------------------------------------------------- derivatives

_SETTLED = """b AS (SELECT event_type AS symbol, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '1970-01-01') ELSE time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') END AS b, count(*) AS n, max(value) / 10000 AS rate FROM events GROUP BY 1, 2),
settled AS (SELECT symbol, b + (n % 20) * INTERVAL 1 SECOND AS ts, rate, round((epoch(b) + n % 20) / 60) * 60 AS slot FROM b WHERE (epoch(b)::BIGINT // 14400) % 11 <> 0),
step AS (SELECT *, (slot - lag(slot) OVER w) / 3600 AS step FROM settled WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
iv AS (SELECT symbol, ts, rate, CASE WHEN step IN (1, 2, 4, 8) AND (step = lag(step) OVER w OR step = lead(step) OVER w) THEN step END AS hours FROM step WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


def _funding(spark, d):
    """Settled rates every 8, later every 4 hours, some seconds late, some missing; and a predicted rate with every event."""
    e = K.table(spark, d, "events").withColumn("symbol", F.col("event_type"))
    slot = F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), B.bucket(F.col("ts"), 28_800)).otherwise(B.bucket(F.col("ts"), 14_400))
    s = e.groupBy("symbol", slot.alias("b")).agg(F.count(F.lit(1)).alias("n"), (F.max("value") / 10_000).alias("funding"))
    s = s.where(F.floor(F.unix_seconds(F.col("b").cast("timestamp")) / 14_400) % 11 != 0)
    s = s.select("symbol", (F.col("b") + F.make_dt_interval(secs=F.col("n") % 20)).alias("ts"), "funding", F.lit("settled").alias("kind"))
    return s.union(e.select("symbol", "ts", (F.col("value") / 20_000).alias("funding"), F.lit("pred").alias("kind")))


@query("o021_settlements", with_(_SETTLED) + "SELECT symbol, ts, round(rate, 8) AS rate, hours, round(rate * 8760 / hours, 7) AS per_year FROM iv")
def o021(spark, d):
    return D.settlements(_funding(spark, d)).withColumns({"rate": F.round("rate", 8), "per_year": F.round("per_year", 7)})


@query("o021_settled_over_predicted", with_(_SETTLED) + """, ahead AS (SELECT e.event_type AS symbol, e.ts, e.value / 20000 AS rate, iv.ts AS next, iv.hours FROM events e ASOF LEFT JOIN iv ON e.event_type = iv.symbol AND e.ts <= iv.ts)
SELECT symbol, ts, round(rate, 8) AS rate, 'settled' AS kind FROM iv UNION ALL SELECT symbol, ts, round(rate, 8), 'pred' FROM ahead WHERE NOT coalesce(floor(epoch(next)) - floor(epoch(ts)) = 0 OR floor(epoch(next)) - floor(epoch(ts)) < hours * 3600, false)""")
def o021b(spark, d):
    rows = _funding(spark, d)
    return D.rates(rows, D.settlements(rows)).withColumn("rate", F.round("rate", 8))


@query("o021_history_pages", """WITH e AS (SELECT event_type AS symbol, date_trunc('second', ts) AS ts, event_id, round(value, 6) AS v, event_id % 4 AS what FROM events), p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS back FROM e WHERE what = 3)
SELECT symbol, ts, max(v) FILTER (what = 1) AS oi, max(round(v * 2, 6)) FILTER (what = 1) AS oi_notional, max(v) FILTER (what = 0) AS funding, CASE WHEN count(*) FILTER (what = 0) > 0 THEN 'settled' END AS kind, max(v) FILTER (what = 3) AS premium, max(v) FILTER (what = 2) AS taker_ratio
FROM (SELECT symbol, ts, v, what FROM e WHERE what < 3 UNION ALL SELECT symbol, ts, v, what FROM p WHERE back > 1) GROUP BY symbol, ts""")
def o021c(spark, d):
    """Histories written as the pages of four interfaces, and read again."""
    e = K.table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), "event_id", F.round("value", 6).alias("v"), (F.col("event_id") % 4).alias("what"))
    ms, text = (F.col("s") * 1000), F.col("v").cast("string")
    row = {
        "funding": F.struct(ms.alias("fundingTime"), text.alias("fundingRate")), "interest": F.struct(ms.alias("timestamp"), text.alias("sumOpenInterest"), F.round(F.col("v") * 2, 6).cast("string").alias("sumOpenInterestValue")),
        "ratio": F.struct(ms.alias("timestamp"), text.alias("buySellRatio")), "premium": F.array(ms.cast("string"), F.lit("0"), F.lit("0"), F.lit("0"), text),
    }
    pages = None
    for k, (what, value) in enumerate(row.items()):
        page = e.where(F.col("what") == k).groupBy("symbol").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("s", "event_id", value.alias("x")))), lambda r: r["x"])).alias("text")).select("symbol", F.lit(what).alias("what"), "text")
        pages = page if pages is None else pages.union(page)
    return D.merged(D.histories(pages))
