"""Queries of joins, sorts, limits and set operations."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import windows as X
from tidemark.operators import joins as J
from tidemark.operators import scans as S
from tidemark.plans.registry import query
from tidemark.sources import canonical as K
from tidemark.sources.canonical import BARS_1D, BARS_1H, CALENDAR, PANEL_1D, REGISTRY, VOL_DAILY, with_


@query("o201_term_ratio", with_(BARS_1H) + "SELECT a.ts, a.close / b.close AS ratio FROM bars_1h a JOIN bars_1h b ON a.ts = b.ts AND a.symbol = 'view' AND b.symbol = 'click'")
def o201(spark, d):
    b = K.bars_1h(spark, d)
    x, y = b.where("symbol = 'view'").select("ts", F.col("close").alias("a")), b.where("symbol = 'click'").select("ts", F.col("close").alias("b"))
    return x.join(y, "ts").select("ts", (F.col("a") / F.col("b")).alias("ratio"))


_PANEL = ["click", "error", "purchase", "signup", "view"]


@query("o202_wide_panel", with_(BARS_1H) + "SELECT ts, " + ", ".join(f"any_value(close) FILTER (symbol = '{x}') AS {x}" for x in _PANEL) + " FROM bars_1h GROUP BY ts")
def o202(spark, d):
    return K.bars_1h(spark, d).groupBy("ts").pivot("symbol", _PANEL).agg(F.first("close"))


@query("o203_pair_clock", with_(BARS_1H) + "SELECT x.symbol AS a, y.symbol AS b, count(*) AS n FROM bars_1h x JOIN bars_1h y ON x.ts = y.ts AND x.symbol < y.symbol GROUP BY 1, 2")
def o203(spark, d):
    return J.pairs(K.bars_1h(spark, d), value="close").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("o204_asof_join", with_(BARS_1H) + "SELECT e.event_id, b.ts AS matched_ts, b.close FROM (SELECT * FROM events WHERE event_type <> 'view') e ASOF LEFT JOIN (SELECT ts + INTERVAL 1 HOUR AS vis, * FROM bars_1h) b ON e.event_type = b.symbol AND e.ts >= b.vis")
def o204(spark, d):
    b = K.bars_1h(spark, d).withColumn("vis", F.col("ts") + F.make_dt_interval(hours=F.lit(1)))
    e = K.table(spark, d, "events").where("event_type <> 'view'").select("event_id", "ts", F.col("event_type").alias("symbol"))
    return J.asof_join(e, b.withColumnRenamed("ts", "bar_ts"), ["symbol"], ["bar_ts", "close"], right_ts="vis").select("event_id", F.col("bar_ts").alias("matched_ts"), "close")


@query("o205_oi_change", with_(BARS_1H) + "SELECT a.symbol, a.ts, ln(a.close / b.close) AS d4h FROM bars_1h a ASOF JOIN bars_1h b ON a.symbol = b.symbol AND a.ts - INTERVAL 4 HOUR >= b.ts")
def o205(spark, d):
    b = K.bars_1h(spark, d).select("symbol", "ts", "close")
    return J.shifted_asof(b, ["symbol"], "close", 4).where("past is not null").select("symbol", "ts", X.log_ratio(F.col("close"), F.col("past")).alias("d4h"))


@query("o207_interval_attribution", "SELECT event_type AS symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, round(sum(value), 6) AS value, count(*) AS n FROM events GROUP BY 1, 2")
def o207(spark, d):
    e = K.table(spark, d, "events").withColumnRenamed("event_type", "symbol")
    return J.interval_attribution(e, 14_400, "value").withColumn("value", F.round("value", 6))


@query("o208_event_window", with_(CALENDAR) + "SELECT e.event_id, EXISTS (SELECT 1 FROM calendar c WHERE c.symbol = 'u' || e.user_id AND date_diff('day', e.ts::DATE, c.ts::DATE) BETWEEN 0 AND 1) AS in_window FROM events e")
def o208(spark, d):
    e = K.table(spark, d, "events").select("event_id", "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("symbol"))
    return J.event_within(e, K.calendar(spark, d), 1, F.to_date("ts"), F.to_date("ts"), ["symbol"]).select("event_id", "in_window")


@query("o209_nearest_event", with_(CALENDAR) + "SELECT event_id, days FROM (SELECT e.event_id, date_diff('day', e.ts::DATE, c.ts::DATE) AS days FROM events e JOIN calendar c ON c.symbol = 'u' || e.user_id WHERE e.event_type = 'view') QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(days), days) = 1")
def o209(spark, d):
    e = K.table(spark, d, "events").where("event_type = 'view'").select("event_id", "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("symbol"))
    return J.nearest_event(e, K.calendar(spark, d), ["symbol"]).where("days is not null").select("event_id", F.col("days").cast("long").alias("days"))


# the test tables lie within January, when New York is five hours behind
@query("o210_policy_proximity", """WITH ev AS (SELECT DISTINCT 'u' || user_id AS symbol, ts AS event_ts, CASE event_id % 3 WHEN 0 THEN 'BEFORE' WHEN 1 THEN 'AFTER' END AS pub_type FROM events WHERE event_type = 'error'),
p AS (SELECT event_id, 'u' || user_id AS symbol, ts - INTERVAL 5 HOUR AS et FROM events WHERE event_type = 'view'),
c AS (SELECT event_id, event_ts, pub_type, date_diff('day', et::DATE, event_ts::DATE) AS d, hour(et) * 60 + minute(et) AS m FROM p JOIN ev USING (symbol)),
x AS (SELECT event_id, event_ts, pub_type, CASE WHEN d = 0 AND (pub_type = 'BEFORE' AND m >= 570 OR pub_type = 'AFTER' AND m >= 960) THEN -1 ELSE d END AS days, d = 0 AND pub_type IS NULL AS uncertain FROM c)
SELECT event_id, days::INT AS days, event_ts, pub_type, uncertain FROM x WHERE abs(days) <= 10 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(days), days, event_ts, pub_type NULLS FIRST) = 1""")
def o210(spark, d):
    e = K.table(spark, d, "events").withColumn("symbol", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    kind = F.when(F.col("event_id") % 3 == 0, "before").when(F.col("event_id") % 3 == 1, "After")
    calendar = e.where("event_type = 'error'").select("symbol", "ts", kind.alias("pub_type"))
    return J.event_proximity(e.where("event_type = 'view'").select("event_id", "symbol", "ts"), calendar, ["event_id"])


@query("o211_anti_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def o211(spark, d):
    big = K.table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return K.table(spark, d, "customer").select("c_custkey", "c_name").join(big, "c_custkey", "left_anti")


@query("o213_symbol_pairs", with_(REGISTRY) + "SELECT a.symbol AS a, b.symbol AS b FROM registry a JOIN registry b ON a.class = b.class AND a.symbol < b.symbol")
def o213(spark, d):
    r = K.registry(spark, d)
    return r.select(F.col("symbol").alias("a"), "class").join(r.select(F.col("symbol").alias("b"), "class"), "class").where("a < b").select("a", "b")


@query("o214_parameter_grid", with_(BARS_1H) + "SELECT symbol, k, count(*) FILTER (close > open * (1 + k / 10.0)) AS n FROM bars_1h, (VALUES (1), (2), (5)) g(k) GROUP BY 1, 2")
def o214(spark, d):
    b = K.bars_1h(spark, d)
    # a grid of parameters is a list: rows are counted once for each, in one pass
    n = F.array(*[F.struct(F.lit(k).alias("k"), F.count_if(F.col("close") > F.col("open") * (1 + k / 10)).alias("n")) for k in (1, 2, 5)])
    return b.groupBy("symbol").agg(n.alias("g")).select("symbol", F.inline("g"))


@query("o215_registry_defaults", with_(REGISTRY) + "SELECT s_suppkey, coalesce(r.class, 'crypto') AS class, coalesce(r.pool, 'core') AS pool FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM registry WHERE class <> 'crypto') r ON r.symbol = n_name")
def o215(spark, d):
    s, n = K.table(spark, d, "supplier"), K.table(spark, d, "nation")
    r = K.registry(spark, d).where("class <> 'crypto'")
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(r, n["n_name"] == r["symbol"], "left")
    return j.select("s_suppkey", F.coalesce("class", F.lit("crypto")).alias("class"), F.coalesce("pool", F.lit("core")).alias("pool"))


@query("o216_aligned_tail", with_(BARS_1H) + "SELECT a.symbol, count(*) AS n, count(b.ts) AS matched FROM (SELECT symbol, ts FROM bars_1h QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100) a LEFT JOIN (SELECT symbol, ts FROM bars_1h WHERE volume > 1) b ON a.symbol = b.symbol AND a.ts = b.ts GROUP BY 1")
def o216(spark, d):
    b = K.bars_1h(spark, d)
    tail = S.latest_n(b.select("symbol", "ts"), ["symbol"], 100)
    other = b.where("volume > 1").select("symbol", "ts", F.lit(1).alias("m"))
    return tail.join(other, ["symbol", "ts"], "left").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count("m").alias("matched"))


@query("o217_latest_per_key", with_(PANEL_1D) + "SELECT symbol, max(ts) AS ts, arg_max(close, ts) AS close FROM panel GROUP BY symbol")
def o217(spark, d):
    return S.latest_row(K.panel_1d(spark, d), ["symbol"], "ts", ["close"])


@query("o218_successor", "SELECT a.n_name AS name, b.n_name AS successor FROM nation a LEFT JOIN nation b ON a.n_nationkey + 5 = b.n_nationkey")
def o218(spark, d):
    n = K.table(spark, d, "nation")
    after = n.select((F.col("n_nationkey") - 5).alias("n_nationkey"), F.col("n_name").alias("successor"))
    return n.join(after, "n_nationkey", "left").select(F.col("n_name").alias("name"), "successor")


# ---------------------------------------------------------------- sorts, limits, sets


@query("o601_latest_ascending", "SELECT event_id, ts FROM (SELECT event_id, ts FROM events ORDER BY ts DESC LIMIT 200) ORDER BY ts")
def o601(spark, d):
    return K.table(spark, d, "events").select("event_id", "ts").orderBy(F.col("ts").desc()).limit(200).orderBy("ts")


@query("o602_composite_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice NULLS LAST, o_orderkey) AS pos FROM orders")
def o602(spark, d):
    """Every order's place by priority, then price, then key: sorted within its priority, after the counts of the priorities before."""
    o = K.table(spark, d, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    n = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    before = n.select("o_orderpriority", (F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("o_orderpriority")) - F.col("n")).alias("before"))  # a row a priority
    at = F.row_number().over(W.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").asc_nulls_last(), "o_orderkey"))
    return o.join(before, "o_orderpriority").select("o_orderkey", (F.col("before") + at).alias("pos"))


@query("o603_top10", "SELECT event_id, value FROM events ORDER BY abs(value - 10) DESC, event_id LIMIT 10")
def o603(spark, d):
    return K.table(spark, d, "events").orderBy(F.abs(F.col("value") - 10).desc(), "event_id").limit(10).select("event_id", "value")


@query("o604_newest_flips", "SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p <> event_type ORDER BY ts DESC LIMIT 40")
def o604(spark, d):
    e = K.table(spark, d, "events")
    p = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts"))
    return e.withColumn("p", p).where("p <> event_type").orderBy(F.col("ts").desc()).limit(40).select("event_id", "event_type")


@query("o605_top_per_key", with_(VOL_DAILY) + "SELECT symbol, ts FROM vol_daily QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, ts) <= 4")
def o605(spark, d):
    w = W.partitionBy("symbol").orderBy(F.col("volume").desc(), "ts")
    return K.vol_daily(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 4").select("symbol", "ts")


@query("o606_arg_min", "SELECT user_id, first(event_id ORDER BY value, event_id) AS event_id FROM events GROUP BY user_id")
def o606(spark, d):
    return K.table(spark, d, "events").groupBy("user_id").agg(F.min(F.struct("value", "event_id")).alias("m")).select("user_id", "m.event_id")


@query("o611_union_all", "SELECT s_name AS name, 'supplier' AS kind FROM supplier UNION ALL SELECT c_name, 'customer' FROM customer")
def o611(spark, d):
    s = K.table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    return s.unionByName(K.table(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("kind")))


@query("o612_union_distinct", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def o612(spark, d):
    return K.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).union(K.table(spark, d, "customer").select("c_nationkey")).distinct()


@query("o613_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def o613(spark, d):
    return K.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(K.table(spark, d, "orders").select("o_custkey"))


@query("o614_intersection", "SELECT user_id, list_sort(list_intersect(list(DISTINCT event_type), ['view', 'error', 'none'])) AS hits FROM events GROUP BY user_id")
def o614(spark, d):
    g = K.table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))  # five types at most
    return g.select("user_id", F.array_sort(F.array_intersect("s", F.array(*[F.lit(x) for x in ("view", "error", "none")]))).alias("hits"))


@query("o615_ordered_distinct", "SELECT r_name, array_to_string(list_distinct_sorted, ',') AS initials FROM (SELECT r_name, list(c ORDER BY k) AS list_distinct_sorted FROM (SELECT r_name, c, min(k) AS k FROM (SELECT r_name, n_nationkey AS k, substr(n_name, 1, 1) AS c FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY 1, 2) GROUP BY r_name)")
def o615(spark, d):
    n, r = K.table(spark, d, "nation"), K.table(spark, d, "region")
    j = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.substring("n_name", 1, 1).alias("c")))).alias("a"))
    return j.select("r_name", F.array_join(F.array_distinct(F.transform("a", lambda x: x["c"])), ",").alias("initials"))


@query("o616_recursion", "WITH RECURSIVE p(page, lo) AS (SELECT 1, 1000 UNION ALL SELECT page + 1, lo - 100 FROM p WHERE lo > 100) SELECT page, lo FROM p")
def o616(spark, d):
    return spark.sql("WITH RECURSIVE p(page, lo) AS (SELECT 1, 1000 UNION ALL SELECT page + 1, lo - 100 FROM p WHERE lo > 100) SELECT page, lo FROM p")


@query("grouping_sets", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def cube(spark, d):
    return K.table(spark, d, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
