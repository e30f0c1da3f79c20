"""Queries of scans, sources and merges."""

from pyspark.sql import functions as F

from tidemark.operators import scans as S
from tidemark.plans.registry import query
from tidemark.sources import canonical as K
from tidemark.sources.canonical import BARS_1D, BARS_1H, DERIV, REGISTRY, with_

_T = ("symbol", "ts", "open", "high", "low", "close")


@query("o001_get_ohlcv", with_(BARS_1H) + "SELECT symbol, ts, open, high, low, close, CAST(volume AS BIGINT) AS volume FROM bars_1h QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 120")
def o001(spark, d):
    return S.latest_n(K.bars_1h(spark, d), ["symbol"], 120).select(*_T, "volume")


@query("o002_get_daily_since", with_(BARS_1D) + "SELECT symbol, ts, close FROM bars_1d WHERE ts >= TIMESTAMP '1999-01-01'")
def o002(spark, d):
    return S.since(K.bars_1d(spark, d), "1999-01-01").select("symbol", "ts", "close")


@query("o003_get_deriv", with_(DERIV) + "SELECT symbol, ts, event_id, funding, oi, mark, kind FROM deriv QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 50")
def o003(spark, d):
    return S.latest_n(K.deriv(spark, d), ["symbol"], 50)


@query("o004_get_deriv_col", with_(DERIV) + "SELECT symbol, ts, funding FROM deriv WHERE funding IS NOT NULL AND (kind = 'settled' OR (kind IS NULL AND least(epoch_ms(ts) % 28800000, 28800000 - epoch_ms(ts) % 28800000) < 60000)) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 30")
def o004(spark, d):
    return S.latest_non_null(K.deriv(spark, d), ["symbol"], "funding", 30, grid_hours=8).select("symbol", "ts", "funding")


@query("o005_by_source", "SELECT event_type AS source, ts, user_id, value FROM events WHERE event_type = 'view'")
def o005(spark, d):
    return K.table(spark, d, "events").where("event_type = 'view'").select(F.col("event_type").alias("source"), "ts", "user_id", "value")


@query("o006_latest_curve", "SELECT user_id, ts, value FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 5")
def o006(spark, d):
    return S.latest_n(K.table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "ts", "value"), ["user_id"], 5)


@query("o007_get_vol1h", with_(BARS_1H) + "SELECT symbol, ts, CAST(volume AS BIGINT) AS volume FROM bars_1h WHERE ts >= TIMESTAMP '2024-01-15'")
def o007(spark, d):
    return S.since(K.bars_1h(spark, d), "2024-01-15").select("symbol", "ts", "volume")


@query("o008_states_audit", "SELECT event_id, event_type AS state, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def o008(spark, d):
    parsed = F.from_json("props", "k int", {"mode": "PERMISSIVE"})
    return K.table(spark, d, "events").select("event_id", F.col("event_type").alias("state"), parsed["k"].alias("k"))


@query("o009_setup_history", with_(BARS_1H) + "SELECT s.symbol, s.ts, s.close, (SELECT max(b.ts) FROM bars_1h b WHERE b.symbol = s.symbol) AS series_ts FROM bars_1h s WHERE s.close > s.open")
def o009(spark, d):
    b = K.bars_1h(spark, d)
    return S.with_series_end(b.where("close > open").select("symbol", "ts", "close"), b)


@query("o010_live_bar", with_(BARS_1H) + "SELECT symbol, max(ts) AS ts, arg_max(close, ts) AS close FROM bars_1h GROUP BY symbol")
def o010(spark, d):
    return S.latest_row(K.bars_1h(spark, d), ["symbol"], "ts", ["close"])


@query("o011_last_source", "SELECT user_id, arg_max(event_type, ts) AS source FROM events GROUP BY user_id")
def o011(spark, d):
    return S.last_source(K.table(spark, d, "events").withColumnRenamed("event_type", "source"), ["user_id"])


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("o012_catalog", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows, (SELECT string_agg(column_name, ',' ORDER BY ordinal_position) FROM information_schema.columns WHERE table_name = '{t}') AS columns FROM {t}" for t in _TABLES))
def o012(spark, d):
    return S.catalog({t: K.table(spark, d, t) for t in _TABLES})


@query("o012_symbols", "SELECT DISTINCT event_type AS symbol FROM events")
def o012b(spark, d):
    return K.table(spark, d, "events").select(F.col("event_type").alias("symbol")).distinct()


@query("o013_coverage", with_(DERIV) + "SELECT symbol, count(oi) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM deriv GROUP BY symbol")
def o013(spark, d):
    return S.coverage(K.deriv(spark, d), ["symbol"], "oi")


@query("o014_adhoc_sql", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def o014(spark, d):
    K.table(spark, d, "nation").createOrReplaceTempView("tm_nation")
    K.table(spark, d, "region").createOrReplaceTempView("tm_region")
    return S.checked_sql(spark, "SELECT n_name, r_name FROM tm_nation JOIN tm_region ON n_regionkey = r_regionkey;", ["tm_nation", "tm_region"])


@query("o018_pair_symbol", "SELECT n_name, CASE WHEN regexp_matches(p, '(USDT|USDC|USD)$') THEN regexp_replace(p, '(USDT|USDC|USD)$', '') || '-' || regexp_extract(p, '(USDT|USDC|USD)$', 1) ELSE p || '-USDT' END AS pair FROM (SELECT n_name, upper(regexp_replace(CASE WHEN n_nationkey % 2 = 0 THEN n_name || '/usd' ELSE n_name END, '[-_/ ]', '', 'g')) AS p FROM nation)")
def o018(spark, d):
    loose = F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit("/usd"))).otherwise(F.col("n_name"))
    return K.table(spark, d, "nation").select("n_name", S.pair_symbol(loose, sep="-").alias("pair"))


@query("o023_breadth", "SELECT date_trunc('day', ts) AS ts, count(*) FILTER (x > 0) AS up, count(*) FILTER (x < 0) AS down, count(*) FILTER (x = 0) AS flat, count(*) FILTER (x >= 10) AS tail_hi, count(*) FILTER (x <= -10) AS tail_lo FROM (SELECT ts, round(value - 10, 0) AS x FROM events) GROUP BY 1")
def o023(spark, d):
    x = K.table(spark, d, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), F.round(F.col("value") - 10, 0).alias("x"))
    return x.groupBy("ts").agg(F.count_if(F.col("x") > 0).alias("up"), F.count_if(F.col("x") < 0).alias("down"), F.count_if(F.col("x") == 0).alias("flat"), F.count_if(F.col("x") >= 10).alias("tail_hi"), F.count_if(F.col("x") <= -10).alias("tail_lo"))


@query("o025_route_source", """WITH c AS (SELECT 'u' || (user_id % 40) AS symbol, event_type AS source, count(*) AS n_bars, count(*) % 7 = 0 AS has_gap, ascii(event_type) AS pos FROM events GROUP BY 1, 2)
SELECT symbol, source, n_bars FROM c WHERE NOT has_gap QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n_bars >= 55 DESC, CASE WHEN n_bars >= 55 THEN pos END NULLS FIRST, n_bars DESC, pos) = 1""")
def o025(spark, d):
    e = K.table(spark, d, "events").groupBy(F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("symbol"), F.col("event_type").alias("source"))
    c = e.agg(F.count(F.lit(1)).alias("n_bars")).withColumn("has_gap", F.col("n_bars") % 7 == 0).withColumn("pos", F.ascii("source"))
    return S.route(c, 55)


_LOADS = "SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, event_id AS seq, CASE WHEN event_type = 'click' THEN value END AS a, CASE WHEN event_type = 'view' THEN value END AS b, event_id AS known_at FROM events"


def _loads(spark, d):
    e = K.table(spark, d, "events")
    return e.select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", F.col("value")).alias("a"), F.when(F.col("event_type") == "view", F.col("value")).alias("b"), F.col("event_id").alias("known_at"))


@query("o026_upsert_overwrite", f"SELECT user_id, ts, seq, a, b, known_at FROM ({_LOADS}) QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY seq DESC) = 1")
def o026a(spark, d):
    return S.merge_overwrite(_loads(spark, d), ["user_id", "ts"], "seq")


@query("o026_upsert_first", f"SELECT user_id, ts, seq, a, b, known_at FROM ({_LOADS}) QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY seq) = 1")
def o026b(spark, d):
    return S.merge_first(_loads(spark, d), ["user_id", "ts"], "seq")


@query("o026_upsert_coalesce", f"SELECT user_id, ts, arg_max(a, seq) FILTER (a IS NOT NULL) AS a, arg_max(b, seq) FILTER (b IS NOT NULL) AS b, arg_min(known_at, seq) AS known_at FROM ({_LOADS}) GROUP BY user_id, ts")
def o026c(spark, d):
    return S.merge_coalesce(_loads(spark, d), ["user_id", "ts"], "seq", first_known=("known_at",))


@query("o027_snapshot_universe", "SELECT count(*) AS n, sha256(string_agg('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}', chr(10) ORDER BY '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}')) AS sha FROM nation")
def o027(spark, d):
    return S.snapshot_hash(K.table(spark, d, "nation"))


@query("o028_record_experiment", "SELECT substr(sha256(n_name || '|' || n_regionkey), 1, 12) AS id, n_name AS metrics FROM nation WHERE n_nationkey % 2 = 1")
def o028(spark, d):
    every = K.table(spark, d, "nation").select(S.ledger_id(F.col("n_name"), F.col("n_regionkey").cast("string")).alias("id"), F.col("n_name").alias("metrics"), "n_nationkey")
    return S.ledger_insert(every.where("n_nationkey % 2 = 0").select("id", "metrics"), every.select("id", "metrics"))


@query("o121_source_stickiness", "WITH l AS (SELECT user_id AS symbol, arg_max(event_type, ts) AS s FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1) SELECT user_id AS symbol, ts, event_type AS source FROM events LEFT JOIN l ON user_id = symbol WHERE ts >= TIMESTAMP '2024-01-20' AND (s IS NULL OR s = event_type)")
def o121(spark, d):
    e = K.table(spark, d, "events").select(F.col("user_id").alias("symbol"), "ts", F.col("event_type").alias("source"))
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    return S.sticky_source(e.where(F.col("ts") >= cut), e.where(F.col("ts") < cut))


@query("o115_panel_members", with_(REGISTRY) + "SELECT symbol FROM registry WHERE class IN ('crypto', 'commodity') AND pool = 'core'")
def o115(spark, d):
    return K.registry(spark, d).where(F.col("class").isin("crypto", "commodity") & (F.col("pool") == "core")).select("symbol")


@query("o116_iv_symbols", with_(REGISTRY) + "SELECT symbol FROM registry WHERE class = 'us_stock_perp' OR symbol LIKE 'C%'")
def o116(spark, d):
    return K.registry(spark, d).where((F.col("class") == "us_stock_perp") | F.col("symbol").startswith("C")).select("symbol")
