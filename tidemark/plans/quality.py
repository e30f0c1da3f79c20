"""Queries of predicates and data quality."""

from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.operators.bars import resample
from tidemark.plans.registry import query
from tidemark.sources import canonical as K
from tidemark.sources.canonical import BARS_1D, BARS_1H, VOL_DAILY, with_

ASOF = "2024-01-20 00:00:00"


def _ntz(s):
    return F.lit(s).cast("timestamp_ntz")


@query("o101_closed", with_(BARS_1H) + f"SELECT symbol, ts, close FROM bars_1h WHERE ts + INTERVAL 1 HOUR <= TIMESTAMP '{ASOF}'")
def o101(spark, d):
    return Q.closed(K.bars_1h(spark, d), _ntz(ASOF), 3600).select("symbol", "ts", "close")


@query("o102_closed_tail", with_(BARS_1H) + f"SELECT symbol, ts, close FROM bars_1h WHERE ts + INTERVAL 1 HOUR <= TIMESTAMP '{ASOF}' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 400")
def o102(spark, d):
    return Q.closed_tail(K.bars_1h(spark, d), _ntz(ASOF), 3600, 400).select("symbol", "ts", "close")


@query("o103_vol_prefix", with_(BARS_1H) + f"SELECT symbol, ts, CAST(volume AS BIGINT) AS volume FROM bars_1h WHERE ts >= TIMESTAMP '{ASOF}' - INTERVAL 260 HOUR AND ts < TIMESTAMP '{ASOF}'")
def o103(spark, d):
    b = K.bars_1h(spark, d)
    return b.where((F.col("ts") >= _ntz(ASOF) - F.make_dt_interval(hours=F.lit(260))) & (F.col("ts") < _ntz(ASOF))).select("symbol", "ts", "volume")


@query("o104_tail_days", with_(BARS_1D) + "SELECT symbol, ts, close FROM bars_1d QUALIFY ts >= max(ts) OVER (PARTITION BY symbol) - INTERVAL 1095 DAY")
def o104(spark, d):
    return Q.tail_days(K.bars_1d(spark, d), 1095).select("symbol", "ts", "close")


def _shifted(spark, d, years=28):
    """Daily rows moved into the years of the calendar table."""
    return K.bars_1d(spark, d).withColumn("ts", F.col("ts") + F.make_ym_interval(years=F.lit(years)))


_SHIFT = "(SELECT symbol, ts + INTERVAL 28 YEAR AS ts, close FROM bars_1d)"
_HOL = ", ".join(f"'{x}'" for x in Q.HOLIDAYS)
_EARLY = ", ".join(f"'{x}'" for x in Q.EARLY_CLOSES)
_TRADING = f"(year({{0}}) BETWEEN 2025 AND 2027 AND isodow({{0}}) < 6 AND strftime({{0}}, '%Y-%m-%d') NOT IN ({_HOL}))"
_PROBABLE = f"(CASE WHEN year({{0}}) BETWEEN 2025 AND 2027 THEN {_TRADING} ELSE isodow({{0}}) < 6 END)"


@query("o105_settled_only", with_(BARS_1D) + f"SELECT symbol, ts, close FROM {_SHIFT} WHERE {_PROBABLE.format('ts')} AND ts::DATE < DATE '2026-11-25'")
def o105(spark, d):
    return Q.settled_only(_shifted(spark, d), F.lit("2026-11-25 12:00:00").cast("timestamp")).select("symbol", "ts", "close")


@query("o106_trading_day", with_(BARS_1D) + f"SELECT DISTINCT ts, {_TRADING.format('ts')} AS trading, {_PROBABLE.format('ts')} AS probable FROM {_SHIFT}")
def o106(spark, d):
    return _shifted(spark, d).select("ts", Q.is_trading_day(F.col("ts")).alias("trading"), Q.is_probable_trading_day(F.col("ts")).alias("probable")).distinct()


_ET = "(ts + INTERVAL 2 YEAR - INTERVAL 5 HOUR)"  # January: New York is five hours behind
_MIN = f"(hour({_ET}) * 60 + minute({_ET}))"
_CLOSE = f"(CASE WHEN strftime({_ET}, '%Y-%m-%d') IN ({_EARLY}) THEN 780 ELSE 960 END)"


def _moved(spark, d):
    return K.table(spark, d, "events").select("event_id", (F.col("ts") + F.make_ym_interval(years=F.lit(2))).alias("ts"))


@query("o107_is_rth", f"SELECT event_id, {_TRADING.format(_ET)} AND {_MIN} >= 570 AND {_MIN} < {_CLOSE} AS rth FROM events")
def o107(spark, d):
    return _moved(spark, d).select("event_id", Q.is_rth(F.col("ts")).alias("rth"))


_E2 = f"({_ET} + INTERVAL 1 HOUR)"


#: Of a column ts of January, two years later.
FULL_RTH = f"{_TRADING.format(_ET)} AND {_MIN} >= 570 AND {_ET}::DATE = {_E2}::DATE AND hour({_E2}) * 60 + minute({_E2}) <= {_CLOSE}"


@query("o108_bar_full_rth", f"SELECT event_id, {FULL_RTH} AS full_rth FROM events")
def o108(spark, d):
    return _moved(spark, d).select("event_id", Q.bar_full_rth(F.col("ts"), 3600).alias("full_rth"))


@query("o109_breadth_slot", f"SELECT event_id, CASE WHEN {_TRADING.format(_ET)} THEN CASE WHEN {_MIN} BETWEEN 580 AND 610 THEN '0945' WHEN {_MIN} BETWEEN {_CLOSE} - 15 AND {_CLOSE} + 5 THEN '1559' END END AS slot FROM events")
def o109(spark, d):
    return _moved(spark, d).select("event_id", Q.breadth_slot(F.col("ts")).alias("slot"))


@query("o110_quote_day", with_(BARS_1D) + f"SELECT DISTINCT ts::DATE AS day, (SELECT max(c) FROM (SELECT unnest(range(0, 8)) AS k, (s.ts - k * INTERVAL 1 DAY) AS c) WHERE {_PROBABLE.format('c')})::DATE AS trade_day FROM {_SHIFT} s")
def o110(spark, d):
    return _shifted(spark, d).select(F.to_date("ts").alias("day"), Q.last_trading_day(F.col("ts")).alias("trade_day")).distinct()


@query("o111_fresh", f"SELECT user_id, max(ts) AS last_ts, epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(max(ts)) <= 14400000 AS fresh FROM events GROUP BY user_id")
def o111(spark, d):
    g = K.table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    return g.withColumn("fresh", F.unix_millis(F.lit("2024-01-31").cast("timestamp")) - F.unix_millis(F.col("last_ts").cast("timestamp")) <= 14_400_000)


@query("o112_health", with_(BARS_1H) + "SELECT symbol, count(*) AS bars, max(ts) AS last_ts, count(*) < 280 AS warmup, epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(max(ts)) - 3600000 > 5400000 AS stale FROM bars_1h GROUP BY symbol")
def o112(spark, d):
    return Q.health(K.bars_1h(spark, d), F.lit("2024-01-31"), 3600)


@query("o113_heartbeat", "SELECT event_type AS lane, CASE WHEN age <= 1800 THEN 'ok' WHEN age <= 3600 THEN 'warn' ELSE 'bad' END AS status FROM (SELECT event_type, (epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(max(ts))) / 1000.0 AS age FROM events GROUP BY 1)")
def o113(spark, d):
    age = (F.unix_millis(F.lit("2024-01-31").cast("timestamp")) - F.unix_millis(F.max("ts").cast("timestamp"))) / 1000
    return K.table(spark, d, "events").groupBy(F.col("event_type").alias("lane")).agg(age.alias("age")).select("lane", Q.lane(F.col("age"), 1800, 3600).alias("status"))


@query("o114_clean_number", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN NULL ELSE value END AS x FROM events")
def o114(spark, d):
    dirty = F.when(F.col("event_id") % 4 == 0, "N/A").when(F.col("event_id") % 4 == 1, "NaN").otherwise(F.col("value").cast("string"))
    return K.table(spark, d, "events").select("event_id", Q.number(dirty).alias("x"))


@query("o117_missing_states", with_(BARS_1H) + "SELECT symbol, ts FROM bars_1h WHERE NOT (hour(ts) % 2 = 0 AND hour(ts) % 3 <> 0)")
def o117(spark, d):
    b = K.bars_1h(spark, d).select("symbol", "ts")
    stored = b.where(F.hour("ts") % 2 == 0).withColumn("version", F.lit("v3")).withColumn("audit_version", F.when(F.hour("ts") % 3 == 0, "a1").otherwise("a2"))
    return Q.missing_states(b, stored, "v3", "a2")


@query("o120_grid", with_(BARS_1H) + "SELECT symbol, count(DISTINCT epoch_ms(ts) % 14400000) AS n_offsets, min(epoch_ms(ts) % 14400000) AS anchor_ms FROM bars_1h GROUP BY symbol")
def o120(spark, d):
    return Q.grid_report(K.bars_1h(spark, d), 14_400)


@query("o122_non_finite", with_(VOL_DAILY) + "SELECT symbol, count(*) FILTER (volume > 400) AS n_bad, count(*) AS n FROM vol_daily GROUP BY symbol")
def o122(spark, d):
    v = K.vol_daily(spark, d)
    return Q.non_finite_report(v.withColumn("volume", F.when(F.col("volume") > 400, F.lit(float("nan"))).otherwise(F.col("volume"))), ("volume", "price"))


@query("o123_invalidate_revised", with_(BARS_1H) + "SELECT symbol, min(ts) AS first_changed FROM (SELECT symbol, ts FROM bars_1h WHERE (day(ts) = 20 AND hour(ts) > 5 AND symbol <> 'view') OR (day(ts) = 25 AND hour(ts) = 3)) GROUP BY symbol")
def o123(spark, d):
    b = K.bars_1h(spark, d)
    old = b.where("not (day(ts) = 25 and hour(ts) = 3)")
    new = b.withColumn("close", F.when((F.dayofmonth("ts") == 20) & (F.hour("ts") > 5) & (F.col("symbol") != "view"), F.col("close") * 1.01).otherwise(F.col("close")))
    return Q.first_revision(old, new)


@query("o123_states_kept", with_(BARS_1H) + "SELECT symbol, ts FROM bars_1h b WHERE ts < (SELECT min(ts) FROM bars_1h c WHERE c.symbol = b.symbol AND day(ts) = 20 AND hour(ts) > 5)")
def o123b(spark, d):
    b = K.bars_1h(spark, d)
    new = b.withColumn("close", F.when((F.dayofmonth("ts") == 20) & (F.hour("ts") > 5), F.col("close") * 1.01).otherwise(F.col("close")))
    return Q.invalidate(b.select("symbol", "ts"), Q.first_revision(b, new))


@query("o124_gaps", with_(BARS_1H) + "SELECT symbol, count(*) FILTER (step <> 1) AS n_gaps, coalesce(max(step), 1.0) AS worst FROM (SELECT symbol, (epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY symbol ORDER BY ts))) / 3600000.0::DOUBLE AS step FROM bars_1h) GROUP BY symbol")
def o124(spark, d):
    return Q.gaps(K.bars_1h(spark, d), 3600)


@query("o125_scale_breaks", with_(BARS_1H) + "SELECT symbol, ts, open / pc AS ratio FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM bars_1h) WHERE pc > 0 AND (open / pc > 3 OR open / pc < 1 / 3.0::DOUBLE)")
def o125(spark, d):
    return Q.scale_breaks(K.bars_1h(spark, d)).select("symbol", "ts", "ratio")


@query("o126_series_floor", with_(BARS_1H) + "SELECT symbol, ts FROM bars_1h WHERE ts >= TIMESTAMP '2024-01-01' + length(symbol) * INTERVAL 1 DAY")
def o126(spark, d):
    b = K.bars_1h(spark, d)
    floors = b.select("symbol").distinct().withColumn("floor", _ntz("2024-01-01") + F.make_dt_interval(days=F.length("symbol")))
    return b.join(floors, "symbol").where("ts >= floor").select("symbol", "ts")


@query("o127_valid_window", with_(BARS_1H) + "SELECT symbol, ts, count(*) OVER w = 15 AND bool_and(coalesce(high >= greatest(open, close, low) AND low <= least(open, close, high), false)) OVER w AS valid FROM bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 14 PRECEDING)")
def o127(spark, d):
    return Q.valid_window(K.bars_1h(spark, d)).select("symbol", "ts", "valid")


_B4 = "SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, sum(volume)::BIGINT AS volume, count(*) AS n FROM bars_1h GROUP BY 1, 2"


@query("o128_rebuild_diff", with_(BARS_1H) + f"SELECT symbol, ts, (volume + 1)::BIGINT AS volume, volume AS rebuilt_volume FROM (SELECT * FROM ({_B4}) QUALIFY n = 4 OR lead(ts) OVER (PARTITION BY symbol ORDER BY ts) IS NULL) WHERE day(ts) % 7 = 0")
def o128(spark, d):
    good = resample(K.bars_1h(spark, d), 14_400, 4)
    stored = good.withColumn("volume", F.col("volume") + F.when(F.dayofmonth("ts") % 7 == 0, 1).otherwise(0))
    return Q.rebuild_diff(stored, good).select("symbol", "ts", "volume", "rebuilt_volume")


@query("o129_lockbox", with_(BARS_1H) + "SELECT symbol, ts FROM bars_1h WHERE ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-25'")
def o129(spark, d):
    return Q.closed(K.bars_1h(spark, d), _ntz("2024-01-25"), 3600).select("symbol", "ts")
