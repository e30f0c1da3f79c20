"""Queries of window features."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import windows as X
from tidemark.operators import features as O
from tidemark.plans.quality import FULL_RTH
from tidemark.plans.registry import query
from tidemark.sources import canonical as K
from tidemark.sources.canonical import BARS_1H, VOL_DAILY, with_

_W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def _full(agg, x, n):
    r = f"(PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) OVER {r} >= {n} THEN {agg}({x}) OVER {r} END"


def _rank(x, n):
    a = f"list_filter(array_agg({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING), lambda z: z IS NOT NULL)"
    return f"len(list_filter({a}, lambda z: z < {x})) / len({a})::DOUBLE"


def _valid_rank(table, x, out):
    """CTE: table with the rank of the last valid value."""
    return f"""{table}_{out}_k AS (SELECT symbol, ts, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) < 2 THEN 0.5 ELSE {_rank(x, 250)} END AS {out} FROM {table} WHERE {x} IS NOT NULL),
{table}_{out} AS (SELECT t.*, coalesce(last_value(k.{out} IGNORE NULLS) OVER (PARTITION BY t.symbol ORDER BY t.ts), 0.5) AS {out} FROM {table} t LEFT JOIN {table}_{out}_k k ON t.symbol = k.symbol AND t.ts = k.ts)"""


_BASE = f"""base0 AS (SELECT *, lag(close) OVER w AS pc, row_number() OVER w AS n FROM bars_1h {_W}),
base1 AS (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, ln(close / pc) AS ret, close - pc AS chg FROM base0),
base AS (SELECT *, {_full('avg', 'tr', 14)} AS atr FROM base1)"""
BASE = with_(BARS_1H, _BASE)


def _bars(spark, d):
    return O.with_base(K.bars_1h(spark, d))


def r6(c, name=None):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


@query("o310_pct_rank", BASE.rstrip() + ", t AS (SELECT *, CASE WHEN n % 5 <> 0 THEN round(atr / close, 9) END AS x FROM base),\n" + _valid_rank("t", "x", "rank") + "\nSELECT symbol, ts, round(rank, 6) AS rank FROM t_rank")
def o310(spark, d):
    t = _bars(spark, d).withColumn("x", F.when(F.col("n") % 5 != 0, F.round(F.col("atr") / F.col("close"), 9)))
    return X.valid_rank(t, "x", "rank").select("symbol", "ts", r6("rank"))


_O311 = BASE.rstrip() + f", t AS (SELECT symbol, ts, round(atr / close, 9) AS x FROM base)\nSELECT symbol, ts, CASE WHEN x IS NOT NULL AND count(x) OVER (PARTITION BY symbol ORDER BY ts ROWS 249 PRECEDING) >= 2 THEN round({_rank('x', 250)}, 6) END AS rank FROM t"


@query("o311_rolling_pct_rank", _O311)
def o311(spark, d):
    t = _bars(spark, d).select("symbol", "ts", F.round(F.col("atr") / F.col("close"), 9).alias("x"))
    return t.select("symbol", "ts", r6(X.rolling_rank(F.col("x")), "rank"))


@query("o325_true_range", BASE + "SELECT symbol, ts, round(tr, 6) AS tr FROM base")
def o325(spark, d):
    return _bars(spark, d).select("symbol", "ts", r6("tr"))


@query("o326_strict_true_range", BASE + "SELECT symbol, ts, CASE WHEN pc IS NOT NULL THEN round(tr, 6) END AS tr FROM base")
def o326(spark, d):
    return K.bars_1h(spark, d).select("symbol", "ts", r6(O.true_range(strict=True), "tr"))


@query("o327_atr", BASE + "SELECT symbol, ts, round(atr, 6) AS atr FROM base")
def o327(spark, d):
    return _bars(spark, d).select("symbol", "ts", r6("atr"))


_VOL0 = f"""vol0 AS (SELECT *, round(atr / close, 9) AS atr_pct, {_full('stddev_samp', 'ret', 30)} * sqrt(8760) AS rv30,
  round(4.0 * ({_full('stddev_samp', 'close', 20)}) / ({_full('avg', 'close', 20)}), 9) AS bbw,
  round(({_full('stddev_samp', 'ret', 12)}) / nullif({_full('stddev_samp', 'ret', 72)}, 0), 9) AS vol_accel,
  CASE WHEN ret < 0 THEN ret * ret WHEN ret IS NOT NULL THEN 0.0 END AS dn, ret * ret AS rr FROM base),
vol AS (SELECT *, ({_full('sum', 'dn', 48)}) / nullif({_full('sum', 'rr', 48)}, 0) AS downside_share FROM vol0)"""


@query("o328_realized_vol", BASE.rstrip() + ",\n" + _VOL0 + "\nSELECT symbol, ts, round(rv30, 6) AS rv30 FROM vol")
def o328(spark, d):
    return _bars(spark, d).select("symbol", "ts", r6(X.full(F.stddev_samp, F.col("ret"), 30) * F.sqrt(F.lit(8760.0)), "rv30"))


@query("o329_bb_width", BASE.rstrip() + ",\n" + _VOL0 + "\nSELECT symbol, ts, round(bbw, 6) AS bbw FROM vol")
def o329(spark, d):
    c = F.col("close")
    return K.bars_1h(spark, d).select("symbol", "ts", F.round(F.round(4.0 * X.full(F.stddev_samp, c, 20) / X.full(F.avg, c, 20), 9), 6).alias("bbw"))


@query("o330_ema", with_(BARS_1H) + "SELECT symbol, ts, round(list_reduce(array_agg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 399 PRECEDING), lambda a, x: (1 - 2.0::DOUBLE / 51) * a + (2.0::DOUBLE / 51) * x), 6) AS ema50 FROM bars_1h")
def o330(spark, d):
    return K.bars_1h(spark, d).select("symbol", "ts", r6(X.ema(F.col("close"), 50), "ema50"))


@query("o332_efficiency_ratio", BASE + f"SELECT symbol, ts, round(abs(close - lag(close, 30) OVER (PARTITION BY symbol ORDER BY ts)) / nullif({_full('sum', 'abs(chg)', 30)}, 0), 6) AS er FROM base")
def o332(spark, d):
    return _bars(spark, d).select("symbol", "ts", r6(O.efficiency_ratio(), "er"))


_PIV = """piv AS (SELECT *, CASE WHEN n > 4 AND n + 4 <= total AND high = max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AND high > max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) THEN high END AS pivot_high,
  CASE WHEN n > 4 AND n + 4 <= total AND low = min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AND low < min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) THEN low END AS pivot_low
  FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS total FROM base)),
dirs AS (SELECT *, list_concat(
    list_transform(range(1, least(len(h), 4)), lambda k: CASE WHEN h[len(h) - k + 1] > h[len(h) - k] THEN 1.0 ELSE -1.0 END),
    list_transform(range(1, least(len(l), 4)), lambda k: CASE WHEN l[len(l) - k + 1] > l[len(l) - k] THEN 1.0 ELSE -1.0 END)) AS steps
  FROM (SELECT *, coalesce(list_filter(array_agg(pivot_high) OVER z, lambda x: x IS NOT NULL), []) AS h, coalesce(list_filter(array_agg(pivot_low) OVER z, lambda x: x IS NOT NULL), []) AS l
    FROM piv WINDOW z AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 395 PRECEDING AND 4 PRECEDING)))"""


@query("o333_swing_pivots", BASE.rstrip() + ",\n" + _PIV + "\nSELECT symbol, ts, pivot_high, pivot_low FROM piv WHERE pivot_high IS NOT NULL OR pivot_low IS NOT NULL")
def o333(spark, d):
    return O.pivots(K.bars_1h(spark, d)).where("pivot_high is not null or pivot_low is not null").select("symbol", "ts", "pivot_high", "pivot_low")


_DIR = "CASE WHEN len(steps) > 0 THEN list_sum(steps) / len(steps) ELSE 0.0 END"


@query("o334_structure_direction", BASE.rstrip() + ",\n" + _PIV + f"\nSELECT symbol, ts, round(CAST({_DIR} AS DOUBLE), 6) AS pivot_dir FROM dirs")
def o334(spark, d):
    return O.direction(O.pivots(K.bars_1h(spark, d))).select("symbol", "ts", r6("pivot_dir"))


_STRUCT = f"""st0 AS (SELECT *, CAST({_DIR} AS DOUBLE) AS pivot_dir, least(n, 400) AS seen, array_agg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 399 PRECEDING) AS cs,
  array_agg(high) OVER (PARTITION BY symbol ORDER BY ts ROWS 99 PRECEDING) AS hs, array_agg(low) OVER (PARTITION BY symbol ORDER BY ts ROWS 99 PRECEDING) AS ls FROM dirs),
st1 AS (SELECT *, list_reduce(cs, lambda a, x: (1 - 2.0::DOUBLE / 51) * a + (2.0::DOUBLE / 51) * x) AS e50, list_reduce(list_slice(cs, 1, greatest(len(cs) - 10, 1)), lambda a, x: (1 - 2.0::DOUBLE / 51) * a + (2.0::DOUBLE / 51) * x) AS e50b,
  list_reduce(cs, lambda a, x: (1 - 2.0::DOUBLE / 201) * a + (2.0::DOUBLE / 201) * x) AS e200, CASE WHEN seen > 100 THEN list_max(hs) ELSE list_max(list_slice(hs, 2, len(hs))) END AS dh, CASE WHEN seen > 100 THEN list_min(ls) ELSE list_min(list_slice(ls, 2, len(ls))) END AS dl FROM st0),
st2 AS (SELECT *, CASE WHEN atr > 0 AND seen > 11 THEN tanh(2.0 * (e50 - e50b) / (atr * 10)) ELSE 0.0 END AS ema_slope, (close - dl) / greatest(dh - dl, 1e-12) AS donchian_pos, CASE WHEN seen >= 200 THEN CASE WHEN close > e200 THEN 1.0 ELSE -1.0 END END AS above FROM st1),
struct AS (SELECT *, CASE WHEN above IS NOT NULL THEN 0.45 * pivot_dir + 0.25 * ema_slope + 0.2 * (2 * donchian_pos - 1) + 0.1 * above ELSE (0.45 * pivot_dir + 0.25 * ema_slope + 0.2 * (2 * donchian_pos - 1)) / 0.9 END AS direction FROM st2)"""


@query("o335_structure_features", BASE.rstrip() + ",\n" + _PIV + ",\n" + _STRUCT + "\nSELECT symbol, ts, round(CAST(ema_slope AS DOUBLE), 6) AS ema_slope, round(donchian_pos, 6) AS donchian_pos, round(CAST(direction AS DOUBLE), 6) AS direction, h[len(h)] AS swing_high, l[len(l)] AS swing_low FROM struct WHERE n > 1")
def o335(spark, d):
    return O.structure(_bars(spark, d)).where("n > 1").select("symbol", "ts", r6("ema_slope"), r6("donchian_pos"), r6("direction"), "swing_high", "swing_low")


@query("o336_vol_accel", BASE.rstrip() + ",\n" + _VOL0 + "\nSELECT symbol, ts, round(vol_accel, 6) AS vol_accel FROM vol")
def o336(spark, d):
    r = F.col("ret")
    return _bars(spark, d).select("symbol", "ts", F.round(F.round(X.full(F.stddev_samp, r, 12) / F.nullif(X.full(F.stddev_samp, r, 72), F.lit(0.0)), 9), 6).alias("vol_accel"))


@query("o337_downside_share", BASE.rstrip() + ",\n" + _VOL0 + "\nSELECT symbol, ts, round(downside_share, 6) AS downside_share FROM vol")
def o337(spark, d):
    r = F.col("ret")
    dn = F.when(r < 0, r * r).when(r.isNotNull(), F.lit(0.0))
    return _bars(spark, d).select("symbol", "ts", r6(X.full(F.sum, dn, 48) / F.nullif(X.full(F.sum, r * r, 48), F.lit(0.0)), "downside_share"))


_BUCKET = "(hour(ts - INTERVAL 5 HOUR) + CASE WHEN isodow(ts - INTERVAL 5 HOUR) > 5 THEN 24 ELSE 0 END)"


@query("o338_session_bucket", f"SELECT event_id, {_BUCKET} AS bucket FROM events")
def o338(spark, d):
    return K.table(spark, d, "events").select("event_id", O.session_bucket(F.col("ts")).cast("long").alias("bucket"))


_DS = f"""ds0 AS (SELECT *, {_BUCKET} AS bucket, tr / close AS trp FROM base),
ds1 AS (SELECT *, CASE WHEN count(trp) OVER wb >= 8 THEN avg(trp) OVER wb END AS fac, CASE WHEN count(trp) OVER wa >= 48 THEN avg(trp) OVER wa END AS overall FROM ds0
  WINDOW wb AS (PARTITION BY symbol, bucket ORDER BY ts ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), wa AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 240 PRECEDING AND 1 PRECEDING)),
ds2 AS (SELECT *, trp / nullif(fac, 0) * overall AS tr_ds FROM ds1),
ds AS (SELECT *, round({_full('avg', 'tr_ds', 14)}, 9) AS atr_ds FROM ds2)"""


@query("o339_deseasonalized_rank", BASE.rstrip() + ",\n" + _DS + ",\n" + _valid_rank("ds", "atr_ds", "rk") + "\nSELECT symbol, ts, round(atr_ds, 6) AS atr_ds, CASE WHEN atr_ds IS NOT NULL THEN round(rk, 6) END AS atr_rank_ds FROM ds_rk")
def o339(spark, d):
    return O.deseasonalized(_bars(spark, d)).select("symbol", "ts", r6("atr_ds"), r6("atr_rank_ds"))


VOLX = _VOL0 + ",\n" + _valid_rank("vol", "atr_pct", "atr_rank") + ",\n" + _valid_rank("vol_atr_rank", "bbw", "bbw_rank") + ",\n" + _valid_rank("vol_atr_rank_bbw_rank", "vol_accel", "accel_rank") + ",\nvolx AS (SELECT *, bbw_rank < 0.15 AND atr_rank < 0.30 AS squeeze, atr_rank > 0.85 AS high_vol FROM vol_atr_rank_bbw_rank_accel_rank)"


@query("o340_volatility_features", BASE.rstrip() + ",\n" + VOLX + "\nSELECT symbol, ts, round(atr_rank, 6) AS atr_rank, round(bbw_rank, 6) AS bbw_rank, round(accel_rank, 6) AS accel_rank, squeeze, high_vol FROM volx")
def o340(spark, d):
    return O.volatility(_bars(spark, d)).select("symbol", "ts", r6("atr_rank"), r6("bbw_rank"), r6("accel_rank"), "squeeze", "high_vol")


VOLUME = f"""vm0 AS (SELECT *, volume::DOUBLE AS v FROM base), {_valid_rank('vm0', 'v', 'vr')},
vm1 AS (SELECT *, sum(CASE WHEN chg > 0 THEN v ELSE 0 END) OVER z AS up, sum(CASE WHEN chg < 0 THEN v ELSE 0 END) OVER z AS dn,
  CASE WHEN count(high) OVER y = 60 AND close > max(high) OVER y THEN 'up' WHEN count(high) OVER y = 60 AND close < min(low) OVER y THEN 'down' END AS hit FROM vm0_vr
  WINDOW z AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), y AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
volume AS (SELECT *, (v - ({_full('avg', 'v', 20)})) / (({_full('stddev_samp', 'v', 20)}) + 1e-12) AS vol_z20, CASE WHEN up + dn > 0 THEN (up - dn) / (up + dn) ELSE 0.0 END AS tilt,
  last_value(hit IGNORE NULLS) OVER x AS breakout, last_value(CASE WHEN hit IS NOT NULL THEN vr END IGNORE NULLS) OVER x AS breakout_rank FROM vm1 WINDOW x AS (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING))"""


@query("o341_volume_features", BASE.rstrip() + ",\n" + VOLUME + "\nSELECT symbol, ts, CASE WHEN abs(vol_z20) < 1e6 THEN round(vol_z20, 6) END AS vol_z20, round(vr, 6) AS vol_rank, round(tilt, 6) AS tilt, breakout, round(breakout_rank, 6) AS breakout_rank FROM volume")
def o341(spark, d):
    v = O.volume(_bars(spark, d))
    return v.select("symbol", "ts", F.when(F.abs("vol_z20") < 1e6, F.round("vol_z20", 6)).alias("vol_z20"), r6("vol_rank"), r6("tilt"), "breakout", r6("breakout_rank"))


_VWAP = "vw AS (SELECT *, CASE WHEN count(volume) OVER z >= 0.8 * 24 AND sum(volume) OVER z > 0 THEN sum(quote_vol) OVER z / sum(volume) OVER z END AS vwap_24 FROM base WINDOW z AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW))"


@query("o342_rolling_vwap", BASE.rstrip() + ",\n" + _VWAP + "\nSELECT symbol, ts, round(vwap_24 + 3e-8::DOUBLE, 5) AS vwap_24 FROM vw")
def o342(spark, d):
    return O.vwap(K.bars_1h(spark, d), 24).select("symbol", "ts", F.round(F.col("vwap_24") + 3e-8, 5).alias("vwap_24"))


@query("o343_vwap_payload", BASE.rstrip() + ",\n" + _VWAP + ",\ndv AS (SELECT *, CASE WHEN atr > 0 THEN round((close - vwap_24) / atr, 9) END AS dev FROM vw),\n" + _valid_rank("dv", "dev", "rk") + "\nSELECT symbol, ts, round(dev, 6) AS dev, CASE WHEN dev IS NOT NULL AND count(dev) OVER (PARTITION BY symbol ORDER BY ts) >= 60 THEN round(rk, 6) END AS dev_rank FROM dv_rk")
def o343(spark, d):
    return O.vwap_deviation(O.vwap(_bars(spark, d), 24), "vwap_24").select("symbol", "ts", r6("dev"), r6("dev_rank"))


_PATH = """pw AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n, array_agg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 119 PRECEDING) AS a FROM bars_1h),
pt AS (SELECT symbol, ts, n, list_sum(list_transform(range(1, 120), lambda i: list_sum(list_transform(range(i + 1, 121), lambda j: sign(a[j] - a[i]))))) / 7140.0::DOUBLE AS tau FROM pw WHERE n >= 120)"""


@query("o344_path_features", with_(BARS_1H, _PATH) + "SELECT symbol, ts, round(tau, 6) AS kendall_tau FROM pt")
def o344(spark, d):
    return O.path(K.bars_1h(spark, d)).where("kendall_tau is not null").select("symbol", "ts", r6("kendall_tau"))


@query("o344_path_geometry")
def o344b(spark, d):
    return O.path(K.bars_1h(spark, d)).where("kendall_tau is not null")


_SPANS = (20, 60, 200)
_MEANS = ", ".join(f"CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) >= {k} THEN round(list_reduce(array_agg(price) OVER (PARTITION BY symbol ORDER BY ts ROWS 399 PRECEDING), lambda a, x: (1 - 2.0::DOUBLE / {k + 1}) * a + (2.0::DOUBLE / {k + 1}) * x), 5) END AS ema{k}" for k in _SPANS)


@query("o348_vol_moving_averages", with_(VOL_DAILY) + f"SELECT symbol, ts, {_MEANS} FROM vol_daily")
def o348(spark, d):
    n = F.row_number().over(X.series())
    return K.vol_daily(spark, d).select("symbol", "ts", *[F.when(n >= k, F.round(X.ema(F.col("price"), k), 5)).alias(f"ema{k}") for k in _SPANS])


_BANDS = f"""vb0 AS (SELECT *, list_reduce(array_agg(price) OVER (PARTITION BY symbol ORDER BY ts ROWS 399 PRECEDING), lambda a, x: (1 - 2.0::DOUBLE / 201) * a + (2.0::DOUBLE / 201) * x) AS centre, {_full('stddev_samp', 'price', 200)} AS sigma FROM vol_daily),
vb AS (SELECT *, CASE WHEN sigma > 0 THEN (price - centre) / sigma END AS z FROM vb0)"""


@query("o349_vol_bands", with_(VOL_DAILY, _BANDS) + "SELECT symbol, ts, round(z, 6) AS z, CASE WHEN z >= 2 THEN 'far_above' WHEN z >= 1 THEN 'above' WHEN z > -1 THEN 'inside' WHEN z > -2 THEN 'below' WHEN z IS NOT NULL THEN 'far_below' END AS position FROM vb")
def o349(spark, d):
    return O.vol_bands(K.vol_daily(spark, d), "price").select("symbol", "ts", r6("z"), "position")


@query("o312_vol_band_coverage", with_(VOL_DAILY, _BANDS) + "SELECT symbol, round(avg(CASE WHEN abs(z) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS coverage1, round(avg(CASE WHEN abs(z) <= 2 THEN 1.0 ELSE 0.0 END), 6) AS coverage2 FROM vb WHERE z IS NOT NULL GROUP BY symbol")
def o312(spark, d):
    b = O.vol_bands(K.vol_daily(spark, d), "price").where("z is not null")
    share = lambda k: F.round(F.avg(F.when(F.abs("z") <= k, 1.0).otherwise(0.0)), 6)
    return b.groupBy("symbol").agg(share(1).alias("coverage1"), share(2).alias("coverage2"))


@query("o350_window_span", with_(VOL_DAILY) + "SELECT symbol, round((epoch_ms(max(ts)) - epoch_ms(min(ts))) / 86400000.0 / (count(*) - 1) * 60, 6) AS span_days FROM vol_daily GROUP BY symbol HAVING count(*) > 1")
def o350(spark, d):
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    g = K.vol_daily(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), (ms(F.max("ts")) - ms(F.min("ts"))).alias("span")).where("n > 1")
    return g.select("symbol", F.round(F.col("span") / 86400000 / (F.col("n") - 1) * 60, 6).alias("span_days"))


@query("o352_rank_gates", with_(BARS_1H) + "SELECT symbol, count(*) AS n, count(*) >= 20 AND epoch_ms(max(ts)) - epoch_ms(min(ts)) >= 604800000 AS enough FROM bars_1h GROUP BY symbol")
def o352(spark, d):
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    return K.bars_1h(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), ((F.count(F.lit(1)) >= 20) & (ms(F.max("ts")) - ms(F.min("ts")) >= 604_800_000)).alias("enough"))


_VRP = f"vr0 AS (SELECT symbol, ts, round(price / 100 - lag(price) OVER w / 100, 9) AS x FROM vol_daily {_W})"


@query("o353_vrp", with_(VOL_DAILY, _VRP) + f"SELECT symbol, ts, round(x + 3e-10::DOUBLE, 6) AS vrp, CASE WHEN x IS NOT NULL AND count(x) OVER (PARTITION BY symbol ORDER BY ts ROWS 251 PRECEDING) >= 120 THEN round({_rank('x', 252)}, 6) END AS rank FROM vr0")
def o353(spark, d):
    x = F.round(F.col("price") / 100 - F.lag("price").over(X.series()) / 100, 9)
    v = K.vol_daily(spark, d).withColumn("x", x)
    gate = F.count("x").over(X.rows(252)) >= 120
    return v.select("symbol", "ts", r6(F.col("x") + 3e-10, "vrp"), F.when(gate, F.round(X.rolling_rank(F.col("x"), 252), 6)).alias("rank"))


_COND = f"""cd AS (SELECT symbol, ts, round(price, 9) AS x, day(ts) <= 10 AS near FROM vol_daily),
cp AS (SELECT *, list_filter(list_zip(array_agg(x) OVER z, array_agg(near) OVER z), lambda p: p[1] IS NOT NULL) AS past, count(x) OVER (PARTITION BY symbol ORDER BY ts ROWS 251 PRECEDING) AS k, {_rank('x', 252)} AS raw FROM cd WINDOW z AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 503 PRECEDING AND 1 PRECEDING)),
cs AS (SELECT *, coalesce(list_filter(past, lambda p: p[2] = near), []) AS same FROM cp),
cc AS (SELECT *, coalesce(len(past), 0) + 1 >= 120 AND len(same) >= 60 AS cond FROM cs)"""
_COND_SQL = with_(VOL_DAILY, _COND) + "SELECT symbol, ts, CASE WHEN cond THEN round(len(list_filter(same, lambda p: p[1] < x)) / len(same)::DOUBLE, 6) WHEN k >= 120 THEN round(raw, 6) END AS rank, CASE WHEN cond THEN 'event' WHEN k >= 120 THEN 'raw' END AS basis FROM cc"


def _conditioned(spark, d):
    v = K.vol_daily(spark, d).withColumn("x", F.round("price", 9)).withColumn("near", F.dayofmonth("ts") <= 10)
    return O.event_conditioned_rank(v, "x", "near").select("symbol", "ts", r6("rank"), "basis")


@query("o331_event_conditioned_rank", _COND_SQL)
def o331(spark, d):
    return _conditioned(spark, d)


@query("o319_latest_ranks", with_(VOL_DAILY, _COND) + "SELECT symbol, max(ts) AS ts, arg_max(CASE WHEN cond THEN round(len(list_filter(same, lambda p: p[1] < x)) / len(same)::DOUBLE, 6) WHEN k >= 120 THEN round(raw, 6) END, ts) AS rank FROM cc GROUP BY symbol")
def o319(spark, d):
    return _conditioned(spark, d).groupBy("symbol").agg(F.max(F.struct("ts", "rank")).alias("m")).select("symbol", "m.ts", "m.rank")


@query("o354_term_rank", with_(BARS_1H, "tr AS (SELECT a.ts, round(a.close / b.close, 9) AS ratio FROM bars_1h a JOIN bars_1h b ON a.ts = b.ts AND a.symbol = 'view' AND b.symbol = 'click')") + "SELECT ts, ratio > 1 AS inverted, CASE WHEN count(*) OVER z >= 252 THEN round(len(list_filter(array_agg(ratio) OVER z, lambda x: x < ratio)) / (count(*) OVER z)::DOUBLE, 6) END AS rank FROM tr WINDOW z AS (ORDER BY ts ROWS 503 PRECEDING)")
def o354(spark, d):
    b = K.bars_1h(spark, d)
    x = b.where("symbol = 'view'").select("ts", F.col("close").alias("a")).join(b.where("symbol = 'click'").select("ts", F.col("close").alias("b")), "ts")
    x = x.select(F.lit("term").alias("symbol"), "ts", F.round(F.col("a") / F.col("b"), 9).alias("ratio"))
    all_ = F.collect_list("ratio").over(X.rows(504))
    return x.select("ts", (F.col("ratio") > 1).alias("inverted"), F.round(X.share_below(all_, F.col("ratio"), 252), 6).alias("rank"))


@query("o355_preview_rank", with_(VOL_DAILY) + "SELECT symbol, count(*) AS n, round(count(*) FILTER (price < live) / count(*)::DOUBLE, 6) AS rank FROM (SELECT symbol, price, arg_max(price, ts) OVER (PARTITION BY symbol) * 1.02 AS live FROM vol_daily) GROUP BY symbol")
def o355(spark, d):
    v = K.vol_daily(spark, d)
    live = v.groupBy("symbol").agg((F.max_by("price", "ts") * 1.02).alias("live"))
    g = v.join(live, "symbol").groupBy("symbol")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("price") < F.col("live")) / F.count(F.lit(1)), 6).alias("rank"))


@query("o356_future_rv", BASE + "SELECT symbol, ts, CASE WHEN count(ret) OVER z = 6 THEN round(sqrt(avg(ret * ret) OVER z), 6) END AS frv FROM base WINDOW z AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)")
def o356(spark, d):
    return _bars(spark, d).select("symbol", "ts", r6(O.future_rv(6), "frv"))


@query("o357_future_range", BASE + "SELECT symbol, ts, CASE WHEN count(high) OVER z = 10 THEN round(max(high) OVER z - min(low) OVER z, 6) END AS rng FROM base WINDOW z AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)")
def o357(spark, d):
    return _bars(spark, d).select("symbol", "ts", r6(O.future_range(10), "rng"))


_EST = f"""es0 AS (SELECT *, ln(high / low) * ln(high / low) AS hl2, 0.5 * ln(high / low) * ln(high / low) - (2 * ln(2) - 1) * ln(close / open) * ln(close / open) AS gk, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM bars_1h),
es AS (SELECT symbol, ts, sqrt(({_full('avg', 'hl2', 14)}) / (4 * ln(2))) AS parkinson, sqrt(greatest({_full('avg', 'gk', 14)}, 0)) AS gk0, ({_full('avg', 'gk', 14)}) AS gkr, ({_full('avg', 'rs', 14)}) AS rsr FROM es0)"""


@query("o358_range_estimators", with_(BARS_1H, _EST) + "SELECT symbol, ts, round(parkinson, 6) AS parkinson, CASE WHEN gkr IS NOT NULL THEN round(sqrt(greatest(gkr, 0)), 6) END AS garman_klass, CASE WHEN rsr IS NOT NULL THEN round(sqrt(greatest(rsr, 0)), 6) END AS rogers_satchell FROM es")
def o358(spark, d):
    e = O.estimators(K.bars_1h(spark, d))
    known = F.col("parkinson").isNotNull()
    return e.select("symbol", "ts", r6("parkinson"), F.when(known, F.round("garman_klass", 6)).alias("garman_klass"), F.when(known, F.round("rogers_satchell", 6)).alias("rogers_satchell"))


@query("o360_session_returns", with_(BARS_1H) + f"SELECT symbol, ts + INTERVAL 2 YEAR AS ts, CASE WHEN ts - lag(ts) OVER w = INTERVAL 1 HOUR THEN round(ln(close / lag(close) OVER w), 6) END AS r FROM (SELECT * FROM bars_1h WHERE {FULL_RTH}) {_W}")
def o360b(spark, d):
    """On the clock of sessions: the first hour of a day has no return."""
    b = K.bars_1h(spark, d).withColumn("ts", F.col("ts") + F.make_ym_interval(years=F.lit(2)))
    return O.panel_returns(b, 3600, "usrth").select("symbol", "ts", r6("r"))


@query("o360_panel_returns", with_(BARS_1H) + f"SELECT symbol, ts, CASE WHEN ts - lag(ts) OVER w = INTERVAL 1 HOUR THEN round(ln(close / lag(close) OVER w), 6) END AS r FROM bars_1h {_W}")
def o360(spark, d):
    return O.panel_returns(K.bars_1h(spark, d), 3600).select("symbol", "ts", r6("r"))


@query("o361_ranking_functions", f"SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS q, round(percent_rank() OVER w, 6) AS pr FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)")
def o361(spark, d):
    w = W.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    long = lambda c: c.over(w).cast("long")
    return K.table(spark, d, "orders").select("o_orderkey", long(F.row_number()).alias("rn"), long(F.rank()).alias("rk"), long(F.dense_rank()).alias("dr"), long(F.ntile(4)).alias("q"), F.round(F.percent_rank().over(w), 6).alias("pr"))


@query("o363_rv3", BASE + f"SELECT symbol, ts, round({_full('stddev_samp', 'ret', 72)} * sqrt(8760) * 100, 5) AS rv3 FROM base")
def o363(spark, d):
    return _bars(spark, d).select("symbol", "ts", F.round(X.full(F.stddev_samp, F.col("ret"), 72) * F.sqrt(F.lit(8760.0)) * 100, 5).alias("rv3"))
