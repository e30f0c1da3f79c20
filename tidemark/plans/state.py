"""Queries of states, aggregations over series, and their scores."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import windows as X
from tidemark.operators import bars as B
from tidemark.operators import features as O
from tidemark.operators import state as S
from tidemark.plans import features as PF
from tidemark.plans.features import BASE, r6
from tidemark.plans.registry import query
from tidemark.sources import canonical as K
from tidemark.sources.canonical import BARS_1D, BARS_1H, REGISTRY, VOL_DAILY, with_

_B4 = "b4 AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume)::BIGINT AS volume, count(*) AS n FROM bars_1h GROUP BY 1, 2)"


@query("o301_resample_4h", with_(BARS_1H, _B4) + "SELECT symbol, ts, open, high, low, close, volume, n FROM b4 QUALIFY n = 4 OR lead(ts) OVER (PARTITION BY symbol ORDER BY ts) IS NULL")
def o301(spark, d):
    return B.resample(K.bars_1h(spark, d), 14_400, 4).select("symbol", "ts", "open", "high", "low", "close", "volume", "n")


@query("o302_hourly_last", "SELECT 'u' || (user_id % 10) AS symbol, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS hour, arg_max(value, ts) FILTER (event_type = 'click') AS funding, arg_max(value, ts) FILTER (event_type = 'view') AS oi FROM events GROUP BY 1, 2")
def o302(spark, d):
    return B.hourly_last(K.deriv(spark, d), ["symbol"], ["funding", "oi"])


@query("o303_previous_day", with_(BARS_1H) + "SELECT symbol, p, max(high) AS hi, min(low) AS lo FROM (SELECT *, date_trunc('day', ts)::TIMESTAMP AS p, max(date_trunc('day', ts)::TIMESTAMP) OVER (PARTITION BY symbol) AS now FROM bars_1h) WHERE p = now - INTERVAL 1 DAY GROUP BY 1, 2")
def o303(spark, d):
    return B.previous_period(K.bars_1h(spark, d), "day")


@query("o303_previous_week", with_(BARS_1H) + "SELECT symbol, p, max(high) AS hi, min(low) AS lo FROM (SELECT *, date_trunc('week', ts)::TIMESTAMP AS p, max(date_trunc('week', ts)::TIMESTAMP) OVER (PARTITION BY symbol) AS now FROM bars_1h) WHERE p = now - INTERVAL 7 DAY GROUP BY 1, 2")
def o303b(spark, d):
    return B.previous_period(K.bars_1h(spark, d), "week")


@query("o304_poc", with_(BARS_1H) + """, e AS (SELECT symbol, max(ts) + INTERVAL 1 HOUR AS "end" FROM bars_1h GROUP BY symbol),
r AS (SELECT b.*, e."end" FROM bars_1h b JOIN e USING (symbol) WHERE volume > 0 AND quote_vol > 0 AND ts <= e."end" - INTERVAL 1 HOUR AND ts >= e."end" - INTERVAL 240 HOUR),
ok AS (SELECT symbol FROM r GROUP BY symbol HAVING count(*) >= 192),
g AS (SELECT symbol, floor(quote_vol / volume / 1.7::DOUBLE)::BIGINT AS bucket, sum(volume)::BIGINT AS volume FROM r GROUP BY 1, 2)
SELECT symbol, bucket, volume, round((bucket + 0.5) * 1.7::DOUBLE, 6) AS point FROM g SEMI JOIN ok USING (symbol) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, bucket) = 1""")
def o304(spark, d):
    b = K.bars_1h(spark, d)
    width = b.groupBy("symbol").agg(F.lit(1.7).alias("width"), (F.max("ts") + F.make_dt_interval(hours=F.lit(1))).alias("end"))
    return B.poc(b, width).select("symbol", "bucket", "volume", r6("point"))


_RAW = "CASE WHEN close > 14 THEN 'high_vol_chop' WHEN close > 9 THEN 'trend_up' WHEN close > 5 THEN 'range' ELSE 'squeeze' END"
RAW = f"raw AS (SELECT symbol, ts, close, {_RAW} AS state, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, day(ts) % 3 = 0 AS ev FROM bars_1h)"


def _raw(spark, d, name="state"):
    c = F.col("close")
    s = F.when(c > 14, "high_vol_chop").when(c > 9, "trend_up").when(c > 5, "range").otherwise("squeeze")
    return K.bars_1h(spark, d).select("symbol", "ts", "close", s.alias(name), (F.dayofmonth("ts") % 3 == 0).alias("ev"))


_ISL = "isl AS (SELECT symbol, ts, state, sum(c) OVER (PARTITION BY symbol ORDER BY ts) AS episode FROM (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY symbol ORDER BY ts) <> state THEN 1 ELSE 0 END AS c FROM raw)), seg AS (SELECT symbol, episode::BIGINT AS episode, state, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS bars FROM isl GROUP BY 1, 2, 3)"


@query("o407_episode_ids", with_(BARS_1H, RAW, _ISL) + "SELECT symbol, ts, episode::BIGINT AS episode FROM isl")
def o407(spark, d):
    return B.islands(_raw(spark, d)).select("symbol", "ts", "episode")


@query("o408_segments", with_(BARS_1H, RAW, _ISL) + "SELECT symbol, episode, state, start_ts, end_ts, bars FROM seg")
def o408(spark, d):
    return B.segments(_raw(spark, d))


@query("o305_episode_stats", with_(BARS_1H, RAW, _ISL) + "SELECT state, count(*) AS runs, quantile_cont(bars, 0.5) AS median_bars, max(bars) AS max_bars FROM seg GROUP BY state")
def o305(spark, d):
    return B.episode_stats(_raw(spark, d))


@query("o305_transitions", with_(BARS_1H, RAW, _ISL) + "SELECT state AS from_state, nxt AS to_state, count(*) AS n FROM (SELECT *, lead(state) OVER (PARTITION BY symbol ORDER BY episode) AS nxt FROM seg) WHERE nxt IS NOT NULL GROUP BY 1, 2")
def o305b(spark, d):
    return B.transitions(_raw(spark, d))


@query("o306_status_counts", with_(BARS_1H, RAW) + "SELECT state, count(*) AS n FROM raw GROUP BY state")
def o306(spark, d):
    return _raw(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("o308_theme_blocks", with_(REGISTRY) + "SELECT theme[1] AS block, count(*) AS n, string_agg(symbol, ',' ORDER BY symbol) AS members FROM registry WHERE theme[1] <> 'AFRICA' GROUP BY 1 HAVING count(*) >= 2")
def o308(spark, d):
    g = K.registry(spark, d).withColumn("block", F.element_at("theme", 1)).where("block <> 'AFRICA'").groupBy("block")
    return g.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("members")).where("n >= 2")


@query("o309_overview_buckets", with_(BARS_1H, RAW) + "SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN state = 'trend_up' AND ev THEN 'armed' WHEN state = 'trend_up' THEN 'wait_signal' WHEN state = 'range' THEN 'near' WHEN state = 'squeeze' THEN 'middle' ELSE 'unavailable' END AS bucket FROM raw) GROUP BY bucket")
def o309(spark, d):
    s = F.col("state")
    bucket = F.when((s == "trend_up") & F.col("ev"), "armed").when(s == "trend_up", "wait_signal").when(s == "range", "near").when(s == "squeeze", "middle").otherwise("unavailable")
    return _raw(spark, d).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("o313_estimator_spearman", with_(BARS_1H, PF._EST, "sp AS (SELECT symbol, round(parkinson, 9) AS a, round(rsr, 9) AS b FROM es WHERE parkinson IS NOT NULL AND rsr IS NOT NULL), rk AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY a) + (count(*) OVER (PARTITION BY symbol, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY symbol ORDER BY b) + (count(*) OVER (PARTITION BY symbol, b) - 1) / 2.0::DOUBLE AS rb FROM sp)") + "SELECT symbol, count(*) AS n, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN round(corr(ra, rb), 6) END AS spearman FROM rk GROUP BY symbol HAVING count(*) >= 100")
def o313(spark, d):
    ln = lambda a, b: X.log_ratio(F.col(a), F.col(b))
    hl, rs = ln("high", "low"), ln("high", "close") * ln("high", "open") + ln("low", "close") * ln("low", "open")
    e = K.bars_1h(spark, d).select("symbol", F.round(F.sqrt(X.full(F.avg, hl * hl, 14) / F.lit(4 * 0.6931471805599453)), 9).alias("a"), F.round(X.full(F.avg, rs, 14), 9).alias("b")).where("a is not null and b is not null")

    def average_rank(c):
        return F.rank().over(W.partitionBy("symbol").orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy("symbol", c)) - 1) / 2

    r = e.select("symbol", average_rank("a").alias("ra"), average_rank("b").alias("rb"))
    return r.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(X.safe_corr("ra", "rb"), 6).alias("spearman")).where("n >= 100")


@query("o314_event_study", BASE + """, t AS (SELECT symbol, ts, close, atr, CASE WHEN count(high) OVER z = 24 THEN (max(high) OVER z - min(low) OVER z) / atr END AS expansion FROM base WINDOW z AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)),
g AS (SELECT t.*, k, close < k AND NOT coalesce(lag(close) OVER (PARTITION BY symbol, k ORDER BY ts) < k, false) AS entry FROM t, (VALUES (3), (5), (8)) v(k))
SELECT symbol, k, count(expansion) AS n_events, round(median(expansion), 6) AS expansion_med FROM g WHERE entry GROUP BY 1, 2 HAVING count(expansion) >= 12""")
def o314(spark, d):
    b = O.with_base(K.bars_1h(spark, d))
    b = b.withColumn("expansion", O.future_range(24) / F.col("atr"))
    b = b.withColumn("before", F.lag("close").over(X.series()))
    gates = F.filter(F.array(*[F.when((F.col("close") < k) & ~F.coalesce(F.col("before") < k, F.lit(False)), F.lit(k)) for k in (3, 5, 8)]), lambda x: x.isNotNull())
    e = b.select("symbol", "expansion", F.explode(gates).alias("k"))
    return e.groupBy("symbol", "k").agg(F.count("expansion").alias("n_events"), F.round(F.percentile("expansion", 0.5), 6).alias("expansion_med")).where("n_events >= 12")


@query("o315_bucket_cv", BASE + f", m AS (SELECT symbol, {PF._BUCKET} AS bucket, median(tr / close) AS med FROM base GROUP BY 1, 2) SELECT symbol, round(stddev_samp(med) / avg(med), 6) AS cv FROM m WHERE med > 0 GROUP BY symbol HAVING count(*) >= 20")
def o315(spark, d):
    b = O.with_base(K.bars_1h(spark, d)).groupBy("symbol", O.session_bucket(F.col("ts")).alias("bucket")).agg(F.percentile(F.col("tr") / F.col("close"), 0.5).alias("med")).where("med > 0")
    return b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_samp("med") / F.avg("med"), 6).alias("cv")).where("n >= 20").drop("n")


@query("o317_event_gate", with_(BARS_1H, RAW) + ", a AS (SELECT *, lag(state) OVER w AS prev, array_agg(state) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS after FROM raw WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT ev AS in_window, count(*) AS n, round(avg(CASE WHEN len(list_filter(after, lambda s: s <> state)) > 0 THEN 1.0 ELSE 0.0 END), 6) AS fail_rate FROM a WHERE prev = 'squeeze' AND state = 'trend_up' AND len(after) = 10 GROUP BY ev")
def o317(spark, d):
    return S.gate_outcomes(_raw(spark, d).withColumnRenamed("ev", "in_window")).select("in_window", "n", r6("fail_rate"))


@query("o318_tail_share", "SELECT user_id, round(count(*) FILTER (value > 15)::DOUBLE / greatest(count(*) - count(*) FILTER (value = 10), 1), 6) AS tail_share FROM events GROUP BY user_id")
def o318(spark, d):
    n = F.count(F.lit(1)) - F.count_if(F.col("value") == 10)
    return K.table(spark, d, "events").groupBy("user_id").agg(F.round(F.count_if(F.col("value") > 15) / F.greatest(n, F.lit(1)), 6).alias("tail_share"))


@query("o320_range_edges", with_(BARS_1H) + "SELECT symbol, round(quantile_cont(close, 0.9), 6) AS hi, round(quantile_cont(close, 0.1), 6) AS lo FROM (SELECT * FROM bars_1h QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 60) GROUP BY symbol")
def o320(spark, d):
    from tidemark.operators.scans import latest_n

    g = latest_n(K.bars_1h(spark, d), ["symbol"], 60).groupBy("symbol")
    return g.agg(F.round(F.percentile("close", 0.9), 6).alias("hi"), F.round(F.percentile("close", 0.1), 6).alias("lo"))


@query("o324_median_across", with_(VOL_DAILY) + "SELECT year(ts) AS year, round(median(m), 6) AS med FROM (SELECT symbol, year(ts) AS y, any_value(ts) AS ts, avg(volume) AS m FROM vol_daily GROUP BY 1, 2) GROUP BY 1")
def o324(spark, d):
    g = K.vol_daily(spark, d).groupBy("symbol", F.year("ts").cast("long").alias("year")).agg(F.avg("volume").alias("m"))
    return g.groupBy("year").agg(F.round(F.percentile("m", 0.5), 6).alias("med"))


# ---------------------------------------------------------------- states

_ER = f"er0 AS (SELECT *, round(abs(close - lag(close, 30) OVER (PARTITION BY symbol ORDER BY ts)) / nullif({PF._full('sum', 'abs(chg)', 30)}, 0), 9) AS er FROM base),\n" + PF._valid_rank("er0", "er", "er_rank")
_CLS = f"""cls0 AS (SELECT s.symbol, s.ts, round(CAST(s.direction AS DOUBLE), 3) AS d, e.er_rank AS er, v.bbw_rank AS bbw, v.atr_rank AS atr_rank, v.squeeze, v.high_vol, round(CAST(u.tilt AS DOUBLE), 3) AS tilt
  FROM struct s JOIN er0_er_rank e USING (symbol, ts) JOIN volx v USING (symbol, ts) JOIN volume u USING (symbol, ts) WHERE s.n >= 90),
cls AS (SELECT *, er >= 0.6 AND abs(d) >= 0.3 AS trend FROM cls0),
cl AS (SELECT *, CASE WHEN trend THEN CASE WHEN d > 0 THEN 'trend_up' ELSE 'trend_down' END WHEN squeeze THEN 'squeeze' WHEN high_vol THEN 'high_vol_chop' ELSE 'range' END AS state,
  greatest(0, least(1, CASE WHEN trend THEN 0.45 * abs(d) + 0.35 * er + 0.2 * (CASE WHEN tilt * sign(d) > 0.1 THEN 1.0 WHEN tilt * sign(d) > -0.1 THEN 0.5 ELSE 0.0 END) WHEN squeeze THEN 1 - bbw WHEN high_vol THEN atr_rank ELSE 0.5 * (1 - er) + 0.5 * (1 - abs(d)) END)) AS confidence,
  greatest(greatest(0, 0.6 - er), greatest(0, 0.3 - abs(d))) AS to_trend, greatest(greatest(0, bbw - 0.15), greatest(0, atr_rank - 0.3)) AS to_squeeze, greatest(0, 0.85 - atr_rank) AS to_chop FROM cls),
cm AS (SELECT *, CASE WHEN trend THEN least(er - 0.6, abs(d) - 0.3) WHEN squeeze THEN least(to_trend, least(0.15 - bbw, 0.3 - atr_rank)) WHEN high_vol THEN least(to_trend, atr_rank - 0.85) ELSE least(to_trend, to_squeeze, to_chop) END AS margin FROM cl)"""
CLASSIFY = BASE.rstrip() + ",\n" + ",\n".join([PF._PIV, PF._STRUCT, PF.VOLX, PF.VOLUME, _ER, _CLS]) + "\n"


@query("o401_classify", CLASSIFY + "SELECT symbol, ts, state, round(CAST(confidence AS DOUBLE) + 3e-8::DOUBLE, 6) AS confidence FROM cm")
def o401(spark, d):
    return S.classify(S.inputs(K.bars_1h(spark, d))).select("symbol", "ts", "state", r6(F.col("confidence") + 3e-8, "confidence"))


@query("o402_boundary_margin", CLASSIFY + "SELECT symbol, ts, round(CAST(greatest(0, margin) AS DOUBLE) + 3e-8::DOUBLE, 6) AS margin FROM cm")
def o402(spark, d):
    return S.classify(S.inputs(K.bars_1h(spark, d))).select("symbol", "ts", r6(F.col("margin") + 3e-8, "margin"))


_NEED = "CASE raw.state WHEN 'high_vol_chop' THEN 1 WHEN 'range' THEN 3 ELSE CASE WHEN raw.ev AND f.cur = 'squeeze' AND raw.state = 'trend_up' THEN 3 ELSE 2 END END"
_FOLD = f"""WITH RECURSIVE {BARS_1H}, {RAW},
f AS (SELECT symbol, rn, ts, state AS cur, CAST(NULL AS VARCHAR) AS pend, 0 AS cnt FROM raw WHERE rn = 1
  UNION ALL SELECT symbol, rn, ts, CASE WHEN fired THEN state ELSE cur END, CASE WHEN state = cur OR fired THEN NULL ELSE state END, CASE WHEN state = cur OR fired THEN 0 ELSE c END
  FROM (SELECT raw.symbol, raw.rn, raw.ts, raw.state, f.cur, CASE WHEN raw.state = f.pend THEN f.cnt + 1 ELSE 1 END AS c, raw.state <> f.cur AND (CASE WHEN raw.state = f.pend THEN f.cnt + 1 ELSE 1 END) >= {_NEED} AS fired
    FROM f JOIN raw ON raw.symbol = f.symbol AND raw.rn = f.rn + 1))
"""


@query("o403_confirm_need", with_(BARS_1H, RAW) + "SELECT symbol, ts, CAST(CASE state WHEN 'high_vol_chop' THEN 1 WHEN 'range' THEN 3 ELSE 2 END AS BIGINT) AS need FROM raw")
def o403(spark, d):
    s = F.col("state")
    return _raw(spark, d).select("symbol", "ts", F.when(s == "high_vol_chop", 1).when(s == "range", 3).otherwise(2).cast("long").alias("need"))


@query("o404_confirm_states", _FOLD + "SELECT symbol, ts, cur AS confirmed, pend AS candidate, cnt::BIGINT AS count FROM f")
def o404(spark, d):
    return S.confirm(_raw(spark, d, "raw_state"), event="ev").select("symbol", "ts", "confirmed", "candidate", "count")


@query("o405_regime_timeline")
def o405(spark, d):
    return S.regime_timeline(K.bars_1h(spark, d))


@query("o406_latest_regime", CLASSIFY + "SELECT symbol, max(ts) AS ts, arg_max(state, ts) AS state FROM cm GROUP BY symbol")
def o406(spark, d):
    c = S.classify(S.inputs(K.bars_1h(spark, d)))
    return c.groupBy("symbol").agg(F.max(F.struct("ts", "state")).alias("m")).select("symbol", "m.ts", "m.state")


_RMA = f"""WITH RECURSIVE {BARS_1H}, {PF._BASE},
s AS (SELECT symbol, n, ts, tr, avg(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING) AS seed FROM base),
r AS (SELECT symbol, n, ts, seed AS rma FROM s WHERE n = 14 UNION ALL SELECT s.symbol, s.n, s.ts, (r.rma * 13 + s.tr) / 14 FROM r JOIN s ON s.symbol = r.symbol AND s.n = r.n + 1)
"""


@query("o345_wilder_rma", _RMA + "SELECT symbol, ts, round(rma, 6) AS rma FROM r")
def o345(spark, d):
    return S.wilder_atr(O.with_base(K.bars_1h(spark, d))).where("rma is not null").select("symbol", "ts", r6("rma"))


@query("o346_crsi")
def o346(spark, d):
    return S.cyclic_rsi(K.bars_1h(spark, d)).where("crsi is not null")


# ---------------------------------------------------------------- scores

_Y = f"""ys AS (SELECT b.symbol, b.ts, r.state, CASE WHEN count(ret) OVER z = 6 THEN sqrt(avg(ret * ret) OVER z) END AS y, row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts) AS k FROM base b JOIN raw r USING (symbol, ts) WINDOW z AS (PARTITION BY b.symbol ORDER BY b.ts ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)),
pl AS (SELECT a.symbol, a.ts, a.state, a.y, list(b.y ORDER BY b.y) AS u, coalesce(list(b.y ORDER BY b.y) FILTER (b.state = a.state), []) AS c FROM ys a JOIN ys b ON a.symbol = b.symbol AND b.k <= a.k - 6 AND b.y IS NOT NULL WHERE a.y IS NOT NULL GROUP BY 1, 2, 3, 4),
sc AS (SELECT symbol, ts, state, len(c) AS n_cond,
  list_sum(list_transform(c, lambda x: abs(x - y))) / len(c) - list_sum(list_transform(c, lambda x, i: (2 * (i - 1) - len(c) + 1) * x)) / (len(c) * len(c)) AS crps_c,
  list_sum(list_transform(u, lambda x: abs(x - y))) / len(u) - list_sum(list_transform(u, lambda x, i: (2 * (i - 1) - len(u) + 1) * x)) / (len(u) * len(u)) AS crps_u FROM pl WHERE len(c) >= 20 AND len(u) >= 20)"""
_SCORED = BASE.rstrip() + ", " + RAW + ",\n" + _Y + "\n"


def _targets(spark, d):
    b = O.with_base(K.bars_1h(spark, d)).withColumn("y", O.future_rv(6))
    c = F.col("close")
    s = F.when(c > 14, "high_vol_chop").when(c > 9, "trend_up").when(c > 5, "range").otherwise("squeeze")
    return b.select("symbol", "ts", s.alias("state"), "y", "close")


@query("o417_conditional_skill", _SCORED + "SELECT symbol, ts, state, round(crps_c, 6) AS crps_c, round(crps_u, 6) AS crps_u, n_cond FROM sc")
def o417(spark, d):
    return S.conditional_skill(_targets(spark, d), 6).select("symbol", "ts", "state", r6("crps_c"), r6("crps_u"), "n_cond")


@query("o418_crps", with_(BARS_1D) + "SELECT symbol, year, round(list_sum(list_transform(s, lambda x: abs(x - y))) / len(s) - list_sum(list_transform(s, lambda x, i: (2 * (i - 1) - len(s) + 1) * x)) / (len(s) * len(s)) + 3e-6::DOUBLE, 4) AS crps FROM (SELECT symbol, year(ts) AS year, list(close ORDER BY close) AS s, avg(close) AS y FROM bars_1d GROUP BY 1, 2)")
def o418(spark, d):
    g = K.bars_1d(spark, d).groupBy("symbol", F.year("ts").cast("long").alias("year")).agg(F.collect_list("close").alias("s"), F.avg("close").alias("y"))
    return g.select("symbol", "year", F.round(S.crps_column(F.col("s"), F.col("y")) + 3e-6, 4).alias("crps"))


@query("o419_skill_summary", _SCORED + "SELECT symbol, count(*) AS n_eval, round(1 - sum(crps_c) / sum(crps_u), 6) AS skill FROM sc GROUP BY symbol")
def o419(spark, d):
    return S.skill(S.conditional_skill(_targets(spark, d), 6)).select("symbol", "n_eval", r6("skill"))


@query("o419_skill_interval")
def o419b(spark, d):
    return S.skill_interval(S.conditional_skill(_targets(spark, d), 6), 12)


@query("o420_surrogate_band")
def o420(spark, d):
    return S.surrogate_band(_targets(spark, d), 6)


_PNL = "pn AS (SELECT symbol, ts, CASE state WHEN 'trend_up' THEN 1.0 WHEN 'squeeze' THEN -1.0 ELSE 0.0 END AS pos, ln(close / lag(close) OVER w) AS r, lead(ts) OVER w IS NULL AS last FROM raw WINDOW w AS (PARTITION BY symbol ORDER BY ts)), pm AS (SELECT *, lag(pos) OVER (PARTITION BY symbol ORDER BY ts) AS held FROM pn)"


_FUND = "ev AS (SELECT event_type AS symbol, ts, value / 10000 AS rate FROM events WHERE event_id % 9 = 0 AND event_type <> 'view'), fb AS (SELECT symbol, date_trunc('hour', ts) AS ts, sum(rate) AS rate FROM ev GROUP BY 1, 2)"


@query("o421_direction_pnl", with_(BARS_1H, RAW, _PNL, _FUND) + """, g AS (SELECT symbol, count(*) AS n_bars, count(*) FILTER (held <> 0) AS n_position_bars, coalesce(sum(held * r), 0) AS gross, sum(CASE WHEN last THEN 0 ELSE abs(pos - coalesce(held, 0)) END) * 5 / 10000.0::DOUBLE AS fees,
  coalesce(sum(held * fb.rate), 0) AS paid FROM pm LEFT JOIN fb USING (symbol, ts) GROUP BY symbol)
SELECT symbol, n_bars, n_position_bars, round(gross, 6) AS gross, round(fees, 6) AS fees, CASE WHEN symbol IN (SELECT symbol FROM ev) THEN round(paid, 6) END AS funding, CASE WHEN symbol IN (SELECT symbol FROM ev) THEN round(gross - fees - paid, 6) END AS net_after_funding FROM g""")
def o421(spark, d):
    r = _raw(spark, d).withColumn("state", F.when(F.col("state") == "squeeze", "trend_down").otherwise(F.col("state")))
    events = K.table(spark, d, "events").where("event_id % 9 = 0 and event_type <> 'view'").select(F.col("event_type").alias("symbol"), "ts", (F.col("value") / 10_000).alias("rate"))
    return S.direction_pnl(r, funding=events).select("symbol", "n_bars", "n_position_bars", r6("gross"), r6("fees"), r6("funding"), r6("net_after_funding"))


@query("o316_hysteresis_grid")
def o316(spark, d):
    return S.hysteresis_grid(_targets(spark, d).withColumnRenamed("state", "raw_state"), 24)


@query("o422_experiment_fanout", with_(BARS_1H, RAW) + "SELECT symbol, h, count(*) AS n FROM raw, (VALUES (6), (24)) v(h) WHERE rn + h <= (SELECT count(*) FROM bars_1h b WHERE b.symbol = raw.symbol) GROUP BY 1, 2")
def o422(spark, d):
    b = O.with_base(K.bars_1h(spark, d))
    b = b.withColumns({f"y{h}": F.lead("close", h).over(X.series()) for h in (6, 24)})
    return b.groupBy("symbol").agg(F.array(*[F.struct(F.lit(h).alias("h"), F.count(f"y{h}").alias("n")) for h in (6, 24)]).alias("g")).select("symbol", F.inline("g"))


@query("o425_confirm_variants", f"""WITH RECURSIVE {BARS_1H}, {RAW},
f AS (SELECT symbol, rn, ts, state AS cur, CAST(NULL AS VARCHAR) AS pend FROM raw WHERE rn = 1
  UNION ALL SELECT raw.symbol, raw.rn, raw.ts, CASE WHEN raw.state = f.pend THEN raw.state ELSE f.cur END, CASE WHEN raw.state = f.cur OR raw.state = f.pend THEN NULL ELSE raw.state END
  FROM f JOIN raw ON raw.symbol = f.symbol AND raw.rn = f.rn + 1)
SELECT symbol, ts, cur AS confirmed FROM f""")
def o425(spark, d):
    """Every state confirmed by two bars."""
    return S.confirm(_raw(spark, d, "raw_state"), needs=lambda s, f, e: 2).select("symbol", "ts", "confirmed")
