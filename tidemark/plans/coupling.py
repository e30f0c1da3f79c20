"""Queries of pairs and panels."""

from pyspark.sql import functions as F

from tidemark.functions.windows import safe_corr, series
from tidemark.operators import coupling as C
from tidemark.operators import features as O
from tidemark.plans.features import r6
from tidemark.plans.quality import FULL_RTH
from tidemark.plans.registry import query
from tidemark.sources import canonical as K
from tidemark.sources.canonical import BARS_1H, PANEL_1D, REGISTRY, with_

_R = "rr AS (SELECT symbol, ts, CASE WHEN ts - lag(ts) OVER w = INTERVAL 1 HOUR THEN ln(close / lag(close) OVER w) END AS r FROM bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY ts))"
_PAIRS = "pr AS (SELECT x.symbol AS a, y.symbol AS b, x.ts, x.r AS x, y.r AS y FROM rr x JOIN rr y ON x.ts = y.ts AND x.symbol < y.symbol WHERE x.r IS NOT NULL AND y.r IS NOT NULL)"


def _r(spark, d):
    return O.panel_returns(K.bars_1h(spark, d), 3600).select("symbol", "ts", "r")


_A = 1 - 0.5 ** (1 / 140.0)
_EW = "list_reduce(list_prepend(0.0::DOUBLE, array_agg({0}) OVER (PARTITION BY a, b ORDER BY ts)), lambda s, v: " + f"{1 - _A!r}::DOUBLE * s + {_A!r}::DOUBLE * v)"


@query("o409_pair_rho", with_(BARS_1H, _R, _PAIRS) + f", e AS (SELECT a, b, ts, {_EW.format('x * y')} AS sxy, {_EW.format('x * x')} AS sxx, {_EW.format('y * y')} AS syy FROM pr) SELECT a, b, ts, round(sxy / sqrt(sxx * syy), 6) AS rho_fast FROM e WHERE sxx > 0 AND syy > 0")
def o409(spark, d):
    return C.pair_rho(_r(spark, d)).where("rho_fast is not null").select("a", "b", "ts", r6("rho_fast"))


_KEEP = repr(1 - (1 - 0.5 ** (1 / 420.0)))


@query("o410_pairwise_ewma_corr", with_(BARS_1H, _R, _PAIRS) + f""", ow AS (SELECT symbol, sum(pow({_KEEP}, k) * r * r) / sum(pow({_KEEP}, k)) AS var FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) - 1 AS k FROM rr WHERE r IS NOT NULL) GROUP BY symbol),
jo AS (SELECT a, b, sum(pow({_KEEP}, k) * x * y) / sum(pow({_KEEP}, k)) AS cov, count(*) AS n_joint FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ts DESC) - 1 AS k FROM pr) GROUP BY a, b)
SELECT a, b, round(greatest(-1, least(1, cov / sqrt(p.var * q.var))), 6) AS corr, n_joint FROM jo JOIN ow p ON p.symbol = a JOIN ow q ON q.symbol = b""")
def o410(spark, d):
    return C.pairwise_corr(_r(spark, d), C.HALF_SLOW, "r").select("a", "b", r6("corr"), "n_joint")


@query("o359_ewma_standardize", with_(BARS_1H, _R) + f""", q AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos FROM rr)
SELECT x.symbol, x.ts, round(x.r, 6) AS r, round(x.r / sqrt(sum(pow({_KEEP}, x.pos - y.pos) * y.r * y.r) / sum(pow({_KEEP}, x.pos - y.pos))), 6) AS z FROM q x JOIN q y ON x.symbol = y.symbol AND y.pos < x.pos WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY x.symbol, x.ts, x.r HAVING count(*) >= 30""")
def o359(spark, d):
    return C.standardize(_r(spark, d)).where("z is not null").select("symbol", "ts", r6("r"), r6("z"))


@query("o411_sign_rate")
def o411(spark, d):
    r = _r(spark, d).where("r is not null")
    return C.sign_rate(r, C.pairwise_corr(r, C.HALF_SLOW, "r"), C.HALF_SLOW, "r")


@query("o412_pair_table")
def o412(spark, d):
    return C.pair_table(_r(spark, d))


@query("o413_pair_states")
def o413(spark, d):
    return C.pair_states(C.pair_rho(_r(spark, d)))


@query("o414_bootstrap_false_alarms")
def o414(spark, d):
    return C.false_alarms(_r(spark, d))


@query("o323_power_test")
def o323(spark, d):
    """Each series with a twin that shares four fifths of it: as many paths as a search over parameters takes."""
    z = C.standardize(_r(spark, d)).where("z is not null")
    ahead = F.lead("z", 7).over(series())
    twins = z.withColumn("z", 0.8 * F.col("z") + 0.6 * F.coalesce(ahead, F.lit(0.0))).withColumn("symbol", F.concat("symbol", F.lit("'")))
    pairs = z.select(F.col("symbol").alias("a"), F.concat("symbol", F.lit("'")).alias("b")).distinct()
    return C.power_test(z.unionByName(twins), paths=50, only=pairs)


_W1 = "ln(close / lag(close) OVER w)"
_PANEL = f"pw AS (SELECT symbol, ts, {_W1} AS r FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY ts)), pp AS (SELECT x.symbol AS a, y.symbol AS b, x.r AS x, y.r AS y FROM pw x JOIN pw y ON x.ts = y.ts AND x.symbol < y.symbol WHERE x.r IS NOT NULL AND y.r IS NOT NULL), pc AS (SELECT a, b, count(*) AS n, corr(x, y) AS corr FROM pp GROUP BY 1, 2 HAVING count(*) >= 60)"


def _panel(spark, d):
    return K.panel_1d(spark, d).withColumn("r", F.ln(F.col("close") / F.lag("close").over(series())))


def _panel_corr(spark, d):
    from tidemark.operators.joins import pairs

    return pairs(_panel(spark, d)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), safe_corr("x", "y").alias("corr")).where("n >= 60")


@query("o213_panel_pair_corr", with_(PANEL_1D, _PANEL) + "SELECT a, b, n, round(corr, 6) AS corr FROM pc")
def o213(spark, d):
    return _panel_corr(spark, d).withColumn("corr", F.round("corr", 6))


@query("o307_block_stats", with_(PANEL_1D, REGISTRY, _PANEL) + """, q AS (SELECT a, b, corr FROM pc UNION ALL SELECT b, a, corr FROM pc), j AS (SELECT x.theme[1] AS block, a, corr, x.theme[1] = y.theme[1] AS inside FROM q JOIN registry x ON x.symbol = a JOIN registry y ON y.symbol = b)
SELECT block, count(DISTINCT a) AS n, round(avg(corr) FILTER (inside), 6) AS intra, round(avg(corr) FILTER (NOT inside), 6) AS extra FROM j GROUP BY block""")
def o307(spark, d):
    blocks = K.registry(spark, d).select("symbol", F.element_at("theme", 1).alias("block"))
    return C.block_stats(_panel_corr(spark, d), blocks).select("block", "n", r6("intra"), r6("extra"))


@query("o307_global_stats", with_(PANEL_1D, _PANEL) + "SELECT (SELECT count(DISTINCT s) FROM (SELECT a AS s FROM pc UNION SELECT b FROM pc)) AS n, round(avg(corr), 6) AS mean_corr, round(stddev_pop(corr), 6) AS dispersion FROM pc HAVING count(*) > 0")
def o307b(spark, d):
    return C.global_stats(_panel_corr(spark, d)).select("n", r6("mean_corr"), r6("dispersion"))


@query("o307_market_mode")
def o307c(spark, d):
    return C.global_stats(_panel_corr(spark, d)).select("n", r6("market_mode"))


@query("o415_shrink_corr")
def o415(spark, d):
    return C.shrink_corr(_r(spark, d))


_K420 = repr(0.5 ** (1 / 420.0))
_KIND = "CASE symbol WHEN 'click' THEN 'crypto' WHEN 'view' THEN 'commodity' WHEN 'signup' THEN 'intl_stock_perp' ELSE 'us_stock_perp' END"
_THEME = "CASE symbol WHEN 'view' THEN 'macro_asset' WHEN 'click' THEN 'crypto_major' WHEN 'purchase' THEN 'ai_infra' ELSE 'other' END"
_HOURS = ", ".join(f"'{c}'" for c in C.ALL_HOURS)


@query("o416_composite_matrix", with_(BARS_1H, f"""rg AS (SELECT *, row_number() OVER (ORDER BY pool <> 'core', CASE theme WHEN 'crypto_major' THEN 0 WHEN 'macro_asset' THEN 2 WHEN 'ai_infra' THEN 3 ELSE 8 END, symbol) - 1 AS i
  FROM (SELECT DISTINCT symbol, {_KIND} AS class, {_THEME} AS theme, CASE WHEN symbol = 'click' THEN 'observation' ELSE 'core' END AS pool FROM bars_1h)),
ce AS (SELECT x.i, y.i AS j, x.symbol AS a, y.symbol AS b, CASE WHEN x.class IN ({_HOURS}) AND y.class IN ({_HOURS}) THEN 'all247' WHEN x.class = 'us_stock_perp' AND y.class = 'us_stock_perp' THEN 'usrth' ELSE 'cross' END AS clock FROM rg x JOIN rg y ON x.i < y.i),
me AS (SELECT clock, a AS symbol FROM ce UNION SELECT clock, b FROM ce),
pb AS (SELECT clock, symbol, ts, close FROM bars_1h JOIN me USING (symbol) WHERE clock = 'all247' OR ({FULL_RTH})),
rt AS (SELECT clock, symbol, ts, CASE WHEN ts - lag(ts) OVER w = INTERVAL 1 HOUR THEN ln(close / lag(close) OVER w) END AS r, dense_rank() OVER (PARTITION BY clock ORDER BY ts) AS pos FROM pb WINDOW w AS (PARTITION BY clock, symbol ORDER BY ts)),
st AS (SELECT x.clock, x.symbol, x.ts, x.r / sqrt(sum(pow({_K420}, x.pos - y.pos) * y.r * y.r) / sum(pow({_K420}, x.pos - y.pos))) AS z FROM rt x JOIN rt y ON x.clock = y.clock AND x.symbol = y.symbol AND y.pos < x.pos WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY x.clock, x.symbol, x.ts, x.r HAVING count(*) >= 30 AND sum(y.r * y.r) > 0),
ow AS (SELECT clock, symbol, sum(pow({_K420}, k) * z * z) / sum(pow({_K420}, k)) AS var FROM (SELECT *, row_number() OVER (PARTITION BY clock, symbol ORDER BY ts DESC) - 1 AS k FROM st) GROUP BY 1, 2),
jt AS (SELECT ce.clock, ce.a, ce.b, x.ts, x.z AS x, y.z AS y FROM ce JOIN st x ON x.clock = ce.clock AND x.symbol = ce.a JOIN st y ON y.clock = ce.clock AND y.symbol = ce.b AND y.ts = x.ts),
jo AS (SELECT clock, a, b, sum(pow({_K420}, k) * x * y) / sum(pow({_K420}, k)) AS cov, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ts DESC) - 1 AS k FROM jt) GROUP BY 1, 2, 3)""") + """SELECT ce.i, ce.j, ce.a, ce.b, ce.clock, CASE WHEN cov / sqrt(p.var * q.var) IS NOT NULL THEN round(greatest(-1, least(1, cov / sqrt(p.var * q.var))), 6) END AS corr, coalesce(n, 0) AS n_joint, coalesce(cov / sqrt(p.var * q.var) IS NOT NULL AND n >= 400, false) AS valid
FROM ce LEFT JOIN jo ON jo.a = ce.a AND jo.b = ce.b LEFT JOIN ow p ON p.clock = ce.clock AND p.symbol = ce.a LEFT JOIN ow q ON q.clock = ce.clock AND q.symbol = ce.b""")
def o416(spark, d):
    """Every cell by its own clock; sessions need the calendar's years."""
    b = K.bars_1h(spark, d).withColumn("ts", F.col("ts") + F.make_ym_interval(years=F.lit(2)))
    kinds = b.select("symbol", F.expr(_KIND).alias("class"), F.expr("CASE WHEN symbol = 'click' THEN 'observation' ELSE 'core' END").alias("pool"), F.array(F.expr(_THEME)).alias("theme"))
    return C.composite_matrix(b, kinds.distinct()).withColumn("corr", F.round("corr", 6))


_LAST = "list_reduce(list_prepend(0.0::DOUBLE, list({0} ORDER BY ts)), lambda s, v: {1!r}::DOUBLE * s + {2!r}::DOUBLE * v)"


def _last_rho(rate: float) -> str:
    sums = [_LAST.format(v, 1 - rate, rate) for v in ("x * y", "x * x", "y * y")]
    return f"greatest(-1, least(1, {sums[0]} / sqrt({sums[1]} * {sums[2]})))"


@query("o321_block_votes", with_(PANEL_1D, REGISTRY, _PANEL) + f""", pt AS (SELECT x.symbol AS a, y.symbol AS b, x.ts, x.r AS x, y.r AS y FROM pw x JOIN pw y ON x.ts = y.ts AND x.symbol < y.symbol WHERE x.r IS NOT NULL AND y.r IS NOT NULL),
pl AS (SELECT a, b, {_last_rho(1 - 0.5 ** (1 / 420.0))} AS rho FROM pt GROUP BY a, b),
cr AS (SELECT least(u.theme[1], v.theme[1]) AS block_a, greatest(u.theme[1], v.theme[1]) AS block_b, rho, coalesce(abs(corr) >= 0.05, false) AS coupled FROM pl LEFT JOIN pc USING (a, b) JOIN registry u ON u.symbol = a JOIN registry v ON v.symbol = b WHERE u.theme[1] <> v.theme[1]),
g AS (SELECT block_a, block_b, count(*) AS n_pairs, median(rho) AS median_rho, avg(coupled::INT::DOUBLE) AS coupled_share FROM cr GROUP BY 1, 2),
ix AS (SELECT theme[1] AS block, ts, avg(r) AS r FROM pw JOIN registry USING (symbol) WHERE r IS NOT NULL GROUP BY 1, 2),
ip AS (SELECT x.block AS block_a, y.block AS block_b, x.ts, x.r AS x, y.r AS y FROM ix x JOIN ix y ON x.ts = y.ts AND x.block < y.block),
il AS (SELECT block_a, block_b, {_last_rho(1 - 0.5 ** (1 / 140.0))} AS index_rho FROM ip GROUP BY 1, 2),
v AS (SELECT *, (abs(median_rho) >= 0.25)::INT + coalesce((abs(index_rho) >= 0.35)::INT, 0) + (coupled_share >= 0.5)::INT AS votes FROM g LEFT JOIN il USING (block_a, block_b))
SELECT block_a, block_b, n_pairs, round(median_rho, 6) AS median_rho, round(index_rho, 6) AS index_rho, round(coupled_share, 6) AS coupled_share, votes, CASE WHEN votes >= 2 THEN 'coupled' ELSE 'not_coupled' END AS state FROM v""")
def o321(spark, d):
    blocks = K.registry(spark, d).select("symbol", F.element_at("theme", 1).alias("block"))
    states = _panel_corr(spark, d).select("a", "b", F.when(F.abs("corr") >= 0.05, "coupled").otherwise("decoupled").alias("state"))
    v = C.block_votes(_panel(spark, d), states, blocks)
    return v.select("block_a", "block_b", "n_pairs", r6("median_rho"), r6("index_rho"), r6("coupled_share"), "votes", "state")


@query("o530_coupling_overview", with_(PANEL_1D, REGISTRY, _PANEL) + "SELECT CASE WHEN x.class = 'us_stock_perp' AND y.class = 'us_stock_perp' THEN 'usrth' WHEN x.class <> 'us_stock_perp' AND y.class <> 'us_stock_perp' THEN 'all247' ELSE 'cross' END AS panel, count(*) AS n_pairs, round(avg(corr), 6) AS mean_corr, round(stddev_pop(corr), 6) AS dispersion FROM pc JOIN registry x ON x.symbol = a JOIN registry y ON y.symbol = b GROUP BY 1")
def o530(spark, d):
    """Global figures of each panel."""
    c = _panel_corr(spark, d).select(F.col("a").alias("low"), F.col("b").alias("high"), "corr")
    m = C.cells(K.registry(spark, d)).join(c, ["low", "high"])
    return m.groupBy(F.col("clock").alias("panel")).agg(F.count(F.lit(1)).alias("n_pairs"), r6(F.avg("corr"), "mean_corr"), r6(F.stddev_pop("corr"), "dispersion"))


@query("o530_coupling_pairs")
def o530b(spark, d):
    """State, correlations, distances and last change of each eligible pair: here every series and its twin."""
    z = C.standardize(_r(spark, d)).where("z is not null").select("symbol", "ts", F.col("z").alias("r"))
    twins = z.withColumn("r", 0.9 * F.col("r") + 0.4 * F.coalesce(F.lead("r", 7).over(series()), F.lit(0.0))).withColumn("symbol", F.concat("symbol", F.lit("'")))
    return C.pair_overview(z.unionByName(twins))


@query("o322_injected_break")
def o322(spark, d):
    """A pair that moves together and then apart: the machine's changes."""
    b = _r(spark, d).where("symbol = 'click' and r is not null")
    twin = b.select(F.lit("twin").alias("symbol"), "ts", F.when(F.dayofmonth("ts") < 20, F.col("r") * 0.9).otherwise(F.when(F.hour("ts") % 2 == 0, F.col("r")).otherwise(-F.col("r"))).alias("r"))
    s = C.pair_states(C.pair_rho(b.unionByName(twin), fast=20.0, slow=200.0), C.Params(window=120, least=30))
    return s.where("reason is not null")
