"""Bar series and side tables made of the test tables, and the same as SQL for the checks.

bars: symbol, ts, open, high, low, close, volume, quote_vol; ts is when a bar opens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ohlc(df: DataFrame, symbol: str, ts, order: str, value: str) -> DataFrame:
    return df.groupBy(F.col(symbol).alias("symbol"), ts.alias("ts")).agg(
        F.min_by(value, order).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, order).alias("close"),
        F.count(F.lit(1)).alias("volume"),
        F.sum(value).alias("quote_vol"),
    )


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events.value by event type."""
    return _ohlc(table(spark, sf_dir, "events"), "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz"), "ts", "value")


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of orders.o_totalprice by priority."""
    return _ohlc(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderdate"), "o_orderkey", "o_totalprice")


def vol_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily volume, quote volume and price of line items by flag and status."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").alias("ts"))
    return g.agg(F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("quote"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of interest: error events by user."""
    return table(spark, sf_dir, "events").where("event_type = 'error'").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("symbol"), "ts")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments: symbol, class, pool, theme."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # regions: a fixed, tiny dimension
    pool = F.when(F.col("n_nationkey") % 5 == 0, "observation").otherwise("core")
    klass = F.when(F.col("n_nationkey") % 3 == 0, "us_stock_perp").when(F.col("n_nationkey") % 3 == 1, "crypto").otherwise("commodity")
    return j.select(F.col("n_name").alias("symbol"), klass.alias("class"), pool.alias("pool"), F.array("r_name").alias("theme"))


def panel_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly closes of orders by the customer's nation: (symbol, ts, close), a panel of 25 symbols."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])
    return j.groupBy(F.col("n_name").alias("symbol"), F.date_trunc("week", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(F.max_by("o_totalprice", "o_orderkey").alias("close"))


def deriv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse table of several metrics: one column each, null where a row has none."""
    e = table(spark, sf_dir, "events")
    pick = lambda t: F.when(F.col("event_type") == t, F.col("value"))
    return e.select(
        F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("symbol"),
        "ts",
        "event_id",
        pick("click").alias("funding"),
        pick("view").alias("oi"),
        pick("purchase").alias("mark"),
        F.when(F.col("event_id") % 3 == 0, "settled").when(F.col("event_id") % 3 == 1, "pred").alias("kind"),
    )


# ---------------------------------------------------------------- the same as SQL

BARS_1H = """bars_1h AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, ts) AS close, count(*) AS volume, sum(value) AS quote_vol FROM events GROUP BY 1, 2)"""
BARS_1D = """bars_1d AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume, sum(o_totalprice) AS quote_vol FROM orders GROUP BY 1, 2)"""
VOL_DAILY = """vol_daily AS (SELECT l_returnflag || l_linestatus AS symbol, l_shipdate AS ts, sum(l_quantity) AS volume, sum(l_extendedprice) AS quote,
  sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem GROUP BY 1, 2)"""
CALENDAR = "calendar AS (SELECT 'u' || user_id AS symbol, ts FROM events WHERE event_type = 'error')"
REGISTRY = """registry AS (SELECT n_name AS symbol, CASE n_nationkey % 3 WHEN 0 THEN 'us_stock_perp' WHEN 1 THEN 'crypto' ELSE 'commodity' END AS class,
  CASE WHEN n_nationkey % 5 = 0 THEN 'observation' ELSE 'core' END AS pool, [r_name] AS theme FROM nation JOIN region ON n_regionkey = r_regionkey)"""
PANEL_1D = """panel AS (SELECT n_name AS symbol, date_trunc('week', o_orderdate)::TIMESTAMP AS ts, arg_max(o_totalprice, o_orderkey) AS close
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""
DERIV = """deriv AS (SELECT 'u' || (user_id % 10) AS symbol, ts, event_id, CASE WHEN event_type = 'click' THEN value END AS funding,
  CASE WHEN event_type = 'view' THEN value END AS oi, CASE WHEN event_type = 'purchase' THEN value END AS mark,
  CASE event_id % 3 WHEN 0 THEN 'settled' WHEN 1 THEN 'pred' END AS kind FROM events)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
