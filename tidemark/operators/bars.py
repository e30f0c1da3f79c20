"""Resampling of bars and other aggregations over series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def bucket(ts, seconds: int):
    """The grid time at or before ts, counted from the epoch."""
    s = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(s - F.pmod(s, F.lit(seconds * 1_000_000))).cast("timestamp_ntz")


def resample(df: DataFrame, seconds: int, full: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars of a coarser grid. A bucket without all its `full` bars goes, unless it is the series' last one."""
    g = df.groupBy(*keys, bucket(F.col("ts"), seconds).alias("_b")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts")
    )
    nxt = F.lead("_b").over(W.partitionBy(*keys).orderBy("_b"))
    return g.withColumn("_next", nxt).where((F.col("n") == full) | F.col("_next").isNull()).withColumnRenamed("_b", "ts").drop("_next")


def hourly_last(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Each hour's last known value of every column."""
    g = df.groupBy(*keys, bucket(F.col("ts"), 3600).alias("hour"))
    return g.agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in cols))


def previous_period(df: DataFrame, period: str) -> DataFrame:
    """High and low of the day or Monday week before that of the series' latest bar; no row where it is absent."""
    step = {"day": F.make_dt_interval(days=F.lit(1)), "week": F.make_dt_interval(days=F.lit(7))}[period]
    p = F.date_trunc(period, "ts").cast("timestamp_ntz")
    levels = df.groupBy("symbol", p.alias("p")).agg(F.max("high").alias("hi"), F.min("low").alias("lo"))
    latest = df.groupBy("symbol").agg(F.max(p).alias("now")).select("symbol", (F.col("now") - step).alias("p"))
    return levels.join(latest, ["symbol", "p"])


def poc(df: DataFrame, width: DataFrame, hours: int = 240, cover: float = 0.8, lag_hours: int = 2) -> DataFrame:
    """The price bucket with most volume of the last hours, the lower one on a tie; nothing where hours lack.
    df: hourly bars with quote_vol; width: (symbol, width, end) with the first hour that isn't over."""
    slot = bucket(F.col("ts"), 3600)
    rows = df.where("volume > 0 and quote_vol > 0").withColumn("slot", slot)
    last = F.col("end") - F.make_dt_interval(hours=F.lit(1))
    rows = rows.join(width, "symbol").where((F.col("slot") <= last) & (F.col("slot") >= last - F.make_dt_interval(hours=F.lit(hours - 1))))
    ok = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), F.max("slot").alias("_latest"), F.max(last).alias("_last"))
    ok = ok.where((F.col("_n") >= cover * hours) & (F.col("_latest") >= F.col("_last") - F.make_dt_interval(hours=F.lit(lag_hours)))).select("symbol")
    g = rows.groupBy("symbol", "width", F.floor(F.col("quote_vol") / F.col("volume") / F.col("width")).alias("b")).agg(F.sum("volume").alias("v"))
    best = g.groupBy("symbol", "width").agg(F.min(F.struct((-F.col("v")).alias("v"), "b")).alias("m"))
    return best.join(ok, "symbol").select("symbol", F.col("m.b").alias("bucket"), (-F.col("m.v")).alias("volume"), ((F.col("m.b") + 0.5) * F.col("width")).alias("point"))


def islands(df: DataFrame, state: str = "state", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Episode numbers from 0: one more at each change of state."""
    w = W.partitionBy(*keys).orderBy("ts")
    change = F.coalesce((F.lag(state).over(w) != F.col(state)).cast("long"), F.lit(0).cast("long"))
    return df.withColumn("_c", change).withColumn("episode", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_c")


def segments(df: DataFrame, state: str = "state", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Runs of one state: start, end and number of bars."""
    g = islands(df, state, keys).groupBy(*keys, "episode", state)
    return g.agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("bars"))


def episode_stats(df: DataFrame, state: str = "state") -> DataFrame:
    """Runs and their lengths by state."""
    return segments(df, state).groupBy(state).agg(F.count(F.lit(1)).alias("runs"), F.percentile("bars", 0.5).alias("median_bars"), F.max("bars").alias("max_bars"))


def transitions(df: DataFrame, state: str = "state") -> DataFrame:
    """Counts of changes from one state to another; a series' last run leads nowhere."""
    s = segments(df, state)
    to = F.lead(state).over(W.partitionBy("symbol").orderBy("episode"))
    return s.withColumn("to_state", to).where("to_state is not null").groupBy(F.col(state).alias("from_state"), "to_state").agg(F.count(F.lit(1)).alias("n"))
