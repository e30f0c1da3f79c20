"""Joins in time that Spark has no operator for: as-of, windows of another series, nearest events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], cols: list[str], ts: str = "ts", right_ts: str = "ts", strict: bool = False) -> DataFrame:
    """Each left row with the latest right row at or before it (before it: strict). One union and one sort by (keys, time) instead of
    a join of ranges, so that rows of a key are neither multiplied nor all held at once."""
    mark = F.struct(F.col(right_ts).alias("_rts"), *cols)
    shown = left.withColumn("_t", F.col(ts)).withColumn("_side", F.lit(0 if strict else 1)).withColumn("_r", F.lit(None))
    known = right.select(*keys, F.col(right_ts).alias("_t"), F.lit(1 if strict else 0).alias("_side"), mark.alias("_r"))
    w = W.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    both = shown.unionByName(known, allowMissingColumns=True).withColumn("_seen", F.last("_r", ignorenulls=True).over(w))
    own = F.col("_side") == (0 if strict else 1)
    return both.where(own).select(*left.columns, F.col("_seen._rts").alias("matched_ts"), *(F.col(f"_seen.{c}").alias(c) for c in cols))


def shifted_asof(df: DataFrame, keys: list[str], value: str, hours: int) -> DataFrame:
    """Each row's value as it was known some hours ago."""
    past = df.where(F.col(value).isNotNull()).select(*keys, "ts", F.col(value).alias("past"))
    now = df.withColumn("_now", F.col("ts")).withColumn("ts", F.col("ts") - F.make_dt_interval(hours=F.lit(hours)))
    return asof_join(now, past, keys, ["past"]).withColumn("ts", F.col("_now")).drop("_now", "matched_ts")


def interval_attribution(events: DataFrame, seconds: int, value: str) -> DataFrame:
    """Events added up by the bar in whose interval they fall: an equi-join key instead of a range."""
    from tidemark.operators.bars import bucket

    return events.groupBy("symbol", bucket(F.col("ts"), seconds).alias("ts")).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("n"))


def event_within(bars: DataFrame, events: DataFrame, days: int, day: Column, event_day: Column, keys: list[str]) -> DataFrame:
    """Whether an event follows within so many calendar days (0 included). Events are spread to the days before them and met by
    equality; distinct days bound the blow-up."""
    ahead = events.select(*keys, event_day.alias("_e")).distinct()
    ahead = ahead.select(*keys, F.explode(F.sequence(F.date_sub("_e", days), F.col("_e"))).alias("_d")).distinct().withColumn("in_window", F.lit(True))
    return bars.withColumn("_d", day).join(ahead, [*keys, "_d"], "left").drop("_d").withColumn("in_window", F.coalesce("in_window", F.lit(False)))


def nearest_event(points: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """The nearest event in days, before or after; of equal distances the past one. Two as-of passes."""
    e = events.select(*keys, F.col("ts").alias("e_ts")).distinct()
    before = asof_join(points, e, keys, ["e_ts"], right_ts="e_ts").withColumnRenamed("e_ts", "prev").drop("matched_ts")
    flipped = e.select(*keys, (-F.unix_micros(F.col("e_ts").cast("timestamp"))).alias("neg"), "e_ts")
    both = asof_join(before.withColumn("neg", -F.unix_micros(F.col("ts").cast("timestamp"))), flipped, keys, ["e_ts"], ts="neg", right_ts="neg").drop("matched_ts", "neg").withColumnRenamed("e_ts", "next")
    dp, dn = F.date_diff("prev", "ts"), F.date_diff("next", "ts")
    past = dn.isNull() | (F.abs(dp) <= F.abs(dn))
    return both.withColumn("days", F.when(dp.isNotNull() & past, dp).otherwise(dn)).drop("prev", "next")


def event_proximity(points: DataFrame, events: DataFrame, by: list[str], horizon: int = 10) -> DataFrame:
    """The nearest dated event of each point (symbol, ts in UTC, named by `by`) within `horizon` calendar days, today being New York's: days (negative:
    over), event_ts, pub_type and uncertain. One of today that was due before the open or after the close is over from 9:30, from 16:00 on (days -1);
    of today without a known time `uncertain` is told. Of equally near ones the past, then the earlier one. Points without an event near are left out.

    events: symbol, ts (its UTC date counts), pub_type (BEFORE, AFTER, in any case, or null). Events are spread over the days that they are near to and met by
    equality, so that no range is joined."""
    from tidemark.operators.quality import CLOSE_MINUTE, OPEN_MINUTE, et

    e = events.select("symbol", F.col("ts").alias("event_ts"), F.upper("pub_type").alias("pub_type")).distinct().withColumn("_day", F.to_date("event_ts"))
    e = e.withColumn("_today", F.explode(F.sequence(F.date_sub("_day", horizon), F.date_add("_day", horizon))))
    p = points.withColumn("_et", et(F.col("ts"))).withColumns({"_today": F.to_date("_et"), "_minute": F.hour("_et") * 60 + F.minute("_et")})
    j = p.join(e, ["symbol", "_today"])
    days = F.date_diff("_day", "_today")
    over = F.when(F.col("pub_type") == "BEFORE", F.col("_minute") >= OPEN_MINUTE).when(F.col("pub_type") == "AFTER", F.col("_minute") >= CLOSE_MINUTE)
    known = F.coalesce(F.col("pub_type").isin("BEFORE", "AFTER"), F.lit(False))
    j = j.withColumn("days", F.when((days == 0) & F.coalesce(over, F.lit(False)), -1).otherwise(days)).withColumn("uncertain", (days == 0) & ~known)
    best = F.min(F.struct(F.abs("days").alias("far"), "days", "event_ts", "pub_type", "uncertain"))
    return j.groupBy(*by).agg(best.alias("m")).select(*by, "m.days", "m.event_ts", "m.pub_type", "m.uncertain")


def pairs(df: DataFrame, key: str = "symbol", on: str | list[str] = "ts", value: str = "r") -> DataFrame:
    """Values of two keys at one time (and one panel, where `on` names it), each unordered pair once; both known."""
    on = [on] if isinstance(on, str) else on
    a = df.where(F.col(value).isNotNull()).select(F.col(key).alias("a"), *on, F.col(value).alias("x"))
    b = df.where(F.col(value).isNotNull()).select(F.col(key).alias("b"), *on, F.col(value).alias("y"))
    return a.join(b, on).where("a < b")
