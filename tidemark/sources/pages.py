"""Stored vendor pages (a text each) as rows: index histories in CSV, price charts and option marks in JSON. Column functions only; a page that isn't
what it should be gives no rows, and so does a line or a point of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def index_history(pages: DataFrame, text: str = "text") -> DataFrame:
    """ts (the trading day's midnight) and close of every line with a date (month/day/year) and a number. The header tells the columns. pages: other
    columns are kept."""
    keep = [c for c in pages.columns if c != text]
    lines = F.split(F.col(text), "\r?\n")
    head = F.transform(F.split(F.get(lines, F.lit(0)), ","), lambda c: F.upper(F.trim(c)))
    p = pages.select(*keep, head.alias("_head"), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))).alias("_lines"))
    p = p.select(*keep, "_head", F.explode("_lines").alias("_line"))  # in a step of its own: a line carries the header, not the page
    cell = lambda name: F.trim(F.get(F.split("_line", ","), F.nullif(F.array_position("_head", name), F.lit(0)).cast("int") - 1))
    p = p.select(*keep, F.try_to_timestamp(cell("DATE"), F.lit("MM/dd/yyyy")).cast("timestamp_ntz").alias("ts"), cell("CLOSE").try_cast("double").alias("close"))
    return p.where("ts is not null and close is not null and not isnan(close)")


_CHART = "chart struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>>>>>"


def chart(pages: DataFrame, text: str = "text") -> DataFrame:
    """Bars of price charts: lists of times (seconds) and of prices side by side; points without a close are left out."""
    keep = [c for c in pages.columns if c != text]
    r = pages.select(*keep, F.get(F.from_json(text, _CHART)["chart"]["result"], F.lit(0)).alias("_r"))
    q = F.get(F.col("_r.indicators.quote"), F.lit(0))
    names = ("open", "high", "low", "close", "volume")
    series = [F.coalesce(q[n], F.array().cast("array<double>")) for n in names]
    r = r.select(*keep, F.col("_r.timestamp").alias("t"), *[x.alias(n) for x, n in zip(series, names, strict=True)])
    r = r.select(*keep, F.arrays_zip("t", *names).alias("_z"))
    r = r.select(*keep, F.explode("_z").alias("_p"))  # shorter lists end in nulls
    r = r.select(*keep, F.timestamp_seconds("_p.t").cast("timestamp_ntz").alias("ts"), *[f"_p.{n}" for n in names])
    return r.where("ts is not null and close is not null")


def _finite(c: Column) -> Column:
    v = c.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def option_marks(pages: DataFrame, text: str = "text") -> DataFrame:
    """underlying, expiry, strike, kind (C or P) and iv of lists of marks, each named UNDERLYING-YYMMDD-STRIKE-KIND; an iv that isn't above 0 is none."""
    keep = [c for c in pages.columns if c != text]
    m = pages.select(*keep, F.explode(F.from_json(text, "array<struct<symbol:string,markIV:string>>")).alias("_m"))
    part = lambda i: F.get(F.split("_m.symbol", "-"), F.lit(i))
    m = m.where(F.size(F.split("_m.symbol", "-")) == 4)
    m = m.select(*keep, part(0).alias("underlying"), F.try_to_date(part(1), "yyMMdd").alias("expiry"), _finite(part(2)).alias("strike"), part(3).alias("kind"), _finite(F.col("_m.markIV")).alias("iv"))
    return m.where("expiry is not null and strike is not null and kind in ('C', 'P')").withColumn("iv", F.when(F.col("iv") > 0, F.col("iv")))
