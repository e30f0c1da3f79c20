"""Stored pages of perpetual futures (a text each) as sparse rows: snapshots, histories, settlement intervals. Column functions only; what can't be read
gives null or no row, and no value is made up for what isn't known.

A sparse row: symbol, ts, oi, oi_notional, funding, kind (settled or pred, of funding alone), premium, taker_ratio; null where a row has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import windows as X

METRICS = ("oi", "oi_notional", "funding", "premium", "taker_ratio")
#: Hours that settlements are apart, where they are apart regularly.
INTERVALS = (1, 2, 4, 8)


def _number(c: Column) -> Column:
    v = c.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def _time(ms: Column) -> Column:
    return F.timestamp_millis(ms.try_cast("bigint")).cast("timestamp_ntz")


def _row(df: DataFrame, ts: Column, keep: list[str], **values: Column) -> DataFrame:
    own = {m: values.get(m, F.lit(None)).cast("double") for m in METRICS}
    return df.select(*keep, ts.alias("ts"), *[c.alias(k) for k, c in own.items()], values.get("kind", F.lit(None)).cast("string").alias("kind"))


def snapshots(pages: DataFrame) -> DataFrame:
    """A row of each snapshot. pages: symbol, ts (when it was taken), index, interest and ratio (texts): the first has the marked and the index price and
    the predicted rate, the second the open interest, the third a list of ratios of which the last counts; it may be null, the others not."""
    i = F.from_json("index", "struct<markPrice:string,indexPrice:string,lastFundingRate:string>")
    mark, spot, oi = _number(i["markPrice"]), _number(i["indexPrice"]), _number(F.get_json_object("interest", "$.openInterest"))
    ratios = F.from_json("ratio", "array<struct<buySellRatio:string>>")
    last = F.when(F.size(ratios) > 0, _number(F.try_element_at(ratios, F.lit(-1))["buySellRatio"]))
    rows = _row(pages, F.col("ts"), ["symbol"], oi=oi, oi_notional=oi * mark, funding=_number(i["lastFundingRate"]), kind=F.lit("pred"), premium=(mark - spot) / F.nullif(spot, F.lit(0.0)), taker_ratio=last)
    return rows.where("oi is not null and funding is not null")


def histories(pages: DataFrame) -> DataFrame:
    """Rows of stored histories, each metric on a grid of its own. pages: symbol, what (funding, interest, ratio, premium), text. The last bar of a page
    of premiums was still forming and goes."""
    of = lambda what, kind: pages.where(F.col("what") == what).select("symbol", F.explode(F.from_json("text", f"array<{kind}>")).alias("x"))
    x = lambda name: F.col(f"x.{name}")
    parts = [
        _row(of("funding", "struct<fundingTime:string,fundingRate:string>"), _time(x("fundingTime")), ["symbol"], funding=_number(x("fundingRate")), kind=F.lit("settled")),
        _row(of("interest", "struct<timestamp:string,sumOpenInterest:string,sumOpenInterestValue:string>"), _time(x("timestamp")), ["symbol"], oi=_number(x("sumOpenInterest")), oi_notional=_number(x("sumOpenInterestValue"))),
        _row(of("ratio", "struct<timestamp:string,buySellRatio:string>"), _time(x("timestamp")), ["symbol"], taker_ratio=_number(x("buySellRatio"))),
    ]
    bars = F.from_json("text", "array<array<string>>")
    closed = pages.where("what = 'premium'").select("symbol", F.explode(F.slice(bars, F.lit(1), F.greatest(F.size(bars) - 1, F.lit(0)))).alias("x"))
    parts.append(_row(closed, _time(F.get("x", F.lit(0))), ["symbol"], premium=_number(F.get("x", F.lit(4)))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    known = F.coalesce(*[F.col(m) for m in METRICS]).isNotNull()
    return out.where(F.col("ts").isNotNull() & known)


def merged(rows: DataFrame) -> DataFrame:
    """One row of each symbol and time with what its rows know; a settled rate before a predicted one, of several values of one metric the greatest."""
    settled = F.max(F.when(F.col("kind") == "settled", F.col("funding")))
    funding = F.coalesce(settled, F.max("funding"))
    kind = F.when(settled.isNotNull(), "settled").when(F.max("funding").isNotNull(), "pred")
    return rows.groupBy("symbol", "ts").agg(*[F.max(m).alias(m) for m in METRICS if m != "funding"], funding.alias("funding"), kind.alias("kind"))


def settlements(rows: DataFrame, told: DataFrame | None = None, tolerance_seconds: int = 60) -> DataFrame:
    """(symbol, ts, rate, hours, per_year) of settled rates. hours: what the venue has told, as of then (told: symbol, ts, hours); else what the times
    show: the step from the settlement before, to the nearest `tolerance_seconds`, where it is one of INTERVALS and the step before or after is the
    same. So a settlement that is missing makes no interval of twice the length, and what isn't known stays null, as does the rate per year.
    Predicted rates don't count: they come every few minutes."""
    w = X.series()
    s = rows.where("kind = 'settled' and funding is not null").groupBy("symbol", "ts").agg(F.max("funding").alias("rate"))
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    slot = F.round(sec / tolerance_seconds) * tolerance_seconds
    s = s.withColumn("_slot", slot).withColumn("_step", (F.col("_slot") - F.lag("_slot").over(w)) / 3_600)
    regular = F.col("_step").isin(*map(float, INTERVALS)) & (F.lag("_step").over(w).eqNullSafe(F.col("_step")) | F.lead("_step").over(w).eqNullSafe(F.col("_step")))
    s = s.withColumn("hours", F.when(regular, F.col("_step")))
    if told is not None:
        from tidemark.operators.joins import asof_join

        known = told.where("hours > 0").select("symbol", "ts", F.col("hours").cast("double").alias("_told"))
        s = asof_join(s, known, ["symbol"], ["_told"]).withColumn("hours", F.coalesce("_told", "hours"))
    return s.select("symbol", "ts", "rate", "hours", F.try_divide(F.col("rate") * 8_760, F.col("hours")).alias("per_year"))


def rates(rows: DataFrame, settled: DataFrame) -> DataFrame:
    """(symbol, ts, rate, kind): settled rates, and of the predicted ones those that no settlement has replaced: one replaces all within its hours before
    it. A settlement of unknown hours replaces none but those at its own time. settled: settlements."""
    known = settled.select("symbol", "ts", "rate", F.lit("settled").alias("kind"), F.struct("ts", "hours").alias("_next"))
    pred = rows.where("kind = 'pred' and funding is not null").select("symbol", "ts", F.col("funding").alias("rate"), F.lit("pred").alias("kind"))
    both = known.unionByName(pred, allowMissingColumns=True)
    # backwards in time, as a frame that grows is one pass and one that shrinks is added up anew for each row; of rows at one time the settled one
    # first, so that it is ahead of the predicted one
    ahead = W.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("kind")).rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("_ahead", F.last("_next", ignorenulls=True).over(ahead))
    gap = F.unix_seconds(F.col("_ahead.ts").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    replaced = (F.col("kind") == "pred") & F.coalesce((gap == 0) | (gap < F.col("_ahead.hours") * 3_600), F.lit(False))
    return both.where(~replaced).select("symbol", "ts", "rate", "kind")
