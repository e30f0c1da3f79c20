"""Setups at every bar as they could have been known then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as X
from tidemark.operators import policy as P
from tidemark.operators import state as S
from tidemark.operators import zones as Z

#: Hours whose volume makes the price with most volume.
POC_HOURS = 240


def states_of(bars: DataFrame) -> DataFrame:
    """(symbol, ts, state): the confirmed state of every bar from the 90th on."""
    told = S.confirm(S.classify(S.inputs(bars)).withColumnRenamed("state", "raw_state"))
    return told.select("symbol", "ts", F.col("confirmed").alias("state"))


def walk_forward(
    bars: DataFrame, slow: DataFrame, fast: DataFrame, volume: DataFrame | None = None, *, seconds: tuple[int, int, int] = (14_400, 86_400, 3_600),
    states: DataFrame | None = None, slow_states: DataFrame | None = None, n: int = X.SLICE,
) -> DataFrame:
    """The setup (policy.assemble) of every bar, from what was closed by the time that the bar closed: its zones, those of volume included, its own and
    the slow timeframe's confirmed states, and the oscillators of three timeframes. A row for each bar; `at` tells whether it stands at a level.

    bars, slow, fast: series (symbol, ts, open, high, low, close, volume), ts when a bar opens; seconds: their bars' lengths; volume: hourly bars with
    volume and quote_vol; states, slow_states: (symbol, ts, state), made of the bars if they aren't given.

    Every bar is one row throughout: windows give what its zones are built of. What other series knew by then comes by closing time, all of them in
    one union that is dealt and sorted once. Nothing of later bars is used, so that a series cut anywhere has the same setups up to there."""
    length, slow_length, fast_length = seconds
    states = states_of(bars) if states is None else states
    slow_states = states_of(slow) if slow_states is None else slow_states
    closed = lambda sec: F.unix_seconds(F.col("ts").cast("timestamp")) + sec
    shown = Z.summaries(bars, n).withColumns({"_t": closed(length), "_own": F.lit(True)})
    facts = {
        **{name: (df, sec, F.col("state")) for name, df, sec in (("regime", states, length), ("regime_slow", slow_states, slow_length))},
        **{name: (S.cyclic_rsi(df).withColumn("bars", F.row_number().over(X.series())), sec, F.struct("crsi", "pos", "zone", F.col("bars").cast("long").alias("bars"))) for name, df, sec in (("main", bars, length), ("slow", slow, slow_length), ("fast", fast, fast_length))},
    }
    rows = shown
    for name, (df, sec, value) in facts.items():
        rows = rows.unionByName(df.select("symbol", closed(sec).alias("_t"), value.alias(name)), allowMissingColumns=True)
    hour = "struct<slot:bigint,price:double,volume:double>"
    if volume is None:
        rows = rows.withColumn("_hour", F.lit(None).cast(hour))
    else:
        told = Z.hours_of(volume).select("symbol", (F.col("slot") + 3_600).alias("_t"), F.struct("slot", "price", "volume").alias("_hour"))
        rows = rows.unionByName(told, allowMissingColumns=True)
    # frames by time and not by rows: whatever closes with a bar is known to it, in whichever order the rows come
    w = X.W.partitionBy("symbol").orderBy("_t")
    known = w.rangeBetween(X.W.unboundedPreceding, 0)
    rows = rows.withColumns({**{name: F.last(name, ignorenulls=True).over(known) for name in facts}, "_hours": F.collect_list("_hour").over(w.rangeBetween(-3_600 * (POC_HOURS - 1), 0))})
    width = F.when(F.col("valid") & (F.col("atr") > 0), Z.POC_BUCKET * F.col("atr"))
    rows = rows.where("_own").withColumns({"poc": Z.poc_of(F.col("_hours"), width, F.col("_t"), POC_HOURS), "poc_width": width}).drop("_hours", "_hour", "_own")
    return P.assemble(Z.zones_of(rows))


def placed(walk: DataFrame) -> DataFrame:
    """The rows of `walk_forward` that stand at a level, which is what is kept of a walk. (The array of one keeps the optimizer from pushing the
    filter below the projections, where it would build all zones a second time.)"""
    return walk.select(F.inline_outer(F.array(F.struct(*walk.columns)))).where(F.col("at").isin("at_support", "at_resistance"))
