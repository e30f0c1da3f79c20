"""Decisions of incremental loads: authority, pruning, batches and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def by_authority(df: DataFrame, keys: list[str], authority: str, seq: str) -> DataFrame:
    """One row of each key: the highest authority's, of these the latest. A lower authority never replaces a higher one."""
    w = W.partitionBy(*keys).orderBy(F.col(authority).desc(), F.col(seq).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def prune_future(stored: DataFrame, fresh: DataFrame, keys: list[str], symbol: str, now) -> DataFrame:
    """Stored events that stay: a future one goes if the fresh calendar knows its symbol and hasn't the event."""
    known = fresh.select(symbol).distinct().withColumn("_known", F.lit(True))
    there = fresh.select(*keys).distinct().withColumn("_there", F.lit(True))
    j = stored.join(known, symbol, "left").join(there, keys, "left")
    return j.where((F.col("ts") <= now) | F.col("_known").isNull() | F.col("_there").isNotNull()).drop("_known", "_there")


def round_robin(df: DataFrame, order: str, groups: int, turn: int) -> DataFrame:
    """Every groups-th member in order, beginning at `turn`. A registry is small: its order is one sort."""
    return df.withColumn("_i", F.row_number().over(W.orderBy(order)) - 1).where(F.col("_i") % groups == turn % groups).drop("_i")


def blocked(results: DataFrame, symbol: str, run: str, ok: str, most: int = 2) -> DataFrame:
    """Symbols that failed in `most` runs and more: a run counts once for a symbol, and only if some symbol succeeded in it."""
    alive = results.groupBy(run).agg(F.bool_or(ok).alias("_alive")).where("_alive").select(run)
    fails = results.join(alive, run).groupBy(symbol, run).agg(F.bool_or(ok).alias("_ok")).where("not _ok")
    return fails.groupBy(symbol).agg(F.count(F.lit(1)).alias("fails")).where(F.col("fails") >= most)
