"""Window specifications and rolling functions that the features share. Features of one series use one partitioning and order,
so that Spark sorts a series once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

#: Bars that a feature may look back on.
SLICE = 400
RANK = 250


def series(*keys: str) -> WindowSpec:
    return W.partitionBy(*(keys or ("symbol",))).orderBy("ts")


def rows(n: int, w: WindowSpec | None = None) -> WindowSpec:
    """The last n rows, the current one included."""
    return (w or series()).rowsBetween(-(n - 1), 0)


def full(agg: Callable[[Column], Column], x: Column, n: int, w: WindowSpec | None = None, least: int | None = None) -> Column:
    """An aggregate of the last n rows where at least `least` (all n) of them are known; else null."""
    r = rows(n, w)
    return F.when(F.count(x).over(r) >= (least or n), agg(x).over(r))


def share_below(values: Column, x: Column, least: int) -> Column:
    """Share of values strictly below x; null under `least` values."""
    return F.when(F.size(values) >= least, F.size(F.filter(values, lambda v: v < x)) / F.size(values))


def rolling_rank(x: Column, n: int = RANK, w: WindowSpec | None = None) -> Column:
    """Strict rank among the known values of the last n rows; null where the value or a second one lacks."""
    return F.when(x.isNotNull(), share_below(F.collect_list(x).over(rows(n, w)), x, 2))


def valid_rank(df: DataFrame, col: str, out: str, n: int = RANK, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Strict rank among the last n known values; an unknown value gives the last known one's rank, fewer than two 0.5."""
    x = F.col(col)
    # known values first, each in its order: the last n rows of a known one are then known ones, without a join
    packed = W.partitionBy(*keys).orderBy(x.isNull(), "ts").rowsBetween(-(n - 1), 0)
    own = F.when(x.isNotNull(), F.coalesce(share_below(F.collect_list(col).over(packed), x, 2), F.lit(0.5)))
    df = df.withColumn("_rank", own)
    seen = F.last("_rank", ignorenulls=True).over(series(*keys).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(out, F.coalesce(seen, F.lit(0.5))).drop("_rank")


def ema(x: Column, span: int, n: int = SLICE, w: WindowSpec | None = None) -> Column:
    """Exponential mean seeded with the first value of the slice of the last n rows."""
    a = 2.0 / (span + 1)
    values = F.collect_list(x).over(rows(n, w))
    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values), F.lit(1))), F.element_at(values, 1), lambda e, v: F.lit(1 - a) * e + F.lit(a) * v)


def in_blocks(df: DataFrame, lookback: int, block: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Rows with _block and _own: a series cut into blocks of rows, each preceded by its look-back (where _own is false), so
    that a function over a group never gets more than block + lookback rows of a long series."""
    n = F.row_number().over(series(*keys)) - 1
    b = F.floor(F.col("_n") / block)
    more = F.when(F.col("_n") % block >= block - lookback, F.array(b, b + 1)).otherwise(F.array(b))
    return df.withColumn("_n", n).withColumn("_block", F.explode(more)).withColumn("_own", F.col("_block") == b)


def numbered(clock: DataFrame, out: str = "row") -> DataFrame:
    """Distinct times `ts` numbered from 0 in order. Times are ordered within their day; only the days' counts, a row a day, meet in one window."""
    day = clock.withColumn("_d", F.to_date("ts"))
    days = day.groupBy("_d").agg(F.count(F.lit(1)).alias("_n"))
    days = days.select("_d", (F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_d")) - F.col("_n")).alias("_before"))
    return day.join(days, "_d").withColumn(out, F.col("_before") + F.row_number().over(W.partitionBy("_d").orderBy("ts")) - 1).drop("_d", "_before")


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b) of two doubles by the rules of floating point, for which ANSI division and Spark's logarithm stand in the way: infinite where b
    is 0, minus infinity where a is, NaN where both are; null where the ratio is negative."""
    inf = float("inf")
    quotient = F.when(b != 0, a / b).when(b == 0, F.when(a > 0, inf).when(a < 0, -inf).otherwise(F.when(a.isNotNull(), float("nan"))))
    return F.when(quotient == 0, -inf).otherwise(F.ln(quotient))


def safe_corr(x: str, y: str) -> Column:
    """Pearson's correlation as an aggregate; null where a side doesn't vary (under ANSI rules the built-in one raises there)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    x, y = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def safe_slope(y: str, x: str) -> Column:
    """Least-squares slope as an aggregate; null where x doesn't vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    x, y = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.covar_pop(x, y) / F.nullif(F.var_pop(x), F.lit(0.0))
