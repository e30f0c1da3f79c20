"""Predicates and data-quality operators on bar series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

KEYS = ("symbol",)


def _w(*keys: str):
    return W.partitionBy(*(keys or KEYS)).orderBy("ts")


def closed(df: DataFrame, asof: Column, seconds: int) -> DataFrame:
    """Bars that are over at `asof`: ts is the opening time, a bar that ends right then is closed."""
    return df.where(F.col("ts") + F.make_dt_interval(secs=F.lit(seconds)) <= asof)


def closed_tail(df: DataFrame, asof: Column, seconds: int, n: int) -> DataFrame:
    """The last n closed bars: first closed, then the tail."""
    w = W.partitionBy(*KEYS).orderBy(F.col("ts").desc())
    return closed(df, asof, seconds).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def tail_days(df: DataFrame, days: int) -> DataFrame:
    """Rows of the last calendar days before the series' own last point, both ends included."""
    last = df.groupBy(*KEYS).agg(F.max("ts").alias("_last"))
    return df.join(last, list(KEYS)).where(F.col("ts") >= F.col("_last") - F.make_dt_interval(days=F.lit(days))).drop("_last")


def finite(c: Column) -> Column:
    """A number, or null for NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def number(s: Column) -> Column:
    """A text as a finite number, or null."""
    return finite(F.expr("1D") * s.try_cast("double"))


def grid_report(df: DataFrame, seconds: int) -> DataFrame:
    """Distinct offsets of a series' times on its grid; one means that it sits on it."""
    off = F.pmod(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(seconds * 1000))
    return df.groupBy(*KEYS).agg(F.count_distinct(off).alias("n_offsets"), F.min(off).alias("anchor_ms"))


def gaps(df: DataFrame, seconds: int) -> DataFrame:
    """Number of steps that aren't one bar, and the worst as a multiple of a bar."""
    step = (F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lag("ts").over(_w()).cast("timestamp"))) / (seconds * 1000)
    steps = df.select(*KEYS, step.alias("step"))
    return steps.groupBy(*KEYS).agg(F.count_if(F.col("step") != 1).alias("n_gaps"), F.coalesce(F.max("step"), F.lit(1.0)).alias("worst"))


def scale_breaks(df: DataFrame, ratio: float = 3.0) -> DataFrame:
    """Bars that open at more than `ratio` times the last close, or at less than its inverse; closes of zero and below don't count."""
    pc = F.lag("close").over(_w())
    r = F.when((pc > 0) & F.col("open").isNotNull(), F.col("open") / pc)
    return df.withColumn("ratio", r).where((F.col("ratio") > ratio) | (F.col("ratio") < 1 / ratio))


def non_finite_report(df: DataFrame, cols: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    bad = F.lit(False)
    for c in cols:
        bad = bad | finite(F.col(c).cast("double")).isNull()
    return df.groupBy(*KEYS).agg(F.count_if(bad).alias("n_bad"), F.count(F.lit(1)).alias("n"))


def first_revision(old: DataFrame, new: DataFrame, rel: float = 1e-9) -> DataFrame:
    """The first time at which new bars differ from stored ones, or come in before the stored end; null columns compare as values."""
    cols = ("open", "high", "low", "close", "volume")
    o = old.select(*KEYS, "ts", *(F.col(c).alias(f"_{c}") for c in cols), F.lit(True).alias("_has"))
    end = old.groupBy(*KEYS).agg(F.max("ts").alias("_end"))
    j = new.join(o, [*KEYS, "ts"], "left").join(end, list(KEYS))
    differs = F.lit(False)
    for c in cols:
        a, b = F.col(c).cast("double"), F.col(f"_{c}").cast("double")
        near = F.abs(a - b) <= rel * F.greatest(F.abs(a), F.abs(b))
        differs = differs | ~F.coalesce(near, a.isNull() & b.isNull())
    changed = F.when(F.col("_has"), differs).otherwise(F.col("ts") < F.col("_end"))
    return j.where(changed).groupBy(*KEYS).agg(F.min("ts").alias("first_changed"))


def invalidate(states: DataFrame, revised: DataFrame) -> DataFrame:
    """Stored states that still hold: those before the first change of their series."""
    return states.join(revised, list(KEYS), "left").where("first_changed is null or ts < first_changed").drop("first_changed")


def valid_window(df: DataFrame, n: int = 15) -> DataFrame:
    """Whether the last n bars are all complete and in order (low <= open, close <= high)."""
    ok = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high"))
    w = _w().rowsBetween(-(n - 1), 0)
    return df.withColumn("valid", (F.count(F.lit(1)).over(w) == n) & F.every(F.coalesce(ok, F.lit(False))).over(w))


def rebuild_diff(stored: DataFrame, rebuilt: DataFrame, rel: float = 1e-6) -> DataFrame:
    """Stored bars whose volume isn't that of the complete bucket they were made of."""
    r = rebuilt.select(*KEYS, "ts", F.col("volume").alias("rebuilt_volume"))
    far = F.abs(F.col("volume") - F.col("rebuilt_volume")) > rel * F.greatest(F.abs("volume"), F.abs("rebuilt_volume"))
    return stored.join(r, [*KEYS, "ts"]).where(far)


# ---------------------------------------------------------------- sessions

#: Full closures and early closes (13:00) of the New York exchange.
HOLIDAYS = (
    "2025-01-01", "2025-01-09", "2025-01-20", "2025-02-17", "2025-04-18", "2025-05-26", "2025-06-19", "2025-07-04", "2025-09-01", "2025-11-27", "2025-12-25",
    "2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25", "2026-06-19", "2026-07-03", "2026-09-07", "2026-11-26", "2026-12-25",
    "2027-01-01", "2027-01-18", "2027-02-15", "2027-03-26", "2027-05-31", "2027-06-18", "2027-07-05", "2027-09-06", "2027-11-25", "2027-12-24",
)
EARLY_CLOSES = ("2025-07-03", "2025-11-28", "2025-12-24", "2026-11-27", "2026-12-24", "2027-11-26")
YEARS = (2025, 2027)
OPEN_MINUTE, CLOSE_MINUTE, EARLY_MINUTE = 570, 960, 780


def et(ts: Column) -> Column:
    """A UTC time as New York wall-clock time."""
    return F.from_utc_timestamp(ts.cast("timestamp"), "America/New_York")


def is_trading_day(day: Column) -> Column:
    """By the table; false outside its years."""
    return F.year(day).between(*YEARS) & (F.weekday(day) < 5) & ~F.date_format(day, "yyyy-MM-dd").isin(*HOLIDAYS)


def is_probable_trading_day(day: Column) -> Column:
    """As above within the table's years, any weekday outside."""
    return F.when(F.year(day).between(*YEARS), is_trading_day(day)).otherwise(F.weekday(day) < 5)


def close_minute(day: Column) -> Column:
    return F.when(F.date_format(day, "yyyy-MM-dd").isin(*EARLY_CLOSES), EARLY_MINUTE).otherwise(CLOSE_MINUTE)


def minute_of_day(t: Column) -> Column:
    return F.hour(t) * 60 + F.minute(t)


def is_rth(ts: Column, trading_day=is_trading_day) -> Column:
    t = et(ts)
    return trading_day(t) & (minute_of_day(t) >= OPEN_MINUTE) & (minute_of_day(t) < close_minute(t))


def bar_full_rth(ts: Column, seconds: int, trading_day=is_trading_day) -> Column:
    """The whole bar lies in one session."""
    a = et(ts)
    b = et(ts.cast("timestamp") + F.make_dt_interval(secs=F.lit(seconds)))
    return trading_day(a) & (minute_of_day(a) >= OPEN_MINUTE) & (F.to_date(a) == F.to_date(b)) & (minute_of_day(b) <= close_minute(a))


def breadth_slot(ts: Column, trading_day=is_trading_day) -> Column:
    """The sampling slot of a time: 0945 from 9:40 to 10:10, 1559 from 15 minutes before the close to 5 after it."""
    t = et(ts)
    m, c = minute_of_day(t), close_minute(t)
    return F.when(trading_day(t), F.when(m.between(580, 610), "0945").when(m.between(c - 15, c + 5), "1559"))


def settled_only(df: DataFrame, now: Column) -> DataFrame:
    """Rows of trading days that are over: a row of today's session only after its close. ts is the day."""
    n = et(now)
    today = F.to_date("ts") == F.to_date(n)
    return df.where(is_probable_trading_day(F.col("ts")) & ((F.to_date("ts") < F.to_date(n)) | (today & (minute_of_day(n) >= close_minute(n)))))


def last_trading_day(day: Column, back: int = 7) -> Column:
    """The day itself or the nearest probable trading day before it."""
    days = F.sequence(F.to_date(day), F.date_sub(F.to_date(day), back), F.expr("interval -1 day"))
    return F.element_at(F.filter(days, is_probable_trading_day), 1)


# ---------------------------------------------------------------- health


def health(df: DataFrame, now: Column, seconds: int, warmup: int = 280) -> DataFrame:
    """Series whose history is short (warmup) or whose last bar is over 1.5 bars old (stale)."""
    age = F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("last_ts").cast("timestamp")) - seconds * 1000
    g = df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("bars"), F.max("ts").alias("last_ts"))
    return g.withColumn("warmup", F.col("bars") < warmup).withColumn("stale", age > 1.5 * seconds * 1000)


def lane(age: Column, ok: float, warn: float) -> Column:
    return F.when(age.isNull(), "idle").when(age <= ok, "ok").when(age <= warn, "warn").otherwise("bad")


def missing_states(targets: DataFrame, stored: DataFrame, version: str, audit: str) -> DataFrame:
    """Targets that no row of both current versions covers."""
    have = stored.where((F.col("version") == version) & (F.col("audit_version") == audit))
    return targets.join(have, [*KEYS, "ts"], "left_anti")
