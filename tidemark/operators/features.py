"""Features of a bar series. Each function adds columns by window expressions over (symbol, ts)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import windows as X
from tidemark.operators.quality import bar_full_rth, et, is_trading_day

BARS_PER_YEAR = {"1h": 8760, "4h": 2190, "1d": 365}
#: Of all bars, of sessions, and of what the two have in common.
CLOCKS = ("all247", "usrth", "cross")


def true_range(strict: bool = False) -> Column:
    """Range of a bar, gaps to the last close included; the first bar's is its own range (strict: null)."""
    pc = F.lag("close").over(X.series())
    plain = F.col("high") - F.col("low")
    wide = F.greatest(plain, F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
    return F.when(pc.isNotNull(), wide) if strict else F.when(pc.isNull(), plain).otherwise(wide)


def log_return() -> Column:
    pc = F.lag("close").over(X.series())
    return X.log_ratio(F.col("close"), pc)


def with_base(df: DataFrame) -> DataFrame:
    """tr, atr (14, plain mean), ret, chg, n (bar number from 1)."""
    w = X.series()
    df = df.withColumns({"tr": true_range(), "ret": log_return(), "chg": F.col("close") - F.lag("close").over(w), "n": F.row_number().over(w)})
    return df.withColumn("atr", X.full(F.avg, F.col("tr"), 14))


def volatility(df: DataFrame, per_year: int = 8760) -> DataFrame:
    """atr_pct, rv30, bbw, vol_accel, downside_share and the ranks and flags made of them. df: with_base."""
    r = F.col("ret")
    sd20 = X.full(F.stddev_samp, F.col("close"), 20)
    down = F.when(r < 0, r * r).when(r.isNotNull(), F.lit(0.0))
    df = df.withColumns(
        {
            "atr_pct": F.round(F.col("atr") / F.col("close"), 9),
            "rv30": X.full(F.stddev_samp, r, 30) * float(np.sqrt(per_year)),
            "bbw": F.round(F.lit(4.0) * sd20 / X.full(F.avg, F.col("close"), 20), 9),
            "vol_accel": F.round(X.full(F.stddev_samp, r, 12) / F.nullif(X.full(F.stddev_samp, r, 72), F.lit(0.0)), 9),
            "downside_share": X.full(F.sum, down, 48) / F.nullif(X.full(F.sum, r * r, 48), F.lit(0.0)),
        }
    )
    for col, out in (("atr_pct", "atr_rank"), ("bbw", "bbw_rank"), ("vol_accel", "accel_rank")):
        df = X.valid_rank(df, col, out)
    return df.withColumns({"squeeze": (F.col("bbw_rank") < 0.15) & (F.col("atr_rank") < 0.30), "high_vol": F.col("atr_rank") > 0.85})


def session_bucket(ts: Column) -> Column:
    """Hour in New York, weekend hours apart."""
    t = et(ts)
    return F.hour(t) + F.when(F.weekday(t) >= 5, 24).otherwise(0)


def deseasonalized(df: DataFrame) -> DataFrame:
    """atr_ds: the mean range after dividing by the past ranges of the same session bucket, and its rank. Causal: factors stop before
    the bar."""
    df = df.withColumn("bucket", session_bucket(F.col("ts"))).withColumn("trp", F.col("tr") / F.col("close"))
    w = X.series("symbol", "bucket").rowsBetween(-30, -1)
    a = X.series().rowsBetween(-240, -1)
    fac = F.when(F.count("trp").over(w) >= 8, F.avg("trp").over(w))
    overall = F.when(F.count("trp").over(a) >= 48, F.avg("trp").over(a))
    df = df.withColumn("tr_ds", F.col("trp") / F.nullif(fac, F.lit(0.0)) * overall)
    df = df.withColumn("atr_ds", F.round(X.full(F.avg, F.col("tr_ds"), 14), 9))
    ranked = X.valid_rank(df, "atr_ds", "atr_rank_ds")
    return ranked.withColumn("atr_rank_ds", F.when(F.col("atr_ds").isNotNull(), F.col("atr_rank_ds")))


def efficiency_ratio(n: int = 30) -> Column:
    net = F.abs(F.col("close") - F.lag("close", n).over(X.series()))
    return net / F.nullif(X.full(F.sum, F.abs("chg"), n), F.lit(0.0))


def pivots(df: DataFrame, k: int = 4) -> DataFrame:
    """pivot_high, pivot_low: a bar's high (low) where it is the extreme of k bars on either side and strictly beyond the k before."""
    w = X.series()
    both, left = w.rowsBetween(-k, k), w.rowsBetween(-k, -1)
    inside = (F.count(F.lit(1)).over(both) == 2 * k + 1) & (F.count(F.lit(1)).over(left) == k)
    hi = inside & (F.col("high") == F.max("high").over(both)) & (F.col("high") > F.max("high").over(left))
    lo = inside & (F.col("low") == F.min("low").over(both)) & (F.col("low") < F.min("low").over(left))
    return df.withColumns({"pivot_high": F.when(hi, F.col("high")), "pivot_low": F.when(lo, F.col("low"))})


def _steps(values: Column, pairs: int) -> Column:
    last = F.slice(values, F.greatest(F.size(values) - pairs, F.lit(1)), F.lit(pairs + 1))
    a = F.slice(last, 1, F.greatest(F.size(last) - 1, F.lit(0)))
    b = F.slice(last, F.lit(2), F.greatest(F.size(last) - 1, F.lit(0)))
    return F.zip_with(a, b, lambda x, y: F.when(y > x, 1.0).otherwise(-1.0))


def direction(df: DataFrame, k: int = 4, pairs: int = 3, n: int = X.SLICE) -> DataFrame:
    """pivot_dir: mean of +1 (higher) and -1 over the last steps of confirmed highs and lows within the slice. df: pivots."""
    w = X.series().rowsBetween(-(n - 1 - k), -k)
    s = F.concat(_steps(F.collect_list("pivot_high").over(w), pairs), _steps(F.collect_list("pivot_low").over(w), pairs))
    df = df.withColumn("_s", s)
    return df.withColumn("pivot_dir", F.when(F.size("_s") > 0, F.aggregate("_s", F.lit(0.0), lambda x, y: x + y) / F.size("_s")).otherwise(0.0)).drop("_s")


def structure(df: DataFrame) -> DataFrame:
    """ema_slope, donchian_pos, above_ema200, direction, swing_high, swing_low. df: with_base."""
    df = direction(pivots(df))
    w = X.series()
    w400 = X.rows(X.SLICE)
    seen = F.least(F.col("n"), F.lit(X.SLICE))
    df = df.withColumns({"closes": F.collect_list("close").over(w400), "seen": seen})

    def folded(span: int, values: Column) -> Column:
        a = 2.0 / (span + 1)
        return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values), F.lit(1))), F.element_at(values, 1), lambda e, v: F.lit(1 - a) * e + F.lit(a) * v)

    before = F.slice(F.col("closes"), F.lit(1), F.greatest(F.size("closes") - 10, F.lit(1)))  # same seed, ten bars earlier
    slope = (folded(50, F.col("closes")) - folded(50, before)) / (F.col("atr") * 10)
    # the channel has min(100, seen - 1) bars
    hi = F.when(F.col("seen") > 100, F.max("high").over(X.rows(100))).otherwise(F.max("high").over(w.rowsBetween(-98, 0)))
    lo = F.when(F.col("seen") > 100, F.min("low").over(X.rows(100))).otherwise(F.min("low").over(w.rowsBetween(-98, 0)))
    first = F.col("seen") <= 100
    highs, lows = F.collect_list("high").over(X.rows(100)), F.collect_list("low").over(X.rows(100))
    hi = F.when(first, F.array_max(F.slice(highs, F.lit(2), F.greatest(F.size(highs) - 1, F.lit(1))))).otherwise(hi)
    lo = F.when(first, F.array_min(F.slice(lows, F.lit(2), F.greatest(F.size(lows) - 1, F.lit(1))))).otherwise(lo)
    df = df.withColumns(
        {
            "ema_slope": F.when((F.col("atr") > 0) & (F.col("seen") > 11), F.tanh(F.lit(2.0) * slope)).otherwise(0.0),
            "donchian_pos": (F.col("close") - lo) / F.greatest(hi - lo, F.lit(1e-12)),
            "above_ema200": F.when(F.col("seen") >= 200, F.when(F.col("close") > folded(200, F.col("closes")), 1.0).otherwise(-1.0)),
            "swing_high": F.last("pivot_high", ignorenulls=True).over(w.rowsBetween(-(X.SLICE - 5), -4)),
            "swing_low": F.last("pivot_low", ignorenulls=True).over(w.rowsBetween(-(X.SLICE - 5), -4)),
        }
    )
    core = 0.45 * F.col("pivot_dir") + 0.25 * F.col("ema_slope") + 0.20 * (2 * F.col("donchian_pos") - 1)
    d = F.when(F.col("above_ema200").isNotNull(), core + 0.10 * F.col("above_ema200")).otherwise(core / 0.9)
    return df.withColumn("direction", d).drop("closes")


def volume(df: DataFrame) -> DataFrame:
    """vol_z20, vol_rank, tilt, breakout (up, down or null), breakout_rank. df: with_base."""
    v = F.col("volume").cast("double")
    w = X.series()
    r20 = X.rows(20)
    up, down = F.sum(F.when(F.col("chg") > 0, v).otherwise(0.0)).over(r20), F.sum(F.when(F.col("chg") < 0, v).otherwise(0.0)).over(r20)
    df = X.valid_rank(df.withColumn("_v", v), "_v", "vol_rank")
    before = w.rowsBetween(-60, -1)
    whole = F.count("high").over(before) == 60
    hit = F.when(whole & (F.col("close") > F.max("high").over(before)), "up").when(whole & (F.col("close") < F.min("low").over(before)), "down")
    df = df.withColumn("_hit", F.when(hit.isNotNull(), F.struct(hit.alias("dir"), F.col("vol_rank").alias("rank"))))
    last = F.last("_hit", ignorenulls=True).over(X.rows(5))
    return df.withColumns(
        {
            "vol_z20": (v - X.full(F.avg, v, 20)) / (X.full(F.stddev_samp, v, 20) + F.lit(1e-12)),
            "tilt": F.when(up + down > 0, (up - down) / (up + down)).otherwise(0.0),
            "breakout": last["dir"],
            "breakout_rank": last["rank"],
        }
    ).drop("_v", "_hit")


def vwap(bars: DataFrame, hours: int, cover: float = 0.8) -> DataFrame:
    """vwap of the hours that lie wholly in the window before each hourly bar's close; null under the coverage."""
    us = 3_600_000_000
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("symbol").orderBy(t).rangeBetween(-(hours - 1) * us, 0)
    n, q, v = F.count("volume").over(w), F.sum("quote_vol").over(w), F.sum("volume").over(w)
    return bars.withColumn(f"vwap_{hours}", F.when((n >= cover * hours) & (v > 0), q / v))


def vwap_deviation(df: DataFrame, col: str, least: int = 60) -> DataFrame:
    """dev: distance of the close to a vwap in ATRs; dev_rank from `least` known distances on. df: with_base and vwap."""
    df = df.withColumn("dev", F.when(F.col("atr") > 0, F.round((F.col("close") - F.col(col)) / F.col("atr"), 9)))
    df = X.valid_rank(df, "dev", "dev_rank")
    n = F.count("dev").over(X.series().rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("dev_rank", F.when(F.col("dev").isNotNull() & (n >= least), F.col("dev_rank")))


def path(df: DataFrame, window: int = 120, block: int = 4096) -> DataFrame:
    """chop_freq, dom_period and kendall_tau of the last `window` closes; all null where one lacks."""
    if window < 100:
        raise ValueError("a window of at least 100 bars")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        x = pdf["close"].to_numpy(float)
        n = len(x)
        out = pdf.loc[:, ["symbol", "ts"]].assign(chop_freq=np.nan, dom_period=np.nan, kendall_tau=np.nan)
        if n >= window:
            v = np.lib.stride_tricks.sliding_window_view(x, window)
            t = np.arange(window) - (window - 1) / 2
            m = v - v.mean(axis=1, keepdims=True)
            resid = m - (m @ t / (t @ t))[:, None] * t
            resid -= resid.mean(axis=1, keepdims=True)
            crossings, tau = np.zeros(len(v)), np.zeros(len(v))
            for i, r in enumerate(np.sign(resid)):
                r = r[r != 0]
                crossings[i] = np.count_nonzero(r[1:] != r[:-1])
            for lag in range(1, window):
                tau += np.sign(v[:, lag:] - v[:, :-lag]).sum(axis=1)
            ok = np.isfinite(v).all(axis=1)
            at = np.arange(window - 1, n)[ok]
            out.loc[at, "chop_freq"] = (crossings * 100.0 / window)[ok]
            out.loc[at, "dom_period"] = np.where(crossings > 0, 2.0 * window / np.maximum(crossings, 1), np.nan)[ok]
            out.loc[at, "kendall_tau"] = (tau / (window * (window - 1) / 2))[ok]
        out = out[pdf["_own"].to_numpy()]
        return out.astype(object).where(out.notna(), None)

    cut = X.in_blocks(df.select("symbol", "ts", "close"), window - 1, block)
    return cut.groupBy("symbol", "_block").applyInPandas(run, "symbol string, ts timestamp_ntz, chop_freq double, dom_period double, kendall_tau double")


def estimators(df: DataFrame, n: int = 14) -> DataFrame:
    """Range-based volatilities over n bars: parkinson, garman_klass, rogers_satchell (the last two cut at 0). Infinite or NaN over bars with a price of 0."""
    ln = lambda a, b: X.log_ratio(F.col(a), F.col(b))
    hl, co = ln("high", "low"), ln("close", "open")
    rs = ln("high", "close") * ln("high", "open") + ln("low", "close") * ln("low", "open")
    pk = X.full(F.avg, hl * hl, n) / float(4 * np.log(2))
    gk = X.full(F.avg, 0.5 * hl * hl - float(2 * np.log(2) - 1) * co * co, n)
    return df.withColumns({"parkinson": F.sqrt(pk), "garman_klass": F.sqrt(F.greatest(gk, F.lit(0.0))), "rogers_satchell": F.sqrt(F.greatest(X.full(F.avg, rs, n), F.lit(0.0)))})


def future_rv(h: int) -> Column:
    """Root mean square of the next h returns; null where one lacks."""
    w = X.series().rowsBetween(1, h)
    return F.when(F.count("ret").over(w) == h, F.sqrt(F.avg(F.col("ret") * F.col("ret")).over(w)))


def future_range(h: int) -> Column:
    w = X.series().rowsBetween(1, h)
    return F.when(F.count("high").over(w) == h, F.max("high").over(w) - F.min("low").over(w))


# ---------------------------------------------------------------- daily implied and index series


def event_conditioned_rank(df: DataFrame, value: str, near: str, window: int = 504, peers: int = 60, least: int = 120) -> DataFrame:
    """Rank among the earlier rows of the last `window` with the same event flag; the plain rank where these are too few, null where all are.
    Gives rank and basis (event, raw)."""
    w = X.series().rowsBetween(-(window - 1), -1)
    past = F.collect_list(F.struct(F.col(value).alias("v"), F.col(near).alias("e"))).over(w)
    df = df.withColumn("_past", past)
    same = F.filter("_past", lambda p: (p["e"] == F.col(near)) & p["v"].isNotNull())
    known = F.size(F.filter("_past", lambda p: p["v"].isNotNull())) + 1
    df = df.withColumn("_same", same)
    conditional = (F.col(value).isNotNull()) & (known >= least) & (F.size("_same") >= peers)
    rank = F.size(F.filter("_same", lambda p: p["v"] < F.col(value))) / F.nullif(F.size("_same"), F.lit(0))
    raw = F.when(F.count(value).over(X.rows(252)) >= least, X.rolling_rank(F.col(value), 252))
    return df.withColumns({"rank": F.when(conditional, rank).otherwise(raw), "basis": F.when(conditional, "event").when(raw.isNotNull(), "raw")}).drop("_past", "_same")


def vol_bands(df: DataFrame, value: str, span: int = 200, n: int = 200) -> DataFrame:
    """centre (EMA), z against the last n values' deviation, and a label of five positions."""
    x = F.col(value)
    df = df.withColumns({"centre": X.ema(x, span), "sigma": X.full(F.stddev_samp, x, n)})
    df = df.withColumn("z", F.when(F.col("sigma") > 0, (x - F.col("centre")) / F.col("sigma")))
    z = F.col("z")
    label = F.when(z >= 2, "far_above").when(z >= 1, "above").when(z > -1, "inside").when(z > -2, "below").when(z.isNotNull(), "far_below")
    return df.withColumn("position", label)


def panel_returns(df: DataFrame, seconds: int, clock: str = "all247", trading_day=is_trading_day, limit: int | None = None) -> DataFrame:
    """Log returns between neighbours that are exactly one bar apart; null across gaps. Of the clocks `usrth` and `cross` only bars that lie
    whole in a session take part, so that the first of a day has no return. `limit`: the newest bars of each series, before any choice."""
    if clock not in CLOCKS:
        raise ValueError(f"not a clock: {clock!r}")
    if limit is not None:
        df = df.withColumn("_n", F.row_number().over(W.partitionBy("symbol").orderBy(F.col("ts").desc()))).where(F.col("_n") <= limit).drop("_n")
    if clock != "all247":
        df = df.where(bar_full_rth(F.col("ts"), seconds, trading_day))
    w = X.series()
    step = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    return df.withColumn("r", F.when((step == seconds * 1_000_000) & (F.lag("close").over(w) > 0) & (F.col("close") > 0), F.ln(F.col("close") / F.lag("close").over(w))))
