"""Path spectrum: a series split into scales, and what the split says."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as X

SCALES = (4, 8, 16, 32, 64, 128)
#: Scales from which a swing is slow; limits of the states; half the width of a limit's ramp, in parts of it.
COARSE = 32
SNR, TAU, AMP, FREQ = 4.0, 0.3, 1.15, 8.2
KNEE = 0.2


def decompose(df: DataFrame, value: str = "close", scales: tuple[int, ...] = SCALES) -> DataFrame:
    """d4 ... d128 and trend: causal moving means applied one on the other; the series is exactly their sum. A mean over fewer bars at the start."""
    last = F.col(value)
    df = df.withColumn("_m0", last)
    for i, s in enumerate(scales):
        df = df.withColumn(f"_m{i + 1}", F.avg(f"_m{i}").over(X.rows(s)))
    cols = {f"d{s}": F.col(f"_m{i}") - F.col(f"_m{i + 1}") for i, s in enumerate(scales)}
    return df.withColumns({**cols, "trend": F.col(f"_m{len(scales)}")}).drop(*[f"_m{i}" for i in range(len(scales) + 1)])


def energies(df: DataFrame, scales: tuple[int, ...] = SCALES) -> DataFrame:
    """Share of each scale's energy, the trend's spread counted as one more."""
    sums = {f"d{s}": F.sum(F.col(f"d{s}") * F.col(f"d{s}")) for s in scales} | {"trend": F.var_pop("trend") * F.count("trend")}
    g = df.groupBy("symbol").agg(*[v.alias(k) for k, v in sums.items()])
    total = sum((F.col(k) for k in sums), F.lit(0.0))
    return g.select("symbol", *[(F.col(k) / F.nullif(total, F.lit(0.0))).alias(k) for k in sums])


def dominant(df: DataFrame, scales: tuple[int, ...] = SCALES) -> DataFrame:
    """trend_share, the scale with most energy (of as much the finer one), and the coarse scales' share of all scales. df: energies."""
    best = F.array_max(F.array(*[F.struct(F.col(f"d{s}").alias("e"), F.lit(-s).alias("s")) for s in scales]))
    parts = lambda some: sum((F.col(f"d{s}") for s in some), F.lit(0.0))
    coarse = parts([s for s in scales if s >= COARSE]) / (parts(scales) + 1e-12)
    return df.select("symbol", F.col("trend").alias("trend_share"), (-best["s"]).alias("scale"), coarse.alias("coarse_share"))


def describe(v: np.ndarray) -> tuple[float, ...]:
    """slope, tau, net, amp, snr and crossings of one window of values: the median of all pairwise slopes; Kendall's tau against time; the line's
    net change and the root mean square around it in percent of the mean; their ratio; crossings of the rest's mean, per 100 bars."""
    n = len(v)
    i, j = np.triu_indices(n, 1)
    rise = v[j] - v[i]
    slope = float(np.median(rise / (j - i)))
    order, same = np.sign(rise), float((rise == 0).sum())
    tau = float(order.sum() / np.sqrt(len(i) * (len(i) - same))) if n >= 3 and same < len(i) else 0.0
    x = np.arange(n)
    rest = v - (np.median(v) - slope * np.median(x)) - slope * x
    mean = v.mean()
    amp = float(np.sqrt(np.mean(rest**2)) / mean * 100)
    net = abs(slope) * (n - 1) / mean * 100
    side = np.sign(rest - rest.mean())
    side = side[side != 0]
    return slope, tau, net, amp, net / (amp + 1e-9), round(100 * np.count_nonzero(side[1:] != side[:-1]) / n, 2)


def theil_sen(df: DataFrame, window: int = 192, block: int = 4096, every: int = 1) -> DataFrame:
    """`describe` of the last `window` bars at each bar (of every `every` bars the last, so that `window` gives windows side by side); series run in
    blocks with their look-back."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        v, n = pdf["close"].to_numpy(float), pdf["_n"].to_numpy()
        at = np.flatnonzero(pdf["_own"].to_numpy() & (n >= window - 1) & (n % every == every - 1))
        rows = [(pdf["symbol"].iat[t], pdf["ts"].iat[t], *describe(v[t - window + 1 : t + 1])) for t in at]
        return pd.DataFrame(rows, columns=["symbol", "ts", "slope", "tau", "net", "amp", "snr", "crossings"])

    cut = X.in_blocks(df.select("symbol", "ts", "close"), window - 1, block)
    return cut.groupBy("symbol", "_block").applyInPandas(run, "symbol string, ts timestamp_ntz, slope double, tau double, net double, amp double, snr double, crossings double")


def path_state(tau: Column, snr: Column, amp: Column, crossings: Column, t_amp: Column | float = AMP) -> Column:
    trend = (snr >= SNR) & (F.abs(tau) >= TAU)
    return F.when(trend, F.when(tau > 0, "trend_up").otherwise("trend_down")).when(amp >= t_amp, F.when(crossings <= FREQ, "swing").otherwise("choppy")).otherwise("quiet")


def membership(tau: Column, snr: Column, amp: Column, crossings: Column, t_amp: float = AMP) -> Column:
    """Soft membership of five states, which add up to 1; the two greatest, the margin between them, and the quality that follows. Each limit
    is a ramp of KNEE to both sides; a trend is as sure as the geometric mean of its two conditions."""
    up = lambda x, t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - t * (1 - KNEE)) / (2 * KNEE * t)))
    strong, rising, falling, loud, fast = up(snr, SNR), up(tau, TAU), up(-tau, TAU), up(amp, t_amp), up(crossings, FREQ)
    both = lambda a, b: F.exp((F.log(F.greatest(a, F.lit(1e-6))) + F.log(F.greatest(b, F.lit(1e-6)))) / 2)
    calm = 1 - F.least(strong, F.greatest(rising, falling))
    parts = {
        "trend_up": F.when(rising >= falling, both(strong, rising)).otherwise(0.0), "trend_down": F.when(falling > rising, both(strong, falling)).otherwise(0.0),
        "range": calm * loud * (1 - fast), "noisy": calm * loud * fast, "quiet": calm * (1 - loud),
    }
    total = F.coalesce(F.nullif(sum(parts.values(), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    mu = {k: F.round(v / total, 4) for k, v in parts.items()}
    # of equal ones the first by name of the list above
    ranked = F.array_sort(F.array(*[F.struct((-v).alias("m"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(mu.items())]))
    worst = lambda a, b, c: (mu[a] >= F.greatest(mu[b], mu[c])) & (mu[a] > 0.15)
    quality = F.when(worst("noisy", "range", "quiet"), "noisy").when(worst("quiet", "range", "noisy"), "thin").otherwise("normal")
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return F.struct(*[v.alias(k) for k, v in mu.items()], first["k"].alias("top"), second["k"].alias("second"), F.round(second["m"] - first["m"], 4).alias("margin"), quality.alias("quality"))


def calibrate(df: DataFrame, window: int = 192, share: float = 0.298, least: int = 10) -> DataFrame:
    """The amplitude from which a series counts as loud: a quantile over windows side by side; nothing under `least` windows."""
    w = theil_sen(df, window, every=window)
    return w.groupBy("symbol").agg(F.percentile("amp", share).alias("threshold"), F.count(F.lit(1)).alias("windows")).where(F.col("windows") >= least)


def continuous(df: DataFrame, value: str, stride: int = 2) -> DataFrame:
    """Values of every `stride`-th bar, carried forward, as known one bar later."""
    n = F.row_number().over(X.series()) - 1
    df = df.withColumn("_v", F.when(n % stride == 0, F.col(value)))
    w = X.series().rowsBetween(X.W.unboundedPreceding, -1)
    return df.withColumn("known", F.last("_v", ignorenulls=True).over(w)).drop("_v")
