"""Price zones of a series, from columns alone: a series' last bars become one row of arrays, in which zones are built, merged and made
disjoint by array functions. No group holds more than a slice of bars.

A zone is a struct (lo, hi, mid, kinds, role, members, overflow); members are the pivots (price, bar, ts) that it stands on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as X
from tidemark.operators import features as O

#: Fixed values, in ATRs where not said otherwise.
HALF, CAP, CLUSTER, MERGE = 0.25, 1.5, 0.35, 0.5
EMAS, PER_SIDE, PIVOT_BARS, ATR_BARS = (21, 55, 100, 200), 4, 4, 14
RANGE_BARS, RANGE_HIGH, RANGE_LOW = 60, 0.90, 0.10
POC_BUCKET = 0.25

MEMBER = "struct<price:double,bar:int,ts:timestamp_ntz>"
ZONE = f"struct<lo:double,hi:double,mid:double,kinds:array<string>,role:string,members:array<{MEMBER}>,overflow:boolean>"


def _zone(lo: Column, hi: Column, mid: Column, kinds: Column, role: Column, members: Column | None = None, overflow: Column | None = None) -> Column:
    members = F.array() if members is None else members
    return F.struct(lo.alias("lo"), hi.alias("hi"), mid.alias("mid"), kinds.alias("kinds"), role.alias("role"), members.cast(f"array<{MEMBER}>").alias("members"), (F.lit(False) if overflow is None else overflow).alias("overflow")).cast(ZONE)


def around(point: Column, kind: Column, role: Column, atr: Column, lo: Column | None = None, hi: Column | None = None) -> Column:
    """A point widened to at least HALF on both sides, and to the given bounds; beyond CAP it is cut around the point."""
    a, b = F.least(point - HALF * atr, point if lo is None else lo), F.greatest(point + HALF * atr, point if hi is None else hi)
    wide = b - a > CAP * atr
    a, b = F.when(wide, point - CAP / 2 * atr).otherwise(a), F.when(wide, point + CAP / 2 * atr).otherwise(b)
    return _zone(a, b, (a + b) / 2, F.array(kind), role)


def clusters(members: Column, atr: Column) -> Column:
    """Members in groups by price: a group begins at the first price more than CLUSTER above the last group's lowest."""
    empty = F.array().cast(f"array<array<{MEMBER}>>")
    rest = lambda groups: F.slice(groups, 1, F.greatest(F.size(groups) - 1, F.lit(0)))

    def put(groups: Column, m: Column) -> Column:
        last = F.try_element_at(groups, F.lit(-1))
        near = F.coalesce(m["price"] - F.get(last, F.lit(0))["price"] <= CLUSTER * atr, F.lit(False))
        return F.when(near, F.concat(rest(groups), F.array(F.concat(last, F.array(m))))).otherwise(F.concat(groups, F.array(F.array(m))))

    return F.aggregate(F.array_sort(members), empty, put)


def of_cluster(cluster: Column, kind: Column, role: Column, atr: Column) -> Column:
    """The zone of a group of pivots: their prices, padded on both sides to 2 HALF where they lie closer and never beyond CAP."""
    price = F.transform(cluster, lambda m: m["price"])
    a, b = F.array_min(price), F.array_max(price)
    pad = F.greatest(F.lit(0.0), F.least(F.greatest(b - a, 2 * HALF * atr), CAP * atr) - (b - a)) / 2
    return _zone(a - pad, b + pad, (a + b) / 2, F.array(kind), role, cluster)


def newest(members: Column, atr: Column) -> Column:
    """The PER_SIDE groups with the newest pivots."""
    last = lambda c: F.array_max(F.transform(c, lambda m: m["bar"]))
    dated = F.transform(clusters(members, atr), lambda c: F.struct(last(c).alias("last"), c.alias("c")))
    return F.transform(F.reverse(F.slice(F.reverse(F.array_sort(dated)), 1, PER_SIDE)), lambda d: d["c"])


def united(zones: Column, overflow: Column | None = None) -> Column:
    """One zone of several. Its role is that of most; of as many, that of the lowest middle."""
    n = lambda role: F.size(F.filter(zones, lambda z: z["role"] == role))
    lo, hi = F.array_min(F.transform(zones, lambda z: z["lo"])), F.array_max(F.transform(zones, lambda z: z["hi"]))
    lowest = F.array_min(F.transform(zones, lambda z, i: F.struct(z["mid"].alias("mid"), i.alias("i"), z["role"].alias("role"))))["role"]
    role = F.when(n("support") == n("resistance"), lowest).when(n("support") > n("resistance"), "support").otherwise("resistance")
    kinds = F.array_distinct(F.flatten(F.transform(zones, lambda z: z["kinds"])))
    members = F.flatten(F.transform(zones, lambda z: z["members"]))
    return _zone(lo, hi, (lo + hi) / 2, kinds, role, members, F.exists(zones, lambda z: z["overflow"]) if overflow is None else overflow)


def _in_order(zones: Column, *by: str) -> Column:
    """Zones sorted by fields; equal ones as they came."""
    keyed = F.transform(zones, lambda z, i: F.struct(*[z[k].alias(f"k{j}") for j, k in enumerate(by)], i.alias("i"), z.alias("z")))
    return F.transform(F.array_sort(keyed), lambda x: x["z"])


def _chained(zones: Column, joins) -> Column:
    """Ordered zones as a list of lists: `joins` tells of a list and the next zone whether this belongs to it."""
    empty = F.array().cast(f"array<array<{ZONE}>>")

    def put(lists: Column, z: Column) -> Column:
        last = F.try_element_at(lists, F.lit(-1))
        more = F.concat(F.slice(lists, 1, F.greatest(F.size(lists) - 1, F.lit(0))), F.array(F.concat(last, F.array(z))))
        return F.when(F.coalesce(joins(last, z), F.lit(False)), more).otherwise(F.concat(lists, F.array(F.array(z))))

    return F.aggregate(zones, empty, put)


def merged(zones: Column, atr: Column) -> Column:
    """Neighbours by their middles join while these are within MERGE and the union within CAP."""
    bound = lambda zs, f, k: f(F.transform(zs, lambda z: z[k]))

    def joins(zs: Column, z: Column) -> Column:
        union = F.greatest(bound(zs, F.array_max, "hi"), z["hi"]) - F.least(bound(zs, F.array_min, "lo"), z["lo"])
        return (F.abs(z["mid"] - F.try_element_at(zs, F.lit(-1))["mid"]) / atr < MERGE) & (union / atr <= CAP)

    return F.transform(_chained(_in_order(zones, "mid"), joins), lambda zs: united(zs))


def disjoint(df: DataFrame, zones: str, out: str) -> DataFrame:
    """`out`: zones that don't overlap. What does is cut half-way between the middles; if a piece would be too narrow or too wide, or middles
    are the same, the whole overlap becomes one zone marked as overflow. df has a column atr; each step is a projection of its own."""
    atr = F.col("atr")
    reach = lambda zs: F.array_max(F.transform(zs, lambda z: z["hi"]))
    chains = _chained(_in_order(F.col(zones), "lo", "mid", "hi"), lambda zs, z: z["lo"] <= reach(zs))
    above = lambda x: x + F.abs(x) * F.lit(2.3e-16) + F.lit(5e-324)  # noqa: E731  the next number
    half_way = lambda zs, i: (F.get(zs, i)["mid"] + F.get(zs, i + 1)["mid"]) / 2

    def pieces(zs: Column) -> Column:
        lo = lambda z, i: F.when(i == 0, z["lo"]).otherwise(F.greatest(z["lo"], above(half_way(zs, i - 1))))
        hi = lambda z, i: F.when(i == F.size(zs) - 1, z["hi"]).otherwise(F.least(z["hi"], half_way(zs, i)))
        apart = lambda z, i: (i == 0) | (z["mid"] > F.get(zs, i - 1)["mid"])
        return F.transform(zs, lambda z, i: F.struct(_zone(lo(z, i), hi(z, i), z["mid"], z["kinds"], z["role"], z["members"], z["overflow"]).alias("z"), apart(z, i).alias("apart")))

    def resolved(zs: Column, ps: Column) -> Column:
        fine = F.forall(ps, lambda p: p["apart"] & ((p["z"]["hi"] - p["z"]["lo"]) / atr).between(2 * HALF - 1e-12, CAP))
        alone = F.transform(zs, lambda z: _zone(z["lo"], z["hi"], z["mid"], z["kinds"], z["role"], z["members"], z["overflow"] | ((z["hi"] - z["lo"]) / atr > CAP)))
        return F.when(F.size(zs) == 1, alone).when(fine, F.transform(ps, lambda p: p["z"])).otherwise(F.array(united(zs, F.lit(True))))

    df = df.withColumn("_chains", F.transform(chains, lambda zs: _in_order(zs, "mid", "lo", "hi"))).withColumn("_pieces", F.transform("_chains", lambda zs: pieces(zs)))
    return df.withColumn(out, _in_order(F.flatten(F.zip_with("_chains", "_pieces", resolved)), "lo", "hi")).drop("_chains", "_pieces")


def summary(bars: DataFrame, n: int = X.SLICE) -> DataFrame:
    """A row for each series with what its zones are built of, from its last n bars."""
    from tidemark.operators.scans import latest_n

    w, all_ = X.series(), X.W.partitionBy("symbol")
    b = O.pivots(latest_n(bars.select("symbol", "ts", "open", "high", "low", "close"), ["symbol"], n), PIVOT_BARS)
    b = b.withColumns({"bar": F.row_number().over(w) - 1, "bars": F.count(F.lit(1)).over(all_), "fine": _fine(), "before": F.lag("close").over(w)})
    b = b.withColumn("left", F.col("bars") - 1 - F.col("bar"))  # bars after this one
    tr = _range_of_bar()
    member = lambda c: F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("price"), F.col("bar").cast("int").alias("bar"), "ts")))
    latest = F.max("ts").over(all_)
    for name, trunc, days in (("day", "day", 1), ("week", "week", 7)):
        start = F.date_trunc(trunc, "ts").cast("timestamp_ntz")
        b = b.withColumn(f"_{name}", start == F.date_trunc(trunc, latest).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days)))
    at = lambda c, x: F.when(c, F.col(x))
    sums = {
        "bars": F.max("bars"), "last_ts": F.max("ts"), "price": F.max_by("close", "ts"), "valid": F.every(F.col("fine") | (F.col("left") > ATR_BARS)) & (F.max("bars") > ATR_BARS),
        "all_fine": F.every("fine"), "atr": F.avg(F.when(F.col("left") < ATR_BARS, tr)), "highs": member("pivot_high"), "lows": member("pivot_low"),
        "series": F.transform(F.array_sort(F.collect_list(F.struct("ts", "high", "low", "close"))), lambda x: F.struct(x["high"].alias("high"), x["low"].alias("low"), x["close"].alias("close"))),
        "range_hi": F.percentile(at(F.col("left") < RANGE_BARS, "high"), RANGE_HIGH), "range_lo": F.percentile(at(F.col("left") < RANGE_BARS, "low"), RANGE_LOW),
        **{f"{p}_{x}": f(at(F.col(f"_{p}"), c)) for p in ("day", "week") for x, f, c in (("hi", F.max, "high"), ("lo", F.min, "low"))},
    }
    return b.groupBy("symbol").agg(*[v.alias(k) for k, v in sums.items()])


def summaries(bars: DataFrame, n: int = X.SLICE) -> DataFrame:
    """For every bar what `summary` has of its series cut there (but the series itself and the pivots' times), by windows over one sort: pivots
    count from PIVOT_BARS after them, and nothing later than the bar does. The last day's and week's extremes are taken from all of their bars,
    which must lie within the last n bars for the same result."""
    w, slice_ = X.series(), X.rows(n)
    b = O.pivots(bars.select("symbol", "ts", "open", "high", "low", "close"), PIVOT_BARS)
    b = b.withColumns({"fine": _fine(), "before": F.lag("close").over(w), "bar": F.row_number().over(w) - 1, "first": F.lag("close", 2).over(w)})
    seen = w.rowsBetween(-(n - 1 - PIVOT_BARS), -PIVOT_BARS)
    member = lambda c: F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("price"), F.col("bar").cast("int").alias("bar"), F.lit(None).cast("timestamp_ntz").alias("ts")))).over(seen)
    b = b.withColumns({
        "bars": F.count(F.lit(1)).over(slice_), "_fine15": F.min(F.col("fine").cast("int")).over(X.rows(ATR_BARS + 1)), "_fine_all": F.min(F.col("fine").cast("int")).over(slice_),
        "atr": F.avg(_range_of_bar()).over(X.rows(ATR_BARS)), "highs": member("pivot_high"), "lows": member("pivot_low"), "_closes": F.collect_list("close").over(slice_),
        "range_hi": F.percentile("high", RANGE_HIGH).over(X.rows(RANGE_BARS)), "range_lo": F.percentile("low", RANGE_LOW).over(X.rows(RANGE_BARS)),
    })
    for name, unit in (("day", 1), ("week", 7)):
        # the days since a Monday, so that weeks are whole sevens
        b = b.withColumn("_p", F.floor((F.date_diff(F.to_date("ts"), F.lit("1970-01-05").cast("date"))) / unit))
        past = X.W.partitionBy("symbol").orderBy("_p").rangeBetween(-1, -1)
        b = b.withColumns({f"{name}_hi": F.max("high").over(past), f"{name}_lo": F.min("low").over(past)})
    enough = F.col("bars") > ATR_BARS
    return b.withColumns({"valid": (F.col("_fine15") == 1) & enough, "all_fine": F.col("_fine_all") == 1, "price": F.col("close"), "emas": _emas(F.col("_closes"))}).drop("_p", "_fine15", "_fine_all", "_closes", "pivot_high", "pivot_low", "fine", "before", "open", "high", "low", "close")


def _fine() -> Column:
    """Whether a bar's prices are numbers in their order."""
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    ordered = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high"))
    return F.coalesce(ordered & known("high") & known("low") & known("open") & known("close"), F.lit(False))


def _range_of_bar() -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("before")), F.abs(F.col("low") - F.col("before")))


def _emas(closes: Column) -> Column:
    """struct of the exponential means of EMAS over closes in order, seeded with the first: one pass."""
    start = F.struct(*[F.get(closes, F.lit(0)).alias(f"e{k}") for k in EMAS])
    rates = {k: 2.0 / (k + 1) for k in EMAS}
    put = lambda m, x: F.struct(*[(F.lit(1 - a) * m[f"e{k}"] + F.lit(a) * x).alias(f"e{k}") for k, a in rates.items()])
    return F.aggregate(F.slice(closes, F.lit(2), F.greatest(F.size(closes), F.lit(1))), start, put)


def poc_of(hours: Column, width: Column, end: Column, span: int = 240, cover: float = 0.8, lag_hours: int = 2) -> Column:
    """The middle of the price bucket with most volume, of an array of struct(slot, price, volume) of hours up to `end`: bars.poc for one row. The
    lower bucket on a tie; null where hours lack. slot, end: seconds."""
    last = end - 3600
    mine = F.filter(hours, lambda h: (h["slot"] <= last) & (h["slot"] >= last - 3600 * (span - 1)))
    dealt = F.array_sort(F.transform(mine, lambda h: F.struct(F.floor(h["price"] / width).alias("b"), h["volume"].cast("double").alias("v"))))
    state = lambda b, v, best, most: F.struct(b.cast("long").alias("b"), v.alias("v"), best.cast("long").alias("best"), most.alias("most"))
    flushed = lambda s: (F.when(s["v"] > s["most"], s["b"]).otherwise(s["best"]), F.greatest(s["v"], s["most"]))

    def put(s: Column, x: Column) -> Column:
        best, most = flushed(s)
        return F.when(x["b"] == s["b"], state(s["b"], s["v"] + x["v"], s["best"], s["most"])).otherwise(state(x["b"], x["v"], best, most))

    none = state(F.lit(None), F.lit(0.0), F.lit(None), F.lit(0.0))
    found = F.aggregate(dealt, none, put, lambda s: flushed(s)[0])
    ok = (F.size(mine) >= cover * span) & (F.array_max(F.transform(mine, lambda h: h["slot"])) >= last - 3600 * lag_hours)
    return F.when(ok, (found + 0.5) * width)


def zones_of(s: DataFrame) -> DataFrame:
    """`zones` (disjoint, in order) and `degraded` (the reasons for sources that lack) of every row, from the columns of `summary` or `summaries`,
    poc and poc_width: projections only, whatever a row stands for."""
    atr, price, bars_ = F.col("atr"), F.col("price"), F.col("bars")
    s = s.withColumns({
        "ok": F.coalesce(F.col("valid") & (atr > 0), F.lit(False)), "pivots_ok": F.col("all_fine") & (bars_ >= 2 * PIVOT_BARS + 1),
        **{f"ema{k}": F.when(bars_ >= k, F.col(f"emas.e{k}")) for k in EMAS}, **{k: F.when(bars_ >= RANGE_BARS, F.col(k)) for k in ("range_hi", "range_lo")},
    })
    side = lambda x: F.when(price >= x, "support").otherwise("resistance")
    edges = {f"{p}_{e}": f"{c}_{e}" for p, c in (("range", "range"), ("prev_day", "day"), ("prev_week", "week")) for e in ("hi", "lo")}
    bottom = F.col("poc") - F.col("poc_width") / 2
    points = [(f"ema{k}", F.col(f"ema{k}"), side(F.col(f"ema{k}")), None, None) for k in EMAS]
    points += [(k, F.col(c), F.lit("resistance" if k.endswith("hi") else "support"), None, None) for k, c in edges.items()]
    points.append(("poc", F.col("poc"), side(F.col("poc")), bottom, bottom + F.col("poc_width")))
    of_points = F.array_compact(F.array(*[F.when(x.isNotNull() & F.col("ok"), around(x, F.lit(k), role, atr, lo, hi)) for k, x, role, lo, hi in points]))
    use = F.col("ok") & F.col("pivots_ok")
    none = F.array().cast(f"array<{MEMBER}>")
    for c in ("highs", "lows"):
        s = s.withColumn(f"_{c}", newest(F.when(use, F.col(c)).otherwise(none), atr))
    of_side = lambda c, kind, role: F.transform(f"_{c}", lambda m: of_cluster(m, F.lit(kind), F.lit(role), atr))
    s = s.withColumn("_all", F.concat(of_side("highs", "pivot_high", "resistance"), of_side("lows", "pivot_low", "support"), of_points))
    s = disjoint(s.withColumn("_merged", merged(F.col("_all"), atr)), "_merged", "zones")
    lacks = {
        "pivot_history_insufficient": bars_ < 2 * PIVOT_BARS + 1, "pivot_invalid_ohlc": (bars_ >= 2 * PIVOT_BARS + 1) & ~F.col("all_fine"),
        "pivot_high_unavailable": F.col("pivots_ok") & (F.size("highs") == 0), "pivot_low_unavailable": F.col("pivots_ok") & (F.size("lows") == 0),
        **{f"ema{k}_history_insufficient": bars_ < k for k in EMAS}, "range_history_insufficient": bars_ < RANGE_BARS,
        "prev_day_history_insufficient": F.col("day_hi").isNull(), "prev_week_history_insufficient": F.col("week_hi").isNull(), "poc_missing": F.col("poc").isNull(), "no_levels": F.size("zones") == 0,
    }
    told = F.when(~F.col("ok"), F.array(F.lit("no_atr"))).otherwise(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in lacks.items()])))
    return s.withColumn("degraded", told).drop("_all", "_merged", "_highs", "_lows")


def levels(bars: DataFrame, volume: DataFrame | None = None, n: int = X.SLICE, seconds: int = 3600) -> DataFrame:
    """(symbol, last_ts, atr, bars, price, first, series, zones, degraded): the disjoint zones of every series at its last bar and the reasons for sources
    that it lacks. volume: hourly bars (symbol, ts, volume, quote_vol) for the price with most volume up to the series' end; seconds: a bar's length."""
    s = summary(bars, n)
    end = F.unix_seconds(F.col("last_ts").cast("timestamp")) + seconds
    if volume is None:
        s = s.withColumn("hours", F.lit(None).cast("array<struct<slot:bigint,price:double,volume:double>>"))
    else:
        slots = hours_of(volume)
        recent = X.W.partitionBy("symbol").orderBy(F.desc("slot"))
        # of a series' hours only those of the last days before its end count: met by the summary, which is a row a series
        near = slots.join(s.select("symbol", end.alias("end")), "symbol").where("slot < end and slot >= end - 3600 * 240").withColumn("_k", F.row_number().over(recent)).where("_k <= 240")
        s = s.join(near.groupBy("symbol").agg(F.collect_list(F.struct("slot", "price", "volume")).alias("hours")), "symbol", "left")
    width = F.when(F.col("valid") & (F.col("atr") > 0), POC_BUCKET * F.col("atr"))
    s = s.withColumns({"poc": poc_of(F.col("hours"), width, end), "poc_width": width, "emas": _emas(F.transform("series", lambda x: x["close"]))})
    s = s.withColumn("first", F.try_element_at("series", F.lit(-3))["close"])
    return zones_of(s).select("symbol", "last_ts", "atr", "bars", "price", "first", "series", "zones", "degraded")


def hours_of(volume: DataFrame) -> DataFrame:
    """(symbol, slot, price, volume) of hourly bars with volume: when the hour begins in seconds and its mean price."""
    slot = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = volume.where("volume > 0 and quote_vol > 0")
    return rows.select("symbol", (slot - F.pmod(slot, F.lit(3600))).alias("slot"), (F.col("quote_vol") / F.col("volume")).alias("price"), F.col("volume").cast("double").alias("volume"))


def extract_levels(bars: DataFrame, volume: DataFrame | None = None, n: int = X.SLICE) -> DataFrame:
    """Disjoint zones of every series as rows, with how often their pivots and other bars have touched them."""
    # explode_outer: the optimizer would infer a filter on the array from explode and build all zones a second time for it
    s = levels(bars, volume, n).select("symbol", "atr", "bars", "series", "degraded", F.explode_outer("zones").alias("z")).where("z is not null")
    inside = F.filter("z.members", lambda m: m["price"].between(F.col("z.lo"), F.col("z.hi")))
    s = s.withColumn("inside", inside).withColumn("hits", F.transform("series", lambda x: F.coalesce((x["high"] >= F.col("z.lo")) & (x["low"] <= F.col("z.hi")), F.lit(False))))
    entries = F.filter(F.transform("hits", lambda h, i: h & ~F.coalesce(F.get("hits", i - 1) & (i > 0), F.lit(False))), lambda x: x)
    since = F.array_position(F.reverse("hits"), True)
    return s.select(
        "symbol", "z.lo", "z.hi", "z.mid", "z.kinds", F.size("inside").cast("long").alias("touches"), F.array_min(F.transform("inside", lambda m: m["ts"])).alias("established_ts"),
        (F.col("bars") - 1 - F.array_max(F.transform("inside", lambda m: m["bar"]))).alias("last_touch_bars"), F.size(entries).cast("long").alias("overlaps"), F.when(since > 0, since - 1).alias("last_overlap_bars"),
        F.col("z.role").alias("origin_role"), ((F.col("z.hi") - F.col("z.lo")) / F.col("atr")).alias("width_atr"), "z.overflow", "degraded",
    )
