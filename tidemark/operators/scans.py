"""Reads of stored series: latest rows, ranges, catalog, routing; and the merges that write them."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows that an ad-hoc statement gives at most (a feature of that interface).
SQL_ROWS = 500
#: A source is healthy from so many closed bars.
HEALTHY_BARS = 90


def latest_n(df: DataFrame, keys: list[str], n: int, ts: str = "ts") -> DataFrame:
    """The latest n rows of every key, by one pass with a top-n per partition before the shuffle."""
    w = W.partitionBy(*keys).orderBy(F.col(ts).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def since(df: DataFrame, lo, ts: str = "ts") -> DataFrame:
    """Rows from a time on; the comparison reaches the scan."""
    return df.where(F.col(ts) >= F.lit(lo))


def latest_non_null(df: DataFrame, keys: list[str], col: str, n: int, grid_hours: int | None = None, kind: str = "kind") -> DataFrame:
    """Latest n rows in which one sparse column is known. With a grid: settled rows, and rows of no kind within 60 s of it."""
    rows = df.where(F.col(col).isNotNull())
    if grid_hours:
        g = grid_hours * 3_600_000
        ms = F.pmod(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(g))
        rows = rows.where((F.col(kind) == "settled") | (F.col(kind).isNull() & (F.least(ms, F.lit(g) - ms) < 60_000)))
    return latest_n(rows, keys, n)


def last_source(df: DataFrame, keys: list[str], source: str = "source", ts: str = "ts") -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(source, ts).alias("source"))


def latest_row(df: DataFrame, keys: list[str], ts: str, cols: list[str]) -> DataFrame:
    """The newest row of each key: a partial aggregate instead of a sort."""
    return df.groupBy(*keys).agg(F.max(F.struct(ts, *cols)).alias("_m")).select(*keys, "_m.*")


def coverage(df: DataFrame, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def with_series_end(df: DataFrame, series: DataFrame, key: str = "symbol") -> DataFrame:
    """Each row with the newest time of its key in another series."""
    return df.join(series.groupBy(key).agg(F.max("ts").alias("series_ts")), key, "left")


#: Nodes of parsed statements that only read. What isn't among them is refused.
READS = frozenset(
    "Project Filter Join LateralJoin Aggregate Sort GlobalLimit LocalLimit Offset Union Distinct Except Intersect Generate Window SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedRelation UnresolvedInlineTable ResolvedInlineTable LocalRelation OneRowRelation UnresolvedHaving WithWindowDefinition Pivot Unpivot Sample Tail UnresolvedTableValuedFunction UnresolvedTVFAliases".split()
)
#: Table functions that read nothing stored, and scalar functions that reach outside of a query.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack".split())
REACHING = frozenset("reflect java_method try_reflect read_files".split())


def _seq(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _parsed(plan, names: frozenset[str]):
    """Raise unless the parsed plan, its subqueries and common table expressions only read relations of these names."""
    kind = plan.getClass().getSimpleName().rstrip("$")
    if kind not in READS:
        raise ValueError(f"only reading is allowed, not {kind}")
    inner = _seq(plan.innerChildren()) if kind == "UnresolvedWith" else []
    if kind == "UnresolvedWith":
        names = names | {c.alias().lower() for c in inner}
    if kind == "UnresolvedRelation":
        parts = [p.lower() for p in _seq(plan.multipartIdentifier())]
        if len(parts) != 1 or parts[0] not in names:
            raise ValueError(f"unknown relation {'.'.join(parts)}")
    if kind == "UnresolvedTableValuedFunction" and _seq(plan.name())[-1].lower() not in TABLE_FUNCTIONS:
        raise ValueError("unknown table function")
    for p in [*_seq(plan.children()), *inner]:
        _parsed(p, names)
    for e in _seq(plan.expressions()):
        _checked(e, names)


def _checked(e, names: frozenset[str]) -> None:
    kind = e.getClass().getSimpleName()
    if kind == "UnresolvedFunction" and _seq(e.nameParts())[-1].lower() in REACHING:
        raise ValueError("a function that reaches outside")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        _parsed(e.plan(), names)
    for c in _seq(e.children()):
        _checked(c, names)


def checked_sql(spark: SparkSession, statement: str, tables: Iterable[str]) -> DataFrame:
    """One statement that only reads the named tables (views), of at most SQL_ROWS rows. Spark's parser tells what it is: commands, writes behind a
    common table expression, other relations and paths, and functions that reach outside raise ValueError before anything runs."""
    text = statement.strip().rstrip(";")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:  # the parser's own error, a second statement among others
        raise ValueError(f"not one statement: {str(e).splitlines()[0]}") from e
    _parsed(plan, frozenset(t.lower() for t in tables))
    return spark.sql(text).limit(SQL_ROWS)


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n_rows, columns of each table, in one job."""
    parts = [t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows", F.lit(",".join(t.columns)).alias("columns")) for name, t in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def route(candidates: DataFrame, healthy: int = HEALTHY_BARS) -> DataFrame:
    """Of candidate sources (symbol, source, pos, n_bars, has_gap): gapless ones only; the first healthy by position, else the longest."""
    ok = F.col("n_bars") >= healthy
    w = W.partitionBy("symbol").orderBy(ok.desc(), F.when(ok, F.col("pos")), F.col("n_bars").desc(), "pos")
    return candidates.where("not has_gap").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("symbol", "source", "n_bars")


# ---------------------------------------------------------------- merges


def merge_overwrite(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Later loads replace earlier rows of a key."""
    w = W.partitionBy(*keys).orderBy(F.col(seq).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def merge_first(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first load of a key stays."""
    w = W.partitionBy(*keys).orderBy(F.col(seq).asc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def merge_coalesce(df: DataFrame, keys: list[str], seq: str, first_known: tuple[str, ...] = ()) -> DataFrame:
    """Per column the latest known value (the first known for `first_known`): an update never erases."""
    rest = [c for c in df.columns if c not in (*keys, seq)]
    agg = [(F.min_by if c in first_known else F.max_by)(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest]
    return df.groupBy(*keys).agg(*agg)


def sticky_source(new: DataFrame, stored: DataFrame, key: str = "symbol") -> DataFrame:
    """New rows whose source is that of the newest stored row, or whose key has none stored."""
    return new.join(last_source(stored, [key]).withColumnRenamed("source", "_s"), key, "left").where("_s is null or _s = source").drop("_s")


def snapshot_hash(members: DataFrame) -> DataFrame:
    """n and a SHA-256 over the sorted member rows; a snapshot is written only when it changed."""
    rows = F.array_sort(F.collect_list(F.to_json(F.struct(*sorted(members.columns)))))
    return members.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(rows, "\n"), 256).alias("sha"))


def ledger_id(params: Column, digest: Column) -> Column:
    """Content address of an experiment: 12 hex digits."""
    return F.substring(F.sha2(F.concat_ws("|", params, digest), 256), 1, 12)


def ledger_insert(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to add; an id that is there with other metrics raises."""
    old = ledger.select("id", F.col("metrics").alias("_m"))
    j = new.join(old, "id", "left")
    clash = F.col("_m").isNotNull() & (F.col("_m") != F.col("metrics"))
    return j.where(F.when(clash, F.raise_error(F.concat(F.lit("other metrics under id "), F.col("id"))).cast("boolean")).otherwise(F.col("_m").isNull())).drop("_m")


# ---------------------------------------------------------------- symbols

#: Quote currencies that a pair may already end with.
QUOTES = ("USDT", "USDC", "USD")


def pair_symbol(s: Column, quote: str = "USDT", sep: str = "") -> Column:
    """BASE + separator + quote of a loosely written symbol; a quote that is there isn't added again."""
    plain = F.upper(F.regexp_replace(s, "[-_/ ]", ""))
    base = F.regexp_replace(plain, f"({'|'.join(QUOTES)})$", "")
    found = F.regexp_extract(plain, f"({'|'.join(QUOTES)})$", 1)
    return F.concat(base, F.lit(sep), F.when(found == "", quote).otherwise(found))
