"""Documents with typed headers, matching, and retrieval under budgets."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidemark.functions.folds import runs

#: Characters that a retrieval may use: its index, automatic entries (and their number), named entries.
INDEX_CHARS, AUTO_CHARS, AUTO_ENTRIES, NAMED_CHARS = 4000, 4000, 2, 8000


def front_matter(df: DataFrame, text: str = "text", required: tuple[str, ...] = ("slug", "title", "status"), known: tuple[str, ...] = ("slug", "title", "status", "created", "updated", "aliases"), statuses: tuple[str, ...] = ("active", "retired")) -> DataFrame:
    """fields (a map), body and errors of texts that begin with a header between lines of three dashes."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n", "\n")
    head = F.regexp_extract(t, r"(?s)^---\n(.*?)\n---(?:\n|$)", 1)
    has = F.regexp_like(t, F.lit(r"(?s)^---\n.*?\n---(?:\n|$)"))
    lines = F.filter(F.split(head, "\n"), lambda x: F.trim(x) != "")
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))
    df = df.withColumns({"_has": has, "_pairs": F.when(has, pairs).otherwise(F.array().cast("array<struct<k:string,v:string>>")), "body": F.when(has, F.regexp_replace(t, r"(?s)^---\n.*?\n---(?:\n|$)", "")).otherwise(t)})
    keys = F.transform("_pairs", lambda p: p["k"])
    df = df.withColumn("_keys", keys)
    first = F.transform(F.array_distinct("_keys"), lambda k: F.struct(k.alias("k"), F.element_at(F.filter("_pairs", lambda p: p["k"] == k), 1)["v"].alias("v")))
    df = df.withColumn("fields", F.map_from_entries(first))
    get = lambda k: F.try_element_at("fields", F.lit(k))
    tell = lambda prefix, values: F.transform(values, lambda v: F.concat(F.lit(prefix + " "), v))
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    doubled = F.filter(F.array_distinct("_keys"), lambda k: F.size(F.filter("_keys", lambda x: x == k)) > 1)
    dates = F.filter(F.array(*[F.when(get(k).isNotNull() & (F.try_to_date(get(k), "yyyy-MM-dd").isNull() | ~F.regexp_like(get(k), F.lit(r"^\d{4}-\d{2}-\d{2}$"))), F.lit(f"bad date {k}")) for k in ("created", "updated")]), lambda x: x.isNotNull())
    order = F.when(F.try_to_date(get("updated"), "yyyy-MM-dd") < F.try_to_date(get("created"), "yyyy-MM-dd"), F.array(F.lit("updated before created"))).otherwise(F.array().cast("array<string>"))
    state = F.when(get("status").isNotNull() & ~get("status").isin(*statuses), F.array(F.lit("bad status"))).otherwise(F.array().cast("array<string>"))
    errors = F.when(~F.col("_has"), F.array(F.lit("no header"))).otherwise(
        F.concat(
            tell("missing", F.array_except(lit(required), "_keys")), tell("unknown", F.array_except("_keys", lit(known))), tell("double", doubled), tell("empty", F.filter(F.map_keys("fields"), lambda k: F.element_at("fields", k) == "")), state, dates, order
        )
    )
    return df.withColumn("errors", F.array_sort(errors)).drop("_has", "_pairs", "_keys")


def string_list(c: Column) -> Column:
    """A JSON array of strings, or null where it is anything else."""
    a = F.from_json(c, "array<string>")
    strict = F.regexp_like(F.trim(c), F.lit(r'^\[\s*("([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*)?\]$'))
    return F.when(strict, a)


def iso_date(c: Column) -> Column:
    return F.when(F.regexp_like(c, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(c, "yyyy-MM-dd"))


def fenced_blocks(text: Column, name: str) -> Column:
    """Contents of the fenced blocks of one name."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)```{name}\n(.*?)\n?```"), F.lit(1))


def quote_block(text: Column) -> Column:
    """The only run of quoted lines outside fences, without its marks; null if there is none or more than one."""
    plain = F.regexp_replace(text, r"(?s)```.*?```", "")
    blocks = F.regexp_extract_all(plain, F.lit(r"(?m)((?:^>[^\n]*(?:\n|\z))+)"), F.lit(1))
    return F.when(F.size(blocks) == 1, F.regexp_replace(F.regexp_replace(F.element_at(blocks, 1), r"(?m)^> ?", ""), r"^\s+|\s+$", ""))


def collisions(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Names (slugs, titles, aliases) that more than one entry uses."""
    every = df.select(key, F.explode(F.array_distinct(F.array_compact(F.concat(*[F.col(n) if dict(df.dtypes)[n].startswith("array") else F.array(n) for n in names])))).alias("name"))
    return every.groupBy(F.lower("name").alias("name")).agg(F.count_distinct(key).alias("entries")).where("entries > 1")


def broken_successors(df: DataFrame, key: str = "slug", successor: str = "superseded_by", status: str = "status") -> DataFrame:
    """Entries whose successor is missing or isn't active."""
    s = df.select(F.col(key).alias(successor), F.col(status).alias("_s"))
    return df.where(F.col(successor).isNotNull()).join(s, successor, "left").where("_s is null or _s <> 'active'").select(key, successor)


@F.pandas_udf(T.StringType())
def _compat(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def normalized(c: Column, fillers: tuple[str, ...] = ()) -> Column:
    """For matching: compatibility forms and case folded (which Spark has no function for), fillers, punctuation and space removed."""
    c = _compat(c)
    for f in fillers:
        c = F.replace(c, F.lit(f), F.lit(""))
    return F.regexp_replace(c, r"[\p{P}\p{Z}\s]", "")


def without_digits(c: Column, marker: str = "#") -> Column:
    return F.regexp_replace(c, r"\d+", marker)


#: Characters of a needle that the automaton holds; what begins like it is then compared whole. Bytes of needles that are broadcast at once.
HELD_CHARS, NEEDLE_BYTES = 24, 8 << 20
_automata: dict = {}


def _automaton(name: str, needles: list[str]):
    """The automaton of a block of needles, built once a worker: each held beginning with its needles and their numbers."""
    import ahocorasick

    if name not in _automata:
        _automata.clear()  # blocks are looked for one after the other
        made, heads = ahocorasick.Automaton(), {}
        for i, needle in enumerate(needles):
            heads.setdefault(needle[:HELD_CHARS], []).append((i, needle))
        for head, of in heads.items():
            made.add_word(head, (len(head), of))
        made.make_automaton()
        _automata[name] = made
    return _automata[name]


def named_matches(texts: DataFrame, needles: DataFrame, key: str, block_bytes: int = NEEDLE_BYTES) -> DataFrame:
    """Which needles (id, needle: normalised, not empty) occur in which texts (key, norm), each pair once for each row of texts: one pass of an automaton
    over every text where it is read. Needles are broadcast in blocks of about `block_bytes`, a pass each, dealt by a hash; however many
    needles end at one place, all are found. Null texts and empty or null needles match nothing; needles that repeat match with each id."""
    spark, kind = texts.sparkSession, needles.schema["id"].dataType
    n = needles.where(F.length("needle") > 0).select("id", "needle")
    total = n.agg(F.sum(F.octet_length("needle"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    schema = T.StructType([texts.schema[key], T.StructField("id", kind)])
    out = spark.createDataFrame([], schema)
    dealt = n.withColumn("_b", F.pmod(F.xxhash64("needle"), F.lit(max(1, blocks))))
    for k in range(blocks):
        block = dealt.where(F.col("_b") == k).select("id", "needle").toArrow()  # about block_bytes
        if not block.num_rows:
            continue
        shared, ids = spark.sparkContext.broadcast(block.column("needle").to_pylist()), spark.sparkContext.broadcast(block.column("id").combine_chunks())

        def run(batches: Iterator[pa.RecordBatch], shared=shared, ids=ids, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            made = _automaton(name, shared.value)
            for b in batches:
                rows, found = [], []
                for i, text in enumerate(b.column(1)):
                    text = text.as_py()
                    seen = {j for end, (size, of) in made.iter(text) for j, needle in of if len(needle) == size or text.startswith(needle, end - size + 1)} if text else ()
                    rows += [i] * len(seen)
                    found += sorted(seen)
                at = ids.value.take(pa.array(found, pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), at], [key, "id"])

        out = out.union(texts.select(key, "norm").mapInArrow(run, schema))
    return out


def relevance(named: Column, symbol_hit: Column, regime_hit: Column) -> Column:
    """3: named; 2: symbol and regime; 1: one of them; 0: none."""
    return F.when(named, 3).when(symbol_hit & regime_hit, 2).when(symbol_hit | regime_hit, 1).otherwise(0)


def within_budget(df: DataFrame, keys: list[str], order: list, size: str, budget: int, most: int | None = None) -> DataFrame:
    """Entries taken greedily in order: one that doesn't fit is passed over, later ones may fit. Ranked by Spark; the greedy choice runs
    over sorted rows and keeps two numbers."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    schema = ranked.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, left, n = None, budget, 0
        for pdf in batches:
            keep = []
            for k, part in runs(pdf, keys) if len(pdf) else ():
                if k != now:
                    now, left, n = k, budget, 0
                for s in part[size]:
                    ok = s <= left and (most is None or n < most)
                    left, n = left - s * ok, n + ok
                    keep.append(bool(ok))
            yield pdf[keep]

    return ranked.repartition(*keys).sortWithinPartitions(*keys, "_rank").mapInPandas(run, schema).drop("_rank")


def recent_states(df: DataFrame, days: int, now: Column) -> DataFrame:
    """Distinct states of each symbol since a cut-off."""
    return df.where(F.col("ts") >= now - F.make_dt_interval(days=F.lit(days))).groupBy("symbol").agg(F.array_sort(F.collect_set("state")).alias("states"))


def chat_tail(df: DataFrame, keys: list[str], n: int, ts: str, gap_minutes: int = 15) -> DataFrame:
    """The last n messages in order, and the minutes since the one before where these are `gap_minutes` and more."""
    w = W.partitionBy(*keys).orderBy(ts)
    m = (F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(F.lag(ts).over(w).cast("timestamp"))) / 60
    df = df.withColumn("gap_min", F.when(m >= gap_minutes, F.floor(m))).withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(ts).desc())))
    return df.where(F.col("_rn") <= n).drop("_rn")


def escaped(c: Column) -> Column:
    """Text for HTML, quotes left as they are."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
