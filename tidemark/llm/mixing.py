"""Mixing sources to target weights by min-cost flow (operator 6).

Documents may belong to several sources. They are added up by membership pattern (the sorted set of their sources), so
that the flow has a node for each pattern and each source, not for each document. A pattern sends its tokens to its sources:
the first pass over its documents costs nothing, the second more, the third more again (convex costs), and a source takes at
most its quota. As only passes cost, and the same for every pattern, the cheapest full flow is that of one maximal flow after the other,
each with one pass more allowed (min_cost_flow). What a pattern sends in all is whole passes over its documents and a rest; the rest goes
to documents in a seeded order (md5 of seed and id) as long as they fit, then in rounds to what fits the gap: the largest TOP_UPS times,
then in seeded order or, where one is half the gap and more, the largest. Such a round leaves less than half of a pattern's gap; they end
when no document fits.

Each taken word is charged to the source that its pattern's flow sends it to: a pattern's passes over its documents in seeded order make a
line, its sources cut the line by what they get, and a document belongs to the piece in which its middle lies.

Only the totals of patterns come to the driver, at most MAX_PATTERNS of them (a documented limit of what one flow problem
may hold; more raise an error rather than being dropped). The seeded order of a hot pattern isn't sorted in one task: the
order's leading bits make BINS bins, and BINS more within the bin where the rest ends; bins are added up, and only the documents
of the last bin of all are ordered. Only a pattern of several routes has all its places counted, bin by bin.

Defined results
  text null or without words    size 0; taken 0
  source null                   a source of its own, last in the order
  sources null or an empty array (given by `sources`)   in no source: target 0, taken 0
  empty table                   no rows
  sources without words         target 0
  repeated or null doc_id       every row is a document; rows of equal id are taken together or in order of their text's md5
  very long texts               counted whole; a document that is longer than its source's gap is passed over
  more columns                  ignored
"""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidemark.llm import common as C

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
SEED = 17
BINS = 1 << 12
MAX_PATTERNS = 200_000
#: Rounds in which the largest document that fits is added to a pattern, however small, before seeded order is tried.
TOP_UPS = 3
#: Cost of a word in the first, second and third pass.
PASS_COST = (0, 1, 3)
_CHARGED = "array<struct<source:string,words:bigint>>"


def n_words(text: Column) -> Column:
    """Number of runs of anything but white space (0x20, 0x09-0x0D); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], total: int, most: int = MAX_PASSES) -> list[float]:
    """Share `total` by weight; none gets more than `most` times its size, what is above is shared again."""
    open_, capped, left = list(range(len(sizes))), {}, total
    while open_:
        w = sum(weights[i] for i in open_)
        level = left / w
        over = [i for i in open_ if level * weights[i] > most * sizes[i]]
        if not over:
            return [float(capped[i]) if i in capped else level * weights[i] for i in range(len(sizes))]
        for i in over:
            capped[i] = most * sizes[i]
            left -= capped[i]
            open_.remove(i)
    return [float(capped[i]) for i in range(len(sizes))]


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], passes: int = len(PASS_COST)) -> list[dict[int, int]]:
    """Words that each pattern sends to each of its sources. patterns: (its sources, its words).

    The amounts that patterns can send at once form a polymatroid, on which a separable convex cost is least when cheap words go
    first; so the flow is made maximal with one pass over every pattern, then with two, then with three. Augmenting paths never take a
    pattern's words back, they only send them to another of its sources."""
    sent: list[dict[int, int]] = [dict.fromkeys(of, 0) for of, _ in patterns]
    users: list[list[int]] = [[] for _ in quotas]
    for i, (of, _) in enumerate(patterns):
        for s in of:
            users[s].append(i)
    room = list(quotas)
    left = [0] * len(patterns)

    def levels() -> tuple[list[int], list[int], bool]:
        """Steps from patterns with words left to patterns and to sources, up to the first source with room."""
        of_p, of_s = [-1] * len(patterns), [-1] * len(quotas)
        queue = deque(i for i in range(len(patterns)) if left[i] > 0)
        for i in queue:
            of_p[i] = 0
        found = False
        while queue and not found:
            after: deque[int] = deque()
            for i in queue:
                for s in sent[i]:
                    if of_s[s] < 0:
                        of_s[s] = of_p[i]
                        found = found or room[s] > 0
                        for k in users[s]:
                            if of_p[k] < 0 and sent[k][s] > 0:
                                of_p[k] = of_p[i] + 1
                                after.append(k)
            queue = after
        return of_p, of_s, found

    def push(i: int, most: int, of_p: list[int], of_s: list[int], todo_p: list, todo_s: list) -> int:
        """Send up to `most` words from pattern i along the levels (paths are at most as long as there are sources)."""
        done = 0
        while todo_p[i] and done < most:
            s = todo_p[i][-1]
            if of_s[s] != of_p[i]:
                todo_p[i].pop()
                continue
            here = min(most - done, room[s])
            room[s] -= here
            while here < most - done and todo_s[s]:
                k = todo_s[s][-1]
                if of_p[k] != of_p[i] + 1 or sent[k][s] == 0:
                    todo_s[s].pop()
                    continue
                back = push(k, min(most - done - here, sent[k][s]), of_p, of_s, todo_p, todo_s)
                sent[k][s] -= back
                here += back
                if not back or sent[k][s] == 0:
                    todo_s[s].pop()
            sent[i][s] += here
            done += here
            if done < most:
                todo_p[i].pop()
        return done

    for _ in range(passes):
        left = [a + size for a, (_, size) in zip(left, patterns, strict=True)]
        while True:
            of_p, of_s, found = levels()
            if not found:
                break
            todo_p, todo_s = [list(x) for x in sent], [list(x) for x in users]
            for i in range(len(patterns)):
                if left[i] > 0:
                    left[i] -= push(i, left[i], of_p, of_s, todo_p, todo_s)
    return sent


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of so many patterns, if these are few."""
    return F.broadcast(df) if rows <= C.BROADCAST_ROWS else df


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, charged) of each document row. sources: an array of the sources that a document belongs
    to (by default its column `source`, null being a source); source_size and target are those of the first. charged: the taken words by
    the source that they count for."""
    spark = docs.sparkSession
    sources = F.array("source") if sources is None else F.coalesce(sources, F.array().cast("array<string>"))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        n_words(F.col(text_col)).alias("size"),
        F.array_sort(F.array_distinct(sources.cast("array<string>"))).alias("pattern"),
        F.concat(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("u"),
    )
    slim = C.materialize(slim.withColumn("key", F.to_json(F.struct("pattern"))), "mixing")
    sums = slim.groupBy("key", "pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    sums = sorted(sums, key=lambda r: [(s is None, s or "") for s in r["pattern"]])
    names = sorted({s for r in sums for s in r["pattern"]}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in sums:
        for s in r["pattern"]:
            sizes[number[s]] += r["size"]
    target = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], sum(r["size"] for r in sums))
    sent = min_cost_flow([(tuple(number[s] for s in r["pattern"]), r["size"]) for r in sums], [round(t) for t in target])
    rows, several = [], False
    for r, flow in zip(sums, sent, strict=True):
        t, upto, routes = sum(flow.values()), 0, []
        for i, words in flow.items():
            if words:
                upto += words
                routes.append((names[i], upto))
        several = several or len(routes) > 1
        whole = t // r["size"] if r["size"] else 0
        i = number[r["pattern"][0]] if r["pattern"] else None
        rows.append((r["key"], r["size"], sizes[i] if i is not None else 0, target[i] if i is not None else 0.0, whole, t - whole * r["size"], routes))
    kind = "key string, in_all long, source_size long, target double, whole long, rest long, routes array<struct<source:string,upto:bigint>>"
    every = slim.drop("pattern").join(_small(spark.createDataFrame(rows, kind), len(rows)), "key")
    first_fit = C.materialize(_in_order(every, len(rows)).withColumn("row", F.monotonically_increasing_id()), "mixing")

    gaps = {r["key"]: r["rest"] - r["got"] for r in first_fit.where("rest > 0").groupBy("key", "rest").agg(F.sum(F.col("size") * F.col("more")).alias("got")).collect()}
    added = _fill(first_fit.where("more = 0 and size > 0").select("key", "row", "size", "u"), gaps)
    more = F.col("more")
    if added is not None:
        first_fit = first_fit.join(added.withColumn("_added", F.lit(1)), "row", "left")
        more = more + F.coalesce("_added", F.lit(0))
    taken = F.col("size") * (F.col("whole") + more)
    first_fit = first_fit.withColumns({"passes": F.col("whole") + more, "taken": taken})
    out = ["doc_id", "size", "source_size", "target", "taken"]
    one = first_fit.where("size(routes) <= 1") if several else first_fit
    only = F.when(F.col("taken") > 0, F.array(F.struct(F.get("routes", F.lit(0))["source"].alias("source"), F.col("taken").alias("words")))).otherwise(F.array()).cast(_CHARGED)
    charged = one.select(*out, only.alias("charged"))
    return charged.union(_charged(first_fit.where("size(routes) > 1")).select(*out, "charged")) if several else charged


def _charged(docs: DataFrame) -> DataFrame:
    """Rows of patterns of several routes with `charged`. A hot pattern's order is counted in BINS pieces."""
    docs = docs.withColumn("b1", F.conv(F.substring("u", 1, 3), 16, 10).cast("int"))
    bins = docs.groupBy("key", "b1").agg(F.sum("size").alias("in_bin"))
    w = W.partitionBy("key").orderBy("b1").rowsBetween(W.unboundedPreceding, W.currentRow)  # at most BINS rows of a pattern
    bins = bins.select("key", "b1", (F.sum("in_bin").over(w) - F.col("in_bin")).alias("before"))
    here = W.partitionBy("key", "b1").orderBy("u", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    docs = docs.join(bins, ["key", "b1"]).withColumn("middle", F.col("before") + F.sum("size").over(here) - F.col("size") / 2)
    last = F.element_at("routes", -1)
    of_pass = lambda k: F.coalesce(F.get(F.filter("routes", lambda r: r["upto"] > k * F.col("in_all") + F.col("middle")), F.lit(0)), last)["source"]
    docs = docs.withColumn("_to", F.when(F.col("taken") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("passes") - 1, F.lit(0))), of_pass)).otherwise(F.array().cast("array<string>")))
    per = F.transform("routes", lambda r: F.struct(r["source"].alias("source"), (F.col("size") * F.size(F.filter("_to", lambda s: s.eqNullSafe(r["source"])))).alias("words")))
    return docs.withColumn("charged", F.filter(per, lambda c: c["words"] > 0).cast(_CHARGED))


def _in_order(every: DataFrame, keys: int) -> DataFrame:
    """Rows (key, rest, size, u, ...) with `more`: 1 for those of each key that together, in the order of u, fit into its rest. keys: how many
    keys there are at most."""
    hexes = lambda at: F.conv(F.substring("u", at, 3), 16, 10).cast("int")
    every = every.withColumns({"b1": hexes(1), "b2": hexes(4)})

    # the bin in which the rest ends, then the bin within that bin; of the at most BINS bins of a pattern one row each is ordered
    open_ = every.where("rest > 0").withColumn("before", F.lit(0).cast("long"))
    upto = F.sum("in_bin").over(W.partitionBy("key").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("before")
    marked = every
    for b in ("b1", "b2"):
        bins = open_.groupBy("key", "rest", "before", F.col(b).alias("bin")).agg(F.sum("size").alias("in_bin"))
        last = bins.withColumn("upto", upto).where("upto >= rest and upto - in_bin < rest").select("key", F.col("bin").alias(f"last_{b}"), (F.col("upto") - F.col("in_bin")).alias("before"))
        last = _small(last, keys)  # a row for each pattern
        marked = marked.drop("before").join(last, "key", "left")
        open_ = open_.drop("before").join(last, "key").where(F.col(b) == F.col(f"last_{b}"))
    inside = marked.where("b1 = last_b1 and b2 = last_b2 and size > 0")
    order = W.partitionBy("key").orderBy("u", "size")
    upto_here = F.col("before") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    inside = inside.withColumn("more", F.when(upto_here <= F.col("rest"), 1).otherwise(0))
    before_last = F.col("last_b1").isNull() | (F.col("b1") < F.col("last_b1")) | ((F.col("b1") == F.col("last_b1")) & (F.col("b2") < F.col("last_b2")))
    outside = marked.where("not (b1 <=> last_b1 and b2 <=> last_b2) or size = 0").withColumn("more", F.when((F.col("rest") > 0) & before_last, 1).otherwise(0))
    return outside.unionByName(inside).drop("b1", "b2", "last_b1", "last_b2", "before")


def _fill(left: DataFrame, gaps: dict[str, int]) -> DataFrame | None:
    """(row) of what goes into the gaps of its key until nothing more fits. left: (key, row, size, u). Of each key a round takes the largest
    document, in the first TOP_UPS rounds and if that fills half the gap and more, or else what fits in seeded order up to the first that
    doesn't, so that the gap halves. The largest are one row a pattern and round; what is taken in order stays in tables."""
    spark, added, picked, turn = left.sparkSession, [], [], 0
    gaps = {k: g for k, g in gaps.items() if g > 0}
    as_rows = lambda: _small(spark.createDataFrame([(r,) for r in picked], "row long"), len(picked))
    first = True
    while gaps:
        small = _small(spark.createDataFrame(list(gaps.items()), "key string, rest long"), len(gaps))
        fits = left.join(small, "key").where("size <= rest")
        if picked:
            fits = fits.join(as_rows(), "row", "left_anti")
        if first:
            left = C.materialize(fits.drop("rest"), "mixing-left")
            fits, first = left.join(small, "key"), False
        best = {r["key"]: r["b"] for r in fits.groupBy("key").agg(F.max(F.struct("size", "u", "row")).alias("b")).collect()}
        gaps = {k: gaps[k] for k in best}
        ordered = [(k, g) for k, g in gaps.items() if turn >= TOP_UPS and 2 * best[k]["size"] < g]
        for k in gaps.keys() - {k for k, _ in ordered}:
            gaps[k] -= best[k]["size"]
            picked.append(best[k]["row"])
        if ordered:
            some = fits.join(_small(spark.createDataFrame(ordered, "key string, _g long").select("key"), len(ordered)), "key")
            new = C.materialize(_in_order(some, len(ordered)).where("more = 1").select("key", "row", "size"), "mixing-added")
            for r in new.groupBy("key").agg(F.sum("size").alias("got")).collect():
                gaps[r["key"]] -= r["got"]
            added.append(new.select("row"))
            left = C.materialize(left.join(added[-1], "row", "left_anti"), "mixing-left")
        gaps = {k: g for k, g in gaps.items() if g > 0}
        turn += 1
    if picked:
        added.append(spark.createDataFrame([(r,) for r in picked], "row long"))
    return reduce(DataFrame.union, added) if added else None


# ---------------------------------------------------------------- query


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return plan(C.table(spark, sf_dir, "documents")).drop("charged")


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) || md5(coalesce(text, '')) AS u FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
n AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, 3 * source_size AS cap, 3.0::DOUBLE * source_size / w AS ratio FROM n),
k AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM o),
level AS (SELECT min_by(CAST(total - below AS DOUBLE) / CAST(w_left AS DOUBLE), ratio) AS level FROM k WHERE CAST(total - below AS DOUBLE) / CAST(w_left AS DOUBLE) <= ratio),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CASE WHEN level * w > cap THEN CAST(cap AS DOUBLE) ELSE level * w END AS target FROM o, level),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(round_even(target, 0) AS BIGINT), 3 * source_size) ELSE 0 END AS sent FROM t),
r AS (SELECT *, CASE WHEN source_size > 0 THEN sent // source_size ELSE 0 END AS whole, CASE WHEN source_size > 0 THEN sent % source_size ELSE 0 END AS rest FROM q),
c AS (SELECT d.doc_id, d.size, d.u, d.source, r.source_size, r.target, r.whole, r.rest,
    rest > 0 AND sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest AS m0
    FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
c1 AS (SELECT *, row_number() OVER () AS rid, rest - sum(CASE WHEN m0 THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM c),
f(turn, rid, source, size, u, gap, took) AS (SELECT 0, rid, source, size, u, gap, false FROM c1 WHERE NOT m0 AND size > 0
  UNION ALL SELECT turn + 1, rid, source, size, u, gap - sum(CASE WHEN t THEN size ELSE 0 END) OVER (PARTITION BY source), t
  FROM (SELECT *, CASE WHEN turn < {TOP_UPS} OR 2 * largest >= gap THEN is_largest ELSE upto <= gap END AS t
    FROM (SELECT *, max(size) OVER (PARTITION BY source) AS largest, row_number() OVER (PARTITION BY source ORDER BY size DESC, u DESC) = 1 AS is_largest,
        sum(size) OVER (PARTITION BY source ORDER BY u, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM f WHERE NOT took AND size <= gap)))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (whole + CASE WHEN m0 OR rid IN (SELECT rid FROM f WHERE took) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c1
"""
