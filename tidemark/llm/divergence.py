"""Source divergence audit: how far the term frequencies of the sources of a language lie apart (operator 12).

A group is a (lang, source). Each language keeps the V terms that at least LEAST of its documents have; every group and every language
gives each of them p = 1 + floor(10^9 (count + 1) / (N + V)), N the sum of its counts. Groups a and b of a language differ by

    D(a, b) = sum over the kept terms of floor((p_a - p_b)^2 / p_b)

which is found exactly, in two parts that are added. Terms of many groups (`dense_share` of the language's, and more than two) are dealt
as dense tiles: some terms times two blocks of groups, a numpy matrix with a value in each cell. The others are postings: where one group has
a term, what it gives depends on its count alone (a histogram of each group's counts meets the other groups), and what both have is corrected by
a join of the term's postings, of which there are few by the choice of terms. Where both have count 0 every term gives the same.

Counting is exact: words are numbered by Arrow's dictionaries, not by hashes; p is found with decimals, so that counts of any size fit.

Defined results
  text, lang or source null     count as ''
  repeated rows                 each row is a document
  a language without kept terms V = 0: pairs of value 0, no terms
  a language of one source      terms, no pairs
  ties                          by the item's UTF-8 bytes
  very long texts               whole, each a slice of its own
  empty documents               no rows
  more columns                  ignored
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm import common as C

LEAST = 3
SCALE = 1_000_000_000
TOP = 200
#: Terms of more than two groups and of at least this share of the language's groups are dense.
DENSE_SHARE = 0.25
#: Terms and groups of a tile's sides: at most 2 * TILE_GROUPS * TILE_TERMS cells are filled at once.
TILE_TERMS = 4096
TILE_GROUPS = 64
#: Groups of a block, where groups meet the counts of others.
BLOCK = 16

_B = np.arange(256)
#: Bytes of terms, after lower-casing: letters and all from 0x80.
LETTERS = ((_B >= 97) & (_B <= 122)) | (_B >= 128)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences in the group, and its documents that have the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [b.column(k).dictionary_encode() for k in (0, 1)]
            lang, source = (x.indices.to_numpy().astype(np.int64) for x in names)
            width = len(names[1].dictionary)
            for i, data, offsets in C.text_slices(b.column(2)):
                low = C.LOWER[data]
                words, first = C.word_array(low, offsets, LETTERS[low])
                coded = words.dictionary_encode()
                k = len(coded.dictionary)
                if not k:
                    continue
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                pair, n = np.unique(doc * k + coded.indices.to_numpy(), return_counts=True)
                doc, term = pair // k, pair % k
                cell, place = np.unique((lang[i + doc] * width + source[i + doc]) * k + term, return_inverse=True)
                group, term = cell // k, cell % k
                yield pa.RecordBatch.from_arrays(
                    [
                        names[0].dictionary.take(pa.array(group // width)),
                        names[1].dictionary.take(pa.array(group % width)),
                        coded.dictionary.take(pa.array(term)).cast(pa.string()),
                        pa.array(np.bincount(place, n).astype(np.int64)),
                        pa.array(np.bincount(place)),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    found = named.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kinds)), exact; null if there are no kinds."""
    whole = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(kinds > 0, 1 + _div(whole, (total + kinds).cast("decimal(20,0)")))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of numbers from 1 to 10^9 + 1: the square fits in a long."""
    return _div((p - q) * (p - q), q)


def audit(docs: DataFrame, *, least: int = LEAST, top: int = TOP, dense_share: float = DENSE_SHARE, tile_terms: int = TILE_TERMS, tile_groups: int = TILE_GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` has every other source of the language by D(source, item), `term` the `top` terms
    of which the group has more than its language, by what they add to its distance from it."""
    w = W.partitionBy("lang", "term")
    counted = term_counts(docs).withColumns({"_docs": F.sum("docs").over(w), "lang_n": F.sum("n").over(w), "groups": F.count(F.lit(1)).over(w), "first": F.col("source") == F.min("source").over(w)})
    kept = C.materialize(counted.where(F.col("_docs") >= least).drop("docs", "_docs"), "divergence-terms")
    groups = C.materialize(_groups(docs, kept, dense_share), "divergence-groups")
    bounded = groups.count() <= C.BROADCAST_ROWS
    stats = F.broadcast(groups) if bounded else groups

    joined = kept.join(stats, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("kinds")), share(F.col("lang_n"), F.col("lang_total"), F.col("kinds"))
    dense = (F.col("groups") > 2) & (F.col("groups") >= F.col("of") * dense_share)
    rows = C.materialize(joined.select("lang", "source", "term", "n", "p0", "of", "dense_terms", p.alias("p"), q.alias("q"), dense.alias("dense")), "divergence-shares")

    order = [F.desc("value"), F.asc("item")]
    terms = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)

    parts = _tiles(rows, groups, tile_terms, tile_groups).unionByName(_postings(rows, groups, stats))
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order)))
    out = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", pairs), ("term", terms))]
    return out[0].union(out[1])


def _groups(docs: DataFrame, kept: DataFrame, dense_share: float) -> DataFrame:
    """Each group with its sum of counts and those of its language: kinds V, sum, groups (of), dense and light terms, and its p of count 0."""
    every = C.materialize(docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct(), "divergence-names")
    sizes = C.materialize(every.groupBy("lang").agg(F.count(F.lit(1)).alias("of")), "divergence-sizes")
    if sizes.count() <= C.BROADCAST_ROWS:
        sizes = F.broadcast(sizes)  # else dealing all terms by a few languages would make as few tasks
    few = (F.col("groups") <= 2) | (F.col("groups") < F.col("of") * dense_share)
    count = lambda c: F.count_if(c)
    of = kept.join(sizes, "lang").groupBy("lang", "source").agg(F.sum("n").alias("total"), count(F.col("first")).alias("_kinds"), count(F.col("first") & ~few).alias("_dense"), count(few).alias("light"))
    all_of = W.partitionBy("lang")
    sums = every.join(sizes, "lang").join(of, ["lang", "source"], "left").na.fill(0, ["total", "_kinds", "_dense", "light"])
    sums = sums.select("lang", "source", "of", "total", "light", F.sum("_kinds").over(all_of).alias("kinds"), F.sum("_dense").over(all_of).alias("dense_terms"), F.sum("total").over(all_of).alias("lang_total"))
    return sums.withColumn("p0", share(F.lit(0), F.col("total"), F.col("kinds")))


# ---------------------------------------------------------------- terms of many groups


def _tiles(rows: DataFrame, groups: DataFrame, tile_terms: int, tile_groups: int) -> DataFrame:
    """(lang, source, item, value): what the dense terms add to each pair beyond what a term of count 0 on both sides gives, tile by tile: a
    chunk of terms times two blocks of groups, all of them in every chunk."""
    chunks = F.greatest(F.ceil(F.col("dense_terms") / tile_terms), F.lit(1)).cast("int")
    cells = rows.where("dense").select("lang", "source", "of", "p0", F.pmod(F.xxhash64("term"), chunks).cast("int").alias("chunk"), "term", "p")
    marks = groups.where("dense_terms > 0").select("lang", "source", "of", "p0", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit("").alias("term"), F.col("p0").alias("p"))
    blocks = F.ceil(F.col("of") / tile_groups).cast("int")
    mine = F.pmod(F.xxhash64("source"), blocks).cast("int")
    both = cells.union(marks).withColumn("_mine", mine).withColumn("_k", F.explode(F.sequence(F.lit(0), blocks - 1)))
    both = both.select("lang", "chunk", F.least("_mine", "_k").alias("bi"), F.greatest("_mine", "_k").alias("bj"), (F.col("_mine") > F.col("_k")).cast("int").alias("side"), "source", "term", "p")
    keys = ["lang", "chunk", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in C.sorted_groups(batches, keys):
            for a, b in zip(at[:-1], at[1:], strict=True):
                x = t.slice(a, b - a)
                yield from _tile(x.column("lang")[0].as_py(), x.column("bi")[0].as_py() == x.column("bj")[0].as_py(), x)

    dealt = both.repartition(*keys).sortWithinPartitions(*keys)
    found = dealt.mapInArrow(run, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _tile(lang: str, alone: bool, x: pa.Table) -> Iterator[pa.RecordBatch]:
    """The sums of one tile, both ways round. Rows without a term mark the groups and what they give the terms they lack; terms that none
    of the tile's groups has add nothing to these sums."""
    names, term, p, side = (x.column(c).combine_chunks() for c in ("source", "term", "p", "side"))
    sources, terms = names.dictionary_encode(), term.dictionary_encode()
    g, t, p, side = sources.indices.to_numpy(), terms.indices.to_numpy(), p.to_numpy(), side.to_numpy()
    marks = term.to_numpy(zero_copy_only=False) == ""
    cells = np.empty((len(sources.dictionary), len(terms.dictionary)), np.int64)
    cells[g[marks]] = p[marks][:, None]
    cells[g[~marks], t[~marks]] = p[~marks]
    none = cells[:, t[marks][:1]].copy()  # the column of the marks: what count 0 gives
    cells = np.delete(cells, t[marks][:1], axis=1)
    left, right = g[marks & (side == 0)], g[marks & (side == 1)]
    for one, two in [(left, left)] if alone else [(left, right), (right, left)]:
        if not len(one) or not len(two):
            continue
        q, q0 = cells[two], none[two, 0]
        value = np.stack([((cells[a] - q) ** 2 // q).sum(1) - cells.shape[1] * ((none[a] - q0) ** 2 // q0) for a in one])
        here = np.repeat(one, len(two)) != np.tile(two, len(one))
        of, item = (sources.dictionary.take(pa.array(v[here])) for v in (np.repeat(one, len(two)), np.tile(two, len(one))))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(of), pa.string()), of, item, pa.array(value.ravel()[here])], ["lang", "source", "item", "value"])


# ---------------------------------------------------------------- terms of few groups


def _meeting(left: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (lang, source, ..) with each other group (item, q0, more) of their language, dealt by blocks of groups."""
    blocks = F.ceil(F.col("of") / BLOCK).cast("int")
    mine = lambda: F.pmod(F.xxhash64("source"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("light").alias("item_light"), mine().alias("bj"), every.alias("bi"))
    return left.withColumns({"bi": mine()}).withColumn("bj", every).join(others, ["lang", "bi", "bj"]).where("source <> item").drop("bi", "bj")


def _postings(rows: DataFrame, groups: DataFrame, stats: DataFrame) -> DataFrame:
    """(lang, source, item, value): what all terms would add to each pair if neither side had any, and what those of few groups change."""
    out = ["lang", "source", "item", "value"]
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    # as if neither had any: every term but the light ones of either side
    none = _meeting(groups, groups)
    none = none.select("lang", "source", "item", F.when(F.col("kinds") > 0, (F.col("kinds") - F.col("light") - F.col("item_light")) * _gap(p0, q0)).otherwise(0).alias("value"))
    # as if the other had none: one row for each count of a group
    counts = rows.where("not dense").groupBy("lang", "source", "of", "p0", "p").agg(F.count(F.lit(1)).alias("m"))
    sides = _meeting(counts, groups).groupBy("lang", "source", "item").agg(F.sum(F.col("m") * _gap(p, q0)).alias("there"), F.sum(F.col("m") * _gap(q0, p)).alias("back"))
    sides = sides.select("lang", F.inline(F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))))
    # what both have
    light = rows.where("not dense")
    other = light.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = light.select("lang", "term", "source", "p", "p0").join(other, ["lang", "term"]).where("source <> item")
    both = both.groupBy("lang", "source", "item").agg(F.sum(_gap(p, q) - _gap(p, q0) - _gap(p0, q) + _gap(p0, q0)).alias("value"))
    return none.select(*out).union(sides.select(*out)).union(both.select(*out))


# ---------------------------------------------------------------- query


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return audit(C.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from words group by all having count(distinct id) >= 3),
n as (select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by all),
groups as (select distinct lang, source from d),
kinds as (select g.lang, count(term) as v from (select distinct lang from d) g left join kept using (lang) group by all),
total as (select g.lang, g.source, coalesce(sum(n), 0)::hugeint as total from groups g left join n using (lang, source) group by all),
langs as (select lang, sum(total)::hugeint as total from total group by all),
p as (
  select g.lang, g.source, k.term, coalesce(n.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n.n, 0) + 1)) // (t.total + v) as p
  from groups g join kept k using (lang) left join n using (lang, source, term) join total t using (lang, source) join kinds using (lang)
),
q as (
  select lang, term, 1 + (1000000000::hugeint * (sum(n) + 1)) // (any_value(l.total) + any_value(v)) as q
  from n join langs l using (lang) join kinds using (lang) group by all
),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(sum(((pa.p - pb.p) * (pa.p - pb.p)) // pb.p), 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join p pa on pa.lang = a.lang and pa.source = a.source left join p pb on pb.lang = b.lang and pb.source = b.source and pb.term = pa.term
  group by all
),
terms as (
  select lang, source, term as item, (((p - q) * (p - q)) // q)::bigint as value, row_number() over (partition by lang, source order by ((p - q) * (p - q)) // q desc, term) as rank
  from p join q using (lang, term) where n > 0 and p > q
)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all
select lang, source, 'term', item, value, rank::int from terms where rank <= 200
"""
