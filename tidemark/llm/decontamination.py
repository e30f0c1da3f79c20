"""Benchmark decontamination with training suffix arrays (operator 3).

The documents are cut into shards of about SLICE_BYTES of text, partition by partition. In a shard the words become numbers of the benchmark's vocabulary
(0: not in it), and a suffix array is sorted over those positions whose run of vocabulary words is long enough
for a match: any other suffix differs from every test suffix within the shortest window, so leaving it out loses
nothing. Every test suffix whose first two words occur in the shard is then binary-searched in the shard's array: the longest verbatim match and its
places come from its insertion point, the places of its window from the interval of suffixes that share the window.

The benchmark goes to the workers in blocks of at most BLOCK_BYTES of text; each block is one more pass over the
documents, so that what is broadcast is bounded, whatever the benchmark's size.

Defined results
  text null, empty or without words   n_words 0, nothing hit, not contaminated; as an item: never occurs
  item of fewer than `window` words   is one window as it is
  item_id null                        its windows hit words, but it isn't counted in n_items
  repeated item_id                    its texts together are the one item
  repeated or null doc_id             every row is judged by itself
  very long texts                     a shard of their own
  empty tables                        no rows; or no hit
  more columns in documents           ignored by `scan`, kept by `decontaminate`
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

WINDOW = 10
BLOCK_BYTES = 16 << 20

SCAN_SCHEMA = (
    "row_id long, n_words long, hit_start array<int>, hit_end array<int>, item_ids array<string>, "
    "longest_words int, longest_item string, longest_at int"
)


class Block:
    """A block of the benchmark: its words as numbers, its windows, and its suffixes."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        data = np.frombuffer(b" ".join(t for _, t in items) or b" ", np.uint8)
        ends = np.cumsum([len(t) + 1 for _, t in items])
        offsets = np.concatenate([[0], np.minimum(ends, len(data))]).astype(np.int64)
        data = C.LOWER[data]
        s, e, first = C.words(data, offsets, C.ALNUM)
        h = C.word_hashes(data, s, e)
        self.vocab, at, codes = np.unique(h, return_index=True, return_inverse=True)
        self.spelled = [data[s[i] : e[i]].tobytes() for i in at]
        self.codes = (codes + 1).astype(np.int32)
        self.item = np.repeat(np.arange(len(items)), np.diff(first))
        self.names = [n for n, _ in items]
        n = np.diff(first)
        self.end = np.repeat(first[1:], n)  # where the suffix's item ends
        left = self.end - np.arange(len(codes))
        whole = np.repeat(n, n)
        #: Words of the window that begins here; 0: none does.
        self.size = np.where(left >= window, window, np.where((whole < window) & (left == whole), whole, 0)).astype(np.int64)
        self.shortest = int(self.size[self.size > 0].min()) if (self.size > 0).any() else 0
        # bits of the hash that the vocabulary takes: a quick way to turn most words away
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.vocab >> np.uint64(44)] = True

    def encode(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Each word's number in the vocabulary by its 64-bit hash, or 0."""
        h = C.word_hashes(data, s, e)
        out = np.zeros(len(h), np.int32)
        maybe = np.flatnonzero(self.bits[h >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.vocab, h[maybe]), len(self.vocab) - 1)
        good = self.vocab[at] == h[maybe]
        out[maybe[good]] = at[good] + 1
        return out


def _suffix_order(codes: np.ndarray, pos: np.ndarray, depth: int) -> np.ndarray:
    """`pos` sorted by the words that follow, compared up to `depth` words; codes ends with `depth` zeros.
    A radix sort from the last word: each pass is one stable sort over small numbers."""
    order = pos
    for d in range(depth - 1, -1, -1):
        order = order[np.argsort(codes[order + d], kind="stable")]
    return order


def _search(codes: np.ndarray, sa: np.ndarray, test: np.ndarray, at: np.ndarray, size: np.ndarray, right: bool) -> np.ndarray:
    """For each test suffix the first place in `sa` whose first `size` words are not below (right: are above) it."""
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) >> 1
        p, q, n = sa[mid], at[live], size[live]
        below = np.zeros(len(live), bool)
        tied = np.ones(len(live), bool)
        for d in range(int(n.max())):
            k = np.flatnonzero(tied & (d < n))
            if not len(k):
                break
            x, y = codes[p[k] + d], test[q[k] + d]
            below[k] |= x < y
            tied[k[x != y]] = False
        down = below | (tied if right else False)
        lo[live[down]] = mid[down] + 1
        hi[live[~down]] = mid[~down]


def _longest(codes: np.ndarray, place: np.ndarray, test: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words in common from place[i] in the shard and at[i] in the test, up to the item's end."""
    n = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        p, q = place[live] + n[live], at[live] + n[live]
        ok = q < end[live]
        ok[ok] = codes[np.minimum(p[ok], len(codes) - 1)] == test[q[ok]]
        live = live[ok]
        n[live] += 1
    return n


def scan_slice(data: np.ndarray, offsets: np.ndarray, block: Block) -> tuple[np.ndarray, dict[int, tuple]]:
    """n_words of each text, and for texts with a match: (starts, ends, item numbers, longest match)."""
    data = C.LOWER[data]
    s, e, first = C.words(data, offsets, C.ALNUM)
    n_words = np.diff(first)
    found: dict[int, tuple] = {}
    if not block.shortest or not len(s):
        return n_words, found
    codes = block.encode(data, s, e)
    # words from here to the end of the run of vocabulary words within the text
    stop = np.zeros(len(codes) + 1, bool)
    stop[:-1] = codes == 0
    stop[first] = True
    stops = np.flatnonzero(stop)
    here = np.arange(len(codes))
    run = stops[np.searchsorted(stops, here, "right")] - here
    run[codes == 0] = 0
    pos = np.flatnonzero(run >= block.shortest)
    if not len(pos):
        return n_words, found
    # words that may match are compared by their bytes too: a mere meeting of hashes ends the run
    long_run = np.zeros(len(codes) + 1, np.int64)
    np.add.at(long_run, pos, 1)
    np.add.at(long_run, pos + run[pos], -1)
    for k in np.flatnonzero(np.cumsum(long_run[:-1]) > 0):
        if data[s[k] : e[k]].tobytes() != block.spelled[codes[k] - 1]:
            codes[k] = 0
    depth = int(block.size.max())
    # the texts apart by a 0, and enough of them behind the last
    shift = np.repeat(np.arange(len(first) - 1), n_words)
    apart = np.zeros(len(codes) + len(first) + depth + 1, np.int32)
    apart[here + shift] = codes
    sa = _suffix_order(apart, pos + shift[pos], depth)
    back = np.zeros(len(apart), np.int64)  # from places among the texts apart to words
    back[here + shift] = here

    # only test suffixes whose first words begin a suffix here can be found: the others need no search
    test = np.append(block.codes, np.zeros(depth, np.int32))
    heads = apart[sa].astype(np.int64)
    begins = np.zeros(len(block.vocab) + 1, bool)
    begins[heads] = True
    tests = np.flatnonzero(block.size)
    tests = tests[begins[test[tests]]]
    pairs = np.unique(heads << 32 | apart[sa + 1])
    two = test[tests].astype(np.int64) << 32 | test[tests + 1]
    tests = tests[(block.size[tests] < 2) | (pairs[np.minimum(np.searchsorted(pairs, two), len(pairs) - 1)] == two)]
    if not len(tests):
        return n_words, found
    size = block.size[tests]
    lo = _search(apart, sa, test, tests, size, False)
    hi = _search(apart, sa, test, tests, size, True)
    got = np.flatnonzero(hi > lo)
    if not len(got):
        return n_words, found
    count = (hi - lo)[got]
    which = np.repeat(got, count)
    place = sa[np.repeat(lo[got], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    length = _longest(apart, place, test, tests[which], block.end[tests[which]])
    at = back[place]
    doc = np.searchsorted(first, at, "right") - 1
    for d in np.unique(doc):
        k = np.flatnonzero(doc == d)
        a = at[k] - first[d]
        b = a + size[which[k]]
        cover = np.zeros(n_words[d] + 1, np.int64)
        np.add.at(cover, a, 1)
        np.add.at(cover, b, -1)
        hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        best = k[np.lexsort((at[k], tests[which[k]], -length[k]))[0]]
        found[int(d)] = (edge[::2], edge[1::2], np.unique(block.item[tests[which[k]]]), int(length[best]), int(block.item[tests[which[best]]]), int(at[best] - first[d]))
    return n_words, found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in blocks of bounded bytes; rows come to the driver one partition at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator():
        held.append((r[0], bytes(r[1] or b"")))
        size += len(held[-1][1]) + 1
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document row: row_id (its id), n_words, the merged spans of hit words (hit_start, hit_end), item_ids, and the
    longest verbatim match of any window's suffix (words, item, first word in the document). Sorted lists."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))
    shared = [spark.sparkContext.broadcast((items, window)) for items in _blocks(benchmark, item_col, item_text_col)]
    if len(shared) <= 1:
        return _pass(slim, shared[0] if shared else spark.sparkContext.broadcast(([], window)))
    # more than one pass: what they find of a row is united by a number that is stored with the row first
    numbered = C.materialize(slim.select(F.monotonically_increasing_id().alias("row_id"), F.col("row_id").alias("_id"), "text"), "decontamination")
    found = _merged([_pass(numbered.select("row_id", "text"), x) for x in shared])
    return found.withColumnRenamed("row_id", "_row").join(numbered.select(F.col("row_id").alias("_row"), F.col("_id").alias("row_id")), "_row").select(*found.columns)


def _pass(slim: DataFrame, shared) -> DataFrame:
    schema = pa.schema([("row_id", pa.int64()), ("n_words", pa.int64()), ("hit_start", pa.list_(pa.int32())), ("hit_end", pa.list_(pa.int32())), ("item_ids", pa.list_(pa.string())), ("longest_words", pa.int32()), ("longest_item", pa.string()), ("longest_at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, window = shared.value
        block = Block(items, window)
        for b in batches:
            ids = b.column(0)
            for i, data, offsets in C.text_slices(b.column(1)):
                n, found = scan_slice(data, offsets, block)
                rows = [found.get(k) for k in range(len(n))]
                names = [sorted({block.names[x] for x in r[2] if block.names[x] is not None}) if r else [] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, len(n)),
                        pa.array(n, pa.int64()),
                        pa.array([r[0] if r else [] for r in rows], pa.list_(pa.int32())),
                        pa.array([r[1] if r else [] for r in rows], pa.list_(pa.int32())),
                        pa.array(names, pa.list_(pa.string())),
                        pa.array([r[3] if r else 0 for r in rows], pa.int32()),
                        pa.array([block.names[r[4]] if r else None for r in rows], pa.string()),
                        pa.array([r[5] if r else None for r in rows], pa.int32()),
                    ],
                    schema=schema,
                )

    return slim.mapInArrow(run, SCAN_SCHEMA)


def _merged(passes: list[DataFrame]) -> DataFrame:
    """Unite the passes' findings of each row; row_id is the row's own number."""
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    every = every.withColumn("spans", F.arrays_zip("hit_start", "hit_end"))
    g = every.groupBy("row_id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),  # one entry for each pass
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.max_by(F.struct("longest_words", "longest_item", "longest_at"), F.struct("longest_words", F.col("longest_item"))).alias("l"),
    )
    start = F.struct(F.expr("cast(array() as array<struct<hit_start:int,hit_end:int>>)").alias("done"))
    merged = F.aggregate(
        "spans",
        start,
        lambda acc, x: F.struct(
            F.when(
                (F.size(acc["done"]) > 0) & (F.element_at(acc["done"], -1)["hit_end"] >= x["hit_start"]),
                F.concat(
                    F.slice(acc["done"], 1, F.greatest(F.size(acc["done"]) - 1, F.lit(0))),
                    F.array(F.struct(F.element_at(acc["done"], -1)["hit_start"].alias("hit_start"), F.greatest(F.element_at(acc["done"], -1)["hit_end"], x["hit_end"]).alias("hit_end"))),
                ),
            )
            .otherwise(F.concat(acc["done"], F.array(x)))
            .alias("done")
        ),
        lambda acc: acc["done"],
    )
    return g.withColumn("m", merged).select("row_id", "n_words", F.col("m.hit_start").alias("hit_start"), F.col("m.hit_end").alias("hit_end"), "item_ids", "l.longest_words", "l.longest_item", "l.longest_at")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest match."""
    n_hit = F.aggregate(F.zip_with("hit_end", "hit_start", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        F.col("row_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "longest_words",
        "longest_item",
        "longest_at",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """`docs` without the rows that a window of the benchmark occurs in; columns as they are. Rows are filtered where
    they are read: nothing is shuffled or joined."""
    out = docs
    spark = docs.sparkSession
    for items in _blocks(benchmark, "item_id", "text"):
        shared = spark.sparkContext.broadcast((items, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, window = shared.value
            block = Block(items, window)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for i, data, offsets in C.text_slices(b.column(b.schema.get_field_index(text_col))):
                    for d in scan_slice(data, offsets, block)[1]:
                        keep[i + d] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out


# ---------------------------------------------------------------- query


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return summary(scan(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len(w) AS n, w FROM b WHERE len(w) BETWEEN 1 AND {WINDOW - 1}
  UNION SELECT item_id, {WINDOW}, list_slice(w, i, i + {WINDOW - 1}) FROM (SELECT item_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM b WHERE len(w) >= {WINDOW})),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS w FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, pos.n, item_id FROM pos JOIN win ON pos.n = win.n AND pos.w = win.w),
hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""
