"""SimHash near-dedup by multi-index hashing (operator 7).

A fingerprint has a bit for each of 64 places: set if it is set in over half of the hashes (XXH64, seed 42) of
the text's word shingles, repeats included. Equal fingerprints are one node. To find all pairs within `radius` bits the
fingerprint is cut into segments: of two within the radius, some segment differs in at most radius // segments bits.
Each fingerprint is put into a table by each segment, and probes the table at every key of a small Hamming ball around
its segment; what meets at a key is held against each other by the complete distance. A key with many fingerprints is cut
into blocks (common.spread_buckets), and a block gives the edges of a spanning forest, not its pairs.

Defined results
  text null, empty or without words    fingerprint 0, linked like any other
  fewer words than a shingle has       the whole sequence is the one shingle
  very long texts                      counted in pieces, whole
  repeated doc_id                      each row has its own fingerprint; `dedup` keeps one row of a group
  doc_id null                          never the group's smallest id unless all are null (then component_id is null)
  empty table                          no rows
  more columns                         ignored by `groups`, kept by `dedup`
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common as C

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Near copies in `dedup`: five-word shingles, similarity 0.8 and more, looked for within 10 bits. At that similarity fingerprints differ
#: by 7 bits in the median and by up to 10 in nine of ten cases.
SIMILAR_SHINGLE, SIMILARITY, SIMILAR_RADIUS, SIMILAR_SEGMENTS = 5, 0.8, 10, 6
#: Members of a bucket that are compared in one piece.
CHUNK = 2048
#: Texts of one fingerprint up to which its candidate pairs are checked one by one; shingles a member in a piece, on average at most.
MANY, GRAMS = 8, 2048
#: Shingles that are counted at once, so that a very long text needs no more memory than others.
PIECE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text in UTF-8, as an unsigned number."""
    w = text.translate(C.LOWER_BYTES).split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(w) - shingle + 1)
    starts, ends = starts[:k].tolist(), ends[-k:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, k, PIECE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + PIECE], ends[i : i + PIECE], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > k, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, hashed: bool = False) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long. hashed: beside them h, a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            fp = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", "h"][: b.num_columns])

    more = [F.xxhash64(text_col).alias("h")] if hashed else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more).mapInArrow(run, "doc_id long, fp long" + ", h long" * hashed)


def _cuts(segments: int) -> list[tuple[int, int]]:
    at = [round(64 * i / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def _ball(width: int, radius: int) -> np.ndarray:
    """The masks of 1 to `radius` bits."""
    return np.array([sum(1 << i for i in c) for r in range(1, radius + 1) for c in combinations(range(width), r)], np.uint64)


def members(fps: DataFrame, radius: int, segments: int) -> DataFrame:
    """(key, fp, placed): each distinct fingerprint's places in the tables (placed 1) and its probes (0). Two that differ
    within a segment are found from one side: the one whose lowest differing bit is 0 probes."""
    small = radius // segments
    cuts = _cuts(segments)
    balls = {w: _ball(w, small) for _, w in cuts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                fp = b.column(0).slice(at, 8192).to_numpy(zero_copy_only=False).view(np.uint64)
                for s, (shift, width) in enumerate(cuts):
                    seg = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                    keys, who, placed = [seg], [fp], [np.ones(len(fp), np.int8)]
                    for m in balls[width]:
                        p = (seg & (m & (~m + np.uint64(1)))) == 0
                        keys.append(seg[p] ^ m)
                        who.append(fp[p])
                        placed.append(np.zeros(int(p.sum()), np.int8))
                    key = np.concatenate(keys) | np.uint64(s << 40)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.concatenate(who).view(np.int64)), pa.array(np.concatenate(placed))], ["key", "fp", "placed"])

    return fps.select("fp").mapInArrow(run, "key long, fp long, placed byte")


def _edges_in(keys: np.ndarray, fp: np.ndarray, side: np.ndarray, cross: np.ndarray, at: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what is within the radius in each group; cross: only pairs of both sides count."""
    n = np.diff(at)
    gid = np.repeat(np.arange(len(n)), n)
    few = n[gid] <= 48
    i = np.flatnonzero(few)
    for d in range(1, 48):
        a, b = i[:-d], i[d:]
        if not len(a):
            break
        k = gid[a] == gid[b]
        if not k.any():
            break
        a, b = a[k], b[k]
        k = (np.bitwise_count(fp[a] ^ fp[b]) <= radius) & (~cross[a] | (side[a] != side[b]))
        yield fp[a[k]], fp[b[k]]
    for g in np.flatnonzero(n > 48):
        x, s = fp[at[g] : at[g + 1]], side[at[g] : at[g + 1]]
        adj = np.empty((len(x), len(x)), bool)
        for r in range(0, len(x), 512):
            adj[r : r + 512] = np.bitwise_count(x[r : r + 512, None] ^ x[None, :]) <= radius
        if cross[at[g]]:
            adj &= s[:, None] != s[None, :]
        a, b = C.spanning_forest(adj)
        yield x[a], x[b]


def _candidates_in(keys: np.ndarray, fp: np.ndarray, side: np.ndarray, cross: np.ndarray, at: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs within the radius in each group, for a later check. Where these are over two a member (a hot group of near copies), edges
    that connect what the pairs connect stand for them, marked as such: all pairs among what they connect are still to be checked."""
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        x, n = fp[lo:hi], hi - lo
        adj = np.empty((n, n), bool)
        for r in range(0, n, 512):
            adj[r : r + 512] = np.bitwise_count(x[r : r + 512, None] ^ x[None, :]) <= radius
        np.fill_diagonal(adj, False)
        if cross[lo]:
            adj[side[lo:hi, None] == side[None, lo:hi]] = False
        hot = bool(adj.sum() > 4 * n)
        a, b = C.spanning_forest(adj) if hot else np.nonzero(np.triu(adj))
        yield x[a], x[b], hot


def _similar_in(fp: np.ndarray, side: np.ndarray, cross: np.ndarray, at: np.ndarray, grams: np.ndarray, ends: np.ndarray, near: int, radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links in each group, every pair that it doesn't connect having been checked. Member i has the
    shingles grams[ends[i] : ends[i + 1]]; cross: only pairs of both sides count."""
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        x, s, start, size = fp[lo:hi], side[lo:hi], ends[lo:hi] - ends[lo], np.diff(ends[lo : hi + 1])
        known, ids = np.unique(grams[ends[lo] : ends[hi]], return_inverse=True)
        mark, free = np.zeros(len(known), bool), np.ones(hi - lo, bool)
        a, b = [], []
        for root in range(hi - lo):
            frontier = [root] if free[root] else []
            free[root] = False
            while frontier:
                f = frontier.pop()
                to = np.flatnonzero(free & (s != s[f]) if cross[lo] else free)
                bits = np.bitwise_count(x[to] ^ x[f])
                linked = bits <= near
                far = np.flatnonzero(~linked & (bits <= radius) & (size[to] > 0) & (np.minimum(size[to], size[f]) >= similarity * np.maximum(size[to], size[f])))
                if len(far):
                    k = to[far]
                    n = size[k]
                    first = np.cumsum(n) - n
                    mine = ids[start[f] : start[f] + size[f]]
                    mark[mine] = True
                    both = np.add.reduceat(mark[ids[np.repeat(start[k] - first, n) + np.arange(n.sum())]], first, dtype=np.int64)
                    mark[mine] = False
                    linked[far] = both >= similarity * (size[f] + n - both)
                to = to[linked]
                free[to] = False
                a.append(np.full(len(to), f))
                b.append(to)
                frontier.extend(to.tolist())
        if a:
            yield x[np.concatenate(a)], x[np.concatenate(b)]


def _met(fps: DataFrame, radius: int, segments: int, pick) -> DataFrame:
    """(u, v, hot): what `pick` gives of the groups in which fingerprints meet; hot where it says so."""
    every = members(fps, radius, segments)
    sizes = every.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.max("placed").alias("_p")).where("_n > 1 and _p = 1").drop("_p")
    spread = C.spread_buckets(every.select("key", "fp").hint("merge"), "key", "fp", CHUNK, sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in C.sorted_groups(batches, ["key", "bi", "bj"]):
            key, fp, side, bi, bj = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "fp", "side", "bi", "bj"))
            for u, v, *hot in pick(key, fp.view(np.uint64), side, bi != bj, at, radius):
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(np.full(len(u), any(hot)))], ["u", "v", "hot"])

    dealt = spread.select("key", "bi", "bj", "side", "fp").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "fp")
    return dealt.mapInArrow(run, "u long, v long, hot boolean")


def links(fps: DataFrame, radius: int = RADIUS, segments: int | None = None) -> DataFrame:
    """(u, v): edges between distinct fingerprints; two are connected by them if and only if a chain of pairs within
    `radius` bits connects them, and each edge is such a pair."""
    return _met(fps, radius, segments or max(2, -(-(radius + 1) // 2)), _edges_in).select("u", "v")  # balls of one bit at most


def shingle_sets(docs: DataFrame, *, text_col: str = "text", shingle: int = SHINGLE, size: int = SIMILAR_SHINGLE) -> DataFrame:
    """(fp, grams): a row's fingerprint, and the 32-bit hashes of the set of its `size`-word shingles, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh32_intdigest
        for b in batches:
            for i in range(0, b.num_rows, 256):
                fps, sets = [], []
                for t in b.column(0).slice(i, 256):
                    text = t.as_buffer().to_pybytes() if t.is_valid else b""
                    fps.append(fingerprint(text, shingle))
                    w = text.translate(C.LOWER_BYTES).split()
                    grams = np.zeros(0, np.uint32)
                    for at in range(0, max(1, len(w) - size + 1) if w else 0, PIECE):  # of a very long text a piece at a time
                        some = np.fromiter((digest(b" ".join(w[k : k + size])) for k in range(at, min(at + PIECE, max(1, len(w) - size + 1)))), np.uint32)
                        grams = np.union1d(grams, some)
                    sets.append(grams.view(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sets, pa.list_(pa.int32()))], ["fp", "grams"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "fp long, grams array<int>")


def similar_links(docs: DataFrame, prints: DataFrame, *, text_col: str, shingle: int, near: int, radius: int, segments: int, similarity: float, size: int) -> DataFrame:
    """Edges that connect fingerprints within `near` bits, and those within `radius` bits of which two texts' sets of `size`-word shingles have
    a Jaccard similarity of `similarity` and more. prints: (doc_id, fp, h), h a hash of the text.

    Pairs are checked one by one, but in hot groups and where a fingerprint has many texts: what such pairs connect is a bucket of texts
    with their shingles, of which all pairs are compared in blocks that give the edges of spanning forests. A pair within such a bucket is compared
    there and not once more by itself: else a hot group, which meets at many keys, would give its pairs by each key where they are few."""
    apart = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) > near
    texts = C.materialize(prints.groupBy("fp", "h").agg(F.min("doc_id").alias("doc_id")), "simhash-texts")
    crowded = texts.groupBy("fp").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MANY).select("fp")
    found = _met(prints.select("fp").distinct(), radius, segments, _candidates_in).groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("hot").alias("hot"))
    for end in ("u", "v"):
        found = found.join(crowded.select(F.col("fp").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    found = found.select("u", "v", (F.col("hot") | (apart & (F.coalesce("_u", F.lit(False)) | F.coalesce("_v", F.lit(False))))).alias("hot"))
    found = C.materialize(found, "simhash-candidates")
    joined = C.components(found.where("hot").select("u", "v"), "simhash-hot").select(F.col("node").alias("fp"), F.col("component").alias("key"))
    joined = C.materialize(joined, "simhash-hot-nodes")
    loose = found.where(~F.col("hot")).select("u", "v")
    for end in ("u", "v"):
        loose = loose.join(joined.select(F.col("fp").alias(end), F.col("key").alias(f"_{end}")), end, "left")
    loose = C.materialize(loose.where(~F.coalesce(F.col("_u") == F.col("_v"), F.lit(False))).select("u", "v"), "simhash-loose")
    single = loose.where(apart)

    checked = found.where(F.col("hot") | apart)
    ends = C.materialize(checked.select(F.col("u").alias("fp")).union(checked.select("v")).distinct(), "simhash-ends")
    named = texts.join(ends, "fp", "left_semi").select(F.col("doc_id").alias("_id"), "h")
    of = docs.join(named, docs["doc_id"].cast("long").eqNullSafe(named["_id"]) & (F.xxhash64(docs[text_col]) == named["h"]), "left_semi")
    sets = shingle_sets(of, text_col=text_col, shingle=shingle, size=size).join(ends, "fp", "left_semi").dropDuplicates(["fp", "grams"])
    sets = C.materialize(sets.withColumn("tag", F.xxhash64("fp", "grams")), "simhash-grams")

    j = single.join(sets.select(F.col("fp").alias("u"), F.col("grams").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("grams").alias("b")), "v")
    both = F.size(F.array_intersect("a", "b"))
    alike = j.where(both >= similarity * (F.size("a") + F.size("b") - both)).select("u", "v")

    bucket = C.materialize(sets.join(joined, "fp"), "simhash-hot")
    weight = F.greatest(F.count(F.lit(1)), F.ceil(F.sum(F.size("grams")) / GRAMS)).alias("_n")
    spread = C.spread_buckets(bucket, "key", "tag", CHUNK, bucket.groupBy("key").agg(weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in C.sorted_groups(batches, ["key", "bi", "bj"]):
            fp, side, bi, bj = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("fp", "side", "bi", "bj"))
            lists = pa.concat_arrays(t.column("grams").chunks)
            grams, n = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            for u, v in _similar_in(fp.view(np.uint64), side, bi != bj, at, grams, np.concatenate([[0], np.cumsum(n, dtype=np.int64)]), near, radius, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    dealt = spread.select("key", "bi", "bj", "side", "fp", "grams").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "fp")
    return loose.where(~apart).union(alike).union(dealt.mapInArrow(run, "u long, v long"))


def _rooted(prints: DataFrame, edges_of) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint. edges_of: the edges of a table (fp, low)."""
    fps = C.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-fps")
    comp = C.components(edges_of(fps), "simhash")
    rooted = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, segments: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row."""
    prints = C.materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "simhash")
    of = _rooted(prints, lambda fps: links(fps, radius, segments))
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, *, text_col: str = "text", shingle: int = SHINGLE, near: int = RADIUS, radius: int = SIMILAR_RADIUS, segments: int = SIMILAR_SEGMENTS, similarity: float = SIMILARITY, size: int = SIMILAR_SHINGLE) -> DataFrame:
    """`docs` with one row of each group: that of the smallest doc_id. Columns as they are. Groups are chains of texts whose fingerprints
    are within `near` bits, or within `radius` bits and found similar (see similar_links)."""
    prints = C.materialize(fingerprints(docs, text_col=text_col, shingle=shingle, hashed=True), "simhash")
    of = _rooted(prints, lambda fps: similar_links(docs, prints, text_col=text_col, shingle=shingle, near=near, radius=radius, segments=segments, similarity=similarity, size=size))
    counts = prints.agg(F.count(F.lit(1)).alias("n")).first()["n"], prints.select("doc_id").where("doc_id is not null").distinct().count()
    if counts[0] == counts[1]:
        out = prints.join(of, "fp").where("doc_id <> component_id").select(F.col("doc_id").alias("__lost"))
        return docs.join(out, docs["doc_id"] == out["__lost"], "left_anti")
    # ids that repeat or are null don't name a row: its fingerprint travels with it, and one row of each group stays
    taken = {c.lower() for c in docs.columns}
    own = {c: next(n for n in (f"{'_' * k}{c}" for k in range(1, len(taken) + 2)) if n.lower() not in taken) for c in ("fp", "root", "component_id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(b.schema.get_field_index(text_col))
            v = np.array([fingerprint(x.as_py().encode() if x.is_valid else b"", shingle) for x in t], np.uint64)
            yield b.append_column(own["fp"], pa.array(v.view(np.int64)))

    schema = T.StructType([*docs.schema.fields, T.StructField(own["fp"], T.LongType())])
    kept = docs.mapInArrow(run, schema).join(of.select(*[F.col(c).alias(n) for c, n in own.items()]), own["fp"])
    return kept.where(F.col("doc_id").eqNullSafe(F.col(own["component_id"]))).dropDuplicates([own["root"]]).select(docs.columns)


# ---------------------------------------------------------------- query


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return groups(C.table(spark, sf_dir, "documents"))
