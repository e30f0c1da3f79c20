"""What several operators of this subpackage share: the shared working folder, byte-level
tokenising with numpy, blocked comparison of buckets and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document is worked on in slices of about so many bytes of text.
SLICE_BYTES = 2 << 20
#: A side of at most so many rows of a few numbers may be broadcast.
BROADCAST_ROWS = 20_000

_own_dir: dict[str, str] = {}


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a temporary folder of this process is used on a
    single machine; on a cluster that would be seen by the driver alone, so that it raises."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own_dir[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: cuts lineage and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.tidemark_path = path
    return out


def drop_materialized(*frames: DataFrame) -> None:
    """Delete what `materialize` has written for intermediate frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "tidemark_path", None)
        if path:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n).cast("int")


# ---------------------------------------------------------------- tokenising

_ALL = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, every other byte as it is.
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
LOWER_BYTES = LOWER.tobytes()
#: Bytes of words between white space: all but 0x20 and 0x09-0x0D.
NOT_SPACE = ~((_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13)))
#: Bytes of words of letters and digits: 0-9, a-z (after lower-casing) and all from 0x80.
ALNUM = ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 128)

_TRUE = _ALL == 1

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power_table(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES // 2), _P if kind == "p" else _P_INV, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * SLICE_BYTES:  # a table for a giant text isn't kept
            _powers[kind] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about SLICE_BYTES; nulls are empty texts."""
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "left"))
        j = min(max(j, i + 1), len(column))
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more at the end)."""
    m = is_word[data]
    s, e = m.copy(), m.copy()
    s[1:] &= ~m[:-1]
    e[:-1] &= ~m[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    s[first] = m[first]
    e[last] = m[last]
    starts = np.flatnonzero(s)
    return starts, np.flatnonzero(e) + 1, np.searchsorted(starts, offsets)


def word_array(data: np.ndarray, offsets: np.ndarray, m: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words themselves as binaries, and for each text the index of its first word (one more at the end). m: which bytes belong to words."""
    starts, ends, first = words(m.view(np.uint8), offsets, _TRUE)
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    kind, width = (pa.binary(), np.int32) if at[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(at.astype(width)), pa.py_buffer(data[m])]), first


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes by prefix sums, then mixed with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table("p", len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power_table("inv", len(data))[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))


# ---------------------------------------------------------------- buckets


def spread_buckets(members: DataFrame, key: str, spread_by: str, chunk: int, sizes: DataFrame) -> DataFrame:
    """Prepare the members of buckets for comparison of all pairs within each bucket.

    sizes: (key, _n) of the buckets that count; others go. Adds bi, bj and side. A bucket of up to `chunk` members stays whole
    (bi = bj = side = 0); a larger one is cut into c chunks by a hash of `spread_by`, and each pair of chunks
    becomes a block (bi <= bj) of its own, so that no task gets a whole hot bucket. side is 0 in chunk bi, 1 in bj.

    Members that are many rows for each stored one (a row a key) must come with hint("merge"): Spark's estimate knows nothing of them, takes
    them for small and broadcasts them. Others come without, so that a hot bucket's members stay where they are while `sizes` is small."""
    c = F.ceil(F.col("_n") / chunk).cast("int")
    mine = F.when(F.col("_c") > 1, F.pmod(F.xxhash64(F.col(spread_by)), F.col("_c")).cast("int")).otherwise(0)
    return (
        members.join(sizes.select(key, c.alias("_c")), key)
        .withColumn("_mine", mine)
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
        .withColumn("bi", F.least("_mine", "_k"))
        .withColumn("bj", F.greatest("_mine", "_k"))
        .withColumn("side", F.when(F.col("_mine") == F.col("bi"), 0).otherwise(1))
        .drop("_mine", "_k", "_c")
    )


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of batches sorted by `keys`: tables of whole groups and the offsets of the groups in them."""
    held: pa.Table | None = None

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).combine_chunks().to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        at = starts(held)
        if len(at) > 1:
            cut = int(at[-1])
            yield held.slice(0, cut).combine_chunks(), at
            held = held.slice(cut).combine_chunks()
    if held is not None:
        yield held, np.append(starts(held), held.num_rows)


def spanning_forest(adj: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric boolean matrix, found breadth first."""
    free = np.ones(len(adj), bool)
    a, b = [], []
    for root in range(len(adj)):
        if not free[root]:
            continue
        free[root] = False
        frontier = [root]
        while frontier:
            after: list[int] = []
            for f in frontier:
                to = np.flatnonzero(adj[f] & free)
                if len(to):
                    free[to] = False
                    a.append(np.full(len(to), f))
                    b.append(to)
                    after.extend(to.tolist())
            frontier = after
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of `edges` (u, v: long): (node, component) for every node with an edge, component
    being the smallest node. Alternates large-star and small-star steps until nothing changes; each step is
    aggregations and equi-joins (which AQE may split), its result is a table in the shared folder, and only
    counts come to the driver."""
    u, v = F.col("u"), F.col("v")
    e = materialize(edges.where("u <> v").select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), name)
    seal = None
    while True:
        both = e.union(e.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").where("v <> m").select(v.alias("u"), F.col("m").alias("v"))
        after = materialize(low.select("u", F.col("m").alias("v")).union(rest).distinct(), name)
        drop_materialized(e)
        e = after
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seal:
            break
        seal = now
    roots = e.select(v.alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(u.alias("node"), v.alias("component")).union(roots)
