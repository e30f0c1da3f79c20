"""Embedding near-dedup by Euclidean p-stable hashing (operator 4).

Vectors are normalised; a table's hash is HASHES quantised random projections, floor((a.x + b) / WIDTH), and TABLES tables are kept.
Two vectors meet in a table with a probability that falls with their distance; those that meet are held against each other by their
cosine in double precision. Equal vectors of a label are one node with a weight. Only (key, node) goes through the
shuffle that finds buckets of two and more; vectors join those alone. A large bucket is cut into blocks
(common.spread_buckets). A pair counts in the first table where it meets, so that links can be added up without listing
pairs, and a block gives the edges of a spanning forest.

With HASHES, TABLES and WIDTH as set, a pair at the limit (cosine 0.93) is found with probability 0.97, one at 0.95 with 0.99, one at
0.99 with more than 0.9999.

Defined results
  embedding null, empty, zero or with null or non-finite components   links with nothing
  label null                     links with nothing
  different lengths              never linked
  vec_id null                    its row links as others; it is no component's smallest id unless all are null
  repeated rows                  each is a vector of its own
  empty table                    no rows
  more columns                   ignored
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

COSINE = 0.93
HASHES = 10
TABLES = 32
WIDTH = 1.5
SEED = 20240229
#: Vectors of a bucket that are compared in one piece.
CHUNK = 2048


def _projections(dim: int, hashes: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng([SEED, dim])
    return r.standard_normal((dim, hashes * tables)), r.random(hashes * tables) * WIDTH


def signatures(x: np.ndarray, hashes: int = HASHES, tables: int = TABLES) -> np.ndarray:
    """The key of each row of unit vectors in each table, as int64."""
    a, b = _projections(x.shape[1], hashes, tables)
    q = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(x), tables, hashes)
    h = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64), (len(x), tables)).copy()
    for k in range(hashes):
        h = C.mix64(h ^ C.mix64(q[:, :, k].astype(np.uint64) + np.uint64(k)))
    return h.view(np.int64)


def _unit(values: np.ndarray, dim: int) -> np.ndarray:
    x = values.reshape(-1, dim).astype(np.float64)
    # apart from each vector's size, so that very large or small components neither overflow nor vanish
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nodes(vectors: DataFrame, *, hashes: int = HASHES, tables: int = TABLES) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, node) of all vectors, node null where nothing can be linked, and the distinct vectors:
    (node, weight, low, embedding, grp, keys)."""
    ok = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("ok", F.coalesce(ok & fine, F.lit(False)))
    # -0.0 and 0.0 are one value; two 64-bit hashes of label and vector name an exact copy
    plain = F.transform("embedding", lambda v: v + F.lit(0.0))
    name = F.when(F.col("ok"), F.struct(F.xxhash64("label", plain).alias("a"), F.xxhash64(plain, F.lit(1), "label").alias("b")))
    rows = rows.withColumn("name", name)
    distinct = rows.where("ok").groupBy("name").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("low"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    distinct = distinct.select(F.col("name.a").alias("node"), "weight", "low", "embedding", F.xxhash64("label", F.size("embedding")).alias("grp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column(b.schema.get_field_index("embedding"))
            dims = np.diff(e.offsets.to_numpy())
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                keys = signatures(_unit(part.column(b.schema.get_field_index("embedding")).flatten().to_numpy(zero_copy_only=False), int(dim)), hashes, tables)
                grp = part.column(b.schema.get_field_index("grp")).to_numpy(zero_copy_only=False)
                keys = C.mix64(keys.view(np.uint64) ^ C.mix64(grp.view(np.uint64))[:, None]).view(np.int64)
                yield part.append_column("keys", pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * tables, pa.array(keys.ravel())))

    schema = "node long, weight long, low long, embedding array<double>, grp long, keys array<long>"
    every = C.materialize(distinct.mapInArrow(run, schema), "vectors")
    return rows.select("vec_id", F.col("name.a").alias("node")), every


def _compare(t: pa.Table, at: np.ndarray, tables: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(node, links to add) and edges (u, v) of whole groups sorted by bucket and block."""
    col = lambda c: t.column(c).combine_chunks()
    node, weight, table, side = (col(c).to_numpy(zero_copy_only=False) for c in ("node", "weight", "tbl", "side"))
    cross = col("bi").to_numpy(zero_copy_only=False) != col("bj").to_numpy(zero_copy_only=False)
    e = col("embedding")
    dims = np.diff(e.offsets.to_numpy())
    keys = col("keys").flatten().to_numpy(zero_copy_only=False).reshape(-1, tables)
    values, start = e.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dims)])
    n = np.diff(at)
    # pairs of small groups, by the distance of their places; groups have one dimension each
    small = n <= 32
    gid = np.repeat(np.arange(len(n)), n)
    for dim in np.unique(dims):
        i = np.flatnonzero(small[gid] & (dims == dim))
        if not len(i):
            continue
        x = _unit(values[(start[i][:, None] + np.arange(dim)).ravel()], int(dim))
        for d in range(1, 32):
            if d >= len(i):
                break
            k = np.flatnonzero(gid[i[d:]] == gid[i[:-d]])
            if not len(k):
                break
            a, b = i[k], i[k + d]
            ok = (~cross[a] | (side[a] != side[b])) & (np.einsum("ij,ij->i", x[k], x[k + d]) >= cosine)
            a, b = a[ok], b[ok]
            ok = ~((keys[a] == keys[b]) & (np.arange(tables) < table[a][:, None])).any(axis=1)
            a, b = a[ok], b[ok]
            yield np.concatenate([node[a], node[b]]), np.concatenate([weight[b], weight[a]]), node[a], node[b]
    for g in np.flatnonzero(~small):
        i = np.arange(at[g], at[g + 1])
        dim = int(dims[i[0]])
        x = _unit(values[start[i[0]] : start[i[-1] + 1]], dim)
        adj = (x @ x.T) >= cosine
        np.fill_diagonal(adj, False)
        if cross[i[0]]:
            adj &= side[i][:, None] != side[i][None, :]
        elif not adj.any():
            continue
        for s in range(int(table[i[0]])):
            adj &= keys[i, s][:, None] != keys[i, s][None, :]
        links = adj @ weight[i].astype(np.float64)
        u, v = C.spanning_forest(adj)
        yield node[i], links.astype(np.int64), node[i][u], node[i][v]


def links(every: DataFrame, *, cosine: float = COSINE, tables: int = TABLES) -> DataFrame:
    """Rows (node, n, u, v): links to add to a node, or an edge of two linked nodes."""
    slim = every.select("node", F.posexplode("keys").alias("tbl", "key"))
    sizes = slim.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    spread = C.spread_buckets(slim.hint("merge"), "key", "node", CHUNK, sizes)
    full = spread.join(every.select("node", "weight", "embedding", "keys"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in C.sorted_groups(batches, ["key", "bi", "bj"]):
            nodes_, adds, us, vs = [], [], [], []
            for node, add, u, v in _compare(t, at, tables, cosine):
                keep = add > 0
                nodes_.append(node[keep])
                adds.append(add[keep])
                us.append(u)
                vs.append(v)
            if not nodes_:
                continue
            node, add, u, v = (np.concatenate(x) for x in (nodes_, adds, us, vs))
            who, which = np.unique(node, return_inverse=True)
            total = np.bincount(which, add, len(who)).astype(np.int64) if len(who) else add
            for a, b, c, d in ((who, total, None, None), (None, None, u, v)):
                m = len(a if a is not None else c)
                if m:
                    yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) if z is not None else pa.nulls(m, pa.int64()) for z in (a, b, c, d)], ["node", "n", "u", "v"])

    dealt = full.select("key", "bi", "bj", "side", "tbl", "node", "weight", "embedding", "keys").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return dealt.mapInArrow(run, "node long, n long, u long, v long")


def groups(vectors: DataFrame, *, cosine: float = COSINE, hashes: int = HASHES, tables: int = TABLES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    rows, every = nodes(vectors, hashes=hashes, tables=tables)
    rows = C.materialize(rows, "vector-rows")
    found = C.materialize(links(every, cosine=cosine, tables=tables), "vector-links")
    comp = C.components(found.where("u is not null").select("u", "v"), "vectors")
    n = found.where("node is not null").groupBy("node").agg(F.sum("n").alias("n"))
    per = every.select("node", "weight", "low").join(n, "node", "left").join(comp, "node", "left")
    per = per.select("node", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"), "low")
    low = per.groupBy("root").agg(F.min("low").alias("component_id"))
    per = per.join(low, "root").select("node", "n_links", "component_id")
    linked = rows.where("node is not null").join(per, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


# ---------------------------------------------------------------- query


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings."""
    return groups(C.table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {COSINE}),
r AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = c.u LEFT JOIN n ON vec_id = n.u
"""
