"""Language-model scoring: an interpolated modified Kneser-Ney bigram model (operator 8).

Counting: each task counts its (word, next word) pairs as 63-bit hashes and packs them by the first word's shard, Spark deals
them by shard, and a shard's writer adds up equal pairs and keeps, as sorted arrays: the contexts with their totals and
their numbers of followers seen once, twice and more, and the pairs (context's number and the follower's leading bits) with
their counts (a byte each; greater ones apart, with their places). Followers of one context that share their leading bits stand
apart too, with whole hashes, so that each has its own count (a word never seen there is taken for a follower with a chance of
followers / 2^41). What each shard has seen of a follower goes on to a second shuffle, which gives each word its number of distinct
predecessors and its count. All arrays lie in the shared folder; a worker maps the files into memory (from a store that can't be
mapped a worker process copies a shard to an unlinked temporary file first) and searches sorted batches. Only sums of each shard come to the
driver.

    p(w|v) = (c(vw) - D(c(vw))) / c(v) + gamma(v) p(w),   p(w) = (n(w) - D'(n(w))) / sum n + gamma' / (V + 1)

with n(w) the number of distinct words before w, V the distinct tokens in training, and discounts D for 1, 2 and 3 or more from the
counts of counts (0.5, 1, 1.5 where these allow none). A word that training lacks gets the last term; after a word that was
no context p(w|v) = p(w). The probabilities of all V words and of the unknown add up to 1.

Defined results
  text null or empty            one token, the end
  no training document          N = V = 0, every probability and base probability is 1
  doc_id null                   counts as the text '' for the split
  very long texts               counted and scored in one slice of their own
  repeated rows                 each row is counted and scored
  empty table                   no rows
  more columns                  ignored
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

FOLDS = 10
#: Pairs that a task counts at once.
HELD = 1_500_000
#: Bits of a context's number within its shard, and what is left for the follower.
CONTEXT_BITS = 22
WORD_BITS = 63 - CONTEXT_BITS
START, END = np.int64(1), np.int64(2)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token before, token, index of each text's first) of a slice; every text ends with END and begins after START."""
    data = C.LOWER[data]
    s, e, first = C.words(data, offsets, C.NOT_SPACE)
    h = np.maximum((C.word_hashes(data, s, e) >> np.uint64(1)).astype(np.int64), 3)
    n = len(offsets) - 1
    at = first + np.arange(n + 1)
    w = np.empty(len(h) + n, np.int64)
    where = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(first))
    w[where] = h
    w[at[1:] - 1] = END
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[at[:-1]] = START
    return v, w, at


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (h >> 20) % shards


def _added(v: np.ndarray, w: np.ndarray, c: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs and their counts."""
    if c is None:
        order = np.lexsort((w, v))
        v, w = v[order], w[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(v))) if c is None else np.add.reduceat(c, at) if len(at) else c
    return v[at], w[at], n


# ---------------------------------------------------------------- files


def write_file(path: str, arrays: list[np.ndarray]) -> None:
    fs, p = pafs.FileSystem.from_uri(path)
    fs.create_dir(os.path.dirname(p), recursive=True)
    with fs.open_output_stream(p) as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())


_copies: dict[str, np.ndarray] = {}


def map_file(path: str) -> np.ndarray:
    fs, p = pafs.FileSystem.from_uri(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(p, np.uint8, "r") if os.path.getsize(p) else np.zeros(0, np.uint8)
    if path not in _copies:  # once for each worker process, which outlives its tasks; of one model at a time
        for other in [k for k in _copies if os.path.dirname(k) != os.path.dirname(path)]:
            del _copies[other]
        with tempfile.NamedTemporaryFile() as t, fs.open_input_stream(p) as f:
            while piece := f.read(8 << 20):
                t.write(piece)
            t.flush()
            _copies[path] = np.memmap(t.name, np.uint8, "r") if t.tell() else np.zeros(0, np.uint8)
    return _copies[path]


def _cut(data: np.ndarray, kinds: list[tuple[type, int]]) -> list[np.ndarray]:
    out, at = [], 0
    for kind, n in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(data[at : at + size].view(kind))
        at += size
    return out


# ---------------------------------------------------------------- counting
#
# Counts travel as packed arrays, one for each shard and chunk of a task, so that the JVM moves few rows.


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(blob: bytes, kinds: tuple[type, ...]) -> list[np.ndarray]:
    n = np.frombuffer(blob, np.int64, len(kinds))
    return _cut(np.frombuffer(blob, np.uint8, offset=8 * len(kinds)), list(zip(kinds, n.tolist(), strict=True)))


def _pack_pairs(v: np.ndarray, w: np.ndarray, c: np.ndarray) -> bytes:
    """Sorted pairs: each context once with its number of followers; counts in a byte, those of 255 and more apart."""
    at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    return _pack(v[at], np.diff(np.append(at, len(v))).astype(np.uint32), w, np.minimum(c, 255).astype(np.uint8), c[c >= 255].astype(np.int64))


def _unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v, runs, w, small, large = _unpack(blob, (np.int64, np.uint32, np.int64, np.uint8, np.int64))
    c = small.astype(np.int64)
    c[small == 255] = large
    return np.repeat(v, runs), w, c


def _count_pairs(docs: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            v, w, c = _added(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), None)
            held.clear()
            s = shard_of(v, shards)
            order = np.argsort(s, kind="stable")
            cut = np.searchsorted(s[order], np.arange(shards + 1))
            for k in range(shards):
                if cut[k + 1] > cut[k]:
                    at = order[cut[k] : cut[k + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack_pairs(v[at], w[at], c[at])], pa.binary())], ["shard", "blob"])

        for b in batches:
            for _, data, offsets in C.text_slices(b.column(0)):
                held.append(tokens(data, offsets)[:2])
                if sum(len(x) for x, _ in held) >= HELD:
                    yield from out()
        if held:
            yield from out()

    return docs.mapInArrow(run, "shard int, blob binary")


_ROW = "shard int, blob binary, path string, sizes array<long>"


def _row(shard: int, blob: bytes | None, path: str | None, sizes: list[int] | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), pa.array([blob], pa.binary()), pa.array([path], pa.string()), pa.array([sizes], pa.list_(pa.int64()))],
        ["shard", "blob", "path", "sizes"],
    )


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each shard, of batches sorted by shard."""
    number, held = None, []
    for b in batches:
        for i in range(b.num_rows):
            row = {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}
            if number is not None and row["shard"] != number:
                yield number, held
                held = []
            number = row["shard"]
            held.append(row)
    if held:
        yield number, held


def _write_pairs(pairs: DataFrame, folder: str, shards: int) -> DataFrame:
    """Write the shard files of contexts and pairs; gives each follower's part sums, and a row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _by_shard(batches):
            v, w, c = (np.concatenate(x) for x in zip(*(_unpack_pairs(r["blob"]) for r in rows), strict=True))
            rows.clear()
            order = np.lexsort((w, v))
            v, w, c = _added(v[order], w[order], c[order])
            new = np.concatenate([[True], v[1:] != v[:-1]])
            at = np.flatnonzero(new)
            if len(at) > 1 << CONTEXT_BITS:
                raise ValueError("too many contexts in a shard: raise spark.sql.shuffle.partitions")
            key = (np.cumsum(new) - 1) << WORD_BITS | (w >> (63 - WORD_BITS))
            sums = np.add.reduceat(c, at)
            seen = [np.add.reduceat(x, at, dtype=np.int64).astype(np.uint32) for x in (c == 1, c == 2, c > 2)]
            large = c[c >= 255]
            places = np.flatnonzero(c >= 255)
            # followers of one context that share their leading bits: their whole hashes, with their counts
            same = key[1:] == key[:-1]
            met = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
            path = f"{folder}/pairs-{number:05d}-{uuid.uuid4().hex}"
            write_file(path, [key, v[at], sums, large, places, key[met], w[met], c[met], *seen, np.minimum(c, 255).astype(np.uint8)])
            of = [int((c == k).sum()) for k in (1, 2, 3, 4)]
            yield _row(number, None, path, [number, len(at), len(key), len(large), *of, len(met)])
            del v, key
            s = shard_of(w, shards)
            order = np.lexsort((w, s))
            s, w, c = s[order], w[order], c[order]
            at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            n, c, w, s = np.diff(np.append(at, len(w))), np.add.reduceat(c, at), w[at], s[at]
            cut = np.searchsorted(s, np.arange(shards + 1))
            for k in range(shards):
                if cut[k + 1] > cut[k]:
                    i = slice(cut[k], cut[k + 1])
                    yield _row(k, _pack(w[i], n[i], c[i]), None, None)

    return pairs.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, _ROW)


def _write_words(parts: DataFrame, folder: str, shards: int) -> DataFrame:
    """Add up the followers' part sums and write the shard files of words; passes on the rows of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _by_shard(batches):
            for r in rows:
                if r["path"] is not None:
                    yield _row(number, None, r["path"], r["sizes"])
            blobs = [_unpack(r["blob"], (np.int64,) * 3) for r in rows if r["blob"] is not None]
            rows.clear()
            if not blobs:
                continue
            w, n, c = (np.concatenate(x) for x in zip(*blobs, strict=True))
            order = np.argsort(w, kind="stable")
            w, n, c = w[order], n[order], c[order]
            at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            w, n, c = w[at], np.add.reduceat(n, at), np.add.reduceat(c, at)
            path = f"{folder}/words-{number:05d}-{uuid.uuid4().hex}"
            write_file(path, [w, n, c])
            of = [int((n == k).sum()) for k in (1, 2, 3, 4)]
            yield _row(number, None, path, [number, len(w), int(n.sum()), int(c.sum()), *of, -1])

    return parts.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, _ROW)


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Of counts 0, 1, 2 and more, by the counts of counts."""
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        if all(0 < d[k] <= k for k in (1, 2, 3)):
            return d
    return [0.0, 0.5, 1.0, 1.5]


def train(docs: DataFrame, *, text_col: str = "text") -> dict:
    """Count `docs` and write the model; gives what `score` needs: file names, sums and discounts."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = C.new_path(spark, "lm")
    pairs = _count_pairs(docs.select(F.col(text_col).alias("text")), shards)
    files = _write_words(_write_pairs(pairs, folder, shards), folder, shards).select("path", "sizes").collect()  # two rows for each shard
    of_pairs = {r["sizes"][0]: (r["path"], r["sizes"]) for r in files if r["sizes"][-1] != -1}
    of_words = {r["sizes"][0]: (r["path"], r["sizes"]) for r in files if r["sizes"][-1] == -1}
    p, w = [x[1] for x in of_pairs.values()], [x[1] for x in of_words.values()]
    add = lambda rows, i: sum(r[i] for r in rows)
    cc = [add(w, i) for i in (4, 5, 6, 7)]
    d_word, total, v = _discounts(*cc), add(w, 2), add(w, 1)
    more = v - cc[0] - cc[1]
    return {
        "shards": shards, "pairs": of_pairs, "words": of_words, "N": add(w, 3), "V": v, "n": total,
        "d_pair": _discounts(*(add(p, i) for i in (4, 5, 6, 7))), "d_word": d_word,
        "g_word": (d_word[1] * cc[0] + d_word[2] * cc[1] + d_word[3] * more) / total if total else 1.0,
    }


# ---------------------------------------------------------------- scoring


class Reader:
    """The mapped files of a model."""

    def __init__(self, model: dict):
        self.m = model
        self.pairs = {s: _cut(map_file(path), [(np.int64, z[2]), (np.int64, z[1]), (np.int64, z[1]), *[(np.int64, z[3])] * 2, *[(np.int64, z[8])] * 3, *[(np.uint32, z[1])] * 3, (np.uint8, z[2])]) for s, (path, z) in model["pairs"].items()}
        self.words = {s: _cut(map_file(path), [(np.int64, z[1])] * 3) for s, (path, z) in model["words"].items()}

    def _dealt(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        s = shard_of(h, self.m["shards"])
        order = np.argsort(s, kind="stable")
        cut = np.searchsorted(s[order], np.arange(self.m["shards"] + 1))
        for k in range(self.m["shards"]):
            if cut[k + 1] > cut[k]:
                yield k, order[cut[k] : cut[k + 1]]

    def word(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n(w) and c(w) of sorted distinct words."""
        n, c = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        for s, k in self._dealt(w):
            if s not in self.words:
                continue
            ws, ns, cs = self.words[s]
            at = np.minimum(np.searchsorted(ws, w[k]), len(ws) - 1)
            ok = ws[at] == w[k]
            n[k[ok]], c[k[ok]] = ns[at[ok]], cs[at[ok]]
        return n, c

    def pair(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """c(vw), c(v) and gamma(v) c(v)."""
        c, total, gamma = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64), np.zeros(len(v))
        d = self.m["d_pair"]
        for s, k in self._dealt(v):
            if s not in self.pairs:
                continue
            key, ctx, sums, large, places, met, met_word, met_count, n1, n2, n3, small = self.pairs[s]
            at = np.minimum(np.searchsorted(ctx, v[k]), len(ctx) - 1)
            ok = ctx[at] == v[k]
            k, at = k[ok], at[ok]
            total[k] = sums[at]
            gamma[k] = d[1] * n1[at] + d[2] * n2[at] + d[3] * n3[at]
            want = (at.astype(np.int64) << WORD_BITS) | (w[k] >> (63 - WORD_BITS))
            order = np.argsort(want)
            want, k = want[order], k[order]
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            ok = key[at] == want
            got = small[at].astype(np.int64)
            if len(large):
                big = got == 255
                got[big] = large[np.minimum(np.searchsorted(places, at[big]), len(large) - 1)]
            c[k[ok]] = got[ok]
            if len(met):
                lo, hi = np.searchsorted(met, want), np.searchsorted(met, want, "right")
                for i in np.flatnonzero(hi > lo):
                    j = lo[i] + np.searchsorted(met_word[lo[i] : hi[i]], w[k[i]])
                    c[k[i]] = met_count[j] if j < hi[i] and met_word[j] == w[k[i]] else 0
        return c, total, gamma


def score_slice(reader: Reader, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of each text of a slice."""
    m = reader.m
    v, w, at = tokens(data, offsets)
    distinct, which = np.unique(w, return_inverse=True)
    n, c = (x[which] for x in reader.word(distinct))
    pair, total, gamma = reader.pair(v, w)
    d_pair, d_word = np.array(m["d_pair"]), np.array(m["d_word"])
    p = (n - d_word[np.minimum(n, 3)]) / max(m["n"], 1) + m["g_word"] / (m["V"] + 1)
    seen = total > 0
    p[seen] = (pair[seen] - d_pair[np.minimum(pair[seen], 3)]) / total[seen] + gamma[seen] / total[seen] * p[seen]
    base = np.log10((c + 0.1) / (m["N"] + 0.1 * (m["V"] + 1)))
    add = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  every text has its end
    return [np.diff(at), add((c > 0).astype(np.int64)), add(base), add(np.log10(p))]


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # names and sums of two files a shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for b in batches:
            for i, data, offsets in C.text_slices(b.column(1)):
                got = score_slice(reader, data, offsets)
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n), pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(np.full(n, shared.value["N"]), pa.int64()), pa.array(got[2]), pa.array(got[3])],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


# ---------------------------------------------------------------- query


def op8_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of those that aren't held out."""
    docs = C.table(spark, sf_dir, "documents")
    model = train(docs.where(C.crc_mod("doc_id", FOLDS) != 0))
    return score(docs, model).select("doc_id", (C.crc_mod("doc_id", FOLDS) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", (F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).alias("perplexity"))
