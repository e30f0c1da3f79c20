"""Quality classifier: a generalised additive model with pairwise interactions (operator 10).

Every text becomes a row of FEATURES, counted over its whole bytes with numpy. The model is learnt on the driver from at most
SAMPLE labelled rows (chosen by a hash of the id; a documented bound) by cyclic boosting: round after round each feature gets a
tree of up to four leaves fitted to what is left to explain, and the tree is added to the feature's lookup table over its bins.
Then the pairs of features that explain most of the rest get tables over both their bins in the same way. A score is the
logistic of a sum of looked-up numbers. Only the feature rows of the sample reach the driver, never texts. Every text is turned into
features once, where it is scored; those of the sample once more, to learn from.

Defined results
  text null or empty              all features 0, scored like any other
  repeated or null doc_id         every row is scored; a null id counts as the text '' for the split and has no label
  a label that repeats            the smallest counts; null labels don't
  no labels, or of one kind       the score is the smoothed share of label 1 (0.5 without labels)
  very long texts                 counted whole, each a slice of its own
  empty documents                 no rows
  more columns                    ignored by `score`, kept by `keep_good`
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Labelled rows that the model is learnt from, at most.
SAMPLE = 20_000
BINS = 64
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 6
PAIR_BINS = 16
RATE = 0.15
THRESHOLD = 0.3

FEATURES = ("log_words", "word_bytes", "upper", "symbols", "exclaims", "bars", "digits", "other_marks", "triples", "same_as_before", "distinct_words", "distinct_threes", "line_bytes", "distinct_lines")

_B = np.arange(256)
_UPPER = (_B >= 65) & (_B <= 90)
_DIGIT = (_B >= 48) & (_B <= 57)
_SYMBOL = np.isin(_B, list(b"#$%&*@^~=<>{}[]\\"))
_OTHER = np.isin(_B, list(b".,;:?-'\"()/"))
_NEWLINE = _B == 10


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of h for each doc."""
    if not len(h):
        return np.zeros(n)
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return np.bincount(d[new], minlength=n)


def features_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a slice."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    safe = np.maximum(size, 1)
    per = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets])
    s, e, first = C.words(data, offsets, C.NOT_SPACE)
    words = np.diff(first)
    w_safe = np.maximum(words, 1)
    doc = np.repeat(np.arange(n), words)
    h = C.word_hashes(data, s, e)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    threes = C.mix64(h[:-2] ^ C.mix64(h[1:-1] ^ C.mix64(h[2:]))) if len(h) > 2 else h[:0]
    in_one = doc[: len(threes)] == doc[2:] if len(h) > 2 else np.zeros(0, bool)
    n_threes = np.maximum(words - 2, 0)
    triple = np.zeros(len(data), bool)
    if len(data) > 2:
        triple[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & C.NOT_SPACE[data[2:]]
    ls, le, l_first = C.words(data, offsets, ~_NEWLINE)
    lines = np.diff(l_first)
    l_doc = np.repeat(np.arange(n), lines)
    return np.column_stack(
        [
            np.log1p(words),
            np.bincount(doc, weights=e - s, minlength=n) / w_safe,
            per(_UPPER) / safe,
            per(_SYMBOL) / safe,
            per(_B == 33) / safe,
            per(_B == 124) / safe,
            per(_DIGIT) / safe,
            per(_OTHER) / safe,
            np.diff(np.concatenate([[0], np.cumsum(triple)])[offsets]) / safe,
            np.bincount(doc, weights=same, minlength=n) / w_safe,
            np.where(words > 0, _distinct(doc, h, n) / w_safe, 0),
            np.where(n_threes > 0, _distinct(doc[: len(threes)][in_one], threes[in_one], n) / np.maximum(n_threes, 1), 0),
            np.log1p(size / np.maximum(lines, 1)),
            np.where(lines > 0, _distinct(l_doc, C.word_hashes(data, ls, le), n) / np.maximum(lines, 1), 0),
        ]
    )


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)])

    def logits(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.intercept)
        for i, t in enumerate(self.tables):
            out += t[b[:, i]]
        for i, j, t in self.pairs:
            out += t[_coarse(b[:, i]), _coarse(b[:, j])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.bins(x)), -30, 30)))


def _coarse(b: np.ndarray) -> np.ndarray:
    return b * PAIR_BINS // BINS


def _cut(g: np.ndarray, h: np.ndarray, lam: float = 1.0, least: float = 2.0) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins with gradients g and weights h; place 0: none."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + lam) + gr**2 / (hr + lam), 0) - g.sum() ** 2 / (h.sum() + lam)
    if not len(gain) or gain.max() <= 1e-9:
        return 0.0, 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, lam: float = 1.0) -> np.ndarray:
    """A tree of depth two over ordered bins, as its value in each bin."""
    ends = [0, len(g)]
    _, k = _cut(g, h)
    if k:
        ends = sorted({0, len(g), k, *(c for c in (_cut(g[:k], h[:k])[1], k + _cut(g[k:], h[k:])[1]) if 0 < c < len(g))})
    out = np.zeros(len(g))
    for a, b in zip(ends, ends[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + lam)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, lam: float = 1.0) -> tuple[float, np.ndarray]:
    """A cut along one axis, then a cut of each half along the other: gain, and the value in each cell."""
    best, out = 0.0, np.zeros_like(g)
    base = g.sum() ** 2 / (h.sum() + lam)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        _, k = _cut(a.sum(1), b.sum(1))
        k = k or len(a) // 2
        value, gain = np.zeros_like(a), -base
        for part in (slice(0, k), slice(k, None)):
            _, c = _cut(a[part].sum(0), b[part].sum(0))
            for half in ((slice(0, c), slice(c, None)) if c else (slice(0, None),)):
                x, y = a[part, half].sum(), b[part, half].sum()
                value[part, half] = x / (y + lam)
                gain += x**2 / (y + lam)
        if gain > best:
            best, out = gain, value.T if flip else value
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learn the tables from rows of features and labels 0 or 1."""
    n, k = x.shape if len(x) else (0, len(FEATURES))
    share = (y.sum() + 1) / (n + 2)
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for i in range(k)]
    m = Model(edges, math.log(share / (1 - share)), [np.zeros(BINS) for _ in range(k)], [])
    if n == 0 or y.min() == y.max():
        return m
    b = m.bins(x)
    f = np.full(n, m.intercept)

    def rest() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for i in range(k):
            g, h = rest()
            t = RATE * _tree(np.bincount(b[:, i], g, BINS), np.bincount(b[:, i], h, BINS))
            m.tables[i] += t
            f += t[b[:, i]]
    g, h = rest()
    c = _coarse(b)
    grid = lambda i, j, v: np.bincount(c[:, i] * PAIR_BINS + c[:, j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    gains = sorted(((_tree2(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(k) for j in range(i)), reverse=True)
    m.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in m.pairs:
            g, h = rest()
            t = RATE * _tree2(grid(i, j, g), grid(i, j, h))[1]
            table += t
            f += t[c[:, i], c[:, j]]
    return m


# ---------------------------------------------------------------- in Spark


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f: array<double>) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data, offsets in C.text_slices(b.column(1)):
                x = features_of(data, offsets)
                f = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(x)), f], ["doc_id", "f"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, f array<double>")


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 5, sample: int = SAMPLE) -> Model:
    """Learn from the labelled rows whose crc32(doc_id) isn't divisible by `folds`, at most `sample` of them by a hash of the id. Ids are
    chosen first, so that only the texts of the chosen rows are looked at."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(label).alias("y"))
    known = known.where(C.crc_mod("_id", folds) != 0)
    ids = docs.select(F.col("doc_id").cast("long").alias("_id"))
    order = [F.xxhash64("_id"), "_id"]
    chosen = known.join(ids, "_id", "left_semi").orderBy(*order).limit(sample)  # at most `sample` rows of two numbers
    chosen = C.materialize(chosen, "quality-sample")
    some = docs.withColumn("_id", F.col("doc_id").cast("long")).join(F.broadcast(chosen.select("_id")), "_id", "left_semi").select(F.col("_id").alias("doc_id"), "text")
    feats = features(some).withColumnRenamed("doc_id", "_id").join(F.broadcast(chosen), "_id")
    rows = feats.orderBy(*order, "f").limit(sample).select("f", "y").toArrow()
    x = np.array(rows.column("f").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, np.array(rows.column("y").to_pylist(), float))


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, scored where it is read."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds=folds, sample=sample))  # tables of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data, offsets in C.text_slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(offsets) - 1), pa.array(shared.value.score(features_of(data, offsets)))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (C.crc_mod("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """`docs` without the rows scored below the threshold; columns as they are. Rows are scored and filtered where they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds=folds, sample=sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index("text"))
            parts = [shared.value.score(features_of(data, offsets)) for _, data, offsets in C.text_slices(column)]
            yield b.filter(pa.array(np.concatenate(parts) >= threshold)) if parts else b

    return docs.mapInArrow(run, docs.schema)


# ---------------------------------------------------------------- query


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return score(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
