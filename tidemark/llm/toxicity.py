"""Toxicity: a factorization machine over hashed terms (operator 11).

The terms of a text are its words of letters (A-Z lower-cased) and the first 4, 5 and 6 bytes of longer words, each named by a hash of
62 bits, so that even a text of many thousand terms doesn't meet another term's name. A text is the set of its terms.

    logit = w0 + sum_i w_i + sum_{i<j} <v_i, v_j>        over the terms i, j of the text

The pairs are summed in linear time, 0.5 * sum_f ((sum_i v_if)^2 - sum_i v_if^2). The machine is learnt on the driver by AdaGrad from at most
SAMPLE labelled rows (chosen by a hash of the id; a documented bound) and the at most TERMS terms that tell the labels apart best there
(chi-square over the sample's texts, counted in Spark). Of the sample only lists of chosen terms reach the driver, never texts.

Defined results
  text null or empty              no terms; the score is that of w0, the logistic of the intercept
  repeated or null doc_id         every row is scored; a null id counts as the text '' for the split and has no label
  a label that repeats            the smallest counts; null labels don't
  no labels, or of one kind       the score is the smoothed share of label 1 (0.5 without labels)
  ties                            terms of equal chi-square by their hash, rows of equal hash by id and terms: reruns agree
  very long texts                 whole, each a slice of its own
  empty documents                 no rows
  more columns                    ignored
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

#: Labelled rows that the machine is learnt from, at most.
SAMPLE = 20_000
#: Terms that it knows, at most; each in at least LEAST rows of the sample, with a chi-square of at least CHI (one chance in a hundred).
TERMS = 4096
LEAST = 3
CHI = 6.63
FACTORS = 8
EPOCHS = 12
BATCH = 256
RATE = 0.1
DECAY = 1e-5
FOLDS = 4
HELD_OUT = 2
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)

_B = np.arange(256)
#: Bytes of words of letters, after lower-casing.
LETTERS = ((_B >= 97) & (_B <= 122)) | (_B >= 128)


def terms_of(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of the distinct terms of each text of a slice, by text and term. known: only these sorted terms, as their places."""
    data = C.LOWER[data]
    s, e, first = C.words(data, offsets, LETTERS)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    docs, found = [], []
    for kind, k in enumerate((0, *PREFIXES)):
        longer = slice(None) if k == 0 else np.flatnonzero(e - s > k)
        starts = s[longer]
        h = C.word_hashes(data, starts, e[longer] if k == 0 else starts + k)
        h = (C.mix64(h + np.uint64(kind)) >> np.uint64(2)).astype(np.int64)
        d = doc[longer]
        if known is not None:
            at = np.minimum(np.searchsorted(known, h), len(known) - 1) if len(known) else np.zeros(len(h), np.int64)
            hit = known[at] == h if len(known) else np.zeros(len(h), bool)
            d, h = d[hit], at[hit]
        docs.append(d)
        found.append(h)
    d, h = np.concatenate(docs), np.concatenate(found)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[new], h[new]


# ---------------------------------------------------------------- the machine


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the rows of values between the offsets, which leave none out; each sum by its own rows alone."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]))
    some = offsets[1:] > offsets[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, offsets[:-1][some], axis=0)
    return out


@dataclass
class Machine:
    terms: np.ndarray  # sorted hashes
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, idx: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """idx: places of the terms of all texts, one text after the other; offsets: where each text's begin, and the end."""
        v = self.v[idx]
        s = _sums(v, offsets)
        return self.w0 + _sums(self.w[idx], offsets) + 0.5 * (s**2 - _sums(v**2, offsets)).sum(1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of the texts of a slice."""
        d, idx = terms_of(data, offsets, self.terms)
        at = np.searchsorted(d, np.arange(len(offsets)))
        return 1 / (1 + np.exp(-np.clip(self.logits(idx, at), -30, 30)))


def fit(terms: np.ndarray, rows: list[np.ndarray], y: np.ndarray, *, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 11) -> Machine:
    """Learn from the terms' places of each row and labels 0 or 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    rng = np.random.default_rng(seed)
    m = Machine(terms, math.log(share / (1 - share)), np.zeros(len(terms)), np.zeros((len(terms), factors)))
    if not len(y) or y.min() == y.max() or not len(terms):
        return m
    m.v = rng.normal(0, 0.01, (len(terms), factors))
    g0, gw, gv = 1e-8, np.full(len(terms), 1e-8), np.full((len(terms), factors), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            part = order[i : i + BATCH]
            n = np.array([len(rows[k]) for k in part])
            idx, at = np.concatenate([rows[k] for k in part]), np.concatenate([[0], np.cumsum(n)])
            off = 1 / (1 + np.exp(-np.clip(m.logits(idx, at), -30, 30))) - y[part]
            v, each = m.v[idx], np.repeat(off, n)
            step_v = each[:, None] * (np.repeat(_sums(v, at), n, axis=0) - v)
            d0 = off.mean()
            dw = np.bincount(idx, each, len(terms)) / len(part) + DECAY * m.w
            dv = np.column_stack([np.bincount(idx, step_v[:, f], len(terms)) for f in range(factors)]) / len(part) + DECAY * m.v
            g0, gw, gv = g0 + d0**2, gw + dw**2, gv + dv**2
            m.w0 -= RATE * d0 / math.sqrt(g0)
            m.w -= RATE * dw / np.sqrt(gw)
            m.v -= RATE / 2 * dv / np.sqrt(gv)
    return m


# ---------------------------------------------------------------- in Spark


def _chosen_terms(some: DataFrame, terms: int) -> np.ndarray:
    """The terms that tell the labels of `some` (y, text) apart best, sorted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, data, offsets in C.text_slices(b.column(1)):
                d, h = terms_of(data, offsets)
                of, place = np.unique(h, return_inverse=True)
                n, k = np.bincount(place, minlength=len(of)), np.bincount(place, y[i + d], len(of))
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(n), pa.array(k.astype(np.int64))], ["term", "n", "k"])

    counts = some.groupBy().agg(F.count(F.lit(1)), F.sum("y")).first()
    rows, ones = counts[0], counts[1] or 0
    if ones in (0, rows):
        return np.zeros(0, np.int64)
    seen = some.select("y", "text").mapInArrow(run, "term long, n long, k long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    chi = (k * rows - n * ones) ** 2 * rows / (n * (rows - n) * ones * (rows - ones))
    best = seen.where((n >= LEAST) & (n < rows)).withColumn("chi", chi).where(F.col("chi") >= CHI).orderBy(F.desc("chi"), "term").limit(terms)
    return np.sort(best.select("term").toArrow().column("term").to_numpy().astype(np.int64))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, sample: int = SAMPLE, terms: int = TERMS) -> Machine:
    """Learn from the labelled rows whose crc32(doc_id) modulo `folds` isn't `held_out`, at most `sample` of them by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(label).cast("int").alias("y"))
    known = known.where(C.crc_mod("_id", folds) != held_out)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    order = [F.xxhash64("_id"), "_id"]
    chosen = C.materialize(known.join(texts.select("_id"), "_id", "left_semi").orderBy(*order).limit(sample), "toxicity-sample")
    some = C.materialize(texts.join(F.broadcast(chosen), "_id"), "toxicity-texts")  # at most `sample` ids
    best = _chosen_terms(some, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data, offsets in C.text_slices(b.column(2)):
                d, idx = terms_of(data, offsets, best)
                lists = pa.ListArray.from_arrays(np.searchsorted(d, np.arange(len(offsets))).astype(np.int32), pa.array(idx.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(offsets) - 1), b.column(1).slice(i, len(offsets) - 1), lists], ["_id", "y", "terms"])

    rows = some.select("_id", "y", "text").mapInArrow(run, "_id long, y int, terms array<int>").orderBy(*order, "terms").limit(sample).select("y", "terms").toArrow()
    C.drop_materialized(chosen, some)
    lists = rows.column("terms").combine_chunks()
    flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return fit(best, [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], rows.column("y").to_numpy().astype(float))


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, folds: int = FOLDS, held_out: int = HELD_OUT, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, scored where it is read."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds=folds, held_out=held_out, sample=sample))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data, offsets in C.text_slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(offsets) - 1), pa.array(shared.value.score(data, offsets))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (C.crc_mod("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


# ---------------------------------------------------------------- query


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return score(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
