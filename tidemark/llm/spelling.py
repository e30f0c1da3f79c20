"""Spelling variant grouping by full neighbourhoods (operator 13).

Every word emits all its distinct neighbours, the words one deletion, replacement or insertion away over the alphabet that the vocabulary
shows (at most 90 letters), and a hash join of these with the vocabulary gives the near words: what meets is near, no distance is looked at.
A word of nine letters has some thousand neighbours, nearly all of them no words, so that neighbours are first numbered only, by a rolling hash that
a change of one letter updates (numpy, for all words of a length at once), and looked up in a bit table of the vocabulary; those that it
can't rule out are written out and joined by their letters. The table takes BITS bits a word and at most MOST_BITS (64 MB): beyond 16 million words
it rules out less and less, the join then tells as before.

A neighbour is emitted once: of a run of equal letters the first is deleted, a letter is replaced by others only and inserted only where the letter before
is another.

Defined results
  text null or empty            no words
  doc_id null                   counts as the text '' for the changed letters
  repeated rows                 each row is counted
  ties                          of near words of equal n the smallest in code-point order
  very long texts               whole, each a slice of its own; very long words too, their neighbours come in pieces
  empty table, or no near words no rows; form null, root the word itself
  more columns                  ignored
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

LEAST_LETTERS = 7
LEAST_TIMES = 2
RATIO = 10
#: One run in so many has a letter taken out.
CHANGED = 31
BITS = 32
MOST_BITS = 1 << 29
PROBES = 4
#: Words whose neighbours one task finds, about.
WORDS = 25_000
#: Neighbours that are numbered at once.
PIECE = 1 << 18

_B = np.arange(256)
_ASCII = (_B >= 97) & (_B <= 122)
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


# ---------------------------------------------------------------- counting


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes of lower-cased texts belong to letters a-z or U+00C0 to U+00FF (0xC3 and the byte after it)."""
    two = data == 0xC3
    m = _ASCII[data] | two
    m[1:] |= two[:-1]
    return m


def word_counts(docs: DataFrame, *, letters: int = LEAST_LETTERS, changed: int = CHANGED) -> DataFrame:
    """(word, n): the words of at least `letters` letters, after a letter is taken out of the runs that their hash tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, data, offsets in C.text_slices(b.column(1)):
                low = C.LOWER[data]
                runs, first = C.word_array(low, offsets, _letters(low))
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                coded = runs.dictionary_encode()
                if not len(coded):
                    continue
                words = coded.dictionary.cast(pa.string())
                size = pc.utf8_length(words).to_numpy()
                at = coded.indices.to_numpy()
                long = size[at] >= letters
                pair, times = np.unique(doc[long] * len(words) + at[long], return_counts=True)
                before = [zlib.crc32(f"{x}:".encode()) for x in ids[i : i + len(offsets) - 1]]
                raw = coded.dictionary.to_pylist()
                d, w = np.divmod(pair, len(words))
                h = np.fromiter((zlib.crc32(raw[x], before[k]) for k, x in zip(d.tolist(), w.tolist(), strict=True)), np.int64, len(pair))
                hit = h % changed == 0
                n = np.bincount(w[~hit], times[~hit], len(words)).astype(np.int64)
                cut: Counter = Counter()
                for x, k, c in zip(w[hit].tolist(), h[hit].tolist(), times[hit].tolist(), strict=True):
                    s = raw[x].decode()
                    if len(s) > letters:
                        k %= len(s)
                        cut[s[:k] + s[k + 1 :]] += c
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(some)), pa.array(n[some])], ["word", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(list(cut), pa.string()), pa.array(list(cut.values()), pa.int64())], ["word", "n"])

    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- neighbours


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of words of U+0000 to U+00FF, and where each word's begin."""
    raw = words.cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]]
    two = data == 0xC3
    out = data + np.concatenate([[0], two[:-1] * 0x40]).astype(np.uint8)
    return out[~two], (at - at[0]) - np.concatenate([[0], np.cumsum(two)])[at - at[0]]


def _strings(rows: np.ndarray) -> pa.Array:
    """Rows of code points of U+0000 to U+00FF as strings."""
    flat = rows.ravel()
    two = flat >= 0x80
    place = np.arange(len(flat)) + np.cumsum(two)
    data = np.empty(len(flat) + int(two.sum()), np.uint8)
    data[place] = np.where(two, flat - 0x40, flat)
    data[place[two] - 1] = 0xC3
    ends = np.concatenate([[0], place[rows.shape[1] - 1 :: rows.shape[1]] + 1])
    return pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _P, _U)
    p[:1] = 1
    return np.multiply.accumulate(p)


def _mixed(h: np.ndarray, length: int) -> np.ndarray:
    """What the bit table is asked with: the rolling hash and the length."""
    h = (h ^ (h >> _U(29)) ^ _U(length)) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _bits(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The place of a probe among `bits` (a power of two, at most 2^32): the probes take different parts of the hash and of its mix."""
    if probe:
        h = C.mix64(h + _U(probe))
    return h & _U(bits - 1)


class Table:
    """A bit table of the vocabulary: `has` is true for every word's hash, and for few others."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, len(words) * 64

    def has(self, h: np.ndarray) -> np.ndarray:
        """Places in h that may be words."""
        octets = self.words.view(np.uint8)
        found = np.arange(len(h))
        for probe in range(PROBES):
            at = _bits(h[found], probe, self.bits)
            found = found[(octets[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1]
        return found


def _of_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows of code points) of the words of each length."""
    codes, at = _codes(words)
    size = np.diff(at)
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        yield rows, codes[at[rows][:, None] + np.arange(length)]


def hashes(words: pa.Array) -> np.ndarray:
    """What the bit table is asked with, for each word."""
    out = np.zeros(len(words), _U)
    for rows, x in _of_length(words):
        out[rows] = _mixed((x.astype(_U) * _powers(x.shape[1])).sum(1, dtype=_U), x.shape[1])
    return out


def neighbours(words: pa.Array, alphabet: np.ndarray, table: Table | None = None) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(places of words, neighbours): every deletion, replacement and insertion once; table: only those that may be in it."""
    letters = alphabet.astype(_U)
    for places, x in _of_length(words):
        length = x.shape[1]
        step = max(1, PIECE // (len(letters) * (length + 1)))
        power = _powers(length + 1)
        for a in range(0, len(x), step):
            part = x[a : a + step]
            c = part.astype(_U)
            upto = np.zeros((len(part), length + 1), _U)
            np.cumsum(c * power[:length], axis=1, out=upto[:, 1:])
            total = upto[:, -1:]
            width = max(1, PIECE // (len(part) * len(letters)))
            before = np.concatenate([np.zeros((len(part), 1), np.uint8), part], axis=1)
            for i in range(0, length + 1, width):
                for kind in ("delete", "replace", "insert"):
                    j = min(i + width, length + (kind == "insert"))
                    if i >= j:
                        continue
                    u = upto[:, i:j]
                    if kind == "delete":
                        h = (u + (total - upto[:, i + 1 : j + 1]) * _INV)[:, :, None]
                        ok = (part[:, i:j] != before[:, i:j])[:, :, None]
                    elif kind == "replace":
                        h = total[:, :, None] + (letters - c[:, i:j, None]) * power[i:j, None]
                        ok = alphabet != part[:, i:j, None]
                    else:
                        h = (u + (total - u) * _P)[:, :, None] + letters * power[i:j, None]
                        ok = alphabet != before[:, i:j, None]
                    n = length + {"delete": -1, "replace": 0, "insert": 1}[kind]
                    if n == 0:
                        continue
                    at = np.flatnonzero(ok.ravel())
                    if table is not None:
                        at = at[table.has(_mixed(h.ravel()[at], n))]
                    for cut in range(0, len(at), max(1, PIECE * 16 // n)):
                        w, k, letter = np.unravel_index(at[cut : cut + max(1, PIECE * 16 // n)], ok.shape)
                        k = k + i
                        yield places[a + w], _strings(_changed(part[w], k, alphabet[letter], kind))


def _changed(rows: np.ndarray, k: np.ndarray, letter: np.ndarray, kind: str) -> np.ndarray:
    """Rows of code points with one change at place k of each."""
    if kind == "replace":
        rows[np.arange(len(rows)), k] = letter
        return rows
    n = rows.shape[1] + (1 if kind == "insert" else -1)
    at = np.arange(n)
    if kind == "delete":
        return np.take_along_axis(rows, at + (at >= k[:, None]), axis=1)
    out = np.take_along_axis(rows, np.clip(at - (at > k[:, None]), 0, rows.shape[1] - 1), axis=1)
    out[np.arange(len(rows)), k] = letter
    return out


# ---------------------------------------------------------------- in Spark


def _table(vocabulary: DataFrame, bits: int, most: int) -> Table:
    """The bit table of the vocabulary, put together by Spark; at most `most` bits come to the driver."""
    size = 1 << max(10, (vocabulary.count() * bits - 1).bit_length())
    size = min(size, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = hashes(b.column(0))
            at = np.unique(np.concatenate([_bits(h, probe, size) for probe in range(PROBES)]))
            word, start = np.unique(at >> _U(6), return_index=True)
            if len(word):
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(np.bitwise_or.reduceat(_U(1) << (at & _U(63)), start).view(np.int64))], ["at", "bits"])

    found = vocabulary.select("word").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.int64)
    words[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return Table(words.view(_U))


def near_words(vocabulary: DataFrame, *, bits: int = BITS, most: int = MOST_BITS) -> DataFrame:
    """(word, near, near_n) of a table (word, n) of distinct words of letters from U+0000 to U+00FF: each pair both ways round."""
    spark = vocabulary.sparkSession
    shown = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()  # letters: 90 at most
    alphabet = np.array(sorted(ord(r.c) for r in shown), np.uint8)
    shared = spark.sparkContext.broadcast((alphabet, _table(vocabulary, bits, most)))  # 64 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, table = shared.value
        for b in batches:
            for places, found in neighbours(b.column(0), letters, table) if len(letters) else ():
                at = pa.array(places)
                yield pa.RecordBatch.from_arrays([found, b.column(0).take(at), b.column(1).take(at)], ["word", "near", "near_n"])

    # words are dealt anew, so many to a task: their neighbours are some thousand times what a word weighs in its file
    dealt = vocabulary.select("word", "n").repartition(max(1, -(-vocabulary.count() // WORDS)), "word")
    emitted = dealt.mapInArrow(run, "word string, near string, near_n long")
    return emitted.join(vocabulary.select("word").hint("shuffle_hash"), "word", "left_semi")


def variants(docs: DataFrame, *, letters: int = LEAST_LETTERS, times: int = LEAST_TIMES, ratio: int = RATIO, changed: int = CHANGED) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word with its near words counted, the frequent one that it is taken for, and where
    following forms ends."""
    vocabulary = C.materialize(word_counts(docs, letters=letters, changed=changed).where(F.col("n") >= times), "spelling-words")
    near = near_words(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    formed = F.col("best.m") * -1 >= F.col("n") * ratio
    of = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n"))
    of = C.materialize(of, "spelling-forms")
    root = _roots(of.where("form is not null").select("word", F.col("form").alias("root")))
    return of.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """Each word with the end of its chain of links. A form is ten times as frequent as its word, so that there are no rings; every
    round doubles the steps taken."""
    now = C.materialize(links, "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = C.materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        C.drop_materialized(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("word", "root")


# ---------------------------------------------------------------- query


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return variants(C.table(spark, sf_dir, "documents"))


#: crc32 is a fold over bytes with a table of 256 entries from its polynomial. Near words share a pattern: the word with one place blanked (replaced), or
#: the word with one letter less (inserted, deleted).
ORACLE_SQL = r"""
with recursive crc as (
  select list(v order by k) as t from (
    select k, list_reduce(range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, k) as v from (select unnest(range(256)) as k)
  )
),
runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run
  from documents
),
each_run as (select id, run, count(*) as n from runs where length(run) >= 7 group by all),
bytes as (
  select id, run, n, flatten([case when unicode(c) < 128 then [unicode(c)] else [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] end for c in string_split(id || ':' || run, '')]) as b
  from each_run
),
hashed as (select id, run, n, xor(list_reduce(b, lambda x, y: xor(x >> 8, t[(xor(x, y::bigint) & 255) + 1]), 4294967295::bigint), 4294967295) as h from bytes, crc),
cut as (select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed),
voc as (select word, sum(n)::bigint as n from cut where length(word) >= 7 group by all having sum(n) >= 2),
places as (select word, n, unnest(range(1, length(word) + 1)) as i from voc),
blanked as (select word, n, i, left(word, i - 1) || '_' || substr(word, i + 1) as key from places),
shorter as (select distinct word, n, left(word, i - 1) || substr(word, i + 1) as key from places),
near as (
  select a.word, b.word as near, b.n as near_n from blanked a join blanked b on a.key = b.key and a.word <> b.word
  union select s.word, v.word, v.n from shorter s join voc v on v.word = s.key
  union select v.word, s.word, s.n from shorter s join voc v on v.word = s.key
),
ranked as (select word, near, near_n, count(*) over (partition by word) as n_near, row_number() over (partition by word order by near_n desc, near) as k from near),
of as (
  select v.word, v.n, coalesce(n_near, 0)::bigint as n_near, case when near_n >= 10 * v.n then near end as form, case when near_n >= 10 * v.n then near_n end as form_n
  from voc v left join ranked r on r.word = v.word and k = 1
),
chain as (
  select word, word as root, form as ahead from of
  union all select c.word, c.ahead, o.form from chain c join of o on o.word = c.ahead
)
select word, form, root, n, n_near, form_n from of join (select word, root from chain where ahead is null) using (word)
"""
