"""Token counts as delta-maintained rollups (operator 2).

A change inserts a document, deletes it, or revises it (another count, source or language). Each change is signed: what it takes
away with -1, what it adds with +1. A batch of changes is added up by source, language and tokenizer version, and that sum is the
batch's commit: one folder, named by the batch, valid once Spark has put its _SUCCESS there. A batch that is committed isn't
written again, one whose writing broke off is overwritten, so that repeating a batch changes nothing. Totals are
the sums of the committed batches. `compact` adds up all committed batches into a generation: a folder of one row for each key, and
then the names of the batches in it, whose _SUCCESS makes the generation count. The newest such generation and the batches that it
doesn't name are what is read; older folders are deleted only after it stands, and deleting may break off at any point. Documents
are never looked up again. A rollup has one writer at a time.

Tokenizers are functions by version name. Words are runs of anything but white space; byte-level BPE reads a public vocabulary file from
a path that is a parameter.

Defined results
  text null or empty         0 tokens; the document counts
  source or lang null        a group of its own
  repeated rows, null ids    each row counts
  an unknown kind of change  raises
  empty table                no rows
  very long texts            counted whole
  a broken-off batch or compaction      doesn't count, and is overwritten or passed over by the next
  compacting twice, or with nothing new      changes nothing
  groups that sum to nothing (no documents and no tokens) aren't listed
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

KEYS = ("source", "lang", "tokenizer")
SUMS = "source string, lang string, tokenizer string, docs long, tokens long"


@functools.lru_cache(maxsize=4)
def _bpe(path: str) -> Callable[[str], int]:
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    code = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(code.encode_ordinary(text))


def count_words(text: str) -> int:
    return len(text.encode().split())


def default_tokenizers() -> dict[str, str | None]:
    """Versions and their vocabulary files; None: white-space words."""
    import public_tokenizers

    return {"words@1": None, "byte_bpe_50k@1": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def count(docs: DataFrame, tokenizers: dict[str, str | None] | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens, bytes): a row for each document row and tokenizer."""
    tokenizers = default_tokenizers() if tokenizers is None else tokenizers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = {v: _bpe(p) if p else count_words for v, p in tokenizers.items()}
        for b in batches:
            texts = [x or "" for x in b.column(3).to_pylist()]
            size = pa.array([len(x.encode()) for x in texts], pa.int64())
            for version, f in functions.items():
                tokens = pa.array([f(x) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([version] * len(texts)), tokens, size], ["doc_id", "source", "lang", "tokenizer", "tokens", "bytes"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text"))
    return slim.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, tokens long, bytes long")


# ---------------------------------------------------------------- changes


def side(tokens: str = "tokens") -> Column:
    """What one side of a change holds."""
    return F.struct("source", "lang", "tokenizer", F.col(tokens).alias("tokens"))


def signed(changes: DataFrame) -> DataFrame:
    """Rows (source, lang, tokenizer, docs, tokens) with their signs, of changes (kind: insert, delete or revise; old; new)."""
    known = F.when(F.col("kind").isin("insert", "delete", "revise"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(F.col("kind"), F.lit("null")))))
    minus = F.when(known != "insert", F.struct("old", F.lit(-1).alias("sign")))
    plus = F.when(F.col("kind") != "delete", F.struct(F.col("new").alias("old"), F.lit(1).alias("sign")))
    one = changes.select(F.explode(F.filter(F.array(minus, plus), lambda x: x.isNotNull())).alias("x")).select("x.old.*", "x.sign")
    return one.select(*KEYS, F.col("sign").cast("long").alias("docs"), (F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Rollup:
    """A folder of committed batches (batch-NAME) and generations of added-up batches (sums-N, names-N)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, batch: str) -> str:
        if not batch or "/" in batch or batch.startswith(("_", ".")):
            raise ValueError(f"not a batch name: {batch!r}")
        return f"{self.folder}/batch-{batch}"

    def _whole(self) -> tuple[list[str], list[int]]:
        """Names of whole batches, and whole generations in their order."""
        fs, p = _fs(self.spark, self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        done = {n for n in names if fs.exists(path(f"{self.folder}/{n}/_SUCCESS"))}
        made = sorted(int(n.removeprefix("names-")) for n in done if n.startswith("names-") and f"sums-{n.removeprefix('names-')}" in done)
        return sorted(n.removeprefix("batch-") for n in done if n.startswith("batch-")), made

    def _names(self, made: list[int]) -> DataFrame:
        """(batch) in the newest generation: as many as were ever committed, so they stay a table."""
        if not made:
            return self.spark.createDataFrame([], "batch string")
        return self.spark.read.schema("batch string").parquet(f"{self.folder}/names-{made[-1]}")

    def _merged(self, made: list[int], batches: list[str]) -> set[str]:
        """Of the batches that have folders of their own, those that the newest generation holds already: a compaction broke off before
        it deleted them. There are as many folders as commits since the last compaction."""
        if not made or not batches:
            return set()
        own = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        return {r[0] for r in self._names(made).join(own, "batch", "left_semi").collect()}

    def names(self) -> DataFrame:
        """(batch): names of the batches whose sums count."""
        batches, made = self._whole()
        return self._names(made).union(self.spark.createDataFrame([(b,) for b in batches], "batch string")).distinct()

    def committed(self) -> list[str]:
        """The same as a sorted list, for looking at: neither commits nor compaction need it."""
        return sorted(r[0] for r in self.names().collect())

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch's changes; False if it is already there."""
        path = self._path(batch)
        batches, made = self._whole()
        if batch in batches or not self._names(made).where(F.col("batch") == batch).isEmpty():
            return False
        sums = signed(changes).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(path)
        return True

    def _sums(self) -> DataFrame | None:
        """What counts, a row for each key and folder."""
        batches, made = self._whole()
        merged = self._merged(made, batches)
        read = [*(f"{self.folder}/sums-{k}" for k in made[-1:]), *(self._path(b) for b in batches if b not in merged)]
        return self.spark.read.schema(SUMS).parquet(*read) if read else None

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches."""
        sums = self._sums()
        if sums is None:
            return self.spark.createDataFrame([], SUMS)
        return sums.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Add up all committed batches into a new generation; then delete what it replaces."""
        batches, made = self._whole()
        number = made[-1] if made else 0
        if set(batches) - self._merged(made, batches):
            names = self.names()
            number += 1  # a broken-off attempt of this number is overwritten: it has no whole names-N, so nothing reads it
            self.totals().write.mode("overwrite").parquet(f"{self.folder}/sums-{number}")
            names.write.mode("overwrite").parquet(f"{self.folder}/names-{number}")
        fs, p = _fs(self.spark, self.folder)
        for old in [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []:
            kind, _, rest = old.getName().partition("-")
            if kind == "batch" and rest in batches or kind in ("sums", "names") and int(rest) < number:
                fs.delete(old, True)


# ---------------------------------------------------------------- query


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a stream of changes: inserted with estimates, revised to their counts, a tenth deleted and inserted again;
    two batches arrive twice."""
    counts = C.materialize(count(C.table(spark, sf_dir, "documents")), "tokens")
    guess = counts.withColumn("tokens", F.floor(F.col("bytes") / 4).cast("long"))
    tenth = counts.where(C.crc_mod("doc_id", 10) == 0)
    old = F.lit(None).cast("struct<source:string,lang:string,tokenizer:string,tokens:long>")
    inserted = guess.select(F.lit("insert").alias("kind"), old.alias("old"), side().alias("new"))
    revised = counts.withColumn("guess", F.floor(F.col("bytes") / 4).cast("long")).select(F.lit("revise").alias("kind"), side("guess").alias("old"), side().alias("new"))
    rollup = Rollup(spark, C.new_path(spark, "rollup"))
    for batch, changes in (
        ("1-insert", inserted),
        ("2-revise", revised),
        ("1-insert", inserted),
        ("2-revise", revised),
        ("3-delete", tenth.select(F.lit("delete").alias("kind"), side().alias("old"), old.alias("new"))),
        ("4-insert", tenth.select(F.lit("insert").alias("kind"), old.alias("old"), side().alias("new"))),
    ):
        rollup.commit(batch, changes)
    return rollup.totals()
