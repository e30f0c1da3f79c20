"""Tables that change together: incremental scans with versioned watermarks, a fair work budget, and reads that no writer disturbs."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


class Conflict(Exception):
    """Another writer has committed since the snapshot that this one stands on."""


@dataclass(frozen=True)
class Snapshot:
    """What a reader has pinned: a number and each table's folders. Folders are never written to again, so that what is read through it stays the
    same whatever is committed meanwhile. facts: small values that are committed with the tables."""

    number: int = 0
    folders: dict[str, list[str]] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)


class Tables:
    """Tables below a folder. Data are written into new folders first; then one manifest that names the folders of all tables makes them seen, all of
    them or none. A manifest's number is taken by one writer only (the file is created, never replaced); who comes second gets Conflict.
    What is written without a manifest, by a writer that broke off, is never read."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def pin(self) -> Snapshot:
        """The latest snapshot."""
        where = self._path(f"{self.root}/manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(where)] if self._fs.exists(where) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        if not numbers:
            return Snapshot()
        at = max(numbers)
        row = self.spark.read.text(f"{self.root}/manifests/{at:012d}.json", wholetext=True).first()
        return Snapshot(at, **json.loads(row.value))

    def read(self, name: str, at: Snapshot | None = None) -> DataFrame:
        folders = (at or self.pin()).folders.get(name, [])
        reader = self.spark.read.schema(self.schemas[name])
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], self.schemas[name])

    def stage(self, name: str, df: DataFrame) -> str:
        """Write rows that no reader sees yet."""
        folder = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
        df.select(*[f.split()[0] for f in self.schemas[name].split(", ")]).write.parquet(folder)
        return folder

    def commit(self, at: Snapshot, add: dict[str, str] | None = None, replace: dict[str, str] | None = None, facts: dict | None = None) -> Snapshot:
        """Make staged folders seen: added to those of the snapshot `at`, or in their place."""
        folders = {k: list(v) for k, v in at.folders.items()}
        for name, folder in (add or {}).items():
            folders.setdefault(name, []).append(folder)
        for name, folder in (replace or {}).items():
            folders[name] = [folder]
        after = Snapshot(at.number + 1, folders, {**at.facts, **(facts or {})})
        # the whole file under a name of its own first: a manifest is there with all that it says, or not at all
        draft, final = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/{after.number:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"folders": after.folders, "facts": after.facts}).encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"snapshot {at.number} is not the latest")
        return after


# ---------------------------------------------------------------- scans


class Scans:
    """Sparse results of scans over series, of several versions of the rules. A scan tells which bars it has looked at and what it found; what it found
    replaces whatever any version had at these bars, and the watermark of its version moves, in one commit.

    rows: symbol, ts, commit, version, found (a JSON text; null: looked at, nothing there). marks: symbol, version, commit, through."""

    SCHEMAS = {"rows": "symbol string, ts timestamp_ntz, commit long, version string, found string", "marks": "symbol string, version string, commit long, through timestamp_ntz"}

    def __init__(self, spark: SparkSession, root: str):
        self.tables = Tables(spark, root, self.SCHEMAS)

    def marks(self, version: str, at: Snapshot | None = None) -> DataFrame:
        """(symbol, through): up to where this version has scanned; no row where it hasn't."""
        own = self.tables.read("marks", at).where(F.col("version") == version)
        return own.groupBy("symbol").agg(F.max_by("through", "commit").alias("through"))

    def results(self, at: Snapshot | None = None) -> DataFrame:
        """(symbol, ts, version, found): of each bar what the last scan found there."""
        last = self.tables.read("rows", at).groupBy("symbol", "ts").agg(F.max_by(F.struct("version", "found"), "commit").alias("m"))
        return last.select("symbol", "ts", "m.version", "m.found").where("found is not null")

    def replace(self, at: Snapshot, processed: DataFrame, found: DataFrame, version: str, facts: dict | None = None, through: DataFrame | None = None) -> Snapshot:
        """Commit a scan on top of the snapshot that it was made from. processed: (symbol, ts) of every bar looked at; found: (symbol, ts, ..) of
        some of them; through: (symbol, through) where a symbol is known to be scanned further than its last processed bar.

        A found row at a bar that wasn't processed, or a watermark before the last processed bar, fails; so does a second row of a bar."""
        number = at.number + 1
        values = [c for c in found.columns if c not in ("symbol", "ts")]
        f = found.select("symbol", "ts", F.to_json(F.struct(*values)).alias("found")) if values else found.select("symbol", "ts", F.lit("{}").alias("found"))
        seen = processed.select("symbol", "ts").distinct().withColumn("_seen", F.lit(True))
        rows = seen.join(f, ["symbol", "ts"], "full")
        rows = rows.withColumn("_bad", F.assert_true(F.col("_seen").isNotNull() & (F.count(F.lit(1)).over(W.partitionBy("symbol", "ts")) == 1), F.lit("a found row at a bar that wasn't processed, or twice")))
        rows = rows.where(F.col("_bad").isNull()).select("symbol", "ts", F.lit(number).alias("commit"), F.lit(version).alias("version"), "found")
        last = processed.groupBy("symbol").agg(F.max("ts").alias("last"))
        if through is not None:
            last = last.join(through.select("symbol", F.col("through").cast("timestamp_ntz").alias("_to")), "symbol", "full")
            last = last.withColumn("_bad", F.assert_true(F.col("_to").isNull() | F.col("last").isNull() | (F.col("_to") >= F.col("last")), F.lit("a watermark before the last processed bar")))
            last = last.where(F.col("_bad").isNull()).withColumn("last", F.coalesce("_to", "last"))
        marks = last.select("symbol", F.lit(version).alias("version"), F.lit(number).alias("commit"), F.col("last").alias("through"))
        staged = {"rows": self.tables.stage("rows", rows), "marks": self.tables.stage("marks", marks)}
        return self.tables.commit(at, add=staged, facts=facts)

    def compact(self, at: Snapshot) -> Snapshot:
        """One folder a table, with what still counts. Readers of earlier snapshots aren't touched."""
        rows = self.tables.read("rows", at).groupBy("symbol", "ts").agg(F.max_by(F.struct("commit", "version", "found"), "commit").alias("m")).select("symbol", "ts", "m.*").where("found is not null")
        marks = self.tables.read("marks", at).groupBy("symbol", "version").agg(F.max_by(F.struct("commit", "through"), "commit").alias("m")).select("symbol", "version", "m.*")
        return self.tables.commit(at, replace={"rows": self.tables.stage("rows", rows), "marks": self.tables.stage("marks", marks)})


def share_budget(bars: DataFrame, marks: DataFrame, budget: int, start: int = 0) -> DataFrame:
    """(symbol, ts, place, symbols): the bars that a cycle looks at, at most `budget` in all. Symbols in order, rotated so that the one numbered `start`
    comes first, take what they have after their watermark until the budget is used up; of each symbol the oldest ones, so that its watermark can
    move. place: how many symbols stand before it in the rotation. bars: symbol, ts; marks: (symbol, through).

    Quotas are running sums over a row a symbol (a registry, which is one window); bars are numbered within their symbol."""
    new = bars.select("symbol", "ts").distinct().join(marks.select("symbol", "through"), "symbol", "left").where("through is null or ts > through").select("symbol", "ts")
    every = bars.groupBy("symbol").agg(F.lit(1).alias("_one")).select("symbol").join(new.groupBy("symbol").agg(F.count(F.lit(1)).alias("new")), "symbol", "left")
    order = W.partitionBy(F.lit(0))
    ranked = every.select("symbol", F.coalesce("new", F.lit(0)).alias("new"), (F.row_number().over(order.orderBy("symbol")) - 1).alias("_i"), F.count(F.lit(1)).over(order).alias("symbols"))
    ranked = ranked.withColumn("place", F.pmod(F.col("_i") - F.lit(start), F.col("symbols")))
    before = F.sum("new").over(order.orderBy("place").rowsBetween(W.unboundedPreceding, 0)) - F.col("new")
    quota = ranked.withColumn("quota", F.greatest(F.lit(0), F.least("new", F.lit(budget) - before)))
    w = W.partitionBy("symbol").orderBy("ts")
    return new.join(quota.where("quota > 0").select("symbol", "place", "symbols", "quota"), "symbol").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= F.col("quota")).select("symbol", "ts", "place", "symbols")


def cycle(scans: Scans, bars: DataFrame, scan, version: str, budget: int) -> Snapshot:
    """One cycle of an incremental scan: the next bars within the budget, `scan` over them (from (symbol, ts) to found rows), and one commit of what it
    found, the watermarks and where the next cycle begins: after the symbols that this one has come to. Nothing to do commits nothing."""
    at = scans.tables.pin()
    start = int(at.facts.get("start", 0))
    todo = share_budget(bars, scans.marks(version, at), budget, start)
    staged = f"{scans.tables.root}/work/{uuid.uuid4().hex}"
    todo.write.parquet(staged)  # decided once, then scanned and committed
    todo = scans.tables.spark.read.schema(todo.schema).parquet(staged)
    done = todo.agg(F.count_distinct("symbol").alias("n"), F.max("symbols").alias("of")).first()
    if not done.n:
        return at
    return scans.replace(at, todo, scan(todo.select("symbol", "ts")), version, {"start": (start + done.n) % done.of})


# ---------------------------------------------------------------- confirmation by authority


def confirmed(values: DataFrame, keys: list[str], day: str, official: Column, value: str, seq: str) -> DataFrame:
    """Of official and provisional values of days: the official ones (the latest by `seq`), and provisional ones of days after the confirmation
    watermark only, which is the key's last official day. Adds confirmed_through and official. The result is that of the set of rows: in whichever
    order or batches they have arrived, the watermark never goes back and a late provisional value never wins."""
    best = values.select(*keys, day, official.alias("official"), F.struct(F.col(seq).alias("seq"), F.col(value).alias("value")).alias("m")).groupBy(*keys, day, "official").agg(F.max("m").alias("m"))
    mark = F.max(F.when(F.col("official"), F.col(day))).over(W.partitionBy(*keys))
    best = best.withColumn("confirmed_through", mark)
    return best.where(F.col("official") | F.col("confirmed_through").isNull() | (F.col(day) > F.col("confirmed_through"))).select(*keys, day, "official", F.col("m.value").alias(value), "confirmed_through")
