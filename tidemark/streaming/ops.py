"""The incremental half: windows, sessions, deduplication, stateful folds and corrected data as Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

from tidemark.operators.state import need


def work_dir(spark: SparkSession) -> str:
    """A new folder for checkpoints and sinks, below the shared folder that the cluster names; on a single machine without one, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A table as a stream of files. ts becomes an instant, as watermarks want it."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    s = reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in schema.names else s


def in_files(df: DataFrame, folder: str, files: int = 6, late_seconds: int = 1800) -> DataFrame:
    """A stream of a table's rows (with a time `ts`) in files by time, a batch each; of the last `late_seconds` before a cut every second row, by a
    hash, comes late, in the next file."""
    spark = df.sparkSession
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    sec = F.unix_seconds("ts")
    low, high = df.agg(F.min(sec), F.max(sec)).first()
    span = max(1, -(-((high or 0) - (low or 0) + 1) // files))
    place = F.floor((sec - (low or 0)) / span)
    last_of = (place + 1) * span + (low or 0) - sec <= late_seconds
    moved = last_of & (F.pmod(F.xxhash64(*df.columns), F.lit(2)) == 0) & (place < files - 1)
    dealt = df.withColumn("_file", place + F.when(moved, 1).otherwise(0))
    for k in range(files):  # one after the other: a stream takes files in the order of their times
        dealt.where(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Let a stream take what is there, into parquet, and read that."""
    spark = stream.sparkSession
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/data").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/data")


def bars(stream: DataFrame, width: str = "4 hours", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) windows of values by symbol, put out when the watermark has passed them."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = stream.withWatermark("ts", late).groupBy("symbol", w.alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("high"), F.min("value").alias("low")).select("symbol", F.col("w.start").alias("ts"), "n", "high", "low")


def sessions(stream: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def first_wins(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


_STATE = T.StructType([T.StructField("current", T.StringType()), T.StructField("pending", T.StringType()), T.StructField("count", T.IntegerType())])


def confirm(stream: DataFrame) -> DataFrame:
    """Hysteresis of raw states (symbol, ts, raw_state) kept between batches; rows of a batch are put in order first."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(pdfs)).sort_values("ts", ignore_index=True)
        current, pending, count = state.get if state.exists else (None, None, 0)
        out = []
        for x in rows["raw_state"]:
            if current is None:
                current = x
            elif x == current:
                pending, count = None, 0
            else:
                pending, count = (x, count + 1) if x == pending else (x, 1)
                if count >= need(x, current, False):
                    current, pending, count = x, None, 0
            out.append(current)
        state.update((current, pending, count))
        yield rows[["symbol", "ts", "raw_state"]].assign(confirmed=out)

    return stream.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, raw_state string, confirmed string", _STATE, "append", GroupStateTimeout.NoTimeout)


def _latest(df: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in (*keys, "ts")]
    return df.groupBy(*keys).agg(F.max(F.struct("ts", *rest)).alias("m")).select(*keys, "m.*")


def upsert_latest(stream: DataFrame, keys: list[str], out: str, compact: int = 8) -> DataFrame:
    """The latest row of each key. A batch writes only its own keys' latest rows, under its number: one that is run again writes the same. After
    `compact` batches these become one table and are deleted; a reader takes the newest of what it finds. An empty stream gives no rows."""
    spark = stream.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    schema = _latest(spark.createDataFrame([], stream.schema), keys).schema

    def folders(s: SparkSession) -> list[tuple[int, str]]:
        p = path(f"{out}/latest")
        fs = p.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((int(n.split("-")[1]), n) for n in names if fs.exists(path(f"{out}/latest/{n}/_SUCCESS")))

    def read(s: SparkSession) -> DataFrame:
        found = [f"{out}/latest/{n}" for _, n in folders(s)]
        return _latest(s.read.schema(schema).parquet(*found), keys) if found else s.createDataFrame([], schema)

    def merge(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        _latest(batch, keys).write.mode("overwrite").parquet(f"{out}/latest/batch-{number}")
        old = folders(s)
        if len(old) > compact:
            read(s).write.mode("overwrite").parquet(f"{out}/latest/table-{number}")
            p = path(f"{out}/latest")
            for _, name in old:
                if name != f"table-{number}":
                    p.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).delete(path(f"{out}/latest/{name}"), True)

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return read(spark)


def recompute(stream: DataFrame, out: str, derive, look_back: int, key: str = "symbol") -> DataFrame:
    """Derived rows of bars that arrive late or corrected: each batch puts its bars (the latest arrival of a bar counts) into its series, and derives anew
    what follows from each series' first changed bar on, with `look_back` bars before it; what lies earlier stays as it is. derive: from bars to
    rows (key, ts, ...). Only series that a batch touches are read and written: a version of their own for each batch.

    stream: key, ts, arrived, and what `derive` looks at."""
    spark = stream.sparkSession
    last = lambda df, by: df.withColumn("_r", F.row_number().over(W.partitionBy(key, "ts").orderBy(F.col(by).desc()))).where("_r = 1").drop("_r")
    path = spark._jvm.org.apache.hadoop.fs.Path

    def stored(s: SparkSession, kind: str, below: int) -> list[str]:
        p = path(f"{out}/{kind}")
        fs = p.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return [f"{out}/{kind}/{n}" for n in names if int(n.split("=")[1]) < below and fs.exists(path(f"{out}/{kind}/{n}/_SUCCESS"))]

    def merge(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        if batch.isEmpty():
            return
        last(batch, "arrived").write.mode("overwrite").parquet(f"{out}/bars/batch={number}")
        changed = s.read.parquet(f"{out}/bars/batch={number}").groupBy(key).agg(F.min("ts").alias("_from"))
        every = last(s.read.schema(batch.schema).parquet(*stored(s, "bars", number + 1)).join(changed, key), "arrived")
        back = F.count_if(F.col("ts") < F.col("_from")).over(W.partitionBy(key).orderBy(F.col("ts").desc()))
        some = every.withColumn("_back", back).where(F.col("_back") <= look_back)
        rows = derive(some.drop("_from", "_back")).join(changed, key).where(F.col("ts") >= F.col("_from")).drop("_from")
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/version={number}")

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    found = stored(spark, "rows", 1 << 62)
    return last(spark.read.parquet(*found), "batch").drop("batch") if found else derive(spark.createDataFrame([], stream.schema))


def each_key_apart(df: DataFrame, key: str, step, schema: str) -> DataFrame:
    """`step` over each key's rows (a bounded group), failures told apart: rows with a null `error`, or one row of the key with its message alone. A
    failing key doesn't stop the others."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return step(pdf)[names].assign(error=None)
        except Exception as e:  # noqa: BLE001  whatever a key's data may cause is that key's result
            return pd.DataFrame([{**dict.fromkeys(names), key: pdf[key].iat[0], "error": f"{type(e).__name__}: {e}"}])

    return df.groupBy(key).applyInPandas(run, f"{schema}, error string")


def watermark(stream: DataFrame, key: str, out: str) -> DataFrame:
    """The newest time of each key: a watermark that never goes back."""
    return upsert_latest(stream.select(key, "ts", F.col("ts").alias("seen")), [key], out).select(key, "seen")
