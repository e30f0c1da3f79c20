"""A data source that replays stored pages of vendor JSON, one partition a page; and a synthetic series.

Live connectors stop at this interface: whoever has a network stores pages (one JSON array of [ts_ms, open, high, low, close, volume]
a file, however paged) and reads them as `spark.read.format("bar_pages").option("pages", "a.json;b.json").option("symbol", "X").load()`.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
EPOCH = dt.datetime(1970, 1, 1)


class Page(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages = [p for p in options.get("pages", "").split(";") if p]
        self.symbol = options.get("symbol", "")

    def partitions(self) -> list[Page]:
        return [Page(p) for p in self.pages]

    def read(self, partition: Page) -> Iterator[tuple]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(partition.uri) if "://" in partition.uri else (fs.LocalFileSystem(), partition.uri)
        with files.open_input_stream(path) as f:
            for ms, *values in json.loads(f.read()):
                yield (self.symbol, EPOCH + dt.timedelta(milliseconds=int(ms)), *map(float, values))


class BarPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bar_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def read_pages(spark: SparkSession, symbol: str, pages: list[str], drop_last: bool = True) -> DataFrame:
    """Bars of all pages; what pages share comes once, and the newest bar, which may still form, goes."""
    spark.dataSource.register(BarPages)
    df = spark.read.format("bar_pages").option("pages", ";".join(pages)).option("symbol", symbol).load().dropDuplicates(["symbol", "ts"])
    if not drop_last:
        return df
    return df.join(df.groupBy("symbol").agg(F.max("ts").alias("_last")), "symbol").where("ts < _last").drop("_last")


def demo(spark: SparkSession, n: int = 600, seed: int = 7, hours: int = 1) -> DataFrame:
    """A seeded series in three phases: quiet, then 120 bars of trend, then 60 of high volatility."""
    if n < 180:
        raise ValueError("at least 180 bars")
    r = np.random.default_rng(seed)
    step = np.concatenate([r.normal(0, 0.004, n - 180), r.normal(0.004, 0.004, 120), r.normal(0, 0.02, 60)])
    close = 100 * np.exp(np.cumsum(step))
    first = np.concatenate([[100.0], close[:-1]])
    wide = np.abs(r.normal(0, 0.002, n))
    rows = [("demo", EPOCH + dt.timedelta(days=20_000, hours=hours * i), float(first[i]), float(max(first[i], close[i]) * (1 + wide[i])), float(min(first[i], close[i]) * (1 - wide[i])), float(close[i]), float(r.integers(50, 500))) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)
