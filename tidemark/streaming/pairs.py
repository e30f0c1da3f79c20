"""The pair machine of operators.coupling as a stream: one stateful operator keyed by pair, that takes values of single series as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import coupling as C

OUT = "a string, b string, ts timestamp, rho_fast double, rho_slow double, state string, left string, reason string"
_MACHINE = "state string, z double, sd double, sign double, need double, gate double, peak double, age bigint, dwell bigint, pending string, streak bigint, sums array<double>"


class PairMachine(StatefulProcessor):
    """Keeps of each pair the machine and its running sums (a value), the bars that its quantiles look back on (a list of at most Params.window) and
    the values that wait for the watermark (a list). When the watermark has passed a time nothing of it can arrive any more: the bars up to there
    that both sides have are taken in order, whichever batches they came in."""

    def __init__(self, params: C.Params, fast: float, slow: float):
        self.params, self.rates = params, (C.alpha(fast), C.alpha(slow))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", _MACHINE)
        self.tail = handle.getListState("tail", "x double, gap double")
        self.held = handle.getListState("held", "ts bigint, side int, r double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002  the interface's names
        for pdf in rows:
            at = pdf["ts"].astype("int64") // {"s": 1, "ms": 10**3, "us": 10**6, "ns": 10**9}[pdf["ts"].dt.unit] * 1000
            self.held.appendList([(int(t), int(s), float(r)) for t, s, r in zip(at, pdf["side"], pdf["r"], strict=True)])
            self.handle.registerTimer(int(at.max()))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        mark = timerValues.getCurrentWatermarkInMs()
        held = list(self.held.get())
        self.held.clear()
        if later := [x for x in held if x[0] > mark]:
            self.held.put(later)
            self.handle.registerTimer(max(x[0] for x in later))
        sides = [{t: r for t, side, r in held if side == k and t <= mark} for k in (0, 1)]
        at = sorted(sides[0].keys() & sides[1].keys())
        if at:
            yield self._advance(key, at, *(np.array([s[t] for t in at]) for s in sides))

    def _advance(self, key: tuple, at: list[int], x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        _, step = C._states(self.params)
        machine, sums = C.Coupling(), np.zeros((2, 3))
        if self.machine.exists():
            *fields, kept = self.machine.get()
            machine, sums = C.Coupling(*fields), np.array(kept, float).reshape(2, 3)
        tail = np.array([tuple(r) for r in self.tail.get()], float).reshape(-1, 2)
        rho, sums = C._rho(x, y, self.rates, sums)
        (machine, tail), out = step((machine, tail), rho[:, 0], rho[:, 1])
        kinds = (str, float, float, float, float, float, float, int, int, str, int)
        self.machine.update((*(None if v is None else k(v) for k, v in zip(kinds, asdict(machine).values(), strict=True)), sums.ravel().tolist()))
        self.tail.put([tuple(map(float, r)) for r in tail])
        return pd.DataFrame({"a": key[0], "b": key[1], "ts": pd.to_datetime(at, unit="ms"), "rho_fast": rho[:, 0], "rho_slow": rho[:, 1], **out})


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams begun inside keep their state in RocksDB, as transformWithState wants it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pair_states(stream: DataFrame, pairs: DataFrame, params: C.Params | None = None, fast: float = C.HALF_FAST, slow: float = C.HALF_SLOW, late: str = "1 hour") -> DataFrame:
    """What coupling.pair_states gives of coupling.pair_rho, as a stream: a row for each joint bar once the watermark, `late` behind, has passed it.

    stream: symbol, ts (timestamp), r; pairs: (a, b) with a < b, a static table. A null r is no value; of values of one series and time the last
    to arrive counts. Start it inside `rocksdb`."""
    sides = pairs.select(F.col("a").alias("symbol"), "a", "b", F.lit(0).alias("side")).union(pairs.select(F.col("b").alias("symbol"), "a", "b", F.lit(1).alias("side")))
    # merged by symbol: left to itself Spark takes the batch, whose files are small, for the side to broadcast, and sends it through the driver
    rows = stream.where("r is not null").withWatermark("ts", late).join(sides.hint("merge"), "symbol").select("a", "b", "ts", "side", "r")
    return rows.groupBy("a", "b").transformWithStateInPandas(PairMachine(params or C.Params(), fast, slow), OUT, "append", "eventTime")
