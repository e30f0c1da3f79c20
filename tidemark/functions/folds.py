"""Sequential functions over sorted series in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame | None]]


def runs(pdf: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Rows of each key, of rows sorted by key. A null is a key of its own, apart from any text."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for k in keys:
        v, w = pdf[k].to_numpy()[1:], pdf[k].to_numpy()[:-1]
        new[1:] |= ~((v == w) | (pd.isna(v) & pd.isna(w))).astype(bool)
    at = [*np.flatnonzero(new), len(pdf)]
    for a, b in zip(at, at[1:], strict=False):
        part = pdf.iloc[a:b].reset_index(drop=True)
        yield tuple(None if pd.isna(part[k].iat[0]) else part[k].iat[0] for k in keys), part


def fold(df: DataFrame, keys: list[str], start: Callable[[], Any], step: Step, schema: str, order: list[str] | None = None) -> DataFrame:
    """Run `step(state, rows)` along each key's rows in order. Rows come in the pieces in which Arrow brings them: only the state is
    kept between pieces, never a whole series. `step` gives the new state and the rows to put out."""
    order = order or ["ts"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out = []
            for key, part in runs(pdf, keys) if len(pdf) else ():
                if key != current:
                    current, state = key, start()
                state, rows = step(state, part)
                if rows is not None and len(rows):
                    out.append(rows.astype(object).where(rows.notna(), None))
            if out:
                yield pd.concat(out, ignore_index=True)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def running_mean(v: np.ndarray, rate: float, start: np.ndarray | float = 0.0) -> np.ndarray:
    """s[i] = (1 - rate) s[i-1] + rate v[i] along the first axis, value by value, so that pieces give the same to the last bit."""
    if v.ndim > 1:
        first = np.broadcast_to(start, v.shape[1:])
        return np.column_stack([running_mean(v[:, k], rate, first[k]) for k in range(v.shape[1])])
    keep = 1 - rate
    return np.array([*accumulate(v.tolist(), lambda s, x: keep * s + rate * x, initial=float(start))][1:])
