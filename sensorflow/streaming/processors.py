"""What runs inside Python workers: the stateful processor and the batch fold.

The module imports nothing else of the package and is pickled by value, so workers need
only pandas, numpy and pyarrow.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_LONG, MIN_LONG = (1 << 63) - 1, -(1 << 63)
NUMBERS = [
    T.StructField("total", T.DoubleType()),
    T.StructField("nans", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low_us", T.LongType()),
    T.StructField("high_us", T.LongType()),
    T.StructField("seq", T.LongType()),
]
NUMBER_NAMES = [f.name for f in NUMBERS]
FOLDS = {
    "total": "sum",
    "nans": "sum",
    "n": "sum",
    "low": "min",
    "high": "max",
    "low_us": "min",
    "high_us": "max",
}


def text_fields(names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task with their number in it as the last column."""
    done = 0
    for batch in batches:
        numbers = pa.array(np.arange(done, done + batch.num_rows, dtype=np.int64))
        done += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, numbers], names=[*batch.schema.names, "line"])


def batch_fold(keys: Sequence[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Fold the accumulators of each Arrow batch by `keys`."""
    keys = list(keys)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            # The earliest row first; of equal ones that with the least values, null before all.
            words = [c for c in pdf.columns if c not in (*keys, *NUMBER_NAMES)]
            ordered = pdf.sort_values(["seq", *words], kind="stable", na_position="first")
            groups = ordered.groupby(keys, dropna=False, sort=False)
            folded = groups.agg({**FOLDS, "seq": "min"}).reset_index()
            # Context comes from the earliest row of each group, in the same group order.
            first = groups.head(1).reset_index(drop=True)
            for c in (*FOLDS, "seq"):
                first[c] = folded[c].to_numpy()
            yield first[list(pdf.columns)]

    return fold


class ClockWindows(StatefulProcessor):
    """Keeps one accumulator per open window of a group and emits it when its timer fires."""

    def __init__(self, seconds: int, group: Sequence[str], context: Sequence[str]):
        self.width = seconds * 1000
        self.group = list(group)
        self.context = list(context)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState(
            "windows",
            T.StructType([T.StructField("start", T.LongType())]),
            T.StructType([*NUMBERS, *text_fields(self.context)]),
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        start = now - now % self.width
        slot = (start,)
        acc = self.windows.getValue(slot) if self.windows.containsKey(slot) else None
        if acc is None:
            self.handle.registerTimer(start + self.width)
        for pdf in rows:
            acc = self._fold(acc, pdf)
        if acc is not None:
            self.windows.updateValue(slot, acc)
        return iter(())

    def _fold(self, acc, pdf: pd.DataFrame):
        if pdf.empty:
            return acc
        first = pdf.sort_values(["seq", *self.context], kind="stable", na_position="first").iloc[0]
        seen = {
            "total": float(pdf["total"].sum()),
            "nans": int(pdf["nans"].sum()),
            "n": int(pdf["n"].sum()),
            "low": float(pdf["low"].min()),
            "high": float(pdf["high"].max()),
            "low_us": int(pdf["low_us"].min()),
            "high_us": int(pdf["high_us"].max()),
            "seq": int(first["seq"]),
        }
        words = [None if pd.isna(first[c]) else str(first[c]) for c in self.context]
        if acc is None:
            return (*[seen[n] for n in NUMBER_NAMES], *words)
        old = dict(zip(NUMBER_NAMES, acc, strict=False))
        before = list(acc[len(NUMBER_NAMES) :])

        def place(seq, values):
            return seq, [(v is not None, v or "") for v in values]

        if place(old["seq"], before) <= place(seen["seq"], words):
            words = before
        merged = {
            "total": old["total"] + seen["total"],
            "nans": old["nans"] + seen["nans"],
            "n": old["n"] + seen["n"],
            "low": min(old["low"], seen["low"]),
            "high": max(old["high"], seen["high"]),
            "low_us": min(old["low_us"], seen["low_us"]),
            "high_us": max(old["high_us"], seen["high_us"]),
            "seq": min(old["seq"], seen["seq"]),
        }
        return (*[merged[n] for n in NUMBER_NAMES], *words)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        start = end - self.width
        if not self.windows.containsKey((start,)):
            return
        acc = self.windows.getValue((start,))
        self.windows.removeKey((start,))
        names = [*self.group, "start_us", *NUMBER_NAMES, *self.context]
        row = pd.DataFrame([[*key, start * 1000, *acc]], columns=names)
        yield row.astype({c: np.int64 for c in ("start_us", "nans", "n", "low_us", "high_us", "seq")})

    def close(self) -> None:
        pass
