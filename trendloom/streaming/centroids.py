"""The registry as streaming state: running centroids, numbers for new topics, eviction.

Tasks add up their own rows first, so a frequent topic sends its state one row for each
batch of a task. State is kept by Spark's store and comes back after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that several values for a key need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def partial_sums(rows: DataFrame, topic: str, vector: str, time: str) -> DataFrame:
    """topic, total (of unit vectors), n, first, last of the rows of each task's batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            v = np.stack([np.asarray(x, float) for x in f["_v"]])
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            out = [(t, v[at].sum(axis=0).tolist(), len(at), f["_at"].iloc[at].min(), f["_at"].iloc[at].max()) for t, at in f.reset_index(drop=True).groupby("topic").indices.items()]
            yield pd.DataFrame(out, columns=["topic", "total", "n", "first", "last"])

    some = rows.where(F.col(topic).isNotNull() & F.col(vector).isNotNull()).select(F.col(topic).cast("string").alias("topic"), F.col(vector).alias("_v"), F.col(time).cast("timestamp").alias("_at"))
    return some.mapInPandas(run, "topic string, total array<double>, n long, first timestamp, last timestamp")


class RunningCentroid(StatefulProcessor):
    """Value state: the sum of a topic's unit vectors, their number, first and last time. A
    timer at last + days drops a topic that hasn't been seen since."""

    def __init__(self, days: float) -> None:
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("topic", "total array<double>, n long, first timestamp, last timestamp")

    def _row(self, key, total, n, first, last, status: str) -> pd.DataFrame:
        v = np.asarray(total, float)
        unit = (v / max(np.linalg.norm(v), 1e-12)).tolist()
        return pd.DataFrame([(key, unit, int(n), first, last, status)], columns=["topic", "centroid", "size", "first_seen", "last_seen", "status"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        total, n, first, last = held if held else (None, 0, None, None)
        for f in rows:
            for r in f.itertuples(index=False):
                add = np.asarray(r.total, float)
                total = add if total is None else np.asarray(total, float) + add
                n += int(r.n)
                first = r.first if first is None else min(pd.Timestamp(first), pd.Timestamp(r.first))
                last = r.last if last is None else max(pd.Timestamp(last), pd.Timestamp(r.last))
        if total is None:
            return
        total = [float(x) for x in total]
        self.state.update((total, n, pd.Timestamp(first).to_pydatetime(), pd.Timestamp(last).to_pydatetime()))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(pd.Timestamp(last).timestamp() * 1000) + int(self.days * 86_400_000))
        yield self._row(key[0], total, n, first, last, "ACTIVE")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            total, n, first, last = self.state.get()
            self.state.clear()
            yield self._row(key[0], total, n, first, last, "RETIRED")

    def close(self) -> None:
        pass


def running_centroids(stream: DataFrame, topic: str, vector: str, time: str, late: str = "2 days", days: float = 90) -> DataFrame:
    """topic, centroid, size, first_seen, last_seen, status: a row for each topic that a
    batch changes, and one with RETIRED for a topic once the watermark is ``days`` behind
    its last row. A topic that comes again after that starts anew."""
    sums = partial_sums(stream, topic, vector, time).withWatermark("last", late)
    schema = "topic string, centroid array<double>, size long, first_seen timestamp, last_seen timestamp, status string"
    return sums.groupBy("topic").transformWithStateInPandas(RunningCentroid(days), schema, "Update", "EventTime")


class NewNumbers(StatefulProcessor):
    """Value state of a scope: the largest number given. Map state: what each name has."""

    def __init__(self, floor: int) -> None:
        self.floor = floor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "number long")
        self.given = handle.getMapState("given", "name string", "number long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = sorted({(r.first, r.name) for f in rows for r in f.itertuples(index=False)})
        last = self.last.get()[0] if self.last.exists() else self.floor
        out = []
        for _, name in names:
            if not self.given.containsKey((name,)):
                last += 1
                self.given.updateValue((name,), (last,))
                out.append((key[0], name, last))
        self.last.update((last,))
        if out:
            yield pd.DataFrame(out, columns=["scope", "name", "number"])

    def close(self) -> None:
        pass


def new_numbers(stream: DataFrame, scope: str, name: str, first: str, floor: int = 0) -> DataFrame:
    """scope, name, number: a number for each new name of a scope, above all that were
    given before it and above floor, by time and name within a batch. A name that was
    numbered before gives no row. Names are of topics, not of records."""
    rows = stream.select(F.col(scope).cast("string").alias("scope"), F.col(name).cast("string").alias("name"), F.col(first).cast("timestamp").alias("first"))
    return rows.groupBy("scope").transformWithStateInPandas(NewNumbers(floor), "scope string, name string, number long", "Append", "None")
