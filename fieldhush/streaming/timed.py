"""The rolling scorer and the self-updating baseline on event-time timers, with state in RocksDB.

A recorder's rows wait in a map of time buckets. An event-time timer at the end of a bucket fires once the watermark has passed it, when no row of
it can come any more; its rows are then sorted, scored against the recorder's memory, and removed. Files may come in any
order within ``lateness``, and the result is that of one sorted table. State lives in RocksDB, on local disk with a copy in the checkpoint, so the rows that
wait are not bound by memory: only one bucket of one recorder is. The memory can be seeded from history.

The watermark is the latest time of any recorder less ``lateness``. Rows that come later still are left out by Spark, which counts them
(``numRowsDroppedByWatermark``); ``online`` has scorers that mark such rows instead. A row without ``tie`` is a heartbeat:
it moves the watermark and is not scored. A stream that has ended is flushed by a heartbeat in a further run on the same checkpoint.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fieldhush.streaming.online import Run, scorer_run, self_updating_run

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
_CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"

#: Rows of a recorder that a task gathers before it writes them to the state.
PART_ROWS = 1 << 18


@contextmanager
def rocks_state(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, in so many partitions if given; the session's own settings come back afterwards.

    A micro-batch writes its changes to the checkpoint; Spark writes whole snapshots of the state now and then.
    """
    wanted = {_PROVIDER: ROCKS, _CHANGES: "true"} | ({_PARTITIONS: str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def state_partitions(rows: DataFrame, rec: str) -> int:
    """Partitions for the state of the recorders of ``rows``, at most the session's number.

    Every micro-batch opens and commits the state of every partition, whether a recorder lies in it or not. Where recorders are few, this is
    the least number up to four times theirs in which the fewest of them share a partition, by the hash that Spark deals them with.
    """
    most = int(rows.sparkSession.conf.get(_PARTITIONS))
    codes = [r[0] for r in rows.select(F.hash(rec)).distinct().limit(most).collect()]
    if 4 * len(codes) >= most:
        return most
    return min(range(max(len(codes), 1), 4 * len(codes) + 2), key=lambda n: max(Counter(c % n for c in codes).values(), default=0))


class _Timed(StatefulProcessor):
    """Rows of a key by time bucket, scored bucket by bucket when the bucket's timer fires."""

    def __init__(self, rec: str, t: str, tie: str, values: list[str], out: list[T.StructField], run: Run, width: int):
        self.rec, self.t, self.tie, self.values, self.out, self.run, self.width = rec, t, tie, values, out, run, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "memory array<double>")
        # A bucket's rows wait in parts, so that rows that come do not touch those that wait; "parts" counts them.
        self.waiting = handle.getMapState("waiting", "bucket long, part int", "t binary, tie binary, x binary")
        self.parts = handle.getMapState("parts", "bucket long", "n int")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.memory.update(([float(v) for v in initialState["memory"].iloc[0]],))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        come, n = [], 0
        for pdf in rows:
            pdf = pdf[pdf[self.tie].notna() & pdf[self.t].notna()]
            come.append((pdf[self.t].to_numpy(np.int64), pdf[self.tie].to_numpy(np.int64), pdf[self.values].to_numpy(float)))
            n += len(pdf)
            if n >= PART_ROWS:
                self._wait(come)
                come, n = [], 0
        if n:
            self._wait(come)
        yield pd.DataFrame(columns=self._names())

    def _wait(self, come: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Add a part to every bucket that has rows; each call of the state is a message to Spark, so frames are not written one by one."""
        t, tie, x = (np.concatenate(c) for c in zip(*come))
        bucket = t // self.width
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            known = (int(bucket[part[0]]),)
            n = self.parts.getValue(known)[0] if self.parts.containsKey(known) else 0
            self.waiting.updateValue((*known, n), (t[part].tobytes(), tie[part].tobytes(), x[part].tobytes()))
            self.parts.updateValue(known, (n + 1,))
            if not n:
                self.handle.registerTimer((known[0] + 1) * self.width * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = (expiredTimerInfo.getExpiryTimeInMs() // 1000 // self.width - 1,)
        if not self.parts.containsKey(known):
            yield pd.DataFrame(columns=self._names())
            return
        held = []
        for k in range(self.parts.getValue(known)[0]):
            held.append(self.waiting.getValue((*known, k)))
            self.waiting.removeKey((*known, k))
        self.parts.removeKey(known)
        t, tie, x = (np.concatenate([np.frombuffer(h[j], kind) for h in held]) for j, kind in enumerate((np.int64, np.int64, float)))
        x = x.reshape(len(t), len(self.values))
        order = np.lexsort((tie, t))
        memory = list(self.memory.get()[0]) if self.memory.exists() else []
        got, memory = self.run(memory, x[order])
        self.memory.update(([float(v) for v in memory],))
        pdf = pd.DataFrame({self.rec: key[0], self.tie: tie[order], self.t: t[order]})
        for j, f in enumerate(self.out):
            pdf[f.name] = got[:, j].astype(int) if isinstance(f.dataType, T.IntegerType) else got[:, j]
        yield pdf

    def _names(self) -> list[str]:
        return [self.rec, self.tie, self.t, *[f.name for f in self.out]]

    def close(self) -> None:
        pass


def _timed(stream: DataFrame, rec: str, t: str, tie: str, values: Sequence[str], out: list[T.StructField], run: Run, lateness: int, width: int, seed: DataFrame | None) -> DataFrame:
    spark, values = stream.sparkSession, list(values)
    if spark.conf.get(_PROVIDER, "") != ROCKS:
        raise ValueError(f"set {_PROVIDER} to {ROCKS}")
    rows = stream.select(rec, t, tie, *values, F.timestamp_seconds(t).alias("__at")).withWatermark("__at", f"{lateness} seconds")
    schema = T.StructType([*[T.StructField(n, stream.schema[n].dataType) for n in (rec, tie, t)], *out])
    first = seed.select(rec, "memory").groupBy(rec) if seed is not None else None
    return rows.groupBy(rec).transformWithStateInPandas(_Timed(rec, t, tie, values, out, run, width), schema, "Append", "EventTime", first)


def timed_scorer(stream: DataFrame, rec: str, t: str, tie: str, value: str, n: int = 20, cut: float = 1.5, votes: int = 5, need: int = 3, lateness: int = 0, width: int = 21600, seed: DataFrame | None = None) -> DataFrame:
    """(rec, tie, t, z, alert): z against the last ``n`` values, alert when ``need`` of the last ``votes`` rows exceed ``cut``. ``seed`` (rec, memory) is ``scorer_seed`` of history."""
    return _timed(stream, rec, t, tie, [value], [T.StructField("z", T.DoubleType()), T.StructField("alert", T.IntegerType())], scorer_run(n, cut, votes, need), lateness, width, seed)


def timed_self_updating(stream: DataFrame, rec: str, t: str, tie: str, values: Sequence[str], n: int = 20, threshold: float = 2.5, lateness: int = 0, width: int = 21600, seed: DataFrame | None = None) -> DataFrame:
    """(rec, tie, t, z_<value> ...): the self-updating baseline. ``seed`` (rec, memory) holds the accepted rows of history, oldest first, flat."""
    out = [T.StructField(f"z_{v}", T.DoubleType()) for v in values]
    return _timed(stream, rec, t, tie, values, out, self_updating_run(len(values), n, threshold), lateness, width, seed)


def scorer_seed(history: DataFrame, rec: str, t: str, tie: str, value: str, n: int = 20, cut: float = 1.5, votes: int = 5, need: int = 3) -> DataFrame:
    """(rec, memory) of a scorer that has seen ``history``: made from the last n + votes rows of each recorder."""
    run = scorer_run(n, cut, votes, need)
    last = Window.partitionBy(rec).orderBy(F.desc(t), F.desc(tie))
    rows = history.select(rec, t, tie, value).withColumn("__rn", F.row_number().over(last)).filter(F.col("__rn") <= n + votes)

    def memory(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values([t, tie])[[value]].to_numpy(float)
        return pd.DataFrame({rec: [key[0]], "memory": [run([], x)[1]]})

    return rows.groupBy(rec).applyInPandas(memory, T.StructType([history.schema[rec], T.StructField("memory", T.ArrayType(T.DoubleType()))]))
