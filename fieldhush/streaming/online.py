"""The rolling scorer and the self-updating baseline as stateful streams, one state per recorder.

Files and partitions need not be in time order. A recorder's rows wait in its state until a row ``lateness`` later has come, and are
then scored in time order, so any mix of files within that time gives the result of one sorted file. A row that
comes after its place was scored is still scored, against the state as it is, and marked ``late``; no row is dropped. A row
without ``tie`` is a heartbeat: it moves the recorder's clock and is not scored, which releases what waits at the end of a stream.

State holds the last values and flags and the rows of the last ``lateness``. Bound a micro-batch with ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldhush.operators.series import LEAST_STD, self_update_run

#: (memory, values in order) -> (one row of results per row, new memory); memory is a flat list of doubles.
Run = Callable[[list[float], np.ndarray], tuple[np.ndarray, list[float]]]

_STATE = T.StructType([T.StructField(n, T.ArrayType(t)) for n, t in (
    ("memory", T.DoubleType()), ("held_t", T.LongType()), ("held_tie", T.LongType()), ("held", T.DoubleType()), ("last", T.LongType()))])


def _ordered(stream: DataFrame, rec: str, t: str, tie: str, values: Sequence[str], out: Sequence[T.StructField], run: Run, lateness: int) -> DataFrame:
    values, names = list(values), [f.name for f in out]
    width = len(values)
    out_t = T.StructType([*[stream.schema[n] for n in (rec, tie, t)], *out, T.StructField("late", T.IntegerType())])

    def frame(key, tt: np.ndarray, ties: np.ndarray, got: np.ndarray, late: int) -> pd.DataFrame:
        pdf = pd.DataFrame({rec: key[0], tie: ties, t: tt})
        for j, f in enumerate(out):
            pdf[f.name] = got[:, j].astype(int) if isinstance(f.dataType, T.IntegerType) else got[:, j]
        return pdf.assign(late=late)[[rec, tie, t, *names, "late"]]

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, ht, hk, hv, last = ([list(x) for x in state.get] if state.exists else [[], [], [], [], []])
        rows = [p[[t, tie, *values]] for p in parts if len(p)]
        if not rows:
            return
        pdf = pd.concat(rows, ignore_index=True)
        horizon = int(pdf[t].max()) - lateness
        if last:
            horizon = max(horizon, last[0])
        pdf = pdf[pdf[tie].notna()]
        held = pd.DataFrame(np.reshape(hv, (-1, width)), columns=values).assign(**{t: ht, tie: hk})
        pdf = pd.concat([held[[t, tie, *values]], pdf.astype({tie: "int64"})], ignore_index=True) if len(held) else pdf.astype({tie: "int64"})
        pdf = pdf.sort_values([t, tie], kind="stable")
        tt, ties, x = pdf[t].to_numpy(np.int64), pdf[tie].to_numpy(np.int64), pdf[values].to_numpy(float)
        # The last row scored: a row before it comes too late for its place.
        late = (tt < last[1]) | ((tt == last[1]) & (ties <= last[2])) if len(last) == 3 else np.zeros(len(tt), bool)
        due = (tt <= horizon) & ~late
        if late.any():
            yield frame(key, tt[late], ties[late], np.concatenate([run(memory, r[None])[0] for r in x[late]]), 1)
        place = last[1:]
        if due.any():
            got, memory = run(memory, x[due])
            place = [int(tt[due][-1]), int(ties[due][-1])]
            yield frame(key, tt[due], ties[due], got, 0)
        wait = ~due & ~late
        state.update((memory, tt[wait].tolist(), ties[wait].tolist(), x[wait].ravel().tolist(), [horizon, *place]))

    return stream.groupBy(rec).applyInPandasWithState(step, out_t, _STATE, "append", GroupStateTimeout.NoTimeout)


def scorer_run(n: int, cut: float, votes: int, need: int) -> Run:
    """z of each value against the last ``n`` before it, and the alert. Memory: number of values, then those, then the flags."""

    def run(memory: list[float], x: np.ndarray) -> tuple[np.ndarray, list[float]]:
        k = int(memory[0]) if memory else 0
        past, flags = np.array(memory[1 : 1 + k]), np.array(memory[1 + k :])
        all_ = np.concatenate([past, x[:, 0]])
        shift = all_.mean()
        total, square = (np.concatenate([[0.0], np.cumsum((all_ - shift) ** p)]) for p in (1, 2))
        hi = np.arange(k, len(all_))
        lo = np.maximum(hi - n, 0)
        m = np.maximum(hi - lo, 1)
        mean = (total[hi] - total[lo]) / m
        std = np.sqrt(np.maximum((square[hi] - square[lo]) / m - mean**2, 0))
        z = np.where(hi - lo >= 2, (all_[hi] - shift - mean) / np.maximum(std, LEAST_STD), 0.0)
        f = np.concatenate([flags, (np.abs(z) > cut).astype(float)])
        c = np.concatenate([[0.0], np.cumsum(f)])
        end = np.arange(len(flags), len(f)) + 1
        alert = (c[end] - c[np.maximum(end - votes, 0)] >= need).astype(float)
        keep = all_[-n:]
        return np.stack([z, alert], 1), [float(len(keep)), *keep.tolist(), *f[-votes:].tolist()]

    return run


def self_updating_run(width: int, n: int, threshold: float) -> Run:
    """z of each row against the accepted ones before it. Memory: the last ``n`` accepted rows, flat."""

    def run(memory: list[float], x: np.ndarray) -> tuple[np.ndarray, list[float]]:
        z, buf = self_update_run([memory[i : i + width] for i in range(0, len(memory), width)], x, n, threshold)
        return z, [float(v) for row in buf for v in row]

    return run


def online_scorer(stream: DataFrame, rec: str, t: str, tie: str, value: str, n: int = 20, cut: float = 1.5, votes: int = 5, need: int = 3, lateness: int = 0) -> DataFrame:
    """(rec, tie, t, z, alert, late): z against the last ``n`` values, alert when ``need`` of the last ``votes`` rows exceed ``cut``."""
    return _ordered(stream, rec, t, tie, [value], [T.StructField("z", T.DoubleType()), T.StructField("alert", T.IntegerType())], scorer_run(n, cut, votes, need), lateness)


def online_self_updating(stream: DataFrame, rec: str, t: str, tie: str, values: Sequence[str], n: int = 20, threshold: float = 2.5, lateness: int = 0) -> DataFrame:
    """(rec, tie, t, z_<value> ..., late): the self-updating baseline on a stream; equals the batch operator."""
    return _ordered(stream, rec, t, tie, values, [T.StructField(f"z_{v}", T.DoubleType()) for v in values], self_updating_run(len(values), n, threshold), lateness)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, partitions: Sequence[str] = ()) -> None:
    """Process what is there and stop; progress is kept in ``checkpoint``, so the next run goes on from there."""
    w = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    w = w.partitionBy(*partitions) if partitions else w
    w.trigger(availableNow=True).start().awaitTermination()
