"""Sound measures of clips, computed batch by batch inside Spark tasks.

A job takes (sample rate, samples) rows, either decoded arrays or WAV bytes, so a clip's samples need
never become a column. Keep ``spark.sql.execution.arrow.maxRecordsPerBatch`` near a few hundred for
3-second clips: a batch is what one task holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fieldhush.sources.audio import decode_bytes, slices

Measure = Callable[[np.ndarray, float], dict]
FLOOR = 1e-15

# Band limits in Hz.
LOW, BIRD, HIGH, HUMAN = (50, 1500), (2000, 8000), (8000, 16000), (1000, 2000)
MEASURES = ("total_db", "low_db", "bird_db", "high_db", "ndsi", "aci", "entropy")
FRAME_FEATURES = ("centroid_mean", "centroid_std", "rolloff_mean", "rolloff_std", "bandwidth_mean", "bandwidth_std", "zcr_mean", "zcr_std",
                  "rms_mean", "rms_std", "silence_fraction", "spec_entropy_mean", "spec_entropy_std", "temporal_entropy")


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def tukey(n: int, share: float = 0.25) -> np.ndarray:
    """Periodic tapered cosine window."""
    x = np.arange(n) / n
    edge = share / 2
    rise = 0.5 * (1 - np.cos(np.pi * np.minimum(x, 1 - x) / edge))
    return np.where((x < edge) | (x > 1 - edge), rise, 1.0)


def power_frames(y: np.ndarray, fs: float, size: int, window: Callable[[int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided power density (frequency x frame): half-overlapping frames, each with its mean removed."""
    n = min(size, len(y))
    step = n - n // 2
    frames = np.lib.stride_tricks.sliding_window_view(y, n)[::step]
    w = window(n)
    spec = np.abs(np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 / (fs * (w * w).sum())
    spec[:, 1: -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / fs), spec.T


@dataclass(frozen=True)
class Bands:
    """Totals of a power spectrum over frequency bands, from one pass over the frames.

    Per band: ``bins``, ``power`` (sum over its bins of the mean over frames), and ``change`` (sum over its bins of the total
    variation over frames divided by the bin's total). All measures of a clip are ratios of these.
    """

    bins: np.ndarray
    power: np.ndarray
    change: np.ndarray

    def level(self, i: int) -> float:
        """Mean power of a band's bins in dB."""
        return float(10 * np.log10(self.power[i] / self.bins[i] + FLOOR)) if self.bins[i] else float("nan")


def bands_of(f: np.ndarray, frames: np.ndarray, limits: Sequence[tuple[float, float]]) -> Bands:
    """Bands ``[low, high)`` may overlap; every bin's totals are summed up once and a band is a difference of two sums."""
    edge = np.searchsorted(f, np.asarray(limits, float))
    lifted = frames + FLOOR
    per_bin = np.stack([np.ones(len(f)), frames.mean(axis=1), np.abs(np.diff(lifted, axis=1)).sum(axis=1) / lifted.sum(axis=1)])
    sums = np.concatenate([np.zeros((3, 1)), np.cumsum(per_bin, axis=1)], axis=1)
    return Bands(*(sums[:, edge[:, 1]] - sums[:, edge[:, 0]]))


def soundscape(y: np.ndarray, fs: float) -> dict:
    """The published indices as ratios of band totals.

    Levels are the mean power of a band. NDSI is the contrast of biological and human-made power (Kasten et al. 2012). The
    complexity index is the change over frames relative to the total, summed over the bins of the bird band (Pieretti et al. 2011).
    Entropy is the Shannon entropy of the mean spectrum over that of a flat one (Sueur et al. 2008).
    """
    f, frames = power_frames(y, fs, 1024, tukey)
    everything, low, bird, high, human = range(5)
    b = bands_of(f, frames, [(-1.0, np.inf), LOW, BIRD, HIGH, HUMAN])
    spectrum = frames.mean(axis=1)
    total = spectrum.sum()
    # With S = sum p and H = log S - sum(p log p) / S no share has to be formed; an empty bin adds nothing.
    used = spectrum[spectrum > 0]
    entropy = (np.log(total) - (used * np.log(used)).sum() / total) / np.log(len(f)) if total > 0 else 0.0
    out = {f"{name}_db": b.level(i) for name, i in (("total", everything), ("low", low), ("bird", bird), ("high", high))}
    contrast = (b.power[bird] - b.power[human]) / (b.power[bird] + b.power[human] + FLOOR)
    return out | {"ndsi": float(contrast), "aci": float(b.change[bird]), "entropy": float(entropy)}


def edges_every(hz: float, top: float = 16000.0, low: float = 0.0) -> list[float]:
    """Band edges of equal width from ``low`` to ``top``."""
    return [low + i * hz for i in range(int(round((top - low) / hz)) + 1)]


# The eight pitch groups, in Hz.
PITCH_GROUPS = (0, 1000, 2000, 4000, 6000, 8000, 11000, 14000, 16000)


def banded_power(edges: Sequence[float], size: int = 2048, log: bool = False, centre: bool = False) -> Measure:
    """Welch power averaged over ``[edge, next edge)`` bands; bands without a bin give NaN."""
    limits = list(zip(edges[:-1], edges[1:]))

    def measure(y: np.ndarray, fs: float) -> dict:
        b = bands_of(*power_frames(y - y.mean() if centre else y, fs, size, hann), limits)
        out = np.divide(b.power, b.bins, out=np.full(len(limits), np.nan), where=b.bins > 0)
        return {"power": np.log10(np.maximum(out, 0) + FLOOR) if log else out}

    return measure


def frame_features(y: np.ndarray, fs: float, size: int = 2048, hop: int = 512) -> dict:
    """Mean and std over centred frames of the spectral shape, zero crossings and energy, with three entropies and silence."""
    half = size // 2
    frames = lambda mode: np.lib.stride_tricks.sliding_window_view(np.pad(y, half, mode=mode), size)[::hop]
    mag = np.abs(np.fft.rfft(frames("constant") * hann(size), axis=1))
    f = np.fft.rfftfreq(size, 1 / fs)
    total = mag.sum(axis=1)
    share = mag / np.maximum(total, 1e-10)[:, None]
    centroid = share @ f
    width = np.sqrt((share * (f[None, :] - centroid[:, None]) ** 2).sum(axis=1))
    cum = np.cumsum(mag, axis=1)
    rolloff = f[(cum >= 0.85 * cum[:, -1:]).argmax(axis=1)]
    edge = np.signbit(frames("edge"))
    zcr = (edge[:, 1:] != edge[:, :-1]).sum(axis=1) / size
    rms = np.sqrt((frames("constant") ** 2).mean(axis=1))
    power = mag ** 2
    q = power / (power.sum(axis=1, keepdims=True) + 1e-10)
    ent = -(q * np.log(q + 1e-10)).sum(axis=1)
    r = rms / (rms.sum() + 1e-10) + 1e-10
    r = r / r.sum()
    pairs = [v for a in (centroid, rolloff, width, zcr, rms) for v in (a.mean(), a.std())]
    values = [*pairs, (rms < 0.01).mean(), ent.mean(), ent.std(), -(r * np.log(r)).sum()]
    return {k: float(v) for k, v in zip(FRAME_FEATURES, values)}


def signal_job(df: DataFrame, measure: Measure, fields: Sequence[T.StructField], keep: Sequence[str], wave: str = "wave", sr: str = "sr",
               content: str | None = None) -> DataFrame:
    """``keep`` columns plus the measures of each clip; clips that cannot be read or hold fewer than two samples get nulls.

    With ``content`` the clips are WAV bytes and are decoded in the same pass, a slice of bounded size at a time.
    """
    keep = list(keep)
    names = [f.name for f in fields]
    schema = T.StructType([*[df.schema[c] for c in keep], *fields])

    def measured(clips) -> dict[str, list]:
        rows = []
        for clip in clips:
            ok = clip is not None and clip[1] is not None and len(clip[1]) >= 2
            rows.append(measure(np.asarray(clip[1], float), float(clip[0])) if ok else dict.fromkeys(names))
        return {n: [r[n] for r in rows] for n in names}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[keep].copy().assign(**measured(zip(pdf[sr], pdf[wave])))

    def run_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(f.dataType) for f in fields]
        for b in slices(batches, content):
            out = measured(decode_bytes(c.as_py()) for c in b.column(content))
            # As pandas has it, a measure that is not a number is null.
            made = [pa.array(out[n], t, from_pandas=True) for n, t in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], schema.fieldNames())

    if content:
        return df.select(*keep, content).mapInArrow(run_bytes, schema)
    return df.select(*keep, sr, wave).mapInPandas(run, schema)


def doubles(names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


ARRAY_POWER = [T.StructField("power", T.ArrayType(T.DoubleType()))]


def cut_windows(df: DataFrame, keep: Sequence[str], onsets: str | Column, seconds: float = 0.2, wave: str = "wave", sr: str = "sr") -> DataFrame:
    """(keep, seg_idx, onset, segment): fixed-length slices at the onsets; those that reach the end of the clip are dropped."""
    o = F.col(onsets) if isinstance(onsets, str) else onsets
    rows = df.select(*keep, sr, wave, F.posexplode(o).alias("seg_idx", "onset"))
    first, last = F.floor(F.col("onset") * F.col(sr)).cast("int"), F.floor((F.col("onset") + seconds) * F.col(sr)).cast("int")
    return rows.filter(last < F.size(wave)).select(*keep, "seg_idx", "onset", F.slice(wave, first + 1, last - first).alias("segment"))
