"""Audio clips as rows: WAV files listed and read by Spark, decoded batch by batch in the tasks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Format tags of the WAV header.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Bytes of clips that a task decodes at once.
SLICE_BYTES = 1 << 20


def read_wav_files(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """Recursive listing with file contents; prune it by name before decoding."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("clip_name"), "path", "content")


def _chunks(content: bytes) -> dict[bytes, bytes]:
    """The RIFF chunks; a data chunk that claims more than is there holds what is there."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    out, at = {}, 12
    while at + 8 <= len(content):
        name, size = struct.unpack_from("<4sI", content, at)
        out.setdefault(name, content[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


def _samples(kind: int, bits: int, raw: bytes) -> np.ndarray:
    """Samples as floats, full scale 1."""
    raw = raw[: len(raw) - len(raw) % max(bits // 8, 1)]
    if kind == PCM and bits == 8:
        return (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    if kind == PCM and bits in (16, 32):
        return np.frombuffer(raw, f"<i{bits // 8}") / 2.0 ** (bits - 1)
    if kind == PCM and bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8) / 2.0**31
    if kind == FLOAT and bits in (32, 64):
        return np.frombuffer(raw, f"<f{bits // 8}").astype(float)
    raise ValueError(f"samples of format {kind} with {bits} bits")


def read_wav(content: bytes | None) -> tuple[int | None, np.ndarray | None, str | None]:
    """(sample rate, mono samples as the channel mean, None), or (None, None, reason) where the clip cannot be read."""
    try:
        chunks = _chunks(content or b"")
        kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", chunks[b"fmt "])
        if kind == EXTENSIBLE:
            kind = struct.unpack_from("<H", chunks[b"fmt "], 24)[0]
        x = _samples(kind, bits, chunks[b"data"])
        x = x[: len(x) - len(x) % channels].reshape(-1, channels)
        return rate, x.mean(axis=1).astype(np.float32), None
    except KeyError as e:
        return None, None, f"no chunk {e.args[0].decode()}"
    except (ValueError, struct.error, ZeroDivisionError) as e:
        return None, None, str(e)


def decode_bytes(content: bytes | None) -> tuple[int, np.ndarray] | None:
    rate, x, reason = read_wav(content)
    return None if reason else (rate, x)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, each slice with at most about ``most`` bytes of ``column``, or one row.

    A batch holds a fixed number of rows, whatever their length. What a task makes of them is many times their size, so it takes a slice at a time.
    """
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def decode_wav(df: DataFrame, content: str = "content") -> DataFrame:
    """Replace ``content`` by ``sr``, ``wave array<float>`` and ``wav_error``: null, or why there are no samples."""
    keep = [f for f in df.schema.fields if f.name != content]
    schema = T.StructType([*keep, T.StructField("sr", T.IntegerType()), T.StructField("wave", T.ArrayType(T.FloatType())), T.StructField("wav_error", T.StringType())])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, content):
            got = [read_wav(c.as_py()) for c in b.column(content)]
            rate, wave, error = (pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int32(), pa.list_(pa.float32()), pa.string())))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), rate, wave, error], schema.fieldNames())

    return df.mapInArrow(run, schema)
