"""Token files in bit-plane form.

Ids are stored in blocks of a fixed number. A block is transposed: all lowest bytes (or bits) first, then all second ones,
and so on, which puts the nearly constant high planes next to each other. Each plane is compressed with Zstandard. Layout:

    magic | planes of block 0 | planes of block 1 | ... | document table | chunk index | lengths of both (2 x u64) | magic

The document table is an Arrow stream (key, number of ids), the chunk index JSON: ids per block, width, plane kind,
and for each block its number of ids and the offset and size of each plane. Any id range can be read from the few blocks it is in.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldhush.llm import files
from fieldhush.llm.tokens import encoded, vocabulary
from fieldhush.sources.scratch import scratch_dir

MAGIC = b"FHPLANE1"
BLOCK_IDS = 1 << 16
WIDTH = 4


def split_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """Planes of unsigned 32-bit ids, lowest first: 4 of bytes, or 32 of bits packed 8 to a byte."""
    b = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, WIDTH)
    if kind == "byte":
        return [np.ascontiguousarray(b[:, i]).tobytes() for i in range(WIDTH)]
    bits = np.unpackbits(b, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(8 * WIDTH)]


def join_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    if kind == "byte":
        b = np.stack([np.frombuffer(p, np.uint8) for p in planes], 1)
    else:
        b = np.packbits(np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], 1), axis=1, bitorder="little")
    return np.ascontiguousarray(b).view("<u4").ravel()


class PlaneWriter:
    def __init__(self, stream, block_ids: int = BLOCK_IDS, kind: str = "byte", level: int = 3) -> None:
        self.stream, self.block_ids, self.kind = stream, block_ids, kind
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.chunks: list[dict] = []
        self.held = bytearray()
        self.at = len(MAGIC)
        self.n_ids = 0
        stream.write(MAGIC)

    def add(self, ids: bytes) -> None:
        self.held += ids
        self.n_ids += len(ids) // WIDTH
        size = self.block_ids * WIDTH
        cut = len(self.held) - len(self.held) % size
        for i in range(0, cut, size):
            self._block(bytes(self.held[i : i + size]))
        del self.held[:cut]

    def _block(self, raw: bytes) -> None:
        planes = []
        for p in split_planes(np.frombuffer(raw, "<u4"), self.kind):
            z = self.zstd.compress(p)
            self.stream.write(z)
            planes.append([self.at, len(z)])
            self.at += len(z)
        self.chunks.append({"n": len(raw) // WIDTH, "planes": planes})

    def close(self, documents: pa.Table) -> None:
        if self.held:
            self._block(bytes(self.held))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, documents.schema) as w:
            w.write_table(documents)
        table = self.zstd.compress(sink.getvalue().to_pybytes())
        index = self.zstd.compress(json.dumps({"block_ids": self.block_ids, "width": WIDTH, "kind": self.kind, "chunks": self.chunks}).encode())
        self.stream.write(table + index + struct.pack("<QQ", len(table), len(index)) + MAGIC)
        self.stream.close()


class PlaneFile:
    def __init__(self, source) -> None:
        self.source = source
        end = source.size()
        tail = self._bytes(end - 16 - len(MAGIC), 16 + len(MAGIC))
        if tail[16:] != MAGIC or self._bytes(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a bit-plane file, or cut short")
        n_table, n_index = struct.unpack("<QQ", tail[:16])
        self.zstd = zstandard.ZstdDecompressor()
        at = end - 16 - len(MAGIC) - n_index
        self.index = json.loads(self.zstd.decompress(self._bytes(at, n_index)))
        self.documents = pa.ipc.open_stream(self.zstd.decompress(self._bytes(at - n_table, n_table))).read_all()

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, i: int) -> np.ndarray:
        c = self.index["chunks"][i]
        return join_planes([self.zstd.decompress(self._bytes(a, n)) for a, n in c["planes"]], c["n"], self.index["kind"])

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n``, from their blocks alone."""
        size = self.index["block_ids"]
        parts = [self.block(i)[max(0, start - i * size) : start + n - i * size] for i in range(start // size, -(-(start + n) // size))]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS, kind: str = "byte") -> None:
    """Files of all documents' ids in ascending key order under ``path``, with a manifest that orders the files.

    A null or empty text is the end id alone. Null keys come first; rows of one key are ordered by their text. An empty table
    gives an empty manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name, keys, counts, kinds = None, "", [], [], None
        for part, ids in encoded(batches, tokenizer):
            if writer is None:
                name, stream = files.create(f"{path}/data", ".planes")
                writer = PlaneWriter(stream, block_ids, kind)
            kinds = part["key"].type
            keys.append(part["key"])
            for x in ids:
                writer.add(x)
                counts.append(len(x) // WIDTH)
        if writer is not None:
            table = pa.table({"key": pa.chunked_array(keys, kinds), "n": pa.array(counts, pa.int64())})
            writer.close(table)
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [name], "ids": [writer.n_ids], "documents": [len(counts)]})

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    # The range bounds come from a sample of the keys; rows of one key stay together in one file.
    placed = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    placed.mapInArrow(write, "part long, path string, ids long, documents long").write.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """key, start, n_tokens, ids of each document, read from the files; ``start`` counts the ids of all earlier documents."""
    manifest = spark.read.schema("part long, path string, ids long, documents long").parquet(f"{path}/manifest")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    listed = manifest.select("path", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch["path"].to_pylist(), batch["first"].to_pylist(), strict=True):
                with files.open_read(name) as source:
                    yield from _documents(PlaneFile(source), first)

    return listed.repartition(_tasks(spark), "path").mapInArrow(read, f"`{key}` {kind}, start long, n_tokens long, ids binary")


def _tasks(spark: SparkSession) -> int:
    return 4 * spark.sparkContext.defaultParallelism


def _documents(f: PlaneFile, first: int, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Blocks are decoded in order, each once; what is held is one block and the documents of one batch."""
    held, block, out, start = b"", 0, [], first
    keys, counts = f.documents["key"], f.documents["n"].to_pylist()

    def batch(i: int) -> pa.RecordBatch:
        n = len(out)
        k = keys.slice(i - n, n).combine_chunks()
        return pa.RecordBatch.from_arrays([k if isinstance(k, pa.Array) else pa.concat_arrays(k.chunks), pa.array([o[0] for o in out], pa.int64()),
                                           pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], names=["key", "start", "n_tokens", "ids"])

    at = 0
    for i, n in enumerate(counts):
        parts = []
        need = n * WIDTH
        while need > len(held) - at:
            parts.append(held[at:])
            need -= len(held) - at
            held, at, block = f.block(block).tobytes(), 0, block + 1
        parts.append(held[at : at + need])
        at += need
        out.append((start, n, b"".join(parts)))
        start += n
        if len(out) == rows:
            yield batch(i + 1)
            out.clear()
    if out:
        yield batch(len(counts))


def token_file(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to a new folder of the shared scratch folder and read the files back."""
    path = f"{scratch_dir(docs.sparkSession)}/planes-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer or vocabulary("byte_bpe_50k.json"), key, text)
    return read_tokens(docs.sparkSession, path, key, dict(docs.dtypes)[key])
