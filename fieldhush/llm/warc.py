"""WARC archives with a Zstandard dictionary in each file.

Of records with equal payloads the one with the smallest id is written as a response, the others as revisits that refer to it and
carry no payload. A task gathers its first records up to a sample size, builds a dictionary from them, writes it as a
leading skippable frame, and compresses each record as a frame of its own, so any record can be read by its offset with
the dictionary alone. Records after the sample are written as they come; a task holds the sample and one batch.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldhush.llm import files
from fieldhush.sources.scratch import materialize, scratch_dir, sized

#: Fixed values of the formats: the skippable frame that holds a dictionary, and the profile of a revisit.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:page:"
SAMPLE_BYTES, DICTIONARY_BYTES, FILE_BYTES = 4 << 20, 64 << 10, 1 << 30


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: object, url: str | None, payload: bytes, refers_to: object, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{RECORD}{page_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url or 'urn:unknown')}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{RECORD}{refers_to}>"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; of samples too few or small to train on, their last bytes as raw content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class WarcWriter:
    def __init__(self, stream, samples: list[bytes], level: int = 3) -> None:
        self.stream = stream
        raw = build_dictionary(samples)
        stream.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        self.written = 8 + len(raw)
        self.zstd = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)

    def add(self, rec: bytes) -> None:
        z = self.zstd.compress(rec)
        self.stream.write(z)
        self.written += len(z)


def records(stream) -> Iterator[bytes]:
    """The records of a file; it is read in pieces, and one record is held."""
    magic, n = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the file does not begin with a dictionary frame")
    raw = stream.read(n)
    zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    rest = b""
    while True:
        frame, parts = zstd.decompressobj(), []
        while not frame.eof:
            rest = rest or stream.read(1 << 20)
            if not rest:
                if parts:
                    raise ValueError("the last record is cut short")
                return
            parts.append(frame.decompress(rest))
            rest = b""
        rest = frame.unused_data
        yield b"".join(parts)


def parse(rec: bytes) -> dict:
    head, _, block = rec.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = block[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
    revisit = h["WARC-Type"] == "revisit"
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != declared or payload_digest(payload) != digest):
        raise ValueError(f"{h['WARC-Record-ID']}: the payload is not the one that was archived")
    page = lambda x: None if x in (None, f"<{RECORD}None>") else int(x[len(RECORD) + 1 : -1])
    return {"record_type": h["WARC-Type"], "page_id": page(h["WARC-Record-ID"]), "url": h["WARC-Target-URI"], "payload": None if revisit else payload,
            "payload_bytes": declared, "payload_digest": digest, "refers_to": page(h.get("WARC-Refers-To"))}


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", min_payload: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archive every row of ``pages`` (integer key) under ``path``, with a manifest of the files.

    A null payload is empty. Payloads below ``min_payload`` bytes are always responses. Null keys rank last; of rows with equal
    payload and key, one is the response. An empty table gives an empty manifest.
    """
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    table = materialize(pages.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
                                     payload.alias("payload"), F.sha1(payload).alias("sha1")), "pages")
    # Only payloads that occur twice meet the pages again.
    top = F.min(F.struct(F.col("page_id").isNull().alias("z"), "page_id", "row"))
    again = table.filter(F.octet_length("payload") >= min_payload).groupBy("sha1").agg(F.count("*").alias("n"), top.alias("top")).filter("n > 1").drop("n")
    rows = table.join(sized(again), "sha1", "left")
    revisit = F.col("top").isNotNull() & (F.col("top.row") != F.col("row")) & (F.octet_length("payload") >= min_payload)
    rows = rows.select("page_id", "url", "payload", F.coalesce(revisit, F.lit(False)).alias("revisit"), F.col("top.page_id").alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream, writer, count, wait, held = "", None, None, 0, [], 0
        done = []

        def close() -> None:
            nonlocal writer, count
            if writer:
                stream.close()
                done.append((name, count))
                writer, count = None, 0

        def start() -> None:
            nonlocal name, stream, writer, wait, held
            name, stream = files.create(f"{path}/data", ".warc.zst")
            writer = WarcWriter(stream, wait)
            for x in wait:
                writer.add(x)
            wait, held = [], 0

        for b in batches:
            for page_id, u, p, again_, first in zip(*[b[c].to_pylist() for c in ("page_id", "url", "payload", "revisit", "first")], strict=True):
                rec = record(page_id, u, p, first, again_, date)
                count += 1
                if writer:
                    writer.add(rec)
                    if writer.written > FILE_BYTES:
                        close()
                else:
                    wait.append(rec)
                    held += len(rec)
                    if held >= SAMPLE_BYTES:
                        start()
        if wait:
            start()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    rows.mapInArrow(write, "path string, records long").write.parquet(f"{path}/manifest")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_type, page_id, url, payload (null for revisits), payload_bytes, payload_digest, refers_to of every record."""
    manifest = spark.read.schema("path string, records long").parquet(f"{path}/manifest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["path"].to_pylist():
                with files.open_read(name) as stream:
                    held, size = [], 0
                    for rec in records(stream):
                        held.append(parse(rec))
                        size += len(rec)
                        if size > 1 << 23:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    schema = pa.schema([("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
    n = 4 * spark.sparkContext.defaultParallelism
    return manifest.select("path").repartition(n, "path").mapInArrow(read, "record_type string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to a new folder of the shared scratch folder and read the archives back."""
    path = f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path)
