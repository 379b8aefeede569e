"""Substring deduplication by line or paragraph hashing.

Every text is split into units: lines, paragraphs between blank lines, or lines cut at sentence ends, which also
finds a passage that was pasted into the middle of a line. Units are normalised (A-Z lower-cased, runs of white space
as one space, ends trimmed) and grouped over the whole corpus by a 128-bit digest. Of each group the occurrence that
ranks first (smallest key, then smallest offset) stays; the others are removed. Neighbouring removed units form one
span. Spans are character offsets in the original text.

Units of fewer than ``min_words`` words are too short to match alone. What short units stand between two others is matched together
with both (a bridge): it goes where it repeats with them, so a passage with short sentences goes as one span, and short text
that differs stays. Units without words (white space) do not count.

Null and empty texts have no units. Rows with a null key rank last. Repeated rows are repeated text: the
later row's units go. Ties (equal key and offset) are broken by a row number written with the units.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldhush.llm.common import free_name, slim
from fieldhush.sources.scratch import materialize, sized

#: One match is one unit with its end marks.
UNITS = {"line": r"[^\n]+", "paragraph": r"(?:[^\n]|\n(?!\s*\n|\s*\Z))+", "sentence": r"[^\n.!?]+[.!?]*"}
MIN_WORDS = 4


def units(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """(row, key, pos, start, end, words, units, bridge, d0, d1) of units with at least ``min_words`` words and of the bridges between them.

    ``pos`` counts these rows of the text, so units and bridges that stand next to each other have neighbouring numbers.
    """
    pattern = re.compile(UNITS[unit])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, k, t in zip(batch["row"].to_pylist(), batch["key"].to_pylist(), batch["text"], strict=True):
                pos, before, short = 0, None, []
                for m in pattern.finditer(t.as_py() or ""):
                    w = m[0].encode().lower().split()
                    if 0 < len(w) < min_words:
                        short.append((*m.span(), len(w), b" ".join(w)))
                    elif w:
                        unit_text = b" ".join(w)
                        if before is not None and short:
                            # No unit has a line feed, so a bridge never has the digest of a unit.
                            d = digest(b"\n".join([before, *[x[3] for x in short], unit_text]))
                            out.append((row, k, pos, short[0][0], short[-1][1], sum(x[2] for x in short), len(short), True, *d))
                            pos += 1
                        out.append((row, k, pos, *m.span(), len(w), 1, False, *digest(unit_text)))
                        pos, before, short = pos + 1, unit_text, []
                if len(out) >= 50_000:
                    yield from batches_of(out)
                    out = []
            yield from batches_of(out)

    def digest(b: bytes) -> tuple[int, int]:
        d = hashlib.md5(b, usedforsecurity=False).digest()
        return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)

    def batches_of(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)

    names = ["row", "key", "pos", "start", "end", "words", "units", "bridge", "d0", "d1"]
    kind = dict(slim(docs, key).dtypes)[key]
    rows = slim(docs, *dict.fromkeys([key, text])).select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"row long, key {kind}, pos long, start long, end long, words long, units long, bridge boolean, d0 long, d1 long"
    return rows.filter("text is not null").mapInArrow(cut, schema)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "sentence", min_words: int = MIN_WORDS, min_span_words: int = 0) -> DataFrame:
    """The spans to remove: row, key, start, end, words, units, keep_key and keep_start of the first removed unit.

    A span is a run of neighbouring units and bridges that all occur earlier in the corpus; it starts and ends with a unit. Every
    later unit is in a span. With ``min_span_words``, spans of fewer words stay in the text.
    """
    table = materialize(units(docs, key, text, unit, min_words), "units")
    order = F.struct(F.col("key").isNull().alias("z"), "key", "start", "row")
    groups = table.groupBy("d0", "d1").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1").drop("n")
    later = table.join(sized(groups), ["d0", "d1"]).filter((F.col("first.row") != F.col("row")) | (F.col("first.start") != F.col("start")))
    # One text's removed units at a time, so the window never holds a group of the corpus.
    w = Window.partitionBy("row").orderBy("pos")
    # Rows that share a key rank by offset, so a bridge can be a later one next to a first unit; it then stays.
    inner = (F.lag("pos").over(w) == F.col("pos") - 1) & (F.lead("pos").over(w) == F.col("pos") + 1)
    later = later.withColumn("inner", inner).filter(~F.col("bridge") | F.coalesce("inner", F.lit(False)))
    runs = later.withColumn("run", F.col("pos") - F.row_number().over(w))
    spans = runs.groupBy("row", "run").agg(
        F.first("key").alias("key"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"),
        F.sum("units").alias("units"), F.min(F.struct("pos", F.col("first.key").alias("k"), F.col("first.start").alias("s"))).alias("f"))
    return spans.filter(F.col("words") >= min_span_words).select(
        "row", F.col("key").alias(key), "start", "end", "words", "units", F.col("f.k").alias(f"keep_{key}"), F.col("f.s").alias("keep_start"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated spans taken out of ``text`` and a column ``removed``: array of (start, end).

    A text all of which repeats becomes empty; rows are never dropped, and null texts stay null.
    """
    row = free_name(docs)
    table = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    ids = table.select(F.struct(F.col(f"`{key}`").alias("k"), F.col(row).alias("r")).alias("id"), F.col(f"`{text}`").alias("text"))
    spans = repeated_spans(ids, "id", "text", **options).groupBy(F.col("id.r").alias(row)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    joined = table.join(sized(spans), row, "left")
    # Between two removed spans lies the kept text; "end" of the one and "start" of the next bound it.
    size = F.size("removed")
    kept = F.transform(F.sequence(F.lit(0), size), lambda i: F.substring(
        F.col(f"`{text}`"), F.when(i == 0, 1).otherwise(F.get(F.col("removed.end"), i - 1) + 1).cast("int"),
        (F.when(i == size, 1 << 30).otherwise(F.get(F.col("removed.start"), i.cast("int"))) - F.when(i == 0, 0).otherwise(F.get(F.col("removed.end"), i - 1))).cast("int")))
    return joined.withColumn(text, F.when(F.col("removed").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, ""))).drop(row)
