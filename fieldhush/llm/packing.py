"""Best-two-fit packing of token pieces into sequences of a fixed capacity.

What packing depends on is the number of pieces of each length: at most ``capacity`` numbers, however large the corpus. A
sequence is filled greedily with the longest piece that fits, again and again. Then its smallest piece is put back if two
unpacked pieces fill the gap it leaves more tightly. The pattern found is used as often as its lengths allow, so whole
classes of equal sequences are planned at once. Spark numbers the pieces in the order of their lengths, and a piece's number
says which pattern, sequence and offset are its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhush.llm.tokens import token_pieces, vocabulary
from fieldhush.operators.blocks import number_rows
from fieldhush.sources.scratch import materialize

CAPACITY = 2048


def _longest(have: np.ndarray) -> np.ndarray:
    """For each x the largest available length <= x, or 0."""
    return np.maximum.accumulate(np.where(have > 0, np.arange(len(have)), 0))


def best_pair(have: np.ndarray, room: int) -> tuple[int, int]:
    """The two available lengths with the largest sum <= room, (0, 0) if there are none."""
    a = np.flatnonzero(have[: room + 1] > 0)
    a = a[a > 0]
    if not len(a):
        return 0, 0
    below = _longest(have)
    limit = np.minimum(room - a, a)
    limit = np.where((limit == a) & (have[a] < 2), a - 1, limit)
    b = below[limit]
    total = np.where(b > 0, a + b, 0)
    i = int(np.argmax(total))
    return (int(a[i]), int(b[i])) if total[i] else (0, 0)


def plan(counts: Sequence[int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences); ``counts[l]`` pieces of length ``l`` are all used up."""
    have = np.zeros(capacity + 1, np.int64)
    have[: len(counts)] = counts
    have[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    while (top := int(_longest(have)[-1])):
        left, fill, room = have.copy(), [top], capacity - top
        left[top] -= 1
        while room and (x := int(_longest(left)[room])):
            n = min(int(left[x]), room // x)
            fill += [x] * n
            left[x] -= n
            room -= n * x
        if len(fill) > 1 and room:
            small = fill.pop()
            left[small] += 1
            a, b = best_pair(left, room + small)
            fill += [a, b] if a + b > small else [small]
        lengths, used = np.unique(fill, return_counts=True)
        times = int((have[lengths] // used).min())
        have[lengths] -= times * used
        out.append((tuple(sorted(fill, reverse=True)), times))
    return out


@dataclass
class Slots:
    """Slot i holds the pieces numbered from ``start[i]`` to ``start[i + 1]``, one in each of consecutive sequences."""

    start: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def slots(counts: Sequence[int], capacity: int = CAPACITY) -> Slots:
    """Pieces are numbered by length, so each length owns a range of numbers; patterns take theirs from its front."""
    cursor = np.concatenate([[0], np.cumsum(counts)])
    rows, sequence = [], 0
    for lengths, times in plan(counts, capacity):
        offset = 0
        for x in lengths:
            rows.append((int(cursor[x]), sequence, offset))
            cursor[x] += times
            offset += x
        sequence += times
    rows.sort()
    start, seq, off = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ([], [], [])))
    return Slots(start, seq, off)


def pack(pieces: DataFrame, order: Sequence[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. Lengths are 1 to ``capacity``; ``order`` settles ties of length.

    Rows equal in length and ``order`` may swap places. An empty table stays empty.
    """
    table = materialize(pieces, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in table.groupBy(length).count().collect():  # at most one row per length
        if r[0] is None or not 1 <= r[0] <= capacity:
            raise ValueError(f"a piece has length {r[0]}; lengths must be 1 to {capacity}")
        counts[r[0]] = r[1]
    s = slots(counts, capacity)
    numbered = number_rows(table, [length], list(order))
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos = b["__pos"].to_numpy()
            i = np.searchsorted(s.start, pos, "right") - 1
            yield pa.RecordBatch.from_arrays([*[b[c] for c in names], pa.array(s.sequence[i] + pos - s.start[i]), pa.array(s.offset[i])],
                                             names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return numbered.select(*[F.col(f"`{c}`") for c in names], "__pos").mapInArrow(place, schema)


def packed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, **options) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset for each piece of every document.

    The ids themselves are left out of the shuffle; ``sequences`` puts them back.
    """
    p = token_pieces(docs, tokenizer or vocabulary("word_bpe_49k.json"), key, text, capacity, **options)
    return pack(p.select(key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), [key, "piece", "ids_crc32"], capacity=capacity)


def sequences(placed: DataFrame, pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """sequence_id, ids and the documents in it, from ``pack``'s placement and ``token_pieces``. Keys must be unique.

    A sequence holds at most ``capacity`` ids, so its group is bounded.
    """
    parts = placed.select(key, "piece", "sequence_id", "offset").join(pieces.select(key, "piece", "ids"), [key, "piece"])
    s = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", key, "piece", "ids"))).alias("p"))
    # Binary parts are joined as hex text, which the built-in functions can concatenate.
    return s.select("sequence_id", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"), F.col(f"p.{key}").alias(f"{key}s"))
