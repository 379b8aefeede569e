"""Ordered row windows that do not depend on how rows are spread over the keys.

``Window.partitionBy(recorder).orderBy(t)`` puts a whole recorder into one task. Here the rows are
range-partitioned by (keys, order), numbered in that order, and cut into blocks of equal row count.
Each block also receives the few neighbouring rows its frames reach into (the halo), so a frame of
at most ``before`` rows back and ``after`` rows ahead gives the same answer as the unbounded window.
Running totals are the in-block total plus the carry of all earlier blocks of the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fieldhush.sources.scratch import materialize

BLOCK_ROWS = 1 << 18
_POS, _HOME, _BLK = "__pos", "__home", "__blk"
_SEQ_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def _asc(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Add ``__pos``: 0, 1, 2 ... over all rows in (by, order). ``order`` must make rows unique."""
    keys = [F.col(c) for c in by] + [_asc(c) for c in order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The range bounds come from a sample, so the placement is written before it is used twice.
    placed = materialize(placed.withColumn("__mid", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__mid", _SEQ_BITS)
    # One row per range partition: its size is the partition count, whatever the data.
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    pos = F.col("__start") + F.col("__mid").bitwiseAND((1 << _SEQ_BITS) - 1)
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(start), "__part")
        .withColumn(_POS, pos)
        .drop("__part", "__mid", "__start")
    )


@dataclass(frozen=True)
class Ordered:
    """Rows in blocks. Use ``window`` for frames on ``df``, then ``home`` to drop the halo."""

    df: DataFrame
    by: tuple[str, ...]
    numbered: DataFrame
    block_rows: int

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(_BLK, *self.by).orderBy(_POS)

    def home(self, df: DataFrame, keep_pos: bool = False) -> DataFrame:
        df = df.filter(F.col(_BLK) == F.col(_HOME))
        return df.drop(_BLK, _HOME) if keep_pos else df.drop(_BLK, _HOME, _POS)


def ordered(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    before: int = 0,
    after: int = 0,
    block_rows: int | None = None,
) -> Ordered:
    """Cut ``df`` into equal blocks in (by, order) with a halo of ``before`` and ``after`` rows."""
    return reblock(number_rows(df, by, order), by, before, after, block_rows)


def reblock(
    numbered: DataFrame,
    by: Sequence[str],
    before: int = 0,
    after: int = 0,
    block_rows: int | None = None,
) -> Ordered:
    """Blocks over rows that already carry ``__pos``."""
    size = max(block_rows or BLOCK_ROWS, before, after, 1)
    home = F.expr(f"{_POS} div {size}")
    rows = numbered.withColumn(_HOME, home)
    if before or after:
        inner = F.col(_POS) % size
        into = F.array(
            F.col(_HOME),
            F.when(inner >= size - before, F.col(_HOME) + 1),
            F.when(inner < after, F.col(_HOME) - 1),
        )
        rows = rows.withColumn(_BLK, F.explode(F.array_compact(into)))
    else:
        rows = rows.withColumn(_BLK, F.col(_HOME))
    return Ordered(rows, tuple(by), numbered, size)


def running(o: Ordered, totals: dict[str, tuple[str, str]], current: bool = True, reverse: bool = False) -> DataFrame:
    """Running ``sum``/``max``/``min``/``last``/``next`` over the rows of each key.

    ``totals`` maps a new column to (kind, source column). ``last`` is the most recent non-null value
    and ``next`` the first one ahead. ``current`` includes the row itself; ``reverse`` runs the totals
    from the last row backwards. The per-block summary has one row for each block and key in it, so
    the carry never holds the rows themselves.
    """
    base = o.df.filter(F.col(_BLK) == F.col(_HOME))
    end = 0 if current else -1
    picks = ("last", "next")
    agg = {"sum": F.sum, "max": F.max, "min": F.min}

    def frame(part: Sequence[str], at: str, kind: str, stop: int) -> WindowSpec:
        backwards = reverse or kind == "next"
        w = Window.partitionBy(*part).orderBy(F.col(at).desc() if backwards else F.col(at))
        return w.rowsBetween(Window.unboundedPreceding, stop)

    def over(kind: str, c: str, w: WindowSpec) -> Column:
        return (F.last(c, ignorenulls=True) if kind in picks else agg[kind](c)).over(w)

    def whole(kind: str, c: str) -> Column:
        if kind not in picks:
            return agg[kind](c)
        edge = F.min_by if reverse or kind == "next" else F.max_by
        return edge(c, F.when(F.col(c).isNotNull(), F.col(_POS)))

    summary = base.groupBy(_BLK, *o.by).agg(*[whole(k, c).alias(f"__s_{n}") for n, (k, c) in totals.items()])
    carry = summary.select(
        F.col(_BLK).alias("__cb"),
        *[F.col(c).alias(f"__c_{c}") for c in o.by],
        *[over(k, f"__s_{n}", frame(o.by, _BLK, k, -1)).alias(f"__k_{n}") for n, (k, _) in totals.items()],
    )
    out = base.select("*", *[over(k, c, frame([_BLK, *o.by], _POS, k, end)).alias(f"__i_{n}") for n, (k, c) in totals.items()])
    cond = F.col(_BLK) == F.col("__cb")
    for c in o.by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__c_{c}"))
    out = out.join(carry, cond, "left")
    join_up = {"sum": lambda i, k: F.coalesce(i + k, i, k), "max": F.greatest, "min": F.least,
               "last": F.coalesce, "next": F.coalesce}
    for n, (kind, _) in totals.items():
        out = out.withColumn(n, join_up[kind](F.col(f"__i_{n}"), F.col(f"__k_{n}")))
    drop = ["__cb", _BLK, _HOME] + [f"__c_{c}" for c in o.by]
    drop += [f"__{p}_{n}" for p in "ik" for n in totals]
    return out.drop(*drop)
