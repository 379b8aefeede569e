"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; target / size is how often each of its documents is wanted, a fraction.
The whole part of it is sure. For the fractional part two documents meet at a time: mass, counted in words, moves at
random from one to the other until one's copy probability is 0 or 1. The source's expected words never change,
and each document's expected copies stay what they were. Documents meet in buckets of bounded size first, each bucket leaves
one fraction, and the fractions meet again in the next level of a tree until one per source is left.

All random numbers are hashes of the seed and the document, and buckets are made from the document's place
in its source, so a rerun on any cluster takes the same copies.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldhush.llm.common import WORD, free_name
from fieldhush.llm.wordvec import mix as scramble
from fieldhush.sources.scratch import materialize, sized

BUCKET_ROWS = 1 << 14
FAN_IN = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``totals`` (source, source_size, docs) with ``sid`` and ``target``: weighted shares of ``share`` x all sizes.

    Weights repeat over the sources in code-point order, null last. A target stops at ``most`` x its source's size; the
    excess is shared again by weight among the others until none is above. With weights w and caps c that is min(c, level x w)
    with one level for all, found in the order of c / w by running sums. The table has one row per source.
    """
    order = Window.orderBy(F.col(source).isNull(), F.col(source).cast("string").cast("binary"))
    everything = Window.partitionBy()
    t = totals.withColumn("sid", F.row_number().over(order) - 1)
    t = t.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    t = t.withColumn("level", left / rest)
    # The first source that its level does not fill sets the level for itself and for all that come later.
    first = F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct("ratio", "sid", "level"))).over(everything)
    t = t.withColumn("first", first)
    target = F.least("cap", F.coalesce(F.col("first.level") * F.col("w"), F.col("cap")))
    return t.select(source, "source_size", "docs", "sid", target.alias("target"))


def pivotal(p: np.ndarray, size: np.ndarray, rnd: np.ndarray) -> np.ndarray:
    """Round ``p`` (0 to 1) pairwise; at most one entry of the result is fractional. sum(size * p) is kept.

    A tree over the array: in each round the entries that are still fractional meet their neighbour, all pairs at once.
    """
    p = p.copy()
    live = np.flatnonzero((p > 1e-12) & (p < 1 - 1e-12))
    step = 0
    while len(live) > 1:
        odd = live[-1:] if len(live) % 2 else live[:0]
        a, b = live[: len(live) - len(odd)].reshape(-1, 2).T
        sa, sb = size[a], size[b]
        up = np.minimum((1 - p[a]) * sa, p[b] * sb)  # words that can move from b to a
        down = np.minimum(p[a] * sa, (1 - p[b]) * sb)
        u = scramble(rnd[a] + np.full(len(a), step, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
        moved = np.where(u * 2.0**-53 * (up + down) < down, up, -down)
        pa_, pb_ = p[a] + moved / sa, p[b] - moved / sb
        # One of the two is integral now; set it exactly, whatever the last bits say.
        a_done = np.minimum(np.abs(pa_), np.abs(1 - pa_)) <= np.minimum(np.abs(pb_), np.abs(1 - pb_))
        p[a] = np.where(a_done, np.rint(pa_), np.clip(pa_, 0, 1))
        p[b] = np.where(a_done, np.clip(pb_, 0, 1), np.rint(pb_))
        met = np.stack([a, b], 1).ravel()
        live = np.concatenate([met[(p[met] > 1e-12) & (p[met] < 1 - 1e-12)], odd])
        step += 1
    return p


def _meet(level: int):
    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "rnd", "row"], kind="stable")
        rnd = scramble(pdf["rnd"].to_numpy().view(np.uint64) + np.uint64(level << 32))
        pdf["p"] = pivotal(pdf["p"].to_numpy(), pdf["size"].to_numpy(float), rnd)
        return pdf

    return meet


def copies(rows: DataFrame, seed: int = 0, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """(row, copies) for ``rows`` (row, id, sid, size, want, docs): ``want`` copies are wanted of each of the source's ``docs`` rows.

    ``row`` is unique; random numbers come from ``id`` and size alone, so they do not depend on how rows are numbered. A document
    without words has no mass to move and is not taken. The last fraction of a source is rounded at
    random, so a source misses its target by less than one document.
    """
    whole = F.floor(F.col("want") + 1e-12)
    draw = [F.xxhash64(F.lit(3 * seed + i), "id", "size") for i in range(3)]
    r = rows.filter("size > 0").select(
        "row", "sid", "size", whole.cast("long").alias("whole"), F.greatest(F.col("want") - whole, F.lit(0.0)).alias("p"), draw[0].alias("rnd"),
        F.ceil(F.col("docs") / bucket_rows).cast("long").alias("buckets"), draw[1].alias("bucket"), (F.pmod(draw[2], F.lit(1 << 40)) / float(1 << 40)).alias("last"))
    r = r.withColumn("bucket", F.pmod("bucket", "buckets"))
    schema = "row long, sid int, size long, whole long, p double, rnd long, buckets long, bucket long, last double"
    part = (F.col("p") > 1e-12) & (F.col("p") < 1 - 1e-12)
    taken = rows.filter("size <= 0").select("row", F.lit(0).cast("long").alias("copies"))
    level = 0
    while True:
        out = materialize(r.groupBy("sid", "bucket").applyInPandas(_meet(level), schema), "mixed")
        if (out.agg(F.max("buckets")).first()[0] or 1) == 1:
            last = F.when(part, (F.col("last") < F.col("p")).cast("long")).otherwise(F.round("p").cast("long"))
            return taken.unionByName(out.select("row", (F.col("whole") + last).alias("copies")))
        taken = taken.unionByName(out.filter(~part).select("row", (F.col("whole") + F.round("p").cast("long")).alias("copies")))
        level += 1
        r = out.filter(part).withColumn("buckets", F.ceil(F.col("buckets") / fan_in).cast("long")).withColumn("bucket", F.pmod("bucket", "buckets"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, row: str | None = None) -> DataFrame:
    """A row per document: row, key, size, source_size, target, copies.

    ``row`` names a column of ``docs`` with a unique number; without one, rows are numbered here.

    A null text has size 0. A null source is a source of its own, a null key a key like others, and repeated rows are
    documents each. An empty table, or one without words, takes nothing.
    """
    sized_rows = materialize(docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").alias("source"),
                                         word_count(F.col(f"`{text}`")).alias("size")), "sizes")
    totals = sized_rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    # One row per source; written, so the planner broadcasts it only if it is small.
    t = sized(source_targets(totals, "source", weights, share, most).withColumnRenamed("source", "s"))
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized_rows.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("source", "s").withColumn("want", want)
    took = copies(rows, seed)
    return rows.join(took, "row").select("row", F.col("id").alias(key), "size", "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` as the mix takes them: a row for each copy, with all columns."""
    row, times = free_name(docs), free_name(docs, "__copies")
    table = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    took = mix(table, key, text, source, row=row, **options).filter("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(times))
    copy = F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(row)
    return table.join(took, row).select(*[F.col(f"`{c}`") for c in docs.columns], copy).drop(row)
