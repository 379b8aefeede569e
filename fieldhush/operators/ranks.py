"""Exact ranks, percentiles and cumulative counts over groups of any size.

All of them first count equal values (partial aggregation on the map side), then run a cumulative
count over the distinct values, so neither a sort nor a value buffer ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldhush.operators.blocks import ordered, running
from fieldhush.sources.scratch import sized


def value_ranks(df: DataFrame, by: Sequence[str], value: str, weights: dict[str, Column] | None = None,
                descending: bool = False, block_rows: int | None = None) -> DataFrame:
    """One row per distinct value of a group: ``n`` rows, ``below`` rows ranked before it, ``avg_rank``.

    ``weights`` adds summed columns and, as ``<name>_cum``, their running totals up to this value.
    """
    weights = weights or {}
    hist = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in weights.items()]
    )
    key = F.col(value).desc() if descending else F.col(value)
    o = ordered(hist, by, [key], block_rows=block_rows)
    cum = running(o, {"__cum": ("sum", "n"), **{f"{k}_cum": ("sum", k) for k in weights}})
    return (
        cum.withColumn("below", F.col("__cum") - F.col("n"))
        .withColumn("avg_rank", F.col("below") + (F.col("n") + 1) / 2)
        .drop("__cum", "__pos")
    )


def percentiles(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float],
                block_rows: int | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation: (by, q, value, n)."""
    by = list(by)
    ranks = value_ranks(df, by, value, block_rows=block_rows)
    # Sizes come from the rows, so the ranking is made once; they are written, so that one large group is no hot key of a join.
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("__total"))
    rows = ranks.join(sized(sizes), by) if by else ranks.crossJoin(F.broadcast(sizes))
    rows = rows.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    rows = rows.withColumn("__h", (F.col("__total") - 1) * F.col("q"))
    holds = lambda r: (F.col("below") <= r) & (r < F.col("below") + F.col("n"))
    out = rows.filter(holds(F.floor("__h")) | holds(F.ceil("__h"))).groupBy(*by, "q").agg(
        F.max(F.when(holds(F.floor("__h")), F.col(value))).alias("__lo"),
        F.max(F.when(holds(F.ceil("__h")), F.col(value))).alias("__hi"),
        F.max("__h").alias("__h"),
        F.max("__total").alias("n"),
    )
    frac = F.col("__h") - F.floor("__h")
    return out.select(*by, "q", (F.col("__lo") + frac * (F.col("__hi") - F.col("__lo"))).alias(value), "n")


def medians(df: DataFrame, by: Sequence[str], values: Sequence[str], block_rows: int | None = None) -> DataFrame:
    """Exact group medians of several columns in one pass: by, one column per value, ``n_<value>``."""
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(v).alias("m"), F.col(v).cast("double").alias("v")) for v in values
    ])).alias("__mv")).select(*by, "__mv.m", "__mv.v")
    p = percentiles(long, [*by, "m"], "v", [0.5], block_rows)
    return p.groupBy(*by).agg(
        *[F.max(F.when(F.col("m") == v, F.col("v"))).alias(v) for v in values],
        *[F.max(F.when(F.col("m") == v, F.col("n"))).alias(f"n_{v}") for v in values],
    )


def zero_medians(df: DataFrame, by: Sequence[str], value: str, n: Column, block_rows: int | None = None) -> DataFrame:
    """(by, value): the median of each group over ``n`` values, of which the rows of ``df`` are some and all others are zero.

    ``n`` is a column that is the same in all rows of a group. Zeros are never rows: between negative and positive values lies a block of them.
    """
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).withColumn("__n", n)
    sizes = rows.groupBy(*by).agg(F.max("__n").alias("__all"), F.count_if(F.col(value) != 0).alias("__nz"))
    ranks = value_ranks(rows.filter(F.col(value) != 0), by, value, block_rows=block_rows).join(sized(sizes), by)
    at = F.col("below") + F.when(F.col(value) > 0, F.col("__all") - F.col("__nz")).otherwise(0)
    half = (F.col("__all") - 1) / 2
    holds = lambda r: (at <= r) & (r < at + F.col("n"))
    pick = lambda r: F.max(F.when(holds(r), F.col(value)))
    got = ranks.groupBy(*by).agg(pick(F.floor(half)).alias("__lo"), pick(F.ceil(half)).alias("__hi"))
    out = sizes.join(got, by, "left")
    return out.select(*by, ((F.coalesce("__lo", F.lit(0.0)) + F.coalesce("__hi", F.lit(0.0))) / 2).alias(value))
