"""Segment vectors to clip vectors: statistics, ordered concatenation, deltas, spectra, site geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhush.functions.parse import decibel, finite
from fieldhush.functions.vectors import cosine, group_vectors, l2_distance
from fieldhush.operators.blocks import ordered
from fieldhush.operators.intervals import interval_join, pairs


def clip_statistics(df: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """Element-wise ``mean``, population ``std`` and ``max`` over the segments of a clip."""
    return group_vectors(df, list(by), vector, {"mean": "mean", "std": "std", "max": "max"})


def nested_mean(df: DataFrame, key: str, segments: str, out: str = "embedding") -> DataFrame:
    """Mean over the segments held in one ``array<array<float>>`` cell per clip; NaN and infinity become 0."""
    segs = F.transform(F.col(segments), lambda s: F.transform(s, lambda x: x.cast("double")))
    total = F.aggregate(F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0))), segs[0], lambda a, s: F.zip_with(a, s, lambda x, y: x + y))
    return df.select(key, F.transform(total, lambda x: finite(x / F.size(segs))).alias(out))


def ordered_concat(df: DataFrame, by: Sequence[str], order: str, vector: str, k: int, width: int, out: str = "ordered") -> DataFrame:
    """The first ``k`` segments end to end, padded with zeros to ``k * width``. Only those k are ever collected."""
    from fieldhush.operators.aggregates import top_k

    first = top_k(df.select(*by, order, vector), by, [F.col(order)], k)
    parts = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", vector))).alias("__p"))
    flat = F.flatten(F.transform("__p", lambda p: p[vector]))
    return parts.select(*by, F.slice(F.concat(flat, F.array_repeat(F.lit(0.0).cast("float"), k * width)), 1, k * width).alias(out))


def delta_statistics(df: DataFrame, by: Sequence[str], order: str, vector: str, width: int) -> DataFrame:
    """Mean, std, first and last of consecutive segment differences; zeros for clips of one segment."""
    by = list(by)
    o = ordered(df.select(*by, order, vector), by, [order], before=1)
    prev = F.lag(vector).over(o.window)
    d = o.home(o.df.withColumn("__d", F.zip_with(F.col(vector), prev, lambda x, y: x.cast("double") - y.cast("double"))))
    stats = group_vectors(d.filter(F.col("__d").isNotNull()), by, "__d", {"delta_mean": "mean", "delta_std": "std"})
    ends = d.groupBy(*by).agg(F.min_by("__d", F.when(F.col("__d").isNotNull(), F.col(order))).alias("delta_first"),
                              F.max_by("__d", F.when(F.col("__d").isNotNull(), F.col(order))).alias("delta_last"))
    zeros = F.array_repeat(F.lit(0.0), width)
    out = ends.join(stats, by, "left")
    return out.select(*by, *[F.coalesce(c, zeros).alias(c) for c in ("delta_mean", "delta_std", "delta_first", "delta_last")])


def window_spectrum(rows: DataFrame, windows: DataFrame, by: Sequence[str], t: str, start: str, end: str, spectrum: str,
                    least: int, bucket: int = 3600) -> DataFrame:
    """(window, band, db, n): mean power of each band over the window's clips in dB, from at least ``least`` clips."""
    ids = windows.columns
    hit = interval_join(rows.select(*by, t, spectrum), windows, by, t, start, end, bucket)
    n = hit.groupBy(*ids).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    means = group_vectors(hit, list(ids), spectrum, {"mean": "mean"}).join(n, ids)
    return means.select(*ids, "n", F.posexplode("mean").alias("band", "__m")).withColumn("db", decibel("__m")).drop("__m")


def site_distances(df: DataFrame, site: str, vector: str) -> DataFrame:
    """Distance between the mean vectors of every two sites."""
    means = group_vectors(df, [site], vector, {"mean": "mean"})
    p = pairs(means, site, "mean")
    return p.select(f"{site}_a", f"{site}_b", l2_distance("vec_a", "vec_b").alias("distance"), cosine("vec_a", "vec_b").alias("cosine"))


def distance_change(before: DataFrame, after: DataFrame, site: str) -> DataFrame:
    """Percent change of each site distance between two vector spaces."""
    keys = [f"{site}_a", f"{site}_b"]
    b = before.select(*keys, F.col("distance").alias("before"))
    a = after.select(*keys, F.col("distance").alias("after"))
    return b.join(a, keys).withColumn("change_pct", F.try_divide(100 * (F.col("after") - F.col("before")), F.col("before")))
