"""Scores scaled within a group, filters against the group's own baseline, and id remaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldhush.operators.ranks import medians, percentiles, value_ranks
from fieldhush.sources.scratch import materialize, sized


def min_max_score(df: DataFrame, by: Sequence[str], weights: dict[str, float], out: str) -> DataFrame:
    """Weighted sum of columns scaled to 0..1 within the group; a negative weight takes 1 - scaled."""
    edges = df.groupBy(*by).agg(*[f(c).alias(f"__{n}_{c}") for c in weights for n, f in (("lo", F.min), ("hi", F.max))])
    total = F.lit(0.0)
    for c, w in weights.items():
        scaled = (F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}") + 1e-10)
        total = total + abs(w) * (scaled if w >= 0 else 1 - scaled)
    joined = df.join(sized(edges), list(by)).withColumn(out, total)
    return joined.drop(*[f"__{n}_{c}" for c in weights for n in ("lo", "hi")])


def baseline_percentile_filter(df: DataFrame, by: Sequence[str], value: str, baseline: Column, q: float) -> DataFrame:
    """Keep rows not above the q-quantile of the group's baseline rows."""
    cut = percentiles(df.filter(baseline), by, value, [q]).select(*by, F.col(value).alias("__cut"))
    return df.join(sized(cut), list(by)).filter(F.col(value) <= F.col("__cut")).drop("__cut")


def noisy_rows(before: DataFrame, after: DataFrame, by: Sequence[str], level: str, margin: float) -> DataFrame:
    """``after`` rows with ``noisy``: level above the window's median before-level plus ``margin``."""
    cut = medians(before, by, [level]).select(*by, (F.col(level) + margin).alias("__cut"))
    return after.join(sized(cut), list(by)).withColumn("noisy", F.col(level) > F.col("__cut")).drop("__cut")


def noise_filtered_change(before: DataFrame, after: DataFrame, by: Sequence[str], noise: str, value: str, margin: float, expected: tuple[float, float],
                          covered: float = 0.5, least: tuple[int, int] = (20, 60)) -> DataFrame:
    """(by, n_before, n_after, noisy_share, change): median ``value`` after less before, both without noisy rows.

    A row is noisy if its ``noise`` is above the window's median before plus ``margin``. Windows with fewer than ``covered`` of the ``expected``
    rows on either side, or fewer than ``least`` rows left, are dropped. ``noisy_share`` is that of the rows after.
    """
    by = list(by)
    both = before.withColumn("__side", F.lit(0)).unionByName(after.withColumn("__side", F.lit(1)))
    full = both.groupBy(*by).agg(F.count_if(F.col("__side") == 0).alias("__nb"), F.count_if(F.col("__side") == 1).alias("__na"))
    cut = medians(before, by, [noise]).select(*by, (F.col(noise) + margin).alias("__cut"))
    full = full.filter((F.col("__nb") >= covered * expected[0]) & (F.col("__na") >= covered * expected[1])).join(cut, by)
    rows = materialize(both.join(sized(full.select(*by, "__cut")), by).withColumn("__noisy", F.col(noise) > F.col("__cut")), "noisy")
    here = lambda side: (F.col("__side") == side) & ~F.col("__noisy")
    n = rows.groupBy(*by).agg(F.count_if(here(0)).alias("n_before"), F.count_if(here(1)).alias("n_after"),
                              F.avg(F.when(F.col("__side") == 1, F.col("__noisy").cast("double"))).alias("noisy_share"))
    n = n.filter((F.col("n_before") >= least[0]) & (F.col("n_after") >= least[1]))
    mid = medians(rows.filter(~F.col("__noisy")), [*by, "__side"], [value])
    change = mid.groupBy(*by).agg((F.max(F.when(F.col("__side") == 1, F.col(value))) - F.max(F.when(F.col("__side") == 0, F.col(value)))).alias("change"))
    return n.join(change, by)


def remap_ids(df: DataFrame, column: str, out: str) -> DataFrame:
    """Values to 0..k-1 in value order."""
    codes = value_ranks(df.select(column).distinct(), [], column).select(column, F.col("below").cast("int").alias(out))
    return df.join(sized(codes), column)
