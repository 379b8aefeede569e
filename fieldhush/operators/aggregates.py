"""Grouped summaries: windows, species, clusters, audits and matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldhush.functions.parse import shannon
from fieldhush.operators.intervals import interval_join
from fieldhush.operators.ranks import medians
from fieldhush.sources.scratch import sized


def time_bins(df: DataFrame, by: Sequence[str], t: str, seconds: int, aggs: Sequence[Column], least: int = 1, out: str = "bin_t") -> DataFrame:
    """Rows per time bin with further aggregates; bins with fewer than ``least`` rows are dropped."""
    g = df.groupBy(*by, (F.col(t) - F.col(t) % seconds).alias(out)).agg(F.count("*").alias("n"), *aggs)
    return g.filter(F.col("n") >= least)


def window_medians(rows: DataFrame, windows: DataFrame, by: Sequence[str], t: str, start: str, end: str, values: Sequence[str],
                   least: int = 1, bucket: int = 3600) -> DataFrame:
    """Exact median of each value per window, null with fewer than ``least`` rows."""
    ids = windows.columns
    hit = interval_join(rows.select(*by, t, *values), windows, by, t, start, end, bucket)
    m = medians(hit, ids, values)
    for v in values:
        m = m.withColumn(v, F.when(F.col(f"n_{v}") >= least, F.col(v)))
    return windows.join(m, ids, "left")


def entropy(counts: DataFrame, by: Sequence[str], n: str, out: str = "entropy") -> DataFrame:
    """Shannon entropy of the counts within each group."""
    total = counts.groupBy(*by).agg(F.sum(n).alias("__total"))
    both = counts.join(total, list(by)) if by else counts.crossJoin(F.broadcast(total))
    return both.groupBy(*by).agg(F.sum(shannon(n, "__total")).alias(out))


def window_diversity(rows: DataFrame, windows: DataFrame, by: Sequence[str], t: str, start: str, end: str, species: str,
                     target: Column, bucket: int = 3600) -> DataFrame:
    """Rate per minute, richness, Shannon diversity and target share of each window."""
    ids = windows.columns
    hit = interval_join(rows, windows, by, t, start, end, bucket)
    counts = hit.groupBy(*ids, species).agg(F.count("*").alias("k"), F.count_if(target).alias("hits"))
    sums = counts.groupBy(*ids).agg(F.sum("k").alias("n"), F.count("*").alias("richness"), F.sum("hits").alias("hits"))
    out = windows.join(sums, ids, "left").join(entropy(counts, ids, "k", "shannon"), ids, "left")
    minutes = (F.col(end) - F.col(start)) / 60.0
    return out.fillna(0, ["n", "richness", "shannon"]).withColumn("rate", F.col("n") / minutes).withColumn(
        "owl_frac", F.try_divide("hits", "n")).drop("hits")


def rarefied_richness(df: DataFrame, by: Sequence[str], species: str, draw: int, out: str = "richness") -> DataFrame:
    """Expected number of species in ``draw`` rows taken without replacement, groups of at least ``draw`` rows.

    The chance that a species with k of n rows is missed is prod((n - k - i) / (n - i)), i < draw.
    """
    counts = df.groupBy(*by, species).agg(F.count("*").alias("k"))
    total = counts.groupBy(*by).agg(F.sum("k").alias("n")).filter(F.col("n") >= draw)
    rows = counts.join(total, list(by))
    logs = F.aggregate(F.sequence(F.lit(0), F.lit(draw - 1)), F.lit(0.0),
                       lambda a, i: a + F.log(F.col("n") - F.col("k") - i) - F.log(F.col("n") - i))
    missed = F.when(F.col("n") - F.col("k") < draw, 0.0).otherwise(F.exp(logs))
    return rows.groupBy(*by).agg(F.sum(1 - missed).alias(out))


def species_share(rows: DataFrame, windows: DataFrame, by: Sequence[str], t: str, start: str, end: str, tags: str,
                  least: int = 0, bucket: int = 3600, dense: bool = False) -> DataFrame:
    """(window, n, species, k, share): the share of each window's ``n`` clips that carry each species.

    ``least`` keeps species with so many detections in all rows. With ``dense`` every window with clips has a row for every species
    that is left; else a species that a window lacks has no row there, and statistics over windows count the missing rows as zeros, see ``zero_medians``.
    """
    ids = windows.columns
    hit = interval_join(rows, windows, by, t, start, end, bucket)
    n = hit.groupBy(*ids).agg(F.count("*").alias("n"))
    seen = hit.select(*ids, F.explode(F.array_distinct(tags)).alias("species")).groupBy(*ids, "species").agg(F.count("*").alias("k"))
    if least or dense:
        frequent = rows.select(F.explode(tags).alias("species")).groupBy("species").agg(F.count("*").alias("__k")).filter(F.col("__k") >= least).select("species")
        frequent = sized(frequent)
    if dense:
        seen = n.crossJoin(frequent).join(seen, [*ids, "species"], "left").withColumn("k", F.coalesce("k", F.lit(0).cast("long")))
    else:
        seen = (seen.join(frequent, "species", "left_semi") if least else seen).join(n, ids)
    return seen.withColumn("share", F.col("k") / F.col("n"))


def padded_median(values: Column, n: Column) -> Column:
    """Median of an array of values and as many zeros as it lacks to ``n``. For short arrays."""
    full = F.array_sort(F.concat(values, F.array_repeat(F.lit(0.0), F.greatest(n - F.size(values), F.lit(0)).cast("int"))))
    half = F.size(full) / 2
    return (F.element_at(full, F.ceil(half).cast("int")) + F.element_at(full, F.floor(half + 1).cast("int"))) / 2


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group; the limit is applied before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def value_counts(df: DataFrame, by: Sequence[str], value: str, k: int | None = None) -> DataFrame:
    """Counts per value, optionally the ``k`` most frequent of each group (ties by value)."""
    c = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return c if k is None else top_k(c, by, [F.col("n").desc(), F.col(value)], k)


# ---- label audits ----------------------------------------------------------

def label_audit(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """n, pos, neg, positive share and whether both classes occur."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    g = g.withColumn("neg", F.col("n") - F.col("pos")).withColumn("pos_frac", F.col("pos") / F.col("n"))
    return g.withColumn("both", (F.col("pos") > 0) & (F.col("neg") > 0))


def top_sessions_share(audit: DataFrame, by: Sequence[str], session: str, k: int = 3) -> DataFrame:
    """Share of all positives that lie in the ``k`` sessions with most of them."""
    total = audit.groupBy(*by).agg(F.sum("pos").alias("__all"), F.count("*").alias("sessions"), F.count_if("both").alias("with_both"))
    top = top_k(audit, by, [F.col("pos").desc(), F.col(session)], k).groupBy(*by).agg(F.sum("pos").alias("__top"))
    return total.join(top, list(by)).withColumn("top_share", F.try_divide("__top", "__all")).drop("__top", "__all")


# ---- clusters --------------------------------------------------------------

def cluster_shift(df: DataFrame, cluster: str, label: str, noise: int = -1) -> DataFrame:
    """Percent of baseline and of simulation rows in each cluster and the difference; noise rows count in the totals only."""
    totals = df.agg(F.count_if(F.col(label) == 0).alias("__nb"), F.count_if(F.col(label) == 1).alias("__ns"))
    c = df.filter(F.col(cluster) != noise).groupBy(cluster).agg(
        F.count_if(F.col(label) == 0).alias("base"), F.count_if(F.col(label) == 1).alias("sim"))
    out = c.crossJoin(F.broadcast(totals))
    out = out.withColumn("base_pct", F.try_divide(100.0 * F.col("base"), F.col("__nb"))).withColumn(
        "sim_pct", F.try_divide(100.0 * F.col("sim"), F.col("__ns")))
    return out.withColumn("shift", F.col("sim_pct") - F.col("base_pct")).drop("__nb", "__ns")


def cluster_presence(df: DataFrame, cluster: str, label: str, noise: int = -1) -> DataFrame:
    """Where each cluster occurs: ``baseline_only``, ``sim_only`` or ``shared``."""
    c = df.filter(F.col(cluster) != noise).groupBy(cluster).agg(
        F.max((F.col(label) == 0).cast("int")).alias("b"), F.max((F.col(label) == 1).cast("int")).alias("s"))
    where = F.when(F.col("s") == 0, "baseline_only").when(F.col("b") == 0, "sim_only").otherwise("shared")
    return c.select(cluster, where.alias("presence"))


def cluster_summary(df: DataFrame, by: Sequence[str], cluster: str, vector: str, noise: int = -1) -> DataFrame:
    """Per condition: entropy over clusters, noise share, number of clusters, mean distance to the cluster centre."""
    from fieldhush.functions.vectors import group_vectors, l2_distance

    by = list(by)
    kept = df.filter(F.col(cluster) != noise)
    counts = kept.groupBy(*by, cluster).agg(F.count("*").alias("k"))
    share = df.groupBy(*by).agg(F.avg((F.col(cluster) == noise).cast("double")).alias("noise_share"))
    big = counts.filter("k >= 2").select(*by, cluster)
    centres = group_vectors(kept.join(big, [*by, cluster], "left_semi"), [*by, cluster], vector, {"centre": "mean"})
    spread = kept.join(centres, [*by, cluster]).groupBy(*by).agg(F.avg(l2_distance(vector, "centre")).alias("scatter"))
    n = counts.groupBy(*by).agg(F.count("*").alias("clusters"))
    return share.join(entropy(counts, by, "k"), by, "left").join(n, by, "left").join(spread, by, "left").fillna(
        0, ["entropy", "clusters", "scatter"])


# ---- variance --------------------------------------------------------------

def variance_explained(df: DataFrame, factor: str, values: Sequence[str]) -> DataFrame:
    """Per feature: population variance of the group means over the total population variance."""
    long = df.select(factor, F.explode(F.array(*[
        F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("v")) for v in values])).alias("__f")).select(factor, "__f.*")
    means = long.groupBy("feature", factor).agg(F.avg("v").alias("m"))
    between = means.groupBy("feature").agg(F.var_pop("m").alias("__between"))
    total = long.groupBy("feature").agg(F.var_pop("v").alias("__total"))
    return between.join(total, "feature").select("feature", F.coalesce(F.try_divide("__between", "__total"), F.lit(0.0)).alias("explained"))


def within_between(df: DataFrame, factor: str, value: str) -> DataFrame:
    """Mean within-group variance, variance of group means, and their ratio."""
    g = df.groupBy(factor).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    return g.agg(F.avg("v").alias("within"), F.var_pop("m").alias("between")).withColumn("ratio", F.try_divide("between", "within"))
