"""Samples, splits and folds. Order is by md5 of seed and id, so a draw is the same on every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldhush.operators.series import row_index
from fieldhush.sources.scratch import sized


def hash_key(ids: Sequence[str], seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in ids]))


def first_k(df: DataFrame, by: Sequence[str], ids: Sequence[str], k: int, seed: str) -> DataFrame:
    """``k`` rows per group. The rank limit is applied before the shuffle, so a hot group sends k rows per task."""
    w = Window.partitionBy(*by).orderBy(hash_key(ids, seed), *ids)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def hash_rank(df: DataFrame, by: Sequence[str], ids: Sequence[str], seed: str, out: str = "hash_rank") -> DataFrame:
    """1, 2, 3 ... in hash order within the group, for groups of any size."""
    rows = df.withColumn("__h", hash_key(ids, seed))
    return row_index(rows, by, ["__h", *ids], out).drop("__h")


def ratio_capped(df: DataFrame, by: Sequence[str], ids: Sequence[str], label: str, ratio: float | None, seed: str) -> DataFrame:
    """All positives and up to ``ratio`` times as many negatives per group; ``None`` keeps all negatives.

    Groups without a positive are dropped.
    """
    n_pos = df.groupBy(*by).agg(F.sum(label).alias("__pos_n")).filter(F.col("__pos_n") > 0)
    rows = df.join(sized(n_pos), list(by))
    if ratio is None:
        return rows.drop("__pos_n")
    ranked = hash_rank(rows, [*by, label], ids, seed, "__rn")
    keep = (F.col(label) == 1) | (F.col("__rn") <= F.col("__pos_n") * ratio)
    return ranked.filter(keep).drop("__rn", "__pos_n")


def ratio_steps(df: DataFrame, by: Sequence[str], ids: Sequence[str], label: str, ratios: Sequence[float], seed: str, out: str = "from_ratio") -> DataFrame:
    """The rows that ``ratio_capped`` keeps at any of the ascending ``ratios``, with the index of the first that keeps them; negatives are ranked once."""
    n_pos = df.groupBy(*by).agg(F.sum(label).alias("__pos_n")).filter(F.col("__pos_n") > 0)
    ranked = hash_rank(df.join(sized(n_pos), list(by)), [*by, label], ids, seed, "__rn")
    first = F.when(F.col(label) == 1, 0)
    for i, ratio in enumerate(ratios):
        first = first.when(F.col("__rn") <= F.col("__pos_n") * ratio, i)
    return ranked.withColumn(out, first).filter(F.col(out).isNotNull()).drop("__rn", "__pos_n")


def matched(df: DataFrame, by: Sequence[str], ids: Sequence[str], label: str, seed: str, ratio: int = 1) -> DataFrame:
    """Equal positives and negatives per group (negatives up to ``ratio`` times); one-class groups are dropped."""
    sizes = df.groupBy(*by).agg(F.sum(label).alias("__p"), F.sum(1 - F.col(label)).alias("__n"))
    sizes = sizes.withColumn("__k", F.least("__p", "__n")).filter("__k > 0").select(*by, "__k")
    ranked = hash_rank(df.join(sized(sizes), list(by)), [*by, label], ids, seed, "__rn")
    cap = F.when(F.col(label) == 1, F.col("__k")).otherwise(F.col("__k") * ratio)
    return ranked.filter(F.col("__rn") <= cap).drop("__rn", "__k")


def k_folds(df: DataFrame, label: str, ids: Sequence[str], k: int, seed: str, out: str = "fold") -> DataFrame:
    """Folds 0..k-1 of equal label mix."""
    ranked = hash_rank(df, [label], ids, seed, "__rn")
    return ranked.withColumn(out, ((F.col("__rn") - 1) % k).cast("int")).drop("__rn")


def group_folds(df: DataFrame, group: str, k: int, seed: str, out: str = "fold") -> DataFrame:
    """Folds that keep each group whole."""
    code = hash_rank(df.select(group).distinct(), [], [group], seed, "__g")
    folds = code.select(group, ((F.col("__g") - 1) % k).cast("int").alias(out))
    return df.join(sized(folds), group)


def leaks(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups that lie in more than one fold: empty when the split is safe."""
    return df.groupBy(group).agg(F.count_distinct(fold).alias("n_folds")).filter("n_folds > 1")


def usable_groups(df: DataFrame, group: str, label: str, least_pos: int = 3, least_neg: int = 3) -> DataFrame:
    """Groups that can be held out: enough rows of both classes."""
    g = df.groupBy(group).agg(F.sum(label).alias("n_pos"), F.sum(1 - F.col(label)).alias("n_neg"))
    return g.filter((F.col("n_pos") >= least_pos) & (F.col("n_neg") >= least_neg))


def support_split(df: DataFrame, by: Sequence[str], label: str, ids: Sequence[str], sizes: Sequence[int], trials: int) -> DataFrame:
    """Few-shot draws: rows x (n, trial) with ``role`` support for n rows of each class, else test.

    A size larger than a group's positives is left out for that group.
    """
    grid = df.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    rows = grid.withColumn("__h", F.md5(F.concat_ws("|", F.col("trial").cast("string"), *[F.col(c).cast("string") for c in ids])))
    ranked = row_index(rows, [*by, "trial", label], ["__h", *ids], "__rn").drop("__h")
    most = sized(df.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("__most")))
    out = ranked.join(most, list(by)).withColumn("n_shot", F.explode(F.array(*[F.lit(n) for n in sizes])))
    out = out.filter(F.col("n_shot") <= F.col("__most")).drop("__most")
    return out.withColumn("role", F.when(F.col("__rn") <= F.col("n_shot"), "support").otherwise("test")).drop("__rn")


def proportional(df: DataFrame, by: Sequence[str], label: str, ids: Sequence[str], target_pos: int, seed: str) -> DataFrame:
    """Keep the same share of every (group, class) so that about ``target_pos`` positives remain."""
    total = df.agg(F.least(F.lit(1.0), F.try_divide(F.lit(float(target_pos)), F.sum(label))).alias("__frac"))
    sizes = df.groupBy(*by, label).agg(F.count("*").alias("__n")).crossJoin(F.broadcast(total))
    caps = sizes.withColumn("__cap", F.bround(F.col("__n") * F.col("__frac"))).select(*by, label, "__cap")
    ranked = hash_rank(df, [*by, label], ids, seed, "__rn").join(sized(caps), [*by, label])
    return ranked.filter(F.col("__rn") <= F.col("__cap")).drop("__rn", "__cap")


def row_cap(df: DataFrame, ids: Sequence[str], cap: int, seed: str) -> DataFrame:
    """At most ``cap`` rows in hash order."""
    return df.withColumn("__h", hash_key(ids, seed)).orderBy("__h", *ids).limit(cap).drop("__h")


def middle_run(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int = 10) -> DataFrame:
    """``n`` consecutive rows around the middle of each group."""
    rows = row_index(df, by, order, "__rn")
    size = rows.groupBy(*by).agg(F.max("__rn").alias("__n"))
    start = F.greatest(F.floor(F.col("__n") / 2) - n // 2, F.lit(0))
    stop = F.floor(F.col("__n") / 2) + (n - n // 2)
    out = rows.join(sized(size), list(by)).filter((F.col("__rn") > start) & (F.col("__rn") <= stop))
    return out.drop("__rn", "__n")


def date_holdout(df: DataFrame, day: str, train: tuple[int, int], test: tuple[int, int], out: str = "role") -> DataFrame:
    """``train`` and ``test`` rows by half-open day ranges; other rows are dropped."""
    d = F.col(day)
    role = F.when((d >= train[0]) & (d < train[1]), "train").when((d >= test[0]) & (d < test[1]), "test")
    return df.withColumn(out, role).filter(F.col(out).isNotNull())


def bootstrap_weights(df: DataFrame, by: Sequence[str], order: Sequence[str], draws: int, seed: str) -> DataFrame:
    """(row columns, draw, weight): how often each row of a group is picked in each resample of the group's size.

    Pick i of a draw takes the row at a hashed index, so no draw is held in one task.
    """
    rows = row_index(df, by, order, "__rn")
    sizes = rows.groupBy(*by).agg(F.max("__rn").alias("__n"))
    picks = rows.select(*by, F.col("__rn").alias("__i"))
    picks = (picks.join(sizes, list(by)) if by else picks.crossJoin(F.broadcast(sizes))).withColumn(
        "draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), F.col("__i").cast("string"))), 1, 8), 16, 10)
    picks = picks.withColumn("__rn", h.cast("long") % F.col("__n") + 1)
    weights = picks.groupBy(*by, "draw", "__rn").agg(F.count("*").alias("weight"))
    return weights.join(rows, [*by, "__rn"]).drop("__rn")
