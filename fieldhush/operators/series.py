"""Normalisation, change and voting over the clips of a recorder in time order.

Row frames run on equal blocks (see :mod:`fieldhush.operators.blocks`), group statistics are
partial aggregates joined back, so a recorder with a third of all rows is no special case.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldhush.functions.vectors import l2_distance
from fieldhush.operators.blocks import Ordered, number_rows, ordered, reblock, running
from fieldhush.operators.ranks import value_ranks
from fieldhush.sources.scratch import materialize, sized

LEAST_STD = 1e-6


def _z(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / F.greatest(std, F.lit(LEAST_STD))


def row_index(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], out: str = "rn") -> DataFrame:
    """1, 2, 3 ... within the group, without sorting a group in one task."""
    rows = number_rows(df, by, order)
    if not by:
        return rows.withColumn(out, F.col("__pos") + 1).drop("__pos")
    first = sized(rows.groupBy(*by).agg(F.min("__pos").alias("__first")))
    return rows.join(sized(first), list(by)).withColumn(out, F.col("__pos") - F.col("__first") + 1).drop("__pos", "__first")


# ---- group statistics ------------------------------------------------------

def group_stats(df: DataFrame, by: Sequence[str], values: Sequence[str], sample: bool) -> DataFrame:
    std = F.stddev_samp if sample else F.stddev_pop
    return df.groupBy(*by).agg(*[F.avg(v).alias(f"__m_{v}") for v in values], *[std(v).alias(f"__s_{v}") for v in values])


def apply_stats(df: DataFrame, stats: DataFrame, by: Sequence[str], values: Sequence[str], prefix: str = "z_") -> DataFrame:
    """z of each value against the joined statistics; a zero std becomes 1e-6, no statistics give 0."""
    out = df.join(sized(stats), list(by), "left")
    for v in values:
        std = F.when(F.col(f"__s_{v}") == 0, LEAST_STD).otherwise(F.col(f"__s_{v}"))
        out = out.withColumn(f"{prefix}{v}", F.coalesce((F.col(v) - F.col(f"__m_{v}")) / std, F.lit(0.0)))
    return out.drop(*[f"__{k}_{v}" for v in values for k in "ms"])


def baseline_z(df: DataFrame, by: Sequence[str], values: Sequence[str], baseline: Column, train: DataFrame | None = None) -> DataFrame:
    """z against the group's baseline rows (sample std), taken from ``train`` rows when given."""
    source = (df if train is None else train).filter(baseline)
    return apply_stats(df, group_stats(source, by, values, sample=True), by, values)


def centre(df: DataFrame, by: Sequence[str], values: Sequence[str], scale: bool = False, least: float = 1e-6) -> DataFrame:
    """Subtract the group mean; with ``scale`` divide by the population std + ``least``."""
    out = df.join(sized(group_stats(df, by, values, sample=False)), list(by))
    for v in values:
        c = F.col(v) - F.col(f"__m_{v}")
        out = out.withColumn(f"c_{v}", c / (F.col(f"__s_{v}") + least) if scale else c)
    return out.drop(*[f"__{k}_{v}" for v in values for k in "ms"])


# ---- rolling frames --------------------------------------------------------

def rolling_z_on(o: Ordered, df: DataFrame, values: Sequence[str], n: int, least_rows: int = 2, prefix: str = "z_") -> DataFrame:
    """z against the previous ``n`` rows, current excluded; 0 with fewer than ``least_rows``."""
    past = o.window.rowsBetween(-n, -1)
    for v in values:
        z = _z(F.col(v), F.avg(v).over(past), F.stddev_pop(v).over(past))
        df = df.withColumn(f"{prefix}{v}", F.when(F.count(v).over(past) >= least_rows, z).otherwise(0.0))
    return df


def rolling_z(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], n: int = 20,
              least_rows: int = 2, block_rows: int | None = None) -> DataFrame:
    """Deployment-valid z: only earlier rows of the recorder, no labels."""
    o = ordered(df, by, order, before=n, block_rows=block_rows)
    return o.home(rolling_z_on(o, o.df, values, n, least_rows))


def labelled_rolling_z(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], baseline: Column,
                       n: int = 20, block_rows: int | None = None) -> DataFrame:
    """z against the last ``n`` baseline rows before the row; 0 with fewer than two of them."""
    rows = number_rows(df.withColumn("__base", baseline), by, order)
    base = rows.filter("__base").select(*by, F.col("__pos").alias("__at"), *values)
    o = ordered(base, by, ["__at"], before=n, block_rows=block_rows)
    past = o.window.rowsBetween(-(n - 1), 0)
    stats = o.home(o.df.select("*", F.count("*").over(past).alias("__n"),
                               *[F.avg(v).over(past).alias(f"__m_{v}") for v in values],
                               *[F.stddev_pop(v).over(past).alias(f"__s_{v}") for v in values]))
    packed = stats.select(F.col("__at").alias("__pos"), F.struct(
        "__n", *[f"__{k}_{v}" for v in values for k in "ms"]).alias("__stats"))
    with_own = rows.join(packed, "__pos", "left")
    out = running(reblock(with_own, by, block_rows=block_rows), {"__last": ("last", "__stats")}, current=False)
    for v in values:
        z = _z(F.col(v), F.col(f"__last.__m_{v}"), F.col(f"__last.__s_{v}"))
        out = out.withColumn(f"z_{v}", F.when(F.col("__last.__n") >= 2, z).otherwise(0.0))
    return out.drop("__base", "__pos", "__stats", "__last")


def calibration_z(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], n: int = 60) -> DataFrame:
    """z against the first ``n`` rows of the recorder."""
    rows = row_index(df, by, order, "__rn")
    stats = group_stats(rows.filter(F.col("__rn") <= n), by, values, sample=False)
    out = rows.join(sized(stats), list(by), "left")
    for v in values:
        out = out.withColumn(f"z_{v}", _z(F.col(v), F.col(f"__m_{v}"), F.col(f"__s_{v}")))
    return out.drop("__rn", *[f"__{k}_{v}" for v in values for k in "ms"])


def new_site_z(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], baseline: Column,
               sizes: Sequence[int], last: int = 20) -> DataFrame:
    """z of every row against the last ``last`` of the first N baseline rows, for each N; N = 0 gives 0, -1 takes all."""
    base = row_index(df.filter(baseline).select(*by, *order, *values), by, order, "__rn")
    total = base.groupBy(*by).agg(F.max("__rn").alias("__total"))
    base = base.join(sized(total), list(by))
    grid = F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n_calib")
    base = base.select("*", grid)
    upto = F.when(F.col("n_calib") < 0, F.col("__total")).otherwise(F.least("n_calib", "__total"))
    used = base.filter((F.col("__rn") <= upto) & (F.col("__rn") > upto - last))
    stats = group_stats(used, [*by, "n_calib"], values, sample=False)
    rows = df.select("*", grid)
    out = rows.join(sized(stats), [*by, "n_calib"], "left")
    for v in values:
        z = _z(F.col(v), F.col(f"__m_{v}"), F.col(f"__s_{v}"))
        out = out.withColumn(f"z_{v}", F.when(F.col("n_calib") == 0, 0.0).otherwise(F.coalesce(z, F.lit(0.0))))
    return out.drop(*[f"__{k}_{v}" for v in values for k in "ms"])


def rolling_percentile_on(o: Ordered, df: DataFrame, value: str, n: int = 40, out: str = "pct") -> DataFrame:
    """Share of the last ``n`` values below the current one; 0.5 with fewer than two of them."""
    past = F.collect_list(value).over(o.window.rowsBetween(-n, -1))
    below = F.size(F.filter(past, lambda x: x < F.col(value)))
    return df.withColumn(out, F.when(F.size(past) >= 2, below / F.size(past)).otherwise(0.5))


def rolling_percentile(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, n: int = 40,
                       out: str = "pct", block_rows: int | None = None) -> DataFrame:
    o = ordered(df, by, order, before=n, block_rows=block_rows)
    return o.home(rolling_percentile_on(o, o.df, value, n, out))


def velocity_on(o: Ordered, df: DataFrame, vector: str) -> DataFrame:
    """``velocity``: L2 distance to the previous vector; ``accel``: its absolute change from the third row on."""
    w = o.window
    df = df.withColumn("velocity", F.coalesce(l2_distance(vector, F.lag(vector).over(w)), F.lit(0.0)))
    step = F.abs(F.col("velocity") - F.lag("velocity").over(w))
    return df.withColumn("accel", F.when(F.lag(vector, 2).over(w).isNotNull(), step).otherwise(0.0))


def velocity(df: DataFrame, by: Sequence[str], order: Sequence[str], vector: str, n: int = 40,
             block_rows: int | None = None) -> DataFrame:
    """Velocity, acceleration and their rolling z (more than two earlier rows needed)."""
    o = ordered(df, by, order, before=n + 3, block_rows=block_rows)
    return o.home(rolling_z_on(o, velocity_on(o, o.df, vector), ["velocity", "accel"], n, least_rows=3))


def spectral_anomaly(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], n: int = 40,
                     block_rows: int | None = None) -> DataFrame:
    """Length of the unlabelled rolling z vector, with its rolling percentile."""
    o = ordered(df, by, order, before=2 * n, block_rows=block_rows)
    z = rolling_z_on(o, o.df, values, n)
    norm = F.sqrt(sum((F.col(f"z_{v}") * F.col(f"z_{v}") for v in values), F.lit(0.0)))
    return o.home(rolling_percentile_on(o, z.withColumn("anomaly", norm), "anomaly", n, "anomaly_pct"))


def vote_on(o: Ordered, df: DataFrame, flag: Column, k: int, n: int, out: str = "alert") -> DataFrame:
    """1 when at least ``k`` of the last ``n`` rows, the current one included, are flagged."""
    df = df.withColumn("__flag", flag.cast("int"))
    hits = F.sum("__flag").over(o.window.rowsBetween(-(n - 1), 0))
    return df.withColumn(out, (hits >= k).cast("int")).drop("__flag")


def sequence_vote(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: Column,
                  grid: Sequence[tuple[int, int]] = ((3, 2), (5, 3), (5, 4), (10, 6), (10, 7), (15, 9)),
                  block_rows: int | None = None) -> DataFrame:
    """One ``alert_<n>_<k>`` column for each (n, k), all from one pass over the rows."""
    o = ordered(df, by, order, before=max(n for n, _ in grid), block_rows=block_rows)
    out = o.df
    for n, k in grid:
        out = vote_on(o, out, flag, k, n, f"alert_{n}_{k}")
    return o.home(out)


def top_share_threshold(df: DataFrame, by: Sequence[str], value: str, share: float = 0.15) -> DataFrame:
    """Per group the value at rank ``int(share * n)`` from the top, counted from 0."""
    ranks = value_ranks(df, by, value, descending=True)
    total = ranks.groupBy(*by).agg(F.sum("n").alias("__total"))
    at = F.least(F.floor(F.col("__total") * share), F.col("__total") - 1)
    rows = ranks.join(sized(total), list(by))
    return rows.filter((F.col("below") <= at) & (at < F.col("below") + F.col("n"))).select(*by, F.col(value).alias("threshold"))


def top_share_vote(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, k: int, n: int,
                   share: float = 0.15, block_rows: int | None = None) -> DataFrame:
    cut = top_share_threshold(df, by, value, share)
    o = ordered(df.join(sized(cut), list(by)), by, order, before=n, block_rows=block_rows)
    return o.home(vote_on(o, o.df, F.col(value) >= F.col("threshold"), k, n))


def change_features(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, silent: Column, n: int = 10,
                    block_rows: int | None = None) -> DataFrame:
    """Difference to the previous row, rolling mean / sample std / z including the row, onset of silence."""
    o = ordered(df.withColumn("__silent", silent.cast("int")), by, order, before=n, block_rows=block_rows)
    w, recent = o.window, o.window.rowsBetween(-(n - 1), 0)
    out = o.df.select(
        "*",
        F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0)).alias("delta"),
        F.avg(value).over(recent).alias("roll_mean"),
        F.coalesce(F.stddev_samp(value).over(recent), F.lit(0.0)).alias("roll_std"),
        ((F.col("__silent") == 1) & (F.coalesce(F.lag("__silent").over(w), F.lit(0)) == 0)).cast("int").alias("silence_onset"),
    )
    z = F.when(F.col("roll_std") > 0, F.try_divide(F.col(value) - F.col("roll_mean"), F.col("roll_std"))).otherwise(0.0)
    return o.home(out.withColumn("roll_z", z)).drop("__silent")


def lag_context(df: DataFrame, by: Sequence[str], order: Sequence[str], vector: str, n: int = 5,
                keep: Column | None = None, block_rows: int | None = None) -> DataFrame:
    """``context``: the previous ``n`` vectors as one array. Rows without ``n`` of them are dropped.

    With ``keep`` only rows where it holds for the row and all its context rows remain (contiguous runs).
    """
    keep = F.lit(True) if keep is None else keep
    o = ordered(df.withColumn("__keep", keep.cast("int")), by, order, before=n, block_rows=block_rows)
    w = o.window
    parts = [F.lag(vector, i).over(w) for i in range(n, 0, -1)]
    out = o.df.withColumn("context", F.when(parts[0].isNotNull(), F.concat(*parts)))
    out = out.withColumn("__run", F.sum("__keep").over(w.rowsBetween(-n, 0)))
    return o.home(out).filter(F.col("context").isNotNull() & (F.col("__run") == n + 1)).drop("__keep", "__run")


def state_entropy_on(o: Ordered, df: DataFrame, state: str, n: int = 11, out: str = "state_entropy") -> DataFrame:
    """Entropy of the states in the last ``n`` rows, the current one included."""
    recent = F.collect_list(state).over(o.window.rowsBetween(-(n - 1), 0))
    size = F.size(recent)

    def term(s: Column) -> Column:
        p = F.size(F.filter(recent, lambda x: x == s)) / size
        return -p * F.log(p)

    total = F.aggregate(F.array_distinct(recent), F.lit(0.0), lambda a, s: a + term(s))
    return df.withColumn(out, total)


def change_since(df: DataFrame, by: Sequence[str], step: str, values: Sequence[str], base_steps: Sequence[int]) -> DataFrame:
    """Each step's value minus the mean over the base steps; units missing a base step are dropped."""
    base = df.filter(F.col(step).isin(*base_steps)).groupBy(*by).agg(
        F.count_distinct(step).alias("__k"), *[F.avg(v).alias(f"__b_{v}") for v in values])
    base = base.filter(F.col("__k") == len(base_steps)).drop("__k")
    out = df.join(sized(base), list(by))
    for v in values:
        out = out.withColumn(f"d_{v}", F.col(v) - F.col(f"__b_{v}"))
    return out.drop(*[f"__b_{v}" for v in values])


def gate(df: DataFrame, by: Sequence[str], least: int, distinct: str | None = None) -> DataFrame:
    """Keep groups with at least ``least`` rows, or distinct values of a column."""
    size = F.count_distinct(distinct) if distinct else F.count("*")
    big = df.groupBy(*by).agg(size.alias("__n")).filter(F.col("__n") >= least).select(*by)
    return df.join(sized(big), list(by), "left_semi")


# ---- corrections for many tests -------------------------------------------

def holm(df: DataFrame, by: Sequence[str], p: str, order: Sequence[str], out: str = "p_holm") -> DataFrame:
    """Running max of (m - i) * p over ascending p, capped at 1."""
    return _adjust(df, by, p, order, out, lambda rn, m: F.least(F.lit(1.0), (m - rn + 1) * F.col(p)), "max", False)


def benjamini_hochberg(df: DataFrame, by: Sequence[str], p: str, order: Sequence[str], out: str = "p_fdr") -> DataFrame:
    """Running min of p * m / rank from the largest p down, capped at 1."""
    return _adjust(df, by, p, order, out, lambda rn, m: F.least(F.lit(1.0), F.col(p) * m / rn), "min", True)


def _adjust(df, by, p, order, out, step, kind, reverse) -> DataFrame:
    rows = number_rows(df, by, [p, *order])
    ends = rows.groupBy(*by).agg(F.min("__pos").alias("__first"), F.count("*").alias("__m"))
    rows = rows.join(sized(ends), list(by)) if by else rows.crossJoin(F.broadcast(ends))
    rows = rows.withColumn("__step", step(F.col("__pos") - F.col("__first") + 1, F.col("__m")))
    return running(reblock(rows, by), {out: (kind, "__step")}, reverse=reverse).drop("__pos", "__first", "__m", "__step")


# ---- self-updating baseline ------------------------------------------------

def self_update_run(buffer: list[list[float]], rows: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, list[list[float]]]:
    """z of each row against the accepted rows before it, and the accepted rows at the end (at most ``n``, oldest first)."""
    z = np.zeros(rows.shape)
    ring = np.zeros((n, rows.shape[1]))
    held = len(buffer)
    if held:
        ring[:held] = buffer
    at = held % n  # where the next accepted row goes once the ring is full
    mean = std = None
    for i, x in enumerate(rows):
        if held >= 2:
            if mean is None:
                past = ring[:held]
                mean = past.sum(axis=0) / held
                gap = past - mean
                std = np.maximum(np.sqrt((gap * gap).sum(axis=0) / held), LEAST_STD)
            z[i] = (x - mean) / std
            if np.abs(z[i]).mean() >= threshold:
                continue
        ring[at] = x
        at, held, mean = (at + 1) % n, min(held + 1, n), None
    kept = ring[:held] if held < n else np.roll(ring, -at, axis=0)
    return z, kept.tolist()


def self_updating_z(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], n: int = 20,
                    threshold: float = 2.5, block_rows: int | None = None) -> DataFrame:
    """z against accepted rows only: a row joins the baseline when its mean absolute z is below ``threshold``.

    Each row depends on the one before. Blocks run in parallel from the state the block before is
    known to end in; blocks whose starting state turns out different run again until none does. The
    state is the last ``n`` accepted rows, so blocks soon agree and two or three rounds are usual.
    """
    by, values = list(by), list(values)
    size = max(block_rows or (1 << 16), 1)
    rows = number_rows(df, by, order).withColumn("__blk", F.expr(f"__pos div {size}"))
    rows = materialize(rows, "blocks")
    state_t = T.ArrayType(T.ArrayType(T.DoubleType()))
    keys = [*by, "__blk"]
    key_fields = [rows.schema[c] for c in keys]

    def starts(ends: DataFrame) -> DataFrame:
        # The end state of one block is the start state of the next block of the same key.
        nxt = ends.select(*by, (F.col("__blk") + 1).alias("__blk"), F.col("state_out").alias("state_in"))
        return ends.select(*keys).join(nxt, keys, "left").select(
            *keys, F.coalesce("state_in", F.array().cast(state_t)).alias("state_in"))

    def run(key, left: pd.DataFrame, right: pd.DataFrame, emit: bool):
        """Rows of one block in order, from the given start state."""
        buf = [list(map(float, r)) for r in right["state_in"].iloc[0]] if len(right) else []
        begin = [list(r) for r in buf]
        left = left.sort_values("__pos")
        z, buf = self_update_run(buf, left[values].to_numpy(float), n, threshold)
        if emit:
            return pd.concat([left.reset_index(drop=True), pd.DataFrame(z, columns=[f"z_{v}" for v in values])], axis=1)
        return pd.DataFrame([[*key, begin, buf]], columns=[*keys, "state_in", "state_out"])

    end_schema = T.StructType([*key_fields, T.StructField("state_in", state_t), T.StructField("state_out", state_t)])
    slim = rows.select(*keys, "__pos", *values)

    def sweep(part: DataFrame, begin: DataFrame) -> DataFrame:
        return part.groupBy(*keys).cogroup(begin.groupBy(*keys)).applyInPandas(
            lambda key, a, b: run(key, a, b, False) if len(a) else pd.DataFrame(columns=end_schema.names), end_schema)

    empty = slim.select(*keys).distinct().withColumn("state_in", F.array().cast(state_t))
    ends = materialize(sweep(slim, empty), "ends")
    while True:
        begin = materialize(starts(ends), "starts")
        stale = begin.join(ends.select(*keys, F.col("state_in").alias("used")), keys).filter(F.col("state_in") != F.col("used"))
        stale = materialize(stale.drop("used"), "stale")
        if stale.isEmpty():
            break
        again = sweep(slim.join(stale.select(*keys), keys, "left_semi"), stale)
        ends = materialize(ends.join(stale.select(*keys), keys, "left_anti").unionByName(again), "ends")
    out_schema = T.StructType([*rows.schema.fields, *[T.StructField(f"z_{v}", T.DoubleType()) for v in values]])
    out = rows.groupBy(*keys).cogroup(begin.groupBy(*keys)).applyInPandas(
        lambda key, a, b: run(key, a, b, True) if len(a) else pd.DataFrame(columns=out_schema.names), out_schema)
    return out.drop("__pos", "__blk")
