"""State sequences: smoothed transition matrices and features read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldhush.operators.blocks import ordered
from fieldhush.operators.series import rolling_z_on, state_entropy_on, velocity_on
from fieldhush.sources.scratch import sized

SMOOTH = 1e-3
LEAST_P = 1e-8


def transition_matrix(df: DataFrame, by: Sequence[str], order: Sequence[str], state: str, n_states: int, keep: Column) -> DataFrame:
    """(by, s1, s2, p, diagonality): smoothed row-normalised counts of consecutive rows that both satisfy ``keep``."""
    by = list(by)
    o = ordered(df.select(*by, *order, state, keep.alias("__keep")), by, order, after=1)
    w = o.window
    steps = o.home(o.df.select("*", F.lead(state).over(w).alias("__next"), F.lead("__keep").over(w).alias("__next_keep")))
    counts = steps.filter(F.col("__keep") & F.col("__next_keep")).groupBy(
        *by, F.col(state).alias("s1"), F.col("__next").alias("s2")).agg(F.count("*").alias("n"))
    # Every group gets the full n_states x n_states grid, a size set by the parameter.
    ids = F.sequence(F.lit(0), F.lit(n_states - 1))
    grid = df.select(*by).distinct().select(*by, F.explode(ids).alias("s1")).select("*", F.explode(ids).alias("s2"))
    full = grid.join(counts, [*by, "s1", "s2"], "left").withColumn("w", F.coalesce(F.col("n"), F.lit(0)) + SMOOTH)
    total = full.groupBy(*by, "s1").agg(F.sum("w").alias("__row"))
    p = full.join(total, [*by, "s1"]).select(*by, "s1", "s2", (F.col("w") / F.col("__row")).alias("p"))
    trace = p.filter("s1 = s2").groupBy(*by).agg((F.sum("p") / n_states).alias("diagonality"))
    return p.join(trace, by)


def dynamic_features(df: DataFrame, by: Sequence[str], order: Sequence[str], state: str, vector: str, n_states: int,
                     keep: Column, n: int = 40) -> DataFrame:
    """Velocity and its rolling z, surprise of the transition, rarity of the state, entropy of recent states."""
    by = list(by)
    m = transition_matrix(df, by, order, state, n_states, keep).drop("diagonality")
    total = m.groupBy(*by).agg(F.sum("p").alias("__all"))
    rarity = m.groupBy(*by, "s1").agg(F.sum("p").alias("__row")).join(total, by).select(
        *by, F.col("s1").alias(state), (-F.log(F.greatest(F.col("__row"), F.lit(LEAST_P)) / F.col("__all"))).alias("rarity"))
    surprise = m.select(*by, F.col("s1").alias("prev_state"), F.col("s2").alias(state),
                        (-F.log(F.greatest(F.col("p"), F.lit(LEAST_P)))).alias("surprise"))
    o = ordered(df, by, order, before=n + 3)
    out = rolling_z_on(o, velocity_on(o, o.df, vector), ["velocity"], n, least_rows=3)
    out = state_entropy_on(o, out, state)
    out = o.home(out.withColumn("prev_state", F.lag(state).over(o.window)))
    out = out.join(sized(surprise), [*by, "prev_state", state], "left").join(sized(rarity), [*by, state], "left")
    return out.withColumn("surprise", F.coalesce("surprise", F.lit(0.0)))
