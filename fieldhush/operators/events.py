"""Logged events rebuilt from clip labels, and the gap sessions they form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldhush.functions.parse import event_kind, is_simulation, parse_list, parse_numbers
from fieldhush.operators.blocks import ordered, reblock, running
from fieldhush.sources.scratch import materialize


def logged_events(df: DataFrame, rec: str, t: str, sim_type: str, sim_rel: str, grid: int = 3) -> DataFrame:
    """(rec, t, type, kind): clip time minus relative seconds, rounded to ``grid`` seconds, distinct."""
    types, rels = parse_list(sim_type), parse_numbers(sim_rel)
    n = F.least(F.size(types), F.size(rels))
    pairs = F.slice(F.arrays_zip(types.alias("type"), rels.alias("rel")), 1, n)
    e = df.filter(is_simulation(sim_type)).select(F.col(rec).alias("rec"), F.col(t).alias("__t"), F.explode(pairs).alias("e"))
    at = (F.round((F.col("__t") - F.col("e.rel")) / grid) * grid).cast("long")
    e = e.filter(F.col("e.rel").isNotNull()).select("rec", at.alias("t"), F.col("e.type").alias("type")).distinct()
    return e.withColumn("kind", event_kind("type"))


def gap_ids(df: DataFrame, by: Sequence[str], t: str, tie: Sequence[str], gap: float, out: str = "sid",
            block_rows: int | None = None, keep_pos: bool = False) -> DataFrame:
    """Row-level session id, the position of its first row: a new one starts after a gap longer than ``gap`` seconds."""
    o = ordered(df, by, [t, *tie], before=1, block_rows=block_rows)
    before = F.lag(t).over(o.window)
    marked = o.home(o.df.withColumn("__start", F.when(before.isNull() | (F.col(t) - before > gap), F.col("__pos"))), keep_pos=True)
    rows = running(reblock(marked, by, block_rows=block_rows), {out: ("last", "__start")}).drop("__start")
    return rows if keep_pos else rows.drop("__pos")


def gap_sessions(df: DataFrame, by: Sequence[str], t: str, tie: Sequence[str], gap: float = 1200, pad: int = 3,
                 types: str | None = None, block_rows: int | None = None) -> DataFrame:
    """One row per session: ``start_t``, ``end_t`` (last time + ``pad``), ``centre`` (median time), ``n_events``, ``types``."""
    by = list(by)
    rows = materialize(gap_ids(df, by, t, tie, gap, block_rows=block_rows, keep_pos=True), "sessions")
    aggs = [F.min(t).alias("start_t"), (F.max(t) + pad).alias("end_t"), F.count("*").alias("n_events")]
    if types:
        aggs += [F.array_sort(F.collect_set(types)).alias("types"), F.min_by(types, F.struct(t, *tie)).alias("first_type")]
    sums = rows.groupBy(*by, "sid").agg(*aggs)
    # Session rows have consecutive positions from ``sid`` on, so the median is the mean of the middle one or two.
    at = [F.col("sid") + F.expr(x) for x in ("(n_events - 1) div 2", "n_events div 2")]
    mid = sums.select(*by, "sid", F.explode(F.array_distinct(F.array(*at))).alias("__pos"))
    centre = mid.join(rows.select("__pos", t), "__pos").groupBy(*by, "sid").agg(F.avg(t).alias("centre"))
    return sums.join(centre, [*by, "sid"]).drop("sid")


def bout_purity(df: DataFrame, by: Sequence[str], t: str, tie: Sequence[str], label: str, gap: float = 3600) -> DataFrame:
    """Sessions of clips with their label mix: ``all_sim``, ``all_baseline`` or ``mixed``."""
    rows = gap_ids(df, by, t, tie, gap)
    s = rows.groupBy(*by, "sid").agg(F.min(t).alias("start_t"), F.count("*").alias("n"), F.sum(label).alias("n_sim"))
    mix = F.when(F.col("n_sim") == 0, "all_baseline").when(F.col("n_sim") == F.col("n"), "all_sim").otherwise("mixed")
    return s.withColumn("purity", mix).drop("sid")


def gaps(df: DataFrame, by: Sequence[str], t: str, tie: Sequence[str], block_rows: int | None = None) -> DataFrame:
    """Rows with ``gap``: seconds since the previous row of the group, null on the first."""
    o = ordered(df, by, [t, *tie], before=1, block_rows=block_rows)
    return o.home(o.df.withColumn("gap", F.col(t) - F.lag(t).over(o.window)))


def lag_indicators(df: DataFrame, sessions: DataFrame, by: Sequence[str], t: str, steps: dict[str, tuple[Column, Column]],
                   length: int) -> DataFrame:
    """0/1 columns: the row lies in ``[from, to)`` of any session at its recorder, for each named step."""
    from fieldhush.operators.intervals import interval_join

    spans = sessions.select(*by, F.explode(F.array(*[
        F.struct(F.lit(n).alias("__step"), a.alias("__a"), b.alias("__b")) for n, (a, b) in steps.items()])).alias("__s")
    ).select(*by, "__s.*").distinct()
    keys = [*by, t]
    hit = interval_join(df.select(*keys).distinct(), spans, by, t, "__a", "__b", length)
    flags = hit.groupBy(*keys).agg(*[F.max(F.when(F.col("__step") == n, 1.0).otherwise(0.0)).alias(n) for n in steps])
    out = df.join(flags, keys, "left")
    return out.fillna(0.0, list(steps))
