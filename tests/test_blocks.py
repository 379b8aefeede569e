"""Blocks, ranks and series operators with one key holding most rows and blocks far smaller than the key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldhush.operators import events, intervals, series
from fieldhush.operators.blocks import ordered, running
from fieldhush.operators.ranks import medians, percentiles, value_ranks


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(3)
    n = 900
    rec = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 5, n))
    return pd.DataFrame({"id": np.arange(n), "rec": rec, "t": rng.integers(0, 4000, n), "x": rng.integers(0, 50, n).astype(float),
                         "y": rng.normal(size=n), "lab": (rng.random(n) < 0.1).astype(int)})


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf).repartition(5)


def by_id(d):
    return d.toPandas().sort_values("id").reset_index(drop=True)


@pytest.mark.parametrize("block_rows", [7, 64, None])
def test_rolling_frames_equal_plain_windows(df, block_rows):
    o = ordered(df, ["rec"], ["t", "id"], before=5, after=2, block_rows=block_rows)
    got = by_id(o.home(o.df.withColumn("m", F.avg("x").over(o.window.rowsBetween(-5, 2)))))
    w = W.partitionBy("rec").orderBy("t", "id")
    want = by_id(df.withColumn("m", F.avg("x").over(w.rowsBetween(-5, 2))))
    assert len(got) == len(want)
    assert np.allclose(got.m, want.m)


@pytest.mark.parametrize("block_rows", [7, 64])
def test_running_totals(df, block_rows):
    d = df.withColumn("h", F.when(F.col("x") > 45, F.col("x")))
    o = ordered(d, ["rec"], ["t", "id"], block_rows=block_rows)
    got = by_id(running(o, {"s": ("sum", "x"), "mx": ("max", "x"), "last": ("last", "h"), "nxt": ("next", "h")}))
    w = W.partitionBy("rec").orderBy("t", "id")
    past, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    want = by_id(d.select("id", F.sum("x").over(past).alias("s"), F.max("x").over(past).alias("mx"),
                          F.last("h", True).over(past).alias("last"), F.first("h", True).over(ahead).alias("nxt")))
    for c in ("s", "mx", "last", "nxt"):
        assert np.allclose(got[c].fillna(-1), want[c].fillna(-1)), c


def test_ranks_and_percentiles(df, pdf):
    r = value_ranks(df, ["rec"], "x", block_rows=5).toPandas().set_index(["rec", "x"]).avg_rank
    want = pdf.assign(r=pdf.groupby("rec").x.rank()).drop_duplicates(["rec", "x"]).set_index(["rec", "x"]).r
    assert np.allclose(r.sort_index(), want.sort_index())
    p = percentiles(df, ["rec"], "y", [0.1, 0.5, 0.93], block_rows=5).toPandas()
    for _, row in p.iterrows():
        assert np.isclose(row.y, pdf[pdf.rec == row.rec].y.quantile(row.q))
    m = medians(df, ["rec"], ["x", "y"]).toPandas().set_index("rec")
    assert np.allclose(m[["x", "y"]].sort_index(), pdf.groupby("rec")[["x", "y"]].median())


def self_updating(values, n=20, threshold=2.5):
    """The recursion written out, one row after the other."""
    buf, out = [], []
    for x in values:
        if len(buf) < 2:
            out.append(np.zeros(len(x)))
            buf.append(x)
            continue
        past = np.array(buf[-n:])
        z = (x - past.mean(0)) / np.maximum(past.std(0), 1e-6)
        out.append(z)
        if np.abs(z).mean() < threshold:
            buf.append(x)
    return np.array(out)


@pytest.mark.parametrize("block_rows", [11, 200, 5000])
def test_self_updating_baseline(df, pdf, block_rows):
    got = by_id(series.self_updating_z(df, ["rec"], ["t", "id"], ["x", "y"], n=6, threshold=1.2, block_rows=block_rows))
    want = np.zeros((len(pdf), 2))
    for _, g in pdf.sort_values(["t", "id"]).groupby("rec"):
        want[g.id.to_numpy()] = self_updating(g[["x", "y"]].to_numpy(), 6, 1.2)
    assert np.allclose(got[["z_x", "z_y"]], want)


def test_labelled_rolling_z_small_blocks(df, pdf):
    got = by_id(series.labelled_rolling_z(df, ["rec"], ["t", "id"], ["y"], F.col("lab") == 0, 4, block_rows=9))
    want = np.zeros(len(pdf))
    for _, g in pdf.sort_values(["t", "id"]).groupby("rec"):
        past = []
        for r in g.itertuples():
            if len(past) >= 2:
                w = np.array(past[-4:])
                want[r.id] = (r.y - w.mean()) / max(w.std(), 1e-6)
            if r.lab == 0:
                past.append(r.y)
    assert np.allclose(got.z_y, want)


def test_constant_feature_gives_zero(spark):
    d = spark.range(50).select("id", F.lit(1).alias("rec"), F.lit(3.0).alias("x"))
    assert series.rolling_z(d, ["rec"], ["id"], ["x"], 5, block_rows=8).filter("z_x <> 0").count() == 0
    assert series.baseline_z(d, ["rec"], ["x"], F.lit(True)).filter("z_x <> 0").count() == 0


def test_vote_is_monotone_in_k(df):
    v = series.sequence_vote(df, ["rec"], ["t", "id"], F.col("x") > 20, [(5, 2), (5, 3), (5, 4)], block_rows=13)
    assert v.filter("alert_5_3 > alert_5_2 OR alert_5_4 > alert_5_3").count() == 0


def test_gap_is_strict(spark):
    d = spark.createDataFrame([(0, 0), (1, 1200), (2, 2401), (3, 2401)], "id long, t long").withColumn("rec", F.lit(1))
    s = events.gap_sessions(d, ["rec"], "t", ["id"], 1200, block_rows=2).toPandas().sort_values("start_t")
    assert s.start_t.tolist() == [0, 2401] and s.end_t.tolist() == [1203, 2404] and s.centre.tolist() == [600.0, 2401.0]


def test_windows_are_half_open(spark):
    rows = spark.createDataFrame([(1, 99), (1, 100), (1, 199), (1, 200)], "rec int, t long")
    win = spark.createDataFrame([(1, 100, 200)], "rec int, a long, b long")
    got = intervals.interval_join(rows, win, ["rec"], "t", "a", "b", 60).toPandas()
    assert sorted(got.t) == [100, 199]


@pytest.mark.parametrize("width", [1, 7, 60])
def test_quiet_neighbours_and_overlap_against_brute_force(spark, df, pdf, width):
    ev = pdf[pdf.lab == 1]
    e = spark.createDataFrame(ev[["rec", "t"]].rename(columns={"t": "et"}))
    got = set(intervals.quiet(df, e, ["rec"], "t", "et", width).toPandas().id)
    want = {r.id for r in pdf.itertuples() if not (np.abs(ev[ev.rec == r.rec].t - r.t) < width).any()}
    assert got == want
    near = intervals.nearest(df, e, ["rec"], "t", "et", [], block_rows=17).toPandas()
    for r in near.itertuples():
        gap = np.abs(ev[ev.rec == r.rec].t - r.t)
        assert (r.nearest is None) == gap.empty
        if r.nearest is not None:
            assert abs(r.nearest["et"] - r.t) == gap.min()


def test_events_elsewhere(spark, df, pdf):
    ev = pdf[pdf.lab == 1].drop_duplicates("t")
    e = spark.createDataFrame(ev[["rec", "t"]].rename(columns={"t": "et"}))
    got = intervals.neighbours(df.select("id", "rec", "t"), e, [], "t", "et", ["rec"], same_time_is_before=False, own="rec", block_rows=13).toPandas()
    for r in got.itertuples():
        past, ahead = ev[(ev.rec != r.rec) & (ev.t < r.t)], ev[(ev.rec != r.rec) & (ev.t >= r.t)]
        assert (r.prev["et"] if r.prev is not None else None) == (past.t.max() if len(past) else None)
        assert (r.next["et"] if r.next is not None else None) == (ahead.t.min() if len(ahead) else None)
