"""The scorers on event-time timers equal the batch operators, whatever the order of files, and go on from history."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldhush.operators import series
from fieldhush.operators.blocks import ordered
from fieldhush.streaming import online, timed


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    n = 260
    return pd.DataFrame({"id": np.arange(n), "rec": rng.choice(4, n, p=[0.4, 0.3, 0.3, 0.0]), "t": rng.integers(0, 9000, n), "x": rng.normal(size=n), "y": rng.normal(size=n)})


def beat(at):
    return pd.DataFrame({"id": pd.array([None], "Int64"), "rec": [0], "t": [at], "x": [np.nan], "y": [np.nan]})


def streamed(spark, rows, tmp_path, scorer, files):
    """Each entry of ``files`` is a run on one checkpoint, over the files it adds."""
    folder = tmp_path / "in"
    folder.mkdir()
    schema = spark.createDataFrame(rows).schema
    k = 0
    for run in files:
        for part in run:
            part.to_parquet(folder / f"p{k}.parquet")
            k += 1
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        with timed.rocks_state(spark):
            online.run_to_table(scorer(stream), str(tmp_path / "o"), str(tmp_path / "c"))
    return spark.read.parquet(str(tmp_path / "o")).toPandas().sort_values("id").reset_index(drop=True)


def batch(spark, rows):
    df = spark.createDataFrame(rows)
    o = ordered(df, ["rec"], ["t", "id"], before=12, block_rows=20)
    z = series.rolling_z_on(o, o.df, ["x"], 8)
    return o.home(series.vote_on(o, z, F.abs("z_x") > 1.5, 2, 4)).toPandas().sort_values("id").reset_index(drop=True)


def test_scorer_on_shuffled_files(spark, rows, tmp_path):
    scorer = lambda s: timed.timed_scorer(s, "rec", "t", "id", "x", n=8, votes=4, need=2, lateness=10_000, width=900)
    parts = [rows[rows.id % 3 == i] for i in range(3)]
    got, want = streamed(spark, rows, tmp_path, scorer, [parts, [beat(30_000)]]), batch(spark, rows)
    assert len(got) == len(rows) and np.allclose(got.z, want.z_x) and (got.alert == want.alert).all()


def test_self_updating_in_one_file(spark, rows, tmp_path):
    scorer = lambda s: timed.timed_self_updating(s, "rec", "t", "id", ["x", "y"], n=8, threshold=1.0, width=2000)
    got = streamed(spark, rows, tmp_path, scorer, [[rows.sample(frac=1, random_state=1)], [beat(30_000)]])
    want = series.self_updating_z(spark.createDataFrame(rows), ["rec"], ["t", "id"], ["x", "y"], n=8, threshold=1.0, block_rows=30).toPandas().sort_values("id").reset_index(drop=True)
    assert len(got) == len(rows) and np.allclose(got[["z_x", "z_y"]], want[["z_x", "z_y"]])


def test_scorer_goes_on_from_history(spark, rows, tmp_path):
    """Rows before 4500 are history; the stream scores the others as if it had seen them. A recorder without history starts afresh."""
    rows = pd.concat([rows, rows[rows.rec == 1].assign(rec=3, id=lambda d: d.id + 1000).query("t >= 4500")])
    old, new = rows[rows.t < 4500], rows[rows.t >= 4500]
    seed = timed.scorer_seed(spark.createDataFrame(old), "rec", "t", "id", "x", n=8, votes=4, need=2)
    scorer = lambda s: timed.timed_scorer(s, "rec", "t", "id", "x", n=8, votes=4, need=2, lateness=10_000, width=900, seed=seed)
    got = streamed(spark, rows, tmp_path, scorer, [[new, beat(60_000)]])
    want = batch(spark, rows)
    want = want[want.t >= 4500].reset_index(drop=True)
    assert len(got) == len(new) and np.allclose(got.z, want.z_x) and (got.alert == want.alert).all()


def test_needs_the_store(spark, tmp_path):
    stream = spark.readStream.schema("id long, rec int, t long, x double").parquet(str(tmp_path))
    with pytest.raises(ValueError, match="providerClass"):
        timed.timed_scorer(stream, "rec", "t", "id", "x")


def test_rows_that_wait_are_not_written_again(rows):
    """What comes into a bucket is written once, however much waits there; the timer takes all of it, in order."""
    from types import SimpleNamespace

    from pyspark.sql import types as T

    written = []

    class State(dict):
        containsKey, getValue, removeKey = dict.__contains__, dict.__getitem__, dict.__delitem__

        def updateValue(self, key, value):
            written.append(len(value[0]) if len(value) == 3 else 0)
            self[key] = value

    maps = {}
    handle = SimpleNamespace(getValueState=lambda *a: SimpleNamespace(exists=lambda: False, update=lambda v: None), registerTimer=lambda at: None,
                             getMapState=lambda name, *a: maps.setdefault(name, State()))
    p = timed._Timed("rec", "t", "id", ["x"], [T.StructField("z", T.DoubleType()), T.StructField("alert", T.IntegerType())], online.scorer_run(8, 1.5, 4, 2), 10_000)
    p.init(handle)
    parts = [rows.assign(rec=1)[rows.id % 26 == k] for k in range(26)]
    list(p.handleInputRows((1,), iter(parts), None))
    assert max(written) == written[0]
    (got,) = p.handleExpiredTimer((1,), None, SimpleNamespace(getExpiryTimeInMs=lambda: 10_000_000))
    assert got.id.tolist() == rows.sort_values(["t", "id"]).id.tolist()
    assert not any(maps.values())


def test_frames_are_gathered_before_they_are_written(rows, monkeypatch):
    """Each call of the state is a message: 26 frames over 9 buckets are one part a bucket, or as many as ``PART_ROWS`` makes. Rows without a time are left out."""
    from types import SimpleNamespace

    calls = []

    class State(dict):
        containsKey, getValue = dict.__contains__, dict.__getitem__

        def updateValue(self, key, value):
            calls.append(key)
            self[key] = value

    def wait():
        calls.clear()
        maps, timers = {}, []
        handle = SimpleNamespace(getValueState=lambda *a: None, registerTimer=timers.append, getMapState=lambda name, *a: maps.setdefault(name, State()))
        p = timed._Timed("rec", "t", "id", ["x", "y"], [T.StructField("z", T.DoubleType())], None, 1000)
        p.init(handle)
        odd = pd.DataFrame({"id": [9000, np.nan], "rec": 1, "t": [np.nan, 5], "x": 0.0, "y": 0.0})
        list(p.handleInputRows((1,), iter([*(rows[rows.id % 26 == k] for k in range(26)), odd]), None))
        got = {k[0]: np.concatenate([np.frombuffer(v[1], np.int64) for j, v in maps["waiting"].items() if j[0] == k[0]]) for k in maps["parts"]}
        assert {k: sorted(v) for k, v in got.items()} == rows.groupby(rows.t // 1000).id.apply(sorted).to_dict()
        assert sorted(timers) == [(k + 1) * 1_000_000 for k in range(9)]
        return len(calls)

    assert wait() == 2 * 9
    monkeypatch.setattr(timed, "PART_ROWS", 100)
    assert 2 * 9 < wait() <= 2 * 9 * 3


def test_state_has_few_partitions_where_recorders_are_few(spark):
    """A partition of the state costs each micro-batch the same with and without a recorder; recorders spread over those there are."""
    from collections import Counter

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        for recs in ([0, 1, 2, 3, 4, 5], [None, 7], [7] * 5):
            d = spark.createDataFrame([(r,) for r in recs], "rec int")
            n = timed.state_partitions(d, "rec")
            at = Counter(r.p for r in d.distinct().select(F.expr(f"pmod(hash(rec), {n})").alias("p")).collect())
            assert n <= 4 * len(set(recs)) + 1 and max(at.values()) == 1
        assert timed.state_partitions(spark.range(1000), "id") == 200
        assert timed.state_partitions(spark.range(0), "id") == 1
        with timed.rocks_state(spark, 7):
            assert spark.conf.get("spark.sql.shuffle.partitions") == "7"
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_replay_keeps_state_for_its_recorders_only(spark, tmp_path, monkeypatch):
    """The state of a replay is dealt to as few partitions as its recorders need, not to the session's number."""
    from fieldhush.plans import q_sources

    ev = pd.DataFrame({"event_id": np.arange(400), "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.arange(400) * 600, "s"), "user_id": np.arange(400) % 6,
                       "event_type": "view", "value": np.arange(400) % 17 / 3.0, "props": '{"k": 7}'})
    spark.createDataFrame(ev).write.parquet(str(tmp_path / "events.parquet"))
    seen = []
    real = q_sources.online.run_to_table

    def spy(stream, *a):
        seen.append(int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return real(stream, *a)

    monkeypatch.setattr(q_sources.online, "run_to_table", spy)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        out = q_sources.replay(spark, str(tmp_path), lambda stream, late: timed.timed_scorer(stream, "rec", "t", "clip_id", "x1", lateness=late))
        assert out.count() == 400 and len(seen) == 2 and set(seen) == {17}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
