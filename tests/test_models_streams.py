"""Models on data with a planted effect; streams over several micro-batches equal the batch operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldhush.operators import evaluate, models, sampling, series
from fieldhush.streaming import online


@pytest.fixture(scope="module")
def planted(spark):
    """10 sessions at 5 recorders, 8 shifted features in the positives, a shift per session."""
    rng = np.random.default_rng(42)
    rows = []
    for s in range(10):
        shift = rng.normal(size=20)
        for i in range(40):
            y = int(s in (1, 2, 5) and rng.random() < 0.6 or s not in (1, 2, 5) and rng.random() < 0.2)
            x = rng.normal(size=20) + 0.3 * shift
            x[:8] += 0.9 * y
            rows.append((s * 40 + i, s, s % 5, y, x.tolist()))
    d = spark.createDataFrame(rows, "id long, session int, rec int, label int, v array<double>")
    return models.with_vector(d, "v").cache()


def test_group_folds_never_share_a_group(planted):
    f = sampling.group_folds(planted, "session", 3, "1")
    assert sampling.leaks(f, "session", "fold").count() == 0
    assert f.count() == 400 and f.select("fold").distinct().count() == 3


def test_held_out_scores_find_the_planted_effect(planted):
    f = sampling.group_folds(planted, "session", 2, "1").cache()
    s = models.cross_validate(f, "fold", range(2), lambda t: models.fit_pipeline(t, "label", models.logistic(), pca=10))
    assert s.count() == 400
    assert evaluate.roc_auc(s, [], "score", "label").first().auc > 0.75


def test_probe_keeps_no_model(planted):
    """Guesses are read from written rows: a plan that keeps the models of all folds holds every class's counts in every node."""
    f = sampling.group_folds(planted, "rec", 2, "1").cache()
    out = models.probe(f.select("id", "session", "fold", "features"), "session", "fold", range(2), models.forest(5))
    assert out.count() == 400 and "UDF" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 2


def test_forest_is_the_same_with_nodes_kept_in_the_tasks(planted):
    fit = lambda c: c.setFeaturesCol("features").setLabelCol("session").fit(planted)
    a, b = fit(models.forest(7)), fit(models.forest(7).setCacheNodeIds(False))
    assert models.forest().getCacheNodeIds() and a.toDebugString.split("\n")[1:] == b.toDebugString.split("\n")[1:]


def test_ratio_steps_keep_what_each_ratio_keeps(spark):
    rows = [(i, i % 3, int(i % 7 == 0 and i % 3 > 0)) for i in range(200)]  # group 0 has no positive
    d = spark.createDataFrame(rows, "id long, g int, y int").repartition(3)
    steps = sampling.ratio_steps(d, ["g"], ["id"], "y", [1, 2, 3, 9], "42")
    for i, ratio in enumerate([1, 2, 3, 9]):
        want = {r.id for r in sampling.ratio_capped(d, ["g"], ["id"], "y", ratio, "42").collect()}
        assert {r.id for r in steps.filter(F.col("from_ratio") <= i).collect()} == want and want


def test_anomaly_scores_rank_outliers_high(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    x[:10] += 6
    d = spark.createDataFrame([(i, int(i < 10), r.tolist()) for i, r in enumerate(x)], "id long, label int, v array<double>")
    iso = models.isolation_forest(d, "v", F.col("label") == 0, ["id"], trees=40, sample=64)
    assert evaluate.roc_auc(iso, [], "isolation", "label").first().auc > 0.98
    rec = models.reconstruction_error(d, "v", F.col("label") == 0, 2)
    assert evaluate.roc_auc(rec, [], "recon_error", "label").first().auc > 0.9


def test_ridge_error_and_coral_against_numpy(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(80, 6)), rng.normal(size=(80, 2))
    d = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "id long, x array<double>, y array<double>").repartition(3)
    got = models.autoregressive_error(d, "x", "y", F.lit(True)).toPandas().sort_values("id").ar_error
    xc, yc = x - x.mean(0), y - y.mean(0)
    beta = np.linalg.solve(xc.T @ xc + np.eye(6), xc.T @ yc)
    want = ((yc - xc @ beta) ** 2).mean(axis=1)
    assert np.allclose(got, want)
    moved = np.stack(models.coral(d, d.withColumn("x", F.transform("x", lambda v: 2 * v + 1)), "x").toPandas().aligned)
    assert np.allclose(moved.mean(0), 2 * x.mean(0) + 1) and np.allclose(np.cov(moved.T), 4 * np.cov(x.T), atol=0.05)


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Three files in time order, one micro-batch each, plus a late copy of old rows."""
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"id": np.arange(240), "rec": rng.integers(0, 3, 240), "t": np.sort(rng.integers(0, 5000, 240)), "x": rng.normal(size=240), "y": rng.normal(size=240)})
    folder = tmp_path_factory.mktemp("feed")
    for i, part in enumerate([pdf.iloc[:90], pdf.iloc[90:170], pdf.iloc[170:], pdf.iloc[:20]]):
        part.sample(frac=1, random_state=i).to_parquet(folder / f"part{i}.parquet")
        import os
        os.utime(folder / f"part{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.createDataFrame(pdf), str(folder)


def read(spark, feed):
    return spark.readStream.schema(feed[0].schema).option("maxFilesPerTrigger", 1).parquet(feed[1])


def scored(spark, tmp_path):
    """Rows in their place; the late copies of old rows are kept, and marked."""
    every = spark.read.parquet(str(tmp_path / "o")).toPandas()
    assert (every.late == 1).sum() == 20
    return every[every.late == 0]


def test_shuffled_files_lose_nothing(spark, feed, tmp_path):
    """Eight files without any time order, one to a micro-batch, and heartbeats after them."""
    import os

    pdf = feed[0].toPandas()
    beats = pdf.groupby("rec", as_index=False).t.max().assign(t=lambda d: d.t + 20_000)
    beats = pd.DataFrame({"id": pd.array([None] * len(beats), "Int64"), "rec": beats.rec, "t": beats.t, "x": np.nan, "y": np.nan})
    (tmp_path / "in").mkdir()
    for i in range(9):
        part = pdf[pdf.id % 8 == i] if i < 8 else beats
        part.to_parquet(tmp_path / "in" / f"p{i}.parquet")
        os.utime(tmp_path / "in" / f"p{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(feed[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    online.run_to_table(online.online_self_updating(stream, "rec", "t", "id", ["x", "y"], n=8, threshold=1.0, lateness=10_000), str(tmp_path / "o"), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "o")).toPandas().sort_values("id").reset_index(drop=True)
    want = series.self_updating_z(feed[0], ["rec"], ["t", "id"], ["x", "y"], n=8, threshold=1.0, block_rows=30).toPandas().sort_values("id").reset_index(drop=True)
    assert len(got) == 240 and (got.late == 0).all() and np.allclose(got[["z_x", "z_y"]], want[["z_x", "z_y"]])


def test_online_scorer_equals_batch(spark, feed, tmp_path):
    online.run_to_table(online.online_scorer(read(spark, feed), "rec", "t", "id", "x", n=8, votes=4, need=2), str(tmp_path / "o"), str(tmp_path / "c"))
    got = scored(spark, tmp_path).sort_values("id").reset_index(drop=True)
    from fieldhush.operators.blocks import ordered

    o = ordered(feed[0], ["rec"], ["t", "id"], before=12, block_rows=20)
    z = series.rolling_z_on(o, o.df, ["x"], 8)
    want = o.home(series.vote_on(o, z, F.abs("z_x") > 1.5, 2, 4)).toPandas().sort_values("id").reset_index(drop=True)
    assert len(got) == 240 and np.allclose(got.z, want.z_x) and (got.alert == want.alert).all()


def test_online_self_updating_equals_batch(spark, feed, tmp_path):
    online.run_to_table(online.online_self_updating(read(spark, feed), "rec", "t", "id", ["x", "y"], n=8, threshold=1.0), str(tmp_path / "o"), str(tmp_path / "c"))
    got = scored(spark, tmp_path).sort_values("id").reset_index(drop=True)
    want = series.self_updating_z(feed[0], ["rec"], ["t", "id"], ["x", "y"], n=8, threshold=1.0, block_rows=30).toPandas().sort_values("id").reset_index(drop=True)
    assert len(got) == 240 and np.allclose(got[["z_x", "z_y"]], want[["z_x", "z_y"]])
