"""Probes of targets with many classes: no table of classes x nodes x bins, and the models that MLlib fits."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler
from pyspark.sql import functions as F

from fieldhush.operators import many_classes, models


def planted(spark, classes, each, seed=3, noise=0.5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(classes, 9))
    rows = [(c * each + i, c, i % 2, (centre[c] + noise * rng.normal(size=9)).tolist()) for c in range(classes) for i in range(each)]
    return models.with_vector(spark.createDataFrame(rows, "id long, session int, fold int, v array<double>"), "v").repartition(3).cache()


@pytest.mark.parametrize("kind", ["linear", "forest"])
def test_probe_of_many_classes_is_not_fitted_by_mllib(spark, monkeypatch, kind):
    """MLlib's statistics of 300 sessions are 300 numbers for every node, feature and bin, in every task."""
    d = planted(spark, 300, 6)

    def refuse(*a, **kw):
        raise AssertionError("fitted by MLlib")

    monkeypatch.setattr(models, "Pipeline", refuse)
    clf = models.logistic() if kind == "linear" else models.forest(12)
    out = models.probe(d.select("id", "session", "fold", "features"), "session", "fold", range(2), clf).toPandas()
    assert sorted(out.id) == list(range(1800)) and (out.truth.astype(int) == out.session).all()
    assert (out.truth == out.guess).mean() > 0.1  # 1 / 300 by chance


def test_probe_of_few_classes_and_of_a_hot_class_stay_with_mllib(spark, monkeypatch):
    monkeypatch.setattr(models, "MANY_CLASSES", 5)
    monkeypatch.setattr(models, "CLASS_ROWS", 3)
    d = planted(spark, 6, 8).withColumn("__y", F.col("session").cast("double"))
    assert models._many_class_fit(d, models.forest(3), 7) is None and models._many_class_fit(d, models.logistic(), 7)
    assert models._many_class_fit(d, models.boosting(), 7) is None


def test_linear_guesses_are_those_of_mllib(spark):
    d = planted(spark, 12, 40, noise=1.5).withColumn("__y", F.col("session").cast("double")).cache()
    train, test = d.filter("fold = 0"), d.filter("fold = 1")
    clf = models.logistic().setFeaturesCol("__scaled").setLabelCol("__y")
    want = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="__scaled", withMean=True), clf]).fit(train).transform(test)
    want = {r.id: int(r.prediction) for r in want.select("id", "prediction").collect()}
    got = {r.id: r.guess for r in many_classes.linear_guesses(train, test, "id", "__y", "features", 13, 0.01, 50, 1e-6).collect()}
    assert got.keys() == want.keys() and np.mean([got[k] == want[k] for k in want]) > 0.98


def test_forest_finds_what_mllib_finds(spark):
    d = planted(spark, 12, 40).withColumn("__y", F.col("session").cast("double")).cache()
    train, test = d.filter("fold = 0"), d.filter("fold = 1")
    want = models.forest(20).setFeaturesCol("features").setLabelCol("__y").fit(train).transform(test).agg(F.avg(F.expr("int(prediction = __y)"))).first()[0]
    run = lambda: {r.id: r.guess for r in many_classes.forest_guesses(train, test, "id", "__y", "features", 20, 6, 42).collect()}
    got, truth = run(), {r.id: r.session for r in test.collect()}
    assert got.keys() == truth.keys() and abs(np.mean([got[k] == truth[k] for k in truth]) - want) < 0.1 and want > 0.5
    assert run() == got


def test_chunks_have_whole_classes(spark, monkeypatch):
    monkeypatch.setattr(many_classes, "CHUNK_ROWS", 10)
    monkeypatch.setattr(many_classes, "CHUNK_CLASSES", 3)
    d = planted(spark, 40, 4).withColumn("__y", F.col("session").cast("double"))
    chunks = many_classes._class_chunks(d, "__y", "features", many_classes._edges(d, "features")).collect()
    ys = [np.frombuffer(c.y, np.int32) for c in chunks]
    assert sorted(np.concatenate(ys)) == sorted(list(range(40)) * 4)
    assert sum(len(set(y)) for y in ys) == 40 and max(len(set(y)) for y in ys) <= 3
    assert all(len(c.x) == 9 * len(y) for c, y in zip(chunks, ys))


def test_best_split_is_the_one_of_all_pairs():
    rng = np.random.default_rng(1)
    y, x = rng.integers(0, 5, 200), rng.integers(0, 32, (200, 4))
    x[:, 2] = np.clip(y * 6 + rng.integers(0, 9, 200), 0, 31)
    gini = lambda v: 1 - sum((np.bincount(v) / max(len(v), 1)) ** 2)
    gain = {(f, b): gini(y) - sum(len(s) / 200 * gini(s) for s in (y[x[:, f] <= b], y[x[:, f] > b])) for f in range(4) for b in range(32) if 0 < (x[:, f] <= b).sum() < 200}
    sums = np.zeros((1, 4, 32, 3))
    for part in (y < 2, y >= 2):  # chunks of whole classes add up
        for f in range(4):
            left = np.stack([np.bincount(x[part & (y == c), f], minlength=32).cumsum() for c in range(5)]).astype(float)
            sums[0, f] += np.stack([left.sum(0), (left**2).sum(0), (left[:, -1:] * left).sum(0)], axis=1)
    f, b = many_classes._best_splits(sums, np.arange(4)[None])
    assert np.isclose(gain[f[0], b[0]], max(gain.values()))
    assert many_classes._best_splits(sums * 0, np.arange(4)[None])[0][0] == -1
