"""Mixture, permutation importance and alignment of all sites against plain NumPy."""

import numpy as np
from pyspark.sql import functions as F

from fieldhush.operators import models


def em(x, centres, iters, floor=1e-6):
    k = len(centres)
    r = np.eye(k)[((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)]
    last = -np.inf
    for i in range(iters + 1):
        n = r.sum(0) + 10 * np.finfo(float).eps
        w, mean = n / n.sum(), (r.T @ x) / n[:, None]
        var = (r.T @ x**2) / n[:, None] - mean**2 + floor
        logp = np.log(w) - 0.5 * (((x[:, None] - mean[None]) ** 2 / var[None]).sum(2) + np.log(2 * np.pi * var).sum(1))
        top = logp.max(1, keepdims=True)
        ll = (top[:, 0] + np.log(np.exp(logp - top).sum(1))).mean()
        r = np.exp(logp - top) / np.exp(logp - top).sum(1, keepdims=True)
        if abs(ll - last) < 1e-3:
            break
        last = ll
    n = r.sum(0)
    mean = (r.T @ x) / n[:, None]
    return n / n.sum(), mean, (r.T @ x**2) / n[:, None] - mean**2 + floor, ll


def test_diagonal_mixture(spark):
    rng = np.random.default_rng(2)
    true = rng.normal(size=(4, 5)) * 3
    x = np.concatenate([c + rng.normal(size=(150, 5)) * rng.uniform(0.3, 1.2, 5) for c in true])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(5)
    start = true + rng.normal(size=true.shape)
    got = models.diagonal_mixture(df, "x", start)
    w, mean, var, ll = em(x, start, 200)
    assert np.allclose(got.weight, w, atol=1e-6) and np.allclose(got.mean, mean, atol=1e-5) and np.allclose(got.var, var, atol=1e-4) and abs(got.log_likelihood - ll) < 1e-6


def test_mixture_states_are_all_used(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=8) * 4 + rng.normal(size=(60, 8)) for _ in range(6)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<double>")
    out = models.mixture_states(models.with_vector(df, "x"), F.col("i") % 5 != 0, k=6, pca=4).toPandas()
    assert out.state.nunique() == 6 and (out.groupby(out.i // 60).state.agg(lambda s: (s == s.mode()[0]).mean()) > 0.95).all()


def auc(s, y):
    s, y = np.round(s, 9), y.astype(bool)
    return ((s[y][:, None] > s[~y][None]) + 0.5 * (s[y][:, None] == s[~y][None])).mean()


def test_permutation_importance(spark):
    import hashlib

    rng = np.random.default_rng(4)
    x, g = rng.normal(size=(120, 4)), rng.integers(0, 3, 120)
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=120) > 0).astype(int)
    w, b = np.array([1.0, 0.4, 0.0, -0.2]), 0.1
    df = spark.createDataFrame([(i, int(a), int(c), v.tolist()) for i, (a, c, v) in enumerate(zip(g, y, x, strict=True))], "i int, g int, y int, x array<double>").repartition(4)
    model = spark.createDataFrame([(b, w.tolist())], "intercept double, coefficients array<double>")
    got = {(r.g, r.feature): r["drop"] for r in models.permutation_importance(df, "g", ["i"], "x", "y", model, 3).collect()}
    for k in range(3):
        at = np.flatnonzero(g == k)
        s = x[at] @ w + b
        for j in range(4):
            drops = []
            for rep in range(3):
                order = sorted(at, key=lambda i: hashlib.md5(f"perm|{rep}|{i}".encode()).hexdigest())  # noqa: B023
                drops.append(auc(s, y[at]) - auc(s + w[j] * (x[order, j] - x[at, j]), y[at]))
            assert abs(got[k, j] - np.mean(drops)) < 1e-9


def test_coral_pairs(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, i % 3, (rng.normal(size=4) * (1 + i % 3) + i % 3).tolist()) for i in range(150)], "i int, rec int, x array<double>").repartition(4)
    every = models.coral_pairs(df, "rec", [0, 1, 2], "x").toPandas()
    assert len(every) == 300
    for a, b in ((0, 1), (2, 0)):
        one = models.coral(df.filter(F.col("rec") == a), df.filter(F.col("rec") == b), "x").toPandas().sort_values("i")
        got = every[(every.rec == a) & (every.target == b)].sort_values("i")
        assert np.allclose(np.stack(got.aligned), np.stack(one.aligned))
