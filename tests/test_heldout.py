"""Fits of all training sets at once against one fit at a time in NumPy."""

import numpy as np
import pytest

from fieldhush.operators import heldout


def fit_alone(x, y, pca, reg, balanced):
    n = len(y)
    mean, std = x.mean(0), x.std(0, ddof=1)
    z = np.where(std > 1e-9, (x - mean) / np.where(std > 0, std, 1), 0)
    if pca:
        value, vector = np.linalg.eigh(np.cov(z.T))
        top = np.argsort(-value)[:pca]
        z = z @ vector[:, top] / np.sqrt(value[top])
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum()))) if balanced else np.ones(n)
    a, b = np.hstack([np.ones((n, 1)), z]), np.zeros(z.shape[1] + 1)
    ridge = np.full(len(b), reg * w.sum())
    ridge[0] = 0
    for _ in range(200):
        p = 1 / (1 + np.exp(-a @ b))
        h = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.lstsq(h, a.T @ (w * (y - p)) - ridge * b, rcond=None)[0]
        b = b + step * min(1, 4 / max(abs(step).max(), 1e-12))
        if abs(step).max() < 1e-11:
            break
    return lambda t: 1 / (1 + np.exp(-(b[0] + (np.where(std > 1e-9, (t - mean) / np.where(std > 0, std, 1), 0) @ (vector[:, top] / np.sqrt(value[top]) if pca else np.eye(t.shape[1]))) @ b[1:])))


@pytest.fixture(scope="module")
def table():
    rnd = np.random.default_rng(4)
    n = 900
    g = np.where(np.arange(n) < 300, "hot", [f"g{i}" for i in rnd.integers(0, 7, n)])  # a third of the rows in one group
    x = rnd.standard_normal((n, 6)) * [1, 5, 0.1, 2, 1, 0] + [0, 100, 0, -3, 0, 7]
    x[:, 4] += 0.8 * x[:, 0]
    y = (x[:, 0] + 0.3 * (x[:, 1] - 100) + rnd.standard_normal(n) * 2 > 1.5).astype(int)
    return g, x, y


@pytest.mark.parametrize(("pca", "balanced", "only"), [(None, True, False), (3, True, False), (None, False, True), (2, True, True)])
def test_all_fits_at_once(spark, table, pca, balanced, only):
    g, x, y = table
    rows = [(i, str(a), int(b), [float(v) for v in c]) for i, (a, b, c) in enumerate(zip(g, y, x, strict=True))]
    df = spark.createDataFrame([*rows, (-1, None, 1, [0.0] * 6), (-2, "g1", None, [0.0] * 6), (-3, "g2", 1, None)], "i long, grp string, y int, x array<double>").repartition(5)
    models = heldout.fit_groups(df, "grp", "y", "x", pca=pca, reg=0.01, balanced=balanced, only=only)
    got = {r.i: r.score for r in heldout.held_out_scores(df, models, "grp", "x").collect()}
    assert len(got) == len(rows) + 3
    for name in set(g):
        mine = g == name
        train = mine if only else ~mine
        want = fit_alone(x[train], y[train], pca, 0.01, balanced)(x[mine])
        assert np.allclose([got[i] for i in np.flatnonzero(mine)], want, atol=2e-6), name
    # Each model again from the table of all rows x models.
    every = heldout.all_scores(df.filter("i = 5"), models, "grp", "x")
    assert every.count() == len(set(g)) and {r.score for r in every.collect() if r.model == g[5]} == {got[5]}


def test_sets_without_both_classes(spark):
    rows = [(i, "ab"[i % 2], i % 2, [float(i)]) for i in range(20)] + [(20 + i, "c", i % 2, [float(i)]) for i in range(8)]
    df = spark.createDataFrame(rows, "i long, grp string, y int, x array<double>")
    alone = {r.grp: (r.intercept is None, r.n_train, r.pos_train) for r in heldout.fit_groups(df, "grp", "y", "x", only=True).collect()}
    assert alone == {"a": (True, 10, 0), "b": (True, 10, 10), "c": (False, 8, 4)}
    assert {r.grp: (r.n_pos, r.n_neg) for r in heldout.usable_groups(df, "grp", "y").collect()} == {"c": (4, 4)}
    assert heldout.fit_groups(df.limit(0), "grp", "y", "x").count() == 0
    with pytest.raises(RuntimeError):
        heldout.fit_groups(df, "grp", "y", "x", rounds=1)
