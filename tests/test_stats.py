"""Hand-worked p-values, fixed effects against dense algebra, permutation and leave-one-out identities."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldhush.functions import pvalues as PV
from fieldhush.operators import panel, stats
from fieldhush.operators.series import benjamini_hochberg, holm


def test_exact_p_values():
    assert PV.rank_sum_p(0, 3, 3, 0) == pytest.approx(0.1)
    assert PV.rank_sum_p(17, 4, 5, 0) == pytest.approx(1 / 9)
    assert PV.signed_rank_p(0, 5, 0, 0) == pytest.approx(0.0625)
    assert PV.signed_rank_p(3, 6, 0, 0) == pytest.approx(0.15625)
    assert PV.sign_p(8, 2) == pytest.approx(0.109375)
    assert PV.binomial_tail(7, 10) == pytest.approx(0.171875)
    assert PV.student_two_sided(2.0, 10) == pytest.approx(0.0733880348)
    assert sum(PV.rank_sum_counts(5, 7)) == math.comb(12, 5)


def test_exact_p_values_have_no_size_limit():
    """The values on both sides of any product of the sample sizes or number of coins follow one formula."""
    for n2 in (6666, 6667, 20000):
        assert PV.rank_sum_p(0, 3, n2, 0) == pytest.approx(2 / math.comb(n2 + 3, 3), rel=1e-12)
    for n in (999_999, 1_000_001):
        k = n // 2 + 700
        assert PV.binomial_tail(k, n) == pytest.approx(0.5 * math.erfc((k - 0.5 - n / 2) / math.sqrt(n / 4) / math.sqrt(2)), rel=1e-3)
    for n, k in ((1, 1), (10, 7), (30, 15), (30, 0), (30, 30)):
        assert PV.binomial_tail(k, n) == pytest.approx(sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n, rel=1e-12)


def test_binomial_tail_stays_exact_for_many_coins():
    assert PV.binomial_tail(5100, 10000) == pytest.approx(0.5 * math.erfc(99.5 / 50 / math.sqrt(2)), rel=1e-3)


def test_signed_rank_and_leave_one_out(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(0.3, 1, 31), 1)  # rounding makes ties and zeros
    d = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "g int, u long, d double")

    def w_plus(x):
        x = x[x != 0]
        return pd.Series(np.abs(x)).rank()[x > 0].sum()

    got = stats.signed_rank(d, ["g"], "d").first()
    assert got.w_plus == pytest.approx(w_plus(v)) and got["median"] == pytest.approx(np.median(v))
    loo = stats.leave_one_out(d, ["g"], "u", "d").toPandas().sort_values("u")
    for i, r in zip(range(len(v)), loo.itertuples()):
        rest = np.delete(v, i)
        nz = rest[rest != 0]
        c = pd.Series(np.abs(nz)).value_counts().to_numpy(float)
        assert r.loo_median == pytest.approx(np.median(rest)) and r.loo_below == (rest < 0).sum()
        assert r.loo_w == pytest.approx(w_plus(rest))
        assert r.loo_p == pytest.approx(PV.signed_rank_p(w_plus(rest), len(nz), (c ** 3 - c).sum(), len(rest) - len(nz)))


def test_spearman_p(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 9, 40).astype(float)
    b = a + rng.integers(0, 9, 40)
    d = spark.createDataFrame(pd.DataFrame({"g": 1, "a": a, "b": b}))
    r = stats.spearman(d, ["g"], "a", "b").first()
    rho = np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1]
    assert r.rho == pytest.approx(rho) and r.p == pytest.approx(PV.spearman_p(rho, 40))


def test_spearman_of_all_pairs(spark):
    """Every two units as by ``spearman``, in blocks, with ties, missing items and a constant unit; the items of a pair are no rows."""
    rng = np.random.default_rng(7)
    rows = [(u, j, float(rng.integers(0, 6)) if u != 5 else 1.0) for u in range(11) for j in range(9) if (u, j) not in {(2, 3), (4, 0), (4, 1), (4, 2), (4, 8)}]
    d = spark.createDataFrame([*rows, (8, 100, None), (None, 1, 1.0)], "u long, item int, v double").repartition(3)
    a, b = (d.select(F.col("u").alias(f"u_{k}"), "item", F.col("v").alias(w)) for k, w in (("a", "x"), ("b", "y")))
    want = {(r.u_a, r.u_b): (r.n, r.rho) for r in stats.spearman(a.join(b, "item").filter("u_a < u_b"), ["u_a", "u_b"], "x", "y").collect()}
    out = stats.spearman_pairs(d, "u", "item", "v", block_units=4)
    got = {(r.u_a, r.u_b): (r.n, r.rho) for r in out.collect()}
    assert got.keys() == want.keys() and len(got) == 55
    for k, (n, rho) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(rho, abs=1e-12), k


def test_corrections_are_ordered(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.2]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    out = benjamini_hochberg(holm(d, [], "p", ["i"]), [], "p", ["i"]).toPandas().sort_values("i")
    assert out.p_holm.tolist() == pytest.approx([0.04, 0.09, 0.09, 0.025, 0.2])
    assert out.p_fdr.tolist() == pytest.approx([0.025, 0.05, 0.05, 0.025, 0.2])
    assert (out.p_holm >= out.p - 1e-12).all()


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(8)
    n = 400
    f1, f2 = rng.integers(0, 12, n), rng.integers(0, 7, n)
    x1 = (rng.random(n) < 0.2 + 0.05 * f2).astype(float)
    x2 = (rng.random(n) < 0.3).astype(float)
    y = 0.5 * f1 - 0.3 * f2 + 1.5 * x1 - 0.7 * x2 + rng.normal(size=n)
    return pd.DataFrame({"id": range(n), "f1": f1, "f2": f2, "x1": x1, "x2": x2, "y": y, "c": f1 % 5})


def dense(c, xs, y):
    """Least squares with a column for every level of both factors."""
    d = np.column_stack([pd.get_dummies(c.f1).to_numpy(float), pd.get_dummies(c.f2).to_numpy(float)])
    resid = lambda v: v - d @ np.linalg.lstsq(d, v, rcond=None)[0]
    x = np.column_stack([resid(c[k].to_numpy()) for k in xs])
    r = resid(c[y].to_numpy())
    return x, r, np.linalg.lstsq(x, r, rcond=None)[0]


def test_fixed_effects_match_dense_least_squares(spark, cells):
    df = spark.createDataFrame(cells)
    x, r, beta = dense(cells, ["x1", "x2"], "y")
    got = panel.fixed_effects_ols(df, "f1", "f2", "y", ["x1", "x2"], cluster="c").toPandas()
    assert got.beta.tolist() == pytest.approx(beta.tolist(), abs=1e-6)
    inv, e = np.linalg.pinv(x.T @ x), r - x @ beta
    meat = sum(np.outer(x[i].T @ e[i], x[i].T @ e[i]) for i in [np.flatnonzero(cells.c == k) for k in cells.c.unique()])
    assert got.se.tolist() == pytest.approx(np.sqrt(np.diag(inv @ meat @ inv)).tolist(), rel=1e-5)
    dm = panel.demean(df, "f1", "f2", ["y"])
    for f in ("f1", "f2"):
        assert dm.groupBy(f).agg(F.abs(F.avg("r_y")).alias("m")).agg(F.max("m")).first()[0] < 1e-6


def test_sparse_fits_equal_dense_fits(spark, cells):
    """Permuted indicators, fitted from their non-zero rows only, give the dense coefficients."""
    df = spark.createDataFrame(cells)
    rows = panel.demean(df, "f1", "f2", ["y"]).select("id", "f1", "f2", "r_y")
    hits, want = [], {}
    for p in range(3):
        c = cells.copy()
        if p:
            c[["x1", "x2"]] = c[["x1", "x2"]].sample(frac=1, random_state=p).to_numpy()
        want[p] = dense(c, ["x1", "x2"], "y")[2]
        h = c[(c.x1 != 0) | (c.x2 != 0)][["id", "x1", "x2"]].assign(perm=p)
        hits.append(h)
    hits = spark.createDataFrame(pd.concat(hits)).join(rows, "id")
    n = df.groupBy("f1", "f2").agg(F.count("*").alias("n"))
    got = panel.sparse_fits(n, hits, "perm", "f1", "f2", "n", [["x1", "x2"], ["x1"]], "r_y").collect()
    assert len(got) == 3
    for r in got:
        assert r.beta[:2] == pytest.approx(want[r.perm].tolist(), abs=1e-5)


def test_sparse_fits_in_blocks(spark):
    """Both factors share a slot: one small system per slot gives the coefficients of the whole panel."""
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame([(d, r, s) for d in range(9) for r in range(4) for s in range(3) if rng.random() > 0.15], columns=["d", "r", "s"])
    pdf = pdf.assign(f1=pdf.d.astype(str) + "|" + pdf.s.astype(str), f2=pdf.r.astype(str) + "|" + pdf.s.astype(str), id=range(len(pdf)),
                     y=rng.normal(size=len(pdf)), x1=(rng.random(len(pdf)) < 0.2) * 1.0, x2=(rng.random(len(pdf)) < 0.2) * 1.0)
    df = spark.createDataFrame(pdf)
    want = dense(pdf, ["x1", "x2"], "y")[2]
    rows = panel.demean(df, "f1", "f2", ["y"]).filter("x1 <> 0 or x2 <> 0").withColumn("perm", F.lit(0))
    got = panel.sparse_fits(df.groupBy("f1", "f2").agg(F.count("*").alias("n")), rows, "perm", "f1", "f2", "n", [["x1", "x2"]], "r_y", F.substring_index("f2", "|", -1))
    assert got.first().beta == pytest.approx(want.tolist(), abs=1e-6)


def test_schedule_permutation_is_a_permutation(spark):
    d = spark.createDataFrame([(d, r) for d in range(4) for r in range(6)], "day int, rec int")
    g = panel.schedule_permutations(d, "day", "rec", 5, "5").toPandas()
    assert (g[g.perm == 0].rec == g[g.perm == 0].source).all()
    for _, x in g.groupby(["perm", "day"]):
        assert sorted(x.rec) == sorted(x.source) == list(range(6))
