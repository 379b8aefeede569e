"""Two-way fixed effects, cluster-robust errors and permutation nulls.

Means over two factors depend on the rows only through the count and sums of each factor pair, so
the rows are aggregated to those cells once and the alternating updates run on the cells. Indicator
columns are zero almost everywhere: their normal equations need the non-zero rows only, so a
permutation costs its hits and not another copy of the panel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldhush.operators.intervals import interval_join
from fieldhush.sources.scratch import materialize


PER_STEP = 2


def two_way_effects(cells: DataFrame, by: Sequence[str], f1: str, f2: str, n: str, sums: Sequence[str],
                    rounds: int = 500, tol: float = 1e-8, must_converge: bool = True) -> tuple[DataFrame, DataFrame]:
    """Additive effects of both factors for each summed column: (by, f1, a_<s>) and (by, f2, b_<s>).

    Alternates between the factors until no effect moves by ``tol``. Not reaching that in ``rounds`` is an error, unless
    the study's rule is a fixed number of rounds (``must_converge`` false).
    """
    by = list(by)
    cells = materialize(cells, "cells")
    nil = cells.select(*by, f2).distinct().select(*by, f2, *[F.lit(0.0).alias(f"b_{s}") for s in sums])
    b = nil

    def half(other: DataFrame, key: str, level: str, o: str, mine: str) -> DataFrame:
        return cells.join(other, [*by, key]).groupBy(*by, level).agg(*[
            (F.sum(F.col(s) - F.col(n) * F.col(f"{o}_{s}")) / F.sum(n)).alias(f"{mine}_{s}") for s in sums])

    for _ in range(0, rounds, PER_STEP):
        # A few rounds per written step; the change is checked against the step before.
        new = b
        for _ in range(PER_STEP):
            new = half(half(new, f2, f1, "b", "a"), f1, f2, "a", "b")
        old = b.select(*by, f2, *[F.col(f"b_{s}").alias(f"__o_{s}") for s in sums])
        moved = F.greatest(F.lit(0.0), *[F.abs(F.col(f"b_{s}") - F.col(f"__o_{s}")) for s in sums])
        step = materialize(new.join(old, [*by, f2]).select(*by, f2, *[f"b_{s}" for s in sums], moved.alias("__moved")), "effects")
        b = step.drop("__moved")
        last = step.agg(F.max("__moved")).first()[0]
        if last is None or last < tol:
            break
    else:
        if must_converge:
            raise ArithmeticError(f"the effects still move by {last} after {rounds} rounds")
    return materialize(half(b, f2, f1, "b", "a"), "effects"), b


def demean(df: DataFrame, f1: str, f2: str, values: Sequence[str], rounds: int = 500, tol: float = 1e-8, prefix: str = "r_") -> DataFrame:
    """Rows with ``r_<v>``: each value with the means of both factors removed."""
    cells = df.groupBy(f1, f2).agg(F.count("*").alias("__n"), *[F.sum(F.col(v).cast("double")).alias(v) for v in values])
    a, b = two_way_effects(cells, [], f1, f2, "__n", values, rounds, tol)
    out = df.join(a, f1).join(b, f2)
    return out.select(*df.columns, *[(F.col(v) - F.col(f"a_{v}") - F.col(f"b_{v}")).alias(f"{prefix}{v}") for v in values])


def _gram_columns(xs: Sequence[str], ys: Sequence[str], y: str) -> list[Column]:
    return [F.sum(F.col(x) * F.col(z)) for x in xs for z in ys] + [F.sum(F.col(x) * F.col(y)) for x in xs]


def fixed_effects_ols(df: DataFrame, f1: str, f2: str, y: str, terms: Sequence[str], cluster: str | None = None) -> DataFrame:
    """(term, beta, se): OLS on the demeaned columns, errors clustered by ``cluster`` when given.

    Sums of products are Spark aggregates; only a terms x terms system is solved on the driver.
    """
    k = len(terms)
    rows = materialize(demean(df, f1, f2, [y, *terms]), "demeaned")
    xs = [f"r_{t}" for t in terms]
    s = rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(_gram_columns(xs, xs, f"r_{y}"))]).first()
    g = np.array([s[f"c{i}"] for i in range(k * k)], float).reshape(k, k)
    beta = np.linalg.lstsq(g, np.array([s[f"c{k * k + i}"] for i in range(k)], float), rcond=None)[0]
    se = np.full(k, np.nan)
    if cluster:
        fit = sum((float(b) * F.col(x) for b, x in zip(beta, xs)), F.lit(0.0))
        e = rows.withColumn("__e", F.col(f"r_{y}") - fit)
        per = e.groupBy(cluster).agg(*[F.sum(F.col(x) * F.col("__e")).alias(f"q{i}") for i, x in enumerate(xs)])
        m = per.agg(*[F.sum(F.col(f"q{i}") * F.col(f"q{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
        meat = np.array([[m[f"m{i}_{j}"] for j in range(k)] for i in range(k)], float)
        inv = np.linalg.pinv(g)
        se = np.sqrt(np.clip(np.diag(inv @ meat @ inv), 0, None))
    data = [(t, float(b), float(v)) for t, b, v in zip(terms, beta, se)]
    return df.sparkSession.createDataFrame(data, "term string, beta double, se double")


def solve_column(gram: Column, rhs: Column) -> Column:
    """Least-norm solution of small normal equations held as flat arrays."""

    def run(rows: pd.DataFrame) -> pd.Series:
        out = []
        for g, r in zip(rows["g"], rows["r"]):
            k = len(r)
            m = np.asarray(g, float).reshape(k, k)
            keep = np.diag(m) > 1e-9
            beta = np.full(k, np.nan)
            if keep.any():
                beta[keep] = np.linalg.lstsq(m[np.ix_(keep, keep)], np.asarray(r, float)[keep], rcond=None)[0]
            out.append(beta.tolist())
        return pd.Series(out)

    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(F.struct(gram.alias("g"), rhs.alias("r")))


def _pseudo_inverse(entries: DataFrame, block: str) -> DataFrame:
    """(block, p, q, v): pseudo-inverse of each block's symmetric matrix, given by its entries (block, p, q, v)."""
    kind = entries.schema[block].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        levels, at = np.unique(np.concatenate([pdf["p"], pdf["q"]]), return_inverse=True)
        m = np.zeros((len(levels), len(levels)))
        np.add.at(m, (at[: len(pdf)], at[len(pdf):]), pdf["v"].to_numpy(float))
        inv = np.linalg.pinv(m, rcond=1e-10, hermitian=True)
        i, j = np.nonzero(np.abs(inv) > 0)
        return pd.DataFrame({block: [pdf[block].iloc[0]] * len(i), "p": levels[i], "q": levels[j], "v": inv[i, j]})

    level = entries.schema["p"].dataType.simpleString()
    return entries.groupBy(block).applyInPandas(run, f"{block} {kind}, p {level}, q {level}, v double")


def sparse_fits(cells: DataFrame, hits: DataFrame, perm: str, f1: str, f2: str, n: str, systems: Sequence[Sequence[str]], y: str, block: Column | None = None) -> DataFrame:
    """(perm, beta array) of y (already demeaned) on two-way demeaned indicator columns, for every permutation in ``hits``.

    ``cells`` has the row count of each factor pair, ``hits`` the rows where any indicator is not zero. Each of ``systems`` is a regression
    of its own; their coefficients follow each other in ``beta``. Demeaning is exact and needs the hits only. With x an indicator, A its
    sums over the levels of factor 1, and u its sums over those of factor 2 less what factor 1 explains of them, the products of the demeaned columns are
    x'z - sum(A B / n1) - u' S^+ w, where S is the normal matrix of factor 2 with factor 1 removed. S is made once from the cells. It has a
    block for each value of ``block``, an expression of factor 2 that both factors share; without one it is a single block of levels x levels.
    """
    terms = list(dict.fromkeys(t for sys in systems for t in sys))
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    cells = cells.select(f1, f2, F.col(n).cast("double").alias("__n"))
    n1 = cells.groupBy(f1).agg(F.sum("__n").alias("__n1"))
    share = materialize(cells.join(n1, f1).select(f1, f2, "__n", "__n1", (F.col("__n") / F.col("__n1")).alias("__w")), "cells")
    group = block if block is not None else F.lit(0)
    other = share.select(f1, F.col(f2).alias("q"), F.col("__n").alias("__m"))
    off = share.join(other, f1).groupBy(F.col(f2).alias("p"), "q").agg((-F.sum(F.col("__w") * F.col("__m"))).alias("v"))
    diagonal = share.groupBy(F.col(f2).alias("p")).agg(F.sum("__n").alias("v")).select("p", F.col("p").alias("q"), "v")
    key = share.select(F.col(f2).alias("p"), group.alias("__block")).distinct()
    inverse = materialize(_pseudo_inverse(off.unionByName(diagonal).join(key, "p").select("__block", "p", "q", "v"), "__block"), "inverse")
    s = materialize(hits.groupBy(perm, f1, f2).agg(*[F.sum(t).alias(t) for t in terms]), "hits")
    a = s.groupBy(perm, f1).agg(*[F.sum(t).alias(t) for t in terms])
    explained = a.join(share, f1).select(perm, f2, *[(-F.col("__w") * F.col(t)).alias(t) for t in terms])
    u = materialize(s.select(perm, f2, *terms).unionByName(explained).groupBy(perm, f2).agg(*[F.sum(t).alias(t) for t in terms]), "left")
    v = u.join(inverse.select(F.col("q").alias(f2), "p", "v"), f2).groupBy(perm, F.col("p").alias(f2)).agg(*[F.sum(F.col("v") * F.col(t)).alias(f"__v_{t}") for t in terms])

    def products(df: DataFrame, left: Sequence[Column], right: Sequence[Column], name: str) -> DataFrame:
        return df.groupBy(perm).agg(F.array(*[F.sum(left[i] * right[j]) for i, j in pairs]).alias(name))

    cols = [F.col(t) for t in terms]
    raw = hits.groupBy(perm).agg(F.array(*[F.sum(cols[i] * cols[j]) for i, j in pairs]).alias("__x"), F.array(*[F.sum(c * F.col(y)) for c in cols]).alias("__r"))
    first = products(a.join(n1, f1), [c / F.col("__n1") for c in cols], cols, "__a")
    second = products(u.join(v, [perm, f2]), cols, [F.col(f"__v_{t}") for t in terms], "__u")
    g = raw.join(first, perm).join(second, perm)
    at = {p: i for i, p in enumerate(pairs)}

    def entry(s_: str, t_: str) -> Column:
        i = at[tuple(sorted((terms.index(s_), terms.index(t_))))]
        return F.col("__x")[i] - F.col("__a")[i] - F.col("__u")[i]

    betas = [solve_column(F.array(*[entry(x, z) for x in sys for z in sys]), F.array(*[F.col("__r")[terms.index(t)] for t in sys])) for sys in systems]
    return g.select(perm, F.concat(*betas).alias("beta"))


def permutation_p(fits: DataFrame, perm: str, terms: Sequence[str], real: int = 0) -> DataFrame:
    """(term, beta, p_lower, p_two_sided, n_perm) from fits where ``perm == real`` is the true one."""
    long = materialize(fits, "fits").select(perm, F.posexplode("beta").alias("i", "b")).filter(~F.isnan("b"))
    true = long.filter(F.col(perm) == real).select("i", F.col("b").alias("beta"))
    null = long.filter(F.col(perm) != real).join(true, "i").groupBy("i", "beta").agg(
        F.count("*").alias("n_perm"), F.count_if(F.col("b") <= F.col("beta")).alias("lo"),
        F.count_if(F.abs("b") >= F.abs("beta")).alias("far"), F.stddev_samp("b").alias("null_sd"))
    name = F.element_at(F.array(*[F.lit(t) for t in terms]), F.col("i") + 1)
    return null.select(name.alias("term"), "beta", ((1 + F.col("lo")) / (1 + F.col("n_perm"))).alias("p_lower"),
                       ((1 + F.col("far")) / (1 + F.col("n_perm"))).alias("p_two_sided"), "null_sd", "n_perm")


def schedule_permutations(day_recs: DataFrame, day: str, rec: str, n: int, seed: str) -> DataFrame:
    """(perm, day, rec, source): recorders permuted within each day in hash order; perm 0 is the identity.

    The windows sort the recorders of one day, a list as long as the fleet.
    """
    g = day_recs.select(day, rec).distinct().withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n))))
    key = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in ("perm", day, rec)]))
    part = Window.partitionBy("perm", day)
    g = g.withColumn("__i", F.row_number().over(part.orderBy(rec))).withColumn("__h", F.row_number().over(part.orderBy(key, rec)))
    g = g.withColumn("__j", F.when(F.col("perm") == 0, F.col("__i")).otherwise(F.col("__h")))
    src = g.select("perm", day, F.col("__j").alias("__i"), F.col(rec).alias("source"))
    return g.select("perm", day, "__i", rec).join(src, ["perm", day, "__i"]).drop("__i")


def shifted_sessions(options: DataFrame, session: Sequence[str], offset: str, n: int, seed: str) -> DataFrame:
    """(perm, session, offset): for perm 1..n one hashed choice among each session's allowed day offsets."""
    g = options.select(*session, offset).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n))))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("perm").cast("string"), *[F.col(c).cast("string") for c in (*session, offset)]))
    return g.groupBy("perm", *session).agg(F.min_by(offset, F.struct(key, F.col(offset))).alias(offset))


def lag_hits(rows: DataFrame, sessions: DataFrame, by: Sequence[str], t: str, keys: Sequence[str], steps: dict[str, tuple[Column, Column]],
             bucket: int) -> DataFrame:
    """(keys, row columns, 0/1 per step) for rows inside any step window; ``keys`` (such as perm) come from sessions."""
    spans = sessions.select(*keys, *by, F.explode(F.array(*[
        F.struct(F.lit(s).alias("s"), a.alias("a"), b.alias("b")) for s, (a, b) in steps.items()])).alias("__w"))
    spans = spans.select(*keys, *by, F.col("__w.s").alias("__s"), F.col("__w.a").alias("__a"), F.col("__w.b").alias("__b")).distinct()
    hit = interval_join(rows, spans, by, t, "__a", "__b", bucket)
    return hit.groupBy(*keys, *rows.columns).agg(*[F.max(F.when(F.col("__s") == s, 1.0).otherwise(0.0)).alias(s) for s in steps])
