"""p-values of test statistics: vectorised columns over result rows (one row per test)."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The exact rank-sum test is for a smaller side of at most 8, the exact signed-rank test for at most 50 pairs.
RANK_SUM_EXACT, SIGNED_RANK_EXACT = 8, 50


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


@lru_cache(maxsize=256)
def rank_sum_counts(n: int, m: int, top: int | None = None) -> tuple[int, ...]:
    """How many of the C(n + m, n) orders give each U up to ``top``: coefficients of the Gaussian binomial."""
    size = (n * m if top is None else min(top, n * m)) + 1
    c = np.zeros(size, dtype=object)
    c[0] = 1
    for i in range(1, n + 1):
        up = c.copy()
        if m + i < size:
            up[m + i:] -= c[: size - m - i]
        for r in range(min(i, size)):
            up[r::i] = np.cumsum(up[r::i])
        c = up
    return tuple(c)


def rank_sum_p(u: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided Mann-Whitney p: exact for a small sample without ties, else normal with tie and continuity terms."""
    top = max(u, n1 * n2 - u)
    if min(n1, n2) <= RANK_SUM_EXACT and ties == 0:
        # The upper tail equals the lower one, which needs the counts of the small U only.
        low = n1 * n2 - int(math.ceil(top))
        return min(1.0, float(2 * sum(rank_sum_counts(min(n1, n2), max(n1, n2), low)) / math.comb(n1 + n2, n1)))
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    return min(1.0, math.erfc((top - n1 * n2 / 2 - 0.5) / math.sqrt(var) / math.sqrt(2)))


@lru_cache(maxsize=128)
def signed_rank_counts(n: int) -> tuple[int, ...]:
    c = [1]
    for i in range(1, n + 1):
        nxt = c + [0] * i
        for j, v in enumerate(c):
            nxt[j + i] += v
        c = nxt
    return tuple(c)


def signed_rank_p(w_plus: float, n: int, ties: float, zeros: int) -> float:
    """Two-sided Wilcoxon signed-rank p: exact up to 50 pairs without ties or zeros, else normal with the tie term."""
    if n == 0:
        return float("nan")
    low = min(w_plus, n * (n + 1) / 2 - w_plus)
    if n <= SIGNED_RANK_EXACT and ties == 0 and zeros == 0:
        counts = signed_rank_counts(n)
        return min(1.0, 2 * sum(counts[: int(low) + 1]) / sum(counts))
    var = (n * (n + 1) * (2 * n + 1) - ties / 2) / 24
    return normal_two_sided((low - n * (n + 1) / 4) / math.sqrt(var)) if var > 0 else 1.0


def binomial_tail(k: int, n: int) -> float:
    """P(X >= k) for n fair coins, by the incomplete beta function: exact in form for any n."""
    return 1.0 if k <= 0 else 0.0 if k > n else min(1.0, incomplete_beta(k, n - k + 1, 0.5))


def sign_p(up: int, down: int) -> float:
    n = up + down
    return float("nan") if n == 0 else min(1.0, 2 * binomial_tail(max(up, down), n))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, to 1e-14. It needs about sqrt(max(a, b)) terms."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000 + 20 * math.isqrt(int(max(a, b)) + 1)):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            return h
    raise ArithmeticError(f"the incomplete beta function of ({a}, {b}, {x}) does not converge")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def spearman_p(rho: float, n: int) -> float:
    if n < 3 or math.isnan(rho):
        return float("nan")
    if abs(rho) >= 1:
        return 0.0
    return student_two_sided(rho * math.sqrt((n - 2) / ((1 - rho) * (1 + rho))), n - 2)


def _column(fn, *cols: Column) -> Column:
    """``fn`` over the rows of a struct of the arguments; a null argument gives null."""

    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in r) else fn(*r) for r in rows.itertuples(index=False)], dtype="float64")

    udf = F.pandas_udf(run, "double")
    return udf(F.struct(*[c.cast("double").alias(f"a{i}") for i, c in enumerate(cols)]))


def rank_sum_p_col(u: Column, n1: Column, n2: Column, ties: Column) -> Column:
    return _column(lambda a, b, c, d: rank_sum_p(float(a), int(b), int(c), float(d)), u, n1, n2, ties)


def signed_rank_p_col(w: Column, n: Column, ties: Column, zeros: Column) -> Column:
    return _column(lambda a, b, c, d: signed_rank_p(float(a), int(b), float(c), int(d)), w, n, ties, zeros)


def sign_p_col(up: Column, down: Column) -> Column:
    return _column(lambda a, b: sign_p(int(a), int(b)), up, down)


def tail_p_col(k: Column, n: Column) -> Column:
    return _column(lambda a, b: binomial_tail(int(a), int(b)), k, n)


def spearman_p_col(rho: Column, n: Column) -> Column:
    return _column(lambda a, b: spearman_p(float(a), int(b)), rho, n)
