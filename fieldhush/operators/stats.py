"""Rank tests, sign tests, correlations and matched comparisons.

Ranks and counts are Spark aggregates over groups of any size; only the finished statistics, one
row per test, reach the p-value functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldhush.functions import pvalues as PV
from fieldhush.operators.intervals import interval_join
from fieldhush.operators.ranks import medians, value_ranks

# Normal quantiles at 0.975 and 0.8.
Z_975 = 1.959963984540054
Z_80 = 0.8416212335729143


# ---- tests -----------------------------------------------------------------

def mann_whitney(df: DataFrame, by: Sequence[str], value: str, first: Column, least: int = 3) -> DataFrame:
    """U of the rows where ``first`` holds against the others, z and two-sided p; null p below ``least`` rows a side."""
    f = first.cast("long")
    r = value_ranks(df, by, value, {"k": f})
    n = F.col("n").cast("double")
    g = r.groupBy(*by).agg(F.sum("k").alias("n1"), F.sum(F.col("n") - F.col("k")).alias("n2"),
                           F.sum(F.col("k") * F.col("avg_rank")).alias("__r"), F.sum(n * n * n - n).alias("ties"))
    g = g.withColumn("u", F.col("__r") - F.col("n1") * (F.col("n1") + 1) / 2).drop("__r")
    enough = (F.col("n1") >= least) & (F.col("n2") >= least)
    return g.withColumn("p", PV.rank_sum_p_col(F.when(enough, F.col("u")), F.col("n1"), F.col("n2"), F.col("ties")))


def signed_rank(df: DataFrame, by: Sequence[str], diff: str) -> DataFrame:
    """W+ of the non-zero differences with counts, median and two-sided p."""
    by = list(by)
    d = df.filter(F.col(diff).isNotNull())
    nz = d.filter(F.col(diff) != 0).withColumn("__a", F.abs(diff))
    r = value_ranks(nz, by, "__a", {"k": (F.col(diff) > 0).cast("long")})
    n = F.col("n").cast("double")
    g = r.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("up"), F.sum(F.col("k") * F.col("avg_rank")).alias("w_plus"),
                           F.sum(n * n * n - n).alias("ties"))
    total = d.groupBy(*by).agg(F.count("*").alias("rows"))
    mid = medians(d, by, [diff]).select(*by, F.col(diff).alias("median"))
    out = total.join(mid, by).join(g, by, "left") if by else total.crossJoin(F.broadcast(mid)).crossJoin(F.broadcast(g))
    out = out.fillna(0, ["n", "up"]).withColumn("down", F.col("n") - F.col("up")).withColumn("zeros", F.col("rows") - F.col("n"))
    return out.withColumn("p", PV.signed_rank_p_col(F.col("w_plus"), F.col("n"), F.col("ties"), F.col("zeros"))).drop("rows")


def sign_test(df: DataFrame, by: Sequence[str], diff: str) -> DataFrame:
    """Ups, downs and the exact two-sided binomial p."""
    g = df.groupBy(*by).agg(F.count_if(F.col(diff) > 0).alias("up"), F.count_if(F.col(diff) < 0).alias("down"))
    return g.withColumn("p_sign", PV.sign_p_col(F.when(F.col("up") + F.col("down") > 0, F.col("up")), F.col("down")))


def direction_test(df: DataFrame, by: Sequence[str], observed: str, expected: str) -> DataFrame:
    """How many non-zero signs match the expected ones, with the one-sided binomial p."""
    d = df.filter(F.col(observed) != 0)
    g = d.groupBy(*by).agg(F.count("*").alias("tested"), F.count_if(F.signum(observed) == F.signum(expected)).alias("agree"))
    return g.withColumn("p_agree", PV.tail_p_col(F.col("agree"), F.col("tested")))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, least: int = 6) -> DataFrame:
    """Correlation of average ranks with its t-based p; null below ``least`` complete pairs."""
    by = list(by)
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    d = d.groupBy(*by, x, y).agg(F.count("*").alias("__w"))  # equal pairs carry a weight
    side = lambda c, out: _weighted_ranks(d, by, c, out)
    r = d.join(side(x, "__rx"), [*by, x]).join(side(y, "__ry"), [*by, y])
    w, a, b = (F.col(c).cast("double") for c in ("__w", "__rx", "__ry"))
    s = r.groupBy(*by).agg(F.sum("__w").alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * b).alias("sab"),
                           F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"))
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n"), F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")
    s = s.withColumn("rho", F.when(F.col("n") >= least, F.try_divide(cov, F.sqrt(va * vb))))
    return s.select(*by, "n", "rho").withColumn("p", PV.spearman_p_col(F.col("rho"), F.col("n")))


def spearman_pairs(df: DataFrame, unit: str, item: str, value: str, least: int = 6, block_units: int = 256) -> DataFrame:
    """``spearman`` of every two units over the items that both have a value for: (unit_a, unit_b, n, rho, p) with unit_a < unit_b.

    Items are few (features) and a unit has at most one value for each, so a unit is one short vector. Units meet in blocks: a task holds two
    blocks, ranks a unit once, and a matrix product gives all correlations of the two. Items of pairs are never rows.
    """
    import numpy as np
    import pandas as pd

    from fieldhush.operators.blocks import number_rows
    from fieldhush.sources.scratch import materialize, sized

    d = df.filter(F.col(unit).isNotNull() & F.col(value).isNotNull()).select(F.col(unit).alias("u"), F.col(item).alias("i"), F.col(value).cast("double").alias("v"))
    places = sized(number_rows(d.select("i").distinct(), [], ["i"]).withColumnRenamed("__pos", "at"))
    last = places.agg(F.max("at")).first()[0]
    held = d.join(places, "i").groupBy("u").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(last or 0)).cast("array<long>"), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(float("nan"))))
    rows = number_rows(held.select("u", dense.alias("x")), [], ["u"]).withColumn("block", F.expr(f"__pos div {block_units}"))
    blocks = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("__pos", "u", "x"))).alias("r"))
    blocks = materialize(blocks.select("block", F.transform("r", lambda r: r["u"]).alias("u"), F.flatten(F.transform("r", lambda r: r["x"])).alias("x")), "blocks")
    a, b = (blocks.select(F.col("block").alias(f"b{k}"), F.col("u").alias(f"u{k}"), F.col("x").alias(f"x{k}")) for k in "ab")

    def ranks(x: np.ndarray) -> np.ndarray:
        """Average ranks less their mean; null values have no rank."""
        r = pd.DataFrame(x).rank(axis=1).to_numpy()
        return r - (np.isfinite(r).sum(1, keepdims=True) + 1) / 2

    def run(frames):
        for f in frames:
            for r in f.itertuples():
                xa, xb = (np.asarray(x, float).reshape(len(u), -1) for u, x in ((r.ua, r.xa), (r.ub, r.xb)))
                whole_a, whole_b = (~np.isnan(x).any(1) for x in (xa, xb))
                za, zb = (np.nan_to_num(ranks(x)) for x in (xa, xb))
                n = np.full((len(xa), len(xb)), xa.shape[1])
                cov, var = za @ zb.T, np.outer((za * za).sum(1), (zb * zb).sum(1))
                # Where a value is missing, the ranks are those among the items of both.
                for i, j in zip(*np.nonzero(~(whole_a[:, None] & whole_b[None])), strict=True):
                    both = ~(np.isnan(xa[i]) | np.isnan(xb[j]))
                    ra, rb = ranks(xa[i : i + 1, both])[0], ranks(xb[j : j + 1, both])[0]
                    n[i, j], cov[i, j], var[i, j] = both.sum(), ra @ rb, (ra @ ra) * (rb @ rb)
                i, j = np.nonzero(n > 0) if r.ba != r.bb else np.nonzero(np.triu(n > 0, 1))
                rho = np.where((n >= least) & (var > 0), cov / np.sqrt(np.where(var > 0, var, 1)), np.nan)
                for at in range(0, len(i), 1 << 16):
                    p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                    yield pd.DataFrame({"a": np.asarray(r.ua)[p], "b": np.asarray(r.ub)[q], "n": n[p, q], "rho": rho[p, q]})

    kind = dict(d.dtypes)["u"]
    # Blocks meet by equality keys, so the cells are dealt over the tasks: a block goes once to each block.
    count = rows.agg(F.max("block").alias("k"))
    cells = a.crossJoin(F.broadcast(count)).withColumn("bb", F.explode(F.sequence(F.col("ba"), F.col("k")))).repartition("ba", "bb")
    out = cells.join(b, "bb").select("ba", "bb", "ua", "xa", "ub", "xb").mapInPandas(run, f"a {kind}, b {kind}, n long, rho double")
    out = out.select(F.col("a").alias(f"{unit}_a"), F.col("b").alias(f"{unit}_b"), "n", F.when(~F.isnan("rho"), F.col("rho")).alias("rho"))
    return out.withColumn("p", PV.spearman_p_col(F.col("rho"), F.col("n")))


def _weighted_ranks(d: DataFrame, by: list[str], c: str, out: str) -> DataFrame:
    from fieldhush.operators.blocks import ordered, running

    h = d.groupBy(*by, c).agg(F.sum("__w").alias("__n"))
    cum = running(ordered(h, by, [c]), {"__cum": ("sum", "__n")})
    return cum.select(*by, c, (F.col("__cum") - F.col("__n") + (F.col("__n") + 1) / 2).alias(out))


def smallest_effect(df: DataFrame, by: Sequence[str], value: str, kind: str, case: str = "visit") -> DataFrame:
    """Change detectable with 80% power given the spread of the placebo rows."""
    is_case = F.col(kind) == case
    g = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count_if(is_case).alias("n"), F.count_if(~is_case).alias("m"), F.stddev_samp(F.when(~is_case, F.col(value))).alias("sd"))
    reach = (Z_975 + Z_80) * F.col("sd") * F.sqrt(F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.lit(1.0), F.col("m")))
    return g.withColumn("smallest_effect", reach)


# ---- matched comparisons ---------------------------------------------------

def matched_difference(df: DataFrame, visit: Sequence[str], kind: str, values: Sequence[str], case: str = "visit",
                       prefix: str = "d_") -> DataFrame:
    """Each visit's value minus the median over its own placebo windows; visits lacking either are dropped.

    A visit has at most one placebo window per recorded day, so its median is over a short list.
    """
    is_case = F.col(kind) == case
    one = lambda v: F.max(F.when(is_case, F.col(v)))
    mid = lambda v: F.median(F.when(~is_case, F.col(v)))
    g = df.groupBy(*visit).agg(*[(one(v) - mid(v)).alias(f"{prefix}{v}") for v in values])
    return g.filter(F.greatest(*[F.col(f"{prefix}{v}").isNotNull().cast("int") for v in values], F.lit(0)) == 1)


def step_levels(rows: DataFrame, windows: DataFrame, by: Sequence[str], t: str, anchor: str, step: int, first: int, last: int,
                aggs: Sequence[Column], least: int = 1) -> DataFrame:
    """Per window and signed step (``floor((t - anchor) / step)``): n and aggregates, for first <= step < last."""
    w = windows.withColumn("__a", F.col(anchor) + first * step).withColumn("__b", F.col(anchor) + last * step)
    hit = interval_join(rows, w, by, t, "__a", "__b", step * (last - first))
    hit = hit.withColumn("step", F.floor((F.col(t) - F.col(anchor)) / step).cast("int"))
    return hit.groupBy(*windows.columns, "step").agg(F.count("*").alias("n"), *aggs).filter(F.col("n") >= least)


def part_levels(rows: DataFrame, parts: DataFrame, by: Sequence[str], t: str, start: str, end: str, aggs: Sequence[Column],
                least: int = 1, bucket: int = 7200) -> DataFrame:
    hit = interval_join(rows, parts, by, t, start, end, bucket)
    return hit.groupBy(*parts.columns).agg(F.count("*").alias("n"), *aggs).filter(F.col("n") >= least)


def time_course(effects: DataFrame, by: Sequence[str], value: str, star: float = 0.75) -> DataFrame:
    """Per step: number of visits, median effect, share up, and a star when ``star`` of them go the same way."""
    d = effects.filter(F.col(value).isNotNull())
    mid = medians(d, by, [value]).select(*by, F.col(value).alias("median"))
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(value) > 0).cast("double")).alias("share_up"))
    same = (F.col("share_up") >= star) | (F.col("share_up") <= 1 - star)
    return g.join(mid, list(by)).withColumn("star", same)


def step_contrast(levels: DataFrame, by: Sequence[str], step: str, value: str, chosen: Sequence[int], base: Sequence[int],
                  out: str, least_chosen: int | None = None) -> DataFrame:
    """Mean over the chosen steps minus mean over the base steps; units with too few of either are dropped."""
    pick = lambda s: F.when(F.col(step).isin(*s), F.col(value))
    g = levels.groupBy(*by).agg(F.avg(pick(chosen)).alias("__c"), F.count(pick(chosen)).alias("__nc"),
                                F.avg(pick(base)).alias("__b"), F.count(pick(base)).alias("__nb"))
    need = len(chosen) if least_chosen is None else least_chosen
    return g.filter((F.col("__nc") >= need) & (F.col("__nb") >= 1)).select(*by, (F.col("__c") - F.col("__b")).alias(out))


def shape_contrast(levels: DataFrame, by: Sequence[str], step: str, value: str, centre: Sequence[int], early: Sequence[int],
                   late: Sequence[int]) -> DataFrame:
    """Middle of the visit minus the mean of both edges, and minus the early edge; one step of a set may be missing."""
    def mean(steps: Sequence[int]) -> Column:
        inside = F.when(F.col(step).isin(*steps), F.col(value))
        return F.when(F.count(inside) >= max(1, len(steps) - 1), F.avg(inside))

    g = levels.groupBy(*by).agg(mean(centre).alias("__c"), mean(early).alias("__e"), mean(late).alias("__l"))
    edges = F.when(F.col("__e").isNull(), F.col("__l")).when(F.col("__l").isNull(), F.col("__e")).otherwise((F.col("__e") + F.col("__l")) / 2)
    return g.select(*by, (F.col("__c") - edges).alias("both_edges"), (F.col("__c") - F.col("__e")).alias("early_edge"))


def contrast_tests(df: DataFrame, measure: str, value: str, kind: str, case: str = "visit") -> DataFrame:
    """Visits against placebo windows per measure: medians, Mann-Whitney p and its Holm correction."""
    from fieldhush.operators.series import holm

    t = mann_whitney(df.filter(F.col(value).isNotNull()), [measure], value, F.col(kind) == case)
    mid = medians(df, [measure, kind], [value]).groupBy(measure).agg(
        F.max(F.when(F.col(kind) == case, F.col(value))).alias("median_visit"), F.max(F.when(F.col(kind) != case, F.col(value))).alias("median_placebo"))
    return holm(t.join(mid, measure), [], "p", [measure])


def minute_reaction(rows: DataFrame, unit: Sequence[str], minute: str, level: str, flag: str, base: tuple[int, int], least_base: int,
                    least: int) -> DataFrame:
    """Per unit and minute: median level minus the baseline median, change of the share of quiet rows (below the
    baseline's lower quartile) and of the flag share. Baseline minutes are ``base[0] <= minute < base[1]``."""
    from fieldhush.operators.ranks import percentiles

    unit = list(unit)
    b = rows.filter((F.col(minute) >= base[0]) & (F.col(minute) < base[1]))
    q = percentiles(b, unit, level, [0.25, 0.5])
    cuts = q.groupBy(*unit).agg(F.max(F.when(F.col("q") == 0.25, F.col(level))).alias("__p25"),
                                F.max(F.when(F.col("q") == 0.5, F.col(level))).alias("__mid"), F.max("n").alias("__nb"))
    cuts = cuts.filter(F.col("__nb") >= least_base)
    quiet = (F.col(level) < F.col("__p25")).cast("double")
    base_share = b.join(cuts, unit).groupBy(*unit).agg(F.avg(quiet).alias("__q0"), F.avg(F.col(flag).cast("double")).alias("__f0"))
    share = rows.join(cuts, unit).groupBy(*unit, minute).agg(F.count("*").alias("n"), F.avg(quiet).alias("__q"), F.avg(F.col(flag).cast("double")).alias("__f"))
    mid = medians(rows, [*unit, minute], [level]).select(*unit, minute, F.col(level).alias("__m"))
    out = share.filter(F.col("n") >= least).join(base_share, unit).join(cuts.select(*unit, "__mid"), unit).join(mid, [*unit, minute])
    return out.select(*unit, minute, "n", (F.col("__m") - F.col("__mid")).alias("d_level"), (F.col("__q") - F.col("__q0")).alias("d_quiet"),
                      (F.col("__f") - F.col("__f0")).alias("d_flag"))


def leave_one_out(df: DataFrame, by: Sequence[str], unit: str, value: str) -> DataFrame:
    """For every unit the median, number below zero and signed-rank p of the others; groups of one unit are dropped.

    Dropping one value moves the ranks of larger absolute values by 1 and of equal ones by a half, so
    all answers follow from the ranks of the whole group; nothing is paired with everything else.
    """
    from fieldhush.operators.series import row_index

    by = list(by)
    d = df.filter(F.col(value).isNotNull()).select(*by, unit, F.col(value).alias("v"))
    rows = row_index(d, by, ["v", unit], "r")
    size = rows.groupBy(*by).agg(F.max("r").alias("n"), F.count_if(F.col("v") < 0).alias("neg"))
    rows = rows.join(size.filter("n > 1"), by)
    m = F.expr("n div 2")
    near = rows.filter((F.col("r") >= m - 1) & (F.col("r") <= m + 2)).groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("r") - m).cast("int"), F.col("v")))).alias("mid"))
    at = lambda i: F.try_element_at("mid", F.lit(i))
    odd = F.when(F.col("r") <= m, (at(1) + at(2)) / 2).when(F.col("r") == m + 1, (at(0) + at(2)) / 2).otherwise((at(0) + at(1)) / 2)
    even = F.when(F.col("r") <= m, at(1)).otherwise(at(0))
    out = rows.join(near, by).withColumn("loo_median", F.when(F.col("n") % 2 == 1, odd).otherwise(even))
    out = out.withColumn("loo_below", F.col("neg") - (F.col("v") < 0).cast("int"))

    nz = rows.filter("v <> 0").withColumn("a", F.abs("v"))
    ranks = value_ranks(nz, by, "a", {"k": (F.col("v") > 0).cast("long")})
    cube = lambda c: c * c * c - c
    n = F.col("n").cast("double")
    whole = ranks.groupBy(*by).agg(F.sum("n").alias("nn"), F.sum("k").alias("kk"), F.sum(F.col("k") * F.col("avg_rank")).alias("ww"), F.sum(cube(n)).alias("tt"))
    each = ranks.join(whole, by).select(*by, "a", F.col("n").alias("t"), F.col("k").alias("kt"), (F.col("kk") - F.col("k_cum")).alias("above"), "avg_rank")
    out = out.withColumn("a", F.abs("v")).join(each, [*by, "a"], "left").join(whole, by)
    pos = (F.col("v") > 0).cast("int")
    w = F.when(F.col("v") == 0, F.col("ww")).otherwise(F.col("ww") - pos * F.col("avg_rank") - F.col("above") - 0.5 * (F.col("kt") - pos))
    left = F.when(F.col("v") == 0, F.col("nn")).otherwise(F.col("nn") - 1)
    t = F.col("t").cast("double")
    ties = F.when(F.col("v") == 0, F.col("tt")).otherwise(F.col("tt") - cube(t) + cube(t - 1))
    zeros = F.col("n") - 1 - left
    return out.select(*by, unit, "v", "loo_median", "loo_below", w.alias("loo_w"), PV.signed_rank_p_col(w, left, ties, zeros).alias("loo_p"))


# ---- covariates ------------------------------------------------------------

def clock_shift(hourly: DataFrame, hour_t: str, value: str, peak: float = 13.5, reach: int = 12) -> DataFrame:
    """Whole-hour shift that puts the daily peak of the mean nearest ``peak`` o'clock; the smallest shift wins a tie."""
    h = hourly.groupBy(F.floor((F.col(hour_t) % 86400) / 3600).cast("int").alias("h")).agg(F.avg(value).alias("m"))
    shifted = h.select(F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("shift"), "h", "m").withColumn("lh", F.pmod(F.col("h") - F.col("shift"), F.lit(24)))
    best = shifted.groupBy("shift").agg(F.max_by("lh", F.struct("m", -F.col("lh"))).alias("peak_hour"))
    err = F.abs(F.col("peak_hour") - peak)
    return best.agg(F.min_by(F.struct("shift", "peak_hour"), F.struct(err, F.col("shift"))).alias("s")).select("s.*")


def closest_placebo(df: DataFrame, visit: Sequence[str], kind: str, value: str, covariate: str, case: str = "visit") -> DataFrame:
    """Visit minus the placebo window whose covariate is closest to the visit's; one without a covariate is taken only if all lack it."""
    visit = list(visit)
    v = df.filter(F.col(kind) == case).select(*visit, F.col(value).alias("__v"), F.col(covariate).alias("__c"))
    p = df.filter(F.col(kind) != case).join(v, visit)
    gap = F.abs(F.col(covariate) - F.col("__c"))
    g = p.groupBy(*visit).agg(F.min_by(F.struct(value, covariate), F.struct(gap.isNull(), gap, F.col(covariate), F.col(value))).alias("__p"),
                              F.max("__v").alias("__v"), F.max("__c").alias("__c"))
    return g.select(*visit, (F.col("__v") - F.col(f"__p.{value}")).alias("diff"), (F.col("__c") - F.col(f"__p.{covariate}")).alias("d_cov"))


def intercept_at_zero(df: DataFrame, by: Sequence[str], order: Sequence[str], x: str, y: str, draws: int, seed: str) -> DataFrame:
    """OLS intercept of y on x with a 95% bootstrap interval."""
    from fieldhush.operators.ranks import percentiles
    from fieldhush.operators.sampling import bootstrap_weights

    by = list(by)
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, *order, F.col(x).alias("x"), F.col(y).alias("y"))
    fit = d.groupBy(*by).agg(F.count("*").alias("n"), F.regr_intercept("y", "x").alias("intercept"), F.regr_slope("y", "x").alias("slope"))
    w = F.col("weight")
    s = bootstrap_weights(d, by, order, draws, seed).groupBy(*by, "draw").agg(
        F.sum(w).alias("w"), F.sum(w * F.col("x")).alias("wx"), F.sum(w * F.col("y")).alias("wy"),
        F.sum(w * F.col("x") * F.col("x")).alias("wxx"), F.sum(w * F.col("x") * F.col("y")).alias("wxy"))
    b = F.try_divide(F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy"), F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx"))
    boot = s.select(*by, ((F.col("wy") - b * F.col("wx")) / F.col("w")).alias("b0")).filter("b0 is not null")
    q = percentiles(boot, by, "b0", [0.025, 0.975]).groupBy(*by).agg(
        F.max(F.when(F.col("q") < 0.5, F.col("b0"))).alias("lo"), F.max(F.when(F.col("q") > 0.5, F.col("b0"))).alias("hi"))
    return fit.join(q, by) if by else fit.crossJoin(F.broadcast(q))


def residual_after(df: DataFrame, y: str, covariates: Sequence[str], out: str = "resid") -> DataFrame:
    """y minus its fitted dependence on the standardized covariates (the intercept stays in).

    One aggregation gives the moments; a system of ``len(covariates) + 1`` equations is solved on the driver.
    """
    import numpy as np

    d = df.filter(F.greatest(*[F.col(c).isNull().cast("int") for c in (y, *covariates)]) == 0)
    stats = d.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(covariates)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(covariates)])
    z = d.crossJoin(F.broadcast(stats))
    for i, c in enumerate(covariates):
        std = F.when(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"s{i}"))
        z = z.withColumn(f"__z{i}", (F.col(c) - F.col(f"m{i}")) / std)
    terms = [F.lit(1.0), *[F.col(f"__z{i}") for i in range(len(covariates))]]
    k = len(terms)
    sums = z.agg(*[F.sum(terms[i] * terms[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)],
                 *[F.sum(terms[i] * F.col(y)).alias(f"r{i}") for i in range(k)]).first()
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    coef = np.linalg.lstsq(gram, np.array([sums[f"r{i}"] for i in range(k)], float), rcond=None)[0]
    fitted = sum((float(coef[i + 1]) * F.col(f"__z{i}") for i in range(len(covariates))), F.lit(0.0))
    return z.withColumn(out, F.col(y) - fitted).select(*df.columns, out)
