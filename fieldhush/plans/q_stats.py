"""Statistical queries (T rows, W19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldhush.functions import parse as P
from fieldhush.operators import intervals as J
from fieldhush.operators import panel as N
from fieldhush.operators import stats as S
from fieldhush.operators.aggregates import padded_median, species_share
from fieldhush.operators.ranks import medians, zero_medians
from fieldhush.operators.series import benjamini_hochberg, change_since
from fieldhush.plans.q_intervals import BUSY, CHOSEN, CONTROLS, PER_HOUR, chosen_placebos, controls, labelled_cells, sessions
from fieldhush.plans.registry import query, rnd
from fieldhush.plans.views import clips, ctes, panel, segments, sims, weather
from fieldhush.sources.scratch import materialize, sized

STEP = 7200
STUDY = f"""{ctes('placebos')}, {CHOSEN}, study AS (SELECT rec, start_t AS vid_t, 'visit' AS kind, start_t AS t0 FROM visits UNION ALL SELECT rec, visit_t, 'placebo', start_t FROM chosen)"""
LEVELS = f"""{STUDY}, lev AS (SELECT s.rec, s.vid_t, s.kind, s.t0, CAST(floor((c.t - s.t0) / {STEP}.0) AS INTEGER) AS step, count(*) AS n, round(avg(c.x1), 8) AS y, round(avg(c.x2), 8) AS y2
  FROM study s JOIN clips c ON c.rec = s.rec AND c.t >= s.t0 - {3 * STEP} AND c.t < s.t0 + {3 * STEP} GROUP BY 1, 2, 3, 4, 5)"""
DIFF = f"""{LEVELS}, diff AS (SELECT rec, vid_t, step, round(max(CASE WHEN kind = 'visit' THEN y END) - median(CASE WHEN kind = 'placebo' THEN y END), 8) AS d FROM lev GROUP BY 1, 2, 3),
dd AS (SELECT * FROM diff WHERE d IS NOT NULL)"""


def norm_p(z: str) -> str:
    """Two-sided normal p of a column by Simpson's rule."""
    return (f"(1 - sqrt(2 / pi()) * {z} / 1200.0 * list_sum([exp(-pow(i * {z} / 400.0, 2) / 2) * CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END FOR i IN range(0, 401)]))")


def student_p(t: str, v: str) -> str:
    """Two-sided p of Student's t with v degrees of freedom by Simpson's rule."""
    return (f"greatest(0.0, 1 - 2 * exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt({v} * pi()) * {t} / 1200.0 * "
            f"list_sum([pow(1 + pow(i * {t} / 400.0, 2) / {v}, -({v} + 1) / 2.0) * CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END FOR i IN range(0, 401)]))")


def binom_tail(k: str, n: str) -> str:
    """P(X >= k) for n fair coins."""
    return f"list_sum([exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2)) FOR i IN range({k}, {n} + 1)])"


def study(spark, sf):
    """Visits and up to four placebo windows each: (rec, vid_t, kind, t0)."""
    s = sessions(spark, sf)
    v = s.select("rec", F.col("start_t").alias("vid_t"), F.lit("visit").alias("kind"), F.col("start_t").alias("t0"))
    p = chosen_placebos(spark, sf, s)
    return v.unionByName(p.select("rec", F.col("visit_t").alias("vid_t"), F.lit("placebo").alias("kind"), F.col("start_t").alias("t0")))


def levels(spark, sf):
    c = clips(spark, sf).select("rec", "t", "x1", "x2")
    lev = S.step_levels(c, materialize(study(spark, sf), "study"), ["rec"], "t", "t0", STEP, -3, 3, [F.round(F.avg("x1"), 8).alias("y"), F.round(F.avg("x2"), 8).alias("y2")])
    return materialize(lev, "levels")


def diffs(spark, sf):
    """Visit minus placebo median per step. Means are rounded, so that values equal on paper rank as equal."""
    d = S.matched_difference(levels(spark, sf), ["rec", "vid_t", "step"], "kind", ["y"])
    return d.select("rec", "vid_t", "step", F.round("d_y", 8).alias("d"))


# ---- single tests ----------------------------------------------------------

@query("t1_mann_whitney", f"""WITH {LEVELS}, r AS (SELECT step, kind, rank() OVER (PARTITION BY step ORDER BY y) + (count(*) OVER (PARTITION BY step, y) - 1) / 2.0 AS r FROM lev),
tie AS (SELECT step, sum(c * c * c - c) AS ties FROM (SELECT step, y, count(*)::DOUBLE AS c FROM lev GROUP BY 1, 2) GROUP BY 1),
u AS (SELECT step, sum(CASE WHEN kind = 'visit' THEN 1 ELSE 0 END)::DOUBLE AS n1, sum(CASE WHEN kind <> 'visit' THEN 1 ELSE 0 END)::DOUBLE AS n2, sum(CASE WHEN kind = 'visit' THEN r ELSE 0 END) AS rs FROM r GROUP BY 1),
z AS (SELECT u.step, n1, n2, rs - n1 * (n1 + 1) / 2 AS u, (greatest(rs - n1 * (n1 + 1) / 2, n1 * n2 - rs + n1 * (n1 + 1) / 2) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u JOIN tie ON tie.step = u.step)
SELECT step, n1::BIGINT AS n1, n2::BIGINT AS n2, u, round(least(1.0, {norm_p('z')}), 6) AS p FROM z""")
def t1(spark, sf):
    t = S.mann_whitney(levels(spark, sf), ["step"], "y", F.col("kind") == "visit")
    return t.select("step", "n1", "n2", F.col("u").cast("double").alias("u"), rnd("p").alias("p"))


@query("t2_wilcoxon_signed_rank", f"""WITH {DIFF}, nz AS (SELECT step, d, rank() OVER (PARTITION BY step ORDER BY abs(d)) + (count(*) OVER (PARTITION BY step, abs(d)) - 1) / 2.0 AS r FROM dd WHERE d <> 0),
tie AS (SELECT step, sum(c * c * c - c) AS ties FROM (SELECT step, abs(d) AS a, count(*)::DOUBLE AS c FROM dd WHERE d <> 0 GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT step, count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w FROM nz GROUP BY 1),
z AS (SELECT s.step, n, w, abs(least(w, n * (n + 1) / 2 - w) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM s JOIN tie ON tie.step = s.step)
SELECT step, n::BIGINT AS n, w AS w_plus, round({norm_p('z')}, 6) AS p FROM z""")
def t2(spark, sf):
    return S.signed_rank(diffs(spark, sf), ["step"], "d").select("step", "n", F.col("w_plus").cast("double").alias("w_plus"), rnd("p").alias("p"))


@query("t3_sign_test", f"""WITH {DIFF}, g AS (SELECT step, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END)::BIGINT AS up, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END)::BIGINT AS down FROM dd GROUP BY 1)
SELECT step, up, down, round(least(1.0, 2 * {binom_tail('greatest(up, down)', '(up + down)')}), 6) AS p_sign FROM g""")
def t3(spark, sf):
    return S.sign_test(diffs(spark, sf), ["step"], "d").withColumn("p_sign", rnd("p_sign"))


@query("t4_direction_agreement", f"""WITH {DIFF}, g AS (SELECT rec, count(*) AS tested, sum(CASE WHEN sign(d) = CASE WHEN step < 0 THEN -1 ELSE 1 END THEN 1 ELSE 0 END)::BIGINT AS agree FROM dd WHERE d <> 0 GROUP BY 1)
SELECT rec, tested, agree, round({binom_tail('agree', 'tested')}, 6) AS p_agree FROM g""")
def t4(spark, sf):
    d = diffs(spark, sf).withColumn("expect", F.when(F.col("step") < 0, -1.0).otherwise(1.0))
    return S.direction_test(d, ["rec"], "d", "expect").withColumn("p_agree", rnd("p_agree"))


@query("t5_spearman", f"""WITH {ctes('clips')}, r AS (SELECT rec, rank() OVER (PARTITION BY rec ORDER BY x1) + (count(*) OVER (PARTITION BY rec, x1) - 1) / 2.0 AS a, rank() OVER (PARTITION BY rec ORDER BY x2) + (count(*) OVER (PARTITION BY rec, x2) - 1) / 2.0 AS b FROM clips),
g AS (SELECT rec, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY 1), t AS (SELECT rec, n, rho, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS t FROM g)
SELECT rec, n, round(rho, 6) AS rho, round({student_p('t', '(n - 2)')}, 6) AS p FROM t""")
def t5(spark, sf):
    return S.spearman(clips(spark, sf), ["rec"], "x1", "x2").select("rec", "n", rnd("rho").alias("rho"), rnd("p").alias("p"))


@query("t6_smallest_effect", f"""WITH {LEVELS}, g AS (SELECT step, sum(CASE WHEN kind = 'visit' THEN 1 ELSE 0 END)::BIGINT AS n, sum(CASE WHEN kind <> 'visit' THEN 1 ELSE 0 END)::BIGINT AS m, stddev_samp(CASE WHEN kind <> 'visit' THEN y END) AS sd FROM lev GROUP BY 1)
SELECT step, n, m, round(sd, 6) AS sd, round((1.959963984540054 + 0.8416212335729143) * sd * sqrt(1.0 / n + 1.0 / m), 6) AS smallest_effect FROM g""")
def t6(spark, sf):
    out = S.smallest_effect(levels(spark, sf), ["step"], "y", "kind")
    return out.select("step", "n", "m", rnd("sd").alias("sd"), rnd("smallest_effect").alias("smallest_effect"))


# ---- matched comparisons ---------------------------------------------------

@query("t7_matched_difference", f"WITH {DIFF} SELECT rec, vid_t, step, round(d, 6) + 0.0 AS d FROM dd")
def t7(spark, sf):
    return diffs(spark, sf).select("rec", "vid_t", "step", rnd("d").alias("d"))


WIDE = f"""{LEVELS}, w AS (SELECT rec, vid_t, kind, t0, avg(CASE WHEN step < 0 THEN y END) AS b, avg(CASE WHEN step = 0 THEN y END) AS d, avg(CASE WHEN step > 0 THEN y END) AS a FROM lev GROUP BY 1, 2, 3, 4),
ch AS (SELECT kind, 'after' AS measure, a - b AS v FROM w WHERE a - b IS NOT NULL UNION ALL SELECT kind, 'during', d - b FROM w WHERE d - b IS NOT NULL)"""


@query("t8_visits_vs_placebo", f"""WITH {WIDE}, r AS (SELECT measure, kind, rank() OVER (PARTITION BY measure ORDER BY v) + (count(*) OVER (PARTITION BY measure, v) - 1) / 2.0 AS r FROM ch),
u AS (SELECT measure, sum(CASE WHEN kind = 'visit' THEN 1 ELSE 0 END)::DOUBLE AS n1, sum(CASE WHEN kind <> 'visit' THEN 1 ELSE 0 END)::DOUBLE AS n2, sum(CASE WHEN kind = 'visit' THEN r ELSE 0 END) AS rs FROM r GROUP BY 1),
m AS (SELECT measure, median(CASE WHEN kind = 'visit' THEN v END) AS mv, median(CASE WHEN kind <> 'visit' THEN v END) AS mp FROM ch GROUP BY 1),
tie AS (SELECT measure, sum(c * c * c - c) AS ties FROM (SELECT measure, v, count(*)::DOUBLE AS c FROM ch GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT u.measure, (greatest(rs - n1 * (n1 + 1) / 2, n1 * n2 - rs + n1 * (n1 + 1) / 2) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u JOIN tie ON tie.measure = u.measure),
pv AS (SELECT measure, least(1.0, {norm_p('z')}) AS p FROM z), ph AS (SELECT measure, p, max(least(1.0, p * (m - rn + 1))) OVER (ORDER BY rn) AS h FROM (SELECT *, row_number() OVER (ORDER BY p, measure) AS rn, count(*) OVER () AS m FROM pv))
SELECT u.measure, n1::BIGINT AS n1, n2::BIGINT AS n2, rs - n1 * (n1 + 1) / 2 AS u, round(mv, 6) AS median_visit, round(mp, 6) AS median_placebo, round(ph.p, 6) AS p, round(ph.h, 6) AS p_holm FROM u JOIN m ON m.measure = u.measure JOIN ph ON ph.measure = u.measure""")
def t8(spark, sf):
    lev = levels(spark, sf)
    at = lambda c: F.avg(F.when(c, F.col("y")))
    w = lev.groupBy("rec", "vid_t", "kind", "t0").agg(at(F.col("step") < 0).alias("b"), at(F.col("step") == 0).alias("d"), at(F.col("step") > 0).alias("a"))
    both = F.array(F.struct(F.lit("after").alias("measure"), (F.col("a") - F.col("b")).alias("v")), F.struct(F.lit("during").alias("measure"), (F.col("d") - F.col("b")).alias("v")))
    ch = w.select("kind", F.explode(both).alias("x")).select("kind", "x.*")
    t = S.contrast_tests(ch, "measure", "v", "kind")
    return t.select("measure", "n1", "n2", F.col("u").cast("double").alias("u"), *[rnd(k).alias(k) for k in ("median_visit", "median_placebo", "p", "p_holm")])


BASED = f"""{DIFF}, bs AS (SELECT rec, vid_t, avg(d) AS b FROM dd WHERE step IN (-3, -2) GROUP BY 1, 2 HAVING count(*) = 2), cs AS (SELECT dd.rec, dd.vid_t, step, d, d - b AS c FROM dd JOIN bs ON bs.rec = dd.rec AND bs.vid_t = dd.vid_t)"""


@query("w19_change_since_baseline", f"WITH {BASED} SELECT rec, vid_t, step, round(c + 5e-8, 6) + 0.0 AS change FROM cs")
def w19(spark, sf):
    return change_since(diffs(spark, sf), ["rec", "vid_t"], "step", ["d"], [-3, -2]).select("rec", "vid_t", "step", rnd(F.col("d_d") + 5e-8).alias("change"))


@query("t9_step_time_course", f"""WITH {BASED} SELECT step, count(*) AS n, round(median(c), 6) + 0.0 AS median, round(avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_up,
  avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END) >= 0.75 OR avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END) <= 0.25 AS star FROM cs GROUP BY 1""")
def t9(spark, sf):
    c = change_since(diffs(spark, sf), ["rec", "vid_t"], "step", ["d"], [-3, -2])
    out = S.time_course(c, ["step"], "d_d")
    return out.select("step", "n", rnd("median").alias("median"), rnd("share_up").alias("share_up"), "star")


@query("t10_focused_window_test", f"""WITH {LEVELS}, f AS (SELECT rec, vid_t, kind, t0, avg(CASE WHEN step IN (-1, 0) THEN y END) - avg(CASE WHEN step IN (-3, -2) THEN y END) AS c FROM lev GROUP BY 1, 2, 3, 4 HAVING count(CASE WHEN step IN (-1, 0) THEN 1 END) = 2 AND count(CASE WHEN step IN (-3, -2) THEN 1 END) >= 1),
m AS (SELECT rec, vid_t, max(CASE WHEN kind = 'visit' THEN c END) - median(CASE WHEN kind <> 'visit' THEN c END) AS d FROM f GROUP BY 1, 2),
nz AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM m WHERE d <> 0), ti AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT abs(d) AS a, count(*)::DOUBLE AS c FROM m WHERE d <> 0 GROUP BY 1)),
sr AS (SELECT count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w FROM nz), z AS (SELECT abs(least(w, n * (n + 1) / 2 - w) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM sr, ti)
SELECT count(*) AS visits, round(median(d), 6) AS median, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END)::BIGINT AS up, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END)::BIGINT AS down, round({norm_p('max(z.z)')}, 6) AS p FROM m, z WHERE d IS NOT NULL""")
def t10(spark, sf):
    f = S.step_contrast(levels(spark, sf), ["rec", "vid_t", "kind", "t0"], "step", "y", [-1, 0], [-3, -2], "c")
    d = S.matched_difference(f, ["rec", "vid_t"], "kind", ["c"])
    out = S.signed_rank(d, [], "d_c")
    return out.select((F.col("n") + F.col("zeros")).alias("visits"), rnd("median").alias("median"), "up", "down", rnd("p").alias("p"))


@query("t11_minute_reaction", f"""WITH {ctes('visits')}, r AS (SELECT v.rec, v.start_t, CAST(floor((c.t - v.start_t) / 3600.0) AS INTEGER) AS minute, c.x1, CASE WHEN c.x2 > 50 THEN 1.0 ELSE 0.0 END AS f FROM visits v JOIN clips c ON c.rec = v.rec AND c.t >= v.start_t - 10800 AND c.t < v.start_t + 10800),
b AS (SELECT rec, start_t, quantile_cont(x1, 0.25) AS p25, median(x1) AS mid FROM r WHERE minute < 0 GROUP BY 1, 2 HAVING count(*) >= 5),
q AS (SELECT r.rec, r.start_t, avg(CASE WHEN x1 < p25 THEN 1.0 ELSE 0.0 END) AS q0, avg(f) AS f0 FROM r JOIN b ON b.rec = r.rec AND b.start_t = r.start_t WHERE minute < 0 GROUP BY 1, 2)
SELECT r.rec, r.start_t, r.minute, count(*) AS n, round(median(x1) - max(mid), 6) + 0.0 AS d_level, round(avg(CASE WHEN x1 < p25 THEN 1.0 ELSE 0.0 END) - max(q0), 6) + 0.0 AS d_quiet, round(avg(f) - max(f0), 6) + 0.0 AS d_flag
FROM r JOIN b ON b.rec = r.rec AND b.start_t = r.start_t JOIN q ON q.rec = r.rec AND q.start_t = r.start_t GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def t11(spark, sf):
    v = sessions(spark, sf).select("rec", "start_t", (F.col("start_t") - 10800).alias("a"), (F.col("start_t") + 10800).alias("b"))
    r = J.interval_join(clips(spark, sf).select("rec", "t", "x1", "x2"), v, ["rec"], "t", "a", "b", 21600)
    r = materialize(r.select("rec", "start_t", F.floor((F.col("t") - F.col("start_t")) / 3600).cast("int").alias("minute"), "x1", (F.col("x2") > 50).alias("flag")), "reaction")
    out = S.minute_reaction(r, ["rec", "start_t"], "minute", "x1", "flag", (-3, 0), 5, 2)
    return out.select("rec", "start_t", "minute", "n", *[rnd(k).alias(k) for k in ("d_level", "d_quiet", "d_flag")])


# Spectra: blocks of 20 segments are windows; every fifth block is a visit, the four after it its placebo days.
SPEC = """blk AS (SELECT dim, vec_id // 20 AS w, (vec_id % 20) // 10 AS half, avg(v * v) AS m FROM dims GROUP BY 1, 2, 3),
sp AS (SELECT w // 5 AS vid, CASE WHEN w % 5 = 0 THEN 'visit' ELSE 'placebo' END AS kind, w, dim, 10 * log10(max(CASE WHEN half = 1 THEN m END) + 1e-15) - 10 * log10(max(CASE WHEN half = 0 THEN m END) + 1e-15) AS c FROM blk GROUP BY w, dim),
sd AS (SELECT vid, dim, max(CASE WHEN kind = 'visit' THEN c END) - median(CASE WHEN kind <> 'visit' THEN c END) AS d FROM sp GROUP BY 1, 2)"""


def spectrum_diffs(spark, sf):
    """Late minus early level of every band in each window, visits minus the median of their placebo windows."""
    s = segments(spark, sf).select(F.expr("vec_id div 20").alias("w"), F.expr("vec_id % 20 div 10").alias("half"), F.posexplode("embedding").alias("band", "v"))
    m = s.groupBy("w", "band", "half").agg(F.avg(F.col("v").cast("double") * F.col("v").cast("double")).alias("m"))
    db = lambda h: P.decibel(F.max(F.when(F.col("half") == h, F.col("m"))))
    c = m.groupBy("w", "band").agg((db(1) - db(0)).alias("c"))
    c = c.select(F.expr("w div 5").alias("vid"), F.when(F.col("w") % 5 == 0, "visit").otherwise("placebo").alias("kind"), "band", "c")
    return S.matched_difference(c, ["vid", "band"], "kind", ["c"])


@query("t12_early_late_spectrum", f"WITH {ctes('dims')}, {SPEC} SELECT vid, CAST(dim AS INTEGER) AS band, round(d, 6) + 0.0 AS change_db FROM sd WHERE d IS NOT NULL")
def t12(spark, sf):
    return spectrum_diffs(spark, sf).select("vid", "band", rnd("d_c").alias("change_db"))


@query("t13_frequency_fingerprint", f"""WITH {ctes('dims')}, {SPEC}, g AS (SELECT dim, median(d) AS m, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END)::BIGINT AS up, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END)::BIGINT AS down FROM sd WHERE d IS NOT NULL GROUP BY 1)
SELECT CAST(dim AS INTEGER) AS band, dim * 250 AS lo_hz, round(m, 6) + 0.0 AS median, up, down, round(least(1.0, 2 * {binom_tail('greatest(up, down)', '(up + down)')}), 6) AS p_sign, dim * 250 >= 2000 AND dim * 250 < 8000 AND m > 1 AS bird_rise FROM g""")
def t13(spark, sf):
    d = materialize(spectrum_diffs(spark, sf), "fingerprint")
    from fieldhush.operators.ranks import medians

    mid = medians(d, ["band"], ["d_c"]).select("band", F.col("d_c").alias("m"))
    out = S.sign_test(d, ["band"], "d_c").join(mid, "band")
    hz = (F.col("band") * 250).cast("long")
    return out.select("band", hz.alias("lo_hz"), rnd("m").alias("median"), "up", "down", rnd("p_sign").alias("p_sign"),
                      ((hz >= 2000) & (hz < 8000) & (F.col("m") > 1)).alias("bird_rise"))


@query("t14_shape_contrast", f"""WITH {DIFF}, g AS (SELECT rec, vid_t, CASE WHEN count(CASE WHEN step IN (-1, 0) THEN 1 END) >= 1 THEN avg(CASE WHEN step IN (-1, 0) THEN d END) END AS c, avg(CASE WHEN step = -3 THEN d END) AS e, avg(CASE WHEN step = 2 THEN d END) AS l FROM dd GROUP BY 1, 2)
SELECT rec, vid_t, round(c - CASE WHEN e IS NULL THEN l WHEN l IS NULL THEN e ELSE (e + l) / 2 END + 5e-8, 6) + 0.0 AS both_edges, round(c - e + 5e-8, 6) + 0.0 AS early_edge FROM g WHERE c IS NOT NULL AND e IS NOT NULL""")
def t14(spark, sf):
    out = S.shape_contrast(diffs(spark, sf), ["rec", "vid_t"], "step", "d", [-1, 0], [-3], [2])
    return out.filter("early_edge is not null").select("rec", "vid_t", rnd(F.col("both_edges") + 5e-8).alias("both_edges"), rnd(F.col("early_edge") + 5e-8).alias("early_edge"))


FARW = """o AS (SELECT rec, start_t AS vid_t, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS i, unnest([-3, 3, -4, 4, -5, 5, -6, 6]) AS h FROM visits), f AS (SELECT *, vid_t + h * 3600 AS far_t FROM o),
g AS (SELECT * FROM f WHERE far_t % 86400 // 60 BETWEEN 330 AND 1110 AND NOT EXISTS (SELECT 1 FROM sims s WHERE s.rec = f.rec AND abs(s.t - f.far_t) < 10800) AND NOT EXISTS (SELECT 1 FROM sims s WHERE abs(s.t - f.far_t) < 1200)),
far AS (SELECT rec, vid_t, h, far_t FROM (SELECT *, row_number() OVER (PARTITION BY rec, vid_t ORDER BY i) AS rn FROM g) WHERE rn <= 2),
fw AS (SELECT s.rec, s.vid_t, s.kind, f.h, s.t0 + f.h * 3600 AS t0 FROM study s JOIN far f ON f.rec = s.rec AND f.vid_t = s.vid_t),
nl AS (SELECT s.rec, s.vid_t, s.kind, s.t0, avg(c.x1) AS y FROM study s JOIN clips c ON c.rec = s.rec AND c.t >= s.t0 - 3600 AND c.t < s.t0 + 3600 GROUP BY 1, 2, 3, 4),
fl AS (SELECT w.rec, w.vid_t, w.kind, w.h, w.t0, avg(c.x1) AS y FROM fw w JOIN clips c ON c.rec = w.rec AND c.t >= w.t0 - 3600 AND c.t < w.t0 + 3600 GROUP BY 1, 2, 3, 4, 5),
nd AS (SELECT rec, vid_t, max(CASE WHEN kind = 'visit' THEN y END) - median(CASE WHEN kind <> 'visit' THEN y END) AS near FROM nl GROUP BY 1, 2),
fd AS (SELECT rec, vid_t, avg(d) AS far FROM (SELECT rec, vid_t, h, max(CASE WHEN kind = 'visit' THEN y END) - median(CASE WHEN kind <> 'visit' THEN y END) AS d FROM fl GROUP BY 1, 2, 3) WHERE d IS NOT NULL GROUP BY 1, 2),
nf AS (SELECT nd.rec, nd.vid_t, near, far, near - far AS near_far FROM nd JOIN fd ON fd.rec = nd.rec AND fd.vid_t = nd.vid_t WHERE near IS NOT NULL)"""


def near_far_windows(spark, sf):
    """Windows (visit and placebo) near the visit (h = 0) and at its far hours."""
    st = materialize(study(spark, sf), "study")
    far = J.far_windows(st.filter("kind = 'visit'").select("rec", "vid_t"), sims(spark, sf).select("rec", F.col("t").alias("et")), "rec", "vid_t", "et", gap_any=1200)
    fw = st.join(far.select("rec", "vid_t", "h"), ["rec", "vid_t"]).withColumn("t0", F.col("t0") + F.col("h") * 3600)
    near = st.withColumn("h", F.lit(0))
    both = near.unionByName(fw).withColumn("a", F.col("t0") - 3600).withColumn("b", F.col("t0") + 3600)
    return materialize(both, "near-far")


def near_far(spark, sf):
    w = near_far_windows(spark, sf)
    lev = S.part_levels(clips(spark, sf).select("rec", "t", "x1"), w, ["rec"], "t", "a", "b", [F.avg("x1").alias("y")])
    d = S.matched_difference(lev, ["rec", "vid_t", "h"], "kind", ["y"])
    g = d.groupBy("rec", "vid_t").agg(F.max(F.when(F.col("h") == 0, F.col("d_y"))).alias("near"), F.avg(F.when(F.col("h") != 0, F.col("d_y"))).alias("far"))
    return g.filter("near is not null and far is not null").withColumn("near_far", F.col("near") - F.col("far"))


@query("t15_near_minus_far", f"WITH {STUDY}, {FARW} SELECT rec, vid_t, round(near, 6) + 0.0 AS near, round(far, 6) + 0.0 AS far, round(near_far, 6) + 0.0 AS near_far FROM nf")
def t15(spark, sf):
    return near_far(spark, sf).select("rec", "vid_t", *[rnd(k).alias(k) for k in ("near", "far", "near_far")])


@query("t16_visited_minus_control", f"""WITH {STUDY}, {CONTROLS},
ws AS (SELECT rec AS home, vid_t, rec, kind, t0 FROM study UNION ALL SELECT rec, visit_t, ctrl, 'visit', visit_t FROM ct UNION ALL SELECT rec, visit_t, ctrl, 'placebo', start_t FROM co),
l AS (SELECT w.home, w.vid_t, w.rec, w.kind, w.t0, round(avg(c.x1), 8) AS y FROM ws w JOIN clips c ON c.rec = w.rec AND c.t >= w.t0 - 1800 AND c.t < w.t0 + 1800 GROUP BY 1, 2, 3, 4, 5),
d AS (SELECT home, vid_t, rec, max(CASE WHEN kind = 'visit' THEN y END) - median(CASE WHEN kind <> 'visit' THEN y END) AS d FROM l GROUP BY 1, 2, 3),
g AS (SELECT home, vid_t, max(CASE WHEN rec = home THEN d END) AS visited, median(CASE WHEN rec <> home THEN d END) AS control, count(CASE WHEN rec <> home THEN d END) AS n_ctrl FROM d GROUP BY 1, 2),
x AS (SELECT *, round(visited - control, 7) AS v FROM g WHERE visited IS NOT NULL AND control IS NOT NULL),
pt AS (SELECT unnest(['all', CASE WHEN vid_t % 86400 >= 43200 THEN 'afternoon' ELSE 'morning' END]) AS part, n_ctrl, v FROM x),
nz AS (SELECT part, v, rank() OVER (PARTITION BY part ORDER BY abs(v)) + (count(*) OVER (PARTITION BY part, abs(v)) - 1) / 2.0 AS r FROM pt WHERE v <> 0),
ti AS (SELECT part, sum(c * c * c - c) AS ties FROM (SELECT part, abs(v) AS av, count(*)::DOUBLE AS c FROM pt WHERE v <> 0 GROUP BY 1, 2) GROUP BY 1),
sr AS (SELECT part, count(*)::DOUBLE AS n, sum(CASE WHEN v > 0 THEN r ELSE 0 END) AS w FROM nz GROUP BY 1),
z AS (SELECT sr.part, abs(least(w, n * (n + 1) / 2 - w) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM sr JOIN ti ON ti.part = sr.part)
SELECT pt.part, count(*) AS visits, sum(n_ctrl)::BIGINT AS n_ctrl, round(median(v), 6) + 0.0 AS median, count_if(v < 0) AS quieter, round({norm_p('max(z.z)')}, 6) + 0.0 AS p FROM pt JOIN z ON z.part = pt.part GROUP BY 1""")
def t16(spark, sf):
    """Each visited recorder less the unvisited ones at the same moment, each against its own normal days; all, morning and afternoon visits."""
    st = materialize(study(spark, sf), "study")
    chosen = st.filter("kind = 'placebo'").select("rec", F.col("vid_t").alias("visit_t"), F.col("t0").alias("start_t"))
    c = materialize(controls(spark, sf, chosen), "controls")
    home = st.select(F.col("rec").alias("home"), "vid_t", "rec", "kind", "t0")
    away = c.select(F.col("rec").alias("home"), F.col("visit_t").alias("vid_t"), F.col("ctrl").alias("rec"), F.lit("placebo").alias("kind"), (F.col("visit_t") + F.col("offset")).alias("t0"))
    there = away.select("home", "vid_t", "rec", F.lit("visit").alias("kind"), F.col("vid_t").alias("t0")).distinct()
    w = materialize(home.unionByName(away).unionByName(there).withColumn("a", F.col("t0") - 1800).withColumn("b", F.col("t0") + 1800), "control")
    lev = S.part_levels(clips(spark, sf).select("rec", "t", "x1"), w, ["rec"], "t", "a", "b", [F.round(F.avg("x1"), 8).alias("y")])
    d = S.matched_difference(lev, ["home", "vid_t", "rec"], "kind", ["y"])
    own = F.col("rec") == F.col("home")
    g = d.groupBy("home", "vid_t").agg(F.max(F.when(own, F.col("d_y"))).alias("visited"), F.median(F.when(~own, F.col("d_y"))).alias("control"), F.count(F.when(~own, F.col("d_y"))).alias("n_ctrl"))
    part = F.when(F.col("vid_t") % 86400 >= 43200, "afternoon").otherwise("morning")
    v = g.filter("visited is not null and control is not null").select(F.explode(F.array(F.lit("all"), part)).alias("part"), "n_ctrl", F.round(F.col("visited") - F.col("control"), 7).alias("v"))
    v = materialize(v, "visited-control")
    t = S.signed_rank(v, ["part"], "v").join(v.groupBy("part").agg(F.sum("n_ctrl").alias("n_ctrl"), F.count("*").alias("visits")), "part")
    return t.select("part", "visits", "n_ctrl", rnd("median").alias("median"), F.col("down").alias("quieter"), rnd("p").alias("p"))


@query("t17_before_approach_here", f"""WITH {STUDY}, p AS (SELECT rec, vid_t, prev_t FROM (SELECT v.rec, v.start_t AS vid_t, s.t AS prev_t, row_number() OVER (PARTITION BY v.rec, v.start_t ORDER BY s.t DESC) AS rn FROM visits v JOIN (SELECT DISTINCT rec, t FROM sims) s ON s.rec <> v.rec AND s.t < v.start_t AND s.t // 86400 = v.start_t // 86400) WHERE rn = 1 AND vid_t - prev_t BETWEEN 600 AND 7200),
w AS (SELECT s.rec, s.vid_t, s.kind, 'before' AS part, prev_t + t0 - s.vid_t - 7200 AS a, prev_t + t0 - s.vid_t - 600 AS b FROM study s JOIN p ON p.rec = s.rec AND p.vid_t = s.vid_t
  UNION ALL SELECT s.rec, s.vid_t, s.kind, 'approach', prev_t + t0 - s.vid_t, t0 - 300 FROM study s JOIN p ON p.rec = s.rec AND p.vid_t = s.vid_t UNION ALL SELECT s.rec, s.vid_t, s.kind, 'here', t0 - 300, t0 + 3600 FROM study s JOIN p ON p.rec = s.rec AND p.vid_t = s.vid_t),
l AS (SELECT w.rec, w.vid_t, w.kind, w.part, w.a, avg(c.x1) AS y FROM w JOIN clips c ON c.rec = w.rec AND c.t >= w.a AND c.t < w.b GROUP BY 1, 2, 3, 4, 5),
d AS (SELECT rec, vid_t, part, max(CASE WHEN kind = 'visit' THEN y END) - median(CASE WHEN kind <> 'visit' THEN y END) AS d FROM l GROUP BY 1, 2, 3) SELECT rec, vid_t, part, round(d, 6) + 0.0 AS d FROM d WHERE d IS NOT NULL""")
def t17(spark, sf):
    st = materialize(study(spark, sf), "study")
    ev = sims(spark, sf).select("rec", F.col("t").alias("et")).distinct()
    prev = J.previous_stop(st.filter("kind = 'visit'").select("rec", "vid_t"), ev, "rec", "vid_t", "et", []).select("rec", "vid_t", F.col("prev.et").alias("prev_t"))
    w = st.join(prev, ["rec", "vid_t"]).withColumn("p", F.col("prev_t") + F.col("t0") - F.col("vid_t"))
    part = lambda n, a, b: F.struct(F.lit(n).alias("part"), a.alias("a"), b.alias("b"))
    t0, p = F.col("t0"), F.col("p")
    w = w.select("rec", "vid_t", "kind", F.explode(F.array(part("before", p - 7200, p - 600), part("approach", p, t0 - 300), part("here", t0 - 300, t0 + 3600))).alias("w"))
    lev = S.part_levels(clips(spark, sf).select("rec", "t", "x1"), materialize(w.select("rec", "vid_t", "kind", "w.*"), "legs"), ["rec"], "t", "a", "b", [F.avg("x1").alias("y")])
    d = S.matched_difference(lev, ["rec", "vid_t", "part"], "kind", ["y"])
    return d.select("rec", "vid_t", "part", rnd("d_y").alias("d"))


# ---- covariates ------------------------------------------------------------

WIND = f"""{STUDY}, l AS (SELECT s.rec, s.vid_t, s.kind, s.t0, avg(c.x1) AS y FROM study s JOIN clips c ON c.rec = s.rec AND c.t >= s.t0 - 3600 AND c.t < s.t0 + 3600 GROUP BY 1, 2, 3, 4),
wl AS (SELECT l.rec, l.vid_t, l.kind, l.t0, max(l.y) AS y, avg(w.wind) AS wind, avg(w.temp) AS temp FROM l JOIN weather w ON w.hour_t >= (l.t0 - 1800) - (l.t0 - 1800) % 3600 AND w.hour_t < l.t0 + 1800 GROUP BY 1, 2, 3, 4),
vw AS (SELECT rec, vid_t, max(CASE WHEN kind = 'visit' THEN y END) - median(CASE WHEN kind <> 'visit' THEN y END) AS d, max(CASE WHEN kind = 'visit' THEN wind END) - median(CASE WHEN kind <> 'visit' THEN wind END) AS dwind,
  max(CASE WHEN kind = 'visit' THEN temp END) - median(CASE WHEN kind <> 'visit' THEN temp END) AS dtemp FROM wl GROUP BY 1, 2),
vv AS (SELECT * FROM vw WHERE d IS NOT NULL AND dwind IS NOT NULL)"""
WIND = WIND.replace(ctes("placebos"), ctes("placebos", "weather"))


def windy(spark, sf):
    st = materialize(study(spark, sf), "study").withColumn("a", F.col("t0") - 3600).withColumn("b", F.col("t0") + 3600)
    lev = S.part_levels(clips(spark, sf).select("rec", "t", "x1"), st, ["rec"], "t", "a", "b", [F.avg("x1").alias("y")]).drop("a", "b", "n")
    lev = lev.withColumn("a", F.col("t0") - 1800).withColumn("b", F.col("t0") + 1800)
    hourly = materialize(weather(spark, sf), "weather")
    return J.hourly_mean(materialize(lev, "windy"), hourly, "a", "b", "hour_t", ["temp", "wind"]).filter("wind is not null").drop("a", "b")


def wind_diffs(spark, sf):
    d = S.matched_difference(windy(spark, sf), ["rec", "vid_t"], "kind", ["y", "wind", "temp"])
    return d.filter("d_y is not null and d_wind is not null")


@query("t18_wind_matched", f"""WITH {WIND}, m AS (SELECT median(dwind) AS m FROM vv), c AS (SELECT v.rec, v.vid_t, max(v.y) - max(p.y) AS diff FROM (SELECT * FROM wl WHERE kind = 'visit') v
  JOIN (SELECT p.*, row_number() OVER (PARTITION BY p.rec, p.vid_t ORDER BY abs(p.wind - v.wind), p.wind, p.y) AS rn FROM wl p JOIN wl v ON v.kind = 'visit' AND v.rec = p.rec AND v.vid_t = p.vid_t WHERE p.kind <> 'visit') p ON p.rec = v.rec AND p.vid_t = v.vid_t AND p.rn = 1 GROUP BY 1, 2)
SELECT 'low_wind' AS subset, count(*) AS n, round(median(d), 6) AS median FROM vv WHERE abs(dwind) <= 1 UNION ALL SELECT 'calmer_half', count(*), round(median(d), 6) FROM vv, m WHERE dwind <= m.m
UNION ALL SELECT 'closest_wind', count(*), round(median(diff), 6) FROM c""")
def t18(spark, sf):
    from fieldhush.operators.ranks import medians

    w = materialize(windy(spark, sf), "windy")
    d = S.matched_difference(w, ["rec", "vid_t"], "kind", ["y", "wind"]).filter("d_y is not null and d_wind is not null")
    half = medians(d, [], ["d_wind"]).select(F.col("d_wind").alias("__m"))
    tag = F.array_compact(F.array(F.when(F.abs("d_wind") <= 1, "low_wind"), F.when(F.col("d_wind") <= F.col("__m"), "calmer_half")))
    a = d.crossJoin(F.broadcast(half)).select(F.explode(tag).alias("subset"), F.col("d_y").alias("v"))
    b = S.closest_placebo(w, ["rec", "vid_t"], "kind", "y", "wind").select(F.lit("closest_wind").alias("subset"), F.col("diff").alias("v"))
    m = medians(a.unionByName(b), ["subset"], ["v"])
    return m.select("subset", F.col("n_v").alias("n"), rnd("v").alias("median"))


@query("t19_intercept_at_zero_wind", f"""WITH {WIND}, r AS (SELECT d, dwind, row_number() OVER (ORDER BY rec, vid_t) AS rn, count(*) OVER () AS n FROM vv),
p AS (SELECT draw, ('0x' || substr(md5('1|' || draw || '|' || rn), 1, 8))::BIGINT % n + 1 AS pick FROM (SELECT rn, n, unnest(range(2000)) AS draw FROM r)),
b AS (SELECT draw, regr_intercept(d, dwind) AS b0 FROM p JOIN r ON r.rn = p.pick GROUP BY 1)
SELECT count(*) AS n, round(regr_intercept(d, dwind), 5) AS intercept, round(regr_slope(d, dwind), 5) AS slope, (SELECT round(quantile_cont(b0, 0.025), 5) FROM b) AS lo, (SELECT round(quantile_cont(b0, 0.975), 5) FROM b) AS hi FROM vv""")
def t19(spark, sf):
    d = materialize(wind_diffs(spark, sf), "wind-diffs")
    out = S.intercept_at_zero(d, [], ["rec", "vid_t"], "d_wind", "d_y", 2000, "1")
    return out.select("n", *[rnd(k, 5).alias(k) for k in ("intercept", "slope", "lo", "hi")])


@query("t20_residual_after_covariates", f"""WITH {WIND}, m AS (SELECT avg(dwind) AS mw, stddev_samp(dwind) AS sw, avg(dtemp) AS mt, stddev_samp(dtemp) AS st, avg(d) AS md FROM vv), z AS (SELECT rec, vid_t, d, (dwind - mw) / sw AS a, (dtemp - mt) / st AS b, d - md AS c FROM vv, m),
g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * c) AS ac, sum(b * c) AS bc FROM z)
SELECT rec, vid_t, round(d - (ac * bb - bc * ab) / (aa * bb - ab * ab) * a - (bc * aa - ac * ab) / (aa * bb - ab * ab) * b, 5) AS resid FROM z, g""")
def t20(spark, sf):
    d = materialize(wind_diffs(spark, sf), "wind-diffs")
    return S.residual_after(d, "d_y", ["d_wind", "d_temp"]).select("rec", "vid_t", rnd("resid", 5).alias("resid"))


@query("t21_leave_one_day_out", f"""WITH {STUDY}, {FARW}, x AS (SELECT a.rec, a.vid_t, b.near_far AS v FROM nf a JOIN nf b ON b.rec = a.rec AND b.vid_t <> a.vid_t),
r AS (SELECT rec, vid_t, v, rank() OVER (PARTITION BY rec, vid_t ORDER BY abs(v)) + (count(*) OVER (PARTITION BY rec, vid_t, abs(v)) - 1) / 2.0 AS rk FROM x WHERE v <> 0)
SELECT x.rec, x.vid_t, round(median(x.v), 6) + 0.0 AS loo_median, sum(CASE WHEN x.v < 0 THEN 1 ELSE 0 END)::BIGINT AS loo_below, (SELECT sum(CASE WHEN r.v > 0 THEN r.rk ELSE 0 END) FROM r WHERE r.rec = x.rec AND r.vid_t = x.vid_t) AS loo_w FROM x GROUP BY 1, 2""")
def t21(spark, sf):
    d = materialize(near_far(spark, sf), "near-far")
    out = S.leave_one_out(d, ["rec"], "vid_t", "near_far")
    return out.select("rec", "vid_t", rnd("loo_median").alias("loo_median"), F.col("loo_below").cast("long").alias("loo_below"), F.col("loo_w").cast("double").alias("loo_w"))


@query("t22_weather_clock_shift", f"""WITH {ctes('weather')}, h AS (SELECT hour_t % 86400 // 3600 AS h, avg(temp) AS m FROM weather GROUP BY 1), s AS (SELECT k, ((h - k) % 24 + 24) % 24 AS lh, m FROM h, range(-12, 13) r(k)),
p AS (SELECT k, arg_max(lh, m) AS peak FROM s GROUP BY 1) SELECT CAST(k AS INTEGER) AS shift, CAST(peak AS INTEGER) AS peak_hour FROM p ORDER BY abs(peak - 13.5), k LIMIT 1""")
def t22(spark, sf):
    return S.clock_shift(weather(spark, sf), "hour_t", "temp")


NFSP = f"""WITH {STUDY}, {FARW}, wins AS (SELECT rec, vid_t, kind, 0 AS h, t0 FROM study UNION ALL SELECT rec, vid_t, kind, h, t0 FROM fw),
q AS (SELECT w.rec, w.vid_t, w.kind, w.h, w.t0, c.species FROM wins w JOIN clips c ON c.rec = w.rec AND c.t >= w.t0 - 3600 AND c.t < w.t0 + 3600),
n AS (SELECT rec, vid_t, kind, h, t0, count(*) AS n FROM q GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 0.5 * 2 * {PER_HOUR}),
gh AS (SELECT rec, vid_t, h FROM n GROUP BY 1, 2, 3 HAVING count_if(kind = 'visit') > 0 AND count_if(kind <> 'visit') > 0),
vis AS (SELECT rec, vid_t FROM gh GROUP BY 1, 2 HAVING count_if(h = 0) > 0 AND count_if(h <> 0) > 0),
qn AS (SELECT n.rec, n.vid_t, n.kind, n.h, n.t0, n.n, q.species FROM n JOIN q ON q.rec = n.rec AND q.vid_t = n.vid_t AND q.kind = n.kind AND q.h = n.h AND q.t0 = n.t0 JOIN vis ON vis.rec = n.rec AND vis.vid_t = n.vid_t),
tot AS (SELECT species, count(*) AS det FROM qn WHERE kind = 'visit' GROUP BY 1 HAVING count(*) >= 30),
nw AS (SELECT n.* FROM n JOIN gh ON gh.rec = n.rec AND gh.vid_t = n.vid_t AND gh.h = n.h JOIN vis ON vis.rec = n.rec AND vis.vid_t = n.vid_t),
sh AS (SELECT w.rec, w.vid_t, w.kind, w.h, w.t0, tot.species, count(x.species) / w.n::DOUBLE AS s FROM nw w CROSS JOIN tot LEFT JOIN qn x ON x.rec = w.rec AND x.vid_t = w.vid_t AND x.kind = w.kind AND x.h = w.h AND x.t0 = w.t0 AND x.species = tot.species
  GROUP BY w.rec, w.vid_t, w.kind, w.h, w.t0, tot.species, w.n),
d AS (SELECT rec, vid_t, h, species, max(CASE WHEN kind = 'visit' THEN s END) - median(CASE WHEN kind <> 'visit' THEN s END) AS d FROM sh GROUP BY 1, 2, 3, 4),
ef AS (SELECT rec, vid_t, species, round(100 * (max(CASE WHEN h = 0 THEN d END) - avg(CASE WHEN h <> 0 THEN d END)), 7) + 0.0 AS e FROM d GROUP BY 1, 2, 3),
nz AS (SELECT species, e, rank() OVER (PARTITION BY species ORDER BY abs(e)) + (count(*) OVER (PARTITION BY species, abs(e)) - 1) / 2.0 AS r FROM ef WHERE e <> 0),
ti AS (SELECT species, sum(c * c * c - c) AS ties FROM (SELECT species, abs(e) AS av, count(*)::DOUBLE AS c FROM ef WHERE e <> 0 GROUP BY 1, 2) GROUP BY 1),
sr AS (SELECT species, count(*)::DOUBLE AS n, sum(CASE WHEN e > 0 THEN r ELSE 0 END) AS w FROM nz GROUP BY 1 HAVING count(*) >= 4),
z AS (SELECT sr.species, abs(least(w, n * (n + 1) / 2 - w) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM sr JOIN ti ON ti.species = sr.species),
pv AS (SELECT species, {norm_p('z')} AS p FROM z), pr AS (SELECT *, row_number() OVER (ORDER BY p, species) AS rn, count(*) OVER () AS m FROM pv),
fd2 AS (SELECT species, p, min(least(1.0, p * m / rn)) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM pr)"""


def species_windows(rows, windows, per_hour, share):
    """The windows in which at least ``share`` of the expected clips were recorded, by two lookups in a prefix-count index."""
    index = materialize(J.count_index(rows.select("rec", "t"), ["rec"], "t"), "count-index")
    return J.count_between(windows, index, ["rec"], "a", "b", "n").filter(F.col("n") * 3600 >= share * per_hour * (F.col("b") - F.col("a")))


def visit_minus_normal(values, ids, value, normal):
    """Visit value less the median over ``normal`` placebo windows, in which a species without a row has the value 0."""
    is_visit = F.col("kind") == "visit"
    g = values.groupBy(*ids).agg(F.sum(F.when(is_visit, F.col(value))).alias("v"), F.collect_list(F.when(~is_visit, F.col(value))).alias("__p"), F.max(normal).alias("__n"),
                                 F.max((F.col(value) != 0).cast("int")).alias("present"))
    return g.withColumn("d", F.coalesce("v", F.lit(0.0)) - padded_median(F.col("__p"), F.col("__n"))).drop("v", "__p", "__n")


@query("t23_species_near_far", f"""{NFSP} SELECT ef.species, max(tot.det) AS clips_detected, count(*) AS visits, round(median(e), 6) + 0.0 AS median_pp, round(avg(e), 6) + 0.0 AS mean_pp, count_if(e < 0) AS quieter, count_if(e > 0) AS louder,
round(max(f.p), 6) + 0.0 AS p, round(max(f.q), 6) + 0.0 AS fdr_q FROM ef JOIN tot ON tot.species = ef.species LEFT JOIN fd2 f ON f.species = ef.species GROUP BY 1""")
def t23(spark, sf):
    """Near less normal days, less the same at far hours, in percentage points of clips: species with 30 detections in the visits' windows, p and false discovery rate."""
    c = clips(spark, sf).select("rec", "t", F.array("species").alias("tags"))
    w = materialize(species_windows(c, near_far_windows(spark, sf), PER_HOUR, 0.5), "covered")
    g = w.groupBy("rec", "vid_t", "h").agg(F.count_if(F.col("kind") == "visit").alias("v"), F.count_if(F.col("kind") != "visit").alias("normal")).filter("v > 0 and normal > 0").drop("v")
    vis = g.groupBy("rec", "vid_t").agg(F.count_if(F.col("h") == 0).alias("near"), F.count_if(F.col("h") != 0).alias("far")).filter("near > 0 and far > 0").drop("near")
    vis = materialize(vis, "visits")
    n = vis.count()
    sh = materialize(species_share(c, w.drop("n"), ["rec"], "t", "a", "b", "tags", bucket=7200).join(sized(vis), ["rec", "vid_t"]), "shares")
    heard = sized(sh.filter("kind = 'visit'").groupBy("species").agg(F.sum("k").alias("clips_detected")).filter("clips_detected >= 30"))
    d = visit_minus_normal(sh.join(sized(g), ["rec", "vid_t", "h"]).join(heard, "species"), ["rec", "vid_t", "h", "far", "species"], "share", "normal")
    at = lambda near: F.coalesce(F.sum(F.when((F.col("h") == 0) == F.lit(near), F.col("d"))), F.lit(0.0))
    e = d.groupBy("rec", "vid_t", "species").agg(F.round(100 * (at(True) - at(False) / F.max("far")), 7).alias("e"))
    e = materialize(e, "species-effects")
    sums = e.groupBy("species").agg((F.sum("e") / n).alias("mean"), F.count_if(F.col("e") < 0).alias("quieter"), F.count_if(F.col("e") > 0).alias("louder"))
    tests = S.signed_rank(e.filter("e <> 0"), ["species"], "e").filter("n >= 4").select("species", "p")
    tests = materialize(benjamini_hochberg(tests, [], "p", ["species"], "fdr_q"), "species-tests")
    out = heard.join(sums, "species").join(zero_medians(e, ["species"], "e", F.lit(n)), "species").join(tests, "species", "left")
    return out.select("species", "clips_detected", F.lit(n).cast("long").alias("visits"), rnd("e").alias("median_pp"), rnd("mean").alias("mean_pp"), "quieter", "louder", rnd("p").alias("p"), rnd("fdr_q").alias("fdr_q"))


def drop_sql(step: int, least: int) -> str:
    """Share of each species in the step before arrival less the step before that, visit less normal days."""
    return f"""WITH {STUDY}, q AS (SELECT s.rec, s.vid_t, s.kind, s.t0, CASE WHEN c.t >= s.t0 - {step} THEN 1 ELSE 0 END AS late, c.species FROM study s JOIN clips c ON c.rec = s.rec AND c.t >= s.t0 - {2 * step} AND c.t < s.t0),
n AS (SELECT rec, vid_t, kind, t0, count_if(late = 1)::DOUBLE AS nl, count_if(late = 0)::DOUBLE AS ne FROM q GROUP BY 1, 2, 3, 4 HAVING count_if(late = 1) >= {least} AND count_if(late = 0) >= {least}),
vis AS (SELECT rec, vid_t FROM n GROUP BY 1, 2 HAVING count_if(kind = 'visit') > 0 AND count_if(kind <> 'visit') > 0), sp AS (SELECT DISTINCT species FROM clips WHERE species IS NOT NULL),
ch AS (SELECT n.rec, n.vid_t, n.kind, n.t0, sp.species, round(count(CASE WHEN q.late = 1 THEN 1 END) / n.nl - count(CASE WHEN q.late = 0 THEN 1 END) / n.ne, 9) + 0.0 AS c FROM n JOIN vis ON vis.rec = n.rec AND vis.vid_t = n.vid_t CROSS JOIN sp
  LEFT JOIN q ON q.rec = n.rec AND q.vid_t = n.vid_t AND q.kind = n.kind AND q.t0 = n.t0 AND q.species = sp.species GROUP BY n.rec, n.vid_t, n.kind, n.t0, sp.species, n.nl, n.ne),
d AS (SELECT rec, vid_t, species, round(max(CASE WHEN kind = 'visit' THEN c END) - median(CASE WHEN kind <> 'visit' THEN c END), 8) + 0.0 AS d, max(CASE WHEN c <> 0 THEN 1 ELSE 0 END) AS present FROM ch GROUP BY 1, 2, 3)"""


def species_drops(spark, sf, step, least):
    """(rec, vid_t, species, present, d) of the species heard in a visit's windows, and the number of visits."""
    c = clips(spark, sf).select("rec", "t", F.array_compact(F.array("species")).alias("tags"))
    st = materialize(study(spark, sf), "study")
    half = lambda n, a, b: F.struct(F.lit(n).alias("part"), (F.col("t0") + a).alias("a"), (F.col("t0") + b).alias("b"))
    w = st.select("*", F.explode(F.array(half("late", -step, 0), half("early", -2 * step, -step))).alias("x")).select(*st.columns, "x.*")
    w = materialize(species_windows(c, w, 1.0, least * 3600.0 / step), "covered")
    whole = w.groupBy(*st.columns).count().filter("count = 2").drop("count")
    normal = whole.groupBy("rec", "vid_t").agg(F.count_if(F.col("kind") == "visit").alias("v"), F.count_if(F.col("kind") != "visit").alias("normal")).filter("v > 0 and normal > 0").drop("v")
    whole = materialize(whole.join(normal, ["rec", "vid_t"]), "whole")
    sh = species_share(c, w.drop("n").join(sized(whole), st.columns), ["rec"], "t", "a", "b", "tags", bucket=step)
    part = lambda n: F.coalesce(F.sum(F.when(F.col("part") == n, F.col("share"))), F.lit(0.0))
    ch = sh.groupBy(*st.columns, "normal", "species").agg(F.round(part("late") - part("early"), 9).alias("c"))
    d = visit_minus_normal(ch, ["rec", "vid_t", "species"], "c", "normal").withColumn("d", F.round("d", 8))
    return materialize(d, "species-drops"), normal.count()


@query("t24_species_pre_arrival_drop", f"""{drop_sql(86400, 50)}, r AS (SELECT species, count_if(d > 0)::BIGINT AS up, count_if(d < 0)::BIGINT AS down, median(d) AS m FROM d WHERE present = 1 GROUP BY 1 HAVING count_if(d <> 0) >= 6)
SELECT species, down, up + down AS n, round(m, 6) + 0.0 AS median, round(least(1.0, 2 * {binom_tail('greatest(up, down)', '(up + down)')}), 6) AS p FROM r""")
def t24(spark, sf):
    """Visits at which the species was heard, windows with 50 clips (a day in these sparse tables), species with 6 visits that changed."""
    d, _ = species_drops(spark, sf, 86400, 50)
    d = d.filter("present = 1")
    t = S.sign_test(d, ["species"], "d").filter("up + down >= 6").join(medians(d, ["species"], ["d"]).select("species", "d"), "species")
    return t.select("species", "down", (F.col("up") + F.col("down")).alias("n"), rnd("d").alias("median"), rnd("p_sign").alias("p"))


@query("t24_each_species_drop", f"""{drop_sql(7200, 1)} SELECT species, count(*) AS visits, round(median(d), 6) + 0.0 AS median, count_if(d > 0) AS up, count_if(d < 0) AS down FROM d GROUP BY 1 HAVING count(*) >= 6""")
def t24_each(spark, sf):
    """All visits with a clip in both two-hour windows; a species that a visit does not have counts as no change there."""
    d, n = species_drops(spark, sf, 7200, 1)
    names = clips(spark, sf).select("species").filter("species is not null").distinct()
    g = d.groupBy("species").agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    out = names.join(g, "species", "left").join(zero_medians(d, ["species"], "d", F.lit(n)), "species", "left").fillna(0, ["up", "down"]).fillna(0.0, ["d"])
    return out.filter(F.lit(n) >= 6).select("species", F.lit(n).cast("long").alias("visits"), rnd("d").alias("median"), "up", "down")


WALK = 21600  # a walking stretch: the quarter of a day that has a walking event


@query("t25_walking_only_contrast", f"""WITH {ctes('clips')}, wk AS (SELECT DISTINCT rec, day, t // {WALK} AS s FROM clips WHERE lab = 1 AND x2 < 90), dy AS (SELECT DISTINCT rec, day FROM clips), vd AS (SELECT DISTINCT rec, day FROM wk),
od AS (SELECT v.rec, v.day AS vday, d.day, row_number() OVER (PARTITION BY v.rec, v.day ORDER BY md5('4|' || v.rec || '|' || v.day * 86400 || '|' || d.day * 86400)) AS rn FROM vd v JOIN dy d ON d.rec = v.rec AND d.day <> v.day),
wn AS (SELECT rec, day AS vday, day FROM vd UNION ALL SELECT rec, vday, day FROM od WHERE rn <= 4),
wc AS (SELECT w.rec, w.vday, w.day, count(*) AS n, avg(CASE WHEN c.x1 > 20 THEN 1.0 ELSE 0.0 END) AS y FROM wn w JOIN wk k ON k.rec = w.rec AND k.day = w.vday JOIN clips c ON c.rec = w.rec AND c.t // {WALK} = k.s + (w.day - w.vday) * {86400 // WALK} GROUP BY 1, 2, 3),
bc AS (SELECT w.rec, w.vday, w.day, count(*) AS n, avg(CASE WHEN c.x1 > 20 THEN 1.0 ELSE 0.0 END) AS y FROM wn w JOIN clips c ON c.rec = w.rec AND c.t >= (w.day - 1) * 86400 AND c.t < w.day * 86400 GROUP BY 1, 2, 3),
ch AS (SELECT wc.rec, wc.vday, wc.day, wc.n, wc.y - bc.y AS c FROM wc JOIN bc ON bc.rec = wc.rec AND bc.vday = wc.vday AND bc.day = wc.day WHERE wc.n >= 20 AND bc.n >= 50),
r AS (SELECT rec, vday, max(CASE WHEN day = vday THEN n END) AS n, max(CASE WHEN day = vday THEN c END) - median(CASE WHEN day <> vday THEN c END) AS d FROM ch GROUP BY 1, 2)
SELECT rec, vday, n AS n_walk_clips, round(d, 6) + 0.0 AS diff FROM r WHERE d IS NOT NULL""")
def t25(spark, sf):
    """Share of loud clips in the walking stretches of a day less that of the day before, minus the same on up to four other days; 20 walking clips and 50 before."""
    c = clips(spark, sf)
    slots = materialize(c.filter("lab = 1 and x2 < 90").select("rec", F.col("day").alias("vday"), F.expr(f"t div {WALK}").alias("slot")).distinct(), "walking")
    v = slots.select("rec", (F.col("vday") * 86400).alias("start_t")).distinct()
    other = J.chosen_days(v, c.select("rec", "day"), ["rec"], "start_t", ["start_t"], lambda m: m, 4, "4")
    w = v.select("rec", F.col("start_t").alias("base"), "start_t").unionByName(other.select("rec", F.col("base_start_t").alias("base"), "start_t"))
    w = materialize(w.select("rec", F.expr("base div 86400").alias("vday"), F.expr("start_t div 86400").alias("day")), "days")
    loud = [F.count("*").alias("n"), F.avg((F.col("x1") > 20).cast("double")).alias("y")]
    moved = w.join(slots, ["rec", "vday"]).withColumn("slot", F.col("slot") + (F.col("day") - F.col("vday")) * (86400 // WALK))
    walk = c.select("rec", "x1", F.expr(f"t div {WALK}").alias("slot")).join(moved, ["rec", "slot"]).groupBy("rec", "vday", "day").agg(*loud).filter("n >= 20")
    before = c.select("rec", "x1", (F.col("day") + 1).alias("day")).join(w, ["rec", "day"]).groupBy("rec", "vday", "day").agg(*loud).filter("n >= 50")
    ch = walk.withColumnRenamed("y", "walking").join(before.drop("n"), ["rec", "vday", "day"]).withColumn("c", F.col("walking") - F.col("y"))
    ch = materialize(ch.withColumn("kind", F.when(F.col("day") == F.col("vday"), "visit").otherwise("placebo")), "walks")
    d = S.matched_difference(ch, ["rec", "vday"], "kind", ["c"]).join(ch.filter("kind = 'visit'").select("rec", "vday", F.col("n").alias("n_walk_clips")), ["rec", "vday"])
    return d.select("rec", "vday", "n_walk_clips", rnd("d_c").alias("diff"))


@query("t32_busy_vs_quiet_visits", f"""WITH {DIFF}, {BUSY} SELECT busy_s > 900 AS busy, count(*) AS n, round(median(d), 6) + 0.0 AS median, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END)::BIGINT AS quieter FROM dd JOIN busy b ON b.rec = dd.rec AND b.start_t = dd.vid_t WHERE step = 0 GROUP BY 1""")
def t32(spark, sf):
    from fieldhush.operators.ranks import medians

    d = diffs(spark, sf).filter("step = 0")
    v = d.select("rec", F.col("vid_t").alias("start_t"), (F.col("vid_t") + 1800).alias("end_t"), "d")
    s = sessions(spark, sf).select("rec", "start_t", (F.col("start_t") + 1800).alias("end_t"))
    b = J.activity_elsewhere(v, s, "rec", "end_t", "start_t", "end_t").withColumn("busy", F.col("busy_s") > 900)
    b = materialize(b, "busy")
    m = medians(b, ["busy"], ["d"])
    q = b.groupBy("busy").agg(F.count_if(F.col("d") < 0).alias("quieter"))
    return m.join(q, "busy").select("busy", F.col("n_d").alias("n"), rnd("d").alias("median"), "quieter")


@query("t32_dose_correlation", f"""WITH {DIFF}, {BUSY}, j AS (SELECT d, busy_s FROM dd JOIN busy b ON b.rec = dd.rec AND b.start_t = dd.vid_t WHERE step = 0),
r AS (SELECT rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS a, rank() OVER (ORDER BY busy_s) + (count(*) OVER (PARTITION BY busy_s) - 1) / 2.0 AS b FROM j) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""")
def t32b(spark, sf):
    d = diffs(spark, sf).filter("step = 0")
    v = d.select("rec", F.col("vid_t").alias("start_t"), (F.col("vid_t") + 1800).alias("end_t"), "d")
    s = sessions(spark, sf).select("rec", "start_t", (F.col("start_t") + 1800).alias("end_t"))
    b = J.activity_elsewhere(v, s, "rec", "end_t", "start_t", "end_t").select(F.lit(1).alias("g"), "d", "busy_s")
    return S.spearman(b, ["g"], "d", "busy_s").select("n", rnd("rho").alias("rho"))


# ---- panel models ----------------------------------------------------------

def demean_sql(src: str, cols: list[str], rounds: int = 8) -> str:
    """Alternating removal of the means by rec and by moment, unrolled."""
    out, prev = [], src
    for i in range(rounds):
        for f in ("rec", "moment"):
            cur = f"dm{i}_{f}"
            out.append(f"{cur} AS (SELECT * REPLACE (" + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {f}) AS {c}" for c in cols) + f") FROM {prev})")
            prev = cur
    return ",\n".join(out) + f", dm AS (SELECT * FROM {prev})"


PANEL = f"{ctes('panel')}, pw AS (SELECT l_orderkey, l_linenumber, rec, moment, yr, y, near, after_ FROM panel), {demean_sql('pw', ['y', 'near', 'after_'])}"


@query("t26_two_way_demeaning", f"WITH {PANEL} SELECT l_orderkey, l_linenumber, round(y, 4) + 0.0 AS y, round(near, 4) + 0.0 AS near FROM dm")
def t26(spark, sf):
    d = N.demean(panel(spark, sf), "rec", "moment", ["y", "near"])
    return d.select("l_orderkey", "l_linenumber", rnd("r_y", 4).alias("y"), rnd("r_near", 4).alias("near"))


OLS = f"""{PANEL}, g AS (SELECT sum(near * near) AS aa, sum(near * after_) AS ab, sum(after_ * after_) AS bb, sum(near * y) AS ay, sum(after_ * y) AS by_ FROM dm),
bt AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS b1, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS b2, aa, ab, bb, aa * bb - ab * ab AS det FROM g)"""


@query("t27_fixed_effects_ols", f"WITH {OLS} SELECT 'near' AS term, round(b1, 5) AS beta FROM bt UNION ALL SELECT 'after_', round(b2, 5) FROM bt")
def t27(spark, sf):
    return N.fixed_effects_ols(panel(spark, sf), "rec", "moment", "y", ["near", "after_"]).select("term", rnd("beta", 5).alias("beta"))


@query("t28_cluster_robust_errors", f"""WITH {OLS}, q AS (SELECT rec, yr, sum(near * (y - b1 * near - b2 * after_)) AS q1, sum(after_ * (y - b1 * near - b2 * after_)) AS q2 FROM dm, bt GROUP BY 1, 2),
m AS (SELECT sum(q1 * q1) AS m11, sum(q1 * q2) AS m12, sum(q2 * q2) AS m22 FROM q)
SELECT 'near' AS term, round(b1, 5) AS beta, round(sqrt((bb * bb * m11 - 2 * ab * bb * m12 + ab * ab * m22) / (det * det)), 5) AS se FROM bt, m
UNION ALL SELECT 'after_', round(b2, 5), round(sqrt((ab * ab * m11 - 2 * aa * ab * m12 + aa * aa * m22) / (det * det)), 5) FROM bt, m""")
def t28(spark, sf):
    p = panel(spark, sf).withColumn("cluster", F.col("rec") * 10000 + F.col("yr"))
    return N.fixed_effects_ols(p, "rec", "moment", "y", ["near", "after_"], cluster="cluster").select("term", rnd("beta", 5).alias("beta"), rnd("se", 5).alias("se"))


LAGS = {"during": (0, 1800), "after_0_20": (1800, 3000), "after_20_40": (3000, 4200), "after_40_60": (4200, 5400)}


@query("t29_session_lag_indicators", f"WITH {ctes('clips', 'visits')} SELECT clip_id, " + ", ".join(
    f"CASE WHEN EXISTS (SELECT 1 FROM visits v WHERE v.rec = c.rec AND c.t >= v.start_t + {a} AND c.t < v.start_t + {b}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {n}" for n, (a, b) in LAGS.items()) + " FROM clips c")
def t29(spark, sf):
    from fieldhush.operators.events import lag_indicators

    s = sessions(spark, sf).select("rec", "start_t")
    steps = {n: (F.col("start_t") + a, F.col("start_t") + b) for n, (a, b) in LAGS.items()}
    return lag_indicators(clips(spark, sf).select("clip_id", "rec", "t"), s, ["rec"], "t", steps, 1800).select("clip_id", *LAGS)


@query("t30_placebo_session_null")
def t30(spark, sf):
    """During and after effects of the real sessions against 300 shifted schedules, the real ones kept as controls."""
    c = clips(spark, sf)
    rows = c.select("clip_id", "rec", "t", F.col("x1").alias("y"), P.session_key("rec", "t").alias("f1"), F.concat_ws("|", "rec", "hour").alias("f2"))
    rows = materialize(N.demean(rows, "f1", "f2", ["y"]).drop("y"), "minutes")
    s = sessions(spark, sf)
    v = s.select("rec", "start_t", "centre")
    moved = J.same_clock_days(v, c.select("rec", "day").distinct(), ["rec"], "start_t", ["start_t", "centre"])
    free = J.quiet(moved, s.select("rec", F.col("centre").alias("c")), ["rec"], "centre", "c", 7200)
    picks = N.shifted_sessions(free.select("rec", F.col("base_start_t").alias("start_t"), "offset"), ["rec", "start_t"], "offset", 300, "30")
    fake = picks.select("perm", "rec", (F.col("start_t") + F.col("offset")).alias("start_t"))
    names = list(LAGS)
    steps = {n: (F.col("start_t") + a, F.col("start_t") + b) for n, (a, b) in LAGS.items()}
    f = N.lag_hits(rows, fake, ["rec"], "t", ["perm"], steps, 1800)
    real = N.lag_hits(rows, v, ["rec"], "t", [], steps, 1800)
    again = real.select(*rows.columns, *[F.col(n).alias(f"real_{n}") for n in names]).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(300))))
    hits = f.join(again, ["perm", *rows.columns], "full_outer").fillna(0.0, [*names, *[f"real_{n}" for n in names]])
    cells = materialize(rows.groupBy("f1", "f2").agg(F.count("*").alias("n")), "cells")
    null = N.sparse_fits(cells, materialize(hits, "hits"), "perm", "f1", "f2", "n", [[*names, *[f"real_{n}" for n in names]]], "r_y", F.substring_index("f2", "|", 1))
    true = N.sparse_fits(cells, materialize(real.withColumn("perm", F.lit(0)), "hits"), "perm", "f1", "f2", "n", [names], "r_y", F.substring_index("f2", "|", 1))
    both = true.unionByName(null.withColumn("beta", F.slice("beta", 1, len(names))))
    out = N.permutation_p(both, "perm", names)
    return out.select("term", rnd("beta").alias("beta"), rnd("p_two_sided").alias("p"), rnd(2.8 * F.col("null_sd")).alias("smallest_effect"), "n_perm")


@query("t31_schedule_permutation")
def t31(spark, sf):
    """Distance-bin effects on 2-hour cells against 2000 schedules permuted over the recorders of each day."""
    bins = ["approach", "near", "after", "mid"]
    c = clips(spark, sf).groupBy("rec", "day", P.slot_of("t", 120).alias("slot")).agg(F.avg("x1").alias("y"))
    c = c.withColumn("f1", F.concat_ws("|", "day", "slot")).withColumn("f2", F.concat_ws("|", "rec", "slot"))
    rows = materialize(N.demean(c, "f1", "f2", ["y"]).drop("y"), "cells")
    ev = sims(spark, sf).select("rec", F.expr("t div 86400").alias("day"), "t").distinct()
    at = rows.select("day", "slot").distinct().join(ev.select("rec", "day").distinct(), "day")
    at = at.withColumn("mid_t", F.col("day") * 86400 + F.col("slot") * 60 + 3600)
    lab = J.signed_time(at, ev, ["rec", "day"], "mid_t", "t", []).withColumn("bin", J.distance_label(F.col("dt") / 60)).filter("bin <> 'far'")
    perm = N.schedule_permutations(rows.select("day", "rec"), "day", "rec", 2000, "5")
    moved = lab.select("day", "slot", F.col("rec").alias("source"), "bin").join(perm, ["day", "source"]).select("perm", "day", "rec", "slot", "bin")
    hits = moved.join(rows, ["day", "rec", "slot"]).select("perm", "f1", "f2", "r_y", *[(F.col("bin") == b).cast("double").alias(b) for b in bins], F.lit(1.0).alias("pooled"))
    hits = materialize(hits, "hits")
    cells = materialize(rows.groupBy("f1", "f2").agg(F.count("*").alias("n")), "cells")
    fits = N.sparse_fits(cells, hits, "perm", "f1", "f2", "n", [bins, ["pooled"]], "r_y", F.substring_index("f2", "|", -1))
    return N.permutation_p(fits, "perm", [*bins, "pooled"]).select("term", rnd("beta").alias("beta"), rnd("p_lower").alias("p_lower"), rnd("p_two_sided").alias("p_two_sided"), "n_perm")
