"""Join queries (J rows), sessions and window measures (W15, W16, A9-A15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldhush.functions import parse as P
from fieldhush.operators import events as EV
from fieldhush.operators import intervals as J
from fieldhush.operators.aggregates import rarefied_richness, species_share, window_diversity
from fieldhush.operators.quality import noise_filtered_change
from fieldhush.plans.registry import query, rnd
from fieldhush.plans.views import clips, ctes, raw, segments, sims, table, weather
from fieldhush.sources.scratch import materialize



def sessions(spark, sf):
    return materialize(EV.gap_sessions(sims(spark, sf), ["rec"], "t", ["kind"], types="kind"), "sessions")


def visits(spark, sf):
    """Visits of half an hour from the first logged event of each session."""
    return sessions(spark, sf).select("rec", "start_t", (F.col("start_t") + 1800).alias("end_t"), "centre")


def placebos(spark, sf, v=None, s=None):
    s = sessions(spark, sf) if s is None else s
    v = s.select("rec", "start_t", (F.col("start_t") + 1800).alias("end_t"), "centre") if v is None else v
    days = clips(spark, sf).select("rec", "day").distinct()
    moved = J.same_clock_days(v, days, ["rec"], "start_t", ["start_t", "end_t", "centre"])
    free = J.quiet(moved, s.select("rec", F.col("centre").alias("c")), ["rec"], "centre", "c", 7200)
    return free.select("rec", F.col("base_start_t").alias("visit_t"), "start_t", "end_t")


def chosen_placebos(spark, sf, s=None, k=4):
    """Up to ``k`` quiet windows of each visit on other days, without a row for every day."""
    s = sessions(spark, sf) if s is None else s
    v = s.select("rec", "start_t", (F.col("start_t") + 1800).alias("end_t"), "centre")
    centres = s.select("rec", F.col("centre").alias("c"))
    quiet = lambda m: J.quiet(m, centres, ["rec"], "centre", "c", 7200)
    p = J.chosen_days(v, clips(spark, sf).select("rec", "day"), ["rec"], "start_t", ["start_t", "end_t", "centre"], quiet, k, "4")
    return p.select("rec", F.col("base_start_t").alias("visit_t"), "start_t")


# ---- sessions --------------------------------------------------------------

@query("w15_gap_sessions", f"""WITH {ctes('sids')} SELECT rec, min(t) AS start_t, max(t) + 3 AS end_t, round(median(t), 3) AS centre, count(*) AS n_events,
  array_to_string(list_sort(list(DISTINCT kind)), ';') AS types FROM sids GROUP BY rec, sid""")
def w15(spark, sf):
    s = EV.gap_sessions(sims(spark, sf), ["rec"], "t", ["kind"], types="kind")
    return s.select("rec", "start_t", "end_t", rnd("centre", 3).alias("centre"), "n_events", F.array_join("types", ";").alias("types"))


@query("w15_session_ids_on_rows", f"""WITH {ctes('clips')}, g AS (SELECT clip_id, rec, t, CASE WHEN t - lag(t) OVER (PARTITION BY rec ORDER BY t, clip_id) > 2400 THEN 1 ELSE 0 END AS brk FROM clips),
s AS (SELECT *, sum(brk) OVER (PARTITION BY rec ORDER BY t, clip_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT clip_id, min(t) OVER (PARTITION BY rec, sid) AS session_start FROM s""")
def w15b(spark, sf):
    rows = EV.gap_ids(clips(spark, sf).select("clip_id", "rec", "t"), ["rec"], "t", ["clip_id"], 2400)
    first = rows.groupBy("rec", "sid").agg(F.min("t").alias("session_start"))
    return rows.join(first, ["rec", "sid"]).select("clip_id", "session_start")


@query("events_from_labels", f"""WITH {ctes('raw')}, e AS (SELECT "Recorder" AS rec, CAST(epoch(strptime(stamp, '%Y%m%d_%H%M%S')) AS BIGINT) AS t,
  CASE WHEN sim_type = '[]' THEN [] ELSE [trim(q, ' ''') FOR q IN string_split(trim(sim_type, '[]'), ',')] END AS ty,
  CASE WHEN sim_rel = '[]' THEN [] ELSE [TRY_CAST(trim(q) AS DOUBLE) FOR q IN string_split(trim(sim_rel, '[]'), ',')] END AS re FROM raw WHERE sim_type <> '[]'),
x AS (SELECT rec, t, unnest(ty[1:least(len(ty), len(re))]) AS type, unnest(re[1:least(len(ty), len(re))]) AS rel FROM e)
SELECT DISTINCT rec, CAST(round((t - rel) / 3) * 3 AS BIGINT) AS t, type, CASE WHEN lower(type) LIKE '%presence%' THEN 'presence' ELSE 'sound' END AS kind FROM x WHERE rel IS NOT NULL""")
def events_from_labels(spark, sf):
    r = raw(spark, sf).withColumn("t", P.epoch_seconds(P.stamp_ntz("stamp")))
    return EV.logged_events(r, "Recorder", "t", "sim_type", "sim_rel")


@query("w16_recorder_active", f"""WITH {ctes('placebos')} SELECT rec, visit_t, start_t FROM placebos p
WHERE EXISTS (SELECT 1 FROM clips c WHERE c.rec = p.rec AND c.t < p.start_t AND c.t >= p.start_t - 900)
  AND EXISTS (SELECT 1 FROM clips c WHERE c.rec = p.rec AND c.t >= p.end_t AND c.t < p.end_t + 900)""")
def w16(spark, sf):
    p = placebos(spark, sf)
    return J.active_around(p, clips(spark, sf), ["rec"], "start_t", "end_t", "t", 900).select("rec", "visit_t", "start_t")


@query("a27_gap_quantiles", f"""WITH {ctes('clips')}, g AS (SELECT rec, t - lag(t) OVER (PARTITION BY rec ORDER BY t, clip_id) AS gap FROM clips)
SELECT rec, round(quantile_cont(gap, 0.5), 6) AS p50, round(quantile_cont(gap, 0.9), 6) AS p90, round(quantile_cont(gap, 0.99), 6) AS p99,
  sum(CASE WHEN gap > 3600 THEN 1 ELSE 0 END)::BIGINT AS boundaries FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def a27(spark, sf):
    from fieldhush.operators.ranks import percentiles

    g = materialize(EV.gaps(clips(spark, sf).select("rec", "t", "clip_id"), ["rec"], "t", ["clip_id"]).filter("gap is not null"), "gaps")
    q = percentiles(g, ["rec"], "gap", [0.5, 0.9, 0.99])
    at = lambda x: rnd(F.max(F.when(F.col("q") == x, F.col("gap"))))
    wide = q.groupBy("rec").agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))
    return wide.join(g.groupBy("rec").agg(F.count_if(F.col("gap") > 3600).alias("boundaries")), "rec")


@query("a27_bout_purity", f"""WITH {ctes('clips')}, g AS (SELECT rec, t, lab, CASE WHEN t - lag(t) OVER (PARTITION BY rec ORDER BY t, clip_id) > 3600 THEN 1 ELSE 0 END AS brk, clip_id FROM clips),
s AS (SELECT *, sum(brk) OVER (PARTITION BY rec ORDER BY t, clip_id ROWS UNBOUNDED PRECEDING) AS sid FROM g), b AS (SELECT rec, sid, count(*) AS n, sum(lab) AS p FROM s GROUP BY 1, 2)
SELECT rec, CASE WHEN p = 0 THEN 'all_baseline' WHEN p = n THEN 'all_sim' ELSE 'mixed' END AS purity, count(*) AS bouts FROM b GROUP BY 1, 2""")
def a27b(spark, sf):
    b = EV.bout_purity(clips(spark, sf).select("rec", "t", "clip_id", "lab"), ["rec"], "t", ["clip_id"], "lab")
    return b.groupBy("rec", "purity").agg(F.count("*").alias("bouts"))


# ---- equality joins --------------------------------------------------------

@query("j1_metadata_left_join", """SELECT d.doc_id, d.source, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def j1(spark, sf):
    d, lab = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select("doc_id", "source", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("j2_measures_inner_join", f"""WITH {ctes('clips')} SELECT c.rec, count(*) AS n, round(avg(e.value), 6) AS level FROM clips c JOIN events e ON e.event_id = c.clip_id WHERE e.event_type = 'view' GROUP BY 1""")
def j2(spark, sf):
    m = table(spark, sf, "events").filter("event_type = 'view'").select(F.col("event_id").alias("clip_id"), F.col("value").alias("level"))
    return clips(spark, sf).select("clip_id", "rec").join(m, "clip_id").groupBy("rec").agg(F.count("*").alias("n"), rnd(F.avg("level")).alias("level"))


@query("j3_lookup_join", """SELECT n.n_name AS nation, count(*) AS n, round(sum(c.c_acctbal), 4) AS bal FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1""")
def j3(spark, sf):
    # The lookup has one row per nation, a fixed table; the planner broadcasts it from its file size.
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    c = table(spark, sf, "customer")
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy("nation").agg(F.count("*").alias("n"), rnd(F.sum("c_acctbal"), 4).alias("bal"))


@query("j4_semi_join_shifted", f"""WITH {ctes('clips')}, s AS (SELECT DISTINCT rec, t // 600 AS slot FROM clips WHERE lab = 1)
SELECT clip_id FROM clips c WHERE EXISTS (SELECT 1 FROM s WHERE s.rec = c.rec AND s.slot = (c.t - 86400) // 600)""")
def j4(spark, sf):
    c = clips(spark, sf)
    slots = c.filter("lab = 1").select("rec", F.expr("t div 600").alias("slot")).distinct()
    return c.withColumn("slot", F.expr("(t - 86400) div 600")).join(slots, ["rec", "slot"], "left_semi").select("clip_id")


# ---- interval joins and window measures ------------------------------------

@query("j5_interval_join", f"""WITH {ctes('visits')} SELECT v.rec, v.start_t, c.clip_id FROM visits v JOIN clips c ON c.rec = v.rec AND c.t >= v.start_t AND c.t < v.end_t""")
def j5(spark, sf):
    v = visits(spark, sf).select("rec", "start_t", "end_t")
    return J.interval_join(clips(spark, sf).select("clip_id", "rec", "t"), v, ["rec"], "t", "start_t", "end_t", 1800).select("rec", "start_t", "clip_id")


PARTS = """parts AS (SELECT rec, start_t, 'before' AS part, start_t - 1800 AS a, start_t AS b FROM visits UNION ALL SELECT rec, start_t, 'during', start_t, end_t FROM visits
  UNION ALL SELECT rec, start_t, 'after', end_t, end_t + 1800 FROM visits)"""


def parts(spark, sf):
    return J.split_parts(visits(spark, sf).select("rec", "start_t", "end_t"), "start_t", "end_t").drop("end_t")


@query("j6_placebo_days", f"WITH {ctes('placebos')} SELECT rec, visit_t, start_t, end_t FROM placebos")
def j6(spark, sf):
    return placebos(spark, sf)


@query("j7_quiet_any_recorder", f"""WITH {ctes('clips', 'sims')} SELECT clip_id FROM clips c WHERE NOT EXISTS (SELECT 1 FROM sims s WHERE abs(s.t - c.t) < 3600)""")
def j7(spark, sf):
    return J.quiet(clips(spark, sf), sims(spark, sf).select(F.col("t").alias("et")), [], "t", "et", 3600).select("clip_id")


@query("j7_quiet_same_recorder", f"""WITH {ctes('clips', 'sims')} SELECT rec, count(*) AS n FROM clips c WHERE NOT EXISTS (SELECT 1 FROM sims s WHERE s.rec = c.rec AND abs(s.t - c.t) < 7200) GROUP BY 1""")
def j7b(spark, sf):
    q = J.quiet(clips(spark, sf), sims(spark, sf).select("rec", F.col("t").alias("et")), ["rec"], "t", "et", 7200)
    return q.groupBy("rec").agg(F.count("*").alias("n"))


@query("j8_no_overlap", f"""WITH {ctes('visits', 'recdays')}, p AS (SELECT v.rec, v.start_t AS visit_t, v.start_t + (d.day - v.start_t // 86400) * 86400 AS start_t,
  v.end_t + (d.day - v.start_t // 86400) * 86400 AS end_t FROM visits v JOIN recdays d ON d.rec = v.rec AND d.day <> v.start_t // 86400)
SELECT rec, visit_t, start_t FROM p WHERE NOT EXISTS (SELECT 1 FROM sessions s WHERE s.rec = p.rec AND s.end_t > p.start_t - 1800 AND s.start_t < p.end_t + 3600)""")
def j8(spark, sf):
    s = sessions(spark, sf)
    days = clips(spark, sf).select("rec", "day").distinct()
    v = s.select("rec", "start_t", (F.col("start_t") + 1800).alias("end_t"))
    p = J.same_clock_days(v, days, ["rec"], "start_t", ["start_t", "end_t"]).withColumn("a", F.col("start_t") - 1800).withColumn("b", F.col("end_t") + 3600)
    free = J.no_overlap(p, s.select("rec", F.col("start_t").alias("s0"), F.col("end_t").alias("s1")), ["rec"], "a", "b", "s0", "s1")
    return free.select("rec", F.col("base_start_t").alias("visit_t"), "start_t")


@query("j9_nearest_session", f"""WITH {ctes('sessions')}, d AS (SELECT p.clip_id, p.lab, s.start_t, s.n_events, (p.t - s.start_t) / 60.0 AS shift, row_number() OVER (PARTITION BY p.clip_id ORDER BY abs(p.t - s.start_t), s.start_t) AS rn
  FROM clips p JOIN sessions s ON s.rec = p.rec) SELECT clip_id, lab, start_t, n_events, round(shift, 6) AS shift_min, abs(shift) <= 60 AS within_hour FROM d WHERE rn = 1""")
def j9(spark, sf):
    """Every clip with its nearest session, how far it is, and how many events that has."""
    ev = sessions(spark, sf).select("rec", "start_t", "n_events")
    n = J.nearest(clips(spark, sf).select("clip_id", "rec", "t", "lab"), ev, ["rec"], "t", "start_t", ["n_events"]).filter("nearest is not null")
    shift = (F.col("t") - F.col("nearest.start_t")) / 60.0
    return n.select("clip_id", "lab", F.col("nearest.start_t").alias("start_t"), F.col("nearest.n_events").alias("n_events"), rnd(shift).alias("shift_min"), (F.abs(shift) <= 60).alias("within_hour"))


@query("j9_nearest_session_all", f"""WITH {ctes('sessions')},
d AS (SELECT p.clip_id, s.start_t, (p.t - s.start_t) / 60.0 AS shift, row_number() OVER (PARTITION BY p.clip_id ORDER BY abs(p.t - s.start_t), s.start_t) AS rn FROM clips p JOIN sessions s ON s.rec = p.rec)
SELECT clip_id, start_t, round(shift, 6) AS shift_min FROM d WHERE rn = 1""")
def j9_all(spark, sf):
    """Every clip, where J9's first query keeps the quiet ones."""
    n = J.nearest(clips(spark, sf).select("clip_id", "rec", "t"), sessions(spark, sf).select("rec", "start_t"), ["rec"], "t", "start_t", [])
    shift = (F.col("t") - F.col("nearest.start_t")) / 60.0
    return n.filter("nearest is not null").select("clip_id", F.col("nearest.start_t").alias("start_t"), rnd(shift).alias("shift_min"))


@query("j10_previous_stop", f"""WITH {ctes('sessions')}, d AS (SELECT v.rec, v.start_t, s.rec AS prev_rec, s.t AS prev_t,
  row_number() OVER (PARTITION BY v.rec, v.start_t ORDER BY s.t DESC, s.rec DESC) AS rn FROM sessions v
  JOIN (SELECT DISTINCT rec, t FROM sims) s ON s.rec <> v.rec AND s.t < v.start_t AND s.t // 86400 = v.start_t // 86400)
SELECT rec, start_t, prev_rec, prev_t FROM d WHERE rn = 1 AND start_t - prev_t BETWEEN 600 AND 7200""")
def j10(spark, sf):
    ev = sims(spark, sf).select("rec", F.col("t").alias("et")).distinct()
    out = J.previous_stop(sessions(spark, sf).select("rec", "start_t"), ev, "rec", "start_t", "et", [])
    return out.select("rec", "start_t", F.col("prev.rec").alias("prev_rec"), F.col("prev.et").alias("prev_t"))


@query("j11_approach_start", f"""WITH {ctes('visits')}, d AS (SELECT v.rec, v.start_t, greatest(min(s.start_t), 2 * v.start_t - v.end_t) AS approach_t FROM visits v
  JOIN visits s ON s.rec <> v.rec AND s.start_t < v.start_t AND s.start_t >= v.start_t - 3600 GROUP BY v.rec, v.start_t, v.end_t)
SELECT rec, start_t, approach_t FROM d WHERE start_t - approach_t >= 120""")
def j11(spark, sf):
    v = visits(spark, sf).select("rec", "start_t", "end_t")
    return J.approach_start(v, v, "rec", "start_t", "end_t").select("rec", "start_t", "approach_t")


CELLS = "cells AS (SELECT rec, day, t - t % 600 AS slot_t, count(*) AS n, avg(x1) AS y FROM clips GROUP BY 1, 2, 3)"
SIGNED = f"""{CELLS}, near AS (SELECT c.rec, c.slot_t, c.slot_t + 300 - s.t AS dt, row_number() OVER (PARTITION BY c.rec, c.slot_t ORDER BY abs(c.slot_t + 300 - s.t), s.t) AS rn
  FROM cells c JOIN (SELECT DISTINCT rec, t FROM sims) s ON s.rec = c.rec AND s.t // 86400 = c.day),
lab AS (SELECT c.rec, c.day, c.slot_t, c.y, n.dt, CASE WHEN abs(n.dt) < 1200 THEN 'near' WHEN n.dt >= -3600 AND n.dt < -1200 THEN 'approach' WHEN n.dt >= 1200 AND n.dt < 3600 THEN 'after'
  WHEN abs(n.dt) >= 3600 AND abs(n.dt) < 7200 THEN 'mid' ELSE 'far' END AS bin FROM cells c LEFT JOIN near n ON n.rec = c.rec AND n.slot_t = c.slot_t AND n.rn = 1)"""


def labelled_cells(spark, sf):
    """10-minute cells with the signed seconds to the nearest event of the day and its distance label."""
    c = clips(spark, sf).groupBy("rec", "day", P.floor_to("t", 600).alias("slot_t")).agg(F.count("*").alias("n"), F.avg("x1").alias("y"))
    ev = sims(spark, sf).select("rec", F.expr("t div 86400").alias("day"), "t").distinct()
    out = J.signed_time(c.withColumn("mid_t", F.col("slot_t") + 300), ev, ["rec", "day"], "mid_t", "t", [])
    return out.withColumn("bin", J.distance_label(F.col("dt") / 60)).drop("mid_t")


@query("j12_signed_time_to_event", f"WITH {ctes('clips', 'sims')}, {SIGNED} SELECT rec, slot_t, coalesce(dt, 999999) AS dt FROM lab")
def j12(spark, sf):
    return labelled_cells(spark, sf).select("rec", "slot_t", F.coalesce("dt", F.lit(999999)).cast("long").alias("dt"))


@query("j13_distance_label", f"WITH {ctes('clips', 'sims')}, {SIGNED} SELECT bin, count(*) AS cells, round(avg(y), 6) AS level FROM lab GROUP BY 1")
def j13(spark, sf):
    return labelled_cells(spark, sf).groupBy("bin").agg(F.count("*").alias("cells"), rnd(F.avg("y")).alias("level"))


PER_HOUR = 2.5  # clips an hour that a running recorder of these tables gives
CHOSEN = """chosen AS (SELECT rec, visit_t, start_t FROM (SELECT *, row_number() OVER (PARTITION BY rec, visit_t ORDER BY md5('4|' || rec || '|' || visit_t || '|' || start_t)) AS rn FROM placebos) WHERE rn <= 4)"""
SEEN = "(SELECT count(*) FROM clips c WHERE c.rec = {r} AND c.t >= {t} - 1800 AND c.t < {t} + 1800) >= 0.8 * 2.5"
CONTROLS = f"""qc AS (SELECT v.rec, v.start_t AS visit_t, r.rec AS ctrl, g.gap FROM visits v JOIN (SELECT DISTINCT rec FROM clips) r ON r.rec <> v.rec, (SELECT unnest([5400, 3600]) AS gap) g
  WHERE NOT EXISTS (SELECT 1 FROM sims s WHERE s.rec = r.rec AND abs(s.t - v.start_t) < g.gap)),
gp AS (SELECT CASE WHEN count(DISTINCT rec || '@' || visit_t) >= 8 THEN 5400 ELSE 3600 END AS gap FROM qc WHERE gap = 5400),
uc AS (SELECT q.rec, q.visit_t, q.ctrl FROM qc q JOIN gp ON gp.gap = q.gap WHERE {SEEN.format(r='q.ctrl', t='q.visit_t')}),
oc AS (SELECT u.rec, u.visit_t, u.ctrl, p.start_t FROM uc u JOIN chosen p ON p.rec = u.rec AND p.visit_t = u.visit_t
  WHERE NOT EXISTS (SELECT 1 FROM sims s WHERE s.rec = u.ctrl AND abs(s.t - p.start_t) < 7200) AND {SEEN.format(r='u.ctrl', t='p.start_t')}),
ct AS (SELECT rec, visit_t, ctrl FROM (SELECT *, row_number() OVER (PARTITION BY rec, visit_t ORDER BY md5('23|' || ctrl || '|' || rec || '|' || visit_t)) AS rn FROM (SELECT DISTINCT rec, visit_t, ctrl FROM oc)) WHERE rn <= 3),
co AS (SELECT oc.* FROM oc JOIN ct ON ct.rec = oc.rec AND ct.visit_t = oc.visit_t AND ct.ctrl = oc.ctrl)"""


def controls(spark, sf, chosen):
    """(rec, visit_t, ctrl, offset): unvisited recorders of each visit, with the usable ones of its placebo times."""
    v = visits(spark, sf).select("rec", F.col("start_t").alias("visit_t"))
    return J.control_recorders(v, chosen, sims(spark, sf).select("rec", "t"), clips(spark, sf).select("rec", "t"), "rec", "visit_t", "start_t", "t", PER_HOUR)


@query("j14_control_recorders", f"""WITH {ctes('placebos')}, {CHOSEN}, {CONTROLS} SELECT rec, visit_t AS start_t, ctrl, start_t - visit_t AS "offset" FROM co""")
def j14(spark, sf):
    """Unvisited recorders at each visit's time that recorded, and the visit's placebo times at which they are quiet and recorded too."""
    chosen = materialize(chosen_placebos(spark, sf), "chosen")
    return controls(spark, sf, chosen).select("rec", F.col("visit_t").alias("start_t"), "ctrl", "offset")


@query("j15_far_windows", f"""WITH {ctes('visits')}, o AS (SELECT rec, start_t, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS i, unnest([-3, 3, -4, 4, -5, 5, -6, 6]) AS h FROM visits),
f AS (SELECT *, start_t + h * 3600 AS far_t FROM o), g AS (SELECT * FROM f WHERE far_t % 86400 // 60 BETWEEN 330 AND 1110
  AND NOT EXISTS (SELECT 1 FROM sims s WHERE s.rec = f.rec AND abs(s.t - f.far_t) < 10800) AND NOT EXISTS (SELECT 1 FROM sims s WHERE abs(s.t - f.far_t) < 1200)),
r AS (SELECT *, row_number() OVER (PARTITION BY rec, start_t ORDER BY i) AS rn FROM g) SELECT rec, start_t, CAST(h AS INTEGER) AS h, far_t FROM r WHERE rn <= 2""")
def j15(spark, sf):
    v = visits(spark, sf).select("rec", "start_t")
    return J.far_windows(v, sims(spark, sf).select("rec", F.col("t").alias("et")), "rec", "start_t", "et", gap_any=1200)


@query("j16_hourly_weather", f"""WITH {ctes('visits', 'weather')} SELECT v.rec, v.start_t, round(avg(w.temp), 6) AS temp, round(avg(w.wind), 6) AS wind FROM visits v
LEFT JOIN weather w ON w.hour_t >= v.start_t - v.start_t % 3600 AND w.hour_t < v.end_t GROUP BY 1, 2""")
def j16(spark, sf):
    v = visits(spark, sf).select("rec", "start_t", "end_t")
    out = J.hourly_mean(v, weather(spark, sf), "start_t", "end_t", "hour_t", ["temp", "wind"])
    return out.select("rec", "start_t", rnd("temp").alias("temp"), rnd("wind").alias("wind"))


BUSY = """busy AS (SELECT v.rec, v.start_t, v.end_t, sum(CASE WHEN s.rec IS NULL THEN 0 ELSE greatest(least(s.end_t, v.end_t + 3600) - greatest(s.start_t, v.end_t), 0) END)::BIGINT AS busy_s FROM visits v
  LEFT JOIN visits s ON s.rec <> v.rec AND s.end_t > v.end_t AND s.start_t < v.end_t + 3600 GROUP BY 1, 2, 3)"""


@query("j17_activity_elsewhere", f"WITH {ctes('visits')}, {BUSY} SELECT rec, start_t, busy_s, busy_s > 1800 AS busy FROM busy")
def j17(spark, sf):
    v = visits(spark, sf).select("rec", "start_t", "end_t")
    out = J.activity_elsewhere(v, v, "rec", "end_t", "start_t", "end_t")
    return out.select("rec", "start_t", "busy_s", (F.col("busy_s") > 1800).alias("busy"))


@query("j18_site_pairs", f"""WITH {ctes('dims')}, m AS (SELECT rec, dim, avg(v) AS v FROM dims GROUP BY 1, 2)
SELECT a.rec AS rec_a, b.rec AS rec_b, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 6) AS distance FROM m a JOIN m b ON a.dim = b.dim AND a.rec < b.rec GROUP BY 1, 2""")
def j18(spark, sf):
    from fieldhush.functions.vectors import group_vectors, l2_distance

    m = group_vectors(segments(spark, sf), ["rec"], "embedding", {"v": "mean"})
    return J.pairs(m, "rec", "v").select("rec_a", "rec_b", rnd(l2_distance("vec_a", "vec_b")).alias("distance"))


# ---- window measures -------------------------------------------------------

@query("a9_minute_bins", f"""WITH {ctes('clips')} SELECT rec, t - t % 1800 AS minute_t, count(*) AS n, round(avg(lab), 6) AS share, round(avg(x1), 6) AS level FROM clips GROUP BY 1, 2 HAVING count(*) >= 2""")
def a9(spark, sf):
    from fieldhush.operators.aggregates import time_bins

    b = time_bins(clips(spark, sf), ["rec"], "t", 1800, [F.avg("lab").alias("share"), F.avg("x1").alias("level")], least=2, out="minute_t")
    return b.select("rec", "minute_t", "n", rnd("share").alias("share"), rnd("level").alias("level"))


@query("a10_window_coverage", f"""WITH {ctes('visits')}, {PARTS} SELECT p.rec, p.start_t, p.part, count(c.clip_id) AS n, round(count(c.clip_id) * 3600.0 / (1800 * 2.5), 6) AS cov, count(c.clip_id) * 3600.0 / (1800 * 2.5) >= 0.8 AS ok
FROM parts p LEFT JOIN clips c ON c.rec = p.rec AND c.t >= p.a AND c.t < p.b GROUP BY 1, 2, 3""")
def a10(spark, sf):
    c = J.coverage(clips(spark, sf), parts(spark, sf), ["rec"], "t", "part_start", "part_end", 2.5, 1800)
    return c.select("rec", "start_t", "part", "n", rnd("cov").alias("cov"), (F.col("cov") >= 0.8).alias("ok"))


@query("a11_window_medians", f"""WITH {ctes('visits')}, {PARTS} SELECT p.rec, p.start_t, p.part, round(CASE WHEN count(c.x1) >= 2 THEN median(c.x1) END, 6) AS med
FROM parts p LEFT JOIN clips c ON c.rec = p.rec AND c.t >= p.a AND c.t < p.b GROUP BY 1, 2, 3""")
def a11(spark, sf):
    from fieldhush.operators.aggregates import window_medians

    p = parts(spark, sf)
    out = window_medians(clips(spark, sf), p, ["rec"], "t", "part_start", "part_end", ["x1"], least=2, bucket=1800)
    return out.select("rec", "start_t", "part", rnd("x1").alias("med"))


@query("a12_window_bird_statistics", f"""WITH {ctes('visits')}, s AS (SELECT v.rec, v.start_t, c.species, count(*) AS k FROM visits v JOIN clips c ON c.rec = v.rec AND c.t >= v.start_t - 7200 AND c.t < v.end_t GROUP BY 1, 2, 3),
t AS (SELECT *, sum(k) OVER (PARTITION BY rec, start_t) AS n FROM s)
SELECT rec, start_t, round(sum(k) / 150.0, 6) AS rate, count(*) AS richness, round(-sum(k / n * ln(k / n)), 6) + 0.0 AS shannon, round(sum(CASE WHEN species = 'click' THEN k ELSE 0 END) / max(n), 6) AS owl_frac FROM t GROUP BY 1, 2""")
def a12(spark, sf):
    v = visits(spark, sf).select("rec", "start_t", (F.col("start_t") - 7200).alias("a"), F.col("end_t").alias("b"))
    out = window_diversity(clips(spark, sf), v, ["rec"], "t", "a", "b", "species", F.col("species") == "click", 7200)
    return out.filter("n > 0").select("rec", "start_t", rnd("rate").alias("rate"), F.col("richness").cast("long").alias("richness"), rnd("shannon").alias("shannon"), rnd("owl_frac").alias("owl_frac"))


@query("a13_share_and_species_union", f"""WITH {ctes('visits')} SELECT v.rec, v.start_t, round(avg(CASE WHEN c.x1 > 20 THEN 1.0 ELSE 0.0 END), 6) AS bird_share, count(DISTINCT c.species) AS n_species
FROM visits v JOIN clips c ON c.rec = v.rec AND c.t >= v.start_t AND c.t < v.end_t + 3600 GROUP BY 1, 2""")
def a13(spark, sf):
    v = visits(spark, sf).select("rec", "start_t", (F.col("end_t") + 3600).alias("b"))
    aggs = [rnd(F.avg((F.col("x1") > 20).cast("double"))).alias("bird_share"), F.count_distinct("species").alias("n_species")]
    out = J.window_measures(clips(spark, sf), v, ["rec"], "t", "start_t", "b", aggs, 3600)
    return out.filter("n_species is not null").drop("b")


@query("a14_rarefied_richness", f"""WITH {ctes('clips')}, s AS (SELECT rec, day, species, count(*) AS k FROM clips GROUP BY 1, 2, 3), t AS (SELECT *, sum(k) OVER (PARTITION BY rec, day) AS n FROM s)
SELECT rec, day, round(sum(1 - CASE WHEN n - k < 15 THEN 0 ELSE exp(lgamma(n - k + 1) - lgamma(n - k - 14) - lgamma(n + 1) + lgamma(n - 14)) END), 6) AS richness FROM t WHERE n >= 15 GROUP BY 1, 2""")
def a14(spark, sf):
    return rarefied_richness(clips(spark, sf), ["rec", "day"], "species", 15).select("rec", "day", rnd("richness").alias("richness"))


@query("a15_species_share", f"""WITH {ctes('visits')}, f AS (SELECT species FROM clips GROUP BY 1 HAVING count(*) >= 200),
w AS (SELECT v.rec, v.start_t, c.clip_id, c.species FROM visits v JOIN clips c ON c.rec = v.rec AND c.t >= v.start_t AND c.t < v.end_t + 3600),
n AS (SELECT rec, start_t, count(*) AS n FROM w GROUP BY 1, 2)
SELECT n.rec, n.start_t, f.species, n.n, round(count(w.clip_id) / n.n::DOUBLE, 6) AS share FROM n CROSS JOIN f LEFT JOIN w ON w.rec = n.rec AND w.start_t = n.start_t AND w.species = f.species GROUP BY n.rec, n.start_t, f.species, n.n""")
def a15(spark, sf):
    """Every frequent species in every window, with the share 0 of the window's ``n`` clips where it was not heard."""
    v = visits(spark, sf).select("rec", "start_t", (F.col("end_t") + 3600).alias("b"))
    c = clips(spark, sf).select("rec", "t", "clip_id", F.array("species").alias("tags"))
    return species_share(c, v, ["rec"], "t", "start_t", "b", "tags", least=200, dense=True).select("rec", "start_t", "species", "n", rnd("share").alias("share"))


NOISE_BEFORE, NOISE_AFTER = 86400, 259200  # clips of these tables are sparse: 20 and 60 quiet ones need a day and three days


@query("p23_noisy_clips", f"""WITH {ctes('visits')}, b AS (SELECT v.rec, v.start_t, c.x1, c.x2, median(c.x1) OVER (PARTITION BY v.rec, v.start_t) + 3 AS cut, count(*) OVER (PARTITION BY v.rec, v.start_t) AS n FROM visits v
  JOIN clips c ON c.rec = v.rec AND c.t >= v.start_t - {NOISE_BEFORE} AND c.t < v.start_t),
kb AS (SELECT rec, start_t, cut, count_if(x1 <= cut) AS n_before, median(CASE WHEN x1 <= cut THEN x2 END) AS m FROM b WHERE n >= 0.5 * {NOISE_BEFORE} * {PER_HOUR} / 3600 GROUP BY 1, 2, 3),
ka AS (SELECT k.rec, k.start_t, k.n_before, k.m, count_if(c.x1 <= k.cut) AS n_after, avg(CASE WHEN c.x1 > k.cut THEN 1.0 ELSE 0.0 END) AS noisy, median(CASE WHEN c.x1 <= k.cut THEN c.x2 END) AS ma FROM kb k
  JOIN visits v ON v.rec = k.rec AND v.start_t = k.start_t JOIN clips c ON c.rec = v.rec AND c.t >= v.end_t AND c.t < v.end_t + {NOISE_AFTER} GROUP BY 1, 2, 3, 4 HAVING count(*) >= 0.5 * {NOISE_AFTER} * {PER_HOUR} / 3600)
SELECT rec, start_t, n_before, n_after, round(noisy, 6) AS noisy_share, round(ma - m, 6) + 0.0 AS change FROM ka WHERE n_before >= 20 AND n_after >= 60""")
def p23(spark, sf):
    """Both sides without noisy clips: the change of the level, where 20 clips before and 60 after the visit are left."""
    v = visits(spark, sf).select("rec", "start_t", "end_t")
    c = clips(spark, sf).select("rec", "t", "x1", F.col("x2").cast("double").alias("level"))
    side = lambda a, b: J.interval_join(c, v.select("rec", "start_t", a.alias("a"), b.alias("b")), ["rec"], "t", "a", "b", 86400).select("rec", "start_t", "x1", "level")
    before = side(F.col("start_t") - NOISE_BEFORE, F.col("start_t"))
    after = side(F.col("end_t"), F.col("end_t") + NOISE_AFTER)
    expected = (NOISE_BEFORE * PER_HOUR / 3600, NOISE_AFTER * PER_HOUR / 3600)
    out = noise_filtered_change(before, after, ["rec", "start_t"], "x1", "level", 3.0, expected)
    return out.select("rec", "start_t", "n_before", "n_after", rnd("noisy_share").alias("noisy_share"), rnd("change").alias("change"))


@query("k7_placebo_choice", f"""WITH {ctes('placebos')}, r AS (SELECT *, row_number() OVER (PARTITION BY rec, visit_t ORDER BY md5('4|' || rec || '|' || visit_t || '|' || start_t)) AS rn FROM placebos)
SELECT rec, visit_t, start_t FROM r WHERE rn <= 4""")
def k7(spark, sf):
    return chosen_placebos(spark, sf)
