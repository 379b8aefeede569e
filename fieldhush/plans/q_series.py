"""Window-function queries (W rows of the survey) and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldhush.operators import series as S
from fieldhush.operators.blocks import ordered
from fieldhush.operators.transitions import dynamic_features, transition_matrix
from fieldhush.plans.registry import query, rnd
from fieldhush.plans.views import clips, ctes, scores, segments

BY, ORDER = ["rec"], ["t", "clip_id"]
W = "PARTITION BY rec ORDER BY t, clip_id"


def z_sql(x: str, mean: str, std: str) -> str:
    return f"({x} - {mean}) / greatest({std}, 1e-6)"


ROLL = f"""roll AS (SELECT clip_id, rec, t, lab, x1, x2, count(*) OVER p AS n, avg(x1) OVER p AS m1, stddev_pop(x1) OVER p AS s1,
  avg(x2) OVER p AS m2, stddev_pop(x2) OVER p AS s2 FROM clips WINDOW p AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
rz AS (SELECT *, CASE WHEN n >= 2 THEN {z_sql('x1', 'm1', 's1')} ELSE 0 END AS z1, CASE WHEN n >= 2 THEN {z_sql('x2', 'm2', 's2')} ELSE 0 END AS z2 FROM roll)"""


@query("flagship_rolling_alerts", f"""WITH {ctes('clips')}, {ROLL},
v AS (SELECT rec, lab, CASE WHEN sum(CASE WHEN abs(z1) > 1.5 THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 THEN 1 ELSE 0 END AS alert FROM rz)
SELECT rec, count(*) AS n_clips, sum(alert)::BIGINT AS n_alerts, sum(alert * lab)::BIGINT AS n_alerts_sim FROM v GROUP BY rec""")
def flagship(spark, sf):
    """One pass: rolling z over the last 20 clips, then at least 3 unusual clips of the last 5."""
    o = ordered(clips(spark, sf).select("clip_id", "rec", "t", "x1", "lab"), BY, ORDER, before=24)
    z = S.rolling_z_on(o, o.df, ["x1"], 20)
    voted = o.home(S.vote_on(o, z, F.abs("z_x1") > 1.5, 3, 5))
    return voted.groupBy("rec").agg(F.count("*").alias("n_clips"), F.sum("alert").alias("n_alerts"),
                                    F.sum(F.col("alert") * F.col("lab")).alias("n_alerts_sim"))


@query("w1_hour_baseline_z", f"""WITH {ctes('clips')}, s AS (SELECT rec, hour, avg(x1) AS m1, stddev_samp(x1) AS s1, avg(x2) AS m2, stddev_samp(x2) AS s2 FROM clips WHERE lab = 0 GROUP BY 1, 2)
SELECT clip_id, round(coalesce((x1 - m1) / CASE WHEN s1 = 0 THEN 1e-6 ELSE s1 END, 0), 6) + 0.0 AS z_x1, round(coalesce((x2 - m2) / CASE WHEN s2 = 0 THEN 1e-6 ELSE s2 END, 0), 6) + 0.0 AS z_x2
FROM clips c LEFT JOIN s ON s.rec = c.rec AND s.hour = c.hour""")
def w1(spark, sf):
    out = S.baseline_z(clips(spark, sf), ["rec", "hour"], ["x1", "x2"], F.expr("lab = 0"))
    return out.select("clip_id", rnd("z_x1").alias("z_x1"), rnd("z_x2").alias("z_x2"))


@query("w2_train_only_z", f"""WITH {ctes('clips')}, s AS (SELECT hour, avg(x1) AS m1, stddev_samp(x1) AS s1 FROM clips WHERE lab = 0 AND clip_id % 5 <> 0 AND hour < 20 GROUP BY 1)
SELECT clip_id, round(coalesce((x1 - m1) / CASE WHEN s1 = 0 THEN 1e-6 ELSE s1 END, 0), 6) + 0.0 AS z_x1 FROM clips c LEFT JOIN s ON s.hour = c.hour WHERE clip_id % 5 = 0""")
def w2(spark, sf):
    c = clips(spark, sf)
    train, test = c.filter("clip_id % 5 <> 0 AND hour < 20"), c.filter("clip_id % 5 = 0")
    return S.baseline_z(test, ["hour"], ["x1"], F.expr("lab = 0"), train).select("clip_id", rnd("z_x1").alias("z_x1"))


@query("w3_rolling_z_labelled", f"""WITH {ctes('clips')}, b AS (SELECT *, sum(1 - lab) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb FROM clips),
s AS (SELECT rec, row_number() OVER ({W}) AS i, count(*) OVER p AS n, avg(x1) OVER p AS m1, stddev_pop(x1) OVER p AS s1 FROM clips WHERE lab = 0
  WINDOW p AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT b.clip_id, round(CASE WHEN s.n >= 2 THEN {z_sql('x1', 'm1', 's1')} ELSE 0 END, 6) + 0.0 AS z_x1 FROM b LEFT JOIN s ON s.rec = b.rec AND s.i = b.nb""")
def w3(spark, sf):
    c = clips(spark, sf).select("clip_id", "rec", "t", "x1", "lab")
    return S.labelled_rolling_z(c, BY, ORDER, ["x1"], F.expr("lab = 0"), 20).select("clip_id", rnd("z_x1").alias("z_x1"))


@query("w4_rolling_z_unlabelled", f"WITH {ctes('clips')}, {ROLL} SELECT clip_id, round(z1, 6) + 0.0 AS z_x1, round(z2, 6) + 0.0 AS z_x2 FROM rz")
def w4(spark, sf):
    c = clips(spark, sf).select("clip_id", "rec", "t", "x1", "x2")
    out = S.rolling_z(c, BY, ORDER, ["x1", "x2"], 20)
    return out.select("clip_id", rnd("z_x1").alias("z_x1"), rnd("z_x2").alias("z_x2"))


@query("w5_initial_calibration_z", f"""WITH {ctes('clips')}, r AS (SELECT *, row_number() OVER ({W}) AS rn FROM clips),
s AS (SELECT rec, avg(x1) AS m1, stddev_pop(x1) AS s1 FROM r WHERE rn <= 60 GROUP BY 1)
SELECT clip_id, round({z_sql('x1', 'm1', 's1')}, 6) + 0.0 AS z_x1 FROM r JOIN s ON s.rec = r.rec""")
def w5(spark, sf):
    c = clips(spark, sf).select("clip_id", "rec", "t", "x1")
    return S.calibration_z(c, BY, ORDER, ["x1"], 60).select("clip_id", rnd("z_x1").alias("z_x1"))


SELF_UPDATE = f"""WITH RECURSIVE {ctes('clips')}, r AS (SELECT clip_id, rec, x1, CAST(x2 AS DOUBLE) AS x2, row_number() OVER ({W}) AS rn FROM clips),
s AS (SELECT rec, rn, clip_id, 0.0::DOUBLE AS z1, 0.0::DOUBLE AS z2, [x1] AS b1, [x2] AS b2 FROM r WHERE rn = 1
  UNION ALL SELECT rec, rn, clip_id, z1, z2, CASE WHEN len(p1) < 2 OR (abs(z1) + abs(z2)) / 2 < 2.5 THEN list_append(p1, x1)[-20:] ELSE p1 END, CASE WHEN len(p1) < 2 OR (abs(z1) + abs(z2)) / 2 < 2.5 THEN list_append(p2, x2)[-20:] ELSE p2 END
  FROM (SELECT r.rec, r.rn, r.clip_id, r.x1, r.x2, s.b1 AS p1, s.b2 AS p2, CASE WHEN len(s.b1) < 2 THEN 0.0::DOUBLE ELSE (r.x1 - list_avg(s.b1)) / greatest(list_stddev_pop(s.b1), 1e-6) END AS z1,
    CASE WHEN len(s.b1) < 2 THEN 0.0::DOUBLE ELSE (r.x2 - list_avg(s.b2)) / greatest(list_stddev_pop(s.b2), 1e-6) END AS z2 FROM s JOIN r ON r.rec = s.rec AND r.rn = s.rn + 1))
SELECT clip_id, round(z1, 5) + 0.0 AS z_x1, round(z2, 5) + 0.0 AS z_x2 FROM s"""


@query("w6_self_updating_z", SELF_UPDATE)
def w6(spark, sf):
    c = clips(spark, sf).select("clip_id", "rec", "t", "x1", F.col("x2").cast("double").alias("x2"))
    out = S.self_updating_z(c, BY, ORDER, ["x1", "x2"])
    return out.select("clip_id", rnd("z_x1", 5).alias("z_x1"), rnd("z_x2", 5).alias("z_x2"))


@query("w7_new_site_calibration_z", f"""WITH {ctes('clips')}, b AS (SELECT rec, x1, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY rec) AS tot FROM clips WHERE lab = 0),
g AS (SELECT *, unnest([0, 10, 20, 50, 100, 200, -1]) AS n_calib FROM b),
s AS (SELECT rec, n_calib, avg(x1) AS m1, stddev_pop(x1) AS s1 FROM g WHERE rn <= CASE WHEN n_calib < 0 THEN tot ELSE least(n_calib, tot) END
  AND rn > CASE WHEN n_calib < 0 THEN tot ELSE least(n_calib, tot) END - 20 GROUP BY 1, 2),
r AS (SELECT clip_id, rec, x1, unnest([0, 10, 20, 50, 100, 200, -1]) AS n_calib FROM clips)
SELECT r.clip_id, r.n_calib, round(CASE WHEN r.n_calib = 0 THEN 0 ELSE coalesce({z_sql('x1', 'm1', 's1')}, 0) END, 6) + 0.0 AS z_x1
FROM r LEFT JOIN s ON s.rec = r.rec AND s.n_calib = r.n_calib""")
def w7(spark, sf):
    c = clips(spark, sf).select("clip_id", "rec", "t", "x1", "lab")
    out = S.new_site_z(c, BY, ORDER, ["x1"], F.expr("lab = 0"), [0, 10, 20, 50, 100, 200, -1])
    return out.select("clip_id", "n_calib", rnd("z_x1").alias("z_x1"))


@query("w8_rolling_percentile", f"""WITH {ctes('clips')}, p AS (SELECT clip_id, x1, list(x1) OVER ({W} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS h FROM clips)
SELECT clip_id, round(CASE WHEN coalesce(len(h), 0) >= 2 THEN len([q FOR q IN h IF q < x1]) / len(h)::DOUBLE ELSE 0.5 END, 6) AS pct FROM p""")
def w8(spark, sf):
    c = clips(spark, sf).select("clip_id", "rec", "t", "x1")
    return S.rolling_percentile(c, BY, ORDER, "x1").select("clip_id", rnd("pct").alias("pct"))


VEL = f"""pairs AS (SELECT vec_id, rec, sqrt(sum((v - pv) * (v - pv))) AS raw FROM (SELECT vec_id, rec, v, lag(v) OVER (PARTITION BY rec, dim ORDER BY vec_id) AS pv FROM dims) GROUP BY 1, 2),
vel AS (SELECT vec_id, rec, coalesce(raw, 0.0) AS velocity, row_number() OVER (PARTITION BY rec ORDER BY vec_id) AS rn FROM pairs),
acc AS (SELECT *, CASE WHEN rn > 2 THEN abs(velocity - lag(velocity) OVER (PARTITION BY rec ORDER BY vec_id)) ELSE 0.0 END AS accel FROM vel)"""
VP = "PARTITION BY rec ORDER BY vec_id ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING"


@query("w9_velocity_acceleration", f"WITH {ctes('dims')}, {VEL} SELECT vec_id, round(velocity, 6) AS velocity, round(accel, 6) AS accel FROM acc")
def w9(spark, sf):
    s = segments(spark, sf).select("vec_id", "rec", "embedding")
    o = ordered(s, BY, ["vec_id"], before=3)
    return o.home(S.velocity_on(o, o.df, "embedding")).select("vec_id", rnd("velocity").alias("velocity"), rnd("accel").alias("accel"))


@query("w10_rolling_z_velocity", f"""WITH {ctes('dims')}, {VEL}, r AS (SELECT *, count(*) OVER p AS n, avg(velocity) OVER p AS mv, stddev_pop(velocity) OVER p AS sv, avg(accel) OVER p AS ma, stddev_pop(accel) OVER p AS sa FROM acc WINDOW p AS ({VP}))
SELECT vec_id, round(CASE WHEN n >= 3 THEN {z_sql('velocity', 'mv', 'sv')} ELSE 0 END, 5) + 0.0 AS z_velocity, round(CASE WHEN n >= 3 THEN {z_sql('accel', 'ma', 'sa')} ELSE 0 END, 5) + 0.0 AS z_accel FROM r""")
def w10(spark, sf):
    out = S.velocity(segments(spark, sf).select("vec_id", "rec", "embedding"), BY, ["vec_id"], "embedding")
    return out.select("vec_id", rnd("z_velocity", 5).alias("z_velocity"), rnd("z_accel", 5).alias("z_accel"))


@query("w11_spectral_anomaly", f"""WITH {ctes('clips')}, r AS (SELECT clip_id, rec, t, x1, x2, count(*) OVER p AS n, avg(x1) OVER p AS m1, stddev_pop(x1) OVER p AS s1, avg(x2) OVER p AS m2, stddev_pop(x2) OVER p AS s2
  FROM clips WINDOW p AS ({W} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)),
a AS (SELECT clip_id, rec, t, CASE WHEN n >= 2 THEN sqrt(pow({z_sql('x1', 'm1', 's1')}, 2) + pow({z_sql('x2', 'm2', 's2')}, 2)) ELSE 0 END AS anomaly FROM r),
h AS (SELECT clip_id, round(anomaly, 9) AS anomaly, list(round(anomaly, 9)) OVER ({W} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS h FROM a)
SELECT clip_id, round(anomaly, 5) AS anomaly, round(CASE WHEN coalesce(len(h), 0) >= 2 THEN len([q FOR q IN h IF q < anomaly]) / len(h)::DOUBLE ELSE 0.5 END, 6) AS anomaly_pct FROM h""")
def w11(spark, sf):
    c = clips(spark, sf).select("clip_id", "rec", "t", "x1", "x2")
    return S.spectral_anomaly(c, BY, ORDER, ["x1", "x2"]).select("clip_id", rnd("anomaly", 5).alias("anomaly"), rnd("anomaly_pct").alias("anomaly_pct"))


VOTES = [(3, 2), (5, 3), (5, 4), (10, 6), (10, 7), (15, 9)]


@query("w12_sequence_vote", f"WITH {ctes('scores')} SELECT clip_id, " + ", ".join(
    f"CASE WHEN sum(CASE WHEN score >= 0.6 THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {k} THEN 1 ELSE 0 END AS alert_{n}_{k}" for n, k in VOTES) + " FROM scores")
def w12(spark, sf):
    s = scores(spark, sf).select("clip_id", "rec", "t", "score")
    return S.sequence_vote(s, BY, ORDER, F.col("score") >= 0.6, VOTES).select("clip_id", *[f"alert_{n}_{k}" for n, k in VOTES])


@query("w13_top_share_vote", f"""WITH {ctes('scores')}, c AS (SELECT rec, list_sort(list(score), 'DESC')[1 + least(floor(count(*) * 0.15)::BIGINT, count(*) - 1)] AS th FROM scores GROUP BY 1)
SELECT clip_id, CASE WHEN sum(CASE WHEN score >= th THEN 1 ELSE 0 END) OVER (PARTITION BY s.rec ORDER BY t, clip_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 THEN 1 ELSE 0 END AS alert FROM scores s JOIN c ON c.rec = s.rec""")
def w13(spark, sf):
    s = scores(spark, sf).select("clip_id", "rec", "t", "score")
    return S.top_share_vote(s, BY, ORDER, "score", 3, 5).select("clip_id", "alert")


@query("w14_change_features", f"""WITH {ctes('clips')}, r AS (SELECT clip_id, x1, coalesce(x1 - lag(x1) OVER w, 0) AS delta, avg(x1) OVER p AS roll_mean, coalesce(stddev_samp(x1) OVER p, 0) AS roll_std,
  CASE WHEN x2 < 20 AND coalesce(lag(x2) OVER w, 99) >= 20 THEN 1 ELSE 0 END AS silence_onset FROM clips WINDOW w AS ({W}), p AS ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT clip_id, round(delta, 6) + 0.0 AS delta, round(roll_mean, 6) AS roll_mean, round(roll_std, 6) AS roll_std, round(CASE WHEN roll_std > 0 THEN (x1 - roll_mean) / roll_std ELSE 0 END, 6) + 0.0 AS roll_z, silence_onset FROM r""")
def w14(spark, sf):
    c = clips(spark, sf).select("clip_id", "rec", "t", "x1", "x2")
    out = S.change_features(c, BY, ORDER, "x1", F.col("x2") < 20)
    return out.select("clip_id", *[rnd(k).alias(k) for k in ("delta", "roll_mean", "roll_std", "roll_z")], "silence_onset")


@query("w17_lag_context", f"""WITH {ctes('dims')}, d AS (SELECT vec_id, dim, {', '.join(f'lag(v, {k}) OVER w AS c{k}' for k in range(1, 6))} FROM dims WINDOW w AS (PARTITION BY rec, dim ORDER BY vec_id)),
g AS (SELECT vec_id, list({{'dim': dim, 'c': [c5, c4, c3, c2, c1]}} ORDER BY dim) AS l FROM d WHERE c5 IS NOT NULL GROUP BY 1)
SELECT vec_id, CAST(5 * len(l) AS INTEGER) AS width, array_to_string(flatten([[CAST(CAST(round(x.c[k] * 1000000) AS BIGINT) AS VARCHAR) FOR x IN l] FOR k IN [1, 2, 3, 4, 5]]), ' ') AS context FROM g""")
def w17(spark, sf):
    """The five segments before each as one vector; all values in millionths, oldest segment first."""
    out = S.lag_context(segments(spark, sf).select("vec_id", "rec", "embedding"), BY, ["vec_id"], "embedding", 5)
    values = F.transform("context", lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string"))
    return out.select("vec_id", F.size("context").alias("width"), F.array_join(values, " ").alias("context"))


@query("w17_lag_context_values", f"""WITH {ctes('dims')}, d AS (SELECT vec_id, dim, {', '.join(f'lag(v, {k}) OVER w AS c{k}' for k in range(1, 6))} FROM dims WINDOW w AS (PARTITION BY rec, dim ORDER BY vec_id))
{' UNION ALL '.join(f'SELECT vec_id, CAST({(5 - k) * 64} + dim AS INTEGER) AS i, round(c{k}, 6) + 0.0 AS v FROM d WHERE c5 IS NOT NULL' for k in range(5, 0, -1))}""")
def w17_values(spark, sf):
    """All 320 values of each context."""
    out = S.lag_context(segments(spark, sf).select("vec_id", "rec", "embedding"), BY, ["vec_id"], "embedding", 5)
    return out.select("vec_id", F.posexplode("context").alias("i", "v")).select("vec_id", "i", rnd("v").alias("v"))


STATES_SQL = f"""seq AS (SELECT vec_id, rec, state, clip_label, lag(state) OVER w AS prev, row_number() OVER w AS rn, lead(state) OVER w AS nxt, lead(clip_label) OVER w AS nxt_label FROM segments WINDOW w AS (PARTITION BY rec ORDER BY vec_id)),
cnt AS (SELECT r.rec, a.s AS s1, b.s AS s2, 1e-3 + coalesce(c.n, 0) AS w FROM (SELECT DISTINCT rec FROM segments) r, range(10) a(s), range(10) b(s)
  LEFT JOIN (SELECT rec, state, nxt, count(*) AS n FROM seq WHERE clip_label = 0 AND nxt_label = 0 GROUP BY 1, 2, 3) c ON c.rec = r.rec AND c.state = a.s AND c.nxt = b.s),
trans AS (SELECT rec, s1, s2, w / sum(w) OVER (PARTITION BY rec, s1) AS p FROM cnt)"""


@query("a26_transition_matrix", f"""WITH {ctes('segments')}, {STATES_SQL} SELECT rec, CAST(s1 AS INTEGER) AS s1, CAST(s2 AS INTEGER) AS s2, round(p, 6) AS p,
  round(sum(CASE WHEN s1 = s2 THEN p ELSE 0 END) OVER (PARTITION BY rec) / 10, 6) AS diagonality FROM trans""")
def a26(spark, sf):
    m = transition_matrix(segments(spark, sf), BY, ["vec_id"], "state", 10, F.col("clip_label") == 0)
    return m.select("rec", "s1", "s2", rnd("p").alias("p"), rnd("diagonality").alias("diagonality"))


@query("w18_dynamic_state_features", f"""WITH {ctes('segments')}, {STATES_SQL},
marg AS (SELECT rec, s1, avg(p) AS p FROM trans GROUP BY 1, 2),
rec_h AS (SELECT vec_id, list(state) OVER (PARTITION BY rec ORDER BY vec_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS h FROM segments),
ent AS (SELECT vec_id, -sum(p * ln(p)) AS e FROM (SELECT vec_id, s, count(*)::DOUBLE / max(n) AS p FROM (SELECT vec_id, len(h) AS n, unnest(h) AS s FROM rec_h) GROUP BY 1, 2) GROUP BY 1)
SELECT q.vec_id, round(CASE WHEN q.prev IS NULL THEN 0 ELSE -ln(greatest(t.p, 1e-8)) END, 6) + 0.0 AS surprise, round(-ln(m.p), 6) AS rarity, round(e.e, 6) + 0.0 AS state_entropy
FROM seq q LEFT JOIN trans t ON t.rec = q.rec AND t.s1 = q.prev AND t.s2 = q.state JOIN marg m ON m.rec = q.rec AND m.s1 = q.state JOIN ent e ON e.vec_id = q.vec_id""")
def w18(spark, sf):
    out = dynamic_features(segments(spark, sf), BY, ["vec_id"], "state", "embedding", 10, F.col("clip_label") == 0)
    return out.select("vec_id", rnd("surprise").alias("surprise"), rnd("rarity").alias("rarity"), rnd("state_entropy").alias("state_entropy"))


@query("w20_partition_gates", f"""WITH {ctes('clips')}, c AS (SELECT rec, day, hour, count(*) AS n FROM clips GROUP BY 1, 2, 3 HAVING count(*) >= 3)
SELECT rec, day, hour, n FROM (SELECT *, count(*) OVER (PARTITION BY day, hour) AS k FROM c) WHERE k >= 2""")
def w20(spark, sf):
    c = clips(spark, sf).groupBy("rec", "day", "hour").agg(F.count("*").alias("n")).filter("n >= 3")
    return S.gate(c, ["day", "hour"], 2, distinct="rec")


PV = "pv AS (SELECT rec, hour, round(avg(x1) / 100.0, 6) AS p FROM clips GROUP BY 1, 2)"


@query("w21_holm", f"""WITH {ctes('clips')}, {PV}, s AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY p, hour) AS rn, count(*) OVER (PARTITION BY rec) AS m FROM pv)
SELECT rec, hour, round(max(least(1.0, (m - rn + 1) * p)) OVER (PARTITION BY rec ORDER BY rn), 6) AS p_holm FROM s""")
def w21(spark, sf):
    p = clips(spark, sf).groupBy("rec", "hour").agg(F.round(F.avg("x1") / 100.0, 6).alias("p"))
    return S.holm(p, BY, "p", ["hour"]).select("rec", "hour", rnd("p_holm").alias("p_holm"))


@query("w22_benjamini_hochberg", f"""WITH {ctes('clips')}, {PV}, s AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY p, hour) AS rn, count(*) OVER (PARTITION BY rec) AS m FROM pv)
SELECT rec, hour, round(min(least(1.0, p * m / rn)) OVER (PARTITION BY rec ORDER BY rn DESC), 6) AS p_fdr FROM s""")
def w22(spark, sf):
    p = clips(spark, sf).groupBy("rec", "hour").agg(F.round(F.avg("x1") / 100.0, 6).alias("p"))
    return S.benjamini_hochberg(p, BY, "p", ["hour"]).select("rec", "hour", rnd("p_fdr").alias("p_fdr"))


@query("w23_group_centre_scale", f"""WITH {ctes('clips')}, s AS (SELECT rec, day, avg(x1) AS m, stddev_pop(x1) AS s FROM clips GROUP BY 1, 2)
SELECT clip_id, round(x1 - m, 6) + 0.0 AS centred, round((x1 - m) / (s + 1e-6), 6) + 0.0 AS scaled FROM clips c JOIN s ON s.rec = c.rec AND s.day = c.day""")
def w23(spark, sf):
    c = S.centre(clips(spark, sf), ["rec", "day"], ["x1"]).withColumnRenamed("c_x1", "centred")
    c = S.centre(c, ["rec", "day"], ["x1"], scale=True)
    return c.select("clip_id", rnd("centred").alias("centred"), rnd("c_x1").alias("scaled"))
