"""Evaluation (E rows), sampling and split (K rows) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldhush.operators import evaluate as E
from fieldhush.operators import sampling as K
from fieldhush.operators.aggregates import top_k
from fieldhush.plans.registry import query, rnd
from fieldhush.plans.views import clips, ctes, scores, segments

RATES = ["precision", "recall", "f1", "accuracy"]
PR = """round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall"""
CONF = """sum(CASE WHEN p AND lab = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN p AND lab = 0 THEN 1 ELSE 0 END)::BIGINT AS fp,
  sum(CASE WHEN NOT p AND lab = 1 THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN NOT p AND lab = 0 THEN 1 ELSE 0 END)::BIGINT AS tn"""


@query("e1_confusion", f"""WITH {ctes('scores')}, c AS (SELECT rec, {CONF} FROM (SELECT *, score >= 0.5 AS p FROM scores) GROUP BY 1)
SELECT rec, tp, fp, fn, tn, {PR}, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy FROM c""")
def e1(spark, sf):
    c = E.confusion(scores(spark, sf), ["rec"], "lab", F.col("score") >= 0.5)
    return c.select("rec", "tp", "fp", "fn", "tn", *[rnd(k).alias(k) for k in RATES])


CURVE = """h AS (SELECT rec, score, sum(lab) AS p, count(*) AS n FROM scores GROUP BY 1, 2),
curve AS (SELECT rec, score AS threshold, sum(p) OVER w / (sum(n) OVER w)::DOUBLE AS precision, sum(p) OVER w / (sum(p) OVER (PARTITION BY rec))::DOUBLE AS recall FROM h WINDOW w AS (PARTITION BY rec ORDER BY score DESC))"""


@query("e2_precision_recall_curve", f"WITH {ctes('scores')}, {CURVE} SELECT rec, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve")
def e2(spark, sf):
    c = E.pr_curve(scores(spark, sf), ["rec"], "score", "lab")
    return c.select("rec", "threshold", rnd("precision").alias("precision"), rnd("recall").alias("recall"))


@query("e3_best_threshold", f"""WITH {ctes('scores')}, {CURVE}, r AS (SELECT *, precision >= 0.02 AND recall >= 0.6 AS ok, row_number() OVER (PARTITION BY rec ORDER BY (precision >= 0.02 AND recall >= 0.02)::INTEGER DESC, round(precision + recall, 9) DESC, threshold) AS rn FROM curve)
SELECT rec, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, precision >= 0.02 AND recall >= 0.02 AS beats FROM r WHERE rn = 1""")
def e3(spark, sf):
    b = E.best_threshold(E.pr_curve(scores(spark, sf), ["rec"], "score", "lab"), ["rec"], least=0.02)
    return b.select("rec", "threshold", rnd("precision").alias("precision"), rnd("recall").alias("recall"), "beats")


STEPS = [round(0.30 + 0.05 * i, 2) for i in range(13)]


@query("e4_threshold_sweep", f"""WITH {ctes('scores')}, g AS (SELECT rec, threshold, {CONF} FROM (SELECT rec, lab, threshold, score >= threshold AS p FROM (SELECT rec, lab, score, unnest([{', '.join(f'{t}::DOUBLE' for t in STEPS)}]) AS threshold FROM scores)) GROUP BY 1, 2)
SELECT rec, threshold, tp, fp, fn, tn, {PR} FROM g""")
def e4(spark, sf):
    s = E.threshold_sweep(scores(spark, sf), ["rec"], "score", "lab", STEPS)
    return s.select("rec", "threshold", "tp", "fp", "fn", "tn", rnd("precision").alias("precision"), rnd("recall").alias("recall"))


AUC = """rk AS (SELECT rec, lab, rank() OVER (PARTITION BY rec ORDER BY score) + (count(*) OVER (PARTITION BY rec, score) - 1) / 2.0 AS r FROM scores),
auc AS (SELECT rec, sum(lab)::BIGINT AS n_pos, sum(1 - lab)::BIGINT AS n_neg, (sum(lab * r) - sum(lab) * (sum(lab) + 1) / 2.0) / (sum(lab) * sum(1 - lab)) AS auc FROM rk GROUP BY 1)"""


@query("e5_roc_auc", f"WITH {ctes('scores')}, {AUC} SELECT rec, n_pos, n_neg, round(auc, 6) AS auc FROM auc")
def e5(spark, sf):
    return E.roc_auc(scores(spark, sf), ["rec"], "score", "lab").withColumn("auc", rnd("auc"))


@query("e6_clip_vote", f"""WITH {ctes('segments')}, g AS (SELECT clip, max(clip_label) AS clip_label, avg(CASE WHEN state / 9.0 >= 0.5 THEN 1.0 ELSE 0.0 END) AS s FROM segments GROUP BY 1)
SELECT clip, clip_label, round(s, 6) AS vote_share, CASE WHEN s >= 0.5 THEN 1 ELSE 0 END AS pred FROM g""")
def e6(spark, sf):
    s = segments(spark, sf).withColumn("score", F.col("state") / 9.0)
    return E.segment_vote(s, ["clip"], "score", "clip_label", 0.5).withColumn("vote_share", rnd("vote_share"))


@query("e7_majority_lift", f"""WITH {ctes('clips')}, g AS (SELECT rec, species, count(*) AS n, sum(CASE WHEN species = CASE WHEN x2 < 30 THEN species ELSE 'view' END THEN 1 ELSE 0 END) AS hit FROM clips GROUP BY 1, 2),
r AS (SELECT rec, sum(hit) / sum(n)::DOUBLE AS a, max(n) / sum(n)::DOUBLE AS c FROM g GROUP BY 1) SELECT rec, round(a, 6) AS accuracy, round(c, 6) AS chance, round(a - c, 6) AS lift, a - c > 0.15 AS confounded FROM r""")
def e7(spark, sf):
    c = clips(spark, sf).withColumn("guess", F.when(F.col("x2") < 30, F.col("species")).otherwise("view"))
    m = E.majority_lift(c, ["rec"], "species", "guess")
    return m.select("rec", rnd("accuracy").alias("accuracy"), rnd("chance").alias("chance"), rnd("lift").alias("lift"), "confounded")


@query("e8_pass_table", f"""WITH {ctes('scores')}, c AS (SELECT rec, clip_id % 5 AS fold, {CONF} FROM (SELECT *, score >= 0.3 AS p FROM scores) GROUP BY 1, 2),
r AS (SELECT rec, avg(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)) AS p, avg(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)) AS r FROM c GROUP BY 1)
SELECT rec, round(p, 6) AS precision, round(r, 6) AS recall, p >= 0.7 AND r >= 0.7 AS passes FROM r""")
def e8(spark, sf):
    folds = E.confusion(scores(spark, sf).withColumn("fold", F.col("clip_id") % 5), ["rec", "fold"], "lab", F.col("score") >= 0.3)
    t = E.pass_table(folds, ["rec"])
    return t.select("rec", rnd("precision").alias("precision"), rnd("recall").alias("recall"), "passes")


@query("e9_outcome_split", f"""WITH {ctes('scores')} SELECT clip_id, score, CASE WHEN score >= 0.5 AND lab = 1 THEN 'TP' WHEN score >= 0.5 THEN 'FP' WHEN lab = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM scores""")
def e9(spark, sf):
    return scores(spark, sf).select("clip_id", "score", E.outcome("lab", F.col("score") >= 0.5).alias("outcome"))


MATCHED = """rk AS (SELECT *, row_number() OVER (PARTITION BY rec, day, lab ORDER BY md5('7|' || clip_id), clip_id) AS rn, sum(lab) OVER (PARTITION BY rec, day) AS np, sum(1 - lab) OVER (PARTITION BY rec, day) AS nn FROM scores),
mt AS (SELECT * FROM rk WHERE rn <= least(np, nn))"""


@query("e10_matched_verdict", f"""WITH {ctes('scores')}, {MATCHED}, a AS (SELECT rec, {CONF} FROM (SELECT *, score >= 0.2 AS p FROM scores) GROUP BY 1), b AS (SELECT rec, {CONF} FROM (SELECT *, score >= 0.2 AS p FROM mt) GROUP BY 1),
r AS (SELECT a.rec, a.tp / (a.tp + a.fp)::DOUBLE AS u, b.tp / (b.tp + b.fp)::DOUBLE AS m FROM a JOIN b ON b.rec = a.rec)
SELECT rec, round(u, 6) AS unmatched, round(m, 6) AS matched, CASE WHEN abs(m - u) < 0.05 THEN 'STABLE' WHEN m - u < -0.10 THEN 'DATE CONFOUND LIKELY' ELSE 'SLIGHT DROP' END AS verdict FROM r""")
def e10(spark, sf):
    s = scores(spark, sf)
    p = lambda d, n: E.confusion(d, ["rec"], "lab", F.col("score") >= 0.2).select("rec", F.col("precision").alias(n))
    both = p(s, "u").join(p(K.matched(s, ["rec", "day"], ["clip_id"], "lab", "7"), "m"), "rec")
    return both.select("rec", rnd("u").alias("unmatched"), rnd("m").alias("matched"), E.matched_verdict(F.col("u"), F.col("m")).alias("verdict"))


# ---- sampling --------------------------------------------------------------

@query("k1_chronological_sort", f"WITH {ctes('clips')} SELECT rec, t, clip_id FROM clips ORDER BY rec, t, clip_id")
def k1(spark, sf):
    return clips(spark, sf).select("rec", "t", "clip_id").orderBy("rec", "t", "clip_id")


@query("k2_top_rows", f"WITH {ctes('scores')} SELECT clip_id, rec, score FROM scores WHERE lab = 0 ORDER BY score DESC, clip_id LIMIT 15")
def k2(spark, sf):
    return scores(spark, sf).filter("lab = 0").select("clip_id", "rec", "score").orderBy(F.col("score").desc(), "clip_id").limit(15)


@query("k3_ratio_capped_sample", f"""WITH {ctes('clips')}, r AS (SELECT *, row_number() OVER (PARTITION BY rec, hour, lab ORDER BY md5('42|' || clip_id), clip_id) AS rn, sum(lab) OVER (PARTITION BY rec, hour) AS np FROM clips)
SELECT clip_id, rec, hour, lab FROM r WHERE np > 0 AND (lab = 1 OR rn <= 5 * np)""")
def k3(spark, sf):
    out = K.ratio_capped(clips(spark, sf).select("clip_id", "rec", "hour", "lab"), ["rec", "hour"], ["clip_id"], "lab", 5, "42")
    return out.select("clip_id", "rec", "hour", "lab")


@query("k4_matched_sample", f"WITH {ctes('scores')}, {MATCHED} SELECT clip_id, rec, day, lab FROM mt")
def k4(spark, sf):
    return K.matched(scores(spark, sf), ["rec", "day"], ["clip_id"], "lab", "7").select("clip_id", "rec", "day", "lab")


@query("k5_sample_per_step", f"""WITH {ctes('clips')}, r AS (SELECT *, row_number() OVER (PARTITION BY rec, t // 14400 ORDER BY md5('11|' || clip_id), clip_id) AS rn, count(*) OVER (PARTITION BY rec, t // 14400) AS n FROM clips)
SELECT clip_id, rec, t // 14400 AS step FROM r WHERE n >= 5 AND rn <= 4""")
def k5(spark, sf):
    from fieldhush.operators.series import gate

    c = clips(spark, sf).select("clip_id", "rec", F.expr("t div 14400").alias("step"))
    return K.first_k(gate(c, ["rec", "step"], 5), ["rec", "step"], ["clip_id"], 4, "11")


@query("k6_head_per_group", f"""WITH {ctes('clips')}, r AS (SELECT *, row_number() OVER (PARTITION BY day, hour ORDER BY md5('5|' || clip_id), clip_id) AS rn FROM clips) SELECT clip_id, day, hour FROM r WHERE rn <= 4""")
def k6(spark, sf):
    return K.first_k(clips(spark, sf).select("clip_id", "day", "hour"), ["day", "hour"], ["clip_id"], 4, "5")


@query("k8_row_cap", f"WITH {ctes('clips')} SELECT clip_id, lab FROM clips ORDER BY md5('8|' || clip_id), clip_id LIMIT 4000")
def k8(spark, sf):
    return K.row_cap(clips(spark, sf).select("clip_id", "lab"), ["clip_id"], 4000, "8")


@query("k9_stratified_folds", f"WITH {ctes('clips')} SELECT clip_id, lab, CAST((row_number() OVER (PARTITION BY lab ORDER BY md5('1|' || clip_id), clip_id) - 1) % 5 AS INTEGER) AS fold FROM clips")
def k9(spark, sf):
    return K.k_folds(clips(spark, sf).select("clip_id", "lab"), "lab", ["clip_id"], 5, "1").select("clip_id", "lab", "fold")


@query("k10_group_folds", f"""WITH {ctes('clips')}, g AS (SELECT s, CAST((row_number() OVER (ORDER BY md5('2|' || s), s) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT rec || '-' || day AS s FROM clips)) SELECT clip_id, fold FROM clips JOIN g ON g.s = rec || '-' || day""")
def k10(spark, sf):
    c = clips(spark, sf).select("clip_id", F.concat_ws("-", F.col("rec").cast("string"), F.col("day").cast("string")).alias("session"))
    return K.group_folds(c, "session", 5, "2").select("clip_id", "fold")


@query("k10_leak_check", f"""WITH {ctes('clips')}, f AS (SELECT rec, day, CAST((row_number() OVER (PARTITION BY lab ORDER BY md5('1|' || clip_id), clip_id) - 1) % 5 AS INTEGER) AS fold FROM clips)
SELECT rec || '-' || day AS session, count(DISTINCT fold) AS n_folds FROM f GROUP BY 1 HAVING count(DISTINCT fold) > 1""")
def k10b(spark, sf):
    c = clips(spark, sf).select("clip_id", "lab", F.concat_ws("-", F.col("rec").cast("string"), F.col("day").cast("string")).alias("session"))
    return K.leaks(K.k_folds(c, "lab", ["clip_id"], 5, "1"), "session", "fold")


@query("k11_usable_groups", f"""WITH {ctes('clips')} SELECT rec * 100000 + day AS session, sum(lab)::BIGINT AS n_pos, sum(1 - lab)::BIGINT AS n_neg FROM clips GROUP BY 1 HAVING sum(lab) >= 3 AND sum(1 - lab) >= 3""")
def k11(spark, sf):
    return K.usable_groups(clips(spark, sf).withColumn("session", F.col("rec") * 100000 + F.col("day")), "session", "lab")


@query("k12_few_shot_split", f"""WITH {ctes('segments')}, g AS (SELECT vec_id, rec, clip_label, unnest([0, 1, 2, 3, 4]) AS trial FROM segments), m AS (SELECT rec, count(CASE WHEN clip_label = 1 THEN 1 END) AS most FROM segments GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY rec, trial, clip_label ORDER BY md5(trial || '|' || vec_id), vec_id) AS rn FROM g)
SELECT vec_id, CAST(trial AS INTEGER) AS trial, n_shot, CASE WHEN rn <= n_shot THEN 'support' ELSE 'test' END AS role FROM (SELECT *, unnest([1, 2, 5, 10, 20, 50]) AS n_shot FROM r) x JOIN m ON m.rec = x.rec WHERE n_shot <= most""")
def k12(spark, sf):
    s = segments(spark, sf).select("vec_id", "rec", "clip_label")
    return K.support_split(s, ["rec"], "clip_label", ["vec_id"], [1, 2, 5, 10, 20, 50], 5).select("vec_id", "trial", "n_shot", "role")


@query("k13_proportional_subsample", f"""WITH {ctes('clips')}, f AS (SELECT least(1.0, 100.0 / sum(lab)) AS frac FROM clips), r AS (SELECT clip_id, day, lab, row_number() OVER (PARTITION BY day, lab ORDER BY md5('3|' || clip_id), clip_id) AS rn, count(*) OVER (PARTITION BY day, lab) AS n FROM clips)
SELECT clip_id, day, lab FROM r, f WHERE rn <= round_even(n * frac, 0)""")
def k13(spark, sf):
    return K.proportional(clips(spark, sf).select("clip_id", "day", "lab"), ["day"], "lab", ["clip_id"], 100, "3").select("clip_id", "day", "lab")


@query("k14_temporal_holdout", f"""WITH {ctes('clips')} SELECT clip_id, CASE WHEN day < 19733 THEN 'train' ELSE 'test' END AS role FROM clips WHERE day < 19733 OR day >= 19740""")
def k14(spark, sf):
    return K.date_holdout(clips(spark, sf).select("clip_id", "day"), "day", (0, 19733), (19740, 99999)).select("clip_id", "role")


@query("k15_middle_run", f"""WITH {ctes('clips')}, r AS (SELECT clip_id, rec, day, row_number() OVER (PARTITION BY rec, day ORDER BY t, clip_id) AS rn, count(*) OVER (PARTITION BY rec, day) AS n FROM clips)
SELECT clip_id, rec, day FROM r WHERE rn > greatest(n // 2 - 5, 0) AND rn <= n // 2 + 5""")
def k15(spark, sf):
    return K.middle_run(clips(spark, sf).select("clip_id", "rec", "day", "t"), ["rec", "day"], ["t", "clip_id"]).select("clip_id", "rec", "day")


@query("k16_bootstrap_resample", f"""WITH {ctes('weather')}, r AS (SELECT hour_t, temp, row_number() OVER (ORDER BY hour_t) AS rn, count(*) OVER () AS n FROM weather),
p AS (SELECT draw, ('0x' || substr(md5('9|' || draw || '|' || rn), 1, 8))::BIGINT % n + 1 AS pick FROM (SELECT rn, n, unnest(range(2000)) AS draw FROM r)),
m AS (SELECT draw, avg(temp) AS m FROM p JOIN r ON r.rn = p.pick GROUP BY 1) SELECT CAST(draw AS INTEGER) AS draw, round(m, 6) AS mean FROM m""")
def k16(spark, sf):
    from fieldhush.plans.views import weather

    w = K.bootstrap_weights(weather(spark, sf).select("hour_t", "temp"), [], ["hour_t"], 2000, "9")
    return w.groupBy("draw").agg(rnd(F.sum(F.col("temp") * F.col("weight")) / F.sum("weight")).alias("mean"))
