"""Aggregation queries (A rows) and set operations (G rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldhush.operators import aggregates as A
from fieldhush.operators import clip_vectors as V
from fieldhush.operators import evaluate as E
from fieldhush.operators.ranks import percentiles
from fieldhush.plans.registry import query, rnd
from fieldhush.plans.views import clips, ctes, scores, segments, table


@query("a1_group_summary", f"""WITH {ctes('clips')} SELECT rec, hour, count(*) AS n, round(avg(x1), 6) AS mean, round(sum(x1), 4) AS total, min(t) AS first_t FROM clips GROUP BY 1, 2""")
def a1(spark, sf):
    return clips(spark, sf).groupBy("rec", "hour").agg(F.count("*").alias("n"), rnd(F.avg("x1")).alias("mean"),
                                                      rnd(F.sum("x1"), 4).alias("total"), F.min("t").alias("first_t"))


AUDIT = "aud AS (SELECT rec, day, count(*) AS n, sum(lab)::BIGINT AS pos FROM clips GROUP BY 1, 2)"


@query("a2_session_label_audit", f"""WITH {ctes('clips')}, {AUDIT} SELECT rec, day, n, pos, n - pos AS neg, round(pos / n::DOUBLE, 6) AS pos_frac, pos > 0 AND pos < n AS both FROM aud""")
def a2(spark, sf):
    return A.label_audit(clips(spark, sf), ["rec", "day"], "lab").withColumn("pos_frac", rnd("pos_frac"))


@query("a2_top_sessions_share", f"""WITH {ctes('clips')}, {AUDIT}, r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY pos DESC, day) AS rn FROM aud)
SELECT rec, count(*) AS sessions, sum(CASE WHEN pos > 0 AND pos < n THEN 1 ELSE 0 END)::BIGINT AS with_both, round(sum(CASE WHEN rn <= 3 THEN pos ELSE 0 END) / sum(pos)::DOUBLE, 6) AS top_share FROM r GROUP BY 1""")
def a2b(spark, sf):
    audit = A.label_audit(clips(spark, sf), ["rec", "day"], "lab")
    return A.top_sessions_share(audit, ["rec"], "day").withColumn("top_share", rnd("top_share"))


@query("a3_cross_tabulation", f"""WITH {ctes('clips')} SELECT rec, """ + ", ".join(
    f"sum(CASE WHEN species = '{s}' THEN 1 ELSE 0 END)::BIGINT AS {s}" for s in ("click", "error", "purchase", "signup", "view")) + " FROM clips GROUP BY 1")
def a3(spark, sf):
    return clips(spark, sf).groupBy("rec").pivot("species", ["click", "error", "purchase", "signup", "view"]).count().fillna(0)


@query("a4_value_counts_top_k", f"""WITH {ctes('clips')}, c AS (SELECT rec, hour, count(*) AS n FROM clips GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY n DESC, hour) AS rank FROM c)
SELECT rec, hour, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def a4(spark, sf):
    return A.value_counts(clips(spark, sf), ["rec"], "hour", 5)


@query("a5_distinct_counts", f"""WITH {ctes('clips')} SELECT rec, count(DISTINCT species) AS species, count(DISTINCT x2) AS levels FROM clips GROUP BY 1""")
def a5(spark, sf):
    return clips(spark, sf).groupBy("rec").agg(F.count_distinct("species").alias("species"), F.count_distinct("x2").alias("levels"))


@query("a6_clip_embedding_statistics", f"""WITH {ctes('dims')} SELECT clip, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(max(v), 6) AS max FROM dims GROUP BY 1, 2""")
def a6(spark, sf):
    s = V.clip_statistics(segments(spark, sf), ["clip"], "embedding")
    z = F.arrays_zip("mean", "std", "max")
    return s.select("clip", F.posexplode(z).alias("dim", "z")).select("clip", "dim", *[rnd(f"z.{k}").alias(k) for k in ("mean", "std", "max")])


@query("a7_ordered_concat", f"""WITH {ctes('dims')} SELECT clip, CAST(seg_idx * 64 + dim AS INTEGER) AS i, round(v, 6) + 0.0 AS v FROM dims WHERE seg_idx < 3""")
def a7(spark, sf):
    o = V.ordered_concat(segments(spark, sf), ["clip"], "seg_idx", "embedding", 3, 64)
    return o.select("clip", F.posexplode("ordered").alias("i", "v")).withColumn("v", rnd("v"))


@query("a8_delta_features", f"""WITH {ctes('dims')}, d AS (SELECT clip, seg_idx, dim, v - lag(v) OVER (PARTITION BY clip, dim ORDER BY seg_idx) AS dv FROM dims)
SELECT clip, CAST(dim AS INTEGER) AS dim, round(avg(dv), 6) + 0.0 AS delta_mean, round(stddev_pop(dv), 6) AS delta_std, round(sum(CASE WHEN seg_idx = 1 THEN dv END), 6) + 0.0 AS delta_first,
  round(sum(CASE WHEN seg_idx = 4 THEN dv END), 6) + 0.0 AS delta_last FROM d WHERE dv IS NOT NULL GROUP BY 1, 2""")
def a8(spark, sf):
    names = ["delta_mean", "delta_std", "delta_first", "delta_last"]
    d = V.delta_statistics(segments(spark, sf), ["clip"], "seg_idx", "embedding", 64)
    return d.select("clip", F.posexplode(F.arrays_zip(*names)).alias("dim", "z")).select("clip", "dim", *[rnd(f"z.{k}").alias(k) for k in names])


@query("a16_cluster_shift", f"""WITH {ctes('segments')}, t AS (SELECT sum(1 - clip_label) AS nb, sum(clip_label) AS ns FROM segments),
c AS (SELECT state, sum(1 - clip_label)::BIGINT AS base, sum(clip_label)::BIGINT AS sim FROM segments WHERE state <> 9 GROUP BY 1)
SELECT state, base, sim, round(100.0 * base / nb, 6) AS base_pct, round(100.0 * sim / ns, 6) AS sim_pct, round(100.0 * sim / ns - 100.0 * base / nb, 6) + 0.0 AS shift FROM c, t""")
def a16(spark, sf):
    out = A.cluster_shift(segments(spark, sf), "state", "clip_label", noise=9)
    return out.select("state", "base", "sim", *[rnd(k).alias(k) for k in ("base_pct", "sim_pct", "shift")])


@query("a17_cluster_presence", f"""WITH {ctes('segments')}, c AS (SELECT rec, state, max(1 - clip_label) AS b, max(clip_label) AS s FROM segments GROUP BY 1, 2)
SELECT rec * 100 + state AS cluster, CASE WHEN s = 0 THEN 'baseline_only' WHEN b = 0 THEN 'sim_only' ELSE 'shared' END AS presence FROM c""")
def a17(spark, sf):
    s = segments(spark, sf).withColumn("cluster", F.col("rec") * 100 + F.col("state"))
    return A.cluster_presence(s, "cluster", "clip_label")


@query("a18_cluster_entropy_scatter", f"""WITH {ctes('dims', 'segments')}, k AS (SELECT clip_label, state, count(*) AS k FROM segments WHERE state <> 9 GROUP BY 1, 2),
e AS (SELECT clip_label, -sum(p * ln(p)) AS entropy, count(*) AS clusters FROM (SELECT *, k / sum(k) OVER (PARTITION BY clip_label) AS p FROM k) GROUP BY 1),
n AS (SELECT clip_label, avg(CASE WHEN state = 9 THEN 1.0 ELSE 0.0 END) AS noise_share FROM segments GROUP BY 1),
d AS (SELECT d.*, s.state FROM dims d JOIN segments s ON s.vec_id = d.vec_id WHERE s.state <> 9), m AS (SELECT clip_label, state, dim, avg(v) AS m FROM d GROUP BY 1, 2, 3),
x AS (SELECT d.clip_label, d.vec_id, sqrt(sum((d.v - m.m) * (d.v - m.m))) AS dist FROM d JOIN m ON m.clip_label = d.clip_label AND m.state = d.state AND m.dim = d.dim GROUP BY 1, 2)
SELECT n.clip_label, round(noise_share, 6) AS noise_share, round(entropy, 6) AS entropy, clusters, round((SELECT avg(dist) FROM x WHERE x.clip_label = n.clip_label), 6) AS scatter FROM n JOIN e ON e.clip_label = n.clip_label""")
def a18(spark, sf):
    out = A.cluster_summary(segments(spark, sf), ["clip_label"], "state", "embedding", noise=9)
    return out.select("clip_label", rnd("noise_share").alias("noise_share"), rnd("entropy").alias("entropy"), "clusters", rnd("scatter").alias("scatter"))


OUTCOME = "oc AS (SELECT *, CASE WHEN score >= 0.5 AND lab = 1 THEN 'TP' WHEN score >= 0.5 THEN 'FP' WHEN lab = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM scores)"


@query("a19_quantiles_per_class", f"""WITH {ctes('scores')}, {OUTCOME} SELECT outcome, count(*) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.75), 6) AS p75, round(quantile_cont(score, 0.9), 6) AS p90 FROM oc GROUP BY 1""")
def a19(spark, sf):
    o = scores(spark, sf).withColumn("outcome", E.outcome("lab", F.col("score") >= 0.5))
    at = lambda x: rnd(F.max(F.when(F.col("q") == x, F.col("score"))))
    q = percentiles(o, ["outcome"], "score", [0.75, 0.9]).groupBy("outcome").agg(at(0.75).alias("p75"), at(0.9).alias("p90"))
    return o.groupBy("outcome").agg(F.count("*").alias("n"), rnd(F.avg("score")).alias("mean")).join(q, "outcome")


@query("a20_closer_class", f"""WITH {ctes('clips')}, o AS (SELECT CASE WHEN x1 >= 20 AND lab = 1 THEN 'TP' WHEN x1 >= 20 THEN 'FP' WHEN lab = 1 THEN 'FN' ELSE 'TN' END AS outcome, x2, hour FROM clips),
l AS (SELECT 'hour' AS feature, outcome, CAST(hour AS DOUBLE) AS v FROM o UNION ALL SELECT 'x2', outcome, CAST(x2 AS DOUBLE) FROM o),
g AS (SELECT feature, avg(CASE WHEN outcome = 'FP' THEN v END) AS f, avg(CASE WHEN outcome = 'TP' THEN v END) AS s, avg(CASE WHEN outcome = 'TN' THEN v END) AS b FROM l GROUP BY 1)
SELECT feature, round(f, 6) AS fp_mean, round(s, 6) AS sim_mean, round(b, 6) AS base_mean, CASE WHEN abs(f - s) < abs(f - b) THEN 'simulation' ELSE 'baseline' END AS closer FROM g""")
def a20(spark, sf):
    o = clips(spark, sf).withColumn("outcome", E.outcome("lab", F.col("x1") >= 20))
    out = E.closer_class(o, ["x2", "hour"], "outcome")
    return out.select("feature", *[rnd(k).alias(k) for k in ("fp_mean", "sim_mean", "base_mean")], "closer")


@query("a21_alarm_rate_by_hour", f"""WITH {ctes('scores')}, g AS (SELECT rec, hour, count(*) AS baseline, sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS fa FROM scores WHERE lab = 0 GROUP BY 1, 2)
SELECT rec, hour, baseline, fa AS false_alarms, round(fa / baseline::DOUBLE, 6) AS rate, fa / baseline::DOUBLE > 0.25 AS high FROM g""")
def a21(spark, sf):
    return E.alarm_rate(scores(spark, sf), ["rec", "hour"], "lab", F.col("score") >= 0.5).withColumn("rate", rnd("rate"))


@query("a22_window_spectrum", f"""WITH {ctes('dims')}, p AS (SELECT clip, rec, vec_id, dim, v * v AS pw FROM dims), g AS (SELECT rec, vec_id // 50 AS w, dim, avg(pw) AS m, count(*) AS n FROM p GROUP BY 1, 2, 3)
SELECT rec, w * 50 AS start_v, CAST(dim AS INTEGER) AS band, n, round(10 * log10(m + 1e-15), 6) AS db FROM g WHERE n >= 5""")
def a22(spark, sf):
    s = segments(spark, sf).select("rec", "vec_id", F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("power"))
    w = s.select("rec", (F.col("vec_id") - F.col("vec_id") % 50).alias("start_v")).distinct().withColumn("end_v", F.col("start_v") + 50)
    out = V.window_spectrum(s, w, ["rec"], "vec_id", "start_v", "end_v", "power", least=5, bucket=50)
    return out.select("rec", "start_v", "band", "n", rnd("db").alias("db"))


@query("a23_variance_explained", f"""WITH {ctes('clips')}, l AS (SELECT rec, 'x1' AS feature, x1 AS v FROM clips UNION ALL SELECT rec, 'x2', CAST(x2 AS DOUBLE) FROM clips UNION ALL SELECT rec, 'hour', CAST(hour AS DOUBLE) FROM clips),
m AS (SELECT feature, rec, avg(v) AS m FROM l GROUP BY 1, 2) SELECT feature, round((SELECT var_pop(m) FROM m WHERE m.feature = l.feature) / var_pop(v), 6) AS explained FROM l GROUP BY feature""")
def a23(spark, sf):
    return A.variance_explained(clips(spark, sf), "rec", ["x1", "x2", "hour"]).select("feature", rnd("explained").alias("explained"))


@query("a24_within_between_variance", f"""WITH {ctes('clips')}, g AS (SELECT rec, avg(x1) AS m, var_pop(x1) AS v FROM clips GROUP BY 1) SELECT round(avg(v), 6) AS within, round(var_pop(m), 6) AS between, round(var_pop(m) / avg(v), 6) AS ratio FROM g""")
def a24(spark, sf):
    return A.within_between(clips(spark, sf), "rec", "x1").select(*[rnd(k).alias(k) for k in ("within", "between", "ratio")])


@query("a25_centroid_distance_change", f"""WITH {ctes('dims')}, m AS (SELECT rec, dim, avg(v) AS v FROM dims GROUP BY 1, 2), g AS (SELECT clip, dim, avg(v) AS gm FROM dims GROUP BY 1, 2),
m2 AS (SELECT d.rec, d.dim, avg(d.v * (1 + d.seg_idx)) AS v FROM dims d GROUP BY 1, 2),
b AS (SELECT a.rec AS ra, b.rec AS rb, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS x FROM m a JOIN m b ON a.dim = b.dim AND a.rec < b.rec GROUP BY 1, 2),
c AS (SELECT a.rec AS ra, b.rec AS rb, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS x FROM m2 a JOIN m2 b ON a.dim = b.dim AND a.rec < b.rec GROUP BY 1, 2)
SELECT b.ra AS rec_a, b.rb AS rec_b, round(b.x, 6) AS before, round(c.x, 6) AS after, round(100 * (c.x - b.x) / b.x, 4) AS change_pct FROM b JOIN c ON c.ra = b.ra AND c.rb = b.rb""")
def a25(spark, sf):
    s = segments(spark, sf)
    after = s.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("seg_idx"))))
    out = V.distance_change(V.site_distances(s, "rec", "embedding"), V.site_distances(after, "rec", "embedding"), "rec")
    return out.select("rec_a", "rec_b", rnd("before").alias("before"), rnd("after").alias("after"), rnd("change_pct", 4).alias("change_pct"))


@query("a28_composition_report", f"""WITH {ctes('clips')} SELECT rec, count(*) AS n, sum(CASE WHEN lab = 1 AND x2 < 90 THEN 1 ELSE 0 END)::BIGINT AS walking, sum(CASE WHEN lab = 1 AND x2 >= 90 THEN 1 ELSE 0 END)::BIGINT AS played, round(100.0 * avg(lab), 6) AS pos_pct FROM clips GROUP BY 1""")
def a28(spark, sf):
    sim = F.col("lab") == 1
    return clips(spark, sf).groupBy("rec").agg(F.count("*").alias("n"), F.count_if(sim & (F.col("x2") < 90)).alias("walking"),
                                              F.count_if(sim & (F.col("x2") >= 90)).alias("played"), rnd(100.0 * F.avg("lab")).alias("pos_pct"))


@query("a29_recall_by_type", f"""WITH {ctes('clips')} SELECT CASE WHEN x2 < 90 THEN 'presence' ELSE 'sound' END AS kind, count(*) AS total, sum(CASE WHEN x1 >= 20 THEN 1 ELSE 0 END)::BIGINT AS found,
  round(avg(CASE WHEN x1 >= 20 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM clips WHERE lab = 1 GROUP BY 1""")
def a29(spark, sf):
    s = clips(spark, sf).filter("lab = 1")
    hit = F.col("x1") >= 20
    return s.groupBy(F.when(F.col("x2") < 90, "presence").otherwise("sound").alias("kind")).agg(
        F.count("*").alias("total"), F.count_if(hit).alias("found"), rnd(F.avg(hit.cast("double"))).alias("recall"))


# ---- set operations --------------------------------------------------------

@query("g1_union_all", """SELECT 'orders' AS part, o_orderstatus AS flag, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'lines', l_linestatus, count(*) FROM lineitem GROUP BY 2""")
def g1(spark, sf):
    o = table(spark, sf, "orders").select(F.lit("orders").alias("part"), F.col("o_orderstatus").alias("flag"))
    li = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("flag"), F.lit("lines").alias("part"))
    return o.unionByName(li).groupBy("part", "flag").agg(F.count("*").alias("n"))


@query("g2_distinct_by_key", f"""WITH {ctes('clips')} SELECT rec, day, min(clip_id) AS clip_id FROM clips GROUP BY 1, 2""")
def g2(spark, sf):
    from fieldhush.sources.tables import first_by_key

    return first_by_key(clips(spark, sf).select("rec", "day", "clip_id"), ["rec", "day"], ["clip_id"])


@query("g3_set_difference", f"""WITH {ctes('clips')}, s AS (SELECT DISTINCT x2 FROM clips WHERE lab = 1 AND x1 > 60), b AS (SELECT DISTINCT x2 FROM clips WHERE lab = 0 AND x1 > 150)
SELECT 'baseline_only' AS part, x2 FROM (SELECT x2 FROM b EXCEPT SELECT x2 FROM s) UNION ALL SELECT 'sim_only', x2 FROM (SELECT x2 FROM s EXCEPT SELECT x2 FROM b) UNION ALL SELECT 'shared', x2 FROM (SELECT x2 FROM s INTERSECT SELECT x2 FROM b)""")
def g3(spark, sf):
    c = clips(spark, sf)
    s, b = c.filter("lab = 1 and x1 > 60").select("x2"), c.filter("lab = 0 and x1 > 150").select("x2")
    named = lambda d, n: d.select(F.lit(n).alias("part"), "x2")
    return named(b.subtract(s), "baseline_only").unionByName(named(s.subtract(b), "sim_only")).unionByName(named(s.intersect(b), "shared"))


@query("g4_species_union", f"""WITH {ctes('clips')} SELECT rec, day, array_to_string(list_sort(list(DISTINCT species)), ';') AS species FROM clips WHERE x1 > 40 GROUP BY 1, 2""")
def g4(spark, sf):
    # Distinct first, so the set a group collects is its vocabulary and not its rows.
    d = clips(spark, sf).filter("x1 > 40").select("rec", "day", "species").distinct()
    return d.groupBy("rec", "day").agg(F.array_join(F.array_sort(F.collect_list("species")), ";").alias("species"))


@query("g5_jaccard_top_features", f"""WITH {ctes('clips')}, c AS (SELECT rec, x2, count(*) AS n FROM clips GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY n DESC, x2) AS rn FROM c), t AS (SELECT rec, x2 FROM r WHERE rn <= 10)
SELECT a.rec AS rec_a, b.rec AS rec_b, round(len(list_intersect(a.s, b.s)) / (20.0 - len(list_intersect(a.s, b.s))), 6) AS jaccard FROM (SELECT rec, list(x2) AS s FROM t GROUP BY 1) a JOIN (SELECT rec, list(x2) AS s FROM t GROUP BY 1) b ON a.rec < b.rec""")
def g5(spark, sf):
    from fieldhush.operators.intervals import pairs

    top = A.value_counts(clips(spark, sf), ["rec"], "x2", 10).groupBy("rec").agg(F.collect_set("x2").alias("s"))
    both = pairs(top, "rec", "s")
    share = F.size(F.array_intersect("vec_a", "vec_b")) / F.size(F.array_union("vec_a", "vec_b"))
    return both.select("rec_a", "rec_b", rnd(share).alias("jaccard"))
