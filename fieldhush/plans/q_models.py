"""Machine-learning queries (M rows) over the segment vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldhush.functions.vectors import group_vectors
from fieldhush.operators import evaluate as E
from fieldhush.operators import heldout as H
from fieldhush.operators import models as M
from fieldhush.operators import sampling as K
from fieldhush.operators import series as S
from fieldhush.operators import stats as T
from fieldhush.plans.registry import query, rnd
from fieldhush.plans.views import clips, ctes, segments
from fieldhush.sources.scratch import materialize, sized

SITES = [0, 1, 2, 3, 4]
WIDTH = 64


def rows(spark, sf):
    """Segments with a feature vector, a label, a session (clip block) and a group-safe fold."""
    s = segments(spark, sf).withColumn("session", F.expr("clip div 20"))
    s = K.group_folds(s, "clip", 3, "2")
    return materialize(M.with_vector(s, "embedding"), "rows")


def lr(train):
    return M.fit_pipeline(train, "clip_label", M.logistic(), pca=20)


def summary(scored, by):
    """AUC and the rates at the best threshold."""
    auc = E.roc_auc(scored, by, "score", "clip_label")
    best = E.best_threshold(E.pr_curve(scored, by, "score", "clip_label"), by)
    out = auc.join(best, by) if by else auc.crossJoin(F.broadcast(best))
    return out.select(*by, "n_pos", "n_neg", *[rnd(k, 4).alias(k) for k in ("auc", "threshold", "precision", "recall")], "beats")


@query("m1_standardize_pca")
def m1(spark, sf):
    from pyspark.ml.functions import vector_to_array

    r = rows(spark, sf)
    m = M.fit_pipeline(r.filter("fold <> 0"), "clip_label", M.logistic(maxIter=1), pca=20)
    held_out = m.transform(r.filter("fold = 0"))
    return held_out.select("vec_id", F.posexplode(vector_to_array("__ready")).alias("pc", "v")).groupBy("pc").agg(F.count("*").alias("n"), rnd(F.stddev_pop("v"), 4).alias("std"))


@query("m2_balanced_logistic")
def m2(spark, sf):
    return summary(M.cross_validate(rows(spark, sf), "fold", range(3), lr), [])


@query("m3_weighted_boosting")
def m3(spark, sf):
    fit = lambda t: M.fit_pipeline(t, "clip_label", M.boosting(), pca=20)
    return summary(M.cross_validate(rows(spark, sf), "fold", range(3), fit), [])


@query("m4_site_probe_importances")
def m4(spark, sf):
    names = [f"e{i}" for i in range(WIDTH)]
    r = rows(spark, sf)
    imp = materialize(M.importances(r, "rec", names, 100), "importances")
    left = M.drop_features(r, "embedding", imp, names, 10, "kept")
    width = left.agg(F.max(F.size("kept")).alias("w"))
    return imp.crossJoin(F.broadcast(width)).select("feature", rnd("importance").alias("importance"), "w")


@query("m5_perceptron")
def m5(spark, sf):
    fit = lambda t: M.fit_pipeline(t, "clip_label", M.perceptron(WIDTH), balanced=False)
    return summary(M.cross_validate(rows(spark, sf), "fold", range(3), fit), [])


@query("m6_mixture_states")
def m6(spark, sf):
    s = M.mixture_states(rows(spark, sf).drop("state"), F.col("clip_label") == 0)
    return s.groupBy("state", "clip_label").agg(F.count("*").alias("n"))


@query("m7_cluster_tokens")
def m7(spark, sf):
    t = M.cluster_tokens(rows(spark, sf), 6, 8)
    return t.groupBy("token").agg(F.count("*").alias("n"), F.sum("clip_label").alias("n_sim"), rnd(F.avg("distance"), 4).alias("spread"))


@query("m8_autoregressive_surprise")
def m8(spark, sf):
    """Five previous vectors predict the next; the error is ranked against the last 40 errors."""
    s = segments(spark, sf).withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    ctx = S.lag_context(s.select("vec_id", "rec", "clip_label", "v"), ["rec"], ["vec_id"], "v", 5)
    ctx = materialize(ctx, "context")
    e = M.autoregressive_error(ctx, "context", "v", F.col("clip_label") == 0)
    p = S.rolling_percentile(e.select("vec_id", "rec", "ar_error"), ["rec"], ["vec_id"], "ar_error")
    return p.select("vec_id", rnd("ar_error").alias("ar_error"), rnd("pct", 4).alias("pct"))


COS = "sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)))"


@query("m9_prototype_classifier", f"""WITH {ctes('dims')}, m AS (SELECT rec, clip_label, dim, avg(v) AS v FROM dims WHERE seg_idx < 2 GROUP BY 1, 2, 3),
c AS (SELECT a.rec, a.vec_id, b.clip_label AS k, {COS} AS c FROM dims a JOIN m b ON b.rec = a.rec AND b.dim = a.dim WHERE a.seg_idx >= 2 GROUP BY 1, 2, 3),
s AS (SELECT rec, vec_id, max(CASE WHEN k = 1 THEN c END) - max(CASE WHEN k = 0 THEN c END) AS s FROM c GROUP BY 1, 2)
SELECT vec_id, round((s - min(s) OVER (PARTITION BY rec)) / (max(s) OVER (PARTITION BY rec) - min(s) OVER (PARTITION BY rec) + 1e-10), 5) + 0.0 AS score FROM s""")
def m9(spark, sf):
    s = segments(spark, sf)
    out = M.prototype_scores(s.filter("seg_idx < 2"), s.filter("seg_idx >= 2"), ["rec"], "clip_label", "embedding")
    return out.select("vec_id", rnd("score", 5).alias("score"))


@query("m10_logistic_calibration")
def m10(spark, sf):
    s = segments(spark, sf).select("vec_id", "rec", "clip_label", (F.col("state") / 9.0 + F.col("embedding")[0].cast("double")).alias("raw"))
    support, test = s.filter("vec_id % 10 < 3"), s.filter("vec_id % 10 >= 3")
    c = M.calibrate(support, test, "clip_label", "raw")
    return c.select("vec_id", rnd("raw").alias("raw"), rnd("calibrated", 4).alias("calibrated"))


@query("m11_local_head")
def m11(spark, sf):
    """Heads fitted on the support rows of each site only: logistic ones of all sites at once, and boosting with 50 trees."""
    r = rows(spark, sf)
    support, test = r.filter("vec_id % 10 < 4"), r.filter("vec_id % 10 >= 4")
    cols = lambda d, head: d.select("rec", "clip_label", "score", F.lit(head).alias("head"))
    out = cols(H.held_out_scores(test, H.fit_groups(support, "rec", "clip_label", "embedding", only=True), "rec", "embedding"), "logistic")
    for site in SITES:
        here = F.col("rec") == site
        out = out.unionByName(cols(M.score(M.fit_pipeline(support.filter(here), "clip_label", M.boosting(50, 2)), test.filter(here)), "boosting"))
    return E.roc_auc(out, ["rec", "head"], "score", "clip_label").withColumn("auc", rnd("auc", 4))


@query("m12_site_experts")
def m12(spark, sf):
    """Every site is a target once: its rows by the models of all other sites, on the scale of its own baseline, weighted by similarity."""
    r = rows(spark, sf)
    experts = H.fit_groups(r, "rec", "clip_label", "embedding", pca=20, only=True)
    s = H.all_scores(r.select("vec_id", "rec", "clip_label", "embedding"), experts, "rec", "embedding", "expert").filter("expert <> rec").drop("embedding")
    c = M.rank_calibrate(materialize(s, "expert-scores"), ["rec", "expert"], ["vec_id"], "score", F.col("clip_label") == 0)
    w = M.similarity_weights(r, "rec", "embedding", F.col("clip_label") == 0).select(F.col("target").alias("rec"), "expert", "weight")
    out = M.combine_experts(c.join(sized(w), ["rec", "expert"]), ["rec", "vec_id", "clip_label"], "percentile", "weight")
    return out.select("rec", "vec_id", *[rnd(k, 4).alias(k) for k in ("mean", "weighted", "median", "consensus")])


@query("m13_rank_calibration", f"""WITH {ctes('scores')}, b AS (SELECT rec, list(score) AS ref FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY t, clip_id) AS rn FROM scores WHERE lab = 0) WHERE rn <= 40 GROUP BY 1)
SELECT clip_id, round(len([q FOR q IN ref IF q < score]) / len(ref)::DOUBLE, 6) AS percentile FROM scores s JOIN b ON b.rec = s.rec""")
def m13(spark, sf):
    from fieldhush.plans.views import scores

    out = M.rank_calibrate(scores(spark, sf).select("clip_id", "rec", "t", "lab", "score"), ["rec"], ["t", "clip_id"], "score", F.col("lab") == 0)
    return out.select("clip_id", rnd("percentile").alias("percentile"))


@query("m14_site_similarity_weights", f"""WITH {ctes('dims')}, m AS (SELECT rec, dim, avg(v) AS v FROM dims WHERE clip_label = 0 GROUP BY 1, 2), c AS (SELECT a.rec AS target, b.rec AS expert, greatest({COS}, 0) AS w FROM m a JOIN m b ON a.dim = b.dim AND a.rec <> b.rec GROUP BY 1, 2)
SELECT target, expert, round(CASE WHEN sum(w) OVER (PARTITION BY target) > 0 THEN w / sum(w) OVER (PARTITION BY target) ELSE 1.0 / count(*) OVER (PARTITION BY target) END, 5) AS weight FROM c""")
def m14(spark, sf):
    return M.similarity_weights(segments(spark, sf), "rec", "embedding", F.col("clip_label") == 0).withColumn("weight", rnd("weight", 5))


@query("m15_expert_combination", f"""WITH {ctes('clips')}, x AS (SELECT clip_id, unnest([1, 2, 3, 4, 5]) AS expert, x2 FROM clips), s AS (SELECT clip_id, expert, (x2 * expert % 97) / 97.0 AS p FROM x)
SELECT clip_id, round(avg(p), 6) AS mean, round(sum(p * expert) / sum(expert), 6) AS weighted, round(median(p), 6) AS median, round(avg(CASE WHEN p > 0.7 THEN 1.0 ELSE 0.0 END), 6) AS consensus FROM s GROUP BY 1""")
def m15(spark, sf):
    s = clips(spark, sf).select("clip_id", "x2", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("expert"))
    s = s.withColumn("p", (F.col("x2") * F.col("expert") % 97) / 97.0)
    return M.combine_experts(s, ["clip_id"], "p", "expert").select("clip_id", *[rnd(k).alias(k) for k in ("mean", "weighted", "median", "consensus")])


PCT = "CASE WHEN coalesce(len({h}), 0) >= 2 THEN len([q FOR q IN {h} IF q < {x}]) / len({h})::DOUBLE ELSE 0.5 END"


@query("m16_unsupervised_fusion", f"""WITH {ctes('clips')}, h AS (SELECT clip_id, x1, x2, hour * x2 AS x3, list(x1) OVER w AS h1, list(x2) OVER w AS h2, list(hour * x2) OVER w AS h3 FROM clips WINDOW w AS (PARTITION BY rec ORDER BY t, clip_id ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)),
p AS (SELECT clip_id, {PCT.format(h='h1', x='x1')} AS a, {PCT.format(h='h2', x='x2')} AS b, {PCT.format(h='h3', x='x3')} AS c FROM h)
SELECT clip_id, round(greatest(a, c), 7) AS s4_max, round((a + c) / 2, 7) AS s5_mean, round((a + b + c) / 3, 7) AS s6_mean3, round(a * c, 7) AS s7_product, round(greatest(a, b, c), 7) AS s8_max3 FROM p""")
def m16(spark, sf):
    from fieldhush.operators.blocks import ordered

    c = clips(spark, sf).select("clip_id", "rec", "t", "x1", "x2", (F.col("hour") * F.col("x2")).alias("x3"))
    o = ordered(c, ["rec"], ["t", "clip_id"], before=40)
    d = o.df
    for i in (1, 2, 3):
        d = S.rolling_percentile_on(o, d, f"x{i}", 40, f"p{i}")
    out = M.fuse(o.home(d), "p1", "p2", "p3")
    return out.select("clip_id", *[rnd(k, 7).alias(k) for k in ("s4_max", "s5_mean", "s6_mean3", "s7_product", "s8_max3")])


@query("m17_isolation_forest")
def m17(spark, sf):
    s = segments(spark, sf)
    out = M.isolation_forest(s, "embedding", F.col("clip_label") == 0, ["vec_id"])
    return out.select("vec_id", rnd("isolation", 5).alias("isolation"))


@query("m18_reconstruction_error")
def m18(spark, sf):
    out = M.reconstruction_error(segments(spark, sf), "embedding", F.col("clip_label") == 0, 8)
    return out.select("vec_id", rnd("recon_error", 5).alias("recon_error"))


@query("m19_corrected_cross_validation")
def m19(spark, sf):
    """Clip-level folds, in-fold hourly z of two clip features, then a balanced logistic model."""
    from pyspark.ml.feature import VectorAssembler

    c = clips(spark, sf).select("clip_id", "rec", "hour", "x1", F.col("x2").cast("double").alias("x2"), F.col("lab").alias("clip_label"))
    c = materialize(K.k_folds(c, "clip_label", ["clip_id"], 5, "1"), "folds")
    join = VectorAssembler(inputCols=["x1", "x2", "z_x1", "z_x2"], outputCol="features")

    def prepare(train, test):
        z = lambda d: join.transform(S.baseline_z(d, ["hour"], ["x1", "x2"], F.col("clip_label") == 0, train))
        return z(train), z(test)

    fit = lambda t: M.fit_pipeline(t, "clip_label", M.logistic())
    return summary(M.cross_validate(c, "fold", range(5), fit, prepare), ["rec"])


def held_out(r, group, features="embedding", **options):
    """Rows scored by a logistic model of all other groups."""
    return H.held_out_scores(r, H.fit_groups(r, group, "clip_label", features, **options), group, features)


@query("m20_leave_one_site_out")
def m20(spark, sf):
    return summary(held_out(rows(spark, sf), "rec", pca=20), ["rec"])


def clip_features(spark, sf):
    """Clips with their levels, the clock and the hour's baseline z of the same recorder."""
    c = clips(spark, sf).select("clip_id", "rec", "day", "hour", "x1", F.col("x2").cast("double").alias("x2"), F.col("lab").alias("clip_label"))
    z = S.baseline_z(c, ["rec", "hour"], ["x1", "x2"], F.col("clip_label") == 0, c)
    turn = F.col("hour") * (3.141592653589793 / 12)
    return z.withColumn("features", F.array("x1", "x2", "z_x1", "z_x2", F.sin(turn), F.cos(turn)))


@query("m20_leave_one_session_out")
def m20_session(spark, sf):
    """Every recorder-day with 3 clips of each class: scored by a model of all other days, with its own AUC and rates at 0.5."""
    c = clip_features(spark, sf).withColumn("session", F.concat_ws("|", F.concat(F.lit("AM"), F.col("rec") + 1), F.col("day")))
    c = materialize(c, "session-clips")
    usable = H.usable_groups(c, "session", "clip_label", 3).select("session")
    s = materialize(held_out(c, "session", "features").join(usable, "session"), "session-scores")
    auc = E.roc_auc(s, ["rec", "session"], "score", "clip_label")
    hit = F.col("score") >= 0.5
    g = s.groupBy("session").agg(F.count_if(hit).alias("called"), F.count_if(hit & (F.col("clip_label") == 1)).alias("right"))
    out = auc.join(g, "session")
    precision, recall = F.coalesce(F.try_divide("right", "called"), F.lit(0.0)), F.col("right") / F.col("n_pos")
    f1 = F.coalesce(F.try_divide(2 * F.col("right"), F.col("called") + F.col("n_pos")), F.lit(0.0))
    return out.select("rec", "session", "n_pos", "n_neg", *[rnd(c, 4).alias(n) for n, c in (("auc", F.col("auc")), ("precision", precision), ("recall", recall), ("f1", f1))])


@query("m20_leave_one_visit_out")
def m20b(spark, sf):
    """Held-out visits: mean log-odds of each time step minus the median over the visit's placebo windows."""
    s = held_out(rows(spark, sf).withColumn("visit", F.expr("clip div 25")), "visit", pca=20)
    odds = F.log(F.greatest("score", F.lit(1e-9)) / F.greatest(1 - F.col("score"), F.lit(1e-9)))
    w = s.groupBy("visit", "clip", "seg_idx").agg(F.avg(odds).alias("odds"))
    w = w.withColumn("kind", F.when(F.col("clip") % 25 == 0, "visit").otherwise("placebo"))
    d = T.matched_difference(w, ["visit", "seg_idx"], "kind", ["odds"])
    return d.select("visit", "seg_idx", rnd("d_odds", 4).alias("contrast"))


RAW = 16  # the first dimensions stand for measured features, the others for the embedding


def feature_blocks(spark, sf):
    """raw, its z against the recorder's baseline at the same place in the clip, emb, and the change since the segment before."""
    r = rows(spark, sf)
    base = group_vectors(r.filter("clip_label = 0").withColumn("raw", F.slice("embedding", 1, RAW)), ["rec", "seg_idx"], "raw", {"m": "mean", "s": "std"})
    before = r.select("clip", (F.col("seg_idx") + 1).alias("seg_idx"), F.col("embedding").alias("was"))
    r = r.join(sized(base), ["rec", "seg_idx"], "left").join(before, ["clip", "seg_idx"], "left")
    r = r.withColumn("raw", F.slice("embedding", 1, RAW)).withColumn("emb", F.slice("embedding", RAW + 1, WIDTH - RAW))
    z = F.zip_with(F.zip_with("raw", "m", lambda x, m: x - m), "s", lambda x, s: x / F.greatest(s, F.lit(1e-6)))
    r = r.withColumn("z", F.coalesce(z, F.transform("raw", lambda x: F.lit(0.0))))
    delta = F.zip_with("embedding", F.coalesce("was", "embedding"), lambda x, y: (x - y).cast("double"))
    return materialize(r.withColumn("delta", delta).drop("m", "s", "was", "features"), "blocks")


def grid(r, sets, cross):
    """AUC of each feature set: (features, columns, number of them kept as they are, components of the rest)."""
    out = None
    for name, columns, plain, pca in sets:
        f = r.withColumn("x", F.concat(*[F.transform(c, lambda v: v.cast("double")) for c in columns]))
        for test, group in cross.items():
            part = held_out(f, group, "x", plain=plain, pca=pca).select("rec", "clip_label", "score", F.lit(name).alias("features"), F.lit(test).alias("test"))
            out = part if out is None else out.unionByName(part)
    return out


@query("m21_feature_ablation")
def m21(spark, sf):
    """AUC by site of five feature sets, within sites (grouped folds) and across sites."""
    sets = [("A_z", ["z"], 0, None), ("B_raw", ["raw"], 0, None), ("C_emb", ["emb"], 0, 20), ("D_z_emb", ["z", "emb"], RAW, 20), ("E_all", ["z", "raw", "emb"], 2 * RAW, 20)]
    out = grid(feature_blocks(spark, sf), sets, {"within": "fold", "across": "rec"})
    return E.roc_auc(out, ["features", "test", "rec"], "score", "clip_label").withColumn("auc", rnd("auc", 4))


@query("m21_generalisation_strategies")
def m21_strategies(spark, sf):
    """Five ways to carry a model to a site it has not seen; S3 leaves out the 10 measured features that tell sites apart best."""
    r = feature_blocks(spark, sf)
    names = [f"e{i}" for i in range(RAW)]
    told = M.importances(M.with_vector(r, "raw"), "rec", names, 100)
    r = materialize(M.drop_features(r, "raw", told, names, 10, "shared"), "strategies")
    sets = [("S0_baseline", ["raw", "z", "emb"], 2 * RAW, 50), ("S1_no_zscores", ["raw", "emb"], RAW, 50), ("S2_delta_only", ["delta"], 0, 40),
            ("S3_adversarial", ["shared", "emb"], RAW - 10, 50), ("S4_no_z_plus_delta", ["raw", "delta", "emb"], RAW, 50)]
    return summary(grid(r, sets, {"across": "rec"}), ["features", "rec"])


@query("m22_class_ratio_grid")
def m22(spark, sf):
    out = None
    ratios = (1, 2, 3, 5)
    base = clip_features(spark, sf).select("clip_id", "rec", "hour", "clip_label", "features")
    every = materialize(K.ratio_steps(base, ["rec", "hour"], ["clip_id"], "clip_label", ratios, "42"), "ratio-clips")
    for i, ratio in enumerate(ratios):
        s = every.filter(F.col("from_ratio") <= i).drop("from_ratio")
        s = materialize(K.k_folds(s, "clip_label", ["clip_id"], 5, "1"), "ratio")
        part = held_out(s, "fold", "features").withColumn("ratio", F.lit(ratio))
        out = part if out is None else out.unionByName(part)
    return summary(out, ["ratio"])


@query("m23_transfer_matrix")
def m23(spark, sf):
    """AUC of each site's model at each site; a site's own is by three folds of whole clips."""
    r = rows(spark, sf)
    away = H.all_scores(r, H.fit_groups(r, "rec", "clip_label", "embedding", pca=20, only=True), "rec", "embedding", "train_site").filter("train_site <> rec")
    out = away.select("train_site", "rec", "score", "clip_label")
    for site in SITES:
        own = held_out(r.filter(F.col("rec") == site), "fold", pca=20)
        out = out.unionByName(own.select(F.col("rec").alias("train_site"), "rec", "score", "clip_label"))
    m = E.roc_auc(out, ["train_site", "rec"], "score", "clip_label")
    return m.select("train_site", F.col("rec").alias("test_site"), rnd("auc", 4).alias("auc"))


STRONG = [1, 4]  # the sites whose own models are good


@query("m23_strong_teacher")
def m23_teacher(spark, sf):
    """Each site scored by a model of all other sites and by one of the strong sites other than itself."""
    r = rows(spark, sf)
    every = held_out(r, "rec", pca=20).withColumn("teacher", F.lit("all"))
    strong = r.filter(F.col("rec").isin(STRONG))
    weak = r.filter(~F.col("rec").isin(STRONG)).withColumn("team", F.lit(1))
    team = H.fit_groups(strong.withColumn("team", F.lit(1)), "team", "clip_label", "embedding", pca=20, only=True)
    taught = held_out(strong, "rec", pca=20).unionByName(H.held_out_scores(weak, team, "team", "embedding").drop("team")).withColumn("teacher", F.lit("strong"))
    return E.roc_auc(every.unionByName(taught), ["rec", "teacher"], "score", "clip_label").withColumn("auc", rnd("auc", 4))


@query("m24_identity_probe")
def m24(spark, sf):
    r = rows(spark, sf)
    out = None
    for target in ("rec", "session"):
        for name, clf in (("linear", M.logistic()), ("forest", M.forest(100))):
            part = M.probe(r, target, "fold", range(3), clf).select("truth", "guess", F.lit(target).alias("identity"), F.lit(name).alias("probe"))
            out = part if out is None else out.unionByName(part)
    m = E.majority_lift(out, ["identity", "probe"], "truth", "guess")
    return m.select("identity", "probe", *[rnd(k, 4).alias(k) for k in ("accuracy", "chance", "lift")], "confounded")


@query("m25_permutation_importance")
def m25(spark, sf):
    """AUC drop of all features in every session with 5 rows of each class, 5 repeats: rank correlation and top-10 overlap of every two sessions."""
    r = rows(spark, sf)
    model = H.fit_groups(r.withColumn("all", F.lit(1)), "all", "clip_label", "embedding", only=True)
    usable = H.usable_groups(r, "session", "clip_label", 5).select("session")
    d = materialize(M.permutation_importance(r.join(sized(usable), "session"), "session", ["vec_id"], "embedding", "clip_label", model), "importance")
    order = F.struct((-F.col("drop")).alias("k"), "feature")
    top = d.groupBy("session").agg(F.transform(F.slice(F.array_sort(F.collect_list(order)), 1, 10), lambda x: x["feature"]).alias("top"))
    rho = T.spearman_pairs(d, "session", "feature", "drop")
    ta, tb = (top.select(F.col("session").alias(f"session_{k}"), F.col("top").alias(f"top_{k}")) for k in "ab")
    shared = F.size(F.array_intersect("top_a", "top_b")) / F.size(F.array_union("top_a", "top_b"))
    out = rho.join(sized(ta), "session_a").join(sized(tb), "session_b")
    return out.select("session_a", "session_b", "n", rnd("rho", 4).alias("rho"), rnd(shared, 4).alias("jaccard_top10"))


@query("m26_coral_alignment")
def m26(spark, sf):
    """Every site aligned to every other one."""
    a = M.coral_pairs(segments(spark, sf).select("vec_id", "rec", "embedding"), "rec", SITES, "embedding")
    return a.select("rec", "target", "vec_id", F.posexplode("aligned").alias("dim", "v")).groupBy("rec", "target", "dim").agg(F.count("*").alias("n"), rnd(F.avg("v"), 4).alias("mean"), rnd(F.stddev_samp("v"), 4).alias("std"))


@query("m27_coefficient_report")
def m27(spark, sf):
    m = M.fit_pipeline(rows(spark, sf), "clip_label", M.logistic())
    return M.coefficients(m, spark, 20).withColumn("coefficient", rnd("coefficient", 5))


RECIPES = [(0, 5, 3, 0.4), (1, 3, 2, 0.5), (2, 10, 6, 0.4), (3, 5, 4, 0.5), (4, 10, 7, 0.3), (5, 15, 9, 0.4)]


@query("m28_recorder_recipes", f"""WITH {ctes('scores')}, v AS (SELECT rec, lab, CASE rec """ + " ".join(
    f"WHEN {r} THEN CASE WHEN sum(CASE WHEN score >= {th} THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY t, clip_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {k} THEN 1 ELSE 0 END" for r, n, k, th in RECIPES) + """ END AS alert FROM scores)
SELECT rec, sum(alert)::BIGINT AS alerts, sum(alert * lab)::BIGINT AS hits FROM v GROUP BY 1""")
def m28(spark, sf):
    """Each recorder has its own threshold and vote; one pass over the rows serves all of them."""
    from fieldhush.operators.blocks import ordered
    from fieldhush.plans.views import scores

    s = scores(spark, sf).select("clip_id", "rec", "t", "lab", "score")
    o = ordered(s, ["rec"], ["t", "clip_id"], before=15)
    pick = lambda f: F.coalesce(*[F.when(F.col("rec") == r[0], f(r)) for r in RECIPES])
    d = o.df.withColumn("flag", (F.col("score") >= pick(lambda r: F.lit(r[3]))).cast("int"))
    d = d.withColumn("alert", pick(lambda r: (F.sum("flag").over(o.window.rowsBetween(-(r[1] - 1), 0)) >= r[2]).cast("int")))
    return o.home(d).groupBy("rec").agg(F.sum("alert").alias("alerts"), F.sum(F.col("alert") * F.col("lab")).alias("hits"))
