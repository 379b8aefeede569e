"""Projections, filters and scalar functions (P rows of the survey)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fieldhush.functions import parse as P
from fieldhush.functions.features import FeatureSet, select_features
from fieldhush.operators.quality import baseline_percentile_filter, min_max_score, remap_ids
from fieldhush.plans.registry import query, rnd
from fieldhush.plans.views import clips, ctes, raw, segments

# SQL forms shared by several queries over the text columns.
SQL_LIST = """CASE WHEN {0} IS NULL OR trim({0}) IN ('', 'nan', 'None') THEN CAST([] AS VARCHAR[])
  WHEN {0} LIKE '[%' THEN CASE WHEN {0} IN ('[]', '[bad]') THEN CAST([] AS VARCHAR[]) ELSE [trim(q, ' ''') FOR q IN string_split(trim({0}, '[]'), ',')] END
  ELSE [{0}] END"""
SP, CF = SQL_LIST.format("species"), SQL_LIST.format("confidence")
PAIRED = f"""pairs AS (SELECT clip_id, "Recorder", stamp, sim_type, sp,
    CASE WHEN len(cf) = 1 AND len(sp) > 1 THEN [cf[1] FOR q IN sp] ELSE cf END AS cf
  FROM (SELECT *, {SP} AS sp, {CF} AS cf FROM raw))"""


@query("p1_parse_clip_name", f"""WITH {ctes('raw')}
SELECT clip_id, 'AM' || regexp_extract(clip_name, 'Moth_(\\d+)_', 1) AS rec, regexp_extract(clip_name, '(\\d{{8}})_\\d{{6}}', 1) AS day,
  CAST(epoch(strptime(regexp_extract(clip_name, '(\\d{{8}}_\\d{{6}})', 1), '%Y%m%d_%H%M%S')) AS BIGINT) AS t FROM raw""")
def p1(spark, sf):
    return raw(spark, sf).select("clip_id", P.recorder_of("clip_name").alias("rec"), P.day_of("clip_name").alias("day"),
                                 P.seconds_of("clip_name").alias("t"))


@query("p2_parse_list", f"""WITH {ctes('raw')} SELECT clip_id, array_to_string({SP}, ';') AS species, len({SP}) AS n FROM raw""")
def p2(spark, sf):
    items = P.parse_list("species")
    return raw(spark, sf).select("clip_id", F.array_join(items, ";").alias("species"), F.size(items).cast("long").alias("n"))


@query("p3_first_relative_time", f"""WITH {ctes('raw')}
SELECT clip_id, coalesce(TRY_CAST(trim(string_split(trim(sim_rel, '[]'), ',')[1]) AS DOUBLE), 0.0) AS rel FROM raw""")
def p3(spark, sf):
    return raw(spark, sf).select("clip_id", P.first_relative("sim_rel").alias("rel"))


@query("p4_is_simulation", f"""WITH {ctes('raw')} SELECT "Recorder" AS recorder, sum(CASE WHEN trim(sim_type) <> '[]' THEN 1 ELSE 0 END)::BIGINT AS n_sim, count(*) AS n FROM raw GROUP BY 1""")
def p4(spark, sf):
    return raw(spark, sf).groupBy(F.col("Recorder").alias("recorder")).agg(
        F.count_if(P.is_simulation("sim_type")).alias("n_sim"), F.count("*").alias("n"))


@query("p5_disturbance_class", f"""WITH {ctes('raw')} SELECT CASE WHEN sim_type = '[]' THEN 'baseline' WHEN contains(sim_type, 'Gunshot') THEN 'gunshot'
  WHEN contains(sim_type, 'Vehicle') THEN 'human_vehicle' ELSE 'human_trail' END AS kind, count(*) AS n FROM raw GROUP BY 1""")
def p5(spark, sf):
    return raw(spark, sf).groupBy(P.disturbance_class("sim_type").alias("kind")).agg(F.count("*").alias("n"))


@query("p6_walking_only", f"""WITH {ctes('raw')} SELECT clip_id FROM raw WHERE sim_type = '[]'
  OR (contains(sim_type, 'Human Presence on Trail') AND NOT contains(sim_type, 'Vehicle') AND NOT contains(sim_type, 'Gunshot') AND NOT contains(sim_type, 'Chainsaw'))""")
def p6(spark, sf):
    return raw(spark, sf).filter(P.walking_only("sim_type")).select("clip_id")


@query("p7_event_kind", f"""WITH {ctes('raw')}, e AS (SELECT unnest({SQL_LIST.format('sim_type')}) AS kind_text FROM raw)
SELECT CASE WHEN lower(kind_text) LIKE '%presence%' THEN 'presence' ELSE 'sound' END AS kind,
  CASE WHEN lower(kind_text) LIKE '%gun%' THEN 'gunshot' WHEN lower(kind_text) LIKE '%chain%' THEN 'chainsaw'
    WHEN lower(kind_text) LIKE '%vehic%' THEN 'vehicle' ELSE lower(kind_text) END AS sound, count(*) AS n FROM e GROUP BY 1, 2""")
def p7(spark, sf):
    e = raw(spark, sf).select(F.explode(P.parse_list("sim_type")).alias("s"))
    return e.groupBy(P.event_kind("s").alias("kind"), P.sound_type("s").alias("sound")).agg(F.count("*").alias("n"))


@query("p8_species_at_confidence", f"""WITH {ctes('raw')}, {PAIRED}
SELECT clip_id, array_to_string(list_sort([sp[i] FOR i IN range(1, least(len(sp), len(cf)) + 1) IF TRY_CAST(cf[i] AS DOUBLE) >= 0.5]), ';') AS species FROM pairs""")
def p8(spark, sf):
    return raw(spark, sf).select("clip_id", F.array_join(F.array_sort(P.species_at("species", "confidence", 0.5)), ";").alias("species"))


@query("p9_common_name", f"""WITH {ctes('raw')}, e AS (SELECT unnest({SP}) AS s FROM raw) SELECT string_split(s, '_')[-1] AS name, count(*) AS n FROM e GROUP BY 1""")
def p9(spark, sf):
    return raw(spark, sf).select(F.explode(P.parse_list("species")).alias("s")).groupBy(P.common_name("s").alias("name")).agg(F.count("*").alias("n"))


@query("p10_top_confidence", f"""WITH {ctes('raw')}, c AS (SELECT clip_id, coalesce(list_max([TRY_CAST(q AS DOUBLE) FOR q IN {CF}]), 0.0) AS conf FROM raw)
SELECT clip_id, conf, CASE WHEN conf >= 0.5 THEN conf ELSE 0.0 END AS mean_conf_clip FROM c""")
def p10(spark, sf):
    conf = P.top_confidence("confidence")
    return raw(spark, sf).select("clip_id", conf.alias("conf")).withColumn("mean_conf_clip", P.zero_below("conf", 0.5))


@query("p11_human_tag", f"""WITH {ctes('raw')}, s AS (SELECT clip_id, {SQL_LIST.format('sim_type')} AS tags FROM raw)
SELECT clip_id, len([q FOR q IN tags IF regexp_matches(lower(q), 'human|engine|gun|siren|dog|power tool|chainsaw|vehicle|fireworks')]) > 0 AS human FROM s""")
def p11(spark, sf):
    return raw(spark, sf).select("clip_id", P.human_tag(P.parse_list("sim_type")).alias("human"))


@query("p12_target_species", f"""WITH {ctes('raw')} SELECT "Recorder" AS recorder, round(avg(CASE WHEN lower(species) LIKE '%owl%' THEN 1.0 ELSE 0.0 END), 6) AS owl_share,
  round(avg(CASE WHEN lower(species) LIKE '%click%' THEN 1.0 ELSE 0.0 END), 6) AS click_share FROM raw GROUP BY 1""")
def p12(spark, sf):
    sp = P.parse_list("species")
    share = lambda w: rnd(F.avg(P.mentions(sp, w).cast("double")))
    return raw(spark, sf).groupBy(F.col("Recorder").alias("recorder")).agg(share("Owl").alias("owl_share"), share("Click").alias("click_share"))


@query("p13_time_parts", f"""WITH {ctes('clips')} SELECT clip_id, CAST(hour AS INTEGER) AS hour, CAST(t % 86400 // 60 AS INTEGER) AS minute_of_day, t - t % 60 AS minute_t,
  CAST(t % 86400 // 600 * 10 AS INTEGER) AS slot, rec || '|' || (t - t % 86400) AS rec_day, rec || '|' || hour AS rec_hour FROM clips""")
def p13(spark, sf):
    return clips(spark, sf).select(
        "clip_id", P.hour_of("t").alias("hour"), P.minute_of_day("t").alias("minute_of_day"), P.floor_to("t", 60).alias("minute_t"),
        P.slot_of("t").alias("slot"), P.session_key("rec", "t").alias("rec_day"),
        F.concat_ws("|", F.col("rec").cast("string"), P.hour_of("t").cast("string")).alias("rec_hour"))


# Hours left out or kept by each variant.
HOUR_VARIANTS = {
    "A_exclude_15_16": {"exclude": [15, 16]},
    "B_exclude_8_15_16": {"exclude": [8, 15, 16]},
    "C_best_hours_only": {"keep": [9, 13, 17, 18]},
    "D_no_restriction": {},
}


@query("p14_hour_restriction", f"""WITH {ctes('clips')} SELECT rec, variant, count(*) AS n, sum(lab)::BIGINT AS n_sim FROM (
  SELECT rec, lab, unnest([v FOR v IN ['A_exclude_15_16', 'B_exclude_8_15_16', 'C_best_hours_only', 'D_no_restriction']
    IF CASE v WHEN 'A_exclude_15_16' THEN hour NOT IN (15, 16) WHEN 'B_exclude_8_15_16' THEN hour NOT IN (8, 15, 16)
      WHEN 'C_best_hours_only' THEN hour IN (9, 13, 17, 18) ELSE true END]) AS variant FROM clips) GROUP BY 1, 2""")
def p14(spark, sf):
    names = F.array_compact(F.array(*[F.when(P.in_hours("t", **v), F.lit(k)) for k, v in HOUR_VARIANTS.items()]))
    return clips(spark, sf).select("rec", "lab", F.explode(names).alias("variant")).groupBy("rec", "variant").agg(
        F.count("*").alias("n"), F.sum("lab").alias("n_sim"))


@query("p14_shared_hours", f"""WITH {ctes('clips')}, h AS (SELECT hour, count(DISTINCT rec) AS n FROM clips WHERE lab = 1 GROUP BY 1)
SELECT hour FROM h WHERE n = (SELECT count(DISTINCT rec) FROM clips WHERE lab = 1)""")
def p14b(spark, sf):
    sim = clips(spark, sf).filter("lab = 1")
    h = sim.groupBy("hour").agg(F.count_distinct("rec").alias("n"))
    total = sim.agg(F.count_distinct("rec").alias("total"))
    return h.join(F.broadcast(total), F.col("n") == F.col("total")).select("hour")


@query("p15_daytime_span", f"""WITH {ctes('visits')}, v AS (SELECT rec, start_t, end_t, start_t - 1800 AS a, end_t + 1800 AS b FROM visits)
SELECT rec, start_t, (a // 86400 = b // 86400) AND a % 86400 // 60 >= 360 AND b % 86400 // 60 <= 1050 AS daytime FROM v""")
def p15(spark, sf):
    from fieldhush.plans.q_intervals import visits

    return visits(spark, sf).select("rec", "start_t", P.daytime_span("start_t", "end_t").alias("daytime"))


@query("p16_session_key", f"""WITH {ctes('clips')} SELECT rec || '|' || (t - t % 21600) AS session, count(*) AS n, sum(lab)::BIGINT AS n_sim FROM clips GROUP BY 1""")
def p16(spark, sf):
    return clips(spark, sf).groupBy(P.session_key("rec", "t", 6).alias("session")).agg(F.count("*").alias("n"), F.sum("lab").alias("n_sim"))


@query("p17_feature_sets", f"""WITH {ctes('clips')} SELECT clip_id, x1 AS f0, CAST(x2 AS DOUBLE) AS f1 FROM clips""")
def p17(spark, sf):
    c = clips(spark, sf).select("clip_id", "x1", F.col("x2").cast("double").alias("x2"), F.lit(0.0).alias("z_x1"))
    out = select_features(c, FeatureSet("raw", prefixes=("x",)), keep=["clip_id"])
    v = vector_to_array("features")
    return out.select("clip_id", v[0].alias("f0"), v[1].alias("f1"))


@query("p18_finite", f"""WITH {ctes('clips')} SELECT clip_id, CASE WHEN x2 % 10 = 0 THEN 0.0 WHEN x2 = 7 THEN 0.0 ELSE round(x1 / (x2 % 10), 6) END AS v FROM clips""")
def p18(spark, sf):
    broken = F.when(F.col("x2") == 7, float("nan")).when(F.col("x2") % 10 == 0, float("inf")).otherwise(F.try_divide("x1", F.col("x2") % 10))
    return clips(spark, sf).select("clip_id", rnd(P.finite(broken)).alias("v"))


@query("p19_decibel", f"""WITH {ctes('clips')} SELECT rec, hour, round(10 * log10(avg(x1) + 1e-15), 6) AS db_of_mean, round(avg(10 * log10(x1 + 1e-15)), 6) AS mean_of_db FROM clips GROUP BY 1, 2""")
def p19(spark, sf):
    return clips(spark, sf).groupBy("rec", "hour").agg(rnd(P.decibel(F.avg("x1"))).alias("db_of_mean"), rnd(F.avg(P.decibel("x1"))).alias("mean_of_db"))


@query("p20_band_mean", f"""WITH {ctes('dims')} SELECT vec_id, round(avg(CASE WHEN (dim + 0.5) * 250 >= 2000 AND (dim + 0.5) * 250 < 7000 THEN v END), 6) AS bird,
  round(avg(CASE WHEN (dim + 0.5) * 250 >= 10000 AND (dim + 0.5) * 250 < 13000 THEN v END), 6) AS insect FROM dims GROUP BY 1""")
def p20(spark, sf):
    return segments(spark, sf).select("vec_id", rnd(P.band_mean("embedding", 2000, 7000, 250)).alias("bird"),
                                      rnd(P.band_mean("embedding", 10000, 13000, 250)).alias("insect"))


# Weight of each measure in the rain score; a negative weight takes 1 - scaled value.
RAIN_WEIGHTS = {"rms": 0.35, "entropy": 0.35, "rolloff_std": -0.20, "silence": -0.10}


def rain_input(spark, sf):
    return clips(spark, sf).select("clip_id", "rec", "lab", F.col("x1").alias("rms"), F.col("x2").cast("double").alias("entropy"),
                                   F.col("hour").cast("double").alias("rolloff_std"), (F.col("t") % 60).cast("double").alias("silence"))


RAIN_SQL = f"""{ctes('clips')}, f AS (SELECT clip_id, rec, lab, x1 AS rms, CAST(x2 AS DOUBLE) AS ent, CAST(hour AS DOUBLE) AS ro, CAST(t % 60 AS DOUBLE) AS si FROM clips),
rain AS (SELECT clip_id, rec, lab, 0.35 * (rms - min(rms) OVER w) / (max(rms) OVER w - min(rms) OVER w + 1e-10)
  + 0.35 * (ent - min(ent) OVER w) / (max(ent) OVER w - min(ent) OVER w + 1e-10)
  + 0.20 * (1 - (ro - min(ro) OVER w) / (max(ro) OVER w - min(ro) OVER w + 1e-10))
  + 0.10 * (1 - (si - min(si) OVER w) / (max(si) OVER w - min(si) OVER w + 1e-10)) AS score FROM f WINDOW w AS (PARTITION BY rec))"""


@query("p21_rain_score", f"WITH {RAIN_SQL} SELECT clip_id, round(score, 6) AS score FROM rain")
def p21(spark, sf):
    return min_max_score(rain_input(spark, sf), ["rec"], RAIN_WEIGHTS, "score").select("clip_id", rnd("score").alias("score"))


@query("p22_baseline_percentile_filter", f"""WITH {RAIN_SQL}, p AS (SELECT rec, quantile_cont(score, 0.9) AS cut FROM rain WHERE lab = 0 GROUP BY 1)
SELECT r.rec, count(*) AS n, sum(r.lab)::BIGINT AS n_sim FROM rain r JOIN p ON p.rec = r.rec WHERE r.score <= p.cut GROUP BY 1""")
def p22(spark, sf):
    scored = min_max_score(rain_input(spark, sf), ["rec"], RAIN_WEIGHTS, "score")
    kept = baseline_percentile_filter(scored, ["rec"], "score", F.col("lab") == 0, 0.9)
    return kept.groupBy("rec").agg(F.count("*").alias("n"), F.sum("lab").alias("n_sim"))


@query("p24_label_remap", """SELECT doc_id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS site FROM documents""")
def p24(spark, sf):
    return remap_ids(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "source", "site").select("doc_id", "site")
