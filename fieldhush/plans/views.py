"""Clip-like views over the supplied tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldhush.functions.parse import epoch_seconds

RECORDERS = 6

CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "clips": ((), f"""
      SELECT event_id AS clip_id, CAST(user_id % {RECORDERS} AS INTEGER) AS rec,
        CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t, event_type AS species, value AS x1,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS x2,
        CASE WHEN event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS INTEGER) >= 80 THEN 1 ELSE 0 END AS lab,
        CAST(epoch(date_trunc('second', ts)) AS BIGINT) % 86400 // 3600 AS hour,
        CAST(epoch(date_trunc('second', ts)) AS BIGINT) // 86400 AS day
      FROM events"""),
    "sims": (("clips",), """
      SELECT DISTINCT rec, t, CASE WHEN x2 < 90 THEN 'presence' ELSE 'sound' END AS kind FROM clips WHERE lab = 1"""),
    "raw": (("clips",), """
      SELECT clip_id, 'Audio_Moth_' || (rec + 1) || '_' || strftime(make_timestamp(t * 1000000), '%Y%m%d_%H%M%S') || '.wav' AS clip_name,
        'Audio_Moth_' || (rec + 1) AS "Recorder", strftime(make_timestamp(t * 1000000), '%Y%m%d_%H%M%S') AS stamp,
        CASE x2 % 4 WHEN 0 THEN '[]' WHEN 1 THEN 'Avis_' || species
          WHEN 2 THEN '[''Avis_' || species || ''', ''Avis_Grey Owl'']' ELSE '[''Avis_' || species || ''']' END AS species,
        CASE WHEN x2 % 4 = 0 THEN '[]' WHEN x2 % 4 = 1 THEN CAST(x2 AS VARCHAR) || 'e-2'
          WHEN x2 % 8 = 2 THEN '[' || x2 || 'e-2]' WHEN x2 % 4 = 2 THEN '[' || x2 || 'e-2, 60e-2]' ELSE '[bad]' END AS confidence,
        CASE WHEN lab = 0 THEN '[]' WHEN x2 < 90 THEN '[''Human Presence on Trail'']'
          WHEN x2 % 2 = 0 THEN '[''Human Presence on Trail'', ''Vehicle'']' ELSE '[''Gunshot'']' END AS sim_type,
        CASE WHEN lab = 0 THEN '[]' WHEN x2 >= 90 AND x2 % 2 = 0 THEN '[-12.0, 30.0]' WHEN x2 = 99 THEN 'oops'
          ELSE '[' || ((x2 - 80) * 3) || '.0]' END AS sim_rel
      FROM clips"""),
    "segments": ((), """
      SELECT e.vec_id, e.vec_id // 5 AS clip, e.vec_id % 5 AS seg_idx, CAST(e.vec_id // 5 % 5 AS INTEGER) AS rec, e.embedding, e.label AS state,
        CASE WHEN f.label >= 5 THEN 1 ELSE 0 END AS clip_label
      FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id - e.vec_id % 5"""),
    "dims": (("segments",), """
      SELECT vec_id, clip, seg_idx, rec, clip_label, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM segments"""),
    "scores": (("clips",), """
      SELECT clip_id, rec, t, hour, day, lab, round(x1 / (x1 + 20.0), 4) AS score FROM clips"""),
    "panel": ((), f"""
      SELECT l_orderkey, l_linenumber, CAST(l_suppkey % {RECORDERS} AS INTEGER) AS rec, CAST(month(l_shipdate) AS INTEGER) AS moment,
        CAST(year(l_shipdate) AS INTEGER) AS yr, l_extendedprice / 1000.0 AS y, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS near,
        CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END AS after_, l_quantity AS qty FROM lineitem"""),
    "weather": (("clips",), """
      SELECT t - t % 3600 AS hour_t, avg(x1) AS temp, avg(x2) AS wind FROM clips GROUP BY 1"""),
    # Gap sessions of the logged events at each recorder: 20 minutes, then the visit is start .. start + 30 min.
    "gaps": (("sims",), """
      SELECT rec, t, kind, CASE WHEN t - lag(t) OVER (PARTITION BY rec ORDER BY t, kind) > 1200 THEN 1 ELSE 0 END AS brk FROM sims"""),
    "sids": (("gaps",), """
      SELECT rec, t, kind, sum(brk) OVER (PARTITION BY rec ORDER BY t, kind ROWS UNBOUNDED PRECEDING) AS sid FROM gaps"""),
    "sessions": (("sids",), """
      SELECT rec, min(t) AS start_t, max(t) + 3 AS end_t, median(t) AS centre, count(*) AS n_events, min(t) AS vid_t FROM sids GROUP BY rec, sid"""),
    "visits": (("sessions",), """
      SELECT rec, start_t, start_t + 1800 AS end_t, centre FROM sessions"""),
    "recdays": (("clips",), "SELECT DISTINCT rec, day FROM clips"),
    "placebos": (("visits", "recdays", "sessions"), """
      SELECT v.rec, v.start_t AS visit_t, v.start_t + (d.day - v.start_t // 86400) * 86400 AS start_t,
        v.end_t + (d.day - v.start_t // 86400) * 86400 AS end_t
      FROM visits v JOIN recdays d ON d.rec = v.rec AND d.day <> v.start_t // 86400
      WHERE NOT EXISTS (SELECT 1 FROM sessions s WHERE s.rec = v.rec
        AND abs(s.centre - (v.centre + (d.day - v.start_t // 86400) * 86400)) < 7200)"""),
}


def ctes(*names: str) -> str:
    """``WITH``-list text of the named views and what they build on."""
    done: list[str] = []

    def add(n: str) -> None:
        if n in done:
            return
        for need in CTE[n][0]:
            add(need)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    return ",\n".join(f"{n} AS ({CTE[n][1]})" for n in done)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def clips(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    t = epoch_seconds("ts")
    k = F.get_json_object("props", "$.k").cast("int")
    sim = (F.col("event_type") == "error") & (k >= 80)
    return e.select(
        F.col("event_id").alias("clip_id"),
        (F.col("user_id") % RECORDERS).cast("int").alias("rec"),
        t.alias("t"),
        F.col("event_type").alias("species"),
        F.col("value").alias("x1"),
        k.alias("x2"),
        F.when(sim, 1).otherwise(0).alias("lab"),
    ).withColumn("hour", F.expr("t % 86400 div 3600")).withColumn("day", F.expr("t div 86400"))


def sims(spark: SparkSession, sf: str) -> DataFrame:
    c = clips(spark, sf).filter("lab = 1")
    return c.select("rec", "t", F.when(F.col("x2") < 90, "presence").otherwise("sound").alias("kind")).distinct()


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """The clip table as text, the way the loggers write it."""
    c = clips(spark, sf)
    x2, s = F.col("x2"), F.col("x2").cast("string")
    name = F.concat(F.lit("Audio_Moth_"), (F.col("rec") + 1).cast("string"))
    clock = F.expr("timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, t)").cast("string")
    stamp = F.regexp_replace(clock, r"(\d+)-(\d+)-(\d+) (\d+):(\d+):(\d+).*", "$1$2$3_$4$5$6")
    one = F.concat(F.lit("Avis_"), F.col("species"))
    sim = F.col("lab") == 1
    return c.select(
        "clip_id",
        F.concat_ws("_", name, F.concat(stamp, F.lit(".wav"))).alias("clip_name"),
        name.alias("Recorder"),
        stamp.alias("stamp"),
        F.when(x2 % 4 == 0, "[]").when(x2 % 4 == 1, one)
        .when(x2 % 4 == 2, F.concat(F.lit("['"), one, F.lit("', 'Avis_Grey Owl']")))
        .otherwise(F.concat(F.lit("['"), one, F.lit("']"))).alias("species"),
        F.when(x2 % 4 == 0, "[]").when(x2 % 4 == 1, F.concat(s, F.lit("e-2")))
        .when(x2 % 8 == 2, F.concat(F.lit("["), s, F.lit("e-2]")))
        .when(x2 % 4 == 2, F.concat(F.lit("["), s, F.lit("e-2, 60e-2]"))).otherwise("[bad]").alias("confidence"),
        F.when(~sim, "[]").when(x2 < 90, "['Human Presence on Trail']")
        .when(x2 % 2 == 0, "['Human Presence on Trail', 'Vehicle']").otherwise("['Gunshot']").alias("sim_type"),
        F.when(~sim, "[]").when((x2 >= 90) & (x2 % 2 == 0), "[-12.0, 30.0]").when(x2 == 99, "oops")
        .otherwise(F.concat(F.lit("["), ((x2 - 80) * 3).cast("string"), F.lit(".0]"))).alias("sim_rel"),
    )


def segments(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").withColumn("clip", F.expr("vec_id div 5"))
    first = e.filter("vec_id % 5 = 0").select("clip", F.when(F.col("label") >= 5, 1).otherwise(0).alias("clip_label"))
    return e.join(first, "clip").select(
        "vec_id", "clip", F.expr("vec_id % 5").alias("seg_idx"), F.expr("cast(clip % 5 as int)").alias("rec"),
        "embedding", F.col("label").alias("state"), "clip_label",
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return clips(spark, sf).select(
        "clip_id", "rec", "t", "hour", "day", "lab", F.round(F.col("x1") / (F.col("x1") + 20.0), 4).alias("score"))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") % RECORDERS).cast("int").alias("rec"),
        F.month("l_shipdate").alias("moment"), F.year("l_shipdate").alias("yr"), (F.col("l_extendedprice") / 1000.0).alias("y"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("near"),
        F.when(F.col("l_discount") >= 0.05, 1.0).otherwise(0.0).alias("after_"),
        F.col("l_quantity").alias("qty"),
    )


def weather(spark: SparkSession, sf: str) -> DataFrame:
    return clips(spark, sf).groupBy((F.col("t") - F.col("t") % 3600).alias("hour_t")).agg(
        F.avg("x1").alias("temp"), F.avg("x2").alias("wind"))
