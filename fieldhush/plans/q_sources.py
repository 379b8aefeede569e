"""Source and sink (S), signal (D) and stream (ST) queries. Clips of sound are made from the document texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldhush.functions.parse import epoch_seconds
from fieldhush.operators import clip_vectors as V
from fieldhush.operators import signal as D
from fieldhush.plans.q_series import SELF_UPDATE
from fieldhush.plans.registry import query, rnd
from fieldhush.plans.views import clips, ctes, raw, segments, table
from fieldhush.sources import audio
from fieldhush.sources import tables as B
from fieldhush.sources.scratch import scratch_dir
from fieldhush.streaming import online, timed
from fieldhush.streaming.timed import rocks_state, state_partitions

RATE = 32000


def fresh(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- tables ----------------------------------------------------------------

@query("s1_clean_clips", f"""WITH {ctes('raw')}, d AS (SELECT clip_name, min(clip_id) AS clip_id, min(stamp) AS stamp FROM raw GROUP BY 1)
SELECT clip_name, clip_id, CAST(epoch(strptime(stamp, '%Y%m%d_%H%M%S')) AS BIGINT) AS t FROM d""")
def s1(spark, sf):
    r = raw(spark, sf).select("clip_name", "clip_id", F.col("stamp").alias("Timestamp"))
    twice = r.unionByName(r.filter("clip_id % 3 = 0").withColumn("clip_id", F.col("clip_id") + 1000000)).unionByName(
        r.filter("clip_id % 7 = 0").withColumn("clip_name", F.concat(F.lit("x"), "clip_name")).withColumn("Timestamp", F.lit("unknown")))
    return B.clean_clips(twice, ["clip_id"]).select("clip_name", "clip_id", "t")


@query("s1_read_clip_csv", f"""WITH {ctes('raw')} SELECT clip_name, min(species) AS species, CAST(epoch(strptime(min(stamp), '%Y%m%d_%H%M%S')) AS BIGINT) AS t FROM raw GROUP BY 1""")
def s1b(spark, sf):
    r = raw(spark, sf).select("clip_name", "Recorder", F.col("stamp").alias("Timestamp"), "species", "confidence", F.col("sim_type").alias("Sim Type"))
    path = fresh(spark, "clips-csv")
    B.write_table(r, path, "csv")
    return B.read_clips(spark, path, ["clip_name", "Timestamp", "species"]).select("clip_name", "species", "t")


@query("s2_feature_matrices", f"""WITH {ctes('clips')} SELECT 'AM' || (rec + 1) AS recorder, count(*) AS n, round(sum(x1), 4) AS x1, CASE WHEN rec = 1 THEN sum(x2)::BIGINT ELSE -1 END AS extra FROM clips GROUP BY rec""")
def s2(spark, sf):
    path = fresh(spark, "matrices")
    for r in range(6):
        part = clips(spark, sf).filter(F.col("rec") == r).select(F.concat(F.lit("clip"), "clip_id").alias("clip_name"), "x1", *(["x2"] if r == 1 else []))
        B.write_table(part.withColumn("clip_name", F.lit("nameless")), f"{path}/am{r + 1}_feature_matrix.csv", "csv")
    m = B.read_feature_matrices(spark, path)
    return m.groupBy("recorder").agg(F.count("*").alias("n"), rnd(F.sum("x1"), 4).alias("x1"), F.coalesce(F.sum("x2"), F.lit(-1)).cast("long").alias("extra"))


@query("s3_align_embeddings", f"""WITH {ctes('segments')}, e AS (SELECT vec_id, CASE WHEN vec_id % 25 = 0 THEN 1 - clip_label ELSE clip_label END AS other FROM segments WHERE vec_id % 11 <> 0)
SELECT s.clip, s.seg_idx, (SELECT round(avg(CASE WHEN s2.clip_label = e2.other THEN 1.0 ELSE 0.0 END), 6) FROM segments s2 JOIN e e2 ON e2.vec_id = s2.vec_id) AS agreement,
  (SELECT avg(CASE WHEN s2.clip_label = e2.other THEN 1.0 ELSE 0.0 END) >= 0.95 FROM segments s2 JOIN e e2 ON e2.vec_id = s2.vec_id) AS aligned FROM segments s JOIN e ON e.vec_id = s.vec_id""")
def s3(spark, sf):
    s = segments(spark, sf)
    e = s.filter("vec_id % 11 <> 0").select("clip", "seg_idx", F.when(F.col("vec_id") % 25 == 0, 1 - F.col("clip_label")).otherwise(F.col("clip_label")).alias("other"))
    return B.align(s.select("clip", "seg_idx", "clip_label"), e, ["clip", "seg_idx"], "clip_label", "other").select("clip", "seg_idx", rnd("agreement").alias("agreement"), "aligned")


@query("s4_nested_mean", f"""WITH {ctes('dims')} SELECT clip, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) + 0.0 AS v FROM dims GROUP BY 1, 2""")
def s4(spark, sf):
    nested = segments(spark, sf).groupBy("clip").agg(F.collect_list("embedding").alias("segments"))  # five segments a clip
    return V.nested_mean(nested, "clip", "segments").select("clip", F.posexplode("embedding").alias("dim", "v")).withColumn("v", rnd("v"))


def sound(spark, sf):
    """Each document as a 16-bit mono WAV file whose samples are the bytes of the text."""
    d = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    d = d.withColumn("n", F.expr("octet_length(b) div 2 * 2"))

    def little(c):
        h = F.lpad(F.hex(c.cast("long")), 8, "0")
        return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))

    text = lambda s: F.encode(F.lit(s), "UTF-8")
    head = F.concat(text("RIFF"), little(F.col("n") + 36), text("WAVEfmt "), F.unhex(F.lit("1000000001000100")), little(F.lit(RATE)), little(F.lit(2 * RATE)),
                    F.unhex(F.lit("02001000")), text("data"), little(F.col("n")), F.expr("substring(b, 1, cast(n as int))"))
    return d.select("doc_id", head.alias("content"))


@query("s5_decode_wav", """SELECT doc_id, CAST(32000 AS INTEGER) AS sr, CAST(octet_length(encode(text)) // 2 AS INTEGER) AS samples FROM documents""")
def s5(spark, sf):
    return audio.decode_wav(sound(spark, sf)).select("doc_id", "sr", F.size("wave").alias("samples"))


@query("s6_only_stored_clips", f"""WITH {ctes('raw')} SELECT clip_name, count(*) AS n FROM raw WHERE clip_name IN (SELECT clip_name FROM raw WHERE clip_id % 4 = 1) GROUP BY 1""")
def s6(spark, sf):
    r = raw(spark, sf)
    stored = r.filter("clip_id % 4 = 1").select(F.when(F.col("clip_id") % 8 == 1, F.concat(F.lit("/data/"), F.regexp_replace("clip_name", r"\.wav$", " (1).wav")))
                                                .otherwise(F.concat(F.lit("/data/"), "clip_name")).alias("path"))
    return B.only_stored(r.select("clip_name"), stored, "clip_name").groupBy("clip_name").agg(F.count("*").alias("n"))


@query("s7_measure_cache", f"""WITH {ctes('clips')} SELECT clip_id, round(ln(1 + x1), 6) AS level FROM clips""")
def s7(spark, sf):
    c = clips(spark, sf).select("clip_id", "x1")
    job = lambda d: d.select("clip_id", rnd(F.log1p("x1")).alias("level"))
    schema = T.StructType([T.StructField("clip_id", T.LongType()), T.StructField("level", T.DoubleType())])
    path = fresh(spark, "cache")
    B.measure_missing(c.filter("clip_id % 2 = 0"), path, "clip_id", job, schema)
    return B.measure_missing(c, path, "clip_id", job, schema)


@query("s7_union_caches", f"""WITH {ctes('clips')} SELECT clip_id, CASE WHEN x2 < 50 THEN 'first' ELSE 'second' END AS origin FROM clips WHERE x2 < 50 OR x2 >= 30""")
def s7b(spark, sf):
    c = clips(spark, sf)
    a = c.filter("x2 < 50").select("clip_id", F.lit("first").alias("origin"))
    b = c.filter("x2 >= 30").select("clip_id", F.lit("second").alias("origin"))
    return B.union_caches([a, b], "clip_id")


@query("s8_write_result_table", f"""WITH {ctes('clips')} SELECT rec, day, count(*) AS n FROM clips GROUP BY 1, 2""")
def s8(spark, sf):
    path = fresh(spark, "result")
    B.write_table(clips(spark, sf).groupBy("rec", "day").agg(F.count("*").alias("n")), path, partition_by=["rec"])
    return spark.read.parquet(path).select("rec", "day", "n")


@query("s9_compare_label_files", f"""WITH a AS (SELECT doc_id, quality AS lab FROM labels), b AS (SELECT doc_id, toxic AS lab FROM labels WHERE doc_id % 3 <> 0)
SELECT count(a.doc_id) AS n_a, count(b.doc_id) AS n_b, sum(CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS common, sum(CASE WHEN a.lab = 1 THEN 1 ELSE 0 END)::BIGINT AS pos_a,
  sum(CASE WHEN b.lab = 1 THEN 1 ELSE 0 END)::BIGINT AS pos_b, sum(CASE WHEN a.lab = 1 AND b.lab = 0 THEN 1 ELSE 0 END)::BIGINT AS only_a, sum(CASE WHEN a.lab = 0 AND b.lab = 1 THEN 1 ELSE 0 END)::BIGINT AS only_b
FROM a FULL OUTER JOIN b ON b.doc_id = a.doc_id""")
def s9(spark, sf):
    lab = table(spark, sf, "labels")
    a, b = lab.select("doc_id", F.col("quality").alias("lab")), lab.filter("doc_id % 3 <> 0").select("doc_id", F.col("toxic").alias("lab"))
    return B.compare_labels(a, b, "doc_id", "lab")


@query("s9_label_disagreements", """SELECT doc_id, quality AS lab_a, toxic AS lab_b FROM labels WHERE quality <> toxic""")
def s9b(spark, sf):
    lab = table(spark, sf, "labels")
    return B.label_disagreements(lab.select("doc_id", F.col("quality").alias("lab")), lab.select("doc_id", F.col("toxic").alias("lab")), "doc_id", "lab").select("doc_id", "lab_a", "lab_b")


# ---- signal ----------------------------------------------------------------

@query("d1_soundscape_measures")
def d1(spark, sf):
    out = D.signal_job(sound(spark, sf), D.soundscape, D.doubles(D.MEASURES), ["doc_id"], content="content")
    return out.select("doc_id", *[rnd(m, 4).alias(m) for m in D.MEASURES])


@query("d2_banded_power")
def d2(spark, sf):
    """48 bands of a third of a kHz, log power, mean removed."""
    job = D.banded_power([i * 16000 / 48 for i in range(49)], 1024, log=True, centre=True)
    out = D.signal_job(sound(spark, sf), job, D.ARRAY_POWER, ["doc_id"], content="content")
    return out.select("doc_id", F.posexplode("power").alias("band", "p")).groupBy("band").agg(F.count("p").alias("n"), rnd(F.avg("p"), 4).alias("level"))


def spectrum_layout(name, edges):
    @query(name)
    def layout(spark, sf):
        out = D.signal_job(sound(spark, sf), D.banded_power(edges), D.ARRAY_POWER, ["doc_id"], content="content")
        bands = out.select("doc_id", F.posexplode("power").alias("band", "p")).groupBy("band").agg(F.count("p").alias("n"), F.avg("p").alias("p"))
        return bands.select("band", "n", rnd(10 * F.log10("p"), 4).alias("level"))


spectrum_layout("d2_steps_of_500_hz", D.edges_every(500))
spectrum_layout("d2_steps_of_250_hz", D.edges_every(250, 10000, 4000))
spectrum_layout("d2_pitch_groups", list(D.PITCH_GROUPS))


@query("d3_frame_features")
def d3(spark, sf):
    out = D.signal_job(sound(spark, sf), D.frame_features, D.doubles(D.FRAME_FEATURES), ["doc_id"], content="content")
    return out.select("doc_id", *[rnd(m, 4).alias(m) for m in D.FRAME_FEATURES])


@query("d4_windows_from_onsets", f"""WITH {ctes('dims')}, o AS (SELECT unnest([0, 1, 2, 3]) AS i, unnest([0.0, 0.25, 0.5, 0.875]) AS onset)
SELECT vec_id, CAST(i AS INTEGER) AS seg_idx, count(*) AS n, round(sum(v), 6) + 0.0 AS total FROM dims JOIN o ON dim >= floor(onset * 64) AND dim < floor((onset + 0.2) * 64) WHERE floor((onset + 0.2) * 64) < 64 GROUP BY 1, 2""")
def d4(spark, sf):
    s = segments(spark, sf).select("vec_id", F.lit(64).alias("sr"), F.col("embedding").alias("wave"))
    cut = D.cut_windows(s, ["vec_id"], F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.875)]), 0.2)
    total = F.aggregate("segment", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return cut.select("vec_id", "seg_idx", F.size("segment").cast("long").alias("n"), rnd(total).alias("total"))


# ---- streams ---------------------------------------------------------------

LATENESS = 2 * 3600  # slices of the feed are read in order, so only the rows of this span and of a time bucket wait
FEED_ROWS, FEED_BATCHES, FEED_FILES = 1_000_000, 5, 3  # rows of a micro-batch, about; micro-batches of a small feed; files of each


def replay(spark, sf, scorer, path=None):
    """Score the events as a stream and return the table written to ``path``.

    The feed is cut into slices of time, and each slice's files are written after those of the slice before, so a stream, which takes older files first, reads
    a slice in each micro-batch. A second run on the same checkpoint finds one heartbeat in the folder, which moves the watermark beyond the last row. Had a store
    mixed up the files by more than ``LATENESS``, rows would be missing, and that is an error here.
    """
    events = table(spark, sf, "events").select(F.col("event_id").alias("clip_id"), (F.col("user_id") % 6).cast("int").alias("rec"), epoch_seconds("ts").alias("t"),
                                               F.col("value").alias("x1"), F.get_json_object("props", "$.k").cast("double").alias("x2"))
    n, first, last = events.agg(F.count("*"), F.min("t"), F.max("t")).first()
    first, last = first or 0, last or 0
    slices = max(FEED_BATCHES, -(-n // FEED_ROWS))
    partitions = state_partitions(events, "rec")
    staged, feed, progress = fresh(spark, "slices"), fresh(spark, "feed"), fresh(spark, "progress")
    path = path or fresh(spark, "scored")
    events.withColumn("slice", F.floor((F.col("t") - first) * slices / (last - first + 1)).cast("int")).repartition("slice").write.partitionBy("slice").parquet(staged)
    schema = events.schema
    sliced = spark.read.schema(T.StructType([*schema, T.StructField("slice", T.IntegerType())])).parquet(staged)  # listed once for all slices

    def add(df) -> None:
        df.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("append").parquet(feed)

    def run() -> None:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FEED_FILES).parquet(feed)
        with rocks_state(spark, partitions):
            online.run_to_table(scorer(stream, LATENESS), path, progress)

    for k in range(slices):
        add(sliced.filter(F.col("slice") == k).repartition(FEED_FILES))
    run()
    beat = {"rec": F.lit(0), "t": F.lit(last + LATENESS + 86400)}
    add(spark.range(1).select(*[beat.get(f.name, F.lit(None)).alias(f.name) for f in schema]).coalesce(1))
    run()
    out = spark.read.parquet(path)
    if out.count() != n:
        raise RuntimeError(f"{n - out.count()} rows came later than {LATENESS} s")
    return out


W = "PARTITION BY rec ORDER BY t, clip_id"


@query("st1_online_scorer", f"""WITH {ctes('clips')}, r AS (SELECT clip_id, rec, t, x1, count(*) OVER p AS n, avg(x1) OVER p AS m, stddev_pop(x1) OVER p AS s FROM clips WINDOW p AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
z AS (SELECT clip_id, rec, t, CASE WHEN n >= 2 THEN (x1 - m) / greatest(s, 1e-6) ELSE 0 END AS z FROM r)
SELECT clip_id, round(z, 5) + 0.0 AS z, CASE WHEN sum(CASE WHEN abs(z) > 1.5 THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 THEN 1 ELSE 0 END AS alert FROM z""")
def st1(spark, sf):
    out = replay(spark, sf, lambda stream, late: timed.timed_scorer(stream, "rec", "t", "clip_id", "x1", lateness=late))
    return out.select("clip_id", rnd("z", 5).alias("z"), "alert")


@query("st2_online_self_updating", SELF_UPDATE)
def st2(spark, sf):
    out = replay(spark, sf, lambda stream, late: timed.timed_self_updating(stream, "rec", "t", "clip_id", ["x1", "x2"], lateness=late))
    return out.select("clip_id", rnd("z_x1", 5).alias("z_x1"), rnd("z_x2", 5).alias("z_x2"))
