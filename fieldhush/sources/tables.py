"""Clip tables, feature matrices, embeddings and caches as Spark reads and writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldhush.functions.parse import epoch_seconds, recorder_of, stamp_ntz
from fieldhush.sources.scratch import sized

CLIP_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in (
    "clip_name", "Recorder", "Timestamp", "species", "confidence", "Sim Type", "Sim Relative Time", "Human Activity", "Time Of Day")])


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in ``order``: a partial aggregate, so copies of one key never meet in a sort."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("__row"))
    return g.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def clean_clips(df: DataFrame, order: Sequence[str], stamp: str = "Timestamp") -> DataFrame:
    """String ids, one row per clip name, ``t`` from the stamp; rows without a readable stamp are dropped."""
    d = df.withColumn("clip_name", F.col("clip_name").cast("string"))
    d = first_by_key(d, ["clip_name"], order)
    return d.withColumn("t", epoch_seconds(stamp_ntz(F.col(stamp).cast("string")))).filter(F.col("t").isNotNull())


def read_clips(spark: SparkSession, path: str, columns: Sequence[str] | None = None, fmt: str = "csv") -> DataFrame:
    """Read the wanted columns of a clip table (``csv`` with header, or ``parquet``) and clean it."""
    reader = spark.read
    if fmt == "csv":
        head = reader.option("header", True).csv(path).columns
        known = {f.name: f for f in CLIP_SCHEMA}
        schema = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in head])
        df = reader.option("header", True).option("escape", '"').schema(schema).csv(path)
    else:
        df = reader.format(fmt).load(path)
    df = df.select(*columns) if columns else df
    return clean_clips(df, [F.col(c) for c in df.columns if c != "clip_name"])


#: The text columns of feature matrices; all other columns are numbers.
FEATURE_TEXT = ("clip_name", "sim_type", "recorder", "session", "timestamp")


def read_feature_matrices(spark: SparkSession, path: str, fmt: str = "csv", name: str = r"(?i)am(\d+)_feature_matrix\.", text: Sequence[str] = FEATURE_TEXT) -> DataFrame:
    """All feature tables whose whole file name is ``name`` and the format's ending; ``recorder`` from the clip name, else from the file name.

    Tables with different columns are united by name, missing columns are null. One scan reads all files, whatever their number: each line is mapped by the
    header of its own file, and only the distinct headers come to the driver. Columns other than ``text`` are doubles; a value that is no number is null.
    """
    stem = F.regexp_extract("__path", f"({name}{fmt})(?:/[^/]*)?$", 1)
    if fmt == "csv":
        lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("__path"))
        lines = lines.withColumn("__stem", stem).filter("__stem <> '' and trim(value) <> ''")
        # A header is the line that names the column of the clip names; each part file of a table has one.
        is_head = F.col("value").rlike(r'(^|,)"?clip_name"?(,|$)')
        files = lines.filter(is_head).groupBy("__path").agg(F.first("value").alias("__head"))
        heads = sorted(r["__head"] for r in files.select("__head").distinct().collect())
        if not heads:
            raise FileNotFoundError(f"no feature matrix under {path}")
        names = [[c.strip().strip('"') for c in h.split(",")] for h in heads]
        cells = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(max(map(len, names))))))
        rows = lines.filter(~is_head).join(sized(files), "__path").withColumn("__c", cells)

        def column(c: str) -> Column:
            out = F.lit(None).cast("string")
            for h, n in zip(heads, names, strict=True):
                if c in n:
                    out = F.when(F.col("__head") == h, F.col("__c")[f"c{n.index(c)}"]).otherwise(out)
            return out.alias(c) if c in text else out.try_cast("double").alias(c)

        found = rows.select("__stem", *[column(c) for c in dict.fromkeys(c for n in names for c in n)])
    else:
        reader = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).format(fmt)
        found = reader.load(path).withColumn("__path", F.col("_metadata.file_path")).withColumn("__stem", stem).filter("__stem <> ''").drop("__path")
    from_file = F.concat(F.lit("AM"), F.regexp_extract("__stem", name, 1))
    rec = recorder_of("clip_name")
    return found.withColumn("recorder", F.when(rec == "AM?", from_file).otherwise(rec)).drop("__stem")


def align(features: DataFrame, embeddings: DataFrame, keys: Sequence[str], label: str, other_label: str, least: float = 0.95) -> DataFrame:
    """Keyed inner join with ``agreement``, the share of rows whose labels agree, and ``aligned`` when it reaches ``least``."""
    both = features.join(embeddings, list(keys))
    share = both.agg(F.avg((F.col(label) == F.col(other_label)).cast("double")).alias("agreement"))
    return both.crossJoin(F.broadcast(share)).withColumn("aligned", F.col("agreement") >= least)


def plain_name(name: str | Column) -> Column:
    """Copies such as ``clip (1).wav`` stand for ``clip.wav``."""
    return F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"\s*\(\d+\)(?=\.[^.]*$|$)", "")


def only_stored(df: DataFrame, files: DataFrame, name: str, path: str = "path") -> DataFrame:
    """Rows whose clip exists in the file listing."""
    listed = files.select(plain_name(F.element_at(F.split(path, "/"), -1)).alias(name)).distinct()
    return df.withColumn(name, plain_name(name)).join(listed, name, "left_semi")


def union_caches(caches: Sequence[DataFrame], key: str) -> DataFrame:
    """One row per key; the first cache that has it wins."""
    tagged = [c.withColumn("__prio", F.lit(i)) for i, c in enumerate(caches)]
    out = tagged[0]
    for c in tagged[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return first_by_key(out, [key], ["__prio"]).drop("__prio")


def measure_missing(wanted: DataFrame, cache_path: str, key: str, measure, schema: T.StructType) -> DataFrame:
    """Measure only what the Parquet cache lacks, append it, and return the wanted rows of the cache.

    ``measure`` is a DataFrame -> DataFrame job. A run that stops half-way leaves no partial append, so the
    next run measures what is still missing.
    """
    spark = wanted.sparkSession
    spark.createDataFrame([], schema).write.mode("append").parquet(cache_path)
    cache = spark.read.schema(schema).parquet(cache_path)
    todo = wanted.join(cache.select(key).distinct(), key, "left_anti")
    measure(todo).select(*schema.names).write.mode("append").parquet(cache_path)
    done = spark.read.schema(schema).parquet(cache_path)
    return first_by_key(done, [key], [c for c in schema.names if c != key]).join(wanted.select(key).distinct(), key, "left_semi")


def compare_labels(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """Counts of agreement between two label tables: rows on each side, common, positives, disagreements each way."""
    j = a.select(key, F.col(label).alias("__a")).join(b.select(key, F.col(label).alias("__b")), key, "full_outer")
    x, y = F.col("__a"), F.col("__b")
    return j.agg(F.count("__a").alias("n_a"), F.count("__b").alias("n_b"), F.count_if(x.isNotNull() & y.isNotNull()).alias("common"),
                 F.count_if(x == 1).alias("pos_a"), F.count_if(y == 1).alias("pos_b"),
                 F.count_if((x == 1) & (y == 0)).alias("only_a"), F.count_if((x == 0) & (y == 1)).alias("only_b"))


def label_disagreements(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    j = a.select(key, F.col(label).alias(f"{label}_a")).join(b.select(key, F.col(label).alias(f"{label}_b")), key)
    return j.filter(F.col(f"{label}_a") != F.col(f"{label}_b"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode).format(fmt)
    w = w.partitionBy(*partition_by) if partition_by else w
    (w.option("header", True) if fmt == "csv" else w).save(path)
