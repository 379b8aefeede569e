"""The registered queries of the text operators, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        QUERIES[name] = plan
        if sql:
            SQL[name] = sql
        return plan

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_source_mix")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldhush.llm.mixing import mix

    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


@query("op2_exact_dedup", """
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
    SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldhush.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents")).drop("row")


@query("op5_repeated_spans")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldhush.llm.line_dedup import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "words", "units", F.col("keep_doc_id"), "keep_start")


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldhush.llm.rules import quality_rules

    kept, _ = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_best_two_fit")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldhush.llm.packing import packed_documents

    return packed_documents(table(spark, sf_dir, "documents"))


@query("op7_token_planes")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldhush.llm.bitplanes import token_file

    return token_file(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op4_warc_dictionary", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    g AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
    b AS (SELECT page_id, octet_length(encode(p.h)) AS n, CAST(CAST(unhex(sha1(p.h)) AS BIT) AS VARCHAR) AS bits, first FROM p JOIN g ON p.h = g.h)
    SELECT page_id, n AS payload_bytes,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5),
        lambda j: CASE WHEN substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) = '1' THEN CAST(2 ** (4 - j) AS INTEGER) ELSE 0 END)) AS BIGINT), 1)), '') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
    FROM b""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldhush.llm.warc import archive

    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_ngram_jaccard")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldhush.llm.jaccard import similar_components

    return similar_components(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldhush.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_language_mixture")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldhush.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


#: The 64 letters from U+00C0 to U+00FF, and as many marks of one byte that no word has: SQL's edit distance counts bytes.
WIDE = "".join(map(chr, range(0xC0, 0x100)))
NARROW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + "!\"#$%&()*+,-./:;<=>?@[]^_{|}"


@query("op11_spelling_variants", f"""
    WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda a, b: CASE WHEN a & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), a >> 1) ELSE a >> 1 END) AS c FROM range(256) r(i))),
    runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z{WIDE}]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    each AS (SELECT run, count(*) AS k, hex(encode(doc_id || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
    hashed AS (SELECT run, k, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(CAST(length(x) / 2 AS BIGINT)),
        lambda i: CAST(16 * (strpos('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1 AS BIGINT))),
        lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), CAST(4294967295 AS BIGINT)) AS h FROM each, tab),
    written AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
    v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n, length(word) AS l, left(word, 3) AS a, right(word, 3) AS z, translate(word, '{WIDE}', '{NARROW}') AS c
      FROM written WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
    near AS (SELECT x.word, y.word AS other, y.n FROM v x JOIN v y ON x.a = y.a AND abs(x.l - y.l) <= 1 AND levenshtein(x.c, y.c) = 1
      UNION ALL SELECT x.word, y.word, y.n FROM v x JOIN v y ON x.z = y.z AND x.a <> y.a AND abs(x.l - y.l) <= 1 AND levenshtein(x.c, y.c) = 1),
    best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -n, o := encode(other))) AS b FROM near GROUP BY word),
    f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 10 * v.n THEN decode(b.o) END AS form, CASE WHEN -b.m >= 10 * v.n THEN -b.m END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
    walk AS (SELECT word, coalesce(form, word) AS last, 0 AS d FROM f UNION ALL SELECT w.word, f.form, d + 1 FROM walk w JOIN f ON f.word = w.last WHERE f.form IS NOT NULL),
    root AS (SELECT word, arg_max(last, d) AS root FROM walk GROUP BY word)
    SELECT f.word, form, root, n, n_near, form_n FROM f JOIN root ON root.word = f.word""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldhush.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_differencing_shards")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldhush.llm.sharding import shards

    return shards(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op13_hard_negatives", """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id,
      positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldhush.llm.hard_negatives import hard_negatives, scaled

    v = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = v.select("vec_id", label.alias("label"), scaled(F.col("embedding")).alias("embedding"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, "vec_id", "embedding", "label")
