"""Exact deduplication by deterministic block naming.

Texts are cut into blocks of a fixed number of characters. The distinct blocks of the corpus are sorted and
numbered: a block's number is its name. Then adjacent names are paired, the distinct pairs are sorted and
numbered in turn, and so on until each text has one name. Two texts of one level have equal names exactly if
they are equal, so the identity (level, name) is free of collisions: every name stands for compared content.

The rows of long texts carry 128-bit keys of their blocks instead of the blocks. The table of distinct blocks
shows whether a key stands for one block only; if ever it does not, all keys are made anew with another seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldhush.llm.common import free_name, lower_ascii, slim
from fieldhush.sources.scratch import materialize, sized

BLOCK_CHARS = 4096
KEY_BITS = 64


def _numbered(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows get integers in the order (partition, keys), written so that they never change."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _keys(block: Column, seed: int, bits: int) -> list[Column]:
    mask = (1 << bits) - 1 if bits < 64 else -1
    return [F.xxhash64(F.lit(2 * seed + i), block).bitwiseAND(F.lit(mask)).alias(f"h{i}") for i in (0, 1)]


def identities(docs: DataFrame, carry: list[str], text: str = "text", block_chars: int = BLOCK_CHARS, key_bits: int = KEY_BITS) -> DataFrame:
    """One row per document: ``carry``, row (a unique long), level and name, and text_sha256.

    Equal (level, name) means equal texts after lower-casing A-Z; a null text is an empty one. An empty text has one
    empty block. Repeated rows get an identity each, the same one. An empty table gives an empty table.
    """
    norm = lower_ascii(F.coalesce(F.col(text), F.lit("")))
    source = slim(docs, *dict.fromkeys([*carry, text]))
    cut = F.when(F.col(text).isNull() | (F.col(text) == ""), F.array(F.lit(""))).otherwise(
        F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    for seed in range(64):
        # One parameter only: a second one, even with a default, would get the block's index.
        keyed = F.transform(cut, lambda b: F.struct(*_keys(b, seed, key_bits)))  # noqa: B023 - called at once
        rows = materialize(source.select(*carry, F.sha2(norm.cast("binary"), 256).alias("text_sha256"), keyed.alias("keys"),
                                         F.monotonically_increasing_id().alias("row")), "texts")
        blocks = source.select(F.explode(cut).alias("block")).select("block", *_keys(F.col("block"), seed, key_bits))
        distinct = blocks.groupBy("h0", "h1", "block").agg(F.count("*").alias("n")).drop("n")
        names = materialize(_numbered(distinct, ["h0", "h1", "block"]).select("h0", "h1", "name"), "names")
        if names.groupBy("h0", "h1").count().filter("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("no seed tells all blocks apart")
    nodes = rows.select("row", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key")).select("row", "n", "pos", "key.*")
    nodes = materialize(nodes.join(names, ["h0", "h1"]).select("row", "n", "pos", "name"), "nodes")
    done, level = [], 0
    while True:
        done.append(nodes.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
        rest = nodes.filter("n > 1")
        if rest.isEmpty():
            break
        # The last node of an odd row pairs with nothing (-1, which is no name).
        pairs = rest.groupBy("row", "n", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("b"))
        pairs = materialize(pairs, "pairs")
        names = materialize(_numbered(pairs.groupBy("a", "b").agg(F.count("*").alias("c")).drop("c"), ["a", "b"]), "names")
        nodes = materialize(pairs.join(names, ["a", "b"]).select("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name"), "nodes")
        level += 1
    ids = done[0]
    for d in done[1:]:
        ids = ids.unionByName(d)
    return rows.drop("keys").join(ids, "row")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """One row per document: key, row, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest key stays; of several rows with that key, one. A null key counts as the
    smallest, so it stays only where all keys of the group are null.
    """
    ids = materialize(identities(docs, [key], text, **options), "identities")
    # Only groups of two or more meet the rows again; the planner splits their join where one group is very large.
    groups = ids.groupBy("level", "name").agg(F.count("*").alias("n"), F.max(F.struct(F.col(key).alias("k"), (-F.col("row")).alias("r"))).alias("top"))
    groups = sized(groups.filter("n > 1"))
    out = ids.join(groups, ["level", "name"], "left")
    single = F.col("n").isNull()
    return out.select(
        key, "row", F.when(single, F.col(key)).otherwise(F.col("top.k")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("top.r") == -F.col("row"))).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The rows that stay, with all their columns.

    The rows are written once with a number of their own, which the decision is joined by: only the numbers of
    the removed rows meet the table, and they are broadcast only if their written size allows it.
    """
    row = free_name(docs)
    table = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = exact_groups(table.select(F.col(f"`{text}`").alias("text"), F.struct(F.col(f"`{key}`").alias("k"), F.col(row).alias("r")).alias("id")), "id", "text", **options)
    gone = sized(groups.filter(~F.col("kept")).select(F.col("id.r").alias(row)))
    return table.join(gone, row, "left_anti").drop(row)
