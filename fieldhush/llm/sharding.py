"""Sharding by Karmarkar-Karp differencing: shards of nearly equal bytes from groups that must stay whole.

A partial partition is a sum for each shard. Differencing takes the two partial partitions with the largest spread (largest sum
less smallest) again and again and adds them in opposite order, the largest of one on the smallest of the other,
until one is left.

That loop is sequential, so it runs on many items only in parts: items of similar size meet in buckets of bounded count, a bucket is
differenced into as many nearly equal bundles as there are shards, and bundles are the items of the next level. Items that are heavy for
a whole shard are never bundled, so a group with a third of all bytes meets bundles at the last level, where they fill the other
shards beside it. The last level is one bounded set of items, whatever the table's size.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhush.operators.blocks import number_rows
from fieldhush.sources.scratch import materialize, sized

BUCKET_ITEMS, LAST_ITEMS = 4096, 1 << 15


def difference(weights: list[int], parts: int) -> list[int]:
    """The part (0 to parts - 1) of each item of positive weight. Part 0 has the largest sum, and so on."""
    # A partial partition lists its non-empty slots by falling sum; what a slot holds is an item or a pair of such.
    heap = [(-w, i, [(w, i)]) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    for tick in range(len(weights), 2 * len(weights) - 1):
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = a + [(0, None)] * (parts - len(a))
        for k, (w, held) in enumerate(b, 1):
            w0, there = both[-k]
            both[-k] = (w0 + w, held if there is None else (there, held))
        both = sorted((s for s in both if s[1] is not None), key=lambda s: -s[0])
        least = both[-1][0] if len(both) == parts else 0
        heapq.heappush(heap, (least - both[0][0], tick, both))
    part = [0] * len(weights)
    for p, (_, held) in enumerate(heap[0][2] if heap else []):
        todo = [held]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            else:
                part[x] = p
    return part


def _differenced(parts: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "item"], ascending=[False, True])
        return pd.DataFrame({"item": pdf["item"].to_numpy(), "weight": pdf["weight"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "part": difference(pdf["weight"].tolist(), parts)})

    return run


def partition(items: DataFrame, parts: int, bucket_items: int = BUCKET_ITEMS, last_items: int = LAST_ITEMS) -> DataFrame:
    """(item, part) for ``items`` (item, a unique long; weight, a positive long): parts 0 to ``parts`` - 1 of nearly equal weight.

    No items give no rows. With fewer items than parts, parts stay empty.
    """
    if bucket_items <= parts or last_items <= 2 * bucket_items:
        raise ValueError("a bucket must hold more items than there are parts, and the last level more than two buckets")
    schema = "item long, weight long, bucket long, part int"
    level = materialize(items.select("item", "weight"), "items")
    n, total = level.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    # At most last_items / 2 items can be as heavy as this, whatever their sizes.
    heavy = -(-2 * total // last_items)
    steps = []
    while n > last_items:
        light = level.filter(F.col("weight") < heavy)
        placed = number_rows(light, [], [F.desc("weight"), "item"]).select("item", "weight", F.expr(f"__pos div {bucket_items}").alias("bucket"))
        met = materialize(placed.groupBy("bucket").applyInPandas(_differenced(parts), schema), "bundled")
        # Bundles get negative names below all earlier ones, so that they cannot meet an item's.
        low = min(level.agg(F.min("item")).first()[0], 0)
        bundle = F.lit(low - 1) - (F.col("bucket") * parts + F.col("part"))
        steps.append(met.select("item", bundle.alias("bundle")))
        bundles = met.groupBy(bundle.alias("item")).agg(F.sum("weight").alias("weight"))
        last, level = n, materialize(bundles.unionByName(level.filter(F.col("weight") >= heavy)), "items")
        n = level.count()
        if n >= last:
            raise RuntimeError("bundling does not reduce the items")
    one = level.withColumn("bucket", F.lit(0).cast("long"))
    where = materialize(one.groupBy("bucket").applyInPandas(_differenced(parts), schema).select("item", "part"), "parts")
    for step in reversed(steps):
        inside = step.join(sized(where.withColumnRenamed("item", "bundle")), "bundle").select("item", "part")
        where = materialize(where.join(step.select(F.col("bundle").alias("item")).distinct(), "item", "left_anti").unionByName(inside), "parts")
    return where


def shards(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """A row per document: key, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null), text_sha256.

    Size is the text's UTF-8 bytes plus 1. Documents of equal texts stay together, so a shard can be larger than an even share only where one such
    group is. Texts are compared by length and SHA-256. A null text is an empty one, a null key is a key like others, and repeated rows are
    documents each. Slots count a shard's documents from 0 in the order of keys. An empty table gives an empty result.
    """
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = materialize(docs.select(F.col(f"`{key}`").alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
                                   F.sha2(raw, 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "texts")
    groups = rows.groupBy("text_sha256", "size").agg(F.count("*").alias("n"), F.min("row").alias("item"))
    groups = materialize(groups.select("text_sha256", "item", "n", (F.col("n") * F.col("size")).alias("weight")), "groups")
    where = sized(partition(groups, n_shards, **options))
    # A text that stands alone finds its shard by its row; only repeated texts meet by text, where the planner splits large groups.
    alone = rows.join(where, F.col("row") == F.col("item")).drop("item")
    repeated = groups.filter("n > 1")
    others = rows.join(sized(repeated.join(where, "item").select("text_sha256", F.col("item").alias("first"), "part")), "text_sha256").filter(F.col("row") != F.col("first")).drop("first")
    placed = number_rows(alone.unionByName(others), ["part"], ["id", "row"])
    placed = materialize(placed, "placed")
    # One row per shard.
    start = placed.groupBy("part").agg(F.min("__pos").alias("start"))
    return placed.join(F.broadcast(start), "part").select(
        F.col("id").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("part").cast("int").alias("shard"), (F.col("__pos") - F.col("start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "text_sha256")
