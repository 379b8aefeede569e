"""Hard negatives by anchor spanning-tree bounds.

Anchors that point the same way are put into blocks of bounded size, and each block gets a minimum spanning tree over
the distances of its anchors. For a candidate x and an anchor a with the parent p,

    score(p, x) - |a - p| |x|  <=  score(a, x)  <=  score(p, x) + |a - p| |x|,

so a candidate's interval at the parent, widened by edge distance times candidate norm, holds its score at the child.
Only candidates whose interval overlaps the anchor's window are scored again; their interval becomes the score itself,
the others hand the wider interval on. The root's parent is the origin, where every score is 0. A window starts wide and
closes as better candidates are found. The bounds never rule out a candidate of the result, so results are exact; how much they
save depends on how near the anchors of a block are to each other.

All rows meet all anchors, which is what the search asks for, but in cells: a block of anchors with some packed chunks of
rows. A cell has a bounded size and returns at most a few rows for each of its anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldhush.operators.blocks import number_rows
from fieldhush.sources.scratch import materialize

ANCHORS, CHUNK_ROWS, CELL_ROWS = 512, 2048, 1 << 14
SKETCH_BITS = 24
#: The bounds are computed in doubles; so much is added to each, relative to its size.
SLACK = 1e-9
NONE = np.iinfo(np.int64).min


def _pack(vectors: list[np.ndarray], dim: int) -> bytes:
    """Vectors padded with zeros to ``dim`` components, in the smallest integer type that holds them."""
    x = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    for t in (np.int16, np.int32):
        if not x.size or (np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max):
            return x.astype(t).tobytes()
    return x.tobytes()


def _unpack(data: bytes, n: int, dim: int) -> np.ndarray:
    width = len(data) // max(n * dim, 1)
    return np.frombuffer(data, {2: np.int16, 4: np.int32}.get(width, np.int64), count=n * dim).reshape(n, dim).astype(np.int64)


def _chunks(dim: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                b = batch.slice(at, CHUNK_ROWS)
                vec, flat = b.column("vec"), np.asarray(b.column("vec").flatten(), np.int64)
                ends = np.cumsum(np.asarray(vec.value_lengths(), np.int64))
                rows = np.asarray(b.column("row"), np.int64)
                yield pa.RecordBatch.from_pydict({
                    "first": [int(rows[0])], "size": [b.num_rows], "rows": [rows.tobytes()], "ids": [np.asarray(b.column("id"), np.int64).tobytes()],
                    "labels": [np.asarray(b.column("label"), np.int64).tobytes()], "vectors": [_pack(np.split(flat, ends[:-1]), dim)]})

    return pack


def _directions(dim: int, seed: int):
    """Signs against fixed random directions: vectors that point the same way share their leading bits."""

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = np.random.default_rng(seed).standard_normal((SKETCH_BITS, dim))
        for f in frames:
            x = np.zeros((len(f), dim))
            for i, v in enumerate(f["vec"]):
                x[i, : len(v)] = v
            f["sketch"] = (x @ planes.T > 0) @ (1 << np.arange(SKETCH_BITS, dtype=np.int64)[::-1])
            yield f

    return sketch


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): a minimum spanning tree over the rows of ``x``, in an order of never falling depth.

    ``parent`` holds places in that order, -1 for the root; ``edge`` is the distance to the parent, or from the origin.
    """
    x = x.astype(float)
    n = len(x)
    sq = (x * x).sum(1)
    d = np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0)
    root = int(np.argmin(d.sum(1)))
    near, by, depth, parent = d[root].copy(), np.full(n, root), np.zeros(n, int), np.full(n, -1)
    near[root], out = np.inf, np.ones(n, bool)
    out[root] = False
    for _ in range(n - 1):
        i = int(np.argmin(np.where(out, near, np.inf)))
        if not out[i]:  # distances that overflow are infinite, any node will do
            i = int(np.flatnonzero(out)[0])
        out[i], parent[i], depth[i] = False, by[i], depth[by[i]] + 1
        closer = d[i] < near
        near[closer], by[closer] = d[i][closer], i
    order = np.argsort(depth, kind="stable")
    place = np.empty(n, int)
    place[order] = np.arange(n)
    above = parent[order]
    edge = np.sqrt(((x[order] - np.where((above >= 0)[:, None], x[above], 0.0)) ** 2).sum(1))
    return order, np.where(above >= 0, place[above], -1), edge


def _trees(dim: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__pos")
        x = _unpack(_pack([np.asarray(v, np.int64) for v in pdf["vec"]], dim), len(pdf), dim)
        order, parent, edge = spanning_tree(x)
        return pd.DataFrame({
            "block": [int(pdf["block"].iloc[0])], "size": [len(pdf)], "rows": [pdf["row"].to_numpy(np.int64)[order].tobytes()], "ids": [pdf["id"].to_numpy(np.int64)[order].tobytes()],
            "labels": [pdf["label"].to_numpy(np.int64)[order].tobytes()], "vectors": [_pack(list(x[order]), dim)],
            "parents": [parent.astype(np.int64).tobytes()], "edges": [edge.tobytes()]})

    return build


class Tree:
    """A block of anchors in tree order, and the scores that their windows ask for."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, x: np.ndarray, parent: np.ndarray, edge: np.ndarray):
        self.rows, self.labels, self.x, self.parent, self.edge = rows, labels, x, parent, edge
        depth = np.zeros(len(x), int)
        for i in range(len(x)):
            depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 0
        self.levels = np.split(np.arange(len(x)), np.flatnonzero(np.diff(depth)) + 1)
        self.length = np.sqrt((x.astype(float) ** 2).sum(1)).max(initial=0.0)
        self.scored = 0

    def scan(self, x: np.ndarray, allowed, lowest: np.ndarray, highest: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, candidates, their scores) inside ``lowest`` .. ``highest``; ``allowed(anchors)`` is a mask anchors x candidates."""
        norms = np.sqrt((x.astype(float) ** 2).sum(1))
        most = self.length * norms.max(initial=0.0)
        if most >= 2.0**63:
            raise OverflowError("an inner product does not fit 64 bits")
        exact = most < 2.0**52  # then products and sums of doubles are exact, and so are the bounds up to SLACK
        lo, hi = np.empty((len(self.x), len(x))), np.empty((len(self.x), len(x)))
        xf = x.astype(float) if exact else x
        af = self.x.astype(float) if exact else self.x
        for level in self.levels:
            need = allowed(level)
            if exact:
                wide = self.edge[level][:, None] * norms[None, :] * (1 + SLACK) + SLACK
                at = self.parent[level]
                low, high = (lo[at] - wide, hi[at] + wide) if at[0] >= 0 else (-wide, wide)
                need = need & (high >= lowest[level][:, None]) & (low <= highest[level][:, None])
            cols, picked = np.flatnonzero(need.any(0)), np.flatnonzero(need.any(1))
            if len(cols):
                s = af[level[picked]] @ xf[cols].T
                mask = need[np.ix_(picked, cols)]
                self.scored += int(mask.sum())
                if exact:
                    at = np.ix_(picked, cols)
                    low[at], high[at] = np.where(mask, s, low[at]), np.where(mask, s, high[at])
                whole = np.rint(s).astype(np.int64) if exact else s
                for i, a in enumerate(level[picked]):
                    hit = mask[i] & (whole[i] >= lowest[a]) & (whole[i] <= highest[a])
                    if hit.any():
                        yield int(a), cols[hit], whole[i][hit]
            if exact:
                lo[level], hi[level] = low, high


def _best(score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by falling score, then rising key."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= cut)
        return keep[np.lexsort((key[keep], -score[keep]))[:k]]
    return np.lexsort((key, -score))[:k]


def _read_tree(r, dim: int) -> Tree:
    n = int(r["size"])
    return Tree(np.frombuffer(r["rows"], np.int64), np.frombuffer(r["labels"], np.int64), _unpack(r["vectors"], n, dim),
                np.frombuffer(r["parents"], np.int64), np.frombuffer(r["edges"]))


def _read_chunks(chunks: pd.DataFrame, dim: int):
    for c in chunks.sort_values("first").to_dict("records"):
        yield (np.frombuffer(c["rows"], np.int64), np.frombuffer(c["ids"], np.int64), np.frombuffer(c["labels"], np.int64), _unpack(c["vectors"], int(c["size"]), dim))


def _positives(dim: int, k: int):
    """Each anchor's first ``k`` other rows of its label within a cell."""

    def find(trees: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in trees.to_dict("records"):
            t = _read_tree(r, dim)
            n = len(t.x)
            lowest, highest = np.full(n, NONE), np.full(n, np.iinfo(np.int64).max)
            best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * n
            for rows, ids, labels, x in _read_chunks(chunks, dim):
                allowed = lambda a: (t.labels[a][:, None] == labels[None, :]) & (t.rows[a][:, None] != rows[None, :])  # noqa: B023, E731
                for a, cols, s in t.scan(x, allowed, lowest, highest):
                    s, i = np.concatenate([best[a][0], s]), np.concatenate([best[a][1], ids[cols]])
                    top = _best(s, i, k)
                    best[a] = s[top], i[top]
                    if len(top) == k:
                        lowest[a] = s[top[-1]]
            size = [len(b[0]) for b in best]
            out.append(pd.DataFrame({"block": int(r["block"]), "anchor": np.repeat(t.rows, size), "score": np.concatenate([b[0] for b in best]), "id": np.concatenate([b[1] for b in best])}))
        return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in ("block", "anchor", "score", "id")})

    return find


def _negatives(dim: int, k: int, low: int, high: int):
    """For each anchor and positive, the first ``k`` rows of other labels in the positive's window within a cell."""

    def find(trees: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in trees.to_dict("records"):
            t = _read_tree(r, dim)
            n = len(t.x)
            windows: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
            place = {int(a): i for i, a in enumerate(t.rows)}
            for p in r["positives"]:
                s = int(p["score"])
                windows[place[int(p["anchor"])]].append((int(p["rank"]), -(-low * s // 100), high * s // 100))
            nothing = np.iinfo(np.int64).max
            best = {(a, w[0]): (np.empty(0, np.int64), np.empty(0, np.int64)) for a in range(n) for w in windows[a]}
            floor = {(a, rank): lo for a in range(n) for rank, lo, _ in windows[a]}
            lowest = np.array([min((lo for _, lo, _ in w), default=nothing) for w in windows], np.int64)
            highest = np.array([max((hi for _, _, hi in w), default=NONE) for w in windows], np.int64)
            for _, ids, labels, x in _read_chunks(chunks, dim):
                allowed = lambda a: t.labels[a][:, None] != labels[None, :]  # noqa: B023, E731
                for a, cols, s in t.scan(x, allowed, lowest, highest):
                    order = np.lexsort((ids[cols], -s))
                    s, i = s[order], ids[cols][order]
                    for rank, lo, hi in windows[a]:
                        at = int(np.searchsorted(-s, -hi, "left"))  # the first score that is not above the window
                        new, new_ids = s[at : at + k], i[at : at + k]
                        new_ids, new = new_ids[new >= floor[a, rank]], new[new >= floor[a, rank]]
                        if len(new):
                            got = best[a, rank]
                            new, new_ids = np.concatenate([got[0], new]), np.concatenate([got[1], new_ids])
                            top = _best(new, new_ids, k)
                            best[a, rank] = new[top], new_ids[top]
                            if len(top) == k:
                                floor[a, rank] = int(new[top[-1]])
                    lowest[a] = min(floor[a, w[0]] for w in windows[a])
            keys, size = list(best), [len(b[0]) for b in best.values()]
            out.append(pd.DataFrame({
                "anchor": np.repeat([t.rows[a] for a, _ in keys], size), "rank": np.repeat([k_ for _, k_ in keys], size),
                "score": np.concatenate([b[0] for b in best.values()] or [np.empty(0, np.int64)]), "id": np.concatenate([b[1] for b in best.values()] or [np.empty(0, np.int64)])}))
        return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in ("anchor", "rank", "score", "id")})

    return find


def hard_negatives(rows: DataFrame, anchor: Column, key: str = "id", vector: str = "vector", label: str = "label", positives: int = 5, negatives: int = 5,
                   low: int = 80, high: int = 100, seed: int = 0, anchors: int = ANCHORS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (all long but rank, an int).

    ``vector`` holds integers, ``anchor`` is a condition on ``rows``. Higher scores come first, ties by smaller key. A positive's window
    is low% .. high% of its score. Rows with a null key, label or vector, or a null component, take no part; a shorter vector counts as
    padded with zeros. Repeated rows are rows of their own: each is a candidate, and each repeated anchor gives its results.
    A window may be empty: an anchor, positive or rank that has nothing to return has no row. An empty table gives an empty result.
    Scores that do not fit 64 bits raise OverflowError.
    """
    v = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<long>").alias("vec"),
                    F.coalesce(anchor, F.lit(False)).alias("anchor"))
    v = v.filter("id is not null and label is not null and vec is not null and not exists(vec, x -> x is null)").withColumn("row", F.monotonically_increasing_id())
    v = materialize(v, "vectors")
    n, dim, n_anchors = v.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.count_if("anchor")).first()
    dim = max(dim, 1)
    across, down = -(-max(n_anchors, 1) // anchors), -(-max(n, 1) // cell_rows)

    packed = "size long, rows binary, ids binary, labels binary, vectors binary"
    chunks = v.select("row", "id", "label", "vec").mapInArrow(_chunks(dim), f"first long, {packed}")
    chunks = materialize(chunks.withColumn("down", F.pmod(F.xxhash64("first"), F.lit(down)).cast("int")), "chunks")

    picked = v.filter("anchor").select("row", "id", "label", "vec").mapInPandas(_directions(dim, seed), "row long, id long, label long, vec array<long>, sketch long")
    placed = number_rows(picked, [], ["sketch", "id", "row"]).withColumn("block", F.expr(f"cast(__pos div {anchors} as int)"))
    trees = materialize(placed.groupBy("block").applyInPandas(_trees(dim), f"block int, {packed}, parents binary, edges binary"), "trees")

    # A cell is a block of anchors and the chunks of one slice of the rows: each side is sent once for every slice of the other.
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = chunks.withColumn("block", every(across)).groupBy("block", "down")
    cells = lambda t: t.withColumn("down", every(down)).groupBy("block", "down").cogroup(right)
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))

    pos = cells(trees).applyInPandas(_positives(dim, positives), "block int, anchor long, score long, id long")
    pos = materialize(pos.withColumn("rank", place("anchor")).filter(F.col("rank") <= positives), "positives")
    # At most ``anchors`` x ``positives`` entries in a block.
    of_block = pos.groupBy("block").agg(F.collect_list(F.struct("anchor", "rank", "score")).alias("positives"))
    asked = materialize(trees.join(of_block, "block"), "windows")
    neg = cells(asked).applyInPandas(_negatives(dim, negatives, low, high), "anchor long, rank int, score long, id long")
    neg = neg.withColumnRenamed("rank", "of").withColumn("rank", place("anchor", "of")).filter(F.col("rank") <= negatives)
    ids = v.filter("anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    pos = pos.select("anchor", F.col("rank").alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = neg.join(pos, ["anchor", "of"]).join(ids, "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component as a long; null where a component is null, infinite or not a number."""
    x = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~bad, F.transform(x, lambda c: F.floor(F.lit(factor) * c)))
