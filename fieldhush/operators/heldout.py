"""Logistic models of many training sets at once: leave one group out, or fit each group alone.

Every group (a recorder-day, a site, a fold) gives blocks of sums: its rows' Gram matrices and gradients for each class. A
training set is all groups less one, so its blocks are the total less the group's own; means, deviations, principal
components, class weights and the Newton matrix of a fit all come from these small blocks. Rows are read once for the Gram blocks and
then once for each iteration, in which all models see them together: one matrix product of rows and models in a task,
one sum for each model between the tasks. The number of jobs does not depend on the number of groups.

All fits start from the model of all rows. Its Newton matrix less the group's own block serves the group's fit as long as steps get shorter
fast, which they do where models differ by one group only; otherwise the pass also sums that model's matrix at its own point.
Gradients are exact, so the fits end where separate fits would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhush.operators.blocks import number_rows
from fieldhush.sources.scratch import materialize, sized

CHUNK_ROWS, MODELS = 1024, 512
TINY = 1e-9


def _sum_vectors(rows: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Element-wise sums of an array column; tasks send one vector for each key."""
    s = Summarizer.metrics("sum").summary(array_to_vector(F.col(value))).alias("s")
    return rows.groupBy(*by).agg(s).select(*by, vector_to_array("s.sum").alias(value))


def _chunks(df: DataFrame, group: str, label: str, features: str) -> tuple[DataFrame, DataFrame, int]:
    """(chunks, groups, number of features): rows of one group packed together, and the numbers of the groups."""
    names = df.filter(F.col(group).isNotNull()).select(F.col(group).alias("grp")).distinct()
    groups = materialize(number_rows(names, [], ["grp"]).select("grp", F.col("__pos").alias("g")), "groups")
    rows = df.select(F.col(group).alias("grp"), F.col(label).cast("int").alias("y"), F.transform(F.col(features), lambda x: x.cast("double")).alias("x")).filter("y is not null and x is not null")
    rows = rows.join(sized(groups), "grp").select("g", "y", "x")
    rows = rows.repartitionByRange("g", F.xxhash64("x")).sortWithinPartitions("g")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, y = np.asarray(b.column("g")), np.asarray(b.column("y"), np.int8)
            x = np.asarray(b.column("x").flatten(), np.float64).reshape(len(g), -1) if len(g) else None
            for run in np.split(np.arange(len(g)), np.flatnonzero(np.diff(g)) + 1) if len(g) else []:
                for at in range(0, len(run), CHUNK_ROWS):
                    i = run[at : at + CHUNK_ROWS]
                    yield pa.RecordBatch.from_pydict({"g": [int(g[i[0]])], "y": [y[i].tobytes()], "x": [x[i].tobytes()]})

    chunks = materialize(rows.mapInArrow(pack, "g long, y binary, x binary"), "chunks")
    width = chunks.agg(F.max(F.expr("length(x) div (8 * length(y))"))).first()[0] or 0
    return chunks, groups, width


def _unpacked(y: bytes, x: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    y = np.frombuffer(y, np.int8).astype(float)
    return y, np.hstack([np.ones((len(y), 1)), np.frombuffer(x).reshape(len(y), width)])


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -700, 700)))


def _blocks(chunks: DataFrame, width: int, beta: np.ndarray | None) -> DataFrame:
    """(g, c, v) for each group and class: the Gram matrix without ``beta``; with it, the gradient and then the Newton matrix."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for f in frames:
            for r in f.itertuples():
                y, x = _unpacked(r.y, r.x, width)
                for c in (0, 1):
                    z = x[y == c]
                    if not len(z):
                        continue
                    if beta is None:
                        v = (z.T @ z).ravel()
                    else:
                        p = _sigmoid(z @ beta)
                        v = np.concatenate([(c - p) @ z, ((z * (p * (1 - p))[:, None]).T @ z).ravel()])
                    key = (int(r.g), c)
                    held[key] = held[key] + v if key in held else v
                if len(held) > 64:  # rows come in the order of groups, so only the last ones can go on
                    yield pd.DataFrame([(g, c, v) for (g, c), v in held.items()], columns=["g", "c", "v"])
                    held = {}
        if held:
            yield pd.DataFrame([(g, c, v) for (g, c), v in held.items()], columns=["g", "c", "v"])

    return _sum_vectors(chunks.mapInPandas(run, "g long, c int, v array<double>"), ["g", "c"])


def _total(blocks: DataFrame) -> dict[int, np.ndarray]:
    """Both classes' sums over all groups: two rows of a size given by the number of features."""
    return {r.c: np.array(r.v) for r in _sum_vectors(blocks, ["c"]).collect()}


def _inverse(space: np.ndarray, newton: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    h = space.T @ newton @ space + np.diag(ridge)
    return np.linalg.pinv(h + np.eye(len(h)) * TINY * max(np.trace(h), TINY) / len(h))


class _Space:
    """What the Gram blocks of a training set say: class weights, and the map from scaled components to features."""

    def __init__(self, gram: dict[int, np.ndarray], width: int, pca: int | None, balanced: bool, reg: float, plain: int = 0):
        d = width + 1
        m = {c: np.asarray(gram[c]).reshape(d, d) if c in gram else np.zeros((d, d)) for c in (0, 1)}
        self.n = {c: m[c][0, 0] for c in (0, 1)}
        n = self.n[0] + self.n[1]
        self.usable = min(self.n.values()) > 0.5
        self.weight = {c: n / (2 * max(self.n[c], 1)) if balanced else 1.0 for c in (0, 1)}
        whole = m[0] + m[1]
        mean = whole[0, 1:] / max(n, 1)
        cov = (whole[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1)
        std = np.sqrt(np.maximum(np.diag(cov), 0))
        scale = np.where(std > TINY * np.maximum(np.abs(mean), 1), 1 / np.where(std > 0, std, 1), 0.0)
        a = np.diag(scale)
        if pca:
            value, vector = np.linalg.eigh((cov * np.outer(scale, scale))[plain:, plain:])
            top = np.argsort(-value, kind="stable")[:pca]
            spread = np.sqrt(np.maximum(value[top], 0))
            parts = vector[:, top] * np.where(spread > TINY, 1 / np.where(spread > 0, spread, 1), 0.0)
            a = np.hstack([a[:, :plain], a[:, plain:] @ parts])
        # Column 0 is the intercept; the others are centred.
        self.map = np.vstack([np.hstack([[1.0], -mean @ a]), np.hstack([np.zeros((width, 1)), a])])
        self.ridge = np.full(self.map.shape[1], reg * (self.weight[0] * self.n[0] + self.weight[1] * self.n[1]))
        self.ridge[0] = 0

    def inverse(self, newton: dict[int, np.ndarray]) -> np.ndarray:
        d = len(self.map)
        return _inverse(self.map, sum((self.weight[c] * np.asarray(newton[c]).reshape(d, d) for c in newton), np.zeros((d, d))), self.ridge)

    def step(self, inverse: np.ndarray, gamma: np.ndarray, gradient: dict[int, np.ndarray]) -> np.ndarray:
        return inverse @ (self.map.T @ sum(self.weight[c] * np.asarray(gradient[c]) for c in gradient) - self.ridge * gamma)


def _packed(models: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"batch": models["batch"].iloc[:1], "ids": [models["g"].to_numpy(np.int64).tobytes()], "betas": [np.vstack(list(models["beta"])).tobytes()],
                         "stale": [models["stale"].to_numpy(bool).tobytes()]})


def _gradients(chunks: DataFrame, models: DataFrame, width: int, only: bool) -> DataFrame:
    """(g, v): for each model the gradients of both classes over its training rows; for a stale one also both Newton matrices.

    ``models`` (batch, ids, betas, stale) holds up to ``MODELS`` models in a row.
    """
    d = width + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]] = {}
        for f in frames:
            if len(held) > 16:
                yield from flush(held)
                held = {}
            for r in f.itertuples():
                y, x = _unpacked(r.y, r.x, width)
                ids, b = np.frombuffer(r.ids, np.int64), np.frombuffer(r.betas).reshape(-1, d)
                use = np.flatnonzero(ids == r.g) if only else np.flatnonzero(ids != r.g)
                if r.batch not in held:
                    held[r.batch] = ids, np.zeros((len(ids), 2, d)), {int(m): np.zeros((2, d, d)) for m in np.flatnonzero(np.frombuffer(r.stale, bool))}
                if not len(use):
                    continue
                p, (_, sums, full) = _sigmoid(x @ b[use].T), held[r.batch]
                for c in (0, 1):
                    z, q = x[y == c], p[y == c]
                    sums[use, c] += (c - q).T @ z
                    for at, m in enumerate(use):
                        if int(m) in full:
                            full[int(m)][c] += (z * (q[:, at] * (1 - q[:, at]))[:, None]).T @ z
        yield from flush(held)

    def flush(held: dict) -> Iterator[pd.DataFrame]:
        for ids, sums, full in held.values():
            yield pd.DataFrame({"g": ids, "v": [np.concatenate([sums[m].ravel(), full[m].ravel()]) if m in full else sums[m].ravel() for m in range(len(ids))]})

    last = models.agg(F.max("batch")).first()[0]
    batch = F.expr(f"g div {MODELS}") if only else F.explode(F.sequence(F.lit(0), F.lit(last)).cast("array<long>"))
    pairs = chunks.withColumn("batch", batch).join(models, "batch")
    return _sum_vectors(pairs.select("batch", "g", "y", "x", "ids", "betas", "stale").mapInPandas(run, "g long, v array<double>"), ["g"])


def fit_groups(df: DataFrame, group: str, label: str, features: str, pca: int | None = None, reg: float = 0.01, balanced: bool = True, only: bool = False,
               plain: int = 0, tol: float = 1e-7, rounds: int = 60) -> DataFrame:
    """(group, intercept, coefficients, n_train, pos_train): a model for each group, of all other groups, or with ``only`` of the group alone.

    Features are standardised, those after the first ``plain`` are optionally replaced by ``pca`` components that are standardised again, and fitted by logistic regression with
    the penalty ``reg`` / 2 x |coefficients|^2 for the mean loss; everything is learned on the training rows. ``balanced`` gives both classes the same weight.
    ``label`` is 0 or 1, ``features`` an array of equal length in all rows; rows with a null label, group or array take no part. A training set without
    both classes has a null model. Raises RuntimeError where a fit has not converged after ``rounds`` iterations.
    """
    chunks, groups, width = _chunks(df, group, label, features)
    d = width + 1
    kind = dict(df.dtypes)[group]
    empty = f"`{group}` {kind}, intercept double, coefficients array<double>, n_train long, pos_train long"
    gram = materialize(_blocks(chunks, width, None), "gram")
    total = _total(gram)
    if not total:
        return df.sparkSession.createDataFrame([], empty)
    base = _Space(total, width, pca, balanced, reg, plain)
    gamma = np.zeros(base.map.shape[1])
    if base.usable:
        for _ in range(rounds):
            sums = _total(_blocks(chunks, width, base.map @ gamma))
            step = base.step(base.inverse({c: v[d:] for c, v in sums.items()}), gamma, {c: v[:d] for c, v in sums.items()})
            # Far from the solution a Newton step can overshoot; scaled steps of bounded length cannot run away.
            gamma = gamma + step * min(1.0, 4 / max(np.abs(step).max(), TINY))
            if np.abs(step).max() < tol:
                break
    beta = base.map @ gamma
    newton = materialize(_blocks(chunks, width, beta), "newton")
    sums = {c: v[d:] for c, v in _total(newton).items()}

    def own(blocks: DataFrame, name: str) -> DataFrame:
        return blocks.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias(name))

    spaces = materialize(own(gram, "gram").join(own(newton.select("g", "c", F.slice("v", d + 1, d * d).alias("v")), "newton"), "g"), "spaces")

    def trained(mine, whole: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        mine = {int(c): np.asarray(v) for c, v in dict(mine).items()}
        return mine if only else {c: v - mine[c] if c in mine else v for c, v in whole.items()}

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                s = _Space(trained(r.gram, total), width, pca, balanced, reg, plain)
                n, pos = round(s.n[0] + s.n[1]), round(s.n[1])
                if not s.usable:
                    out.append((r.g, n, pos, None, None, None, None, None, None))
                    continue
                h = trained(r.newton, sums)
                c0 = np.linalg.lstsq(s.map, beta, rcond=None)[0] if base.usable else np.zeros(s.map.shape[1])
                out.append((r.g, n, pos, s.map.ravel(), [s.weight[0], s.weight[1]], s.ridge, s.inverse(h).ravel(), c0, s.map @ c0))
            yield pd.DataFrame(out, columns=["g", "n", "pos", "map", "weight", "ridge", "inverse", "gamma", "beta"])

    fields = "g long, n long, pos long, map array<double>, weight array<double>, ridge array<double>, inverse array<double>, gamma array<double>, beta array<double>"
    fixed = materialize(spaces.mapInPandas(start, fields), "fits")
    state = fixed.select("g", "inverse", "gamma", "beta", F.lit(None).cast("double").alias("size"), F.lit(only).alias("stale"), F.lit(False).alias("done")).filter("beta is not null")
    fixed = fixed.drop("inverse", "gamma", "beta")

    def move(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                a = np.asarray(r.map).reshape(d, -1)
                k = a.shape[1]
                g0, v, h, ridge = np.asarray(r.gamma), np.asarray(r.v), np.asarray(r.inverse).reshape(k, k), np.asarray(r.ridge)
                if r.stale:
                    new = v[2 * d :].reshape(2, d, d)
                    h = _inverse(a, r.weight[0] * new[0] + r.weight[1] * new[1], ridge)
                step = h @ (a.T @ (r.weight[0] * v[:d] + r.weight[1] * v[d : 2 * d]) - ridge * g0)
                size = float(np.abs(step).max())
                g1 = g0 + step * min(1.0, 4 / max(size, TINY))
                # Where steps do not get much shorter, the Newton matrix is made anew at every further point.
                out.append((r.g, h.ravel(), g1, a @ g1, size, r.stale or (r.size is not None and size > 0.3 * r.size), size < tol))
            yield pd.DataFrame(out, columns=["g", "inverse", "gamma", "beta", "size", "stale", "done"])

    moved = "g long, inverse array<double>, gamma array<double>, beta array<double>, size double, stale boolean, done boolean"
    ready = None
    for _ in range(rounds):
        state = materialize(state, "state")
        finished = state.filter("done")
        ready = finished if ready is None else ready.unionByName(finished)
        state = state.filter("not done")
        if state.isEmpty():
            break
        # Models are packed by number; a batch is a bounded matrix.
        packed = state.withColumn("batch", F.expr(f"g div {MODELS}")).groupBy("batch").applyInPandas(_packed, "batch long, ids binary, betas binary, stale binary")
        grads = _gradients(chunks, sized(packed), width, only)
        state = state.join(grads, "g").join(fixed, "g").mapInPandas(move, moved)
    else:
        raise RuntimeError(f"{state.count()} of the fits have not converged after {rounds} iterations")
    out = fixed.select("g", "n", "pos").join(ready.select("g", "beta"), "g", "left").join(groups, "g")
    return out.select(F.col("grp").alias(group), F.col("beta")[0].alias("intercept"), F.slice("beta", 2, max(width, 1)).alias("coefficients"), F.col("n").alias("n_train"), F.col("pos").alias("pos_train"))


def held_out_scores(df: DataFrame, models: DataFrame, group: str, features: str, out: str = "score") -> DataFrame:
    """``df`` with the score of each row by the model of its own group, null without one."""
    m = sized(models.select(F.col(group).alias("__g"), "intercept", "coefficients"))
    return _scored(df.join(m, F.col(group) == F.col("__g"), "left"), features, out).drop("__g", "intercept", "coefficients")


def all_scores(df: DataFrame, models: DataFrame, group: str, features: str, model: str = "model", out: str = "score") -> DataFrame:
    """Rows x models: each row scored by every model that there is; ``model`` is the model's group. For few models."""
    m = models.filter("intercept is not null").select(F.struct(F.col(group).alias("g"), "intercept", "coefficients").alias("m"))
    # One row that holds all models; its size is the number of models times the number of features.
    rows = df.crossJoin(F.broadcast(materialize(m.agg(F.collect_list("m").alias("__m")), "models"))).withColumn("__m", F.explode("__m"))
    rows = rows.select(*df.columns, F.col("__m.g").alias(model), "__m.intercept", "__m.coefficients")
    return _scored(rows, features, out).drop("intercept", "coefficients")


def _scored(rows: DataFrame, features: str, out: str) -> DataFrame:
    s = F.aggregate(F.zip_with(F.col(features), F.col("coefficients"), lambda a, b: a.cast("double") * b), F.col("intercept"), lambda a, b: a + b)
    return rows.withColumn(out, 1 / (1 + F.exp(-s)))


def usable_groups(df: DataFrame, group: str, label: str, least: int = 3) -> DataFrame:
    """(group, n_pos, n_neg) of the groups with at least ``least`` rows of each class."""
    g = df.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    return g.filter((F.col("n_pos") >= least) & (F.col("n_neg") >= least))
