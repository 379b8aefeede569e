"""Fitting and scoring with MLlib under leakage-safe splits, and scores that need no classifier.

Every fit (scaler, PCA, classifier) sees training rows only. Loops run over folds, sites or feature
sets, which are few; the rows of each fit stay distributed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldhush.functions.vectors import cosine, group_vectors, l2_distance
from fieldhush.operators.evaluate import roc_auc
from fieldhush.operators.many_classes import forest_guesses, linear_guesses
from fieldhush.operators.ranks import percentiles
from fieldhush.operators.sampling import hash_rank
from fieldhush.operators.series import row_index
from fieldhush.sources.scratch import materialize, sized

Fit = Callable[[DataFrame], PipelineModel]


def with_vector(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.transform(F.col(array), lambda x: x.cast("double"))))


def balance_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (2 * n of the class): both classes weigh the same."""
    counts = df.groupBy(label).count().collect()  # one row per class
    n, out_w = sum(r["count"] for r in counts), F.lit(None).cast("double")
    for r in counts:
        out_w = F.when(F.col(label).eqNullSafe(F.lit(r[label])), n / (len(counts) * r["count"])).otherwise(out_w)
    return df.withColumn(out, out_w)


def fit_pipeline(train: DataFrame, label: str, classifier, pca: int | None = None, balanced: bool = True,
                 features: str = "features") -> PipelineModel:
    """Standardize, optionally PCA and standardize again, then the classifier; all fitted on ``train``."""
    stages = [StandardScaler(inputCol=features, outputCol="__scaled", withMean=True)]
    last = "__scaled"
    if pca:
        stages += [PCA(k=pca, inputCol=last, outputCol="__pcs"), StandardScaler(inputCol="__pcs", outputCol="__ready", withMean=True)]
        last = "__ready"
    clf = classifier.copy().setFeaturesCol(last).setLabelCol(label)
    rows = train.withColumn(label, F.col(label).cast("double"))
    if balanced:
        rows = balance_weights(rows, label)
        clf = clf.setWeightCol("weight")
    return Pipeline(stages=[*stages, clf]).fit(materialize(rows, "train"))


def score(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    scored = model.transform(df)
    drop = [c for c in scored.columns if c not in df.columns]
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(*[c for c in drop if c != out])


def logistic(**kw) -> LogisticRegression:
    return LogisticRegression(maxIter=kw.pop("maxIter", 50), regParam=kw.pop("regParam", 0.01), **kw)


def boosting(trees: int = 100, depth: int = 3) -> GBTClassifier:
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=42)


def cross_validate(df: DataFrame, fold: str, folds: Sequence[int], fit: Fit, prepare: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """Out-of-fold scores: each fold is scored by a model that never saw it. ``prepare(train, test)`` runs inside the fold."""
    out = None
    for k in folds:
        train, test = df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)
        if prepare:
            train, test = prepare(train, test)
        part = score(fit(train), test)
        out = part if out is None else out.unionByName(part)
    return out


#: From so many classes on, probes are fitted by ``many_classes``. Its forest keeps a class in one chunk, so no class may have more rows than this.
MANY_CLASSES, CLASS_ROWS = 256, 1 << 16


def probe(df: DataFrame, target: str, fold: str, folds: Sequence[int], classifier) -> DataFrame:
    """Held-out predictions of a site or session from the features: rows with ``guess``."""
    index = StringIndexer(inputCol="__t", outputCol="__y", handleInvalid="keep").fit(df.withColumn("__t", F.col(target).cast("string")))
    rows = index.transform(df.withColumn("__t", F.col(target).cast("string")))
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "probe")
    names = F.from_json(F.lit(json.dumps(list(index.labels))), "array<string>")  # one literal, not one for each class
    guesses = _many_class_fit(rows, classifier, len(index.labels) + 1) if len(index.labels) >= MANY_CLASSES else None
    out = None
    for k in folds:
        train, test = rows.filter(F.col(fold) != k), rows.filter(F.col(fold) == k)
        if guesses:
            p = test.join(guesses(train, test), "__row").withColumnRenamed("guess", "prediction")
        else:
            clf = classifier.copy().setFeaturesCol("__scaled").setLabelCol("__y")
            p = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="__scaled", withMean=True), clf]).fit(train).transform(test)
        p = p.withColumn("guess", F.try_element_at(names, F.col("prediction").cast("int") + 1))
        # Written fold by fold: a forest has a count of every class in every node, so no plan may keep the models of all folds.
        p = materialize(p.select(*df.columns, F.col("__t").alias("truth"), "guess"), "guesses")
        out = p if out is None else out.unionByName(p)
    return out


def _many_class_fit(rows: DataFrame, classifier, classes: int) -> Callable[[DataFrame, DataFrame], DataFrame] | None:
    """(train, test) -> (row, guess) of the same classifier made for many classes; None where there is none."""
    if isinstance(classifier, LogisticRegression):
        return lambda train, test: linear_guesses(train, test, "__row", "__y", "features", classes, classifier.getRegParam(), classifier.getMaxIter(), classifier.getTol())
    if isinstance(classifier, RandomForestClassifier) and classifier.getMaxDepth() <= 6:
        if rows.groupBy("__y").count().agg(F.max("count")).first()[0] <= CLASS_ROWS:
            return lambda train, test: forest_guesses(train, test, "__row", "__y", "features", classifier.getNumTrees(), classifier.getMaxDepth(), classifier.getSeed())
    return None


def forest(trees: int = 50, depth: int = 6) -> RandomForestClassifier:
    """The tasks keep the node of each row: otherwise every step of the fit sends them all trees with the class counts of all nodes."""
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=42, cacheNodeIds=True)


def importances(df: DataFrame, target: str, names: Sequence[str], trees: int = 50) -> DataFrame:
    """(feature, importance) of a forest that predicts ``target``."""
    y = StringIndexer(inputCol="__t", outputCol="__y")
    rows = materialize(df.withColumn("__t", F.col(target).cast("string")), "probe")
    m = Pipeline(stages=[y, forest(trees).setFeaturesCol("features").setLabelCol("__y")]).fit(rows).stages[-1]
    data = [(n, float(v)) for n, v in zip(names, m.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(data, "feature string, importance double")


def drop_features(df: DataFrame, array: str, weak: DataFrame, names: Sequence[str], k: int, out: str) -> DataFrame:
    """The array without its ``k`` most important entries according to ``weak`` (feature, importance)."""
    top = [r.feature for r in weak.orderBy(F.col("importance").desc(), "feature").limit(k).collect()]
    keep = [i for i, n in enumerate(names) if n not in top]
    return df.withColumn(out, F.array(*[F.col(array)[i] for i in keep]))


def coefficients(model: PipelineModel, spark, k: int = 20) -> DataFrame:
    """The ``k`` coefficients of largest absolute value."""
    data = [(i, float(c)) for i, c in enumerate(model.stages[-1].coefficients.toArray())]
    d = spark.createDataFrame(data, "component int, coefficient double")
    return d.orderBy(F.abs("coefficient").desc(), "component").limit(k)


def perceptron(inputs: int, hidden: Sequence[int] = (256, 128), max_iter: int = 60) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=[inputs, *hidden, 2], maxIter=max_iter, seed=42)


# ---- states and tokens -----------------------------------------------------

@dataclass
class Mixture:
    """A Gaussian mixture with diagonal covariances."""

    weight: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    log_likelihood: float = float("-inf")

    def joint(self, x: np.ndarray) -> np.ndarray:
        """log(weight) + log density, rows x components."""
        p = 1 / self.var
        maha = (x * x) @ p.T - 2 * x @ (self.mean * p).T + (self.mean**2 * p).sum(1)
        return np.log(np.maximum(self.weight, 1e-300)) - 0.5 * (maha + np.log(self.var).sum(1) + x.shape[1] * np.log(2 * np.pi))


def _moments(rows: DataFrame, array: str, resp: Callable[[np.ndarray], tuple[np.ndarray, float]], k: int) -> np.ndarray:
    """Sums of responsibility, responsibility x value and x value squared, and of the log-likelihood: one vector from each task, added up in Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy()).astype(float)
                r, ll = resp(x)
                part = np.concatenate([r.sum(0), (r.T @ x).ravel(), (r.T @ (x * x)).ravel(), [ll, len(x)]])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    cells = rows.select(F.col(array).alias("x")).mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(cells))
    for c in cells:
        out[c.i] = c.v
    return out


def _maximise(sums: np.ndarray, k: int, floor: float) -> Mixture:
    d = (len(sums) - 2 - k) // (2 * k)
    n = sums[:k] + 10 * np.finfo(float).eps
    mean = sums[k : k + k * d].reshape(k, d) / n[:, None]
    var = sums[k + k * d : k + 2 * k * d].reshape(k, d) / n[:, None] - mean**2
    return Mixture(n / n.sum(), mean, np.maximum(var, 0) + floor)


def diagonal_mixture(rows: DataFrame, array: str, centres: np.ndarray, max_iter: int = 200, tol: float = 1e-3, floor: float = 1e-6) -> Mixture:
    """EM from hard assignments to the nearest of ``centres``; ends when the mean log-likelihood changes by less than ``tol``.

    Each iteration is one aggregate of k x (2 d + 1) sums; only these and the parameters leave the tasks. ``floor`` is added to variances.
    """
    k = len(centres)

    def hard(x: np.ndarray) -> tuple[np.ndarray, float]:
        near = (((x[:, None, :] - centres[None]) ** 2).sum(2)).argmin(1)
        return np.eye(k)[near], 0.0

    m = _maximise(_moments(rows, array, hard, k), k, floor)
    for _ in range(max_iter):
        now = m

        def soft(x: np.ndarray, now: Mixture = now) -> tuple[np.ndarray, float]:
            j = now.joint(x)
            top = j.max(1, keepdims=True)
            e = np.exp(j - top)
            s = e.sum(1, keepdims=True)
            return e / s, float((top + np.log(s)).sum())

        sums = _moments(rows, array, soft, k)
        ll = sums[-2] / sums[-1]
        m = _maximise(sums, k, floor)
        m.log_likelihood = ll
        if abs(ll - now.log_likelihood) < tol:
            break
    return m


def mixture_states(df: DataFrame, baseline: Column, k: int = 16, pca: int = 32) -> DataFrame:
    """``state`` of every row from a diagonal Gaussian mixture of ``pca`` components, fitted on the baseline rows from a k-means start."""
    stages = [StandardScaler(inputCol="features", outputCol="__scaled", withMean=True), PCA(k=pca, inputCol="__scaled", outputCol="__pcs")]
    pipe = Pipeline(stages=stages).fit(materialize(df.filter(baseline), "baseline"))
    rows = materialize(pipe.transform(df).drop("__scaled").withColumn("__x", vector_to_array("__pcs")).withColumn("__base", baseline), "components")
    base = materialize(rows.filter("__base").select("__pcs", "__x"), "baseline")
    centres = np.array(KMeans(k=k, featuresCol="__pcs", seed=42, maxIter=100).fit(base).clusterCenters())
    m = diagonal_mixture(base, "__x", centres)

    def state(col: pd.Series) -> pd.Series:
        return pd.Series(m.joint(np.stack(col.to_numpy()).astype(float)).argmax(1).astype("int32"))

    return rows.withColumn("state", F.pandas_udf(state, "int")("__x")).drop("__pcs", "__x", "__base")


def cluster_tokens(df: DataFrame, k: int, pca: int, noise_q: float = 0.95) -> DataFrame:
    """``token`` by PCA and k-means; rows beyond the cluster's ``noise_q`` distance become -1."""
    stages = [StandardScaler(inputCol="features", outputCol="__scaled", withMean=True), PCA(k=pca, inputCol="__scaled", outputCol="__pcs"),
              KMeans(k=k, featuresCol="__pcs", predictionCol="cluster", seed=42)]
    m = Pipeline(stages=stages).fit(materialize(df, "tokens"))
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in m.stages[-1].clusterCenters()])
    rows = m.transform(df).withColumn("distance", l2_distance(vector_to_array("__pcs"), centres[F.col("cluster")]))
    rows = materialize(rows.drop("__scaled", "__pcs"), "tokens")
    cut = percentiles(rows, ["cluster"], "distance", [noise_q]).select("cluster", F.col("distance").alias("__cut"))
    return rows.join(sized(cut), "cluster").withColumn("token", F.when(F.col("distance") > F.col("__cut"), -1).otherwise(F.col("cluster"))).drop("__cut")


# ---- moments of vectors ----------------------------------------------------

def gram(df: DataFrame, left: str, right: str) -> np.ndarray:
    """Sum of outer products of two array columns. Each task adds up its batches to one matrix; the matrices are
    added up in Spark, and one matrix of parameter-set size comes back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                a, b = np.stack(pdf["a"].to_numpy()).astype(float), np.stack(pdf["b"].to_numpy()).astype(float)
                total = a.T @ b if total is None else total + a.T @ b
        if total is not None:
            yield pd.DataFrame({"m": [total.ravel().tolist()], "rows": [total.shape[0]]})

    parts = df.select(F.col(left).alias("a"), F.col(right).alias("b")).mapInPandas(run, "m array<double>, rows int")
    cells = parts.select("rows", F.posexplode("m").alias("i", "v")).groupBy("i", "rows").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(cells))
    for r in cells:
        out[r.i] = r.v
    return out.reshape(cells[0].rows, -1)


def with_one(c: str) -> Column:
    return F.concat(F.transform(F.col(c), lambda x: x.cast("double")), F.array(F.lit(1.0)))


def covariance(df: DataFrame, array: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance of an array column."""
    g = gram(df.withColumn("__x", with_one(array)), "__x", "__x")
    n = g[-1, -1]
    mean = g[-1, :-1] / n
    return mean, (g[:-1, :-1] - n * np.outer(mean, mean)) / (n - 1)


def _matrix_power(c: np.ndarray, power: float, least: float) -> np.ndarray:
    w, v = np.linalg.eigh(c)
    return (v * np.clip(w, least, None) ** power) @ v.T


def _coral_move(source: tuple[np.ndarray, np.ndarray], target: tuple[np.ndarray, np.ndarray], eps: float) -> np.ndarray:
    eye = eps * np.eye(len(source[0]))
    return _matrix_power(source[1] + eye, -0.5, eps) @ _matrix_power(target[1] + eye, 0.5, eps)


def coral(source: DataFrame, target: DataFrame, array: str, out: str = "aligned", eps: float = 1e-3) -> DataFrame:
    """Source vectors whitened by their own covariance, coloured by the target's and moved to its mean."""
    s, t = covariance(source, array), covariance(target, array)
    move = _coral_move(s, t, eps)

    def run(col: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(col.to_numpy()).astype(float) - s[0]) @ move + t[0]))

    return source.withColumn(out, F.pandas_udf(run, "array<double>")(array))


def coral_pairs(df: DataFrame, site: str, sites: Sequence[int], array: str, target: str = "target", out: str = "aligned", eps: float = 1e-3) -> DataFrame:
    """Each row once for every other site, aligned to it: the moments of a site are taken once, and one matrix for each pair of sites goes to the tasks."""
    moments = {s: covariance(df.filter(F.col(site) == s), array) for s in sites}
    moves = {(a, b): _coral_move(moments[a], moments[b], eps) for a in sites for b in sites if a != b}
    others = F.filter(F.array(*[F.lit(s) for s in sites]), lambda s: s != F.col(site))
    rows = df.filter(F.col(site).isin(list(sites))).withColumn(target, F.explode(others))

    def run(pdf: pd.DataFrame) -> pd.Series:
        y = [None] * len(pdf)
        x = np.stack(pdf["x"].to_numpy()).astype(float)
        for key, at in pdf.groupby(["a", "b"]).indices.items():
            for i, v in zip(at, (x[at] - moments[key[0]][0]) @ moves[key] + moments[key[1]][0], strict=True):
                y[i] = v
        return pd.Series(y)

    return rows.withColumn(out, F.pandas_udf(run, "array<double>")(F.struct(F.col(site).alias("a"), F.col(target).alias("b"), F.col(array).alias("x"))))


def autoregressive_error(df: DataFrame, context: str, target: str, train: Column, alpha: float = 1.0, out: str = "ar_error") -> DataFrame:
    """Mean squared error of a ridge prediction of each vector from its context, fitted on ``train`` rows.

    As in ridge regression with an intercept, the intercept is not penalised.
    """
    rows = df.withColumn("__x", with_one(context)).withColumn("__y", F.transform(F.col(target), lambda x: x.cast("double")))
    fit = materialize(rows.filter(train).select("__x", "__y"), "ar")
    xx, xy = gram(fit, "__x", "__x"), gram(fit, "__x", "__y")
    pen = alpha * np.eye(len(xx))
    pen[-1, -1] = 0
    beta = np.linalg.solve(xx + pen, xy)

    def run(pdf: pd.DataFrame) -> pd.Series:
        e = np.stack(pdf["y"].to_numpy()) - np.stack(pdf["x"].to_numpy()) @ beta
        return pd.Series((e * e).mean(axis=1))

    udf = F.pandas_udf(run, "double")
    return rows.withColumn(out, udf(F.struct(F.col("__x").alias("x"), F.col("__y").alias("y")))).drop("__x", "__y")


def reconstruction_error(df: DataFrame, array: str, baseline: Column, k: int, out: str = "recon_error") -> DataFrame:
    """Mean squared residual after projecting onto the ``k`` main directions of the baseline rows."""
    mean, cov = covariance(df.filter(baseline), array)
    std = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    _, v = np.linalg.eigh(cov / np.outer(std, std))
    top = v[:, -k:]

    def run(col: pd.Series) -> pd.Series:
        z = (np.stack(col.to_numpy()).astype(float) - mean) / std
        return pd.Series(((z - z @ top @ top.T) ** 2).mean(axis=1))

    return df.withColumn(out, F.pandas_udf(run, "double")(array))


# ---- prototypes, calibration, experts --------------------------------------

def prototype_scores(support: DataFrame, test: DataFrame, by: Sequence[str], label: str, vector: str) -> DataFrame:
    """cos(test, mean of positives) - cos(test, mean of negatives), scaled to 0..1 within the group."""
    by = list(by)
    proto = group_vectors(support, [*by, label], vector, {"m": "mean"})
    both = proto.groupBy(*by).agg(F.max(F.when(F.col(label) == 1, F.col("m"))).alias("__pos"), F.max(F.when(F.col(label) == 0, F.col("m"))).alias("__neg"))
    raw = test.join(sized(both), by).withColumn("__s", cosine(vector, "__pos") - F.coalesce(cosine(vector, "__neg"), F.lit(0.0))).drop("__pos", "__neg")
    edge = raw.groupBy(*by).agg(F.min("__s").alias("__lo"), F.max("__s").alias("__hi"))
    out = raw.join(sized(edge), by).withColumn("score", (F.col("__s") - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-10))
    return out.drop("__s", "__lo", "__hi")


def calibrate(support: DataFrame, test: DataFrame, label: str, raw: str, out: str = "calibrated") -> DataFrame:
    """One-feature logistic calibration from the support set; the raw score when it lacks a class."""
    n = support.agg(F.count_distinct(label)).first()[0]
    if n < 2:
        return test.withColumn(out, F.col(raw))
    vec = lambda d: d.withColumn("__v", array_to_vector(F.array(F.col(raw).cast("double"))))
    m = LogisticRegression(featuresCol="__v", labelCol="__y", maxIter=50).fit(materialize(vec(support).withColumn("__y", F.col(label).cast("double")), "support"))
    s = m.transform(vec(test)).withColumn(out, vector_to_array("probability")[1])
    return s.select(*test.columns, out)


def rank_calibrate(df: DataFrame, by: Sequence[str], order: Sequence[str], raw: str, baseline: Column, n: int = 40, out: str = "percentile") -> DataFrame:
    """Share of the group's first ``n`` baseline scores below each score."""
    base = row_index(df.filter(baseline).select(*by, *order, raw), by, order, "__rn").filter(F.col("__rn") <= n)
    ref = base.groupBy(*by).agg(F.collect_list(raw).alias("__ref"))  # at most n values a group
    below = F.size(F.filter("__ref", lambda x: x < F.col(raw)))
    return df.join(sized(ref), list(by)).withColumn(out, below / F.size("__ref")).drop("__ref")


def similarity_weights(df: DataFrame, site: str, vector: str, baseline: Column) -> DataFrame:
    """(target, expert, weight): cosine of mean baseline vectors, clipped at 0 and normalised per target; equal when all are 0.

    One row per pair of sites: the matrix is the result.
    """
    m = group_vectors(df.filter(baseline), [site], vector, {"m": "mean"})
    a, b = m.select(F.col(site).alias("target"), F.col("m").alias("__a")), m.select(F.col(site).alias("expert"), F.col("m").alias("__b"))
    w = a.join(b, F.col("target") != F.col("expert")).withColumn("__w", F.greatest(cosine("__a", "__b"), F.lit(0.0)))
    total = w.groupBy("target").agg(F.sum("__w").alias("__t"), F.count("*").alias("__n"))
    return w.join(total, "target").select("target", "expert", F.when(F.col("__t") > 0, F.col("__w") / F.col("__t")).otherwise(1.0 / F.col("__n")).alias("weight"))


def combine_experts(scores: DataFrame, ids: Sequence[str], value: str, weight: str | None = None, cut: float = 0.7) -> DataFrame:
    """Mean, weighted mean, median and share of experts above ``cut`` (experts are few per row)."""
    v = F.col(value)
    w = F.col(weight) if weight else F.lit(1.0)
    return scores.groupBy(*ids).agg(F.avg(v).alias("mean"), (F.sum(v * w) / F.sum(w)).alias("weighted"), F.median(v).alias("median"),
                                    F.avg((v > cut).cast("double")).alias("consensus"))


def fuse(df: DataFrame, velocity: str, second: str, spectral: str) -> DataFrame:
    """The eight fusion scores of three rolling percentiles."""
    a, b, c = F.col(velocity), F.col(second), F.col(spectral)
    return df.select("*", a.alias("s1_velocity"), b.alias("s2_second"), c.alias("s3_spectral"), F.greatest(a, c).alias("s4_max"),
                     ((a + c) / 2).alias("s5_mean"), ((a + b + c) / 3).alias("s6_mean3"), (a * c).alias("s7_product"), F.greatest(a, b, c).alias("s8_max3"))


# ---- isolation forest ------------------------------------------------------

def _average_path(n: int) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, depth: int, limit: int, rng: np.random.Generator, nodes: list) -> int:
    """Append the subtree of ``x`` to ``nodes``; each node is (feature, cut, left, right, path length below a leaf)."""
    at = len(nodes)
    nodes.append(None)
    spread = np.ptp(x, axis=0) if len(x) else np.zeros(1)
    if depth >= limit or len(x) <= 1 or not (spread > 0).any():
        nodes[at] = (-1, 0.0, -1, -1, depth + _average_path(len(x)))
        return at
    f = int(rng.choice(np.flatnonzero(spread > 0)))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    side = x[:, f] < cut
    left, right = _grow(x[side], depth + 1, limit, rng, nodes), _grow(x[~side], depth + 1, limit, rng, nodes)
    nodes[at] = (f, cut, left, right, 0.0)
    return at


def _distinct(rng: np.random.Generator, n: int, k: int) -> np.ndarray:
    """``k`` different numbers below ``n`` in random order."""
    out = np.zeros(0, np.int64)
    while len(out) < k:
        both = np.concatenate([out, rng.integers(0, n, k)])
        out = both[np.sort(np.unique(both, return_index=True)[1])]
    return out[:k]


def isolation_forest(df: DataFrame, array: str, baseline: Column, ids: Sequence[str], trees: int = 200, sample: int = 256, out: str = "isolation") -> DataFrame:
    """Anomaly score from trees grown in parallel on ``sample`` baseline rows each.

    The forest has ``trees`` x at most 2 * sample nodes whatever the data; it goes to the scoring tasks as a constant.
    """
    base = df.filter(baseline)
    n = base.count()
    per = max(1, min(sample, n))
    # Each tree draws its own rows without replacement, by their places; trees x sample places, whatever the size of the table.
    draws = []
    for tree in range(trees):
        at = np.random.default_rng([tree, 1]).permutation(n)[:per] if n <= 4 * per else _distinct(np.random.default_rng([tree, 1]), n, per)
        draws += [(tree, int(i) + 1, j) for j, i in enumerate(at)]
    chosen = df.sparkSession.createDataFrame(draws, "tree int, __i long, __h int")
    pick = row_index(base.select(*ids, array), [], list(ids), "__i").join(chosen, "__i")
    limit = int(np.ceil(np.log2(max(per, 2))))
    node_t = "tree int, nodes array<struct<f:int,c:double,l:int,r:int,d:double>>"

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(pdf.sort_values("__h")[array].to_numpy()[:per]).astype(float)
        nodes: list = []
        _grow(x, 0, limit, np.random.default_rng(tree), nodes)
        return pd.DataFrame({"tree": [tree], "nodes": [[{"f": a, "c": b, "l": c, "r": d, "d": e} for a, b, c, d, e in nodes]]})

    grown = pick.groupBy("tree").applyInPandas(grow, node_t).collect()
    packed = [tuple(np.array([getattr(n_, k) for n_ in t.nodes]) for k in ("f", "c", "l", "r", "d")) for t in grown]
    scale = _average_path(per) or 1.0

    def run(col: pd.Series) -> pd.Series:
        x = np.stack(col.to_numpy()).astype(float)
        total = np.zeros(len(x))
        for f, c, lft, rgt, d in packed:
            at = np.zeros(len(x), dtype=int)
            for _ in range(limit + 1):
                inner = f[at] >= 0
                go_left = x[np.arange(len(x)), np.where(inner, f[at], 0)] < c[at]
                at = np.where(inner, np.where(go_left, lft[at], rgt[at]), at)
            total += d[at]
        return pd.Series(2.0 ** (-(total / len(packed)) / scale))

    return df.withColumn(out, F.pandas_udf(run, "double")(array))


# ---- permutation importance ------------------------------------------------

def permutation_importance(df: DataFrame, group: str, ids: Sequence[str], array: str, label: str, model: DataFrame, repeats: int = 5) -> DataFrame:
    """(group, feature, drop): mean loss of AUC when one feature is shuffled within its group, for a linear model (intercept, coefficients).

    Shuffling feature j changes a row's score by w_j (x'_j - x_j), where x' is the row at hash rank i, joined by rank: a row of two vectors gives the scores
    of all features, and no vector is copied. A group is never collected. Several models' groups are not mixed: ``model`` is one row.
    """
    base = df.select(group, *ids, label, F.transform(array, lambda x: x.cast("double")).alias("__x")).crossJoin(F.broadcast(model.select("intercept", "coefficients")))
    dot = F.aggregate(F.zip_with("__x", "coefficients", lambda a, b: a * b), F.col("intercept"), lambda a, b: a + b)
    base = materialize(base.withColumn("__s", dot).drop("intercept"), "scored")
    plain = row_index(base, [group], list(ids), "__i")
    every = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    other = hash_rank(base.select(group, *ids, F.col("__x").alias("__other")).withColumn("repeat", every), [group, "repeat"], ["repeat", *ids], "perm", "__i")
    both = plain.withColumn("repeat", every).join(other.select(group, "repeat", "__i", "__other"), [group, "repeat", "__i"])
    change = F.zip_with(F.zip_with("__other", "__x", lambda a, b: a - b), "coefficients", lambda d, w: d * w)
    # Scores that differ by rounding only count as equal.
    shuffled = both.select(group, "repeat", label, F.col("__s"), F.posexplode(change).alias("feature", "__d")).withColumn("__s", F.round(F.col("__s") + F.col("__d"), 9))
    true = roc_auc(base.withColumn("__s", F.round("__s", 9)), [group], "__s", label).select(group, F.col("auc").alias("__auc"))
    auc = roc_auc(shuffled, [group, "repeat", "feature"], "__s", label)
    return auc.join(sized(true), group).groupBy(group, "feature").agg(F.avg(F.col("__auc") - F.col("auc")).alias("drop"))
