"""Arithmetic on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: str | Column, b: str | Column) -> Column:
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_distance(a: str | Column, b: str | Column) -> Column:
    gap = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: str | Column, b: str | Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def group_vectors(df: DataFrame, by: list[str], vector: str, stats: dict[str, str]) -> DataFrame:
    """Element-wise ``mean``, population ``std`` or ``max`` of an array column, one array per entry of ``stats``.

    The vector summary is a partial aggregate: each task sends one summary per group, never the vectors.
    """
    vec = array_to_vector(F.transform(_c(vector), lambda x: x.cast("double")))
    rows = df.filter(_c(vector).isNotNull()).select(*by, vec.alias("__v"))
    wanted = {"mean": ["mean"], "std": ["variance", "count"], "max": ["max"]}
    metrics = sorted({m for k in stats.values() for m in wanted[k]})
    g = rows.groupBy(*by).agg(Summarizer.metrics(*metrics).summary(F.col("__v")).alias("__s"))
    n = F.col("__s.count")
    forms = {
        "mean": lambda: vector_to_array("__s.mean"),
        "max": lambda: vector_to_array("__s.max"),
        "std": lambda: F.transform(vector_to_array("__s.variance"), lambda v: F.sqrt(v * (n - 1) / n)),
    }
    return g.select(*by, *[forms[k]().alias(name) for name, k in stats.items()])
