"""Named feature sets chosen by role: a prefix or an explicit list of columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class FeatureSet:
    name: str
    prefixes: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()

    def names(self, df: DataFrame) -> list[str]:
        """The numeric columns of ``df`` in this set, in schema order."""
        numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
        return [c for c in numeric if c in self.columns or any(c.startswith(p) for p in self.prefixes)]

    def __add__(self, other: FeatureSet) -> FeatureSet:
        return FeatureSet(f"{self.name}+{other.name}", self.prefixes + other.prefixes, self.columns + other.columns)


def select_features(df: DataFrame, features: FeatureSet, keep: Sequence[str], out: str = "features") -> DataFrame:
    """``keep`` plus the set's columns assembled into one vector."""
    names = features.names(df)
    if not names:
        raise ValueError(f"no column of the table is in feature set {features.name}")
    return VectorAssembler(inputCols=names, outputCol=out, handleInvalid="keep").transform(df.select(*keep, *names)).select(*keep, out)
