"""Tables written once and read back, for results that several later steps need.

Writing cuts the lineage, so a lost executor costs a re-read and not a re-run, and it gives the
planner the true size of the result: a join with it is broadcast only when the files written are
below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}
#: Lists that new tables' paths are added to, see ``recorded``.
_recorders: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    shared = spark.conf.get(_KEY, None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_KEY} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="fieldhush-")
    return _local_dirs[app]


def sized(df: DataFrame) -> DataFrame:
    """Group statistics and other results meant for a join with a large table, written first.

    A plan can only guess the size of an aggregate. Once written its size is known: a small one is broadcast and
    the large table is not shuffled, a large one is merge-joined with the adaptive split of hot keys.
    """
    return materialize(df, "sized")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of the written table."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _recorders:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables written inside the block."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders[:] = [p for p in _recorders if p is not paths]


def drop_scratch(paths: list[str], *still_read: DataFrame) -> list[str]:
    """Remove written tables but those that ``still_read`` come from; returns the paths of these.

    For a step whose input has been written for good: nothing that its predecessor wrote on the way is read again.
    A folder that cannot be opened from here is left alone.
    """
    files = [f for df in still_read for f in df.inputFiles()]
    kept = [p for p in paths if any(f"/{_name(p)}/" in f for f in files)]
    for path in (p for p in paths if p not in kept):
        try:
            fs, at = pafs.FileSystem.from_uri(_uri(path)) if ":" in path else (pafs.LocalFileSystem(), path)
            fs.delete_dir(at)
        except (OSError, ValueError):  # another store, or already gone
            pass
    return kept


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
