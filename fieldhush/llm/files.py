"""Binary files that tasks write to and read from the shared folder.

A task writes each file under a name of its own and reports it; the report is a row of a Spark table, the manifest.
Spark commits the manifest once for each task, so files of lost or repeated attempts are in no manifest and are never read.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark import TaskContext


def located(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def create(folder: str, suffix: str):
    """(path, open stream) of a new file for this attempt of this task."""
    fs, at = located(folder)
    fs.create_dir(at, recursive=True)
    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", fs.open_output_stream(f"{at}/{name}", compression=None)


def open_read(path: str):
    fs, at = located(path)
    return fs.open_input_file(at)
