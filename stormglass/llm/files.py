"""Binary files in the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from ..storage import scratch_path


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a path or URI (local, hdfs, s3, gs, ..) and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; its files are named in a table, never listed."""
    path = scratch_path(spark, name)
    system, inner = file_system(path)
    system.create_dir(inner, recursive=True)
    return path


def new_name(folder: str, suffix: str) -> str:
    """A file name that no other task or attempt uses, so attempts cannot disturb each other."""
    return f"{folder}/{uuid.uuid4().hex}{suffix}"
