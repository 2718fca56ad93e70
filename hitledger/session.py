"""Shared folders and file-system calls of a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the cluster's shared folder; only a local session may fall back to a temporary one."""
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="hitledger-")
        spark.conf.set(CHECKPOINT_DIR, base)
    return qualified(spark, f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}")


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, so that every reader and task means the same place."""
    hadoop, fs = _path(spark, path)
    return fs.makeQualified(hadoop).toString()


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _path(spark, path)
    return fs.exists(hadoop)


def file_status(spark: SparkSession, path: str) -> tuple[float, int] | None:
    """Modification time in seconds and size of a file, None if there is none."""
    hadoop, fs = _path(spark, path)
    if not fs.exists(hadoop):
        return None
    status = fs.getFileStatus(hadoop)
    return status.getModificationTime() / 1000, status.getLen()


def empty_files(spark: SparkSession, path: str) -> list[tuple[str, str, float, int]]:
    """Name, path, modification time in seconds and size (0) of the empty files directly under ``path``: one listing."""
    hadoop, fs = _path(spark, path)
    statuses = fs.globStatus(hadoop) or []
    listed = [s for top in statuses for s in fs.listStatus(top.getPath()) if s.isFile() and s.getLen() == 0]
    return [(s.getPath().getName(), s.getPath().toString(), s.getModificationTime() / 1000, 0) for s in listed
            if not s.getPath().getName().startswith((".", "_"))]


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly under ``path``, none if it does not exist."""
    hadoop, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def remove(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _path(spark, path)
    return fs.delete(hadoop, True)


def make_folder(spark: SparkSession, path: str) -> None:
    hadoop, fs = _path(spark, path)
    fs.mkdirs(hadoop)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Full paths that match a glob, from one listing."""
    hadoop, fs = _path(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(hadoop) or []))


def rename(spark: SparkSession, path: str, to: str) -> None:
    hadoop, fs = _path(spark, path)
    if not fs.rename(hadoop, _path(spark, to)[0]):
        raise OSError(f"{path} could not be renamed to {to}")
