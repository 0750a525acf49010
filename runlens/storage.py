"""The folder that driver and executors share, and small files by Hadoop's file system, whatever store they are in."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

OWN_DIR_CONF = "runlens.checkpoint.dir"
#: Characters written to a file at a time.
CHUNK = 1 << 20
_at_exit: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session names none (tests, a laptop), a temporary folder is
    made and remembered in the session; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_DIR_CONF, None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="runlens-")
    spark.conf.set(OWN_DIR_CONF, folder)
    return folder


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder for tables between steps; removed when the driver's process ends."""
    folder = f"{shared_dir(spark)}/runlens-{spark.sparkContext.applicationId}"
    if folder not in _at_exit:
        _at_exit.add(folder)
        atexit.register(_remove_at_exit, spark, folder)
    return folder


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        remove(spark, folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read again.

    This cuts the lineage; lost executors cost no recomputation of ``df``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing to come reads."""
    for table in tables:
        for folder in {os.path.dirname(x) for x in table.inputFiles()}:
            remove(table.sparkSession, folder)


def _opened(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of the JVM."""
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    system, own = _opened(spark, path)
    return system.exists(own)


def remove(spark: SparkSession, path: str) -> bool:
    """Removes a file or folder; whether there was one."""
    system, own = _opened(spark, path)
    return system.delete(own, True)


def find(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths that a glob matches; no scheme is added to a pattern without one."""
    system, own = _opened(spark, pattern)
    found = system.globStatus(own) or []
    bare = "://" not in pattern and not pattern.startswith("file:")
    return sorted(x.getPath().toUri().getPath() if bare else x.getPath().toString() for x in found)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """One small file that must not be there before; False, and nothing done, where it is."""
    system, own = _opened(spark, path)
    try:
        out = system.create(own, False)
    except Exception:
        if system.exists(own):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def write_text(spark: SparkSession, path: str, parts: Iterable[str]) -> None:
    """One small file, written as the parts come."""
    system, own = _opened(spark, path)
    out = system.create(own, True)
    held: list[str] = []
    size = 0
    try:
        for part in parts:
            held.append(part)
            size += len(part)
            if size >= CHUNK:
                out.write(bytearray("".join(held).encode()))
                held, size = [], 0
        out.write(bytearray("".join(held).encode()))
    finally:
        out.close()
