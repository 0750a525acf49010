"""A reference that grows on disk: every file counts once, whatever lists name it and wherever a run breaks off.

A folder holds ``parts/<attempt>`` (the merged state after the attempt, and the
names of the files that it added) and ``commits/<version>.json``, which names
the parts that make up a version.  A version exists once its commit file does;
that file is created, never replaced, so of two writers one wins and the other
is told.  Parts that no commit names are left-overs of broken attempts.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..config import DetectorConfig
from ..operators import reference
from ..operators.membership import not_in
from .steps import Model, with_detector

#: Parts whose names are read one by one; with more, a commit writes them as one.
MOST_PARTS = 16


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass
class Version:
    """A committed version: the state over ``n_files`` files and their base names."""

    number: int
    parts: list[str]
    columns: list[str]
    n_files: int
    state: DataFrame
    files: DataFrame


def latest(spark: SparkSession, folder: str) -> Version | None:
    """The last committed version of a folder; None where there is none."""
    numbers = [int(m[1]) for p in storage.find(spark, f"{folder}/commits/*.json") if (m := re.search(r"/(\d+)\.json$", p))]
    if not numbers:
        return None
    said = json.loads(spark.read.text(f"{folder}/commits/{max(numbers):08d}.json", wholetext=True).first()["value"])
    state = spark.read.parquet(f"{folder}/parts/{said['parts'][-1]}/state")
    files = spark.read.schema("filename string").parquet(*[f"{folder}/parts/{p}/files" for p in said["parts"]])
    return Version(max(numbers), said["parts"], said["columns"], said["n_files"], state, files)


def base_names(files: DataFrame) -> DataFrame:
    """``files`` once for each base name (the smallest path), with that name as ``_base``."""
    named = files.withColumn("_base", F.substring_index("filename", "/", -1))
    return named.groupBy("_base").agg(F.min_by(F.struct(*files.columns), "filename").alias("r")).select("r.*", "_base")


def add_files(spark: SparkSession, folder: str, files: DataFrame, extract: Callable[[DataFrame], DataFrame], columns: list[str]) -> Version:
    """Adds the files that the folder's reference has not seen, and commits.

    ``files`` (filename, ...) may be of any list; ``extract`` makes features
    (channel, columns) of those that are new.  Files are told apart by base
    name; null names are left out.  Without new files nothing is written.  Of
    two calls at once the later raises ``Conflict`` and has changed nothing.
    """
    old = latest(spark, folder)
    if old is not None and old.columns != columns:
        raise ValueError("the folder's reference has other features; start a new folder")
    fresh = base_names(files.where(F.col("filename").isNotNull()))
    if old is not None:
        fresh = not_in(fresh, "_base", old.files.withColumnRenamed("filename", "_base"))
    fresh = storage.written(fresh, "new-files")  # what is extracted and what is recorded must be the same files
    n = fresh.count()
    if not n and old is not None:
        return old
    own = reference.reference_state(extract(fresh.drop("_base")), columns)
    state = own if old is None else reference.merge_states(old.state, own)
    attempt = uuid.uuid4().hex
    state.write.parquet(f"{folder}/parts/{attempt}/state")
    names = fresh.select(F.col("_base").alias("filename"))
    parts = old.parts if old is not None else []
    if len(parts) >= MOST_PARTS:
        names, parts = names.unionByName(old.files), []
    names.write.parquet(f"{folder}/parts/{attempt}/files")
    number = old.number + 1 if old is not None else 0
    said = {"parts": [*parts, attempt], "columns": columns, "n_files": n + (old.n_files if old is not None else 0)}
    if not storage.create_text(spark, f"{folder}/commits/{number:08d}.json", json.dumps(said)):
        storage.remove(spark, f"{folder}/parts/{attempt}")
        raise Conflict(f"version {number} of {folder} is there already")
    return latest(spark, folder)


def train_files(spark: SparkSession, folder: str, files: DataFrame, extract: Callable[[DataFrame], DataFrame], columns: list[str], config: DetectorConfig, with_forest: bool = True) -> Model:
    """Updates the folder's reference by the new ones of ``files``, and grows the forest anew on all of ``files``."""
    version = add_files(spark, folder, files, extract, columns)
    return with_detector(version.state, extract(files) if with_forest else None, columns, config)


def left_over(spark: SparkSession, folder: str) -> list[str]:
    """Parts that no commit names: of broken attempts, or merged into later parts.  They may go when nothing writes or reads."""
    named: set[str] = set()
    version = latest(spark, folder)
    if version is not None:
        named = set(version.parts)
    return [p for p in storage.find(spark, f"{folder}/parts/*") if posixpath.basename(p) not in named]
