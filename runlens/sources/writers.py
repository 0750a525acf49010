"""Sinks: logs, models, evaluation and report tables.  Table writes go through Spark; small summaries are JSON."""

from __future__ import annotations

import itertools
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..config import DetectorConfig
from ..functions.scalar import half_even, utc_stamp
from ..operators.sampling import first_appearances
from . import readers


def done(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to a path before: a step then has nothing to do."""
    return storage.exists(spark, f"{path}/_SUCCESS")


def as_log(log: DataFrame) -> DataFrame:
    """The log's public columns: time stamp, file name, z to 2 and score to 4 places (halves to even, by the binary value)."""
    name = F.concat(F.lit("Digitizer_run"), F.col("run").cast("string"), F.lit("_subrun"), F.col("subrun").cast("string"), F.lit(".csv"))
    file = F.col("filename") if "filename" in log.columns else name
    return log.select(utc_stamp().alias("timestamp"), file.alias("filename"), F.col("channel").cast("string").alias("channel"), "anomalous", "method", "triggered_features", half_even(F.col("max_z"), 2).alias("max_z"), half_even(F.col("if_score"), 4).alias("if_score"), "run")


def append_log(log: DataFrame, path: str, form: str = "parquet") -> None:
    """Appends to a log that is laid out by run."""
    as_log(log).write.mode("append").partitionBy("run").format(form).save(path)


def replace_runs(log: DataFrame, path: str) -> None:
    """Writes a log again for the runs that it has, and leaves other runs as they are."""
    as_log(log).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def combine_logs(logs: list[DataFrame]) -> DataFrame:
    """Union by name of logs whose columns may differ."""
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def combine_folders(spark: SparkSession, logs: list[str], lists: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(the logs of several folders or files as one, their path lists merged: each path once, in order of first appearance)."""
    log = combine_logs([readers.read_log(spark, p) for p in logs])
    none = spark.createDataFrame([], "part int, line int, path string")
    for i, p in enumerate(lists):
        lines = spark.read.text(p, wholetext=True).select(F.lit(i).alias("part"), F.posexplode(F.split("value", "\r?\n")).alias("line", "path"))
        none = none.unionByName(lines.where(F.trim("path") != ""))
    return log, first_appearances(none, ["path"], ["part", "line"]).orderBy("part", "line").select("path")


def newer_than(spark: SparkSession, parts: str | list[str], combined: str) -> bool:
    """Whether a part was changed after the combined log was written."""
    last = lambda p: spark.read.format("binaryFile").load(p).agg(F.max("modificationTime").alias("t")).first()["t"]
    a, b = last(parts), last(combined)
    return a is not None and (b is None or a > b)


def save_model(state: DataFrame, nodes: DataFrame | None, folder: str, meta: dict, files: DataFrame | None = None) -> None:
    """Reference, forest and the files (run, subrun) that the reference covers as tables, the rest as one JSON row beside them."""
    if files is not None:
        files.write.mode("overwrite").parquet(f"{folder}/files")
    state.write.mode("overwrite").parquet(f"{folder}/reference")
    if nodes is not None:
        nodes.write.mode("overwrite").parquet(f"{folder}/forest")
    spark = state.sparkSession
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")


def load_model(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame | None, dict]:
    """(reference, forest or None, metadata); fields that old models lack get their defaults."""
    meta = json.loads(spark.read.text(f"{folder}/meta").first()["value"])
    nodes = spark.read.parquet(f"{folder}/forest") if done(spark, f"{folder}/forest") else None
    return spark.read.parquet(f"{folder}/reference"), nodes, {"use_trigger": True, "use_lvds": True, "offset": None} | meta


def covered_files(spark: SparkSession, folder: str) -> DataFrame | None:
    """The files (run, subrun) that a saved model's reference covers; None where it does not tell."""
    return spark.read.parquet(f"{folder}/files") if done(spark, f"{folder}/files") else None


def save_config(spark: SparkSession, config: DetectorConfig, path: str) -> None:
    """The effective configuration as JSON beside a model."""
    storage.write_text(spark, path, [json.dumps(asdict(config), indent=1, sort_keys=True)])


def write_framework(tiers: DataFrame, path: str, label: str) -> None:
    """Rows [run, subrun, loose, medium, tight, 0, label] in order, one JSON document.

    The document's format asks for one writer: rows (one a file) come to it
    partition by partition and leave as they come.
    """
    rows = tiers.orderBy("run", "subrun").select("run", "subrun", "loose", "medium", "tight").toLocalIterator()
    texts = (", " * bool(i) + json.dumps([*r, 0, label]) for i, r in enumerate(rows))
    storage.write_text(tiers.sparkSession, path, itertools.chain(['{"data": ['], texts, ["]}"]))


def write_confusion(judged: DataFrame, path: str) -> dict:
    """Counts of ground truth by status as JSON, {"counts": {gt: {status: n}}}: twelve numbers."""
    counts: dict[str, dict[str, int]] = {}
    for r in judged.groupBy("gt", "status").count().collect():
        counts.setdefault(r["gt"], {})[r["status"]] = r["count"]
    storage.write_text(judged.sparkSession, path, [json.dumps({"counts": counts}, sort_keys=True)])
    return counts


def write_summary(counts: dict[str, dict[str, int]], spark: SparkSession, path: str) -> None:
    """The evaluation in words: of each ground truth, files by status with their shares."""
    lines = []
    for gt, own in sorted(counts.items()):
        total = sum(own.values())
        lines.append(f"{gt}: {total} files; " + ", ".join(f"{k} {n} ({100 * n / total:.1f} %)" for k, n in sorted(own.items())))
    storage.write_text(spark, path, ["\n".join([*lines, ""])])


def write_report(runs: DataFrame, folder: str) -> None:
    """The run summary, and lists of good, partial and persistently faulty runs, a run a line in order.

    The lists are folders of text files, one a classification, written by one
    pass over the summary.
    """
    runs.write.mode("overwrite").option("header", True).csv(f"{folder}/run_summary")
    kinds = ["good", "partial", "persistent_fault"]
    own = runs.where(F.col("classification").isin(kinds)).select("run", "classification").repartitionByRange("classification", "run").sortWithinPartitions("classification", "run")
    own.select(F.col("run").cast("string").alias("value"), "classification").write.mode("overwrite").partitionBy("classification").text(f"{folder}/lists")


def report_list(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Runs of one list of a report."""
    if not storage.exists(spark, f"{folder}/lists/classification={kind}"):
        return []
    return sorted(int(r["value"]) for r in spark.read.text(f"{folder}/lists/classification={kind}").collect())  # some thousand runs


def put_good_list(paths: DataFrame, target: str, number: int) -> None:
    """The paths (path) of one numbered batch, a line each; written again, they replace what the batch had written.

    The list is a folder of text files with a folder for each batch, read as
    one; a new list starts with a comment.
    """
    spark = paths.sparkSession
    if not storage.exists(spark, target):
        storage.write_text(spark, f"{target}/batch=-1/comment.txt", ["# files that passed the live quality gate\n"])
    paths.select(F.col("path").alias("value")).write.mode("overwrite").text(f"{target}/batch={number}")


def good_list(spark: SparkSession, target: str) -> DataFrame:
    """(path) of a list's files."""
    return spark.read.text(target).where("value <> '' and not startswith(value, '#')").select(F.col("value").alias("path"))


def append_suggestions(rows: DataFrame, target: str) -> None:
    """Adds rows as JSON lines; the sidecar is a folder of text files."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(target)


def remove_outputs(spark: SparkSession, folder: str, names: list[str], confirmed: bool = False) -> list[str]:
    """Outputs of a tag below ``folder``; they are deleted only where that is confirmed."""
    found = [p for n in names if storage.exists(spark, p := f"{folder}/{n}")]
    for p in found if confirmed else []:
        storage.remove(spark, p)
    return found
