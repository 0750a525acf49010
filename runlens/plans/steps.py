"""The three entry points as lazy plans: train, apply and evaluate; each writes its tables once and skips what is there."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..config import DetectorConfig, check_arguments
from ..functions.scalar import base_name, file_run, file_subrun
from ..operators import catalogue as cat
from ..operators import detect, forest, reference, report, sampling, status
from ..sources import readers, writers

#: What names a row of features.
KEY = ["run", "subrun", "channel"]


@dataclass
class Model:
    state: DataFrame
    nodes: DataFrame | None
    offset: float | None
    columns: list[str]
    #: The files (run, subrun) that the state covers, where they are known.
    files: DataFrame | None = None


def with_detector(state: DataFrame, features: DataFrame | None, columns: list[str], config: DetectorConfig, files: DataFrame | None = None) -> Model:
    """A model of a reference and, unless ``features`` is None, a forest grown on them."""
    if features is None:
        return Model(state, None, None, columns, files)
    z = reference.zscores(features, reference.reference_stats(state), columns)
    # forest and offset are taken from one and the same bounded sample
    sample = storage.written(forest.training_sample(z, columns, KEY, config.seed, config.training_cap), "training-sample")
    nodes = storage.written(forest.fit_forest(sample, columns, KEY, config.n_trees, config.max_samples, config.seed, config.training_cap), "forest")
    return Model(state, nodes, forest.contamination_offset(forest.score_forest(sample, columns, nodes), config.contamination), columns, files)


def train(features: DataFrame, columns: list[str], config: DetectorConfig, with_forest: bool = True, old: Model | None = None) -> Model:
    """Reference and forest of known-good features.

    With ``old``, files that its reference covers are not counted again; the
    forest is grown anew on all of ``features``.
    """
    files = features.select("run", "subrun").distinct()
    if old is None:
        state = reference.reference_state(features, columns)
    else:
        if old.files is None:
            raise ValueError("the old model does not tell which files it covers")
        files = files.join(old.files, ["run", "subrun"], "left_anti")
        state = reference.merge_states(old.state, reference.reference_state(features.join(files, ["run", "subrun"], "left_semi"), columns))
        files = old.files.select("run", "subrun").unionByName(files)
    return with_detector(state, features if with_forest else None, columns, config, files)


def apply(features: DataFrame, model: Model, config: DetectorConfig) -> DataFrame:
    """The anomaly log of features."""
    stats = reference.reference_stats(model.state)
    z = reference.zscores(features, stats, model.columns)
    if model.nodes is not None:
        z = forest.flag_forest(forest.score_forest(z, model.columns, model.nodes), model.offset)
    return detect.detection_log(z, model.columns, config.z_threshold, stats.select("channel").distinct())


def judge(log: DataFrame, config: DetectorConfig) -> DataFrame:
    """The status of each file of a log."""
    return status.file_status(log, config.alert_consecutive_n, config.file_alert_n_channels, config.single_file_alert_n_channels, config.single_file_alert_max_z)


def evaluate(files: DataFrame, catalogue: DataFrame, quality: str = "All") -> tuple[DataFrame, DataFrame]:
    """(crosstab with ground truth, framework tiers)."""
    return cat.crosstab(cat.ground_truth(files, catalogue, quality)), cat.framework_tiers(files)


def files_to_apply(spark: SparkSession, config: DetectorConfig, training_list: str | None = None, catalogue: str | None = None, run: int | None = None, text_list: str | None = None, root: str = "", quality: str = "All", first_run: int | None = None, last_run: int | None = None) -> tuple[list[str], list[str]]:
    """(paths, what was not found) by the one mode that is given.

    A list (training or other) has globs; a catalogue names files below ``root``
    by quality and run range, subrun -1 meaning all of a run, of which the
    configured share is taken; a run is all its files below ``root``.
    """
    mode = check_arguments({"training_list": training_list, "catalogue": catalogue, "run": run, "text_list": text_list}, config.sample_fraction)
    if mode in ("training_list", "text_list"):
        return readers.run_list(spark, training_list or text_list)
    if mode == "run":
        found = storage.find(spark, readers.run_directory(root, run))
        return found, [] if found else [f"run {run}"]
    entries = cat.select_catalogue(cat.last_entries(readers.read_catalogue(spark, catalogue)), quality, first_run, last_run)
    runs = sorted(r["run"] for r in entries.select("run").distinct().collect())  # some thousands
    paths = [p for r in runs for p in storage.find(spark, readers.run_directory(root, r))]
    name = base_name(F.col("path"))
    files = spark.createDataFrame([(p,) for p in paths], "path string").select("path", file_run(name).alias("run"), file_subrun(name).alias("subrun"))
    named = files.join(cat.expand_catalogue(entries, files), ["run", "subrun"], "left_semi")
    if config.sample_fraction < 1 and not named.isEmpty():
        named = sampling.fraction_sample(named, config.sample_fraction, ["path"], config.test_seed)
    lost = [f"run {r['run']} subrun {r['subrun']}" for r in cat.unmatched(entries, files).orderBy("run", "subrun").collect()]
    return [r["path"] for r in named.orderBy(*report.file_order()).collect()], lost


STEPS = ("train", "apply", "evaluate", "report", "plots")


def full(spark: SparkSession, features: DataFrame, good: DataFrame, catalogue: DataFrame, columns: list[str], config: DetectorConfig, folder: str, skip: tuple[str, ...] = ()) -> None:
    """Train on ``good``, apply to ``features``, evaluate, report and lay out plot tables, into a folder.

    Tables that are there are not made again; steps named in ``skip`` are left out.
    """
    if set(skip) - set(STEPS):
        raise ValueError(f"unknown steps: {', '.join(sorted(set(skip) - set(STEPS)))}")
    if "train" not in skip and not writers.done(spark, f"{folder}/reference"):
        model = train(good, columns, config)
        writers.save_model(model.state, model.nodes, folder, asdict(config) | {"offset": model.offset, "columns": columns}, model.files)
        writers.save_config(spark, config, f"{folder}/config.json")
    if "apply" not in skip and not writers.done(spark, f"{folder}/log"):
        state, nodes, meta = writers.load_model(spark, folder)
        apply(features, Model(state, nodes, meta["offset"], meta["columns"]), config).write.mode("overwrite").partitionBy("run").parquet(f"{folder}/log")
    if not writers.done(spark, f"{folder}/log"):
        return
    log = spark.read.parquet(f"{folder}/log")
    tables = {
        "evaluate": {"status": lambda: judge(log, config), "confusion": lambda: evaluate(judge(log, config), catalogue)[0], "framework": lambda: evaluate(judge(log, config), catalogue)[1]},
        "report": {"run_summary": lambda: status.classify_runs(log, config.file_alert_n_channels)},
        "plots": {
            "status_grid": lambda: report.status_grid(judge(log, config)),
            "anomaly_rate": lambda: report.anomaly_rate(log, judge(log, config)),
            "channel_frequency": lambda: report.channel_frequency(log),
            "feature_frequency": lambda: report.feature_frequency(log),
        },
    }
    for step, own in tables.items():
        for name, make in own.items():
            if step not in skip and not writers.done(spark, f"{folder}/{name}"):
                make().write.mode("overwrite").parquet(f"{folder}/{name}")
    if "evaluate" not in skip and not storage.exists(spark, f"{folder}/summary.txt"):
        judged = cat.ground_truth(judge(log, config), catalogue)
        writers.write_summary(writers.write_confusion(judged, f"{folder}/confusion.json"), spark, f"{folder}/summary.txt")
