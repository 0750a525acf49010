"""Live monitoring: files arrive, history is kept by run, decisions leave as they fall.

Two streams: files become rows of the anomaly log (``watch``), and the log
becomes decisions and the good list (``decide``).  State is keyed by run, so
interleaved runs do not disturb each other, and a restart of either goes on
from its checkpoint.  Within a micro-batch a run's files are taken in numeric
order; across batches in order of arrival, so a file that comes late is judged
against what came before it.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import storage
from ..config import DetectorConfig
from ..functions.scalar import base_name, file_run, file_subrun
from ..operators.report import file_order
from ..operators.sampling import exact_sample
from ..sources.readers import HITS, list_files, located, read_hits
from ..sources.writers import put_good_list

DECISIONS = "run int, subrun int, file_index int, n_anomalous int, n_persistent int, status string, decision string, released string"
#: What is kept of a run: its channels' last flags ("01..", oldest first), the next file's index, and when it is forgotten.
PROGRESS, HELD = "channels array<string>, flags array<string>, next_index int, forget_at bigint", "subrun int"
#: A run without a file for so long is closed: its state goes.
IDLE_SECONDS = 7 * 24 * 3600
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of files that are tried at the same time once files have failed together.
AT_ONCE = 4
LOG = "run int, subrun int, channel string, anomalous boolean, method string, triggered_features string, max_z double, if_score double"
SKIPPED = "path string, run int, subrun int, reason string"
PATTERN = "Digitizer_*.csv"


def hit_stream(spark: SparkSession, folder: str, max_files: int = 1000, since: str | None = None) -> DataFrame:
    """Hits of files as they arrive in a folder; ``since`` (a time stamp) leaves older files alone."""
    reader = spark.readStream.schema(HITS).option("header", True).option("maxFilesPerTrigger", max_files).option("ignoreCorruptFiles", True)
    rows = reader.csv(f"{folder}/{PATTERN}")
    if since is not None:
        rows = rows.where(F.col("_metadata.file_modification_time") >= F.lit(since).cast("timestamp"))
    return located(rows)


def file_stream(spark: SparkSession, folder: str, max_files: int = 1000, since: str | None = None) -> DataFrame:
    """(path) of files as they arrive, empty and broken ones too; contents are not read.

    A file without a byte counts as not yet there: it is taken once it has some.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    rows = reader.option("pathGlobFilter", PATTERN).option("maxFilesPerTrigger", max_files).load(folder)
    if since is not None:
        rows = rows.where(F.col("modificationTime") >= F.lit(since).cast("timestamp"))
    return rows.select("path")


def isolated(paths: list[str], attempt: Callable[[list[str]], DataFrame]) -> tuple[list[DataFrame], dict[str, str]]:
    """(results, error of each bad file): files are worked off together, and halved where they fail, down to those that fail alone.

    Where an error names some of its files, those are tried apart first.  With
    k bad files of n there are at most 1 + 2 k log2 n attempts, in log2 n
    rounds as a rule, since the parts of a round run side by side.
    """
    done: list[DataFrame] = []
    errors: dict[str, str] = {}

    def tried(own: list[str]) -> DataFrame | Exception:
        try:
            return attempt(own)
        except Exception as error:
            return error

    groups = [list(paths)] if paths else []
    with ThreadPoolExecutor(AT_ONCE) as pool:
        while groups:
            parts = []
            for own, got in zip(groups, list(pool.map(tried, groups)), strict=True):
                if not isinstance(got, Exception):
                    done.append(got)
                elif len(own) == 1:
                    errors[own[0]] = str(got).splitlines()[0]
                else:
                    named = [p for p in own if os.path.basename(p) in str(got)]
                    rest = [p for p in own if p not in set(named)]
                    parts += [named, rest] if named and rest else [own[: len(own) // 2], own[len(own) // 2 :]]
            groups = parts
    return done, errors


def scored_files(spark: SparkSession, paths: list[str], score: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(log, skipped) of some files: ``score`` makes log rows of hits (run, subrun, ...).

    Files without a row of the log are skipped, with a reason; so are files
    that fail, with the error, and they do not keep the others back.
    """
    names = [x.split()[0] for x in LOG.split(", ")]
    files = spark.createDataFrame([(p,) for p in paths], "path string").select("path", file_run(base_name(F.col("path"))).alias("run"), file_subrun(base_name(F.col("path"))).alias("subrun"))

    def made(own: list[str]) -> DataFrame:
        rows = score(read_hits(spark, own, corrupt=True))
        none = F.lit(None)
        return storage.written(rows.select(*[(F.col(c) if c in rows.columns else none).cast(x.split()[1]).alias(c) for c, x in zip(names, LOG.split(", "), strict=True)]), "live-log")

    logs, errors = isolated(paths, made)
    log = reduce(DataFrame.unionByName, logs) if logs else spark.createDataFrame([], LOG)
    told = spark.createDataFrame(list(errors.items()), "path string, reason string")
    lost = files.join(log.select("run", "subrun").distinct(), ["run", "subrun"], "left_anti").join(told, "path", "left")
    return log, lost.select("path", "run", "subrun", F.coalesce("reason", F.lit("no events in file")).alias("reason"))


def watch(spark: SparkSession, folder: str, score: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, since: str | None = None, max_files: int = 1000, seconds: float | None = 5.0) -> StreamingQuery:
    """Files that arrive in ``folder`` become rows of ``target``/log; files that give none are told in ``target``/skipped.

    Each micro-batch writes folders of its own, so one that is taken up again
    after a failure replaces what it had written.  A skipped file leaves a row
    of nulls in the log, since it takes a place in its run.  ``seconds=None``
    works off what is there and stops.
    """

    def batch(df: DataFrame, number: int) -> None:
        paths = [r["path"] for r in df.select("path").collect()]  # max_files at most
        if not paths:
            return
        log, skipped = scored_files(spark, paths, score)
        skipped = storage.written(skipped, "live-skipped")
        lost = skipped.where("run is not null").select("run", "subrun", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in LOG.split(", ")[2:]])
        # all rows of a file in one part, so that they stay together downstream
        log.unionByName(lost).repartition("run", "subrun").write.mode("overwrite").parquet(f"{target}/log/batch={number}")
        skipped.write.mode("overwrite").parquet(f"{target}/skipped/batch={number}")

    writer = file_stream(spark, folder, max_files, since).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def files_before(spark: SparkSession, target: str, number: int) -> int:
    """Files with a decision in the batches before this one, from what was committed: a restart counts on."""
    if number == 0:
        return 0
    last = f"{target}/progress/{number - 1}.json"
    if storage.exists(spark, last):
        return json.loads(spark.read.text(last, wholetext=True).first()["value"])["after"]
    if not storage.exists(spark, f"{target}/decisions"):
        return 0
    return spark.read.schema(f"{DECISIONS}, batch bigint").parquet(f"{target}/decisions").where(F.col("batch") < number).count()


def decide(spark: SparkSession, target: str, checkpoint: str, config: DetectorConfig, each: Callable[[DataFrame, int], None] | None = None, good_list: str | None = None, folder: str = "", every: int = 0, refresh: Callable[[int], None] | None = None, seconds: float | None = 5.0, idle: float = IDLE_SECONDS) -> StreamingQuery:
    """Decisions on the files of ``target``/log go to ``target``/decisions and, as they are released, to the good list.

    ``good_list`` gets the paths of released files, below ``folder``; ``each``
    sees every batch of decisions; ``refresh`` is called with the number of files so
    far whenever that passes a multiple of ``every``.  All that a batch writes
    bears its number and is replaced when the batch is taken up again, so
    decisions, list and count have each file once whatever fails; ``each`` and
    ``refresh`` may see a batch again.  A run without a file for ``idle``
    seconds is forgotten.
    """

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/decisions/batch={number}")
        rows = spark.read.schema(DECISIONS).parquet(f"{target}/decisions/batch={number}")
        if good_list is not None:
            released = rows.select("run", F.explode(F.split("released", ",")).alias("subrun")).where("subrun <> ''")
            put_good_list(released.select(F.format_string(f"{folder.rstrip('/')}/Digitizer_run%d_subrun%s.csv", "run", "subrun").alias("path")), good_list, number)
        if each is not None:
            each(rows, number)
        before = files_before(spark, target, number)
        after = before + rows.count()
        storage.write_text(spark, f"{target}/progress/{number}.json", [json.dumps({"after": after})])
        if refresh is not None and every and after // every > before // every:
            refresh(after)

    stream = spark.readStream.schema(f"{LOG}, batch bigint").parquet(f"{target}/log")
    decisions = live_status(stream, config.alert_consecutive_n, config.file_alert_n_channels, config.single_file_alert_n_channels, config.single_file_alert_max_z, idle)
    writer = decisions.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def test_sample(spark: SparkSession, folder: str, n: int, seed: int = 42) -> DataFrame:
    """(path, filename, run, subrun) of ``n`` of the files that are there, in order; the same for the same seed."""
    files = list_files(spark, f"{folder}/{PATTERN}")
    return exact_sample(files, n, ["path"], seed).orderBy(*file_order(), "path")


def status_of(persistent: int, anomalous: int, worst: float, least: int, bulk: int, extreme: float) -> str:
    if persistent >= least or 0 < bulk <= anomalous or 0 < extreme <= worst:
        return "alert"
    return "warn" if persistent else "ok"


class RunJudge(StatefulProcessor):
    """Judges the files of one run after another; a timer forgets a run that has had no file for a while."""

    def __init__(self, n: int, least: int, bulk: int, extreme: float, idle_ms: int):
        self.n, self.rule, self.idle_ms = n, (least, bulk, extreme), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", PROGRESS)
        self.held = handle.getListState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        history: dict[str, str] = {}
        index = 0
        if self.progress.exists():
            channels, flags, index, forget_at = self.progress.get()
            history = dict(zip(channels, flags, strict=True))
            self.handle.deleteTimer(forget_at)
        held = [x[0] for x in self.held.get()] if self.held.exists() else []
        out = []
        files = pd.concat(list(rows), ignore_index=True)
        now = int(files["now"].max())
        for subrun, own in files.groupby("subrun", sort=True):
            own = own.dropna(subset=["channel"])
            if not own.empty:
                judged, held = self.judged(int(subrun), own, history, index, held)
                out.append((int(key[0]), *judged))
            index += 1
        forget_at = now + self.idle_ms
        self.progress.update((list(history), list(history.values()), index, forget_at))
        if held:
            self.held.put([(s,) for s in held])
        else:
            self.held.clear()
        self.handle.registerTimer(forget_at)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in DECISIONS.split(", ")])

    def judged(self, subrun: int, rows: pd.DataFrame, history: dict[str, str], index: int, held: list[int]) -> tuple[tuple, list[int]]:
        """(decision on a file, files held after it); its flags go into the history."""
        n = self.n
        once = rows.groupby("channel")["anomalous"].max()
        z = rows.loc[rows["anomalous"].astype(bool), "max_z"].dropna()
        persistent = 0
        for channel, bad in once.items():
            past = history.get(channel, "")
            persistent += bool(bad) and past == "1" * (n - 1)
            history[channel] = (past + "01"[bool(bad)])[-(n - 1) :] if n > 1 else ""
        anomalous = int(once.sum())
        status = status_of(persistent, anomalous, float(z.max()) if len(z) else 0.0, *self.rule)
        if status == "alert":
            return (subrun, index, anomalous, persistent, status, "drop", ""), []
        if index < n - 1 and anomalous:
            return (subrun, index, anomalous, persistent, status, "hold", ""), [*held, subrun]
        return (subrun, index, anomalous, persistent, status, "list", ",".join(map(str, [*held, subrun]))), []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.progress.clear()
        self.held.clear()
        yield pd.DataFrame(columns=[x.split()[0] for x in DECISIONS.split(", ")])

    def close(self) -> None:
        pass


def live_status(log: DataFrame, n: int = 1, least: int = 1, bulk: int = 0, extreme: float = 0.0, idle: float = IDLE_SECONDS) -> DataFrame:
    """Decisions on the files of a streaming anomaly log (run, subrun, channel, anomalous, max_z).

    A file's rows are expected in one micro-batch, as a file source gives them.
    A file whose only row has no channel was skipped: it takes a place in its
    run and nothing else.  The state of a run has its channels' last n - 1
    flags, a file index and the held files; ``released`` lists files that a
    decision lets into the good list.  State is kept by RocksDB, and that of a
    run without a file for ``idle`` seconds is dropped: a file that comes after
    that begins the run anew.  The clock is the time at which micro-batches
    begin, so no row is ever late, and a batch taken up again has its old time.
    """
    spark = log.sparkSession
    # the driver looks at the processor in a Python process of its own, which shipped files do not reach
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keyed = log.select("run", "subrun", F.col("channel").cast("string").alias("channel"), "anomalous", "max_z", F.current_timestamp().alias("at")).where("run is not null")
    timed = keyed.withWatermark("at", "0 seconds").withColumn("now", F.unix_millis("at"))
    return timed.groupBy("run").transformWithStateInPandas(RunJudge(n, least, bulk, extreme, int(1000 * idle)), DECISIONS, "Append", "EventTime")


def run_to_end(rows: DataFrame, target: str, checkpoint: str) -> None:
    """Works off what is there, into a Parquet folder, and stops."""
    query = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
