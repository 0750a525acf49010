"""The live monitor under failures: outputs once, counts across restarts, closed runs forgotten, bad files apart."""

import math
import random

import pytest

from runlens import config
from runlens.sources import writers
from runlens.streaming import monitor

CONFIG = config.DetectorConfig(alert_consecutive_n=2, file_alert_n_channels=1)


def put(spark, target, number, files):
    """Log rows of files (run, subrun, {channel: anomalous}) as the first stream writes them."""
    rows = [(run, s, c, bad, "m", "", 9.0 if bad else 1.0, None) for run, s, own in files for c, bad in own.items()]
    spark.createDataFrame(rows, monitor.LOG).coalesce(1).write.parquet(f"{target}/log/batch={number}")


def run(spark, target, checkpoint, **more):
    monitor.decide(spark, target, checkpoint, CONFIG, good_list=f"{target}/good", folder="/data", seconds=None, **more).awaitTermination()


def listed(spark, target):
    return sorted(x.path for x in writers.good_list(spark, f"{target}/good").collect())


def name(run_, subrun):
    return f"/data/Digitizer_run{run_}_subrun{subrun}.csv"


def test_a_batch_taken_up_again_lists_its_files_once(spark, tmp_path):
    target, checkpoint = f"{tmp_path}/out", f"{tmp_path}/c"
    put(spark, target, 0, [(1, 1, {"a": False}), (1, 2, {"a": False})])
    run(spark, target, checkpoint)
    put(spark, target, 1, [(1, 3, {"a": False}), (2, 1, {"a": False})])
    broken = []

    def each(rows, number):  # after the list is written, before the batch is committed
        if not broken:
            broken.append(number)
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(spark, target, checkpoint, each=each)
    assert listed(spark, target) == [name(1, 1), name(1, 2), name(1, 3), name(2, 1)]
    run(spark, target, checkpoint, each=each)
    assert broken
    assert listed(spark, target) == [name(1, 1), name(1, 2), name(1, 3), name(2, 1)]
    assert spark.read.parquet(f"{target}/decisions").count() == 4


def test_refresh_counts_on_after_a_restart(spark, tmp_path):
    batches = [[(1, s, {"a": False}) for s in own] for own in ([1, 2], [3], [4, 5, 6], [7])]
    seen = {}
    for how in ("one by one", "at once"):
        target, checkpoint, seen[how] = f"{tmp_path}/{how}", f"{tmp_path}/c {how}", []
        for number, own in enumerate(batches):
            put(spark, target, number, own)
            if how == "one by one":
                run(spark, target, checkpoint, every=3, refresh=seen[how].append)
        if how == "at once":
            run(spark, target, checkpoint, every=3, refresh=seen[how].append)
    assert seen["one by one"] == [3, 6]
    assert seen["at once"][-1] >= 6


def test_count_without_progress_file(spark, tmp_path):
    target = f"{tmp_path}/out"
    assert monitor.files_before(spark, target, 0) == monitor.files_before(spark, target, 3) == 0
    spark.createDataFrame([(1, 1, 0, 0, 0, "ok", "list", "1")], monitor.DECISIONS).write.parquet(f"{target}/decisions/batch=0")
    spark.createDataFrame([(1, 2, 0, 0, 0, "ok", "list", "2")], monitor.DECISIONS).write.parquet(f"{target}/decisions/batch=5")
    assert monitor.files_before(spark, target, 3) == 1


def test_closed_runs_are_forgotten(spark, tmp_path):
    target, checkpoint = f"{tmp_path}/out", f"{tmp_path}/c"

    def known():
        rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "progress").load()
        return {x.key.run for x in rows.collect()}

    put(spark, target, 0, [(1, 1, {"a": True}), (2, 1, {"a": False})])
    run(spark, target, checkpoint)
    assert known() == {1, 2}
    put(spark, target, 1, [(3, 1, {"a": False})])
    run(spark, target, checkpoint, idle=0.0)  # new timers only: those of runs 1 and 2 are a week away
    assert known() == {1, 2}
    put(spark, target, 2, [(4, 1, {"a": False})])
    put(spark, target, 3, [(1, 2, {"a": True})])
    run(spark, target, checkpoint, idle=0.0)
    put(spark, target, 4, [(5, 1, {"a": False})])
    run(spark, target, checkpoint, idle=3600.0)
    assert known() == {2, 5}
    put(spark, target, 5, [(1, 3, {"a": True})])
    run(spark, target, checkpoint)
    got = {(x.run, x.subrun): (x.file_index, x.decision) for x in spark.read.parquet(f"{target}/decisions").collect()}
    assert got[1, 2] == (1, "drop")  # the second anomalous file of a run that is known
    assert got[1, 3] == (0, "hold")  # forgotten meanwhile: the run begins anew


@pytest.mark.parametrize("named", [False, True])
def test_bad_files_are_found_by_halves(named):
    paths = [f"/in/Digitizer_run1_subrun{i}.csv" for i in range(500)]
    bad, tried = set(random.Random(1).sample(paths, 3)), []

    def attempt(own):
        tried.append(own)
        worst = sorted(bad & set(own))
        if worst:
            raise RuntimeError(f"failed in {worst[0]}" if named else "failed")
        return own

    done, errors = monitor.isolated(paths, attempt)
    assert sorted(p for own in done for p in own) == sorted(set(paths) - bad)
    assert set(errors) == bad
    assert len(tried) <= (7 if named else 1 + 2 * 3 * math.log2(500))
    assert monitor.isolated([], attempt) == ([], {})


def test_many_files_three_bad(spark, tmp_path):
    from pyspark.sql import functions as F

    from .test_operators import hits_file

    for s in range(40):
        hits_file(tmp_path, 1, s, [666 if s in (3, 4, 31) else 1])
    score = lambda hits: hits.groupBy("run", "subrun", "channel").agg(F.max("nPulses").alias("x")).select("run", "subrun", F.col("channel").cast("string").alias("channel"), F.when(F.col("x") == 666, F.raise_error(F.lit("poison"))).otherwise(F.col("x") > 5).cast("boolean").alias("anomalous"))
    log, skipped = monitor.scored_files(spark, [str(tmp_path / f"Digitizer_run1_subrun{s}.csv") for s in range(40)], score)
    assert {x.subrun for x in log.select("subrun").distinct().collect()} == set(range(40)) - {3, 4, 31}
    assert {x.subrun for x in skipped.where("reason like '%poison%'").collect()} == {3, 4, 31}
