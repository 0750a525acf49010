"""Operators against small loops that state their rules, and the edge cases."""

import datetime
import json
import os
import random
import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from runlens import config, storage
from runlens.functions import scalar
from runlens.operators import catalogue, detect, features, forest, reference, report, sampling, status, sweeps
from runlens.plans import steps
from runlens.sources import readers, writers
from runlens.streaming import monitor


def random_log(spark, seed, runs=8, files=7, channels=4):
    r = random.Random(seed)
    rows = [(run, s, f"c{c}", bad, r.uniform(5, 20) if bad else r.uniform(0, 4)) for run in range(runs) for s in range(r.randint(1, files)) for c in range(channels) if r.random() < 0.9 for bad in [r.random() < 0.4]]
    return spark.createDataFrame(rows, "run int, subrun int, channel string, anomalous boolean, max_z double"), rows


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_persistence_is_a_queue_of_flags(spark, n):
    log, rows = random_log(spark, n)
    past, want = {}, {}
    for run, s, c, bad, _ in sorted(rows):
        q = past.setdefault((run, c), deque(maxlen=max(1, n - 1)))
        want[run, s, c] = bad and (n == 1 or len(q) == n - 1 and all(q))
        q.append(bad)
    got = {(x.run, x.subrun, x.channel): x.persistent for x in status.streaks(log, n).collect()}
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 3])
def test_good_list_and_stream(spark, n, tmp_path):
    log, _ = random_log(spark, 10 + n)
    files = status.file_status(log, n, 2, 4, 19.0)
    want, held, last = {}, [], None
    for x in sorted(files.collect(), key=lambda x: (x.run, x.subrun)):
        if x.run != last:
            held, index, last = [], 0, x.run
        if x.status == "alert":
            held = []
        elif index < n - 1 and x.n_anomalous:
            held.append(x.subrun)
        else:
            want |= {(x.run, s): True for s in [*held, x.subrun]}
            held = []
        index += 1
    got = {(x.run, x.subrun) for x in status.good_list(files, n).where("listed").collect()}
    assert got == set(want)
    log.coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    monitor.run_to_end(monitor.live_status(stream, n, 2, 4, 19.0), f"{tmp_path}/out", f"{tmp_path}/state")
    live = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(x.run, int(s)) for x in live for s in x.released.split(",") if s} == got
    assert {(x.run, x.subrun): x.n_persistent for x in live} == {(x.run, x.subrun): x.n_persistent for x in files.collect()}


def test_hand_checked_status(spark):
    bad = {(1, 1): "ab", (1, 2): "ab", (1, 3): "ab", (1, 4): "a", (1, 5): "", (1, 10): "c", (2, 1): "a", (3, 1): "abcde"}
    rows = [(run, s, c, c in names, (20.0 if c == "c" and s == 10 else 7.0) if c in names else 1.0) for (run, s), names in bad.items() for c in "abcdef"]
    log = spark.createDataFrame(rows, "run int, subrun int, channel string, anomalous boolean, max_z double")
    files = status.file_status(log, 3, 2, 5, 15.0)
    got = {(x.run, x.subrun): x.status for x in files.collect()}
    assert got == {(1, 1): "ok", (1, 2): "ok", (1, 3): "alert", (1, 4): "warn", (1, 5): "ok", (1, 10): "alert", (2, 1): "pend", (3, 1): "alert"}
    assert {(x.run, x.subrun) for x in status.good_list(files, 3).where("listed").collect()} == {(1, 4), (1, 5)}
    kinds = {x.run: x for x in status.classify_runs(log, 2).collect()}
    assert (kinds[1].classification, kinds[2].classification, kinds[3].classification) == ("mixed", "good", "bad")
    assert (kinds[1].first_bad_subrun, kinds[1].last_good_subrun) == (1, 10)
    assert {x.status for x in status.file_status(log, 1, 0).collect()} == {"alert"}  # no channel needed: every file alerts


def test_fold_with_nulls(spark):
    v = spark.createDataFrame([(1, 1, None), (1, 2, 10.0), (1, 3, 12.0), (2, 1, 5.0), (3, 1, None)], "channel int, o int, x double")
    got = {x.channel: x for x in reference.ordered_fold(v, ["channel"], "o").collect()}
    assert got[1].n == 3 and got[1].mean == pytest.approx(7.3333, abs=1e-3) and got[1].m2 == pytest.approx(82.6667, abs=1e-3)
    state = reference.reference_state(v, ["x"])
    clean = {x.channel: x for x in reference.reference_stats(state).collect()}
    assert (clean[1].n, clean[1].mean, clean[1].std) == (2, 11.0, 1.0) and clean[2].std == 1.0 and clean[3].std is None
    same = reference.reference_stats(reference.reference_state(spark.createDataFrame([(1, 4.0), (1, 4.0)], "channel int, x double"), ["x"])).first()
    assert same.std == reference.FLOOR
    merged = {x.channel: x for x in reference.merge_states(state.where("channel < 3"), state.where("channel = 3")).collect()}
    assert merged[3].n == 0 and merged[1].mean == 11.0


def test_detection_edges(spark):
    z = spark.createDataFrame([(1, 1, "0", 6.0, None, True), (1, 1, "1", 5.0, -7.0, True), (1, 1, "2", None, None, True), (1, 1, "9", None, None, False)], "run int, subrun int, channel string, a double, b double, known boolean")
    channels = spark.createDataFrame([("0",), ("1",), ("2",), ("3",)], "channel string")
    got = {x.channel: x for x in detect.detection_log(z, ["a", "b"], 5.0, channels).collect()}
    assert (got["0"].method, got["0"].triggered_features, got["0"].max_z) == ("statistical", "a", 6.0)
    assert got["1"].triggered_features == "b"  # the threshold itself does not trigger
    assert not got["2"].anomalous and got["2"].max_z is None
    assert got["9"].method == "new_channel" and got["3"].method == "missing_channel"
    both = detect.detection_log(z.withColumns({"if_flag": F.lit(True), "if_score": F.lit(-0.7)}), ["a", "b"], 5.0)
    assert {x.channel: x.method for x in both.collect()} == {"0": "statistical+IF", "1": "statistical+IF", "2": "isolation_forest", "9": "new_channel"}


def test_distinct_events_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks get more, not larger, with more hits; the features stay."""
    hits = spark.range(20_000).selectExpr("int(id % 3) as run", "int(id % 2) as subrun", "int(id % 5) as channel", "id % 7000 as event_id", "double(id % 3) as nPulses")
    want = sorted(map(tuple, features.channel_features(hits, [], only=["occupancy", "frac_dead"]).collect()))
    monkeypatch.setattr(features, "EVENT_ROWS", 1000)
    assert features.distinct_events(hits, F.lit(False), "event_id", 20_000).groupBy(F.spark_partition_id()).count().agg({"count": "max"}).first()[0] < 2000
    assert sorted(map(tuple, features.channel_features(hits, [], only=["occupancy", "frac_dead"], n_hits=5000).collect())) == want
    assert sorted(map(tuple, features.channel_features(hits, [], only=["occupancy", "frac_dead"]).collect())) == want


def test_features_of_rare_cases(spark):
    rows = [(1, 1, 0, 1, 2.0, 1.0), (1, 1, 0, 2, 4.0, 0.0), (1, 1, 1, 1, None, 1.0), (1, 1, None, 3, 1.0, 1.0)]
    hits = spark.createDataFrame(rows, "run int, subrun int, channel int, event_id int, m double, nPulses double")
    got = {x.channel: x for x in features.channel_features(hits, ["m"]).collect()}
    assert got[0].m_mean == 3.0 and got[0].frac_dead == 0.5 and got[0].occupancy == pytest.approx(2 / 3)
    assert (got[1].m_mean, got[1].m_std, got[1].m_median) == (0.0, 0.0, 0.0)
    assert features.channel_features(hits.limit(0), ["m"]).count() == 0
    assert len(features.feature_columns()) == 55 and len(features.feature_columns(use_trigger=False, use_lvds=False)) == 35
    assert not [c for c in features.feature_columns(exclude=("TDC*",)) if c.startswith("TDC")]


def test_mask_and_pins(spark):
    pins = features.masked_channels()
    assert len(pins) == 48 and pins[32][0] == 40
    f = spark.createDataFrame([(1, 1, c, 1.0) for c in range(96)], "run int, subrun int, channel_num int, a double")
    mask = spark.createDataFrame([(1, [255, 255, 255, 255, 0, 0xF6, 255, 0xC1])], "run int, mask array<int>")
    assert {x.channel_num for x in features.null_masked(f, mask, ["a"]).where("a is null").collect()} == {64, 65}
    usual = spark.createDataFrame([(1, [255, 255, 255, 255, 0, 0xF7, 255, 0xC1])], "run int, mask array<int>")
    assert features.null_masked(f, usual, ["a"]).where("a is null").count() == 0


def test_repeated_headers(spark):
    text = "9, 9\nsubrunnum, triggerRate_bit1 , triggerRate_tot\n1, 0.5, bad\n\nsubrunnum, triggerRate_tot\n2 , 7.25\n2, 8\n"
    rows = readers.trigger_rows(spark.createDataFrame([("d/TriggerBoard_run7.csv", text)], "path string, value string"))
    got = {x.subrun: x for x in features.first_by_file(rows).collect()}
    assert set(got) == {1, 2} and got[1].run == 7 and got[1].triggerRate_bit1 == 0.5 and got[1].triggerRate_tot is None
    assert got[2].triggerRate_tot == 7.25 and got[2].triggerRate_bit1 is None


def test_run_config(spark, tmp_path):
    text = "# triggerBoard.trigger = 1\ntriggerBoard.trigger = 3\ntriggerBoard.trigger = 0b101   # the last one\ntriggerBoard.prescale = [1, 2, 10]\ntriggerBoard.trigger_mask = [0xff, 0x00]\n"
    (tmp_path / "Run12TriggerDefault.py").write_text(text)
    got = readers.read_run_configs(spark, [str(tmp_path)]).first()
    assert (got.run, got.trigger, got.prescale, got.mask) == (12, 5, [10.0, 2.0, 1.0], [255, 0])
    board = spark.createDataFrame([(12, 1, 20.0, 6.0, 3.0), (13, 1, 20.0, 6.0, 3.0), (14, 1, 1.0, 1.0, 1.0)], "run int, subrun int, triggerRate_bit1 double, triggerRate_bit2 double, triggerRate_bit3 double")
    c = spark.createDataFrame([(12, [10.0, 2.0, 0.0], 5), (13, None, 7)], "run int, prescale array<double>, trigger bigint")
    rates = {x.run: (x.triggerRate_bit1, x.triggerRate_bit2, x.triggerRate_bit3) for x in features.normalised_rates(board, c).collect()}
    assert rates == {12: (2.0, None, None), 13: (None, None, None), 14: (1.0, 1.0, 1.0)}


def test_catalogue(spark):
    doc = {"data": [[1601, 1, True, True, True, 0, "v1"], [1602, -1, True, True, False, 0, "v1"], [1603, 1, True, False, False, 0, "v1"], [1603, 1, False, False, False, 0, "v2"]]}
    c = catalogue.last_entries(readers.parse_catalogue(spark.createDataFrame([(json.dumps(doc),)], "value string")))
    assert catalogue.select_catalogue(c, "All").count() == 2 and catalogue.select_catalogue(c, "Tight").count() == 1
    files = spark.createDataFrame([(1601, 1), (1602, 4), (1602, 5), (1603, 1)], "run int, subrun int")
    assert {tuple(x) for x in catalogue.expand_catalogue(catalogue.select_catalogue(c, "Loose"), files).collect()} == {(1601, 1), (1602, 4), (1602, 5)}
    gt = {(x.run, x.subrun): x.gt for x in catalogue.ground_truth(files, c).collect()}
    assert gt == {(1601, 1): "known_good", (1602, 4): "unknown", (1602, 5): "unknown", (1603, 1): "not_certified"}


def test_globs_and_samples(spark):
    found = {"a*": ["a1", "a2"], "a1": ["a1"], "b": []}
    assert readers.expand_globs(["# note", "", "a1", "a*", "b"], found.get) == (["a1", "a2"], ["b"])
    rows = spark.range(101)
    a = {x.id for x in sampling.fraction_sample(rows, 0.1, ["id"]).collect()}
    assert len(a) == 10 and a == {x.id for x in sampling.fraction_sample(rows.repartition(7), 0.1, ["id"]).collect()}
    assert sampling.fraction_size(3, 0.1) == 1 and sampling.fraction_size(5, 0.5) == 2
    with pytest.raises(ValueError):
        sampling.fraction_size(0, 0.5)


def test_forest(spark):
    r = random.Random(5)
    rows = [(i, 1, "c", r.gauss(0, 1), r.gauss(0, 1)) for i in range(800)] + [(900, 1, "c", 9.0, 9.0)]
    df = spark.createDataFrame(rows, "run int, subrun int, channel string, a double, b double")
    key = ["run", "subrun", "channel"]
    nodes = forest.fit_forest(df, ["a", "b"], key, n_trees=60).cache()
    again = forest.fit_forest(df.repartition(5), ["a", "b"], key, n_trees=60)
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, again.collect()))
    scored = forest.score_forest(df, ["a", "b"], nodes)
    assert scored.orderBy("if_score").first().run == 900
    flagged = forest.flag_forest(scored, forest.contamination_offset(scored, 0.05)).where("if_flag").count()
    assert 35 <= flagged <= 45


def test_train_apply_and_files(spark, tmp_path):
    r = random.Random(1)
    rows = [(run, s, c, r.gauss(10, 1) + (50 if run == 3 and c == "2" else 0)) for run in range(1, 4) for s in range(6) for c in "012"]
    f = spark.createDataFrame(rows, "run int, subrun int, channel string, a double")
    cfg = config.DetectorConfig(z_threshold=6.0, alert_consecutive_n=2, n_trees=20)
    entries = f.select("run", "subrun").distinct().selectExpr("run", "subrun", "true loose", "true medium", "run < 3 tight", "0 position")
    steps.full(spark, f, f.where("run < 3"), entries, ["a"], cfg, f"{tmp_path}/m")
    log = spark.read.parquet(f"{tmp_path}/m/log")
    assert log.where("run = 3 and channel = '2' and anomalous").count() == 6
    assert {x.run: x.classification for x in spark.read.parquet(f"{tmp_path}/m/run_summary").collect()}[3] in ("persistent_fault", "bad")
    steps.full(spark, f, f, entries, ["a"], cfg, f"{tmp_path}/m")  # all there: nothing is done again
    writers.append_log(log, f"{tmp_path}/log")
    writers.replace_runs(log.where("run = 3"), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == log.count()
    state, nodes, meta = writers.load_model(spark, f"{tmp_path}/m")
    assert nodes is not None and meta["z_threshold"] == 6.0 and state.count() == 3


def test_log_csv_and_hits(spark, tmp_path):
    (tmp_path / "Digitizer_run5_subrun12.csv").write_text(",".join(readers.HITS.names) + "\n1,0,0,0,0,0,nan,1,2,3,4,5,6,7,8,9,x\n")
    got = readers.read_hits(spark, str(tmp_path)).first()
    assert (got.run, got.subrun, got.channel, got.sideband_mean, got.TDCRollovers) == (5, 12, 0, None, None)
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.csv").write_text("timestamp,filename,channel,anomalous,method,triggered_features,max_z,if_score\nt,Digitizer_run5_subrun1.csv,trigger_rate,True,statistical,a;b,7.1,\n")
    row = readers.read_log(spark, str(tmp_path / "log")).first()
    assert (row.run, row.channel, row.anomalous, row.if_score) == (5, "trigger_rate", True, None)


def test_config(tmp_path):
    (tmp_path / "base.json").write_text('{"z_threshold": 6, "base": "ignored.json", "more": 1}')
    (tmp_path / "own.json").write_text('{"base": "base.json", "contamination": 0.01}')
    cfg, rest = config.load_config(tmp_path / "own.json", z_threshold=None, n_trees=50)
    assert (cfg.z_threshold, cfg.contamination, cfg.n_trees) == (6, 0.01, 50) and rest == {"more": 1}
    off = config.disable(cfg, use_trigger=True)
    assert config.tag_of("m", off, "Tight") == "m_Tight_noTrigger"
    assert config.metadata(off, cfg)["overrides"] == {"use_trigger": False}
    with pytest.raises(ValueError):
        config.DetectorConfig(sample_fraction=0.0)


def test_scalars(spark):
    rows = spark.createDataFrame([(None,), (0.0,), (12345.0,), (0.001,), (250.0,), (2.5,), (0.25,)], "x double")
    assert [x.t for x in rows.select(scalar.compact(F.col("x")).alias("t")).collect()] == ["", "0", "1.2e+04", "1.0e-03", "250.0", "2.50", "0.250"]
    assert spark.range(1).select(scalar.number(F.lit(" nan ")).alias("a"), scalar.number(F.lit(" 2.5")).alias("b")).first()[:] == (None, 2.5)


def test_panels_and_reports(spark):
    m = spark.createDataFrame([(c, z) for c, z in zip("abcd", (6.0, 6.0, 8.0, 8.0), strict=True)], "model string, z_threshold double")
    assert sweeps.panels(m, 3).count() == 12 and sweeps.panels(m, 2, (6.0, 8.0)).count() == 8
    replies = spark.createDataFrame([('{"category": "hv"}',), ("no json",)], "response string")
    assert [x.raw_response for x in report.parsed_response(replies).collect()] == [None, "no json"]


def test_half_even_is_the_binary_value(spark):
    r = random.Random(2)
    values = [2.675, 1.005, 0.125, 0.375, -2.675, -0.125, 2.5, 1e11 + 0.125, 0.0, -0.0, 5e-324, 1e300, *(round(r.uniform(-100, 100), 3) for _ in range(500)), *(r.randint(-4000, 4000) / 16 for _ in range(200)), *(r.randint(-9999, 9999) / 1000 + 0.0005 for _ in range(300))]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, x double")
    for places in (1, 2, 4):
        got = {x.i: x.y for x in rows.select("i", scalar.half_even(F.col("x"), places).alias("y")).collect()}
        assert [got[i] for i in range(len(values))] == [round(v, places) for v in values] and got[len(values)] is None


def test_utc_stamp(spark):
    at = datetime.datetime(2024, 7, 1, 12, 0, tzinfo=datetime.timezone.utc)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert spark.createDataFrame([(at,)], "t timestamp").select(scalar.utc_stamp(F.col("t")).alias("s")).first().s == "2024-07-01T12:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_alert_reasons(spark):
    rows = [(1, 1, c, True, 7.0) for c in ("3", "trigger_rate")] + [(1, 2, "3", True, 20.25), (1, 2, "4", True, 8.0), (1, 2, "trigger_rate", True, None), (1, 2, "5", False, 1.0)]
    log = spark.createDataFrame([(*x, "m", "a;b") for x in rows], "run int, subrun int, channel string, anomalous boolean, max_z double, method string, triggered_features string")
    files = status.file_status(log, 2, 1, 3, 15.0)
    got = {x.subrun: x.reason for x in report.reasons(log, files, 1, 3, 15.0, 2).collect()}
    assert got == {2: "2 persistent + 1 transient anomalous ch  (window: 2 files)  |  3/4 anomalous ch  [bulk ≥3]  |  extreme z=20.2 on ch3"}
    alone = status.file_status(log, 1, 2, 0, 0.0)
    assert {x.subrun: x.reason for x in report.reasons(log, alone, 2).collect()} == {1: "2 persistent anomalous ch", 2: "3 persistent anomalous ch"}
    text = report.alert_text(log, files, 1, 3, 15.0, 1, 2).first().text
    assert text.startswith("run 1 subrun 2: 2 persistent") and text.endswith(" | ch3 (a;b) and 1 more")


def test_new_channels_have_no_score(spark):
    z = spark.createDataFrame([(1, 1, "0", 1.0, True, -0.4, True), (1, 1, "9", None, False, -0.4, True)], "run int, subrun int, channel string, a double, known boolean, if_score double, if_flag boolean")
    got = {x.channel: (x.method, x.if_score) for x in detect.detection_log(z, ["a"], 5.0).collect()}
    assert got == {"0": ("isolation_forest", -0.4), "9": ("new_channel", None)}


def test_forest_of_few_rows_keeps_its_size(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(i, 1, "c", r.gauss(0, 1)) for i in range(50)], "run int, subrun int, channel string, a double")
    nodes = forest.fit_forest(df, ["a"], ["run", "subrun", "channel"], n_trees=40)
    assert {x["size"] for x in nodes.select("size").distinct().collect()} == {50}
    mean = forest.score_forest(df, ["a"], nodes).agg(F.avg("if_score")).first()[0]
    assert -0.6 < mean < -0.45
    assert forest.contamination_offset(forest.score_forest(df.limit(0), ["a"], nodes), 0.1) is None


def test_directory_is_part_of_a_file(spark):
    f = spark.createDataFrame([("a", 1, 1, 0, 1.0), ("b", 1, 1, 0, 1.0)], "directory string, run int, subrun int, channel int, m double")
    side = spark.createDataFrame([("a", 1, 1, 2, 5.0, 9.0), ("a", 1, 1, 1, 4.0, 8.0), ("b", 1, 2, 1, 6.0, 7.0)], "directory string, run int, subrun int, line int, triggerRate_tot double, LVDStotal double")
    first = features.first_by_file(side)
    got = {(x.run, x.channel): x for x in features.with_pseudo_rows(f, f, first, None, ["m", "triggerRate_tot"]).where("channel_num is null and triggerRate_tot is not null").collect()}
    assert len(got) == 1 and got[1, "trigger_rate"].triggerRate_tot == 4.0  # the first line, of the same directory only
    pins = first.select("directory", "run", "subrun", F.create_map(F.lit(0), F.lit(3.0)).alias("pins"))
    assert {x.directory: x.LVDSpin for x in features.with_lvds_pin(f, pins).collect()} == {"a": 3.0, "b": None}


def test_lists_patterns_and_cases(spark, tmp_path):
    for n in ("Digitizer_run1601_subrun2.csv", "Digitizer_run1601_subrun10.csv", "Digitizer_run1650_subrun1.csv"):
        (tmp_path / "slab" / "1600").mkdir(parents=True, exist_ok=True)
        (tmp_path / "slab" / "1600" / n).write_text("x")
    (tmp_path / "list.txt").write_text(f"# note\n\n{tmp_path}/slab/1600/*run1650*\n{tmp_path}/slab/1600/*\n{tmp_path}/none*\n")
    paths, lost = readers.run_list(spark, f"file://{tmp_path}/list.txt")
    assert [os.path.basename(p) for p in paths] == ["Digitizer_run1650_subrun1.csv", "Digitizer_run1601_subrun10.csv", "Digitizer_run1601_subrun2.csv"] and lost == [f"{tmp_path}/none*"]
    cfg = config.DetectorConfig()
    assert steps.files_to_apply(spark, cfg, run=1650, root=str(tmp_path))[0] == paths[:1]
    assert steps.files_to_apply(spark, cfg, run=7, root=str(tmp_path)) == ([], ["run 7"])
    assert steps.files_to_apply(spark, cfg, text_list=f"{tmp_path}/list.txt")[0] == paths
    doc = {"data": [[1601, -1, True, True, True, 0, "v"], [1650, 1, True, False, False, 0, "v"], [1650, 9, True, False, False, 0, "v"], [1700, -1, False, False, False, 0, "v"]]}
    (tmp_path / "cat.json").write_text(json.dumps(doc))
    found, missed = steps.files_to_apply(spark, cfg, catalogue=f"{tmp_path}/cat.json", root=str(tmp_path))
    assert [os.path.basename(p) for p in found] == ["Digitizer_run1601_subrun2.csv", "Digitizer_run1601_subrun10.csv", "Digitizer_run1650_subrun1.csv"] and missed == ["run 1650 subrun 9"]
    assert len(steps.files_to_apply(spark, config.replace(cfg, sample_fraction=0.3), catalogue=f"{tmp_path}/cat.json", root=str(tmp_path))[0]) == 1
    for bad in ({}, {"run": 1, "text_list": "x"}):
        with pytest.raises(ValueError):
            steps.files_to_apply(spark, cfg, **bad)
    files = spark.createDataFrame([(f"logs/m/m_run{p}.csv",) for p in ("1", "12", "2x", "[3]")] + [("logs/m/other.csv",)], "filename string")
    parts = lambda pattern: sorted(x.filename[12:-4] for x in readers.matching_runs(files, "m", pattern).collect())
    assert parts("*") == ["1", "12", "2x", "[3]"] and parts("1?") == ["12"] and parts("[!1]*") == ["2x", "[3]"] and parts("[[]3]") == ["[3]"] and parts("1") == ["1"] and parts("[12") == []
    (tmp_path / "kb.json").write_text(json.dumps([{"run": 5, "category": "hv", "more": 1}, {"run": 6}]))
    assert [tuple(x)[:2] for x in readers.read_knowledge_base(spark, f"{tmp_path}/kb.json").collect()] == [(5, "hv"), (6, None)]
    assert readers.first_catalogue(spark, [{}, {"goodRunsList_json": f"{tmp_path}/no.json"}, {"goodRunsList_json": f"{tmp_path}/cat.json"}]) == f"{tmp_path}/cat.json"
    assert readers.run_directory("r", 1699) == "r/slab/1600/Digitizer_run1699_subrun*.csv"


def test_small_sinks(spark, tmp_path):
    out = f"{tmp_path}/m"
    tiers = spark.createDataFrame([(2, 1, 1, 1, 0), (1, 10, 0, 0, 0), (1, 2, 1, 1, 1)], "run int, subrun int, loose int, medium int, tight int")
    writers.write_framework(tiers, f"{out}/model/framework.json", "v1")
    assert json.loads((tmp_path / "m" / "model" / "framework.json").read_text())["data"] == [[1, 2, 1, 1, 1, 0, "v1"], [1, 10, 0, 0, 0, 0, "v1"], [2, 1, 1, 1, 0, 0, "v1"]]
    (tmp_path / "m" / "model" / "broken.json").write_text("{")
    assert {(x.model, x.run, x.subrun, x.tight) for x in readers.read_framework(spark, f"{out}/model/*.json").collect()} == {("model", 1, 2, 1), ("model", 1, 10, 0), ("model", 2, 1, 0)}
    assert readers.unread_framework(spark, f"{out}/model/*.json").count() == 1
    judged = spark.createDataFrame([("known_good", "ok"), ("known_good", "ok"), ("known_good", "alert"), ("unknown", "warn")], "gt string, status string")
    counts = writers.write_confusion(judged, f"{out}/model/confusion/confusion.json")
    read = readers.read_confusion(spark, f"{out}/model/confusion/confusion.json")
    assert {(x.gt, x.status): x.n for x in read.collect()} == {("known_good", "ok"): 2, ("known_good", "alert"): 1, ("unknown", "warn"): 1}
    assert sweeps.from_confusion(read).first()[1:4] == (3, 1, 2)
    writers.write_summary(counts, spark, f"{out}/summary.txt")
    assert "known_good: 3 files; alert 1 (33.3 %), ok 2 (66.7 %)" in (tmp_path / "m" / "summary.txt").read_text()
    for number, part in enumerate(("a", "b")):
        writers.put_good_list(spark.createDataFrame([(part,)], "path string"), f"{out}/good", number)
    lines = [x.value for x in spark.read.text(f"{out}/good").collect()]
    assert sorted(lines) == ["# files that passed the live quality gate", "a", "b"] and readers.expand_globs(lines, lambda p: [p])[0] in (["a", "b"], ["b", "a"])
    writers.append_suggestions(spark.createDataFrame([(1, "x")], "run int, response string"), f"{out}/suggestions")
    assert json.loads(spark.read.text(f"{out}/suggestions").first().value) == {"run": 1, "response": "x"}
    assert writers.remove_outputs(spark, out, ["good", "none"]) == [f"{out}/good"] and storage.exists(spark, f"{out}/good")
    assert writers.remove_outputs(spark, out, ["good", "none"], confirmed=True) and not storage.exists(spark, f"{out}/good")
    for name, log in (("a", "1"), ("b", "2")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.csv").write_text(f"timestamp,filename,channel,anomalous,method,triggered_features,max_z,if_score\nt,Digitizer_run{log}_subrun1.csv,3,True,m,f,1,\n")
        (tmp_path / f"{name}.txt").write_text("p2\np1\n\n" if name == "a" else "p3\np2\n")
    log, paths = writers.combine_folders(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], [f"{tmp_path}/a.txt", f"{tmp_path}/b.txt"])
    assert log.count() == 2 and [x.path for x in paths.collect()] == ["p2", "p1", "p3"]
    assert not writers.newer_than(spark, f"{tmp_path}/a.txt", f"{tmp_path}/b.txt")
    os.utime(tmp_path / "a.txt", (time.time() + 60, time.time() + 60))
    assert writers.newer_than(spark, f"{tmp_path}/a.txt", f"{tmp_path}/b.txt")
    (tmp_path / "t.json").write_text('{"1": {"2": 0.5}}')
    assert [tuple(x) for x in readers.read_thresholds(spark, f"{tmp_path}/t.json").collect()] == [(18, 0.5)] and readers.uniform_thresholds(spark, 1.5).count() == 96


def test_plot_tables(spark):
    files = spark.createDataFrame([(1, 1, "ok", 0), (1, 2, "alert", 3), (2, 2, "pend", 1), (2, 3, "alert", 9), (2, 4, "warn", 1), (None, None, "alert", 4)], "run int, subrun int, status string, n_anomalous int")
    assert {(x.run, x.subrun): x.code for x in report.status_grid(files).collect()} == {(1, 1): 1, (1, 2): 4, (1, 3): 0, (1, 4): 0, (2, 1): 0, (2, 2): 2, (2, 3): 4, (2, 4): 3}
    some = sampling.plot_selection(files, 1).collect()
    assert [(x.run, x.subrun) for x in some if x.status == "alert"] == [(2, 3)] and len(some) == 2
    assert sampling.plot_selection(files, -1).count() == 6 and sampling.plot_selection(files, 10).count() == 6
    names = spark.createDataFrame([(n,) for n in ("trigger_lvds_total", "10", "other", "2", "trigger_rate")], "channel string")
    assert [x.channel for x in names.where(report.is_channel(F.col("channel"))).orderBy(*report.channel_order(F.col("channel"))).collect()] == ["2", "10", "trigger_rate", "trigger_lvds_total"]
    assert [x.run for x in files.orderBy(*report.file_order()).collect()] == [1, 1, 2, 2, 2, None]
    stats = spark.createDataFrame([("1", "a", 3, 12345.0, 1.0), ("2", "a", 3, 1.5, 2.0)], "channel string, feature string, n long, mean double, std double")
    assert {x.channel: x.text for x in report.mean_table(stats).collect()} == {"1": "1.2e+04", "2": "1.50"}
    raw = spark.createDataFrame([(1, 1, 4, 1.0), (1, 1, 5, 1.0)], "run int, subrun int, channel int, a double")
    hits = spark.createDataFrame([(4, 2, 9, 9, 9), (4, 1, 7, 3, 0)], "channel int, event_id int, layer int, row int, column int")
    got = {x.channel: (x.masked, x.layer, x.y) for x in report.masked_geometry(raw, raw.withColumn("a", F.when(F.col("channel") == 5, F.col("a"))), ["a"], hits).collect()}
    assert got == {"4": (True, 7, 3.2), "5": (False, None, None)}


def test_prompts_and_answers(spark):
    alerts = spark.createDataFrame([(1, 1, "alert one"), (1, 2, "fail")], "run int, subrun int, text string")
    cases = spark.createDataFrame([(7, "hv", None, 2), (3, None, "crash", 1)], "run int, category string, cause string, position int")

    def provider(prompt):
        if "fail" in prompt:
            raise RuntimeError("no answer")
        return json.dumps({"candidates": [], "reasoning": prompt})

    prompts = report.prompt_text(alerts, cases, "\n---\n## Task")
    out = report.parsed_response(report.categorised(prompts, provider))
    got = {x.subrun: (x.suggestion and x.suggestion.reasoning, x.api_error, x.raw_response) for x in out.collect()}
    assert got[2] == (None, "no answer", None)
    assert got[1][0] == "\n".join(
        ["## Current alert", "", "alert one", "", "---", "", "## Historical reference cases", ""]
        + ["### Case: run 3", "Anomaly data (auto-injected from log):", "  (no anomaly data)", "Human annotation:", "  Category : unknown", "  Cause    : crash", "  Action   : unspecified", "  Recovery : unspecified", ""]
        + ["### Case: run 7", "Anomaly data (auto-injected from log):", "  (no anomaly data)", "Human annotation:", "  Category : hv", "  Cause    : unspecified", "  Action   : unspecified", "  Recovery : unspecified", "---", "## Task"]
    )
    without = report.categorised(report.prompt_text(alerts, cases.limit(0), "task"), provider).collect()
    assert {x.api_error for x in without} == {"knowledge base is empty"}


ANSWER = """
{
  "candidates": [
    {"rank": 1, "category": "hv_trip", "likely_cause": "supply", "suggested_action": "check", "matched_runs": [3, 9, 3], "confidence": "high"},
    {"category": "light_leak", "matched_runs": [], "confidence": "low", "more": 1}
  ],
  "reasoning": "channels of one board"
}"""


@pytest.mark.parametrize("n", [1, 2, 3])
def test_status_at_many_thresholds(spark, n):
    """One window serves all thresholds: as the log flagged and judged at each."""
    r = random.Random(n)
    rows = [(run, s, c, r.choice([None, r.uniform(0, 8)])) for run in (1, 2, 3) for s in range(8 if run < 3 else 2) for c in "abc" if r.random() < 0.9]
    rows += [(1, 3, "a", 7.5)]
    log = spark.createDataFrame(rows, "run int, subrun int, channel string, max_z double")
    z = [1.0, 4.0, 6.5]
    got = sorted(map(tuple, status.status_sweep(log, sweeps.grid(spark, z_threshold=z), n, 2, 3, 7.8).collect()))
    want = []
    for t in z:
        own = log.withColumn("anomalous", F.coalesce(F.col("max_z") > t, F.lit(False)))
        want += [(t, *x) for x in map(tuple, status.file_status(own, n, 2, 3, 7.8).collect())]
    assert got == sorted(want)


TAGS = [
    # fixed values: tags as training jobs carry them, and what they say
    ("model_260521_zThreshold_6sigma_ifContamination_0p001_alertConsec_1", 0.001, 6.0, 1, None, None, None, True, True, True),
    ("model_260521_zThreshold_7sigma_ifContamination_0p05_alertConsec_5_noTrigger_noLVDS", 0.05, 7.0, 5, None, None, None, False, False, True),
    ("model_260521_zThreshold_8sigma_ifContamination_0p01_alertConsec_3_noLVDS_ignoreTriggerConfig", 0.01, 8.0, 3, None, None, None, True, False, False),
    ("model_260429_IFhp_Medium_zThreshold_8sigma_ifContamination_0p002_nEst_300_maxSamp_1024", 0.002, 8.0, None, 300, 1024, "Medium", True, True, True),
    ("model_260429_EXT_Tight", None, None, None, None, None, "Tight", True, True, True),
]


def test_tags(spark):
    got = spark.createDataFrame([(t[0],) for t in TAGS], "tag string")
    assert {tuple(r) for r in got.select("tag", *[c.alias(k) for k, c in scalar.tag_fields(F.col("tag")).items()]).collect()} == {tuple(t) for t in TAGS}


def test_report_files(spark, tmp_path):
    runs = spark.createDataFrame([(12, "good"), (3, "good"), (7, "partial"), (9, "other")], "run int, classification string")
    writers.write_report(runs, f"{tmp_path}/r")
    assert [writers.report_list(spark, f"{tmp_path}/r", k) for k in ("good", "partial", "persistent_fault")] == [[3, 12], [7], []]
    assert spark.read.option("header", True).csv(f"{tmp_path}/r/run_summary").count() == 4


def test_answers_are_laid_out(spark):
    texts = [ANSWER, "no JSON", None, "[1, 2]", ANSWER + " and so on", '{"candidates": "none", "reasoning": "r"}', '{"category": "hv"}', ""]
    parsed = report.parsed_response(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "run int, subrun int, response string"))
    rows = {x.subrun: x for x in parsed.collect()}
    assert len(rows) == len(texts)
    assert {i for i, x in rows.items() if x.parse_error} == {1, 3, 4, 7}
    assert all(rows[i].raw_response == texts[i] and rows[i].suggestion is None for i in (1, 3, 4, 7))
    assert rows[2].suggestion is None and rows[2].parse_error is None
    assert rows[5].suggestion.candidates is None and rows[5].suggestion.reasoning == "r"
    found = report.candidates(parsed).collect()
    assert [(x.subrun, x["rank"], x.category, x.matched_runs, x.confidence, x.reasoning) for x in found] == [(0, 1, "hv_trip", [3, 9, 3], "high", "channels of one board"), (0, 2, "light_leak", [], "low", "channels of one board")]
    cases = spark.createDataFrame([(3, "hv", "trip"), (3, "daq", "crash")], "run int, category string, cause string")
    got = {(x["rank"], x.matched_run, x.case_category) for x in report.matched_cases(report.candidates(parsed), cases).collect()}
    assert got == {(1, 3, "hv"), (1, 3, "daq"), (1, 9, None), (2, None, None)}


def test_snapshot_and_alert_by_largest_z(spark):
    """Literal values of the texts that a categoriser gets."""
    rows = [(5, 1, "3", True, 12.25, -0.61249, "a;b"), (5, 1, "4", True, 6.0, -0.5, "a"), (5, 2, "3", True, 40.0, None, "c"), (5, 2, "8", True, None, None, "missing_channel"), (5, 3, "8", False, 1.0, -0.4, "")]
    rows += [(5, 2, str(c), True, 5.0 + c / 100, -0.5, "") for c in range(10, 14)]
    log = spark.createDataFrame(rows, "run int, subrun int, channel string, anomalous boolean, max_z double, if_score double, triggered_features string")
    runs = spark.createDataFrame([(5,), (6,)], "run int")
    got = {x.run: x for x in report.historical_snapshot(log, runs, 3).collect()}
    assert (got[5].n_subruns, got[5].n_bad_subruns, got[5].n_anomalous, got[5].top_channels) == (3, 2, 8, "3,3,4")
    assert got[5].snapshot == "\n".join(["  Subruns in log: 3  |  subruns with anomalies: 2", "  Total anomalous channel-entries: 8", "  Top channels (by max_z):", "  ch3: max_z=40.0  if_score=nan  features=[c]", "  ch3: max_z=12.2  if_score=-0.612  features=[a;b]", "  ch4: max_z=6.0  if_score=-0.500  features=[a]", "  ... and 4 more anomalous channels"])
    assert got[6].snapshot == "  (run 6 not found in log — annotation used without snapshot)" and got[6].n_subruns == 0
    files = status.file_status(log, 1, 1, 0, 0.0)
    text = {x.subrun: x.text for x in report.alert_block(log, files, n=1).collect()}
    assert text[1] == "Run 5, subrun 1 — ALERT\nConditions: 2 persistent anomalous ch\nAnomalous channels (2 total, top by max_z):\n  ch3: max_z=12.2  if_score=-0.612  features=[a;b]\n  ... and 1 more anomalous channels"
    assert text[2].startswith("Run 5, subrun 2 — ALERT\nConditions: 6 persistent anomalous ch\nAnomalous channels (6 total")
    only = log.where("channel = '8'")
    assert report.alert_block(only, status.file_status(only, 1, 1, 0, 0.0)).first().text.endswith("\n  (no anomaly data)")


def test_panels_of_few_candidates(spark):
    m = spark.createDataFrame([("a", 6.0, 1.0), ("b", 6.0, 2.0), ("c", 7.0, 0.5), ("d", 8.0, 9.0), ("e", 8.0, None), ("f", 7.0, 0.1)], "model string, z_threshold double, fp_percent double")
    names = lambda df: [x.model for x in df.collect()]
    assert names(sweeps.panel_candidates(m, 3)) == ["f", "c", "a"]
    assert names(sweeps.panel_candidates(m, 4, both=(6.0, 8.0))) == ["a", "b", "d", "f"]
    assert names(sweeps.panel_candidates(m, 2, descending=True)) == ["d", "b"]
    metrics = spark.createDataFrame([("p", 2, 1.0, 50.0), ("q", 2, 1.0, 60.0), ("r", 2, None, 99.0), ("s", 2, 0.5, 10.0)], "panel string, k int, fp_percent double, coverage_percent double")
    by_fp, by_coverage = sweeps.best_panels(metrics, 2)
    assert [x.panel for x in by_fp.collect()] == ["s", "q"] and [x.panel for x in by_coverage.collect()] == ["q", "p"]


def test_islands_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(sweeps, "REACH", 4)
    r = random.Random(4)
    numbers = sorted({r.randint(-30, 60) for _ in range(60)})
    want, last = [], None
    for n in numbers:
        if last is None or n != last + 1:
            want.append([n, n, 0])
        want[-1][1:], last = [n, want[-1][2] + 1], n
    got = sorted(list(x) for x in sweeps.run_islands(spark.createDataFrame([(n,) for n in [*numbers, *numbers]] + [(None,)], "run int")).collect())
    assert got == want


def test_votes_by_hand(spark):
    r = random.Random(6)
    votes = [(f // 4, f % 4, m, r.randint(0, 1)) for f in range(24) for m in "abc" if r.random() < 0.9]
    truth = {(f // 4, f % 4): r.random() < 0.5 for f in range(0, 24, 2)}
    v = spark.createDataFrame(votes, "run int, subrun int, model string, ok int")
    t = spark.createDataFrame([(*k, g) for k, g in truth.items()], "run int, subrun int, good boolean")
    pan = {"ab": "ab", "abc": "abc"}
    p = spark.createDataFrame([(n, m) for n, own in pan.items() for m in own], "panel string, model string")
    for x in sweeps.vote_metrics(v, t, p).collect():
        own = {(a, b): sum(1 - o for i, j, m, o in votes if (i, j) == (a, b) and m in pan[x.panel]) for a, b in {(a, b) for a, b, *_ in votes} if sum((i, j) == (a, b) and m in pan[x.panel] for i, j, m, _ in votes) == len(pan[x.panel])}
        good = [f for f in own if truth.get(f)]
        assert (x.n_scored, x.n_known_good) == (len(own), len(good)) and x.coverage_percent == pytest.approx(100 * sum(b < x.k for b in own.values()) / len(own))
        assert x.fp_percent == (pytest.approx(100 * sum(own[f] >= x.k for f in good) / len(good)) if good else None)


def hits_file(folder, run, subrun, pulses):
    """A small hit file; ``pulses`` by channel."""
    names = readers.HITS.names
    rows = [[e, c, 0, 0, 0, 0, 1, 1, n, 1, 1, 1, 1, 1, 1, 1, 1] for e in range(3) for c, n in enumerate(pulses)]
    (folder / f"Digitizer_run{run}_subrun{subrun}.csv").write_text("\n".join([",".join(names), *(",".join(map(str, r)) for r in rows)]) + "\n")


def test_live_monitor(spark, tmp_path):
    """Files -> log, decisions and good list: broken and empty files are told and skipped, a restart goes on."""
    folder, target = tmp_path / "in", f"{tmp_path}/out"
    folder.mkdir()
    cfg = config.DetectorConfig(z_threshold=5.0, alert_consecutive_n=2, file_alert_n_channels=1)

    def score(hits):
        own = hits.groupBy("run", "subrun", "channel").agg(F.avg("nPulses").alias("x"), F.max(F.col("event_id")).alias("e")).where("channel is not null")
        own = own.withColumn("x", F.when(F.col("x") == 666, F.raise_error(F.lit("poison"))).otherwise(F.col("x")))
        return own.select("run", "subrun", F.col("channel").cast("string").alias("channel"), (F.col("x") > 5).alias("anomalous"), F.col("x").cast("double").alias("max_z"))

    def work():
        monitor.watch(spark, str(folder), score, target, f"{tmp_path}/c1", max_files=3, seconds=None).awaitTermination()
        monitor.decide(spark, target, f"{tmp_path}/c2", cfg, good_list=f"{target}/good", folder=str(folder), every=2, refresh=refreshed.append, seconds=None).awaitTermination()
        return {(x.run, x.subrun): (x.file_index, x.status, x.decision) for x in spark.read.parquet(f"{target}/decisions").collect()}

    refreshed = []
    hits_file(folder, 1, 1, [1, 1])
    hits_file(folder, 1, 2, [9, 1])
    (folder / "Digitizer_run1_subrun3.csv").write_text(",".join(readers.HITS.names) + "\n")  # empty
    (folder / "Digitizer_run1_subrun6.csv").write_text("")  # not yet there
    (folder / "Digitizer_run1_subrun4.csv").write_bytes(b"\xff\xfe\x00,,,\n\x00\x00")  # no hits
    hits_file(folder, 1, 5, [666, 1])  # scoring fails
    (folder / "note.txt").write_text("no hit file")
    assert work() == {(1, 1): (0, "ok", "list"), (1, 2): (1, "ok", "list")}
    assert refreshed == [2]
    told = {x.subrun: x.reason for x in spark.read.parquet(f"{target}/skipped").collect()}
    assert set(told) == {3, 4, 5} and told[3] == "no events in file" and "poison" in told[5]
    hits_file(folder, 1, 10, [9, 1])
    hits_file(folder, 2, 1, [9, 9])
    after = work()
    assert after[1, 10] == (5, "alert", "drop") and after[2, 1] == (0, "ok", "hold") and len(after) == 4  # three skipped files took places 2 to 4
    lines = [x.value for x in spark.read.text(f"{target}/good").collect()]
    assert sorted(lines) == ["# files that passed the live quality gate", f"{folder}/Digitizer_run1_subrun1.csv", f"{folder}/Digitizer_run1_subrun2.csv"]
    assert spark.read.parquet(f"{target}/log").where("channel is not null").count() == 8
    assert [x.filename for x in monitor.test_sample(spark, str(folder), 100).collect()][0] == "Digitizer_run1_subrun1.csv" and monitor.test_sample(spark, str(folder), 2).count() == 2
    late = monitor.file_stream(spark, str(folder), since="2999-01-01T00:00:00")
    query = late.writeStream.format("memory").queryName("late").option("checkpointLocation", f"{tmp_path}/c3").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("late").count() == 0
    assert monitor.hit_stream(spark, str(folder), since="2999-01-01T00:00:00").isStreaming
    rows = monitor.hit_stream(spark, str(folder)).writeStream.format("memory").queryName("hits").option("checkpointLocation", f"{tmp_path}/c4").trigger(availableNow=True).start()
    rows.awaitTermination()
    assert spark.table("hits").where("channel is not null").count() == 5 * 6
