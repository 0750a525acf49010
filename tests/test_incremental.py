"""The growing reference: overlapping lists, broken runs, writers in each other's way; the filter behind it."""

import math
import random

import pytest

from runlens import config, storage
from runlens.operators import membership, reference
from runlens.plans import incremental, steps

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    return spark.createDataFrame([(run, s, c, r.gauss(10, 1), None if s == 2 else r.gauss(0, 5)) for run in range(1, 5) for s in range(4) for c in "012"], "run int, subrun int, channel string, a double, b double").cache()


def listed(spark, pairs, folder="/data"):
    return spark.createDataFrame([(f"{folder}/Digitizer_run{run}_subrun{s}.csv", run, s) for run, s in pairs], "filename string, run int, subrun int")


def files(first, last):
    return [(run, s) for run in range(first, last + 1) for s in range(4)]


def extract(rows):
    return lambda new: rows.join(new.select("run", "subrun"), ["run", "subrun"], "left_semi")


def same(state, rows):
    got = {(x.channel, x.feature): x[2:] for x in state.select("channel", "feature", "n", "mean", "m2").collect()}
    want = {(x.channel, x.feature): x[2:] for x in reference.reference_state(rows, COLUMNS).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k][0] == v[0]
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(got[k][1:], v[1:], strict=True))


def test_each_file_counts_once(spark, rows, tmp_path):
    folder, own = f"{tmp_path}/m", extract(rows)
    assert incremental.latest(spark, folder) is None
    first = incremental.add_files(spark, folder, listed(spark, files(1, 2)), own, COLUMNS)
    assert (first.number, first.n_files) == (0, 8)
    twice = listed(spark, files(2, 3)).unionByName(listed(spark, files(1, 3), "/copy")).unionByName(spark.createDataFrame([(None, 4, 0)], "filename string, run int, subrun int"))
    second = incremental.add_files(spark, folder, twice, own, COLUMNS)
    assert (second.number, second.n_files) == (1, 12)
    same(second.state, rows.where("run <= 3"))
    again = incremental.add_files(spark, folder, listed(spark, files(1, 3)), own, COLUMNS)
    assert (again.number, again.parts) == (1, second.parts)
    assert {x.filename for x in again.files.collect()} == {f"Digitizer_run{run}_subrun{s}.csv" for run, s in files(1, 3)}
    with pytest.raises(ValueError, match="other features"):
        incremental.add_files(spark, folder, listed(spark, files(4, 4)), own, ["a"])


def test_a_broken_run_leaves_nothing_that_counts(spark, rows, tmp_path, monkeypatch):
    folder, own = f"{tmp_path}/m", extract(rows)
    incremental.add_files(spark, folder, listed(spark, files(1, 1)), own, COLUMNS)
    with monkeypatch.context() as m:

        def broken(*_):
            raise OSError("the driver went away")

        m.setattr(storage, "create_text", broken)
        with pytest.raises(OSError, match="went away"):
            incremental.add_files(spark, folder, listed(spark, files(1, 3)), own, COLUMNS)
    assert incremental.latest(spark, folder).n_files == 4
    assert len(incremental.left_over(spark, folder)) == 1
    after = incremental.add_files(spark, folder, listed(spark, files(1, 3)), own, COLUMNS)
    assert after.n_files == 12
    same(after.state, rows.where("run <= 3"))


def test_of_two_writers_one_wins(spark, rows, tmp_path):
    folder, own = f"{tmp_path}/m", extract(rows)

    def slow(new):  # another writer commits while this one extracts
        incremental.add_files(spark, folder, listed(spark, files(2, 2)), own, COLUMNS)
        return own(new)

    with pytest.raises(incremental.Conflict):
        incremental.add_files(spark, folder, listed(spark, files(1, 2)), slow, COLUMNS)
    assert incremental.latest(spark, folder).n_files == 4
    assert incremental.left_over(spark, folder) == []
    last = incremental.add_files(spark, folder, listed(spark, files(1, 2)), own, COLUMNS)
    same(last.state, rows.where("run <= 2"))


def test_parts_are_merged(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "MOST_PARTS", 2)
    folder, own = f"{tmp_path}/m", extract(rows)
    for run in range(1, 5):
        last = incremental.add_files(spark, folder, listed(spark, files(run, run)), own, COLUMNS)
    assert (last.number, last.n_files, len(last.parts)) == (3, 16, 2)
    assert last.files.count() == 16
    same(last.state, rows)
    assert len(incremental.left_over(spark, folder)) == 2


def test_models_in_memory(spark, rows):
    cfg = config.DetectorConfig(n_trees=5)
    a = steps.train(rows.where("run <= 3"), COLUMNS, cfg, with_forest=False)
    b = steps.train(rows.where("run >= 2"), COLUMNS, cfg, old=a)
    same(b.state, rows)
    assert sorted(map(tuple, b.files.collect())) == files(1, 4)
    assert b.nodes.select("tree").distinct().count() == 5
    with pytest.raises(ValueError, match="which files"):
        steps.train(rows, COLUMNS, cfg, old=steps.Model(a.state, None, None, COLUMNS))


def test_forest_is_grown_on_the_whole_list(spark, rows, tmp_path):
    cfg = config.DetectorConfig(n_trees=4)
    incremental.train_files(spark, f"{tmp_path}/m", listed(spark, files(1, 3)), extract(rows), COLUMNS, cfg, with_forest=False)
    model = incremental.train_files(spark, f"{tmp_path}/m", listed(spark, files(1, 4)), extract(rows), COLUMNS, cfg)
    same(model.state, rows)
    assert {x["size"] for x in model.nodes.select("size").collect()} == {rows.count()}
    saved = steps.writers
    saved.save_model(model.state, model.nodes, f"{tmp_path}/saved", {}, rows.select("run", "subrun").distinct())
    assert saved.covered_files(spark, f"{tmp_path}/saved").count() == 16
    assert saved.covered_files(spark, f"{tmp_path}/none") is None


def test_filter(spark):
    known = spark.range(50_000).selectExpr("concat('file', id) as name")
    few = spark.createDataFrame([("file7",), ("file49999",), ("other",), (None,)], "name string")
    passed = membership.may_be_in(known, "name", few, 3)
    assert {"file7", "file49999"} <= {x.name for x in passed.collect()}
    assert passed.count() < 50
    assert sorted((x.name or "") for x in membership.not_in(few, "name", known).collect()) == ["", "other"]
    # known names meet bitmaps by broadcast, before anything of them is shuffled
    plan = passed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert membership.filter_bits(10**9) == membership.MOST_BITS
    many = spark.range(3000).selectExpr("concat('file', id * 2) as name")
    assert membership.not_in(many, "name", known.where("name <> 'file10'")).collect()[0].name == "file10"
