"""Panel search on bit strings against a loop over files."""

import itertools
import random

import numpy as np

from runlens.operators import panels


def loop(votes, truth, size, models, groups=()):
    """(fp, coverage) of each panel that scored known-good files."""
    by_file = {}
    for run, s, m, ok in votes:
        by_file.setdefault((run, s), {})[m] = ok
    out = {}
    for own in itertools.combinations(sorted(models), size):
        if any(not set(own) & g for g in groups):
            continue
        files = {f: all(v[m] == 0 for m in own) for f, v in by_file.items() if all(m in v for m in own)}
        good = [f for f in files if truth.get(f)]
        if good:
            out["+".join(own)] = (100.0 * sum(files[f] for f in good) / len(good), 100.0 * sum(not b for b in files.values()) / len(files))
    return out


def test_search_is_a_loop(spark, monkeypatch):
    monkeypatch.setattr(panels, "FILES_A_BLOCK", 100)  # several blocks, more than one word in each
    r = random.Random(2)
    names = [f"m{i:02d}" for i in range(12)]
    bias = {m: r.uniform(0.3, 0.95) for m in names}
    votes = [(f // 20, f % 20, m, int(r.random() < bias[m])) for f in range(700) for m in names if r.random() < (0.02 if m == "m05" else 0.95)]
    truth = {(f // 20, f % 20): r.random() < 0.4 for f in range(0, 700, 2)}
    v = spark.createDataFrame(votes, "run int, subrun int, model string, ok int")
    t = spark.createDataFrame([(*k, g) for k, g in truth.items()] + [(999, 1, True)], "run int, subrun int, good boolean")
    z = {m: (6.0, 7.0, 8.0)[i % 3] for i, m in enumerate(names)}
    alone = loop(votes, truth, 1, names)
    for both in (None, (6.0, 8.0)):
        groups = [{m for m in names if z[m] == x} for x in both or ()]
        for most in (100, 6):
            got = panels.panel_search(v, t, 3, 4, most, z, both)
            for df, key, order in ((got[0], lambda m: alone[m][0], lambda x: (x[1][0], -x[1][1], x[0])), (got[1], lambda m: -alone[m][1], lambda x: (-x[1][1], x[1][0], x[0]))):
                ranked = sorted(alone, key=lambda m: (key(m), m))
                own = [m for g in groups for m in [x for x in ranked if x in g][: most // 2]]
                own = list(dict.fromkeys([*own, *(m for m in ranked if not any(m in g for g in groups))]))[:most]
                want = sorted(loop(votes, truth, 3, own, groups).items(), key=order)[:4]
                assert [(x.panel, (round(x.fp_percent, 9), round(x.coverage_percent, 9))) for x in df.collect()] == [(p, (round(a, 9), round(b, 9))) for p, (a, b) in want]


def test_panels_without_known_good_files_drop_out(spark):
    v = spark.createDataFrame([(1, 1, "a", 1), (1, 1, "b", 1), (1, 2, "a", 1), (1, 2, "c", 0)], "run int, subrun int, model string, ok int")
    t = spark.createDataFrame([(1, 1, True)], "run int, subrun int, good boolean")
    for df in panels.panel_search(v, t, 2):
        assert [x.panel for x in df.collect()] == ["a+b"]


def test_all_triples_of_a_hundred():
    assert len(panels.combinations(list(range(100)), 3)) == 161_700
    some = panels.combinations([3, 1, 2], 2, ({1}, {2, 3}))
    assert some.tolist() == [[1, 2], [1, 3]]
    assert panels.combinations([1], 3).shape == (0, 3)
    assert isinstance(some, np.ndarray)
