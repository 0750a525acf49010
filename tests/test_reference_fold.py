"""The order-dependent fold in pieces against the running update itself."""

import math
import random

import pytest

from runlens.operators import reference


def running(values):
    n, mean, m2 = 0, 0.0, 0.0
    for x in values:
        n += 1
        if x is not None:
            delta = x - mean
            mean += delta / n
            m2 += delta * (x - mean)
    return n, mean, m2


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_pieces_are_the_running_update(spark, shift):
    r = random.Random(8)
    own = {}
    for key in ("a", "b", None, "first null", "all null", "one"):
        n = {"one": 1, "b": 3000}.get(key, 400)
        own[key] = [None if r.random() < 0.1 or key == "all null" or key == "first null" and i < 3 else shift + r.gauss(5, 2) for i in range(n)]
    rows = [(k, i, x) for k, v in own.items() for i, x in enumerate(v)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, x double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several pieces a key
    try:
        got = {x.k: (x.n, x.mean, x.m2) for x in reference.ordered_fold(df, ["k"], "o").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.keys() == own.keys()
    for k, v in own.items():
        n, mean, m2 = running(v)
        assert got[k][0] == n
        assert math.isclose(got[k][1], mean, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(got[k][2], m2, rel_tol=1e-9, abs_tol=1e-9)


def test_no_array_holds_a_key(spark):
    """The values of one key are in several pieces."""
    df = spark.range(20_000).selectExpr("'k' as k", "id as o", "cast(id % 7 as double) as x").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plan = reference.ordered_fold(df, ["k"], "o")
        pieces = plan.inputFiles()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(set(pieces)) > 1
    assert plan.first().n == 20_000


def test_no_values(spark):
    assert reference.ordered_fold(spark.createDataFrame([], "k string, o int, x double"), ["k"], "o").count() == 0
