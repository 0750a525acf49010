"""Every core query against its SQL in DuckDB, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from runlens import queries

SF = "/root/testdata/sf0.001"
#: Queries for which the smallest tables rightly have no rows; these run over larger ones.
LARGER = {"persistent_faults": "/root/testdata/sf0.01"}


def duck(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    folder = LARGER.get(name, SF)
    df = queries.QUERIES[name](spark, folder)
    got = df.collect()
    assert got
    if name in queries.ORACLES:
        want = duck(folder).execute(queries.ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(names)
        assert rows(df.columns, got) == rows(names, want.fetchall())


def test_whole_tables(spark):
    """No row is left out."""
    log = queries.adapt.log(spark, SF)
    got = {name: queries.QUERIES[name](spark, SF) for name in ("trigger_bit_decode", "z_heatmap", "combine_logs")}
    assert got["trigger_bit_decode"].count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert len(got["trigger_bit_decode"].columns) == 2 + 16
    assert got["combine_logs"].count() == log.count()
    assert got["z_heatmap"].select("run").distinct().count() == log.select("run").distinct().count()
