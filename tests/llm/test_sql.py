"""Queries and their SQL over rows that the given tables lack: nulls, ties, repeated rows and ids, extra columns."""

import collections

import duckdb
import pytest

from runlens.llm import queries

from .helpers import corpus, frame


def same(spark, name, folder, tables):
    """Rows of the query equal those of its SQL."""
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(queries.ORACLES[name])
    columns = [x[0] for x in want.description]
    got = queries.QUERIES[name](spark, str(folder)).select(*columns).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want.fetchall())


SHARED = ["a line that many sites have", "another such line"]


@pytest.mark.parametrize("name", ["op4_substring_dedup", "op5_line_dedup", "op8_minhash_dedup"])
def test_documents(spark, tmp_path, name):
    rows = [(i, None if t is None else "\n".join([t, *SHARED[: i % 3]]), s) for i, t, s in corpus(11)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    same(spark, name, tmp_path, ["documents"])


def test_lines_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(i, None if t is None else "\n".join([SHARED[0], t, *SHARED[: i % 3]]), s) for i, t, s in corpus(12)]
    rows += [(0, "precious line\nanother line here", "s1"), (0, "precious line\nanother line here", "s1"), (None, f"{SHARED[0]}\nno id", None), (None, SHARED[0], "s3"), (None, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    same(spark, "op5_line_dedup", tmp_path, ["documents"])


def test_turns(spark, tmp_path):
    rows = [(c, t, r, x) for c in (0, 1, None) for t in (0, 1, 1, None) for r in ("user", "assistant", None) for x in ("a#", None, "", "<b>\\")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    same(spark, "op10_chat_format", tmp_path, ["conversations"])
