"""Queries with Python stages run where the workers do not find the package by themselves."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from runlens import queries
for name in {names!r}:
    print(name, len(queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
spark.stop()
"""


@pytest.mark.parametrize("names", [["forest_scores"], ["stream_persistence"], ["panel_search"]], ids=lambda x: x[0])
def test_in_an_empty_folder(tmp_path, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(repo=REPO, names=names)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    for line in done.stdout.splitlines():
        if line.startswith(tuple(names)):
            assert int(line.split()[1]) > 0
    assert names[0] in done.stdout
