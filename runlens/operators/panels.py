"""Search of voting panels on bit strings: one a model and block of files.

Files are numbered within blocks; a model's verdicts on a block are two strings
of bits, what it scored and what it calls bad.  A panel's verdict is the AND of
its members' strings and its counts are numbers of bits, so a block answers for
all panels in one pass over words of 64 files, and blocks only add up.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship_package
from ..storage import written
from .sweeps import FILE

#: Files of a block, on average; a block's strings have as many bits as it has files.
FILES_A_BLOCK = 8192
#: Panels times words of a block that are worked on at once.
AT_ONCE = 1 << 21
SUMS = "members array<int>, n_scored long, n_known_good long, n_bad long, n_bad_known_good long"


def vote_bits(votes: DataFrame, truth: DataFrame, models: list[str]) -> DataFrame:
    """(block, model, scored, bad, known_good), a row a block and model: strings as arrays of 64-bit words.

    ``votes``: (run, subrun, model, ok 0/1), each file and model once; ``model``
    becomes its place in ``models``.  Files without ground truth are not known to be good.
    """
    files = votes.select(*FILE).distinct().join(truth.select(*FILE, F.col("good").alias("kg")), FILE, "left").groupBy(*FILE).agg(F.coalesce(F.max("kg"), F.lit(False)).alias("kg"))
    files = written(files, "voted-files")
    blocks = max(1, -(-files.count() // FILES_A_BLOCK))
    files = files.withColumn("block", F.pmod(F.xxhash64(*FILE), F.lit(blocks)).cast("int"))
    files = files.withColumn("at", F.row_number().over(W.partitionBy("block").orderBy(*FILE)) - 1)
    files = files.select(*FILE, "kg", "block", F.floor(F.col("at") / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % 64).alias("bit"))
    place = F.create_map(*[x for i, m in enumerate(models) for x in (F.lit(m), F.lit(i))])
    own = votes.where(F.col("model").isin(models)).withColumn("place", place[F.col("model")])
    words = own.join(files, FILE).groupBy("block", "place", "word").agg(F.bit_or("bit").alias("scored"), F.bit_or(F.when(F.col("ok") == 0, F.col("bit")).otherwise(0)).alias("bad"))
    known = files.groupBy("block", "word").agg(F.bit_or(F.when(F.col("kg"), F.col("bit")).otherwise(0)).alias("known_good"))
    return words.join(known, ["block", "word"])


def panel_sums(words: DataFrame, n_models: int, panels: np.ndarray) -> DataFrame:
    """(members, n_scored, n_known_good, n_bad, n_bad_known_good) of each panel, a row of places in ``panels``.

    A file counts where all members scored it, as bad where all call it bad.
    """
    ship_package(words.sparkSession)

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n_words = int(rows["word"].max()) + 1
        scored, bad = (np.zeros((n_models, n_words), np.uint64) for _ in range(2))
        known = np.zeros(n_words, np.uint64)
        at = (rows["place"].to_numpy(), rows["word"].to_numpy())
        scored[at], bad[at] = rows["scored"].to_numpy().view(np.uint64), rows["bad"].to_numpy().view(np.uint64)
        known[at[1]] = rows["known_good"].to_numpy().view(np.uint64)
        sums = np.zeros((len(panels), 4), np.int64)
        step = max(1, AT_ONCE // n_words)
        for a in range(0, len(panels), step):
            own = panels[a : a + step]
            every, all_bad = scored[own[:, 0]], bad[own[:, 0]]
            for member in own.T[1:]:
                every, all_bad = every & scored[member], all_bad & bad[member]
            for i, bits in enumerate((every, every & known, all_bad, all_bad & known)):
                sums[a : a + step, i] = np.bitwise_count(bits).sum(1)
        some = sums[:, 0] > 0
        return pd.DataFrame({"members": list(panels[some].astype(np.int32)), **{n: sums[some, i] for i, n in enumerate(["n_scored", "n_known_good", "n_bad", "n_bad_known_good"])}})

    sums = words.groupBy("block").applyInPandas(block, SUMS)
    return sums.groupBy("members").agg(*[F.sum(n).alias(n) for n in ("n_scored", "n_known_good", "n_bad", "n_bad_known_good")])


def panel_rates(sums: DataFrame, models: list[str]) -> DataFrame:
    """(panel, n_scored, n_known_good, fp_percent, coverage_percent); panels without known-good files drop out."""
    names = F.array(*[F.lit(m) for m in models])
    panel = F.array_join(F.transform("members", lambda i: F.get(names, i)), "+")
    return sums.where("n_known_good > 0").select(panel.alias("panel"), "n_scored", "n_known_good", (100.0 * F.col("n_bad_known_good") / F.col("n_known_good")).alias("fp_percent"), (100.0 * (F.col("n_scored") - F.col("n_bad")) / F.col("n_scored")).alias("coverage_percent"))


def combinations(candidates: list[int], size: int, groups: tuple[set[int], ...] = ()) -> np.ndarray:
    """All panels of ``size`` candidates, a row each, that have a member of every group."""
    rows = np.array(list(itertools.combinations(sorted(candidates), size)), np.int64).reshape(-1, size)
    for group in groups:
        rows = rows[np.isin(rows, sorted(group)).any(1)]
    return rows


def panel_search(votes: DataFrame, truth: DataFrame, size: int = 3, top: int = 3, most: int = 100, thresholds: dict[str, float] | None = None, both: tuple[float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """The ``top`` panels of ``size`` models with the lowest false-positive rate, and those of highest coverage.

    A panel calls a file bad where all members do.  Candidates are the ``most``
    best models by either rate, of those that scored known-good files.  With
    ``both`` (two z thresholds; ``thresholds`` tells each model's), half of the
    places go to the best of each, and a panel needs members of both.  Ties go
    to the other rate, then to the smaller name.  The driver holds the panels'
    numbers: 161,700 for triples of a hundred.
    """
    models = sorted(r["model"] for r in votes.select("model").distinct().collect())
    words = written(vote_bits(votes, truth, models), "vote-bits")
    alone = {r["members"][0]: r for r in panel_sums(words, len(models), np.arange(len(models))[:, None]).where("n_known_good > 0").collect()}
    rate = {i: (r["n_bad_known_good"] / r["n_known_good"], (r["n_scored"] - r["n_bad"]) / r["n_scored"]) for i, r in alone.items()}
    groups = tuple({i for i, m in enumerate(models) if (thresholds or {}).get(m) == z} for z in both or ())

    def candidates(key) -> list[int]:
        order = sorted(rate, key=lambda i: (key(i), models[i]))
        parts = [i for g in groups for i in [x for x in order if x in g][: most // 2]]
        return list(dict.fromkeys([*parts, *(i for i in order if not any(i in g for g in groups))]))[:most]

    out = []
    orders = ([F.asc("fp_percent"), F.desc("coverage_percent"), "panel"], [F.desc("coverage_percent"), F.asc("fp_percent"), "panel"])
    for own, order in zip((candidates(lambda i: rate[i][0]), candidates(lambda i: -rate[i][1])), orders, strict=True):
        rates = panel_rates(panel_sums(words, len(models), combinations(own, size, groups)), models)
        out.append(rates.orderBy(*order).limit(top))
    return out[0], out[1]
