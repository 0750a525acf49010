"""An isolation forest: trees are grown by Spark tasks on bounded samples, scoring is a pass of Arrow batches.

Split randomness comes from the seed and the tree's number, so a lost task
grows the same tree again.  A forest is a table (tree, node, feature, split,
left, right, leaf_depth, size) of n_trees x 2 x max_samples rows at most; size
is the number of points that its tree was grown from.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from .sampling import exact_sample

NODES = "tree int, node int, feature int, split double, left int, right int, leaf_depth double, size int"


def mean_depth(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(points: np.ndarray, tree: int, seed: int) -> list[tuple]:
    """Nodes of one tree over the given points; constant features are not split."""
    random = np.random.Generator(np.random.PCG64([seed, tree]))
    limit, nodes, todo = math.ceil(math.log2(max(2, len(points)))), [], [(0, points, 0)]
    n = 1
    while todo:
        node, own, depth = todo.pop()
        low, high = (own.min(0), own.max(0)) if len(own) else (np.zeros(1), np.zeros(1))
        able = np.flatnonzero(high > low)
        if depth >= limit or len(own) <= 1 or not len(able):
            nodes.append((tree, node, -1, 0.0, -1, -1, depth + mean_depth(len(own)), len(points)))
            continue
        feature = int(random.choice(able))
        split = float(random.uniform(low[feature], high[feature]))
        nodes.append((tree, node, feature, split, n, n + 1, 0.0, len(points)))
        side = own[:, feature] <= split
        todo += [(n, own[side], depth + 1), (n + 1, own[~side], depth + 1)]
        n += 2
    return nodes


def training_sample(rows: DataFrame, columns: list[str], key: list[str], seed: int = 42, cap: int = 50_000) -> DataFrame:
    """The rows that a forest is grown from and its offset is taken from: those with a value, ``cap`` at most."""
    return exact_sample(rows.where(F.coalesce(*columns).isNotNull()), cap, key, seed)


def fit_forest(rows: DataFrame, columns: list[str], key: list[str], n_trees: int = 200, max_samples: int = 256, seed: int = 42, cap: int = 50_000) -> DataFrame:
    """Nodes of the forest.  Rows whose features are all null are not used; other nulls count as 0.

    At most ``cap`` rows, chosen by a hash, take part; each tree gets its own
    hash sample of ``max_samples`` of them, gathered by one small group a tree.
    """
    pool = training_sample(rows, columns, key, seed, cap).select(*key, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns])
    n = pool.count()
    size = min(max_samples, n) if n else 0
    # a row joins a tree with some room to spare; each tree then takes exactly `size` by the hash's order
    chance = min(1.0, 1.5 * size / n + 20.0 / n) if n else 0.0
    dealt = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))).withColumn("_h", F.xxhash64(F.lit(seed), "tree", *key))
    dealt = dealt.where((F.col("_h") / F.lit(2.0**64) + 0.5) < chance).select("tree", "_h", *columns)

    def tree(key_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        points = frame.sort_values("_h")[columns].to_numpy(np.float64)[:size]
        return pd.DataFrame(grow(points, int(key_[0]), seed), columns=[x.split()[0] for x in NODES.split(", ")])

    ship_package(rows.sparkSession)
    return dealt.groupBy("tree").applyInPandas(tree, NODES)


def path_lengths(points: np.ndarray, nodes: pd.DataFrame) -> np.ndarray:
    """Mean path length of each point over the trees."""
    total, trees = np.zeros(len(points)), 0
    for _, own in nodes.groupby("tree"):
        own = own.sort_values("node")
        feature, split, left, right, leaf = (own[c].to_numpy() for c in ("feature", "split", "left", "right", "leaf_depth"))
        at = np.zeros(len(points), np.int64)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                break
            i = np.flatnonzero(inner)
            down = points[i, feature[at[i]]] <= split[at[i]]
            at[i] = np.where(down, left[at[i]], right[at[i]])
        total += leaf[at]
        trees += 1
    return total / max(1, trees)


def score_forest(rows: DataFrame, columns: list[str], nodes: DataFrame) -> DataFrame:
    """Adds ``if_score``: -2 ** (-mean path / expected path); lower is more anomalous.  Nulls count as 0.

    The expected path is that of the number of points that the trees were grown
    from.  The forest is collected once and shipped with the tasks: n_trees x 2
    x max_samples rows at most, whatever the data.
    """
    ship_package(rows.sparkSession)
    forest = nodes.toPandas()
    expected = mean_depth(int(forest["size"].max()) if len(forest) else 0) or 1.0

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        points = np.stack(features.to_numpy()) if len(features) else np.empty((0, len(columns)))
        return pd.Series(-(2.0 ** (-path_lengths(points, forest) / expected)))

    return rows.withColumn("if_score", score(F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in columns])))


def offset_table(scores: DataFrame, contamination: float, column: str = "if_score") -> DataFrame:
    """(offset): the score below which the given share of the training scores lies, interpolated.

    ``scores`` are those of the training sample, so they fit one task.
    """
    return scores.agg(F.percentile(column, F.lit(contamination)).alias("offset"))


def contamination_offset(scores: DataFrame, contamination: float, column: str = "if_score") -> float | None:
    """The value of ``offset_table``; null without scores."""
    return offset_table(scores, contamination, column).first()["offset"]


def flag_forest(scored: DataFrame, offset: float | None) -> DataFrame:
    """Adds ``if_flag``: a score below the offset."""
    return scored.withColumn("if_flag", F.coalesce(F.col("if_score") < F.lit(offset).cast("double"), F.lit(False)))
