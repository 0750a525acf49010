"""Exact-size samples without replacement, stable for a seed: the rows with the smallest hashes of their keys."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_sample(rows: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """min(n, rows) rows; a top-n by hash, so tasks send n rows at most."""
    return rows.withColumn("_s", F.xxhash64(F.lit(seed), *key)).orderBy("_s", *key).limit(n).drop("_s")


def fraction_size(total: int, fraction: float) -> int:
    """max(1, total * fraction), rounded half to even; an empty input has no sample."""
    if not total:
        raise ValueError("nothing to sample from")
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    return max(1, int((Decimal(total) * Decimal(str(fraction))).quantize(Decimal(1), ROUND_HALF_EVEN)))


def fraction_sample(rows: DataFrame, fraction: float, key: list[str], seed: int = 42) -> DataFrame:
    return exact_sample(rows, fraction_size(rows.count(), fraction), key, seed)


def plot_selection(status: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """Files to look at: the worst bad one, most - 1 other bad ones and ``most`` good ones by hash; -1: all.

    ``status``: (run, subrun, status, n_anomalous, ...).
    """
    if most < 0:
        return status
    bad = status.where("status = 'alert'")
    worst = bad.orderBy(F.desc("n_anomalous"), "run", "subrun").limit(1)
    rest = exact_sample(bad.join(worst.select("run", "subrun"), ["run", "subrun"], "left_anti"), max(0, most - 1), ["run", "subrun"], seed)
    return worst.unionByName(rest.select(status.columns)).unionByName(exact_sample(status.where("status <> 'alert'"), most, ["run", "subrun"], seed).select(status.columns))


def first_appearances(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows that repeat the keys, the first in ``order``; ties go to the smallest other columns."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])) if rest else None
    return rows.groupBy(*keys).agg(first.alias("r")).select(*keys, "r.*").select(rows.columns) if rest else rows.distinct()
