"""The reference: mean and spread of each (channel, feature) over known-good files, kept as mergeable state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written
from .membership import not_in

FLOOR = 1e-6


def long_form(features: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, feature, x): one row a feature value."""
    return features.unpivot(keys, columns, "feature", "x")


def reference_state(features: DataFrame, columns: list[str]) -> DataFrame:
    """(channel, feature, n, mean, m2) of the values that are not null; order does not matter.

    Aggregated wide, one shuffle by channel, then laid out long: the result has
    channels x features rows, whatever the number of files.
    """
    stats = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("m2")) for c in columns]
    return features.groupBy("channel").agg(F.array(*stats).alias("s")).select("channel", F.explode("s").alias("s")).select("channel", "s.*")


def spread(n: Column, m2: Column) -> Column:
    """Population std, at least FLOOR; 1 for a single value, null without any."""
    return F.when(n > 1, F.greatest(F.sqrt(m2 / n), F.lit(FLOOR))).when(n == 1, 1.0)


def reference_stats(state: DataFrame) -> DataFrame:
    """(channel, feature, n, mean, std)."""
    return state.select("channel", "feature", "n", "mean", spread(F.col("n"), F.col("m2")).alias("std"))


def merge_states(a: DataFrame, b: DataFrame) -> DataFrame:
    """The state of the union of two disjoint sets of files, from their states alone."""
    both = a.select("channel", "feature", "n", "mean", "m2").unionByName(b.select("channel", "feature", "n", "mean", "m2"))
    got = both.where("n > 0").groupBy("channel", "feature").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.collect_list(F.struct("n", "mean", "m2")).alias("parts"))
    m2 = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["m2"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    none = both.groupBy("channel", "feature").agg(F.max("n").alias("most")).where("most = 0").select("channel", "feature", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("m2"))
    return got.select("channel", "feature", "n", "mean", m2.alias("m2")).unionByName(none)


def ordered_fold(values: DataFrame, keys: list[str], order: str, x: str = "x") -> DataFrame:
    """(keys, n, mean, m2) by a running update in ``order`` whose count also advances on nulls.

    Compatible with references built that way: with nulls the result is biased
    and depends on the order.  The update takes a mean m to c m + x / n and a
    sum of squares s to s + c (x - m)^2, c = 1 - 1/n; so any piece of a key's
    values takes (m, s) to (a m + b, s + p m^2 + q m + r), with numbers that
    follow from the piece and the count before it.  Pieces are ranges of keys
    and order, folded side by side; a key's pieces are then few, and applied in
    turn.  Values are taken relative to their key's mean, so that squares stay
    small.
    """
    rows = values.select(F.struct(*keys).alias("_key"), F.col(order).alias("o"), F.col(x).cast("double").alias("x"))
    dealt = written(rows.repartitionByRange("_key", "o").withColumn("piece", F.spark_partition_id()), "pieces")
    sizes = dealt.groupBy("_key", "piece").agg(F.count("*").alias("rows"), F.count("x").alias("values"), F.sum("x").alias("sum"))
    whole, before = W.partitionBy("_key"), W.partitionBy("_key").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("_key", "piece", F.coalesce(F.sum("sum").over(whole) / F.sum("values").over(whole), F.lit(0.0)).alias("base"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    lists = dealt.groupBy("_key", "piece").agg(F.sort_array(F.collect_list(F.struct("o", "x"))).alias("v")).join(sizes, ["_key", "piece"])
    zero = F.lit(0.0)
    start = F.struct(F.col("before").cast("bigint").alias("n"), F.lit(1.0).alias("a"), zero.alias("b"), zero.alias("p"), zero.alias("q"), zero.alias("r"))

    def step(s: Column, v: Column) -> Column:
        n = s["n"] + 1
        c, d = 1 - 1 / n, v["x"] - F.col("base") - s["b"]
        after = (c * s["a"], c * s["b"] + (v["x"] - F.col("base")) / n, s["p"] + c * s["a"] * s["a"], s["q"] - 2 * c * s["a"] * d, s["r"] + c * d * d)
        return F.struct(n.alias("n"), *[F.coalesce(y, s[name]).alias(name) for name, y in zip("abpqr", after, strict=True)])

    # a null changes the count only
    folded = lists.select("_key", "piece", "base", F.aggregate("v", start, lambda s, v: F.when(v["x"].isNull(), s.withField("n", s["n"] + 1)).otherwise(step(s, v))).alias("s"))
    parts = folded.groupBy("_key").agg(F.first("base").alias("base"), F.array_sort(F.collect_list(F.struct("piece", "s.n", "s.a", "s.b", "s.p", "s.q", "s.r"))).alias("parts"))
    first = F.struct(F.lit(0).cast("bigint").alias("n"), (-F.col("base")).alias("m"), zero.alias("m2"))
    done = F.aggregate("parts", first, lambda s, p: F.struct(p["n"].alias("n"), (p["a"] * s["m"] + p["b"]).alias("m"), (s["m2"] + p["p"] * s["m"] * s["m"] + p["q"] * s["m"] + p["r"]).alias("m2")))
    return parts.select("_key", "base", done.alias("s")).select("_key.*", "s.n", (F.col("s.m") + F.col("base")).alias("mean"), "s.m2")


def unseen(files: DataFrame, seen: DataFrame, name: str = "filename") -> DataFrame:
    """Files (few) whose base name is not in the set of seen ones (many, read but not shuffled)."""
    base = F.substring_index(name, "/", -1)
    return not_in(files.withColumn("_base", base), "_base", seen.select(base.alias("_base"))).drop("_base")


def wide_reference(stats: DataFrame, columns: list[str]) -> DataFrame:
    """(channel, known, mean_<feature>, std_<feature>): one row a channel, for a join."""
    picked = [a for c in columns for a in (F.max(F.when(F.col("feature") == c, F.col("mean"))).alias(f"mean_{c}"), F.max(F.when(F.col("feature") == c, F.col("std"))).alias(f"std_{c}"))]
    return stats.groupBy("channel").agg(*picked).withColumn("known", F.lit(True))


def zscores(features: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Features replaced by (x - mean) / std of their channel; null for unknown channels.

    The reference has one row a channel (some hundreds), so Spark joins it by
    broadcast once its size is known; ``known`` tells whether it has the channel.
    """
    rows = features.join(wide_reference(stats, columns), "channel", "left")
    z = {c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in columns}
    keep = [c for c in features.columns if c not in columns]
    return rows.select(*keep, *[x.alias(c) for c, x in z.items()], F.coalesce("known", F.lit(False)).alias("known"))
