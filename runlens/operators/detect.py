"""Two-layer detection: z-scores and a forest, plus missing and new channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE = ["run", "subrun"]


def triggered(columns: list[str], threshold: float) -> Column:
    """Names of the features with |z| > threshold, in feature order."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.abs(F.col(c)).alias("z")) for c in columns])
    return F.transform(F.filter(pairs, lambda p: p["z"] > threshold), lambda p: p["name"])


def max_abs_z(columns: list[str]) -> Column:
    """Largest |z| of a row; null where all are null."""
    return F.array_max(F.array(*[F.abs(F.col(c)) for c in columns]))


def missing_channels(files: DataFrame, channels: DataFrame, present: DataFrame) -> DataFrame:
    """(run, subrun, channel): known channels without a row in a file that has rows.

    ``channels`` has the reference's channels (some hundreds): it is laid out
    as one array and exploded for each file, and what is present is taken off.
    """
    known = channels.select("channel").distinct().agg(F.collect_set("channel").alias("channels"))
    wanted = files.select(*FILE).distinct().join(F.broadcast(known)).select(*FILE, F.explode("channels").alias("channel"))
    return wanted.join(present.select(*FILE, "channel"), [*FILE, "channel"], "left_anti")


def detection_log(z: DataFrame, columns: list[str], threshold: float, channels: DataFrame | None = None) -> DataFrame:
    """(run, subrun, channel, anomalous, method, triggered_features, max_z, if_score): one row a (file, channel).

    ``z`` has z-scores, ``known`` and, where a forest scored it, ``if_score`` and
    ``if_flag``.  A channel that the reference lacks is new_channel, and the
    forest's word on it does not count; with ``channels``, those that a file lacks are added as missing_channel.
    """
    forest = F.col("known") & F.coalesce(F.col("if_flag"), F.lit(False)) if "if_flag" in z.columns else F.lit(False)
    rows = z.withColumns({"_t": triggered(columns, threshold), "_m": max_abs_z(columns), "_f": forest})
    stat = F.size("_t") > 0
    method = F.when(~F.col("known"), "new_channel").when(stat & F.col("_f"), "statistical+IF").when(stat, "statistical").when(F.col("_f"), "isolation_forest").otherwise("")
    log = rows.select(
        *FILE,
        "channel",
        (~F.col("known") | stat | F.col("_f")).alias("anomalous"),
        method.alias("method"),
        F.when(F.col("known"), F.array_join("_t", ";")).otherwise("new_channel").alias("triggered_features"),
        F.when(F.col("known"), F.col("_m")).alias("max_z"),
        (F.when(F.col("known"), F.col("if_score")) if "if_score" in z.columns else F.lit(None).cast("double")).alias("if_score"),
    )
    if channels is None:
        return log
    none = F.lit(None).cast("double")
    lost = missing_channels(z, channels, z).select(*FILE, "channel", F.lit(True).alias("anomalous"), F.lit("missing_channel").alias("method"), F.lit("missing_channel").alias("triggered_features"), none.alias("max_z"), none.alias("if_score"))
    return log.unionByName(lost)
