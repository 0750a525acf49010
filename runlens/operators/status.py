"""From the anomaly log to the status of files, the live good list and the class of runs.

History never crosses runs, so rows are dealt out by run once and all windows
and groupings within it need no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILE = ["run", "subrun"]
#: Thresholds of a sweep, at most.
MOST_THRESHOLDS = 10_000


def streaks(log: DataFrame, n: int) -> DataFrame:
    """Adds ``streak`` (anomalous among the channel's last n appearances in the run) and ``persistent`` (all n of them)."""
    last = W.partitionBy("run", "channel").orderBy("subrun").rowsBetween(-(n - 1), 0)
    rows = log.repartition("run").withColumn("streak", F.sum(F.col("anomalous").cast("int")).over(last))
    return rows.withColumn("persistent", F.col("streak") == n)


def file_counts(log: DataFrame) -> DataFrame:
    """(run, subrun, n_total, n_bad, frac_bad) by log rows."""
    return log.groupBy(*FILE).agg(F.count("*").alias("n_total"), F.count_if("anomalous").alias("n_bad")).withColumn("frac_bad", F.col("n_bad") / F.col("n_total"))


def worst_channel(log: DataFrame) -> DataFrame:
    """(run, subrun, worst_z, worst_channel) over anomalous rows with a z; ties go to the smaller channel name; none: 0 and null."""
    z = F.when(F.col("anomalous"), F.col("max_z"))
    best = F.min(F.when(z.isNotNull(), F.struct((-z).alias("o"), F.col("channel").alias("c"))))
    return log.groupBy(*FILE).agg(best.alias("b")).select(*FILE, F.coalesce(-F.col("b.o"), F.lit(0.0)).alias("worst_z"), F.col("b.c").alias("worst_channel"))


def file_status(log: DataFrame, n: int = 1, least: int = 1, bulk: int = 0, extreme: float = 0.0) -> DataFrame:
    """(run, subrun, n_anomalous, n_persistent, n_transient, worst_z, status) of every file.

    alert: ``least`` persistent channels, or ``bulk`` anomalous ones, or a z of
    ``extreme`` (0 switches the last two off); warn: some persistent; pend:
    some transient in a run of fewer than ``n`` files; else ok.  A channel
    counts once a file.
    """
    once = log.groupBy(*FILE, "channel").agg(F.bool_or("anomalous").alias("anomalous"), F.max(F.when(F.col("anomalous"), F.col("max_z"))).alias("z"))
    rows = streaks(once, n)
    files = rows.groupBy(*FILE).agg(F.count_if("anomalous").alias("n_anomalous"), F.count_if("persistent").alias("n_persistent"), F.coalesce(F.max("z"), F.lit(0.0)).alias("worst_z"))
    files = files.withColumn("n_files", F.count("*").over(W.partitionBy("run")))
    return _with_status(files, n, least, bulk, extreme).select(*FILE, "n_anomalous", "n_persistent", "n_transient", "worst_z", "status")


def _with_status(files: DataFrame, n: int, least: int, bulk: int, extreme: float) -> DataFrame:
    """Adds ``n_transient`` and ``status`` to files (n_anomalous, n_persistent, worst_z, n_files)."""
    transient = F.col("n_anomalous") - F.col("n_persistent")
    alert = F.col("n_persistent") >= least
    if bulk > 0:
        alert = alert | (F.col("n_anomalous") >= bulk)
    if extreme > 0:
        alert = alert | (F.col("worst_z") >= extreme)
    status = F.when(alert, "alert").when(F.col("n_persistent") > 0, "warn").when((transient > 0) & (F.col("n_files") < n), "pend").otherwise("ok")
    return files.withColumns({"n_transient": transient, "status": status})


def status_sweep(log: DataFrame, thresholds: DataFrame, n: int = 1, least: int = 1, bulk: int = 0, extreme: float = 0.0) -> DataFrame:
    """file_status of the log judged by its z alone, at each of ``thresholds`` (z_threshold).

    A channel is anomalous at a threshold where its z is above it, and
    persistent where the smallest z of its last n files is: so one window over
    the log serves all thresholds, and they are laid out on files only.  The
    thresholds are broadcast: more than MOST_THRESHOLDS are refused.
    """
    if thresholds.limit(MOST_THRESHOLDS + 1).count() > MOST_THRESHOLDS:
        raise ValueError(f"more than {MOST_THRESHOLDS} thresholds")
    once = log.groupBy(*FILE, "channel").agg(F.max("max_z").alias("z"))
    last = W.partitionBy("run", "channel").orderBy("subrun").rowsBetween(-(n - 1), 0)
    # a file without a z ends a streak
    rows = once.repartition("run").withColumn("least_z", F.when((F.count("*").over(last) == n) & (F.count("z").over(last) == n), F.min("z").over(last)))
    files = rows.groupBy(*FILE).agg(F.collect_list("z").alias("zs"), F.collect_list("least_z").alias("least_zs"), F.max("z").alias("top")).withColumn("n_files", F.count("*").over(W.partitionBy("run")))
    above = lambda c: F.size(F.filter(c, lambda z: z > F.col("z_threshold"))).cast("long")
    swept = files.join(F.broadcast(thresholds.select("z_threshold"))).select("z_threshold", *FILE, above("zs").alias("n_anomalous"), above("least_zs").alias("n_persistent"), F.when(F.col("top") > F.col("z_threshold"), F.col("top")).otherwise(0.0).alias("worst_z"), "n_files")
    return _with_status(swept, n, least, bulk, extreme).select("z_threshold", *FILE, "n_anomalous", "n_persistent", "n_transient", "worst_z", "status")


def not_alerted(status: Column) -> Column:
    """The usual quality gate."""
    return status != "alert"


def good_list(status: DataFrame, n: int = 1, gate=not_alerted) -> DataFrame:
    """(run, subrun, file_index, decision, listed): which files the live good list takes.

    One of a run's first n - 1 files that is anomalous but passes is held; it is
    released if the next file that decides (one that fails, or that passes
    without being held) passes, and dropped if that fails or the run ends.
    """
    order = W.partitionBy("run").orderBy("subrun")
    rows = status.withColumn("file_index", F.row_number().over(order) - 1).withColumn("passes", gate(F.col("status")))
    held = F.col("passes") & (F.col("file_index") < n - 1) & (F.col("n_anomalous") > 0)
    rows = rows.withColumn("decision", F.when(~F.col("passes"), "drop").when(held, "hold").otherwise("list"))
    ahead = order.rowsBetween(1, W.unboundedFollowing)
    coming = F.first(F.when(F.col("decision") != "hold", F.col("decision")), ignorenulls=True).over(ahead)
    listed = F.when(F.col("decision") == "hold", F.coalesce(coming == "list", F.lit(False))).otherwise(F.col("decision") == "list")
    return rows.select(*FILE, "file_index", "decision", listed.alias("listed"))


def classify_runs(log: DataFrame, least: int = 1) -> DataFrame:
    """(run, classification, n_good_subruns, n_bad_subruns, last_good_subrun, first_bad_subrun, persistent_channels).

    A subrun is bad with ``least`` anomalous rows.  good, bad, partial (all bad
    ones after all good ones), mixed; persistent_fault: else good, two subruns
    or more, and some channel anomalous in every one.
    """
    known = log.where("run is not null")
    files = known.groupBy(*FILE).agg(F.count_if("anomalous").alias("n")).withColumn("bad", F.col("n") >= least)
    runs = files.groupBy("run").agg(F.count_if(~F.col("bad")).alias("n_good_subruns"), F.count_if("bad").alias("n_bad_subruns"), F.max(F.when(~F.col("bad"), F.col("subrun"))).alias("last_good_subrun"), F.min(F.when(F.col("bad"), F.col("subrun"))).alias("first_bad_subrun"))
    channels = known.groupBy(*FILE, "channel").agg(F.bool_or("anomalous").alias("a")).where("a").groupBy("run", "channel").agg(F.count("*").alias("n"))
    sizes = runs.select("run", (F.col("n_good_subruns") + F.col("n_bad_subruns")).alias("size"))
    always = channels.join(sizes, "run").where("n >= size").groupBy("run").agg(F.array_join(F.array_sort(F.collect_list(F.col("channel").cast("string"))), ";").alias("persistent_channels"))
    rows = runs.join(always, "run", "left").withColumn("persistent_channels", F.coalesce("persistent_channels", F.lit("")))
    two = (F.col("n_good_subruns") + F.col("n_bad_subruns")) >= 2
    kind = (
        F.when((F.col("n_bad_subruns") == 0) & two & (F.col("persistent_channels") != ""), "persistent_fault")
        .when(F.col("n_bad_subruns") == 0, "good")
        .when(F.col("n_good_subruns") == 0, "bad")
        .when(F.col("first_bad_subrun") > F.col("last_good_subrun"), "partial")
        .otherwise("mixed")
    )
    return rows.select("run", kind.alias("classification"), "n_good_subruns", "n_bad_subruns", "last_good_subrun", "first_bad_subrun", "persistent_channels")
