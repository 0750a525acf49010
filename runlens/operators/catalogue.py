"""The quality catalogue, ground truth, evaluation and framework tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE = ["run", "subrun"]
QUALITIES = ["loose", "medium", "tight"]


def quality(name: str) -> Column:
    """The flag of a quality, or any of the three for All; null counts as false."""
    flags = [F.coalesce(F.col(q), F.lit(False)) for q in (QUALITIES if name.lower() == "all" else [name.lower()])]
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def last_entries(catalogue: DataFrame, order: str = "position") -> DataFrame:
    """Of entries that repeat a (run, subrun), the last."""
    rest = [c for c in catalogue.columns if c not in FILE]
    return catalogue.groupBy(*FILE).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*FILE, "r.*")


def select_catalogue(catalogue: DataFrame, name: str = "All", first_run: int | None = None, last_run: int | None = None) -> DataFrame:
    """Entries of a quality in an inclusive range of runs."""
    rows = catalogue.where(quality(name))
    if first_run is not None:
        rows = rows.where(F.col("run") >= first_run)
    return rows if last_run is None else rows.where(F.col("run") <= last_run)


def expand_catalogue(catalogue: DataFrame, files: DataFrame) -> DataFrame:
    """(run, subrun) of the files that entries name; subrun -1 means all files of the run."""
    names = files.select(*FILE).distinct()
    some = catalogue.where("subrun <> -1").select(*FILE).join(names, FILE, "left_semi")
    whole = names.join(catalogue.where("subrun = -1").select("run"), "run", "left_semi").select(*FILE)
    return some.unionByName(whole).distinct()


def unmatched(catalogue: DataFrame, files: DataFrame) -> DataFrame:
    """Entries that no file answers to."""
    names = files.select(*FILE).distinct()
    some = catalogue.where("subrun <> -1").join(names, FILE, "left_anti")
    return some.unionByName(catalogue.where("subrun = -1").join(names.select("run").distinct(), "run", "left_anti").select(catalogue.columns))


def expanded_with_misses(catalogue: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that entries name, (n_missing): how many entries no file answers to)."""
    return expand_catalogue(catalogue, files), unmatched(catalogue, files).agg(F.count("*").alias("n_missing"))


def catalogue_counts(catalogue: DataFrame) -> DataFrame:
    """Totals, entries of each quality and distinct runs, one row."""
    return catalogue.agg(F.count("*").alias("n_entries"), F.count_distinct("run").alias("n_runs"), *[F.count_if(quality(q)).alias(f"n_{q}") for q in [*QUALITIES, "all"]])


def tag_counts(catalogue: DataFrame) -> DataFrame:
    """(tag, n_entries, n_runs)."""
    return catalogue.groupBy("tag").agg(F.count("*").alias("n_entries"), F.count_distinct("run").alias("n_runs"))


def stage_counts(catalogue: DataFrame, name: str = "All", fraction: float = 1.0, first_run: int | None = None, last_run: int | None = None) -> DataFrame:
    """(total, after_quality, quality_runs, after_range, range_runs, after_fraction): entries and runs left by each filter, one row.

    ``after_fraction`` is the size of a sample of that share: one at least, halves to even.
    """
    good = quality(name)
    ranged = good
    if first_run is not None:
        ranged = ranged & (F.col("run") >= first_run)
    if last_run is not None:
        ranged = ranged & (F.col("run") <= last_run)
    runs = lambda kept: F.count_distinct(F.when(kept, F.col("run")))
    out = catalogue.agg(F.count("*").alias("total"), F.count_if(good).alias("after_quality"), runs(good).alias("quality_runs"), F.count_if(ranged).alias("after_range"), runs(ranged).alias("range_runs"))
    size = F.greatest(F.lit(1), F.rint(F.col("after_range") * fraction).cast("bigint")) if fraction < 1 else F.col("after_range")
    return out.withColumn("after_fraction", size)


def in_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of the given (training) runs."""
    return rows.join(runs.select("run").distinct(), "run", "left_semi")


def ground_truth(status: DataFrame, catalogue: DataFrame, name: str = "All") -> DataFrame:
    """Adds ``gt`` to files: known_good, not_certified, or unknown where the catalogue has no such entry."""
    flags = last_entries(catalogue).select(*FILE, quality(name).alias("good"))
    gt = F.when(F.col("good"), "known_good").when(~F.col("good"), "not_certified").otherwise("unknown")
    return status.join(flags, FILE, "left").withColumn("gt", gt).drop("good")


def from_list(status: DataFrame, listed: DataFrame) -> DataFrame:
    """Adds ``gt`` from a plain list of good files."""
    rows = status.join(listed.select(*FILE, F.lit(True).alias("_in")).distinct(), FILE, "left")
    return rows.withColumn("gt", F.when(F.col("_in"), "known_good").otherwise("unknown")).drop("_in")


def crosstab(judged: DataFrame) -> DataFrame:
    """(gt, ok, warn, pend, alert): counts."""
    counts = judged.groupBy("gt").pivot("status", ["ok", "warn", "pend", "alert"]).count()
    return counts.na.fill(0)


def rates(judged: DataFrame) -> DataFrame:
    """(gt, status, n, total, percent) of the pairs that occur."""
    from pyspark.sql import Window as W

    rows = judged.groupBy("gt", "status").agg(F.count("*").alias("n"))
    rows = rows.withColumn("total", F.sum("n").over(W.partitionBy("gt")))
    return rows.withColumn("percent", 100.0 * F.col("n") / F.col("total"))


def framework_tiers(status: DataFrame) -> DataFrame:
    """(run, subrun, loose, medium, tight): 0 or 1 by status."""
    s = F.col("status")
    return status.select(*FILE, s.isin("ok", "warn", "pend").cast("int").alias("loose"), s.isin("ok", "warn").cast("int").alias("medium"), (s == "ok").cast("int").alias("tight"))
