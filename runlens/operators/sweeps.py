"""Parameter sweeps and voting ensembles over a long table (run, subrun, model, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILE = ["run", "subrun"]
#: Run numbers that one task orders.
REACH = 1 << 16
#: Values of k that are laid out, and thresholds of a sweep, at most.
MOST_K = 10_000


def grid(spark, **values: list) -> DataFrame:
    """All combinations of the parameters' values: a small table for a join."""
    out = None
    for name, own in values.items():
        column = spark.createDataFrame([(v,) for v in own], [name])
        out = column if out is None else out.join(column)
    return out


def sweep_flags(log: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(z_threshold, run, subrun, channel, anomalous): the log judged again at each threshold.

    Scores are computed once; thresholds are compared afterwards.  The grid is
    broadcast, so more than MOST_K rows are refused.
    """
    if thresholds.limit(MOST_K + 1).count() > MOST_K:
        raise ValueError(f"more than {MOST_K} thresholds")
    return log.join(F.broadcast(thresholds)).select("z_threshold", *FILE, "channel", F.coalesce(F.col("max_z") > F.col("z_threshold"), F.lit(False)).alias("anomalous"), "max_z")


def model_metrics(flags: DataFrame, truth: DataFrame, ok: str = "tight", by: tuple[str, ...] = ()) -> DataFrame:
    """(model, n, n_known_good, fp, tn, fp_percent, tn_percent, ok_percent).

    ``flags``: (run, subrun, model, loose, medium, tight); a file alerts where all
    three are 0; ``ok`` is the tier that counts as good.  Rates without known
    good files are null.  ``by`` adds columns, such as the run.
    """
    rows = flags.join(truth.select(*FILE, F.col("good").alias("kg")), FILE, "left").withColumn("kg", F.coalesce("kg", F.lit(False)))
    alert = (F.col("loose") + F.col("medium") + F.col("tight")) == 0
    good = F.col(ok) == 1
    out = rows.groupBy("model", *by).agg(F.count("*").alias("n"), F.count_if("kg").alias("n_known_good"), F.count_if(F.col("kg") & alert).alias("fp"), F.count_if(F.col("kg") & good).alias("tn"), F.count_if(good).alias("n_ok"))
    percent = lambda a, b: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b))
    return out.select("model", *by, "n", "n_known_good", "fp", "tn", percent("fp", "n_known_good").alias("fp_percent"), percent("tn", "n_known_good").alias("tn_percent"), percent("n_ok", "n").alias("ok_percent"))


def flat_metrics(flags: DataFrame, truth: DataFrame, ok: str = "tight") -> DataFrame:
    """model_metrics of the models that have known-good files."""
    return model_metrics(flags, truth, ok).where("n_known_good > 0")


def mean_ok_rate(flags: DataFrame, ok: str = "tight") -> DataFrame:
    """(model, mean_ok_percent): the mean over runs of each run's rate."""
    runs = flags.groupBy("model", "run").agg((100.0 * F.avg((F.col(ok) == 1).cast("int"))).alias("r"))
    return runs.groupBy("model").agg(F.avg("r").alias("mean_ok_percent"))


def from_confusion(confusion: DataFrame) -> DataFrame:
    """(model, n_known_good, fp, tn, fp_percent, tn_percent) from stored counts; models without known good files drop out."""
    rows = confusion.where("gt = 'known_good'").groupBy("model").agg(F.sum("n").alias("n_known_good"), F.sum(F.when(F.col("status") == "alert", F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("status") == "ok", F.col("n")).otherwise(0)).alias("tn"))
    return rows.where("n_known_good > 0").select("*", (100.0 * F.col("fp") / F.col("n_known_good")).alias("fp_percent"), (100.0 * F.col("tn") / F.col("n_known_good")).alias("tn_percent"))


def best_per_threshold(metrics: DataFrame, n: int = 3) -> DataFrame:
    """The n models with the lowest false-positive rate of each z threshold."""
    order = W.partitionBy("z_threshold").orderBy(F.col("fp_percent").asc_nulls_last(), "model")
    return metrics.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def marginals(metrics: DataFrame, parameters: list[str], values: list[str], name: str = "model") -> DataFrame:
    """(parameter, value, metric, n, mean, lowest, lowest_model, highest, highest_model) of a grid of models.

    One row for each value of each parameter and each metric, over all other
    parameters, and one for the whole grid (parameter null); one pass with
    grouping sets.  Models without the metric do not count; ties go to the
    smaller name.
    """
    rows = metrics.select(name, *parameters, F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("y")) for v in values])).alias("m")).select(name, *parameters, "m.*").where("y is not null and not isnan(y)")
    low, high = F.min(F.struct("y", name)), F.min(F.struct((-F.col("y")).alias("y"), name))
    sets = [["metric", p] for p in parameters] + [["metric"]]
    got = rows.groupingSets(sets, "metric", *parameters).agg(F.count("*").alias("n"), F.avg("y").alias("mean"), low.alias("low"), high.alias("high"), *[F.grouping(p).alias(f"all_{p}") for p in parameters])
    which = F.coalesce(*[F.when(F.col(f"all_{p}") == 0, F.lit(p)) for p in parameters])
    value = F.coalesce(*[F.when(F.col(f"all_{p}") == 0, F.col(p).cast("string")) for p in parameters])
    return got.select(which.alias("parameter"), value.alias("value"), "metric", "n", "mean", F.col("low.y").alias("lowest"), F.col(f"low.{name}").alias("lowest_model"), (-F.col("high.y")).alias("highest"), F.col(f"high.{name}").alias("highest_model"))


def curves(metrics: DataFrame, along: str, by: list[str], values: list[str], at: dict | None = None) -> DataFrame:
    """(by, along, metric, y): points of a curve for each combination of ``by`` and each metric, where ``at`` holds.

    A metric that is null gives no point.
    """
    rows = metrics
    for column, value in (at or {}).items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows.unpivot([*by, along], values, "metric", "y").where("y is not null")


def best_profiles(metrics: DataFrame, rates: DataFrame, n: int = 5, n_each: int = 3) -> DataFrame:
    """(best, rank, model, value, run, ok_percent): the runs' rates of the best models, for a plot.

    ``metrics``: (model, z_threshold, fp_percent); ``rates``: (model, run,
    ok_percent).  ``best`` is fp (the n lowest false-positive rates), fp_z<z>
    (the ``n_each`` lowest of each z threshold) or coverage (the n highest means
    over runs, whatever the other rate).  Models without rates of runs are left
    out; ties go to the smaller name.
    """
    rates = rates.where("ok_percent is not null")
    means = rates.groupBy("model").agg(F.avg("ok_percent").alias("value"))
    fp = metrics.where("fp_percent is not null").join(means.select("model"), "model", "left_semi").select("model", "z_threshold", F.col("fp_percent").alias("value"))
    each = fp.withColumn("rank", F.row_number().over(W.partitionBy("z_threshold").orderBy("value", "model"))).where(F.col("rank") <= n_each)
    # of the n best ones overall each is among the n best of its threshold: one row a threshold and rank meets in the last window
    some = fp.withColumn("_r", F.row_number().over(W.partitionBy("z_threshold").orderBy("value", "model"))).where(F.col("_r") <= n)
    best = some.orderBy("value", "model").limit(n).withColumn("rank", F.row_number().over(W.orderBy("value", "model")))
    cover = means.orderBy(F.desc("value"), "model").limit(n).withColumn("rank", F.row_number().over(W.orderBy(F.desc("value"), "model")))
    kinds = [best.select(F.lit("fp").alias("best"), "rank", "model", "value"), each.select(F.concat(F.lit("fp_z"), F.col("z_threshold").cast("string")).alias("best"), "rank", "model", "value"), cover.select(F.lit("coverage").alias("best"), "rank", "model", "value")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).join(rates.select("model", "run", "ok_percent"), "model").select("best", "rank", "model", "value", "run", "ok_percent")


def vote_vectors(votes: DataFrame, truth: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(vector, kg, n): how many known-good and other files have the same votes.

    ``vector`` holds (model, ok) of the models that scored a file, in order; it
    has a part for each model at most.  Files are many, vectors few: panels are
    evaluated on these.  ``by`` adds columns, such as the run.
    """
    files = votes.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("model", "ok"))).alias("vector"))
    files = files.join(truth.select(*FILE, F.col("good").alias("kg")), FILE, "left").withColumn("kg", F.coalesce("kg", F.lit(False)))
    return files.groupBy("vector", "kg", *by).agg(F.count("*").alias("n"))


def bad_votes(vectors: DataFrame, panel: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(panel, size, bad, kg, n): files that all members of a panel scored, by the number of members that say bad."""
    sizes = panel.groupBy("panel").agg(F.count("*").alias("size"))
    rows = vectors.withColumn("id", F.xxhash64("vector")).select("vector", "id", "kg", "n", *by, F.explode("vector").alias("v")).select("vector", "id", "kg", "n", *by, "v.model", "v.ok")
    met = rows.join(panel, "model").groupBy("panel", "id", "vector", "kg", "n", *by).agg(F.count("*").alias("scored"), F.sum("ok").alias("ok"))
    full = met.join(sizes, "panel").where("scored = size")
    return full.groupBy("panel", "size", (F.col("size") - F.col("ok")).alias("bad"), "kg", *by).agg(F.sum("n").alias("n"))


def vote_metrics(votes: DataFrame, truth: DataFrame, panel: DataFrame, least: DataFrame | None = None) -> DataFrame:
    """(panel, k, n_scored, n_known_good, fp_percent, coverage_percent) of panels of models.

    ``votes``: (run, subrun, model, ok 0/1); ``panel``: (panel, model).  Only files
    that all members scored count; a file is good where fewer than k members
    say bad; k runs from 1 to the panel's size, or over ``least`` (k).
    Coverage is the share of the scored files that are good.
    """
    if least is not None and least.limit(MOST_K + 1).count() > MOST_K:
        raise ValueError(f"more than {MOST_K} values of k")
    # panels, sizes and bad votes make few rows; k is laid out on them
    counts = bad_votes(vote_vectors(votes, truth), panel)
    rows = counts.join(F.broadcast(least)) if least is not None else counts.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("size"))))
    ok = F.col("bad") < F.col("k")
    out = rows.groupBy("panel", "k").agg(F.sum("n").alias("n_scored"), F.sum(F.when(F.col("kg"), F.col("n")).otherwise(0)).alias("n_known_good"), F.sum(F.when(F.col("kg") & ~ok, F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("n_ok"))
    return out.select("panel", "k", "n_scored", "n_known_good", F.when(F.col("n_known_good") > 0, 100.0 * F.col("fp") / F.col("n_known_good")).alias("fp_percent"), (100.0 * F.col("n_ok") / F.col("n_scored")).alias("coverage_percent"))


def vote_run_rates(votes: DataFrame, truth: DataFrame, panel: DataFrame, k: int) -> DataFrame:
    """(panel, run, n_scored, ok_percent): the share of each run's scored files that fewer than ``k`` members call bad."""
    counts = bad_votes(vote_vectors(votes, truth, ("run",)), panel, ("run",))
    out = counts.groupBy("panel", "run").agg(F.sum("n").alias("n_scored"), F.sum(F.when(F.col("bad") < k, F.col("n")).otherwise(0)).alias("n_ok"))
    return out.select("panel", "run", "n_scored", (100.0 * F.col("n_ok") / F.col("n_scored")).alias("ok_percent"))


def panel_candidates(metrics: DataFrame, most: int = 100, by: str = "fp_percent", descending: bool = False, both: tuple[float, float] | None = None) -> DataFrame:
    """The ``most`` best models by a metric; ties go to the smaller name, models without the metric are left out.

    With ``both`` z thresholds, half of the places go to the best of each, and
    the rest follow in order.
    """
    value = F.col(by).desc() if descending else F.col(by).asc()
    rows = metrics.where(F.col(by).isNotNull())
    if both is None:
        return rows.orderBy(value, "model").limit(most)
    a, b = both
    own = rows.withColumn("_kind", F.when(F.col("z_threshold") == a, 0).when(F.col("z_threshold") == b, 1).otherwise(2))
    parts = [own.where(f"_kind = {k}").orderBy(value, "model").limit(n).withColumn("_part", F.lit(k)) for k, n in ((0, most // 2), (1, most // 2), (2, most))]
    united = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return united.orderBy("_part", value, "model").limit(most).drop("_kind", "_part")


def panels(models: DataFrame, size: int, both: tuple[float, float] | None = None) -> DataFrame:
    """(panel, model): all combinations of 2 or 3 candidate models (a list of at most some hundred).

    With ``both``, only those with a member at either z threshold.
    """
    rows = models.select("model", *(["z_threshold"] if both else []))
    out = rows.toDF(*[f"{c}0" for c in rows.columns])
    for i in range(1, size):
        out = out.join(rows.toDF(*[f"{c}{i}" for c in rows.columns]), F.col(f"model{i}") > F.col(f"model{i - 1}"))
    for z in both or ():
        has = F.col("z_threshold0") == z
        for i in range(1, size):
            has = has | (F.col(f"z_threshold{i}") == z)
        out = out.where(has)
    names = F.array(*[f"model{i}" for i in range(size)])
    return out.select(F.array_join(names, "+").alias("panel"), F.explode(names).alias("model"))


def best_panels(metrics: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The n panels of lowest false-positive rate, and the n of highest coverage; those without known-good files are left out."""
    metrics = metrics.where(F.col("fp_percent").isNotNull())
    by_fp = metrics.orderBy("fp_percent", F.desc("coverage_percent"), "panel", "k").limit(n)
    return by_fp, metrics.orderBy(F.desc("coverage_percent"), "fp_percent", "panel", "k").limit(n)


def run_islands(runs: DataFrame) -> DataFrame:
    """(first_run, last_run, n): blocks of consecutive run numbers.

    Blocks are found within ranges of REACH numbers.  Only those that touch an
    end of their range may go on in the next one; they are two a range at most,
    and one window joins them.
    """
    ranged = W.partitionBy("range").orderBy("run")
    rows = runs.select("run").where("run is not null").distinct().withColumn("range", F.floor(F.col("run") / REACH))
    rows = rows.withColumn("island", F.col("run") - F.row_number().over(ranged))
    parts = rows.groupBy("range", "island").agg(F.min("run").alias("first_run"), F.max("run").alias("last_run"), F.count("*").alias("n")).drop("range", "island")
    at_end = (F.pmod("first_run", F.lit(REACH)) == 0) | (F.pmod("last_run", F.lit(REACH)) == REACH - 1)
    order = W.orderBy("first_run")
    ends = parts.where(at_end).withColumn("new", F.coalesce(F.lag("last_run").over(order) + 1 != F.col("first_run"), F.lit(True)).cast("int"))
    ends = ends.withColumn("block", F.sum("new").over(order)).groupBy("block").agg(F.min("first_run").alias("first_run"), F.max("last_run").alias("last_run"), F.sum("n").alias("n")).drop("block")
    return parts.where(~at_end).unionByName(ends)


def partial_evaluations(evaluations: DataFrame, by: list[str], total: str = "n_total") -> DataFrame:
    """Evaluations with fewer files than the largest of their group: stale, to be run again."""
    return evaluations.withColumn("most", F.max(total).over(W.partitionBy(*by))).where(F.col(total) < F.col("most"))


def still_to_do(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Grid cells without a result."""
    return wanted.join(done.select(wanted.columns), wanted.columns, "left_anti")
