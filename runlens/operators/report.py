"""Tables behind reports and plots: frequencies, run summaries, grids, reference views, alert texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import clipped, compact, half_even, row_offset
from ..shipping import ship_package
from .features import LVDS_CHANNEL, TRIGGER_CHANNEL
from .status import file_counts, worst_channel

FILE = ["run", "subrun"]


def channel_frequency(log: DataFrame, n: int = 40) -> DataFrame:
    """The n channels with most anomalous rows."""
    return log.where("anomalous").groupBy("channel").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "channel").limit(n)


def feature_frequency(log: DataFrame, n: int = 20) -> DataFrame:
    """The n features triggered most; new_channel and missing_channel count as features."""
    names = log.select(F.explode(F.split("triggered_features", ";")).alias("feature")).select(F.trim("feature").alias("feature"))
    return names.where("feature <> '' and feature <> 'nan'").groupBy("feature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feature").limit(n)


def run_ok_share(status: DataFrame) -> DataFrame:
    """(run, n_subruns, n_good, n_pend, pct_good)."""
    return status.groupBy("run").agg(F.count("*").alias("n_subruns"), F.count_if(F.col("status") == "ok").alias("n_good"), F.count_if(F.col("status") == "pend").alias("n_pend")).withColumn("pct_good", 100.0 * F.col("n_good") / F.col("n_subruns"))


def persistence_summary(status: DataFrame) -> DataFrame:
    """(run, n_subruns, n_bad, n_warn, n_pend, n_good, pct_good): good is all but bad here."""
    rows = status.groupBy("run").agg(F.count("*").alias("n_subruns"), *[F.count_if(F.col("status") == s).alias(f"n_{name}") for s, name in (("alert", "bad"), ("warn", "warn"), ("pend", "pend"))])
    return rows.withColumns({"n_good": F.col("n_subruns") - F.col("n_bad") - F.col("n_warn") - F.col("n_pend"), "pct_good": 100.0 * (1 - F.col("n_bad") / F.col("n_subruns"))})


#: Codes of a grid's cells; 0 is no data.
CODES = {"ok": 1, "pend": 2, "warn": 3, "alert": 4}


def status_grid(status: DataFrame) -> DataFrame:
    """(run, subrun, code) of every cell of runs x subruns: 0 no data, 1 ok, 2 pend, 3 warn, 4 alert.

    The subrun numbers that occur (as many as the longest run has) are laid out
    for each run; files whose name does not parse have no cell.
    """
    known = status.where("run is not null and subrun is not null")
    subruns = known.select("subrun").distinct().agg(F.collect_list("subrun").alias("all"))
    cells = known.select("run").distinct().join(F.broadcast(subruns)).select("run", F.explode("all").alias("subrun"))
    code = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])[F.col("status")]
    return cells.join(known.select(*FILE, code.alias("code")), FILE, "left").select(*FILE, F.coalesce("code", F.lit(0)).alias("code"))


def anomaly_rate(log: DataFrame, status: DataFrame) -> DataFrame:
    """(run, subrun, n_bad, frac_bad, status): files without a status are ok."""
    return file_counts(log).join(status.select(*FILE, "status"), FILE, "left").select(*FILE, "n_bad", "frac_bad", F.coalesce("status", F.lit("ok")).alias("status"))


def coverage(features: DataFrame) -> DataFrame:
    """(channel, n_files, mean_files): files that each channel is in, and the mean over channels (some hundreds)."""
    rows = features.select(*FILE, "channel").distinct().groupBy("channel").agg(F.count("*").alias("n_files"))
    return rows.join(F.broadcast(rows.agg(F.avg("n_files").alias("mean_files"))))


def normalised_reference(stats: DataFrame) -> DataFrame:
    """(channel, feature, mean_norm, std_log, mean_unit) for display, each over a feature's channels.

    mean_norm: z over channels; std_log: log1p(std / median std); mean_unit: 0..1.
    """
    own = stats.groupBy("feature").agg(F.avg("mean").alias("m"), F.stddev_pop("mean").alias("s"), F.median("std").alias("mid"), F.min("mean").alias("low"), F.max("mean").alias("high"))
    rows = stats.join(own, "feature")
    return rows.select(
        "channel",
        "feature",
        ((F.col("mean") - F.col("m")) / (F.col("s") + 1e-9)).alias("mean_norm"),
        F.log1p(F.try_divide("std", "mid")).alias("std_log"),
        F.coalesce(F.try_divide(F.col("mean") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)).alias("mean_unit"),
    )


def mean_table(stats: DataFrame) -> DataFrame:
    """normalised_reference with the mean as short text."""
    return normalised_reference(stats).join(stats.select("channel", "feature", compact(F.col("mean")).alias("text")), ["channel", "feature"])


def channel_severity(log: DataFrame, bulk: int = 0, extreme: float = 0.0) -> DataFrame:
    """(run, subrun, channel, max_z, severity): alert for anomalous channels of a bulk file or of extreme z, warn, ok."""
    n = F.sum(F.col("anomalous").cast("int")).over(W.partitionBy(*FILE))
    hard = F.lit(False)
    if bulk > 0:
        hard = hard | (n >= bulk)
    if extreme > 0:
        hard = hard | F.coalesce(F.col("max_z") >= extreme, F.lit(False))
    return log.select(*FILE, "channel", "max_z", F.when(F.col("anomalous") & hard, "alert").when(F.col("anomalous"), "warn").otherwise("ok").alias("severity"))


def z_heatmap(z: DataFrame, columns: list[str]) -> DataFrame:
    """(run, subrun, channel, feature, z): |z| up to 50, null where a value is missing."""
    return z.unpivot([*FILE, "channel"], columns, "feature", "z").withColumn("z", clipped(F.col("z")))


def geometry(hits: DataFrame) -> DataFrame:
    """(channel, layer, row, column): place of each channel, of its smallest event."""
    return hits.groupBy("channel").agg(F.min(F.struct("event_id", "layer", "row", "column")).alias("g")).select("channel", "g.layer", "g.row", "g.column")


def geometry_map(hits: DataFrame, severity: DataFrame) -> DataFrame:
    """Place, max z (0 if null) and severity of each channel that has a result."""
    rows = geometry(hits).join(severity, "channel")
    return rows.withColumns({"y": row_offset(F.col("row"), F.col("channel").try_cast("int")), "max_z": F.coalesce("max_z", F.lit(0.0))})


def raw_and_normalised(raw: DataFrame, normal: DataFrame, columns: list[str]) -> DataFrame:
    """(run, subrun, channel, masked, raw_*, norm_*): both sides, null where a channel is in one only.

    masked: has raw values, and none once normalised.
    """
    keys = [*FILE, "channel"]
    rows = raw.select(*keys, *[F.col(c).alias(f"raw_{c}") for c in columns]).join(normal.select(*keys, *[F.col(c).alias(f"norm_{c}") for c in columns]), keys, "full_outer")
    return rows.withColumn("masked", F.coalesce(*[f"raw_{c}" for c in columns]).isNotNull() & F.coalesce(*[f"norm_{c}" for c in columns]).isNull())


def is_channel(channel: Column) -> Column:
    """Whether a name is that of a channel or pseudo-channel; plots leave others out."""
    return channel.try_cast("int").isNotNull() | channel.isin(TRIGGER_CHANNEL, LVDS_CHANNEL)


def channel_order(channel: Column) -> list[Column]:
    """Sort keys: numbers ascending, then the trigger and the pin pseudo-channel."""
    return [channel.try_cast("int").asc_nulls_last(), F.when(channel == TRIGGER_CHANNEL, 0).when(channel == LVDS_CHANNEL, 1).otherwise(2).asc()]


def file_order() -> list[Column]:
    """Sort keys of files: run, subrun; names that do not parse come last."""
    return [F.col("run").asc_nulls_last(), F.col("subrun").asc_nulls_last()]


def masked_geometry(raw: DataFrame, normal: DataFrame, columns: list[str], hits: DataFrame) -> DataFrame:
    """raw_and_normalised with the place of each channel, for a map of what is masked."""
    places = geometry(hits).select(F.col("channel").cast("string").alias("channel"), "layer", "row", "column")
    rows = raw_and_normalised(raw, normal, columns).withColumn("channel", F.col("channel").cast("string")).join(places, "channel", "left")
    return rows.withColumn("y", row_offset(F.col("row"), F.col("channel").try_cast("int")))


def log_counts(log: DataFrame) -> DataFrame:
    """(n_rows, n_files, n_runs, n_anomalous, n_bad_files) of a log, one row."""
    files = log.groupBy(*FILE).agg(F.count("*").alias("rows"), F.count_if("anomalous").alias("bad"))
    return files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_files"), F.count_distinct("run").alias("n_runs"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_anomalous"), F.count_if(F.col("bad") > 0).alias("n_bad_files"))


def top_channels(log: DataFrame, n: int = 5) -> DataFrame:
    """(run, subrun, channel, max_z, rank, more): the n largest z of each file, and how many it has besides."""
    rows = log.where("anomalous and max_z is not null")
    files = W.partitionBy(*FILE)
    rows = rows.withColumn("rank", F.row_number().over(files.orderBy(F.desc("max_z"), "channel"))).where(F.col("rank") <= n)
    counts = log.where("anomalous and max_z is not null").groupBy(*FILE).agg(F.count("*").alias("all"))
    return rows.join(counts, FILE).select(*FILE, "channel", "method", "triggered_features", "max_z", "rank", F.greatest(F.col("all") - n, F.lit(0)).alias("more"))


def channel_label(channel: Column) -> Column:
    """ch and the number of a channel; pseudo-channels by name."""
    name = channel.cast("string")
    return F.when(name.try_cast("int").isNotNull(), F.concat(F.lit("ch"), name)).otherwise(name)


def reasons(log: DataFrame, status: DataFrame, least: int = 1, bulk: int = 0, extreme: float = 0.0, n: int = 1) -> DataFrame:
    """(run, subrun, reason) of alerted files: a clause for each condition that fired.

    ``n`` is the number of files of the persistence window.
    """
    rows = status.where("status = 'alert'").join(file_counts(log).select(*FILE, "n_total"), FILE).join(worst_channel(log).select(*FILE, "worst_channel"), FILE)
    text = lambda c: F.col(c).cast("string")
    window = F.lit(f"  (window: {n} files)" if n > 1 else "")
    some = F.when(F.col("n_transient") > 0, F.concat(F.lit(" + "), text("n_transient"), F.lit(" transient"))).otherwise("")
    clauses = [F.when(F.col("n_persistent") >= least, F.concat(text("n_persistent"), F.lit(" persistent"), some, F.lit(" anomalous ch"), window))]
    if bulk > 0:
        clauses.append(F.when(F.col("n_anomalous") >= bulk, F.concat(text("n_anomalous"), F.lit("/"), text("n_total"), F.lit(f" anomalous ch  [bulk ≥{bulk}]"))))
    if extreme > 0:
        clauses.append(F.when(F.col("worst_z") >= extreme, F.concat(F.lit("extreme z="), F.format_string("%.1f", half_even(F.col("worst_z"), 1)), F.lit(" on "), channel_label(F.col("worst_channel")))))
    return rows.select(*FILE, F.concat_ws("  |  ", *clauses).alias("reason"))


def alert_text(log: DataFrame, status: DataFrame, least: int = 1, bulk: int = 0, extreme: float = 0.0, n: int = 5, window: int = 1) -> DataFrame:
    """(run, subrun, text): reason and the ``n`` worst channels of each alerted file, and how many there are besides."""
    line = F.concat(channel_label(F.col("channel")), F.lit(" ("), F.col("triggered_features"), F.lit(")"))
    lines = top_channels(log, n).groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"), F.max("more").alias("more"))
    lines = lines.select(*FILE, F.array_join(F.transform("l", lambda x: x["line"]), ", ").alias("worst"), "more")
    rows = reasons(log, status, least, bulk, extreme, window).join(lines, FILE, "left")
    tail = F.when(F.col("more") > 0, F.concat(F.lit(" and "), F.col("more").cast("string"), F.lit(" more")))
    return rows.select(*FILE, F.concat(F.lit("run "), F.col("run").cast("string"), F.lit(" subrun "), F.col("subrun").cast("string"), F.lit(": "), F.col("reason"), F.coalesce(F.concat(F.lit(" | "), F.col("worst"), F.coalesce(tail, F.lit(""))), F.lit(""))).alias("text"))


def worst_rows(log: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    """(by, lines): the ``n`` anomalous rows of largest z, a line each, and how many there are besides.

    Rows without a z do not count; ties go to the smaller file, then to the
    channel's text.  Where there are no rows with one, there is no row here.
    """
    rows = log.where("anomalous and max_z is not null").withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("max_z"), *[c for c in FILE if c not in by], F.col("channel").cast("string"))))
    number = lambda c, places: F.when(F.col(c).isNull(), F.lit("nan")).otherwise(F.format_string(f"%.{places}f", half_even(F.col(c), places)))
    line = F.concat(F.lit("  ch"), F.col("channel").cast("string"), F.lit(": max_z="), number("max_z", 1), F.lit("  if_score="), number("if_score", 3), F.lit("  features=["), F.coalesce("triggered_features", F.lit("")), F.lit("]"))
    top = F.sort_array(F.collect_list(F.when(F.col("_k") <= n, F.struct("_k", line.alias("line")))))
    own = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.transform(top, lambda x: x["line"]).alias("_lines"))
    more = F.when(F.col("_n") > n, F.array(F.format_string("  ... and %d more anomalous channels", F.col("_n") - n))).otherwise(F.array().cast("array<string>"))
    return own.select(*by, F.array_join(F.concat("_lines", more), "\n").alias("lines"))


NO_DATA = "  (no anomaly data)"


def alert_block(log: DataFrame, status: DataFrame, least: int = 1, bulk: int = 0, extreme: float = 0.0, n: int = 5, window: int = 1) -> DataFrame:
    """(run, subrun, text) of each alerted file: heading, conditions and the ``n`` anomalous channels of largest z with z, score and features."""
    rows = reasons(log, status, least, bulk, extreme, window).join(worst_rows(log, FILE, n), FILE, "left").join(log.groupBy(*FILE).agg(F.count_if("anomalous").alias("_all")), FILE)
    conditions = F.replace("reason", F.lit("  |  "), F.lit(", "))
    head = F.format_string("Run %d, subrun %d — ALERT\nConditions: %s\nAnomalous channels (%d total, top by max_z):\n", "run", "subrun", conditions, "_all")
    return rows.select(*FILE, F.concat(head, F.coalesce("lines", F.lit(NO_DATA))).alias("text"))


def historical_snapshot(log: DataFrame, runs: DataFrame, n: int = 5) -> DataFrame:
    """(run, n_subruns, n_bad_subruns, n_anomalous, top_channels, snapshot) of annotated runs; runs without a log have zeros.

    ``top_channels`` are those of the ``n`` anomalous rows of largest z, a
    channel as often as it is there; ``snapshot`` tells all that in words.
    """
    wanted = runs.select("run").distinct()
    own = log.join(wanted, "run", "left_semi")
    sums = own.groupBy("run").agg(F.count_distinct("subrun").alias("n_subruns"), F.count_distinct(F.when(F.col("anomalous"), F.col("subrun"))).alias("n_bad_subruns"), F.count_if("anomalous").alias("n_anomalous"))
    ranked = own.where("anomalous and max_z is not null").withColumn("r", F.row_number().over(W.partitionBy("run").orderBy(F.desc("max_z"), "subrun", F.col("channel").cast("string")))).where(F.col("r") <= n)
    top = ranked.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("r", F.col("channel").cast("string").alias("c")))).alias("l")).select("run", F.array_join(F.transform("l", lambda x: x["c"]), ",").alias("top_channels"))
    out = wanted.join(sums, "run", "left").join(top, "run", "left").join(worst_rows(own, ["run"], n), "run", "left")
    told = F.format_string("  Subruns in log: %d  |  subruns with anomalies: %d\n  Total anomalous channel-entries: %d\n  Top channels (by max_z):\n%s", "n_subruns", "n_bad_subruns", "n_anomalous", F.coalesce("lines", F.lit(NO_DATA)))
    missing = F.format_string("  (run %d not found in log — annotation used without snapshot)", "run")
    out = out.withColumn("snapshot", F.when(F.col("n_subruns").isNull(), missing).otherwise(told)).drop("lines")
    return out.na.fill(0, ["n_subruns", "n_bad_subruns", "n_anomalous"]).na.fill("", ["top_channels"])


def annotated(cases: DataFrame, log: DataFrame, n: int = 5) -> DataFrame:
    """The knowledge base's cases (run, category, cause, action, ...), each with its run's snapshot."""
    return cases.join(historical_snapshot(log, cases.select("run"), n), "run", "left")


def case_blocks(cases: DataFrame) -> DataFrame:
    """Adds ``block``, the text of an annotated case (run, snapshot and, where people gave them, category, cause, action, recovery)."""
    said = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none)) if c in cases.columns else F.lit(none)
    text = "### Case: run %d\nAnomaly data (auto-injected from log):\n%s\nHuman annotation:\n  Category : %s\n  Cause    : %s\n  Action   : %s\n  Recovery : %s"
    snapshot = F.col("snapshot") if "snapshot" in cases.columns else F.lit(NO_DATA)
    return cases.withColumn("block", F.format_string(text, "run", snapshot, said("category", "unknown"), *[said(c, "unspecified") for c in ("cause", "action", "recovery")]))


#: Most annotated cases of a prompt.
MOST_CASES = 1000


def prompt_text(alerts: DataFrame, cases: DataFrame, task: str) -> DataFrame:
    """(run, subrun, prompt): alert, annotated cases and task.

    ``cases`` is a list that people keep, MOST_CASES at most, in the order of
    ``position`` if they have one, else of their text: they are one text, which is
    sent along with every alert.  Without cases the prompts are null.
    """
    blocks = case_blocks(cases)
    rows = blocks.select("block", *[c for c in ("position",) if c in cases.columns]).limit(MOST_CASES + 1).collect()
    if len(rows) > MOST_CASES:
        raise ValueError(f"more than {MOST_CASES} cases")
    known = "\n\n".join(r["block"] for r in sorted(rows, key=lambda r: (r["position"] if "position" in r else 0, r["block"])))
    whole = F.concat(F.lit("## Current alert\n\n"), F.col("text"), F.lit("\n\n---\n\n## Historical reference cases\n\n"), F.lit(known), F.lit(task))
    return alerts.select(*FILE, (whole if rows else F.lit(None).cast("string")).alias("prompt"))


def categorised(prompts: DataFrame, provider: Callable[[str], str]) -> DataFrame:
    """(run, subrun, response, api_error): the provider's answer to each prompt.

    A call that fails leaves its message in ``api_error``, and so does a prompt
    that is null for want of cases, without a call; each prompt has a row.
    """
    ship_package(prompts.sparkSession)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for run, subrun, prompt in frame.itertuples(index=False):
                if prompt is None:
                    out.append((run, subrun, None, "knowledge base is empty"))
                    continue
                try:
                    out.append((run, subrun, provider(prompt), None))
                except Exception as error:  # whatever a provider raises
                    out.append((run, subrun, None, str(error)))
            yield pd.DataFrame(out, columns=["run", "subrun", "response", "api_error"])

    return prompts.select(*FILE, "prompt").mapInPandas(batches, "run int, subrun int, response string, api_error string")


CANDIDATE = "rank int, category string, likely_cause string, suggested_action string, matched_runs array<int>, confidence string"
ANSWER = f"candidates array<struct<{CANDIDATE.replace(' ', ':').replace(',:', ', ')}>>, reasoning string"


def parsed_response(responses: DataFrame, column: str = "response") -> DataFrame:
    """Adds ``suggestion`` (candidates, reasoning), ``raw_response`` and ``parse_error``.  Every row stays.

    What is no JSON object is told as it is in ``raw_response``; fields of an
    answer that are missing or of another kind are null.
    """
    # the parser stops after a first value; in brackets, whatever follows is an error or a second element
    said = F.try_parse_json(F.concat(F.lit("["), F.col(column), F.lit("]")))
    is_object = F.coalesce(F.schema_of_variant(said).startswith("ARRAY<OBJECT") & F.try_variant_get(said, "$[1]", "variant").isNull(), F.lit(False))
    rows = responses.withColumn("_object", is_object).withColumn("suggestion", F.when(F.col("_object"), F.from_json(column, ANSWER, {"mode": "PERMISSIVE"})))
    bad = F.col(column).isNotNull() & ~F.col("_object")
    return rows.withColumns({"raw_response": F.when(bad, F.col(column)), "parse_error": F.when(bad, F.lit("the answer is not JSON"))}).drop("_object")


def candidates(parsed: DataFrame) -> DataFrame:
    """(run, subrun, rank, category, likely_cause, suggested_action, matched_runs, confidence, reasoning): a row for each candidate of each answer.

    Candidates without a rank take their place in the answer; answers without
    candidates have no rows here.
    """
    rows = parsed.select(*FILE, F.col("suggestion.reasoning").alias("reasoning"), F.posexplode("suggestion.candidates").alias("place", "c")).where("c is not null")
    return rows.select(*FILE, F.coalesce("c.rank", F.col("place") + 1).alias("rank"), "c.category", "c.likely_cause", "c.suggested_action", "c.matched_runs", "c.confidence", "reasoning")


def matched_cases(candidates_: DataFrame, cases: DataFrame) -> DataFrame:
    """(run, subrun, rank, category, confidence, matched_run, case_category, case_cause, case_action): candidates beside the cases that they name.

    A candidate that names no run, or runs without a case, has one row with
    nulls for each; a run has a row for each of its cases.
    """
    rows = candidates_.select(*FILE, "rank", "category", "confidence", F.explode_outer(F.array_distinct("matched_runs")).alias("matched_run"))
    known = cases.select(F.col("run").alias("matched_run"), *[(F.col(c) if c in cases.columns else F.lit(None).cast("string")).alias(f"case_{c}") for c in ("category", "cause", "action")])
    return rows.join(known, "matched_run", "left").select(*FILE, "rank", "category", "confidence", "matched_run", "case_category", "case_cause", "case_action")
