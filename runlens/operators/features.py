"""Features of each (file, channel): metric statistics, occupancy, dead fraction, side tables."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import bit, guarded

#: Metrics of a hit, in order.
METRICS = ["sideband_mean", "sideband_rms", "nPulses", "pulseHeight_max", "pulseHeight_min", "pulseArea_max", "pulseArea_min", "pulseDuriation_max", "pulseDuriation_min", "TDC", "TDCRollovers"]
#: Pins without a signal, and number of signal pins.
DEAD_PINS = [*range(32, 40), 43]
SIGNAL_PINS = 48
TRIGGER_BITS = 16
TRIGGER_FEATURES = [*(f"triggerRate_bit{i + 1}" for i in range(TRIGGER_BITS)), "triggerRate_tot", "triggerCounts_tot"]
FILE = ["run", "subrun"]
#: Hits that a task gets at a time, about, when distinct events are counted.
EVENT_ROWS = 1 << 18
TRIGGER_CHANNEL, LVDS_CHANNEL = "trigger_rate", "trigger_lvds_total"


def feature_columns(metrics: list[str] = METRICS, use_trigger: bool = True, use_lvds: bool = True, exclude: tuple[str, ...] = ()) -> list[str]:
    """Ordered feature names of the flags, without those that match an exclusion glob."""
    names = [f"{m}_{s}" for m in metrics for s in ("mean", "std", "median")] + ["occupancy", "frac_dead"]
    names += ["LVDSpin"] * use_lvds + TRIGGER_FEATURES * use_trigger + ["LVDStotal"] * use_lvds
    return [n for n in names if not any(fnmatch(n, g) for g in exclude)]


def distinct_events(hits: DataFrame, dead: Column, event: str, n_hits: int) -> DataFrame:
    """(run, subrun, event, channel, dead) of each distinct one, dealt out by file and event to as many tasks as ``n_hits`` ask for.

    Adaptive execution would make about one task a core of them, each as large
    as the table.
    """
    dealt = hits.where(F.col(event).isNotNull()).repartition(1 + n_hits // EVENT_ROWS, *FILE, event)
    return dealt.groupBy(*FILE, event, "channel").agg(dead.alias("dead"))


def channel_features(hits: DataFrame, metrics: list[str] = METRICS, pulses: str = "nPulses", event: str = "event_id", only: list[str] | None = None, n_hits: int | None = None) -> DataFrame:
    """One row a (run, subrun, channel): mean, sample std and median of the metrics, occupancy and dead fraction.

    Statistics without values (also the std of one row) are 0; rows without a
    channel are left out.  The events of a file are counted by distinct id, its
    rows without a channel included; files without hits have no rows.  ``only``
    names the features that are wanted.

    Distinct (file, channel, event) are dealt out by file and event, so that
    no file's events meet in one task.  There one row of each (file, event) is
    marked, and all counts are sums over (file, channel).  ``n_hits``, about the
    number of hits, says over how many tasks; if it is not given, they are
    counted (of Parquet, only footers are read for that).
    """
    names = [f"{m}_{s}" for m in metrics for s in ("mean", "std", "median") if only is None or f"{m}_{s}" in only]
    shares = [c for c in ("occupancy", "frac_dead") if only is None or c in only]
    kinds = {"mean": F.avg, "std": F.stddev_samp, "median": F.median}
    stats = [F.coalesce(kinds[n.rpartition("_")[2]](n.rpartition("_")[0]), F.lit(0.0)).alias(n) for n in names]
    own = hits.where("channel is not null").groupBy(*FILE, "channel").agg(*stats) if stats else hits.where("channel is not null").select(*FILE, "channel").distinct()
    if not shares:
        return own
    dead = F.max(F.col(pulses) == 0) if "frac_dead" in shares else F.lit(False)
    events = distinct_events(hits, dead, event, hits.count() if n_hits is None else n_hits)
    first = F.row_number().over(W.partitionBy(*FILE, event).orderBy("channel")) == 1
    counts = events.withColumn("first", first).groupBy(*FILE, "channel").agg(F.count("*").alias("n_events"), F.count_if("dead").alias("n_dead"), F.count_if("first").alias("n_first"))
    counts = counts.withColumn("file_events", F.sum("n_first").over(W.partitionBy(*FILE)))
    rows = own.join(counts, [*FILE, "channel"], "left")
    values = {"occupancy": F.try_divide("n_events", "file_events"), "frac_dead": F.try_divide("n_dead", "n_events")}
    return rows.select(*FILE, "channel", *names, *[F.coalesce(values[c], F.lit(0.0)).alias(c) for c in shares])


def file_keys(*tables: DataFrame) -> list[str]:
    """What names a file: run and subrun, and the directory where all tables have it."""
    return [*FILE, *(["directory"] if all("directory" in t.columns for t in tables) else [])]


def first_by_file(table: DataFrame, order: str = "line") -> DataFrame:
    """Of rows that repeat a file (run, subrun and, if there, directory), the first."""
    keys = file_keys(table)
    rest = [c for c in table.columns if c not in keys]
    return table.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def with_lvds_pin(features: DataFrame, lvds: DataFrame) -> DataFrame:
    """Adds LVDSpin, the count of the pin of two neighbouring channels; null where there is none.

    ``lvds``: (run, subrun, pins map<int, double>, total); where both sides have
    a directory, only tables of the same directory count.
    """
    keys = file_keys(features, lvds)
    return features.join(lvds.select(*keys, "pins"), keys, "left").withColumn("LVDSpin", F.try_element_at("pins", F.expr("int(channel div 2)"))).drop("pins")


def normalised_rates(board: DataFrame, config: DataFrame, on: str = "run") -> DataFrame:
    """Trigger rates by prescale: rate i / prescale i where that is positive, else null.

    ``board``: one row a file with triggerRate_bit1..16; ``config``: (run,
    prescale array<double>, trigger bigint).  Switched-off bits are null, and
    all rates where a run's configuration has no prescale; without a
    configuration rates stay; totals stay always.
    """
    known = config.select(on, "prescale", "trigger", F.lit(True).alias("configured"))
    rows = board.join(known, on, "left")

    def rate(i: int) -> Column:
        value = F.col(f"triggerRate_bit{i + 1}")
        scaled = F.when(F.col("configured").isNull(), value).otherwise(guarded(value, F.get("prescale", i)))
        return F.when(F.coalesce(bit(F.col("trigger"), i) == 0, F.lit(False)), None).otherwise(scaled)

    return rows.withColumns({f"triggerRate_bit{i + 1}": rate(i) for i in range(TRIGGER_BITS) if f"triggerRate_bit{i + 1}" in board.columns}).drop("prescale", "trigger", "configured")


def rates_before_and_after(board: DataFrame, config: DataFrame, on: str = "run") -> DataFrame:
    """(run, subrun, bit, raw, normalised, prescale): each trigger rate before and after, for a plot."""
    bits = [i for i in range(TRIGGER_BITS) if f"triggerRate_bit{i + 1}" in board.columns]
    name = lambda i: f"triggerRate_bit{i + 1}"
    keys = list(dict.fromkeys([*file_keys(board), on]))
    raw = board.select(*keys, *[F.col(name(i)).alias(f"raw{i}") for i in bits])
    rows = raw.join(normalised_rates(board, config, on).select(*keys, *[name(i) for i in bits]), keys).join(config.select(on, "prescale"), on, "left")
    each = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("bit"), F.col(f"raw{i}").alias("raw"), F.col(name(i)).alias("normalised"), F.get("prescale", i).alias("prescale")) for i in bits]))
    return rows.select(*keys, each.alias("e")).select(*keys, "e.*")


def masked_channels() -> list[tuple[int, int, int]]:
    """(pin, mask byte, bit) of each pair of channels: pair l is the l-th pin with a signal."""
    pins = [p for p in range(64) if p not in DEAD_PINS][:SIGNAL_PINS]
    return [(p, p // 8, p % 8) for p in pins]


def null_masked(features: DataFrame, config: DataFrame, columns: list[str]) -> DataFrame:
    """All features of channels that a run's mask (array of bytes) switches off become null; rows stay."""
    rows = features.join(config.select("run", "mask"), "run", "left")
    pair = F.expr("int(channel_num div 2)")
    pin = F.get(F.array(*[F.lit(p) for p, _, _ in masked_channels()]), pair)
    byte = F.get("mask", F.floor(pin / 8).cast("int"))
    off = F.coalesce(F.getbit(byte, pin % 8) == 0, F.lit(False))
    return rows.withColumns({c: F.when(~off, F.col(c)) for c in columns}).drop("mask")


def with_pseudo_rows(features: DataFrame, files: DataFrame, board: DataFrame | None, lvds: DataFrame | None, columns: list[str]) -> DataFrame:
    """Channels as text with their number, and up to two pseudo-channels for each file of ``files``.

    A file without trigger or pin row still gets its pseudo-channels, with nulls.
    Side tables are joined by directory too where ``files`` and they have it.
    """
    out = features.select(*FILE, F.col("channel").cast("string").alias("channel"), F.col("channel").cast("int").alias("channel_num"), *[c for c in columns if c in features.columns])
    none = F.lit(None).cast("int").alias("channel_num")
    for name, side, own in ((TRIGGER_CHANNEL, board, TRIGGER_FEATURES), (LVDS_CHANNEL, lvds, ["LVDStotal"])):
        if side is not None:
            kept = [c for c in own if c in columns and c in side.columns]
            keys = file_keys(files, side)
            rows = files.select(*keys).distinct().join(side.select(*keys, *kept), keys, "left")
            out = out.unionByName(rows.select(*FILE, F.lit(name).alias("channel"), none, *kept), allowMissingColumns=True)
    missing = [c for c in columns if c not in out.columns]
    return out.withColumns({c: F.lit(None).cast("double") for c in missing}).select(*FILE, "channel", "channel_num", *columns) if columns else out
