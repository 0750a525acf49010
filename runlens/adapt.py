"""The driver's star-schema tables seen as detector data, so that every operator has real rows to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import features as feat
from .operators import reference as ref
from .operators.detect import detection_log
from .operators.status import file_status
from .storage import written

METRICS = ["quantity", "price", "tax", "discount"]
#: Features that are scored.
COLUMNS = ["quantity_mean", "price_mean", "tax_mean", "occupancy"]
LAST_GOOD_RUN = 1997
Z, N, LEAST, BULK, EXTREME = 2.5, 2, 1, 3, 3.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: a run a year, a file a month, 16 channels by supplier, events by order."""
    return table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("run"),
        F.month("l_shipdate").alias("subrun"),
        (F.col("l_suppkey") % 16).cast("int").alias("channel"),
        F.col("l_orderkey").alias("event_id"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / 1000).alias("price"),
        F.col("l_tax").alias("tax"),
        F.col("l_discount").alias("discount"),
    )


def features(spark: SparkSession, sf_dir: str, only: list[str] | None = None) -> DataFrame:
    return feat.channel_features(hits(spark, sf_dir), METRICS, "discount", only=only)


def scored(features_: DataFrame) -> DataFrame:
    """All files, with channel 3 missing in July and channel 15 (unknown to the reference) there in May only."""
    return features_.where(~((F.col("channel") == 3) & (F.col("subrun") == 7)) & ~((F.col("channel") == 15) & (F.col("subrun") != 5)))


def is_good():
    return (F.col("run") <= LAST_GOOD_RUN) & (F.col("channel") != 15)


def good(scored_: DataFrame) -> DataFrame:
    return scored_.where(is_good())


def stats(scored_: DataFrame) -> DataFrame:
    """The reference of the good files."""
    return ref.reference_stats(ref.reference_state(good(scored_), COLUMNS)).where("n > 0")


def scored_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all files, aggregated once and kept as a table: reference, scoring and missing channels all read them."""
    return written(scored(features(spark, sf_dir, COLUMNS)), "features")


def zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scored_once(spark, sf_dir)
    return ref.zscores(f, stats(f), COLUMNS)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anomaly log, kept as a table."""
    f = scored_once(spark, sf_dir)
    s = stats(f)
    return written(detection_log(ref.zscores(f, s, COLUMNS), COLUMNS, Z, s.select("channel").distinct()), "log")


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_status(log(spark, sf_dir), N, LEAST, BULK, EXTREME)


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders a month and priority as trigger rates of five bits."""
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("run"), F.month("o_orderdate").alias("subrun"), F.substring("o_orderpriority", 1, 1).alias("p"))
    return rows.groupBy("run", "subrun").agg(*[F.count_if(F.col("p") == str(i)).cast("double").alias(f"triggerRate_bit{i}") for i in range(1, 6)])


def configs(spark: SparkSession) -> DataFrame:
    """Configurations of three runs: usual, one bit off and a mask, none for the prescale."""
    rows = [(1994, [1.0, 2.0, 0.0, 5.0, 10.0], 31, [255] * 8), (1995, [1.0, 2.0, 4.0, 5.0, 10.0], 29, [0b11101110, *[255] * 7]), (1996, None, 31, None)]
    return spark.createDataFrame(rows, "run int, prescale array<double>, trigger bigint, mask array<int>")


def lvds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders a month by eighth of the customers as pin counts."""
    rows = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("run"), F.month("o_orderdate").alias("subrun"), (F.col("o_custkey") % 8).cast("int").alias("pin")).agg(F.count("*").cast("double").alias("v"))
    return rows.groupBy("run", "subrun").agg(F.map_from_entries(F.collect_list(F.struct("pin", "v"))).alias("pins"), F.sum("v").alias("LVDStotal"))


def catalogue(files: DataFrame) -> DataFrame:
    """A catalogue entry for every file outside February."""
    k = F.col("run") * 13 + F.col("subrun")
    rows = files.select("run", "subrun").distinct().where("subrun <> 2")
    return rows.select("run", "subrun", (k % 5 != 0).alias("loose"), (k % 3 != 0).alias("medium"), (k % 3 == 1).alias("tight"), F.col("subrun").alias("position"))
