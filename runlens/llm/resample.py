"""Importance resampling towards a target: hashed n-gram weights, then a distributed quickselect.

Each document's weight is the sum of its n-grams' gains, which an array of one
gain a bucket gives.  With noise from the document's id added, the highest
scores are a draw in proportion to the weights.  The k-th highest is found by
quickselect: a few random keys of what is left are pivots, one aggregation
counts exactly what lies below, at and between them, and the range around the
k-th key goes on.  Only the winners are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, read_documents, ship_package, slices, written
from .tokens import Words, crcs_of, shifted, text_bytes

BUCKETS = 10_000
#: Runs of one to so many words are features.
LONGEST = 3
#: A document needs so many words to be drawn.
LEAST_WORDS = 20
#: Of a hundred documents with enough words, so many are drawn.
PERCENT = 5
SEED = 42
#: Random keys that one pass compares all remaining rows with: what is left falls to a sixteenth a pass, as a rule.
PIVOTS = 15
#: Winners that one task numbers.
ROWS_A_PART = 100_000
#: A-Z become a-z; other ASCII than these and digits becomes a space.
PLAIN = bytes((b | 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def features(texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(offsets of the texts' words, for each length of run: (first word, bucket) of every run)."""
    offsets, data = text_bytes(texts)
    words = Words(offsets, data.translate(PLAIN))
    own, after = crcs_of(words.distinct), crcs_of([b" " + w for w in words.distinct])
    text = words.text_of()
    crcs, found = own[words.at] if len(own) else np.empty(0, np.uint32), []
    for n in range(longest):
        if n:  # one more word behind each run, where its text goes on
            last = words.at[n:]
            crcs = shifted(crcs[: len(last)], words.sizes[last] + 1) ^ after[last] if len(last) else crcs[:0]
        first = np.arange(len(crcs))
        inside = text[first] == text[first + n]
        found.append((first[inside], crcs[inside] % np.uint32(buckets)))
    return words.offsets, found


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts in each bucket.  A task sends one row a bucket at most, and so does the sum to the driver."""
    ship_package(df.sparkSession)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in source:
            for part in slices(batch, "text"):
                for _, found in features(part.column("text"), buckets, longest)[1]:
                    sums += np.bincount(found, minlength=buckets)
        own = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(sums[own])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in map_batches(df.select(df[text_col].alias("text")), batches, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket in thousandths: log of the target's smoothed share over the documents' own."""
    n, of_own, of_target = len(own), float(own.sum() + len(own)), float(target.sum() + len(own))
    return np.array([math.floor(1000 * math.log(float(target[i] + 1) * of_own / (float(own[i] + 1) * of_target))) for i in range(n)], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(id, n_words, n_features, weight, tie) of every row; tie is a hash of the text, which tells rows of one id apart."""
    ship_package(docs.sparkSession)
    names = ["doc_id", "n_words", "n_features", "weight", "tie"]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in slices(batch, "text"):
                offsets, found = features(part.column("text"), len(gains), longest)
                n = np.diff(offsets)
                weight, count = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                for first, bucket in found:
                    sums, ends = np.append(0, np.cumsum(gains[bucket])), np.searchsorted(first, offsets)
                    weight += sums[ends[1:]] - sums[ends[:-1]]
                    count += np.diff(ends)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(count), pa.array(weight), part.column("tie")], names)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("tie"))
    return map_batches(rows, batches, "doc_id long, n_words long, n_features long, weight long, tie long")


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of seed and id; a null id is written as nothing."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


#: Composite key in ascending order: highest score first, then smallest id, null ids last, then the text's hash.
KEY = ("negative", "no_id", "id", "tie")


def keyed(scores: DataFrame) -> DataFrame:
    return scores.withColumns({"negative": -F.col("score"), "no_id": F.col("doc_id").isNull().cast("long"), "id": F.coalesce("doc_id", F.lit(0))})


def _compared(key: tuple[int, ...]) -> tuple[Column, Column]:
    """(less, equal): how a row's key compares with this one."""
    less, equal = F.lit(False), F.lit(True)
    for name, value in zip(reversed(KEY), reversed(key), strict=True):
        one = F.lit(value).cast("long")
        less = (F.col(name) < one) | ((F.col(name) == one) & less)
        equal = (F.col(name) == one) & equal
    return less, equal


def quickselect(rows: DataFrame, k: int, seed: int = SEED) -> tuple[int, ...] | None:
    """The k-th smallest key, k from 1, of written rows that have the columns of KEY; None for k = 0.

    A pass draws pivots at random from the open range that holds the k-th key
    and counts, in one aggregation, the rows below and at each.  So the driver
    sees some keys and counts; each pass takes the pivots themselves out, which
    bounds the passes also where one key has most of the rows.
    """
    if k < 1:
        return None
    left, before, turn = rows, 0, 0
    while True:
        order = F.xxhash64(F.lit(seed), F.lit(turn), *KEY)
        pivots = sorted({tuple(r[c] for c in KEY) for r in left.select(*KEY, order.alias("o")).orderBy("o").limit(PIVOTS).collect()})
        if not pivots:
            raise ValueError(f"fewer than {k} rows")
        sums = [F.count_if(x) for p in pivots for x in _compared(p)]
        counts = list(left.agg(*[x.alias(f"c{i}") for i, x in enumerate(sums)]).first())
        below, above = None, None
        for p, less, equal in zip(pivots, counts[::2], counts[1::2], strict=True):
            if before + less >= k:
                above = p
                break
            if before + less + equal >= k:
                return p
            below, skipped = p, less + equal
        if below is not None:
            less, equal = _compared(below)
            left, before = left.where(~(less | equal) & (F.col(KEY[0]) >= below[0])), before + skipped
        if above is not None:
            left = left.where(_compared(above)[0] & (F.col(KEY[0]) <= above[0]))
        turn += 1


def ranked(winners: DataFrame, n: int) -> DataFrame:
    """Adds ``rank`` from 1, in the order of the key, to about ``n`` rows: sorted by ranges of the key, each range numbered by one task."""
    parts = max(1, math.ceil(n / ROWS_A_PART))
    dealt = written(winners.repartitionByRange(parts, *KEY).withColumn("part", F.spark_partition_id()), "winners")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row for 100,000 winners
    own = F.row_number().over(W.partitionBy("part").orderBy(*KEY))
    return dealt.withColumn("own", own).join(starts, "part").withColumn("rank", (F.col("own") + F.col("start")).cast("long")).drop("part", "own", "start")


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``.

    Weights come from the shares of hashed runs of words in all of ``docs`` and
    in all of ``target``.  Of the rows with at least ``least_words`` words,
    ``percent`` of a hundred (rounded down) are drawn and ranked by score, ties
    to the smaller id; rank is null elsewhere.  Null and empty texts have no
    features and weight 0.  Null ids have one and the same noise and come last
    among ties.  Rows of one id and score are told apart by their texts; rows
    alike in all take the ranks that are left to them.  Other columns are not
    read; an empty table gives no rows.
    """
    gains = gains_of(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, text_col, buckets, longest))
    scores = weighted(docs, gains, id_col, text_col, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = keyed(written(scores, "scores"))
    able = rows.where(F.col("n_words") >= least_words)
    k = able.count() * percent // 100
    last = quickselect(able, k, seed)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    less, equal = _compared(last)
    won = (F.col("n_words") >= least_words) & (less | equal)
    best = ranked(rows.where(won), k)
    # more rows than k only where the last key is repeated: these are alike
    drawn = best.select(*columns, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return drawn.unionByName(rows.where(~won).select(*columns, F.lit(None).cast("long").alias("rank")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their weight towards the benchmark's texts, and the rank of those drawn."""
    out = importance_resample(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
