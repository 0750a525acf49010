"""What the training-data operators share: words, hashes, Arrow batches, written tables.

Words are maximal runs of characters other than the six ASCII white-space
characters; on UTF-8 bytes this is what ``bytes.split()`` gives, so texts are
handled as bytes throughout.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping
from ..storage import discard, written  # noqa: F401  # the operators take them from here

#: ASCII white space, as a Java regular expression class.
SPACES = r"[\x20\x09-\x0D]+"
#: The same six characters, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"
BATCH_CONF, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Bytes of text that Python works on at once.
SLICE_BYTES = 8_000_000
#: Bytes of an Arrow batch, from which the next row starts another one.
BATCH_BYTES = "8m"


def row_key(id_col: Column, text: Column) -> Column:
    """128 bits of an id and a text: rows share a key only where both are equal, so what follows from the text is the same for them."""
    return F.unhex(F.md5(F.concat_ws("\0", F.when(id_col.isNull(), "null").otherwise(F.concat(F.lit("="), id_col.cast("string"))), F.when(text.isNull(), "null").otherwise(F.concat(F.lit("="), text))).cast("binary")))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """Array of words of a text; empty for null and for texts without words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


class HashCache(dict):
    """word -> 64-bit hash; remembers at most ``limit`` words."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value


_hashes = HashCache()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp values (mod 2**64) of all windows of ``width`` hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, width):
        out *= np.uint64(base)
        out += hashes[j : j + n]
    return out


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string or binary column as Python bytes, nulls as None."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most about ``most`` bytes of a column, so that what is held beside a part is bounded; a longer text is a part."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def map_batches(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose workers give back, after each task, what memory they no longer use."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(source)
        release_memory()

    return df.mapInArrow(batches, schema)


def release_memory() -> None:
    """Free memory goes back to the system; workers live on, and their allocators would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc here
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound what they hold.

    Arrow batches are held to ``BATCH_BYTES`` where the session leaves Spark's
    default of 64 MB: a task has a few of them in memory at once, in the JVM
    and in Python.
    """
    if spark.conf.get(BATCH_CONF) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)
    shipping.ship_package(spark)
