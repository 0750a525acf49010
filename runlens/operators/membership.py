"""Which rows of a large table may have a key of a small one: a Bloom filter as a small table of bitmaps.

The filter is built by Spark's bitmap aggregates and looked up by a broadcast
join on the bitmap's number, so that rows without a chance leave before any
shuffle.  What passes must still be joined: some pass by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap (4 KB), as Spark's bitmap aggregates have them.
MAP_BITS = 32_768
#: Bits for each key, and bits in all at most (8 MB): with more keys than these bits serve, more rows pass.
BITS_EACH, MOST_BITS = 16, 1 << 26
#: Hash functions: with 16 bits a key, one row in about 70 passes by chance.
HASHES = 2


def _place(key: Column, turn: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(turn), key), F.lit(bits))


def filter_bits(n: int) -> int:
    """Bits of the filter for ``n`` keys: whole bitmaps."""
    return MAP_BITS * max(1, -(-min(MOST_BITS, n * BITS_EACH) // MAP_BITS))


def may_be_in(rows: DataFrame, column: str, keys: DataFrame, n: int) -> DataFrame:
    """The rows whose ``column`` may be among that of ``keys`` (``n`` of them): all that are, and some by chance.

    Null is in no table.  ``keys`` is aggregated once for each hash function;
    what is broadcast has ``filter_bits(n)`` bits.
    """
    bits = filter_bits(n)
    out = rows
    for turn in range(HASHES):
        place = _place(F.col(column), turn, bits)
        own = keys.where(F.col(column).isNotNull()).select(place.alias("_p"))
        maps = own.groupBy(F.bitmap_bucket_number("_p").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_map"))
        at = F.bitmap_bit_position(place)
        byte = F.conv(F.hex(F.substring("_map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0
        out = out.where(F.col(column).isNotNull()).withColumn("_part", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "_part").where(is_set).drop("_part", "_map")
    return out


def not_in(rows: DataFrame, column: str, known: DataFrame, n: int | None = None) -> DataFrame:
    """The ``rows`` (few) whose ``column`` is not in that of ``known`` (many); rows without a value stay.

    Only those known ones that the filter of the rows lets through are joined,
    so a large table of known keys is read but not shuffled.
    """
    n = rows.count() if n is None else n
    found = may_be_in(known.select(column), column, rows.select(column), n).distinct()
    return rows.join(found, column, "left_anti")
