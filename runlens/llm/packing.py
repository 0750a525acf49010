"""Best-fit packing of token sequences by exact complements.

What fits together depends only on lengths, and there are at most ``capacity``
of them.  So the plan is made on the table of counts by length (bounded by the
capacity, whatever the corpus), as patterns of lengths with multiplicities;
the pieces themselves never leave the executors.  Each piece has a rank among
the pieces of its length, and the plan says which ranks go to which sequence.

Plan: from the longest length down, the gap that a piece leaves is filled
exactly by a single piece, a pair or a triple whose sum is the gap, as far as
the counts last; what is left is packed best-fit, longest first.  Fills of
fewer pieces are tried too, and the plan with the fewest sequences is taken.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import default_path, vocabulary
from .common import map_batches, read_documents, ship_package, slices, written

CAPACITY = 2048
#: Separator id after each document.
SEPARATOR = 0
#: Ranks of one length, at most.
RANKS = 1 << 44


Plan = list[tuple[tuple[int, ...], int]]


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """[(lengths of one sequence, number of such sequences)] that use up all counts.

    Triples that fill a gap exactly may take short pieces that later ones need,
    and so may pairs; so plans with exact fills of up to three, two and one
    piece are made, and that of the fewest sequences is taken.
    """
    total = sum(length * n for length, n in counts.items())
    best: Plan | None = None
    for most, even in ((3, False), (3, True), (2, False), (2, True), (1, False)):
        plan = exact_plan(counts, capacity, most, even)
        if best is None or sequences_of(plan) < sequences_of(best):
            best = plan
        if sequences_of(best) * capacity - total < capacity:  # no plan has fewer
            break
    return best


def sequences_of(plan: Plan) -> int:
    return sum(n for _, n in plan)


def exact_plan(counts: dict[int, int], capacity: int, most: int = 3, even: bool = False) -> Plan:
    """A plan whose exact fills have at most ``most`` pieces besides the longest; the rest is best-fit.

    The longest pieces are filled up first, or those whose fills are most
    ``even`` (pieces of about one length), which leaves short ones.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    plan: Plan = []

    def take(*lengths: int) -> None:
        """As many sequences of these lengths as the counts allow."""
        times = min(left[x] // lengths.count(x) for x in set(lengths))
        if times:
            plan.append((lengths, int(times)))
            for x in lengths:
                left[x] -= times

    def partners(gap: int, longest: int) -> np.ndarray:
        """Lengths a >= gap - a, a <= longest, for which a and gap - a are both left; longest first."""
        a = np.arange(min(gap - 1, longest), (gap - 1) // 2, -1)
        return a[(left[a] > 0) & (left[gap - a] > 0)]

    take(capacity)
    for length in range(1, capacity) if even else range(capacity - 1, 0, -1):
        gap = capacity - length
        if left[length] and gap <= length:
            take(length, gap)
        if left[length] and most > 1:
            for a in partners(gap, length).tolist():
                take(length, a, gap - a)
                if not left[length]:
                    break
        if left[length] and most > 2:
            firsts = np.arange(min(gap - 2, length), (gap + 2) // 3 - 1, -1)
            for a in firsts[left[firsts] > 0].tolist():
                for b in partners(gap - a, a).tolist():
                    take(length, a, b, gap - a - b)
                    if not left[length]:
                        break
                if not left[length]:
                    break
    return plan + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> Plan:
    """Best-fit of what is left at each length, longest first."""
    gaps: dict[int, Plan] = defaultdict(list)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        gap = length
        while n:
            while gap <= capacity and not gaps.get(gap):
                gap += 1
            if gap > capacity:
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    gaps[capacity - each * length].append(((length,) * each, full))
                if rest:
                    gaps[capacity - rest * length].append(((length,) * rest, 1))
                n = 0
                break
            lengths, times = gaps[gap].pop()
            used = min(n, times)
            if used < times:
                gaps[gap].append((lengths, times - used))
            gaps[gap - length].append(((*lengths, length), used))
            n -= used
            gap = length
    return [x for group in gaps.values() for x in group]


def slots_of(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted keys (length * RANKS + first rank), with the first sequence and the offset there."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            rows.append((length * RANKS + used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds ``place``: the rank, from 0, of each piece among all pieces of its length.

    ``pieces`` has (part, local) from the task that made it: the task and the
    rank within task and length.  Only counts by task and length are sorted.
    """
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return pieces.join(starts, ["part", "length"]).withColumn("place", F.col("before") + F.col("local"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds (sequence_id, offset) to a written table of pieces (part, local, length, ...).

    The counts collected to the driver and the plan sent back have at most
    ``capacity`` lengths, at any size of the corpus.  No pieces: no rows.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    assert len(counts) <= capacity, "lengths beyond the capacity"
    keys, sequences, offsets = slots_of(plan_packing(counts, capacity))
    rows = ranked(pieces).drop("part", "local", "before")
    names = [c for c in rows.columns if c != "place"]

    def batches(source):
        for batch in source:
            place = batch.column("place").to_numpy(zero_copy_only=False)
            want = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64) * RANKS + place
            at = np.searchsorted(keys, want, "right") - 1
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequences[at] + want - keys[at], pa.int64()), pa.array(offsets[at], pa.int64())], [*names, "sequence_id", "offset"])

    kinds = dict(rows.dtypes)
    return map_batches(rows, batches, ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id bigint, offset bigint")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every text as ids, then the separator, cut into pieces of at most ``capacity``.

    Null and empty texts give one piece, the separator.  Written once, since
    the ranks of pieces within a task must not change between reads.
    """
    ship_package(docs.sparkSession)
    path = path or default_path()
    end = SEPARATOR.to_bytes(4, "little")

    def batches(source):
        v = vocabulary(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in source:
            for rows in slices(batch, "text"):
                offsets, ids = v.encode_all(rows.column("text"))
                coded, bounds = ids.tobytes(), (4 * offsets).tolist()
                columns: tuple[list, ...] = ([], [], [], [], [], [])
                for doc, a, b in zip(rows.column("doc_id").to_pylist(), bounds, bounds[1:], strict=False):
                    whole = coded[a:b] + end
                    for piece, at in enumerate(range(0, len(whole), 4 * capacity)):
                        own = whole[at : at + 4 * capacity]
                        n = len(own) // 4
                        for c, x in zip(columns, (doc, piece, at // 4, n, zlib.crc32(own), int(seen[n])), strict=True):
                            c.append(x)
                        seen[n] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(columns[0]), pa.int32()), pa.array(columns[5], pa.int64())], [x.split()[0] for x in PIECES.split(", ")])

    return written(map_batches(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), batches, PIECES), "pieces")


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Repeated rows are packed as often as they come; other columns of ``docs``
    are not read; an empty table gives no rows.
    """
    out = pack(token_pieces(docs, path=path, capacity=capacity), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` packed into sequences of at most 2048 tokens."""
    return best_fit_packing(read_documents(spark, sf_dir))
