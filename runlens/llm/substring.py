"""Substring dedup: repeated windows of words, found by Rabin-Karp hashes.

Every window of ``width`` consecutive words is hashed (64 bits, rolling); a
second polynomial deals the windows out to buckets, so two windows meet by
chance only where both values agree.  A task first keeps, of each hash it
sees, the occurrences in the smallest document: one entry a task stands for
even the most frequent window, the others are already known to be removed.
Spark groups the entries by bucket, where all entries of a hash meet in arrays
of bounded size; entries of documents beyond the smallest are sent back to
their documents.  There the words covered by marked windows merge into maximal
intervals.

Hashes travel packed, one row for a task, bucket and kind; the corpus itself
is shuffled once, to meet the marks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_bytes, map_batches, read_documents, rolling, ship_package, word_hashes

WIDTH = 13
#: Odd bases of the two rolling hashes.
BASE, BUCKET_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Characters of text for each bucket: about 2 million windows, 16 MB of hashes.
BUCKET_CHARS = 12_000_000
#: Words that a task gathers before it sends its hashes.
CHUNK_WORDS = 1_500_000
ENTRIES = "bucket long, marked boolean, docs binary, counts binary, hashes binary"


def window_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    return rolling(word_hashes(words), width, BASE)


def segments(keys: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of each run of equal keys."""
    if not len(keys):
        return []
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist()
    return list(zip(cuts, [*cuts[1:], len(keys)], strict=True))


def runs(docs: np.ndarray, hashes: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Packed (doc ids, entries of each, hashes); entries of a document are neighbours."""
    first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    return docs[first].astype("<i8").tobytes(), np.diff(np.append(first, len(docs))).astype("<u4").tobytes(), hashes.astype("<u8").tobytes()


def spread(docs: np.ndarray, parts: int) -> np.ndarray:
    """The part that each document's marks go to."""
    return ((docs.astype(np.uint64) * np.uint64(BASE) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def unpacked(docs: list[bytes], counts: list[bytes], hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each entry of packed rows."""
    owners = [np.repeat(np.frombuffer(d, "<i8"), np.frombuffer(n, "<u4")) for d, n in zip(docs, counts, strict=True)]
    return np.concatenate([np.empty(0, "<i8"), *owners]), np.frombuffer(b"".join(hashes), "<u8")


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
    columns = [list(x) for x in zip(*rows, strict=True)] or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "marked", "docs", "counts", "hashes"])


def beyond_first(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether each entry's document is not the smallest that has its hash."""
    order = np.lexsort((docs, hashes))
    h = hashes[order]
    first = np.append(True, h[1:] != h[:-1])
    lead = docs[order][np.flatnonzero(first)[np.cumsum(first) - 1]]
    out = np.empty(len(h), bool)
    out[order] = docs[order] > lead
    return out


def chunk_rows(parts: list[tuple[int, np.ndarray]], width: int, buckets: int) -> list[tuple]:
    """The packed entries of a chunk of documents, given as (doc_id, word hashes)."""
    parts.sort(key=lambda x: x[0])
    sizes = np.array([len(h) for _, h in parts])
    words = np.concatenate([h for _, h in parts])
    owner = np.repeat(np.array([d for d, _ in parts], np.int64), sizes)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = len(words) - width + 1
    if n <= 0:
        return []
    whole = place[width - 1 :] >= width - 1  # the window that ends here is of one document
    hashes, bucket = rolling(words, width, BASE)[whole], rolling(words, width, BUCKET_BASE)[whole]
    owner = owner[:n][whole]
    if not len(hashes):
        return []
    bucket = ((bucket >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    marked = beyond_first(hashes, owner)
    rows = []
    for kind in (False, True):
        own = np.flatnonzero(marked == kind)
        # entries that are already marked travel by document
        key = spread(owner[own], buckets) if kind else bucket[own]
        order = own[np.argsort(key, kind="stable")]
        key = np.sort(key, kind="stable")
        for a, b in segments(key):
            rows.append((int(key[a]), kind, *runs(owner[order[a:b]], hashes[order[a:b]])))
    return rows


def window_entries(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    def batches(source: Iterator[pa.RecordBatch]):
        parts: list[tuple[int, np.ndarray]] = []
        held = 0
        for batch in source:
            for doc, text in zip(batch.column("doc_id").to_pylist(), column_bytes(batch, "text"), strict=True):
                words = (text or b"").split()
                if doc is None or len(words) < width:
                    continue
                parts.append((doc, word_hashes(words)))
                held += len(words)
                if held >= CHUNK_WORDS:
                    yield batch_of(chunk_rows(parts, width, buckets))
                    parts, held = [], 0
        if parts:
            yield batch_of(chunk_rows(parts, width, buckets))

    return map_batches(docs, batches, ENTRIES)


def bucket_marks(entries: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, hashes): the windows to remove, one row a document.

    Marks leave the buckets packed by parts of the documents, and each part
    unpacks its own, so rows follow the documents and not documents times buckets.
    """

    def marks(table: pa.Table) -> pa.Table:
        marked = table.column("marked").to_numpy()
        packed = [table.column(c).to_pylist() for c in ("docs", "counts", "hashes")]
        rows = [(int(table.column("bucket")[i].as_py()), *(c[i] for c in packed)) for i in np.flatnonzero(marked)]
        d, h = unpacked(*([c[i] for i in np.flatnonzero(~marked)] for c in packed))
        if len(d):
            beyond = beyond_first(h, d)
            d, h = d[beyond], h[beyond]
            part = spread(d, buckets)
            order = np.lexsort((d, part))
            d, h, part = d[order], h[order], part[order]
            rows += [(int(part[a]), *runs(d[a:b], h[a:b])) for a, b in segments(part)]
        columns = [list(x) for x in zip(*rows, strict=True)] or [[]] * 4
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("part", "docs", "counts", "hashes"), columns, (pa.int64(), *[pa.binary()] * 3), strict=True)})

    def by_document(table: pa.Table) -> pa.Table:
        d, h = unpacked(*(table.column(c).to_pylist() for c in ("docs", "counts", "hashes")))
        order = np.argsort(d, kind="stable")
        d, h = d[order], h[order]
        found = segments(d)
        return pa.table({"doc_id": pa.array([int(d[a]) for a, _ in found], pa.int64()), "hashes": pa.array([h[a:b].tobytes() for a, b in found], pa.binary())})

    packed = entries.groupBy("bucket").applyInArrow(marks, "part long, docs binary, counts binary, hashes binary")
    return packed.groupBy("part").applyInArrow(by_document, "doc_id long, hashes binary")


def intervals(words: list[bytes], marks: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal word intervals covered by marked windows."""
    marked = np.frombuffer(marks, "<u8")
    starts = np.flatnonzero(np.isin(window_hashes(words, width), marked))
    if not len(starts):
        return starts, starts
    cut = np.append(True, starts[1:] > starts[:-1] + width)
    ends = starts[np.append(np.flatnonzero(cut)[1:], len(starts)) - 1] + width
    return starts[cut], ends


OUT = "n_words long, n_removed long, kept_text string, span_starts array<long>, span_ends array<long>"


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, carry: list[str] | None = None, as_is: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, span_starts, span_ends) of every document.

    A word is removed where a window that covers it also starts in a document
    with a smaller id.  ``kept_text`` has the kept words with one space
    between; spans are word intervals.  Null and empty texts have no words;
    texts of fewer words than a window are kept.  Ids are expected to be
    unique: rows that share one are each judged by the marks of that id.  Rows
    with a null id are kept whole.  Columns named in ``carry`` come along in a
    struct ``row``; others are not read.  With ``as_is``, ``kept_text`` is the
    text itself, spacing included, where nothing is removed.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.struct(*[docs[c] for c in carry or [id_col]]).alias("row"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(16, -(-chars // BUCKET_CHARS))
    marks = bucket_marks(window_entries(rows.select("doc_id", "text"), width, buckets), buckets).withColumnRenamed("hashes", "marks")

    def batches(source):
        for batch in source:
            columns: tuple[list, ...] = ([], [], [], [], [])
            for text, marks in zip(column_bytes(batch, "text"), batch.column("marks").to_pylist(), strict=True):
                words = (text or b"").split()
                starts, ends = intervals(words, marks, width) if marks else (np.empty(0, np.int64),) * 2
                cuts = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(words)]
                kept = [w for a, b in zip(cuts[::2], cuts[1::2], strict=True) for w in words[a:b]]
                left = (text and text.decode()) if as_is and len(kept) == len(words) else b" ".join(kept).decode()
                for c, x in zip(columns, (len(words), len(words) - len(kept), left, starts.tolist(), ends.tolist()), strict=True):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), batch.column("row")], ["doc_id", *(x.split()[0] for x in OUT.split(", ")), "row"])

    out = map_batches(rows.join(marks, "doc_id", "left"), batches, f"doc_id long, {OUT}, row {rows.schema['row'].dataType.simpleString()}")
    return out if carry else out.drop("row")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document after substring dedup with windows of 13 words."""
    out = substring_dedup(read_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
