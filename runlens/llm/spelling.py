"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols.  Each word, so reduced, gives its full
one-edit neighbourhood: itself and every deletion, replacement and insertion of
a symbol.  Those are joined with the reduced vocabulary: two words that differ
by one edit differ by one or none once reduced, so no pair is missed, and with
few symbols the neighbourhood stays small at any size of the real alphabet.
What the join finds is verified on the words as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read_documents, ship_package, slices, written
from .tokens import Words, crcs_of, shifted, text_bytes

#: Words have at least so many code points and occurrences.
LEAST_POINTS, LEAST_COUNT = 6, 5
#: A word's form is at least so many times as frequent as the word.
TIMES = 5
#: In one of so many runs of letters a letter is dropped.
DROP = 199
#: Symbols of the reduced alphabet: with s, a word of n letters gives 2 n s - n + s + 1 neighbours, and one in about s**n words shares each by chance.
SYMBOLS = 8
#: Base of the polynomial hash of reduced words (odd, so that it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
#: Neighbours that are made at once.
AT_ONCE = 1 << 20
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_LOWER = np.array([b | 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def blanked(data: bytes) -> bytes:
    """UTF-8 with A-Z lower-cased and all but A-Z, a-z and U+00C0 to U+00FF made spaces, byte for byte."""
    b = np.frombuffer(data, np.uint8)
    lead = b == 0xC3  # the first byte of U+00C0 to U+00FF, and of nothing else
    keep = _LETTER[b] | lead
    keep[1:] |= lead[:-1]
    return np.where(keep, _LOWER[b], np.uint8(32)).tobytes()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop: int = DROP, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of all texts that are long and frequent enough.

    A run of letters loses a letter where ``drop`` divides the CRC-32 of id,
    colon and run; a null id is written as nothing.
    """
    least_points = max(1, least_points)
    ship_package(docs.sparkSession)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in slices(batch, "text"):
                offsets, data = text_bytes(part.column("text"))
                words = Words(offsets, blanked(data))
                if not words.distinct:
                    continue
                keys = crcs_of([b":" if i is None else b"%d:" % i for i in part.column("doc_id").to_pylist()])
                own = crcs_of(words.distinct)
                h = shifted(keys[words.text_of()], words.sizes[words.at]) ^ own[words.at]
                cut = np.flatnonzero(h % np.uint32(drop) == 0)
                counts = np.bincount(words.at, minlength=len(words.distinct)) - np.bincount(words.at[cut], minlength=len(words.distinct))
                texts = [w.decode() for w in words.distinct]
                out = {w: n for w, n in zip(texts, counts.tolist(), strict=True) if n and len(w) >= least_points}
                for x, k in zip(words.at[cut].tolist(), h[cut].tolist(), strict=True):
                    at = k % len(texts[x])
                    w = texts[x][:at] + texts[x][at + 1 :]
                    if len(w) >= least_points:
                        out[w] = out.get(w, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], ["word", "n"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return map_batches(rows, batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def symbol_values(symbols: int = SYMBOLS) -> np.ndarray:
    """A 64-bit value of each symbol."""
    x = np.arange(1, symbols + 1, dtype=np.uint64) * np.uint64(BASE)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n, modulo 2**64."""
    return np.cumprod(np.append(np.uint64(1), np.full(n, BASE, np.uint64)), dtype=np.uint64)


def reduced(words: list[str], symbols: int = SYMBOLS) -> np.ndarray:
    """Symbols, as numbers, of words of one length: a row a word."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return (points % np.uint32(symbols)).reshape(len(words), -1)


def reduced_hash(own: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hash of each reduced word."""
    return (values[own] * powers(own.shape[1])[-2::-1]).sum(1, dtype=np.uint64)


def neighbourhood(own: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of all words within one edit of each reduced word, each once, in portions.

    A deletion inside a run of one symbol, and an insertion behind the same
    symbol, give what their neighbour gives, and are left out.
    """
    m, n = own.shape
    symbols, power, base = len(values), powers(n + 1), np.uint64(BASE)
    inverse = np.uint64(pow(BASE, -1, 1 << 64))
    parts = values[own] * power[n - 1 :: -1][:n]
    before = np.concatenate([np.zeros((m, 1), np.uint64), np.cumsum(parts, axis=1, dtype=np.uint64)], axis=1)
    whole = before[:, -1:]
    yield np.arange(m), whole[:, 0]
    width = max(1, AT_ONCE // (2 * symbols * m))
    for a in range(0, n + 1, width):
        i = np.arange(a, min(n + 1, a + width))
        j = i[i < n]
        gone = before[:, j] * inverse + whole - before[:, j + 1]
        rows, columns = np.nonzero((own[:, j] != own[:, j - 1]) | (j == 0))
        yield rows, gone[rows, columns]
        for s in range(symbols):
            instead = whole + (values[s] - values[own[:, j]]) * power[n - 1 - j]
            rows, columns = np.nonzero(own[:, j] != s)
            yield rows, instead[rows, columns]
            more = before[:, i] * base + values[s] * power[n - i] + whole - before[:, i]
            rows, columns = np.nonzero((own[:, i - 1] != s) | (i == 0))
            yield rows, more[rows, columns]


def by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Places of the words of each length, in portions of bounded size."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == n)
        step = max(1, AT_ONCE // (16 * SYMBOLS * max(1, n)))
        for a in range(0, len(places), step):
            yield places[a : a + step]


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n) of all ordered pairs of different words, one edit apart, of a written table (word, n) of distinct words."""
    ship_package(words.sparkSession)
    values = symbol_values(symbols)

    def probes(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts, keys = batch.column("word").to_pylist(), batch.column("key").to_numpy(zero_copy_only=False)
            for places in by_length(texts):
                for rows, hashes in neighbourhood(reduced([texts[i] for i in places], symbols), values):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[places[rows]]), pa.array(hashes.view(np.int64))], ["key", "probe"])

    def members(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = batch.column("word").to_pylist()
            out = np.zeros(len(texts), np.uint64)
            for places in by_length(texts):
                out[places] = reduced_hash(reduced([texts[i] for i in places], symbols), values)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(out.view(np.int64))], ["near", "near_n", "probe"])

    keyed = words.select("word", "n", F.xxhash64("word").alias("key"))
    asked = map_batches(keyed.select("word", "key"), probes, "key long, probe long")
    there = map_batches(words.select("word", "n"), members, "near string, near_n long, probe long")
    found = asked.join(there, "probe").where(F.col("key") != F.xxhash64("near")).drop("probe")
    # hashes of probes and keys may collide: only what holds for the words themselves counts, and once
    return found.join(keyed, "key").drop("key").where(F.levenshtein("word", "near", 1) == 1).distinct()


def roots_of(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) of a table (word, form) whose chains have at most ``steps`` steps: the distance looked ahead doubles each round."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, steps)))):
        now = written(now, "roots")
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return now


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop: int = DROP, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT, times: int = TIMES, symbols: int = SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of all texts.

    A word's form is its most frequent word at one edit's distance, the
    smallest in code-point order among ties, if it is ``times`` as frequent as
    the word; else null.  The root is what the forms lead to, or the word
    itself.  Null and empty texts have no words; repeated rows count each;
    other columns are not read; an empty table gives no rows.
    """
    words = written(word_counts(docs, id_col, text_col, drop, least_points, least_count), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words, symbols).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    near = written(near.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "near-words")
    most = words.agg(F.max("n")).first()[0] or least_count
    roots = roots_of(near.where("form is not null"), 1 + int(math.log(most / least_count, times)))  # each step multiplies n
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of ``documents`` with the forms that they are variants of."""
    return spelling_groups(read_documents(spark, sf_dir))
