"""Quality classifier: ordinal (cumulative-link) regression on graded ratings.

One latent score, a sum of hashed text-feature weights, and ordered thresholds:
P(grade >= k) = sigmoid(score - threshold_k).  Features are the presence of
lower-cased words, of their beginnings, and of shape tokens (how large the shares of symbols,
capitals, exclamations, table bars and repeated words are).  The model is
fitted on a bounded sample of rated documents; every document is scored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_bytes, map_batches, read_documents, ship_package, slices, written

#: Buckets of hashed features.
BUCKETS = 1 << 18
#: Rated documents that the model is fitted on, at most.
SAMPLE = 16_000
#: Features found in fewer documents of the sample have no weight.
LEAST_DOCS = 5
#: Nor have features with which a grade is reached about as often as without: by this much, at least, the shares differ.
#: They also differ by more standard errors than the largest of so many chance differences would, sqrt(2 ln n) for n
#: features: with many more features than documents, weights would otherwise learn the sample by heart.
APART = 0.3
ROUNDS, STEP, RIDGE = 600, 0.1, 5e-5
#: Lengths, in bytes, of word beginnings that are features too.
PREFIXES = (5, 6, 7)
#: Numbers of words with the same beginning that are told apart.
LEVELS = (1, 2, 4)
EDGE = b".,;:!?\"'()[]{}*#$%&|<>-_/\\"
SYMBOLS = b"*#$%&|<>"


class Buckets(dict):
    """feature -> bucket; remembers at most ``limit`` features."""

    limit = 100_000

    def __missing__(self, feature: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(feature) % BUCKETS
        if len(self) < self.limit:
            self[feature] = value
        return value


_buckets = Buckets()


def shapes(name: bytes, share: float) -> list[bytes]:
    """One token for each tenth that the share reaches, after a first at 2 %."""
    return [b"\0%s>%d" % (name, k) for k in range(1, int(share * 10) + 1)] + ([b"\0%s>0" % name] if share >= 0.02 else [])


def word_features(times: Counter) -> list[bytes]:
    """Words, and their beginnings with the numbers of words that have them."""
    begun: Counter = Counter()
    for w, n in times.items():
        for k in PREFIXES:
            if len(w) >= k:
                begun[w[:k]] += n
    return [*times, *(p + b"\0%d" % k for p, n in begun.items() for k in LEVELS if n >= k)]


def shape_features(text: bytes, words: int, upper: int, repeats: float) -> list[bytes]:
    """Shape tokens of a text with so many words, of which ``upper`` are in capitals; ``repeats`` is the share of repeated triples."""
    n, size = max(1, words), max(1, len(text))
    tokens = shapes(b"symbols", (size - len(text.translate(None, SYMBOLS))) / size if text else 0.0)
    tokens += shapes(b"bars", text.count(b"|") / n)
    tokens += shapes(b"calls", text.count(b"!") / n)
    tokens += shapes(b"capitals", upper / n)
    tokens += shapes(b"repeats", repeats)
    return tokens + [b"\0words>%d" % k for k in (2, 5, 10, 20) if words > k]


def features(text: bytes) -> np.ndarray:
    """Sorted distinct buckets of a text."""
    words = text.split()
    times = Counter(w.strip(EDGE).lower() for w in words)
    del times[b""]
    n = len(words)
    repeats = 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / (n - 2) if n > 20 else 0.0
    found = [*word_features(times), *shape_features(text, n, sum(map(bytes.isupper, words)), repeats)]
    return np.unique(np.fromiter(map(_buckets.__getitem__, found), np.int32, len(found)))


@dataclass
class Ordinal:
    """Weights of the buckets and thresholds of grades 1, 2, ..."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, buckets: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.weights[buckets].sum(dtype=np.float64), -60, 60)))


class Scorer:
    """A model applied to many texts at once.

    Most words have neither a weight nor a beginning with one.  Each distinct
    word of a slice of texts is looked at once; only occurrences of the others
    are gathered by document, so the result is that of ``features`` and
    ``tails`` at a fraction of the work.
    """

    #: Words that are remembered.
    limit = 100_000

    def __init__(self, model: Ordinal):
        self.model = model
        self.weighted = set(np.flatnonzero(model.weights).tolist())
        self.words: dict[bytes, bytes | None] = {}
        self.beginnings: dict[bytes, bool] = {}
        self.repeats = any(_buckets[t] in self.weighted for t in shapes(b"repeats", 1.0))

    def begins(self, beginning: bytes) -> bool:
        """Whether any number of words with this beginning has a weight."""
        found = self.beginnings.get(beginning)
        if found is None:
            found = any(xxhash.xxh3_64_intdigest(beginning + b"\0%d" % k) % BUCKETS in self.weighted for k in LEVELS)
            if len(self.beginnings) < self.limit:
                self.beginnings[beginning] = found
        return found

    def base(self, word: bytes) -> bytes | None:
        """The word as a feature, if it or a beginning of it has a weight."""
        base = word.strip(EDGE).lower()
        found = None
        if base and (xxhash.xxh3_64_intdigest(base) % BUCKETS in self.weighted or any(len(base) >= k and self.begins(base[:k]) for k in PREFIXES)):
            found = base
        if len(self.words) < self.limit:
            self.words[word] = found
        return found

    def distinct_triples(self, at: np.ndarray, offsets: list[int], distinct: int) -> list[int]:
        """Number of distinct three-word sequences of each text."""
        if len(at) < 3:
            return [0] * (len(offsets) - 1)
        pairs = at[:-1].astype(np.int64) * distinct + at[1:]
        if distinct > 1 << 20:  # else a triple's number would not fit 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        triples = pairs[:-1] * distinct + at[2:]
        return [len(np.unique(triples[a : max(a, b - 2)])) for a, b in zip(offsets, offsets[1:], strict=False)]

    def tails(self, texts: pa.Array) -> tuple[list[np.ndarray], list[int]]:
        """(tails, number of words) of each text; a null text is empty."""
        whole = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(whole)
        flat, offsets = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
        solid = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # white space at the ends of a text gives empty words
        offsets = np.append(0, np.cumsum(solid))[offsets]
        coded = flat.filter(pa.array(solid)).dictionary_encode()
        at = coded.indices.to_numpy()
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar("\n", pa.large_string()))[0].as_buffer().to_pybytes()
        distinct = joined.split(b"\n") if len(coded.dictionary) else []
        bases = [self.words[w] if w in self.words else self.base(w) for w in distinct]
        upper = np.append(0, np.cumsum(np.fromiter(map(bytes.isupper, distinct), np.int64, len(distinct))[at]))[offsets]
        chosen = np.flatnonzero(np.fromiter((b is not None for b in bases), bool, len(bases))[at])
        found = [bases[i] for i in at[chosen].tolist()]
        parts = np.searchsorted(chosen, offsets).tolist()
        bounds = offsets.tolist()
        triples = self.distinct_triples(at, bounds, len(distinct)) if self.repeats else [0] * len(texts)
        out = []
        for i, text in enumerate(whole.cast(pa.large_binary()).to_pylist()):
            n = bounds[i + 1] - bounds[i]
            repeats = 1 - triples[i] / (n - 2) if n > 20 and self.repeats else 0.0
            own = [*word_features(Counter(found[parts[i] : parts[i + 1]])), *shape_features(text, n, int(upper[i + 1] - upper[i]), repeats)]
            out.append(self.model.tails(np.unique(np.fromiter(map(_buckets.__getitem__, own), np.int32, len(own)))))
        return out, np.diff(offsets).tolist()


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, columns: np.ndarray) -> Ordinal:
    """Maximum likelihood with a ridge on the weights, by Adam over the whole sample.

    ``rows`` are places in ``columns``, the buckets that have weights.
    Thresholds are a first one and positive steps, so they stay in order.
    Without rows every grade is as likely as the next.
    """
    weights = np.zeros(BUCKETS, np.float32)
    k = n_grades - 1
    if not rows:
        return Ordinal(weights, np.log(np.arange(1, n_grades) / np.arange(k, 0, -1)))
    index = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n, d = len(rows), len(columns)
    params = np.zeros(d + k)
    params[d] = -2.0
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, ROUNDS + 1):
        w = params[:d]
        cuts = params[d] + np.concatenate([[0.0], np.cumsum(np.exp(params[d + 1 :]))])
        score = np.bincount(owner, weights=w[index], minlength=n)
        tail = 1 / (1 + np.exp(np.clip(cuts[None] - score[:, None], -60, 60)))
        full = np.column_stack([np.ones(n), tail, np.zeros(n)])
        p = np.maximum(full[np.arange(n), grades] - full[np.arange(n), grades + 1], 1e-9)
        slope = np.column_stack([np.zeros(n), tail * (1 - tail), np.zeros(n)])
        up, down = slope[np.arange(n), grades], slope[np.arange(n), grades + 1]
        by_score = -(up - down) / p / n
        by_cut = np.zeros((n, k + 2))
        by_cut[np.arange(n), grades] += up / p / n
        by_cut[np.arange(n), grades + 1] -= down / p / n
        by_cut = by_cut[:, 1:-1].sum(0)
        gradient = np.empty_like(params)
        gradient[:d] = np.bincount(index, weights=by_score[owner], minlength=d) + RIDGE * w
        gradient[d] = by_cut.sum()
        for j in range(1, k):
            gradient[d + j] = by_cut[j:].sum() * np.exp(params[d + j])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        params -= STEP * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights[columns] = params[:d]
    return Ordinal(weights, params[d] + np.concatenate([[0.0], np.cumsum(np.exp(params[d + 1 :]))]))


def fit_on(docs: DataFrame, ratings: DataFrame, n_grades: int, sample: int = SAMPLE) -> Ordinal:
    """A model of ``ratings`` (doc_id, grade), fitted on at most ``sample`` rated documents, chosen by a hash of the id.

    Of an id's ratings the lowest is used, and of documents that share an id
    the smallest text; null ids and grades, and ratings without a document, are
    left out.  Features are made and screened by the
    executors; the driver gets the few that are left of each document.
    """
    ship_package(docs.sparkSession)
    chosen = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers, whatever the corpus
    rated = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("grade", "text")

    def featured(source):
        for batch in source:
            rows = [features(x or b"") for x in column_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(rows, pa.list_(pa.int32()))], ["grade", "buckets"])

    rated = written(map_batches(rated, featured, "grade int, buckets array<int>"), "rated")
    reached = rated.agg(F.count("*"), *[F.count_if(F.col("grade") >= g) for g in range(1, n_grades)]).first()
    strength = F.lit(0.0)
    for g in range(1, n_grades):
        share = min(max(reached[g] / max(1, reached[0]), 1e-6), 1 - 1e-6)
        apart = F.abs(F.count_if(F.col("grade") >= g) / F.count("*") - share)
        strength = F.greatest(strength, F.when(apart >= APART, apart * F.sqrt(F.count("*") / (share * (1 - share)))).otherwise(0.0))
    by_bucket = rated.select("grade", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("docs"), strength.alias("strength"))
    frequent = written(by_bucket.where(F.col("docs") >= LEAST_DOCS), "features")
    least = (2 * np.log(max(2, frequent.count()))) ** 0.5
    strong = frequent.where(F.col("strength") >= float(least)).select("bucket")
    columns = np.array(sorted(r["bucket"] for r in strong.collect()), np.int32)  # at most BUCKETS numbers

    def narrowed(source):
        for batch in source:
            rows = [np.searchsorted(columns, np.intersect1d(x, columns)).astype("<i4").tobytes() for x in map(np.asarray, batch.column("buckets").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(rows, pa.binary())], ["grade", "places"])

    got = sorted((r["grade"], bytes(r["places"])) for r in map_batches(rated, narrowed, "grade int, places binary").collect())
    return fit([np.frombuffer(b, "<i4") for _, b in got], np.array([g for g, _ in got], np.int64), n_grades, columns)


def ordinal_scores(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", least_grade: int = 2, least_tail: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, expected_grade, tail_prob, kept) of every row.

    ``tail_prob`` is P(grade >= ``least_grade``); kept: at least ``least_tail``.
    Null and empty texts have no features and get the thresholds' own
    probabilities, but are not kept.  Rows are judged each by its own text, also
    where ids repeat or are null.  Columns named in ``carry`` come along in a
    struct ``row``; others are not read.
    """
    ship_package(docs.sparkSession)
    out = ["expected_grade double", "tail_prob double", "kept boolean"]

    def batches(source):
        scorer = Scorer(model)
        for batch in source:
            for part in slices(batch, "text"):
                tails, words = scorer.tails(part.column("text"))
                expected, tail = [float(t.sum()) for t in tails], [float(t[least_grade - 1]) for t in tails]
                kept = [n > 0 and t >= least_tail for n, t in zip(words, tail, strict=True)]
                columns = [pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array(kept, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, *([part.column("row")] if carry else [])], ["doc_id", *(x.split()[0] for x in out), *(["row"] if carry else [])])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *([F.struct(*[docs[c] for c in carry]).alias("row")] if carry else []))
    schema = [f"doc_id {dict(docs.dtypes)[id_col]}", *out, *([f"row {rows.schema['row'].dataType.simpleString()}"] if carry else [])]
    return map_batches(rows, batches, ", ".join(schema))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as grades: 0 of low quality, 1 toxic, 2 clean."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, probability of the clean grade and verdict of every document."""
    docs = read_documents(spark, sf_dir)
    return ordinal_scores(docs, fit_on(docs, graded(spark, sf_dir), 3))
