"""MinHash near-dedup with b-bit signatures.

Each text becomes a set of word shingles and the minima of ``PERMUTATIONS``
hash functions over it.  Bands of minima give candidates; two low bits of each
minimum, packed into four longs, give a similarity estimate that is corrected
for chance agreement, so most false candidates cost a few bit counts; what
remains is confirmed on the full sets.

Texts with equal sets are one node from the start.  Candidates are never paired
all with all.  First each node meets one leader, the first node of a bucket of
its; what this links is one component.  Then, where nodes of different
components share a bucket, their signatures meet: in small buckets as pairs, in
large ones block by block inside tasks, those outside the bucket's main
component against all, each pair in its first common band only.  A bucket with
very many nodes outside its main component (texts of one form, say) would take
blocks by the square of its nodes; its nodes are dealt by rare shingles instead
(``rare_keys``), of which two alike sets always share one.  Of the pairs of
small buckets, the likeliest of every two components is confirmed on the texts,
and the others follow only where their components are still apart; of a block,
texts go to those rows that have a candidate there, and pairs are confirmed as
far as they connect more.  So a group of near copies costs rows in proportion to
its size, texts go only where they are compared, and no link that shares a
bucket is lost.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_bytes, map_batches, read_documents, rolling, row_key, ship_package, word_hashes, written
from .components import connected

BANDS, ROWS = 24, 5
PERMUTATIONS = BANDS * ROWS
#: Nodes of either side that meet in a block.
BLOCK = 2048
#: Shingles of the texts of either side of a block, about; a longer text is a block.
BLOCK_SHINGLES = 1 << 22
#: Buckets of at most so many nodes are paired by a join.
SMALL = 16
#: A bucket with more nodes outside its main component is dealt anew, by rare shingles.  So blocks of short texts have
#: at most HEAVY / BLOCK = 2 rows for a node of either side and as many for each of the bucket: 4 for each, at any size.
HEAVY = 2 * BLOCK
#: Counts by which shingles are put in order.
SLOTS = 1 << 16
BASE = 0x9E3779B97F4A7C15
_random = np.random.Generator(np.random.PCG64(20240501))
MULTIPLIERS = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
MIX = np.uint64(0xFF51AFD7ED558CCD)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    values = rolling(word_hashes(words), min(width, len(words)), BASE) + np.uint64(len(words) if len(words) < width else 0)
    values ^= values >> np.uint64(33)
    values *= MIX
    return np.unique(values)


def minima(values: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set that is not empty."""
    out = np.full(PERMUTATIONS, np.iinfo(np.uint64).max)
    for a in range(0, len(values), 4096):
        np.minimum(out, (values[a : a + 4096, None] * MULTIPLIERS + SHIFTS).min(0), out=out)
    return out


def packed_bits(low: np.ndarray) -> list[int]:
    """Two bits of each of the minima: two longs of first bits, two of second bits."""
    mixed = (low ^ (low >> np.uint64(31))) * MIX
    half = PERMUTATIONS // 2
    weights = np.uint64(1) << np.arange(half, dtype=np.uint64)
    return [int((((mixed[a : a + half] >> np.uint64(bit)) & np.uint64(1)) * weights).sum().astype(np.int64)) for bit in (62, 63) for a in (0, half)]


def band_keys(low: np.ndarray) -> list[int]:
    """A 64-bit key of each band; the band's number is part of it."""
    return [xxhash.xxh3_64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)]


#: Equal bits expected of unrelated minima: one in 2 ** 2.
CHANCE = 0.25


def least_matches(similarity: float, deviations: float = 6.0) -> int:
    """Agreeing minima below which ``similarity`` is out of question: that many standard deviations down."""
    p = similarity + (1 - similarity) * CHANCE
    return int(PERMUTATIONS * p - deviations * (PERMUTATIONS * p * (1 - p)) ** 0.5)


SIGNATURES = "own binary, doc_id long, n_shingles long, set_key binary, s0 long, s1 long, s2 long, s3 long, bands array<long>"
BITS = ["s0", "s1", "s2", "s3"]


def signatures(rows: DataFrame, width: int) -> DataFrame:
    """The signature of each row (own, doc_id, text)."""

    def batches(source):
        for batch in source:
            columns: tuple[list, ...] = tuple([] for _ in range(7))
            for text in column_bytes(batch, "text"):
                values = shingle_set(text or b"", width)
                row = (0, None, 0, 0, 0, 0, [])
                if len(values):
                    low = minima(values)
                    row = (len(values), xxhash.xxh3_128_digest(values.tobytes()), *packed_bits(low), band_keys(low))
                for c, x in zip(columns, row, strict=True):
                    c.append(x)
            kinds = (pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in SIGNATURES.split(", ")])

    return map_batches(rows, batches, SIGNATURES)


def agreeing(a: str, b: str) -> F.Column:
    """Number of agreeing minima of two rows' packed bits."""
    differ = [F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}")).bitwiseOR(F.col(f"{a}.s{i + 2}").bitwiseXOR(F.col(f"{b}.s{i + 2}"))) for i in (0, 1)]
    return F.lit(PERMUTATIONS) - F.bit_count(differ[0]) - F.bit_count(differ[1])


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def confirmed(pairs: DataFrame, texts: DataFrame, lengths: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (node, grp) whose texts' sets are alike, as links (a, b).

    A node's text goes to its partner in blocks of about BLOCK pairs or
    BLOCK_SHINGLES shingles; the two of a pair have similar numbers of these,
    and ``lengths`` (node, n_shingles) has that of the partner.
    """

    def links(table: pa.Table) -> pa.Table:
        grp = table.column("grp")[0].as_py()
        nodes = table.column("node").to_pylist()
        texts = table.column("text").cast(pa.binary())
        mine = shingle_set(texts[nodes.index(grp)].as_py() or b"", width)
        sets = (shingle_set(x.as_py() or b"", width) for x in texts)
        alike = [x for x, own in zip(nodes, sets, strict=True) if x != grp and 100 * (n := common_count(mine, own)) >= percent * (len(mine) + len(own) - n)]
        return pa.table({"a": pa.array(alike, pa.int64()), "b": pa.array([grp] * len(alike), pa.int64())})

    counts = pairs.groupBy("grp").agg(F.count("*").alias("n")).join(lengths.withColumnRenamed("node", "grp"), "grp")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("n") * F.col("n_shingles") / BLOCK_SHINGLES))
    sizes = written(counts.select("grp", blocks.alias("blocks")), "block-sizes")
    theirs = pairs.select("grp", "node").join(sizes, "grp").select("grp", F.pmod(F.xxhash64("node"), "blocks").alias("block"), "node")
    mine = sizes.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("grp").alias("node"))
    return theirs.unionByName(mine).join(texts, "node").groupBy("grp", "block").applyInArrow(links, "a long, b long")


def in_blocks(members: DataFrame, others: DataFrame) -> DataFrame:
    """Blocks of ``members`` and ``others`` (grp, band, node, component, n_shingles).

    Each side of a group is dealt to blocks of about BLOCK nodes or
    BLOCK_SHINGLES shingles, and every block of one side meets every block of
    the other.
    """
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    sizes = members.groupBy("grp").agg(blocks.alias("m")).join(others.groupBy("grp").agg(blocks.alias("o")), "grp")
    sizes = written(sizes, "block-sizes")

    def dealt(side: DataFrame, number: int, own: str, other: str) -> DataFrame:
        rows = side.join(sizes, "grp").withColumn("own", F.pmod(F.xxhash64("node"), own))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        names = ("own", "other") if number == 0 else ("other", "own")
        return rows.select("grp", F.col(names[0]).alias("mine"), F.col(names[1]).alias("theirs"), F.lit(number).alias("side"), "band", "node", "component", "n_shingles")

    return dealt(members, 0, "m", "o").unionByName(dealt(others, 1, "o", "m"))


def pairs_of(table: pa.Table, least: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row of one side, rows of the other that may be alike) of a block's signatures.

    Nodes of one component are no pair, and a pair is left to the first band
    that it shares; groups by rare shingles have the band -1 and take all.
    """
    side, band, component, size = (table.column(c).to_numpy() for c in ("side", "band", "component", "n_shingles"))
    bits = np.stack([table.column(c).to_numpy().view(np.uint64) for c in BITS])
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    members = np.flatnonzero(side == 0)
    for i in np.flatnonzero(side == 1).tolist():
        differ = (bits[:2, members] ^ bits[:2, i, None]) | (bits[2:, members] ^ bits[2:, i, None])
        n = PERMUTATIONS - np.bitwise_count(differ).sum(0)
        low, high = np.minimum(size[members], size[i]), np.maximum(size[members], size[i])
        near = members[(n >= least) & (component[members] != component[i]) & (100 * low >= percent * high)]
        if band[i] >= 0:
            near = near[(bands[near] == bands[i]).argmax(1) == band[i]]
        if len(near):
            yield i, near


BLOCK_ROWS = "grp long, mine long, theirs long, side int, band int, node long, component long, n_shingles long, s0 long, s1 long, s2 long, s3 long, bands array<long>"


def candidates(blocks: DataFrame, percent: int) -> DataFrame:
    """The rows of blocks with signatures that may be alike to some row of the other side."""
    least = least_matches(percent / 100)
    names = [x.split()[0] for x in BLOCK_ROWS.split(", ")]

    def some(table: pa.Table) -> pa.Table:
        hit = np.zeros(len(table), bool)
        for i, near in pairs_of(table, least, percent):
            hit[i] = True
            hit[near] = True
        return table.select(names).filter(pa.array(hit))

    return blocks.groupBy("grp", "mine", "theirs").applyInArrow(some, BLOCK_ROWS)


def linked(blocks: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of components between the sides of blocks with signatures and texts.

    Each link given connects what was not connected in its block before.
    """
    least = least_matches(percent / 100)

    def links(table: pa.Table) -> pa.Table:
        texts = table.column("text").cast(pa.binary())
        names = table.column("component").to_numpy()
        labels, own = np.unique(names, return_inverse=True)
        parent = list(range(len(labels)))
        sets: dict[int, np.ndarray] = {}

        def values(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(texts[i].as_py() or b"", width)
            return sets[i]

        def root(i: int) -> int:
            i = own[i]
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        a, b = [], []
        for i, near in pairs_of(table, least, percent):
            for j in near.tolist():
                x, y = root(i), root(j)
                if x == y:
                    continue
                mine, theirs = values(i), values(j)
                n = common_count(mine, theirs)
                if 100 * n >= percent * (len(mine) + len(theirs) - n):
                    parent[x] = y
                    a.append(int(names[i]))
                    b.append(int(names[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return blocks.groupBy("grp", "mine", "theirs").applyInArrow(links, "a long, b long")


def slot_counts(texts: DataFrame, width: int) -> np.ndarray:
    """Number of sets with a shingle in each of SLOTS slots, a shingle's slot being its low bits."""

    def batches(source):
        total = np.zeros(SLOTS, np.int64)
        for batch in source:
            for text in batch.column("text").cast(pa.binary()):
                np.add.at(total, (shingle_set(text.as_py() or b"", width) & np.uint64(SLOTS - 1)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["slot", "n"])

    found = map_batches(texts.select("text"), batches, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # SLOTS rows at most
    out = np.zeros(SLOTS, np.int64)
    out[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def rare_first(values: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, as many as it must share one of with any set alike.

    All sets are in one order (slot's count, hash).  Alike sets share at least
    ceil(percent * n / 100) of either's n shingles, so the first shingle that
    they share is, in both, followed by at least that many less one.
    """
    order = np.lexsort((values, counts[(values & np.uint64(SLOTS - 1)).astype(np.int64)]))
    return values[order[: len(values) + (-percent * len(values) // 100) + 1]]


def rare_keys(nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(grp, node, component, n_shingles): ``nodes`` (node, component, n_shingles) by each of their rarest shingles.

    No link between the nodes is lost, whatever the counts are; what a form's
    texts have in common has high counts and is not among their rarest.  A
    text gives (1 - percent / 100) of its shingles as rows.
    """
    rows = written(nodes.join(texts, "node"), "heavy-texts")
    counts = slot_counts(rows, width)

    def batches(source):
        for batch in source:
            keys = [rare_first(shingle_set(x.as_py() or b"", width), counts, percent).view(np.int64) for x in batch.column("text").cast(pa.binary())]
            at = pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in keys]), pa.int64())
            columns = [batch.column(c).take(at) for c in ("node", "component", "n_shingles")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else [], pa.int64()), *columns], ["grp", "node", "component", "n_shingles"])

    return map_batches(rows.select("node", "component", "n_shingles", "text"), batches, "grp long, node long, component long, n_shingles long")


def mixed_groups(placed: DataFrame) -> DataFrame:
    """``placed`` (grp, component, ...) with the size of the group, docs, where it has several components."""
    sizes = placed.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("docs")).where("low <> high").select("grp", "docs")
    return written(placed.join(written(sizes, "mixed"), "grp"), "placed")


def main_components(placed: DataFrame) -> DataFrame:
    """(grp, main, outside): the component with the most nodes of each group, and the number of other nodes."""
    counts = placed.groupBy("grp", "component").agg(F.count("*").alias("n"))
    return counts.groupBy("grp").agg(F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("outside"))


def without_heavy(placed: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``placed`` with the nodes of heavy buckets dealt by rare shingles instead."""
    heavy = written(main_components(placed.where(F.col("docs") > HEAVY)).where(F.col("outside") > HEAVY).select("grp"), "heavy")
    if heavy.isEmpty():
        return placed
    nodes = placed.join(heavy, "grp", "left_semi").select("node", "component", "n_shingles").distinct()
    fine = mixed_groups(rare_keys(nodes, texts, width, percent).withColumn("band", F.lit(-1)))
    return placed.join(heavy, "grp", "left_anti").unionByName(fine)


def relabelled(table: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``column`` replaced by its component, where ``labels`` (node, component) has it."""
    out = table.join(labels.select(F.col("node").alias(column), F.col("component").alias("_new")), column, "left")
    return out.withColumn(column, F.coalesce("_new", column)).drop("_new")


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(own, doc_id, n_shingles, component, component_id, kept) of every row.

    Texts are linked where 100 * intersection >= ``percent`` * union of their
    sets of distinct ``width``-word shingles (of fewer words: the whole
    sequence).  ``component`` is a number of the linked rows' own, which may
    differ between runs; ``component_id`` is their smallest id, null where all
    ids are null; ``kept`` where the row has this id.  Null and empty texts have
    no shingles and no links: ``component`` is null and they are kept.  Rows are
    linked each by its own text, also where ids repeat or are null.  ``own`` is
    the row's key by id and text.  Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).withColumn("own", row_key(F.col("doc_id"), F.col("text")))
    signed = written(signatures(rows.select("own", "doc_id", "text"), width), "signatures")
    heads = signed.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("first"), F.min("own").alias("own"), *[F.first(c).alias(c) for c in ("n_shingles", *BITS, "bands")])
    # leaders are the nodes of the smallest ids: later copies are made of earlier ones, so they are closer to these than to each other
    rank = F.coalesce("first", F.lit((1 << 63) - 1)).alias("rank")
    heads = written(heads.select("*", rank, F.monotonically_increasing_id().alias("node")), "heads")
    bits = heads.select("node", "n_shingles", *BITS)

    lengths = heads.select("node", "n_shingles")
    bands = heads.select("node", "rank", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    buckets = bands.groupBy("bucket").agg(F.min(F.struct("rank", "node")).alias("leader"), F.count("*").alias("nodes")).where("nodes > 1").select("bucket", F.col("leader.rank").alias("leader_rank"), F.col("leader.node").alias("leader"))
    shared = written(bands.drop("rank").join(written(buckets, "buckets"), "bucket"), "shared")
    least = least_matches(percent / 100)

    def alike(pairs: DataFrame) -> DataFrame:
        """Pairs (node, grp, ...) with the number of agreeing minima, as far as they may be linked."""
        both = pairs.alias("p").join(bits.alias("x"), "node").join(bits.withColumnRenamed("node", "grp").alias("y"), "grp")
        sized = 100 * F.least("x.n_shingles", "y.n_shingles") >= percent * F.greatest("x.n_shingles", "y.n_shingles")
        return both.where(sized).select(*[F.col(f"p.{c}") for c in pairs.columns], agreeing("x", "y").alias("n")).where(F.col("n") >= least)

    led = alike(shared.where("node <> leader").select("node", F.col("leader").alias("grp"), "leader_rank").distinct())
    star = written(led.groupBy("node").agg(F.max_by("grp", F.struct("n", -F.col("leader_rank"), -F.col("grp"))).alias("grp")), "stars")
    near = heads.join(shared.select("node").distinct(), "node", "left_semi").select("node", "own")
    texts = written(rows.select("own", "text").join(near, "own").dropDuplicates(["node"]).drop("own"), "near-texts")
    steps = [connected(confirmed(star, texts, lengths, width, percent))]

    placed = relabelled(shared.select("node", "band", "n_shingles", F.col("bucket").alias("grp"), F.col("node").alias("component")), "component", steps[0])
    placed = without_heavy(mixed_groups(placed), texts, width, percent)
    small = placed.where(F.col("docs") <= SMALL).select("grp", "node", "component")
    met = small.join(small.toDF("grp", "other", "theirs"), "grp").where("node > other and component <> theirs")
    pairs = written(alike(met.select("node", F.col("other").alias("grp"), F.col("component").alias("mine"), "theirs").distinct()), "pairs")
    links = []  # of components
    large = placed.where(F.col("docs") > SMALL).drop("docs")
    if not large.isEmpty():
        outside = large.join(written(main_components(large), "main"), "grp").where("component <> main").drop("main", "outside")
        blocks = in_blocks(large, outside).join(heads.select("node", *BITS, "bands"), "node")
        # texts go to those rows of a block only that have a candidate there
        some = written(candidates(blocks, percent), "candidates")
        links.append(written(linked(some.join(texts, "node"), width, percent), "links"))
    if not pairs.isEmpty():
        two = [F.least("mine", "theirs").alias("low"), F.greatest("mine", "theirs").alias("high")]
        best = written(pairs.groupBy(*two).agg(F.max(F.struct("n", "node", "grp")).alias("b")).select("b.node", "b.grp"), "best")
        label = pairs.select("node", "grp", "mine", "theirs")

        def by_component(found: DataFrame, named: DataFrame) -> DataFrame:
            return found.select(F.col("a").alias("node"), F.col("b").alias("grp")).join(named, ["node", "grp"]).select(F.col("mine").alias("a"), F.col("theirs").alias("b"))

        links.append(by_component(confirmed(best, texts, lengths, width, percent), label))
        steps.append(connected(functools.reduce(DataFrame.unionByName, links)))
        links = []
        apart = relabelled(relabelled(label.distinct().join(best, ["node", "grp"], "left_anti"), "mine", steps[-1]), "theirs", steps[-1]).where("mine <> theirs")
        apart = written(apart, "apart")
        if not apart.isEmpty():
            links.append(by_component(confirmed(apart.select("node", "grp"), texts, lengths, width, percent), apart))
    if links:
        steps.append(connected(functools.reduce(DataFrame.unionByName, links)))

    named = heads.select("set_key", "first", F.col("node").alias("component"))
    for step in steps:
        named = relabelled(named, "component", step)
    named = written(named, "components")
    least_ids = written(named.groupBy("component").agg(F.min("first").alias("component_id")), "least-ids")
    named = named.join(least_ids, "component").select("set_key", "component", "component_id")
    out = signed.select("own", "doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    out = out.select("own", "doc_id", "n_shingles", "component", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` by 3-word shingles and a similarity of 0.85."""
    return near_components(read_documents(spark, sf_dir), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")
