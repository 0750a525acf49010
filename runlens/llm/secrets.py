"""Secret scans through a trigram inverted index.

From each rule's regular expression follows a Boolean query over trigrams: what
every match must hold.  One pass over the texts lists, for every text, which of
the trigrams that some query names it has; Spark turns this into postings by
block of texts and trigram.  Queries are answered by intersecting and uniting
postings, and only the texts found so are read again and searched for the rule.
A rule whose query holds everywhere has nothing to look up: it is searched for
in every text, in the first pass.
"""

from __future__ import annotations

import functools
import re
import re._constants as op
import re._parser as parser
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.membership import may_be_in
from .common import map_batches, read_documents, row_key, ship_package, slices, written
from .tokens import text_bytes


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` (ASCII rules) whose first group, or the whole, has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    any_case: bool = False

    @property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of each match, leftmost first, in code points."""
        for m in self.compiled.finditer(text):
            found = m.group(1) if m.re.groups else m.group()
            if len(found) >= self.least:
                yield m.span()


#: The first three are the base kinds; for the second and third, a least number inside the pattern gives the maximal runs of at least that length, as a later check would.
BASE = 3
RULES = (
    Rule("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{30,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("key_block", r"-----BEGIN (?:[A-Z]{1,12} ){0,2}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{6,1000}\.eyJ[A-Za-z0-9_-]{6,1000}\.[A-Za-z0-9_-]{6,1000}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{30,}"),
    Rule("pay", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("login", r"://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/@]{6,64}@"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}", 0, True),
)

#: Alternatives that a query lists; where there would be more, it asks for less.
MOST = 16
#: Bytes that trigrams are looked for in at once.
WINDOW = 1 << 22
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))

#: A query: True (every text), a trigram as bytes, or ("and" | "or", frozenset of queries).
Query = bool | bytes | tuple[str, frozenset]


def both(queries: Iterable[Query]) -> Query:
    """All of the queries."""
    parts: set = set()
    for q in queries:
        if q is not True:
            parts |= q[1] if isinstance(q, tuple) and q[0] == "and" else {q}
    return True if not parts else parts.pop() if len(parts) == 1 else ("and", frozenset(parts))


def either(queries: Iterable[Query]) -> Query:
    """At least one of the queries."""
    parts: set = set()
    for q in queries:
        if q is True:
            return True
        parts |= q[1] if isinstance(q, tuple) and q[0] == "or" else {q}
    return parts.pop() if len(parts) == 1 else ("or", frozenset(parts))


def holds_one_of(strings: set[bytes]) -> Query:
    """What a text has that holds one of these strings."""
    return either(both(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


class Reader:
    """Reads a parsed expression from left to right.

    ``ends`` are the strings of which one stands right before the place read
    to; what is sure before them is in ``sure``.
    """

    def __init__(self) -> None:
        self.sure: list[Query] = []
        self.ends: set[bytes] = {b""}

    def cut(self) -> None:
        """From here on nothing is known of what stands before."""
        self.sure.append(holds_one_of(self.ends))
        self.ends = {b""}

    def add(self, strings: set[bytes]) -> None:
        """One of these strings comes next."""
        if len(self.ends) * len(strings) > MOST:
            ends = {s[-2:] for s in self.ends}
            self.cut()
            if len(ends) * len(strings) <= MOST:
                self.ends = ends
            elif len(strings) > MOST:
                return
        self.ends = {a + b for a in self.ends for b in strings}

    def read(self, items: Iterable) -> None:
        for kind, value in items:
            if kind is op.LITERAL:
                self.add({folded(value)})
            elif kind is op.IN and (members := listed(value)):
                self.add(members)
            elif kind is op.SUBPATTERN:
                self.read(value[-1])
            elif kind is op.BRANCH:
                self.branch(value[1])
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
                self.repeat(*value)
            elif kind is op.ATOMIC_GROUP:
                self.read(value)
            elif kind not in (op.AT, op.ASSERT, op.ASSERT_NOT):  # those stand between characters
                self.cut()

    def branch(self, ways: list) -> None:
        read = [whole(w) for w in ways]
        if all(r.sure == [] for r in read) and sum(len(r.ends) for r in read) <= MOST:
            self.add(set().union(*(r.ends for r in read)))
            return
        self.cut()
        self.sure.append(either(r.query() for r in read))

    def repeat(self, least: int, most: int, items: Iterable) -> None:
        one = whole(items)
        if least == 0:
            if most == 1 and one.sure == [] and len(one.ends) < MOST:
                self.add(one.ends | {b""})
            else:
                self.cut()
            return
        for _ in range(min(least, 3)):  # three times over give all trigrams inside and across
            self.read(items)
        if (least, most) != (1, 1) and not least == most <= 3:
            self.cut()
            self.ends = {s[-2:] for s in one.ends}

    def query(self) -> Query:
        return both([*self.sure, holds_one_of(self.ends)])


def whole(items: Iterable) -> Reader:
    out = Reader()
    out.read(items)
    return out


def folded(point: int) -> bytes:
    return chr(point).encode("utf-8", "surrogatepass").translate(_FOLD)


def listed(members: list) -> set[bytes] | None:
    """The strings of a small class of characters; None for others."""
    out: set[bytes] = set()
    for kind, value in members:
        if kind is op.LITERAL:
            out.add(folded(value))
        elif kind is op.RANGE and value[1] - value[0] < 256:
            out |= {folded(x) for x in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST else None


def trigram_query(rule: Rule) -> Query:
    """What every text with a match has, of its trigrams of UTF-8 bytes with A-Z lower-cased."""
    return whole(parser.parse(rule.pattern, re.ASCII)).query()


def trigrams_of(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


@functools.lru_cache(4)
def slot_table(trigrams: tuple[bytes, ...]) -> np.ndarray:
    """Trigram, as a number -> 1 + its place, 0 for others."""
    out = np.zeros(1 << 24, np.uint16)
    for i, t in enumerate(trigrams):
        out[int.from_bytes(t, "big")] = i + 1
    return out


def trigram_slots(offsets: np.ndarray, data: bytes, trigrams: tuple[bytes, ...]) -> list[np.ndarray]:
    """Places in ``trigrams`` of those that each text has."""
    table, found = slot_table(trigrams), [np.empty(0, np.int64)]
    buffer = np.frombuffer(data.translate(_FOLD), np.uint8)
    for a in range(0, len(buffer) - 2, WINDOW):
        b = buffer[a : a + WINDOW + 2].astype(np.int32)
        slots = table[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]
        hit = np.flatnonzero(slots)
        text = np.searchsorted(offsets, hit + a, "right") - 1
        inside = hit + a + 2 < offsets[text + 1]
        found.append(np.unique(text[inside] * 65536 + slots[hit[inside]] - 1))
    all_found = np.unique(np.concatenate(found))
    cuts = np.searchsorted(all_found, np.arange(len(offsets)) * 65536)
    return [all_found[a:b] % 65536 for a, b in zip(cuts, cuts[1:], strict=False)]


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))


def spans_in(text: str | None, rules: list[tuple[int, Rule]]) -> list[dict]:
    return [{"start": a, "kind": k, "end": b} for k, rule in rules for a, b in rule.spans(text or "")]


def scanned(rows: DataFrame, rules: tuple[Rule, ...], queries: list[Query], trigrams: tuple[bytes, ...]) -> DataFrame:
    """The first pass: (doc_id, key, block, at, trigrams, spans) of every row (doc_id, key, text), written.

    ``at`` numbers the texts of a block, which is a part of an Arrow batch;
    ``spans`` are those of the rules that have no trigrams to look up.
    """
    everywhere = [(i, r) for i, (r, q) in enumerate(zip(rules, queries, strict=True)) if q is True]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in source:
            for part in slices(batch, "text"):
                text = part.column("text")
                lists = trigram_slots(*text_bytes(text), trigrams)
                sizes = np.append(0, np.cumsum([len(x) for x in lists]))
                slots = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *lists]), pa.int32()))
                spans = pa.array([spans_in(t, everywhere) for t in text.to_pylist()], SPAN)
                n = len(part)
                columns = [part.column("doc_id"), part.column("key"), pa.array(np.full(n, block)), pa.array(np.arange(n), pa.int32()), slots, spans]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "block", "at", "trigrams", "spans"])
                block += 1

    schema = "doc_id long, key binary, block long, at int, trigrams array<int>, spans array<struct<start:long,kind:int,end:long>>"
    return written(map_batches(rows.select("doc_id", "key", "text"), batches, schema), "scanned")


def inverted_index(texts: DataFrame) -> DataFrame:
    """(block, trigram, posting): the texts, by number, of each block that have the trigram.

    Postings are cut by block, so that a trigram which all texts have gives many short ones.
    """
    return texts.select("block", "at", F.explode("trigrams").alias("trigram")).groupBy("block", "trigram").agg(F.collect_list("at").alias("posting"))


def answered(query: Query, posting: dict[bytes, Column]) -> Column:
    """The posting of a query: intersections and unions of those of its trigrams."""
    if isinstance(query, bytes):
        return posting[query]
    combine = F.array_intersect if query[0] == "and" else F.array_union
    return reduce(combine, [answered(q, posting) for q in sorted(query[1], key=repr)])


def candidates(index: DataFrame, queries: list[Query], trigrams: tuple[bytes, ...]) -> DataFrame:
    """(block, at, rules): texts that meet the query of a rule, with the bits of those rules."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "posting"))).alias("lists"))
    posting = {t: F.coalesce(F.col("lists")[i], F.array().cast("array<int>")) for i, t in enumerate(trigrams)}
    each = [F.struct(F.lit(1 << i).alias("rule"), answered(q, posting).alias("at")) for i, q in enumerate(queries) if q is not True]
    found = lists.select("block", F.inline(F.array(*each))) if each else lists.select("block", F.lit(0).alias("rule"), F.array().cast("array<int>").alias("at"))
    return found.select("block", "rule", F.explode("at").alias("at")).groupBy("block", "at").agg(F.bit_or(F.col("rule").cast("long")).alias("rules"))


def verified(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, spans) of the rows (key, rules, text): what those rules find."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in slices(batch, "text"):
                asked = [[(i, r) for i, r in enumerate(rules) if bits >> i & 1] for bits in part.column("rules").to_pylist()]
                spans = [spans_in(t, own) for t, own in zip(part.column("text").to_pylist(), asked, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(spans, SPAN)], ["key", "more"])

    return map_batches(rows.select("key", "rules", "text"), batches, "key binary, more array<struct<start:long,kind:int,end:long>>")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) of every row: spans of all rules as (start, kind, end), in that order; ``kind`` is the rule's number.

    Offsets are code points, ends exclusive; matches of one rule do not
    overlap, those of several may.  Null and empty texts have no spans.  Each
    row is judged by its own text, also where ids repeat or are null; other
    columns are not read; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    queries = [trigram_query(r) for r in rules]
    trigrams = tuple(sorted(set().union(*map(trigrams_of, queries))))
    key = row_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).withColumn("key", key)
    texts = scanned(rows, rules, queries, trigrams)
    index = written(inverted_index(texts), "trigram-index")
    found = candidates(index, queries, trigrams).join(texts.select("block", "at", "key"), ["block", "at"])
    found = written(found.groupBy("key").agg(F.max("rules").alias("rules")), "candidates")  # rows that are alike share their rules
    # texts that are no candidates leave before the join's shuffle
    asked = may_be_in(rows.select("key", "text"), "key", found, found.count()).join(found, "key").dropDuplicates(["key"])
    more = verified(asked, rules)
    out = texts.select("doc_id", "key", "spans").join(more, "key", "left")
    return out.select("doc_id", F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast("array<struct<start:long,kind:int,end:long>>")))).alias("spans"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    written_out = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    counted = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return secret_spans(read_documents(spark, sf_dir)).select(
        "doc_id",
        *[counted(k).alias(f"n_{RULES[k].kind}") for k in range(BASE)],
        F.sha2(written_out(F.filter("spans", lambda s: s["kind"] < BASE)).cast("binary"), 256).alias("base_sha256"),
        written_out(F.col("spans")).alias("spans"),
    )
