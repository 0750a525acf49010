"""BPE encoding by backtracking, and decoding by an offset table.

A word is covered left to right with the longest tokens (an Aho-Corasick
automaton gives them).  A cover equals the result of the merges exactly when
every two neighbouring tokens are compatible: merging their joined symbols
gives the same two tokens back.  Where a pair is not, the encoder tries the
next shorter token, and goes back a token when none is left; a position found
dead is never tried again, so the work stays linear in the word.

Vocabulary, merges, special tokens and the pattern of pre-tokens are read from
the vocabulary file; its normalisation (NFC, lower case) and its end of word
are fixed here.  No tokenizer library runs.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, read_documents, ship_package, slices

#: Added to the code point of a word's last symbol: it then stands for symbol + "</w>".
END = 0x2000
SUFFIX = "</w>"
#: A rank after all merges.
NEVER = 1 << 40
#: Words and pairs remembered by a worker.
REMEMBERED = 100_000
#: Symbols of a long word that the automaton reads at once, at first and at most; the first is more than twice the longest token.
REACH, MOST_REACH = 256, 1 << 16


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def marked(token: str) -> str:
    """A vocabulary entry with its end of word, if any, folded into the last symbol."""
    if token.endswith(SUFFIX) and len(token) > len(SUFFIX):
        body = token[: -len(SUFFIX)]
        return body[:-1] + chr(ord(body[-1]) + END)
    return token


class Vocabulary:
    """Tokens, merges, automaton and offset table of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pre_token = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split") + "|\n")
        pairs = (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])
        self.rank = {(marked(a), marked(b)): i for i, (a, b) in enumerate(pairs)}
        everything = {marked(t): i for t, i in model["vocab"].items() if t not in self.special}
        #: token -> its last (first) parts at all depths, each with the rank of the merge that ends it
        self.lasts = {t: [(t, NEVER)] for t in everything if len(t) == 1}
        self.firsts = dict(self.lasts)
        for (a, b), rank in self.rank.items():  # in order: parts come before what they make
            t = a + b
            if t not in self.lasts and t in everything and a in self.lasts and b in self.lasts and self.meet(a, b) == rank:
                self.lasts[t] = [(t, NEVER), (b, rank), *self.lasts[b][1:]]
                self.firsts[t] = [(t, NEVER), (a, rank), *self.firsts[a][1:]]
        self.ids = {t: everything[t] for t in self.lasts}
        self.id_bytes = {t: i.to_bytes(4, "little") for t, i in self.ids.items()}
        #: token -> the longest token that is a shorter beginning of it
        self.shorter = {t: next((t[:n] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), None) for t in self.ids}
        self.longest = max(map(len, self.ids))
        assert 2 * self.longest < REACH, "a vocabulary of longer tokens needs a larger REACH"
        self.automaton = ahocorasick.Automaton()
        for t in self.ids:
            self.automaton.add_word(t, t)
        self.automaton.make_automaton()
        #: Pair compatibility as far as it was asked for: token -> tokens that may follow; pairs that may not.
        self.follow: dict[str, set[str]] = defaultdict(set)
        self.apart: set[tuple[str, str]] = set()
        self.pairs = 0
        self.symbols = {b: s for b, s in enumerate(byte_symbols())}
        self.ends = {s: chr(ord(s) + END) for s in self.symbols.values()}
        #: Pre-tokens met so far; a line end has no ids.
        self.pre_tokens = {"\n": b""} | {t: i.to_bytes(4, "little") for t, i in self.special.items()}
        by_id = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        texts = [by_id.get(i, "").encode() for i in range(max(by_id) + 1)]
        #: Token i's text is text[offsets[i]:offsets[i + 1]].
        self.text, self.offsets = b"".join(texts), np.cumsum([0, *map(len, texts)])
        self.pieces = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(self.offsets.astype("<i4")), pa.py_buffer(self.text)])
        self.decimals = pa.array([str(i).encode() for i in range(len(texts))], pa.binary())

    def merge(self, symbols: str) -> list[str]:
        """The merges applied one by one, lowest rank first: the definition that the encoder must meet."""
        parts = list(symbols)
        while len(parts) > 1:
            ranks = [self.rank.get(p, len(self.rank)) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == len(self.rank):
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def meet(self, a: str, b: str) -> int:
        """Rank of the first merge across the border of two neighbouring tokens; NEVER if there is none.

        Merges come in the order of their ranks, so a part of a token is there
        until the merge that ends it, and a merge across the border takes place
        where both its parts are still there; of equal ranks, the left goes first.
        """
        get = self.rank.get
        found = [r for x, end in self.lasts[a] for y, stop in self.firsts[b] if (r := get((x, y))) is not None and r < end and r <= stop]
        return min(found, default=NEVER)

    def fits(self, a: str, b: str) -> bool:
        """Whether token b may follow token a inside a word."""
        if b in self.follow[a]:
            return True
        if (a, b) in self.apart:
            return False
        fit = self.meet(a, b) == NEVER
        if self.pairs < 2 * REMEMBERED:
            self.pairs += 1
            self.follow[a].add(b) if fit else self.apart.add((a, b))
        return fit

    def longest_from(self, word: str, at: int) -> Iterator[tuple[int, str]]:
        """The longest tokens from a place on, each where the one before ends.

        The automaton copies what it reads, so a long word is read in pieces
        that grow while no token is turned down; at a piece's end, tokens that
        might go on beyond it are looked for again.
        """
        size = REACH
        while at < len(word):
            piece = word[at : at + size]
            last = at + len(piece) == len(word)
            for end, t in self.automaton.iter_long(piece):
                if not last and end >= len(piece) - self.longest:
                    at += end + 1 - len(t)
                    break
                yield end, t
            else:
                return
            size = min(2 * size, MOST_REACH)

    def cover(self, word: str) -> list[str]:
        """Tokens of one pre-token, given as symbols with a marked end."""
        follow, shorter = self.follow, self.shorter
        tokens: list[str] = []
        ends = [0]  # where each token ends, after the word's beginning
        before, dead = "", set()
        matches = self.automaton.iter_long(word) if len(word) <= REACH else self.longest_from(word, 0)
        while True:
            for _, t in matches:  # the longest token at the end of those before
                at = ends[-1] + len(t)
                if at in dead or before and t not in follow[before] and not self.fits(before, t):
                    break
                tokens.append(t)
                ends.append(at)
                before = t
            else:
                return tokens
            while True:
                t = shorter.get(t)
                if t is None:  # no token is left here: shorten the one before
                    dead.add(ends.pop())
                    t = tokens.pop()
                    before = tokens[-1] if tokens else ""
                elif ends[-1] + len(t) not in dead and (not before or self.fits(before, t)):
                    break
            tokens.append(t)
            ends.append(ends[-1] + len(t))
            before = t
            matches = self.automaton.iter_long(word, ends[-1]) if len(word) <= REACH else self.longest_from(word, ends[-1])

    def pre_token_ids(self, piece: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a pre-token."""
        symbols = piece if piece.isascii() and piece.isprintable() else "".join(map(self.symbols.__getitem__, piece.encode()))
        found = b"".join(map(self.id_bytes.__getitem__, self.cover(symbols[:-1] + self.ends[symbols[-1]])))
        if len(self.pre_tokens) < REMEMBERED and len(piece) <= REACH:
            self.pre_tokens[piece] = found
        return found

    def lines(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each line) of lines of text."""
        pieces = []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                pieces.append(part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            pieces += self.pre_token.findall(part.lower())
        coded = list(map(self.pre_tokens.get, pieces))
        if None in coded:
            coded = [self.pre_token_ids(t) if x is None else x for t, x in zip(pieces, coded, strict=True)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        # a line end is a piece of no ids, as nothing else is
        ends = np.append(np.cumsum(sizes)[sizes == 0], sizes.sum())
        return np.frombuffer(b"".join(coded), "<u4"), np.diff(ends, prepend=0)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of whole texts: ids[offsets[i]:offsets[i + 1]] are those of text i; a null text is empty.

        No rule reaches across white space, so each distinct word is encoded
        once and its ids are gathered by index.
        """
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = split.flatten().dictionary_encode()
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar("\n", pa.large_string()))
        values, sizes = self.lines(joined[0].as_py())
        starts = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        place = np.repeat(starts[at] - ends + n, n)
        place += np.arange(len(place))
        return np.append(0, ends)[split.offsets.to_numpy() - split.offsets[0].as_py()], values[place]

    def encode(self, text: str) -> np.ndarray:
        """Ids of one whole text."""
        return self.encode_all(pa.array([text], pa.string()))[1]

    def decode_all(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """UTF-8 of each sequence: its tokens' texts, cut out by the offset table, one space between."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.pieces.take(pa.array(ids))), b" ")

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of one sequence."""
        return self.decode_all(np.array([0, len(ids)]), np.asarray(ids, np.uint32))[0].as_py()


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every text.  Null and empty texts: no ids.  Repeated rows stay."""
    ship_package(df.sparkSession)
    path = path or default_path()

    def batches(source):
        v = vocabulary(path)
        for batch in source:
            for part in slices(batch, "text"):
                offsets, ids = v.encode_all(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "ids"])

    kind = dict(df.dtypes)[id_col]
    return map_batches(df.select(df[id_col].alias("id"), df[text_col].alias("text")), batches, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text) of every id sequence; null or no ids: the empty text.  An unknown id fails the job."""
    ship_package(df.sparkSession)
    path = path or default_path()

    def batches(source):
        v = vocabulary(path)
        for batch in source:
            lists = pc.fill_null(batch.column("ids"), [])
            texts = v.decode_all(lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(), lists.flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("id"), texts.cast(pa.string())], ["id", "text"])

    kind = dict(df.dtypes)[id_col]
    return map_batches(df.select(df[id_col].alias("id"), df[ids_col].alias("ids")), batches, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digests(values: pa.Array) -> pa.Array:
    """SHA-256 of each binary value, in lowercase hex."""
    return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in values], pa.string())


def op7_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of the ids of every text and of the text decoded from them.

    Encoder and decoder are those of bpe_encode and bpe_decode, in one pass:
    the ids, larger than the texts, are not moved between processes.
    """
    ship_package(spark)
    path = path or default_path()

    def batches(source):
        v = vocabulary(path)
        for batch in source:
            for part in slices(batch, "text"):
                offsets, ids = v.encode_all(part.column("text"))
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), v.decimals.take(pa.array(ids)))
                of_ids, of_text = digests(pc.binary_join(listed, b" ")), digests(v.decode_all(offsets, ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), of_ids, of_text], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(read_documents(spark, sf_dir).select("doc_id", "text"), batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
