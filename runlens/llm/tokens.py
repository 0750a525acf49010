"""Words of whole slices of texts at once, and CRC-32 of joined strings by its algebra.

Texts are made blank outside their words, byte for byte, so that one split of
the slice gives all words; distinct words are looked at once and the rest is
gathered by index.  CRC-32 is linear: the value of A + B follows from those of
A and B and the length of B, so n-grams and keyed words are never put together.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Lengths below this have a table of their own.
SHORT = 64
POLYNOMIAL = 0xEDB88320


@functools.lru_cache(1)
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables of what so many zero bytes make of each byte of a value: one for every short length, one for each power of two from SHORT on."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1)
    now = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    short = []
    for _ in range(SHORT):
        short.append(now)
        now = (now >> np.uint32(8)) ^ step[now & 255]
    powers = [now]
    for _ in range(40):
        powers.append(_apply(powers[-1], powers[-1], np.int64(0)))
    return np.concatenate(short), powers


def _apply(table: np.ndarray, crcs: np.ndarray, base: np.ndarray | np.int64) -> np.ndarray:
    """Values taken through the table that begins at ``base``."""
    out = table[base + (crcs & 255)]
    for k in (1, 2, 3):
        out = out ^ table[base + 256 * k + ((crcs >> np.uint32(8 * k)) & 255)]
    return out


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What the values become with so many bytes behind; XOR with those bytes' own value is the value of both together."""
    short, powers = _tables()
    out = _apply(short, crcs, (lengths % SHORT).astype(np.int64) * 1024)
    rest, k = lengths // SHORT, 0
    while rest.any():
        at = np.flatnonzero(rest & 1)
        out[at] = _apply(powers[k], out[at], np.int64(0))
        rest, k = rest >> 1, k + 1
    return out


def crcs_of(values: list[bytes]) -> np.ndarray:
    """CRC-32 of each value."""
    return np.fromiter(map(zlib.crc32, values), np.uint32, len(values))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    """(offsets, UTF-8) of all texts in one piece; nulls are empty."""
    plain = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1] if len(plain) else np.zeros(1, np.int64)
    data = plain.buffers()[2]
    return offsets - offsets[0], data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data is not None else b""


class Words:
    """Words of all texts of a slice: word ``at[i]`` of ``distinct`` for i in ``offsets[d]:offsets[d + 1]`` of text d."""

    def __init__(self, offsets: np.ndarray, blanked: bytes):
        """``blanked``: the texts' UTF-8 with each byte that is in no word a space."""
        texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(blanked)])
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten()
        real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        self.offsets = np.append(0, np.cumsum(real))[split.offsets.to_numpy()]
        coded = flat.filter(pa.array(real)).dictionary_encode()
        self.at = coded.indices.to_numpy()
        self.distinct: list[bytes] = coded.dictionary.cast(pa.large_binary()).to_pylist()
        self.sizes = np.fromiter(map(len, self.distinct), np.int64, len(self.distinct))

    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
