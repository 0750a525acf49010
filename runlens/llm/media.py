"""Media columns: ISO base media containers, stored and walked without decoding.

``wrap`` puts a payload of 8-bit samples into a minimal container
(ftyp, moov/trak/mdia/minf/stbl, mdat); ``walk`` yields the boxes of any such
file with their nesting; ``describe`` decodes the sample tables of every track,
and the runs of its fragments, into codec, duration, sample and keyframe byte
ranges.  Payload bytes are only ever sliced by the ranges that the tables give.

Bytes may be cut, foreign or crafted: whatever a table says, what is listed is
bounded by the bytes that are there, and no more ranges are listed than lie
inside them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import column_bytes, map_batches, read_documents, ship_package

#: Bytes in one sample unit; payloads are padded with spaces to a multiple.
UNIT = 192
#: Every so manieth sample is marked as a sync sample (keyframe).
KEY_EVERY = 16
#: Samples in one chunk.
CHUNK = 64
#: Ticks per second of the media time scale, one tick a sample.
TIMESCALE = 8000
#: Boxes of the format that hold other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: Boxes inside more boxes than these are not opened; the format's own nesting is below ten.
MAX_DEPTH = 32
#: Offsets from here on lie in no file.
NOWHERE = 1 << 61
#: Unity matrix of the format's headers.
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    """One box; a 64-bit size is used where 32 bits do not hold it."""
    body = b"".join(parts)
    size = len(body) + 8
    if size >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, size + 8) + body
    return struct.pack(">I4s", size, kind) + body


def full_box(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def pad(payload: bytes, unit: int = UNIT) -> bytes:
    """Spaces (byte 32) are appended up to a positive multiple of ``unit``."""
    return payload.ljust(max(1, -(-len(payload) // unit)) * unit, b" ")


def wrap(payload: bytes, unit: int = UNIT, codec: bytes = b"raw ") -> bytes:
    """A container with one track whose samples are ``unit`` payload bytes each."""
    n = len(payload) // unit
    chunks = -(-n // CHUNK)
    file_type = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    entry = box(codec, bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, TIMESCALE << 16 & 0xFFFFFFFF))
    last = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] if last == CHUNK else [(1, CHUNK, 1), (chunks, last, 1)] if chunks > 1 else [(1, last, 1)]

    def movie(first: int) -> bytes:
        """The tables, with the first chunk at byte ``first``."""
        offsets = (np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK * unit) + np.uint64(first)).astype(">u8")
        table = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, n, 1)),
            full_box(b"stss", struct.pack(">I", len(range(0, n, KEY_EVERY))), np.arange(1, n + 1, KEY_EVERY, dtype=">u4").tobytes()),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">II", unit, n)),
            full_box(b"co64", struct.pack(">I", chunks), offsets.tobytes()),
        )
        media = box(
            b"mdia",
            full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)),
            full_box(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
            box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), table),
        )
        track = full_box(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0x100, 0), MATRIX, bytes(8), flags=7)
        head = full_box(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, n, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", head, box(b"trak", track, media))

    header = 16 if len(payload) + 8 >= 1 << 32 else 8
    tables = movie(len(file_type) + len(movie(0)) + header)
    return b"".join((file_type, tables, box(b"mdat", payload)))


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """(path, start, body start, body end) of every box, parents first.

    A box whose size does not fit its parent ends the walk of that parent, so
    cut or foreign bytes give the boxes before them and never an error.
    """
    open_boxes: list[tuple[tuple[bytes, ...], int, int]] = [((), 0, len(data))]
    while open_boxes:
        path, start, end = open_boxes.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            continue
        open_boxes.append((path, start + size, end))
        own = (*path, kind)
        yield own, start, body, start + size
        if kind in CONTAINERS and len(own) < MAX_DEPTH:
            open_boxes.append((own, body, start + size))


def numbers(data: bytes, at: int, n: int, end: int, kind: str = ">u4") -> np.ndarray:
    """``n`` table entries, or as many as the box holds."""
    width = np.dtype(kind).itemsize
    found = np.frombuffer(data, kind, max(0, min(n, (end - at) // width)), at)
    return np.minimum(found, np.uint64(NOWHERE)).astype(np.int64) if width == 8 else found.astype(np.int64)


def _none() -> np.ndarray:
    return np.empty(0, np.int64)


@dataclass
class Track:
    """What the tables say of a track; ``starts`` and ``sizes`` are those of the samples inside the file, ``keys`` their keyframes' places."""

    number: int = 0
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    first_time: int = 0
    n_samples: int = 0
    starts: np.ndarray = field(default_factory=_none)
    sizes: np.ndarray = field(default_factory=_none)
    keys: np.ndarray = field(default_factory=_none)


def sample_sizes(kind: bytes, data: bytes, at: int, end: int) -> tuple[int, int, np.ndarray]:
    """(number of samples, size of each if they are alike, else 0 and the sizes) of stsz or stz2."""
    fixed, n = struct.unpack_from(">II", data, at + 4)
    if kind == b"stsz":
        return n, fixed, _none() if fixed else numbers(data, at + 12, n, end)
    bits = fixed & 0xFF
    if bits == 4:
        halves = numbers(data, at + 12, (n + 1) // 2, end, ">u1")
        return n, 0, np.stack([halves >> 4, halves & 15], 1).ravel()[:n]
    return n, 0, numbers(data, at + 12, n, end, ">u2" if bits == 16 else ">u1") if bits in (8, 16) else _none()


def placed(tables: dict, limit: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(number of samples, starts, sizes, keyframe marks) by the chunk tables; samples have no more than ``limit`` bytes in all."""
    n, fixed, sizes = tables.get("sizes", (0, 0, _none()))
    sizes = np.full(min(n, limit // fixed), fixed, np.int64) if fixed else sizes
    chunks, runs = tables.get("chunks", _none()), tables.get("runs", np.empty((0, 3), np.int64))
    first = np.maximum.accumulate(np.clip(runs[:, 0] - 1, 0, len(chunks))) if len(runs) else _none()
    per = np.repeat(np.minimum(runs[:, 1], len(sizes)), np.diff(np.append(first, len(chunks))))
    per = np.diff(np.minimum(np.cumsum(per), len(sizes)), prepend=0)
    held = np.repeat(np.arange(len(per)), per)
    chunks = chunks[len(chunks) - len(per) :]
    sizes = sizes[: len(held)]
    before = np.cumsum(sizes) - sizes
    starts = chunks[held] + before - before[np.searchsorted(held, held)] if len(held) else _none()
    key = np.ones(len(sizes), bool)
    if "keys" in tables:
        keys = tables["keys"]
        key[:] = False
        key[keys[(keys >= 0) & (keys < len(key))]] = True
    return n, starts, sizes, key


def run_of(data: bytes, at: int, end: int, defaults: tuple[int, int, int], base: int, after: int) -> tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(number of samples, duration, end of data, starts, sizes, keyframe marks) of one trun box.

    ``defaults`` are a sample's duration, size and flags; ``after`` is where the run before ended.
    """
    flags, n = struct.unpack_from(">II", data, at)
    flags &= 0xFFFFFF
    at += 8
    start = after
    if flags & 0x1 and at + 4 <= end:
        start = base + struct.unpack_from(">i", data, at)[0]
        at += 4
    first = None
    if flags & 0x4 and at + 4 <= end:
        first = struct.unpack_from(">I", data, at)[0]
        at += 4
    fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
    if fields:
        n = min(n, max(0, end - at) // (4 * len(fields)))
        table = dict(zip(fields, numbers(data, at, n * len(fields), end).reshape(n, len(fields)).T, strict=True))
    else:
        table = {}
    length, size, of_sample = defaults
    total = int(table[0x100].sum()) if 0x100 in table else n * length
    sizes = table.get(0x200)
    if sizes is None:
        sizes, stop = np.full(min(n, len(data) // size) if size else 0, size, np.int64), start + n * size
    else:
        stop = start + int(sizes.sum())
    marks = table[0x400][: len(sizes)] if 0x400 in table else np.full(len(sizes), of_sample, np.int64)
    if first is not None and len(marks):
        marks = np.append(first, marks[1:])
    starts = min(max(start, -NOWHERE), NOWHERE) + np.cumsum(sizes) - sizes
    return n, total, stop, starts, sizes, marks & 0x10000 == 0  # the bit says: not a sync sample


def describe(data: bytes) -> list[Track]:
    """The tracks of a file, in order.

    Sizes and offsets come from stsz/stz2, stsc and stco/co64, durations from
    mdhd or else stts, keyframes from stss (absent: every sample is one), the
    first time shown from the edit list; fragments (moof) add the samples of
    their runs, with the defaults of tfhd and trex.  ``n_samples`` and
    ``duration`` are the tables' own, also where media lies outside the file.
    """
    tracks: list[Track] = []
    tables: list[dict] = []
    by_number: dict[int, int] = {}
    trex: dict[int, tuple[int, int, int]] = {}
    runs: dict[int, list[tuple]] = {}
    moof = base = after = 0
    current, defaults = -1, (0, 0, 0)
    for path, start, at, end in walk(data):
        kind, room = path[-1], end - at
        if kind == b"trak":
            tracks.append(Track())
            tables.append({})
        elif kind == b"moof":
            moof = after = start
            current = -1
        elif kind == b"trex" and room >= 24:
            number, _, *rest = struct.unpack_from(">5I", data, at + 4)
            trex[number] = tuple(rest)
        elif kind == b"traf":
            current = -1
        elif kind == b"tfhd" and b"traf" in path and room >= 8:
            flags, number = struct.unpack_from(">II", data, at)
            if number not in by_number:
                by_number[number] = len(tracks)
                tracks.append(Track(number))
                tables.append({})
            current, at = by_number[number], at + 8
            base = moof if flags & 0x20000 else after
            if flags & 0x1 and at + 8 <= end:
                base = min(struct.unpack_from(">Q", data, at)[0], NOWHERE)
                at += 8
            at += 4 * bool(flags & 0x2)
            own = list(trex.get(number, (0, 0, 0)))
            for j, bit in enumerate((0x8, 0x10, 0x20)):
                if flags & bit and at + 4 <= end:
                    own[j] = struct.unpack_from(">I", data, at)[0]
                    at += 4
            defaults, after = tuple(own), base
        elif kind == b"trun" and b"traf" in path and room >= 8 and current >= 0:
            n, total, after, *found = run_of(data, at, end, defaults, base, after)
            tracks[current].n_samples += n
            tables[current]["run_time"] = tables[current].get("run_time", 0) + total
            runs.setdefault(current, []).append(found)
        if not tracks or b"trak" not in path or room < 8:
            continue
        track, table = tracks[-1], tables[-1]
        count = struct.unpack_from(">I", data, at + 4)[0]
        if kind == b"tkhd" and room >= 24:
            track.number = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
            by_number.setdefault(track.number, len(tracks) - 1)
        elif kind == b"mdhd":
            wide = data[at] == 1
            if room >= (32 if wide else 20):
                track.timescale, track.duration = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
                track.duration = 0 if track.duration in (0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF) else min(track.duration, NOWHERE)  # all ones: not known
        elif kind == b"stsd" and room >= 16:
            track.codec = data[at + 12 : at + 16].decode("latin-1").strip()
        elif kind == b"stts":
            entries = numbers(data, at + 8, 2 * count, end)
            table["time"] = sum(a * b for a, b in zip(entries[::2].tolist(), entries[1::2].tolist(), strict=False))
        elif kind == b"elst":
            wide = data[at] == 1
            entries = np.frombuffer(data, ">i8, >i8, >i4" if wide else ">i4, >i4, >i4", min(count, (room - 8) // (20 if wide else 12)), at + 8)
            track.first_time = next((int(t) for t in entries["f1"] if t >= 0), 0)
        elif kind in (b"stsz", b"stz2") and room >= 12:
            table["sizes"] = sample_sizes(kind, data, at, end)
        elif kind in (b"stco", b"co64"):
            table["chunks"] = numbers(data, at + 8, count, end, ">u4" if kind == b"stco" else ">u8")
        elif kind == b"stsc":
            entries = numbers(data, at + 8, 3 * count, end)
            table["runs"] = entries[: len(entries) // 3 * 3].reshape(-1, 3)
        elif kind == b"stss":
            table["keys"] = numbers(data, at + 8, count, end) - 1
    for k, (track, table) in enumerate(zip(tracks, tables, strict=True)):
        n, *own = placed(table, len(data))
        track.n_samples += n
        track.duration = min(track.duration or table.get("time", 0) + table.get("run_time", 0), NOWHERE)
        starts, sizes, key = (np.concatenate(x) for x in zip(own, *runs.get(k, []), strict=True))
        inside = (starts >= 0) & (starts + sizes <= len(data))
        track.starts, track.sizes, track.keys = starts[inside], sizes[inside], np.flatnonzero(key[inside])
    return tracks


def payload_of(data: bytes, track: Track) -> bytes:
    """The bytes of a track's samples in order; neighbouring samples are read as one slice."""
    starts, sizes = track.starts, track.sizes
    if not len(starts):
        return b""
    cut = np.flatnonzero(np.append(True, starts[1:] != starts[:-1] + sizes[:-1]))
    ends = np.append(cut[1:], len(starts)) - 1
    return b"".join(data[a:b] for a, b in zip(starts[cut].tolist(), (starts[ends] + sizes[ends]).tolist(), strict=True))


FEATURES = "track int, track_number long, codec string, timescale long, duration long, first_time long, n_samples long, key_starts array<long>, key_sizes array<long>"
NO_TRACK = (None, None, None, None, None, None, 0, [], [])


def _features(data: bytes | None) -> list[tuple]:
    tracks = describe(data) if data else []
    return [(k, t.number, t.codec, t.timescale, t.duration, t.first_time, t.n_samples, t.starts[t.keys].tolist(), t.sizes[t.keys].tolist()) for k, t in enumerate(tracks)] or [NO_TRACK]


def media_columns(df: DataFrame, id_col: str = "doc_id", content_col: str = "media") -> DataFrame:
    """(id, track, track_number, codec, timescale, duration, first_time, n_samples, key_starts, key_sizes): one row a track.

    ``track`` counts from 0 in a file; ranges are those of keyframes inside the
    file.  Null, empty or foreign bytes and files without tracks: one row, all
    null, no samples and no ranges.  Repeated rows stay; null ids are as any
    other; other columns of ``df`` are not read; an empty table gives no rows.
    """
    ship_package(df.sparkSession)
    names = ["id", *(x.split()[0] for x in FEATURES.split(", "))]
    kinds = [pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 4, *[pa.list_(pa.int64())] * 2]

    def batches(source):
        for batch in source:
            found = [_features(x) for x in column_bytes(batch, "content")]
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
            columns = [list(x) for x in zip(*(row for rows in found for row in rows), strict=True)] or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    kind = dict(df.dtypes)[id_col]
    out = map_batches(df.select(df[id_col].alias("id"), df[content_col].alias("content")), batches, f"id {kind}, {FEATURES}")
    return out.withColumnRenamed("id", id_col)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a container: (doc_id, n_bytes, media).  Null text: empty."""
    ship_package(docs.sparkSession)

    def batches(source):
        for batch in source:
            texts = [x or b"" for x in column_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array((wrap(pad(x)) for x in texts), pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), batches, "doc_id long, n_bytes long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(n_bytes: int, data: bytes) -> tuple:
    track = describe(data)[0]
    payload, keys = payload_of(data, track), track.keys
    ranges = np.stack([track.starts[keys], track.sizes[keys]]).astype("<i8").tobytes()
    feature = f"codec={track.codec};timescale={track.timescale};duration={track.duration};samples={track.n_samples};keyframes={len(keys)};key_ranges_crc32={zlib.crc32(ranges)}"
    return (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as a container, read back and described."""
    stored = text_media(read_documents(spark, sf_dir))

    def batches(source):
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in source:
            rows = [_digest(n, x) for n, x in zip(batch.column("n_bytes").to_pylist(), column_bytes(batch, "media"), strict=True)]
            columns = [list(x) for x in zip(*rows, strict=True)] or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return map_batches(stored, batches, DIGEST)
