import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runlens.llm import bpe, chat, licences, media, ordinal, packing, rules

from .helpers import corpus, frame, words

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "a\x1cb\x1f", "<|endoftext|> x<|startoftext|>y <|end", "don't I'LL 'sun ΑΣ ΌΣΟΣ İstanbul é 가", "x᠎y​z\u0085q", "①²³ 12345 ½", "你好，世界！ 😀👍🏽", "A" * 3000, "!!??..--__ </w>", "\x00\x01 ﻿", "ſ K Å ﬁ ǅ", "à́b"]


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    texts = [t for _, t, _ in corpus() if t] + ODD
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    ids = bpe.bpe_encode(docs)
    got = {x.doc_id: list(x.ids) for x in ids.collect()}
    want = [library.encode(t, add_special_tokens=False).ids for t in texts] + [[]]
    assert got == dict(enumerate(want))
    back = {x.doc_id: x.text for x in bpe.bpe_decode(ids).collect()}
    assert back == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(want)}
    assert bpe.bpe_encode(docs.limit(0)).count() == 0


def test_pairs_fit_as_merges_say():
    v, r = bpe.vocabulary(PATH), random.Random(2)
    inner = [t for t in v.ids if ord(t[-1]) < bpe.END]
    for t in r.sample(list(v.ids), 2000):
        assert v.merge(t) == [t]
    for _ in range(4000):
        a, b = r.choice(inner), r.choice(list(v.ids))
        assert v.fits(a, b) == (v.merge(a + b) == [a, b])
    for _ in range(500):  # also where the longest tokens do not do
        w = "".join(r.choice("aehinorst") for _ in range(r.randint(1, 14)))
        w = w[:-1] + chr(ord(w[-1]) + bpe.END)
        assert v.cover(w) == v.merge(w)


def test_packing(spark):
    r = random.Random(3)
    for counts in ({}, {1: 5}, {2048: 7, 2047: 3}, collections.Counter(min(2048, int(r.lognormvariate(6, 1)) + 1) for _ in range(4000)), collections.Counter(r.randint(600, 1500) for _ in range(3000))):
        plan = packing.plan_packing(dict(counts))
        used = collections.Counter()
        for lengths, n in plan:
            assert sum(lengths) <= 2048
            for x in lengths:
                used[x] += n
        assert used == collections.Counter(counts)
    total = sum(k * n for k, n in {100: 50, 1948: 50}.items())
    assert sum(n for _, n in packing.plan_packing({100: 50, 1948: 50})) == total // 2048  # exact complements
    library = Tokenizer.from_file(PATH)
    rows = corpus()
    got = packing.best_fit_packing(frame(spark, rows), capacity=64).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for x in got:
        by_doc[x.doc_id].append(x)
        by_sequence[x.sequence_id].append((x.offset, x.length))
    for i, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda x: x.piece)
        assert [(x.piece, x.start, x.length, x.ids_crc32) for x in own] == [(k, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.best_fit_packing(frame(spark, rows).limit(0)).count() == 0


def test_media_round_trip(spark):
    rows = corpus()
    made = media.text_media(frame(spark, rows)).cache()
    parts = {x.doc_id: x for x in media.media_columns(made).collect()}
    texts = {i: t for i, t, _ in rows}
    for x in made.collect():
        text = (texts[x.doc_id] or "").encode()
        payload = text + b" " * (-len(text) % 192 or (192 if not text else 0))
        track = media.describe(x.media)[0]
        assert media.payload_of(x.media, track) == payload and x.n_bytes == len(text)
        p = parts[x.doc_id]
        assert p.codec == "raw" and p.n_samples == p.duration == len(payload) // 192 and p.track == 0 and p.track_number == 1
        for k, (a, n) in enumerate(zip(p.key_starts, p.key_sizes, strict=True)):
            assert bytes(x.media[a : a + n]) == payload[k * 16 * 192 :][:192]
    assert media.text_media(made.withColumn("text", F.lit("")).limit(0)).count() == 0
    broken = spark.createDataFrame([(1, None), (2, b""), (3, b"no box"), (4, bytes(media.wrap(b"x" * 192))[:300]), (None, b""), (1, None)], "doc_id long, media binary")
    got = media.media_columns(broken).collect()
    assert sorted(str(x.doc_id) for x in got) == ["1", "1", "2", "3", "4", "None"] and all(x.n_samples == 0 for x in got)
    assert media.media_columns(broken.limit(0)).count() == 0


def test_media_boxes():
    data = media.box(b"free", b"") + media.wrap(b"y" * 192 * 200)
    kinds = [p[-1] for p, *_ in media.walk(data)]
    assert kinds[:3] == [b"free", b"ftyp", b"moov"] and kinds[-1] == b"mdat" and b"stsz" in kinds
    track = media.describe(data)[0]
    assert track.n_samples == len(track.sizes) == 200 and len(track.keys) == 13


def track_box(number, codec, sizes, chunks, runs, keys=None, times=()):
    """A trak box from plain tables; ``sizes`` is (kind, body after version and flags)."""
    u = lambda *x: struct.pack(f">{len(x)}I", *x)
    tables = [media.full_box(b"stsd", u(1), media.box(codec, bytes(20))), media.full_box(sizes[0], sizes[1]), media.full_box(b"stsc", u(len(runs)), *(u(*r) for r in runs)), chunks]
    tables += [media.full_box(b"stss", u(len(keys)), u(*keys))] if keys is not None else []
    tables += [media.full_box(b"stts", u(len(times)), *(u(*t) for t in times))]
    head = media.full_box(b"mdhd", u(0, 0, 90000, 0, 0))
    edits = media.box(b"edts", media.full_box(b"elst", struct.pack(">I", 2), struct.pack(">iii", 10, -1, 65536), struct.pack(">iii", 10, 1234, 65536)))
    return media.box(b"trak", media.full_box(b"tkhd", u(0, 0, number, 0, 0)), edits, media.box(b"mdia", head, media.box(b"minf", media.box(b"stbl", *tables))))


def test_media_tracks_and_compact_sizes():
    u = lambda *x: struct.pack(f">{len(x)}I", *x)
    payload = bytes(range(100))
    at = 8  # mdat comes first
    video = track_box(7, b"avc1", (b"stz2", u(4, 5) + bytes([0x12, 0x34, 0x50])), media.full_box(b"stco", u(2, at, at + 20)), [(1, 2, 1), (2, 3, 1)], [1, 4], [(3, 10), (2, 5)])
    sound = track_box(9, b"mp4a", (b"stz2", u(16, 2) + struct.pack(">HH", 30, 40)), media.full_box(b"co64", u(1), struct.pack(">Q", at + 30)), [(1, 2, 1)])
    data = media.box(b"mdat", payload) + media.box(b"moov", video, sound)
    a, b = media.describe(data)
    assert (a.number, a.codec, a.duration, a.first_time, a.n_samples) == (7, "avc1", 40, 1234, 5) and (b.number, b.codec, b.n_samples) == (9, "mp4a", 2)
    assert (a.starts - at).tolist() == [0, 1, 20, 23, 27] and a.sizes.tolist() == [1, 2, 3, 4, 5] and a.keys.tolist() == [0, 3]
    assert media.payload_of(data, b) == payload[30:100] and b.keys.tolist() == [0, 1]


def test_media_fragments():
    u = lambda *x: struct.pack(f">{len(x)}I", *x)
    empty = track_box(1, b"avc1", (b"stsz", u(0, 0)), media.full_box(b"stco", u(0)), [])
    movie = media.box(b"moov", empty, media.box(b"mvex", media.full_box(b"trex", u(1, 1, 100, 6, 0x10000))))

    def fragment(offset):
        first = media.full_box(b"trun", struct.pack(">IiI", 2, offset, 0), u(10, 20), flags=0x1 | 0x4 | 0x200)  # explicit sizes; the first is a keyframe
        second = media.full_box(b"trun", struct.pack(">I", 2), flags=0)  # defaults, right behind
        return media.box(b"moof", media.full_box(b"mfhd", u(1)), media.box(b"traf", media.full_box(b"tfhd", u(1), flags=0x20000), first, second))

    payload = bytes(range(42))
    part = fragment(len(fragment(0)) + 8) + media.box(b"mdat", payload)
    data = movie + part + part
    (track,) = media.describe(data)
    assert track.n_samples == 8 and track.duration == 800 and track.sizes.tolist() == [10, 20, 6, 6] * 2 and track.keys.tolist() == [0, 4]
    assert media.payload_of(data, track) == payload * 2


def test_media_crafted():
    u = lambda *x: struct.pack(f">{len(x)}I", *x)
    deep = b""
    for _ in range(3000):
        deep = media.box(b"moov", deep)
    assert media.describe(deep) == [] and sum(1 for _ in media.walk(deep)) == media.MAX_DEPTH
    many = media.box(b"moov", track_box(1, b"raw ", (b"stsz", u(1, 0xFFFFFFFF)), media.full_box(b"stco", u(3, 0, 0, 0)), [(1, 0xFFFFFFFF, 1), (0xFFFFFFFF, 1, 1)]))
    (track,) = media.describe(many)
    assert track.n_samples == 0xFFFFFFFF and len(track.starts) <= len(many)
    far = media.box(b"moov", track_box(1, b"raw ", (b"stsz", u(192, 1)), media.full_box(b"co64", u(1), struct.pack(">Q", 2**64 - 192)), [(1, 1, 1)]))
    (track,) = media.describe(far)
    assert track.n_samples == 1 and len(track.starts) == 0 and media.payload_of(far, track) == b""
    run = media.box(b"moof", media.box(b"traf", media.full_box(b"tfhd", u(5, 3), flags=0x10), media.full_box(b"trun", u(0xFFFFFFFF, 0), flags=0)))
    (track,) = media.describe(run)
    assert track.n_samples == 0xFFFFFFFF and len(track.starts) <= len(run)
    whole, r = bytearray(media.wrap(b"z" * 192 * 40) + run), random.Random(6)
    for _ in range(300):  # changed and cut bytes give something, never an error
        data = bytearray(whole)
        for _ in range(r.randint(1, 6)):
            data[r.randrange(700)] = r.choice([0, 1, 8, 127, 255, r.randrange(256)])
        data = bytes(data[: r.choice([len(data), r.randrange(len(data))])])
        for track in media.describe(data):
            assert (track.starts >= 0).all() and (track.starts + track.sizes <= len(data)).all() and len(track.keys) <= len(track.sizes)


def test_op3_by_hand(spark, tmp_path):
    rows = corpus(7) + [(5, "another text of id 5", None), (None, "no id", None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t, _ in rows:
        text = (t or "").encode()
        payload = text + b" " * (max(1, -(-len(text) // 192)) * 192 - len(text))
        want.append((str(i), len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), payload))
    got = [(str(x.doc_id), x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) for x in media.op3_media_columns(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(x[:5] for x in want)
    stored = {x.payload_sha256: (x.media_bytes, x.media_sha256, x.feature) for x in media.op3_media_columns(spark, str(tmp_path)).collect()}
    for *_, sha, _, payload in want:
        data = media.wrap(payload)
        assert stored[sha][:2] == (len(data), hashlib.sha256(data).hexdigest()) and f"samples={len(payload) // 192};" in stored[sha][2]


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[a : a + 5]) for a in range(len(w) - 4)]
    times = collections.Counter(windows)
    covered = [False] * len(w)
    for a, x in enumerate(windows):
        if times[x] > 1:
            covered[a : a + 5] = [True] * 5
    found = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in rules.SYMBOLS for c in text), len(found) - len(set(found)), sum(covered)


def brute_shapes(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    found = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return sum(c.isalpha() for x in w for c in x), sum(x[-1] in ".!?" for x in w), sum(bool(re.search(r"[.!?][\"')]?[\x20\x09-\x0D]*\Z", x)) for x in found), len(set(w))


def test_quality_rules(spark):
    rows = corpus() + [(900, "a b\na b\n\na b\nx ### $ | <>", None), (901, "p q r s t " * 3 + "u v w x y z", None), (902, "WOW!! " * 40, None)]
    got = {x.doc_id: x for x in rules.quality_rules(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_counts(t), i
        assert (x.n_letters, x.n_ends, x.n_line_ends, x.n_distinct) == brute_shapes(t), i
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words)
        assert not (x.base_failed and x.kept) and 0 <= x.quality <= 1
    assert rules.quality_rules(frame(spark, rows).limit(0)).count() == 0


def loop_em(patterns, rules):
    """The same estimate in plain loops."""
    prior, on_good, on_bad = 0.5, [rules_start()] * rules, [rules_start()] * rules
    for _ in range(300):
        says = [[rules_start() * 2.0, 2.0, rules_start() * 2.0, 2.0] for _ in range(rules)]
        good = total = 0.0
        for votes, n in patterns:
            a, b = prior, 1 - prior
            for j, v in enumerate(votes):
                if v is not None:
                    a *= on_good[j] if v else 1 - on_good[j]
                    b *= 1 - on_bad[j] if v else on_bad[j]
            p = a / (a + b)
            good, total = good + n * p, total + n
            for j, v in enumerate(votes):
                if v is not None:
                    says[j][0] += n * p * v
                    says[j][1] += n * p
                    says[j][2] += n * (1 - p) * (1 - v)
                    says[j][3] += n * (1 - p)
        prior = (good + 1) / (total + 2)
        on_good, on_bad = [x[0] / x[1] for x in says], [x[2] / x[3] for x in says]
    return prior, on_good, on_bad


def rules_start():
    return rules.START


def planted_votes(n=20000):
    """Votes of seven rules with known accuracies over texts of which 80 % are good; a fifth abstains."""
    r = random.Random(5)
    accuracies = [(0.95, 0.9), (0.9, 0.7), (0.8, 0.8), (0.97, 0.6), (0.7, 0.9), (0.85, 0.75), (0.99, 0.95)]
    counted = collections.Counter()
    for _ in range(n):
        good = r.random() < 0.8
        counted[tuple(None if r.random() < 0.2 else int((r.random() < (a if good else b)) == good) for a, b in accuracies)] += 1
    return accuracies, list(counted.items())


def test_rules_recover_planted_accuracies():
    accuracies, patterns = planted_votes()
    got = rules.estimate(patterns, len(accuracies))
    assert abs(got.prior - 0.8) < 0.05
    assert np.abs(got.on_good - [a for a, _ in accuracies]).max() < 0.05 and np.abs(got.on_bad - [b for _, b in accuracies]).max() < 0.05
    prior, on_good, on_bad = loop_em(patterns, len(accuracies))
    assert got.prior == pytest.approx(prior, abs=1e-6) and got.on_good == pytest.approx(on_good, abs=1e-6) and got.on_bad == pytest.approx(on_bad, abs=1e-6)
    none = rules.estimate([], 3)
    assert none.prior == 0.5 and none.on_bad.tolist() == [rules.START] * 3


def test_votes_are_weighed(spark):
    """The posterior is not the all-must-pass filter: some documents with a vote for bad stay, and the result follows from the estimate."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = rules.quality_rules(docs).where("not base_failed").collect()
    names = list(rules.votes())
    patterns = collections.Counter(tuple(x[k] for k in names) for x in got)
    prior, on_good, on_bad = loop_em(list(patterns.items()), len(names))
    for x in got:
        a, b = prior, 1 - prior
        for k, g, h in zip(names, on_good, on_bad, strict=True):
            if x[k] is not None:
                a, b = (a * g, b * (1 - h)) if x[k] else (a * (1 - g), b * h)
        assert x.quality == pytest.approx(a / (a + b), abs=1e-5)
    with_bad = [x for x in got if any(x[k] == 0 for k in names)]
    assert 50 < sum(x.kept for x in with_bad) < len(with_bad) - 300
    assert sum({0, 1} <= {x[k] for x in got} for k in names) >= 7  # rules that voted both ways here


def test_quality_rules_find_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rules.quality_rules(docs).join(labels.withColumnRenamed("quality", "label"), "doc_id").where("not base_failed")
    good, junk = got.where("label = 1"), got.where("label = 0")
    assert good.where("kept").count() > 0.97 * good.count() and junk.where("kept").count() < 0.1 * junk.count()


def test_ordinal_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    grades = ordinal.graded(spark, "/root/testdata/sf0.1")
    model = ordinal.fit_on(docs, grades.where("doc_id % 2 = 0"), 3)
    assert model.thresholds[0] < model.thresholds[1]
    got = ordinal.ordinal_scores(docs, model).join(grades.where("doc_id % 2 = 1"), "doc_id").collect()
    clean, rest = [x for x in got if x.grade == 2], [x for x in got if x.grade < 2]
    assert sum(x.kept for x in clean) > 0.98 * len(clean) and sum(x.kept for x in rest) < 0.08 * len(rest)
    for x in got[:50]:
        assert 0 <= x.tail_prob <= 1 and x.tail_prob <= x.expected_grade <= 2


def test_ordinal_on_few_labels(spark):
    """With 200 labels, half of the smaller table's: junk goes, clean documents stay, and most toxic ones of the language that has the most are known."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    grades = ordinal.graded(spark, "/root/testdata/sf0.01")
    model = ordinal.fit_on(docs, grades.where("doc_id % 2 = 0"), 3)
    got = ordinal.ordinal_scores(docs, model, carry=["lang"]).join(grades.where("doc_id % 2 = 1"), "doc_id").collect()
    kept = lambda own: sum(x.kept for x in own) / len(own)
    assert kept([x for x in got if x.grade == 2]) > 0.97 and kept([x for x in got if x.grade == 0]) < 0.1
    assert kept([x for x in got if x.grade == 1 and x.row.lang == "en"]) < 0.3


def test_scorer_equals_features_and_tails():
    """Scores of slices of texts are those of one text at a time."""
    r = random.Random(8)
    texts = [t for _, t, _ in corpus(5)] + ODD + ["WOW! | a b", " lead", "a " * 50, "one two three four five six seven " * 30, None]
    weights = np.zeros(ordinal.BUCKETS, np.float32)
    for t in texts:
        own = ordinal.features((t or "").encode())
        weights[r.sample(own.tolist(), min(len(own), 5))] = r.random() - 0.5
    for k in range(11):
        weights[ordinal._buckets[b"\0repeats>%d" % k]] = 0.3
    for w in (weights, np.zeros_like(weights)):
        model = ordinal.Ordinal(w, np.array([-0.5, 0.5]))
        for n in (1, 7, len(texts)):
            got = [x for a in range(0, len(texts), n) for x in ordinal.Scorer(model).tails(pa.array(texts[a : a + n], pa.string()))[0]]
            assert np.abs(np.array(got) - [model.tails(ordinal.features((t or "").encode())) for t in texts]).max() < 1e-6


def test_ordinal_judges_rows(spark):
    """Clashing names, repeated and null ids: each row by its own text."""
    words = ["good"] * 30 + ["bad"] * 30
    rows = [(i, f"{w} {w} text number {i}", "x", "y") for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, row string")
    ratings = spark.createDataFrame([(i, 2 if w == "good" else 0) for i, w in enumerate(words)], "doc_id long, grade int")
    twice = docs.unionByName(spark.createDataFrame([(0, "zzz", "x", "y")], docs.schema))
    model = ordinal.fit_on(twice, ratings, 3, sample=60)
    new = spark.createDataFrame([(1, "good good", "x", "y"), (1, "bad bad", "x", "y"), (None, "good good", "x", "y"), (None, None, "x", "y"), (1, " ", "x", "y")], docs.schema)
    got = sorted((x.row.text or "", x.kept) for x in ordinal.ordinal_scores(new, model, carry=new.columns).collect())
    assert got == [("", False), (" ", False), ("bad bad", False), ("good good", True), ("good good", True)]


def test_ordinal_edges(spark):
    docs = frame(spark, corpus(2, 20))
    none = ordinal.fit_on(docs, spark.createDataFrame([], "doc_id long, grade int"), 3)
    got = ordinal.ordinal_scores(docs, none).collect()
    assert len(got) == docs.count() and abs(got[0].expected_grade - 1) < 1e-9
    odd = spark.createDataFrame([(0, 2), (0, 1), (None, 1), (1, None), (99999, 0)], "doc_id long, grade int")
    assert ordinal.ordinal_scores(docs.limit(0), ordinal.fit_on(docs, odd, 3)).count() == 0


def test_licences(spark):
    rows = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nAll rights reserved."),
        (2, "He lost his license plate.\nPermission was granted."),
        (3, None),
        (4, ""),
        (5, "This work is licensed under the GNU General Public License, version 3."),
        (6, "Licensed under CC BY-NC 4.0."),
        (7, "long " * 3000 + "released under the MIT License " + "text " * 3000),
        (8, "licensed under the full moon"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"gram": F.lit(1), "family": F.lit(2), "line": F.lit(3)})
    got = {x.doc_id: x for x in licences.licence_scan(docs).collect()}
    assert {i: x.families for i, x in got.items()} == {1: "apache-2.0,proprietary", 2: "", 3: "", 4: "", 5: "gpl", 6: "cc-by-nc", 7: "mit", 8: ""}
    assert got[1].n_paragraphs == 3 and got[3].n_paragraphs == 0 and got[2].n_candidates == 2
    assert licences.licence_scan(docs.limit(0)).count() == 0 and licences.licence_scan(docs.unionByName(docs)).count() == 16
    weights, bias = licences.model()
    assert len(bias) == len(licences.FAMILIES) and any(0.0 in w for w in weights.values())


def test_every_template_is_found(spark):
    """Also statements without a legal word pass the gate."""
    rows = [(t, name) for name, texts in licences.TEMPLATES.items() for t in texts]
    rows += [("Released under the GPL version 3.", "gpl"), ("GPLv2+", "gpl"), ("Available under CC BY 4.0", "cc-by"), ("Available under the Apache 2.0 terms", "apache-2.0"), *((t, "") for t in licences.OTHERS)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {x.doc_id: x.families for x in licences.licence_scan(docs).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(rows)] == rows
    for texts in licences.TEMPLATES.values():
        for t in map(licences.tokens_of, texts):
            pairs = set(zip(t, t[1:], strict=False))
            assert sum(not licences.ANCHORS & {*p} for p in pairs) < licences.LEAST_CONTAINED * len(pairs)


WRAPPED = {
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.",
    "apache-2.0": " * Licensed under the Apache License, Version\n * 2.0 (the \"License\"); you may not use this\n * file except in compliance with the License.\n *\n * Unless required by applicable law or agreed to in\n * writing, software distributed under the License is\n * distributed on an \"AS IS\" BASIS.",
    "mit": "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files (the \"Software\"), to deal in the Software\nwithout restriction.",
    "gpl": "This program is free software: you can redistribute it and/or\nmodify it under the terms of the GNU General\nPublic License as published by the Free Software\nFoundation, either version 3 of the License, or (at your option) any later\nversion.",
}


def test_identifiers_and_spellings(spark):
    """Expressions of identifiers, either spelling, and plain texts with the same words."""
    rows = [("Apache-2.0 OR MIT", "apache-2.0"), ("MIT OR Apache-2.0", "apache-2.0"), ("Dual licensed under MIT and Apache 2.0", "apache-2.0"), ("CC0-1.0", "public-domain"), ("BSD-3-Clause", "bsd"), ("SPDX-License-Identifier: BSD-2-Clause", "bsd")]
    rows += [("Distributed under the terms of the MIT", "mit"), ("This file is under the MIT licence.", "mit"), ("Released under the Apache Licence, Version 2.0", "apache-2.0"), ("Licenced under the GNU General Public Licence version 3", "gpl")]
    rows += [(t, "") for t in ("The driver had no licence.", "the clause of the bsd contract", "he got 3 cc0 kits", "Mozilla Public Licence Version 2.0", "the students of MIT or Apache helicopters", "submit it or permit it")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {x.doc_id: x.families for x in licences.licence_scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [f for _, f in rows]


def test_wrapped_licences(spark):
    """Notices that no single line states; the last one shares its block with another statement."""
    rows = [(f"Title\n\n{t}\n\nother words", name) for name, t in WRAPPED.items()]
    rows += [(f"Copyright (c) 2020, Jane Doe.\nAll rights reserved.\n{WRAPPED['bsd']}", "bsd,proprietary"), ("\n\nthe license\nplate was\n\n--\nfound\n", "")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {x.doc_id: x for x in licences.licence_scan(docs).collect()}
    assert [(t, got[i].families) for i, (t, _) in enumerate(rows)] == rows
    assert all(x.n_confirmed <= x.n_candidates <= x.n_paragraphs for x in got.values())
    units = docs.where(f"doc_id = {len(rows) - 1}").select(F.inline(licences.units_of(F.col("text")))).where("unit > -2").collect()
    assert [tuple(x) for x in units] == [(2, -1, ["the", "license", "plate", "was"])]


def test_gate_loses_nothing():
    """Without gate words a text holds too little of any template; other licences are unknown."""
    for texts in licences.TEMPLATES.values():
        for t in map(licences.tokens_of, texts):
            pairs = set(zip(t, t[1:], strict=False))
            assert sum(not {*licences.gate()} & {*p} for p in pairs) < licences.LEAST_CONTAINED * len(pairs), t
    weights, bias = licences.model()

    def family(text):
        s = np.array(bias) + sum((np.array(weights[g]) for g in licences.ngrams(licences.tokens_of(text)) if g in weights), np.zeros(len(bias)))
        return licences.FAMILIES[int(s.argmax())]

    unseen = ["this file is under the Mozilla Public License, v. 2.0", "licensed under the Eclipse Public License", "Nokia open source license 1.0", "Mulan PSL v2 license"]
    assert [family(t) for t in unseen] == ["unknown"] * 4
    assert [family(t) for t in ("GPLv3 or later", "Distributed under the terms of the MIT license")] == ["gpl", "mit"]


def test_licences_judge_rows(spark):
    """Repeated and null ids, repeated rows: each row by its own text."""
    rows = [(1, "licensed under the MIT license"), (1, None), (1, "plain text"), (None, "released into the public domain"), (None, "x"), (2, "gpl version 3"), (2, "gpl version 3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(x.doc_id), x.n_paragraphs, x.families) for x in licences.licence_scan(docs).collect())
    assert got == [("1", 0, ""), ("1", 1, ""), ("1", 1, "mit"), ("2", 1, "gpl"), ("2", 1, "gpl"), ("None", 1, ""), ("None", 1, "public-domain")]


def test_licence_shares_by_hand(spark):
    """Template shares, confirmation and result of whole texts equal a plain loop (single lines only)."""
    weights, bias = licences.model()
    texts = [t for own in licences.TEMPLATES.values() for t in own] + ["licensed under the mozilla public license version 2.0", "he had no license", "unless required by applicable law or agreed to in writing this stays", "gpl"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in licences.licence_paragraphs(docs).collect()}
    for i, text in enumerate(texts):
        tokens = licences.tokens_of(text)
        s = np.array(bias) + sum((np.array(weights[g]) for g in licences.ngrams(tokens) if g in weights), np.zeros(len(bias)))
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        family = licences.FAMILIES[int(p.argmax())]
        own = set(zip(tokens, tokens[1:], strict=False))
        shares = [len(own & (q := set(zip(t, t[1:], strict=False)))) / len(q) for t in map(licences.tokens_of, licences.TEMPLATES.get(family, []))]
        family = family if p.max() >= licences.LEAST_PROBABILITY else "unknown"
        x = got[i]
        assert x.family == family and x.template_share == pytest.approx(max(shares, default=0.0)), text
        assert x.confirmed == (family != "unknown" and max(shares, default=0.0) >= licences.LEAST_CONTAINED)


def test_licence_scores_by_hand(spark):
    """Probabilities in SQL equal a plain loop over the same weights."""
    weights, bias = licences.model()
    texts = ["licensed under the bsd license", "copyright 2020 all rights reserved by us", "a license", "in the public domain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in licences.licence_paragraphs(docs, least=0.0).collect():
        s = np.array(bias) + sum((np.array(weights[g]) for g in licences.ngrams(licences.tokens_of(texts[x.doc_id])) if g in weights), np.zeros(len(bias)))
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert x.family == licences.FAMILIES[int(p.argmax())] and x.probability == pytest.approx(p.max())


def test_chat_trees(spark):
    hard = "\\### Assistant: </turn> ok\n### user:\nx\n</turn>\n\\\\#"
    rows = [
        (1, 0, None, "user", "hi", 1.0), (1, 1, 0, "assistant", "yes", 2.0), (1, 2, 0, "assistant", hard, 1.0), (1, 3, 2, "user", hard, 1.5), (1, 4, 3, "assistant", None, None),
        (2, 7, 99, "us:er\n", "parent is absent", None), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0), (3, 5, 2, "user", "behind it", 1.0),
        (4, 1, None, "user", "twice", 1.0), (4, 1, None, "user", "twice", 1.0), (None, 1, None, "user", "no tree", 1.0),
    ]
    rows += [(5, i, i - 1 if i else None, "user", f"m{i}", 0.0) for i in range(37)]
    m = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    best = {x.tree: chat.turns_of(x.formatted) for x in chat.format_trees(m).collect()}
    assert [t[:2] for t in best[1]] == [("user", "hi"), ("assistant", hard), ("user", hard), ("assistant", "")]
    assert [t[:2] for t in best[2]] == [("us:er\n", "parent is absent")] and len(best[4]) == 1 and 3 not in best and len(best) == 4
    assert [t[1] for t in best[5]] == [f"m{i}" for i in range(37)]
    branches = chat.reply_paths(m, keep=None).select("tree", "leaf", "branch").distinct().where("tree = 1").collect()
    assert {(x.leaf, x.branch) for x in branches} == {(4, 1), (1, 2)}
    text = next(x.formatted for x in chat.format_trees(m).where("tree = 1").collect())
    assert "".join(chat.ESCAPED.sub(r"\1", text[a:b]) for a, b in chat.loss_spans(text)) == hard
    assert chat.format_trees(m.limit(0)).count() == 0


def test_chat_keeps_every_row(spark, tmp_path):
    """Repeated and null turns, null ids, roles and texts; extra columns."""
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "c"), (1, 1, "assistant", "c"), (1, None, "system", "s"), (2, 0, None, None), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 5, "assistant", "#<\\")]
    made = spark.createDataFrame([(*x, "t", 1, 2) for x in rows], "conv_id long, turn long, role string, text string, tree string, node long, leaf long")
    made.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.conv_id: x for x in chat.op10_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None, -7} and got[1].n_turns == 5
    assert got[1].turns_sha256 == sha("system\ns\nuser\na\nassistant\nb\nassistant\nc\nassistant\nc\n") and got[1].loss_chars == 3 and got[1].loss_sha256 == sha("bcc")
    assert got[2].turns_sha256 == sha("\n\n") and got[None].turns_sha256 == sha("user\nx\nassistant\ny\n") and got[3].loss_sha256 == sha("#<\\")
    made.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [x.conv_id for x in chat.op10_chat_format(spark, f"{tmp_path}/none").collect()] == [-7]


def brute_paths(rows, keep):
    """Best paths of each tree by walking up from every leaf."""
    out = {}
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        ranked = []
        for leaf in set(own) - {r[2] for r in own.values() if r[2] in own}:
            path, at = [], leaf
            while at in own and len(path) <= len(own):
                path.append(at)
                at = own[at][2]
            if len(path) <= len(own):
                ranked.append((-sum(own[x][5] for x in path), leaf, path[::-1]))
        out.update({(tree, leaf, k + 1): path for k, (_, leaf, path) in enumerate(sorted(ranked)[:keep])})
    return out


def test_reply_paths_against_walks(spark):
    r = random.Random(9)
    rows = []
    for tree in range(12):
        n = r.randint(1, 60)
        rows += [(tree, i, None if i == 0 or r.random() < 0.05 else r.randrange(i) if r.random() < 0.5 else i - 1, "user", "t", float(r.randint(0, 4))) for i in range(n)]
    m = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    for keep in (1, 3, None):
        found = collections.defaultdict(list)
        for x in chat.reply_paths(m, keep=keep).collect():
            found[x.tree, x.leaf, x.branch].append((x.depth, x.node))
        assert {k: [n for _, n in sorted(v)] for k, v in found.items()} == brute_paths(rows, keep)
        assert all([d for d, _ in sorted(v)] == list(range(len(v))) for v in found.values())


def test_op7_and_op9_by_hand(spark, tmp_path):
    """The queries' own columns, at their own capacity, against the library."""
    library = Tokenizer.from_file(PATH)
    rows = corpus(6) + [(3, "more text of id 3", None), (3, "more text of id 3", None), (None, " ".join(ODD), None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want, pieces = [], collections.Counter()
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
        whole = np.array([*ids, 0], "<u4")
        pieces.update((str(i), k, a, len(whole[a : a + 2048]), zlib.crc32(whole[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(whole), 2048)))
    got = [(str(x.doc_id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.op7_bpe(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    packed = packing.op9_best_fit_packing(spark, str(tmp_path)).collect()
    assert collections.Counter((str(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in packed) == pieces
    by_sequence = collections.defaultdict(list)
    for x in packed:
        by_sequence[x.sequence_id].append((x.offset, x.length))
    for own in by_sequence.values():
        assert [a for a, _ in sorted(own)] == np.cumsum([0] + [n for _, n in sorted(own)])[:-1].tolist() and sum(n for _, n in own) <= 2048
    assert len(by_sequence) <= -(-sum(x.length for x in packed) // 2048) + 1


def test_packing_is_near_the_optimum():
    """Against all ways to pack a few pieces."""
    def fewest(items, capacity):
        best, bins = len(items), []

        def place(k):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + items[k] <= capacity and bins[j] not in bins[:j]:
                    bins[j] += items[k]
                    place(k + 1)
                    bins[j] -= items[k]
            bins.append(items[k])
            place(k + 1)
            bins.pop()

        place(0)
        return best

    r = random.Random(10)
    over = 0
    for _ in range(60):
        items = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
        used = sum(n for _, n in packing.plan_packing(dict(collections.Counter(items)), 20))
        over += used - fewest(items, 20)
        assert used - fewest(items, 20) <= 1
    assert over <= 6


def test_queries_return_their_columns(spark):
    from runlens.llm import queries

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op1_license_scan", "op2_quality_rules", "op3_media_columns", "op4_substring_dedup", "op5_line_dedup", "op6_quality_classifier", "op7_bpe", "op8_minhash_dedup"):
        assert queries.QUERIES[name](spark, sf).count() == n, name
    ten = {x.conv_id: x for x in queries.QUERIES["op10_chat_format"](spark, sf).collect()}
    hard = "\\### Assistant: </turn> ok"
    assert ten[-7].turns_sha256 == hashlib.sha256(f"user\n{hard}\nassistant\n{hard}\n".encode()).hexdigest() and ten[-7].loss_chars == len(hard)
    assert words(None) == []
