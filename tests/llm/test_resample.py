"""Importance resampling against plain loops; CRC-32 algebra; quickselect with ties and hot keys."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from runlens.llm import resample, tokens

from .helpers import SCHEMA, corpus, frame


def runs(text):
    text = "".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def brute(docs, target):
    """(doc_id, n_words, n_features, weight, score) of every row, as sorted for the draw, and how many are drawn."""
    own, wanted = (collections.Counter(bucket(f) for t in texts for f in runs(t)[1]) for texts in ([t for _, t, _ in docs], target))
    s_all, t_all = float(own.total()), float(wanted.total())
    out = []
    for i, t, _ in docs:
        n, found = runs(t)
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10000) / ((own[b] + 1) * (t_all + 10000)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, able, 5 * len(able) // 100


def test_crc_of_joined_strings():
    r = random.Random(1)
    heads = [r.randbytes(r.randrange(9)) for _ in range(300)]
    tails = [r.randbytes(r.choice([0, 1, 5, 63, 64, 65, 200, 5000])) for _ in range(300)]
    got = tokens.shifted(tokens.crcs_of(heads), np.array(list(map(len, tails)))) ^ tokens.crcs_of(tails)
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(heads, tails, strict=True)]


def test_features_of_odd_texts():
    texts = ["Hello  World, x y\x00z\ta 9é", None, "", "  ", "one", "a b", "ÀB c\nD é ß", "x" * 50_000 + " " + "y" * 70_000, "\U0001f600   b"]
    for array in (pa.array(texts), pa.array(["left", *texts, "out"]).slice(1, len(texts))):
        offsets, found = resample.features(array)
        assert np.diff(offsets).tolist() == [runs(t)[0] for t in texts]
        for n in (1, 2, 3):
            assert sorted(found[n - 1][1].tolist()) == sorted(bucket(f) for t in texts for f in runs(t)[1] if f.count(" ") == n - 1)
    assert resample.features(pa.array([], pa.string()))[0].tolist() == [0]


def test_against_loops(spark):
    docs = [r for k in range(4) for r in ((i + 1000 * k, t, s) for i, t, s in corpus(21 + k))]
    docs += [(None, docs[3][1], None), (None, " ".join("abc" for _ in range(30)), None), (5, " ".join(f"w{i}" for i in range(40)), None)]
    docs += [docs[30]] * 3  # rows alike in all
    target = [t for _, t, _ in corpus(77, 30)]
    rows, able, k = brute(docs, target)
    got = resample.importance_resample(frame(spark, docs), frame(spark, [(i, t, None) for i, t in enumerate(target)])).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == collections.Counter(rows)
    drawn = sorted((r["rank"], r.score, r.doc_id) for r in got if r["rank"] is not None)
    assert k >= 10
    assert drawn == [(i + 1, r[4], r[0]) for i, r in enumerate(able[:k])]


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = frame(spark, [(1, "a b c", "s"), (2, None, None)])
    assert resample.importance_resample(empty, some).count() == 0
    assert [(r.doc_id, r["rank"]) for r in resample.importance_resample(some, empty).orderBy("doc_id").collect()] == [(1, None), (2, None)]


def test_quickselect_is_sorting(spark):
    r = random.Random(5)
    keys = [(r.randrange(-9, 9), 0, r.randrange(40), r.randrange(3)) for _ in range(400)] + [(0, 0, 7, 1)] * 300 + [(2, 1, 0, 5)] * 40
    rows = spark.createDataFrame(keys, "negative long, no_id long, id long, tie long").repartition(7).cache()
    for k in (1, 2, 333, 500, 739, 740):
        assert resample.quickselect(rows, k) == sorted(keys)[k - 1]
    assert resample.quickselect(rows, 0) is None


def test_ranks_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(resample, "ROWS_A_PART", 50)
    rows = spark.range(1000).selectExpr("id * 7919 % 1000 - 500 as negative", "0L as no_id", "id", "0L as tie")
    got = [r.negative for r in resample.ranked(rows, 1000).orderBy("rank").collect()]
    assert got == sorted(got)
    assert sorted(r["rank"] for r in resample.ranked(rows, 1000).collect()) == list(range(1, 1001))
