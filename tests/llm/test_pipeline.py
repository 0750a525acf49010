"""corpus_pipeline against loops, stage by stage and as a whole, over rows with null and repeated ids, nulls, empties and clashing columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from runlens.llm import ordinal

from .helpers import COLUMNS, corpus, frame, words

SHARED = ["a line that many sites have", "another line of many sites"]


def rows_of(seed):
    """(doc_id, text, source): the helpers' corpus with shared lines, good and bad words, and odd ids."""
    r = random.Random(seed)
    rows = []
    for i, t, s in corpus(seed, 90):
        mark = "fine" if i % 3 else "awful"
        rows.append((i, None if t is None else "\n".join([f"{mark} {mark} {mark}", t, *SHARED[: i % 3]]), s))
    long = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(80))
    return rows + [(5, f"fine {long}", "s1"), (5, f"fine {long} too", "s2"), (None, f"fine {long} as well", None), (None, "fine words without an id", "s3"), (None, None, None), (7, "fine", "s4"), (7, "fine", "s5"), (8, SHARED[0], "s6")]


def folder(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(bool(i % 3)), 0) for i, t, _ in rows if i is not None and t and i % 2 == 0] + [(None, 1, 0), (10**6, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def classify(rows, model):
    return [x for x in rows if words(x[1]) and model.tails(ordinal.features(x[1].encode()))[1] >= 0.5]


def drop_lines(rows):
    sites = collections.defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            sites[line].add(s or "")
    out = []
    for i, t, s in rows:
        own = (t or "").split("\n")
        solid = [x for x in own if x.strip(" \t\n\x0b\x0c\r")]
        spread = [x for x in solid if len(sites[x]) >= 10]
        if t is not None and len(spread) < len(solid):
            t = "\n".join(x for x in own if x not in spread)
        out.append((i, t, s))
    return out


def key(row):
    parts = ["null" if row[0] is None else f"={row[0]}", "null" if row[1] is None else f"={row[1]}"]
    return hashlib.md5("\0".join(parts).encode()).digest()


def drop_near_copies(rows, width=5, percent=80):
    sets = [{tuple(x.lower() for x in w[a : a + width]) for a in range(max(1, len(w) - width + 1))} if (w := words(t)) else set() for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i, row in enumerate(rows):
        groups[find(i) if sets[i] else ("none", i)].append(row)
    out = []
    for own in groups.values():
        ids = [x[0] for x in own if x[0] is not None]
        out.append(min((x for x in own if not ids or x[0] == min(ids)), key=key))
    return out


def cut_passages(rows, width=13):
    first = {}
    for i, t, _ in rows:
        w = words(t)
        for a in range(len(w) - width + 1) if i is not None else ():
            k = tuple(w[a : a + width])
            first[k] = min(i, first.get(k, i))
    out = []
    for i, t, s in rows:
        w = words(t)
        covered = [False] * len(w)
        for a in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[a : a + width])] < i:
                covered[a : a + width] = [True] * width
        out.append((i, b" ".join(x for x, c in zip(w, covered, strict=True) if not c).decode() if any(covered) else t, s))
    return out


def pieces(rows):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = collections.Counter()
    for i, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.update((i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
    return out


def plain(df):
    """(doc_id, text, source) of a stage's rows, whose other columns are as they were."""
    assert df.columns == COLUMNS
    got = df.collect()
    assert all(x.lang == "en" and x["words"] == "w" and x.bucket == 7 and x.n_chars == len(x.text or "") for x in got)
    return collections.Counter((x.doc_id, x.text, x.source) for x in got)


def without_source(counter):
    """Of rows alike in id and text any may stay."""
    out = collections.Counter()
    for (i, t, _), n in counter.items():
        out[i, t] += n
    return out


@pytest.mark.parametrize("seed", [21, 22])
def test_stages(spark, tmp_path, seed):
    rows = rows_of(seed)
    sf = folder(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = ordinal.fit_on(docs, ordinal.graded(spark, sf), 3)
    stages = dict(corpus_pipeline.STAGES)
    steps = [("quality_classifier", lambda x: classify(x, model)), ("line_dedup", drop_lines), ("minhash_dedup", drop_near_copies), ("substring_dedup", cut_passages)]
    assert [n for n, _ in steps] + ["best_fit_packing"] == list(stages)
    for name, loop in steps:
        want = loop(rows)
        got = stages[name](spark, frame(spark, rows), sf)
        assert without_source(plain(got)) == without_source(collections.Counter(want)), name
        rows = want
        assert len(rows) > 20
    packed = stages["best_fit_packing"](spark, frame(spark, rows), sf).collect()
    assert collections.Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in packed) == pieces(rows)
    whole = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in whole) == pieces(rows)


def test_empty(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
