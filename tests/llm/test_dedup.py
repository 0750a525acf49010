import hashlib

import numpy as np
import pytest

import corpus_pipeline
from runlens.llm import lines, minhash, substring
from runlens.llm.components import connected

from .helpers import corpus, frame, words


def brute_substring(rows, width=13):
    seen, out = {}, {}
    for i, t, _ in sorted(rows):
        w = words(t)
        covered = [False] * len(w)
        own = {tuple(w[a : a + width]) for a in range(len(w) - width + 1)}
        for a in range(len(w) - width + 1):
            if tuple(w[a : a + width]) in seen:
                covered[a : a + width] = [True] * width
        for k in own:
            seen.setdefault(k, i)
        kept = b" ".join(x for x, c in zip(w, covered, strict=True) if not c)
        out[i] = (len(w), sum(covered), kept.decode())
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring(spark, seed, monkeypatch):
    monkeypatch.setattr(substring, "BUCKET_CHARS", 2000)
    rows = corpus(seed)
    got = substring.substring_dedup(frame(spark, rows)).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in got} == brute_substring(rows)
    for x in got:
        assert x.n_removed == sum(b - a for a, b in zip(x.span_starts, x.span_ends, strict=True))


def test_substring_edges(spark):
    docs = frame(spark, corpus(4))
    assert substring.substring_dedup(docs.limit(0)).count() == 0
    out = substring.substring_dedup(docs, carry=["row", "words", "source"], as_is=True)
    texts = {i: t for i, t, _ in corpus(4)}
    assert all(x.kept_text == texts[x.doc_id] for x in out.where("n_removed = 0").collect()) and out.select("row.row", "row.words").distinct().count() == 1
    twice = docs.unionByName(docs)
    assert substring.substring_dedup(twice).count() == 2 * docs.count()


def brute_near(rows, width, percent):
    sets = {}
    for i, t, _ in rows:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[a : a + width]) for a in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("seed,width,percent,small,block,shingles,heavy", [(1, 3, 85, 16, 512, 1 << 22, 4096), (2, 5, 80, 2, 3, 1 << 22, 4096), (3, 3, 60, 2, 3, 100, 4096), (2, 3, 70, 1, 3, 1 << 22, 1), (3, 3, 60, 2, 3, 100, 0)])
def test_near(spark, seed, width, percent, small, block, shingles, heavy, monkeypatch):
    for name, value in (("SMALL", small), ("BLOCK", block), ("BLOCK_SHINGLES", shingles), ("HEAVY", heavy)):
        monkeypatch.setattr(minhash, name, value)
    rows = corpus(seed)
    got = minhash.near_components(frame(spark, rows), width, percent).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == brute_near(rows, width, percent)


@pytest.mark.parametrize("percent", [80, 85])
def test_rare_shingles_lose_no_link(percent):
    """Alike sets share one of their rarest shingles, whatever the counts are."""
    random = np.random.Generator(np.random.PCG64(percent))
    counts = random.integers(0, 3, minhash.SLOTS)
    alike = 0
    for _ in range(2000):
        base = random.integers(0, 1 << 63, random.integers(1, 60), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([base, random.integers(0, 1 << 63, random.integers(0, 7), dtype=np.uint64)])) for _ in range(2))
        n = minhash.common_count(a, b)
        if 100 * n >= percent * (len(a) + len(b) - n):
            alike += 1
            assert set(minhash.rare_first(a, counts, percent).tolist()) & set(minhash.rare_first(b, counts, percent).tolist())
    assert alike > 500


def test_near_on_texts_of_one_form(spark, monkeypatch):
    """Texts that share a form but are not alike are dealt by what is their own; their near copies are linked."""
    monkeypatch.setattr(minhash, "HEAVY", 50)
    dealt = []
    whole = minhash.rare_keys
    monkeypatch.setattr(minhash, "rare_keys", lambda *a: dealt.append(whole(*a)) or dealt[0])
    form = " ".join(f"f{i}" for i in range(90))
    rows = [(i, f"{form} " + " ".join(f"w{i}x{k}" for k in range(30)), None) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " end", None) for i in range(0, 300, 3)]
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_components(frame(spark, rows), 3, 85).collect()}
    assert got == {i: (118, i, True) for i in range(300)} | {1000 + i: (119, i, False) for i in range(0, 300, 3)}
    assert dealt and dealt[0].groupBy("grp").count().agg({"count": "max"}).first()[0] <= 4


@pytest.mark.parametrize("nodes", [4000, 16_000, 64_000])
def test_blocks_grow_with_their_bucket(spark, nodes):
    """A bucket with as many nodes outside its main component as blocks may take: some rows for each node, at any size."""
    outside = min(nodes // 4, minhash.HEAVY)
    large = spark.range(nodes).selectExpr("1L as grp", "0 as band", "id as node", f"if(id < {outside}, id + 1, 0L) as component", "100L as n_shingles")
    assert minhash.in_blocks(large, large.where("component <> 0")).count() <= 4.2 * nodes


def test_candidates_keep_their_signatures(spark):
    """Blocks are read once: what has a candidate goes on with all its columns."""
    rows = [(1, 0, 0, side, 0, node, node, 100, 1, 2, 3, 4, list(range(minhash.BANDS))) for side, node in ((0, 1), (0, 2), (1, 2))]
    rows.append((1, 0, 0, 0, 0, 3, 3, 10, -1, -2, -3, -4, [-1] * minhash.BANDS))
    got = minhash.candidates(spark.createDataFrame(rows, minhash.BLOCK_ROWS), 85)
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


@pytest.mark.parametrize("width,percent", [(5, 80), (3, 85)])
def test_near_on_given_texts(spark, width, percent):
    """No link is lost on the given documents, at the pipeline's setting and at the query's."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(x.doc_id, x.text, None) for x in docs.collect()]
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_components(docs, width, percent).collect()}
    assert got == brute_near(rows, width, percent)


def test_near_edges(spark):
    docs = frame(spark, corpus(4, 10))
    assert minhash.near_components(docs.limit(0)).count() == 0
    twice = minhash.near_components(docs.unionByName(docs)).distinct().count()
    assert twice == docs.count()


def test_near_rows_of_repeated_and_null_ids(spark):
    """Each row is linked by its own text."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a, None), (5, b, None), (7, b + " more", None), (9, a, None), (None, a, None), (None, c, None), (None, c, None), (None, None, None), (None, "", None)]
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id), x.kept) for x in minhash.near_components(frame(spark, rows), 3, 85).collect())
    assert got == sorted([("5", 38, "5", True), ("5", 38, "5", True), ("7", 39, "5", False), ("9", 38, "5", False), ("None", 38, "5", False), ("None", 38, "None", True), ("None", 38, "None", True), ("None", 0, "None", True), ("None", 0, "None", True)])
    parts = {(x.doc_id, x.n_shingles): x.component for x in minhash.near_components(frame(spark, rows[:4]), 3, 85).collect() if x.doc_id != 5}
    assert parts[7, 39] != parts[9, 38]  # the two texts of id 5 are not one
    out = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()
    assert sorted((str(x.doc_id), x.text or "") for x in out) == sorted([("5", a), ("5", b), ("None", c), ("None", ""), ("None", "")])


def test_chain_of_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 150), (150, 170)]
    got = {x.node: x.component for x in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 150: 150, 170: 150, 200: 150}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines(spark):
    sites = [f"s{i}" for i in range(14)]
    rows = [(i, f"own line number {i} of a text\nshared here\nrare\n\n \n", s) for i, s in enumerate(sites)]
    rows += [(20 + i, "rare\nown words that are more than that", s) for i, s in enumerate(["s0", "s1", None])]
    rows += [(30, "shared here", "s1"), (31, None, "s1"), (32, "", None), (33, "x\nshared here\nshared here\nmany more own words than these in here", "s2")]
    rows = [(i, t.replace("rare", "rare " + str(i)) if t and i < 6 else t, s) for i, t, s in rows]
    got = {x.doc_id: x for x in lines.line_dedup(frame(spark, rows)).collect()}
    assert got[0].kept_text == "own line number 0 of a text\nrare 0\n\n \n" and got[0].n_lines == 3 and got[0].n_removed == 1
    assert got[30].kept_text == "shared here"  # a copy as a whole
    assert got[31].kept_text is None and got[32].kept_text == "" and got[33].n_removed == 2
    # "rare" is on s6..s13, s0, s1 and "": eleven sites, near the threshold
    assert got[10].n_removed == 2 or got[10].kept_text.startswith("own")
    assert "rare" not in got[20].kept_text
    assert lines.line_dedup(frame(spark, rows).limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_lines_of_mostly_boilerplate(spark):
    """Own lines stay and boilerplate goes, whatever its share; only texts of nothing else are kept whole."""
    spread = ["a first line that is on many sites", "a second line that is on many sites"]
    rows = [(i, "\n".join(spread), f"s{i}") for i in range(12)] + [(20, f"{spread[0]}\nown\n{spread[1]}", "s1"), (21, f"{spread[0]}\n\n", "s2")]
    got = {x.doc_id: (x.n_lines, x.n_removed, x.kept_text) for x in lines.line_dedup(frame(spark, rows)).collect()}
    assert got == {i: (2, 0, "\n".join(spread)) for i in range(12)} | {20: (3, 2, "own"), 21: (1, 0, f"{spread[0]}\n\n")}
    out = {x.doc_id: x for x in corpus_pipeline.drop_lines(spark, frame(spark, rows), "").collect()}
    assert out[20].text == "own" and out[20].n_chars == 3 and len(out) == len(rows)
