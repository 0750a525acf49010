"""Spelling variants against plain loops: counts, neighbourhoods, near words, forms and roots."""

import collections
import random
import re
import zlib

import numpy as np

from runlens.llm import spelling

from .helpers import SCHEMA, corpus, frame


def words_of(docs, drop=199, points=6, least=5):
    n = collections.Counter()
    for i, t, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % drop == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= points and k >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, times=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return collections.Counter((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def got(df):
    return collections.Counter(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_blanking():
    text = "Été ÀÉÿ ×÷ Āb ſtone K  x\u0000y naïve1Œuvre\U0001f600Zz"
    plain = spelling.blanked(text.encode()).decode().split()
    assert plain == ["".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in r) for r in re.findall("[A-Za-zÀ-ÿ]+", text)]
    assert spelling.blanked(b"") == b""


def test_neighbourhoods_are_whole_and_without_repeats():
    r = random.Random(3)
    values = spelling.symbol_values(4)
    for n in (1, 2, 6, 9):
        own = np.array([[r.randrange(4) for _ in range(n)] for _ in range(20)])
        found = collections.defaultdict(list)
        for rows, hashes in spelling.neighbourhood(own, values):
            for row, h in zip(rows.tolist(), hashes.tolist(), strict=True):
                found[row].append(h)
        for i, word in enumerate(own.tolist()):
            want = {tuple(word)} | {tuple(word[:k] + word[k + 1 :]) for k in range(n)}
            want |= {tuple(word[:k] + [c] + word[k + 1 :]) for k in range(n) for c in range(4)} | {tuple(word[:k] + [c] + word[k:]) for k in range(n + 1) for c in range(4)}
            hashes = sorted(int(spelling.reduced_hash(np.array([w]), values)[0]) if w else 0 for w in want)
            assert sorted(found[i]) == hashes


def test_portions_change_nothing(monkeypatch):
    values = spelling.symbol_values(8)
    own = np.array([[k * i % 8 for k in range(50)] for i in range(1, 4)])
    whole = sorted(x for rows, h in spelling.neighbourhood(own, values) for x in zip(rows.tolist(), h.tolist(), strict=True))
    monkeypatch.setattr(spelling, "AT_ONCE", 300)
    assert whole == sorted(x for rows, h in spelling.neighbourhood(own, values) for x in zip(rows.tolist(), h.tolist(), strict=True))


def test_against_loops(spark):
    r = random.Random(7)
    stems = ["".join(r.choice("abcdeéÿ") for _ in range(r.randint(5, 9))) for _ in range(25)]

    def spelt(w):
        for _ in range(r.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
            k = r.randrange(len(w) + 1)
            w = r.choice([w[:k] + r.choice("abé") + w[k:], w[:k] + w[k + 1 :], w[:k] + r.choice("cdÿ") + w[k + 1 :]])
        return r.choice([w, w, w.upper(), w.title()])

    docs = corpus(31) + [(5000 + i, " ".join(spelt(stems[min(r.randrange(25), r.randrange(25))]) + r.choice(["", ",", "1"]) for _ in range(400)), None) for i in range(40)]
    # a chain of forms: each word five times as frequent as the one before; ties of forms; a very long word
    chain = ["mmmmmm", "mmmmmn", "mmmmnn", "mmmnnn", "mmnnnn", "mnnnnn"]
    docs += [(9000, " ".join(" ".join([w] * 5 * 5**k) for k, w in enumerate(chain)), None), (None, " ".join(["zzzzzzz"] * 5 + ["zzzzzzy"] * 30 + ["zzzzzzx"] * 30), None)]
    docs += [(9001, " ".join(["q" * 3000] * 40 + ["q" * 2999 + "r"] * 6), None)]
    words = words_of(docs)
    want = brute(words)
    assert sum(1 for x in want if x[1] and x[2] != x[1]) > 3
    df = frame(spark, docs)
    assert got(spelling.spelling_groups(df)) == want
    assert got(spelling.spelling_groups(df, symbols=2)) == want
    few = words_of(docs, drop=3, points=2, least=2)
    assert got(spelling.spelling_groups(df, drop=3, least_points=2, least_count=2)) == brute(few)


def test_no_words(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.spelling_groups(frame(spark, [(1, None, None), (2, "", None), (3, "1 2 3", None)])).count() == 0
