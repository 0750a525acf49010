"""Long words stay linear in the encoder; packing is never worse than best fit."""

import bisect
import collections
import random
import time

import pytest
from tokenizers import Tokenizer

from runlens.llm import bpe, packing


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "ab", "aé日"])
def test_long_words(alphabet):
    v, r = bpe.vocabulary(bpe.default_path()), random.Random(4)
    library = Tokenizer.from_file(bpe.default_path())
    for n in (255, 256, 257, 2000, 30_000):
        w = "".join(r.choice(alphabet) for _ in range(n))
        assert v.encode(w).tolist() == library.encode(w, add_special_tokens=False).ids
    marked = w[:1999] + chr(ord("a") + bpe.END)
    if alphabet.isascii():
        assert v.cover(marked) == v.merge(marked)


def test_time_is_linear_in_the_word():
    v, r = bpe.vocabulary(bpe.default_path()), random.Random(5)
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))
    v.encode(word[:1000])
    began = time.process_time()
    n = len(v.encode(word))
    assert n > 100_000
    assert time.process_time() - began < 8  # 2 seconds as a rule; square growth would take twenty minutes


def best_fit(counts, capacity):
    gaps, n = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            i = bisect.bisect_left(gaps, length)
            gap = gaps.pop(i) if i < len(gaps) else capacity
            n += gap == capacity
            bisect.insort(gaps, gap - length)
    return n


R = random.Random(6)
DRAWS = {
    "around a third": lambda: R.gauss(700, 60),
    "uniform": lambda: R.randint(1, 2048),
    "middle": lambda: R.randint(500, 1100),
    "texts": lambda: R.lognormvariate(6, 1),
    "short": lambda: 1 + R.expovariate(1 / 120),
    "few lengths": lambda: R.choice([333, 512, 700, 701, 999, 1025, 1100]),
    "two humps": lambda: R.choice([R.gauss(1300, 100), R.gauss(420, 80)]),
    "long": lambda: 2048 - R.expovariate(1 / 300),
}


@pytest.mark.parametrize("name", DRAWS)
def test_no_worse_than_best_fit(name):
    counts = collections.Counter(min(2048, max(1, int(DRAWS[name]()))) for _ in range(6000))
    plan = packing.plan_packing(dict(counts))
    used = collections.Counter()
    for lengths, n in plan:
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] += n
    assert used == counts
    assert packing.sequences_of(plan) <= best_fit(counts, 2048)


def test_even_fills_beat_best_fit_around_a_third():
    counts = collections.Counter(int(R.gauss(700, 60)) for _ in range(6000))
    assert packing.sequences_of(packing.plan_packing(dict(counts))) < 0.98 * best_fit(counts, 2048)


def test_many_equal_lengths_and_none():
    assert packing.plan_packing({}) == []
    assert packing.sequences_of(packing.plan_packing({700: 1_000_000_001})) == 500_000_001
    assert packing.sequences_of(packing.plan_packing({512: 10**9, 1536: 10**9})) == 10**9
