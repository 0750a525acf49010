"""Secret scans against plain searches of every text; what the derived trigram queries say."""

import collections
import hashlib
import random
import re

import pyarrow as pa
import pytest

from runlens.llm import queries, secrets, tokens
from runlens.llm.secrets import RULES, Rule

from .helpers import SCHEMA, corpus, frame

#: The base rules as they are stated: pattern, group, least length.
STATED = {
    "assign": ("(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]+", 0, 16),
}
PARTS = [
    "token = ", "Password:", "passwd='", "SECRET=", "api_key: \"", "apikey=", "ſecret=", "toKen:", "token", ":", "=", "'", '"', " ", "  ", "\n", "é", "\U0001f600", "abcdef012345", "ABCDEF0123456789", "0123456789abcdef", "deadbeef", "AKIA", "AKIAABCDEFGHIJKLMN", "AKIAABC",
    "ghp_", "a" * 36, "xoxb-", "1234567890-abc", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "eyJhbGciOi", "eyJhbGciOi.eyJzdWIiOi.", ".", "eyJzdWIiOi", "AIza", "B" * 35, "sk_live_", "rk_test_", "x7" * 10, "https://", "user", "hunter22", "@", "bearer ", "Bearer  ",
]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.choice([1, 3, 8, 30]))) for _ in range(n)]


def brute(text, rules=RULES):
    return sorted((a, k, b) for k, rule in enumerate(rules) for a, b in rule.spans(text or ""))


def meets(query, text):
    if query is True:
        return True
    if isinstance(query, bytes):
        return query in text.encode().lower()
    return (all if query[0] == "and" else any)(meets(q, text) for q in query[1])


def test_base_rules_are_those_stated():
    for t in texts(3000, 1):
        for rule in RULES[: secrets.BASE]:
            pattern, group, least = STATED[rule.kind]
            assert list(rule.spans(t)) == [m.span() for m in re.finditer(pattern, t) if len(m.group(group)) >= least]


def test_queries_hold_for_every_match():
    queries_of = [secrets.trigram_query(r) for r in RULES]
    seen = collections.Counter()
    for t in texts(4000, 2):
        for rule, query in zip(RULES, queries_of, strict=True):
            for a, b in rule.spans(t):
                assert meets(query, t[a:b])
                seen[rule.kind] += 1
    assert set(seen) == {r.kind for r in RULES}


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("abc", ["abc"], ["abd"]),
        ("ab?cd", ["abcd", "acd"], ["abd"]),
        ("(?:foo|bar)+baz", ["foobarbaz"], ["foo", "baz"]),
        ("x[0-9]{3}yz", ["x123yz"], []),
        ("(ab){2,}c", ["ababc", "abababc"], ["abc"]),
        ("a[^b]cde", ["axcde"], ["axcd"]),
        ("é+tat", ["éétat"], ["etat"]),
        (r"\bkey(?=:)[:]v", ["key:v"], ["key"]),
        ("(?:a|bc|def)ghi", ["aghi", "defghi"], ["gh"]),
    ],
)
def test_derived_queries(pattern, yes, no):
    query = secrets.trigram_query(Rule("x", pattern))
    assert all(re.search(pattern, t) and meets(query, t) for t in yes)
    assert not any(meets(query, t) for t in no)


@pytest.mark.parametrize("pattern", ["ab", "[0-9a-f]+", "a.b", "(?:abc)?", "abc|x", "(?:abc|x*)", ""])
def test_queries_that_ask_nothing(pattern):
    assert secrets.trigram_query(Rule("x", pattern)) is True


def test_trigrams_across_windows_and_texts(monkeypatch):
    rows = ["xyabc", "ab", None, "c", "", "abcabc", "é" + "ABC", "a" * 40 + "bc"]
    wanted = (b"abc", b"bca", b"\xa9ab", b"aab")
    for window in (1, 2, 7, 1 << 20):
        monkeypatch.setattr(secrets, "WINDOW", window)
        got = secrets.trigram_slots(*tokens.text_bytes(pa.array(rows)), wanted)
        assert [[wanted[i] for i in x] for x in got] == [[w for w in wanted if w in (t or "").encode().lower()] for t in rows]


def documents():
    rows = [(i, t, None) for i, t in enumerate(texts(150, 3))] + [(1000 + i, t, s) for i, t, s in corpus(4)]
    rows += [(None, "token = abcdefghijklmnop", None), (None, None, None), (7, "password=abcdefghijkl", None), (7, "nothing", None)]
    rows += [(2000, "é" * 100_000 + " secret: 'abcdefghijklmnop' " + "0" * 50, None)] * 3
    return rows + [(3000 + i, "the token = f33e61083db5dbdf4bd2369d2f80176e57f7fda2 of many copies", None) for i in range(80)]


@pytest.mark.parametrize("rules", [RULES, RULES[2:3], (RULES[1], Rule("none", "never ever"), Rule("word", "[a-z]+key", 5))], ids=["all", "none looked up", "all looked up"])
def test_against_plain_search(spark, rules):
    rows = documents()
    got = secrets.secret_spans(frame(spark, rows), rules=rules).collect()
    assert collections.Counter((r.doc_id, tuple((s.start, s.kind, s.end) for s in r.spans)) for r in got) == collections.Counter((i, tuple(brute(t, rules))) for i, t, _ in rows)


def test_index_finds_only_texts_that_meet_a_query(spark):
    rows = [(i, t) for i, t in enumerate(texts(200, 9))]
    asked = [secrets.trigram_query(r) for r in RULES]
    trigrams = tuple(sorted(set().union(*map(secrets.trigrams_of, asked))))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "cast(cast(doc_id as string) as binary) as key", "text")
    scanned = secrets.scanned(df, RULES, asked, trigrams)
    found = secrets.candidates(secrets.inverted_index(scanned), asked, trigrams).join(scanned, ["block", "at"]).collect()
    want = {(i, k) for i, t in rows for k, q in enumerate(asked) if q is not True and meets(q, t)}
    assert {(r.doc_id, k) for r in found for k in range(len(RULES)) if r.rules >> k & 1} == want


def test_no_rows(spark):
    assert secrets.secret_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_digests_and_sql(spark, tmp_path):
    from .test_sql import same

    rows = documents()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in secrets.op13_secret_scan(spark, str(tmp_path)).where("doc_id < 150").collect()}
    for i, t, _ in rows[:150]:
        spans = brute(t)
        if i == 7:
            continue
        base = ",".join(f"{RULES[k].kind}:{a}:{b}" for a, k, b in spans if k < 3)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert got[i].spans == ",".join(f"{RULES[k].kind}:{a}:{b}" for a, k, b in spans)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
    same(spark, "op13_secret_scan", tmp_path, ["documents"])
    assert "op13_secret_scan" in queries.QUERIES
