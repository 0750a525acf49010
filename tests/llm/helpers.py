"""Fixtures and plain loops that the operators must agree with."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, key string, bucket long, row string"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def corpus(seed=1, n=120):
    """(doc_id, text, source): random texts, copies, near copies, shared passages, odd texts, ties."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(300)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    texts = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 5, 12, 13, 40, 200]))]
        if i % 7 == 0:
            at = r.randint(0, len(words))
            words[at:at] = passage[r.randint(0, 20) :]
        if i % 5 == 0 and texts:
            words = texts[r.randrange(len(texts))].split()
            for _ in range(r.choice([0, 0, 1, 2])):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append(" ".join(w + ("\n" if r.random() < 0.05 else "") for w in words))
    texts += ["", "   \n\t ", None, None, "Same Text here", "same text HERE", "übergröße ß é", "x" * 5000, "a b c\x0bd", ("one two three four five six seven " * 400), "\\ ### <|endoftext|> </turn>"]
    return [(i, t, None if i % 11 == 0 else f"s{i % 17}") for i, t in enumerate(texts)]


def frame(spark, rows):
    """Documents with more columns than asked for, named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "w", "k", 7, "r") for i, t, s in rows], SCHEMA).repartition(5)


def words(text):
    return (text or "").encode().split()
