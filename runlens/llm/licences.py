"""Licence scan: a trained paragraph classifier, confirmed by templates.

Paragraphs are the lines of a text and, so that wrapped notices are read as a
whole, its blocks of several lines: lines between blank ones, joined by spaces.
A block is scored as a whole and by sentences, since it may state more than one
licence.  Features are the word n-grams (one to three words) that contain an
anchor word, and anchors are all words of the training texts but the function
words.  A sparse multinomial logistic regression over these n-grams gives each
licence family and an unknown class a probability.  The unknown class is trained
on other licences as well as on texts that state none, and the temperature is
that which suits templates best that the fit has not seen.  A family counts as
found where it is likely enough and one of its templates is contained in the
paragraph for the larger part.

Texts that hold none of the ``gate`` words are not looked at further.  These
words follow from the templates: without them a text holds less than
``LEAST_CONTAINED`` of any template's word pairs, so nothing of it could be
confirmed.  Everything on texts is in DataFrame functions; the model is fitted
on the fixed texts below, a few hundred short ones.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents, row_key

#: Usual statements of licence families; the classifier's training texts and templates.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2.0",
        "this project is licensed under the apache license 2.0",
        "released under the apache 2.0 license",
        "apache 2.0 or mit",
        "mit or apache 2.0",
        "dual licensed under mit and apache 2.0",
        "distributed under the terms of the apache license",
        "spdx license identifier apache 2.0",
        "licensed under the apache license version 2.0 you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    ],
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "this software is available under the terms of the mit license",
        "distributed under the terms of the mit license",
        "this file is under the mit license",
        "spdx license identifier mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "bsd": [
        "licensed under the bsd license",
        "released under the 3 clause bsd license",
        "this code is under the new bsd license",
        "distributed under the terms of the bsd license",
        "bsd 2 clause",
        "bsd 3 clause",
        "spdx license identifier bsd 3 clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 2",
        "released under the gpl version 3",
        "gpl version 2",
        "gpl version 3",
        "lgpl version 2.1",
        "lgpl version 3",
        "agpl version 3",
        "spdx license identifier gpl 3.0 or later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "licensed under the gnu affero general public license version 3",
        "licensed under the gnu lesser general public license version 2.1",
    ],
    "cc-by": [
        "licensed under cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
        "available under the creative commons attribution license",
        "licensed under cc by sa 4.0",
        "text is available under the creative commons attribution sharealike license",
    ],
    "cc-by-nc": [
        "licensed under cc by nc 4.0",
        "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
        "available under the creative commons attribution noncommercial license",
        "licensed under cc by nc sa 4.0",
        "licensed under cc by nc nd 4.0",
    ],
    "public-domain": [
        "this work is dedicated to the public domain under cc0 1.0",
        "released into the public domain",
        "to the extent possible under law the author has waived all copyright and related rights to this work",
        "spdx license identifier cc0 1.0",
        "cc0 1.0",
        "cc0 1.0 universal",
    ],
    "proprietary": [
        "all rights reserved",
        "copyright 2020 example inc all rights reserved",
        "no part of this publication may be reproduced without the prior written permission of the publisher",
        "unauthorized copying of this file is strictly prohibited proprietary and confidential",
    ],
}
#: Texts with legal words that state no licence; they train the unknown class.
OTHERS = [
    "the driver had no license and the car was towed", "she lost her driving license on the way home", "a fishing license costs ten dollars a year",
    "the license plate was found in the garden", "the bar lost its liquor license last year", "permission to leave was granted by the captain",
    "he asked for permission to speak", "the warranty of this product covers two years", "copyright law is a difficult subject for students",
    "a lecture on copyright in the digital age", "the public domain of knowledge is growing", "redistribution of wealth was debated in parliament",
    "civil rights were on the agenda", "human rights are for all", "the apache helicopter landed", "students of mit won the prize", "the general public was invited",
    "seats are reserved for members", "proprietary trading desks were closed", "the software was distributed on disks", "attribution of the painting is disputed",
    "the commons voted on the bill", "our license fees have doubled", "license renewal forms are in the office", "a copy of the letter was attached",
    "poetic license is allowed here", "the permission slip must be signed by a parent", "she waived her rights to appeal", "reserved rooms are on the left",
]
#: Statements of licences of no family above; they train the unknown class too.
OTHER_LICENCES = [
    "licensed under the mozilla public license version 2.0", "this source code form is subject to the terms of the mozilla public license v. 2.0", "mozilla public license version 2.0",
    "licensed under the eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0",
    "released under the microsoft public license", "licensed under the european union public licence version 1.2", "distributed under the boost software license version 1.0",
    "released under the zlib license", "released under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "available under the artistic license 2.0", "licensed under the academic free license version 3.0", "licensed under the open software license version 3.0",
    "the contents of this file are subject to the terms of the common development and distribution license", "licensed under the python software foundation license version 2",
    "this font software is licensed under the sil open font license version 1.1", "made available under the open database license", "licensed under the server side public license version 1",
    "use of this software is governed by the business source license 1.1", "licensed under the elastic license 2.0", "released under the postgresql license", "spdx license identifier mpl 2.0",
    "spdx license identifier epl 2.0", "spdx license identifier isc", "licensed under the universal permissive license", "released under the beerware license", "licensed under the educational community license version 2.0",
]
UNKNOWN = "unknown"
FAMILIES = [*TEMPLATES, UNKNOWN]
#: Words that state nothing by themselves; n-grams of these alone are no features.
FUNCTION_WORDS = set("a all an and any are as at be been by for from had has have he her his if in into is it its may must no not nd of off on or our she that the their there this to under was were with you your".split())
#: Least probability of a family, and least share of a template's word pairs in the paragraph.
LEAST_PROBABILITY, LEAST_CONTAINED = 0.5, 0.6
ROUNDS, STEP, LASSO = 300, 0.5, 2e-4
#: Parts of the templates that are held out in turn.
FOLDS = 4
#: What is between words, but line ends.
TOKEN = r"[^\p{L}\p{N}.\n]+|\.(?![\p{N}])|(?<![\p{N}])\."
#: Ends of sentences.
SENTENCE = r"(?<=[.!?])\s+"
KEY = ["own", "doc_id", "paragraph", "unit"]
#: GPLv2, LGPLv2.1 and the like are two words and a number.
VERSIONED = r"(?<=gpl)v(?=[0-9])"
#: Two spellings of one word.
BRITISH, AMERICAN = "licence", "license"


def tokens_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits; points inside numbers stay."""
    return [w for w in re.split(r"[^\w.]+|_|\.(?!\d)|(?<!\d)\.", re.sub(VERSIONED, " version ", text.lower().replace(BRITISH, AMERICAN))) if w]


#: Words around which n-grams are features.
ANCHORS = {w for t in [*OTHERS, *OTHER_LICENCES, *(t for texts in TEMPLATES.values() for t in texts)] for w in tokens_of(t)} - FUNCTION_WORDS


def ngrams(tokens: list[str]) -> set[str]:
    """N-grams of one to three words with an anchor."""
    return {" ".join(g) for n in (1, 2, 3) for i in range(len(tokens) - n + 1) if ANCHORS & set(g := tokens[i : i + n])}


@functools.lru_cache(1)
def gate() -> tuple[str, ...]:
    """Words such that a text without any of them holds less than LEAST_CONTAINED of every template's word pairs.

    Chosen one by one: that which covers most of what is still needed, for its
    length (short words are found in many texts).
    """
    pairs = [list(zip(t, t[1:], strict=False)) for texts in TEMPLATES.values() for t in map(tokens_of, texts)]
    #: pairs of each template that some word has to cover: so many that fewer than LEAST_CONTAINED are left
    need = [math.floor((1 - LEAST_CONTAINED) * len(p) + 1e-9) + 1 for p in pairs]
    chosen: list[str] = []
    while any(n > 0 for n in need):
        gain: Counter = Counter()
        for p, n in zip(pairs, need, strict=True):
            if n > 0:
                for w, k in Counter(w for x in p for w in {*x} & ANCHORS).items():
                    gain[w] += min(n, k)
        best = max(sorted(gain), key=lambda w: gain[w] * (1.0 if len(w) > 5 else 0.5 if len(w) > 3 else 0.1))
        chosen.append(best)
        need = [n - sum(best in x for x in p) for p, n in zip(pairs, need, strict=True)]
        pairs = [[x for x in p if best not in x] for p in pairs]
    return tuple(chosen)


def variants(text: str) -> list[str]:
    """A text, framed by other words, with a name or year before it, and without single words."""
    words = text.split()
    shorter = [" ".join(words[:i] + words[i + 1 :]) for i in range(1, len(words), 3)] if len(words) > 5 else []
    return [text, f"note that {text}", f"copyright 2021 jane doe {text}", f"{text} see the file for details", *shorter]


def soft(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Texts:
    """Training texts as places of their n-grams, the last place being the bias."""

    def __init__(self, texts: list[str], vocabulary: dict[str, int]):
        rows = [[*(vocabulary[g] for g in ngrams(tokens_of(t)) if g in vocabulary), len(vocabulary)] for t in texts]
        self.place = np.concatenate([np.array(r) for r in rows])
        self.starts = np.cumsum([0, *map(len, rows[:-1])])
        self.owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.place], self.starts, axis=0)


def fitted(texts: list[str], y: np.ndarray, vocabulary: dict[str, int]) -> np.ndarray:
    """Weights (n-grams and bias, families) of a multinomial regression; proximal steps keep weights that do not pay at zero."""
    x = Texts(texts, vocabulary)
    w = np.zeros((len(vocabulary) + 1, y.shape[1]))
    for _ in range(ROUNDS):
        slope = (soft(x.scores(w)) - y)[x.owner]
        w -= STEP / len(texts) * np.stack([np.bincount(x.place, slope[:, k], len(w)) for k in range(y.shape[1])], 1)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - STEP * LASSO, 0)
    return w


@functools.lru_cache(1)
def model() -> tuple[dict[str, list[float]], list[float]]:
    """(n-gram -> weight of each family, bias of each family), at the calibrated temperature.

    Templates are held out in turn with all their variants; the temperature is
    the one that gives those the best log likelihood, and the weights are then
    fitted on all.
    """
    groups = [(t, k, variants(t)) for k, name in enumerate(TEMPLATES) for t in TEMPLATES[name]]
    groups += [(t, len(TEMPLATES), [t, f"note that {t}", f"{t} see the file for details"]) for t in [*OTHERS, *OTHER_LICENCES]]
    texts = [v for _, _, own in groups for v in own]
    y = np.eye(len(FAMILIES))[[k for _, k, own in groups for _ in own]]
    fold = np.array([i % FOLDS for i, (_, _, own) in enumerate(groups) for _ in own])
    vocabulary = {g: i for i, g in enumerate(sorted(set().union(*(ngrams(tokens_of(t)) for t in texts))))}
    unseen = np.zeros_like(y)
    for k in range(FOLDS):
        w = fitted([t for t, f in zip(texts, fold, strict=True) if f != k], y[fold != k], vocabulary)
        unseen[fold == k] = Texts([t for t, f in zip(texts, fold, strict=True) if f == k], vocabulary).scores(w)
    loss = {t: -np.log(np.maximum((soft(unseen / t) * y).sum(1), 1e-12)).mean() for t in np.arange(0.2, 5.01, 0.1)}
    w = fitted(texts, y, vocabulary) / min(loss, key=loss.get)
    return {g: w[i].tolist() for g, i in vocabulary.items() if w[i].any()}, w[-1].tolist()


def versioned(text: Column) -> Column:
    """The lower-cased text with GPLv2 and the like in words, and in one spelling."""
    low = F.replace(F.lower(text), F.lit(BRITISH), F.lit(AMERICAN))
    return F.when(low.contains("gpl"), F.regexp_replace(low, VERSIONED, " version ")).otherwise(low)


def grams_column(tokens: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Distinct n-grams of an array of words."""
    of = lambda n: F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))
    return F.array_distinct(F.concat(*[F.when(F.size(tokens) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in sizes]))


def units_of(text: Column) -> Column:
    """Array of (paragraph, unit, words) of a text: its lines, its blocks of several lines, their sentences; all that have an anchor.

    ``paragraph`` is the line, from 0, with which the unit starts (a sentence
    has that of its block); ``unit`` is -2 for a line, -1 for a block, else the
    sentence's number.  Lines without letters and digits separate blocks; a
    block of one sentence is not repeated as such.
    """
    once = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  # a lambda's variable is evaluated once
    unit = lambda at, n, words: F.struct(at.alias("paragraph"), n.cast("int").alias("unit"), words.alias("words"))
    anchors = F.array(*map(F.lit, sorted(ANCHORS)))
    split = lambda x: F.array_remove(F.split(x, " ", -1), "")
    plain = lambda x: F.regexp_replace(x, TOKEN, " ")

    def blocks(words: Column, hit: Column) -> Column:
        solid = lambda i: F.coalesce(F.size(F.get(words, i)) > 0, F.lit(False))
        places = F.sequence(F.lit(0), F.size(words) - 1)
        starts, ends = F.filter(places, lambda i: solid(i) & ~solid(i - 1)), F.filter(places, lambda i: solid(i) & ~solid(i + 1))
        spans = F.zip_with(starts, ends, lambda a, b: F.struct((a + 1).alias("a"), (b - a + 1).alias("n")))
        return F.filter(spans, lambda x: (x["n"] > 1) & F.exists(F.slice(hit, x["a"], x["n"]), lambda h: h))

    def sentences(x: Column, lines: Column) -> Column:
        parts = F.split(F.array_join(F.slice(lines, x["a"], x["n"]), " "), SENTENCE)
        return once(parts, lambda p: F.when(F.size(p) > 1, F.transform(p, lambda w, n: unit(x["a"] - 1, n, split(plain(w))))).otherwise(F.slice(F.transform(p, lambda w, n: unit(x["a"] - 1, n, split(w))), 1, 0)))

    def units(lines: Column, words: Column, hit: Column) -> Column:
        single = F.transform(words, lambda w, i: unit(i, F.lit(-2), w))
        joined = lambda spans: F.transform(spans, lambda x: unit(x["a"] - 1, F.lit(-1), F.flatten(F.slice(words, x["a"], x["n"]))))
        parts = lambda spans: F.flatten(F.transform(spans, lambda x: sentences(x, lines)))
        found = once(blocks(words, hit), lambda spans: F.concat(joined(spans), F.filter(parts(spans), lambda x: F.arrays_overlap(x["words"], anchors))))
        return F.concat(F.filter(single, lambda x: F.get(hit, x["paragraph"])), found)

    def read(low: Column) -> Column:
        words = F.transform(F.split(plain(low), "\n", -1), split)
        return once(words, lambda w: once(F.transform(w, lambda x: F.arrays_overlap(x, anchors)), lambda hit: F.when(F.exists(hit, lambda h: h), once(F.split(low, "\n", -1), lambda lines: units(lines, w, hit)))))

    return once(versioned(text), read)


def gated(text: Column) -> Column:
    """Whether a text holds a gate word, also as part of a longer one and in either spelling; GPLv2 stands for "gpl version 2"."""
    low = F.lower(text)
    found = low.contains("gpl")
    for w in gate():
        found |= low.contains(w)
        if AMERICAN in w:
            found |= low.contains(w.replace(AMERICAN, BRITISH))
    return found


def licence_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_PROBABILITY, contained: float = LEAST_CONTAINED) -> DataFrame:
    """(own, doc_id, paragraph, unit, family, probability, template_share, confirmed) of every line, block and sentence with an anchor, of texts with a gate word.

    ``paragraph`` and ``unit`` are those of ``units_of``.  ``family`` is unknown
    where no family is likely enough; ``confirmed`` where a template agrees.
    Null and empty texts have no paragraphs.  Rows that are alike in id and text
    count once; ``own`` is their key.  Other columns are not read.
    """
    spark = docs.sparkSession
    weights, bias = model()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).where(gated(F.col("text")))
    rows = rows.withColumn("own", row_key(F.col("doc_id"), F.col("text")))
    # for the outer forms Spark infers no filters that would evaluate the arrays again
    units = rows.select("own", "doc_id", F.inline_outer(units_of(F.col("text")))).where("paragraph is not null")
    grams = units.select(*KEY, F.explode_outer(grams_column(F.col("words"))).alias("gram"))

    # fixed templates only: a few thousand short rows; every anchor is one, so that each unit has a row
    pairs = [(k, {" ".join(p) for p in zip(tokens_of(t), tokens_of(t)[1:], strict=False)}) for k, name in enumerate(TEMPLATES) for t in TEMPLATES[name]]
    known = sorted(ANCHORS.union(weights, *(p for _, p in pairs)))
    zero = [0.0] * len(FAMILIES)
    table = spark.createDataFrame([(i, g, weights.get(g, zero), [j for j, (_, p) in enumerate(pairs) if g in p]) for i, g in enumerate(known)], "g int, gram string, w array<double>, t array<int>")
    grams = grams.join(F.broadcast(table.select("g", "gram")), "gram").select(*KEY, "g").distinct().join(F.broadcast(table.drop("gram")), "g")
    sums = grams.groupBy(*KEY).agg(*[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(FAMILIES))], F.flatten(F.collect_list("t")).alias("t"))
    scores = F.array(*[F.struct((F.col(f"s{k}") + F.lit(bias[k])).alias("s"), F.lit(name).alias("family")) for k, name in enumerate(FAMILIES)])
    scored = sums.select(*KEY, "t", scores.alias("scores")).withColumn("best", F.array_max("scores"))
    mass = F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x["s"] - F.col("best.s")))
    shares = F.array(*[F.struct(F.lit(FAMILIES[k]).alias("family"), F.lit(j).alias("j"), F.lit(len(p)).alias("n")) for j, (k, p) in enumerate(pairs)])
    shares = F.transform(F.filter(shares, lambda x: x["family"] == F.col("best.family")), lambda x: F.size(F.filter("t", lambda y: y == x["j"])) / x["n"])
    out = scored.select(*KEY, F.col("best.family").alias("family"), (1 / mass).alias("probability"), F.coalesce(F.array_max(shares), F.lit(0.0)).alias("template_share"))
    out = out.withColumn("family", F.when(F.col("probability") >= least, F.col("family")).otherwise(UNKNOWN))
    return out.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("template_share") >= contained))


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, n_candidates, n_confirmed, families) of every row.

    ``n_paragraphs`` are the lines with a word; ``n_candidates`` those that have
    an anchor or start a block with one, in texts with a gate word;
    ``n_confirmed`` those that state a licence or start a block that does.
    ``families`` are the confirmed ones, sorted, joined by commas; "" if none.
    Null texts have no paragraphs.  Rows are judged each by its own text, also
    where ids repeat or are null.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    found = licence_paragraphs(rows).groupBy("own").agg(F.size(F.collect_set("paragraph")).cast("long").alias("n_candidates"), F.size(F.collect_set(F.when(F.col("confirmed"), F.col("paragraph")))).cast("long").alias("n_confirmed"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"))
    lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = rows.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("own"), lines.cast("long").alias("n_paragraphs")).join(found, "own", "left")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families that the paragraphs of every document state."""
    return licence_scan(read_documents(spark, sf_dir))
