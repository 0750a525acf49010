"""Quality rules as weak supervision.

Each rule looks at counts of a text and votes good, bad or abstains.  The
patterns of votes of texts that pass the base filter are counted (at most
3 ** rules rows, whatever the corpus); expectation-maximisation on these counts
estimates how many texts are good and how often each rule is right on good and
on bad ones, and the posterior probability of good, an expression of the votes,
decides.  All work on texts is in SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, read_documents, words_of, written

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Most rounds of expectation-maximisation.
ROUNDS = 500
#: At first each rule is taken to be right so often, on good and on bad texts; this alone says which class is the good one.
START = 0.7
#: Votes at that rate that are added to those seen, so that a rule that hardly votes keeps it.
ADDED = 2.0


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words in windows of ``width`` words that are found twice or more in the text.

    Windows are compared by 64-bit hashes within one text; hashes are sorted
    only in texts that have an equal pair.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        steps = let(starts, lambda p: F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def windows(hashed: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashed) - width), lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(width)]))

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    some = let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashed: let(windows(hashed), counted))
    return F.when(F.size(words) >= width, some).otherwise(F.lit(0))


def counts_of(text: Column) -> dict[str, Column]:
    """The counts that base filter and rules look at; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    solid = F.translate(text, SPACE_CHARS, "")
    words = words_of(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words),
        "word_chars": F.length(solid),
        "n_symbols": F.length(solid) - F.length(F.translate(solid, SYMBOLS, "")),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": let(words, lambda w: repeated_words(w)),
        "n_lines": F.size(lines),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "n_letters": F.length(solid) - F.length(F.regexp_replace(solid, r"\p{L}+", "")),
        "n_ends": F.regexp_count(text, F.lit(r"[.!?](?=[\x20\x09-\x0D]|\z)")),
        "n_line_ends": F.size(F.filter(lines, lambda x: x.rlike(r"[.!?][\"')]?[\x20\x09-\x0D]*\z"))),
        "n_distinct": F.size(F.array_distinct(words)),
    }


def share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


def votes() -> dict[str, Column]:
    """rule -> 1 (good), 0 (bad) or null (abstains); every rule can say all three, and none is the base filter."""

    def rule(value: Column, bad, good) -> Column:
        return F.when(bad(value), 0).when(good(value), 1)

    within = lambda a, b: lambda x: x.between(a, b)
    outside = lambda a, b: lambda x: (x < a) | (x > b)
    below, above = lambda a: lambda x: x < a, lambda a: lambda x: x > a
    lines = share("n_dup_lines", "n_lines")
    return {
        "word_length": rule(share("word_chars", "n_words"), outside(4.2, 6.8), within(4.5, 6.0)),
        "few_symbols": rule(share("n_symbols", "word_chars"), above(0.02), below(0.002)),
        "letters": rule(share("n_letters", "word_chars"), below(0.9), above(0.95)),
        "capitals": rule(share("n_upper", "word_chars"), above(0.2), within(0.003, 0.06)),
        "sentences": rule(share("n_ends", "n_words"), below(0.04), above(0.055)),
        "line_ends": rule(share("n_line_ends", "n_lines"), below(0.9), above(0.98)),
        "own_lines": rule(lines, above(0.2), lambda x: x == 0),
        "own_phrases": rule(share("n_repeat_words", "n_words"), above(0.1), lambda x: x == 0),
        "own_words": rule(share("n_distinct", "n_words"), below(0.5), above(0.65)),
    }


@dataclass
class Estimate:
    """Share of good texts, and how often each rule's votes are right on good and on bad ones."""

    prior: float
    on_good: np.ndarray
    on_bad: np.ndarray

    def weights(self) -> tuple[float, np.ndarray, np.ndarray]:
        """(log odds of good, what a rule's vote for good adds to it, what a vote for bad adds)."""
        return float(np.log(self.prior / (1 - self.prior))), np.log(self.on_good / (1 - self.on_bad)), np.log((1 - self.on_good) / self.on_bad)


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], rules: int) -> Estimate:
    """Expectation-maximisation over (votes, number of texts).

    Rules are taken as independent within a class, and abstaining says nothing.
    It starts from even classes and rules that are right in START of their
    votes; nothing else ties the classes to their names.  No patterns: the start.
    """
    good = np.array([[x == 1 for x in v] for v, _ in patterns], float).reshape(-1, rules)
    bad = np.array([[x == 0 for x in v] for v, _ in patterns], float).reshape(-1, rules)
    n = np.array([k for _, k in patterns], float)
    now = Estimate(0.5, np.full(rules, START), np.full(rules, START))
    for _ in range(ROUNDS if len(n) else 0):
        odds, up, down = now.weights()
        belief = 1 / (1 + np.exp(-np.clip(odds + good @ up + bad @ down, -500, 500)))
        of_good, of_bad = n * belief, n * (1 - belief)
        last, now = now, Estimate(
            (of_good.sum() + 1) / (n.sum() + 2),
            (of_good @ good + START * ADDED) / (of_good @ (good + bad) + ADDED),
            (of_bad @ bad + START * ADDED) / (of_bad @ (good + bad) + ADDED),
        )
        if max(abs(now.prior - last.prior), *abs(now.on_good - last.on_good), *abs(now.on_bad - last.on_bad)) < 1e-9:
            break
    return now


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, counts, votes, base_failed, quality, kept) of every row.

    ``quality`` is the posterior probability of good; kept rows pass the base
    filter and reach ``least``.  Null and empty texts have no words and fail
    the base filter.  Repeated rows stay, each judged alike; null ids are as
    any other; other columns are not read; an empty table gives no rows.
    """
    counts = counts_of(F.col("text"))
    rules = votes()
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).select("doc_id", *[c.cast("long").alias(k) for k, c in counts.items()])
    rows = written(rows.select("*", *[c.cast("int").alias(k) for k, c in rules.items()], failed.alias("base_failed")), "votes")
    seen = rows.where("not base_failed").groupBy(*rules).agg(F.count("*").alias("n")).collect()  # at most 3 ** len(rules) rows
    odds, up, down = estimate([(tuple(r[k] for k in rules), r["n"]) for r in seen], len(rules)).weights()
    total = F.lit(odds)
    for name, a, b in zip(rules, up.tolist(), down.tolist(), strict=True):
        total = total + F.when(F.col(name) == 1, a).when(F.col(name) == 0, b).otherwise(0.0)
    rows = rows.withColumn("quality", 1 / (1 + F.exp(-total)))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, posterior quality and verdict of every document."""
    return quality_rules(read_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
