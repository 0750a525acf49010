"""Chat formatting of reply trees.

Messages form trees by parent ids.  Self-joins that double the known part of
each path (after k rounds every message knows its ancestor at distance 2**k)
score the root-to-leaf paths; branches are ranked, the chosen paths are listed
by the same doubling, and each is written as one conversation.

Template: a turn is ``### `` + role + ``:`` + newline + text + newline +
``</turn>`` + newline; inside role and text every ``\\``, ``#`` and ``<`` gets a
backslash before it, so no control string can occur there and the text is read
back by dropping those backslashes.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, ship_package, written

OPEN, CLOSE = "### ", "\n</turn>\n"
#: A whole turn; control strings cannot occur inside role or text.
TURN = re.compile(r"### ((?:[^\\#<\n:]|\\.)*):\n((?:[^\\#<]|\\.)*)\n</turn>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: Column, more: str = "") -> Column:
    """A backslash before each control character."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"([\\#<{more}])", r"\\$1")


def reply_paths(messages: DataFrame, tree: str = "tree_id", node: str = "node_id", parent: str = "parent_id", score: str = "score", keep: int | None = 1) -> DataFrame:
    """(tree, leaf, branch, depth, node): the messages of the ``keep`` best paths of each tree.

    A path's score is the sum of its messages' scores (null: 0); branches rank
    by it, ties go to the smaller leaf id; ``keep=None`` gives all paths.  A
    message whose parent is null or absent is a root.  Of rows that repeat a
    (tree, node) one is used, that with the smallest parent and score.  Rows
    with a null tree or node are left out: number such messages first.  A cycle
    has no root, so neither it nor a chain behind it gives a path.

    Leaves are scored and ranked before any path is listed: scores are summed
    along ancestors at doubling distances, one row a message.
    """
    rows = messages.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"))
    rows = rows.where("tree is not null and node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", "score")).alias("m")).select("tree", "node", "m.parent", "m.score")
    known = rows.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    rows = rows.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("far"), F.col("score").alias("total"))
    # round k: far is the ancestor at distance 2 ** k, null beyond the root; total and length are those of the way there
    rows = written(rows.withColumn("length", F.when(F.col("far").isNull(), 0).otherwise(1)), "messages")
    most = rows.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    rounds, parts = [], [rows.where("far is null")]  # parts: messages whose root is reached
    active = rows.where("far is not null")
    for _ in range(most.bit_length()):  # no path is longer than its tree
        if active.isEmpty():
            break
        rounds.append(active.select("tree", "node", "far"))
        # only trees that go on are looked at
        known = functools.reduce(DataFrame.unionByName, [*parts, active]).join(active.select("tree").distinct(), "tree", "left_semi")
        there = known.select("tree", F.col("node").alias("far"), F.col("far").alias("next"), F.col("total").alias("more"), F.col("length").alias("further"))
        moved = active.join(there, ["tree", "far"]).select("tree", "node", F.col("next").alias("far"), (F.col("total") + F.col("more")).alias("total"), (F.col("length") + F.col("further")).alias("length"))
        moved = written(moved, "ancestors")
        parts.append(moved.where("far is null"))
        active = moved.where("far is not null")  # what is left at the end has a cycle ahead
    parents = rows.where("far is not null").select("tree", F.col("far").alias("node"))
    totals = functools.reduce(DataFrame.unionByName, parts).join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "total", "length")
    if keep == 1:
        best = totals.groupBy("tree").agg(F.min(F.struct((-F.col("total")).alias("o"), "leaf", "length")).alias("b")).select("tree", "b.leaf", "b.length", F.lit(1).alias("branch"))
    else:
        order = W.partitionBy("tree").orderBy(F.desc("total"), "leaf")
        best = totals.withColumn("branch", F.row_number().over(order)).drop("total")
        best = best if keep is None else best.where(F.col("branch") <= keep)
    up = best.select("tree", "leaf", "branch", F.col("length").alias("depth"), F.col("leaf").alias("node"))
    for k, ahead in enumerate(rounds):  # the nodes nearest to the leaf are there; those 2 ** k further up follow
        more = up.join(ahead, ["tree", "node"]).select("tree", "leaf", "branch", (F.col("depth") - 2**k).alias("depth"), F.col("far").alias("node"))
        up = written(up.unionByName(more), "paths")
    return up


def format_paths(paths: DataFrame, messages: DataFrame, tree: str = "tree_id", node: str = "node_id", role: str = "role", text: str = "text", unique: bool = False) -> DataFrame:
    """(tree, leaf, branch, formatted): one conversation of each path.

    Null role or text: empty.  Of rows that repeat a (tree, node), the smallest
    (role, text) is used; ``unique`` says that none does, so texts need not be
    grouped for it.  A path's messages meet in one row, as they must.
    """
    said = messages.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    told = F.struct("role", "text")
    said = said.select("tree", "node", told.alias("m")) if unique else said.groupBy("tree", "node").agg(F.min(told).alias("m"))
    turn = F.concat(F.lit(OPEN), escape(F.col("m.role"), ":\n"), F.lit(":\n"), escape(F.col("m.text")), F.lit(CLOSE))
    rows = paths.join(said.select("tree", "node", turn.alias("turn")), ["tree", "node"])
    ordered = F.array_sort(F.collect_list(F.struct("depth", "turn")))
    return rows.groupBy("tree", "leaf", "branch").agg(F.array_join(F.transform(ordered, lambda x: x["turn"]), "").alias("formatted"))


def turns_of(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn, texts unescaped; [start, end) is the escaped text's place."""
    return [(ESCAPED.sub(r"\1", m[1]), ESCAPED.sub(r"\1", m[2]), m.start(2), m.end(2)) for m in TURN.finditer(formatted)]


def loss_spans(formatted: str) -> list[tuple[int, int]]:
    """Character spans under the loss mask: the texts of assistant turns."""
    return [(a, b) for role, _, a, b in turns_of(formatted) if role == "assistant"]


def format_trees(messages: DataFrame, tree: str = "tree_id", node: str = "node_id", parent: str = "parent_id", score: str = "score", role: str = "role", text: str = "text", keep: int | None = 1, unique: bool = False) -> DataFrame:
    """(tree, leaf, branch, formatted) of the ``keep`` best branches of each reply tree."""
    return format_paths(reply_paths(messages, tree, node, parent, score, keep), messages, tree, node, role, text, unique)


def conversations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` and conversation -7 as reply trees: each turn answers the one before.

    Every row is a turn.  A conversation's rows are numbered in the order of
    turn (null first), role and text, so rows that repeat a turn follow each
    other; rows with a null id make one conversation, of id null (tree "").
    The score of a message is the length of its text, so the longest branch wins.
    The numbered rows are written once, since paths and texts both read them.
    """
    hard = "\\### Assistant: </turn> ok"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema))
    number = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), number.alias("node"), "role", "text", F.length("text").alias("score"))
    return written(rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)), "turns")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and what is read back from the formatted text."""
    ship_package(spark)
    out = format_trees(conversations_of(spark, sf_dir), "tree", "node", "parent", unique=True).withColumn("conv_id", F.expr("try_cast(tree as bigint)"))

    def batches(source):
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in source:
            columns: tuple[list, ...] = ([], [], [], [], [])
            for formatted in batch.column("formatted").to_pylist():
                turns = turns_of(formatted)
                loss = "".join(ESCAPED.sub(r"\1", formatted[a:b]) for a, b in loss_spans(formatted))
                for c, x in zip(columns, (len(turns), sha("".join(f"{r}\n{t}\n" for r, t, _, _ in turns)), len(loss), sha(loss), len(formatted)), strict=True):
                    c.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return map_batches(out.select("conv_id", "formatted"), batches, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
