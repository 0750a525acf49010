"""The corpus pipeline: classify, drop boilerplate lines, dedup near copies, cut repeated passages, pack.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``.  All but the last return the columns that they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import lines, minhash, ordinal, packing, substring
from runlens.llm.common import row_key, written

#: A character of a word.
WORD = r"[^\x20\x09-\x0D]"


def with_text(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``kept`` (kept_text, row): the text is the kept one; n_chars, if there, follows."""
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def rows_of(kept: DataFrame) -> DataFrame:
    """The columns of the struct ``row``."""
    return kept.select("row.*")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects, null and empty texts among them.

    Each row is judged by its own text; a null or repeated id changes nothing.
    """
    model = ordinal.fit_on(docs, ordinal.graded(spark, sf_dir), 3)
    return rows_of(ordinal.ordinal_scores(docs, model, carry=docs.columns).where("kept"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that are found on many sites; every row stays, null texts null."""
    return with_text(docs, lines.line_dedup(docs, carry=[c for c in docs.columns if c != "text"]))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that with the smallest id.

    Rows are linked each by its own text.  Where several rows of a group have
    that id, or none has one, the row with the smallest key of id and text
    stays, and of rows alike in both the one whose other columns hash lowest.
    Texts without words are in no group; they all stay.
    """
    kept = minhash.near_components(docs).where("kept")
    chosen = kept.where("component is not null").groupBy("component").agg(F.min("own").alias("_own")).select("_own")
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_key(F.col("doc_id").cast("long"), F.col("text")).alias("_own"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("_words"))
    ones = rows.where("_words").join(chosen, "_own", "left_semi").groupBy("_own").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rows_of(ones.select("row").unionByName(rows.where("not _words").select("row")))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; every row stays, and untouched texts as they are, null ones null."""
    return with_text(docs, substring.substring_dedup(docs, carry=[c for c in docs.columns if c != "text"], as_is=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token sequences of all remaining documents; null texts are empty, repeated rows are packed as often as they come."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", drop_lines),
    ("minhash_dedup", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("best_fit_packing", pack),
]

#: The classifier's fit and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
