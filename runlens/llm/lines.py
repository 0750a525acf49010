"""Line dedup by the number of distinct sites that a line is found on.

Each line's sites go into a HyperLogLog sketch, merged by Spark's aggregation;
only lines whose estimate is near the threshold get an exact count of distinct
sites.  Lines spread over enough sites are boilerplate and are removed, except
from documents in which no line with a word would remain: those are copies as a
whole and a matter of document-level dedup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents, row_key, written

#: A line found on so many distinct sites is boilerplate.
MIN_SITES = 10
#: log2 of the sketch's registers; below some hundred sites it is nearly exact.
REGISTERS = 12
#: Estimates within this share of the threshold are counted exactly: over ten standard errors of the sketch.
BAND = 0.2
#: So many boilerplate lines (16 bytes each) are sent to all executors; more are joined by shuffle.
BROADCAST_LINES = 200_000


def text_lines(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` and (at, line, key) of every line with a word of ``text``."""
    lines = rows.select(*columns, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("key", F.unhex(F.md5(F.col("line").cast("binary"))))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Keys of the lines (key, site) that are on at least ``min_sites`` distinct sites."""
    sketches = lines.groupBy("key").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(REGISTERS)).alias("sketch")).where(F.col("n") >= min_sites)
    sites = sketches.select("key", F.hll_sketch_estimate("sketch").alias("sites"))
    far = sites.where(F.col("sites") > min_sites * (1 + BAND)).select("key")
    near = sites.where(F.col("sites").between(min_sites * (1 - BAND), min_sites * (1 + BAND))).select("key")
    exact = lines.select("key", "site").distinct().join(near, "key", "left_semi").groupBy("key").agg(F.count("*").alias("sites"))
    return far.unionByName(exact.where(F.col("sites") >= min_sites).select("key"))


def without(text: Column, marks: Column) -> Column:
    """The text without the lines at the marked places."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(marks, i)), "\n")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, max_share: float | None = None, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_text) of every row.

    Lines are compared as they are; lines without a word are never removed or
    counted.  A null site is a site of its own, "".  Null and empty texts have
    no lines and stay null or empty.  Rows are judged each by its own text, also
    where ids repeat or are null.  Texts with no other lines than those to
    remove are kept whole and so are, if ``max_share`` is given, texts with a
    larger share of their characters in such lines.  Columns named in ``carry``
    come along in a struct ``row``; others are not read.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.coalesce(docs[site_col].cast("string"), F.lit("")).alias("site"), F.struct(*[docs[c] for c in carry or [id_col]]).alias("row"))
    rows = rows.withColumn("own", row_key(F.col("doc_id"), F.col("text")))
    spread = written(spread_lines(text_lines(rows, "site").select("key", "site"), min_sites), "spread-lines")
    few = spread.count() <= BROADCAST_LINES
    # written, so that the larger side of the join is a shuffle of its own, whose hot lines Spark can split
    hits = text_lines(rows, "own").select("own", "at", "key", F.length("line").alias("chars")).join(F.broadcast(spread) if few else spread, "key")
    # rows that are alike share these places
    marks = hits.groupBy("own").agg(F.collect_set(F.struct("at", "chars")).alias("hits"))
    marks = marks.select("own", F.col("hits.at").alias("marks"), F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("marked"))
    total = F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("")))
    counted = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    cut = F.size("marks") < counted
    if max_share is not None:
        cut &= F.col("marked") <= max_share * total
    out = rows.join(marks, "own", "left").withColumn("cut", F.col("marks").isNotNull() & F.coalesce(cut, F.lit(False)))
    return out.select(
        "doc_id",
        counted.cast("long").alias("n_lines"),
        F.when(F.col("cut"), F.size("marks")).otherwise(0).cast("long").alias("n_removed"),
        F.when(F.col("cut"), without(F.col("text"), F.col("marks"))).otherwise(F.col("text")).alias("kept_text"),
        *(["row"] if carry else []),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document after removal of lines found on ten sites or more."""
    out = line_dedup(read_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.length("kept_text").cast("long").alias("kept_chars"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: The same rule with exact counts only; documents of nothing else than spread lines are kept whole.
LINE_DEDUP_SQL = r"""
with docs as (
  select row_number() over () as own, doc_id, text, coalesce(source, '') as site from documents
), line as (
  select own, site, u.place, u.line as line
  from docs, lateral (
    select unnest(string_split(coalesce(text, ''), chr(10))) as line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as place) u
), solid as (
  select * from line where regexp_matches(line, '[^\x20\x09-\x0D]')
), counted as (
  select own, count(*) as n from solid group by own
), spread as (
  select line from solid group by line having count(distinct site) >= 10
), hit as (
  select own, place from solid where line in (select line from spread)
), judged as (
  select own, m.n from (select own, count(*) as n from hit group by own) m join counted c using (own) where m.n < c.n
), kept as (
  select own, string_agg(line, chr(10) order by place) as text
  from line l where not exists (select 1 from hit r join judged j using (own) where r.own = l.own and r.place = l.place) group by own
)
select d.doc_id,
       coalesce(c.n, 0) as n_lines,
       coalesce(j.n, 0) as n_removed,
       length(case when d.text is null then null else coalesce(k.text, '') end) as kept_chars,
       sha256(case when d.text is null then null else coalesce(k.text, '') end) as kept_sha256
from docs d left join kept k using (own) left join counted c using (own) left join judged j using (own)
"""
