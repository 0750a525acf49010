"""Readers: hit files, side tables as text, run configurations, catalogues, logs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from ..functions.scalar import any_run, base_name, file_run, file_subrun, number
from ..operators.features import METRICS, TRIGGER_FEATURES

HITS = T.StructType(
    [T.StructField("event_id", T.LongType())]
    + [T.StructField(c, T.IntegerType()) for c in ("channel", "layer", "supermodule", "row", "column")]
    + [T.StructField(m, T.DoubleType()) for m in METRICS]
)
LOG = "timestamp string, filename string, channel string, anomalous boolean, method string, triggered_features string, max_z double, if_score double"
N_PINS = 50


def located(rows: DataFrame) -> DataFrame:
    """Adds path, filename, directory, run and subrun from the file's own path."""
    path = F.col("_metadata.file_path")
    return rows.select("*", path.alias("path")).withColumns({"filename": base_name(F.col("path")), "directory": F.regexp_replace("path", "/[^/]*$", "")})


def read_hits(spark: SparkSession, paths: str | list[str], corrupt: bool = True) -> DataFrame:
    """Hit rows of CSV files with a header; cells that do not parse are null, NaN is null.

    With ``corrupt``, unreadable files are skipped instead of ending the job.
    """
    rows = spark.read.schema(HITS).option("header", True).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", corrupt).csv(paths)
    rows = located(rows)
    rows = rows.withColumns({m: F.when(~F.isnan(m), F.col(m)) for m in METRICS})
    return rows.withColumns({"run": file_run(F.col("filename")), "subrun": file_subrun(F.col("filename"))})


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, filename, run, subrun) of files, empty ones included; contents are not read."""
    reader = spark.read.format("binaryFile")
    rows = reader.load(paths).select("path")
    return rows.select("path", base_name(F.col("path")).alias("filename")).withColumns({"run": file_run(F.col("filename")), "subrun": file_subrun(F.col("filename"))})


def cells(line: Column) -> Column:
    return F.transform(F.split(line, ","), lambda c: F.trim(c))


def header_rows(text: DataFrame, marker: str = "subrunnum") -> DataFrame:
    """(path, line, cells map<string, string>) of text tables whose header may come again before any row.

    ``text``: (path, value), a whole file each; such files have one row a subrun.
    A row belongs to the last header above it; rows above any are dropped, and
    so are blank lines.  Cells beyond the header's are dropped too.
    """
    lines = text.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line", "x")).where(F.trim("x") != "").select("path", "line", cells(F.col("x")).alias("row"))
    is_head = F.get("row", 0) == marker
    head = F.last(F.when(is_head, F.col("row")), ignorenulls=True).over(W.partitionBy("path").orderBy("line"))
    found = lines.select("path", "line", "row", is_head.alias("is_head"), head.alias("head")).where("not is_head and head is not null")
    n = F.least(F.size("head"), F.size("row"))
    return found.select("path", "line", F.map_from_arrays(F.slice("head", 1, n), F.slice("row", 1, n)).alias("cells"))


def whole_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def trigger_rows(text: DataFrame) -> DataFrame:
    """(directory, run, subrun, line, trigger features): bad and absent cells are null."""
    rows = header_rows(text)
    picked = [number(F.try_element_at("cells", F.lit(c))).alias(c) for c in TRIGGER_FEATURES]
    return rows.select(F.regexp_replace("path", "/[^/]*$", "").alias("directory"), any_run(base_name(F.col("path"))).alias("run"), number(F.try_element_at("cells", F.lit("subrunnum"))).cast("int").alias("subrun"), "line", *picked)


def lvds_rows(text: DataFrame) -> DataFrame:
    """(directory, run, subrun, line, pins map<int, double>, LVDStotal)."""
    rows = header_rows(text)
    pins = F.map_from_arrays(F.array(*[F.lit(i) for i in range(N_PINS)]), F.array(*[number(F.try_element_at("cells", F.lit(f"LVDSpin{i}"))) for i in range(N_PINS)]))
    return rows.select(F.regexp_replace("path", "/[^/]*$", "").alias("directory"), any_run(base_name(F.col("path"))).alias("run"), number(F.try_element_at("cells", F.lit("subrunnum"))).cast("int").alias("subrun"), "line", pins.alias("pins"), number(F.try_element_at("cells", F.lit("total"))).alias("LVDStotal"))


#: Names that a run configuration script assigns.
CONFIG_NAMES = ("triggerBoard.prescale", "triggerBoard.trigger", "triggerBoard.trigger_mask")


def assigned(text: Column, name: str) -> Column:
    """The last active assignment of a name, trimmed; comments, also at the end of a line, do not count; null if there is none."""
    pattern = rf"(?m)^[ \t]*{re.escape(name)}[ \t]*=[ \t]*([^#\r\n]+)"
    return F.trim(F.element_at(F.regexp_extract_all(text, F.lit(pattern), 1), -1))


def integer(text: Column) -> Column:
    """A decimal, hexadecimal (0x) or binary (0b) literal; null if it is none."""
    text = F.lower(F.trim(text))
    based = lambda pattern, base: F.when(text.rlike(pattern), F.conv(F.substring(text, 3, 64), base, 10).try_cast("bigint"))
    return F.coalesce(based("^0x[0-9a-f]+$", 16), based("^0b[01]+$", 2), F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint")))


def listed(text: Column) -> Column:
    """The parts of a list literal; null if it is none."""
    inner = F.regexp_extract(text, r"^[\[(](.*?),?\s*[\])]$", 1)
    return F.when(text.rlike(r"^[\[(].*[\])]$"), F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != ""))


def read_run_configs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(run, prescale, trigger, mask) of run configuration scripts: one tiny file a run.

    Prescales are listed from the highest bit; at most 16 are used.
    """
    prescale, trigger, mask = (assigned(F.col("value"), n) for n in CONFIG_NAMES)
    scales = F.transform(F.slice(listed(prescale), 1, 16), lambda x: F.coalesce(integer(x).cast("double"), x.try_cast("double")))
    masks = F.transform(listed(mask), lambda x: integer(x).cast("int"))
    return whole_texts(spark, paths).select(any_run(base_name(F.col("path"))).alias("run"), F.reverse(scales).alias("prescale"), integer(trigger).alias("trigger"), masks.alias("mask"))


def read_thresholds(spark: SparkSession, path: str, per_board: int = 16) -> DataFrame:
    """(channel, volts) of a JSON map of maps, board -> channel -> volts."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, double>>").alias("m"))
    rows = rows.select(F.explode("m").alias("board", "own")).select("board", F.explode("own").alias("c", "volts"))
    return rows.select((F.col("board").cast("int") * per_board + F.col("c").cast("int")).alias("channel"), "volts")


def uniform_thresholds(spark: SparkSession, volts: float, channels: int = 96) -> DataFrame:
    return spark.range(channels).select(F.col("id").cast("int").alias("channel"), F.lit(volts).alias("volts"))


def expand_globs(patterns: Iterable[str], find: Callable[[str], list[str]]) -> tuple[list[str], list[str]]:
    """(paths in order of first appearance, patterns without a match); blanks and # comments are skipped."""
    paths: dict[str, None] = {}
    lost = []
    for line in patterns:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        found = find(line)
        if not found:
            lost.append(line)
        paths |= dict.fromkeys(found)
    return list(paths), lost


def run_list(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """expand_globs of the lines of a file; list and files may be in any store that Spark reads."""
    lines = spark.read.text(path, wholetext=True).first()
    return expand_globs(lines["value"].splitlines() if lines else [], lambda pattern: storage.find(spark, pattern))


def matching_runs(files: DataFrame, tag: str, pattern: str, column: str = "filename") -> DataFrame:
    """Log parts ``<tag>_run<part>.csv`` whose part matches a shell pattern (*, ?, [...])."""
    part = F.regexp_extract(F.col(column), rf"(?:^|/){re.escape(tag)}_run([^/]*)\.csv$", 1)
    return files.where(part.rlike(f"^(?:{shell_pattern(pattern)})$") & (F.col(column).rlike(rf"(?:^|/){re.escape(tag)}_run[^/]*\.csv$")))


def shell_pattern(pattern: str) -> str:
    """A shell pattern as a regular expression; an opened bracket that is not closed is a plain one."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "!" else 2)) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            own = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + own[1:] if own[0] == "!" else "\\" + own if own[0] == "^" else own) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def read_knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """(run, category, cause, action, recovery) of a YAML or JSON list of annotated runs; parts that a case lacks are null."""
    from ..config import parsed

    text = spark.read.text(path, wholetext=True).first()
    names = ("run", "category", "cause", "action", "recovery")
    rows = [tuple(None if x.get(n) is None else int(x[n]) if n == "run" else str(x[n]) for n in names) for x in parsed(text["value"] if text else "", path.endswith(".json")) or []]
    return spark.createDataFrame(rows, "run int, category string, cause string, action string, recovery string")


def first_catalogue(spark: SparkSession, models: Iterable[dict]) -> str | None:
    """The first catalogue that some model's metadata names and that is there."""
    return next((p for m in models if (p := m.get("goodRunsList_json")) and storage.exists(spark, p)), None)


def run_directory(root: str, run: int) -> str:
    """Where the files of a run are: hundreds of runs share a folder."""
    return f"{root}/slab/{run // 100 * 100}/Digitizer_run{run}_subrun*.csv"


def parse_catalogue(text: DataFrame) -> DataFrame:
    """(run, subrun, loose, medium, tight, single, tag, position) of catalogue JSON in a column ``value``."""
    rows = text.select(F.posexplode(F.from_json("value", "data array<array<string>>")["data"]).alias("position", "r"))
    flag = lambda i: F.get("r", i).try_cast("boolean")
    return rows.select(F.get("r", 0).try_cast("int").alias("run"), F.get("r", 1).try_cast("int").alias("subrun"), flag(2).alias("loose"), flag(3).alias("medium"), flag(4).alias("tight"), F.get("r", 5).alias("single"), F.get("r", 6).alias("tag"), "position")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return parse_catalogue(spark.read.text(path, wholetext=True))


def read_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """An anomaly log from CSV, channels as text; run and subrun come from the file names in it."""
    rows = spark.read.schema(LOG).option("header", True).csv(paths)
    rows = rows.withColumns({"triggered_features": F.coalesce("triggered_features", F.lit("")), "method": F.coalesce("method", F.lit(""))})
    return rows.withColumns({"run": file_run(F.col("filename")), "subrun": file_subrun(F.col("filename"))})


def framework_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return whole_texts(spark, paths).select("path", F.element_at(F.split("path", "/"), -2).alias("model"), F.from_json("value", "data array<array<string>>")["data"].alias("data"))


def read_framework(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(model, run, subrun, loose, medium, tight) of framework JSON files; the model is the file's folder; what does not parse is skipped."""
    rows = framework_texts(spark, paths).select("model", F.explode("data").alias("r"))
    part = [F.get("r", i).try_cast("int").alias(c) for i, c in enumerate(("run", "subrun", "loose", "medium", "tight"))]
    return rows.select("model", *part)


def unread_framework(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, model) of the framework files that read_framework skips."""
    return framework_texts(spark, paths).where("data is null").select("path", "model")


def read_confusion(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(model, gt, status, n) of confusion JSON files."""
    rows = whole_texts(spark, paths).select(F.element_at(F.split("path", "/"), -2).alias("model"), F.explode(F.from_json("value", "counts map<string, map<string, bigint>>")["counts"]).alias("gt", "own"))
    return rows.select("model", "gt", F.explode("own").alias("status", "n"))
