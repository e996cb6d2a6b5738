"""Reading verdict files: JSON lines, plain or gzip, in one file, many, or a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.operators.release import is_measurement

#: Columns of a verdict line over all harnesses; what a line lacks is null.
VERDICT = (
    "uid STRING, row_id BIGINT, kind STRING, gold INT, stratum STRING, category STRING, src_key STRING, model STRING, judge STRING, condition STRING, frame STRING, fmt STRING, "
    "paraphrase STRING, scorer STRING, score DOUBLE, threshold DOUBLE, prob_yes DOUBLE, pred INT, raw STRING"
)
INDEX = "uid STRING, row_id BIGINT, kind STRING, gold INT, stratum STRING, category STRING, src_sha1 STRING"


def read_lines(spark: SparkSession, paths: str | list[str], schema: str = VERDICT, tolerant: bool = False) -> DataFrame:
    """Rows of JSON-line files under a schema; globs and gzip work, blank lines are no rows.

    A path without any file, and files without any row, raise.  ``tolerant`` drops malformed lines and keeps the
    others; else the first malformed line raises when it is read.
    """
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(paths)
    if rows.isEmpty():
        raise ValueError(f"no rows in {paths}")
    return rows


def read_tree(spark: SparkSession, root: str, shards: bool = False) -> DataFrame:
    """Verdict files below ``root``: path, dataset (its folder) and content; shard folders only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.where(is_measurement(name))
    if not shards:
        kept = kept.where(~F.col("path").rlike(r"_shards/"))
    return kept.select("path", F.element_at(F.split("path", "/"), -2).alias("dataset"), "length", "content")


def file_records(files: DataFrame) -> DataFrame:
    """path, sha256, bytes and records of whole files; a last line without its end counts."""
    text = F.decode("content", "ISO-8859-1")
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    open_end = (F.length(text) > 0) & ~text.endswith("\n")
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), (ends + open_end.cast("int")).cast("bigint").alias("records"))


def pinned(files: DataFrame, sha256: str) -> DataFrame:
    """The one file whose digest is the pinned one; raises if another is there."""
    other = file_records(files).where(F.col("sha256") != sha256).select("path").head(1)
    if other:
        raise ValueError(f"{other[0][0]} does not have the pinned digest")
    return files


def panel_source(spark: SparkSession, folder: str) -> list[str]:
    """Where a panel's verdicts are read from: its members' files if there are any, else the file put together from them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/panel_shards/*.jsonl")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(f.getPath().toString() for f in found) or [f"{folder}/experiment.jsonl"]
