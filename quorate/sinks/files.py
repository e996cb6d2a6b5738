"""Writing verdict tables and exports, beside what is there and then in its place."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def replace(df: DataFrame, path: str, form: str = "parquet", partition_by: tuple[str, ...] = (), least_rows: int = 1, **options: str) -> int:
    """Write ``df`` beside ``path``, check it, and put it in place; returns its rows.

    Fewer than ``least_rows`` rows, or any failure, leave what was at ``path`` as it was and no trace of the attempt.
    ``df`` may read from ``path``.
    """
    spark = df.sparkSession
    fs, Path = _fs(spark, path)
    beside, old = Path(f"{path}.new-{uuid.uuid4().hex}"), Path(f"{path}.old-{uuid.uuid4().hex}")
    writer = df.write.format(form).options(**options)
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).save(beside.toString())
        rows = spark.read.format(form).schema(df.schema).load(beside.toString()).count()
        if rows < least_rows:
            raise ValueError(f"{rows} rows, {least_rows} expected")
    except BaseException:
        fs.delete(beside, True)
        raise
    had = fs.exists(Path(path))
    if had:
        fs.rename(Path(path), old)
    fs.rename(beside, Path(path))
    if had:
        fs.delete(old, True)
    return rows


def write_index(index: DataFrame, path: str, force: bool = False) -> int:
    """Write the join index of some data sets (column dataset), carrying over the others that ``path`` has; returns all rows.

    An index that is there is replaced by force only, and only once the new one is whole.
    """
    spark = index.sparkSession
    fs, Path = _fs(spark, path)
    if not fs.exists(Path(path)):
        return replace(index, path, partition_by=("dataset",))
    if not force:
        raise FileExistsError(f"{path} already holds an index")
    kept = spark.read.schema(index.schema).parquet(path).join(index.select("dataset").distinct(), "dataset", "left_anti").select(index.columns)
    return replace(index.unionByName(kept), path, partition_by=("dataset",))


def write_judge(verdicts: DataFrame, path: str, **facts: str) -> int:
    """A judge's rows as JSON lines and its summary beside them (rows, verdicts, coverage and the named facts)."""
    n = replace(verdicts, path, "json", ignoreNullFields="false")
    said = verdicts.sparkSession.read.schema(verdicts.schema).json(path)
    write_manifest(said.agg(F.count("*").alias("n"), F.count("pred").alias("n_pred"), (F.count("pred") / F.count("*")).alias("coverage")), f"{path}.summary.json", **facts)
    return n


def copy_summaries(spark: SparkSession, pattern: str, to: str) -> int:
    """Copy the summary files that match a pattern as they are, each beside its name put in place; returns how many."""
    fs, Path = _fs(spark, to)
    found = fs.globStatus(Path(pattern)) or []
    util, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil, spark.sparkContext._jsc.hadoopConfiguration()
    for f in found:
        beside = Path(f"{to}/.{f.getPath().getName()}.new")
        util.copy(f.getPath().getFileSystem(conf), f.getPath(), fs, beside, False, True, conf)
        target = Path(f"{to}/{f.getPath().getName()}")
        if fs.exists(target):
            fs.delete(target, False)
        fs.rename(beside, target)
    return len(found)


def coverage_report(coverage: DataFrame, least: float = 0.999) -> str:
    """Coverage per data set and judge (dataset, model, n_rows, n_pred, coverage) as a Markdown report: a table per data set, then what falls short.

    Judges and data sets are fixed lists, so the report has a bound of its own.
    """
    rows = coverage.orderBy("dataset", "model").select("dataset", "model", "n_rows", "n_pred", "coverage").collect()
    out = ["# Coverage"]
    for dataset in dict.fromkeys(r["dataset"] for r in rows):
        out += ["", f"## {dataset}", "", "| judge | rows | verdicts | coverage |", "| --- | --- | --- | --- |"]
        out += [f"| {r['model']} | {r['n_rows']} | {r['n_pred']} | {r['coverage']:.3f} |" for r in rows if r["dataset"] == dataset]
    short = [r for r in rows if r["coverage"] < least]
    out += ["", "## Incomplete", "", *([f"- {r['dataset']} {r['model']}: {r['coverage']:.3f}" for r in short] or ["none"])]
    return "\n".join(out)


def export_votes(verdicts: DataFrame, path: str, drop: tuple[str, ...] = ("raw",)) -> int:
    """Verdicts without their texts as compressed JSON lines by dataset; nulls are written out."""
    return replace(verdicts.drop(*drop), path, "json", ("dataset",), compression="gzip", ignoreNullFields="false")


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An export under its schema."""
    return spark.read.schema(schema).json(path)


def write_manifest(summary: DataFrame, path: str, **extra: str) -> None:
    """A summary table of few rows, and named facts, as one JSON file."""
    spark = summary.sparkSession
    fs, Path = _fs(spark, path)
    out = fs.create(Path(path), True)
    try:
        out.write(bytearray(json.dumps(extra | {"rows": [r.asDict(recursive=True) for r in summary.collect()]}, indent=1, default=str, sort_keys=True).encode()))
    finally:
        out.close()


def markdown(summary: DataFrame) -> str:
    """A summary table of few rows as a Markdown table."""
    rows = [summary.columns, ["---"] * len(summary.columns), *[["" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r] for r in summary.collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
