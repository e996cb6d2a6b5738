"""Cutting lineage with a table written to the shared folder.

A plan that is used several times, or that an iteration grows, is written once as Parquet to the folder that all
executors share (``spark.checkpoint.dir`` of the session) and read back.  A lost executor then costs a re-read and
no recomputation, and later joins see the real size of the table.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder within the session's shared one; it goes when the application ends.

    A local temporary folder stands in only where the session names none and runs on one machine (tests); on a cluster
    a missing ``spark.checkpoint.dir`` is an error, as every executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        return _own_folder(context.applicationId)
    folder = f"{named.rstrip('/')}/quorate-{context.applicationId}"
    _removed_at_end(spark, folder)
    return folder


_FOLDERS: set[str] = set()


def _removed_at_end(spark: SparkSession, folder: str) -> None:
    """Have the file system remove ``folder`` when the application's JVM ends."""
    if folder not in _FOLDERS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _FOLDERS.add(folder)


@functools.cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"spark-quorate-{application}-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again under the same schema.

    An empty ``df`` gives an empty table with its columns.  Column names must be distinct.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def workers(spark: SparkSession) -> int:
    """Tasks that run at once, or the session's shuffle partitions where those are more."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts(df: DataFrame, size: int = 128 << 20) -> int:
    """Tasks for work on ``df`` that costs far more than reading it: as many as run at once, more where its bytes ask for it."""
    told = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = -(-told // size) if told < 1 << 60 else df.rdd.getNumPartitions()  # rows that come from no table have no size
    return max(df.sparkSession.sparkContext.defaultParallelism, known)


def spread(df: DataFrame) -> DataFrame:
    """``df`` with its rows dealt out over the cluster if its files give fewer tasks than run at once; else as it is.

    For rows whose work per byte far exceeds that of moving them.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() * 2 < n else df
