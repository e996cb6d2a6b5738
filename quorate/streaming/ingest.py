"""Taking in verdicts as they are delivered, each once, however late and however often."""

from __future__ import annotations

import functools
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.operators.verdicts import KEY
from quorate.plans.lineage import shared_folder

def _unseen(batch: DataFrame, to: str) -> DataFrame:
    """The verdicts of a batch that the table ``to`` does not have, each once, with the day of their recording.

    A verdict is delivered again under the time of its recording, so only the days of the batch are looked at in the
    table; however late a delivery comes, it is known.
    """
    spark = batch.sparkSession
    event = F.coalesce(F.col("recorded_at"), F.col("loaded_at"))
    rows = batch.withColumns({"event_time": event, "event_day": F.coalesce(F.date_format(event, "yyyy-MM-dd"), F.lit("none"))}).dropDuplicates([*KEY, "event_time"])
    try:
        known = spark.read.schema(f"{', '.join(f'{k} string' for k in KEY)}, event_time {dict(rows.dtypes)['event_time']}, event_day string").parquet(to)
    except AnalysisException:  # nothing was taken in yet
        return rows
    known = known.join(rows.select("event_day").distinct(), "event_day", "left_semi").alias("k")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in (*KEY, "event_time", "event_day")]
    return rows.alias("r").join(known, functools.reduce(lambda a, b: a & b, same), "left_anti")


def first_deliveries(spark: SparkSession, path: str, to: str, state: str) -> None:
    """Append every verdict of the files at ``path`` to the table ``to``, unless it was taken in before, however long ago.

    New files are read where the last call stopped (``state``), and a batch that was written but not noted is found in
    the table, so a call that failed is made again without harm.  The table is kept by day of recording.
    """
    schema = spark.read.parquet(path).schema
    # As a pattern, a path may be a single file as well as a folder.
    rows = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    take = lambda batch, _: _unseen(batch, to).write.mode("append").partitionBy("event_day").parquet(to)
    rows.writeStream.foreachBatch(take).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """The verdicts at ``path``, each once, through one run of the stream."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    first_deliveries(spark, path, f"{folder}/table", f"{folder}/state")
    return spark.read.schema(spark.read.parquet(path).schema).parquet(f"{folder}/table")


def daily_coverage(verdicts: DataFrame) -> DataFrame:
    """Verdicts and coverage per judge and day of recording."""
    day = F.date_format("recorded_at", "yyyy-MM-dd").alias("day")
    return verdicts.groupBy(day, "model").agg(F.count("*").alias("n"), F.count("pred").alias("n_pred"), F.try_divide(F.count("pred").cast("double"), F.count("*")).alias("coverage"))
