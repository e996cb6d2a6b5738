"""Queries fed by a stream, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quorate.streaming import ingest


def stream_coverage(spark: SparkSession, d: str) -> DataFrame:
    return ingest.daily_coverage(ingest.delivered(spark, f"{d}/experiment.parquet"))


QUERIES = {"stream_coverage": stream_coverage}

SQL = {
    "stream_coverage": "WITH f AS (SELECT model, pred, recorded_at FROM experiment QUALIFY row_number() OVER (PARTITION BY dataset, uid, model, condition, fmt, paraphrase, recorded_at ORDER BY rec_id) = 1) "
    "SELECT strftime(recorded_at, '%Y-%m-%d') AS day, model, count(*) AS n, count(pred) AS n_pred, count(pred)::DOUBLE / count(*) AS coverage FROM f GROUP BY ALL",
}
