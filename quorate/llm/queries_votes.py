"""Queries on the panel's votes and on splits, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quorate.llm import consensus, splits
from quorate.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.disputed(table(spark, d, "experiment"))


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "experiment"))


def p2_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(table(spark, d, "experiment"))


def p2_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reliability(table(spark, d, "experiment"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.together(table(spark, d, "experiment"))


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_records(table(spark, d, "experiment"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(table(spark, d, "experiment"))


QUERIES = {f.__name__: f for f in (p2_found, p2_labels, p2_agreement, p2_reliability, p3_found, p3_split, p3_report)}

SQL = {
    "p2_agreement": """
WITH v AS (SELECT DISTINCT dataset, uid, model, condition, fmt, paraphrase, pred FROM experiment WHERE pred IS NOT NULL),
i AS (SELECT dataset, uid, count(*) AS n, count(*) FILTER (WHERE pred = 1) AS k FROM v GROUP BY ALL HAVING count(*) >= 2),
t AS (SELECT dataset, count(*)::BIGINT AS n_items, sum(n)::BIGINT AS n_votes, sum(k)::BIGINT AS k,
             sum((k * (k - 1) + (n - k) * (n - k - 1))::DOUBLE / (n - 1)) AS alike FROM i GROUP BY dataset),
c AS (SELECT *, alike / n_votes AS o, (k * (k - 1) + (n_votes - k) * (n_votes - k - 1))::DOUBLE / (n_votes * (n_votes - 1)) AS e FROM t)
SELECT dataset, n_items, n_votes, round(o, 6) AS agreement, round((o - e) / nullif(1 - e, 0), 6) AS alpha FROM c""",
    "p3_found": """
WITH RECURSIVE e AS (SELECT DISTINCT a.dataset, a.row_id AS u, b.row_id AS v FROM experiment a JOIN experiment b
  ON a.dataset = b.dataset AND a.uid = b.uid AND a.row_id <> b.row_id),
r AS (SELECT dataset, u AS s, u AS v FROM e UNION SELECT r.dataset, r.s, e.v FROM r JOIN e ON r.dataset = e.dataset AND r.v = e.u)
SELECT dataset, min(v) AS first_row_id, s AS row_id FROM r GROUP BY dataset, s HAVING min(v) < s""",
}
