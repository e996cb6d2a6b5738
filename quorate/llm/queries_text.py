"""Queries on texts, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quorate.llm import completeness, defects, formatting, packing, subjects, tokens
from quorate.sources.tables import table

_ITEM = ("inst_id", ("question", "candidate"), ("context",))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.defects(table(spark, d, "experiment"), table(spark, d, "instances"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting.copies(table(spark, d, "instances"), *_ITEM)


def p5_items(spark: SparkSession, d: str) -> DataFrame:
    return formatting.collapsed(table(spark, d, "instances"), *_ITEM).select("inst_id", "dataset", "uid", "n_copies")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return completeness.truncated(table(spark, d, "experiment"))


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return completeness.truncation_rates(table(spark, d, "experiment"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p9_prompts(spark: SparkSession, d: str) -> DataFrame:
    return packing.prompts(spark, table(spark, d, "documents"), table(spark, d, "judge_windows"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(spark, table(spark, d, "documents"), table(spark, d, "judge_windows"))


def _subjects(run, spark: SparkSession, d: str) -> DataFrame:
    return run(table(spark, d, "documents"), table(spark, d, "doc_subjects"), table(spark, d, "subject_areas"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(subjects.found, spark, d)


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(subjects.subject_shares, spark, d)


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(subjects.composition, spark, d)


QUERIES = {f.__name__: f for f in (p4_found, p5_found, p5_items, p6_found, p6_rates, p8_ids, p9_prompts, p9_report, p10_found, p10_shares, p10_composition)}

_NORM = r"replace(lower(upper(regexp_replace(coalesce({}, ''), '[^\p{{L}}\p{{N}}]+', '', 'g'))), 'ß', 'ss')"
_COPIES = (
    f"WITH c AS (SELECT inst_id, dataset, uid, {_NORM.format('question')} AS q, {_NORM.format('candidate')} AS a, "
    f"list_sort(list_filter(list_transform(coalesce(context, []), lambda x: {_NORM.format('x')}), lambda x: x <> '')) AS e FROM instances), "
    "g AS (SELECT *, min(inst_id) OVER (PARTITION BY q, a, e) AS first_id, count(*) OVER (PARTITION BY q, a, e) AS n_copies FROM c) "
)
SQL = {
    "p5_found": _COPIES + "SELECT first_id, inst_id AS copy_id FROM g WHERE inst_id <> first_id",
    "p5_items": _COPIES + "SELECT inst_id, dataset, uid, n_copies FROM g WHERE inst_id = first_id",
}
