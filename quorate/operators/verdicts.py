"""Verdict rows, coverage and scores per judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions import metrics
from quorate.functions.prompts import condition

#: What identifies one verdict.
KEY = ("dataset", "uid", "model", "condition", "fmt", "paraphrase")


def first_rows(experiment: DataFrame, key: tuple[str, ...] = KEY, by: str = "rec_id") -> DataFrame:
    """One row per verdict: the first delivered one (smallest ``by``) gives pred, gold and row_id.

    Null key parts form a key of their own.  Only numbers are carried, so the grouping combines before it shuffles.
    """
    return experiment.groupBy(*key).agg(*[F.min_by(c, by).alias(c) for c in ("pred", "gold", "row_id")])


def coverage(experiment: DataFrame, by: tuple[str, ...] = ("dataset", "model", "condition"), least: float = 0.999, also: str | None = None) -> DataFrame:
    """Rows, distinct items, verdicts and coverage per group, and whether it falls short of ``least``.  Every row counts.

    With ``also``, the rows that have a value in that column are counted too (``n_also``).
    """
    n, said = F.count("*"), F.count("pred")
    more = [F.count(also).alias("n_also")] if also else []
    return experiment.groupBy(*by).agg(n.alias("n_rows"), F.count_distinct("uid").alias("n_uids"), said.alias("n_pred"), *more, metrics.ratio(said, n).alias("coverage"), (metrics.ratio(said, n) < least).cast("int").alias("is_low"))


def coverage_rollup(experiment: DataFrame) -> DataFrame:
    """Coverage per dataset and model, per dataset and over everything in one pass; ``level`` tells them apart."""
    n, said = F.count("*"), F.count("pred")
    d, m = F.col("dataset"), F.col("model")
    sets = experiment.select("dataset", "model", "pred").groupingSets([[d, m], [d], []], d, m)
    return sets.agg(F.grouping_id().cast("int").alias("level"), n.alias("n_rows"), said.alias("n_pred"), metrics.ratio(said, n).alias("coverage")).select("dataset", "model", "level", "n_rows", "n_pred", "coverage")


def panel_completeness(experiment: DataFrame, roster: DataFrame, least: float = 0.999) -> DataFrame:
    """Per dataset: roster members that answered, members whose coverage is low, and whether the panel is complete."""
    members = coverage(experiment, ("dataset", "model"), least).join(roster.select("model").distinct(), "model")
    per = members.groupBy("dataset").agg(F.count("*").alias("n_models"), F.sum("is_low").alias("n_low"))
    size = roster.select("model").distinct().count()  # one number of a fixed table
    return per.select("dataset", "n_models", F.lit(size).cast("bigint").alias("n_expected"), "n_low", (F.col("n_models") == size).cast("int").alias("is_complete"))


def judge_cells(experiment: DataFrame) -> DataFrame:
    """The six counts per dataset, condition and judge, each verdict counted once."""
    return first_rows(experiment).groupBy("dataset", "condition", "model").agg(*metrics.cells(F.col("pred"), F.col("gold")))


def judge_scores(experiment: DataFrame) -> DataFrame:
    """Coverage, kappa, both balanced accuracies and macro F1 per dataset, condition and judge."""
    return judge_cells(experiment).select("dataset", "condition", "model", *metrics.CELLS, *metrics.scores())


def main_condition(experiment: DataFrame) -> DataFrame:
    """The condition each dataset is read under: ``def_on`` if it has any such row, else the first by name."""
    return experiment.groupBy("dataset").agg(F.coalesce(F.min(F.when(F.col("condition") == "def_on", "def_on")), F.min("condition")).alias("condition"))


def member_gate(experiment: DataFrame, least: float = 0.95) -> DataFrame:
    """Whether each panel member of a dataset may be assembled.

    Checked over all its rows: the expected condition and no other, no item recorded twice, coverage, and the same
    items as the other members: a member's set of items lies within that of all members, so both are the same if they
    have equally many (``n_uids`` and ``n_all``).
    """
    want = condition(F.col("dataset"))
    rows = experiment.where(F.col("condition") == want)
    other = experiment.groupBy("dataset", "model").agg(F.max((F.col("condition") != want).cast("int")).alias("other_condition"))
    per = rows.groupBy("dataset", "model").agg(F.count("*").alias("n_rows"), F.count_distinct("uid").alias("n_uids"), F.count("pred").alias("n_pred"))
    most = rows.groupBy("dataset").agg(F.count_distinct("uid").alias("n_all"))
    joined = per.join(other, ["dataset", "model"]).join(most, "dataset")
    cov = metrics.ratio(F.col("n_pred"), F.col("n_rows"))
    repeated, short, partial = F.col("n_uids") < F.col("n_rows"), cov < least, F.col("n_uids") < F.col("n_all")
    verdict = F.when(F.col("other_condition") == 1, "other condition").when(repeated, "repeated items").when(short, "low coverage").when(partial, "missing items").otherwise("ok")
    return joined.select("dataset", "model", "n_rows", "n_uids", "n_pred", cov.alias("coverage"), verdict.alias("gate"))


def votes_only(experiment: DataFrame, drop: tuple[str, ...] = ("raw",)) -> DataFrame:
    """The verdict table without the texts; columns that are not there are no error."""
    return experiment.drop(*drop)
