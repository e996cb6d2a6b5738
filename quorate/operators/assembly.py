"""Putting a panel together from its members' files: what is checked first, and what stops it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions import metrics
from quorate.functions.prompts import condition
from quorate.operators.drift import json_objects
from quorate.operators.ranks import numbered
from quorate.sinks import files


def records(lines: DataFrame) -> DataFrame:
    """What a member's file says, line by line: stream, file_id, line_no, uid, model, condition, pred and prob_yes of each complete object."""
    get = lambda name, kind: F.try_variant_get("object", f"$.{name}", kind).alias(name)
    return json_objects(lines.select("stream", "file_id", "line_no", "payload")).select("stream", "file_id", "line_no", get("uid", "string"), get("model", "string"), get("condition", "string"), get("pred", "int"), get("prob_yes", "double"))


def probes(lines: DataFrame) -> DataFrame:
    """Per file its complete lines and the model of the first one."""
    return records(lines).groupBy("stream", "file_id").agg(F.count("*").alias("n_lines"), F.min_by("model", "line_no").alias("model"))


def expected_model(stream: Column) -> Column:
    """The member that a file's path names."""
    return F.try_element_at(F.split(stream, "/"), F.lit(2))


def shard_states(lines: DataFrame, force: bool = False) -> DataFrame:
    """What becomes of each member's file when a run goes on: ``cached``, ``recompute``, or ``refuse`` where it was recorded for another member.

    A file is complete if it has as many lines as the largest of its stream.  A complete file of another member means
    that the panel was put in another order since; it is recomputed only by force.
    """
    found = probes(lines)
    full = found.groupBy("stream").agg(F.max("n_lines").alias("n_expected"))
    own = F.col("model").eqNullSafe(expected_model(F.col("stream")))
    state = F.when(F.col("n_lines") < F.col("n_expected"), "recompute").when(own, "cached").otherwise("recompute" if force else "refuse")
    return found.join(full, "stream").select("stream", "file_id", "n_lines", "n_expected", "model", state.alias("state"))


def foreign_models(lines: DataFrame) -> DataFrame:
    """Files that hold verdicts of a model other than the one their path names, with these models: no force takes them on."""
    rows = records(lines).where(~F.col("model").eqNullSafe(expected_model(F.col("stream"))))
    return rows.groupBy("stream", "file_id").agg(F.count("*").alias("n_rows"), F.array_join(F.array_sort(F.collect_set(F.coalesce("model", F.lit("none")))), ",").alias("models"))


def member_states(lines: DataFrame, least: float = 0.95, need_prob: bool = True) -> DataFrame:
    """Whether each file may be a member: its rows, items, coverage of pred and prob_yes, and the first reason against it.

    Checked over all complete lines: its own model only, the condition of its data set only, no item twice, coverage.
    """
    want = condition(F.split("stream", "/")[0])
    rows = records(lines).select("*", F.col("model").eqNullSafe(expected_model(F.col("stream"))).alias("own"), F.col("condition").eqNullSafe(want).alias("fits"))
    per = rows.groupBy("stream", "file_id").agg(F.count("*").alias("n_rows"), F.count_distinct("uid").alias("n_uids"), F.count("pred").alias("n_pred"), F.count("prob_yes").alias("n_prob"), F.bool_and("own").alias("own"), F.bool_and("fits").alias("fits"))
    cover, prob = metrics.ratio(F.col("n_pred"), F.col("n_rows")), metrics.ratio(F.col("n_prob"), F.col("n_rows"))
    short = (cover < least) | ((prob < least) if need_prob else F.lit(False))
    state = F.when(~F.col("own"), "other model").when(~F.col("fits"), "other condition").when(F.col("n_uids") < F.col("n_rows"), "repeated items").when(short, "low coverage").otherwise("ok")
    return per.select("stream", "file_id", "n_rows", "n_uids", cover.alias("coverage"), prob.alias("prob_coverage"), state.alias("state"))


def in_panel_order(verdicts: DataFrame, roster: DataFrame) -> DataFrame:
    """The rows of a panel's file with their place in it (``line_no``, from 0): by data set, member in the roster's order, and delivery.

    Rows of others than the roster's members are left out.  The roster is a fixed table.
    """
    order = {r["model"]: r["panel_idx"] for r in roster.select("panel_idx", "model").collect()}
    place = F.create_map(*[x for m, i in order.items() for x in (F.lit(m), F.lit(i))]) if order else F.lit(None).cast("map<string,int>")
    rows = verdicts.withColumn("panel_idx", F.try_element_at(place, F.col("model"))).where("panel_idx IS NOT NULL")
    return numbered(rows, ["dataset"], ["panel_idx", "rec_id"], "line_no")


def assemble(rows: DataFrame, roster: DataFrame, gates: DataFrame, path: str) -> int:
    """Write a panel's rows in its order to ``path``; refuses, and leaves what is there, unless every member of the roster passed.

    ``gates`` has dataset, model and gate (``ok`` where a member passed); ``rows`` are those of ``in_panel_order``.
    """
    wanted = rows.select("dataset").distinct().join(roster.select("model").distinct(), how="cross")  # data sets by members, both fixed lists
    missing = wanted.join(gates.where("gate = 'ok'").select("dataset", "model"), ["dataset", "model"], "left_anti").orderBy("dataset", "model").limit(5).collect()
    if missing:
        raise ValueError("incomplete panel: " + ", ".join(f"{r['model']} on {r['dataset']}" for r in missing))
    return files.replace(rows, path, partition_by=("dataset",))
