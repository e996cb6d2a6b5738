"""Whether a measurement may run, is done, or must be refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.prompts import condition, frame
from quorate.operators.drift import json_objects

#: Harnesses whose label field is the frame, those that write one file per judge, and what a vintage may lack.
FRAME_KINDS, SIDECARS = ("ptjudge", "minicheck"), ("judge", "ptjudge", "minicheck")


def recorded_arms(lines: DataFrame, names: tuple[str, ...] = ("condition", "cond", "Condition", "frame")) -> DataFrame:
    """Per file: its rows and the set of labels they carry, under whichever of ``names`` a row has first.

    Lines that are no complete JSON object are no rows.
    """
    label = F.coalesce(*[F.try_variant_get("object", f"$.{n}", "string") for n in names])
    return json_objects(lines).groupBy("stream", "file_id").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set(label)).alias("recorded"))


def shard_schema(lines: DataFrame, key: str = "src_key") -> DataFrame:
    """Per file: its rows, how many carry ``key`` (a null value counts), ``with``, ``without`` or ``mixed``, and whether all files of its stream are alike and unmixed.

    Every complete JSON object is looked at.  A file or stream that is not pure must not be assembled.
    """
    has = F.try_variant_get("object", f"$.{key}", "variant").isNotNull().alias("has")
    rows = json_objects(lines).select("stream", "file_id", has)
    files = rows.groupBy("stream", "file_id").agg(F.count("*").alias("n_rows"), F.count_if("has").alias("n_with"), F.bool_and("has").alias("every"), F.bool_or("has").alias("some"))
    streams = files.groupBy("stream").agg((F.bool_and("every") | ~F.bool_or("some")).alias("stream_pure"))
    state = F.when(F.col("every"), "with").when(F.col("some"), "mixed").otherwise("without")
    return files.select("stream", "file_id", "n_rows", "n_with", state.alias("state")).join(streams, "stream")


def mismatch(recorded: Column, expected: Column, kind: Column) -> Column:
    """Why a file does not hold what it should, null where it does: the read-only form of ``decide``.

    An absent file, an honoured vintage and rows without labels that may still go on are no mismatch.
    """
    none = F.size(recorded) == 0
    vintage = none & ((kind == "minicheck") | ((kind == "ptjudge") & (expected == F.array(F.lit("qa")))))
    fine = recorded.isNull() | vintage | (none & ~kind.isin(*SIDECARS)) | (F.array_sort(recorded) == F.array_sort(expected))
    held = F.when(none, "nothing").otherwise(F.array_join(F.array_sort(recorded), ","))
    return F.when(~fine, F.concat(F.lit("holds "), held, F.lit(", expected "), F.array_join(F.array_sort(expected), ",")))


def scan(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files (path, dataset, tag, recorded) that do not hold what their judge should have written there: path and why.

    ``registry`` has tag, harness and contrast (whether the judge has such an arm); it is a small fixed table.  A tag may
    end with the mark of the contrast arm; files of unknown judges, and contrast files of judges without one, are skipped.
    """
    contrast = F.col("tag").endswith("_defon")
    named = files.select("path", "dataset", "recorded", contrast.alias("apart"), F.regexp_replace("tag", "_defon$", "").alias("tag"))
    rows = named.join(registry.select("tag", "harness", "contrast"), "tag").where("NOT apart OR contrast")
    want = F.when(F.col("apart"), "def_on").when(F.col("harness") == "judge", condition(F.col("dataset"))).when(F.col("harness") == "ptjudge", frame(F.col("dataset"))).otherwise("claimcheck")
    return rows.select("path", mismatch(F.col("recorded"), F.array(want), F.col("harness")).alias("why")).where("why IS NOT NULL")


def decide(recorded: Column, expected: Column, kind: Column, skip_on_match: Column, force: Column) -> Column:
    """``run``, ``skip`` or ``refuse``.

    No file (null) runs.  Labels other than the expected ones are refused, force or not.  A file of rows without
    labels runs on; one written in a single pass counts as expected if its harness had no label field then.  A match is
    skipped where the harness skips and nothing forces it.
    """
    none = F.size(recorded) == 0
    vintage = none & ((kind == "minicheck") | ((kind == "ptjudge") & (expected == F.array(F.lit("qa")))))
    seen = F.when(vintage, expected).otherwise(recorded)
    return (
        F.when(recorded.isNull(), "run")
        .when(none & ~vintage & ~kind.isin(*SIDECARS), "run")
        .when(F.array_sort(seen) != F.array_sort(expected), "refuse")
        .when(skip_on_match & ~force, "skip")
        .otherwise("run")
    )


def relation(recorded: Column, expected: Column) -> Column:
    """How the recorded labels relate to the expected ones: same, narrower, wider, other, none."""
    less, more = F.size(F.array_except(expected, recorded)), F.size(F.array_except(recorded, expected))
    return F.when(F.size(recorded) == 0, "none").when((less == 0) & (more == 0), "same").when(more == 0, "narrower").when(less == 0, "wider").otherwise("other")
