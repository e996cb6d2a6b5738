"""The plan of a panel run, how far it has come, and the boundary to inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.functions.prompts import condition


def run_plan(items: DataFrame, models: Sequence[str], fmt: str = "brief_reason", paraphrase: str = "p0") -> DataFrame:
    """One row per generation of a run: every item under its condition for every model, which are a fixed short list."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("model_idx"), F.lit(m).alias("model")) for i, m in enumerate(models)])).alias("m")
    return items.select("dataset", "uid", "row_id", "kind", "gold", "stratum", "category", each).select("*", "m.*").drop("m").withColumns({"condition": condition(F.col("dataset")), "fmt": F.lit(fmt), "paraphrase": F.lit(paraphrase)})


def progress(plan: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per dataset and model: generations planned, recorded (once or more) and still to make."""
    key = ["dataset", "uid", "model", "condition", "fmt", "paraphrase"]
    done = verdicts.select(*key).distinct().withColumn("done", F.lit(1))
    return plan.join(done, key, "left").groupBy("dataset", "model_idx", "model").agg(F.count("*").alias("n_planned"), F.count("done").alias("n_recorded"), F.count_if(F.col("done").isNull()).alias("n_missing"))


def generate(plan: DataFrame, answer: Callable[[list[str]], list[str]], prompt: str = "prompt") -> DataFrame:
    """The plan with column ``raw`` from ``answer``, which gets the prompts of a batch and returns as many texts.

    This is the boundary to real judges; each batch is one call inside a task.
    """
    names = plan.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = answer(batch.column(names.index(prompt)).to_pylist())
            if len(texts) != batch.num_rows:
                raise ValueError("a judge must answer every prompt of its batch")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "raw"])

    return plan.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plan.schema.fields) + ", raw string")
