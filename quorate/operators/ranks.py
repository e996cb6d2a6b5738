"""Row numbers over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorate.plans.lineage import cut


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """``df`` with the number (from 0) of each row within ``group`` in ``order``, which must be a total order.

    Rows are sorted by range over the cluster, numbered within their range, and ranges start where those before them
    end, so that a group of any size is spread over tasks.
    """
    placed = cut(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*group, "_part").count().select(*group, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return placed.withColumn("_within", within).join(starts, [*group, "_part"]).withColumn(name, F.col("_start") + F.col("_within") - 1).drop("_part", "_within", "_start")
