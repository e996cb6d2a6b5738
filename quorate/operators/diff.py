"""Differences between two copies of a table, field by field."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tagged(df: DataFrame, side: int, key: str, fields: Mapping[str, Column], key_as: Column) -> DataFrame:
    return df.select(key_as.alias("k"), F.lit(side).alias("side"), F.struct(*[c.alias(f) for f, c in fields.items()]).alias("v"))


def differences(left: DataFrame, right: DataFrame, key: str, fields: Mapping[str, Column], key_as: Column | None = None, missing: tuple[str, str] = ("missing_in_right", "missing_in_left")) -> DataFrame:
    """Keys that one side lacks and fields whose values differ: columns ``key`` and ``field_name``.

    ``fields`` maps each compared field to its normal form, ``key_as`` is the key's; columns that only one side has
    are not compared.  Null equals null only, a null key is a key of its own.  Both sides are tagged and put together,
    and one grouping by key keeps a smallest and a largest struct per side, so a key's repeated rows never gather
    anywhere.  Where a side holds more than one version of a key, the sets of each field's values are compared instead.
    """
    key_as = F.col(key) if key_as is None else key_as
    rows = _tagged(left, 1, key, fields, key_as).unionByName(_tagged(right, 2, key, fields, key_as))
    on = lambda side: F.when(F.col("side") == side, F.col("v"))
    grouped = rows.groupBy("k").agg(*[f(on(s)).alias(f"{n}{s}") for s in (1, 2) for n, f in (("low", F.min), ("high", F.max))])
    checks = ", ".join(f"struct('{f}' AS name, NOT (low1.`{f}` <=> low2.`{f}`) AS differs)" for f in fields)
    found = F.expr(
        f"CASE WHEN low2 IS NULL THEN array('{missing[0]}') WHEN low1 IS NULL THEN array('{missing[1]}') "
        f"WHEN low1 = high1 AND low2 = high2 THEN transform(filter(array({checks}), x -> x.differs), x -> x.name) ELSE array() END"
    )
    single = grouped.select(F.col("k").alias(key), F.explode(found).alias("field_name"))

    # Keys with several versions on a side: a value of a field that only one side has makes the field differ.
    several = grouped.where("low1 IS NOT NULL AND low2 IS NOT NULL AND (NOT (low1 <=> high1) OR NOT (low2 <=> high2))").select("k")
    names = F.array(*[F.struct(F.lit(f).alias("name"), F.to_json(F.struct(F.col(f"v.{f}").alias("x"))).alias("value")) for f in fields])
    values = rows.join(several.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")), "left_semi").select("k", "side", F.explode(names).alias("f"))
    sided = values.groupBy("k", "f.name", "f.value").agg(F.bit_or("side").alias("sides"))
    return single.unionByName(sided.where("sides < 3").select(F.col("k").alias(key), F.col("name").alias("field_name")).distinct())


def index_differences(index: DataFrame, copy: DataFrame) -> DataFrame:
    """Differences of the join index and its copy, per uid without the blanks around it; digests compare without letter case."""
    fields = {f: F.lower(f) if f == "src_sha1" else F.col(f) for f in ("row_id", "kind", "gold", "stratum", "category", "src_sha1")}
    return differences(index, copy, "uid", fields, F.regexp_replace("uid", r"(?U)^[\s\x{200b}\x{feff}]+|[\s\x{200b}\x{feff}]+$", ""), ("missing_in_copy", "missing_in_index"))
