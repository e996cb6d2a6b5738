"""Records that are identical but for formatting, by dictionary encoding.

Values are brought to their canonical form where they lie and get an integer, so that no text moves; a dictionary of all
integers in use shows that no two forms share one.  Records become tuples of integers, with lists sorted, and equal
tuples are one record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.plans.lineage import cut


def canonical(value: Column) -> Column:
    """Letters and digits of a text in their order, letter case folded; the empty text for null."""
    kept = F.regexp_replace(F.coalesce(value, F.lit("")), r"[^\p{L}\p{N}]+", "")
    return F.replace(F.lower(F.upper(kept)), F.lit("ß"), F.lit("ss"))  # a sharp s is two s in upper case


def code(form: Column, second: bool = False) -> Column:
    """The integer of a canonical form, or a second one that is independent of it."""
    return F.xxhash64(F.lit(1), form) if second else F.xxhash64(form)


def shared_codes(entries: DataFrame) -> DataFrame:
    """The dictionary's flaws: codes that more than one form has (code), told apart by their second integers.

    ``entries`` has code and mark (the second integer); equal ones are added up before they are shuffled.
    """
    return entries.groupBy("code").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low <> high").select("code")


def encoded(records: DataFrame, key: str, texts: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """``key`` and ``tuple``: for each field the sorted codes of its entries, entries without letter or digit left out.

    Null equals empty throughout.  Only ``key`` and the named fields are read; keys must be unique.  Where two forms of
    the whole table share a code, which next to never happens, their second integer is part of the tuple.
    """

    def entry(number: int, name: str) -> Column:
        values = F.array(F.col(name)) if name in texts else F.coalesce(F.col(name), F.array().cast("array<string>"))
        forms = F.filter(F.transform(values, canonical), lambda f: f != "")
        return F.transform(forms, lambda f: F.struct(F.lit(number).alias("field"), code(f).alias("code"), code(f, True).alias("mark")))

    listed = F.flatten(F.array(*[entry(i, t) for i, t in enumerate([*texts, *lists])]))
    each = cut(records.select(F.col(key).alias("id"), listed.alias("entries")))
    flaws = cut(shared_codes(each.select(F.explode("entries").alias("e")).select("e.code", "e.mark")))
    if flaws.isEmpty():
        return each.select(F.col("id").alias(key), F.sort_array(F.transform("entries", lambda e: F.struct(e["field"].alias("field"), e["code"].alias("code"), F.lit(0).cast("bigint").alias("mark")))).alias("tuple"))
    flawed = flaws.withColumn("flawed", F.lit(True))
    told = each.select("id", F.explode_outer("entries").alias("e")).select("id", "e.field", "e.code", "e.mark").join(flawed, "code", "left")
    one = F.when(F.col("field").isNotNull(), F.struct("field", "code", F.when(F.col("flawed"), F.col("mark")).otherwise(0).alias("mark")))
    return told.groupBy("id").agg(F.sort_array(F.collect_list(one)).alias("tuple")).withColumnRenamed("id", key)


def groups(records: DataFrame, key: str, texts: Sequence[str], lists: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Encoded records, and (tuple, first_id, n_copies) of each group of equal ones; first_id is the smallest key."""
    codes = cut(encoded(records, key, texts, lists))
    return codes, codes.groupBy("tuple").agg(F.min(key).alias("first_id"), F.count("*").alias("n_copies"))


def copies(records: DataFrame, key: str, texts: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """first_id and copy_id of every record that equals an earlier one."""
    codes, first = groups(records, key, texts, lists)
    return codes.join(first.where("n_copies > 1"), "tuple").where(F.col(key) != F.col("first_id")).select("first_id", F.col(key).alias("copy_id"))


def collapsed(records: DataFrame, key: str, texts: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """One row per group: the columns of its first record and n_copies (an existing column of that name is replaced)."""
    _, first = groups(records, key, texts, lists)
    kept = records.drop("n_copies", "first_id") if key not in ("n_copies", "first_id") else records
    return kept.join(first.select(F.col("first_id").alias(key), "n_copies"), key)
