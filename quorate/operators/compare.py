"""Comparing runs, indexes and rebuilds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.functions import metrics
from quorate.functions.text import content_key
from quorate.operators.verdicts import first_rows


def index_drift(built: DataFrame, index: DataFrame, fields: tuple[str, ...] = ("row_id", "kind", "gold", "stratum", "category", "src_sha1")) -> DataFrame:
    """One row per check: keys that only one side has, and per field the shared keys whose values differ.

    Each side counts once per uid, with the smallest value of a field where repeated rows disagree.
    """
    side = lambda df, p: df.groupBy("uid").agg(*[F.min(f).alias(f"{p}_{f}") for f in fields], F.lit(1).alias(p))
    both = side(built, "b").join(side(index, "i"), "uid", "full_outer")
    have = F.col("b").isNotNull() & F.col("i").isNotNull()
    checks = [("only_in_rebuild", F.col("i").isNull()), ("only_in_index", F.col("b").isNull())] + [(f, have & ~F.col(f"b_{f}").eqNullSafe(F.col(f"i_{f}"))) for f in fields]
    counted = both.agg(*[F.count_if(c).alias(n) for n, c in checks])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n, _ in checks])).alias("c")).select("c.check", "c.n")


def rebuilt_index(instances: DataFrame, dataset: str) -> DataFrame:
    """Join index of a dataset from its items."""
    return instances.where(F.col("dataset") == dataset).select("uid", "row_id", "kind", "gold", "stratum", "category", content_key(F.col("question"), F.col("context"), F.col("candidate")).alias("src_sha1"))


def keyed_verdicts(experiment: DataFrame, instances: DataFrame) -> DataFrame:
    """Per dataset: verdicts with a content key, those whose key is their item's, and those whose item is missing."""
    items = instances.select("dataset", "uid", content_key(F.col("question"), F.col("context"), F.col("candidate")).alias("item_key"))
    rows = experiment.where("src_key IS NOT NULL").select("dataset", "uid", "src_key").join(items, ["dataset", "uid"], "left")
    return rows.groupBy("dataset").agg(F.count("*").alias("n_keyed"), F.count_if(F.lower("src_key") == F.col("item_key")).alias("n_same"), F.count_if(F.col("item_key").isNull()).alias("n_missing"))


def run_compare(a: DataFrame, b: DataFrame, least: float = 0.95) -> DataFrame:
    """Agreement of two runs per dataset and judge over the items that both runs have.

    ``a`` and ``b`` are verdict tables.  Items both committed on give agreement and both kappas; coverage counts the
    shared items of each run.  Judges of one run only have null figures and are named by ``side``.
    """
    key = ("dataset", "uid", "model")
    va, vb = first_rows(a, key), first_rows(b, key)
    shared = a.select("dataset", "uid").distinct().join(b.select("dataset", "uid").distinct(), ["dataset", "uid"])
    pick = lambda v, p: v.join(shared, ["dataset", "uid"]).select("dataset", "uid", "model", F.col("pred").alias(f"p{p}"), F.col("gold").alias(f"g{p}"), F.lit(1).alias(p))
    both = pick(va, "a").join(pick(vb, "b"), list(key), "full_outer")
    ok = F.col("pa").isNotNull() & F.col("pb").isNotNull()
    count = lambda c: F.count_if(c)
    cells = [count(ok & (F.col("ga") == g) & (F.col(f"p{s}") == p)).alias(f"{n}_{s}") for s in ("a", "b") for n, g, p in (("tp", 1, 1), ("fn", 1, 0), ("fp", 0, 1), ("tn", 0, 0))]
    per = both.groupBy("dataset", "model").agg(count(ok).alias("n_both"), count(ok & (F.col("pa") == F.col("pb"))).alias("n_agree"), F.count("pa").alias("said_a"), F.count("pb").alias("said_b"), F.max("a").alias("in_a"), F.max("b").alias("in_b"), *cells)
    total = shared.groupBy("dataset").agg(F.count("*").alias("n_shared"))
    k = {s: metrics.kappa({c: F.col(f"{c}_{s}") for c in ("tp", "fn", "fp", "tn")}) for s in ("a", "b")}
    agree = metrics.ratio(F.col("n_agree"), F.col("n_both"))
    side = F.when(F.col("in_b").isNull(), "a").when(F.col("in_a").isNull(), "b").otherwise("both")
    return per.join(total, "dataset").select(
        "dataset", "model", side.alias("side"), "n_shared", "n_both", agree.alias("agreement"), k["a"].alias("kappa_a"), k["b"].alias("kappa_b"),
        metrics.ratio(F.col("said_a"), F.col("n_shared")).alias("coverage_a"), metrics.ratio(F.col("said_b"), F.col("n_shared")).alias("coverage_b"), F.coalesce((agree < least).cast("int"), F.lit(0)).alias("is_low"),
    )
