"""Committees of judges: decisions, frontiers and agreement, over compressed vote patterns.

A decision depends on which members voted and how, so items with equal votes and gold are counted once: per item two
bit masks (who voted, who voted 1), per committee one mask, and bit counts in between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions import metrics
from quorate.operators.verdicts import first_rows, main_condition
from quorate.plans.lineage import workers

#: Shares of agreeing votes from which a committee commits.
TAUS = (0.5, 0.6, 0.7, 0.8, 1.0)


def decision(ones: Column, voted: Column, tau: Column | float) -> Column:
    """1 or 0 where the larger share of votes reaches ``tau`` (a tie is 1); null below it or without votes."""
    p = metrics.ratio(ones, voted)
    return F.when((voted > 0) & (F.greatest(p, 1 - p) >= tau), (ones * 2 >= voted).cast("int"))


def members(roster: DataFrame) -> list[str]:
    """Members in alphabetical order, from the fixed table of the panel."""
    return sorted(r["model"] for r in roster.select("model").distinct().collect())


def panel_votes(experiment: DataFrame, panel: Sequence[str], by: tuple[str, ...] = ("dataset", "condition")) -> DataFrame:
    """Per group and item: gold, row_id and the masks ``voted`` and ``ones`` (bit i for member i); other judges are left out."""
    bit = F.create_map(*[x for i, m in enumerate(panel) for x in (F.lit(m), F.lit(1 << i))])
    rows = first_rows(experiment.where(F.col("model").isin(*panel))).withColumn("bit", F.try_element_at(bit, F.col("model")))
    mask = lambda on: F.coalesce(F.bit_or(F.when(on, F.col("bit"))), F.lit(0))
    pred = F.col("pred")
    return rows.groupBy(*by, "uid").agg(F.max("gold").alias("gold"), F.min("row_id").alias("row_id"), mask(pred.isNotNull()).alias("voted"), mask(pred == 1).alias("ones"))


def panel_decide(experiment: DataFrame, roster: DataFrame, taus: Sequence[float] = TAUS) -> DataFrame:
    """Decision of the whole panel on every item at each tau: votes, ones and decision."""
    panel = members(roster)
    items = panel_votes(experiment, panel).select("dataset", "condition", "uid", F.bit_count("voted").alias("n_votes"), F.bit_count("ones").alias("n_ones"), F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau"))
    return items.select("dataset", "condition", "uid", "tau", "n_votes", "n_ones", decision(F.col("n_ones"), F.col("n_votes"), F.col("tau")).alias("decision"))


def panel_scores(experiment: DataFrame, roster: DataFrame) -> DataFrame:
    """Scores of the whole panel per dataset, condition and tau: the selective curve."""
    panel = members(roster)
    patterns = panel_votes(experiment, panel).groupBy("dataset", "condition", F.bit_count("voted").alias("v"), F.bit_count("ones").alias("k"), "gold").count()
    taus = F.explode(F.array(*[F.lit(float(t)) for t in TAUS])).alias("tau")
    rows = patterns.select("*", taus).withColumn("d", decision(F.col("k"), F.col("v"), F.col("tau")))
    return rows.groupBy("dataset", "condition", "tau").agg(*metrics.cells(F.col("d"), F.col("gold"), F.col("count"))).select("dataset", "condition", "tau", *metrics.CELLS, *metrics.scores())


def sizes(n: int) -> list[int]:
    """Committee sizes that are looked at: the odd ones and the whole panel."""
    return sorted({k for k in range(1, n + 1, 2)} | {n})


def masks(n: int, wanted: Sequence[int]) -> Column:
    """One row per committee of the wanted sizes among ``n`` members; the list is a constant of the plan."""
    listed = ",".join(str(m) for m in range(1, 1 << n) if m.bit_count() in set(wanted))
    return F.explode(F.split(F.lit(listed), ",").cast("array<int>")).alias("mask")


def frontier(experiment: DataFrame, roster: DataFrame, only: Sequence[int] | None = None) -> DataFrame:
    """Scores of every committee of each size at each tau, per dataset under its main condition.

    Columns dataset, mask, k, tau, cost (k times the items), coverage, n and the scores.  The work is one pass over
    distinct vote patterns for each of at most 2^n committees, whatever the number of items.
    """
    panel = members(roster)
    wanted = list(only) if only is not None else sizes(len(panel))
    items = panel_votes(experiment, panel).join(main_condition(experiment), ["dataset", "condition"])
    # Few bytes make many rows here, so patterns are dealt out over all tasks.
    patterns = items.groupBy("dataset", "voted", "ones", "gold").agg(F.count("*").alias("w")).repartition(workers(experiment.sparkSession))
    each = patterns.select("*", masks(len(panel), wanted))
    # Votes of a committee on a pattern: at most (k+1)(k+2)/2 outcomes, so a second grouping leaves little to score.
    # Mask, votes, ones and gold are one number, which is cheaper to group by than four.
    both = lambda c: F.bit_count(F.col(c).bitwiseAND(F.col("mask"))).cast("bigint")
    code = F.shiftleft(F.col("mask").cast("bigint"), 16) + F.shiftleft(both("voted"), 9) + F.shiftleft(both("ones"), 2) + F.when(F.col("gold").isin(0, 1), F.col("gold")).otherwise(2)
    seen = each.groupBy("dataset", code.alias("code")).agg(F.sum("w").alias("w"))
    part = lambda shift, bits: F.shiftright("code", shift).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).cast("int")
    parted = seen.select("dataset", "w", F.shiftright("code", 16).cast("int").alias("mask"), part(9, 7).alias("v"), part(2, 7).alias("k1"), F.nullif(part(0, 2), F.lit(2)).alias("gold"))
    rows = parted.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in TAUS]))).withColumn("d", decision(F.col("k1"), F.col("v"), F.col("tau")))
    scored = rows.groupBy("dataset", "mask", "tau").agg(*metrics.cells(F.col("d"), F.col("gold"), F.col("w")), F.sum("w").alias("items"))
    k = F.bit_count("mask")
    return scored.select("dataset", "mask", k.alias("k"), "tau", (k * F.col("items")).alias("cost"), *metrics.scores())


def item_votes(experiment: DataFrame, roster: DataFrame) -> DataFrame:
    """What every member says of each item, as ``member=verdict`` in the panel's order, and the panel's decision without a threshold.

    A member that is silent is written with ``-``, one without a row not at all.
    """
    panel = members(roster)
    rows = first_rows(experiment.where(F.col("model").isin(*panel)))
    said = F.struct("model", F.concat(F.col("model"), F.lit("="), F.coalesce(F.col("pred").cast("string"), F.lit("-"))).alias("text"))
    per = rows.groupBy("dataset", "condition", "uid").agg(F.array_sort(F.collect_list(said)).alias("said"), F.count("pred").alias("n_votes"), F.coalesce(F.sum("pred"), F.lit(0)).alias("n_ones"))
    return per.select("dataset", "condition", "uid", F.array_join("said.text", " ").alias("votes"), decision(F.col("n_ones"), F.col("n_votes"), 0.0).alias("decision"))


def member_names(panel: Sequence[str], mask: Column) -> Column:
    """Names of a committee, joined by commas in the panel's order."""
    return F.concat_ws(",", *[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, m) for i, m in enumerate(panel)])


def frontier_by_k(experiment: DataFrame, roster: DataFrame, tau: float = 0.5) -> DataFrame:
    """Mean cost and mean kappa of the committees of each size; committees without a kappa are left out of its mean."""
    rows = frontier(experiment, roster).where(F.col("tau") == tau)
    return rows.groupBy("dataset", "k").agg(F.count("*").alias("n_committees"), F.avg("cost").alias("mean_cost"), F.round(F.avg(F.round("kappa", 9)), 6).alias("mean_kappa"))


def agreement(experiment: DataFrame, roster: DataFrame) -> DataFrame:
    """Fleiss' kappa over items that every member judged, the panel's kappa against gold and its balanced accuracy, per dataset and condition."""
    panel = members(roster)
    n = len(panel)
    votes = panel_votes(experiment, panel).withColumn("k", F.bit_count("ones")).withColumn("v", F.bit_count("voted"))
    patterns = votes.groupBy("dataset", "condition", "v", "k", "gold").count()
    full, w, k = F.col("v") == n, F.col("count"), F.col("k")
    d = decision(k, F.col("v"), F.lit(0.5))
    agg = patterns.groupBy("dataset", "condition").agg(
        F.coalesce(F.sum(F.when(full, w)), F.lit(0)).alias("n_full"),
        F.coalesce(F.sum(F.when(full, w * k)), F.lit(0)).alias("s1"),
        F.coalesce(F.sum(F.when(full, w * (k * k + (n - k) * (n - k)))), F.lit(0)).alias("s2"),
        *metrics.cells(d, F.col("gold"), w),
    )
    c = {x: F.col(x) for x in metrics.CELLS}
    return agg.select("dataset", "condition", "n_full", metrics.fleiss(F.lit(n), F.col("n_full"), F.col("s1"), F.col("s2")).alias("fleiss_kappa"), metrics.kappa(c).alias("panel_gold_kappa"), metrics.balanced_committed(c).alias("panel_bal_acc_committed"))


def committee_agreement(experiment: DataFrame, roster: DataFrame, k: int = 3) -> DataFrame:
    """Fleiss' kappa of every committee of ``k`` members over the items all of them judged, per dataset under its main condition."""
    panel = members(roster)
    patterns = panel_votes(experiment, panel).join(main_condition(experiment), ["dataset", "condition"]).groupBy("dataset", "voted", "ones").count().repartition(workers(experiment.sparkSession))
    each = patterns.select("*", masks(len(panel), [k])).where(F.col("voted").bitwiseAND(F.col("mask")) == F.col("mask"))
    ones, w = F.bit_count(F.col("ones").bitwiseAND(F.col("mask"))), F.col("count")
    agg = each.groupBy("dataset", "mask").agg(F.sum(w).alias("n_full"), F.sum(w * ones).alias("s1"), F.sum(w * (ones * ones + (k - ones) * (k - ones))).alias("s2"))
    return agg.select("dataset", "mask", "n_full", metrics.fleiss(F.lit(k), F.col("n_full"), F.col("s1"), F.col("s2")).alias("fleiss_kappa"))
