"""Splits that keep related records together, by component swap search.

Records that share an item or a source row, directly or through other records, form a component.  Components start in
the split that their hash gives and are moved or exchanged by annealing until sizes and labels meet the wanted
proportions.  Components that hold much of all records are settled first, all others in blocks that anneal in parallel
towards what is left; several chains run per block and the best one counts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.plans.lineage import cut, workers

SPLITS = ("train", "validation", "test")


def stars(edges: DataFrame, scope: str = "dataset") -> DataFrame:
    """Connected components within each ``scope``: (scope, v, root) for every node but the roots, root the smallest node.

    ``edges`` has (scope, u, v).  Alternating star contraction: every node first hands its larger neighbours, then its
    smaller ones, to its smallest neighbour, until nothing changes.  Each step joins neighbours with one minimum per
    node, so that no neighbourhood gathers in one place; each is written, so lineage stays short.
    """
    high, low = F.greatest("u", "v"), F.least("u", "v")
    now = cut(edges.where("u <> v").select(scope, high.alias("u"), low.alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(scope, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(scope, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, [scope, "u"]).where("v > u").select(scope, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy(scope, "u").agg(F.min("v").alias("m"))
        small = large.join(down, [scope, "u"])
        now = cut(small.where("v <> m").select(scope, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select(scope, "u", F.col("m").alias("v"))).distinct())
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64(scope, "u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            return now.select(scope, F.col("u").alias("v"), F.col("v").alias("root"))
        mark = new


def items_of(records: DataFrame) -> DataFrame:
    """One row per item and source row: dataset, uid, row_id, n records, ones (gold 1), labelled (gold not null)."""
    return records.groupBy("dataset", "uid", "row_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("gold", F.lit(0))).alias("ones"), F.count("gold").alias("labelled"))


def linked_rows(records: DataFrame) -> DataFrame:
    """Source rows that must stay with another one: (dataset, v, root), root the smallest row_id of the group.

    Rows are linked by items that carry more than one of them; a null row_id links nothing.
    """
    rows = records.where("row_id IS NOT NULL AND uid IS NOT NULL AND dataset IS NOT NULL").select("dataset", "uid", "row_id").distinct()
    least = rows.groupBy("dataset", "uid").agg(F.min("row_id").alias("u"), F.max("row_id").alias("top")).where("u < top").select("dataset", "uid", "u")
    return stars(rows.join(least, ["dataset", "uid"]).select("dataset", "u", F.col("row_id").alias("v")))


def components(records: DataFrame, roots: DataFrame) -> DataFrame:
    """Component of each item: dataset, uid, component (string), n, ones, labelled; ``roots`` are its ``linked_rows``.

    A component is named by its smallest row_id.  An item without any row_id is its own component; one without uid
    follows its row_id; records with neither share one component per dataset.
    """
    roots = roots.withColumnRenamed("v", "row")
    items = items_of(records)
    whole = items.where("uid IS NOT NULL").groupBy("dataset", "uid").agg(F.min("row_id").alias("row"), *[F.sum(c).alias(c) for c in ("n", "ones", "labelled")])
    loose = items.where("uid IS NULL").groupBy("dataset", "row_id").agg(*[F.sum(c).alias(c) for c in ("n", "ones", "labelled")]).select("dataset", F.lit(None).cast("string").alias("uid"), F.col("row_id").alias("row"), "n", "ones", "labelled")
    named = whole.unionByName(loose).join(roots, ["dataset", "row"], "left")
    row = F.coalesce("root", "row")
    name = F.concat_ws(":", F.coalesce("dataset", F.lit("")), F.when(row.isNotNull(), F.concat(F.lit("row"), row)).when(F.col("uid").isNotNull(), F.concat(F.lit("item"), "uid")).otherwise("none"))
    return named.select("dataset", "uid", row.alias("row"), name.alias("component"), "n", "ones", "labelled")


def anneal(size: np.ndarray, ones: np.ndarray, start: np.ndarray, goal: np.ndarray, seed: int, rounds: int = 40) -> tuple[float, np.ndarray]:
    """Best assignment that one chain finds, and its deviation.

    ``goal`` has the wanted records of each split; labels should follow the same proportions.  A step moves a component
    to another split or exchanges two of different splits; worse states are kept with a probability that falls.
    """
    rng, k, n = np.random.default_rng(seed), len(goal), len(size)
    total, label = max(float(size.sum()), 1.0), max(float(ones.sum()), 1.0)
    parts = goal / max(goal.sum(), 1e-9)
    want, want1 = [float(x) for x in parts * size.sum()], [float(x) for x in parts * ones.sum()]
    have, have1 = [float(x) for x in np.bincount(start, size, k)], [float(x) for x in np.bincount(start, ones, k)]
    at, kept, sizes, labels = start.tolist(), start.copy(), size.tolist(), ones.tolist()

    def off(split: int, more: float, more1: float) -> float:
        return abs(have[split] + more - want[split]) / total + 0.5 * abs(have1[split] + more1 - want1[split]) / label

    now = best = sum(off(s, 0.0, 0.0) for s in range(k))
    steps = rounds * n + 400
    picks, others, splits, lucks = rng.integers(0, n, steps).tolist(), rng.integers(0, n, steps).tolist(), rng.integers(0, k, steps).tolist(), rng.random(steps).tolist()
    changed: list[tuple[int, int]] = []  # moves since the best state
    for step, (i, j, split, luck) in enumerate(zip(picks, others, splits, lucks, strict=True)):
        swap = not step % 2
        a, b = at[i], at[j] if swap else split
        if a == b:
            continue
        ds, d1 = (sizes[i] - sizes[j], labels[i] - labels[j]) if swap else (sizes[i], labels[i])
        new = now - off(a, 0.0, 0.0) - off(b, 0.0, 0.0) + off(a, -ds, -d1) + off(b, ds, d1)
        heat = 0.02 * (1 - step / steps) ** 3 / n**0.5
        if new <= now or (heat > 0 and luck < math.exp((now - new) / heat)):
            at[i] = b
            changed.append((i, b))
            if swap:
                at[j] = a
                changed.append((j, a))
            have[a], have[b], have1[a], have1[b], now = have[a] - ds, have[b] + ds, have1[a] - d1, have1[b] + d1, new
            if now < best - 1e-12:
                best = now
                for c, to in changed:
                    kept[c] = to
                changed.clear()
                if best < 1e-9:
                    break
    return best, kept


def _chains(goal: list[float], seed: int, chains: int):
    goal = np.asarray(goal, float)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("component", kind="stable").reset_index(drop=True)
        block, args = int(part["block"].iloc[0]), (part["n"].to_numpy(float), part["ones"].to_numpy(float), part["start"].to_numpy(), goal)
        _, at = min((anneal(*args, hash((seed, block, chain)) & 0x7FFFFFFF) for chain in range(chains)), key=lambda r: r[0])
        return pd.DataFrame({"component": part["component"], "n": part["n"], "split": at})

    return run


def assign(parts: DataFrame, shares: tuple[float, ...] = (0.8, 0.1, 0.1), seed: int = 0, block: int = 2000, chains: int = 4, heavy: float = 0.0005) -> DataFrame:
    """Split of each component (component, split) from ``parts`` (component, n, ones).

    Components with more than the share ``heavy`` of all records, of which there are at most 1/heavy, are annealed
    together first.  The rest goes by hash to blocks of about ``block`` components that anneal at the same time towards
    what the heavy ones left open.  ``chains`` runs per block start alike and differ in their seed; the best one counts.
    """
    n_all, count = parts.agg(F.sum("n"), F.count("*")).first()
    if not count:
        return parts.select("component", F.lit(None).cast("string").alias("split"))
    point = (F.pmod(F.xxhash64(F.lit(seed), F.col("component")), F.lit(1_000_003)) / 1_000_003.0).alias("point")
    edges = np.cumsum(shares)
    start: Column = F.lit(len(shares) - 1)
    for k in reversed(range(len(shares) - 1)):
        start = F.when(point < float(edges[k]), k).otherwise(start)
    blocks = max(1, round(count / block))
    big = F.col("n") > heavy * n_all
    staged = cut(parts.select("component", "n", "ones", start.alias("start"), F.when(big, -1).otherwise(F.pmod(F.xxhash64(F.col("component")), F.lit(blocks)).cast("int")).alias("block")))
    # Few bytes take long here, so blocks are dealt out by number and not by size.
    tasks = min(4 * workers(parts.sparkSession), blocks)

    def settled_by(where: str, goal: list[float]) -> DataFrame:
        return cut(staged.where(where).repartition(tasks, "block").groupBy("block").applyInPandas(_chains(goal, seed, chains), "component string, n long, split int"))

    goal = [s * n_all for s in shares]
    settled = settled_by("block = -1", goal)
    taken = {r["split"]: r["n"] for r in settled.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    left = [max(0.0, g - taken.get(k, 0)) for k, g in enumerate(goal)]
    rest = settled_by("block >= 0", left if sum(left) > 0 else list(goal))
    names = F.array(*[F.lit(s) for s in SPLITS])
    return settled.unionByName(rest).select("component", F.element_at(names, F.col("split") + 1).alias("split"))


def split_records(records: DataFrame) -> DataFrame:
    """rec_id, dataset, uid, row_id, component and split of each record.

    Repeated records, records of one item and records of one source row stay together.  An empty table gives an empty one.
    """
    rec = records.select("rec_id", "dataset", "uid", "row_id", "gold")
    roots = linked_rows(rec)
    comp = cut(components(rec, roots))
    split = assign(comp.groupBy("component").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")))
    placed = cut(comp.select("dataset", "uid", "row", "component").join(split, "component"))
    out = ["rec_id", "dataset", "uid", "row_id", "component", "split"]
    known = rec.where("uid IS NOT NULL").alias("r").join(placed.where("uid IS NOT NULL").alias("p"), F.expr("r.dataset <=> p.dataset AND r.uid = p.uid"))
    loose = rec.where("uid IS NULL").alias("r")
    # Records without uid: their row may be part of a larger component under its root.
    rooted = loose.join(roots.alias("l"), F.expr("r.dataset <=> l.dataset AND r.row_id = l.v"), "left").select("r.*", F.coalesce("l.root", "r.row_id").alias("at"))
    lone = rooted.alias("r").join(placed.where("uid IS NULL").alias("p"), F.expr("r.dataset <=> p.dataset AND r.at <=> p.row"))
    pick = ["r.rec_id", "r.dataset", "r.uid", "r.row_id", "p.component", "p.split"]
    return known.select(pick).unionByName(lone.select(pick)).select(out)


def together(records: DataFrame) -> DataFrame:
    """Groups of source rows that must share a split: dataset, first_row_id, row_id (each other one)."""
    return linked_rows(records).select("dataset", F.col("root").alias("first_row_id"), F.col("v").alias("row_id"))


def split_report(records: DataFrame) -> DataFrame:
    """Records, components, labelled records and share of gold 1 in each split."""
    per = split_records(records).join(records.select("rec_id", "gold"), "rec_id")
    total = per.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("component").alias("n_components"), F.count("gold").alias("labelled"), F.sum("gold").alias("ones"))
    return total.select("split", "n", "n_components", "labelled", F.try_divide("ones", "labelled").alias("share_of_1"))
