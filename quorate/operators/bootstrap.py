"""Paired cluster bootstrap of judge scores from per-cluster counts.

All draws of a dataset are one table of cluster weights, shared by its judges; every replicate is a weighted sum of
integer counts per cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.functions import metrics
from quorate.functions.digests import points
from quorate.operators.ranks import numbered
from quorate.operators.verdicts import first_rows
from quorate.plans.lineage import cut, workers

#: Draws of the reference's estimator, and clusters whose weights in a draw move together.
DRAWS, BLOCK = 2000, 4096


def cluster_counts(experiment: DataFrame) -> DataFrame:
    """tp, fn, fp, tn, a1 and a0 per dataset, condition, judge and source row; rows without gold or row_id count nowhere."""
    rows = first_rows(experiment).where("gold IS NOT NULL AND row_id IS NOT NULL")
    return rows.groupBy("dataset", "condition", "model", "row_id").agg(*metrics.cells(F.col("pred"), F.col("gold")))


def ranked_clusters(counts: DataFrame) -> DataFrame:
    """dataset, row_id, rank (from 0, in the numeric order of row_id) and size (clusters of the dataset)."""
    ranks = numbered(counts.select("dataset", "row_id").distinct(), ["dataset"], ["row_id"])
    return ranks.join(ranks.groupBy("dataset").agg(F.count("*").alias("size")), "dataset")


def _per_draw(clusters: DataFrame, b: int) -> DataFrame:
    """dataset, size and draw, dealt out over all tasks: a draw needs nothing but the number of clusters."""
    sizes = clusters.select("dataset", "size").distinct()
    return sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).repartition(workers(clusters.sparkSession), "dataset", "draw")


def _weights(seed: int, dataset: str, draw: int, size: int) -> np.ndarray:
    """How often a draw picks each cluster, by ``point(seed, dataset, draw, slot) % size``."""
    weight = np.zeros(size, dtype=np.int64)
    for drawn in points(f"{seed}|{dataset}|{draw}", size):
        np.add.at(weight, drawn % size, 1)
    return weight


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int]]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in ("dataset", "size", "draw")], strict=True)


def draws(clusters: DataFrame, b: int = DRAWS, seed: int = 0) -> DataFrame:
    """Weights of the clusters in each of ``b`` draws: dataset, draw, rank, weight.

    Each draw picks as many clusters as the dataset has, with replacement, by the hash of seed, dataset, draw and slot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dataset, size, draw in _each(batches):
            weight = _weights(seed, dataset, draw, size)
            rank = np.flatnonzero(weight)
            for i in range(0, len(rank), 1 << 16):
                r = rank[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(dataset), len(r)), pa.repeat(pa.scalar(draw, pa.int32()), len(r)), pa.array(r, pa.int64()), pa.array(weight[r], pa.int64())], names=["dataset", "draw", "rank", "weight"])

    return _per_draw(clusters, b).mapInArrow(run, "dataset string, draw int, rank long, weight long")


def exact_draws(spark, sizes: dict[str, int], b: int, seed: int = 0) -> DataFrame:
    """The same table with picks of numpy's default generator, for datasets small enough to draw on the driver."""
    rows = []
    for dataset, size in sizes.items():
        rng = np.random.default_rng(seed)
        for draw in range(b):
            rank, weight = np.unique(rng.integers(0, size, size), return_counts=True)
            rows += [(dataset, draw, int(r), int(w)) for r, w in zip(rank, weight, strict=True)]
    return spark.createDataFrame(rows, "dataset string, draw int, rank long, weight long")


def replicates(counts: DataFrame, clusters: DataFrame, weights: DataFrame) -> DataFrame:
    """kappa and balanced accuracy of every judge in every draw; a draw whose committed rows have one gold class has nulls."""
    # Few bytes make many rows here: both sides are dealt out by cluster, evenly, over all tasks.
    n = workers(counts.sparkSession)
    by_rank = counts.join(clusters.select("dataset", "row_id", "rank"), ["dataset", "row_id"]).repartition(n, "dataset", "rank")
    summed = by_rank.join(weights.repartition(n, "dataset", "rank"), ["dataset", "rank"]).groupBy("dataset", "condition", "model", "draw").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("tp", "fn", "fp", "tn")])
    c = {k: F.col(k) for k in ("tp", "fn", "fp", "tn")}
    return summed.select("dataset", "condition", "model", "draw", metrics.kappa(c).alias("kappa"), metrics.balanced_committed(c).alias("balanced_accuracy"))


def hashed_replicates(counts: DataFrame, clusters: DataFrame, b: int = DRAWS, seed: int = 0) -> DataFrame:
    """``replicates`` over ``draws``, with the weights of a block of clusters in one draw moved as one byte string.

    A task multiplies the weights of a block with the counts of its clusters; blocks add up.
    """
    cells = ["tp", "fn", "fp", "tn"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dataset, size, draw in _each(batches):
            weight = _weights(seed, dataset, draw, size)
            if weight.max() > 255:
                raise ValueError(f"draw {draw} of {dataset} picks one cluster more than 255 times")
            parts = [weight[i : i + BLOCK].astype(np.uint8).tobytes() for i in range(0, size, BLOCK)]
            for i in range(0, len(parts), 256):
                some = parts[i : i + 256]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(dataset), len(some)), pa.array(range(i, i + len(some)), pa.int64()), pa.repeat(pa.scalar(draw, pa.int32()), len(some)), pa.array(some, pa.binary())], names=["dataset", "block", "draw", "weights"])

    def multiply(own: pa.Table, weights: pa.Table) -> pa.Table:
        names = ["dataset", "condition", "model", "draw", *cells]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4]
        if not own.num_rows or not weights.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        dataset, drawn = own.column("dataset")[0].as_py(), weights.column("draw").to_pylist()
        w = np.stack([np.frombuffer(x, dtype=np.uint8) for x in weights.column("weights").to_pylist()]).astype(np.float64)
        judges: dict[tuple, int] = {}
        of = np.array([judges.setdefault(j, len(judges)) for j in zip(own.column("condition").to_pylist(), own.column("model").to_pylist(), strict=True)])
        rank = own.column("rank").to_numpy() % BLOCK
        sums = []
        for c in cells:  # whole numbers far below 2^53: exact
            m = np.zeros((w.shape[1], len(judges)))
            np.add.at(m, (rank, of), own.column(c).to_numpy())
            sums.append(pa.array((w @ m).T.ravel().astype(np.int64)))
        n = len(drawn)
        label = [pa.array([x for j in judges for x in [j[k]] * n], pa.string()) for k in (0, 1)]
        return pa.table([pa.repeat(pa.scalar(dataset), n * len(judges)), *label, pa.array(drawn * len(judges), pa.int32()), *sums], names=names)

    block = F.floor(F.col("rank") / BLOCK).alias("block")
    ranked = counts.join(clusters.select("dataset", "row_id", "rank"), ["dataset", "row_id"]).select("dataset", block, "condition", "model", "rank", *cells)
    packed = _per_draw(clusters, b).mapInArrow(pack, "dataset string, block long, draw int, weights binary")
    parts = ranked.groupBy("dataset", "block").cogroup(packed.groupBy("dataset", "block")).applyInArrow(multiply, "dataset string, condition string, model string, draw int, tp long, fn long, fp long, tn long")
    summed = parts.groupBy("dataset", "condition", "model", "draw").agg(*[F.sum(c).alias(c) for c in cells])
    c = {k: F.col(k) for k in cells}
    return summed.select("dataset", "condition", "model", "draw", metrics.kappa(c).alias("kappa"), metrics.balanced_committed(c).alias("balanced_accuracy"))


def intervals(reps: DataFrame) -> DataFrame:
    """Mean of the replicates and their 2.5 and 97.5 percentiles (linear interpolation), rounded to 6 places."""
    out = [F.count("kappa").alias("n_draws")]
    for m in ("kappa", "balanced_accuracy"):
        out.append(F.round(F.avg(F.round(m, 12)), 6).alias(m))
        out += [F.round(F.percentile(m, q), 6).alias(f"{m}_{e}") for e, q in (("lo", 0.025), ("hi", 0.975))]
    return reps.groupBy("dataset", "condition", "model").agg(*out)


def bootstrap(experiment: DataFrame, b: int = DRAWS, seed: int = 0) -> DataFrame:
    """Bootstrap intervals of every judge per dataset and condition, with its coverage over all rows with gold."""
    counts = cut(cluster_counts(experiment))
    clusters = cut(ranked_clusters(counts))
    reps = hashed_replicates(counts, clusters, b, seed)
    c = {k: F.col(k) for k in metrics.CELLS}
    total = counts.groupBy("dataset", "condition", "model").agg(*[F.sum(k).alias(k) for k in metrics.CELLS]).select("dataset", "condition", "model", metrics.coverage(c).alias("coverage"))
    return intervals(reps).join(total, ["dataset", "condition", "model"])
