"""Consensus labels from annotators who disagree, by the triplet moment method.

With x an annotator's vote, pi the share of positive items and d = sensitivity + specificity - 1, annotators who err
independently given the label have Cov(x_i, x_j) = pi (1 - pi) d_i d_j.  With v_i = sqrt(pi (1 - pi)) d_i every
triplet gives v_i^2 = C_ij C_ik / C_jk: agreement corrected for what chance alone would give.  The third central
moments are (1 - 2 pi) / sqrt(pi (1 - pi)) v_i v_j v_k, which gives pi and so each annotator's reliability on either
label.  Votes are then added up with their log-odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.plans.lineage import cut

#: Estimated rates stay this far from 0 and 1, so that no vote outweighs all others.
MARGIN = 0.01


def item_votes(verdicts: DataFrame) -> DataFrame:
    """One row per item: dataset, uid, gold, votes (annotator -> mean of its distinct verdicts, 0..1).

    Repeated rows of a verdict count once; a null pred is no vote, so an item may have an empty map.  An annotator
    asked under several conditions has one vote, the mean of its verdicts: they are no independent opinions.  The
    recorded gold is the one that most rows carry (a tie counts as 1), null where none does.
    """
    arm = F.struct("model", "condition", "fmt", "paraphrase", "pred")
    items = verdicts.groupBy("dataset", "uid").agg(
        F.collect_set(F.when(F.col("pred").isNotNull() & F.col("model").isNotNull(), arm)).alias("arms"),
        F.sum("gold").alias("ones"),
        F.count("gold").alias("golds"),
    )
    models = F.array_distinct(F.transform("arms", lambda a: a["model"]))

    def mean(m: Column) -> Column:
        mine = F.filter("arms", lambda a: a["model"] == m)
        return F.aggregate(mine, F.lit(0.0), lambda acc, a: acc + a["pred"]) / F.size(mine)

    votes = F.map_from_arrays(models, F.transform(models, mean))
    gold = F.when(F.col("golds") > 0, (F.col("ones") * 2 >= F.col("golds")).cast("int"))
    return items.select("dataset", "uid", gold.alias("gold"), votes.alias("votes"))


def annotators(votes: DataFrame) -> list[str]:
    """The annotators in order: a panel, whose size and not the data's decides what the driver holds."""
    return sorted(r[0] for r in votes.select(F.explode(F.map_keys("votes")).alias("m")).distinct().collect())


def _summed(votes: DataFrame, panel: list[str], shapes: dict[str, tuple[int, ...]], add) -> dict[str, np.ndarray]:
    """Sums over all items of the arrays that ``add`` makes of a slice of votes (z, zero where there is none) and of who voted (o).

    Each task reduces its items to one fixed-size set of sums; only these are shuffled and reach the driver.  Slices
    shrink as the panel grows, so that what a task holds beside its sums has a bound.
    """
    m = len(panel)
    size = max(1, min(4096, (1 << 22) // (m * m)))
    ends = np.cumsum([0, *[int(np.prod(s)) for s in shapes.values()]])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(s) for k, s in shapes.items()}
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, m)
            for lo in range(0, len(x), size):
                part = x[lo : lo + size]
                add(total, np.nan_to_num(part), (~np.isnan(part)).astype(float))
        flat = np.concatenate([v.ravel() for v in total.values()])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at])], ["i", "v"])

    dense = votes.select(F.array(*[F.try_element_at("votes", F.lit(a)) for a in panel]).alias("x"))
    got = dense.mapInArrow(reduce, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(ends[-1])
    flat[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return {k: flat[lo:hi].reshape(s) for (k, s), lo, hi in zip(shapes.items(), ends, ends[1:], strict=False)}


def moments(votes: DataFrame, panel: list[str]) -> dict[str, np.ndarray]:
    """Joint sums of the votes of each one and two annotators over all items."""
    m = len(panel)

    def add(total: dict[str, np.ndarray], z: np.ndarray, o: np.ndarray) -> None:
        for k, v in (("n1", o.sum(0)), ("s1", z.sum(0)), ("n2", o.T @ o), ("a2", z.T @ o), ("p2", z.T @ z)):
            total[k] += v

    return _summed(votes, panel, {"n1": (m,), "s1": (m,), "n2": (m, m), "a2": (m, m), "p2": (m, m)}, add)


def third_moments(votes: DataFrame, panel: list[str], mu: np.ndarray, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the products of three annotators' votes less their means over the items that all three judged, and the number of these, for the first of the three in ``at``."""
    m = len(panel)

    def add(total: dict[str, np.ndarray], z: np.ndarray, o: np.ndarray) -> None:
        # Votes less their means, zero without a vote: their products need no further terms.
        c = (z - mu) * o
        for k, i in enumerate(at):
            total["t3"][k] += (c * c[:, i : i + 1]).T @ c
            total["n3"][k] += (o * o[:, i : i + 1]).T @ o

    out = _summed(votes, panel, {"t3": (len(at), m, m), "n3": (len(at), m, m)}, add)
    return out["t3"], out["n3"]


def solve(votes: DataFrame, panel: list[str], most: int = 1 << 20) -> dict[str, np.ndarray | float]:
    """Share of positives and each annotator's sensitivity and specificity from the joint sums.

    The panel as a whole is taken to be better than chance, single annotators need not be.  Fewer than three
    annotators, or votes without any agreement, tell nothing: all then count alike.  Third moments are summed for as
    many annotators at a time as keeps the sums below ``most`` numbers: for 64 annotators and more in several passes.
    """
    s = moments(votes, panel)
    m = len(panel)
    n = np.maximum(s["n1"], 1)
    mu = s["s1"] / n
    n2 = np.maximum(s["n2"], 1)
    cov = (s["p2"] - mu[None, :] * s["a2"] - mu[:, None] * s["a2"].T + np.outer(mu, mu) * s["n2"]) / n2
    off = cov - np.diag(np.diag(cov))
    # For each annotator the triplets it is in: sum of C_ij C_ik C_jk over those of C_jk^2, without itself.
    weight = np.array([(np.delete(np.delete(off, i, 0), i, 1) ** 2).sum() for i in range(m)])
    square = np.divide(np.einsum("ij,jk,ki->i", off, off, off, optimize=True), weight, out=np.zeros(m), where=weight > 0)
    size = np.sqrt(np.maximum(square, 0))
    if m < 3 or not size.any():
        return {"share": 0.5, "sensitivity": np.full(m, 0.75), "specificity": np.full(m, 0.75), "votes": s["n1"]}
    v = size * np.where(np.linalg.eigh(off)[1][:, -1] < 0, -1, 1)
    v = -v if v.sum() < 0 else v

    top = bottom = 0.0
    step = max(1, min(m, most // (2 * m * m)))
    for lo in range(0, m, step):
        at = list(range(lo, min(m, lo + step)))
        t, n3 = third_moments(votes, panel, mu, at)
        i, j, k = np.array(at)[:, None, None], np.arange(m)[None, :, None], np.arange(m)[None, None, :]
        own = (n3 > 0) & (i < j) & (j < k)
        p = v[at][:, None, None] * v[None, :, None] * v[None, None, :]
        top += float((t / np.maximum(n3, 1) * p)[own].sum())
        bottom += float((p * p)[own].sum())
    skew = top / bottom if bottom > 0 else 0.0
    share = float(np.clip(0.5 * (1 - skew / np.sqrt(4 + skew * skew)), MARGIN, 1 - MARGIN))
    d = v / np.sqrt(share * (1 - share))
    edge = np.maximum(MARGIN, 1 / (s["n1"] + 2))
    keep = lambda x: np.minimum(np.maximum(x, edge), 1 - edge)
    return {"share": share, "sensitivity": keep(mu + (1 - share) * d), "specificity": keep(1 - mu + share * d), "votes": s["n1"]}


def weights(model: dict) -> tuple[float, list[float], list[float]]:
    """Log-odds of the prior, of a vote for 1 and of a vote for 0; rounded, so that sums do not depend on their order."""
    se, sp = model["sensitivity"], model["specificity"]
    odds = lambda x: [round(float(w), 9) for w in np.log(x)]
    return round(float(np.log(model["share"] / (1 - model["share"]))), 9), odds(se / (1 - sp)), odds((1 - se) / sp)


def fit(votes: DataFrame) -> tuple[list[str], dict]:
    """The annotators and their model; both empty where there is no vote."""
    panel = annotators(votes)
    return panel, solve(votes, panel) if panel else {"share": 0.5, "sensitivity": np.zeros(0), "specificity": np.zeros(0), "votes": np.zeros(0)}


def labels(votes: DataFrame, panel: list[str], model: dict) -> DataFrame:
    """dataset, uid, gold, consensus (0 or 1), log_odds and n_votes of each item.

    An item without votes, or whose votes weigh exactly nothing, has a null consensus.
    """
    prior, one, zero = weights(model)
    told = lambda w: F.map_from_arrays(F.array(*[F.lit(a) for a in panel]), F.array(*[F.lit(x) for x in w])) if panel else F.lit(None).cast("map<string,double>")
    weigh = lambda e: e["value"] * F.try_element_at(told(one), e["key"]) + (1 - e["value"]) * F.try_element_at(told(zero), e["key"])
    score = F.aggregate(F.map_entries("votes"), F.lit(prior), lambda acc, e: acc + F.coalesce(weigh(e), F.lit(0.0)))
    odds = F.round(F.when(F.size("votes") > 0, score), 6)
    return votes.select("dataset", "uid", "gold", F.when(odds > 0, 1).when(odds < 0, 0).alias("consensus"), odds.alias("log_odds"), F.size("votes").alias("n_votes"))


def consensus(verdicts: DataFrame) -> DataFrame:
    """Consensus label of each item of a verdict table (columns of ``labels``)."""
    votes = cut(item_votes(verdicts))
    return labels(votes, *fit(votes))


def reliability(verdicts: DataFrame) -> DataFrame:
    """model, sensitivity, specificity, balanced_accuracy, weight_1, weight_0 and n_votes of each annotator."""
    spark = verdicts.sparkSession
    panel, model = fit(cut(item_votes(verdicts)))
    _, one, zero = weights(model) if panel else (0, [], [])
    rows = [(a, float(se), float(sp), float(se + sp) / 2, w1, w0, int(n)) for a, se, sp, w1, w0, n in zip(panel, model["sensitivity"], model["specificity"], one, zero, model["votes"], strict=True)]
    return spark.createDataFrame(rows, "model string, sensitivity double, specificity double, balanced_accuracy double, weight_1 double, weight_0 double, n_votes long")


def agreement(verdicts: DataFrame) -> DataFrame:
    """Agreement per dataset beyond chance (nominal alpha over items with two verdicts or more).

    dataset, n_items, n_votes, agreement (share of agreeing pairs) and alpha; null where no item has two verdicts, alpha
    also where all verdicts are alike.  Every distinct verdict counts, under whatever condition.
    """
    arm = F.struct("model", "condition", "fmt", "paraphrase", "pred")
    items = verdicts.groupBy("dataset", "uid").agg(F.collect_set(F.when(F.col("pred").isNotNull(), arm)).alias("arms"))
    n, ones = F.col("n"), F.col("ones")
    counted = items.select("dataset", F.size("arms").alias("n"), F.size(F.filter("arms", lambda a: a["pred"] == 1)).alias("ones")).where("n >= 2")
    alike = (ones * (ones - 1) + (n - ones) * (n - ones - 1)) / (n - 1)
    per = counted.groupBy("dataset", "n", "ones").count().withColumn("alike", alike * F.col("count"))
    total = per.groupBy("dataset").agg(F.sum("count").alias("n_items"), F.sum(n * F.col("count")).alias("n_votes"), F.sum(ones * F.col("count")).alias("ones"), F.sum(F.round("alike", 9)).alias("alike"))
    nv = F.col("n_votes")
    chance = (ones * (ones - 1) + (nv - ones) * (nv - ones - 1)) / (nv * (nv - 1))
    observed = F.col("alike") / nv
    return total.select("dataset", "n_items", "n_votes", F.round(observed, 6).alias("agreement"), F.round(F.try_divide(observed - chance, 1 - chance), 6).alias("alpha"))


def disputed(verdicts: DataFrame) -> DataFrame:
    """Items whose consensus is not the recorded gold (dataset, uid); no case without a gold or a consensus."""
    return consensus(verdicts).where("consensus <> gold").select("dataset", "uid")
