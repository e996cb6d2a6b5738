import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.llm import consensus, splits

EXP = "rec_id long, dataset string, uid string, row_id long, gold int, model string, condition string, fmt string, paraphrase string, pred int"


def panel(spark, n=3000, seed=0, share=0.4):
    """Votes of eight models of known reliability, one of them by chance and one worse."""
    rng = np.random.default_rng(seed)
    true = (rng.random(n) < share).astype(int)
    rates = {"m0": (0.9, 0.8), "m1": (0.7, 0.95), "m2": (0.85, 0.85), "m3": (0.6, 0.7), "m4": (0.5, 0.5), "m5": (0.25, 0.3), "m6": (0.95, 0.75), "m7": (0.8, 0.9)}
    rows = []
    for i, t in enumerate(true):
        for m, (se, sp) in rates.items():
            if rng.random() < 0.85:
                p = int(rng.random() < (se if t else 1 - sp))
                rows.append((len(rows), "d", str(i), i, int(t), m, "c", "f", "p", p))
    return true, rates, spark.createDataFrame(rows, EXP)


def test_reliabilities_and_labels(spark):
    true, rates, exp = panel(spark)
    got = {r.model: r for r in consensus.reliability(exp).collect()}
    for m, (se, sp) in rates.items():
        assert got[m].sensitivity == pytest.approx(se, abs=0.05) and got[m].specificity == pytest.approx(sp, abs=0.05)
    labels = {r.uid: r.consensus for r in consensus.consensus(exp).collect()}
    acc = np.mean([labels[str(i)] == t for i, t in enumerate(true)])
    majority = exp.groupBy("uid").agg((F.avg("pred") > 0.5).cast("int").alias("p"), F.max("gold").alias("g")).where("p = g").count() / len(true)
    assert acc > 0.95 and acc > majority + 0.02


def test_disputed_finds_wrong_gold(spark):
    true, _, exp = panel(spark, 1500, 1)
    wrong = [str(i) for i in range(0, 1500, 50)]
    bad = exp.withColumn("gold", F.when(F.col("uid").isin(wrong), 1 - F.col("gold")).otherwise(F.col("gold")))
    found = {r.uid for r in consensus.disputed(bad).collect()}
    assert len(found & set(wrong)) >= 0.9 * len(wrong)


def test_repeats_do_not_count(spark):
    _, _, exp = panel(spark, 300, 2)
    more = exp.unionByName(exp.withColumn("rec_id", F.col("rec_id") + 10**6)).unionByName(exp.where("uid < '2'").withColumn("rec_id", F.col("rec_id") + 2 * 10**6))
    key = lambda df: sorted((r.uid, r.consensus, r.log_odds, r.n_votes) for r in consensus.consensus(df).collect())
    assert key(exp) == key(more)
    assert consensus.agreement(exp).collect() == consensus.agreement(more).collect()


def test_edges_of_consensus(spark):
    empty = spark.createDataFrame([], EXP)
    for f in (consensus.consensus, consensus.disputed, consensus.reliability, consensus.agreement):
        assert f(empty).count() == 0
    none = spark.createDataFrame([(None,) * 10, (1, "d", "1", 1, 1, "m", "c", "f", "p", None)], EXP).withColumns({"votes": F.lit(1), "arms": F.lit(2), "k": F.lit(3)})
    assert {r.consensus for r in consensus.consensus(none).collect()} == {None} and consensus.reliability(none).count() == 0
    two = spark.createDataFrame([(i, "d", str(i), i, 0, m, "c", "f", "p", p) for i in range(3) for m, p in (("a", 1), ("b", i % 2))], EXP)
    got = {r.uid: r.consensus for r in consensus.consensus(two).collect()}
    assert got == {"0": None, "1": 1, "2": None}  # two annotators tell nothing of each other: a tie has no consensus
    alike = spark.createDataFrame([(i, "d", str(i), i, 0, m, "c", "f", "p", 1) for i in range(3) for m in "abcd"], EXP)
    assert {r.consensus for r in consensus.consensus(alike).collect()} == {1} and consensus.agreement(alike).first().alpha is None


def test_third_moments_in_several_passes(spark):
    _, _, exp = panel(spark, 400, 3)
    votes = consensus.item_votes(exp)
    names = consensus.annotators(votes)
    one, many = consensus.solve(votes, names), consensus.solve(votes, names, most=2 * 64 * 3)
    assert one["share"] == pytest.approx(many["share"]) and np.allclose(one["sensitivity"], many["sensitivity"])


def brute_groups(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {(d, find((d, r))[1], r) for d, r in root if find((d, r)) != (d, r)}


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_linked_rows(spark, shape):
    rng = np.random.default_rng(4)
    if shape == "random":
        items = [(f"u{i}", sorted({int(x) for x in rng.integers(0, 60, rng.integers(1, 3))})) for i in range(40)]
    elif shape == "chain":
        order = [int(x) for x in rng.permutation(64)]
        items = [(f"u{i}", [order[i], order[i + 1]]) for i in range(63)]
    else:
        items = [(f"u{i}", [7, 100 + i]) for i in range(50)]
    rows = [(len(items), d, u, r, 0, "m", "c", "f", "p", 1) for d in ("d", "e") for u, rs in items for r in rs] + [(0, "d", "u0", None, 0, "m", "c", "f", "p", 1), (0, "d", None, 3, 0, "m", "c", "f", "p", 1)]
    got = {tuple(r) for r in splits.together(spark.createDataFrame(rows, EXP)).collect()}
    pairs = [((d, rs[0]), (d, r)) for d in ("d", "e") for _, rs in items for r in rs]
    assert got == brute_groups(pairs)


def test_split_keeps_together_and_meets_shares(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        row = int(rng.integers(0, 700)) if i % 3 else 5  # one source row holds a third
        for m in range(int(rng.integers(1, 4))):
            rows.append((len(rows), "d", f"u{i}", row, int(rng.random() < 0.4), f"m{m}", "c", "f", "p", 1))
        if i % 97 == 0:
            rows.append((len(rows), "d", f"u{i}", int(rng.integers(0, 700)), 1, "m9", "c", "f", "p", 1))
    rows += [(len(rows) + i, "d", None, 3 if i else None, None, None, None, None, None, None) for i in range(2)]
    exp = spark.createDataFrame(rows, EXP).withColumns({"component": F.lit("x"), "split": F.lit("y"), "n": F.lit(1)})
    got = splits.split_records(exp).collect()
    assert len(got) == len(rows) and all(r.split in splits.SPLITS for r in got)
    for key in ("uid", "row_id"):
        seen = {}
        for r in got:
            if r[key] is not None:
                assert seen.setdefault(r[key], r.split) == r.split
    share = {s: sum(r.split == s for r in got) / len(got) for s in splits.SPLITS}
    assert share["train"] == pytest.approx(0.8, abs=0.01) and share["test"] == pytest.approx(0.1, abs=0.01)
    again = {r.rec_id: r.split for r in splits.split_records(exp.repartition(3)).collect()}
    assert again == {r.rec_id: r.split for r in got}


def test_annealing_improves_on_hashing():
    rng = np.random.default_rng(6)
    size = rng.integers(1, 30, 500).astype(float)
    ones = np.floor(size * rng.random(500))
    start = rng.choice(3, 500, p=[0.8, 0.1, 0.1])
    goal = np.array([0.8, 0.1, 0.1]) * size.sum()
    cost, at = splits.anneal(size, ones, start, goal, 0)
    before = np.abs(np.bincount(start, size, 3) - goal).sum() / size.sum()
    after = np.abs(np.bincount(at, size, 3) - goal).sum() / size.sum()
    assert after < 0.005 < before and cost < 0.02


def test_edges_of_splits(spark):
    empty = spark.createDataFrame([], EXP)
    assert splits.together(empty).count() == 0 and splits.split_records(empty).count() == 0
    none = spark.createDataFrame([(None,) * 10, (1, None, "u", 1, None, None, None, None, None, None)], EXP)
    assert splits.split_records(none).count() == 2 and splits.split_report(none).count() >= 1
