import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.functions import metrics
from quorate.operators import bootstrap, committee, compare, cost, scorer, verdicts

EXP = "rec_id long, dataset string, uid string, row_id long, gold int, model string, condition string, fmt string, paraphrase string, pred int"


def rows(spark, *cells):
    return spark.createDataFrame([(i, "d", u, r, g, m, c, "f", "p", p) for i, (u, r, g, m, c, p) in enumerate(cells)], EXP)


def score(spark, pairs):
    e = rows(spark, *[(str(i), i, g, "m", "def_on", p) for i, (g, p) in enumerate(pairs)])
    return verdicts.judge_scores(e).first()


def test_hand_computed_scores(spark):
    r = score(spark, [(1, 1), (1, 1), (1, 0), (1, None), (0, 0), (0, 1)])
    assert (r.tp, r.fn, r.fp, r.tn, r.a1, r.a0) == (2, 1, 1, 1, 1, 0)
    assert r.coverage == pytest.approx(5 / 6)
    assert r.bal_acc_committed == pytest.approx((2 / 3 + 1 / 2) / 2)
    assert r.bal_acc_nonanswer_error == pytest.approx((2 / 4 + 1 / 2) / 2)
    po, pe = 3 / 5, (3 * 3 + 2 * 2) / 25
    assert r.kappa == pytest.approx((po - pe) / (1 - pe))
    assert r.macro_f1 == pytest.approx((4 / 6 + 2 / 4) / 2)


def test_single_class_and_all_abstain(spark):
    r = score(spark, [(1, 1), (1, 0)])
    assert r.kappa is None and r.bal_acc_committed is None and r.macro_f1 is None and r.bal_acc_nonanswer_error == 0.5
    r = score(spark, [(1, None), (0, None)])
    assert r.coverage == 0 and r.kappa is None and r.bal_acc_nonanswer_error == 0


def test_repeated_rows_count_once_and_nulls_have_a_group(spark):
    e = rows(spark, ("1", 1, 1, "m", "def_on", 1), ("1", 1, 1, "m", "def_on", 0), (None, None, None, None, None, None))
    got = {(r.uid, r.pred) for r in verdicts.first_rows(e).collect()}
    assert got == {("1", 1), (None, None)}
    assert verdicts.judge_scores(rows(spark)).count() == 0


@pytest.mark.parametrize(("ones", "voted", "tau", "want"), [(1, 2, 0.5, 1), (1, 2, 0.6, None), (0, 0, 0.5, None), (3, 5, 0.6, 1), (1, 5, 0.8, 0), (1, 5, 1.0, None), (5, 5, 1.0, 1)])
def test_decision(spark, ones, voted, tau, want):
    df = spark.createDataFrame([(ones, voted)], "k int, v int")
    assert df.select(committee.decision(F.col("k"), F.col("v"), F.lit(tau))).first()[0] == want


def test_frontier_against_enumeration(spark):
    from itertools import combinations

    rng = np.random.default_rng(3)
    panel = ["a", "b", "c", "d"]
    cells = [(str(u), u, int(rng.integers(2)), m, "def_on", None if rng.random() < 0.2 else int(rng.integers(2))) for u in range(40) for m in panel]
    gold = {c[0]: c[2] for c in cells}
    cells = [(u, r, gold[u], m, c, p) for u, r, _, m, c, p in cells]
    roster = spark.createDataFrame([(m,) for m in panel], "model string")
    got = {(r["mask"], r.tau): r for r in committee.frontier(rows(spark, *cells), roster).collect()}
    votes = {(u, m): p for u, _, _, m, _, p in cells}
    assert len(got) == (4 + 4 + 1) * 5
    for k in (1, 3, 4):
        for com in combinations(range(4), k):
            for tau in committee.TAUS:
                tp = fn = fp = tn = 0
                for u, g in gold.items():
                    v = [votes[u, panel[i]] for i in com if votes[u, panel[i]] is not None]
                    if not v:
                        continue
                    p = sum(v) / len(v)
                    if max(p, 1 - p) >= tau:
                        d = int(p >= 0.5)
                        tp, fn, fp, tn = tp + (g and d), fn + (g and not d), fp + (not g and d), tn + (not g and not d)
                r = got[sum(1 << i for i in com), tau]
                assert r.coverage == pytest.approx((tp + fn + fp + tn) / 40)
                assert r.cost == 40 * k
                if tp + fn and fp + tn:
                    assert r.bal_acc_committed == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2)


def test_fleiss(spark):
    # three raters, four complete items with 3, 2, 0 and 1 ones
    k = [3, 2, 0, 1]
    n, items = 3, 4
    df = spark.createDataFrame([(items, sum(k), sum(x * x + (n - x) ** 2 for x in k))], "i int, s int, q int")
    got = df.select(metrics.fleiss(F.lit(n), F.col("i"), F.col("s"), F.col("q"))).first()[0]
    pbar = np.mean([(x * (x - 1) + (n - x) * (n - x - 1)) / (n * (n - 1)) for x in k])
    p = sum(k) / (items * n)
    assert got == pytest.approx((pbar - (p * p + (1 - p) ** 2)) / (1 - (p * p + (1 - p) ** 2)))
    for n, i, s, q in ((1, 4, 2, 4), (3, 0, 0, 0), (3, 2, 6, 18)):
        df = spark.createDataFrame([(i, s, q)], "i int, s int, q int")
        assert df.select(metrics.fleiss(F.lit(n), F.col("i"), F.col("s"), F.col("q"))).first()[0] is None


def test_bootstrap_with_exact_draws(spark):
    rng = np.random.default_rng(1)
    cells = [(f"{c}:{i}", c, int(rng.integers(2)), "m", "def_on", None if rng.random() < 0.1 else int(rng.integers(2))) for c in range(12) for i in range(3)]
    counts = bootstrap.cluster_counts(rows(spark, *cells))
    clusters = bootstrap.ranked_clusters(counts)
    weights = bootstrap.exact_draws(spark, {"d": 12}, 50, 7)
    got = {r.draw: r for r in bootstrap.replicates(counts, clusters, weights).collect()}
    gen = np.random.default_rng(7)
    kappas = []
    for draw in range(50):
        picks = gen.integers(0, 12, 12)
        pairs = [(g, p) for c in picks for u, r, g, _, _, p in cells if r == c and p is not None]
        g, p = np.array(pairs).T
        if len(set(g)) == 2:
            po = (g == p).mean()
            pe = g.mean() * p.mean() + (1 - g.mean()) * (1 - p.mean())
            kappas.append((po - pe) / (1 - pe))
            assert got[draw].kappa == pytest.approx(kappas[-1])
        else:
            assert got[draw].kappa is None
    ci = bootstrap.intervals(bootstrap.replicates(counts, clusters, weights)).first()
    assert ci.kappa == pytest.approx(np.mean(kappas), abs=1e-6)
    assert ci.kappa_lo == pytest.approx(np.percentile(kappas, 2.5), abs=1e-6)
    assert ci.kappa_hi == pytest.approx(np.percentile(kappas, 97.5), abs=1e-6)


def test_draws_are_paired_and_complete(spark):
    clusters = spark.createDataFrame([("d", i, i, 9) for i in range(9)], "dataset string, row_id long, rank long, size long")
    got = bootstrap.draws(clusters, 30).groupBy("draw").agg(F.sum("weight").alias("n"), F.max("rank").alias("m")).collect()
    assert len(got) == 30 and all(r.n == 9 and r.m < 9 for r in got)


def test_run_compare(spark):
    a = rows(spark, ("1", 1, 1, "m", "x", 1), ("2", 2, 0, "m", "x", 0), ("3", 3, 0, "m", "x", None), ("1", 1, 1, "only_a", "x", 1))
    b = rows(spark, ("1", 1, 1, "m", "y", 0), ("2", 2, 0, "m", "y", 0), ("3", 3, 0, "m", "y", 1), ("9", 9, 0, "m", "y", 1))
    got = {r.model: r for r in compare.run_compare(a, b).collect()}
    assert (got["m"].n_shared, got["m"].n_both, got["m"].agreement, got["m"].kappa_a, got["m"].is_low) == (3, 2, 0.5, 1.0, 1)
    assert got["only_a"].side == "a" and got["only_a"].agreement is None and got["only_a"].is_low == 0


def test_choice_scorers(spark):
    c = spark.createDataFrame(
        [(1, "▁Yes", -1.0), (1, "yes", -1.2), (1, "No", -0.9), (2, "No", -3.0), (3, "Maybe", -0.1), (4, " Yes", -0.5), (4, "Ġno", -0.6)], "k int, piece string, logprob double"
    )
    mass = {r.k: (r.p_yes, r.choice) for r in scorer.by_mass(c, "k").collect()}
    y = np.exp(-1.0) + np.exp(-1.2)
    assert mass[1] == (pytest.approx(y / (y + np.exp(-0.9))), 1) and mass[2] == (0.0, 0) and mass[3] == (None, None) and mass[4][1] == 1
    best = {r.k: (r.p_yes, r.choice) for r in scorer.by_best(c, "k").collect()}
    assert best[1][1] == 0 and best[2] == (0.0, 0) and best[3] == (None, None)
    bare = {r.k: r.choice for r in scorer.by_best(c, "k", marked=False).collect()}
    assert bare == {1: 0, 2: 0, 3: None, 4: 1}
    vocab = spark.createDataFrame([("▁Yes", 5), ("yes", 3), ("ĊYES", 9), ("Yesterday", 4), ("No", 1)], "piece string, id long")
    assert sorted(r.id for r in scorer.choice_ids(vocab, ("Yes",)).collect()) == [3, 5, 9]


def test_marked_finds_all_that_bare_finds(spark):
    rng = np.random.default_rng(0)
    pieces = ["▁Yes", "Yes", " yes ", "No", "▁no", "x"]
    c = spark.createDataFrame([(k, str(rng.choice(pieces)), float(-5 * rng.random())) for k in range(200) for _ in range(4)], "k int, piece string, logprob double")
    bare = {r.k for r in scorer.by_best(c, "k", marked=False).collect() if r.choice is not None}
    marked = {r.k for r in scorer.by_best(c, "k").collect() if r.choice is not None}
    assert bare <= marked


def test_cost(spark):
    calls = spark.createDataFrame([("d", "kettle/steam-12b-x", 100, 10), ("d", "kettle/other", 50, 5), ("d", "who", 1, 1)], "dataset string, model string, tokens_in long, tokens_out long")
    rates = {"kettle/": (0.2, 0.6), "kettle/steam-12b": (0.5, 1.5)}
    got = {r.model: r for r in cost.usage(calls, rates).collect()}
    assert got["kettle/steam-12b-x"].cost_usd == pytest.approx((100 * 0.5 + 10 * 1.5) / 1e6)
    assert got["kettle/other"].cost_usd == pytest.approx((50 * 0.2 + 5 * 0.6) / 1e6)
    assert got["who"].cost_usd is None and got["who"].calls == 1
    timed = spark.createDataFrame([("m", 1.0), ("m", 4.0), ("m", 0.0), ("m", None)], "model string, seconds double")
    r = cost.throughput(timed).first()
    assert (r.n, r.items_per_second) == (2, 0.4)
