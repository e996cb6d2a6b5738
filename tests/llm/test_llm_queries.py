"""The queries of this package: against their SQL where they have it, else what must hold of their results."""

import pytest
from pyspark.sql import functions as F

from quorate.llm import splits
from quorate.llm.registry import MODULES
from quorate.sources.tables import table

CASES = [(m, n) for m in MODULES for n in m.SQL]
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
CHECKED: dict = {}


@pytest.mark.parametrize(("module", "name"), CASES, ids=[n for _, n in CASES])
def test_query(module, name, same):
    same(module, name)


def holds(*names):
    """Register a check of queries without SQL."""

    def mark(check):
        CHECKED.update(dict.fromkeys(names, check))
        return check

    return mark


@holds("p2_found", "p2_labels", "p2_reliability")
def test_consensus(spark, data):
    labels = QUERIES["p2_labels"](spark, data).collect()
    items = table(spark, data, "experiment").select("dataset", "uid").distinct().count()
    assert len(labels) == len({(r.dataset, r.uid) for r in labels}) == items
    assert all((r.consensus is None) == (r.n_votes == 0 or r.log_odds == 0) and (r.consensus is None or (r.consensus == 1) == (r.log_odds > 0)) for r in labels)
    assert {tuple(r) for r in QUERIES["p2_found"](spark, data).collect()} == {(r.dataset, r.uid) for r in labels if r.gold is not None and r.consensus is not None and r.gold != r.consensus}
    models = {r.model for r in table(spark, data, "experiment").where("pred IS NOT NULL").select("model").distinct().collect()}
    told = QUERIES["p2_reliability"](spark, data).collect()
    assert {r.model for r in told} == models and all(0 < r.sensitivity < 1 and 0 < r.specificity < 1 for r in told)


@holds("p3_split", "p3_report")
def test_split(spark, data):
    got = QUERIES["p3_split"](spark, data).collect()
    records = table(spark, data, "experiment")
    assert sorted(r.rec_id for r in got) == sorted(r.rec_id for r in records.select("rec_id").collect())
    for key in ("uid", "row_id"):
        seen = {}
        for r in got:
            if r[key] is not None:
                assert seen.setdefault((r.dataset, r[key]), r.split) == r.split
    assert {r.split for r in got} <= set(splits.SPLITS)
    report = {r.split: r for r in QUERIES["p3_report"](spark, data).collect()}
    assert {s: r.n for s, r in report.items()} == {s: sum(x.split == s for x in got) for s in report}
    assert abs(report["train"].n / len(got) - 0.8) < 0.05


@holds("p4_found")
def test_defects(spark, data):
    got = QUERIES["p4_found"](spark, data).collect()
    assert got and len({r.rec_id for r in got}) == len(got) and {r.defect for r in got} <= {"empty", "truncated", "refusal", "echo", "language"}
    empty = {r.rec_id for r in table(spark, data, "experiment").where("raw IS NULL OR NOT raw RLIKE '[\\\\p{L}\\\\p{N}]'").collect()}
    assert {r.rec_id for r in got if r.defect == "empty"} == empty
    cut = {r.rec_id for r in QUERIES["p6_found"](spark, data).collect()}
    assert {r.rec_id for r in got if r.defect == "truncated"} <= cut


@holds("p6_found", "p6_rates")
def test_truncation(spark, data):
    found = QUERIES["p6_found"](spark, data)
    texts = table(spark, data, "experiment")
    cut = {r.model: r.n for r in texts.join(found, "rec_id").groupBy("model").agg(F.count("*").alias("n")).collect()}
    rates = {r.model: r for r in QUERIES["p6_rates"](spark, data).collect()}
    assert set(rates) == {r.model for r in texts.select("model").distinct().collect()}
    assert all(r.n_cut == cut.get(m, 0) and (r.share_cut is None if not r.n_texts else r.share_cut == r.n_cut / r.n_texts) for m, r in rates.items())


@holds("p8_ids")
def test_ids(spark, data):
    docs = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    got = {r.doc_id: r.ids for r in QUERIES["p8_ids"](spark, data).collect()}
    assert set(got) == set(docs) and all((ids == []) == (not docs[k]) for k, ids in got.items())


@holds("p9_prompts", "p9_report")
def test_prompts(spark, data):
    sizes = {r.doc_id: len(r.ids) for r in QUERIES["p8_ids"](spark, data).collect()}
    windows = {r.judge: r.window_tokens for r in table(spark, data, "judge_windows").collect()}
    rows = QUERIES["p9_prompts"](spark, data).collect()
    report = {r.judge: r for r in QUERIES["p9_report"](spark, data).collect()}
    for judge, window in windows.items():
        used, pieces = {}, {}
        for r in rows:
            if r.judge == judge:
                used[r.prompt_no] = used.get(r.prompt_no, 0) + r.n_tokens
                pieces.setdefault(r.doc_id, []).append((r.piece_no, r.n_tokens))
        assert max(used.values()) <= window and set(pieces) == set(sizes)
        for doc, p in pieces.items():
            assert [n for n, _ in sorted(p)] == list(range(len(p))) and sum(n for _, n in p) == sizes[doc]
            assert len(p) == max(1, -(-sizes[doc] // window))
        assert report[judge].prompts == max(used) and report[judge].least <= report[judge].prompts and report[judge].tokens == sum(sizes.values())


@holds("p10_found", "p10_shares", "p10_composition")
def test_subjects(spark, data):
    shares = QUERIES["p10_shares"](spark, data).collect()
    areas = {r.subject for r in table(spark, data, "subject_areas").collect()}
    total = {}
    for r in shares:
        assert r.subject in areas and 0 < r.share <= 1
        total[r.doc_id] = total.get(r.doc_id, 0) + r.share
    assert all(0.8 < t < 1.001 for t in total.values())
    found = {tuple(r) for r in QUERIES["p10_found"](spark, data).collect()}
    assert found == {(r.doc_id, r.subject) for r in shares if r.share >= 0.26}
    composed = {r.subject: r for r in QUERIES["p10_composition"](spark, data).collect()}
    assert sum(r.share for r in composed.values()) == pytest.approx(1)
    assert all(r.n_documents == sum(s == r.subject for _, s in found) and r.n_sentences == sum(x.n_sentences for x in shares if x.subject == r.subject) for r in composed.values())


def test_every_query_is_checked(spark, data, sound):
    assert set(QUERIES) == set(CHECKED) | {n for m in MODULES for n in m.SQL}
    for name in ("p2_found", "p4_found", "p6_found", "p9_prompts"):
        sound(QUERIES[name](spark, data))


def test_nothing_else_imports_the_package():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for p in (root / "quorate").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quorate.llm" not in p.read_text(), p
