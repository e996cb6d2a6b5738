import json
import os

import pytest
from pyspark.sql import functions as F

from quorate.functions import parsers, prompts
from quorate.operators import assembly, bootstrap, committee, guard, release, scorer, verdicts
from quorate.plans import lineage
from quorate.sinks import files
from quorate.sources import builders, verdict_files
from quorate.streaming import ingest

LINES = "stream string, file_id long, line_no int, payload string"


def lines(spark, files_):
    rows = [(s, f, n, p if isinstance(p, str) else json.dumps(p)) for (s, f), content in files_.items() for n, p in enumerate(content)]
    return spark.createDataFrame(rows, LINES)


def row(uid, model="m", **more):
    return {"uid": uid, "model": model, "condition": "def_on", "pred": 1, "prob_yes": 0.4} | more


def test_member_files(spark):
    ok = [row("1"), row("2", pred=0)]
    df = lines(spark, {
        ("qa/m/0", 1): ok, ("qa/m/0", 2): [row("1")], ("qa/m/1", 3): [row("1", "n"), row("2", "n")], ("qa/m/2", 4): [row("1"), row("1")], ("qa/m/3", 5): [row("1"), row("2", pred=None)],
        ("aggrefact_x/m/4", 6): ok, ("qa/m/5", 7): [row("1", prob_yes=None), row("2")], ("qa/m/6", 8): ["", '{"cut'], ("qa/m/7", 9): [row("1"), row("2", "n")],
    })
    states = {r.file_id: r.state for r in assembly.member_states(df).collect()}
    assert states == {1: "ok", 2: "ok", 3: "other model", 4: "repeated items", 5: "low coverage", 6: "other condition", 7: "low coverage", 9: "other model"}
    assert {r.file_id: r.state for r in assembly.member_states(df, need_prob=False).collect()}[7] == "ok"
    assert {r.file_id: r.state for r in assembly.shard_states(df).collect()} == {1: "cached", 2: "recompute", 3: "refuse", 4: "cached", 5: "cached", 6: "cached", 7: "cached", 9: "cached"}
    assert {r.file_id: r.state for r in assembly.shard_states(df, True).collect()}[3] == "recompute"
    assert {(r.file_id, r.n_rows, r.models) for r in assembly.foreign_models(df).collect()} == {(3, 2, "n"), (9, 1, "n")}
    assert {(r.file_id, r.n_lines, r.model) for r in assembly.probes(df).collect()} >= {(1, 2, "m"), (3, 2, "n")}
    empty = df.limit(0)
    assert all(f(empty).count() == 0 for f in (assembly.member_states, assembly.shard_states, assembly.foreign_models, assembly.probes))


def test_only_a_complete_panel_is_written(spark, tmp_path):
    rows = spark.createDataFrame([(3, "d", "b", "x"), (1, "d", "a", "x"), (2, "d", "b", "y"), (4, "d", "z", "x"), (5, None, "a", None)], "rec_id long, dataset string, model string, uid string")
    roster = spark.createDataFrame([(0, "b"), (1, "a")], "panel_idx int, model string")
    ordered = assembly.in_panel_order(rows.where("dataset IS NOT NULL"), roster)
    assert [(r.line_no, r.rec_id) for r in ordered.orderBy("line_no").collect()] == [(0, 2), (1, 3), (2, 1)]
    gates = spark.createDataFrame([("d", "a", "ok"), ("d", "b", "low coverage")], "dataset string, model string, gate string")
    path = str(tmp_path / "panel")
    with pytest.raises(ValueError, match="b on d"):
        assembly.assemble(ordered, roster, gates, path)
    assert not os.path.exists(path)
    assert assembly.assemble(ordered, roster, gates.withColumn("gate", F.lit("ok")), path) == 3
    with pytest.raises(ValueError):
        assembly.assemble(ordered, roster, gates, path)
    assert spark.read.parquet(path).count() == 3


def digests(spark, **paths):
    return spark.createDataFrame(list(paths.items()), "path string, sha256 string")


def test_lock_and_mirror(spark):
    lock, same = digests(spark, a="1", b="2"), digests(spark, a="1", b="2", c="3")
    one = lambda df: tuple(df.first())
    assert one(release.lock_guard(lock, same)) == (0, 0, "", "write")
    assert one(release.lock_guard(lock, digests(spark, b="9"))) == (1, 1, "a", "refuse")
    assert one(release.lock_guard(lock, digests(spark, b="9"), force=True))[3] == "write"
    many = digests(spark, **{f"p{i}": "x" for i in range(9)})
    assert one(release.lock_guard(many, same))[::2] == (9, "p0,p1,p2,p3,p4")
    assert one(release.lock_guard(lock.limit(0), same))[3] == "write"
    got = {tuple(r) for r in release.mirror_check(digests(spark, a="1", b="2", c="3"), digests(spark, a="1", b="9"), digests(spark, b="2", d="4")).collect()}
    assert got == {("a", "orphan"), ("b", "changed"), ("c", "missing"), ("c", "orphan"), ("d", "unexported")}
    guarded = lambda *a, **k: release.export_guard(lock, *a, **k)
    assert guarded(lock, "r", "r") == "write" and guarded(lock, "r", "s").startswith("refuse: the mirror") and guarded(same, "r", "r").startswith("refuse: the lock")
    assert guarded(same, None, "r") == "write" and guarded(same, "r", "s", force=True) == "write"


def test_index_is_replaced_by_force_only(spark, tmp_path):
    path = str(tmp_path / "index")
    index = lambda *rows: spark.createDataFrame(list(rows), "uid string, dataset string")
    assert files.write_index(index(("1", "a"), ("2", "b")), path) == 2
    with pytest.raises(FileExistsError):
        files.write_index(index(("3", "b")), path)
    assert files.write_index(index(("3", "b"), ("4", "b")), path, force=True) == 3
    assert {tuple(r) for r in spark.read.parquet(path).select("uid", "dataset").collect()} == {("1", "a"), ("3", "b"), ("4", "b")}


def test_judge_files_and_report(spark, tmp_path):
    rows = spark.createDataFrame([("d", "m", "1", 1), ("d", "m", "2", None)], "dataset string, model string, uid string, pred int")
    assert files.write_judge(rows, str(tmp_path / "judge"), judge="j") == 2
    summary = json.loads((tmp_path / "judge.summary.json").read_text())
    assert summary["judge"] == "j" and summary["rows"][0]["coverage"] == 0.5
    (tmp_path / "to").mkdir()
    (tmp_path / "to" / "judge.summary.json").write_text("old")
    assert files.copy_summaries(spark, str(tmp_path / "*.summary.json"), str(tmp_path / "to")) == 1
    assert (tmp_path / "to" / "judge.summary.json").read_bytes() == (tmp_path / "judge.summary.json").read_bytes()
    text = files.coverage_report(verdicts.coverage(rows, ("dataset", "model")))
    assert "## d" in text and "| m | 2 | 1 | 0.500 |" in text and "- d m: 0.500" in text
    (tmp_path / "run").mkdir()
    assert verdict_files.panel_source(spark, str(tmp_path / "run")) == [f"{tmp_path}/run/experiment.jsonl"]
    (tmp_path / "run/panel_shards").mkdir()
    for n in ("01", "00"):
        (tmp_path / f"run/panel_shards/{n}.jsonl").write_text("")
    assert [p.rsplit("/", 1)[1] for p in verdict_files.panel_source(spark, str(tmp_path / "run"))] == ["00.jsonl", "01.jsonl"]


def test_scan_of_a_tree(spark):
    registry = spark.createDataFrame([("s", "judge", True), ("p", "ptjudge", False), ("c", "minicheck", False)], "tag string, harness string, contrast boolean")
    rows = [("1", "qa", "s", ["def_on"]), ("2", "qa", "s", ["claimcheck"]), ("3", "aggrefact_x", "s_defon", ["def_on"]), ("4", "qa", "p_defon", ["x"]), ("5", "qa", "who", ["x"]), ("6", "qa", "p", []), ("7", "aggrefact_x", "p", []), ("8", "qa", "c", ["claimcheck", "def_on"]), ("9", "qa", "c", []), ("10", "qa", "s", None)]
    got = {tuple(r) for r in guard.scan(spark.createDataFrame(rows, "path string, dataset string, tag string, recorded array<string>"), registry).collect()}
    assert got == {("2", "holds claimcheck, expected def_on"), ("7", "holds nothing, expected claimcheck"), ("8", "holds claimcheck,def_on, expected claimcheck")}


def test_item_votes(spark):
    rows = [(1, "d", "1", "b", "c", "f", "p", 1, 0, 1), (2, "d", "1", "a", "c", "f", "p", None, 0, 1), (3, "d", "1", "x", "c", "f", "p", 0, 0, 1), (4, "d", "2", "a", "c", "f", "p", None, 0, 1)]
    exp = spark.createDataFrame(rows, "rec_id long, dataset string, uid string, model string, condition string, fmt string, paraphrase string, pred int, gold int, row_id long")
    roster = spark.createDataFrame([(0, "b"), (1, "a")], "panel_idx int, model string")
    assert {(r.uid, r.votes, r.decision) for r in committee.item_votes(exp, roster).collect()} == {("1", "a=- b=1", 1), ("2", "a=-", None)}


def test_committee_masks(spark):
    assert sorted(r[0] for r in spark.range(1).select(committee.masks(4, [3])).collect()) == [7, 11, 13, 14]


def test_classified_and_limits(spark):
    schema = "pos long, query string, context array<string>, output string, task_type string, processed struct<evident_conflict:int,baseless_info:int>, labels string"
    rows = [(1, "q", ["c"], "a", "QA", (0, 0), "[x]"), (2, "q", ["c"], "b", "qa", (0, 2), None), (3, "q", ["c"], "z", "Summary", None, None), (4, "r", ["c"], "d", "qa", None, "[{}]"), (5, "r", ["c"], "e", "QA", None, "[]"), (6, "r", ["c"], "f", "QA", None, None)]
    flags = builders.classified(spark.createDataFrame(rows, schema))
    assert {r.pos: r.faulty for r in flags.collect()} == {1: False, 2: True, 4: True, 5: False, 6: False}
    assert builders.build("ragtruth", flags).count() == 4 and builders.build("ragtruth", flags, 1).count() == 2
    pairs = spark.createDataFrame([(i, "q", ["c"], "t", "h", "easy", "k") for i in range(5)], "pos long, question string, context array<string>, truth string, hallucinated string, difficulty string, category string")
    assert {r.row_id for r in builders.build("medhallu", pairs, 2).collect()} == {0, 1}
    claims = spark.createDataFrame([(i, "doc", f"c{i}", i % 2) for i in range(8)], "pos long, doc string, claim string, label int")
    assert builders.build("aggrefact_cnn", claims, 3).count() == 3
    with pytest.raises(ValueError):
        builders.build("x", pairs)


def test_unicode_blanks_in_verdicts(spark):
    texts = {"VERDICT: not sure, no support": None, "not sure": None, "VERDICT: not sure then support": None, "VERDICT : Hallucinated": 1, "　": None, "verdict: supported": 0}
    df = spark.createDataFrame(list(texts), "string").toDF("t")
    assert {r.t: r.v for r in df.select("t", parsers.parse_verdict(F.col("t")).alias("v")).collect()} == texts
    got = df.limit(1).select(parsers.parse_result(F.lit("[RESULT] 4")), parsers.parse_score(F.lit(" Score: 7")), parsers.parse_rating(F.lit("[[ 8 ]]"))).first()
    assert tuple(got) == (4.0, 7.0, 8.0)


def test_choices_of_golden_candidates(spark):
    import math

    rows = [("a", "▁Yes", 0.5), ("a", "yes", 0.1), ("a", "ĠNo", 0.3), ("b", "No", 0.2), ("c", "Maybe", 0.9), ("d", "Yes", 0.25), ("d", " no ", 0.25)]
    df = spark.createDataFrame([(k, p, math.log(x)) for k, p, x in rows], "k string, piece string, logprob double")
    mass = {r.k: (r.p_yes, r.choice) for r in scorer.by_mass(df, "k").collect()}
    assert mass == {"a": (round(0.6 / 0.9, 9), 1), "b": (0.0, 0), "c": (None, None), "d": (0.5, 1)}
    with pytest.warns(DeprecationWarning):
        best = {r.k: (r.p_yes, r.choice) for r in scorer.by_best(df, "k").collect()}
    assert best == {"a": (round(0.5 / 0.8, 9), 1), "b": (0.0, 0), "c": (None, None), "d": (0.5, 1)}
    vocabulary = spark.createDataFrame([("▁Yes", 9), ("yes", 2), ("NO", 5), ("nope", 1), ("Ġno", 7), ("yes", 2)], "piece string, id int")
    assert [(r.id, r.position) for r in scorer.allowed_ids(vocabulary, ("Yes",), ("No", "yes")).orderBy("position").collect()] == [(2, 0), (5, 1), (7, 2), (9, 3)]


def test_prompt_by_condition(spark):
    args = [F.lit("q"), F.array(F.lit("c")), F.lit("a"), F.lit("s"), F.lit(True), F.lit("L")]
    qa, claim = spark.range(1).select(prompts.prompt("def_on", *args), prompts.prompt("claimcheck", *args)).first()
    assert "# Question" in qa and "# Claim" in claim
    for bad in ({"fmt": "long"}, {"paraphrase": "p9"}):
        with pytest.raises(ValueError):
            prompts.prompt("def_on", *args, **bad)
    with pytest.raises(ValueError):
        prompts.prompt("def_off", *args)


def test_late_deliveries_are_known(spark, tmp_path):
    schema = "rec_id long, dataset string, uid string, model string, condition string, fmt string, paraphrase string, pred int, recorded_at timestamp, loaded_at timestamp"
    rows = [(1, "d", "1", "m", "c", "f", "p", 1), (2, "d", "2", "m", "c", "f", None, None)]
    batch = lambda *r, day="2020-01-01": spark.createDataFrame([(*x, None, None) for x in r], schema).withColumn("recorded_at", F.lit(day).cast("timestamp"))
    source, to, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batch(*rows, *rows).write.parquet(source)
    ingest.first_deliveries(spark, source, to, state)
    assert spark.read.parquet(to).count() == 2
    batch((3, "d", "3", "m", "c", "f", "p", 0), day="2026-01-01").write.mode("append").parquet(source)
    ingest.first_deliveries(spark, source, to, state)
    batch((9, "d", "1", "m", "c", "f", "p", 1), (10, "d", "4", "m", "c", "f", "p", 1)).write.mode("append").parquet(source)  # six years late: one known, one new
    ingest.first_deliveries(spark, source, to, state)
    ingest.first_deliveries(spark, source, to, state)
    assert sorted(r.uid for r in spark.read.parquet(to).collect()) == ["1", "2", "3", "4"]


def test_shared_folder(spark, monkeypatch):
    folder = lineage.shared_folder(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir")) and spark.sparkContext.applicationId in folder

    class Conf:
        @staticmethod
        def get(name, default=None):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError):
        lineage.shared_folder(Session)


def test_draws_add_up(spark):
    clusters = spark.createDataFrame([("d", i, i, 7) for i in range(7)], "dataset string, row_id long, rank long, size long")
    assert {r.n for r in bootstrap.draws(clusters, 50).groupBy("draw").agg(F.sum("weight").alias("n")).collect()} == {7}
