import hashlib

import pytest
from pyspark.sql import functions as F

from quorate.functions import prompts
from quorate.functions.text import content_key, strip
from quorate.operators import guard, panel, ranks, release
from quorate.sources import builders

ROW = "inst_id long, dataset string, uid string, row_id long, kind string, gold int, question string, context array<string>, candidate string"


@pytest.mark.parametrize(("q", "c", "a"), [("q?", ["é", "b"], "x"), ("q?", [], "x"), ("", None, None), ("ß", [None, ""], "漢")])
def test_content_key(spark, q, c, a):
    df = spark.createDataFrame([(q, c, a)], "q string, c array<string>, a string")
    want = hashlib.sha1(((q or "") + "\0" + "".join((x or "") + "\0" for x in c or []) + "\0" + (a or "")).encode()).hexdigest()
    assert df.select(content_key(F.col("q"), F.col("c"), F.col("a"))).first()[0] == want


def test_strip(spark):
    df = spark.createDataFrame([(" \t\n x y \r\n",)], "t string")
    assert df.select(strip(F.col("t"))).first()[0] == "x y"


def test_first_pairs(spark):
    rows = [
        (1, " q1 ", ["c"], "good", False), (2, "q1", ["other"], "bad other", True), (3, "q1", ["c"], "bad", True), (4, "q1", ["c"], "bad later", True),
        (5, "q2", ["c"], "", False), (6, "q2", ["c"], "good late", False), (7, "q2", ["c"], "bad", True), (8, "q3", [], "g", False), (9, "q3", [], "b", True),
        (10, "q4", ["c"], "g", None), (11, "q4", ["c"], "b", True), (12, None, ["c"], "g", False), (13, "q5", ["c"], "g", False),
    ]
    got = builders.first_pairs(spark.createDataFrame(rows, "pos long, query string, context array<string>, output string, faulty boolean")).collect()
    assert sorted((r.uid, r.question, r.candidate) for r in got) == [("0:neg", "q1", "bad"), ("0:pos", "q1", "good"), ("1:neg", "q4", "b"), ("1:pos", "q4", "g")]


def test_best_or_first(spark):
    rows = [(0, "q", "", [None, "c1", "c2"], ["i"], "t", "k"), (1, "q", "best", None, ["i"], "t", "k"), (2, "q", "best", ["c"], [], "t", "k"), (3, "q", None, [""], ["i"], "t", "k")]
    got = builders.best_or_first(spark.createDataFrame(rows, "pos long, question string, best string, correct array<string>, incorrect array<string>, type string, category string")).collect()
    assert {(r.uid, r.candidate) for r in got} == {("0:pos", "c1"), ("0:neg", "i"), ("1:pos", "best"), ("1:neg", "i")}
    assert all(r.context == [] for r in got)


def test_nested_facts(spark):
    facts = "array<struct<relevant:boolean,facts:array<struct<label:string,text:string>>>>"
    rows = [(0, "T", [(False, [("S", "no")]), (None, [("NS", ""), ("s", "yes"), ("S", "late")]), (True, [("NS", "wrong")])]), (1, None, [(True, [("S", "a"), ("NS", "b")])]), (2, "U", [(True, [("S", "a")])]), (3, "V", None)]
    got = {r.uid: (r.candidate, r.question) for r in builders.nested_facts(spark.createDataFrame(rows, f"pos long, topic string, annotations {facts}")).collect()}
    assert got["0:pos"][0] == "yes" and got["0:neg"][0] == "wrong" and "person_1" in got["1:pos"][1] and len(got) == 4


def test_balanced_claims(spark):
    rows = [(i, f"doc{i % 3}", f"claim{i}", 1 if i < 7 else 0) for i in range(10)] + [(10, "d", None, 1), (11, "d", "c", None)]
    got = builders.balanced_claims(spark.createDataFrame(rows, "pos long, doc string, claim string, label int"), "x").collect()
    assert sorted(r.gold for r in got) == [0, 0, 0, 1, 1, 1]
    assert sorted(int(r.uid.split(":")[0]) for r in got) == list(range(6))
    assert len({(r.context[0], r.row_id) for r in got}) == len({r.row_id for r in got})
    first = {}
    for r in sorted(got, key=lambda r: int(r.uid.split(":")[0])):
        first.setdefault(r.context[0], len(first))
        assert r.row_id == first[r.context[0]]
    assert builders.balanced_claims(spark.createDataFrame(rows[:5], "pos long, doc string, claim string, label int"), "x").count() == 0


def test_synthetic_and_exemplars(spark):
    items = builders.synthetic(spark, "s", 20)
    assert items.count() == 40 and items.select("uid").distinct().count() == 40
    chosen = builders.exemplars(items, 6)
    assert sorted(r.gold for r in chosen.collect()) == [0, 0, 0, 1, 1, 1]
    rest = builders.without_exemplars(items, chosen)
    rows = {r.row_id for r in chosen.collect()}
    assert rest.count() == 40 - 2 * len(rows) and not rows & {r.row_id for r in rest.collect()}


def test_numbered(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), (1000 - F.col("id")).alias("x"))
    got = ranks.numbered(df, ["g"], ["x"]).collect()
    for g in "ab":
        mine = sorted((r.x, r["rank"]) for r in got if r.g == g)
        assert [n for _, n in mine] == list(range(len(mine)))


def test_prompts(spark):
    df = spark.createDataFrame([("q?", [" a ", "", None, "b"], "ans", "things", True, "Evidence"), ("same ", None, " same", "things", False, None)], "q string, c array<string>, a string, s string, h boolean, l string")
    c = [F.col(x) for x in ("q", "c", "a", "s", "h")]
    qa = [r[0] for r in df.select(prompts.qa_prompt(*c, F.coalesce("l", F.lit("")))).collect()]
    assert "\n# Evidence\n- a\n- b\n" in qa[0] and "the evidence" in qa[0] and "# Evidence" not in qa[1] and qa[1].endswith("# Candidate answer\nsame\n")
    cl = [r[0] for r in df.select(prompts.claim_prompt(F.col("q"), F.col("c"), F.col("a"), F.col("h"))).collect()]
    assert "Question under discussion: q?\na\nb" in cl[0] and prompts.NO_DOCUMENT in cl[1] and "Question under" not in cl[1]
    fs = df.select(prompts.fewshot_block(F.col("q"), F.col("c"), F.col("a"), F.col("h"), F.col("l"), F.lit(True), 2, F.lit("Yes"))).collect()
    assert fs[0][0] == "Evidence: a\n ...\nQuestion: q?\nClaim: ans\nAnswer: Yes" and fs[1][0] == "Claim:  same\nAnswer: Yes"


def test_fit(spark):
    text = " ".join(f"w{i}" for i in range(1000))
    df = spark.createDataFrame([(text, 512), ("short one", 512), (text, 100), (None, 512)], "t string, w int")
    got = [r[0] for r in df.select(prompts.fit(F.col("t"), prompts.words(F.col("t")), F.col("w"), 16)).collect()]
    assert got[0].startswith("w0 w1") and got[0].endswith("w998 w999") and len(got[0].replace(prompts.CUT_NOTE, " ").split()) == 368
    assert got[1] == "short one" and got[2] == text and got[3] is None


def test_guard_matrix(spark):
    cases = [
        (None, ["qa"], "ptjudge", True, False, "run"), (["qa"], ["qa"], "ptjudge", True, False, "skip"), (["qa"], ["qa"], "ptjudge", True, True, "run"), (["qa"], ["claimcheck"], "ptjudge", True, True, "refuse"),
        ([], ["qa"], "ptjudge", True, False, "skip"), ([], ["claimcheck"], "ptjudge", True, False, "refuse"), ([], ["claimcheck"], "minicheck", True, False, "skip"), ([], ["def_on"], "judge", True, False, "refuse"),
        ([], ["def_on"], "panel", False, False, "run"), (["def_on"], ["def_on"], "panel", False, False, "run"), (["def_on", "x"], ["def_on"], "panel", False, False, "refuse"),
    ]
    df = spark.createDataFrame([c[:5] for c in cases], "r array<string>, e array<string>, k string, s boolean, f boolean")
    got = [r[0] for r in df.select(guard.decide(*[F.col(c) for c in "reksf"])).collect()]
    assert got == [c[5] for c in cases]
    rel = spark.createDataFrame([(["a"], ["a"]), (["a"], ["a", "b"]), (["a", "b"], ["a"]), (["c"], ["a"]), ([], ["a"])], "r array<string>, e array<string>")
    assert [r[0] for r in rel.select(guard.relation(F.col("r"), F.col("e"))).collect()] == ["same", "narrower", "wider", "other", "none"]


def test_digests(spark):
    lines = spark.createDataFrame([(1, i, f"l{i}") for i in range(125)] + [(2, 0, None)], "file_id long, line_no int, payload string")
    got = {r.file_id: r for r in release.file_digests(lines, 10).collect()}
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = [h(f"{i} l{i}\n") for i in range(125)]
    for _ in range(2):
        level = [h("\n".join(level[lo : lo + 10])) for lo in range(0, len(level), 10)]
    assert len(level) == 2
    assert got[1].sha256 == h("\n".join(level)) and got[1].records == 125 and got[1].bytes == sum(len(f"l{i}\n") for i in range(125)) and got[2].bytes == 1
    turned = release.file_digests(lines.orderBy(F.desc("line_no")).repartition(3), 10)
    assert {r.file_id: r.sha256 for r in turned.collect()} == {k: r.sha256 for k, r in got.items()}
    lock = release.file_digests(lines, 10).select(F.col("file_id").cast("string").alias("path"), "sha256")
    now = release.file_digests(lines.where("line_no > 0 OR file_id = 2").unionByName(spark.createDataFrame([(3, 1, "n")], "file_id long, line_no int, payload string")), 10).select(F.col("file_id").cast("string").alias("path"), "sha256")
    assert {(r.path, r.state) for r in release.lock_check(lock, now).collect()} == {("1", "changed"), ("3", "unlocked")}
    assert release.lock_check(lock, lock).count() == 0


def test_measurement_names(spark):
    names = ["experiment.jsonl", "judge_a.json", "judge_pair_a.json", "notes.json", "x.txt"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(release.is_measurement(F.col("n"))).collect()] == [True, True, False, False, False]


def test_plan_and_backend(spark):
    items = builders.synthetic(spark, "aggrefact_x", 3)
    plan = panel.run_plan(items, ["m1", "m2"])
    assert plan.count() == 12 and {r.condition for r in plan.collect()} == {"claimcheck"}
    done = panel.progress(plan, plan.where("model = 'm1' AND kind = 'pos'").unionByName(plan.where("model = 'm1' AND kind = 'pos'")))
    assert {r.model: (r.n_planned, r.n_recorded, r.n_missing) for r in done.collect()} == {"m1": (6, 3, 3), "m2": (6, 0, 6)}
    texts = panel.generate(plan.withColumn("prompt", F.col("uid")), lambda batch: [p.upper() for p in batch]).collect()
    assert all(r.raw == r.uid.upper() for r in texts)
    sig = lambda i, m: release.run_signature(i, ["a"], m, 10).first()[1]
    assert sig(items, ["m"]) == sig(items.repartition(3), ["m"]) != sig(items, ["m2"])
