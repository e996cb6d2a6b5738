"""Queries that did less than the whole job, on small tables."""

import numpy as np
from pyspark.sql import functions as F

from quorate.functions import prompts
from quorate.functions.digests import points
from quorate.functions.text import point
from quorate.operators import bootstrap, guard
from quorate.plans import item_queries


def test_exemplars_keep_their_context(spark, tmp_path):
    texts = {1: ["a" * 61], 2: ["b" * 300, "c" * 299], 3: ["d" * 300, "e" * 300], 4: ["f" * 2401], 5: []}
    rows = [(i, "medhallu", "q?", c, "x", i % 2) for i, c in texts.items()]
    spark.createDataFrame(rows, "inst_id long, dataset string, question string, context array<string>, candidate string, gold int").write.parquet(f"{tmp_path}/instances.parquet")
    spark.createDataFrame([("medhallu", "a question", True, "Known")], "dataset string, subject_phrase string, has_context boolean, context_label string").write.parquet(f"{tmp_path}/task_specs.parquet")
    got = {r.inst_id: r for r in item_queries.fewshot_block(spark, str(tmp_path)).collect()}
    for i, c in texts.items():
        body = "\n".join(c)
        for text, cap, end in ((got[i].exemplar, 600, " No" if i % 2 else " Yes"), (got[i].query, 2400, "")):
            shown = f"Known: {body[:cap]}{' ...' if len(body) > cap else ''}\n" if c else ""
            assert text == f"{shown}Question: q?\nClaim: x\nAnswer:{end}"


def test_default_draws(spark):
    clusters = spark.createDataFrame([("d", i, i, 3) for i in range(3)], "dataset string, row_id long, rank long, size long")
    assert bootstrap.draws(clusters).select("draw").distinct().count() == bootstrap.DRAWS == 2000


def test_packed_replicates_equal_rows(spark, monkeypatch):
    """Several blocks of clusters, one of them without any row of a judge."""
    monkeypatch.setattr(bootstrap, "BLOCK", 5)
    rows = [("d", "x", m, i, i % 3, 1, i % 2, 2) for m in "ab" for i in range(13) if m == "a" or i < 4]
    counts = spark.createDataFrame(rows, "dataset string, condition string, model string, row_id long, tp long, fn long, fp long, tn long")
    clusters = bootstrap.ranked_clusters(counts)
    got, want = (sorted(map(tuple, r.where("kappa IS NOT NULL").collect())) for r in (bootstrap.hashed_replicates(counts, clusters, 40), bootstrap.replicates(counts, clusters, bootstrap.draws(clusters, 40))))
    assert got == want and len(got) > 40


def test_points(spark):
    for prefix, n in (("0|d|1", 1205), ("0|ß漢|7", 12), ("0|" + "y" * 60, 11)):
        want = [r[0] for r in spark.range(n).orderBy("id").select(point(prefix, F.col("id"))).collect()]
        assert np.concatenate(list(points(prefix, n, 100))).tolist() == want


def test_shard_schema_reads_every_line(spark):
    keyed, plain = '{"uid": "1", "src_key": "x"}', '{"uid": "1"}'
    rows = [("s", 1, keyed), ("s", 1, plain), ("s", 1, '{"cut'), ("s", 2, keyed), ("t", 3, plain), ("t", 3, plain), ("t", 3, ""), ("u", 4, '{"src_key": null}'), ("v", 5, keyed), ("v", 6, plain)]
    got = guard.shard_schema(spark.createDataFrame(rows, "stream string, file_id long, payload string")).collect()
    assert sorted((r.file_id, r.n_rows, r.n_with, r.state, r.stream_pure) for r in got) == [(1, 2, 1, "mixed", False), (2, 1, 1, "with", False), (3, 2, 0, "without", True), (4, 1, 1, "with", True), (5, 1, 1, "with", False), (6, 1, 0, "without", False)]


def test_fewshot_prompts_hold_six_exemplars(spark, data):
    items = {r.inst_id: r for r in item_queries._items(spark, data).collect()}
    chosen = item_queries.builders.exemplars(item_queries._items(spark, data)).collect()
    blocks = {r.inst_id: r for r in item_queries.fewshot_block(spark, data).collect()}
    got = item_queries.fewshot_prompt(spark, data).collect()
    kept = {(r.dataset, r.uid) for r in item_queries.exemplar_exclusion(spark, data).collect()}
    assert {r.inst_id for r in got} == {i for i, r in items.items() if (r.dataset, r.uid) in kept and i in blocks}
    for r in got[::7]:
        item, query = items[r.inst_id], blocks[r.inst_id].query
        if query is None:
            continue
        assert r.prompt.startswith(prompts.FEWSHOT_HEAD + "\n\n") and r.prompt.endswith("\n\n" + query + " ")
        shots = [(c.uid, c.gold) for c in chosen if c.dataset == item.dataset]
        middle = r.prompt[len(prompts.FEWSHOT_HEAD) + 2 : -len(query) - 1]
        want = [next(blocks[i].exemplar for i in sorted(items) if (items[i].dataset, items[i].uid, items[i].gold) == (item.dataset, *s)) for s in shots]
        assert sorted(want) == sorted(w for w in want if w + "\n\n" in middle) and len(middle) == sum(len(w) + 2 for w in want)


def test_native_prompts(spark):
    rows = [("q?", ["c1", " ", "c2"], " a ", True), ("q?", ["c1"], "a", False), ("a", ["c1"], "a", True)]
    df = spark.createDataFrame(rows, "q string, c array<string>, a string, h boolean")
    for judge, build in prompts.NATIVE.items():
        qa, claim = ([r[0] for r in df.select(build(*[F.col(x) for x in "qcah"], k)).collect()] for k in (False, True))
        assert "q?" in qa[0] and "c1\nc2" in qa[0] and "c1" not in qa[1] and "established facts" in qa[1] and "established facts" not in qa[0]
        assert "Question under discussion: q?\nc1\nc2" in claim[0] and "under discussion" not in claim[2] and "Question under discussion: q?" in claim[1] and "c1" not in claim[1]
        assert all("SOURCE" not in x and "{" not in x for x in qa + claim)
    texts = {j: df.select(b(*[F.col(x) for x in "qcah"], False)).first()[0] for j, b in prompts.NATIVE.items()}
    assert texts["prometheus2"].endswith("###Feedback: [/INST]") and "###Response to evaluate:\na\n" in texts["prometheus2"] and "[RESULT]" in texts["prometheus2"]
    assert texts["judgelm"].endswith("\n\nScore:") and "[The Start of Assistant's Answer]\na\n[The End" in texts["judgelm"] and "[The Start of Reference Answer]\nc1\nc2\n[The End of Reference Answer]" in texts["judgelm"]
    assert texts["autoj"].startswith("[INST] ") and "[Response]: a\n***" in texts["autoj"] and "[[rating]]" in texts["autoj"]


def test_lock_check_compares_every_file(spark, tmp_path):
    """File 7 and first lines count; of stream s, file 2 equals its predecessor and file 3 differs in its first line."""
    lines = [("s", 1, 5, 1, "a"), ("s", 1, 5, 2, "b"), ("s", 2, 7, 1, "a"), ("s", 2, 7, 2, "b"), ("s", 3, 10, 1, "x"), ("s", 3, 10, 2, "b"), ("t", 1, 14, 1, "a")]
    spark.createDataFrame(lines, "stream string, file_seq int, file_id long, line_no int, payload string").withColumn("written_at", F.lit("2026-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/shard_lines.parquet")
    got = sorted(map(tuple, item_queries.lock_check(spark, str(tmp_path)).select("path", "state").collect()))
    assert got == [("s/1", "unlocked"), ("s/3", "changed"), ("s/4", "missing"), ("t/1", "unlocked"), ("t/2", "missing")]
