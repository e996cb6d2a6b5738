import gzip
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from quorate.plans.lineage import cut, spread
from quorate.sinks import files
from quorate.sources import verdict_files


def test_replace_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(5)
    assert files.replace(df, path) == 5
    with pytest.raises(ValueError):
        files.replace(df.where("id > 9"), path)
    with pytest.raises(Exception):
        files.replace(df.select(F.raise_error(F.lit("no")).cast("int").alias("x")), path)
    assert spark.read.parquet(path).count() == 5 and os.listdir(tmp_path) == ["t"]
    assert files.replace(spark.read.parquet(path).where("id > 2"), path) == 2
    assert spark.read.parquet(path).count() == 2


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("d", "1", 1, "text"), ("e", "2", None, None)], "dataset string, uid string, pred int, raw string")
    files.export_votes(df, str(tmp_path / "x"))
    parts = [p for p in (tmp_path / "x").rglob("*.gz")]
    assert parts and "text" not in "".join(gzip.open(p, "rt").read() for p in parts)
    back = files.read_export(spark, str(tmp_path / "x"), "uid string, pred int, dataset string")
    assert {tuple(r) for r in back.select("dataset", "uid", "pred").collect()} == {("d", "1", 1), ("e", "2", None)}
    files.write_manifest(back.groupBy("dataset").count(), str(tmp_path / "m.json"), made="now")
    assert json.loads((tmp_path / "m.json").read_text())["made"] == "now"
    assert files.markdown(spark.createDataFrame([(1, 0.5, None)], "a int, b double, c string")).splitlines()[2] == "| 1 | 0.500 |  |"


def test_reading_lines(spark, tmp_path):
    good = '{"uid":"1","pred":1}\n\n{"uid":"2","pred":null,"prob_yes":0.5}\n'
    (tmp_path / "a.jsonl").write_text(good)
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"uid":"3"}\n')
    (tmp_path / "bad.jsonl").write_text('{"uid":"4"}\n{"uid":')
    assert {r.uid for r in verdict_files.read_lines(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b*.gz")]).collect()} == {"1", "2", "3"}
    assert [r.uid for r in verdict_files.read_lines(spark, str(tmp_path / "bad.jsonl"), tolerant=True).collect()] == ["4"]
    with pytest.raises(Exception):
        verdict_files.read_lines(spark, str(tmp_path / "none*.jsonl"))
    (tmp_path / "empty.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        verdict_files.read_lines(spark, str(tmp_path / "empty.jsonl"))


def test_tree(spark, tmp_path):
    for name, text in {"d1/experiment.jsonl": "a\nb", "d1/judge_x.json": "{}\n", "d1/judge_pair_x.json": "{}", "d1/panel_shards/0.jsonl": "x\n", "d2/notes.txt": "n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    tree = verdict_files.read_tree(spark, str(tmp_path))
    got = {os.path.basename(r.path): r for r in verdict_files.file_records(tree).collect()}
    assert set(got) == {"experiment.jsonl", "judge_x.json"}
    assert got["experiment.jsonl"].records == 2 and got["experiment.jsonl"].sha256 == hashlib.sha256(b"a\nb").hexdigest()
    assert verdict_files.read_tree(spark, str(tmp_path), shards=True).count() == 3
    one = tree.where("path LIKE '%judge_x%'")
    assert verdict_files.pinned(one, hashlib.sha256(b"{}\n").hexdigest()).count() == 1
    with pytest.raises(ValueError):
        verdict_files.pinned(one, "0")


def test_cut_and_spread(spark):
    df = spark.createDataFrame([], "a int, b array<struct<c:string>>")
    assert cut(df).schema == df.schema and cut(df).count() == 0
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_shared_folder_is_the_sessions(spark, monkeypatch):
    from quorate.plans import lineage

    assert lineage.shared_folder(spark) == f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/quorate-{spark.sparkContext.applicationId}"

    class Unset:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = spark.sparkContext

    assert lineage.shared_folder(Unset) == lineage.shared_folder(Unset) and os.path.isdir(lineage.shared_folder(Unset))
