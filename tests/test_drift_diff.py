import json
import random

import pytest
from pyspark.sql import functions as F

from quorate.operators import diff, drift

LINES = "file_id long, stream string, file_seq int, written_at timestamp, line_no int, payload string"


def table(spark, rows, schema=LINES):
    return spark.createDataFrame(rows, schema)


def lines(spark, *files, stream="s"):
    rows = [(f, stream, f, None, n, p if isinstance(p, str) or p is None else json.dumps(p)) for f, content in enumerate(files, 1) for n, p in enumerate(content)]
    return table(spark, rows)


def found(spark, *files):
    return {tuple(r) for r in drift.changes(lines(spark, *files)).collect()}


def test_each_kind_of_change(spark):
    a = [{"uid": "1", "x": 1, "gone": 1, "k": "a", "t": 1}, {"uid": "2", "x": 2, "gone": 1, "k": "b", "t": None}]
    b = [{"uid": "1", "y": 1, "K": "a", "t": "1", "new": None}, {"uid": "2", "y": 2, "K": "b", "t": "2"}, {"uid": "3", "y": 9, "K": "z", "t": "2"}]
    assert found(spark, a, b) == {(2, "x", "y", "renamed"), (2, "k", "K", "renamed"), (2, "gone", "", "removed"), (2, "", "new", "added"), (2, "t", "t", "retyped")}


def test_what_is_no_change(spark):
    a = [{"uid": "1", "v": 1.0, "n": None}]
    assert found(spark, a, [{"uid": "1", "v": 2.5, "n": "x"}]) == set()  # other value; null on one side
    assert found(spark, a, [{"uid": "1", "v": 1, "n": None}]) == {(2, "v", "v", "retyped")}
    assert found(spark, a, ['{"uid": "1", "v": 1', "", None, "[1]", '{"uid":"1","v":2.0,"n":null}', '{"a":1} {"b":2}', '{"q":1}x', "7"]) == set()
    assert found(spark, [{"uid": "1", "x": 1}], [{"uid": "2", "y": 1}]) == {(2, "x", "", "removed"), (2, "", "y", "added")}  # no shared item
    assert found(spark, a) == set()


def test_equal_numbers_are_equal_values(spark):
    assert found(spark, ['{"uid":"1","x":1}'], ['{"uid":"1","y":1.0}']) == {(2, "x", "y", "renamed")}
    assert found(spark, ['{"uid":"1","x":"1"}'], ['{"uid":"1","y":1}']) == {(2, "x", "", "removed"), (2, "", "y", "added")}


def test_file_without_records_and_empty_table(spark):
    assert found(spark, [{"uid": "1"}], [""], [{"uid": "1"}]) == {(2, "uid", "", "removed"), (3, "", "uid", "added")}
    empty = table(spark, [])
    assert drift.changes(empty).count() == 0 and drift.alternatives(empty).count() == 0 and drift.unified_records(empty, drift.changes(empty)).count() == 0


def test_nulls_and_clashing_columns(spark):
    rows = table(spark, [(None,) * 6, (1, None, None, None, None, '{"uid":null,"stream":"x"}'), (1, "s", 1, None, 1, '{"uid":"1","":2,"a.b":3,"it\'s":4,"Stream":5}')])
    wide = rows.withColumns({"name": F.lit(1), "tag": F.lit(2), "value": F.lit(3), "item": F.lit(4), "object": F.lit(5), "later": F.lit(6)})
    assert drift.changes(wide).count() == 0
    out = drift.unified_records(wide, drift.changes(wide))
    assert len({c.lower() for c in out.columns}) == len(out.columns) and out.count() == 2
    assert [r["a.b"] for r in out.collect() if r["file_id"] == 1 and r["stream"] == "s"] == [3]


def test_against_brute_force(spark):
    rnd = random.Random(5)
    files = []
    names = ["a", "b", "c", "d"]
    for _ in range(12):
        mine = rnd.sample(names, rnd.randint(1, 4))
        files.append([{"uid": str(u)} | {n: rnd.choice([u % 3, str(u % 3), u % 3 + 0.5, None, [u % 2], True]) if rnd.random() < 0.3 else u % 3 for n in mine if rnd.random() < 0.95} for u in range(rnd.randint(2, 6))])
    kinds = {str: "s", int: "i", float: "f", bool: "b", list: "a"}
    want = set()
    for f in range(2, len(files) + 1):
        p, n = files[f - 2], files[f - 1]
        types = lambda rows: {k: {kinds[type(r[k])] for r in rows if r.get(k) is not None} for k in {k for r in rows for k in r}}
        tp, tn = types(p), types(n)
        of = lambda rows, k: {r["uid"]: json.dumps(r[k]) for r in rows if k in r}
        olds, news = set(), set()
        for x in tp.keys() - tn.keys():
            for y in tn.keys() - tp.keys():
                vx, vy = of(p, x), of(n, y)
                both = vx.keys() & vy.keys()
                if both and all(vx[u] == vy[u] for u in both):
                    want.add((f, x, y, "renamed"))
                    olds.add(x)
                    news.add(y)
        want |= {(f, x, "", "removed") for x in tp.keys() - tn.keys() - olds} | {(f, "", y, "added") for y in tn.keys() - tp.keys() - news}
        want |= {(f, k, k, "retyped") for k in tp.keys() & tn.keys() if tp[k] and tn[k] and tp[k] != tn[k]}
    assert found(spark, *files) == want


RENAMES = "file_id long, old_field string, new_field string, change_kind string"


def unified(spark, t, *renames):
    return drift.unified_records(t, spark.createDataFrame([(2, a, b, "renamed") for a, b in renames], RENAMES))


def test_unified_records(spark):
    a = [{"uid": "1", "gold": 1, "src_key": "ab"}, {"uid": "2", "gold": 0, "src_key": "cd"}, *({"uid": u, "gold": 0, "src_key": "cd"} for u in "6789")]
    b = [{"uid": "1", "gold": True, "srcKey": "ab"}, {"uid": "2", "gold": "0", "srcKey": ["cd"]}, {"uid": "3", "gold": 1.0, "srcKey": {"alg": "x", "hex": "ef"}}, {"uid": "4", "gold": "no", "srcKey": 5}, {"uid": "5", "gold": 0, "srcKey": {"alg": "x", "hex": "gh"}}]
    t = lines(spark, a, b).withColumn("extra", F.lit("e"))
    got = {(r.file_id, r.uid): r for r in unified(spark, t, ("src_key", "srcKey")).collect()}
    assert [got[2, u].gold for u in "1234"] == [1, 0, 1, None] and [got[2, u].gold_string for u in "1234"] == [None, "0", None, "no"]
    assert got[2, "1"].gold_boolean is True and got[2, "3"].gold_decimal == 1.0 and got[1, "1"].gold_string is None
    assert [got[2, u].src_key for u in "12345"] == ["ab", "cd", "ef", "5", "gh"] and got[1, "1"].src_key == "ab" and got[1, "1"].extra == "e"
    assert got[2, "2"].src_key_array == '["cd"]' and got[2, "3"].src_key_object == '{"alg":"x","hex":"ef"}' and got[2, "4"].src_key_integer == 5
    with pytest.raises(ValueError):
        drift.unified_records(t, spark.createDataFrame([], RENAMES), max_fields=0)


def test_no_value_is_lost_where_linked_names_meet(spark):
    t = lines(spark, [{"uid": "1", "cond": "a"}, {"uid": "2", "condition": "a"}, {"uid": "3", "condition": "b"}], [{"cond": "old", "condition": "new"}, {"cond": "same", "condition": "same"}, {"cond": "x", "condition": None}])
    got = unified(spark, t, ("cond", "condition")).where("file_id = 2").orderBy("line_no").collect()
    assert [r.condition for r in got] == ["new", "same", "x"] and [r.condition_others for r in got] == [{"cond": '"old"'}, None, None]
    assert "cond" not in got[0].asDict()


def test_one_column_per_field(spark):
    """Letter case and signs, a rename, and a rename together with a new type, which only the values of items show."""
    keys = [f"k{i}" for i in range(6)]
    first = [{"uid": str(i), "src_key": k, "pred": i % 2} for i, k in enumerate(keys)]
    streams = [first + [{"uid": "z", "src_key": "q"}], [{"uid": str(i), "SRC_KEY": k} for i, k in enumerate(keys)], [{"uid": str(i), "digest": [k], "vote": i % 2} for i, k in enumerate(keys)]]
    t = lines(spark, streams[0], stream="d/a").unionByName(lines(spark, streams[1], stream="d/b")).unionByName(lines(spark, streams[2], stream="d/c"))
    out = unified(spark, t)
    assert {"src_key", "src_key_array", "pred", "vote"} <= set(out.columns) and not {"SRC_KEY", "digest"} & set(out.columns)
    assert {(r.stream, r.uid, r.src_key) for r in out.where("uid <> 'z'").collect()} == {(s, str(i), k) for s in ("d/a", "d/b", "d/c") for i, k in enumerate(keys)}


def test_changes_inside_fields(spark):
    a, b = [{"uid": "1", "m": {"x": 1, "z": 1}, "l": [1], "n": 1}], [{"uid": "1", "m": {"x": "1", "y": 2}, "l": ["a", {"q": [True]}], "o": {"p": 1}}]
    t = lines(spark, a, b)
    assert {tuple(r) for r in drift.path_changes(t).collect()} == {(2, "m.x", "retyped"), (2, "m.y", "added"), (2, "m.z", "removed"), (2, "l[]", "retyped"), (2, "l[].q", "added"), (2, "l[].q[]", "added")}
    got = {(r.path, r.tag): (r.n_files, r.n_values, r.first_file_id) for r in drift.path_alternatives(t).collect()}
    assert got["m", "object"] == (2, 2, 1) and got["l[]", "integer"] == (1, 1, 1) and got["l[].q[]", "boolean"] == (1, 1, 2)
    assert drift.path_changes(table(spark, [])).count() == 0 and drift.path_alternatives(table(spark, [])).count() == 0


def test_one_complete_object_per_line(spark):
    texts = ['{"a":1}', ' {"a":1} ', '{"a":1} {"b":2}', '{"a":1},{"b":2}', '{"a":1}]', '{"a":1}],"y":[{"b":2}', '{"a":1},0] x', '{"a":1', "[1]", "7", "", None, '{"a":1,"a":2}']
    got = drift.json_objects(spark.createDataFrame(list(enumerate(texts)), "i int, payload string")).select("i").collect()
    assert sorted(r.i for r in got) == [0, 1]


INDEX = "uid string, row_id long, kind string, gold int, stratum string, category string, src_sha1 string"


def test_index_differences(spark):
    a = spark.createDataFrame([("1", 1, "k", 0, "s", "c", "AB"), ("1", 1, "k", 0, "s", "c", "AB"), ("2", 1, "k", 0, "s", "c", None), ("3", None, "k", 0, "s", "c", "x"), ("5", 5, "k", None, "s", "", "x")], INDEX)
    b = spark.createDataFrame([(" 1 ", 1, "k", 0, "s", "c", "ab"), ("2", 2, "k", 1, "s", "c", "x"), ("4", 1, "k", 0, "s", "c", "x"), ("\t5 ", 5, "k", None, "s", None, "x")], INDEX)
    got = {tuple(r) for r in diff.index_differences(a, b.withColumn("side", F.lit(1)).withColumn("k", F.lit(2))).collect()}
    assert got == {("2", "row_id"), ("2", "gold"), ("2", "src_sha1"), ("3", "missing_in_copy"), ("4", "missing_in_index"), ("5", "category")}


def test_several_versions_of_a_key(spark):
    f = {"v": F.col("v"), "w": F.col("w")}
    a = spark.createDataFrame([("1", 1, 1), ("1", 2, 1), ("1", 3, 1), ("2", 1, 1), ("2", 2, 1)], "k1 string, v int, w int")
    b = spark.createDataFrame([("1", 3, 1), ("1", 1, 1), ("1", 2, 1), ("2", 1, 1)], "k1 string, v int, w int")
    assert {tuple(r) for r in diff.differences(a, b, "k1", f).collect()} == {("2", "v")}


def test_null_keys_rows_and_empty_tables(spark):
    n = spark.createDataFrame([(None,) * 7], INDEX)
    e = spark.createDataFrame([], INDEX)
    assert diff.index_differences(n, n).count() == 0
    assert [tuple(r) for r in diff.index_differences(n, e).collect()] == [(None, "missing_in_copy")]
    assert [tuple(r) for r in diff.index_differences(e, n).collect()] == [(None, "missing_in_index")]
    assert diff.index_differences(e, e).count() == 0
    one = spark.createDataFrame([("1", 1, "k" * 100_000, 0, "s", "c", "x")], INDEX)
    assert {r.field_name for r in diff.index_differences(one, one.withColumn("kind", F.lit(""))).collect()} == {"kind"}
