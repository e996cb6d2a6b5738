"""Queries over drifting files and differing copies, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quorate.operators import diff, drift
from quorate.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "shard_lines"))


def p1_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return drift.alternatives(table(spark, d, "shard_lines"))


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    return drift.path_alternatives(table(spark, d, "shard_lines"))


def p1_path_changes(spark: SparkSession, d: str) -> DataFrame:
    return drift.path_changes(table(spark, d, "shard_lines"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "shard_lines")
    return drift.unified_records(lines, drift.changes(lines))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return diff.index_differences(table(spark, d, "aggrefact_cnn"), table(spark, d, "aggrefact_cnn_copy"))


QUERIES = {"p1_found": p1_found, "p1_alternatives": p1_alternatives, "p1_paths": p1_paths, "p1_path_changes": p1_path_changes, "p1_records": p1_records, "p7_found": p7_found}

_FIELDS = ("row_id", "kind", "gold", "stratum", "category", "src_sha1")
_SIDE = "SELECT DISTINCT trim(uid) AS uid, row_id, kind, gold, stratum, category, lower(src_sha1) AS src_sha1 FROM {}"

_LINES = (
    "v AS (SELECT stream, file_seq, file_id, written_at, payload FROM shard_lines WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'), "
    "f AS (SELECT v.stream, v.file_seq, v.file_id, v.written_at, json_extract_string(v.payload, '$.uid') AS uid, e.key AS name, "
    "CASE WHEN e.type = 'VARCHAR' THEN 'string' WHEN e.type IN ('UBIGINT', 'BIGINT', 'HUGEINT') THEN 'integer' WHEN e.type = 'DOUBLE' THEN 'decimal' WHEN e.type = 'NULL' THEN NULL ELSE lower(e.type) END AS tag, "
    "CASE WHEN e.type IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') THEN (e.value::DOUBLE)::VARCHAR ELSE e.value::VARCHAR END AS value FROM v, json_each(v.payload) AS e)"
)



def _held(*names: str) -> str:
    """The JSON value under the first of the names that is there and not null."""
    return "coalesce(" + ", ".join(f"CASE WHEN json_type(payload, '$.{n}') <> 'NULL' THEN json_extract(payload, '$.{n}') END" for n in names) + ")"


def _typed(field: str, kind: str) -> str:
    """Value ``field`` as text, an integer or a decimal."""
    text = f"CASE json_type({field}) WHEN 'ARRAY' THEN CASE WHEN json_array_length({field}) = 1 THEN {field} ->> 0 END WHEN 'OBJECT' THEN {field} ->> 'hex' ELSE {field} ->> '$' END"
    if kind == "string":
        return f"{text} AS {field}"
    number = f"try_cast({text} AS DOUBLE)"
    return f"{number} AS {field}" if kind == "decimal" else f"CASE WHEN json_type({field}) = 'BOOLEAN' THEN ({field}::BOOLEAN)::BIGINT WHEN {number} = floor({number}) THEN {number}::BIGINT END AS {field}"


#: The fields of the verdict files: their names, the type most lines have, and the other types.
_RECORD = {
    "uid": (["uid"], "string", []), "row_id": (["row_id", "rowId"], "integer", ["string", "decimal"]), "kind": (["kind"], "string", []), "gold": (["gold"], "integer", ["string", "boolean"]),
    "stratum": (["stratum", "stratum_name"], "string", []), "category": (["category"], "string", ["array"]), "src_key": (["src_key", "srcKey", "SRC_KEY", "source_key", "src_sha1"], "string", ["integer", "array", "object"]),
    "model": (["model"], "string", []), "condition": (["condition", "cond", "Condition"], "string", []), "fmt": (["fmt", "format"], "string", []), "paraphrase": (["paraphrase"], "string", []),
    "pred": (["pred"], "integer", ["string", "decimal"]), "raw": (["raw"], "string", []), "prob_yes": (["prob_yes"], "decimal", []), "wall_seconds": (["wall_seconds"], "decimal", []),
    "seed_no": (["seed_no"], "integer", []), "threshold": (["threshold"], "decimal", []), "judge": (["judge"], "string", []), "frame": (["frame"], "string", []),
}
_KINDS = {"string": ("'VARCHAR'", "->> '$'", "VARCHAR"), "integer": ("'UBIGINT', 'BIGINT'", "", "BIGINT"), "decimal": ("'DOUBLE'", "", "DOUBLE"), "boolean": ("'BOOLEAN'", "", "BOOLEAN"), "array": ("'ARRAY'", "", "VARCHAR"), "object": ("'OBJECT'", "", "VARCHAR")}


def _branch(field: str, kind: str) -> str:
    types, get, to = _KINDS[kind]
    return f"CASE WHEN json_type({field}) IN ({types}) THEN ({field} {get})::{to} END AS {field}_{kind}"


_TREE = (
    "v AS (SELECT stream, file_seq, file_id, written_at, payload FROM shard_lines WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'), "
    r"f AS (SELECT v.stream, v.file_seq, v.file_id, v.written_at, regexp_replace(substr(t.fullkey, 3), '\[\d+\]', '[]', 'g') AS path, "
    "CASE WHEN t.type = 'VARCHAR' THEN 'string' WHEN t.type IN ('UBIGINT', 'BIGINT', 'HUGEINT') THEN 'integer' WHEN t.type = 'DOUBLE' THEN 'decimal' WHEN t.type = 'NULL' THEN NULL ELSE lower(t.type) END AS tag FROM v, json_tree(v.payload) AS t WHERE t.fullkey <> '$')"
)

SQL = {
    "p1_paths": f"WITH {_TREE} SELECT path, tag, count(DISTINCT file_id) AS n_files, count(*) AS n_values, first(file_id ORDER BY written_at, file_id) AS first_file_id FROM f WHERE tag IS NOT NULL GROUP BY path, tag",
    "p1_path_changes": rf"WITH {_TREE}, p AS (SELECT stream, file_seq, file_id, path, regexp_extract(path, '^[^.\[]*') AS field, list_sort(coalesce(list(DISTINCT tag) FILTER (WHERE tag IS NOT NULL), [])) AS tags FROM f GROUP BY ALL), "
    "n AS (SELECT DISTINCT a.stream, a.file_seq AS before, b.file_seq AS after, b.file_id AS l FROM shard_lines a JOIN shard_lines b ON a.stream = b.stream AND b.file_seq = a.file_seq + 1), "
    "o AS (SELECT l, field, path, tags FROM n JOIN p ON p.stream = n.stream AND p.file_seq = n.before), w AS (SELECT l, field, path, tags FROM n JOIN p ON p.stream = n.stream AND p.file_seq = n.after), "
    "j AS (SELECT coalesce(o.l, w.l) AS l, coalesce(o.field, w.field) AS field, coalesce(o.path, w.path) AS path, o.tags AS a, w.tags AS b FROM o FULL JOIN w ON o.l = w.l AND o.path = w.path) "
    "SELECT l AS file_id, path, CASE WHEN b IS NULL THEN 'removed' WHEN a IS NULL THEN 'added' ELSE 'retyped' END AS change_kind FROM j "
    "WHERE path <> field AND EXISTS (SELECT 1 FROM j k WHERE k.l = j.l AND k.path = j.field AND k.a IS NOT NULL AND k.b IS NOT NULL) AND (a IS NULL OR b IS NULL OR (len(a) > 0 AND len(b) > 0 AND a <> b))",
    "p1_records": "WITH v AS (SELECT file_id, stream, file_seq, written_at, line_no, " + ", ".join(f"{_held(*names)} AS {field}" for field, (names, _, _) in _RECORD.items()) + " FROM shard_lines WHERE json_valid(payload) AND json_type(payload) = 'OBJECT') "
    "SELECT file_id, stream, file_seq, written_at, line_no, " + ", ".join(x for field, (_, main, others) in _RECORD.items() for x in (_typed(field, main), *(_branch(field, k) for k in others))) + " FROM v",
    "p1_alternatives": f"WITH {_LINES} SELECT name, tag, count(DISTINCT file_id) AS n_files, count(*) AS n_lines, first(file_id ORDER BY written_at, file_id) AS first_file_id FROM f WHERE tag IS NOT NULL GROUP BY name, tag",
    "p1_found": f"WITH {_LINES}, p AS (SELECT file_id, name, list_sort(coalesce(list(DISTINCT tag) FILTER (WHERE tag IS NOT NULL), [])) AS tags FROM f GROUP BY ALL), "
    "s AS (SELECT DISTINCT stream, file_seq, file_id FROM shard_lines), n AS (SELECT a.file_id AS e, b.file_id AS l FROM s a JOIN s b ON a.stream = b.stream AND b.file_seq = a.file_seq + 1), "
    "o AS (SELECT e, l, name, tags FROM n JOIN p ON p.file_id = n.e), w AS (SELECT e, l, name, tags FROM n JOIN p ON p.file_id = n.l), "
    "x AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.l = o.l AND w.name = o.name)), y AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.l = w.l AND o.name = w.name)), "
    "r AS (SELECT x.l, x.name AS a, y.name AS b FROM x JOIN y ON x.l = y.l JOIN f AS fa ON fa.file_id = x.e AND fa.name = x.name JOIN f AS fb ON fb.file_id = y.l AND fb.name = y.name AND fa.uid = fb.uid GROUP BY ALL HAVING bool_and(fa.value IS NOT DISTINCT FROM fb.value)) "
    "SELECT l AS file_id, a AS old_field, b AS new_field, 'renamed' AS change_kind FROM r "
    "UNION ALL SELECT l, name, '', 'removed' FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.l = x.l AND r.a = x.name) "
    "UNION ALL SELECT l, '', name, 'added' FROM y WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.l = y.l AND r.b = y.name) "
    "UNION ALL SELECT o.l, o.name, o.name, 'retyped' FROM o JOIN w ON o.l = w.l AND o.name = w.name WHERE len(o.tags) > 0 AND len(w.tags) > 0 AND o.tags <> w.tags",
    "p7_found": f"WITH a AS ({_SIDE.format('aggrefact_cnn')}), b AS ({_SIDE.format('aggrefact_cnn_copy')}) "
    "SELECT uid, 'missing_in_copy' AS field_name FROM a WHERE uid NOT IN (SELECT uid FROM b) "
    "UNION SELECT uid, 'missing_in_index' FROM b WHERE uid NOT IN (SELECT uid FROM a) "
    + " ".join(f"UNION SELECT a.uid, '{f}' FROM a JOIN b ON a.uid = b.uid WHERE a.{f} IS DISTINCT FROM b.{f}" for f in _FIELDS),
}
