"""Queries on members' files, guards, locks and limits, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions import parsers, prompts
from quorate.operators import assembly, committee, cost, guard, panel, release, scorer, verdicts
from quorate.operators.drift import json_objects
from quorate.plans import config, item_queries, verdict_queries
from quorate.plans.lineage import cut
from quorate.sources import builders
from quorate.sources.tables import table

#: Rows, pairs or items that the limited builds keep.
KEPT = 50
#: Registry of judges by tag, a fixed table, and the tags that files are read under here.
REGISTRY = [(j.key, j.harness, j.contrast) for j in config.JUDGES]
TAGS = ("sonnet", "autoj", "minicheck_ft5", "sonnet_defon", "autoj_defon", "nobody")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "shard_lines")


def shard_probes(spark: SparkSession, d: str) -> DataFrame:
    return assembly.probes(_lines(spark, d))


def shard_states(spark: SparkSession, d: str) -> DataFrame:
    return assembly.shard_states(_lines(spark, d))


def foreign_models(spark: SparkSession, d: str) -> DataFrame:
    return assembly.foreign_models(_lines(spark, d))


def member_states(spark: SparkSession, d: str) -> DataFrame:
    return assembly.member_states(_lines(spark, d), 0.75)


def panel_file(spark: SparkSession, d: str) -> DataFrame:
    return assembly.in_panel_order(table(spark, d, "experiment").select("dataset", "rec_id", "model"), table(spark, d, "panel_roster")).select("dataset", "line_no", "rec_id")


def guard_scan(spark: SparkSession, d: str) -> DataFrame:
    arms = guard.recorded_arms(_lines(spark, d).select("stream", "file_id", "payload"))
    tag = F.element_at(F.array(*[F.lit(t) for t in TAGS]), (F.col("file_id") % len(TAGS) + 1).cast("int"))
    files = arms.select(F.col("file_id").cast("string").alias("path"), F.split("stream", "/")[0].alias("dataset"), tag.alias("tag"), "recorded")
    return guard.scan(files, spark.createDataFrame(REGISTRY, "tag string, harness string, contrast boolean"))


def _digests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Digests of all files under the number of the next one in their stream, and under their own."""
    names = _lines(spark, d).select("file_id", "stream", "file_seq").distinct()
    files = cut(release.file_digests(_lines(spark, d)).join(names, "file_id").select("stream", "file_seq", "sha256"))
    of = lambda seq: files.select(F.concat("stream", F.lit("/"), seq.cast("string")).alias("path"), "sha256")
    return of(F.col("file_seq") + 1), of(F.col("file_seq"))


def lock_guard(spark: SparkSession, d: str) -> DataFrame:
    return release.lock_guard(*_digests(spark, d))


def mirror_check(spark: SparkSession, d: str) -> DataFrame:
    recorded, present = _digests(spark, d)
    return release.mirror_check(recorded, present, present)


def index_digest(spark: SparkSession, d: str) -> DataFrame:
    return release.index_digest(table(spark, d, "instances"))


def item_votes(spark: SparkSession, d: str) -> DataFrame:
    return committee.item_votes(table(spark, d, "experiment"), table(spark, d, "panel_roster"))


def api_usage(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d).select("stream", "file_id", "line_no", "payload").where("trim(payload) <> ''")
    whole = json_objects(lines).select("stream", F.lit(False).alias("failed"), cost.words(F.try_variant_get("object", "$.raw", "string")).alias("tokens_out"), F.try_variant_get("object", "$.wall_seconds", "double").alias("seconds"))
    every = lines.groupBy("stream").agg(F.count("*").alias("n"))
    good = whole.groupBy("stream").agg(F.count("*").alias("good"))
    # A line that is no complete object is a call that failed: counted, with nothing else known of it.
    failed = every.join(good, "stream", "left").select("stream", F.explode(F.sequence(F.lit(0), F.col("n") - F.coalesce("good", F.lit(0)))).alias("i")).where("i > 0")
    calls = whole.unionByName(failed.select("stream", F.lit(True).alias("failed"), F.lit(None).cast("int").alias("tokens_out"), F.lit(None).cast("double").alias("seconds")))
    return cost.api_usage(calls.withColumn("tokens_in", F.lit(0)), "stream").drop("input_tokens", "input_tokens_per_item")


def native_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Labels as each graded judge would write them, read again."""
    rows = table(spark, d, "experiment").select("pred")
    per = [rows.select(F.lit(j).alias("judge"), "pred", parsers.native_label(j, parsers.native_mock(j, F.col("pred"))).alias("label")) for j in parsers.SCORES]
    return per[0].unionByName(per[1]).unionByName(per[2]).groupBy("judge").agg(F.count("*").alias("n"), F.count_if(F.col("pred").eqNullSafe(F.col("label"))).alias("n_same"))


def graded_scores(spark: SparkSession, d: str) -> DataFrame:
    """Texts, unreadable ones and the mean score of each graded judge."""
    per = [verdict_queries.QUERIES[f"graded_parse_{q}"](spark, d).select(F.lit(q).alias("judge"), "score") for q in ("prometheus", "judgelm", "autoj")]
    return per[0].unionByName(per[1]).unionByName(per[2]).groupBy("judge").agg(F.count("*").alias("n"), F.count_if(F.col("score").isNull()).alias("n_failed"), F.round(F.avg("score"), 6).alias("mean_score"))


def run_plan(spark: SparkSession, d: str) -> DataFrame:
    """How far the runs of the whole panel over all items have come."""
    models = [r["model"] for r in table(spark, d, "panel_roster").orderBy("panel_idx").collect()]  # the fixed roster
    return panel.progress(panel.run_plan(table(spark, d, "instances"), models), table(spark, d, "experiment"))


def limited_items(spark: SparkSession, d: str) -> DataFrame:
    """The items of limited builds: of so many source rows, pairs, or single items."""
    rows = {"medhallu": item_queries.medhallu_rows(spark, d), "ragtruth": item_queries.ragtruth_rows(spark, d), "aggrefact_expertqa": item_queries.expertqa_rows(spark, d)}
    built = [builders.build(s, r, KEPT).select(F.lit(s).alias("dataset"), "uid") for s, r in rows.items()]
    return built[0].unionByName(built[1]).unionByName(built[2])


def allowed_tokens(spark: SparkSession, d: str) -> DataFrame:
    return scorer.allowed_ids(verdict_queries.word_pieces(spark, d), ("Supported",), ("HALLUCINATED", "Hallucinated"))


def prompt_by_condition(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of each item under the condition of its data set."""
    rows = item_queries.with_task(spark, d)
    args = [*[F.col(c) for c in ("question", "context", "candidate", "subject_phrase", "has_context")], F.coalesce("context_label", F.lit(""))]
    of = lambda c: prompts.prompt(c, *args)
    return rows.select("inst_id", F.when(prompts.condition(F.col("dataset")) == "claimcheck", of("claimcheck")).otherwise(of("def_on")).alias("prompt"))


def coverage_of_keys(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.coverage(table(spark, d, "experiment"), ("dataset", "model"), also="src_key")


QUERIES = {
    f.__name__: f
    for f in (
        shard_probes, shard_states, foreign_models, member_states, panel_file, guard_scan, lock_guard, mirror_check, index_digest, item_votes, api_usage, native_round_trip, graded_scores, run_plan, limited_items,
        allowed_tokens, prompt_by_condition, coverage_of_keys,
    )
}

_OBJECTS = (
    "o AS (SELECT stream, file_id, line_no, split_part(stream, '/', 1) AS dataset, split_part(stream, '/', 2) AS own, json_extract_string(payload, '$.uid') AS uid, json_extract_string(payload, '$.model') AS model, "
    "json_extract_string(payload, '$.condition') AS condition, try_cast(json_extract_string(payload, '$.pred') AS DOUBLE) AS pred, try_cast(json_extract_string(payload, '$.prob_yes') AS DOUBLE) AS prob, payload "
    "FROM shard_lines WHERE json_valid(payload) AND json_type(payload) = 'OBJECT')"
)
_PROBES = f"{_OBJECTS}, p AS (SELECT stream, file_id, count(*) AS n_lines, first(model ORDER BY line_no) AS model, any_value(own) AS own FROM o GROUP BY ALL)"
_WANT = "CASE WHEN starts_with(dataset, 'aggrefact_') THEN 'claimcheck' ELSE 'def_on' END"
_FILES = "WITH " + item_queries._DIGEST.format("shard_lines") + ", n AS (SELECT DISTINCT file_id, stream, file_seq FROM shard_lines), s AS (SELECT stream, file_seq, sha256 FROM f JOIN n USING (file_id)), l AS (SELECT stream || '/' || (file_seq + 1) AS path, sha256 FROM s), p AS (SELECT stream || '/' || file_seq AS path, sha256 FROM s)"
_REGISTRY = "(VALUES " + ", ".join(f"('{t}', '{h}', {str(c).lower()})" for t, h, c in REGISTRY) + ") AS r(tag, harness, contrast)"
_ARMS = f"x AS (SELECT file_id, split_part(stream, '/', 1) AS dataset, {item_queries._LABEL} AS label FROM shard_lines WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'), g AS (SELECT file_id, any_value(dataset) AS dataset, list_sort(coalesce(list(DISTINCT label) FILTER (WHERE label IS NOT NULL), [])) AS rec FROM x GROUP BY file_id)"
_EMPTY = "coalesce({}::VARCHAR, '')"

SQL = {
    "shard_probes": f"WITH {_PROBES} SELECT stream, file_id, n_lines, model FROM p",
    "shard_states": f"WITH {_PROBES}, e AS (SELECT *, max(n_lines) OVER (PARTITION BY stream) AS n_expected FROM p) SELECT stream, file_id, n_lines, n_expected, model, CASE WHEN n_lines < n_expected THEN 'recompute' WHEN model IS NOT DISTINCT FROM own THEN 'cached' ELSE 'refuse' END AS state FROM e",
    "foreign_models": f"WITH {_OBJECTS} SELECT stream, file_id, count(*) AS n_rows, string_agg(DISTINCT coalesce(model, 'none'), ',' ORDER BY coalesce(model, 'none')) AS models FROM o WHERE model IS DISTINCT FROM own GROUP BY ALL",
    "member_states": f"WITH {_OBJECTS}, m AS (SELECT stream, file_id, count(*) AS n_rows, count(DISTINCT uid) AS n_uids, count(pred)::DOUBLE / count(*) AS coverage, count(prob)::DOUBLE / count(*) AS prob_coverage, bool_and(model IS NOT DISTINCT FROM own) AS mine, bool_and(condition IS NOT DISTINCT FROM {_WANT}) AS fits FROM o GROUP BY ALL) "
    "SELECT stream, file_id, n_rows, n_uids, coverage, prob_coverage, CASE WHEN NOT mine THEN 'other model' WHEN NOT fits THEN 'other condition' WHEN n_uids < n_rows THEN 'repeated items' WHEN coverage < 0.75 OR prob_coverage < 0.75 THEN 'low coverage' ELSE 'ok' END AS state FROM m",
    "panel_file": "SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY panel_idx, rec_id) - 1 AS line_no, rec_id FROM experiment JOIN panel_roster USING (model)",
    "guard_scan": f"WITH {_ARMS}, t AS (SELECT file_id, dataset, rec, [{', '.join(repr(t) for t in TAGS)}][file_id % {len(TAGS)} + 1] AS tag FROM g), u AS (SELECT file_id, dataset, rec, ends_with(tag, '_defon') AS apart, regexp_replace(tag, '_defon$', '') AS tag FROM t), "
    f"w AS (SELECT file_id, rec, harness, CASE WHEN apart THEN 'def_on' WHEN harness = 'judge' THEN {_WANT} WHEN harness = 'ptjudge' THEN CASE WHEN starts_with(dataset, 'aggrefact_') THEN 'claimcheck' ELSE 'qa' END ELSE 'claimcheck' END AS want FROM u JOIN {_REGISTRY} USING (tag) WHERE NOT apart OR contrast) "
    "SELECT file_id::VARCHAR AS path, 'holds ' || CASE WHEN len(rec) = 0 THEN 'nothing' ELSE array_to_string(rec, ',') END || ', expected ' || want AS why FROM w WHERE rec <> [want] AND NOT (len(rec) = 0 AND (harness = 'minicheck' OR (harness = 'ptjudge' AND want = 'qa')))",
    "lock_guard": f"{_FILES}, j AS (SELECT l.path, p.path IS NULL AS missing, p.sha256 <> l.sha256 AS changed FROM l LEFT JOIN p ON l.path = p.path), k AS (SELECT count(*) FILTER (WHERE missing) AS n_missing, count(*) FILTER (WHERE changed) AS n_changed FROM j) "
    "SELECT n_missing, n_changed, (SELECT coalesce(string_agg(path, ',' ORDER BY path), '') FROM (SELECT path FROM j WHERE missing ORDER BY path LIMIT 5)) AS missing, CASE WHEN n_missing + n_changed > 0 THEN 'refuse' ELSE 'write' END AS decision FROM k",
    "mirror_check": f"{_FILES} SELECT l.path, CASE WHEN p.path IS NULL THEN 'missing' ELSE 'changed' END AS state FROM l LEFT JOIN p ON l.path = p.path WHERE p.path IS NULL OR p.sha256 <> l.sha256 "
    "UNION ALL SELECT path, 'orphan' FROM l WHERE path NOT IN (SELECT path FROM p) UNION ALL SELECT path, 'unexported' FROM p WHERE path NOT IN (SELECT path FROM l)",
    "index_digest": f"WITH x AS (SELECT dataset, concat_ws('|', {', '.join(_EMPTY.format(c) for c in ('uid', 'row_id', 'kind', 'gold', 'stratum', 'category'))}, {item_queries._sha()}) AS line FROM instances), {item_queries._tree('dataset')} SELECT count(*) AS n_sets, sha256(string_agg(dataset || digest, '' ORDER BY dataset)) AS digest FROM t0",
    "item_votes": f"WITH f AS ({verdict_queries._FIRST}), r AS (SELECT f.* FROM f JOIN (SELECT DISTINCT model FROM panel_roster) USING (model)) SELECT dataset, condition, uid, string_agg(model || '=' || coalesce(pred::VARCHAR, '-'), ' ' ORDER BY model, model || '=' || coalesce(pred::VARCHAR, '-')) AS votes, "
    "CASE WHEN count(pred) > 0 THEN (2 * coalesce(sum(pred), 0) >= count(pred))::INTEGER END AS decision FROM r GROUP BY dataset, condition, uid",
    "api_usage": f"WITH {_OBJECTS}, a AS (SELECT stream, count(*) AS calls FROM shard_lines WHERE trim(payload) <> '' GROUP BY stream), g AS (SELECT stream, count(*) AS good, sum({verdict_queries._words('json_extract_string(payload, chr(36) || chr(46) || chr(114) || chr(97) || chr(119))')})::BIGINT AS output_tokens, round(coalesce(sum(try_cast(json_extract_string(payload, '$.wall_seconds') AS DOUBLE)), 0), 1) AS wall_seconds FROM o GROUP BY stream) "
    "SELECT stream, calls, calls - coalesce(good, 0) AS api_errors, coalesce(output_tokens, 0) AS output_tokens, coalesce(wall_seconds, 0) AS wall_seconds, round(coalesce(output_tokens, 0)::DOUBLE / calls, 2) AS output_tokens_per_item FROM a LEFT JOIN g USING (stream)",
    "native_round_trip": "SELECT judge, count(*) AS n, count(*) AS n_same FROM experiment, (VALUES ('prometheus2'), ('judgelm'), ('autoj')) AS j(judge) GROUP BY judge",
    "graded_scores": " UNION ALL ".join(f"SELECT '{q}' AS judge, count(*) AS n, count(*) - count(score) AS n_failed, round(avg(score), 6) AS mean_score FROM ({verdict_queries.SQL[f'graded_parse_{q}']})" for q in ("prometheus", "judgelm", "autoj")),
    "run_plan": f"WITH e AS (SELECT DISTINCT dataset, uid, model, condition FROM experiment WHERE fmt = 'brief_reason' AND paraphrase = 'p0'), p AS (SELECT dataset, uid, panel_idx AS model_idx, model, {_WANT} AS condition FROM instances, panel_roster) "
    "SELECT p.dataset, model_idx, p.model, count(*) AS n_planned, count(e.uid) AS n_recorded, count(*) - count(e.uid) AS n_missing FROM p LEFT JOIN e ON p.dataset = e.dataset AND p.uid = e.uid AND p.model = e.model AND p.condition = e.condition GROUP BY ALL",
    "limited_items": f"WITH m AS MATERIALIZED ({item_queries.SQL['pair_rows']}), g AS MATERIALIZED ({item_queries.SQL['first_per_group_pairs']}), b AS MATERIALIZED ({item_queries.SQL['balanced_subsample']}) "
    f"SELECT 'medhallu' AS dataset, uid FROM m WHERE row_id IN (SELECT DISTINCT row_id FROM m ORDER BY row_id LIMIT {KEPT}) UNION ALL SELECT 'ragtruth', uid FROM g WHERE row_id < {KEPT} UNION ALL SELECT 'aggrefact_expertqa', uid FROM b WHERE split_part(uid, ':', 1)::BIGINT < {KEPT}",
    "allowed_tokens": f"SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM ({verdict_queries.SQL['choice_tokens']})",
    "prompt_by_condition": f"WITH q AS ({item_queries.SQL['prompt_render_qa']}), c AS ({item_queries.SQL['prompt_render_claim']}) SELECT inst_id, CASE WHEN starts_with(dataset, 'aggrefact_') THEN c.prompt ELSE q.prompt END AS prompt FROM instances JOIN q USING (inst_id) JOIN c USING (inst_id)",
    "coverage_of_keys": "SELECT dataset, model, count(*) AS n_rows, count(DISTINCT uid) AS n_uids, count(pred) AS n_pred, count(src_key) AS n_also, count(pred)::DOUBLE / count(*) AS coverage, (count(pred)::DOUBLE / count(*) < 0.999)::INTEGER AS is_low FROM experiment GROUP BY ALL",
}
