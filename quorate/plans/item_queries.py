"""Queries on items, prompts, indexes, files and guards, with the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions import prompts
from quorate.functions.text import content_key
from quorate.operators import compare, guard, release
from quorate.plans.lineage import cut, shared_folder, spread
from quorate.sinks import files
from quorate.sources import builders
from quorate.sources.tables import table


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "instances")


def _key() -> Column:
    return content_key(F.col("question"), F.col("context"), F.col("candidate"))


def _flat(built: DataFrame) -> DataFrame:
    return built.select("uid", "row_id", "kind", "gold", "stratum", "category", _key().alias("src_sha1"))


def _of(spark: SparkSession, d: str, dataset: str) -> DataFrame:
    return _items(spark, d).where(F.col("dataset") == dataset)


def _by_row(items: DataFrame) -> DataFrame:
    """Source rows of a question set, put together again from its items."""
    by = "inst_id"
    pick = lambda c: F.min_by(c, by).alias(c)
    side = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("candidate")))).alias(k)
    return items.where("row_id IS NOT NULL").groupBy(F.col("row_id").alias("pos")).agg(pick("question"), pick("context"), pick("stratum"), pick("category"), side("pos").alias("good"), side("neg").alias("bad"))


def medhallu_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _by_row(_of(spark, d, "medhallu"))
    at = lambda c: F.try_element_at(F.col(c), F.lit(1))
    return rows.select("pos", "question", "context", at("good").alias("truth"), at("bad").alias("hallucinated"), F.col("stratum").alias("difficulty"), "category").where("truth IS NOT NULL AND hallucinated IS NOT NULL")


def pair_rows(spark: SparkSession, d: str) -> DataFrame:
    return _flat(builders.paired_rows(medhallu_rows(spark, d)))


def best_or_first(spark: SparkSession, d: str) -> DataFrame:
    rows = _by_row(_of(spark, d, "truthfulqa"))
    best = F.when(F.col("pos") % 2 == 0, F.try_element_at(F.col("good"), F.lit(-1))).otherwise("")
    return _flat(builders.best_or_first(rows.select("pos", "question", best.alias("best"), F.col("good").alias("correct"), F.col("bad").alias("incorrect"), F.col("stratum").alias("type"), "category")))


def ragtruth_rows(spark: SparkSession, d: str) -> DataFrame:
    return _of(spark, d, "ragtruth").select(F.col("inst_id").alias("pos"), F.col("question").alias("query"), "context", F.col("candidate").alias("output"), (F.col("gold") == 1).alias("faulty"))


def first_per_group_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _flat(builders.first_pairs(ragtruth_rows(spark, d)))


def nested_facts(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct((F.col("inst_id") % 11 != 0).alias("relevant"), F.array(F.struct(F.when(F.col("gold") == 0, "S").when(F.col("gold") == 1, "ns").alias("label"), F.col("candidate").alias("text"))).alias("facts"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("inst_id", one.alias("a")))), lambda x: x["a"])
    rows = _of(spark, d, "factscore").where("row_id IS NOT NULL").groupBy(F.col("row_id").alias("pos")).agg(F.min_by("question", "inst_id").alias("topic"), listed.alias("annotations"))
    return _flat(builders.nested_facts(rows))


def expertqa_rows(spark: SparkSession, d: str) -> DataFrame:
    return _of(spark, d, "aggrefact_expertqa").select(F.col("inst_id").alias("pos"), F.array_join(F.coalesce("context", F.array().cast("array<string>")), " ").alias("doc"), F.col("candidate").alias("claim"), (1 - F.col("gold")).alias("label"))


def balanced_subsample(spark: SparkSession, d: str) -> DataFrame:
    return _flat(builders.balanced_claims(expertqa_rows(spark, d), "aggrefact-expertqa"))


def exemplar_exclusion(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    return builders.without_exemplars(items, builders.exemplars(items)).select("dataset", "uid")


def content_keys(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("inst_id", _key().alias("src_sha1"))


def index_manifest(spark: SparkSession, d: str) -> DataFrame:
    return release.index_manifest(_items(spark, d))


def join_drift(spark: SparkSession, d: str) -> DataFrame:
    return compare.index_drift(compare.rebuilt_index(_items(spark, d), "aggrefact_cnn"), table(spark, d, "aggrefact_cnn"))


def verdict_drift(spark: SparkSession, d: str) -> DataFrame:
    fields = ("row_id", "kind", "gold", "stratum")
    rows = table(spark, d, "experiment").where("dataset = 'aggrefact_cnn'")
    return compare.index_drift(compare.rebuilt_index(_items(spark, d), "aggrefact_cnn"), rows, fields)


def keyed_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return compare.keyed_verdicts(table(spark, d, "experiment"), _items(spark, d))


def with_task(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).join(F.broadcast(table(spark, d, "task_specs")), "dataset")  # the fixed table of sets


def prompt_render_qa(spark: SparkSession, d: str) -> DataFrame:
    return with_task(spark, d).select("inst_id", prompts.qa_prompt(*[F.col(c) for c in ("question", "context", "candidate", "subject_phrase", "has_context")], F.coalesce("context_label", F.lit(""))).alias("prompt"))


def prompt_render_claim(spark: SparkSession, d: str) -> DataFrame:
    return with_task(spark, d).select("inst_id", prompts.claim_prompt(*[F.col(c) for c in ("question", "context", "candidate", "has_context")]).alias("prompt"))


def fewshot_block(spark: SparkSession, d: str) -> DataFrame:
    args = [F.col(c) for c in ("question", "context", "candidate", "has_context")]
    claim = prompts.frame(F.col("dataset")) == "claimcheck"
    answer = F.when(F.col("gold") == 0, "Yes").otherwise("No")
    label = F.coalesce("context_label", F.lit(""))
    return with_task(spark, d).select("inst_id", prompts.fewshot_block(*args, label, claim, prompts.EXEMPLAR_CHARS, answer).alias("exemplar"), prompts.fewshot_block(*args, label, claim, prompts.QUERY_CHARS).alias("query"))


def fewshot_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Whole few-shot prompts of the items whose source row gave no exemplar."""
    args = [F.col(c) for c in ("question", "context", "candidate", "has_context")]
    claim, label = prompts.frame(F.col("dataset")) == "claimcheck", F.coalesce("context_label", F.lit(""))
    answer = F.when(F.col("gold") == 0, "Yes").otherwise("No")
    items, chosen = with_task(spark, d), builders.exemplars(_items(spark, d))
    shots = builders.exemplar_blocks(items.withColumn("block", prompts.fewshot_block(*args, label, claim, prompts.EXEMPLAR_CHARS, answer)), chosen)
    query = prompts.fewshot_block(*args, label, claim, prompts.QUERY_CHARS)
    rows = builders.without_exemplars(items, chosen).join(F.broadcast(shots), "dataset", "left")  # one row per set
    return rows.select("inst_id", prompts.fewshot_prompt(F.col("shots"), query).alias("prompt"))


def native_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of the three graded judges in both frames."""
    args = [F.col(c) for c in ("question", "context", "candidate", "has_context")]
    return with_task(spark, d).select("inst_id", *[build(*args, claim).alias(f"{judge}_{frame}") for judge, build in prompts.NATIVE.items() for frame, claim in (("qa", False), ("claimcheck", True))])


def specialist_pair(spark: SparkSession, d: str) -> DataFrame:
    from quorate.functions.text import strip

    return _items(spark, d).select("inst_id", prompts.specialist_document(F.col("dataset"), F.col("question"), F.col("context")).alias("document"), strip(F.col("candidate")).alias("claim"))


def fit_prompt(spark: SparkSession, d: str) -> DataFrame:
    windows = [(r["judge"], r["window_tokens"]) for r in table(spark, d, "judge_windows").collect()]  # the fixed table of judges
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("judge"), F.lit(w).alias("window")) for j, w in windows])).alias("j")
    texts = spread(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text"))
    rows = texts.withColumn("words", prompts.words(F.col("text"))).select("*", each)  # words are found once, for all windows
    return rows.select("doc_id", "j.judge", F.md5(prompts.fit(F.col("text"), F.col("words"), F.col("j.window"), 16)).alias("fitted"))


def file_digests(spark: SparkSession, d: str) -> DataFrame:
    return release.file_digests(table(spark, d, "shard_lines"))


def release_digest(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "shard_lines")
    return release.release_digest(release.file_digests(lines), F.lpad(F.col("file_id").cast("string"), 12, "0"))


def lock_check(spark: SparkSession, d: str) -> DataFrame:
    """Each file of a stream against its predecessor: the lock has every file under the number of the next one.

    A stream's first file is unlocked, and what follows its last one is missing.
    """
    lines = table(spark, d, "shard_lines")
    names = lines.select("file_id", "stream", "file_seq").distinct()
    files = cut(release.file_digests(lines).join(names, "file_id").select("stream", "file_seq", "sha256"))
    of = lambda seq: files.select(F.concat("stream", F.lit("/"), seq.cast("string")).alias("path"), "sha256")
    return release.lock_check(of(F.col("file_seq") + 1), of(F.col("file_seq")))


def guard_decisions(spark: SparkSession, d: str) -> DataFrame:
    arms = guard.recorded_arms(table(spark, d, "shard_lines").select("stream", "file_id", "payload"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("panel", "judge", "ptjudge", "minicheck")]), (F.col("file_id") % 4 + 1).cast("int"))
    dataset = F.split("stream", "/")[0]
    expected = F.array(F.when(kind.isin(*guard.FRAME_KINDS), prompts.frame(dataset)).otherwise(prompts.condition(dataset)))
    return arms.select("file_id", "n_rows", F.array_join("recorded", ",").alias("recorded"), guard.relation(F.col("recorded"), expected).alias("relation"), guard.decide(F.col("recorded"), expected, kind, kind != "panel", F.col("file_id") % 7 == 0).alias("decision"))


def shard_schema(spark: SparkSession, d: str) -> DataFrame:
    return guard.shard_schema(table(spark, d, "shard_lines").select("stream", "file_id", "payload"))


def run_signature(spark: SparkSession, d: str) -> DataFrame:
    models = [r["model"] for r in table(spark, d, "panel_roster").orderBy("panel_idx").collect()]  # the fixed roster
    return release.run_signature(_items(spark, d), ["def_on brief_reason p0"], models, 4096)


def votes_export(spark: SparkSession, d: str) -> DataFrame:
    """The verdicts as they come back from a votes-only export."""
    path = f"{shared_folder(spark)}/votes-{uuid.uuid4().hex}"
    files.export_votes(table(spark, d, "experiment").select("rec_id", "dataset", "uid", "model", "condition", "pred", "raw"), path)
    return files.read_export(spark, path, "rec_id BIGINT, uid STRING, model STRING, condition STRING, pred INT, dataset STRING")


QUERIES = {
    f.__name__: f
    for f in (
        pair_rows, best_or_first, first_per_group_pairs, nested_facts, balanced_subsample, exemplar_exclusion, content_keys, index_manifest, join_drift, verdict_drift, keyed_verdicts,
        prompt_render_qa, prompt_render_claim, fewshot_block, fewshot_prompt, native_prompts, specialist_pair, fit_prompt, file_digests, release_digest, lock_check, guard_decisions, shard_schema, run_signature, votes_export,
    )
}

_BLANK = r"[\s\x{000b}\x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _sha(q: str = "question", c: str = "context", a: str = "candidate") -> str:
    return f"sha1(coalesce({q}, '') || chr(0) || coalesce(array_to_string(list_transform({c}, lambda x: coalesce(x, '') || chr(0)), ''), '') || chr(0) || coalesce({a}, ''))"


_POINT = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_FILLED = f"list_filter(list_transform(coalesce(context, []), lambda x: {_strip('x')}), lambda x: x IS NOT NULL AND x <> '')"
_ENTRIES = "len(coalesce(context, [])) > 0"
_TASK = "FROM instances JOIN task_specs USING (dataset)"
_ROWS = (
    "r AS (SELECT row_id AS pos, first(question ORDER BY inst_id) AS question, first(context ORDER BY inst_id) AS context, first(stratum ORDER BY inst_id) AS stratum, first(category ORDER BY inst_id) AS category, "
    "list_sort(coalesce(list(candidate) FILTER (WHERE kind = 'pos' AND candidate IS NOT NULL), [])) AS good, list_sort(coalesce(list(candidate) FILTER (WHERE kind = 'neg' AND candidate IS NOT NULL), [])) AS bad FROM instances WHERE dataset = '{}' AND row_id IS NOT NULL GROUP BY row_id)"
)


def _pairs(src: str, row: str, stratum: str, categories: tuple[str, str]) -> str:
    side = lambda kind, gold, cat, cand: f"SELECT {row} || ':{kind}' AS uid, {row}::BIGINT AS row_id, '{kind}' AS kind, {gold} AS gold, {stratum} AS stratum, {cat} AS category, {_sha('question', 'context', cand)} AS src_sha1 FROM {src}"
    return side("pos", 0, categories[0], "good") + " UNION ALL " + side("neg", 1, categories[1], "bad")


_DIGEST = (
    "h AS (SELECT file_id, line_no // 1000 AS chunk, line_no, coalesce(payload, '') AS p, sha256(line_no || ' ' || coalesce(payload, '') || chr(10)) AS d FROM {}), "
    "c AS (SELECT file_id, chunk, sha256(string_agg(d, chr(10) ORDER BY line_no, d)) AS d, sum(strlen(p) + 1)::BIGINT AS size, count(*) AS n FROM h GROUP BY ALL), "
    "b AS (SELECT file_id, chunk // 1000 AS block, sha256(string_agg(d, chr(10) ORDER BY chunk)) AS d, sum(size)::BIGINT AS size, sum(n)::BIGINT AS n FROM c GROUP BY ALL), "
    "f AS (SELECT file_id, sha256(string_agg(d, chr(10) ORDER BY block)) AS sha256, sum(size)::BIGINT AS bytes, sum(n)::BIGINT AS records FROM b GROUP BY file_id)"
)
_FIELDS = ("row_id", "kind", "gold", "stratum", "category", "src_sha1")


def _tree(scope: str) -> str:
    """Digest of the lines ``x.line`` of each scope, by way of their digests' first six and three digits."""
    whole = "sha256(string_agg(line, chr(10) ORDER BY line))"
    return (
        f"y AS (SELECT {scope}, line || ' x' || count(*) AS line FROM x GROUP BY {scope}, line), "
        f"t6 AS (SELECT {scope}, substr(sha256(line), 1, 6) AS b, substr(sha256(line), 1, 6) || {whole} AS line FROM y GROUP BY {scope}, substr(sha256(line), 1, 6)), "
        f"t3 AS (SELECT {scope}, substr(b, 1, 3) AS b, substr(b, 1, 3) || {whole} AS line FROM t6 GROUP BY {scope}, substr(b, 1, 3)), t0 AS (SELECT {scope}, {whole} AS digest FROM t3 GROUP BY {scope})"
    )


def _drift(index: str, fields: tuple[str, ...]) -> str:
    mins = ", ".join(f"min({f}) AS {f}" for f in fields)
    checks = " UNION ALL ".join([
        "SELECT 'only_in_rebuild' AS \"check\", count(*) AS n FROM j WHERE iu IS NULL", "SELECT 'only_in_index', count(*) FROM j WHERE bu IS NULL",
        *[f"SELECT '{f}', count(*) FROM j WHERE iu IS NOT NULL AND bu IS NOT NULL AND b_{f} IS DISTINCT FROM i_{f}" for f in fields],
    ])
    sides = ", ".join(f"b.{f} AS b_{f}, i.{f} AS i_{f}" for f in fields)
    return f"WITH x AS (SELECT *, {_sha()} AS src_sha1 FROM instances WHERE dataset = 'aggrefact_cnn'), b AS (SELECT uid, {mins} FROM x GROUP BY uid), i AS (SELECT uid, {mins} FROM {index} GROUP BY uid), j AS (SELECT b.uid AS bu, i.uid AS iu, {sides} FROM b FULL JOIN i ON b.uid = i.uid) {checks}"


_COND = "CASE WHEN starts_with(dataset, 'aggrefact_') THEN 'claimcheck' ELSE 'def_on' END"
_LABEL = "coalesce(" + ", ".join(f"json_extract_string(payload, '$.{n}')" for n in ("condition", "cond", "Condition", "frame")) + ")"

SQL = {
    "pair_rows": f"WITH {_ROWS.format('medhallu')}, p AS (SELECT pos, question, context, stratum, category, good[1] AS good, bad[1] AS bad FROM r WHERE len(good) > 0 AND len(bad) > 0) " + _pairs("p", "pos", "stratum", ("category", "category")),
    "best_or_first": f"WITH {_ROWS.format('truthfulqa')}, p AS (SELECT pos, question, [] AS context, stratum, category, coalesce(CASE WHEN pos % 2 = 0 THEN nullif(good[-1], '') END, list_filter(good, lambda x: x <> '')[1]) AS good, list_filter(bad, lambda x: x <> '')[1] AS bad FROM r), "
    "q AS (SELECT * FROM p WHERE good IS NOT NULL AND bad IS NOT NULL) " + _pairs("q", "pos", "stratum", ("category", "category")),
    "first_per_group_pairs": f"WITH x AS (SELECT inst_id AS pos, {_strip('question')} AS question, context, coalesce(candidate, '') AS output, coalesce(gold = 1, false) AS faulty FROM instances WHERE dataset = 'ragtruth'), "
    "y AS (SELECT *, first(context) OVER w AS kept, min(pos) OVER (PARTITION BY question) AS fp FROM x WHERE question <> '' WINDOW w AS (PARTITION BY question ORDER BY pos)), "
    "z AS (SELECT question, any_value(kept) AS context, min(fp) AS fp, first(output ORDER BY pos) FILTER (WHERE NOT faulty) AS good, first(output ORDER BY pos) FILTER (WHERE faulty) AS bad FROM y WHERE context IS NOT DISTINCT FROM kept GROUP BY question), "
    f"p AS (SELECT *, row_number() OVER (ORDER BY fp) - 1 AS i FROM z WHERE good <> '' AND bad <> '' AND {_ENTRIES}) " + _pairs("p", "i", "'ragtruth_qa'", ("'faithful'", "'hallucinated'")),
    "nested_facts": "WITH x AS (SELECT row_id AS pos, first(question ORDER BY inst_id) OVER (PARTITION BY row_id) AS topic, inst_id, gold, candidate, inst_id % 11 <> 0 AS rel FROM instances WHERE dataset = 'factscore' AND row_id IS NOT NULL WINDOW w AS (PARTITION BY row_id)), "
    "z AS (SELECT pos, coalesce(any_value(topic), 'person_' || pos) AS topic, first(candidate ORDER BY inst_id) FILTER (WHERE gold = 0) AS good, first(candidate ORDER BY inst_id) FILTER (WHERE gold = 1) AS bad FROM x WHERE rel AND candidate <> '' GROUP BY pos), "
    "p AS (SELECT pos, 'Is the following biographical claim about ' || topic || ' factually correct?' AS question, []::VARCHAR[] AS context, good, bad FROM z WHERE good IS NOT NULL AND bad IS NOT NULL) " + _pairs("p", "pos", "'factscore_bio'", ("'supported'", "'not_supported'")),
    "balanced_subsample": "WITH x AS (SELECT inst_id AS pos, coalesce(array_to_string(context, ' '), '') AS doc, candidate AS claim, gold, " + _POINT.format("'0|' || inst_id") + " AS draw FROM instances WHERE dataset = 'aggrefact_expertqa' AND gold IS NOT NULL AND candidate <> ''), "
    "y AS (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY draw, pos) - 1 AS nth FROM x), n AS (SELECT CASE WHEN count(*) = 2 THEN min(c) ELSE 0 END AS n FROM (SELECT count(*) AS c FROM x GROUP BY gold)), "
    "z AS (SELECT *, row_number() OVER (ORDER BY draw, pos) - 1 AS i FROM y, n WHERE nth < n), w AS (SELECT *, min(i) OVER (PARTITION BY doc) AS fi FROM z), v AS (SELECT *, dense_rank() OVER (ORDER BY fi) - 1 AS row_id FROM w) "
    f"SELECT i || ':' || CASE gold WHEN 1 THEN 'neg' ELSE 'pos' END AS uid, row_id, CASE gold WHEN 1 THEN 'neg' ELSE 'pos' END AS kind, gold, 'aggrefact-expertqa' AS stratum, CASE gold WHEN 0 THEN 'supported' ELSE 'not_supported' END AS category, {_sha('claim', '[doc]', 'claim')} AS src_sha1 FROM v",
    "exemplar_exclusion": "WITH e AS (SELECT dataset, row_id FROM instances WHERE gold IN (0, 1) QUALIFY row_number() OVER (PARTITION BY dataset, gold ORDER BY " + _POINT.format("'0|' || dataset || '|' || uid") + ", uid) <= 3) "
    "SELECT dataset, uid FROM instances i WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.dataset = i.dataset AND e.row_id = i.row_id)",
    "content_keys": f"SELECT inst_id, {_sha()} AS src_sha1 FROM instances",
    "index_manifest": f"WITH x AS (SELECT dataset, row_id, gold, {_sha()} AS k FROM instances), d AS (SELECT dataset, count(*) AS dk FROM (SELECT dataset, k FROM x GROUP BY ALL HAVING count(*) > 1) GROUP BY dataset) "
    "SELECT dataset, count(*) AS n, count(DISTINCT row_id) AS n_clusters, count(*) FILTER (WHERE gold = 0) AS gold0, count(*) FILTER (WHERE gold = 1) AS gold1, count(DISTINCT k) AS distinct_keys, coalesce(any_value(dk), 0) AS duplicate_keys FROM x LEFT JOIN d USING (dataset) GROUP BY dataset",
    "join_drift": _drift("aggrefact_cnn", _FIELDS),
    "verdict_drift": _drift("(SELECT * FROM experiment WHERE dataset = 'aggrefact_cnn')", _FIELDS[:4]),
    "keyed_verdicts": f"WITH i AS (SELECT dataset, uid, {_sha()} AS k FROM instances) SELECT dataset, count(*) AS n_keyed, count(*) FILTER (WHERE lower(src_key) = k) AS n_same, count(*) FILTER (WHERE k IS NULL) AS n_missing FROM experiment LEFT JOIN i USING (dataset, uid) WHERE src_key IS NOT NULL GROUP BY dataset",
    "prompt_render_qa": "SELECT inst_id, 'You assess a candidate answer to ' || subject_phrase || '. You see the question' || CASE WHEN has_context THEN ', the evidence' ELSE '' END || ' and one candidate answer.' "
    f"|| '\n\nDefinition. {prompts.DEFINITION}\n\n{prompts.ASK}\n\n{prompts.REASON}\nVERDICT: <{prompts.OPTIONS}>\n\n# Question\n' || {_strip('question')} || '\n' "
    f"|| CASE WHEN has_context AND {_ENTRIES} THEN '\n# ' || coalesce(context_label, '') || '\n' || array_to_string(list_transform({_FILLED}, lambda x: '- ' || x), '\n') || '\n' ELSE '' END || '\n# Candidate answer\n' || {_strip('candidate')} || '\n' AS prompt {_TASK}",
    "prompt_render_claim": f"WITH x AS (SELECT inst_id, {_strip('candidate')} AS claim, list_concat(CASE WHEN {_strip('question')} <> '' AND {_strip('question')} <> {_strip('candidate')} THEN ['Question under discussion: ' || {_strip('question')}] ELSE [] END, CASE WHEN has_context THEN {_FILLED} ELSE [] END) AS parts {_TASK}) "
    f"SELECT inst_id, '{prompts.CLAIM_INTRO}\n\n{prompts.REASON}\nVERDICT: <{prompts.OPTIONS}>\n\n# Document\n' || CASE WHEN len(parts) > 0 THEN array_to_string(parts, '\n') ELSE '{prompts.NO_DOCUMENT}' END || '\n\n# Claim\n' || claim || '\n' AS prompt FROM x",
    "fewshot_block": f"WITH x AS (SELECT *, array_to_string({_FILLED}, '\n') AS body, has_context AND {_ENTRIES} AS shown, question <> '' AND NOT (starts_with(dataset, 'aggrefact_') AND {_strip('question')} = {_strip('candidate')}) AS asked {_TASK}), "
    "y AS (SELECT inst_id, gold, CASE WHEN asked THEN 'Question: ' || question || '\n' ELSE '' END || 'Claim: ' || candidate || '\nAnswer:' AS rest, "
    + ", ".join(f"CASE WHEN shown THEN coalesce(context_label, '') || ': ' || CASE WHEN length(body) > {n} THEN left(body, {n}) || ' ...' ELSE body END || '\n' ELSE '' END AS b{n}" for n in (prompts.EXEMPLAR_CHARS, prompts.QUERY_CHARS))
    + f" FROM x) SELECT inst_id, b{prompts.EXEMPLAR_CHARS} || rest || ' ' || CASE WHEN gold = 0 THEN 'Yes' ELSE 'No' END AS exemplar, b{prompts.QUERY_CHARS} || rest AS query FROM y",
    "specialist_pair": f"SELECT inst_id, CASE WHEN dataset IN ('medhallu', 'ragtruth') THEN {_strip('question')} || '\n\n' ELSE '' END || array_to_string({_FILLED}, '\n') AS document, {_strip('candidate')} AS claim FROM instances",
    "fit_prompt": rf"WITH x AS (SELECT doc_id, judge, text, string_split_regex({_strip('text')}, '\s+') AS w, window_tokens - 16 - {prompts.MARGIN} AS b FROM documents, judge_windows WHERE text IS NOT NULL) "
    f"SELECT doc_id, judge, md5(CASE WHEN b > 0 AND len(w) > b THEN array_to_string(w[1:b // 2], ' ') || '{prompts.CUT_NOTE}' || array_to_string(w[len(w) - (b - b // 2) + 1:], ' ') ELSE text END) AS fitted FROM x",
    "file_digests": "WITH " + _DIGEST.format("shard_lines") + " SELECT * FROM f",
    "release_digest": "WITH " + _DIGEST.format("shard_lines") + ", x AS (SELECT 1 AS g, records, lpad(file_id::VARCHAR, 12, '0') || ' ' || sha256 AS line FROM f), " + _tree("g") + " SELECT (SELECT count(*) FROM f) AS n_files, (SELECT sum(records)::BIGINT FROM f) AS records, digest FROM t0",
    "lock_check": "WITH " + _DIGEST.format("shard_lines") + ", n AS (SELECT DISTINCT file_id, stream, file_seq FROM shard_lines), s AS (SELECT stream, file_seq, sha256 FROM f JOIN n USING (file_id)), "
    "l AS (SELECT stream || '/' || (file_seq + 1) AS path, sha256 FROM s), p AS (SELECT stream || '/' || file_seq AS path, sha256 FROM s), "
    "j AS (SELECT coalesce(l.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'missing' WHEN l.path IS NULL THEN 'unlocked' WHEN l.sha256 <> p.sha256 THEN 'changed' END AS state FROM l FULL JOIN p ON l.path = p.path) SELECT * FROM j WHERE state IS NOT NULL",
    "guard_decisions": f"WITH x AS (SELECT file_id, split_part(stream, '/', 1) AS dataset, ['panel', 'judge', 'ptjudge', 'minicheck'][file_id % 4 + 1] AS kind, {_LABEL} AS label FROM shard_lines WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'), "
    f"g AS (SELECT file_id, count(*) AS n_rows, list_sort(coalesce(list(DISTINCT label) FILTER (WHERE label IS NOT NULL), [])) AS rec, any_value(kind) AS kind, any_value(CASE WHEN kind IN ('ptjudge', 'minicheck') THEN CASE WHEN starts_with(dataset, 'aggrefact_') THEN 'claimcheck' ELSE 'qa' END ELSE {_COND} END) AS want FROM x GROUP BY file_id), "
    "h AS (SELECT *, len(rec) = 0 AND (kind = 'minicheck' OR (kind = 'ptjudge' AND want = 'qa')) AS vintage FROM g) "
    "SELECT file_id, n_rows, array_to_string(rec, ',') AS recorded, CASE WHEN len(rec) = 0 THEN 'none' WHEN rec = [want] THEN 'same' WHEN list_contains(rec, want) THEN 'wider' ELSE 'other' END AS relation, "
    "CASE WHEN len(rec) = 0 AND NOT vintage AND kind = 'panel' THEN 'run' WHEN NOT vintage AND rec <> [want] THEN 'refuse' WHEN kind <> 'panel' AND file_id % 7 <> 0 THEN 'skip' ELSE 'run' END AS decision FROM h",
    "run_signature": f"WITH x AS (SELECT dataset, uid || ' ' || {_sha()} AS line FROM instances), {_tree('dataset')} "
    "SELECT dataset, sha256('def_on brief_reason p0|' || (SELECT string_agg(model, '|' ORDER BY panel_idx) FROM panel_roster) || '|4096' || chr(10) || digest) AS signature FROM t0",
    "shard_schema": "WITH x AS (SELECT stream, file_id, json_extract(payload, '$.src_key') IS NOT NULL AS has FROM shard_lines WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'), "
    "f AS (SELECT stream, file_id, count(*) AS n_rows, count(*) FILTER (WHERE has) AS n_with FROM x GROUP BY ALL), s AS (SELECT stream, sum(n_with) IN (0, sum(n_rows)) AS stream_pure FROM f GROUP BY stream) "
    "SELECT stream, file_id, n_rows, n_with, CASE WHEN n_with = n_rows THEN 'with' WHEN n_with = 0 THEN 'without' ELSE 'mixed' END AS state, stream_pure FROM f JOIN s USING (stream)",
    "votes_export": "SELECT rec_id, uid, model, condition, pred, dataset FROM experiment",
}
