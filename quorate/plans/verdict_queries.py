"""Queries on verdicts, judges and committees, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions import parsers
from quorate.operators import bootstrap, committee, compare, cost, scorer, verdicts
from quorate.plans.lineage import spread
from quorate.sources.tables import table


def _exp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "experiment")


def _roster(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "panel_roster")


def coverage_by_model(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.coverage(_exp(spark, d))


def coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.coverage_rollup(_exp(spark, d))


def panel_completeness(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.panel_completeness(_exp(spark, d), _roster(spark, d), 0.93)


def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.judge_scores(_exp(spark, d))


def member_gate(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.member_gate(_exp(spark, d), 0.92)


def panel_decide_tau(spark: SparkSession, d: str) -> DataFrame:
    return committee.panel_decide(_exp(spark, d), _roster(spark, d))


def selective_curve(spark: SparkSession, d: str) -> DataFrame:
    return committee.panel_scores(_exp(spark, d), _roster(spark, d))


def committee_frontier(spark: SparkSession, d: str) -> DataFrame:
    return committee.frontier(_exp(spark, d), _roster(spark, d))


def committee_frontier_k3(spark: SparkSession, d: str) -> DataFrame:
    names = committee.members(_roster(spark, d))
    rows = committee.frontier(_exp(spark, d), _roster(spark, d), only=[3])
    return rows.withColumn("members", committee.member_names(names, F.col("mask"))).drop("mask")


def frontier_by_k(spark: SparkSession, d: str) -> DataFrame:
    return committee.frontier_by_k(_exp(spark, d), _roster(spark, d))


def fleiss_kappa(spark: SparkSession, d: str) -> DataFrame:
    return committee.committee_agreement(_exp(spark, d), _roster(spark, d))


def probe_by_condition(spark: SparkSession, d: str) -> DataFrame:
    return committee.agreement(_exp(spark, d), _roster(spark, d))


def bootstrap_draws(spark: SparkSession, d: str) -> DataFrame:
    return bootstrap.draws(bootstrap.ranked_clusters(bootstrap.cluster_counts(_exp(spark, d))))


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return bootstrap.bootstrap(_exp(spark, d))


def run_compare(spark: SparkSession, d: str) -> DataFrame:
    e = _exp(spark, d)
    return compare.run_compare(e.where("condition = 'def_on'"), e.where("condition = 'claimcheck'"))


def parse_verdict(spark: SparkSession, d: str) -> DataFrame:
    return spread(_exp(spark, d).select("rec_id", "raw")).select("rec_id", parsers.parse_verdict(F.col("raw")).alias("label"))


def parse_agreement(spark: SparkSession, d: str) -> DataFrame:
    label = parsers.parse_verdict(F.col("raw"))
    rows = _exp(spark, d).select("model", "pred", label.alias("label"))
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("pred").eqNullSafe(F.col("label"))).alias("n_same"), F.count("label").alias("n_label"), F.count("pred").alias("n_pred"))


def _native(spark: SparkSession, d: str, judge: str) -> DataFrame:
    """Texts in a graded judge's own format, made from the panel's texts."""
    raw, n5, n10, r = F.coalesce("raw", F.lit("")), (1 + F.col("rec_id") * 7 % 5).cast("string"), (1 + F.col("rec_id") % 10).cast("string"), F.col("rec_id") % 7
    forms = {
        "prometheus2": [F.concat(raw, F.lit(" [RESULT] "), n5), F.concat(raw, F.lit("\n[RESULT] **"), n5, F.lit("**")), F.concat(F.lit("It gets "), n5, F.lit("/5. "), raw), F.concat(raw, F.lit(" That makes "), n5, F.lit(" out of 5")), F.concat(F.lit("[RESULT] 1 "), raw, F.lit(" [RESULT] "), n5), F.lit(""), raw],
        "judgelm": [F.concat(n10, F.lit("\n"), raw), F.concat(F.lit(" Score: "), n10, F.lit(" "), raw), F.concat(F.lit("Seen. "), raw, F.lit("\nScore: "), n10), F.concat(F.lit("Well. "), raw, F.lit(" I rate it a "), n10, F.lit(" overall")), F.concat(F.lit("So. "), raw, F.lit(" It gets "), n10, F.lit(" out of 10.")), F.concat(F.lit("A score of 3 first, then "), n10, F.lit("/10 in the end")), F.concat(F.lit("45 "), raw)],
        "autoj": [F.concat(raw, F.lit(" Rating: [["), n10, F.lit("]]")), F.concat(F.lit("[[3]] "), raw, F.lit(" [[ "), n10, F.lit(".5 ]]")), F.concat(raw, F.lit("[[11]]")), F.concat(F.lit("[["), n10, F.lit("]] "), raw), raw, F.lit(""), F.concat(F.lit("[["), n10, F.lit("]")),],
    }[judge]
    text = F.when(r == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        text = text.when(r == i, form)
    return spread(_exp(spark, d).select("rec_id", text.alias("text")))


def _graded(spark: SparkSession, d: str, judge: str, parse) -> DataFrame:
    rows = _native(spark, d, judge).select("rec_id", parse(F.col("text")).alias("score"))
    return rows.select("rec_id", "score", parsers.graded_label(F.col("score"), parsers.THRESHOLDS[judge]).alias("label"))


def graded_parse_prometheus(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d, "prometheus2", parsers.parse_result)


def graded_parse_judgelm(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d, "judgelm", parsers.parse_score)


def graded_parse_autoj(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d, "autoj", parsers.parse_rating)


#: Pieces of a vocabulary that read as the two answers, each with its share of the answer's probability.
_PIECES = (("▁Yes", 1, 0.75), ("yes", 1, 0.25), ("Ġno", 0, 0.6), ("No", 0, 0.3), ("Maybe", 0, 0.1))
#: Price list per million tokens in and out, by prefix of a model's name.
RATES = {"kettle/": (0.2, 0.6), "kettle/steam-12b": (0.5, 1.5), "lumen-lab/": (0.3, 0.9), "halden/rook": (0.15, 0.45), "northfen/tern-8b": (0.25, 0.75)}


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """First-token candidates of each recorded line with a probability of Yes, with the log-probabilities that it gives them."""
    from quorate.operators.drift import json_objects

    lines = json_objects(table(spark, d, "shard_lines").select("file_id", "line_no", "payload"))
    p = F.try_variant_get("object", "$.prob_yes", "double")
    told = spread(lines.select(F.concat_ws(":", "file_id", "line_no").alias("line"), p.alias("p")).where("p > 0 AND p < 1").distinct())
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("piece"), F.log((F.col("p") if yes else 1 - F.col("p")) * F.lit(share)).alias("logprob")) for w, yes, share in _PIECES])).alias("c")
    return told.select("line", each).select("line", "c.*")


def constrained_choice(spark: SparkSession, d: str) -> DataFrame:
    return scorer.by_mass(_candidates(spark, d), "line").withColumn("label", parsers.choice_label(F.col("choice")))


def best_choice(spark: SparkSession, d: str) -> DataFrame:
    return scorer.by_best(_candidates(spark, d), "line")


def marked_choice(spark: SparkSession, d: str) -> DataFrame:
    return scorer.by_best(_candidates(spark, d), "line", marked=False)


def word_pieces(spark: SparkSession, d: str) -> DataFrame:
    """A vocabulary (piece, id): the words of all texts, each also with the marks of two tokenizers."""
    pieces = _exp(spark, d).select(F.explode(F.split("raw", r"[ \n]")).alias("w")).where("w <> ''").distinct()
    marked = pieces.select(F.explode(F.array(F.col("w"), F.concat(F.lit("▁"), "w"), F.concat(F.lit("Ġ"), "w"))).alias("piece"))
    return marked.select("piece", F.md5("piece").alias("id"))


def choice_tokens(spark: SparkSession, d: str) -> DataFrame:
    return scorer.choice_ids(word_pieces(spark, d), ("Supported", "HALLUCINATED"))


def usage_cost(spark: SparkSession, d: str) -> DataFrame:
    w = cost.words
    items = table(spark, d, "instances").select("dataset", "uid", (w(F.col("question")) + w(F.col("candidate")) + w(F.array_join(F.coalesce("context", F.array().cast("array<string>")), " "))).alias("tokens_in"))
    calls = _exp(spark, d).select("dataset", "uid", "model", w(F.col("raw")).alias("tokens_out")).join(items, ["dataset", "uid"])
    return cost.usage(calls, RATES)


def harmonic_throughput(spark: SparkSession, d: str) -> DataFrame:
    from quorate.operators.drift import json_objects

    lines = json_objects(table(spark, d, "shard_lines").select("payload"))
    timed = lines.select(F.try_variant_get("object", "$.model", "string").alias("model"), F.try_variant_get("object", "$.wall_seconds", "double").alias("seconds"))
    return cost.throughput(timed.where("model IS NOT NULL"))


QUERIES = {
    f.__name__: f
    for f in (
        coverage_by_model, coverage_rollup, panel_completeness, judge_scores, member_gate, panel_decide_tau, selective_curve, committee_frontier, committee_frontier_k3,
        frontier_by_k, fleiss_kappa, probe_by_condition, bootstrap_draws, bootstrap_ci, run_compare, parse_verdict, parse_agreement, graded_parse_prometheus, graded_parse_judgelm,
        graded_parse_autoj, constrained_choice, best_choice, marked_choice, choice_tokens, usage_cost, harmonic_throughput,
    )
}

# SQL.  Every statement starts from the tables and repeats no part of the engine.

_FIRST = "SELECT dataset, uid, model, condition, fmt, paraphrase, pred, gold, row_id FROM experiment QUALIFY row_number() OVER (PARTITION BY dataset, uid, model, condition, fmt, paraphrase ORDER BY rec_id) = 1"


def _cells(pred: str = "pred", gold: str = "gold", weight: str = "1") -> str:
    tests = {"tp": f"{gold} = 1 AND {pred} = 1", "fn": f"{gold} = 1 AND {pred} = 0", "fp": f"{gold} = 0 AND {pred} = 1", "tn": f"{gold} = 0 AND {pred} = 0", "a1": f"{gold} = 1 AND {pred} IS NULL", "a0": f"{gold} = 0 AND {pred} IS NULL"}
    return ", ".join(f"coalesce(sum(CASE WHEN {t} THEN {weight} END), 0)::BIGINT AS {k}" for k, t in tests.items())


_TWO = "tp + fn > 0 AND fp + tn > 0"
_KAPPA = f"CASE WHEN {_TWO} THEN 2 * (tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif((tp + fp)::DOUBLE * (fp + tn) + (tp + fn)::DOUBLE * (fn + tn), 0) END"
_BAL = f"CASE WHEN {_TWO} THEN (tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2 END"
_ERR = "CASE WHEN tp + fn + a1 > 0 AND tn + fp + a0 > 0 THEN (tp::DOUBLE / (tp + fn + a1) + tn::DOUBLE / (tn + fp + a0)) / 2 WHEN tp + fn + a1 > 0 THEN tp::DOUBLE / (tp + fn + a1) WHEN tn + fp + a0 > 0 THEN tn::DOUBLE / (tn + fp + a0) END"
_F1 = f"CASE WHEN {_TWO} THEN (2 * tp::DOUBLE / (2 * tp + fp + fn) + 2 * tn::DOUBLE / (2 * tn + fp + fn)) / 2 END"
_COV = "(tp + fn + fp + tn)::DOUBLE / nullif(tp + fn + fp + tn + a1 + a0, 0)"
_SCORES = f"tp + fn + fp + tn + a1 + a0 AS n, {_COV} AS coverage, {_KAPPA} AS kappa, {_BAL} AS bal_acc_committed, {_ERR} AS bal_acc_nonanswer_error, {_F1} AS macro_f1"
_CELL_NAMES = "tp, fn, fp, tn, a1, a0"
_MEMBERS = "m AS (SELECT model, (row_number() OVER (ORDER BY model) - 1)::INTEGER AS i FROM (SELECT DISTINCT model FROM panel_roster))"
_VOTES = (
    f"f AS ({_FIRST}), {_MEMBERS}, "
    "v AS (SELECT dataset, condition, uid, max(gold) AS gold, coalesce(bit_or(CASE WHEN pred IS NOT NULL THEN 1 << i END), 0)::INTEGER AS voted, "
    "coalesce(bit_or(CASE WHEN pred = 1 THEN 1 << i END), 0)::INTEGER AS ones FROM f JOIN m USING (model) GROUP BY ALL)"
)
_TAUS = "(SELECT unnest([0.5, 0.6, 0.7, 0.8, 1.0])::DOUBLE AS tau)"
_MAIN = "c AS (SELECT dataset, coalesce(min(CASE WHEN condition = 'def_on' THEN condition END), min(condition)) AS condition FROM experiment GROUP BY dataset)"


def _decide(ones: str, voted: str) -> str:
    p = f"({ones}::DOUBLE / nullif({voted}, 0))"
    return f"CASE WHEN {voted} > 0 AND greatest({p}, 1 - {p}) >= tau THEN (CASE WHEN {ones} * 2 >= {voted} THEN 1 ELSE 0 END) END"


def _frontier(sizes: str) -> str:
    return (
        f"WITH {_VOTES}, {_MAIN}, p AS (SELECT dataset, voted, ones, gold, count(*) AS w FROM v JOIN c USING (dataset, condition) GROUP BY ALL), "
        f"k AS (SELECT range::INTEGER AS mask FROM range(1, (1 << (SELECT count(*) FROM m))::BIGINT) WHERE bit_count(range) IN ({sizes})), "
        "s AS (SELECT dataset, mask, bit_count(voted & mask) AS vv, bit_count(ones & mask) AS k1, gold, sum(w) AS w FROM p, k GROUP BY ALL), "
        f"r AS (SELECT *, {_decide('k1', 'vv')} AS d FROM s, {_TAUS}), "
        f"t AS (SELECT dataset, mask, tau, {_cells('d', 'gold', 'w')}, sum(w)::BIGINT AS items FROM r GROUP BY ALL), "
        f"front AS (SELECT dataset, mask, bit_count(mask)::INTEGER AS k, tau, (bit_count(mask) * items)::BIGINT AS cost, {_SCORES} FROM t) "
    )


_ODD = "SELECT unnest([1, 3, 5, 7, 9, 11, 12])"
_POINT = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_CLUSTERS = (
    f"f AS ({_FIRST}), k AS (SELECT dataset, condition, model, row_id, {_cells()} FROM f WHERE gold IS NOT NULL AND row_id IS NOT NULL GROUP BY ALL), "
    "q AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY row_id) - 1 AS rank, count(*) OVER (PARTITION BY dataset) AS size FROM (SELECT DISTINCT dataset, row_id FROM k)), "
    "w AS (SELECT dataset, draw, rank, count(*) AS weight FROM (SELECT dataset, draw::INTEGER AS draw, "
    + _POINT.format("'0|' || dataset || '|' || draw || '|' || q.rank")
    + " % size AS rank FROM q, range({draws}) AS b(draw)) GROUP BY ALL)"
)
_RAW, _N5, _N10 = "coalesce(raw, '')", "(1 + rec_id * 7 % 5)", "(1 + rec_id % 10)"


def _forms(*forms: str) -> str:
    return "SELECT rec_id, CASE rec_id % 7 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END AS text FROM experiment"


_NUM = r"(10(?:\.0+)?|[1-9](?:\.\d+)?)"
_AFTER = r"(?:[^\d.]|\.\D|\.$|$)"
_CTX = [rf"(?is)^(.*\bscores?\s+(?:of|is|was|would\s+be|:|=)\s*){_NUM}{_AFTER}()", rf"(?is)^(.*\brat(?:e|ed|ing)\s+(?:it\s+)?(?:a\s+|as\s+|of\s+)?){_NUM}{_AFTER}()", rf"(?is)^(.*(?:^|[^\d.])){_NUM}(\s*(?:/|out\s+of)\s*10\b)"]
_NAMED = ", ".join("{'e': " + " + ".join(f"length(regexp_extract(text, '{p}', {g}))" for g in (1, 2, 3)) + f", 'v': try_cast(regexp_extract(text, '{p}', 2) AS DOUBLE)}}" for p in _CTX)
_CAND = (
    "l AS (SELECT DISTINCT file_id || ':' || line_no AS line, try_cast(json_extract_string(payload, '$.prob_yes') AS DOUBLE) AS p FROM shard_lines WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'), "
    "c AS (SELECT line, w.piece, ln((CASE WHEN w.yes = 1 THEN p ELSE 1 - p END) * w.share) AS lp FROM l, (VALUES " + ", ".join(f"('{w}', {y}, {s}::DOUBLE)" for w, y, s in _PIECES) + ") AS w(piece, yes, share) WHERE p > 0 AND p < 1), "
    r"p AS (SELECT line, lp, lower(regexp_replace(translate(piece, '▁ĠĊ', '   '), '^\s+|\s+$', '', 'g')) AS word, lower(regexp_replace(piece, '^\s+|\s+$', '', 'g')) AS bare FROM c)"
)


def _best(word: str) -> str:
    return (
        f"WITH {_CAND}, b AS (SELECT line, max(CASE WHEN {word} = 'yes' THEN lp END) AS y, max(CASE WHEN {word} = 'no' THEN lp END) AS n FROM p GROUP BY line), "
        "q AS (SELECT line, CASE WHEN y IS NULL AND n IS NULL THEN NULL WHEN n IS NULL THEN 1.0 WHEN y IS NULL THEN 0.0 ELSE round(exp(y - greatest(y, n)) / (exp(y - greatest(y, n)) + exp(n - greatest(y, n))), 9) END::DOUBLE AS p_yes FROM b) "
        "SELECT line, p_yes, CASE WHEN p_yes >= 0.5 THEN 1 WHEN p_yes < 0.5 THEN 0 END AS choice FROM q"
    )


_BLANK = r"[\s\x{000b}\x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_VERDICT = r"(?i)verdict\s*[:\-]?\s*\**\s*(hallucinat\w*|support\w*|not\s*sure|unsure)".replace(r"\s", _BLANK)
_LABEL = (
    f"(CASE WHEN raw IS NULL OR raw = '' THEN NULL WHEN lower(regexp_extract_all(raw, '{_VERDICT}', 1)[-1]) LIKE 'hallucinat%' THEN 1 WHEN lower(regexp_extract_all(raw, '{_VERDICT}', 1)[-1]) LIKE 'support%' THEN 0 "
    f"WHEN len(regexp_extract_all(raw, '{_VERDICT}', 1)) > 0 THEN NULL WHEN contains(lower(right(raw, 200)), 'hallucinat') THEN 1 WHEN contains(lower(right(raw, 200)), 'support') THEN 0 END)"
)


def _words(x: str) -> str:
    return rf"len(list_filter(string_split_regex(coalesce({x}, ''), '\s+'), lambda w: w <> ''))"


def _rate(which: int) -> str:
    cases = " ".join(f"WHEN starts_with(model, '{p}') THEN {RATES[p][which]}" for p in sorted(RATES, key=len, reverse=True))
    return f"(CASE {cases} END)::DOUBLE"


SQL = {
    "coverage_by_model": "SELECT dataset, model, condition, count(*) AS n_rows, count(DISTINCT uid) AS n_uids, count(pred) AS n_pred, count(pred)::DOUBLE / count(*) AS coverage, (count(pred)::DOUBLE / count(*) < 0.999)::INTEGER AS is_low FROM experiment GROUP BY ALL",
    "coverage_rollup": "SELECT dataset, model, grouping(dataset, model)::INTEGER AS level, count(*) AS n_rows, count(pred) AS n_pred, count(pred)::DOUBLE / count(*) AS coverage FROM experiment GROUP BY GROUPING SETS ((dataset, model), (dataset), ())",
    "panel_completeness": "WITH r AS (SELECT DISTINCT model FROM panel_roster), g AS (SELECT dataset, model, (count(pred)::DOUBLE / count(*) < 0.93)::INTEGER AS low FROM experiment JOIN r USING (model) GROUP BY dataset, model) "
    "SELECT dataset, count(*) AS n_models, (SELECT count(*) FROM r) AS n_expected, sum(low)::BIGINT AS n_low, (count(*) = (SELECT count(*) FROM r))::INTEGER AS is_complete FROM g GROUP BY dataset",
    "judge_scores": f"WITH f AS ({_FIRST}), t AS (SELECT dataset, condition, model, {_cells()} FROM f GROUP BY ALL) SELECT dataset, condition, model, {_CELL_NAMES}, {_SCORES} FROM t",
    "member_gate": "WITH e AS (SELECT *, CASE WHEN starts_with(dataset, 'aggrefact_') THEN 'claimcheck' ELSE 'def_on' END AS want FROM experiment), "
    "o AS (SELECT dataset, model, max((condition <> want)::INTEGER) AS other FROM e GROUP BY ALL), p AS (SELECT dataset, model, count(*) AS n_rows, count(DISTINCT uid) AS n_uids, count(pred) AS n_pred FROM e WHERE condition = want GROUP BY ALL), "
    "a AS (SELECT dataset, count(DISTINCT uid) AS n_all FROM e WHERE condition = want GROUP BY ALL) "
    "SELECT dataset, model, n_rows, n_uids, n_pred, n_pred::DOUBLE / n_rows AS coverage, CASE WHEN other = 1 THEN 'other condition' WHEN n_uids < n_rows THEN 'repeated items' WHEN n_pred::DOUBLE / n_rows < 0.92 THEN 'low coverage' WHEN n_uids < n_all THEN 'missing items' ELSE 'ok' END AS gate "
    "FROM p JOIN o USING (dataset, model) JOIN a USING (dataset)",
    "panel_decide_tau": f"WITH {_VOTES}, x AS (SELECT dataset, condition, uid, bit_count(voted)::INTEGER AS n_votes, bit_count(ones)::INTEGER AS n_ones, tau FROM v, {_TAUS}) SELECT *, {_decide('n_ones', 'n_votes')} AS decision FROM x",
    "selective_curve": f"WITH {_VOTES}, x AS (SELECT dataset, condition, gold, tau, {_decide('bit_count(ones)', 'bit_count(voted)')} AS d FROM v, {_TAUS}), t AS (SELECT dataset, condition, tau, {_cells('d')} FROM x GROUP BY ALL) SELECT dataset, condition, tau, {_CELL_NAMES}, {_SCORES} FROM t",
    "committee_frontier": _frontier(_ODD) + "SELECT * FROM front",
    "committee_frontier_k3": _frontier("3") + "SELECT * EXCLUDE (mask), (SELECT string_agg(model, ',' ORDER BY i) FROM m WHERE (mask >> i) & 1 = 1) AS members FROM front",
    "frontier_by_k": _frontier(_ODD) + "SELECT dataset, k, count(*) AS n_committees, avg(cost) AS mean_cost, round(avg(round(kappa, 9)), 6) AS mean_kappa FROM front WHERE tau = 0.5 GROUP BY dataset, k",
    "fleiss_kappa": f"WITH {_VOTES}, {_MAIN}, k AS (SELECT range::INTEGER AS mask FROM range(1, (1 << (SELECT count(*) FROM m))::BIGINT) WHERE bit_count(range) = 3), "
    "s AS (SELECT dataset, mask, bit_count(ones & mask)::BIGINT AS o FROM v JOIN c USING (dataset, condition), k WHERE voted & mask = mask), "
    "t AS (SELECT dataset, mask, count(*) AS n, sum(o)::BIGINT AS s1, sum(o * o + (3 - o) * (3 - o))::BIGINT AS s2 FROM s GROUP BY ALL), "
    "q AS (SELECT *, s1::DOUBLE / (n * 3.0::DOUBLE) AS p, (s2 - n * 3)::DOUBLE / (n * 3.0::DOUBLE * 2) AS obs FROM t) "
    "SELECT dataset, mask, n AS n_full, (obs - (p * p + (1 - p) * (1 - p))) / nullif(1 - (p * p + (1 - p) * (1 - p)), 0) AS fleiss_kappa FROM q",
    "probe_by_condition": f"WITH {_VOTES}, z AS (SELECT count(*)::DOUBLE AS r FROM m), b AS (SELECT dataset, condition, gold, bit_count(voted)::BIGINT AS vv, bit_count(ones)::BIGINT AS k, 0.5::DOUBLE AS tau FROM v), "
    f"t AS (SELECT dataset, condition, {_cells('d')}, count(*) FILTER (WHERE vv = r) AS n_full, coalesce(sum(k) FILTER (WHERE vv = r), 0) AS s1, coalesce(sum(k * k + (r - k) * (r - k)) FILTER (WHERE vv = r), 0) AS s2, any_value(r) AS r FROM (SELECT *, {_decide('k', 'vv')} AS d FROM b, z) GROUP BY dataset, condition), "
    "q AS (SELECT *, s1::DOUBLE / nullif(n_full * r, 0) AS p, (s2 - n_full * r)::DOUBLE / nullif(n_full * r * (r - 1), 0) AS obs FROM t) "
    f"SELECT dataset, condition, n_full, (obs - (p * p + (1 - p) * (1 - p))) / nullif(1 - (p * p + (1 - p) * (1 - p)), 0) AS fleiss_kappa, {_KAPPA} AS panel_gold_kappa, {_BAL} AS panel_bal_acc_committed FROM q",
    "bootstrap_draws": "WITH " + _CLUSTERS.format(draws=bootstrap.DRAWS) + " SELECT dataset, draw, rank, weight FROM w",
    "bootstrap_ci": "WITH " + _CLUSTERS.format(draws=bootstrap.DRAWS) + ", "
    "s AS (SELECT k.dataset, k.condition, k.model, w.draw, sum(tp * weight)::BIGINT AS tp, sum(fn * weight)::BIGINT AS fn, sum(fp * weight)::BIGINT AS fp, sum(tn * weight)::BIGINT AS tn FROM k JOIN q USING (dataset, row_id) JOIN w ON w.dataset = k.dataset AND w.rank = q.rank GROUP BY ALL), "
    f"r AS (SELECT dataset, condition, model, {_KAPPA} AS kappa, {_BAL} AS bal FROM s), "
    f"t AS (SELECT dataset, condition, model, {_COV} AS coverage FROM (SELECT dataset, condition, model, {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('tp', 'fn', 'fp', 'tn', 'a1', 'a0'))} FROM k GROUP BY ALL)) "
    "SELECT dataset, condition, model, count(kappa) AS n_draws, round(avg(round(kappa, 12)), 6) AS kappa, round(quantile_cont(kappa, 0.025), 6) AS kappa_lo, round(quantile_cont(kappa, 0.975), 6) AS kappa_hi, "
    "round(avg(round(bal, 12)), 6) AS balanced_accuracy, round(quantile_cont(bal, 0.025), 6) AS balanced_accuracy_lo, round(quantile_cont(bal, 0.975), 6) AS balanced_accuracy_hi, any_value(coverage) AS coverage FROM r JOIN t USING (dataset, condition, model) GROUP BY ALL",
    "run_compare": "WITH x AS (SELECT dataset, uid, model, condition, pred, gold FROM experiment QUALIFY row_number() OVER (PARTITION BY dataset, uid, model, condition ORDER BY rec_id) = 1), "
    "s AS (SELECT dataset, uid FROM experiment GROUP BY ALL HAVING count(DISTINCT condition) = 2), a AS (SELECT x.* FROM x JOIN s USING (dataset, uid) WHERE condition = 'def_on'), b AS (SELECT x.* FROM x JOIN s USING (dataset, uid) WHERE condition = 'claimcheck'), "
    "j AS (SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.model, b.model) AS model, a.pred AS pa, b.pred AS pb, a.gold AS ga, b.gold AS gb, a.uid IS NOT NULL AS ina, b.uid IS NOT NULL AS inb FROM a FULL JOIN b ON a.dataset = b.dataset AND a.uid = b.uid AND a.model = b.model), "
    "n AS (SELECT dataset, count(*) AS n_shared FROM s GROUP BY dataset), "
    f"ka AS (SELECT dataset, model, {_KAPPA} AS k FROM (SELECT dataset, model, {_cells('pa', 'ga')} FROM j WHERE pa IS NOT NULL AND pb IS NOT NULL GROUP BY ALL)), kb AS (SELECT dataset, model, {_KAPPA} AS k FROM (SELECT dataset, model, {_cells('pb', 'ga')} FROM j WHERE pa IS NOT NULL AND pb IS NOT NULL GROUP BY ALL)), "
    "t AS (SELECT dataset, model, CASE WHEN NOT bool_or(inb) THEN 'a' WHEN NOT bool_or(ina) THEN 'b' ELSE 'both' END AS side, count(*) FILTER (WHERE pa IS NOT NULL AND pb IS NOT NULL) AS n_both, count(*) FILTER (WHERE pa = pb) AS n_agree, count(pa) AS ca, count(pb) AS cb FROM j GROUP BY ALL) "
    "SELECT dataset, model, side, n_shared, n_both, n_agree::DOUBLE / nullif(n_both, 0) AS agreement, ka.k AS kappa_a, kb.k AS kappa_b, ca::DOUBLE / n_shared AS coverage_a, cb::DOUBLE / n_shared AS coverage_b, coalesce((n_agree::DOUBLE / nullif(n_both, 0) < 0.95)::INTEGER, 0) AS is_low "
    "FROM t JOIN n USING (dataset) LEFT JOIN ka USING (dataset, model) LEFT JOIN kb USING (dataset, model)",
    "parse_verdict": f"SELECT rec_id, {_LABEL} AS label FROM experiment",
    "parse_agreement": f"SELECT model, count(*) AS n, count(*) FILTER (WHERE pred IS NOT DISTINCT FROM {_LABEL}) AS n_same, count({_LABEL}) AS n_label, count(pred) AS n_pred FROM experiment GROUP BY model",
    "graded_parse_prometheus": "WITH x AS (" + _forms(f"{_RAW} || ' [RESULT] ' || {_N5}", f"{_RAW} || '\n[RESULT] **' || {_N5} || '**'", f"'It gets ' || {_N5} || '/5. ' || {_RAW}", f"{_RAW} || ' That makes ' || {_N5} || ' out of 5'", f"'[RESULT] 1 ' || {_RAW} || ' [RESULT] ' || {_N5}", "''", _RAW)
    + r"), y AS (SELECT rec_id, coalesce(regexp_extract_all(text, '\[RESULT\]\s*\**\s*([1-5])', 1)[-1], regexp_extract_all(text, '\b([1-5])\s*(?:/\s*5|out of 5)', 1)[-1])::DOUBLE AS score FROM x) SELECT rec_id, score, CASE WHEN score IS NULL THEN NULL WHEN score >= 3 THEN 0 ELSE 1 END AS label FROM y",
    "graded_parse_autoj": "WITH x AS (" + _forms(f"{_RAW} || ' Rating: [[' || {_N10} || ']]'", f"'[[3]] ' || {_RAW} || ' [[ ' || {_N10} || '.5 ]]'", f"{_RAW} || '[[11]]'", f"'[[' || {_N10} || ']] ' || {_RAW}", _RAW, "''", f"'[[' || {_N10} || ']'")
    + r"), y AS (SELECT rec_id, regexp_extract_all(text, '\[\[\s*(\d+(?:\.\d+)?)\s*\]\]', 1)[-1]::DOUBLE AS s FROM x), z AS (SELECT rec_id, CASE WHEN s BETWEEN 1 AND 10 THEN s END AS score FROM y) SELECT rec_id, score, CASE WHEN score IS NULL THEN NULL WHEN score >= 5.5 THEN 0 ELSE 1 END AS label FROM z",
    "graded_parse_judgelm": "WITH x AS (" + _forms(f"{_N10} || '\n' || {_RAW}", f"' Score: ' || {_N10} || ' ' || {_RAW}", f"'Seen. ' || {_RAW} || '\nScore: ' || {_N10}", f"'Well. ' || {_RAW} || ' I rate it a ' || {_N10} || ' overall'", f"'So. ' || {_RAW} || ' It gets ' || {_N10} || ' out of 10.'", f"'A score of 3 first, then ' || {_N10} || '/10 in the end'", f"'45 ' || {_RAW}")
    + rf"), y AS (SELECT rec_id, try_cast(regexp_extract(trim(regexp_extract(regexp_replace(text, '^\s+', ''), '^([^\n\r]*)', 1)), '(?i)^(?:score\s*[:=]?\s*)?{_NUM}(?:$|[^\d.]|\.\D|\.$)', 1) AS DOUBLE) AS lead, "
    rf"list_filter(list_transform(regexp_extract_all(text, '(?i)\bscores?\s*[:=]\s*(\d+(?:\.\d+)?)', 1), lambda v: v::DOUBLE), lambda v: v BETWEEN 1 AND 10)[-1] AS fin, list_sort(list_filter([{_NAMED}], lambda s: s.v IS NOT NULL))[-1].v AS ctx FROM x), "
    "z AS (SELECT rec_id, coalesce(lead, fin, ctx) AS score FROM y) SELECT rec_id, score, CASE WHEN score IS NULL THEN NULL WHEN score >= 5.5 THEN 0 ELSE 1 END AS label FROM z",
    "constrained_choice": f"WITH {_CAND}, b AS (SELECT line, sum(CASE WHEN word = 'yes' THEN exp(lp) ELSE 0 END) AS y, sum(CASE WHEN word = 'no' THEN exp(lp) ELSE 0 END) AS n FROM p GROUP BY line), q AS (SELECT line, round(y / nullif(y + n, 0), 9) AS p_yes FROM b) "
    "SELECT line, p_yes, CASE WHEN p_yes >= 0.5 THEN 1 WHEN p_yes < 0.5 THEN 0 END AS choice, 1 - CASE WHEN p_yes >= 0.5 THEN 1 WHEN p_yes < 0.5 THEN 0 END AS label FROM q",
    "best_choice": _best("word"),
    "marked_choice": _best("bare"),
    "choice_tokens": r"WITH w AS (SELECT DISTINCT unnest(string_split_regex(raw, '[ \n]')) AS w FROM experiment), v AS (SELECT unnest([w, '▁' || w, 'Ġ' || w]) AS piece FROM w WHERE w <> '') "
    r"SELECT DISTINCT md5(piece) AS id FROM v WHERE lower(regexp_replace(translate(piece, '▁ĠĊ', '   '), '^\s+|\s+$', '', 'g')) IN ('supported', 'hallucinated')",
    "usage_cost": f"WITH i AS (SELECT dataset, uid, {_words('question')} + {_words('candidate')} + {_words(chr(97) + 'rray_to_string(context, chr(32))')} AS tin FROM instances), c AS (SELECT e.dataset, e.model, tin, {_words('raw')} AS tout FROM experiment e JOIN i USING (dataset, uid)), "
    f"g AS (SELECT dataset, model, count(*) AS calls, sum(tin)::BIGINT AS input_tokens, sum(tout)::BIGINT AS output_tokens FROM c GROUP BY ALL), u AS (SELECT *, (input_tokens * {_rate(0)} + output_tokens * {_rate(1)}) / 1e6::DOUBLE AS cost_usd FROM g) "
    "SELECT dataset, model, calls, input_tokens, output_tokens, input_tokens::DOUBLE / calls AS input_tokens_per_item, output_tokens::DOUBLE / calls AS output_tokens_per_item, cost_usd, 1000 * cost_usd / calls AS cost_usd_per_1k FROM u",
    "harmonic_throughput": "WITH t AS (SELECT json_extract_string(payload, '$.model') AS model, try_cast(json_extract_string(payload, '$.wall_seconds') AS DOUBLE) AS s FROM shard_lines WHERE json_valid(payload)) "
    "SELECT model, count(*) AS n, round(avg(s), 6) AS mean_seconds, round(count(*) / sum(s), 6) AS items_per_second FROM t WHERE s > 0 AND model IS NOT NULL GROUP BY model",
}
