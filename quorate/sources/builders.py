"""Builders of balanced items from source rows.

Every source row carries its position ``pos``; identity never depends on the order in which Spark reads rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions.text import point, strip
from quorate.operators.ranks import numbered

ITEM = ["dataset", "uid", "row_id", "kind", "gold", "stratum", "category", "question", "context", "candidate"]


def _both(df: DataFrame, dataset: str, row: str, stratum: str, categories: tuple[str, str], good: str, bad: str) -> DataFrame:
    """Two items per row: the sound answer with gold 0 and the faulty one with gold 1."""
    pair = F.array(
        F.struct(F.lit("pos").alias("kind"), F.lit(0).alias("gold"), F.expr(categories[0]).alias("category"), F.col(good).alias("candidate")),
        F.struct(F.lit("neg").alias("kind"), F.lit(1).alias("gold"), F.expr(categories[1]).alias("category"), F.col(bad).alias("candidate")),
    )
    each = df.withColumn("p", F.explode(pair))
    return each.select(F.lit(dataset).alias("dataset"), F.concat(F.col(row), F.lit(":"), F.col("p.kind")).alias("uid"), F.col(row).cast("bigint").alias("row_id"), "p.kind", "p.gold", F.expr(stratum).alias("stratum"), "p.category", "question", "context", "p.candidate")


def paired_rows(rows: DataFrame, dataset: str = "medhallu") -> DataFrame:
    """Two items from each row (pos, question, context, truth, hallucinated, difficulty, category)."""
    return _both(rows, dataset, "pos", "difficulty", ("category", "category"), "truth", "hallucinated").select(ITEM)


def best_or_first(rows: DataFrame, dataset: str = "truthfulqa") -> DataFrame:
    """Two items from each row (pos, question, best, correct, incorrect, type, category).

    The sound answer is the best one, or the first correct one where that is empty; the faulty one is the first
    incorrect one.  Rows that lack either are dropped; there is no context.
    """
    none = F.array().cast("array<string>")
    first = lambda c: F.try_element_at(F.filter(F.coalesce(c, none), lambda x: x.isNotNull() & (x != "")), F.lit(1))
    kept = rows.select("pos", "question", none.alias("context"), "type", "category", F.coalesce(F.nullif("best", F.lit("")), first(F.col("correct"))).alias("good"), first(F.col("incorrect")).alias("bad"))
    return _both(kept.where("good IS NOT NULL AND bad IS NOT NULL"), dataset, "pos", "type", ("category", "category"), "good", "bad").select(ITEM)


def classified(rows: DataFrame) -> DataFrame:
    """Question-answering responses with the flag ``faulty``, from (pos, query, context, output, task_type, processed, labels).

    ``processed`` (struct of evident_conflict and baseless_info, counts) decides where it is there; else ``labels``, the
    list of faults as text, does: a response is sound where that is null, empty, ``[]`` or ``null``.
    """
    counted = (F.coalesce("processed.evident_conflict", F.lit(0)) > 0) | (F.coalesce("processed.baseless_info", F.lit(0)) > 0)
    listed = F.col("labels").isNotNull() & ~F.col("labels").isin("", "[]", "null")
    return rows.where(F.lower("task_type") == "qa").select("pos", "query", "context", "output", F.when(F.col("processed").isNotNull(), counted).otherwise(listed).alias("faulty"))


def first_pairs(rows: DataFrame, dataset: str = "ragtruth") -> DataFrame:
    """The first faithful and the first faulty response of each query, from (pos, query, context, output, faulty).

    A query's context is that of its first row; later responses under another context do not count.  The first
    response of a kind counts even if it is empty, and then its query gives nothing.  Queries without both kinds or
    without context are dropped; the others are numbered in the order in which they first appear.
    """
    q = strip(F.col("query"))
    base = rows.select("pos", q.alias("query"), "context", F.coalesce("output", F.lit("")).alias("output"), F.coalesce("faulty", F.lit(False)).alias("faulty")).where("query <> ''")
    first = base.groupBy("query").agg(F.min("pos").alias("first_pos"), F.min_by("context", "pos").alias("kept"))
    same = base.join(first, "query").where(F.col("context").eqNullSafe(F.col("kept")))
    slot = lambda bad: F.min_by(F.when(F.col("faulty") == bad, F.col("output")), F.when(F.col("faulty") == bad, F.col("pos")))
    pairs = same.groupBy("query").agg(F.min("first_pos").alias("first_pos"), F.first("kept").alias("context"), slot(False).alias("good"), slot(True).alias("bad"))
    pairs = pairs.where((F.col("good") != "") & (F.col("bad") != "") & (F.size(F.coalesce("context", F.array().cast("array<string>"))) > 0)).withColumnRenamed("query", "question").withColumn("g", F.lit(1))
    return _both(numbered(pairs, ["g"], ["first_pos"], "i"), dataset, "i", "'ragtruth_qa'", ("'faithful'", "'hallucinated'"), "good", "bad").select(ITEM)


def nested_facts(rows: DataFrame, dataset: str = "factscore") -> DataFrame:
    """The first supported and the first unsupported relevant fact of each topic.

    ``rows`` has pos, topic and annotations (array of relevant flag and facts, each a label and a text), read in order.
    Irrelevant annotations and empty facts do not count, rows without both kinds are dropped.
    """
    facts = (
        rows.select("pos", F.coalesce("topic", F.concat(F.lit("person_"), F.col("pos"))).alias("topic"), F.posexplode("annotations").alias("i", "a"))
        .where(F.coalesce("a.relevant", F.lit(True)))
        .select("pos", "topic", "i", F.posexplode("a.facts").alias("j", "f"))
        .where("f.text IS NOT NULL AND f.text <> ''")
    )
    label = F.upper("f.label")
    first = lambda k: F.min_by(F.when(label == k, F.col("f.text")), F.when(label == k, F.struct("i", "j")))
    both = facts.groupBy("pos", "topic").agg(first("S").alias("good"), first("NS").alias("bad")).where("good IS NOT NULL AND bad IS NOT NULL")
    asked = both.withColumn("question", F.concat(F.lit("Is the following biographical claim about "), "topic", F.lit(" factually correct?"))).withColumn("context", F.array().cast("array<string>"))
    return _both(asked, dataset, "pos", "'factscore_bio'", ("'supported'", "'not_supported'"), "good", "bad").select(ITEM)


def balanced_claims(rows: DataFrame, dataset: str, seed: int = 0) -> DataFrame:
    """Items of a document-claim set with as many of either class, clustered by document.

    ``rows`` has pos, doc, claim and label (1 supported).  Rows without label or claim are dropped; of the larger class
    those whose draw comes first are kept.  Items are numbered in the order of their draws, and documents in the
    order in which their items appear.
    """
    kept = rows.where("label IS NOT NULL AND claim <> ''").select("pos", F.coalesce("doc", F.lit("")).alias("doc"), "claim", (1 - F.col("label")).cast("int").alias("gold"), point(F.lit(seed), F.col("pos")).alias("draw"))
    drawn = numbered(kept, ["gold"], ["draw", "pos"], "at")
    least = drawn.groupBy("gold").count().agg(F.min("count").alias("n"), F.count("*").alias("classes")).first()  # two numbers
    n = least["n"] if least["classes"] == 2 else 0
    chosen = numbered(drawn.where(F.col("at") < n).withColumn("g", F.lit(1)), ["g"], ["draw", "pos"], "i")
    docs = numbered(chosen.groupBy("g", F.sha1("doc").alias("key")).agg(F.min("i").alias("i")), ["g"], ["i"], "row_id").select("key", "row_id")
    joined = chosen.withColumn("key", F.sha1("doc")).join(docs, "key")
    kind = F.when(F.col("gold") == 1, "neg").otherwise("pos")
    return joined.select(
        F.lit(dataset).alias("dataset"), F.concat(F.col("i"), F.lit(":"), kind).alias("uid"), "row_id", kind.alias("kind"), "gold", F.lit(dataset).alias("stratum"),
        F.when(F.col("gold") == 0, "supported").otherwise("not_supported").alias("category"), F.col("claim").alias("question"), F.array("doc").alias("context"), F.col("claim").alias("candidate"),
    ).select(ITEM)


def synthetic(spark, dataset: str, n: int, strata: tuple[str, ...] = ("easy", "medium", "hard"), seed: int = 0) -> DataFrame:
    """2n items for trying out a pipeline, with a stratum drawn by hash."""
    base = spark.range(n).select(F.col("id").alias("pos"), F.concat(F.lit("question "), "id", F.lit("?")).alias("question"), F.array(F.concat(F.lit("Evidence "), "id", F.lit("."))).alias("context"), F.lit("clean answer").alias("good"), F.lit("fabricated answer").alias("bad"))
    pick = F.element_at(F.array(*[F.lit(s) for s in strata]), (point(F.lit(seed), F.lit(dataset), F.col("pos")) % len(strata)).cast("int") + 1)
    return _both(base.withColumn("stratum", pick), dataset, "pos", "stratum", ("'clean'", "'made up'"), "good", "bad").select(ITEM)


def exemplars(items: DataFrame, k: int = 6, seed: int = 0) -> DataFrame:
    """k/2 items of either gold class per dataset, those whose draws come first."""
    drawn = items.where("gold IN (0, 1)").select("dataset", "uid", "row_id", "gold", point(F.lit(seed), F.col("dataset"), F.col("uid")).alias("draw"))
    # A rank with a limit is taken within each task before the shuffle, so no group gathers whole.
    first = Window.partitionBy("dataset", "gold").orderBy("draw", "uid")
    some = drawn.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k // 2)
    return some.select("dataset", "uid", "row_id", "gold", "at")


def exemplar_blocks(items: DataFrame, chosen: DataFrame, seed: int = 0) -> DataFrame:
    """Per dataset the ``block`` of each exemplar of ``exemplars``, in a drawn order that mixes the classes: dataset, shots.

    ``items`` have inst_id, dataset, uid, gold and block; of items with one uid and class the first counts.
    """
    drawn = items.join(F.broadcast(chosen.select("dataset", "uid", "gold", "at")), ["dataset", "uid", "gold"])  # k rows per dataset
    each = drawn.groupBy("dataset", "uid", "gold", "at").agg(F.min_by("block", "inst_id").alias("block"))
    order = F.struct(point("shots", F.lit(seed), F.col("dataset"), F.col("uid")).alias("draw"), "uid", "gold", "at", "block")
    return each.groupBy("dataset").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["block"]).alias("shots"))


def without_exemplars(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """Items whose source row gave no exemplar; items without row_id stay."""
    return items.join(chosen.select("dataset", "row_id").distinct(), ["dataset", "row_id"], "left_anti")


def _head(rows: DataFrame, by: str, n: int | None) -> DataFrame:
    return rows if n is None else rows.orderBy(by).limit(n)


#: Builders of the items of each data set, and where a limit falls: ``rows`` read, or ``pairs`` kept, or items after the shuffle.
BUILDERS = {
    "medhallu": (paired_rows, "rows"), "truthfulqa": (best_or_first, "rows"), "ragtruth": (first_pairs, "pairs"), "factscore": (nested_facts, "pairs"),
    **{f"aggrefact_{s}": (lambda rows, s=s: balanced_claims(rows, f"aggrefact-{s}"), "items") for s in ("xsum", "wice", "cnn", "expertqa")},
}


def build(dataset: str, rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Items of a data set from its source rows; raises for an unknown one.

    A limit counts source rows in their order, pairs in theirs (both items of a pair are kept), or single items in the
    order of the shuffle, whichever the set's builder limits.
    """
    if dataset not in BUILDERS:
        raise ValueError(f"unknown data set {dataset!r}")
    builder, at = BUILDERS[dataset]
    if limit is None:
        return builder(rows)
    if at == "rows":
        return builder(_head(rows, "pos", limit))
    built = builder(rows)
    if at == "pairs":
        return built.join(_head(built.select("row_id").distinct(), "row_id", limit), "row_id", "left_semi").select(built.columns)
    number = F.split("uid", ":")[0].cast("bigint")
    return built.where(number < limit)
