"""Checksums, manifests and votes-only exports of verdict files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.text import content_key
from quorate.plans.lineage import cut

#: Lines whose digests are put together at once.
CHUNK = 1000


def index_manifest(items: DataFrame) -> DataFrame:
    """Per dataset: items, source rows, class balance, distinct content keys and keys that several items share."""
    keyed = items.select("dataset", "row_id", "gold", content_key(F.col("question"), F.col("context"), F.col("candidate")).alias("key"))
    keys = keyed.groupBy("dataset", "key").agg(F.count("*").alias("n"), F.count_if(F.col("gold") == 0).alias("g0"), F.count_if(F.col("gold") == 1).alias("g1"))
    per = keys.groupBy("dataset").agg(F.sum("n").alias("n"), F.sum("g0").alias("gold0"), F.sum("g1").alias("gold1"), F.count("*").alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("duplicate_keys"))
    rows = keyed.select("dataset", "row_id").distinct().groupBy("dataset").agg(F.count("row_id").alias("n_clusters"))
    return per.join(rows, "dataset").select("dataset", "n", "n_clusters", "gold0", "gold1", "distinct_keys", "duplicate_keys")


def file_digests(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """sha256, bytes and records of each file from its numbered lines (file_id, line_no, payload).

    The digest of a file is the root of a tree: over the digests of its blocks of ``chunk`` chunks in order, each over
    those of its chunks of ``chunk`` lines, each over its lines' number and text; so no task holds more than ``chunk``
    lines, or a file's list of blocks, whatever the file's size.  Null lines count as empty.
    """
    text = F.coalesce("payload", F.lit(""))
    each = lines.select("file_id", "line_no", text.alias("payload"))
    part = F.concat(F.col("line_no").cast("string"), F.lit(" "), F.col("payload"), F.lit("\n"))
    level = each.select("file_id", F.col("line_no").cast("bigint").alias("at"), F.sha2(F.encode(part, "UTF-8"), 256).alias("digest"), (F.octet_length("payload") + 1).cast("bigint").alias("bytes"), F.lit(1).cast("bigint").alias("records"))
    sums = [F.sum(c).alias(c) for c in ("bytes", "records")]
    for _ in range(2):
        level = level.groupBy("file_id", F.floor(F.col("at") / chunk).alias("to")).agg(_chain("at", "digest"), *sums).withColumnRenamed("to", "at")
    return level.groupBy("file_id").agg(_chain("at", "digest").alias("sha256"), *sums)


def _chain(order: str, digest: str) -> Column:
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(digest).alias("d"))))
    return F.sha2(F.encode(F.array_join(F.transform(listed, lambda x: x["d"]), "\n"), "UTF-8"), 256).alias("digest")


def tree_digest(lines: DataFrame, scope: list[str], line: str, name: str = "digest") -> DataFrame:
    """Digest of the lines of each scope, whatever their order.

    Equal lines are counted first and enter with their count.  They are put together by the first six, then the first
    three digits of their own digests, so that no task holds more than a sixteen-millionth of them.
    """
    whole = lambda x: F.sha2(F.array_join(F.array_sort(F.collect_list(x)), "\n"), 256)
    counted = lines.groupBy(*scope, line).agg(F.count("*").alias("_n")).select(*scope, F.concat(line, F.lit(" x"), "_n").alias(line))
    hashed = counted.select(*scope, line, F.sha2(line, 256).alias("_h"))
    for digits in (6, 3):
        hashed = hashed.groupBy(*scope, F.substring("_h", 1, digits).alias("_b")).agg(whole(F.col(line)).alias("_d")).select(*scope, F.concat("_b", "_d").alias(line), F.col("_b").alias("_h"))
    return hashed.groupBy(*scope).agg(whole(F.col(line)).alias(name))


def release_digest(files: DataFrame, path: Column) -> DataFrame:
    """One row: files, records and the digest over the ``path digest`` lines of all files."""
    lines = files.select("records", F.concat(path, F.lit(" "), F.col("sha256")).alias("line"), F.lit(1).alias("g"))
    counts = lines.agg(F.count("*").alias("n_files"), F.sum("records").alias("records"), F.lit(None).cast("string").alias("digest"))
    digest = tree_digest(lines, ["g"], "line").select(F.lit(None).cast("bigint").alias("n_files"), F.lit(None).cast("bigint").alias("records"), "digest")
    return counts.unionByName(digest).agg(*[F.max(c).alias(c) for c in counts.columns])


def lock_check(lock: DataFrame, present: DataFrame) -> DataFrame:
    """Files (path, sha256) that are missing, unknown to the lock, or changed."""
    p = present.select("path", F.col("sha256").alias("now"))
    both = lock.select("path", "sha256").join(p, "path", "full_outer")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unlocked").when(F.col("now") != F.col("sha256"), "changed")
    return both.select("path", state.alias("state")).where("state IS NOT NULL")


def lock_guard(lock: DataFrame, present: DataFrame, force: bool = False, shown: int = 5) -> DataFrame:
    """One row: whether ``present`` may be locked in place of ``lock`` (path, sha256), ``write`` or ``refuse``, and why.

    Recorded files that are missing or whose content changed are counted, and the first ``shown`` missing paths named;
    new files are no reason.  Nothing recorded, or force, lets it write.
    """
    states = cut(lock_check(lock, present))
    counts = states.agg(F.count_if(F.col("state") == "missing").alias("n_missing"), F.count_if(F.col("state") == "changed").alias("n_changed"), F.lit("").alias("missing"))
    first = states.where("state = 'missing'").orderBy("path").limit(shown).agg(F.lit(None).cast("bigint").alias("n_missing"), F.lit(None).cast("bigint").alias("n_changed"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("missing"))
    one = counts.unionByName(first).agg(*[F.max(c).alias(c) for c in counts.columns])
    bad = (F.col("n_missing") > 0) | (F.col("n_changed") > 0)
    return one.select("*", F.when(bad & F.lit(not force), "refuse").otherwise("write").alias("decision"))


def mirror_check(manifest: DataFrame, mirror: DataFrame, expected: DataFrame) -> DataFrame:
    """Files of an export that are not as they should be: path and state.

    ``manifest`` and ``mirror`` have path and sha256, ``expected`` the paths of the source tree.  A recorded file is
    ``missing`` or ``changed`` in the mirror, an ``orphan`` if the tree has it no more; a file of the tree that was
    never recorded is ``unexported``.  A file can have two states.
    """
    all_ = (
        manifest.select("path", F.col("sha256").alias("said")).join(mirror.select("path", F.col("sha256").alias("now"), F.lit(True).alias("there")), "path", "full_outer")
        .join(expected.select("path", F.lit(True).alias("wanted")).distinct(), "path", "full_outer")
    )
    recorded = F.col("said").isNotNull()
    states = F.array_compact(F.array(
        F.when(recorded & F.col("there").isNull(), "missing").when(recorded & (F.col("said") != F.col("now")), "changed"),
        F.when(recorded & F.col("wanted").isNull(), "orphan").when(~recorded & F.col("wanted").isNotNull(), "unexported"),
    ))
    return all_.select("path", F.explode(states).alias("state"))


def export_guard(lock: DataFrame, present: DataFrame, mirrored: str | None, incoming: str | None, force: bool = False) -> str:
    """``write``, or why an export must not replace the mirror of release ``mirrored`` (None where there is none).

    The lock must describe the tree file for file, and its release must be the mirror's.
    """
    if force or mirrored is None:
        return "write"
    if not lock_check(lock, present).isEmpty():
        return "refuse: the lock does not describe the tree"
    return "write" if mirrored == incoming else "refuse: the mirror holds another release"


def index_digest(items: DataFrame) -> DataFrame:
    """One row: the digest over the names of all data sets and the digests of their index lines, in the names' order."""
    key = content_key(F.col("question"), F.col("context"), F.col("candidate"))
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines = items.select("dataset", F.concat_ws("|", none("uid"), none("row_id"), none("kind"), none("gold"), none("stratum"), none("category"), key).alias("line"))
    sets = tree_digest(lines, ["dataset"], "line")
    listed = F.array_sort(F.collect_list(F.struct("dataset", "digest")))  # one entry per data set
    return sets.agg(F.count("*").alias("n_sets"), F.sha2(F.array_join(F.transform(listed, lambda x: F.concat(x["dataset"], x["digest"])), ""), 256).alias("digest"))


def is_measurement(name: Column) -> Column:
    """Whether a file holds verdicts or a judge's summary, and is no comparison derived from them."""
    return name.endswith(".jsonl") | (name.startswith("judge_") & name.endswith(".json") & ~name.startswith("judge_pair_"))


def run_signature(items: DataFrame, arms: list[str], models: list[str], window: int) -> DataFrame:
    """Per dataset: the digest of a run's plan, over its items with their content, its arms, its models and the window."""
    key = content_key(F.col("question"), F.col("context"), F.col("candidate"))
    digests = tree_digest(items.select("dataset", F.concat_ws(" ", "uid", key).alias("line")), ["dataset"], "line")
    plan = "|".join([*arms, *models, str(window)])
    return digests.select("dataset", F.sha2(F.concat(F.lit(plan + "\n"), "digest"), 256).alias("signature"))
