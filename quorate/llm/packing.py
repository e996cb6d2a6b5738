"""Filling prompts of fixed capacity with texts, planned on a histogram of lengths.

Best-fit in falling length is run over *counts*: prompts with equal free space are one range of numbers, and a step
places many equal lengths at once.  The plan says which ranks within a length go to which prompts; texts then take
their place by their rank within their length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorate.llm import tokens
from quorate.plans.lineage import cut

#: Pieces that one numbering task should hold.
SLICE = 50_000


def best_fit(histogram: Iterable[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Plan for ``(length, count)`` pairs: runs (length, first rank, first prompt, per prompt, prompts) and the number of prompts.

    Lengths lie in 1..capacity.  Prompts and ranks count from 0.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    runs: list[tuple[int, int, int, int, int]] = []
    prompts = 0

    def give(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in free:
                free[space] = []
                bisect.insort(spaces, space)
            free[space].append((first, n))

    for length, count in sorted(histogram, reverse=True):
        rank = 0
        while count:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = free[space].pop()
                if not free[space]:
                    del free[space]
                    spaces.pop(at)
            else:
                space, first = capacity, prompts
                n = -(-count // (capacity // length))
                prompts += n
            each = space // length
            full = min(n, count // each)
            if full:
                runs.append((length, rank, first, each, full))
                give(space - each * length, first, full)
                rank, count, first, n = rank + each * full, count - each * full, first + full, n - full
            if n and count:
                runs.append((length, rank, first, count, 1))
                give(space - count * length, first, 1)
                rank, count, first, n = rank + count, 0, first + 1, n - 1
            give(space, first, n)
    return runs, prompts


def pieces(lengths: DataFrame, windows: dict[str, int], key: str = "doc_id") -> DataFrame:
    """judge, ``key``, piece_no and n_tokens: a text longer than the judge's window is cut into full pieces and a rest.

    A text without tokens is one piece of length 0.
    """
    judges = F.explode(F.array(*[F.struct(F.lit(j).alias("judge"), F.lit(w).alias("window")) for j, w in windows.items()]))
    each = lengths.select(key, "n_tokens", judges.alias("j")).select(key, "n_tokens", "j.*")
    cuts = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("window"))).cast("int")
    numbered = each.withColumn("piece_no", F.explode(F.sequence(F.lit(0), cuts - 1)))
    rest = F.col("n_tokens") - F.col("piece_no") * F.col("window")
    return numbered.select("judge", key, "piece_no", F.least(rest, F.col("window").cast("long")).alias("n_tokens"))


def pack(lengths: DataFrame, windows: dict[str, int], key: str = "doc_id") -> DataFrame:
    """judge, ``key``, piece_no, n_tokens and prompt_no (from 1) of each piece; no prompt holds more than its window.

    ``lengths`` has ``key`` and ``n_tokens`` and is read twice, so it should be stored.  The histogram that reaches the
    driver has at most one row per judge and length, whatever the input.  Pieces of length 0 go to prompt 1.
    """
    spark = lengths.sparkSession
    if not windows or any(w is None or w < 1 for w in windows.values()):
        raise ValueError("each judge needs a window of one token or more")
    all_pieces = pieces(lengths, windows, key)
    counts = all_pieces.groupBy("judge", "n_tokens").count().collect()
    total = sum(r["count"] for r in counts)
    rows = []
    for judge, window in windows.items():
        runs, _ = best_fit([(r["n_tokens"], r["count"]) for r in counts if r["judge"] == judge and r["n_tokens"]], window)
        by: dict[int, list] = {}
        for length, rank, first, each, n in runs:
            by.setdefault(length, []).append((rank, first, each, n))
        rows += [(judge, length, sorted(v)) for length, v in by.items()]
    plan = spark.createDataFrame(rows, "judge string, n_tokens long, runs array<struct<rank:long,first:long,each:long,n:long>>")

    # Rank within a length: numbered within slices of it, which start where the slices before them end.
    slices = max(1, -(-total // SLICE))
    sliced = all_pieces.withColumn("slice", F.pmod(F.xxhash64(key, "piece_no"), F.lit(slices)))
    group = ["judge", "n_tokens", "slice"]
    before = Window.partitionBy("judge", "n_tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy(*group).count().select(*group, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy(*group).orderBy(key, "piece_no"))
    ranked = sliced.withColumn("within", within).join(starts, group).withColumn("rank", F.col("start") + F.col("within") - 1)
    # The plan has a bound of its own: some runs for each length that fits the largest window.
    placed = ranked.join(F.broadcast(plan), ["judge", "n_tokens"], "left")
    run = F.expr("element_at(filter(runs, r -> r.rank <= rank AND rank < r.rank + r.each * r.n), 1)")
    number = placed.withColumn("run", run).withColumn("prompt_no", F.coalesce(F.expr("run.first + (rank - run.rank) div run.each"), F.lit(0)) + 1)
    return number.select("judge", key, "piece_no", "n_tokens", "prompt_no")


def windows_of(judges: DataFrame) -> dict[str, int]:
    """Windows by judge from the table of judges, which is a fixed dimension."""
    return {r["judge"]: r["window_tokens"] for r in judges.select("judge", "window_tokens").distinct().collect()}


def prompts(spark: SparkSession, documents: DataFrame, judges: DataFrame) -> DataFrame:
    """Prompts of all documents for all judges (columns of ``pack``)."""
    return pack(cut(tokens.count(documents)), windows_of(judges))


def report(spark: SparkSession, documents: DataFrame, judges: DataFrame) -> DataFrame:
    """judge, prompts, pieces, tokens, least (prompts that no packing can go below) and fill (used share of all windows)."""
    windows = windows_of(judges)
    size = F.create_map(*[x for j, w in windows.items() for x in (F.lit(j), F.lit(w))])[F.col("judge")]
    per = pack(cut(tokens.count(documents)), windows).groupBy("judge").agg(F.max("prompt_no").alias("prompts"), F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"))
    return per.select("judge", "prompts", "pieces", "tokens", F.ceil(F.col("tokens") / size).alias("least"), (F.col("tokens") / (F.col("prompts") * size)).alias("fill"))
