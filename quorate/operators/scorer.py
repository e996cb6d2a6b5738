"""Forced-choice scoring from first-token log-probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.operators.ranks import numbered
from quorate.plans.config import deprecated

#: Marks that stand for a blank at the start of a vocabulary piece.
MARKERS = "▁ĠĊ"


def plain(piece: Column) -> Column:
    """A vocabulary piece without boundary marks, blanks and letter case."""
    return F.lower(F.regexp_replace(F.translate(piece, MARKERS, "   "), r"^\s+|\s+$", ""))


def choice_ids(vocabulary: DataFrame, words: Sequence[str]) -> DataFrame:
    """Ids of the pieces (piece, id) that read as one of ``words``, in order and without repeats."""
    return vocabulary.where(plain(F.col("piece")).isin(*[w.strip().lower() for w in words])).select("id").distinct()


def allowed_ids(vocabulary: DataFrame, *classes: Sequence[str]) -> DataFrame:
    """All ids that any class of words allows (id and position in the sorted list, from 0), each once."""
    every = choice_ids(vocabulary, [w for words in classes for w in words])
    return numbered(every.withColumn("g", F.lit(1)), ["g"], ["id"], "position").select("id", "position")


def by_mass(candidates: DataFrame, key: str, yes: Sequence[str] = ("Yes",), no: Sequence[str] = ("No",)) -> DataFrame:
    """Choice by the summed probability of either class: key, p_yes and choice; null where neither class has any.

    ``candidates`` has key, piece and logprob.
    """
    word = plain(F.col("piece"))
    mass = lambda ws: F.sum(F.when(word.isin(*[w.lower() for w in ws]), F.exp("logprob")).otherwise(0.0))
    both = candidates.groupBy(key).agg(mass(yes).alias("y"), mass(no).alias("n"))
    p = F.round(F.try_divide(F.col("y"), F.col("y") + F.col("n")), 9)
    return both.select(key, p.alias("p_yes"), F.when(p >= 0.5, 1).when(p < 0.5, 0).alias("choice"))


@deprecated("by_mass counts all that either class has")
def by_best(candidates: DataFrame, key: str, yes: Sequence[str] = ("Yes",), no: Sequence[str] = ("No",), marked: bool = True) -> DataFrame:
    """Choice by the best log-probability of either class (superseded by ``by_mass``).

    One-sided evidence gives 1 or 0 outright.  Without ``marked``, pieces must read as the words without taking
    boundary marks off, as the first version did.
    """
    word = plain(F.col("piece")) if marked else F.lower(F.regexp_replace("piece", r"^\s+|\s+$", ""))
    best = lambda ws: F.max(F.when(word.isin(*[w.lower() for w in ws]), F.col("logprob")))
    both = candidates.groupBy(key).agg(best(yes).alias("y"), best(no).alias("n"))
    y, n = F.col("y"), F.col("n")
    m = F.greatest(y, n)
    p = F.when(y.isNull() & n.isNull(), None).when(n.isNull(), 1.0).when(y.isNull(), 0.0).otherwise(F.round(F.exp(y - m) / (F.exp(y - m) + F.exp(n - m)), 9))
    return both.select(key, p.alias("p_yes"), F.when(p >= 0.5, 1).when(p < 0.5, 0).alias("choice"))
