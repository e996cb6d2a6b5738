"""Metrics of judges from integer counts, so that no result depends on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Counts behind every metric: hits and errors per gold class, and abstentions on gold 1 and 0.
CELLS = ("tp", "fn", "fp", "tn", "a1", "a0")


def cells(pred: Column, gold: Column, weight: Column | None = None) -> list[Column]:
    """Aggregates for the six counts; rows without gold count nowhere."""
    w = F.lit(1) if weight is None else weight
    tests = {"tp": (gold == 1) & (pred == 1), "fn": (gold == 1) & (pred == 0), "fp": (gold == 0) & (pred == 1), "tn": (gold == 0) & (pred == 0), "a1": (gold == 1) & pred.isNull(), "a0": (gold == 0) & pred.isNull()}
    return [F.coalesce(F.sum(F.when(t, w)), F.lit(0)).cast("bigint").alias(k) for k, t in tests.items()]


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def coverage(c: dict[str, Column]) -> Column:
    said = c["tp"] + c["fn"] + c["fp"] + c["tn"]
    return ratio(said, said + c["a1"] + c["a0"])


def _both(c: dict[str, Column], value: Column) -> Column:
    return F.when((c["tp"] + c["fn"] > 0) & (c["fp"] + c["tn"] > 0), value)


def kappa(c: dict[str, Column]) -> Column:
    """Agreement with gold beyond chance over committed rows; null unless both gold classes are there."""
    tp, fn, fp, tn = (c[k].cast("double") for k in ("tp", "fn", "fp", "tn"))
    return _both(c, F.try_divide(2 * (tp * tn - fp * fn), (tp + fp) * (fp + tn) + (tp + fn) * (fn + tn)))


def balanced_committed(c: dict[str, Column]) -> Column:
    """Mean of both class accuracies over committed rows."""
    return _both(c, (ratio(c["tp"], c["tp"] + c["fn"]) + ratio(c["tn"], c["tn"] + c["fp"])) / 2)


def balanced_nonanswer_error(c: dict[str, Column]) -> Column:
    """Mean over the classes present of the accuracy in which an abstention is an error."""
    one, zero = ratio(c["tp"], c["tp"] + c["fn"] + c["a1"]), ratio(c["tn"], c["tn"] + c["fp"] + c["a0"])
    return F.coalesce((one + zero) / 2, one, zero)


def macro_f1(c: dict[str, Column]) -> Column:
    """Mean F1 of both classes over committed rows."""
    return _both(c, (ratio(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]) + ratio(2 * c["tn"], 2 * c["tn"] + c["fp"] + c["fn"])) / 2)


def scores() -> list[Column]:
    """All metrics from columns named as the counts."""
    c = {k: F.col(k) for k in CELLS}
    n = c["tp"] + c["fn"] + c["fp"] + c["tn"] + c["a1"] + c["a0"]
    named = {"n": n, "coverage": coverage(c), "kappa": kappa(c), "bal_acc_committed": balanced_committed(c), "bal_acc_nonanswer_error": balanced_nonanswer_error(c), "macro_f1": macro_f1(c)}
    return [v.alias(k) for k, v in named.items()]


def fleiss(n: Column, items: Column, ones: Column, squares: Column) -> Column:
    """Fleiss' kappa for two categories: n raters, items they all rated, sum of ones, sum of k^2 + (n-k)^2.

    Null for one rater, no item, or votes that are all alike.
    """
    n, items, ones, squares = (x.cast("double") for x in (n, items, ones, squares))
    p = F.try_divide(ones, items * n)
    chance = p * p + (1 - p) * (1 - p)
    return F.try_divide(F.try_divide(squares - items * n, items * n * (n - 1)) - chance, 1 - chance)
