"""Token usage, cost and throughput."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.metrics import ratio

def words(text: Column) -> Column:
    """Words of a text, standing in for its tokens; 0 for null and blank ones."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def rate(model: Column, rates: Mapping[str, tuple[float, float]], which: int) -> Column:
    """Rate per million tokens (in 0, out 1) of the longest prefix that a model's name begins with; null if none does."""
    found: Column = F.lit(None).cast("double")
    for prefix in sorted(rates, key=len):
        found = F.when(model.startswith(prefix), F.lit(rates[prefix][which])).otherwise(found)
    return found


def usage(calls: DataFrame, rates: Mapping[str, tuple[float, float]], by: tuple[str, ...] = ("dataset", "model")) -> DataFrame:
    """Calls, tokens in and out, per item, and cost in total and per thousand calls; unknown models have no cost.

    ``calls`` has model, tokens_in and tokens_out.  Costs are not rounded.
    """
    per = calls.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("input_tokens"), F.sum("tokens_out").alias("output_tokens"))
    usd = (F.col("input_tokens") * rate(F.col("model"), rates, 0) + F.col("output_tokens") * rate(F.col("model"), rates, 1)) / 1e6
    return per.select(*by, "calls", "input_tokens", "output_tokens", ratio(F.col("input_tokens"), F.col("calls")).alias("input_tokens_per_item"), ratio(F.col("output_tokens"), F.col("calls")).alias("output_tokens_per_item"), usd.alias("cost_usd"), F.try_divide(1000 * usd, F.col("calls")).alias("cost_usd_per_1k"))


def throughput(timed: DataFrame, by: str = "model") -> DataFrame:
    """Calls, mean seconds and the harmonic mean of items per second; times of zero or less are left out."""
    kept = timed.where("seconds > 0")
    return kept.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.round(F.count("*") / F.sum("seconds"), 6).alias("items_per_second"))


def api_usage(calls: DataFrame, by: str) -> DataFrame:
    """Calls, errors, tokens in and out with their means per call to two places, and seconds to one, per ``by``.

    ``calls`` has failed (flag), tokens_in, tokens_out and seconds; nulls count as nothing.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    per = calls.groupBy(by).agg(F.count("*").alias("calls"), F.count_if("failed").alias("api_errors"), total("tokens_in").alias("input_tokens"), total("tokens_out").alias("output_tokens"), F.round(total("seconds"), 1).alias("wall_seconds"))
    each = lambda c: F.round(F.col(c) / F.col("calls"), 2).alias(f"{c}_per_item")
    return per.select("*", each("input_tokens"), each("output_tokens"))
