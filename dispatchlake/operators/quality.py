"""Checks of stored data as queries: each gives rows (check, value, threshold, level)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graded(measures: DataFrame, thresholds: dict[str, tuple[float, float]]) -> DataFrame:
    """``measures`` (one row) against (warn, fail) bounds: ok at or above warn, fail under fail, ungraded where null."""
    parts = []
    for name, (warn, fail) in thresholds.items():
        v = F.col(name).cast("double")
        level = F.when(v.isNull(), "ungraded").when(v >= warn, "ok").when(v >= fail, "warn").otherwise("fail")
        parts.append(measures.select(F.lit(name).alias("check"), F.round(v, 6).alias("value"), F.lit(float(warn)).alias("threshold"), level.alias("level")))
    return reduce(DataFrame.unionByName, parts)


def share(condition: str) -> F.Column:
    return F.avg(F.expr(condition).cast("int"))


def registry_checks(sources: DataFrame) -> DataFrame:
    m = sources.agg(share("enabled").alias("enabled"), share("region is not null").alias("has_region"), (F.countDistinct("id") / F.count("*")).alias("unique_ids"), share("weight between 0 and 1").alias("weights_in_range"))
    return graded(m, {"enabled": (0.9, 0.5), "has_region": (0.9, 0.5), "unique_ids": (1.0, 1.0), "weights_in_range": (1.0, 0.99)})


def card_checks(cards: DataFrame) -> DataFrame:
    live = cards.where("pruned_at is null")
    m = live.agg(share("length(headline) between 5 and 200").alias("headline_length"), share("length(coalesce(tldr_rendered, '')) >= 20").alias("has_text"), share("review_state = 'ok'").alias("reviewed"), share("not (coalesce(tldr_rendered, '') rlike '[{}]')").alias("no_braces"))
    return graded(m, {"headline_length": (0.99, 0.9), "has_text": (0.95, 0.8), "reviewed": (0.5, 0.1), "no_braces": (0.999, 0.99)})
