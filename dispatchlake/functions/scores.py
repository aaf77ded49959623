"""Scores and simple gates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def velocity(recent: Column, base: Column, most: float) -> Column:
    """Recent sources over those of the base window, within 0 and ``most``; 0 without any."""
    return F.when(base > 0, F.greatest(F.lit(0.0), F.least(recent / base, F.lit(most)))).otherwise(0.0)


def heat(weighted: Column, speed: Column, bonus: Column | float = 0.0) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), weighted)) * (1 + F.greatest(F.lit(0.0), speed)) + bonus


def recency(age_hours: Column, fresh_hours: Column) -> Column:
    """1 for new, 0 at the end of freshness; 0 without an age or with no freshness."""
    return F.coalesce(F.when(fresh_hours > 0, F.greatest(F.lit(0.0), 1 - age_hours / fresh_hours)), F.lit(0.0))


def weighted_sum(parts: dict[str, tuple[float, Column]]) -> Column:
    total = F.lit(0.0)
    for weight, part in parts.values():
        total = total + weight * part
    return total


def blend(judged: Column, rule: Column, share: float = 0.6) -> Column:
    """A judge's score and the rule's; the rule's alone where nothing was judged."""
    return F.coalesce(share * judged + (1 - share) * rule, rule)


def names_any(text: Column, names: list[str]) -> Column:
    found = F.lit(False)
    for n in names:
        found = found | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(n.lower()))
    return found


def relevance_gate(relevance: Column, listed: Column, least: float = 0.5, least_listed: float = 0.3) -> Column:
    return F.coalesce(relevance >= F.when(listed, least_listed).otherwise(least), F.lit(False))


def best_key(relevance: Column) -> Column:
    """Key of the greatest value of a map, the first by name of equals; null for an empty map."""
    ordered = F.array_sort(F.transform(F.map_entries(relevance), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.when(F.size(ordered) > 0, F.element_at(ordered, 1)["k"])


def pair_key(a: Column, b: Column, *more: Column) -> Column:
    """A cache key of two texts that doesn't depend on their order, with the judge's settings."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.sha2(F.concat_ws("\x1f", F.least(x, y), F.greatest(x, y), *more), 256)


def age_label(age_hours: Column) -> Column:
    return F.concat(F.greatest(F.floor(age_hours), F.lit(0)).cast("string"), F.lit("h"))
