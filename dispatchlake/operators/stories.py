"""Stories over days: snapshots, timelines, what was shown before, and assigning new reports to running stories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_between_snapshots(df: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    """Each snapshot with ``previous`` and ``rate``, the change for each day since it, a day at least."""
    w = Window.partitionBy(key).orderBy(at, tie)
    days = (F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))) / 86_400e6
    return df.where(F.col(value).isNotNull()).withColumn("previous", F.lag(value).over(w)).withColumn("rate", (F.col(value) - F.lag(value).over(w)) / F.greatest(days, F.lit(1.0)))


def timelines(links: DataFrame, thread: str, date: str, entry: list[str], least_days: int) -> DataFrame:
    """(thread, days, first_date, last_date, n, entries): of threads with enough different days, newest entries first."""
    rows = links.where(F.coalesce(date, F.lit("")) != "")
    each = rows.groupBy(thread).agg(
        F.countDistinct(date).alias("days"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.struct(date, *entry)), False).alias("entries"),
    )
    return each.where(F.col("days") >= least_days)


def shown_ledger(links: DataFrame, thread: str, date: str, headline: str, today: str, since: str) -> DataFrame:
    """(thread, days_prior, last_date, last_headline, linked_today) within the ledger's window."""
    rows = links.where(F.col(date) >= since)
    before = F.col(date) < today
    return rows.groupBy(thread).agg(
        F.countDistinct(F.when(before, F.col(date))).alias("days_prior"), F.max(F.when(before, F.col(date))).alias("last_date"),
        F.max_by(headline, F.when(before, F.struct(date, headline))).alias("last_headline"), F.max(F.col(date) >= today).alias("linked_today"),
    )


def dormant(threads: DataFrame, last_seen: str, status: str, now: Column, days: int) -> DataFrame:
    """Active threads not seen for so many days become dormant."""
    quiet = (F.col(status) == "active") & (F.unix_micros(last_seen) < F.unix_micros(now) - days * 86_400_000_000)
    return threads.withColumn(status, F.when(quiet, "dormant").otherwise(F.col(status)))


def assign_to_stories(reports: DataFrame, domain: str, order: list[str], key: str, subject: str, least: float = 0.5) -> DataFrame:
    """(domain, key, thread, is_new): reports of a domain in order, each joining the story with the closest subject or opening one.

    Every report may open the story that the next one joins, so a domain is one sequence; the day's batch of a domain
    is what the display limit leaves and small. Equal words or a subset count 1, else the share of common words; the
    latest story wins ties; a report without words opens its own.
    """
    kind = reports.schema[domain].dataType.simpleString()
    key_kind = reports.schema[key].dataType.simpleString()

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        stories: list[tuple[frozenset, str]] = []
        out = []
        for k, text in f.sort_values([*order, key])[[key, subject]].itertuples(index=False):
            words = frozenset((text or "").casefold().split())
            best, at = 0.0, None
            for n, (own, _) in enumerate(stories):
                common = len(words & own)
                score = 1.0 if words and own and (words <= own or own <= words) else common / max(1, len(words | own))
                if score >= max(best, 1e-9):
                    best, at = score, n
            new = at is None or best < least
            if new:
                stories.append((words, f"thr_{k}"))
                at = len(stories) - 1
            out.append((f[domain].iloc[0], k, stories[at][1], new))
        return pd.DataFrame(out, columns=[domain, key, "thread", "is_new"])

    return reports.groupBy(domain).applyInPandas(fold, f"{domain} {kind}, {key} {key_kind}, thread string, is_new boolean")
