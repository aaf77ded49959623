"""Ranking of a window's events: clusters to events, heat, freshness and body gates, then the boards' quotas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchlake.functions import moments, text
from dispatchlake.operators import selection, similarity


@dataclass(frozen=True)
class Settings:
    clusters_per_board: int = 150
    same_event: float = 0.87
    fresh_hours: float = 24 * 14
    fast_hours: int = 6
    base_hours: int = 24
    most_velocity: float = 2.0
    least_body: int = 24
    category_cap: int = 8
    family_cap: int = 2
    limit: int = 10


def candidate_clusters(items: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(board, cluster_id) of each board's widest-reported, then newest clusters."""
    n = items.where("cluster_id is not null").select("source", "cluster_id", "fetched_at").join(sources.select(F.col("id").alias("source"), F.col("board_domain").alias("board")), "source")
    each = n.groupBy("board", "cluster_id").agg(F.countDistinct("source").alias("n"), F.max("fetched_at").alias("newest"))
    w = Window.partitionBy("board").orderBy(F.desc("n"), F.desc("newest"), "cluster_id")
    return each.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("board", "cluster_id")


def rank_events(items: DataFrame, sources: DataFrame, vectors: DataFrame, now: Column, s: Settings = Settings()) -> DataFrame:
    """(board, event, rank, heat, sources, item_seq): each board's chosen events with their representative item.

    ``vectors`` has one vector for an item. Clusters whose representatives are similar enough are one event; an event's
    board is the commonest among its members. Undated events are not fresh. Items of disabled and board-only sources
    are no members; the registry is a small table.
    """
    # No member from a disabled source or from one that has its own board only.
    out = sources.where("not enabled or board_only").select(F.col("id").alias("source"))
    items = items.join(F.broadcast(out), "source", "left_anti")
    chosen = candidate_clusters(items, sources, s.clusters_per_board).select("cluster_id").distinct()
    registry = sources.select(F.col("id").alias("source"), "board_domain", F.coalesce("weight", F.lit(0.5)).alias("weight"))
    members = items.join(chosen, "cluster_id", "left_semi").join(registry, "source", "left").select(
        "item_seq", "item_id", "cluster_id", "source", text.source_family(F.col("source")).alias("family"), "board_domain", F.coalesce("weight", F.lit(0.5)).alias("weight"),
        "category", "published_at", F.coalesce(F.length("content"), F.lit(0)).alias("size"), text.body_beyond_title(F.col("content"), F.col("title")).alias("beyond"),
    )
    longest = members.groupBy("cluster_id").agg(F.max_by("item_id", F.struct("size", -F.col("item_seq"))).alias("item_id"))
    pairs = similarity.pairs_at_least(longest.join(vectors.select("item_id", "embedding"), "item_id"), "cluster_id", "embedding", s.same_event)
    roots = similarity.components(pairs.select("a", "b")).select(F.col("id").alias("cluster_id"), F.col("root").alias("event"))
    rows = members.join(roots, "cluster_id", "left").withColumn("event", F.coalesce("event", "cluster_id"))

    peak = rows.groupBy("event").agg(
        F.max("published_at").alias("peak"), F.max(F.col("beyond") >= s.least_body).alias("has_body"), F.countDistinct("family").alias("sources"),
        F.max_by(F.struct("item_seq", "family", "category"), F.struct((F.col("size") >= 80).alias("b"), F.coalesce(F.unix_micros("published_at"), F.lit(-(2**62))).alias("t"), (-F.col("item_seq")).alias("i"))).alias("lead"),
    )
    votes = rows.where("board_domain is not null").groupBy("event", "board_domain").count()
    board = votes.groupBy("event").agg(F.min_by("board_domain", F.struct(-F.col("count"), "board_domain")).alias("board"))
    family = rows.where("family <> ''").groupBy("event", "family").agg(F.max("weight").alias("weight"), F.max("published_at").alias("newest")).join(peak.select("event", "peak"), "event")
    late = lambda h: F.count_if(F.unix_micros("newest") >= F.unix_micros("peak") - h * 3_600_000_000)
    force = family.groupBy("event").agg(F.sum("weight").alias("weighted"), late(s.fast_hours).alias("fast"), late(s.base_hours).alias("base"))
    velocity = F.when(F.col("base") > 0, F.least(F.col("fast") / F.col("base"), F.lit(s.most_velocity))).otherwise(0.0)
    events = peak.join(board, "event").join(force, "event").withColumn("heat", F.round(F.log1p("weighted") * (1 + velocity), 6))
    events = events.where(F.col("has_body") & moments.fresh_and_dated(F.col("peak"), now, F.lit(s.fresh_hours)))
    flat = events.select("board", "event", "heat", "sources", "lead.item_seq", F.coalesce("lead.family", F.lit("")).alias("family"), F.coalesce("lead.category", F.lit("")).alias("category"))
    kept = selection.quota_fold(flat, "board", "event", "heat", {"category": s.category_cap, "family": s.family_cap}, s.limit)
    return kept.join(flat.select("board", "event", "heat", "sources", "item_seq"), ["board", "event"])
