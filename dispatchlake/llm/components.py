"""Groups of records from pairwise links: randomised graph contraction.

In each round every vertex hooks to the neighbour (or itself) that comes first in an order drawn by a fresh hash,
the edges are relabelled and deduplicated, and the round's mapping is kept. The number of vertices with an edge
falls by a constant factor a round; at the end the mappings are expanded from the last to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.functions.tables import cut, table

MAX_ROUNDS = 200


def _tidy(edges: DataFrame) -> DataFrame:
    """Undirected edges once each, least end first, without loops and nulls."""
    return edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_groups(edges: DataFrame) -> DataFrame:
    """(member, group) of every vertex of ``edges`` (a, b); group is the least member.

    Loops, repeated, swapped and null-ended edges add nothing; a vertex seen only in such edges is in no group.
    Other columns are ignored and empty input gives no rows. A vertex with any number of edges is safe: its
    neighbours are reduced by a partial minimum before the shuffle, and relabelling joins against unique keys.
    """
    left, maps = cut(_tidy(edges)), []
    for n in range(MAX_ROUNDS):
        if left.isEmpty():
            break
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(n * 7919 + 1), c), F.col(c))  # noqa: E731, B023
        first = both.groupBy("a").agg(F.min(order("b")).alias("low"))
        hook = F.least(F.struct(F.xxhash64(F.lit(n * 7919 + 1), "a").alias("h"), F.col("a").alias("v")), F.col("low").cast("struct<h:bigint,v:string>"))
        maps.append(step := cut(first.select(F.col("a").cast("string").alias("a"), hook["v"].alias("to"))))
        moved = step.where("a <> to")
        ends = left.join(moved.withColumnRenamed("to", "ta"), "a", "left").join(moved.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b", "left")
        left = cut(_tidy(ends.select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))))
    else:
        raise RuntimeError("the contraction did not end")
    if not maps:
        return edges.sparkSession.createDataFrame([], "member string, group string")
    total = maps[-1]
    for step in reversed(maps[:-1]):
        total = step.join(total.select(F.col("a").alias("to"), F.col("to").alias("root")), "to", "left").select("a", F.coalesce("root", "to").alias("to"))
    total = cut(total)
    least = total.groupBy("to").agg(F.min("a").alias("group"))
    return total.join(least, "to").select(F.col("a").alias("member"), "group")


def links(pairs: DataFrame, items: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges from confirmed pairs and from cluster memberships."""
    said = pairs.where("is_same").select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    member = items.where("cluster_id is not null").select(F.col("item_id").alias("a"), "cluster_id")
    heads = clusters.where("cluster_id is not null and first_item_id is not null").select("cluster_id", F.col("first_item_id").alias("b"))
    return said.unionByName(member.join(heads, "cluster_id").select("a", "b"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_found of TESTDATA.md."""
    edges = links(*(table(spark, sf_dir, t) for t in ("match_pairs", "news_items", "clusters")))
    return connected_groups(edges).where("member <> group").select(F.col("group").alias("group_item_id"), F.col("member").alias("item_id"))
