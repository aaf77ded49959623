"""Exact similarity within bounded sets: nearest rows, pairs above a threshold, neighbourhoods, leader clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.functions.tables import cut
from dispatchlake.functions.vec import cosine

#: Rows of a block of the grid.
BLOCK = 2_000


def recall(df: DataFrame, query: Column, vector: str, k: int, floor: float | None = None, ties: str = "id") -> DataFrame:
    """The k rows most similar to one query vector, with ``similarity``; the floor holds after the limit, inclusive."""
    scored = df.withColumn("similarity", cosine(F.col(vector), query)).where("similarity is not null")
    top = scored.orderBy(F.desc("similarity"), ties).limit(k)
    return top if floor is None else top.where(F.col("similarity") >= floor)


def pairs_at_least(df: DataFrame, key: str, vector: str, least: float, window: tuple[str, float] | None = None) -> DataFrame:
    """(a, b, cosine) of all pairs a < b with a cosine of at least ``least``, blocks of rows against blocks.

    The rows of a set are compared with all others, so the set must be bounded: with ``window`` (time column in
    seconds, width) only rows at most so far apart are compared, through time buckets of that width. Null vectors and
    vectors of zeros are in no pair; vectors of different sizes aren't compared.
    """
    at = F.col(window[0]).cast("double") if window else F.lit(0.0)
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), at.alias("t"), F.size(vector).alias("d")).where("v is not null and d > 0 and t is not null").dropDuplicates(["id"])
    width = window[1] if window else 1.0
    rows = rows.withColumn("own", F.floor(F.col("t") / width))
    sizes = rows.groupBy("d", "own").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    rows = rows.join(sizes, ["d", "own"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    blocks = rows.select("d", "own", "part").distinct()
    left, right = (blocks.select("d", F.col("own").alias(f"o{n}"), F.col("part").alias(f"p{n}")) for n in (1, 2))
    reach = "o2 between o1 - 1 and o1 and (o2 < o1 or p2 <= p1)" if window else "p2 <= p1"
    meets = left.join(right, "d").where(reach)
    cell = ["d", "o1", "p1", "o2", "p2"]
    one, two = (rows.select("d", F.col("own").alias(f"o{n}"), F.col("part").alias(f"p{n}"), "id", "v", "t").join(meets, ["d", f"o{n}", f"p{n}"]).select(*cell, "id", "v", "t") for n in (1, 2))
    two = two.toDF(*two.columns)  # columns of its own, apart from those of the other side
    kind = df.schema[key].dataType.simpleString()

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["a", "b", "cosine"], dtype=object)
        x, y = (np.stack(f["v"].to_numpy()) for f in (left, right))
        nx, ny = (np.linalg.norm(z, axis=1) for z in (x, y))
        s = (x @ y.T) / np.maximum(np.outer(nx, ny), 1e-300)
        ok = (s >= least) & (nx > 0)[:, None] & (ny > 0)
        if window:
            ok &= np.abs(left["t"].to_numpy()[:, None] - right["t"].to_numpy()) <= width
        i, j = np.nonzero(ok)
        a, b = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        same_block = left[["o1", "p1"]].iloc[0].tolist() == left[["o2", "p2"]].iloc[0].tolist()
        keep = a < b if same_block else a != b
        a, b, c = a[keep], b[keep], s[i, j][keep]
        swap = a > b
        return pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "cosine": c})

    return one.groupBy(*cell).cogroup(two.groupBy(*cell)).applyInPandas(compare, f"a {kind}, b {kind}, cosine double")


def heat(df: DataFrame, key: str, vector: str, source: str, least: float, window: tuple[str, float] | None = None) -> DataFrame:
    """(key, heat): how many different sources report what is similar, each row's own among them."""
    pairs = pairs_at_least(df, key, vector, least, window).select("a", "b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = df.select(F.col(key).alias("b"), F.col(source).alias("source_")).where("b is not null")
    seen = both.join(own, "b").select("a", "source_").unionByName(own.select(F.col("b").alias("a"), "source_")).distinct()
    return seen.groupBy("a").agg(F.count("source_").alias("heat")).withColumnRenamed("a", key)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) with the least id of everything linked by edges (a, b): least labels spread, with pointer jumps."""
    links = edges.where("a <> b").select("a", "b")
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.least("root", "near").alias("to"), "root")
        jump = step.join(label.select(F.col("id").alias("to"), F.col("root").alias("further")), "to", "left")
        new = cut(jump.select("id", F.least("to", "further").alias("root"), (F.least("to", "further") < F.col("root")).alias("moved")))
        label = new.select("id", "root")
        if new.where("moved").isEmpty():
            return label


def leader_parents(df: DataFrame, pairs: DataFrame, key: str, at: str, fingerprint: str) -> DataFrame:
    """(key, parent, via) of items that join an earlier one, in order of time (undated last), then key.

    The parent is the first item with the same fingerprint, else the most similar earlier dated item of ``pairs``
    (a, b, cosine), ties to the earlier. As which item one joins doesn't depend on clusters, this is one pass; roots
    of the forest are the clusters' leaders.
    """
    when = F.coalesce(F.unix_micros(at), F.lit(2**62))
    place = df.select(F.col(key).alias("id"), F.struct(when.alias("t"), F.col(key).alias("k")).alias("place"), F.col(at).isNotNull().alias("dated"), F.col(fingerprint).alias("fp"))
    twins = place.groupBy("fp").agg(F.min("place").alias("first"))
    twin = place.join(twins, "fp").where("first < place").select("id", F.col("first.k").alias("twin"))
    both = pairs.select("a", "b", "cosine").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    p, q = place.select(F.col("id").alias("a"), F.col("place").alias("pa")), place.select(F.col("id").alias("b"), F.col("place").alias("pb"), F.col("dated").alias("db"))
    near = both.join(p, "a").join(q, "b").where("pb < pa and db").groupBy("a").agg(F.min(F.struct(-F.col("cosine"), "pb")).alias("best"))
    found = place.select("id").join(twin, "id", "left").join(near.select(F.col("a").alias("id"), F.col("best.pb.k").alias("near")), "id", "left")
    return found.where("twin is not null or near is not null").select(F.col("id").alias(key), F.coalesce("twin", "near").alias("parent"), F.when(F.col("twin").isNotNull(), "fingerprint").otherwise("vector").alias("via"))


def roots(parents: DataFrame, key: str) -> DataFrame:
    """(key, root) by pointer doubling over (key, parent)."""
    up = cut(parents.select(F.col(key).alias("id"), F.col("parent").alias("root")))
    while True:
        new = cut(up.join(up.select(F.col("id").alias("root"), F.col("root").alias("further")), "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        up = new.select("id", "root")
        if new.where("moved").isEmpty():
            return up.withColumnRenamed("id", key)
