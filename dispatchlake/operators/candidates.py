"""Which pairs of groups, which running stories and which representatives are worth a closer look."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchlake.functions import text, vec
from dispatchlake.functions.tables import cut
from dispatchlake.operators.similarity import pairs_at_least

#: Rows, in key order, whose first close ones are looked for among themselves and as many after them; later rounds take STRIDE times as many.
NEARBY, STRIDE = 1024, 16


def token_pairs(df: DataFrame, key: str, tokens: str, least: float) -> DataFrame:
    """(a, b), a < b: rows whose token sets are equal, one within the other, or alike by Jaccard of at least ``least``.

    Rows meet on the rarest tokens of one of them, which is exact and leaves common words out. Null and empty sets are
    close to nothing.
    """
    rows = df.where(F.size(tokens) > 0).select(F.col(key).alias("k"), F.array_distinct(tokens).alias("t"))
    each = rows.select("k", F.size("t").alias("n"), F.explode("t").alias("w"))
    # The rarest tokens of a set, of which a close one must hold at least one.
    ranked = each.join(each.groupBy("w").agg(F.count("*").alias("held")), "w")
    asks = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("held", "w"))).where(f"rn <= n - ceil({least} * n) + 1")
    meets = asks.select("k", "w").join(each.select(F.col("k").alias("o"), "w"), "w").where("k <> o").select(F.least("k", "o").alias("a"), F.greatest("k", "o").alias("b")).distinct()
    both = meets.join(rows.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(rows.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
    c, n, m = F.size(F.array_intersect("ta", "tb")), F.size("ta"), F.size("tb")
    return both.where((c == F.least(n, m)) | (c / (n + m - c) >= least)).select("a", "b")


def first_close(df: DataFrame, key: str, tokens: str, least: float, top: int) -> DataFrame:
    """(a, b, place): for each row the ``top`` first in key order of the later rows that ``token_pairs`` would give it.

    Rounds look ahead further and further, and a row takes part until it has ``top`` or has met the end. The first
    compares whole stretches of the order; the others meet on words, Jaccard's on the rarest of both rows and those of a
    set within another on the rarest of the inner one, so that what the few rows left need is all that is formed.
    """
    rows = df.where(F.size(tokens) > 0).select(F.col(key).alias("k"), F.array_distinct(tokens).alias("t")).distinct()
    rows = cut(rows.orderBy("k", "t").select("k", "t", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("id")))
    sizes = {r["p"]: r["count"] for r in rows.groupBy("p").count().toLocalIterator()}  # one number a partition
    total, begins = 0, []
    for p in sorted(sizes):
        begins.append((p, total))
        total += sizes[p]
    if not total:
        return rows.select(F.col("k").alias("a"), F.col("k").alias("b"), F.lit(1).cast("long").alias("place"))
    begin = df.sparkSession.createDataFrame(begins, "p int, begin long")
    rows = rows.join(F.broadcast(begin), "p").select("k", "t", (F.col("begin") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("r"))
    kind = dict(rows.dtypes)["k"]

    width = NEARBY
    both = rows.select("k", "t", "r", F.inline(F.array(*(F.struct((F.floor(F.col("r") / width) - i).alias("stretch"), F.lit(i == 0).alias("asks")) for i in (0, 1)))))
    found = cut(both.groupBy("stretch").applyInPandas(lambda f: _first_of_stretch(f, least, top), f"a {kind}, b {kind}, ra long, rb long"))
    out, left = [], rows
    ranked = None
    while True:
        n = found.groupBy(F.col("ra").alias("r")).count()
        ends = (F.floor(F.col("r") / width) + 2) * width
        done = left.join(n, "r", "left").withColumn("done", (F.coalesce("count", F.lit(0)) >= top) | (ends >= total))
        out.append(found.join(done.where("done").select(F.col("r").alias("ra")), "ra", "left_semi"))
        left = cut(done.where("not done").select("k", "t", "r"))
        if left.isEmpty():
            break
        width *= STRIDE
        if ranked is None:
            each = rows.select("r", F.size("t").alias("n"), F.explode("t").alias("w"))
            rn = F.row_number().over(Window.partitionBy("r").orderBy("held", "w"))
            ranked = cut(each.join(each.groupBy("w").agg(F.count("*").alias("held")), "w").select("r", "w", rn.alias("rn"), (F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).alias("most")))
        bucket = F.floor(F.col("r") / width)
        asks = ranked.join(left.select("r"), "r", "left_semi").select(F.col("r").alias("ra"), "w", F.col("rn").alias("rn_a"), F.col("most").alias("most_a"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
        meets = asks.join(ranked.withColumn("bucket", bucket), ["w", "bucket"]).where("r > ra and (rn_a <= most_a and rn <= most or rn_a = 1 or rn = 1)").select("ra", F.col("r").alias("rb")).distinct()
        pairs = meets.join(left.select(F.col("r").alias("ra"), F.col("k").alias("a"), F.col("t").alias("ta")), "ra").join(rows.select(F.col("r").alias("rb"), F.col("k").alias("b"), F.col("t").alias("tb")), "rb")
        c, n, m = F.size(F.array_intersect("ta", "tb")), F.size("ta"), F.size("tb")
        found = cut(_placed(pairs.where("a < b").where((c == F.least(n, m)) | (c / (n + m - c) >= least)), top).select("a", "b", "ra", "rb"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return _placed(whole, top).select("a", "b", "place")


def _placed(pairs: DataFrame, top: int) -> DataFrame:
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("ra").orderBy("rb")).cast("long")).where(f"place <= {top}")


def _first_of_stretch(f: pd.DataFrame, least: float, top: int) -> pd.DataFrame:
    """(a, b, ra, rb): of each asking row the first ``top`` close ones after it in the stretch."""
    f = f.sort_values("r", ignore_index=True)
    size = f["t"].map(len).to_numpy(np.int64)
    word, _ = pd.factorize(np.concatenate(f["t"].to_numpy()))
    at = np.repeat(np.arange(len(f)), size)
    order = np.argsort(word, kind="stable")
    holders = np.split(at[order], np.cumsum(np.bincount(word))[:-1])  # of each word the rows, in order
    words = np.split(word, np.cumsum(size)[:-1])
    key, rank = f["k"].to_numpy(), f["r"].to_numpy()
    out: list[tuple] = []
    for i in np.flatnonzero(f["asks"]):
        common = np.bincount(np.concatenate([holders[w] for w in words[i]]), minlength=len(f))[i + 1 :]
        other = size[i + 1 :]
        close = (common > 0) & ((common == np.minimum(size[i], other)) | (common / (size[i] + other - common) >= least))
        later: Iterator[int] = (j + i + 1 for j in np.flatnonzero(close) if key[j + i + 1] != key[i])
        out += [(key[i], key[j], rank[i], rank[j]) for j, _ in zip(later, range(top))]
    return pd.DataFrame(out, columns=["a", "b", "ra", "rb"])


def surface_candidates(df: DataFrame, key: str, subject: Column, vector: str, jaccard: float = 0.5, cosine: float = 0.55, top: int = 8, most: int | None = None) -> DataFrame:
    """(a, b, score, place): for each row, in key order, the later rows with a close subject (score 1) or a near vector.

    The ``top`` best of each row, ties in key order; of all these the first ``most`` in the order of (a, place). Rows
    without a subject or vector are compared by the other alone. The vector arm takes the rows in blocks, for the
    bounded set of one run.
    """
    rows = df.withColumn("t_", text.subject_tokens(subject))
    lexical = token_pairs(rows, key, "t_", jaccard).withColumn("score", F.lit(1.0))
    semantic = pairs_at_least(df.where(F.col(vector).isNotNull()), key, vector, cosine).select("a", "b", F.col("cosine").alias("score"))
    best = lexical.unionByName(semantic).groupBy("a", "b").agg(F.max("score").alias("score"))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).where(f"place <= {top}")
    return placed if most is None else placed.orderBy("a", "place").limit(most)


def hot_representatives(df: DataFrame, key: str, heat: str, vector: str, threshold: float, min_sources: int, top: int) -> DataFrame:
    """(key, place): hottest first, those whose vector is not within ``threshold`` of one already chosen; ``top`` at most.

    Only rows hot enough enter. Near pairs are found once, in blocks; the choice is a fold in order of heat over each
    row's hotter neighbours, ties by key.
    """
    order = F.struct((-F.col(heat)).alias("h"), F.col(key).alias("k"))
    hot = cut(df.where(F.col(heat) >= min_sources).select(key, heat, vector))
    near = cut(pairs_at_least(hot, key, vector, threshold).select("a", "b"))
    rank = hot.select(F.col(key).alias("k"), order.alias("o"))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    before = both.join(rank.select(F.col("k").alias("a"), F.col("o").alias("oa")), "a").join(rank.select(F.col("k").alias("b"), F.col("o").alias("ob")), "b").where("ob < oa")
    lists = before.groupBy(F.col("a").alias("k")).agg(F.collect_set("b").alias("hotter"))
    rows = rank.join(lists, "k", "left").select("k", "o", F.coalesce("hotter", F.array().cast("array<bigint>") if dict(df.dtypes)[key] == "bigint" else F.array().cast("array<string>")).alias("hotter"))
    entry = F.array_sort(F.collect_list(F.struct("o", "hotter")))
    kept = F.aggregate(
        "all_", F.slice(F.transform("all_", lambda e: e["o"]["k"]), 1, 0),
        lambda k, e: F.when((F.size(k) < top) & ~F.arrays_overlap(k, e["hotter"]), F.array_append(k, e["o"]["k"])).otherwise(k),
    )
    # One row: the hot rows of one window of hours, which min_sources bounds.
    return rows.agg(entry.alias("all_")).select(F.posexplode(kept).alias("p", key)).select(key, (F.col("p") + 1).alias("place"))


def candidate_stories(asks: DataFrame, stories: DataFrame, match: float = 0.5, semantic: float = 1.1, top: int = 0) -> DataFrame:
    """(ask_id, story_id, by): stories with a close subject, and of the others the ``top`` nearest of at least ``semantic``.

    ``asks``: ask_id, subject, vec; ``stories``: story_id, subject, vec (the active ones). Without vectors, or with
    ``top`` 0, the words alone decide; empty subjects are close to nothing.
    """
    a = asks.select(F.concat(F.lit("a"), F.col("ask_id").cast("string")).alias("k"), text.subject_tokens(F.col("subject")).alias("t"))
    s = stories.select(F.concat(F.lit("s"), F.col("story_id").cast("string")).alias("k"), text.subject_tokens(F.col("subject")).alias("t"))
    close = token_pairs(a.unionByName(s), "k", "t", match).where("a like 'a%' and b like 's%'")
    names = asks.select("ask_id", F.concat(F.lit("a"), F.col("ask_id").cast("string")).alias("a")), stories.select("story_id", F.concat(F.lit("s"), F.col("story_id").cast("string")).alias("b"))
    lexical = close.join(names[0], "a").join(names[1], "b").select("ask_id", "story_id", F.lit("words").alias("by"))
    if not top:
        return lexical
    # Active stories of a domain are a bounded set: those of the last days.
    both = asks.where("vec is not null").select("ask_id", F.col("vec").alias("va")).join(F.broadcast(stories.where("vec is not null").select("story_id", F.col("vec").alias("vb"))))
    near = both.join(lexical, ["ask_id", "story_id"], "left_anti").withColumn("sim", vec.cosine(F.col("va"), F.col("vb"))).where(f"sim >= {semantic}")
    ranked = near.withColumn("rn", F.row_number().over(Window.partitionBy("ask_id").orderBy(F.desc("sim"), "story_id"))).where(f"rn <= {top}")
    return lexical.unionByName(ranked.select("ask_id", "story_id", F.lit("vector").alias("by")))


def corroboration(rows: DataFrame, clusters: DataFrame, heats: DataFrame) -> DataFrame:
    """(item_id, corroboration): the greatest of 1, the sources of the item's cluster and its heat."""
    j = rows.select("item_id", "cluster_id").distinct().join(clusters.select("cluster_id", "source_count"), "cluster_id", "left").join(heats.select("item_id", "heat"), "item_id", "left")
    return j.groupBy("item_id").agg(F.greatest(F.lit(1), F.max(F.coalesce("source_count", F.lit(1))), F.max(F.coalesce("heat", F.lit(1)))).cast("long").alias("corroboration"))


def relevance(centroids: DataFrame, topics: DataFrame) -> DataFrame:
    """(event_id, topic, relevance): product of the unit centroid with each topic's unit vector; topics are a small registry."""
    return centroids.select("event_id", "vec").join(F.broadcast(topics.select("topic", F.col("vec").alias("tv")))).select("event_id", "topic", vec.cosine(F.col("vec"), F.col("tv")).alias("relevance"))
