"""Greedy choices in score order, as folds inside the JVM, and verdicts of pluggable judges."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchlake.functions.tables import cut


def quota_fold(df: DataFrame, group: str, key: str, score: str, caps: dict[str, int], limit: int, flags: dict[str, int] | None = None) -> DataFrame:
    """(group, key, rank): rows taken greedily, score descending, then key, while each column's cap and the limit allow.

    ``caps`` bounds how many kept rows share a value of a column, ``flags`` how many have a true column. A row that is
    passed over uses up nothing. Rows alike in all capped columns are passed over alike, so only the first ones of each
    combination enter the fold; that is exact and bounds what is gathered for a group by its combinations.
    """
    flags = flags or {}
    like = [group, *caps, *flags]
    most = min([limit, *caps.values()])
    first = df.withColumn("rn_", F.row_number().over(Window.partitionBy(*like).orderBy(F.desc(score), key))).where(F.col("rn_") <= most)
    entry = F.struct((-F.col(score)).alias("s_"), F.col(key).alias("k_"), *caps, *flags)
    rows = first.groupBy(group).agg(F.array_sort(F.collect_list(entry)).alias("all_"))

    def alike(kept: Column, e: Column, c: str) -> Column:
        return F.size(F.filter(kept, lambda z: z[c].eqNullSafe(e[c])))

    def flagged(kept: Column, c: str) -> Column:
        return F.size(F.filter(kept, lambda z: F.coalesce(z[c], F.lit(False))))

    def step(kept: Column, e: Column) -> Column:
        ok = F.size(kept) < limit
        for c, n in caps.items():
            ok = ok & (alike(kept, e, c) < n)
        for c, n in flags.items():
            ok = ok & (~F.coalesce(e[c], F.lit(False)) | (flagged(kept, c) < n))
        return F.when(ok, F.array_append(kept, e)).otherwise(kept)

    kept = F.aggregate("all_", F.slice("all_", 1, 0), step)
    return rows.select(group, F.posexplode(kept).alias("pos_", "e_")).select(group, F.col("e_.k_").alias(key), (F.col("pos_") + 1).alias("rank"))


def diverse_fold(df: DataFrame, group: str, key: str, score: str, tokens: str, limit: int, step: int = 300) -> DataFrame:
    """(group, key, rank): rows taken in score order unless they share a token with one taken before.

    Groups are folded in steps of their next ``step`` rows that share no token with those taken, until each has its
    limit or no rows are left; so no group is gathered whole.
    """
    kind = dict(df.dtypes)
    left = cut(df.select(group, key, F.col(score).alias("s_"), F.coalesce(F.col(tokens), F.array().cast(kind[tokens])).alias("t_")))
    taken: DataFrame | None = None
    fold = lambda kept, e: F.when((F.size(kept) < limit) & ~F.exists(kept, lambda z: F.arrays_overlap(z["t_"], e["t_"])), F.array_append(kept, e)).otherwise(kept)
    empty = F.array().cast(f"array<struct<s_:{kind[score]},k_:{kind[key]},t_:{kind[tokens]}>>")
    while not left.isEmpty():
        near = left.withColumn("rn_", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("s_"), key))).where(F.col("rn_") <= step)
        rows = near.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col("s_")).alias("s_"), F.col(key).alias("k_"), F.col("t_")))).alias("all_"), F.max("rn_").alias("n_"))
        if taken is not None:
            rows = rows.join(taken.select(group, "kept_"), group, "left")
        rows = rows.withColumn("kept_", F.aggregate("all_", F.coalesce("kept_", empty) if taken is not None else empty, fold))
        last = rows.select(group, "kept_", F.element_at("all_", -1)["s_"].alias("ls_"), F.element_at("all_", -1)["k_"].alias("lk_"))
        new = cut(last)
        open_ = new.where(F.size("kept_") < limit)
        if taken is not None:
            new = new.unionByName(taken.join(new.select(group), group, "left_anti"))
        taken = cut(new)
        left = cut(left.join(open_.select(group, "kept_", "ls_", "lk_"), group).where((-F.col("s_") > F.col("ls_")) | (-F.col("s_") == F.col("ls_")) & (F.col(key) > F.col("lk_"))).where(~F.exists("kept_", lambda z: F.arrays_overlap(z["t_"], F.col("t_")))).select(group, key, "s_", "t_"))
    if taken is None:
        return df.select(group, key, F.lit(0).alias("rank")).limit(0)
    return taken.select(group, F.posexplode("kept_").alias("pos_", "e_")).select(group, F.col("e_.k_").alias(key), (F.col("pos_") + 1).alias("rank"))


@dataclass(frozen=True)
class Gate:
    """What becomes of a row whose votes failed, that the budget didn't reach, and that is outside the head."""

    votes: int = 3
    on_error: bool = True
    on_budget: bool = True
    tail: bool = True
    head: int | None = None
    budget: int | None = None


def through_gate(df: DataFrame, votes: DataFrame, gate: Gate, group: str, key: str, score: str) -> DataFrame:
    """``df`` with a column ``kept``. ``votes``: key, vote (boolean; null is a failed one), any number of rows for a key.

    A strict majority of gate.votes for "drop" (false) drops, else a failed vote decides by on_error; rows beyond the
    budget, in score order over all groups, by on_budget; rows outside the group's head by tail.
    """
    order = [F.desc(score), key]
    tally = votes.groupBy(key).agg(F.sum(F.when(~F.col("vote"), 1).otherwise(0)).alias("no_"), F.sum(F.when(F.col("vote"), 1).otherwise(0)).alias("yes_"))
    ranked = df.withColumn("rn_", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    ranked = ranked.join(tally, key, "left").withColumn("head_", F.lit(True) if gate.head is None else F.col("rn_") <= gate.head)
    need = gate.votes // 2 + 1
    if gate.budget is None:
        reached = F.lit(True)
    else:  # the budget is a small number of judged rows: they are counted in one order
        judged = ranked.where("head_").select(key, score).orderBy(*order).limit(gate.budget).select(key, F.lit(True).alias("paid_"))
        ranked = ranked.join(judged, key, "left")
        reached = F.coalesce("paid_", F.lit(False))
    verdict = F.when(F.coalesce("no_", F.lit(0)) >= need, False).when(F.coalesce("yes_", F.lit(0)) >= need, True).otherwise(gate.on_error)
    kept = F.when(~F.col("head_"), gate.tail).when(~reached, gate.on_budget).otherwise(verdict)
    return ranked.withColumn("kept", kept).select(*df.columns, "kept")


class PermanentError(Exception):
    """An outside service that will not answer again, such as one that refuses payment: it ends the run."""


#: Texts judged at a time in one task.
WORKERS = 5


def judge(rows: DataFrame, key: str, text: str, verdict: Callable[[str], bool], cache: DataFrame | None = None) -> DataFrame:
    """(key, hash, vote, clean): each text judged once by a plain function; cached verdicts (hash, vote) aren't asked again.

    Any error but PermanentError, which fails the job, is a failed vote: null and not clean, so that it isn't cached.
    """
    hashed = rows.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("hash"), F.coalesce(text, F.lit("")).alias("text_"))
    todo = hashed.select("hash", "text_").dropDuplicates(["hash"])
    if cache is not None:
        todo = todo.join(cache.select("hash"), "hash", "left_anti")

    def one(t: str) -> bool | None:
        try:
            return bool(verdict(t))
        except PermanentError:
            raise
        except Exception:  # a failed vote is data: the gate says what it means
            return None

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(WORKERS) as pool:
            for f in frames:
                votes = list(pool.map(one, f["text_"]))
                yield pd.DataFrame({"hash": f["hash"], "vote": pd.array(votes, dtype="boolean"), "clean": [v is not None for v in votes]})

    told = todo.mapInPandas(ask, "hash string, vote boolean, clean boolean")
    if cache is not None:
        told = told.unionByName(cache.select("hash", "vote", F.lit(True).alias("clean")))
    return hashed.select(key, "hash").join(told, "hash").select(key, "hash", "vote", "clean")


def cacheable(told: DataFrame) -> DataFrame:
    """(hash, vote) of verdicts that may be kept: every vote on the text was clean."""
    return told.groupBy("hash").agg(F.bool_and("clean").alias("clean"), F.first("vote", True).alias("vote")).where("clean").select("hash", "vote")


def same_pairs(pairs: DataFrame, texts: DataFrame, verdict: Callable[[str, str], bool], budget: int | None = None) -> DataFrame:
    """(a, b) of the pairs judged to be one event. ``pairs``: a, b, place; ``texts``: id, text.

    The two sides are put in order, so that a pair and its mirror are judged once; a failed verdict counts as different,
    and so do pairs beyond the budget, in the order of a and place.
    """
    if budget is not None:
        pairs = pairs.orderBy("a", "place").limit(budget)
    sides = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    asked = sides.select("a", "b", F.to_json(F.array(F.least("ta", "tb"), F.greatest("ta", "tb"))).alias("both"))
    told = judge(asked.select(F.struct("a", "b").alias("ab"), "both"), "ab", "both", lambda t: verdict(*json.loads(t)))
    return told.where("vote").select("ab.a", "ab.b")


def majority_label(votes: DataFrame, key: str, label: str, needed: int, active: Sequence[str], confidence: str, least: float) -> DataFrame:
    """(key, label) where one active label has ``needed`` votes of enough confidence; all else is dropped."""
    good = votes.where(F.col(label).isin(list(active)) & (F.col(confidence) >= least)).groupBy(key, label).agg(F.count("*").alias("n_"))
    return good.where(F.col("n_") >= needed).groupBy(key).agg(F.max_by(label, F.struct("n_", label)).alias(label))
