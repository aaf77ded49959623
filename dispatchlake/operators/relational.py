"""Writes as whole-table rewrites: the new state of a table from its old state and a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the greatest by ``order``; made by a partial maximum, so no key's rows meet in one place."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("row_")).select(*keys, *[F.col(f"row_.`{c}`").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], replace: Sequence[str] = (), if_given: Sequence[str] = (), rules: dict[str, Column] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in by ``keys``; both have the same columns and unique keys.

    For a key that both have, the columns of ``replace`` come from the new row, those of ``if_given`` too unless null
    there, those of ``rules`` from an expression over the columns of o and n, all others stay. Null keys match nothing.
    """
    rules = rules or {}
    o, n = old.alias("o").withColumn("o_", F.lit(True)), new.alias("n").withColumn("n_", F.lit(True))
    joined = o.alias("o").join(n.alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full")

    def value(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keys or c in if_given:
            both = F.coalesce(b, a)
        elif c in rules:
            both = rules[c]
        else:
            both = b if c in replace else a
        return F.when(F.col("o_").isNull(), b).when(F.col("n_").isNull(), a).otherwise(both).alias(c)

    return joined.select(*map(value, old.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and the first row of each key of ``new`` that it lacks; the first by all columns."""
    one = latest(new.select(old.columns), keys, [F.hash(*[c for c in old.columns if c not in keys])]) if len(old.columns) > len(keys) else new.select(old.columns).distinct()
    return old.unionByName(one.join(old.select(*keys), list(keys), "left_anti").select(old.columns))


def prune(old: DataFrame, keep: DataFrame, scope: Column, keys: Sequence[str]) -> DataFrame:
    """Without the rows in ``scope`` that aren't in ``keep``; with nothing to keep all of them go."""
    kept = keep.select(*keys).distinct().withColumn("keep_", F.lit(True))
    return old.join(kept, list(keys), "left").where(~F.coalesce(scope, F.lit(False)) | F.col("keep_")).select(old.columns)


def soft_prune(old: DataFrame, keep: DataFrame, scope: Column, keys: Sequence[str], at: Column, column: str = "pruned_at") -> DataFrame:
    """Marks live rows in ``scope`` that aren't in ``keep`` as pruned; with nothing to keep nothing changes."""
    kept = keep.select(*keys).distinct().withColumn("keep_", F.lit(True))
    some = kept.limit(1).select(F.lit(True).alias("some_")).agg(F.count("*").alias("some_"))
    goes = F.coalesce(scope, F.lit(False)) & F.col("keep_").isNull() & F.col(column).isNull() & (F.col("some_") > 0)
    joined = old.join(kept, list(keys), "left").join(F.broadcast(some))  # one row
    return joined.select(*[F.when(goes, at).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in old.columns])


def head_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: Column | int) -> DataFrame:
    """The first ``n`` rows of each group."""
    from pyspark.sql import Window

    ranked = df.withColumn("rn_", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("rn_") <= n).drop("rn_")


def first_of_union(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Union in which the earliest part that has a key wins; inside a part, any of equal rows."""
    tagged = [p.withColumn("part_", F.lit(i)) for i, p in enumerate(parts)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    rest = [c for c in every.columns if c not in (key, "part_")]
    best = every.groupBy(key).agg(F.min_by(F.struct(*rest, "part_"), F.struct("part_", *rest)).alias("row_"))
    return best.select(key, *[F.col(f"row_.{c}").alias(c) for c in rest], F.col("row_.part_").alias("part"))
