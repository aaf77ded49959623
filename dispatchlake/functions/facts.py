"""Stored facts: JSON read by known keys, merged, and turned into traceable rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchlake.functions.ids import source_id

# Numbers that are facts, as kind, label, unit, type and field.
NUMBERS = (
    ("hn.points", "HN points", "points", "hn", "points"),
    ("hn.comments", "HN 评论数", "comments", "hn", "num_comments"),
    ("github.stars", "GitHub stars", "stars", "github", "stars"),
    ("github.forks", "GitHub forks", "forks", "github", "forks"),
)


def number(facts: Column, kind: str, field: str) -> Column:
    return F.try_variant_get(F.try_parse_json(facts), f"$.{kind}.{field}", "bigint")


def extract_facts(item: Column, facts: Column) -> Column:
    """array of struct(kind, label, value, unit, source_id) of the numbers that are there."""
    each = [
        F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), number(facts, t, f).alias("value"), F.lit(unit).alias("unit"), source_id(item, F.lit(t), F.lit(f)).alias("source_id"))
        for kind, label, unit, t, f in NUMBERS
    ]
    return F.filter(F.array(*each), lambda x: x["value"].isNotNull())


def as_map(facts: Column) -> Column:
    """Top-level keys with their JSON values; null for what is no object."""
    return F.when(F.startswith(F.trim(facts), F.lit("{")), F.transform_values(F.from_json(facts, "map<string,string>"), lambda k, v: v))


def merged(old: Column, new: Column) -> Column:
    """Keys of both, the new value where both have one; what is no object gives way."""
    a, b = as_map(old), as_map(new)
    both = F.map_from_entries(F.concat(F.filter(F.map_entries(a), lambda e: ~F.map_contains_key(b, e["key"])), F.map_entries(b)))
    return F.when(a.isNotNull() & b.isNotNull(), both).otherwise(F.coalesce(b, a))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """With ``token`` F1, F2 and so on in the given order: range by range, so that no task holds all rows."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id())
    sizes = spread.groupBy("part_").agg(F.count("*").alias("n_"))
    before = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))  # one row a partition
    nth = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return spread.withColumn("nth_", nth).join(F.broadcast(before), "part_").withColumn("token", F.concat(F.lit("F"), F.col("before_") + F.col("nth_"))).drop("part_", "before_", "nth_")


def fenced_json(reply: Column) -> Column:
    """A reply without the code fence that may stand around its JSON."""
    t = F.trim(F.coalesce(reply, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)^```(?:json)?\s*", ""), r"(?s)\s*```.*$", ""))


def validated_reply(reply: Column, cards: Column) -> Column:
    """struct(enough, answer, used): all three as said only if the reply is sure, says something and cites cards that exist."""
    out = F.from_json(fenced_json(reply), "enough boolean, answer string, used array<bigint>")
    answer = F.trim(F.coalesce(out["answer"], F.lit("")))
    ok = F.coalesce(out["enough"] & (answer != "") & (F.size(out["used"]) > 0) & F.forall(out["used"], lambda u: F.coalesce((u >= 1) & (u <= cards), F.lit(False))), F.lit(False))
    return F.struct(ok.alias("enough"), F.when(ok, answer).otherwise("").alias("answer"), F.when(ok, out["used"]).otherwise(F.array().cast("array<bigint>")).alias("used"))
