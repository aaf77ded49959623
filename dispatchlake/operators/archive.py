"""Day snapshots: the truth of each day as partitioned JSON, an index over the days, and taking older days in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_days(rows: DataFrame, path: str) -> None:
    """Rows with ``date`` as JSON files by date; a date that is written again replaces its files, others stay."""
    rows.write.partitionBy("date").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def read_days(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def day_index(rows: DataFrame, label: str, headline: str, order: str) -> DataFrame:
    """(date, n, labels, top_headline) newest first."""
    each = rows.groupBy("date").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(label)).alias("labels"), F.min_by(headline, order).alias("top_headline"))
    return each.orderBy(F.desc("date"))


def merge_days(new: DataFrame, old: DataFrame, label: str, url: str) -> DataFrame:
    """Days of ``new`` that ``old`` lacks; within a date and label one row for each address that isn't empty, all without."""
    missing = new.join(old.select("date").distinct(), "date", "left_anti")
    given = F.coalesce(F.col(url), F.lit("")) != ""
    return missing.where(given).dropDuplicates(["date", label, url]).unionByName(missing.where(~given))


def highlighted(text: Column, needle: str) -> Column:
    """Every occurrence of a literal, whatever its case, between marks."""
    quoted = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in needle)
    return F.regexp_replace(text, f"(?iu)({quoted})", "<mark>$1</mark>") if needle else text


def escaped_markdown(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "*_~`<>[]", "")


def digest_lines(rows: DataFrame, group: str, order: str, headline: str, source: str, most: int = 12) -> DataFrame:
    """(group, body): the first rows of a group as numbered lines of a message."""
    from pyspark.sql import Window

    ranked = rows.withColumn("rn_", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("rn_") <= most)
    line = F.format_string("%d. %s (%s)", F.col("rn_"), escaped_markdown(F.col(headline)), F.coalesce(F.col(source), F.lit("")))
    return ranked.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn_", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
