"""Structured Streaming in front of the batch tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.functions.tables import cut, table


def _folder(spark: SparkSession, name: str) -> str:
    cut(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str, late: str = "2 hours") -> DataFrame:
    """The events table read as a stream of files with a watermark; rows without a time go no further."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "false")
    rows = stream.parquet(f"{sf_dir}/events.parquet" if _is_folder(spark, f"{sf_dir}/events.parquet") else f"{sf_dir}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null").withWatermark("ts", late)


def _is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


def run_to_end(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All that the stream holds now, through the sink of a finished run; complete results replace each other."""
    spark, out = stream.sparkSession, _folder(stream.sparkSession, name)

    def put(batch: DataFrame, n: int) -> None:  # a repeated batch writes the same place again
        batch.write.mode("overwrite").parquet(f"{out}/data/{'all' if mode == 'complete' else n}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema(stream.schema).parquet(f"{out}/data")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = events(spark, sf_dir).groupBy("event_type", F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return run_to_end(each.select("event_type", F.unix_micros("window.start").alias("hour_us"), "n", "total"), "hourly", "complete")


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, event_type, k): the least event of each key; the state is one row a key."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    first = rows.groupBy("user_id", "event_type", "k").agg(F.min("event_id").alias("event_id"))
    return run_to_end(first.select("event_id", "user_id", "event_type", "k"), "first", "complete")


def deduplicated(stream: DataFrame, keys: list[str], at: str, window: str) -> DataFrame:
    """Each key once within the window, for streams of fingerprints."""
    return stream.withWatermark(at, window).dropDuplicatesWithinWatermark(keys)
