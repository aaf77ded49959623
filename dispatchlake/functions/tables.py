"""Reading the input tables, cutting lineage, and scratch tables of one run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which comes from ``spark.checkpoint.dir``; only a local session that has none gets one made."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that it survives the loss of an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


class Scratch:
    """Tables of one run of an operator, compressed and by column, in a folder of their own that is removed when it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        here = f"{self.path}/{self.n}"
        self.n += 1
        df.write.parquet(here)
        return self.spark.read.schema(df.schema).parquet(here)

    def end(self, df: DataFrame) -> DataFrame:
        """``df`` materialised without the tables, which are removed."""
        out = cut(df)
        remove(self.spark, self.path)
        return out
