"""Session plumbing shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the cluster's shared checkpoint folder, so that lost executors cost no recomputation.

    The folder is the session's ``spark.checkpoint.dir``; only on one machine (a master ``local``, as in
    tests), where that is unset, a temporary one is used.
    """
    shared(df.sparkSession)
    return df.checkpoint()


def shared(spark: SparkSession) -> str:
    """The checkpoint folder, set if it was not."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def tidy(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark's cleaner deletes the shuffle files of tables that are written."""
    spark._jvm.System.gc()


class Scratch:
    """Tables in the shared checkpoint folder, in columns and compressed, for as long as a step needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written; what follows from it starts there."""
        self.paths.append(f"{shared(self.spark)}/scratch-{uuid.uuid4().hex}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self) -> None:
        """Deletes the tables; all that follows from them must be written by then."""
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """64-bit identity of a row: equal rows (same id, same text) share it, same ids with other texts don't."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def fold(column) -> F.Column:
    """crc32 of an id's decimal text, for held-out splits."""
    return F.crc32(column.cast("string").cast("binary"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df does not use (names are compared as Spark does, without case)."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name
