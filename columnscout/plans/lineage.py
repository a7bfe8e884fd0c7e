"""Written stages: how iterative operators cut their lineage.

A stage is a parquet table below the folder that `spark.checkpoint.dir` names, which
all executors share, so it survives the loss of any executor. Only where a local session
has no such setting (tests) a folder below the warehouse is used.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for stages: the cluster's `spark.checkpoint.dir`, else one of our own below the warehouse, which on a cluster must not be a machine's own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and warehouse.startswith(("file:", "/")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse + "/stages"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended; the folder is the cluster's to clean then
        pass


_ROOTS: set[str] = set()


def release(spark: SparkSession) -> None:
    """Delete the stages of all runs so far; results that aren't written or collected by then can't be read any more."""
    while _ROOTS:
        _delete(spark, _ROOTS.pop())


def keep_until_release(spark: SparkSession, folder: str) -> None:
    """Have a folder deleted by `release`, or when the interpreter ends."""
    if not _ROOTS:
        atexit.register(release, spark)
    _ROOTS.add(folder)


class Stages:
    """The stages of one run of an operator, each written once and read by name.

    The folder is deleted by `release` or when the interpreter ends, since a lazy result may read
    it until then; `drop` deletes a stage that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/columnscout-{operator}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.written = 0
        keep_until_release(spark, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` as stage `name` and return a DataFrame that reads it. A name used again doesn't touch the earlier stage, which `df` may read."""
        self.written += 1
        path = self.paths[name] = f"{self.root}/{self.written}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete the latest stage of this name."""
        _delete(self.spark, self.paths.pop(name))
