"""Relations by path, kept in the session while they are worked on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Relations:
    """Reads a relation once and keeps it cached (memory and disk) until `clear`; DataFrames are immutable, so no copies are needed."""

    def __init__(self, spark: SparkSession, read: Callable[[SparkSession, str], DataFrame] | None = None):
        self.spark = spark
        self.read = read or (lambda s, p: s.read.parquet(p))
        self.held: dict[str, DataFrame] = {}

    def get(self, path: str) -> DataFrame:
        if path not in self.held:
            self.held[path] = self.read(self.spark, path).cache()
        return self.held[path]

    def clear(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()
