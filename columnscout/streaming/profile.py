"""Incremental profiles: cells that arrive as a stream keep running statistics and mergeable sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnscout.functions.numbers import to_number


def batch_sketch(cells: DataFrame) -> DataFrame:
    """(nid, total, distinct_sketch, quantile_sketch, min_value, max_value) of a batch of cells (nid, value)."""
    number = to_number(F.col("value"))
    size = F.abs(number.cast("long"))
    return cells.where("nid is not null").groupBy("nid").agg(F.count("value").alias("total"), F.hll_sketch_agg("value").alias("distinct_sketch"), F.kll_sketch_agg_bigint(size).alias("quantile_sketch"),
                                                             F.min(number).alias("min_value"), F.max(number).alias("max_value"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """One row a column out of the rows of many batches; the order of merging doesn't matter."""
    return sketches.groupBy("nid").agg(F.sum("total").alias("total"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_bigint("quantile_sketch").alias("quantile_sketch"),
                                       F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"))


def read_sketches(sketches: DataFrame) -> DataFrame:
    """(nid, total, uniques, median, min_value, max_value) estimated from merged sketches."""
    return sketches.select("nid", "total", F.hll_sketch_estimate("distinct_sketch").alias("uniques"),
                           F.when(F.col("min_value").isNotNull(), F.kll_sketch_get_quantile_bigint("quantile_sketch", F.lit(0.5))).alias("median"), "min_value", "max_value")


def start(cells: DataFrame, path: str, checkpoint: str):
    """Start a stream that appends the sketches of every micro-batch to a table at `path`, under its batch number, so that a batch done again replaces itself."""
    def put(batch: DataFrame, number: int) -> None:
        batch_sketch(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cells.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, time_col: str, key_col: str, width: str, late: str) -> DataFrame:
    """(start, key, n): counts by event time with a watermark; works on a stream and on a table."""
    e = events.withWatermark(time_col, late) if events.isStreaming else events
    return e.groupBy(F.window(time_col, width).alias("w"), F.col(key_col).alias("key")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "key", "n")
