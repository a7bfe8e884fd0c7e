"""Writers and readers of the catalogue, the column graph, views and hash buckets."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columnscout.functions.latest import latest_rows
from columnscout.operators.ann import Hash


def write_profile(profile: DataFrame, path: str) -> None:
    """The profile, partitioned by data_type so that signatures of one kind are read alone."""
    profile.write.mode("overwrite").partitionBy("data_type").parquet(path)


def upsert_profile(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The stored profile with the new rows in place of those of the same nid."""
    return stored.join(new.select("nid"), "nid", "left_anti").unionByName(new, allowMissingColumns=True)


def current_profile(history: DataFrame) -> DataFrame:
    """Of an append-only profile the latest row of each (id, load_no)."""
    return latest_rows(history, ["id", "load_no"], "updated_at", ["received_at"])


def write_postings(postings: DataFrame, path: str) -> None:
    """The inverted index, sorted by term within files so that a search reads few row groups."""
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def write_nothing(df: DataFrame) -> None:
    """Compute everything and store nothing."""
    df.write.format("noop").mode("overwrite").save()


def write_network(columns: DataFrame, edges: DataFrame, path: str) -> None:
    columns.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")


def read_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(columns, edges) as `write_network` stored them."""
    edges = spark.read.parquet(f"{path}/edges")
    return spark.read.parquet(f"{path}/nodes"), edges.select("src", "dst", F.col("relation").cast("int").alias("relation"), "score")


def network_to_csv(columns: DataFrame, edges: DataFrame, path: str) -> None:
    """Folders nodes and edges of CSV, each pair once; also what graph databases import."""
    columns.write.mode("overwrite").option("header", True).csv(f"{path}/nodes")
    edges.where("src < dst").write.mode("overwrite").option("header", True).csv(f"{path}/edges")


def triples(edges: DataFrame, base: str = "urn:column:", relation_base: str = "urn:relation:") -> DataFrame:
    """(line): N-Triples of the edges, each pair once."""
    iri = lambda b, c: F.concat(F.lit(f"<{b}"), F.col(c).cast("string"), F.lit(">"))
    return edges.where("src < dst").select(F.concat_ws(" ", iri(base, "src"), iri(relation_base, "relation"), iri(base, "dst"), F.lit(".")).alias("line"))


def write_view(view: DataFrame, path: str, encoding: str = "ISO-8859-1") -> None:
    """A view as CSV with a header."""
    view.write.mode("overwrite").option("header", True).option("encoding", encoding).csv(path)


def write_buckets(buckets: DataFrame, hashes: list[Hash], path: str) -> None:
    """Buckets and the configuration of their hashes."""
    buckets.write.mode("overwrite").partitionBy("hash_name").parquet(f"{path}/buckets")
    rows = [(h.name, json.dumps(h.normals.tolist()), h.width) for h in hashes]
    buckets.sparkSession.createDataFrame(rows, "name string, normals string, width double").coalesce(1).write.mode("overwrite").json(f"{path}/hashes")


def read_buckets(spark: SparkSession, path: str) -> tuple[DataFrame, list[Hash]]:
    rows = spark.read.schema("name string, normals string, width double").json(f"{path}/hashes").collect()
    return spark.read.parquet(f"{path}/buckets"), [Hash(r["name"], np.array(json.loads(r["normals"])), r["width"]) for r in rows]
