"""Approximate nearest neighbours by hashing: hashes, bucket joins, filters, and quality against the exact twin.

Hashes give (hash_name, bucket_key) for each vector; a search is an equi-join on them.
Projections are seeded, so keys are deterministic, and of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from columnscout.functions.vectors import DISTANCES

#: Principal components are fitted on at most so many vectors.
PCA_SAMPLE = 10_000


@dataclass(frozen=True)
class Hash:
    """A family of bucket keys: projections (rows of `normals`), and a bin width or None for sign bits."""

    name: str
    normals: np.ndarray
    width: float | None = None

    def keys(self, v: np.ndarray) -> list[str]:
        p = v @ self.normals.T
        if self.width is None:
            return ["".join(r) for r in np.where(p > 0, "1", "0")]
        return ["_".join(map(str, r)) for r in np.floor(p / self.width).astype(np.int64)]


def binary_projections(name: str, bits: int, dim: int, seed: int) -> Hash:
    """Sign bits of random hyperplanes; the key has one character for each."""
    return Hash(name, np.random.default_rng(seed).standard_normal((bits, dim)))


def discretised_projections(name: str, n: int, width: float, dim: int, seed: int) -> Hash:
    """Bins of random projections, joined by `_`."""
    return Hash(name, np.random.default_rng(seed).standard_normal((n, dim)), width)


def pca_projections(name: str, n: int, vectors: DataFrame, vector_col: str, width: float | None = None, sample: int = PCA_SAMPLE) -> Hash:
    """Signs or bins along the n first principal components of a bounded sample, taken in hash order."""
    rows = vectors.where(F.col(vector_col).isNotNull()).select(vector_col).orderBy(F.xxhash64(vector_col)).limit(sample).toPandas()
    x = np.stack(rows[vector_col].to_numpy()).astype(np.float64)
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    flip = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])  # a fixed sign for each axis
    return Hash(name, (axes * flip[:, None])[:n], width)


def split(whole: Hash, n: int) -> list[Hash]:
    """One hash for every n directions of a hash; a remainder of fewer directions is left out."""
    return [Hash(f"{whole.name}{i // n}", whole.normals[i : i + n], whole.width) for i in range(0, len(whole.normals) - n + 1, n)]


def unit_bucket(name: str, dim: int) -> Hash:
    """Everything in one bucket: exact search, for small collections and tests."""
    return Hash(name, np.zeros((1, dim)), 1.0)


def buckets(vectors: DataFrame, hashes: list[Hash], id_col: str, vector_col: str) -> DataFrame:
    """(hash_name, bucket_key, id, v): each vector once for each hash; null vectors and those of another length are left out."""
    id_type, dim = vectors.schema[id_col].dataType.simpleString(), hashes[0].normals.shape[1]
    read = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == dim)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for h in hashes:
                yield pa.RecordBatch.from_arrays([pa.array([h.name] * len(v)), pa.array(h.keys(v)), b.column(0), b.column(1)], ["hash_name", "bucket_key", "id", "v"])

    return read.mapInArrow(assign, f"hash_name string, bucket_key string, id {id_type}, v array<double>")


def candidates(queries: DataFrame, stored: DataFrame) -> DataFrame:
    """(query, id, qv, v): entries of the queries' buckets, each pair once. A bucket of any size is only joined, never gathered."""
    q = queries.select("hash_name", "bucket_key", F.col("id").alias("query"), F.col("v").alias("qv"))
    return q.join(stored, ["hash_name", "bucket_key"]).dropDuplicates(["query", "id"]).select("query", "id", "qv", "v")


def with_distance(pairs: DataFrame, distance: str = "cosine", places: int = 9) -> DataFrame:
    """(query, id, distance), rounded so that ties are ties."""
    return pairs.select("query", "id", F.round(DISTANCES[distance]("qv", "v"), places).alias("distance"))


def nearest_filter(pairs: DataFrame, n: int) -> DataFrame:
    """The n nearest of each query; ties by id."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= n)


def threshold_filter(pairs: DataFrame, limit: float) -> DataFrame:
    """Pairs strictly nearer than the limit."""
    return pairs.where(F.col("distance") < limit)


def unique_filter(pairs: DataFrame) -> DataFrame:
    """Each (query, id) once."""
    return pairs.dropDuplicates(["query", "id"])


def search(queries: DataFrame, stored: DataFrame, n: int = 10, distance: str = "cosine", include_self: bool = True) -> DataFrame:
    """(query, id, distance, rank): hashed search of `buckets` rows against `buckets` rows."""
    pairs = candidates(queries, stored)
    if not include_self:
        pairs = pairs.where("query <> id")
    return nearest_filter(with_distance(pairs, distance), n)


def exact_nearest(queries: DataFrame, vectors: DataFrame, n: int, distance: str = "cosine", blocks: int | None = None) -> DataFrame:
    """(query, id, distance, rank): the exact twin, a stated query set (id, v) against all rows (id, v), in blocks of rows.

    Each block of rows keeps its own n best before the merge, and the queries are joined to every block by its number; there are two
    blocks for each core that the session has, if no number is given.
    """
    blocks = blocks or 2 * vectors.sparkSession.sparkContext.defaultParallelism
    rows = vectors.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "v")
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"), F.col("id").alias("query"), F.col("v").alias("qv"))
    pairs = q.join(rows, "block").where("query <> id")
    scored = pairs.select("block", "query", "id", F.round(DISTANCES[distance]("qv", "v"), 9).alias("distance"))
    part = F.row_number().over(Window.partitionBy("query", "block").orderBy("distance", "id"))
    return nearest_filter(scored.withColumn("part", part).where(F.col("part") <= n).select("query", "id", "distance"), n)


def hamming_probes(queries: DataFrame) -> DataFrame:
    """Bucket rows of queries with every key of sign bits that differs in at most one bit, for an equi-join with the stored ones."""
    flip = "concat(array(bucket_key), transform(sequence(1, length(bucket_key)), i -> concat(left(bucket_key, i - 1), if(substring(bucket_key, i, 1) = '1', '0', '1'), substring(bucket_key, i + 1))))"
    return queries.select("hash_name", F.explode(F.expr(flip)).alias("bucket_key"), "id", "v")


def hamming_within(queries: DataFrame, stored: DataFrame, bits: int, most: int) -> DataFrame:
    """(query, id, qv, v): entries whose keys of `bits` sign bits differ in at most `most` bits; by pigeonhole on most + 1 pieces of the key, so without loss or cross join."""
    piece = -(-bits // (most + 1))
    cut = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.struct(i.alias("piece"), F.substring("bucket_key", i * piece + 1, F.lit(piece)).alias("part")))

    def pieces(df: DataFrame) -> DataFrame:
        return df.select("hash_name", "bucket_key", "id", "v", F.inline(cut))

    q = pieces(queries).select("hash_name", "piece", "part", F.col("id").alias("query"), F.col("v").alias("qv"), F.col("bucket_key").alias("q_key"))
    differ = F.bit_count(F.conv("q_key", 2, 10).cast("long").bitwiseXOR(F.conv("bucket_key", 2, 10).cast("long")))
    return q.join(pieces(stored), ["hash_name", "piece", "part"]).where(differ <= most).dropDuplicates(["query", "id"]).select("query", "id", "qv", "v")


def tree_candidates(queries: DataFrame, stored: DataFrame, least: int) -> DataFrame:
    """(query, id, qv, v): entries that share the longest key prefix that at least `least` entries have (the root if none)."""
    prefixes = F.transform(F.sequence(F.lit(0), F.length("bucket_key")), lambda i: F.left("bucket_key", i))
    p = stored.select("hash_name", "id", "v", F.explode(prefixes).alias("prefix"))
    counts = p.groupBy("hash_name", "prefix").agg(F.count("*").alias("n"))
    q = queries.select("hash_name", F.col("id").alias("query"), F.col("v").alias("qv"), F.explode(prefixes).alias("prefix")).join(counts.where((F.col("n") >= least) | (F.col("prefix") == "")), ["hash_name", "prefix"])
    longest = F.row_number().over(Window.partitionBy("hash_name", "query").orderBy(F.length("prefix").desc()))
    best = q.withColumn("r", longest).where("r = 1").select("hash_name", "query", "qv", "prefix")
    return best.join(p, ["hash_name", "prefix"]).dropDuplicates(["query", "id"]).select("query", "id", "qv", "v")


def recall_precision(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (recall, precision) of found (query, id) against exact (query, id)."""
    f, e = found.select("query", "id", F.lit(1).alias("f")), exact.select("query", "id", F.lit(1).alias("e"))
    both = f.join(e, ["query", "id"], "full")
    hit = F.sum(F.when(F.col("f").isNotNull() & F.col("e").isNotNull(), 1).otherwise(0))
    return both.agg((hit / F.nullif(F.count("e"), F.lit(0))).alias("recall"), (hit / F.nullif(F.count("f"), F.lit(0))).alias("precision"))


def distance_ratio(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (ratio): mean over the queries of found total distance over exact total distance."""
    f = found.groupBy("query").agg(F.sum("distance").alias("f"))
    e = exact.groupBy("query").agg(F.sum("distance").alias("e"))
    return f.join(e, "query").where("e > 0").agg(F.avg(F.col("f") / F.col("e")).alias("ratio"))

