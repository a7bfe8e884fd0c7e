"""Problem 6: most similar vectors for every vector.

Inverted file of coarse centroids with product-quantised residuals. The index is fitted
on a bounded sample, in two levels; every vector is indexed, with its list, its codes and the length of its
quantisation error. How many lists a query looks into follows from the true neighbours of a held sample of queries.
Neighbouring lists are packed into regions, so that a query travels once to each region it looks into. There its
asymmetric distance tables score the codes, and whatever the error leaves a chance is
compared exactly; so only a neighbour outside the regions looked into can be missed.
Vectors of one direction are one entry of the index, with their k + 1 smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from columnscout.plans.lineage import Stages


@dataclass(frozen=True)
class Params:
    """Of the index and its search.

    lists: their number over the square root of that of the entries, as long as the sample has 16 vectors a list;
    recall: share of the held queries' true neighbours that the lists looked into must hold, before that number of lists is
    doubled; 1 looks into all lists, which is the exact mode. sample, held: most vectors fitted on, and most queries held.
    region: entries that neighbouring lists are packed to; block: most entries of a region in one task; turn: most queries.
    """

    k: int = 5
    min_similarity: float | None = None
    recall: float = 0.999
    lists: float = 4.0
    sample: int = 262_144
    held: int = 1024
    parts: int = 16
    codes: int = 256
    region: int = 1024
    block: int = 65_536
    turn: int = 16_384
    seed: int = 7


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds if k > 1 else 1):
        near = _nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=k)
        full, start = np.flatnonzero(n), (np.cumsum(n) - n)[n > 0]
        c[full] = np.add.reduceat(x[np.argsort(near, kind="stable")], start, axis=0) / n[full, None]
        c[n == 0] = x[rng.integers(0, len(x), int((n == 0).sum()))]
    return c


def _nearest(x: np.ndarray, c: np.ndarray, m: int) -> np.ndarray:
    """Indexes of the m nearest centroids of each row, nearest first."""
    out, half, step = [], (c * c).sum(1) / 2, max(64, (1 << 22) // max(1, len(c)))
    for a in range(0, len(x), step):
        d = half - x[a : a + step] @ c.T
        if m == 1:
            out.append(d.argmin(axis=1)[:, None])
            continue
        if m >= d.shape[1]:
            out.append(np.argsort(d, axis=1, kind="stable"))
            continue
        top = np.argpartition(d, m - 1, axis=1)[:, :m]
        out.append(np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, m), np.int64)


def _distinct(c: np.ndarray, least: float = 1e-5) -> np.ndarray:
    """The centroids without those that coincide with an earlier one: rounding alone would deal near copies out to their lists."""
    c, kept = c.astype(np.float64), []
    for i in range(len(c)):
        if not kept or ((c[kept] - c[i]) ** 2).sum(1).min() > least * least:
            kept.append(i)
    return c[kept]


@dataclass(frozen=True)
class Quantiser:
    """Coarse centroids (lists x dim), those of one coarser cell side by side; the scale of each list's residuals; for each part of a scaled residual its codebook (parts x codes x width)."""

    centroids: np.ndarray
    scales: np.ndarray
    books: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, n: int, p: Params) -> Quantiser:
        rng = np.random.default_rng(p.seed)
        lists = int(np.clip(p.lists * np.sqrt(n), 1, max(1, len(x) // 16)))
        cells = _kmeans(x, int(np.ceil(np.sqrt(lists))), rng)
        cell = _nearest(x, cells, 1)[:, 0]
        parts = []
        for i in range(len(cells)):
            mine = x[cell == i]
            if len(mine):
                parts.append(_distinct(_kmeans(mine, max(1, round(lists * len(mine) / len(x))), rng)))
        centroids = np.concatenate(parts).astype(np.float32)
        near = _nearest(x, centroids, 1)[:, 0]
        rest = x - centroids[near]
        square = (rest * rest).sum(1)
        held = np.bincount(near, minlength=len(centroids))
        scales = np.sqrt(np.bincount(near, weights=square, minlength=len(centroids)) / np.maximum(held, 1))
        scales = np.where(scales > 1e-7, scales, max(float(np.sqrt(square.mean())), 1e-7)).astype(np.float32)
        some = rng.choice(len(x), min(len(x), 8192), replace=False)
        rest, width = (rest / scales[near][:, None])[some], x.shape[1] // p.parts
        books = [_kmeans(rest[:, i * width : (i + 1) * width], p.codes, rng, 6) for i in range(p.parts)]
        size = max(map(len, books))
        return Quantiser(centroids, scales, np.stack([np.pad(b, ((0, size - len(b)), (0, 0)), mode="edge") for b in books]).astype(np.float32))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, length of the quantisation error) of unit vectors."""
        near, width = _nearest(x.astype(np.float32), self.centroids, 1)[:, 0], self.books.shape[2]
        rest = ((x - self.centroids[near]) / self.scales[near][:, None]).astype(np.float32)
        codes = np.stack([_nearest(rest[:, i * width : (i + 1) * width], b, 1)[:, 0] for i, b in enumerate(self.books)], axis=1).astype(np.uint8)
        made = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)
        return near, codes, np.sqrt(((x - self.centroids[near] - self.scales[near][:, None].astype(np.float64) * made) ** 2).sum(1))

    def scores(self, x: np.ndarray, near: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Dot products (queries x entries) of exact queries and coded entries.

        Asymmetric: a table of the query's products with all codewords, looked up by code; it is the same for all lists, whose
        centroids and scales come in once for each list.
        """
        width = self.books.shape[2]
        out = np.zeros((len(codes), len(x)), np.float32)
        for i, book in enumerate(self.books):
            out += (book @ x[:, i * width : (i + 1) * width].T)[codes[:, i]]
        lists, at = np.unique(near, return_inverse=True)
        out *= self.scales[near][:, None]
        out += (self.centroids[lists] @ x.T)[at]
        return out.T


def _regions(sizes: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The region of each list, and the number of blocks of each region: lists side by side until they hold `region` entries."""
    region, blocks, held = np.zeros(len(sizes), np.int64), [], 0
    for i, n in enumerate(sizes):
        if not blocks or held + n > p.region and held:
            blocks.append(0)
            held = 0
        held += int(n)
        region[i] = len(blocks) - 1
        blocks[-1] = max(1, -(-held // p.block))
    return region, np.array(blocks, np.int64)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # first by the largest number: squares of very large or small ones would leave the range
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _direction(vector: str):
    """Column: the vector over its largest magnitude in steps of 1e-14, equal for vectors that differ by an exact positive factor."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    # the largest is bound as a lambda variable: an expression in a lambda is computed again for each number
    return F.transform(F.array(top), lambda t: F.transform(vector, lambda x: F.rint(x.cast("double") / t * 1e14).cast("long")))[0]


def _compare(x: np.ndarray, store: np.ndarray, score: np.ndarray, err: np.ndarray, keep: int, low: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, cosine): the `keep` most similar of `store` (rows sorted by id) for each query, with a cosine of at least `low`.

    A cosine differs from the quantised score by at most the length of the entry's quantisation error. Compared exactly
    are all entries that this leaves a chance to be among the `keep` best and to reach `low`.
    """
    err = (err + 1e-5).astype(np.float32)  # 1e-5: rounding of single precision
    high, least = score + err, np.full(len(x), low, np.float32)
    if low <= -1 and len(store) > keep:
        least = np.partition(score - err, len(store) - keep, axis=1)[:, len(store) - keep]
    who, which = np.nonzero(high >= least[:, None])
    if len(who) > 0.05 * score.size:
        sim, rows = np.round(x @ store.T, 12), np.arange(len(x))
        exact, top = sim.copy(), []
        for _ in range(min(keep, len(store))):
            best = sim.argmax(axis=1)  # the first of equal ones: the smallest id
            top.append(best)
            sim[rows, best] = -np.inf
        which = np.stack(top, axis=1)
        who, which = np.repeat(rows, which.shape[1]), which.ravel()
        value = exact[who, which]
    else:
        value = np.concatenate([np.round(np.einsum("pd,pd->p", x[who[a : a + 65536]], store[which[a : a + 65536]]), 12) for a in range(0, len(who), 65536)] or [np.zeros(0)])
        order = np.lexsort((which, -value, who))
        who, which, value = who[order], which[order], value[order]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        who, which, value = who[nth < keep], which[nth < keep], value[nth < keep]
    fine = value >= low
    return who[fine], which[fine], value[fine]


def usable(vector: str, dim: int):
    """Column: the vector has `dim` numbers, all finite, and not all are zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)


def _repeat(who: np.ndarray, goal: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (who, goal) so many times, and the number of the copy."""
    return np.repeat(who, times), np.repeat(goal, times), np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)


def _dealt(ids: np.ndarray, parts: np.ndarray, salt: int) -> np.ndarray:
    """Which of so many parts each id is dealt to."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        return (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)


def _held_ranks(placed: DataFrame, held: np.ndarray, names: np.ndarray, fitted: Quantiser, dim: int, p: Params) -> np.ndarray:
    """For each true neighbour of each held query, how many lists are nearer to the query than the neighbour's. One pass over all entries; of each part only the best reach the shuffle."""
    spark, low = placed.sparkSession, -1.0 if p.min_similarity is None else p.min_similarity
    queries = spark.sparkContext.broadcast((held, names))  # at most p.held vectors

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, own = queries.value
        kept: tuple = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        for b in batches:
            ids = b.column(0).to_numpy()
            sim = x @ _unit(_vectors(b.column(1), dim)).T
            sim[own[:, None] == ids[None]] = -np.inf
            least = np.full(len(x), low)
            if p.min_similarity is None and p.k < len(ids):
                least = np.partition(sim, len(ids) - p.k, axis=1)[:, len(ids) - p.k]
            who, at = np.nonzero(sim >= np.maximum(least, low)[:, None])
            new = (who, sim[who, at], b.column(2).to_numpy()[at])
            who, value, near = (np.concatenate((u, v)) for u, v in zip(kept, new))
            order = np.lexsort((-value, who))
            who, value, near = who[order], value[order], near[order]
            few = np.arange(len(who)) - np.searchsorted(who, who) < p.k
            kept = (who[few], value[few], near[few])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept], ["query", "similarity", "list"])

    found = placed.select("entry", "v", "list").mapInArrow(best, "query long, similarity double, list long")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), "list"))
    true = found.withColumn("nth", nth).where(F.col("nth") <= p.k).select("query", "list").toPandas()
    c = fitted.centroids
    d = (c * c).sum(1) / 2 - held.astype(np.float32) @ c.T
    q, near = true["query"].to_numpy(np.int64), true["list"].to_numpy(np.int64)
    return np.array([(d[i] < d[i, j]).sum() for i, j in zip(q, near)], np.int64)


def nearest_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int, params: Params = Params()) -> DataFrame:
    """(id, neighbour, similarity, rank): for every usable vector its k most similar other vectors by cosine.

    Ties (to twelve places) go to the smaller neighbour id. With `min_similarity` only neighbours of at least that
    cosine count. Repeated rows count once; rows with a null id or an unusable vector are left
    out, and an empty input gives an empty result. Approximate only in this: a neighbour outside the regions looked into is missed;
    how many lists that are is set by the recall measured on held queries, and similarities are
    exact (double precision). Runs jobs to write the distinct directions, to fit the index and to measure.
    """
    p, spark = params, vectors.sparkSession
    stages = Stages(spark, "neighbours")
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector_col, dim)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    rows = stages.write(rows.withColumn("name", F.sha2(F.array_join(_direction("v"), ","), 256)).dropDuplicates(["id", "name"]), "rows")
    first = Window.partitionBy("name").orderBy("id")
    few = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= p.k + 1)
    entries = stages.write(few.groupBy("name").agg(F.min("id").alias("entry"), F.array_sort(F.collect_list("id")).alias("ids"), F.min_by("v", "id").alias("v")), "entries")
    n = entries.count()
    if n == 0:
        return spark.createDataFrame([], "id long, neighbour long, similarity double, rank int")
    size = int(min(p.sample, max(16 * p.lists * np.sqrt(n), 4096)))
    sample = entries.select("entry", "v", F.xxhash64(F.lit(p.seed), "name").alias("h")).orderBy("h").limit(size).toArrow()
    known = _unit(_vectors(sample.column("v").combine_chunks(), dim))
    fitted = Quantiser.fit(known.astype(np.float32), n, p)
    index = spark.sparkContext.broadcast(fitted)  # at most sample / 16 centroids, and parts x codes codewords

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near, codes, err = index.value.encode(_unit(_vectors(b.column(1), dim)))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int64)), packed, pa.array(err)], ["entry", "v", "list", "code", "err"])

    placed = stages.write(entries.select("entry", "v").mapInArrow(place, "entry long, v array<float>, list long, code binary, err double"), "placed")
    sizes = np.zeros(len(fitted.centroids), np.int64)
    for r in placed.groupBy("list").count().collect():  # one row a list
        sizes[r["list"]] = r["count"]
    probes = len(sizes)
    if p.recall < 1 and probes > 1:
        ranks = _held_ranks(placed, known[: p.held], sample.column("entry").to_numpy()[: p.held], fitted, dim, p)
        probes = min(probes, 2 * (1 + int(np.quantile(ranks, p.recall, method="higher"))) if len(ranks) else 1)
    region, blocks = _regions(sizes, p)

    # how many asks a region gets, estimated from the sample; it only sets how evenly the tasks share them
    asks = np.bincount(region[_nearest(known.astype(np.float32), fitted.centroids, probes)].ravel(), minlength=len(blocks)) * (n / len(known))
    turns = np.maximum(1, np.ceil(np.minimum(asks, n) / p.turn)).astype(np.int64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each block of each region that has a list it looks into."""
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                near = np.sort(region[_nearest(_unit(_vectors(part.column(1), dim)).astype(np.float32), index.value.centroids, probes)], axis=1)
                new = np.concatenate((np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]), axis=1)
                who, goal = np.nonzero(new)[0], near[new]
                who, goal, block = _repeat(who, goal, blocks[goal])
                ids = part.column(0).to_numpy()[who]
                yield pa.RecordBatch.from_arrays([pa.array(goal), pa.array(block), pa.array(_dealt(ids, turns[goal], 1)), pa.array(ids), part.column(1).take(pa.array(who))], ["region", "block", "turn", "entry", "v"])

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each entry in its block, once for each turn."""
        for b in batches:
            ids, near = b.column(0).to_numpy(), b.column(2).to_numpy()
            who, _, turn = _repeat(np.arange(b.num_rows), near, turns[region[near]])
            goal, at = region[near[who]], pa.array(who)
            yield pa.RecordBatch.from_arrays([pa.array(goal), pa.array(_dealt(ids[who], blocks[goal], 0)), pa.array(turn), *(b.column(i).take(at) for i in range(5))], ["region", "block", "turn", "stored", "stored_v", "list", "code", "err"])

    keys = ["region", "block", "turn"]
    asking = placed.select("entry", "v").mapInArrow(ask, "region long, block long, turn long, entry long, v array<float>")
    stored = placed.mapInArrow(give, "region long, block long, turn long, stored long, stored_v array<float>, list long, code binary, err double")
    keep, low = p.k + 1, -2.0 if p.min_similarity is None else p.min_similarity - 1e-9

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Asking entries of one block against its stored entries."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            right = right.sort_by("stored")
            a_ids, s_ids = left.column("entry").to_numpy(), right.column("stored").to_numpy()
            asks, store = _unit(_vectors(left.column("v").combine_chunks(), dim)), _unit(_vectors(right.column("stored_v").combine_chunks(), dim))
            near, err = right.column("list").to_numpy(), right.column("err").to_numpy()
            codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(s_ids), -1)
            step = max(16, (1 << 21) // len(s_ids))
            for a in range(0, len(a_ids), step):
                x = asks[a : a + step]
                who, which, value = _compare(x, store, index.value.scores(x.astype(np.float32), near, codes), err, keep, low)
                out.append((a_ids[a + who], s_ids[which], value))
        return pa.table([np.concatenate(c) for c in zip(*out)], ["entry", "found", "similarity"])

    hits = asking.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(search, "entry long, found long, similarity double")
    best = Window.partitionBy("entry").orderBy(F.round("similarity", 12).desc(), "found")
    hits = hits.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= keep).drop("nth")
    near = hits.join(entries.select(F.col("entry").alias("found"), "ids"), "found").select("entry", F.explode("ids").alias("neighbour"), "similarity")
    # k + 1 candidates an entry are enough for each of its ids, which may be one of them
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("entry").orderBy(F.round("similarity", 12).desc(), "neighbour"))).where(F.col("nth") <= keep)
    lists = near.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("nth", "neighbour", "similarity"))).alias("near"))
    lists = lists.join(entries.select("entry", "name"), "entry").select("name", "near")
    own = rows.select("id", "name").join(lists, "name")
    ranked = own.select("id", F.posexplode(F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, p.k)).alias("at", "x"))
    return ranked.select("id", F.col("x.neighbour").alias("neighbour"), F.col("x.similarity").alias("similarity"), (F.col("at") + 1).alias("rank"))


def brute_force(ids: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """The exact twin for tests: (id, neighbour, similarity, rank)."""
    u = _unit(v)
    sim = u @ u.T
    np.fill_diagonal(sim, -np.inf)
    order = np.lexsort((np.broadcast_to(ids, sim.shape), -np.round(sim, 12)), axis=1)[:, :k]
    n = order.shape[1]
    return pd.DataFrame({"id": np.repeat(ids, n), "neighbour": ids[order].ravel(), "similarity": np.take_along_axis(sim, order, 1).ravel(), "rank": np.tile(np.arange(1, n + 1), len(ids))})
