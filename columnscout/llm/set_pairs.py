"""Problem 1: all similar pairs between set-valued records.

Pigeonhole partitioning. Two sets whose Jaccard similarity reaches the threshold differ
in at most D tokens, D following from their sizes. Tokens are dealt by a hash into n
segments, n depending on the smaller set's range of lengths. If the larger set allows
segment i to differ in e_i tokens (-1: not used, 0: equal, 1: one deletion) and
the e_i + 1 add up to more than D, then some used segment differs by no more than
its e_i. The smaller set publishes its segments and their one-deletions; the larger
set asks for the cheapest choice of e_i that adds up, which uses no empty segment, and
passes over those made of frequent tokens. Empty segments and empty rests have no key: very many sets would share it.
Two kinds of sets need another signature. Small ones (up to WHOLE tokens) meet by whole deletion signatures:
the sets that are left when as many tokens are deleted as the pair's sizes allow. And where a set's tokens fall into so
few segments that no choice adds up, both sets' rarest tokens are segments of their own, of which
one must be shared. Candidates are verified exactly, by hashes first and then by the values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnscout.plans.lineage import Stages

#: Ranges of lengths grow by this factor.
RANGE = 1.2
#: At most so many frequent tokens are broadcast, whatever the input: a token is frequent from (all tokens / HOT_TOKENS) records on.
HOT_TOKENS = 50_000
HOT_LEAST = 32
#: A pair whose larger set has at most so many tokens meets by deletions of the whole sets.
WHOLE = 9


class Lengths:
    """Ranges of set lengths, their numbers of segments, and the difference that a pair of lengths allows."""

    def __init__(self, threshold: float, least: int, longest: int):
        self.t, starts = threshold, [max(1, least)]
        while starts[-1] <= longest:
            starts.append(max(starts[-1] + 1, math.floor(starts[-1] * RANGE)))
        self.starts = np.array(starts)  # the last one is beyond the longest
        tops = self.starts[1:] - 1
        need = self.differ(tops, np.floor(tops / self.t + 1e-9).astype(np.int64)) + 1
        self.segments = np.maximum(2, np.ceil(need * 0.75).astype(np.int64) + 1)

    def differ(self, s, n):
        """The most tokens in which sets of s and n tokens may differ."""
        return s + n - 2 * np.ceil(self.t / (1 + self.t) * (s + n) - 1e-9).astype(np.int64)

    def least(self, s, n):
        """The fewest tokens that sets of s and n tokens must share."""
        return np.ceil(self.t / (1 + self.t) * (s + n) - 1e-9).astype(np.int64)

    def shared_sizes(self, n: int, larger: bool) -> list[int]:
        """The numbers of shared tokens that a small set must keep, as the larger or the smaller of a pair."""
        partners = range(max(int(self.starts[0]), math.ceil(n * self.t - 1e-9)), n + 1) if larger else range(n, min(WHOLE, math.floor(n / self.t + 1e-9)) + 1)
        return sorted({int(self.least(np.array(m), np.array(n))) for m in partners})

    def range_of(self, n):
        return np.searchsorted(self.starts, n, side="right") - 1


def _mix(x: np.ndarray, salt) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) ^ np.uint64(salt) if np.isscalar(salt) else x.astype(np.uint64) + salt.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _segments(rec: np.ndarray, tokens: np.ndarray, count: np.ndarray):
    """For each record its `count` segments: first segment of each record, segment of each token, xor and size of each segment."""
    base = np.concatenate(([0], np.cumsum(count)))
    seg = base[rec] + (_mix(tokens, 0x5851F42D4C957F2D) % count[rec].astype(np.uint64)).astype(np.int64)
    xor = np.zeros(base[-1], np.uint64)
    np.bitwise_xor.at(xor, seg, tokens)
    return base, seg, xor, np.bincount(seg, minlength=base[-1])


def _key(group: np.ndarray, number: np.ndarray, xor: np.ndarray, kind: int) -> np.ndarray:
    """One number for (range of lengths, segment, tokens in it, equal or one-deletion)."""
    return _mix(xor, _mix(((group.astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64)) * np.uint64(2) + np.uint64(kind), 0x2545F4914F6CDD1D))


def _batch(out: list[tuple], ids, sizes, sketch) -> pa.RecordBatch:
    rec = np.concatenate([r for r, _ in out])
    key = np.concatenate([k for _, k in out])
    pairs = np.unique(np.stack((rec.astype(np.uint64), key), axis=1), axis=0) if len(rec) else np.zeros((0, 2), np.uint64)
    rec, key = pairs[:, 0].astype(np.int64), pairs[:, 1]
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[rec]), pa.array(sizes[rec].astype(np.int32)), pa.array(sketch[rec].view(np.int64))], ["key", "id", "n", "sketch"])


def _flat(batch: pa.RecordBatch):
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    tokens = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    rec = np.repeat(np.arange(len(ids)), sizes)
    sketch = np.zeros(len(ids), np.uint64)
    np.bitwise_or.at(sketch, rec, np.uint64(1) << (_mix(tokens, 0x9E6C63D0876A9A47) % np.uint64(64)))
    return ids, tokens, sizes, rec, sketch


def _frequency(hot: tuple[np.ndarray, np.ndarray], tokens: np.ndarray) -> np.ndarray:
    """How many records hold each token; of tokens that aren't frequent a small number."""
    keys, counts = hot
    if not len(keys):
        return np.full(len(tokens), 4.0)
    at = np.minimum(np.searchsorted(keys, tokens), len(keys) - 1)
    return np.where(keys[at] == tokens, counts[at], 4.0)


def _whole_keys(lengths: Lengths, tokens: np.ndarray, sizes: np.ndarray, larger: bool) -> list[tuple]:
    """(record, key) of the deletion signatures of sets of at most WHOLE tokens."""
    out, ends = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))], np.cumsum(sizes)
    for n in range(int(lengths.starts[0]), WHOLE + 1):
        mine = np.flatnonzero(sizes == n)
        if not len(mine):
            continue
        held = tokens[(ends[mine] - n)[:, None] + np.arange(n)]
        for shared in lengths.shared_sizes(n, larger):
            kept = np.array(list(combinations(range(n), shared)))
            xor = np.bitwise_xor.reduce(held[:, kept], axis=2).ravel()
            zero = np.zeros(len(xor), np.int64)
            out.append((np.repeat(mine, len(kept)), _key(zero, zero + shared, xor, 2)))
    return out


def _rarest(rec: np.ndarray, tokens: np.ndarray, df: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Indexes of the `most` tokens of each record that come first by frequency, an order that is the same for all records."""
    order = np.lexsort((tokens, df, rec))
    r = rec[order]
    return order[np.arange(len(r)) - np.searchsorted(r, r) < most[r]]


def _published(lengths: Lengths, hot: tuple[np.ndarray, np.ndarray], batch: pa.RecordBatch) -> pa.RecordBatch:
    """What the smaller set of a pair offers, in its own range: its segments, each segment without one token, and its rarest tokens; a small set its deletion signatures."""
    ids, tokens, sizes, rec, sketch = _flat(batch)
    out = _whole_keys(lengths, tokens, sizes, False)
    large = np.floor(sizes / lengths.t + 1e-9) > WHOLE  # may have a partner that isn't small
    pick, inside = np.flatnonzero(large), large[rec]
    local, tok = (np.cumsum(large) - 1)[rec[inside]], tokens[inside]
    group = lengths.range_of(sizes[pick])
    count = lengths.segments[group]
    base, seg, xor, held = _segments(local, tok, count)
    owner = np.repeat(np.arange(len(pick)), count)
    number = np.arange(base[-1]) - base[owner]
    full, several = held > 0, held[seg] > 1
    out.append((pick[owner[full]], _key(group[owner[full]], number[full], xor[full], 0)))
    out.append((pick[local[several]], _key(group[local[several]], number[seg[several]], xor[seg[several]] ^ tok[several], 1)))
    few = _rarest(local, tok, _frequency(hot, tok), sizes[pick] - lengths.least(sizes[pick], sizes[pick]) + 1)
    out.append((pick[local[few]], _key(group[local[few]], np.zeros(len(few), np.int64), tok[few], 3)))
    return _batch(out, ids, sizes, sketch)


def _asked(lengths: Lengths, hot: tuple[np.ndarray, np.ndarray], batch: pa.RecordBatch) -> pa.RecordBatch:
    """What the larger set of a pair asks for, in each range where a smaller partner may be."""
    ids, tokens, sizes, rec, sketch = _flat(batch)
    df = _frequency(hot, tokens)
    low, high = lengths.range_of(np.maximum(np.ceil(sizes * lengths.t - 1e-9).astype(np.int64), lengths.starts[0])), lengths.range_of(sizes)
    out = _whole_keys(lengths, tokens, sizes, True)
    large = sizes > WHOLE
    for back in range(int((high - low)[large].max(initial=-1)) + 1):
        mine = large & (high - back >= low)
        pick = np.flatnonzero(mine)
        inside = mine[rec]
        local = (np.cumsum(mine) - 1)[rec[inside]]
        tok, tdf, group = tokens[inside], df[inside], (high - back)[pick]
        n, count = sizes[pick], lengths.segments[group]
        smallest, largest = np.maximum(lengths.starts[group], np.ceil(n * lengths.t - 1e-9).astype(np.int64)), np.minimum(lengths.starts[group + 1] - 1, n)
        need = np.maximum(lengths.differ(largest, n), lengths.differ(np.maximum(smallest, largest - 1), n)) + 1
        base, seg, xor, held = _segments(local, tok, count)
        owner = np.repeat(np.arange(len(pick)), count)
        number = np.arange(base[-1]) - base[owner]
        # what a segment costs: its rarest token bounds how many records can share it; an empty one, and the rest of a single token, can't be asked for
        rare = np.full(base[-1], np.inf)
        np.minimum.at(rare, seg, tdf)
        equal = np.where(held == 0, np.inf, rare / np.maximum(held, 1))
        second = np.full(base[-1], np.inf)  # the rarest but one: what is left when the rarest is deleted
        order = np.lexsort((tdf, seg))
        s = seg[order]
        nth = np.arange(len(s)) - np.concatenate(([0], np.cumsum(np.bincount(s, minlength=base[-1]))))[s] if len(s) else s
        two = order[nth == 1]
        second[seg[two]] = tdf[two]
        without = np.full(base[-1], np.inf)
        several = held >= 2
        without[several] = second[several] + rare[several] * held[several]
        both = equal + without
        joint = both < 2 * equal
        first, more = np.where(joint, both / 2, equal), np.where(joint, both / 2, without)
        cost = np.concatenate((first, more))
        able = np.isfinite(cost)
        who, which = np.concatenate((owner, owner)), np.concatenate((np.arange(base[-1]),) * 2)
        short = np.bincount(who[able], minlength=len(pick)) < need
        order = np.lexsort((np.concatenate((np.zeros(base[-1]), np.ones(base[-1]))), which, cost, who))
        w = who[order]
        nth = np.arange(len(w)) - (2 * base[:-1])[w]
        taken = order[(nth < need[w]) & ~short[w]]
        gain = np.bincount(which[taken], minlength=base[-1])
        gain[(gain == 1) & joint] = 2  # half of a joint step would be worth nothing
        used, deleted = np.flatnonzero(gain >= 1), gain == 2
        out.append((pick[owner[used]], _key(group[owner[used]], number[used], xor[used], 0)))
        ones = np.flatnonzero(deleted)
        out.append((pick[owner[ones]], _key(group[owner[ones]], number[ones], xor[ones], 1)))
        t = np.flatnonzero(deleted[seg])
        out.append((pick[local[t]], _key(group[local[t]], number[seg[t]], xor[seg[t]] ^ tok[t], 0)))
        at = np.flatnonzero(short[local])
        few = at[_rarest(local[at], tok[at], tdf[at], n - lengths.least(smallest, n) + 1)]
        out.append((pick[local[few]], _key(group[local[few]], np.zeros(len(few), np.int64), tok[few], 3)))
    return _batch(out, ids, sizes, sketch)


def normal_set(values):
    """Column: the distinct values, with spaces at both ends removed, lower-cased, without null and empty ones, sorted; null for a null list."""
    clean = F.transform(values, lambda v: F.lower(F.trim(v)))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda v: v.isNotNull() & (v != ""))))


@dataclass(frozen=True)
class SimilarClasses:
    """Records with the same set are one class.

    members (side, id, class_name): each record once; classes (class_name, n): sizes of the sets; links (x, y, shared,
    similarity): the pairs of different classes that are similar, each once. A class is similar to itself.
    """

    members: DataFrame
    classes: DataFrame
    links: DataFrame


def candidates(reps: DataFrame, lengths: Lengths, hot) -> DataFrame:
    """(s_id, id): distinct pairs of classes (rep, hashes) that meet in a signature and whose sketches allow them to be similar; a superset of the similar ones."""
    schema = "key long, id long, n int, sketch long"
    hashed = reps.select("rep", "hashes")
    small = hashed.mapInArrow(lambda it: (_published(lengths, hot.value, b) for b in it if b.num_rows), schema)
    large = hashed.mapInArrow(lambda it: (_asked(lengths, hot.value, b) for b in it if b.num_rows), schema)
    small = small.select("key", *(F.col(c).alias(f"s_{c}") for c in ("id", "n", "sketch")))
    least = F.ceil(F.lit(lengths.t / (1 + lengths.t)) * (F.col("n") + F.col("s_n")) - 1e-9)
    before = (F.col("s_n") < F.col("n")) | ((F.col("s_n") == F.col("n")) & (F.col("s_id") < F.col("id")))
    close = F.bit_count(F.col("sketch").bitwiseXOR(F.col("s_sketch"))) <= F.col("n") + F.col("s_n") - 2 * least
    return small.join(large, "key").where(before & (F.col("s_n") >= least) & close).select("s_id", "id").distinct()


def similar_classes(records: DataFrame, id_col: str, values_col: str, threshold: float = 0.7, min_size: int = 5, other: DataFrame | None = None) -> SimilarClasses:
    """Classes of equal sets, and the similar pairs of classes; see `similar_pairs`, which expands them to pairs of records."""
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must be between 0.5 and 1")
    stages = Stages(records.sparkSession, "set_pairs")

    def sets_of(df: DataFrame, side: int) -> DataFrame:
        s = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), normal_set(values_col).alias("tokens"))
        s = s.where(F.size("tokens") >= min_size)
        # a digest of the whole list, each value with its length in front, names the class
        text = F.concat_ws("", F.transform("tokens", lambda v: F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)))
        return s.select(F.lit(side).alias("side"), "id", F.unhex(F.sha2(text, 256)).alias("class"), "tokens")

    sets = sets_of(records, 0) if other is None else sets_of(records, 0).union(sets_of(other, 1))
    members = stages.write(sets, "sets")
    reps = stages.write(members.groupBy("class").agg(F.first("tokens").alias("tokens")).select(
        F.xxhash64("class").alias("rep"), "class", "tokens",
        F.size("tokens").alias("n"), F.transform("tokens", lambda v: F.xxhash64(v)).alias("hashes")), "classes")
    total = reps.agg(F.sum("n").alias("tokens"), F.max("n").alias("longest"), F.count("*").alias("n"), F.count_distinct("rep").alias("reps"),
                     F.max(F.col("n") - F.size(F.array_distinct("hashes"))).alias("clashes")).first()
    if total["n"] != total["reps"] or total["clashes"]:
        raise RuntimeError("two classes, or two values of a set, share a 64-bit name")
    lengths = Lengths(threshold, min_size, total["longest"] or min_size)
    floor = max(HOT_LEAST, -(-(total["tokens"] or 0) // HOT_TOKENS))
    frequent = reps.select(F.explode("hashes").alias("token")).groupBy("token").count().where(F.col("count") >= floor).toPandas()
    hot_keys = frequent["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot_keys)
    hot = records.sparkSession.sparkContext.broadcast((hot_keys[order], frequent["count"].to_numpy(np.float64)[order]))
    found = candidates(reps, lengths, hot)

    def verified(pairs: DataFrame, values: str) -> DataFrame:
        """The pairs whose sets share enough; equal values have equal hashes, so hashes lose no pair."""
        a = reps.select(F.col("rep").alias("s_id"), F.col(values).alias("a"), F.col("n").alias("s_n"))
        b = reps.select(F.col("rep").alias("id"), F.col(values).alias("b"), "n")
        both = pairs.join(a, "s_id").join(b, "id").select("s_id", "id", F.size(F.array_intersect("a", "b")).alias("shared"), (F.col("s_n") + F.col("n")).alias("n"))
        return both.where(F.col("shared") >= F.ceil(F.lit(threshold / (1 + threshold)) * F.col("n") - 1e-9))

    near = verified(found, "hashes").select("s_id", "id")
    links = verified(near, "tokens").select(F.col("s_id").alias("x"), F.col("id").alias("y"), "shared", (F.col("shared") / (F.col("n") - F.col("shared"))).alias("similarity"))
    return SimilarClasses(members.select("side", "id", F.xxhash64("class").alias("class_name")).distinct(), reps.select(F.col("rep").alias("class_name"), "n"), links)


def similar_pairs(records: DataFrame, id_col: str, values_col: str, threshold: float = 0.7, min_size: int = 5,
                  other: DataFrame | None = None) -> DataFrame:
    """(id_a, id_b, shared, similarity) of all pairs with |A n B| / |A u B| >= threshold.

    Within `records` id_a < id_b; with `other`, id_a is of `records` and id_b of `other`
    (same column names). A record's set is `normal_set` of its values; sets under `min_size` and
    null ids or lists have no pairs. Repeated rows count once, and an id with several different sets has the
    pairs of each; an empty input gives an empty result. Exact: no pair is lost, whatever the
    sizes or frequencies. Records with the same set are joined once, as a class, and
    expanded at the end; where very many records are equal, use `class_members`, which isn't expanded. Runs jobs to write the classes and count frequent tokens.
    """
    c = similar_classes(records, id_col, values_col, threshold, min_size, other)
    left = c.members.where("side = 0").select(F.col("id").alias("id_a"), F.col("class_name").alias("x"))
    right = c.members.where(f"side = {0 if other is None else 1}").select(F.col("id").alias("id_b"), F.col("class_name").alias("y"))
    same = c.classes.select(F.col("class_name").alias("x"), F.col("class_name").alias("y"), F.col("n").alias("shared"), F.lit(1.0).alias("similarity"))
    turned = c.links.select(F.col("y").alias("x"), F.col("x").alias("y"), "shared", "similarity")
    out = c.links.union(turned).union(same).join(left, "x").join(right, "y")
    if other is None:
        out = out.where("id_a < id_b")
    return out.select("id_a", "id_b", "shared", "similarity")


def class_members(records: DataFrame, id_col: str, values_col: str, threshold: float = 0.7, min_size: int = 5) -> DataFrame:
    """(id, class_id, members, links): each record with the smallest id of its class, the class's number of records, and the number of other records that are similar.

    The same records and similarity as in `similar_pairs`, with one row for each record (and set) instead of all pairs.
    """
    c = similar_classes(records, id_col, values_col, threshold, min_size)
    sizes = c.members.groupBy("class_name").agg(F.min("id").alias("class_id"), F.count("*").alias("members"))
    ends = c.links.select("x", "y").union(c.links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    linked = ends.join(sizes.select(F.col("class_name").alias("y"), F.col("members").alias("m")), "y").groupBy(F.col("x").alias("class_name")).agg(F.sum("m").alias("m"))
    whole = sizes.join(linked, "class_name", "left").select("class_name", "class_id", "members", (F.coalesce("m", F.lit(0)) + F.col("members") - 1).alias("links"))
    return c.members.select("id", "class_name").join(whole, "class_name").drop("class_name")
