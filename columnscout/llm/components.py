"""Problem 3: consolidating pairwise matches into groups.

Connected components by randomised contraction: in each round every vertex takes, of
itself and its neighbours, the one that is first in a fresh hash order; edges are
relabelled with these choices and deduplicated, which loses a constant share of the
vertices on average whatever the shape of the graph (chains included). The choices of
all rounds are composed at the end. The last few links, of a fixed number at most, are contracted by one task:
rounds over so little are all start-up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnscout.plans.lineage import Stages

#: A round loses at least a quarter of the vertices on average; so many rounds are never needed.
MAX_ROUNDS = 200
#: From so many remaining links down one task contracts them, whatever the size of the graph.
LAST_LINKS = 20_000


def links_of(edges: DataFrame, nodes: DataFrame | None = None, types: tuple[int, ...] | None = None,
             source: str = "source_node_id", target: str = "target_node_id", kind: str = "relation_type",
             node: str = "node_id") -> DataFrame:
    """Undirected links (u < v), each once, of the edges of `types` whose ends are both in `nodes`.

    Edges with a missing end or type and edges of a node to itself are no links.
    """
    kept = edges if types is None else edges.where(F.col(kind).isin(*types))
    links = (kept.where(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target)))
             .select(F.least(source, target).alias("u"), F.greatest(source, target).alias("v")).distinct())
    if nodes is not None:
        known = nodes.select(F.col(node).alias("__node")).where("__node is not null").distinct()
        for end in ("u", "v"):
            links = links.join(known, F.col(end) == F.col("__node"), "left_semi")
    return links


def _choices(links: DataFrame, seed: int) -> DataFrame:
    """(u, rep): the first of u and its neighbours in the hash order of `seed`."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    order = lambda c: F.xxhash64(F.lit(seed), F.col(c))
    best = both.groupBy("u").agg(F.min_by("v", order("v")).alias("n"))
    return best.select("u", F.when(order("n") < order("u"), F.col("n")).otherwise(F.col("u")).alias("rep"))


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, rep) of links (u, v) that one task holds: the smallest label of each neighbourhood, with labels of labels, until nothing changes."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held))
    names, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u):]
    label, before = np.arange(len(names)), None
    while before is None or (label != before).any():
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)  # the roots of both ends hook to the smaller one
        np.minimum.at(label, label[b], least)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], ["u", "rep"])


def connected_groups(links: DataFrame, seed: int = 1, last_links: int = LAST_LINKS) -> DataFrame:
    """(node_id, group_id) of every vertex of `links` (u, v); group_id is the group's smallest vertex.

    Runs a few jobs a round. Each round's choices and remaining links are written
    stages, so losing an executor costs a task, not the run. Degrees may be of any
    unevenness: neighbours are pre-aggregated before they are shuffled, and joins on
    a vertex of very high degree have one row a vertex on the other side, so that
    adaptive execution can split them. An empty input gives an empty result; rows with
    a null end or with two equal ends are ignored.
    """
    stages = Stages(links.sparkSession, "components")
    links = links.where("u is not null and v is not null and u <> v").select(
        F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v"))
    left = stages.write(links.distinct(), "links0")
    rounds: list[DataFrame] = []
    while n := left.count():
        k = len(rounds)
        if n <= last_links:
            rounds.append(stages.write(left.repartition(1).mapInArrow(_last, "u long, rep long"), f"choice{k}"))
            break
        if k >= MAX_ROUNDS:
            raise RuntimeError(f"links remain after {MAX_ROUNDS} rounds of contraction")
        choice = stages.write(_choices(left, seed * 1_000_003 + k), f"choice{k}")
        a = choice.select("u", F.col("rep").alias("a"))
        b = choice.select(F.col("u").alias("v"), F.col("rep").alias("b"))
        moved = left.join(a, "u").join(b, "v").where("a <> b")
        after = stages.write(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"links{k + 1}")
        stages.drop(f"links{k}")
        rounds.append(choice)
        left = after
    if not rounds:
        return left.select(F.col("u").alias("node_id"), F.col("v").alias("group_id"))
    whole = rounds.pop()
    while rounds:
        step = whole.select(F.col("u").alias("rep"), F.col("rep").alias("root"))
        whole = rounds.pop().join(step, "rep", "left").select("u", F.coalesce("root", "rep").alias("rep"))
        if len(rounds) % 4 == 3:
            whole = stages.write(whole, f"whole{len(rounds)}")
    whole = stages.write(whole, "whole")
    least = whole.groupBy("rep").agg(F.min("u").alias("group_id"))
    return whole.join(least, "rep").select(F.col("u").alias("node_id"), "group_id")
