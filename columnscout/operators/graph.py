"""The column graph: neighbours, traversal, paths, degree and report.

Edges are (src, dst, relation, score) with both directions stored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from columnscout.operators.relate import METADATA_FROM
from columnscout.plans.lineage import Stages


def undirected(edges: DataFrame, source: str = "source_node_id", target: str = "target_node_id", kind: str = "relation_type", weight: str = "weight") -> DataFrame:
    """(src, dst, relation, score) in both directions from stored edges; rows with a missing end or type and edges of a node to itself are left out, of repeats the greatest score stays."""
    e = edges.where(F.col(source).isNotNull() & F.col(target).isNotNull() & F.col(kind).isNotNull() & (F.col(source) != F.col(target)))
    one = e.select(F.col(source).alias("src"), F.col(target).alias("dst"), F.col(kind).alias("relation"), F.col(weight).cast("double").alias("score"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "score"))
    return both.groupBy("src", "dst", "relation").agg(F.max("score").alias("score"))


def neighbours(hits: DataFrame, edges: DataFrame, relation: int | None = None, exclude_origin: bool = False) -> DataFrame:
    """(origin, nid, relation, score): adjacent columns of the hits' nids over one relation, or over all."""
    e = edges if relation is None else edges.where(F.col("relation") == relation)
    out = e.join(hits.select(F.col("nid").alias("src")).distinct(), "src").select(F.col("src").alias("origin"), F.col("dst").alias("nid"), "relation", "score")
    if exclude_origin:
        out = out.join(hits.select("nid").distinct(), "nid", "left_anti")
    return out


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges after adding `more`; the score of the later edge wins."""
    both = edges.withColumn("__late", F.lit(0)).unionByName(more.withColumn("__late", F.lit(1)))
    return both.groupBy("src", "dst", "relation").agg(F.max_by("score", "__late").alias("score"))


def masks(edges: DataFrame) -> DataFrame:
    """(src, dst, mask): all relations of a pair as bits of one number."""
    return edges.groupBy("src", "dst").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("relation").cast("int"))).alias("mask"))


def mask_neighbours(masked: DataFrame, nid: int, relation: int) -> DataFrame:
    """(nid): neighbours over the edges whose mask has the relation."""
    bit = F.lit(1 << relation).cast("long")
    return masked.where((F.col("src") == nid) & (F.col("mask").bitwiseAND(bit) != 0)).select(F.col("dst").alias("nid"))


def traverse(hits: DataFrame, edges: DataFrame, relation: int, max_hops: int, stages: Stages | None = None) -> DataFrame:
    """(nid, hops): columns reached from the hits over one relation within max_hops, each with its least number of hops; the hits themselves are left out.

    Breadth first: only the newest level is joined with the edges, and every level is a written stage.
    """
    stages = stages or Stages(hits.sparkSession, "traverse")
    e = edges.where(F.col("relation") == relation).select("src", "dst").distinct()
    level = seen = stages.write(hits.select("nid").where("nid is not null").distinct().withColumn("hops", F.lit(0)), "level0")
    for hop in range(1, max_hops + 1):
        reached = e.join(level.select(F.col("nid").alias("src")), "src").select(F.col("dst").alias("nid")).distinct().join(seen, "nid", "left_anti")
        level = stages.write(reached.withColumn("hops", F.lit(hop)), f"level{hop}")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.where("hops > 0")


def levels(sources: DataFrame, edges: DataFrame, max_hops: int, stages: Stages) -> DataFrame:
    """(source, nid, hops): what each source reaches over `edges` (src, dst), with the least number of hops; each source itself at 0."""
    level = seen = stages.write(sources.select(F.col("nid").alias("source"), "nid").where("nid is not null").distinct().withColumn("hops", F.lit(0)), "reach0")
    for hop in range(1, max_hops + 1):
        reached = level.join(edges, level["nid"] == edges["src"]).select("source", F.col("dst").alias("nid")).distinct().join(seen, ["source", "nid"], "left_anti")
        level = stages.write(reached.withColumn("hops", F.lit(hop)), f"reach{hop}")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def paths(sources: DataFrame, targets: DataFrame, edges: DataFrame, relation: int, max_hops: int, shortest_only: bool = False) -> DataFrame:
    """(source, target, hops, path): all simple paths over one relation from a source to a target nid, of at most max_hops edges.

    compat: max_hops is honoured, and all paths come out, not only the first. Each hop is one equi-join; partial paths that end a hop away
    from any target are cut by a semi join in the last hop. With shortest_only all shortest paths of each pair: every node's least level is found first, breadth first, and a
    walk only steps to nodes whose level it has reached, so no longer path is ever formed.
    """
    e = edges.where(F.col("relation") == relation).select("src", "dst").distinct()
    goal = targets.select(F.col("nid").alias("target")).distinct()
    walk = sources.select("nid").where("nid is not null").distinct().select(F.col("nid").alias("source"), F.col("nid").alias("at"), F.array("nid").alias("path"))
    if shortest_only:
        stages = Stages(sources.sparkSession, "paths")
        e = stages.write(e, "edges")
        least = levels(sources, e, max_hops, stages)
    found = []
    for hop in range(1, max_hops + 1):
        step = e if hop < max_hops else e.join(goal.select(F.col("target").alias("dst")), "dst", "left_semi")
        walk = walk.join(step, walk["at"] == step["src"])
        if shortest_only:
            walk = walk.join(least.where(F.col("hops") == hop).select("source", F.col("nid").alias("dst")), ["source", "dst"])
        else:
            walk = walk.where(~F.array_contains("path", F.col("dst")))
        walk = walk.select("source", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"))
        found.append(walk.join(goal, walk["at"] == goal["target"], "left_semi").select("source", F.col("at").alias("target"), F.lit(hop).alias("hops"), "path"))
    return reduce(DataFrame.unionByName, found)


def table_paths(sources: list[str] | None, targets: list[str] | None, edges: DataFrame, columns: DataFrame, relation: int, max_hops: int = 2) -> DataFrame:
    """(source, target, hops, tables, joins): table-level paths; a hop goes from any column of a table over the relation to a column of a table not yet on the path.

    `sources` and `targets` are table names, or None for all tables. A path ends at its own target, and may lead through other targets.
    `joins` has the (left column, right column) of every hop. `columns` is (nid, source_name). compat: all paths, shortest first.
    """
    c = columns.select("nid", "source_name").where("source_name is not null")
    hop_edges = (edges.where(F.col("relation") == relation).select("src", "dst").distinct()
                 .join(c.select(F.col("nid").alias("src"), F.col("source_name").alias("t1")), "src").join(c.select(F.col("nid").alias("dst"), F.col("source_name").alias("t2")), "dst").where("t1 <> t2"))
    spark = edges.sparkSession
    start = hop_edges.select(F.col("t1").alias("source")).distinct() if sources is None else spark.createDataFrame([(s,) for s in dict.fromkeys(sources)], "source string")
    walk = start.select("source", F.col("source").alias("at"), F.array("source").alias("tables"), F.array().cast("array<struct<l:bigint,r:bigint>>").alias("joins"))
    found = []
    for hop in range(1, max_hops + 1):
        walk = walk.join(hop_edges, F.col("at") == F.col("t1")).where(~F.array_contains("tables", F.col("t2")))
        walk = walk.select("source", F.col("t2").alias("at"), F.array_append("tables", F.col("t2")).alias("tables"), F.array_append("joins", F.struct(F.col("src").alias("l"), F.col("dst").alias("r"))).alias("joins"))
        ends = walk if targets is None else walk.where(F.col("at").isin(targets))
        found.append(ends.select("source", F.col("at").alias("target"), F.lit(hop).alias("hops"), "tables", "joins"))
    return reduce(DataFrame.unionByName, found)


def degrees(edges: DataFrame, k: int | None = None) -> DataFrame:
    """(nid, degree): parallel edges count each; with k the k highest (ties by nid)."""
    d = edges.groupBy(F.col("src").alias("nid")).agg(F.count("*").alias("degree"))
    return d if k is None else d.orderBy(F.col("degree").desc(), "nid").limit(k)


def enumerate_relation(edges: DataFrame, relation: int) -> DataFrame:
    """(src, dst, score): each pair of the relation once, src < dst."""
    return edges.where((F.col("relation") == relation) & (F.col("src") < F.col("dst"))).select("src", "dst", "score")


def report(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """(what, n): numbers of tables, columns, and pairs of each relation."""
    c = columns.agg(F.count_distinct("source_name").alias("tables"), F.count_distinct("nid").alias("columns"))
    counts = c.select(F.inline(F.array(F.struct(F.lit("tables").alias("what"), F.col("tables").alias("n")), F.struct(F.lit("columns").alias("what"), F.col("columns").alias("n")))))
    pairs = edges.where("src < dst").groupBy("relation").agg(F.count("*").alias("n"))
    return counts.union(pairs.select(F.concat(F.lit("relation "), F.col("relation").cast("string")), "n"))


def from_metadata(relation) -> bool:
    """Whether a relation type comes from annotations."""
    return relation >= METADATA_FROM


def synthetic(spark: SparkSession, nodes: int, per_table: int, relations: dict[int, int], scores: dict[int, float]) -> tuple[DataFrame, DataFrame]:
    """A synthetic network for benches: columns (nid, source_name, field_name) and edges; `relations` has the number of edges of each type.

    With more edges than nodes, node n is linked to the next edges/nodes nodes in a ring, else every nodes/edges-th node to the next.
    compat: long ids, each field once.
    """
    columns = spark.range(nodes).select(F.col("id").alias("nid"), F.concat(F.lit("synt"), (F.col("id") / per_table).cast("long").cast("string")).alias("source_name"), F.concat(F.lit("synf"), F.col("id").cast("string")).alias("field_name"))
    parts = []
    for kind, m in relations.items():
        if m > nodes:
            e = spark.range(nodes).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(m // nodes))).alias("k")).select("src", ((F.col("src") + F.col("k")) % nodes).alias("dst"))
        else:
            hop = max(1, nodes // max(1, m))
            e = spark.range(m).select(((F.col("id") * hop + kind) % nodes).alias("src"), ((F.col("id") * hop + kind + hop) % nodes).alias("dst"))
        parts.append(e.where("src <> dst").select("src", "dst", F.lit(kind).alias("relation"), F.lit(scores[kind]).alias("score")))
    one = reduce(DataFrame.unionByName, parts)
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "score"))
    return columns, both.groupBy("src", "dst", "relation").agg(F.max("score").alias("score"))
