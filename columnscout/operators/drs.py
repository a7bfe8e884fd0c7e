"""Domain result sets: immutable results of discovery with provenance, set operators and ranking.

A Drs holds hits (nid, db_name, source_name, field_name, score), provenance edges (src_nid,
dst_nid, op) and a mode. compat: result sets are immutable, so absorbing while iterating is safe.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum, IntEnum
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from columnscout.operators import graph
from columnscout.plans.lineage import Stages

HIT = "nid long, db_name string, source_name string, field_name string, score double"
PROV = "src_nid long, dst_nid long, op int"


class Op(IntEnum):
    """What led to a hit."""

    NONE = 0
    ORIGIN = 1
    KW_LOOKUP = 2
    SCHNAME_LOOKUP = 3
    SCHEMA_SIM = 4
    TABLE = 5
    CONTENT_SIM = 6
    PKFK = 7
    ENTITY_SIM = 8
    ENTITY_LOOKUP = 9
    MEANS_SAME = 10
    MEANS_DIFF = 11
    SUBCLASS = 12
    SUPERCLASS = 13
    MEMBER = 14
    CONTAINER = 15
    INCLUSION_DEPENDENCY = 16


class Mode(Enum):
    FIELDS = "fields"
    TABLE = "table"


#: The relation type of the column graph behind each neighbour operator.
OP_OF_RELATION = {1: Op.SCHEMA_SIM, 2: Op.CONTENT_SIM, 3: Op.ENTITY_SIM, 5: Op.PKFK, 6: Op.INCLUSION_DEPENDENCY, 10: Op.MEANS_SAME, 11: Op.MEANS_DIFF,
                  12: Op.SUBCLASS, 13: Op.SUPERCLASS, 14: Op.MEMBER, 15: Op.CONTAINER}


@dataclass(frozen=True)
class Drs:
    hits: DataFrame
    prov: DataFrame
    mode: Mode = Mode.FIELDS

    # --- construction -------------------------------------------------
    @staticmethod
    def of(hits: DataFrame, op: Op = Op.ORIGIN, origin: int | None = None) -> Drs:
        """Hits that come from a seed (ORIGIN) or, with `origin`, from a lookup node of that id."""
        h = hits.select("nid", "db_name", "source_name", "field_name", F.col("score").cast("double").alias("score")).dropDuplicates(["nid"])
        source = F.col("nid") if origin is None else F.lit(origin).cast("long")
        return Drs(h, h.select(source.alias("src_nid"), F.col("nid").alias("dst_nid"), F.lit(int(op)).alias("op")))

    @staticmethod
    def lookup(hits: DataFrame, keyword: str, op: Op = Op.KW_LOOKUP) -> Drs:
        """Hits of a search; their provenance is a node of their own that stands for the keyword."""
        name = hits.sparkSession.range(1).select(F.xxhash64(F.lit(keyword))).first()[0]
        return Drs.of(hits, op, name)

    @staticmethod
    def empty(spark: SparkSession) -> Drs:
        return Drs(spark.createDataFrame([], HIT), spark.createDataFrame([], PROV))

    def lean(self) -> Drs:
        """The same hits without provenance."""
        return replace(self, prov=self.prov.limit(0))

    def fields(self) -> Drs:
        return replace(self, mode=Mode.FIELDS)

    def table(self) -> Drs:
        return replace(self, mode=Mode.TABLE)

    # --- views ------------------------------------------------------------
    def rows(self) -> DataFrame:
        """What iterating gives: the hits, or in table mode the distinct table names."""
        return self.hits if self.mode is Mode.FIELDS else self.hits.select("source_name").distinct()

    def size(self) -> int:
        return self.hits.count()

    def sources(self) -> DataFrame:
        """(source_name, fields): the hits by table."""
        return self.hits.groupBy("source_name").agg(F.array_sort(F.collect_set("field_name")).alias("fields"))

    def to_json(self) -> DataFrame:
        """(json): one object for each table with its fields."""
        return self.sources().select(F.to_json(F.struct("source_name", "fields")).alias("json"))

    # --- set operators ------------------------------------------------------
    def _same_mode(self, other: Drs) -> None:
        if self.mode is not other.mode:
            raise ValueError("both result sets must be in the same mode")

    def _merged(self, other: Drs) -> DataFrame:
        return self.prov.unionByName(other.prov).distinct()

    def union(self, other: Drs) -> Drs:
        """Hits of either, each nid once (also in table mode); of two scores that of `self` stays."""
        self._same_mode(other)
        both = self.hits.withColumn("__o", F.lit(0)).unionByName(other.hits.withColumn("__o", F.lit(1)))
        first = F.row_number().over(Window.partitionBy("nid").orderBy("__o"))
        return replace(self, hits=both.withColumn("__r", first).where("__r = 1").drop("__o", "__r"), prov=self._merged(other))

    absorb = union

    def intersection(self, other: Drs) -> Drs:
        """Hits of `self` whose nid is in `other`; in table mode the hits of both whose table is in both, each nid once."""
        self._same_mode(other)
        if self.mode is Mode.FIELDS:
            return replace(self, hits=self.hits.join(other.hits.select("nid"), "nid", "left_semi"), prov=self._merged(other))
        mine = self.hits.join(other.hits.select("source_name"), "source_name", "left_semi")
        theirs = other.hits.join(self.hits.select("source_name"), "source_name", "left_semi")
        return replace(self, hits=mine.select(self.hits.columns).unionByName(theirs.select(self.hits.columns)).dropDuplicates(["nid"]), prov=self._merged(other))

    def difference(self, other: Drs) -> Drs:
        """Hits of `self` whose nid isn't in `other`."""
        self._same_mode(other)
        return replace(self, hits=self.hits.join(other.hits.select("nid"), "nid", "left_anti"), prov=self._merged(other))

    # --- graph operators ------------------------------------------------
    def expand_to_table(self, columns: DataFrame) -> Drs:
        """All columns of the hits' tables, siblings and the hits themselves; op TABLE."""
        c = columns.select("nid", "db_name", "source_name", "field_name")
        t = self.hits.select(F.col("nid").alias("src_nid"), "db_name", "source_name").join(c, ["db_name", "source_name"])
        prov = t.select("src_nid", F.col("nid").alias("dst_nid"), F.lit(int(Op.TABLE)).alias("op"))
        hits = t.select("nid", "db_name", "source_name", "field_name").withColumn("score", F.lit(1.0)).dropDuplicates(["nid"])
        return Drs(hits, self.prov.unionByName(prov).distinct())

    def neighbours(self, edges: DataFrame, columns: DataFrame, relation: int) -> Drs:
        """Columns adjacent to the hits; in table mode to any column of the hits' tables. The best score of several edges stays."""
        seeds = self.expand_to_table(columns) if self.mode is Mode.TABLE else self
        n = graph.neighbours(seeds.hits, edges, relation)
        prov = n.select(F.col("origin").alias("src_nid"), F.col("nid").alias("dst_nid"), F.lit(int(OP_OF_RELATION[relation])).alias("op"))
        hits = n.groupBy("nid").agg(F.max("score").alias("score")).join(columns.select("nid", "db_name", "source_name", "field_name"), "nid")
        return Drs(hits.select("nid", "db_name", "source_name", "field_name", "score"), seeds.prov.unionByName(prov).distinct())

    def schema_similar_to(self, edges, columns) -> Drs:
        return self.neighbours(edges, columns, 1)

    def content_similar_to(self, edges, columns) -> Drs:
        return self.neighbours(edges, columns, 2)

    def pkfk_of(self, edges, columns) -> Drs:
        return self.neighbours(edges, columns, 5)

    def inclusion_dependency_to(self, edges, columns) -> Drs:
        return self.neighbours(edges, columns, 6)

    # --- provenance -------------------------------------------------------
    def _reach(self, max_hops: int | None = None) -> DataFrame:
        """(leaf, nid): what each leaf leads to along the provenance, itself included; to the end, or within max_hops. Each pair once, level by level, each level a written stage."""
        stages = Stages(self.prov.sparkSession, "provenance")
        steps = stages.write(self.prov.where("src_nid <> dst_nid").select("src_nid", "dst_nid").distinct(), "steps")
        level = seen = stages.write(leaf_nodes(self.prov).select(F.col("nid").alias("leaf"), "nid"), "reach0")
        for hop in count(1) if max_hops is None else range(1, max_hops + 1):
            new = level.join(steps, level["nid"] == steps["src_nid"]).select("leaf", F.col("dst_nid").alias("nid")).distinct().join(seen, ["leaf", "nid"], "left_anti")
            level = stages.write(new, f"reach{hop}")
            if level.isEmpty():
                break
            seen = seen.unionByName(level)
        return seen

    def _walk(self, max_hops: int | None = None) -> DataFrame:
        """(leaf, nid, hops, sum, seen, ops): all simple paths from every leaf along the provenance, until none grows, or within max_hops; sum of the scores passed, the nodes and the ops passed. Each level is a written stage."""
        stages = Stages(self.prov.sparkSession, "provenance")
        steps = self.prov.where("src_nid <> dst_nid").groupBy("src_nid", "dst_nid").agg(F.array_sort(F.collect_set("op")).alias("op"))  # as many as there are ops
        score = self.hits.select(F.col("nid").alias("dst_nid"), "score")
        steps = stages.write(steps.join(score, "dst_nid", "left").select("src_nid", "dst_nid", "op", F.coalesce("score", F.lit(0.0)).alias("score")), "steps")
        first = leaf_nodes(self.prov).select(F.col("nid").alias("leaf"), "nid", F.lit(0).alias("hops"), F.lit(0.0).alias("sum"), F.array("nid").alias("seen"), F.array().cast("array<array<int>>").alias("ops"))
        out = walk = stages.write(first, "walk0")
        for hop in count(1) if max_hops is None else range(1, max_hops + 1):
            new = walk.join(steps, walk["nid"] == steps["src_nid"]).where(~F.array_contains("seen", F.col("dst_nid")))
            new = new.select("leaf", F.col("dst_nid").alias("nid"), F.lit(hop).alias("hops"), (F.col("sum") + F.col("score")).alias("sum"), F.array_append("seen", F.col("dst_nid")).alias("seen"), F.array_append("ops", F.col("op")).alias("ops"))
            walk = stages.write(new, f"walk{hop}")
            if walk.isEmpty():
                break
            out = out.unionByName(walk)
        return out

    def provenance_paths(self, max_hops: int | None = None) -> DataFrame:
        """(leaf, nid, path): all simple provenance paths from a leaf to a node without successors."""
        heads = head_nodes(self.prov)
        return self._walk(max_hops).where("hops > 0").join(heads, "nid", "left_semi").select("leaf", "nid", F.col("seen").alias("path"))

    def paths_to(self, nid: int, max_hops: int | None = None) -> DataFrame:
        """(leaf, nid, path): all simple provenance paths from a leaf to one node."""
        return self._walk(max_hops).where((F.col("hops") > 0) & (F.col("nid") == nid)).select("leaf", "nid", F.col("seen").alias("path"))

    def why(self, max_hops: int | None = None) -> DataFrame:
        """(nid, leaf): the leaves that each hit comes from, over any number of steps or at most max_hops."""
        return self._reach(max_hops).join(self.hits.select("nid"), "nid", "left_semi").select("nid", "leaf")

    def how(self, columns: DataFrame, max_hops: int | None = None) -> DataFrame:
        """(nid, explanation): each path that leads from a leaf to a hit, as `table:field -> OP -> table:field -> ...`; several ops of a step are joined by `|`."""
        names = columns.select("nid", F.concat_ws(":", "source_name", "field_name").alias("name")).dropDuplicates(["nid"])
        ops = F.create_map(*(x for o in Op for x in (F.lit(int(o)), F.lit(o.name))))
        paths = self._walk(max_hops).where("hops > 0").join(self.hits.select("nid"), "nid", "left_semi")
        text = F.transform("ops", lambda o: F.array_join(F.transform(o, lambda x: F.element_at(ops, x)), "|"))
        at = paths.select("nid", F.col("seen").alias("path"), text.alias("ops")).select("nid", "path", "ops", F.posexplode("path").alias("at", "node"))
        named = at.join(names.select(F.col("nid").alias("node"), "name"), "node", "left").withColumn("name", F.coalesce("name", F.lit("lookup")))
        step = F.when(F.col("at") == 0, F.col("name")).otherwise(F.concat_ws(" -> ", F.get("ops", F.col("at") - 1), "name"))
        whole = named.groupBy("nid", "path").agg(F.array_sort(F.collect_list(F.struct("at", step.alias("text")))).alias("steps"))  # as long as the path
        return whole.select("nid", F.array_join(F.transform("steps", lambda x: x["text"]), " -> ").alias("explanation"))

    # --- ranking ----------------------------------------------------------------
    def certainty(self, max_hops: int | None = None) -> DataFrame:
        """(nid, certainty): the greatest sum of scores over the paths from a leaf. compat: the maximum of all branches."""
        best = self._walk(max_hops).groupBy("nid").agg(F.max("sum").alias("certainty"))
        return self.hits.select("nid").join(best, "nid", "left").select("nid", F.coalesce("certainty", F.lit(0.0)).alias("certainty"))

    def coverage(self, max_hops: int | None = None) -> DataFrame:
        """(nid, coverage): share of the leaves that a hit comes from."""
        n = leaf_nodes(self.prov).agg(F.count("*").alias("n"))
        each = self.why(max_hops).groupBy("nid").agg(F.count_distinct("leaf").alias("m"))
        out = self.hits.select("nid").join(each, "nid", "left").crossJoin(F.broadcast(n))  # one row
        return out.select("nid", F.when(F.col("n") > 0, F.coalesce("m", F.lit(0)) / F.col("n")).otherwise(0.0).alias("coverage"))

    def table_certainty(self, max_hops: int | None = None) -> DataFrame:
        """(source_name, certainty): sum over the table's hits."""
        return self.certainty(max_hops).join(self.hits, "nid").groupBy("source_name").agg(F.sum("certainty").alias("certainty"))

    def table_coverage(self, max_hops: int | None = None) -> DataFrame:
        """(source_name, coverage): share of the leaves that any of the table's hits comes from."""
        n = leaf_nodes(self.prov).agg(F.count("*").alias("n"))
        each = self.why(max_hops).join(self.hits, "nid").groupBy("source_name").agg(F.count_distinct("leaf").alias("m"))
        return each.crossJoin(F.broadcast(n)).select("source_name", (F.col("m") / F.col("n")).alias("coverage"))  # one row

    def ranked(self, by: str = "certainty", max_hops: int | None = None) -> DataFrame:
        """The hits with both scores, ordered by one, then the other, then nid."""
        other: Column = F.col("coverage" if by == "certainty" else "certainty").desc()
        return self.hits.join(self.certainty(max_hops), "nid").join(self.coverage(max_hops), "nid").orderBy(F.col(by).desc(), other, "nid")


def _real(prov: DataFrame) -> DataFrame:
    """Provenance edges without loops and without pairs that point at each other."""
    p = prov.where("src_nid <> dst_nid").select("src_nid", "dst_nid").distinct()
    back = p.select(F.col("dst_nid").alias("src_nid"), F.col("src_nid").alias("dst_nid"))
    return p.join(back, ["src_nid", "dst_nid"], "left_anti")


def leaf_nodes(prov: DataFrame) -> DataFrame:
    """(nid): nodes with successors but no predecessor; isolated nodes are ignored."""
    p = _real(prov)
    return p.select(F.col("src_nid").alias("nid")).distinct().join(p.select(F.col("dst_nid").alias("nid")), "nid", "left_anti")


def head_nodes(prov: DataFrame) -> DataFrame:
    """(nid): nodes with predecessors but no successor."""
    p = _real(prov)
    return p.select(F.col("dst_nid").alias("nid")).distinct().join(p.select(F.col("src_nid").alias("nid")), "nid", "left_anti")


def make_drs(spark: SparkSession, columns: DataFrame, *things) -> Drs:
    """A result set of any mix of: a Drs, a nid, a table name (table mode), (db, source, field), or None. compat: raises on anything else."""
    out, table = Drs.empty(spark), False
    hit = lambda c: c.select("nid", "db_name", "source_name", "field_name").withColumn("score", F.lit(1.0))
    for x in things:
        if x is None:
            continue
        if isinstance(x, Drs):
            part = x
        elif isinstance(x, int) or isinstance(x, str) and x.isdigit():
            part = Drs.of(hit(columns.where(F.col("nid") == int(x))))
        elif isinstance(x, str):
            part, table = Drs.of(hit(columns.where(F.col("source_name") == x)), Op.ORIGIN), True
        elif isinstance(x, tuple) and len(x) == 3:
            cond = (F.col("db_name") == x[0]) & (F.col("source_name") == x[1])
            table |= not x[2]
            part = Drs.of(hit(columns.where(cond & (F.col("field_name") == x[2]) if x[2] else cond)))
        else:
            raise TypeError(f"not a column, table or result set: {x!r}")
        out = replace(out, mode=part.mode).union(part)
    return out.table() if table else out
