"""Queries for view search, comparison of views, and vector search by hashing; and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columnscout.operators import ann, fourc, relate, views
from columnscout.operators.views import Filter, Join
from columnscout.plans import lake
from columnscout.plans import view_search as view_search_plan
from columnscout.plans.lineage import Stages


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tables(spark, sf_dir, *names) -> dict[str, DataFrame]:
    return {n: _t(spark, sf_dir, n) for n in names}


STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


# --- view search ---
def filter_tables(spark, sf_dir):
    """Tables for the attributes n_name (holding NATION_0), c_name and n_regionkey."""
    filters = views.filters_of(["n_name", "c_name", "n_regionkey"], ["NATION_0", "", ""])
    t = views.filter_tables(views.fulfilling_columns(_tables(spark, sf_dir, *STAR), filters))
    return t.select("source_name", F.array_join("filters", ",").alias("filters"), F.col("n").cast("long").alias("n"))


def candidate_groups(spark, sf_dir):
    filters = views.filters_of(["n_name", "c_name", "o_orderpriority"], ["NATION_0", "", ""])
    rows = views.filter_tables(views.fulfilling_columns(_tables(spark, sf_dir, *STAR), filters)).collect()  # one row a table
    groups = views.candidate_groups([(r["source_name"], r["filters"]) for r in rows], len(filters))
    return spark.createDataFrame([(i, ",".join(t), len(f)) for i, (t, f) in enumerate(groups)], "number int, tables string, filters int")


def join_hop(spark, sf_dir):
    j = views.equi_join(_t(spark, sf_dir, "nation"), _t(spark, sf_dir, "customer"), "n_nationkey", "c_nationkey")
    return j.select("n_name", "c_name")


def view_two_tables(spark, sf_dir):
    """n_name = NATION_0 and c_name."""
    f = views.filters_of(["n_name", "c_name"], ["NATION_0", ""])
    v = views.materialise(_tables(spark, sf_dir, "nation", "customer"), [Join("nation", "n_nationkey", "customer", "c_nationkey")], f)
    return views.project(v, f, {0: ("nation", "n_name"), 1: ("customer", "c_name")})


def view_three_tables(spark, sf_dir):
    """r_name, n_name and c_name."""
    f = views.filters_of(["r_name", "n_name", "c_name"], ["", "", ""])
    joins = [Join("nation", "n_nationkey", "customer", "c_nationkey"), Join("region", "r_regionkey", "nation", "n_regionkey")]
    v = views.materialise(_tables(spark, sf_dir, "region", "nation", "customer"), joins, f)
    return views.project(v, f, {0: ("region", "r_name"), 1: ("nation", "n_name"), 2: ("customer", "c_name")})


def view_join_graphs(spark, sf_dir):
    """Join graphs for customer, nation and lineitem, with their names."""
    j = Join
    paths = {("customer", "nation"): [[j("customer", "c_nationkey", "nation", "n_nationkey")]],
             ("customer", "lineitem"): [[j("customer", "c_custkey", "orders", "o_custkey"), j("orders", "o_orderkey", "lineitem", "l_orderkey")]],
             ("lineitem", "nation"): [[j("lineitem", "l_suppkey", "supplier", "s_suppkey"), j("supplier", "s_nationkey", "nation", "n_nationkey")]]}
    graphs = views.join_graphs(["customer", "lineitem", "nation"], paths)
    return spark.createDataFrame([(views.graph_id(g), len(g)) for g in graphs], "graph string, joins int")


def view_search(spark, sf_dir):
    """n_name (holding NATION_0), c_name and o_orderpriority: the first view that the lake's key graph gives."""
    m = lake.lake_model(spark, sf_dir)
    tables = _tables(spark, sf_dir, *STAR)
    keys = relate.edges_of({"PKFK": m.keys()})
    return view_search_plan.first_view(tables, keys, m.columns, ["n_name", "c_name", "o_orderpriority"], ["NATION_0", "", ""])


def consistent_sample(spark, sf_dir):
    a, b = views.consistent_sample(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer"), "o_custkey", "c_custkey", 1000)
    return a.select("o_custkey").join(b.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


def find_key_for(spark, sf_dir):
    return views.find_key_for(_t(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", "Building")


def value_in_column(spark, sf_dir):
    return views.value_in_column(_t(spark, sf_dir, "nation"), "n_name", "nation_0")


def view_describe(spark, sf_dir):
    return views.describe(_t(spark, sf_dir, "orders"))


def table_cleanliness(spark, sf_dir):
    c = views.cleanliness(_t(spark, sf_dir, "cells"))
    return c.select("column", F.round("blank_share", 9).alias("blank_share"))


# --- comparison of views ---
def _views(spark, sf_dir) -> dict[str, DataFrame]:
    """Views of orders in each relation to the first."""
    a = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v"))
    return {"a": a, "b": a.orderBy(F.col("v").desc()).select("v", "k"), "c": a.where("v <> '1-URGENT'"),
            "d": a.where("v <> '2-HIGH'").unionByName(a.where("v = '2-HIGH'").select((-F.col("k")).alias("k"), "v")),
            "e": a.withColumn("v", F.when(F.col("v") == "5-LOW", "X").otherwise(F.col("v")))}


def view_relations(spark, sf_dir):
    return fourc.pair_relations(_views(spark, sf_dir), "k")


def view_summary(spark, sf_dir):
    return fourc.summary(fourc.pair_relations(_views(spark, sf_dir), "k"))


def curate_view(spark, sf_dir):
    v = _t(spark, sf_dir, "edges").select("source_node_id", "relation_type")
    return fourc.curate(v)


def view_uniqueness(spark, sf_dir):
    return fourc.column_uniqueness(_t(spark, sf_dir, "customer")).select("column", F.round("uniqueness", 9).alias("uniqueness"))


def view_contradictory(spark, sf_dir):
    v = _views(spark, sf_dir)
    return fourc.contradictions(fourc.curate(v["a"]), fourc.curate(v["e"]), "k")


def inconsistent_on_key(spark, sf_dir):
    v = _views(spark, sf_dir)
    return fourc.inconsistent_on_key(v["c"], v["e"], "k", "v")


# --- vectors ---
def _vectors(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _knn(spark, sf_dir, distance):
    v = _vectors(spark, sf_dir)
    return ann.exact_nearest(v.where("id % 50 = 0"), v, 10, distance).select("query", "id", F.round("distance", 6).alias("distance"), "rank")


def knn_cosine_x(spark, sf_dir):
    return _knn(spark, sf_dir, "cosine")


def knn_euclid_x(spark, sf_dir):
    return _knn(spark, sf_dir, "euclidean")


def knn_manhattan_x(spark, sf_dir):
    return _knn(spark, sf_dir, "manhattan")


def _hashed(spark, sf_dir, hashes) -> tuple[DataFrame, DataFrame]:
    """Bucket rows of the queries, and of all."""
    b = Stages(spark, "buckets").write(ann.buckets(_vectors(spark, sf_dir), hashes, "id", "v"), "b")
    return b.where("id % 50 = 0"), b


def rbp_buckets(spark, sf_dir):
    q, b = _hashed(spark, sf_dir, [ann.binary_projections(f"rbp{i}", 6, 64, i) for i in range(64)])
    return ann.search(q, b)


def rdp_buckets(spark, sf_dir):
    q, b = _hashed(spark, sf_dir, [ann.discretised_projections(f"rdp{i}", 2, 2.0, 64, i) for i in range(8)])
    return ann.search(q, b, distance="euclidean")


def pca_buckets(spark, sf_dir):
    q, b = _hashed(spark, sf_dir, ann.split(ann.pca_projections("pca", 63, _vectors(spark, sf_dir), "v"), 3))
    return ann.search(q, b)


def rbp_tree(spark, sf_dir):
    q, b = _hashed(spark, sf_dir, [ann.binary_projections(f"tree{i}", 12, 64, i) for i in range(32)])
    return ann.nearest_filter(ann.with_distance(ann.tree_candidates(q, b, 100)), 10)


def hamming1_probe(spark, sf_dir):
    q, b = _hashed(spark, sf_dir, [ann.binary_projections(f"h{i}", 8, 64, i) for i in range(32)])
    return ann.search(ann.hamming_probes(q), b)


def hamming2_permuted(spark, sf_dir):
    q, b = _hashed(spark, sf_dir, [ann.binary_projections(f"h{i}", 12, 64, i) for i in range(40)])
    return ann.nearest_filter(ann.with_distance(ann.hamming_within(q, b, 12, 2)), 10)


def distance_threshold(spark, sf_dir):
    """Pairs of one bucket that are nearer than 0.7, by a hash that puts all in one bucket."""
    q, b = _hashed(spark, sf_dir, [ann.unit_bucket("all", 64)])
    near = ann.threshold_filter(ann.unique_filter(ann.with_distance(ann.candidates(q, b).where("query <> id"), "cosine")), 0.7)
    return near.select("query", "id", F.round("distance", 6).alias("distance"))


def recall_precision(spark, sf_dir):
    q, b = _hashed(spark, sf_dir, [ann.binary_projections(f"rbp{i}", 4, 64, i) for i in range(24)])
    v = _vectors(spark, sf_dir)
    return ann.recall_precision(ann.search(q, b, include_self=False), ann.exact_nearest(v.where("id % 50 = 0"), v, 10))


QUERIES = {f.__name__: f for f in (filter_tables, candidate_groups, join_hop, view_two_tables, view_three_tables, view_join_graphs, view_search, consistent_sample, find_key_for, value_in_column, view_describe, table_cleanliness,
                                   view_relations, view_summary, curate_view, view_uniqueness, view_contradictory, inconsistent_on_key, knn_cosine_x, knn_euclid_x, knn_manhattan_x, rbp_buckets, rdp_buckets, pca_buckets, rbp_tree,
                                   hamming1_probe, hamming2_permuted, distance_threshold, recall_precision)}


def _knn_sql(distance: str) -> str:
    return f"""with p as (select q.vec_id as query, e.vec_id as id, round({distance}, 9) as distance from embeddings q join embeddings e on q.vec_id % 50 = 0 and q.vec_id <> e.vec_id),
r as (select *, row_number() over (partition by query order by distance, id) as rank from p) select query, id, round(distance, 6) as distance, rank from r where rank <= 10"""


_A, _B = "q.embedding::double[]", "e.embedding::double[]"
VIEWS = """a as (select o_orderkey as k, o_orderpriority as v from orders where o_orderkey is not null and o_orderpriority is not null),
c as (select * from a where v <> '1-URGENT'), d as (select case when v = '2-HIGH' then -k else k end as k, v from a), e as (select k, case when v = '5-LOW' then 'X' else v end as v from a)"""
_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_CELLS = ["nid", "source_name", "load_no", "row_no", "value", "received_at"]

RELATIONS_OF_VIEWS = f"""with {VIEWS}, vs as (select 'a' as n, k, v from a union all select 'b', k, v from a union all select 'c', k, v from c union all select 'd', k, v from d union all select 'e', k, v from e),
u as (select distinct n, k, v from vs), s as (select n, count(*) as c from u group by n),
sh as (select x.n as a, y.n as b, count(*) as shared from u x join u y on x.k = y.k and x.v = y.v and x.n < y.n group by 1, 2),
kc as (select x.n as a, y.n as b, count(distinct x.k) as conflicts from u x join u y on x.k = y.k and x.n < y.n and x.v <> y.v group by 1, 2),
p as (select x.n as a, y.n as b, x.c as na, y.c as nb, coalesce(shared, 0) as shared, coalesce(conflicts, 0) as conflicts from s x join s y on x.n < y.n left join sh on sh.a = x.n and sh.b = y.n left join kc on kc.a = x.n and kc.b = y.n)
select a, b, case when shared = na and shared = nb then 'compatible' when shared = least(na, nb) then 'contained' when conflicts > 0 then 'contradictory' else 'complementary' end as relation,
case when shared = na and shared = nb then shared when shared = least(na, nb) then least(na, nb) when conflicts > 0 then conflicts else shared end::bigint as detail from p"""

SQL = {
    "candidate_groups": "select 0 as number, 'customer,nation,orders' as tables, 3 as filters union all select 1, 'customer,nation', 2 union all select 2, 'customer', 1",
    "view_join_graphs": "select 'customer.c_custkey=orders.o_custkey|customer.c_nationkey=nation.n_nationkey|lineitem.l_orderkey=orders.o_orderkey' as graph, 3 as joins union all select 'customer.c_nationkey=nation.n_nationkey|lineitem.l_suppkey=supplier.s_suppkey|nation.n_nationkey=supplier.s_nationkey', 3 union all select 'customer.c_custkey=orders.o_custkey|lineitem.l_orderkey=orders.o_orderkey|lineitem.l_suppkey=supplier.s_suppkey|nation.n_nationkey=supplier.s_nationkey', 4",
    "view_search": "select n_name, c_name, o_orderpriority from nation join customer on n_nationkey = c_nationkey join orders on o_custkey = c_custkey where lower(n_name) = 'nation_0'",
    "filter_tables": "select 'nation' as source_name, case when exists (select 1 from nation where lower(n_name) = 'nation_0') then '0,2' else '2' end as filters, case when exists (select 1 from nation where lower(n_name) = 'nation_0') then 2 else 1 end::bigint as n union all select 'customer', '1', 1",
    "join_hop": "select n_name, c_name from nation join customer on n_nationkey = c_nationkey",
    "view_two_tables": "select n_name, c_name from nation join customer on n_nationkey = c_nationkey where lower(n_name) = 'nation_0'",
    "view_three_tables": "select r_name, n_name, c_name from region join nation on r_regionkey = n_regionkey join customer on n_nationkey = c_nationkey",
    "consistent_sample": "select c_custkey from customer where c_custkey in (select o_custkey from orders) order by c_custkey::varchar desc limit 1000",
    "find_key_for": "select c_custkey as key from customer where lower(c_mktsegment) = 'building'",
    "value_in_column": "select count(*) > 0 as found from nation where lower(n_name) = 'nation_0'",
    "view_describe": " union all ".join(f"select '{c}' as \"column\", count({c}) as n, count(distinct {c}) as \"distinct\", count(*) - count({c}) as nulls from orders" for c in _COLUMNS),
    "table_cleanliness": " union all ".join(f"select '{c}' as \"column\", round(sum(({c} is null or lower(trim({c}::varchar, ' ')) in ('', 'nan'))::int) / count(*), 9) as blank_share from cells" for c in _CELLS),
    "view_relations": f"""{RELATIONS_OF_VIEWS}""",
    "view_summary": f"""with r as ({RELATIONS_OF_VIEWS}), u as (select relation, a as v from r union select relation, b from r)
select relation, pairs, views from (select relation, count(*) as pairs from r group by 1) join (select relation, count(*) as views from u group by 1) using (relation)""",
    "curate_view": "select distinct relation_type::varchar as relation_type, source_node_id::varchar as source_node_id from edges where source_node_id is not null and relation_type is not null",
    "view_uniqueness": " union all ".join(f"select '{c}' as \"column\", round(count(distinct {c}) / count(*), 9) as uniqueness from customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
    "view_contradictory": f"with {VIEWS} select a.k::varchar as key, 1::bigint as rows_a, 1::bigint as rows_b from a join e using (k) where a.v <> e.v",
    "inconsistent_on_key": f"with {VIEWS} select k as key, case when c.v is null then 'missing_in_a' else 'conflicting' end as finding from e left join c using (k) where c.v is null or c.v <> e.v",
    "knn_cosine_x": _knn_sql(f"1 - list_inner_product({_A}, {_B}) / (sqrt(list_inner_product({_A}, {_A})) * sqrt(list_inner_product({_B}, {_B})))"),
    "knn_euclid_x": _knn_sql(f"list_distance({_A}, {_B})"),
    "knn_manhattan_x": _knn_sql(f"list_sum(list_transform(list_zip({_A}, {_B}), lambda x: abs(x[1] - x[2])))"),
    "distance_threshold": f"select q.vec_id as query, e.vec_id as id, round(round(1 - list_cosine_similarity({_A}, {_B}), 9), 6) as distance from embeddings q join embeddings e on q.vec_id % 50 = 0 and q.vec_id <> e.vec_id where round(1 - list_cosine_similarity({_A}, {_B}), 9) < 0.7",
}
