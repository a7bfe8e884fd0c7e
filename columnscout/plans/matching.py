"""Queries of vocabulary matching, each kind of evidence by itself, and of the comparison of views; and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columnscout.operators import fourc, onto, search
from columnscout.operators.drs import Drs
from columnscout.plans import discovery
from columnscout.plans.discovery import CUR, MATCH, VOCABULARY, _analyse
from columnscout.plans.search_views import VIEWS, _views

#: A small table of word vectors for the semantic queries, of unit length.
EMBEDDING = {"place": (1.0, 0.0, 0.0), "region": (0.8, 0.6, 0.0), "zone": (0.96, 0.28, 0.0), "site": (0.96, 0.0, 0.28), "address": (0.8, 0.0, 0.6), "room": (0.6, 0.8, 0.0), "floor": (0.6, 0.8, 0.0),
             "money": (0.0, 1.0, 0.0), "price": (0.0, 0.96, 0.28), "amount": (0.0, 0.8, 0.6), "fund": (0.28, 0.96, 0.0), "agent": (0.0, 0.0, 1.0), "vendor": (0.0, 0.28, 0.96), "owner": (0.0, 0.6, 0.8),
             "crew": (0.28, 0.0, 0.96), "permits": (0.6, 0.0, 0.8), "licences": (0.8, 0.0, 0.6), "papers": (0.8, 0.0, 0.6), "payroll": (0.0, 0.8, -0.6), "people": (0.0, 0.6, -0.8),
             "date": (-0.6, 0.8, 0.0), "shift": (-0.8, 0.6, 0.0), "count": (-0.28, 0.96, 0.0)}
#: Classes for tables: class and parent.
TABLE_VOCABULARY = [("goods", None), ("shipments", "goods"), ("compounds", "goods"), ("people", None), ("payroll", "people"), ("vendors", "people"), ("papers", None), ("permits", "papers"), ("licences", "papers"), ("surveys", "papers")]
#: Values of the instances of some classes, for matching by content.
INSTANCES = [("answer", "y"), ("answer", "n"), ("answer", "yes"), ("answer", "no"), ("missing", "unknown"), ("missing", "none"), ("missing", "n/a"), ("missing", "not stated")]


def _vocabulary(spark: SparkSession, classes: list = VOCABULARY) -> DataFrame:
    return spark.createDataFrame([("terms", n, p) for n, p in classes], "kr string, name string, parent string")


def _columns(spark, sf_dir) -> DataFrame:
    return discovery.columns_of(spark, sf_dir).where("field_name is not null and source_name is not null")


def _embedding(spark) -> DataFrame:
    return spark.createDataFrame([(t, list(v)) for t, v in EMBEDDING.items()], "token string, vector array<double>")


def _values(spark, sf_dir) -> DataFrame:
    return discovery._current(spark, sf_dir).select("nid", F.explode("t_data").alias("value"))


def _semantic(spark, sf_dir, ban_shared: bool = False) -> DataFrame:
    return onto.semantic(onto.attribute_elements(_columns(spark, sf_dir)), onto.class_elements(_vocabulary(spark)), _embedding(spark), ban_shared=ban_shared)


def match_relation_names(spark, sf_dir):
    """L4: tables and classes by their names."""
    m = onto.syntactic(onto.relation_elements(_columns(spark, sf_dir)), onto.class_elements(_vocabulary(spark, TABLE_VOCABULARY)), "L4", 0.3)
    return m.select("source_name", "name", F.round("score", 9).alias("score"))


def match_semantic(spark, sf_dir):
    """L52: column names and classes by their words' vectors, with a signal of any kind."""
    return _semantic(spark, sf_dir).where("signal <> 0").select("source_name", "field_name", "name", "signal", (F.round("score", 6) + F.lit(0.0)).alias("score"))


def match_relation_semantic(spark, sf_dir):
    """L42: tables and classes by their words' vectors, the words that both have left out."""
    m = onto.semantic(onto.relation_elements(_columns(spark, sf_dir)), onto.class_elements(_vocabulary(spark, TABLE_VOCABULARY)), _embedding(spark), positive=0.25, negative=0.0, ban_shared=True)
    return m.where("signal > 0").select("source_name", "name", (F.round("score", 6) + F.lit(0.0)).alias("score"))


def match_cancelled(spark, sf_dir):
    """L5 matchings against which no vectors speak."""
    m, _ = discovery._matchings(spark, sf_dir)
    return onto.cancel(m, _semantic(spark, sf_dir)).select("source_name", "field_name", "name")


def match_combined(spark, sf_dir):
    """The evidence of L5 and L52 for each pair of column and class."""
    m, _ = discovery._matchings(spark, sf_dir)
    more = _semantic(spark, sf_dir).where("signal > 0").select(*onto.ELEMENT, *onto.CLASS, F.lit("L52").alias("kind"), "score")
    return onto.combine(m.unionByName(more)).select("source_name", "field_name", "name", F.array_join("kinds", ",").alias("kinds"), F.col("n").cast("long").alias("n"))


def match_content(spark, sf_dir):
    """L2: columns whose values are much like the instances of a class."""
    classes = _vocabulary(spark)
    instances = spark.createDataFrame([("terms", c, v) for c, v in INSTANCES], "kr string, name string, value string")
    return onto.by_content(_values(spark, sf_dir), _columns(spark, sf_dir), classes, instances, least=0.05).select("source_name", "field_name", "name", F.round("score", 9).alias("score"))


def match_content_names(spark, sf_dir):
    """L1: columns whose values are names of the vocabulary's classes."""
    instances = spark.createDataFrame([("terms", v, None) for _, v in INSTANCES], "kr string, name string, parent string")
    return onto.by_content(_values(spark, sf_dir), _columns(spark, sf_dir), instances, least=0.05).select("source_name", "field_name", "kr", F.round("score", 9).alias("score"))


def match_context(spark, sf_dir):
    """L3: tables and classes by the words around them."""
    tables, classes = onto.contexts(_columns(spark, sf_dir), _vocabulary(spark))
    return onto.syntactic(tables, classes, "L3", 0.1).select("source_name", "name", F.round("score", 9).alias("score"))


def match_hierarchy(spark, sf_dir):
    """L7: columns that hold much of a class's children."""
    children = spark.createDataFrame([("terms", v, c) for c, v in INSTANCES], "kr string, name string, parent string")
    return onto.by_hierarchy(_values(spark, sf_dir), _columns(spark, sf_dir), children, least_children=4, accept=0.4).select("source_name", "field_name", "name", F.round("score", 9).alias("score"))


def match_cohesive(spark, sf_dir):
    """L6: tables and classes by the group of column words that belong together."""
    words = _columns(spark, sf_dir).select("source_name", onto.name_tokens(F.col("field_name")).alias("tokens"))
    groups = onto.cohesive_groups(words, _embedding(spark), 0.5)
    return onto.group_matchings(groups, onto.class_elements(_vocabulary(spark)), _embedding(spark), 0.5).select("source_name", "name", (F.round("score", 6) + F.lit(0.0)).alias("score"))


def keyword_columns(spark, sf_dir):
    """Columns by BM25 over their values, as a result set whose provenance is the keyword."""
    index = search.postings(_values(spark, sf_dir).withColumnRenamed("value", "text"))
    best = search.bm25(index, search.query_terms(spark, "pending office"), 20).join(_columns(spark, sf_dir), "nid")
    drs = Drs.lookup(best, "pending office")
    return drs.hits.join(drs.prov.select(F.col("dst_nid").alias("nid"), "op"), "nid").select("nid", "source_name", "field_name", "op", (F.round("score", 6) + F.lit(0.0)).alias("score"))


def view_equivalence(spark, sf_dir):
    """Whether views are equivalent, contained in each other or complementary."""
    v = {n: fourc.curate(x) for n, x in _views(spark, sf_dir).items()}
    rows = [(a, b, fourc.equivalent(v[a], v[b]), fourc.contained(v[b], v[a]), fourc.complementary(v[a], v[b], "k")) for a, b in (("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"))]
    return spark.createDataFrame(rows, "a string, b string, equivalent boolean, contained boolean, complementary boolean")


QUERIES = {f.__name__: f for f in (match_relation_names, match_semantic, match_relation_semantic, match_cancelled, match_combined, match_content, match_content_names, match_context, match_hierarchy, match_cohesive, keyword_columns, view_equivalence)}

_EMB = "emb as (select * from (values " + ", ".join(f"('{t}', [{', '.join(map(str, v))}]::double[])" for t, v in EMBEDDING.items()) + ") as x(token, vector))"
_INS = "ins as (select * from (values " + ", ".join(f"('{c}', '{v}')" for c, v in INSTANCES) + ") as x(name, value))"
_SPLIT = "list_filter(regexp_split_to_array(lower(regexp_replace({0}, '\\.csv$', '')), '[^a-z0-9]+'), lambda t: t <> '')"
_SEM = f"""{MATCH}, {_EMB},
els as (select source_name, field_name, unnest(list_filter(regexp_split_to_array({discovery._SNAKE.format('field_name')}, '[^a-z0-9]+'), lambda t: t <> '')) as tok from (select distinct table_name as source_name, node_name as field_name from nodes where node_name is not null and table_name is not null)),
pr as (select source_name, field_name, name, case when els.tok = cl.tok then 1.0 else coalesce(list_inner_product(a.vector, b.vector), 0.0) end as s
       from els cross join cl left join emb a on a.token = els.tok left join emb b on b.token = cl.tok),
sem as (select source_name, field_name, name, round(avg(s), 9) as score, case when round(avg(s), 9) >= 0.5 then 1 when round(avg(s), 9) < 0.4 then -1 else 0 end as signal from pr group by 1, 2, 3)"""
_TVOC = "tcl as (select * from (values " + ", ".join(f"('{n}')" for n, _ in TABLE_VOCABULARY) + ") as x(name))"
_TAB = f"{_TVOC}, tb as (select distinct table_name as source_name, unnest(list_distinct({_SPLIT.format('table_name')})) as tok from nodes where node_name is not null and table_name is not null)"
_CON = f"{CUR}, vv as (select distinct nid, lower(trim(v, ' ')) as value from val where v is not null and lower(trim(v, ' ')) <> ''), nv as (select nid, count(*) as n from vv group by 1)"

SQL = {
    "match_relation_names": f"""with {MATCH}, {_TAB}, nt as (select source_name, count(*) as n from tb group by 1)
select source_name, name, round(o / (nt.n + nc.n - o), 9) as score from (select source_name, name, 1 as n, count(*) as o from tb join tcl on tok = name group by 1, 2) as nc join nt using (source_name) where o / (nt.n + nc.n - o) >= 0.3 - 1e-9""",
    "match_semantic": f"with {_SEM} select source_name, field_name, name, signal, round(score, 6) + 0.0 as score from sem where signal <> 0",
    "match_relation_semantic": f"""with {MATCH}, {_EMB}, {_TAB},
sh as (select distinct source_name, name from tb join tcl on tok = name),
pr as (select source_name, name, coalesce(list_inner_product(a.vector, b.vector), 0.0) as s from tb cross join tcl left join emb a on a.token = tb.tok left join emb b on b.token = tcl.name
       where (source_name, name) not in (select source_name, name from sh))
select source_name, name, round(round(avg(s), 9), 6) + 0.0 as score from pr group by 1, 2 having round(avg(s), 9) >= 0.25""",
    "match_cohesive": f"""with {MATCH}, {_EMB}, t as (select distinct source_name, tok, vector from el join emb on token = tok),
g as (select a.source_name, a.tok, a.vector, round(avg(list_inner_product(a.vector, b.vector)), 9) as cohesion from t a join t b on a.source_name = b.source_name and a.tok <> b.tok group by 1, 2, 3 having round(avg(list_inner_product(a.vector, b.vector)), 9) >= 0.5),
s as (select source_name, name, round(avg(list_inner_product(g.vector, e.vector)), 9) as score, round(avg(cohesion), 9) as own from g cross join (select name, vector from cl join emb on token = tok) e group by 1, 2)
select source_name, name, round(score, 6) + 0.0 as score from s where score >= 0.5 and score >= own""",
    "match_cancelled": f"with {_SEM} select source_name, field_name, name from ma where (source_name, field_name, name) not in (select source_name, field_name, name from sem where signal < 0)",
    "match_combined": f"""with {_SEM}, al as (select source_name, field_name, name, 'L5' as kind from ma union select source_name, field_name, name, 'L52' from sem where signal > 0)
select source_name, field_name, name, string_agg(kind, ',' order by kind) as kinds, count(*) as n from al group by 1, 2, 3""",
    "match_content": f"""with {_CON}, {_INS}, ni as (select name, count(*) as n from ins group by 1)
select table_name as source_name, node_name as field_name, name, round(o / (nv.n + ni.n - o), 9) as score from (select nid, name, count(*) as o from vv join ins using (value) group by 1, 2) join nv using (nid) join ni using (name) join nodes on node_id = nid
where o / (nv.n + ni.n - o) >= 0.05 and node_name is not null and table_name is not null""",
    "match_content_names": f"""with {_CON}, {_INS}, s as (select count(*) as n from ins)
select table_name as source_name, node_name as field_name, 'terms' as kr, round(o / (nv.n + s.n - o), 9) as score from (select nid, count(*) as o from vv join ins using (value) group by 1) join nv using (nid) join nodes on node_id = nid, s
where o / (nv.n + s.n - o) >= 0.05 and node_name is not null and table_name is not null""",
    "match_context": f"""with {MATCH}, tt as (select source_name, tok from el union select distinct table_name, unnest({_SPLIT.format('table_name')}) from nodes where node_name is not null and table_name is not null),
ar as (select name, name as x from voc union select name, parent from voc where parent is not null union select parent, name from voc where parent is not null),
ct as (select distinct name, unnest(string_split(x, ' ')) as tok from ar),
a as (select source_name, count(*) as n from tt group by 1), b as (select name, count(*) as n from ct group by 1)
select source_name, name, round(o / (a.n + b.n - o), 9) as score from (select source_name, name, count(*) as o from tt join ct using (tok) group by 1, 2) join a using (source_name) join b using (name) where o / (a.n + b.n - o) >= 0.1 - 1e-9""",
    "match_hierarchy": f"""with {_CON}, {_INS}, ni as (select name, count(*) as n from ins group by 1),
hit as (select nid, name, count(distinct ins.value) as o from vv join ins on levenshtein(vv.value, ins.value) <= case when length(ins.value) <= 2 then 0 when length(ins.value) <= 5 then 1 else 2 end group by 1, 2)
select table_name as source_name, node_name as field_name, name, round(o / ni.n, 9) as score from hit join ni using (name) join nodes on node_id = nid where o / ni.n > 0.4 and node_name is not null and table_name is not null""",
    "keyword_columns": f"""with {CUR}, p as (select nid, term, count(*) as tf from (select nid, unnest({_analyse('v')}) as term from val where v is not null) group by 1, 2),
l as (select nid, sum(tf) as len from p group by 1), s as (select count(*) as n, avg(len) as al from l), q as (select * from p where term in ('pending', 'office')), f as (select term, count(*) as df from q group by 1),
sc as (select nid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 9) as score from q join f using (term) join l using (nid), s group by 1 order by score desc, nid limit 20)
select nid, table_name as source_name, node_name as field_name, 2 as op, round(score, 6) + 0.0 as score from sc join nodes on node_id = nid where node_name is not null and table_name is not null""",
    "view_equivalence": f"""with {VIEWS}, z as (select distinct lower(k::varchar) as k, lower(v) as v, n from (select k, v, 'a' as n from a union all select k, v, 'b' from a union all select k, v, 'c' from c union all select k, v, 'd' from d union all select k, v, 'e' from e)),
kb as (select n, list_sort(list(k)) as ks, list_sort(list(v)) as vs from z group by n)
select x.n as a, y.n as b, x.ks = y.ks and x.vs = y.vs as equivalent, list_has_all(x.ks, list_distinct(y.ks)) and list_has_all(x.vs, list_distinct(y.vs)) as contained, list_distinct(x.ks) is distinct from list_distinct(y.ks) and not (list_has_all(x.ks, y.ks) and list_has_all(y.ks, x.ks)) as complementary
from kb x join kb y on x.n = 'a' and y.n <> 'a'""",
}
