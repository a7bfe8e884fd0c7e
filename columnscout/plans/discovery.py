"""Queries over the stored catalogue: graph, result sets, search, annotations, drift and matching; and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columnscout.functions.latest import latest_rows
from columnscout.functions.text import name_tokens
from columnscout.operators import annotations as A
from columnscout.operators import drift, graph, onto, quality, relate, search
from columnscout.operators.drs import Drs
from columnscout.plans.catalogue import COUNTS
from columnscout.plans.lineage import Stages, keep_until_release, shared_folder
from columnscout.streaming import profile as stream
from columnscout.streaming.profile import windowed_counts


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(spark, sf_dir) -> DataFrame:
    """The stored columns as the algebra names them."""
    return _t(spark, sf_dir, "nodes").select(F.col("node_id").alias("nid"), F.lit("lake").alias("db_name"), F.col("table_name").alias("source_name"), F.col("node_name").alias("field_name"), "unique_ratio")


def graph_of(spark, sf_dir) -> DataFrame:
    """Stored edges whose ends are both known, in both directions."""
    e = graph.undirected(_t(spark, sf_dir, "edges"))
    known = _t(spark, sf_dir, "nodes").select("node_id")
    return e.join(known.select(F.col("node_id").alias("src")), "src", "left_semi").join(known.select(F.col("node_id").alias("dst")), "dst", "left_semi")


def keys_of(spark, sf_dir) -> DataFrame:
    """Seeds: columns that are nearly unique."""
    c = columns_of(spark, sf_dir)
    return c.where("unique_ratio >= 0.97").select("nid", "db_name", "source_name", "field_name", F.lit(1.0).alias("score"))


def _parts(spark, sf_dir) -> tuple[Drs, DataFrame, DataFrame]:
    return Drs.of(keys_of(spark, sf_dir)), graph_of(spark, sf_dir), columns_of(spark, sf_dir)


# --- graph ---
def neighbors_pkfk(spark, sf_dir):
    n = graph.neighbours(keys_of(spark, sf_dir), graph_of(spark, sf_dir), 5)
    return n.select("origin", "nid", F.round("score", 4).alias("score"))


def neighbors_content(spark, sf_dir):
    n = graph.neighbours(keys_of(spark, sf_dir), graph_of(spark, sf_dir), 2, exclude_origin=True)
    return n.select("origin", "nid", F.round("score", 4).alias("score"))


def edge_masks(spark, sf_dir):
    return graph.masks(graph_of(spark, sf_dir))


def table_neighbors(spark, sf_dir):
    drs, _, c = _parts(spark, sf_dir)
    return drs.expand_to_table(c).hits.select("nid", "source_name", "field_name")


def traverse_2hop(spark, sf_dir):
    return graph.traverse(keys_of(spark, sf_dir), graph_of(spark, sf_dir), 2, 2)


def khop_reachability(spark, sf_dir):
    return graph.traverse(keys_of(spark, sf_dir), graph_of(spark, sf_dir), 5, 3).groupBy("hops").agg(F.count("*").alias("n"))


def all_paths(spark, sf_dir):
    k = keys_of(spark, sf_dir)
    return graph.paths(k, k, graph_of(spark, sf_dir), 5, 2).select("source", "target", "hops", F.array_join("path", ",").alias("path"))


def shortest_paths(spark, sf_dir):
    k = keys_of(spark, sf_dir)
    return graph.paths(k, k, graph_of(spark, sf_dir), 5, 2, shortest_only=True).groupBy("source", "target", "hops").agg(F.count("*").alias("paths"))


def table_paths(spark, sf_dir):
    """Joins of at most two hops between any two tables."""
    p = graph.table_paths(None, None, graph_of(spark, sf_dir), columns_of(spark, sf_dir), 5, 2)
    return p.groupBy("source", "target", "hops").agg(F.count("*").alias("paths"))


def degree_topk(spark, sf_dir):
    return graph.degrees(graph_of(spark, sf_dir), 20)


def relation_report(spark, sf_dir):
    return graph.report(graph_of(spark, sf_dir), columns_of(spark, sf_dir))


def enumerate_content(spark, sf_dir):
    return graph.enumerate_relation(graph_of(spark, sf_dir), 2).select("src", "dst", F.round("score", 4).alias("score"))


def synthetic_network(spark, sf_dir):
    """Degrees of a synthetic network of 100,000 columns, for benches."""
    _, e = graph.synthetic(spark, 100_000, 10, {1: 90_000, 2: 90_000, 5: 90_000}, {1: 0.2, 2: 0.5, 5: 0.8})
    return graph.degrees(e).groupBy("degree").agg(F.count("*").alias("n"))


# --- result sets ---
def _two(spark, sf_dir) -> tuple[Drs, Drs]:
    d, e, c = _parts(spark, sf_dir)
    return d.content_similar_to(e, c), d.schema_similar_to(e, c)


def drs_union(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.union(b).hits.select("nid", "source_name", "field_name")


def drs_intersection_fields(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.intersection(b).hits.select("nid", "source_name", "field_name")


def drs_intersection_table(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.table().intersection(b.table()).hits.select("nid", "source_name", "field_name")


def drs_difference(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.difference(b).hits.select("nid", "source_name", "field_name")


def drs_sources(spark, sf_dir):
    a, _ = _two(spark, sf_dir)
    return a.sources().select("source_name", F.array_join("fields", ",").alias("fields"))


def drs_inclusion(spark, sf_dir):
    d, e, c = _parts(spark, sf_dir)
    return d.table().inclusion_dependency_to(e, c).hits.select("nid", "source_name")


def provenance_edges(spark, sf_dir):
    a, _ = _two(spark, sf_dir)
    return a.prov.select("src_nid", "dst_nid", "op")


def why(spark, sf_dir):
    a, _ = _two(spark, sf_dir)
    return a.why()


def how(spark, sf_dir):
    a, _ = _two(spark, sf_dir)
    return a.how(columns_of(spark, sf_dir))


def coverage_rank(spark, sf_dir):
    a, _ = _two(spark, sf_dir)
    return a.coverage().select("nid", F.round("coverage", 9).alias("coverage"))


def certainty_rank(spark, sf_dir):
    a, _ = _two(spark, sf_dir)
    return a.certainty().select("nid", F.round("certainty", 4).alias("certainty"))


def table_rank(spark, sf_dir):
    a, _ = _two(spark, sf_dir)
    return a.table_certainty().join(a.table_coverage(), "source_name", "left").select("source_name", F.round("certainty", 3).alias("certainty"), F.round("coverage", 9).alias("coverage"))


# --- search ---
def _current(spark, sf_dir) -> DataFrame:
    rows = _t(spark, sf_dir, "modeldb").select("nid", "updated_at", "received_at", "filename", "columnname", "t_data")
    return latest_rows(rows, ["nid"], "updated_at", ["received_at", "t_data"])


def exact_attribute(spark, sf_dir):
    return search.exact_search(columns_of(spark, sf_dir), "region").select("nid", "source_name", "field_name")


def keyword_names(spark, sf_dir):
    return search.name_search(columns_of(spark, sf_dir), ["price", "amount"]).select("nid", "field_name")


def keyword_content(spark, sf_dir):
    values = _current(spark, sf_dir).select("nid", F.explode("t_data").alias("value"))
    return search.content_search(values, ["pending", "various"])


def keyword_bm25(spark, sf_dir):
    index = search.postings(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return search.bm25(index, search.query_terms(spark, "The ledger of the warehouse, reloaded on 12 March"), 20, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


def fuzzy_keyword(spark, sf_dir):
    return search.fuzzy_match(columns_of(spark, sf_dir).select("nid", "field_name"), "adress", k=None)


def suggest_schema(spark, sf_dir):
    return search.suggest_schema(columns_of(spark, sf_dir), "shift", 10).select("field_name", "edits")


def text_signature_terms(spark, sf_dir):
    values = _current(spark, sf_dir).select("nid", F.explode("t_data").alias("text"))
    return search.text_signatures(search.postings(values))


def text_term_sim(spark, sf_dir):
    """Columns with similar content by their frequent terms."""
    return relate.text_similarity(text_signature_terms(spark, sf_dir), 0.7).select("src", "dst", F.round("score", 6).alias("score"))


def schema_sim_hashed(spark, sf_dir):
    """Similar names of stored columns, by latent vectors of their hashed name tokens: all pairs of names of a cosine of at least 0.8.

    A name is the hash of its lower-case tokens in order, and has one row for each similar name, however many columns have it.
    """
    names = columns_of(spark, sf_dir).where("field_name is not null").select(name_tokens(F.lower("field_name")).alias("tokens")).where("size(tokens) > 0").distinct()
    v = Stages(spark, "latent").write(relate.reduced_vectors(names.select(F.xxhash64("tokens").alias("nid"), "tokens")), "v")
    return relate.hashed_similarity(v)


def stored_signatures(spark, sf_dir):
    p = latest_rows(_t(spark, sf_dir, "profile"), ["id", "load_no"], "updated_at", ["received_at"]).select(F.col("id").alias("nid"), "load_no", F.col("dataType").alias("data_type"), "median", "iqr", F.col("minValue").alias("min_value"), F.col("maxValue").alias("max_value"))
    return p.where("data_type = 'N'").select("nid", "load_no", *(F.col(c).cast("double").alias(c) for c in ("median", "iqr", "min_value", "max_value")))


def peek_values(spark, sf_dir):
    values = _current(spark, sf_dir).select("nid", F.explode("t_data").alias("value"))
    return search.peek_values(values, 3).select("nid", F.array_join("values", "|").alias("values"))


def minhash_lsh_pairs(spark, sf_dir):
    """Columns whose stored sketches agree in at least 0.7 of the slots."""
    p = latest_rows(_t(spark, sf_dir, "profile").select("id", "load_no", "updated_at", "received_at", "dataType", "minhash"), ["id"], "load_no", ["updated_at", "received_at"])
    sketches = p.where("size(minhash) = 512").select(F.col("id").alias("nid"), "minhash")
    return relate.minhash_content_similarity(Stages(spark, "sketches").write(sketches, "s"), 0.7, 8)


# --- drift ---
def col_jaccard_change(spark, sf_dir):
    """Every load of every column against the load before, over the rows that count."""
    values = quality.value_counts(_t(spark, sf_dir, "cells")).select("nid", "load_no", "value")
    return drift.load_jaccard(values).select("nid", "load_no", "old_size", "new_size", "shared", F.round("jaccard", 9).alias("jaccard"))


def new_and_removed_tables(spark, sf_dir):
    """Of every load of the lake against the one before."""
    return drift.load_changes(_t(spark, sf_dir, "cells").select("source_name", "load_no"))


# --- annotations ---
def _annotations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents about a column as annotations of it, and reviews as comments."""
    d = _t(spark, sf_dir, "documents").where("nid is not null")
    a = d.select(F.col("doc_id").cast("string").alias("md_id"), F.col("source").alias("author"), "text", F.lit("insight").alias("md_class"), F.col("nid").alias("source"),
                 F.lit(None).cast("struct<id:bigint,type:string>").alias("target"), F.array(F.struct(F.lit("import").alias("author"), F.col("created_at").cast("timestamp").alias("creation_date"), F.col("lang").alias("tag"))).alias("tags"),
                 F.col("created_at").cast("timestamp").alias("creation_date"), F.col("received_at").cast("timestamp").alias("updated_date"))
    c = _t(spark, sf_dir, "doclabels").select(F.concat_ws("-", "doc_id", "reviewer").alias("id"), F.col("doc_id").cast("string").alias("md_id"), F.col("reviewer").alias("author"), F.col("kind").alias("text"), F.col("labelled_at").cast("timestamp").alias("creation_date"))
    return a, c


def md_search(spark, sf_dir):
    return A.search_text(_annotations(spark, sf_dir)[0], "ledger").select("md_id", F.col("source").alias("nid"))


def md_tags(spark, sf_dir):
    a, _ = _annotations(spark, sf_dir)
    return a.select("source", F.inline("tags")).where("tag is not null").groupBy("tag").agg(F.count("*").alias("n"))


def md_comments(spark, sf_dir):
    a, c = _annotations(spark, sf_dir)
    return A.with_comments(a, c).select("md_id", F.coalesce(F.size("comments"), F.lit(0)).alias("n")).where("n > 0")


# --- vocabulary ---
#: A small vocabulary for the matching queries: class and parent.
VOCABULARY = [("thing", None), ("place", "thing"), ("zone", "place"), ("region", "place"), ("site address", "place"), ("room", "site address"), ("floor", "site address"),
              ("money", "thing"), ("price", "money"), ("amount", "money"), ("agent", "thing"), ("vendor name", "agent"), ("owner", "agent"), ("crew", "agent"), ("date", "thing"), ("shift date", "date")]


def _matchings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v = spark.createDataFrame([("terms", n, p) for n, p in VOCABULARY], "kr string, name string, parent string")
    c = columns_of(spark, sf_dir).where("field_name is not null and source_name is not null")
    return onto.syntactic(onto.attribute_elements(c), onto.class_elements(v), "L5", 0.5), v


def name_class_match(spark, sf_dir):
    m, _ = _matchings(spark, sf_dir)
    return m.select("source_name", "field_name", "name", F.round("score", 9).alias("score"))


def ancestor_pairs(spark, sf_dir):
    return onto.ancestors(_matchings(spark, sf_dir)[1]).select("name", "ancestor", "distance")


def ancestor_summary(spark, sf_dir):
    m, v = _matchings(spark, sf_dir)
    return onto.summarise_to_ancestor(m, v, fan_out=1, share=0.5, least_depth=0).select("source_name", "field_name", "name")


def is_a_links(spark, sf_dir):
    """Links between tables by the classes of their columns."""
    m, v = _matchings(spark, sf_dir)
    t = m.select("db_name", "source_name", F.lit("_").alias("field_name"), "kr", "name").distinct()
    return onto.find_links(t, v).select("source_name", "parent_source_name")


def match_precision_recall(spark, sf_dir):
    """Matchings at 0.5 against those at 1, as precision and recall."""
    m, _ = _matchings(spark, sf_dir)
    r = drift.precision_recall(m.where("score >= 0.999"), m, [*onto.ELEMENT, *onto.CLASS])
    return r.select(*(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


# --- events ---
def stream_profile(spark, sf_dir):
    """The cells as a stream of micro-batches whose sketches are merged."""
    root = f"{shared_folder(spark)}/columnscout-stream-{uuid.uuid4().hex}"
    live = spark.readStream.schema(_t(spark, sf_dir, "cells").schema).parquet(f"{sf_dir}/cells.parquet*")  # a file or a folder
    q = stream.start(live.select("nid", "value"), f"{root}/out", f"{root}/ck")
    q.processAllAvailable()
    q.stop()
    keep_until_release(spark, root)
    return stream.read_sketches(stream.merge_sketches(spark.read.parquet(f"{root}/out")))


def events_windowed(spark, sf_dir):
    return windowed_counts(_t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 hour", "2 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "key", "n")


QUERIES = {f.__name__: f for f in (
    neighbors_pkfk, neighbors_content, edge_masks, table_neighbors, traverse_2hop, khop_reachability, all_paths, shortest_paths, table_paths, degree_topk, relation_report, enumerate_content, synthetic_network,
    drs_union, drs_intersection_fields, drs_intersection_table, drs_difference, drs_sources, drs_inclusion, provenance_edges, why, how, coverage_rank, certainty_rank, table_rank,
    exact_attribute, keyword_names, keyword_content, keyword_bm25, fuzzy_keyword, suggest_schema, text_signature_terms, text_term_sim, schema_sim_hashed, stored_signatures, peek_values, minhash_lsh_pairs,
    col_jaccard_change, new_and_removed_tables, md_search, md_tags, md_comments, name_class_match, ancestor_pairs, ancestor_summary, is_a_links, match_precision_recall, events_windowed, stream_profile)}

G = """one as (select source_node_id as src, target_node_id as dst, relation_type as relation, weight::double as score from edges
  where source_node_id is not null and target_node_id is not null and relation_type is not null and source_node_id <> target_node_id
    and source_node_id in (select node_id from nodes) and target_node_id in (select node_id from nodes)),
g as (select src, dst, relation, max(score) as score from (select * from one union all select dst, src, relation, score from one) group by 1, 2, 3),
ks as (select node_id as nid, table_name as source_name, node_name as field_name from nodes where unique_ratio >= 0.97)"""
AB = f"""{G}, a as (select distinct dst as nid from g join ks on src = nid where relation = 2), b as (select distinct dst as nid from g join ks on src = nid where relation = 1),
n as (select node_id as nid, table_name as source_name, node_name as field_name from nodes)"""
PR = f"""{G}, steps as (select distinct src as s, dst as d, score from g join ks on src = nid where relation = 2),
real_ as (select s, d from steps where (d, s) not in (select s, d from steps)),
nm as (select node_id as nid, concat_ws(':', table_name, node_name) as name from nodes),
leaf as (select distinct s as leaf from real_ where s not in (select d from real_)),
hit as (select d as nid, max(score) as score from steps group by d),
walk as (select leaf, leaf as nid, 0.0::double as total, [leaf] as path, coalesce(name, 'lookup') as text from leaf left join nm on nm.nid = leaf
  union all select w.leaf, d, total + coalesce(h.score, 0), list_append(path, d), w.text || ' -> CONTENT_SIM -> ' || coalesce(name, 'lookup') from walk w join steps on s = w.nid left join hit h on h.nid = d left join nm on nm.nid = d where not list_contains(path, d)),
wy as (select distinct w.nid, leaf from walk w join hit using (nid)),
cert as (select hit.nid, coalesce(max(total), 0) as certainty from hit left join walk using (nid) group by 1)"""
STOP = "('a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with')"


def _analyse(c: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower({c}), '\\.csv', ' ', 'g'), '[''’]s\\b', '', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '' and t not in {STOP})"


CUR = "cur as (select * from modeldb where nid is not null qualify row_number() over (partition by nid order by updated_at desc nulls last, received_at desc nulls last) = 1), val as (select nid, unnest(t_data) as v from cur)"
_VOC = ", ".join(f"('{n}', {'null' if p is None else repr(p)})" for n, p in VOCABULARY)
_SNAKE = "lower(regexp_replace(regexp_replace({0}, '([^_])([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"
MATCH = f"""voc as (select * from (values {_VOC}) as x(name, parent)),
el as (select distinct table_name as source_name, node_name as field_name, unnest(list_distinct(list_filter(regexp_split_to_array({_SNAKE.format('node_name')}, '[^a-z0-9]+'), lambda t: t <> ''))) as tok from nodes where node_name is not null and table_name is not null),
cl as (select name, unnest(string_split(name, ' ')) as tok from voc),
ne as (select source_name, field_name, count(*) as n from el group by 1, 2), nc as (select name, count(*) as n from cl group by 1),
ma as (select source_name, field_name, name, o / (ne.n + nc.n - o) as score from (select source_name, field_name, name, count(*) as o from el join cl using (tok) group by 1, 2, 3) join ne using (source_name, field_name) join nc using (name) where o / (ne.n + nc.n - o) >= 0.5)"""
UP = "up as (select name, parent as ancestor, 1 as distance from voc where parent is not null union all select u.name, v.parent, distance + 1 from up u join voc v on v.name = u.ancestor where v.parent is not null)"

SQL = {
    "text_term_sim": f"""with {CUR}, tf as (select nid, term, count(*) as tf from (select nid, unnest({_analyse('v')}) as term from val where v is not null) where length(term) > 3 and not regexp_matches(term, '[0-9]') group by 1, 2 having count(*) > 3),
n as (select count(distinct nid) as n from tf), d as (select term, count(*) as df from tf group by 1), w0 as (select nid, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) as w from tf join d using (term), n),
w as (select nid, term, w / sqrt(sum(w * w) over (partition by nid)) as w from w0)
select a.nid as src, b.nid as dst, round(round(sum(a.w * b.w), 9), 6) as score from w a join w b on a.term = b.term and a.nid <> b.nid group by 1, 2 having round(sum(a.w * b.w), 9) >= 0.7""",
    "neighbors_pkfk": f"with {G} select src as origin, dst as nid, round(score, 4) as score from g join ks on src = nid where relation = 5",
    "neighbors_content": f"with {G} select src as origin, dst as nid, round(score, 4) as score from g join ks on src = nid where relation = 2 and dst not in (select nid from ks)",
    "edge_masks": f"with {G} select src, dst, bit_or(1::bigint << relation) as mask from g group by 1, 2",
    "table_neighbors": f"with {G} select distinct node_id as nid, table_name as source_name, node_name as field_name from nodes where table_name in (select source_name from ks)",
    "traverse_2hop": f"with {G}, h1 as (select distinct dst as nid from g join ks on src = nid where relation = 2 and dst not in (select nid from ks)), h2 as (select distinct dst as nid from g join h1 on src = nid where relation = 2 and dst not in (select nid from ks union all select nid from h1)) select nid, 1 as hops from h1 union all select nid, 2 from h2",
    "khop_reachability": f"with {G}, h1 as (select distinct dst as nid from g join ks on src = nid where relation = 5 and dst not in (select nid from ks)), h2 as (select distinct dst as nid from g join h1 on src = nid where relation = 5 and dst not in (select nid from ks union all select nid from h1)), h3 as (select distinct dst as nid from g join h2 on src = nid where relation = 5 and dst not in (select nid from ks union all select nid from h1 union all select nid from h2)), al as (select 1 as hops, nid from h1 union all select 2, nid from h2 union all select 3, nid from h3) select hops, count(*) as n from al group by 1",
    "all_paths": f"with {G}, e as (select distinct src, dst from g where relation = 5) select src as source, dst as target, 1 as hops, src || ',' || dst as path from e where src in (select nid from ks) and dst in (select nid from ks) union all select a.src, b.dst, 2, a.src || ',' || a.dst || ',' || b.dst from e a join e b on a.dst = b.src where a.src <> b.dst and a.src in (select nid from ks) and b.dst in (select nid from ks)",
    "shortest_paths": f"with {G}, e as (select distinct src, dst from g where relation = 5), p as (select src as source, dst as target, 1 as hops from e where src in (select nid from ks) and dst in (select nid from ks) union all select a.src, b.dst, 2 from e a join e b on a.dst = b.src where a.src <> b.dst and a.src in (select nid from ks) and b.dst in (select nid from ks)), m as (select *, min(hops) over (partition by source, target) as least from p) select source, target, hops, count(*) as paths from m where hops = least group by 1, 2, 3",
    "table_paths": f"with {G}, h as (select distinct src, dst, a.table_name as t1, b.table_name as t2 from g join nodes a on a.node_id = src join nodes b on b.node_id = dst where relation = 5 and a.table_name <> b.table_name) select t1 as source, t2 as target, 1 as hops, count(*) as paths from h group by 1, 2 union all select x.t1, y.t2, 2, count(*) from h x join h y on x.t2 = y.t1 where y.t2 <> x.t1 group by 1, 2",
    "degree_topk": f"with {G} select src as nid, count(*) as degree from g group by 1 order by degree desc, nid limit 20",
    "relation_report": f"with {G} select 'tables' as what, count(distinct table_name) as n from nodes union all select 'columns', count(distinct node_id) from nodes union all select 'relation ' || relation, count(*) from g where src < dst group by relation",
    "enumerate_content": f"with {G} select src, dst, round(score, 4) as score from g where relation = 2 and src < dst",
    "drs_union": f"with {AB} select nid, source_name, field_name from n where nid in (select nid from a union select nid from b)",
    "drs_intersection_fields": f"with {AB} select nid, source_name, field_name from n where nid in (select nid from a) and nid in (select nid from b)",
    "drs_intersection_table": f"with {AB}, x as (select * from n where nid in (select nid from a)), y as (select * from n where nid in (select nid from b)) select distinct nid, source_name, field_name from (select * from x where source_name in (select source_name from y) union all select * from y where source_name in (select source_name from x))",
    "drs_difference": f"with {AB} select nid, source_name, field_name from n where nid in (select nid from a) and nid not in (select nid from b)",
    "drs_sources": f"with {AB} select source_name, string_agg(distinct field_name, ',' order by field_name) as fields from n where nid in (select nid from a) group by 1",
    "drs_inclusion": f"with {G}, x as (select node_id as nid from nodes where table_name in (select source_name from ks)) select distinct node_id as nid, table_name as source_name from nodes where node_id in (select dst from g join x on src = nid where relation = 6)",
    "provenance_edges": f"with {G} select nid as src_nid, nid as dst_nid, 1 as op from ks union select src, dst, 6 from g join ks on src = nid where relation = 2",
    "why": f"with recursive {PR} select nid, leaf from wy",
    "how": f"with recursive {PR} select w.nid, text as explanation from walk w join hit using (nid) where len(path) > 1",
    "coverage_rank": f"with recursive {PR} select hit.nid, round(count(distinct leaf) / (select count(*) from leaf), 9) as coverage from hit left join wy using (nid) group by 1",
    "certainty_rank": f"with recursive {PR} select nid, round(certainty, 4) as certainty from cert",
    "table_rank": f"with recursive {PR}, t as (select table_name as source_name, sum(certainty) as certainty from cert join nodes on node_id = nid group by 1), c as (select table_name as source_name, count(distinct leaf) / (select count(*) from leaf) as coverage from wy join nodes on node_id = nid group by 1) select source_name, round(certainty, 3) as certainty, round(coverage, 9) as coverage from t left join c using (source_name)",
    "exact_attribute": "select node_id as nid, table_name as source_name, node_name as field_name from nodes where node_name = 'region'",
    "keyword_names": f"select node_id as nid, node_name as field_name from nodes where list_has_any({_analyse('node_name')}, ['price', 'amount'])",
    "keyword_content": f"with {CUR} select nid, count(*) as n from val where v is not null and list_has_any({_analyse('v')}, ['pending', 'various']) group by 1",
    "keyword_bm25": f"""with p as (select doc_id, term, count(*) as tf from (select doc_id, unnest({_analyse('text')}) as term from documents where text is not null) group by 1, 2),
l as (select doc_id, sum(tf) as len from p group by 1), s as (select count(*) as n, avg(len) as al from l), q as (select * from p where term in ('ledger', 'warehouse', 'reloaded', '12', 'march')),
f as (select term, count(*) as df from q group by 1)
select doc_id, round(round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 9), 6) as score from q join f using (term) join l using (doc_id), s group by 1 order by round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 9) desc, doc_id limit 20""",
    "fuzzy_keyword": f"select nid, field_name, min(levenshtein(term, 'adress')) as edits from (select node_id as nid, node_name as field_name, unnest({_analyse('node_name')}) as term from nodes) group by 1, 2 having min(levenshtein(term, 'adress')) <= 2",
    "suggest_schema": "select node_name as field_name, min(levenshtein(lower(left(node_name, 5)), 'shift')) as edits from nodes where node_name is not null group by 1 having edits <= 2 order by edits, field_name limit 10",
    "text_signature_terms": f"with {CUR} select nid, term, count(*) as tf from (select nid, unnest({_analyse('v')}) as term from val where v is not null) where length(term) > 3 and not regexp_matches(term, '[0-9]') group by 1, 2 having count(*) > 3",
    "stored_signatures": "select id as nid, load_no, median::double as median, iqr::double as iqr, minValue as min_value, maxValue as max_value from (select * from profile where id is not null and load_no is not null qualify row_number() over (partition by id, load_no order by updated_at desc nulls last, received_at desc nulls last) = 1) where dataType = 'N'",
    "peek_values": f"with {CUR}, u as (select distinct nid, v from val where v is not null and lower(trim(v, ' ')) not in ('', 'nan') and not regexp_full_match(v, '[+-]?[0-9]+(,[0-9]+)*(\\.[0-9]+)?')), r as (select *, row_number() over (partition by nid order by v) as k from u) select nid, string_agg(v, '|' order by v) as values from r where k <= 3 group by 1",
    "col_jaccard_change": f"""with {COUNTS}, ld as (select nid, load_no, p_load from prev where p_load is not null), dv as (select distinct nid, load_no, v from vals where v is not null),
j as (select ld.nid, ld.load_no, n.v, 2 as side from ld join dv n on n.nid = ld.nid and n.load_no = ld.load_no union all select ld.nid, ld.load_no, n.v, 1 from ld join dv n on n.nid = ld.nid and n.load_no = ld.p_load),
c as (select nid, load_no, v, sum(side) as s from j group by 1, 2, 3),
e as (select nid, load_no, count(*) filter (s in (1, 3)) as old_size, count(*) filter (s in (2, 3)) as new_size, count(*) filter (s = 3) as shared from c group by 1, 2)
select nid, load_no, coalesce(old_size, 0) as old_size, coalesce(new_size, 0) as new_size, coalesce(shared, 0) as shared, round(shared / nullif(old_size + new_size - shared, 0), 9) as jaccard from ld left join e using (nid, load_no)""",
    "new_and_removed_tables": """with h as (select distinct source_name, load_no from cells where source_name is not null and load_no is not null),
l as (select a.load_no, max(b.load_no) as before from (select distinct load_no from h) a join (select distinct load_no from h) b on b.load_no < a.load_no group by 1)
select h.source_name, h.load_no, 'new' as change from h join l using (load_no) where (h.source_name, before) not in (select source_name, load_no from h)
union all select h.source_name, l.load_no, 'removed' from h join l on h.load_no = before where (h.source_name, l.load_no) not in (select source_name, load_no from h)""",
    "md_search": "select doc_id::varchar as md_id, nid from documents where nid is not null and (list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'ledger') or lower(lang) = 'ledger')",
    "md_tags": "select lang as tag, count(*) as n from documents where nid is not null and lang is not null group by 1",
    "md_comments": "select doc_id::varchar as md_id, count(*) as n from documents join doclabels using (doc_id) where nid is not null group by 1",
    "name_class_match": f"with {MATCH} select source_name, field_name, name, round(score, 9) as score from ma",
    "ancestor_pairs": f"with recursive voc as (select * from (values {_VOC}) as x(name, parent)), {UP} select name, ancestor, min(distance)::int as distance from up group by 1, 2",
    "ancestor_summary": f"""with recursive {MATCH}, {UP}, an as (select name, ancestor, min(distance) as distance from up group by 1, 2), dp as (select name as ancestor, max(distance) as depth from an group by 1),
m as (select distinct source_name, field_name, name from ma), n as (select source_name, field_name, count(*) as n from m group by 1, 2 having count(*) > 1),
cv as (select source_name, field_name, ancestor, count(*) as c from m join an using (name) group by 1, 2, 3),
b as (select source_name, field_name, ancestor, row_number() over (partition by source_name, field_name order by coalesce(depth, 0) desc, c desc, ancestor) as r from cv join n using (source_name, field_name) left join dp using (ancestor) where c / n > 0.5 and coalesce(depth, 0) > 0),
k as (select source_name, field_name, ancestor from b where r = 1)
select source_name, field_name, name from m where (source_name, field_name) not in (select source_name, field_name from k) union select source_name, field_name, ancestor from k
union select source_name, field_name, name from m join k using (source_name, field_name) where 1 - levenshtein(replace(name, ' ', ' '), lower(field_name)) / greatest(length(name), length(field_name)) >= 0.85""",
    "synthetic_network": """with r(kind, m) as (values (1, 90000), (2, 90000), (5, 90000)), o as (select distinct kind, (i + kind) % 100000 as src, (i + kind + 1) % 100000 as dst from r, range(90000) t(i)),
e as (select kind, src, dst from o union select kind, dst, src from o), d as (select src, count(*) as degree from e group by 1) select degree, count(*) as n from d group by 1""",
    "is_a_links": f"with {MATCH}, t as (select distinct source_name, name from ma), st as (select name, parent from voc where parent is not null union select name, name from voc) select distinct a.source_name, b.source_name as parent_source_name from t a join st on st.name = a.name join t b on b.name = st.parent where a.source_name <> b.source_name",
    "match_precision_recall": f"with {MATCH}, x as (select count(*) filter (score >= 0.999) as hit, count(*) as n from ma) select round(hit / n, 9) as precision, round(1.0::double, 9) as recall, round(2 * (hit / n) / (hit / n + 1), 9) as f1 from x",
    "events_windowed": "select date_trunc('hour', ts) as start, event_type as key, count(*) as n from events group by 1, 2",
}
