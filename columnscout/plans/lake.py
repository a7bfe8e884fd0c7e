"""Queries over the lake's tables: profiles and relations, and their SQL twins. Columns go by (source_name, field_name)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from columnscout.operators import profile as P
from columnscout.operators import relate
from columnscout.plans import model

#: The lake: tables, and the kind of each column (I whole number, F fraction, T text), which the SQL twins are made from.
LAKE = {
    "region": {"r_regionkey": "I", "r_name": "T"},
    "nation": {"n_nationkey": "I", "n_name": "T", "n_regionkey": "I"},
    "customer": {"c_custkey": "I", "c_name": "T", "c_nationkey": "I", "c_acctbal": "F", "c_mktsegment": "T"},
    "supplier": {"s_suppkey": "I", "s_name": "T", "s_nationkey": "I", "s_acctbal": "F"},
    "part": {"p_partkey": "I", "p_name": "T", "p_brand": "T", "p_type": "T", "p_size": "I", "p_retailprice": "F"},
    "orders": {"o_orderkey": "I", "o_custkey": "I", "o_orderstatus": "T", "o_totalprice": "F", "o_orderdate": "T", "o_orderpriority": "T"},
    "lineitem": {"l_orderkey": "I", "l_partkey": "I", "l_suppkey": "I", "l_linenumber": "I", "l_quantity": "F", "l_extendedprice": "F", "l_discount": "F", "l_tax": "F",
                 "l_returnflag": "T", "l_linestatus": "T", "l_shipdate": "T"},
    "events": {"event_id": "I", "ts": "T", "user_id": "I", "event_type": "T", "value": "F", "props": "T"},
}

_MODELS: dict[tuple[str, str], model.Model] = {}


def lake_model(spark: SparkSession, sf_dir: str) -> model.Model:
    """The model of the lake in a folder, built once a session and then read, as a discovery system does."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        _MODELS[key] = model.build(spark, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in LAKE}, name="lake")
    return _MODELS[key]


def _named(m: model.Model, pairs: DataFrame, *columns) -> DataFrame:
    """Pairs (src, dst) by names."""
    c = m.columns
    a = c.select(F.col("nid").alias("src"), F.col("source_name").alias("source_a"), F.col("field_name").alias("field_a"))
    b = c.select(F.col("nid").alias("dst"), F.col("source_name").alias("source_b"), F.col("field_name").alias("field_b"))
    return pairs.join(a, "src").join(b, "dst").select("source_a", "field_a", "source_b", "field_b", *columns)


def _unordered(named: DataFrame, *columns) -> DataFrame:
    """Pairs by names with the smaller (table, column) first."""
    swap = F.struct("source_b", "field_b") < F.struct("source_a", "field_a")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return named.select(pick("source_a", "source_b").alias("source_a"), pick("field_a", "field_b").alias("field_a"), pick("source_b", "source_a").alias("source_b"), pick("field_b", "field_a").alias("field_b"), *columns)


def profile_numeric(spark, sf_dir):
    p = lake_model(spark, sf_dir).profile.where("data_type = 'N'")
    return p.select("source_name", "field_name", "total_values", "unique_values", "min_value", "max_value", F.round("avg_value", 7).alias("avg_value"), F.round("stddev", 3).alias("stddev"), "q25", "median", "q75", "iqr")


def profile_text(spark, sf_dir):
    return lake_model(spark, sf_dir).profile.where("data_type = 'T'").select("source_name", "field_name", "total_values", "unique_values")


def profile_approximate(spark, sf_dir):
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in LAKE}
    return P.approximate_profile(P.melt(tables, "lake")).join(P.catalogue(spark, tables, "lake"), "nid").drop("nid", "path", "db_name")


def type_inference(spark, sf_dir):
    m = lake_model(spark, sf_dir)
    return P.infer_types(m.counts).join(m.columns, "nid").select("source_name", "field_name", "data_type")


def uniqueness(spark, sf_dir):
    return lake_model(spark, sf_dir).profile.select("source_name", "field_name", F.round("uniqueness", 9).alias("uniqueness"))


def top_keys(spark, sf_dir):
    order = Window.partitionBy("source_name").orderBy(F.col("uniqueness").desc(), F.col("field_name"))
    return lake_model(spark, sf_dir).profile.withColumn("r", F.row_number().over(order)).where("r = 1").select("source_name", "field_name", F.round("uniqueness", 9).alias("uniqueness"))


def inclusion_dep(spark, sf_dir):
    m = lake_model(spark, sf_dir)
    return _named(m, m.inclusion())


def numeric_content_sim(spark, sf_dir):
    m = lake_model(spark, sf_dir)
    return _named(m, relate.numeric_content_similarity(m.profile), F.round("score", 6).alias("score"))


def numeric_single_point_clusters(spark, sf_dir):
    m = lake_model(spark, sf_dir)
    return _unordered(_named(m, relate.single_point_clusters(m.profile)))


def numeric_signature_sim(spark, sf_dir):
    m = lake_model(spark, sf_dir)
    return _unordered(_named(m, relate.numeric_signature_similarity(m.profile)))


def text_content_sim_x(spark, sf_dir):
    m = lake_model(spark, sf_dir)
    return _unordered(_named(m, m.text_content(), "score"), F.round("score", 9).alias("score"))


def schema_sim_x(spark, sf_dir):
    m = lake_model(spark, sf_dir)
    return _named(m, relate.schema_similarity(m.columns, 0.5, None), F.round("score", 6).alias("score"))


def pkfk(spark, sf_dir):
    m = lake_model(spark, sf_dir)
    return _unordered(_named(m, m.keys(), "score"), F.round("score", 9).alias("score"))


def pkfk_lineitem(spark, sf_dir):
    """Which columns can join with lineitem."""
    return pkfk(spark, sf_dir).where("source_a = 'lineitem' or source_b = 'lineitem'")


def relation_report_lake(spark, sf_dir):
    e = lake_model(spark, sf_dir).edges()
    return e.where("src < dst").groupBy("relation").agg(F.count("*").alias("n"))


def entity_like_columns(spark, sf_dir):
    m = lake_model(spark, sf_dir)
    return P.entities(m.counts).join(m.columns, "nid").select("source_name", "field_name", "entity", F.round("share", 6).alias("share"))


def ks_prices(spark, sf_dir):
    m = lake_model(spark, sf_dir)
    return P.kolmogorov_smirnov(m.counts, P.nid_of("lake", "customer", "c_acctbal"), P.nid_of("lake", "supplier", "s_acctbal")).select(F.round("statistic", 9).alias("statistic"))


def value_overlap(spark, sf_dir):
    m = lake_model(spark, sf_dir)
    return P.value_overlap(m.counts, P.nid_of("lake", "orders", "o_custkey"), P.nid_of("lake", "customer", "c_custkey"))


def cast_float(spark, sf_dir):
    t = {"orders": spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_totalprice", "o_orderstatus")}
    c = P.cast_column(P.melt(t, "lake"), "FLOAT")
    return c.groupBy("nid").agg(F.count("*").alias("parsed"), F.max("value").cast("double").alias("greatest")).select("parsed", F.round("greatest", 2).alias("greatest"))


def minhash_sketch(spark, sf_dir):
    """Sketches of the lake's text columns."""
    m = lake_model(spark, sf_dir)
    text = m.counts.join(m.profile.where("data_type = 'T'").select("nid"), "nid", "left_semi")
    return P.minhash(text, k=64).join(m.columns, "nid").select("source_name", "field_name", "minhash")


QUERIES = {f.__name__: f for f in (profile_numeric, profile_text, profile_approximate, type_inference, uniqueness, top_keys, inclusion_dep, numeric_content_sim, numeric_single_point_clusters,
                                   numeric_signature_sim, text_content_sim_x, schema_sim_x, pkfk, pkfk_lineitem, relation_report_lake, entity_like_columns, ks_prices, value_overlap, cast_float, minhash_sketch)}

_EACH = [(t, c, k) for t, columns in LAKE.items() for c, k in columns.items()]
NUMERIC = "prof as (" + " union all ".join(
    f"select '{t}' as source_name, '{c}' as field_name, 'N' as data_type, count({c}) as total_values, count(distinct {c}) as unique_values, min({c})::double as min_value, max({c})::double as max_value, "
    f"avg({c}) as avg_value, stddev_pop({c}) as stddev, quantile_disc(abs(trunc({c}))::bigint, 0.25) as q25, quantile_disc(abs(trunc({c}))::bigint, 0.5) as median, quantile_disc(abs(trunc({c}))::bigint, 0.75) as q75 from {t}"
    for t, c, k in _EACH if k != "T") + ")"
COUNTS = "cnt as (" + " union all ".join(f"select '{t}' as source_name, '{c}' as field_name, '{'T' if k == 'T' else 'N'}' as data_type, count({c}) as total_values, count(distinct {c}) as unique_values from {t}" for t, c, k in _EACH) + ")"
TEXT = "txt as (" + " union all ".join(f"select distinct '{t}' as source_name, '{c}' as field_name, lower({c}::varchar) as v from {t} where {c} is not null" for t, c, k in _EACH if k == "T") + ")"
DOMAINS = f"""{NUMERIC},
d as (select source_name, field_name, median - (q75 - q25) as l, median + (q75 - q25) as r, min_value as mn, max_value as mx from prof),
ov as (select c.source_name as source_a, c.field_name as field_a, f.source_name as source_b, f.field_name as field_b, c.mn >= f.mn and c.mx <= f.mx and c.mn >= 0 as inside,
   case when c.l >= f.l and c.r <= f.r then (c.r - c.l) / (f.r - f.l) when c.l >= f.l and c.l <= f.r then (f.r - c.l) / (f.r - f.l) when c.r <= f.r and c.r >= f.l then (c.r - f.l) / (f.r - f.l) else 0 end as o
   from d c, d f where f.r > f.l and (c.source_name, c.field_name) <> (f.source_name, f.field_name))"""
PAIR = "source_a, field_a, source_b, field_b"
LEAST = "case when (source_b, field_b) < (source_a, field_a) then {0}_b else {0}_a end"
MOST = "case when (source_b, field_b) < (source_a, field_a) then {0}_a else {0}_b end"
JACCARD = f"""{TEXT}, sz as (select source_name, field_name, count(*) as n from txt group by 1, 2),
jac as (select a.source_name as source_a, a.field_name as field_a, b.source_name as source_b, b.field_name as field_b, count(*) as o from txt a join txt b on a.v = b.v and (a.source_name, a.field_name) < (b.source_name, b.field_name) group by all),
sim as (select source_a, field_a, source_b, field_b, o / (p.n + q.n - o) as score from jac join sz p on p.source_name = source_a and p.field_name = field_a join sz q on q.source_name = source_b and q.field_name = field_b where o / (p.n + q.n - o) >= 0.7)"""
KEYS = f"""{DOMAINS}, {COUNTS}, {JACCARD},
lk as (select *, 'N' as by_ from (select {PAIR} from ov where inside and o >= 0.3) union all select {PAIR}, 'T' from sim),
un as (select source_name, field_name, data_type, unique_values / total_values as u from cnt),
k as (select {LEAST.format('source')} as source_a, {LEAST.format('field')} as field_a, {MOST.format('source')} as source_b, {MOST.format('field')} as field_b, greatest(p.u, q.u) as score
   from lk join un p on p.source_name = source_a and p.field_name = field_a join un q on q.source_name = source_b and q.field_name = field_b
   where (p.u > 0.7 and p.data_type = by_) or (q.u > 0.7 and q.data_type = by_)),
keys as (select distinct {PAIR}, round(score, 9) as score from k)"""
_NAMES = ", ".join(f"('{t}', '{c}')" for t, c, _ in _EACH)
NAMES = f"""nm as (select * from (values {_NAMES}) as x(s, f)),
tf as (select s, f, tok, count(*) as tf from (select s, f, unnest(string_split(f, '_')) as tok from nm) where tok <> '' group by all),
dfs as (select tok, count(*) as df from tf group by 1),
w0 as (select s, f, tok, (1 + ln(tf)) * (ln((1 + (select count(*) from nm)) / (1 + df)) + 1) as w from tf join dfs using (tok)),
w as (select s, f, tok, w / sqrt(sum(w * w) over (partition by s, f)) as w from w0)"""

SQL = {
    "profile_numeric": f"with {NUMERIC} select source_name, field_name, total_values, unique_values, min_value, max_value, round(avg_value, 7) as avg_value, round(stddev, 3) as stddev, q25, median, q75, q75 - q25 as iqr from prof",
    "profile_text": f"with {COUNTS} select source_name, field_name, total_values, unique_values from cnt where data_type = 'T'",
    "type_inference": "select * from (values " + ", ".join(f"('{t}', '{c}', '{dict(I='INT', F='FLOAT', T='STRING')[k]}')" for t, c, k in _EACH) + ") as x(source_name, field_name, data_type)",
    "uniqueness": f"with {COUNTS} select source_name, field_name, round(unique_values / total_values, 9) as uniqueness from cnt",
    "top_keys": f"with {COUNTS} select source_name, field_name, round(unique_values / total_values, 9) as uniqueness from cnt qualify row_number() over (partition by source_name order by unique_values / total_values desc, field_name) = 1",
    "inclusion_dep": f"with {DOMAINS} select {PAIR} from ov where inside and o >= 0.3",
    "numeric_content_sim": f"with {DOMAINS} select {PAIR}, round(o, 6) as score from ov where o >= 0.85",
    "numeric_single_point_clusters": f"""with {DOMAINS}, z as (select source_name, field_name, r / 2 as x from d where l = r),
g as (select *, case when x - lag(x) over w <= 0.1 then 0 else 1 end as st from z window w as (order by x, source_name, field_name)),
c as (select *, sum(st) over (order by x, source_name, field_name rows unbounded preceding) as cl from g)
select a.source_name as source_a, a.field_name as field_a, b.source_name as source_b, b.field_name as field_b from c a join c b on a.cl = b.cl and (a.source_name, a.field_name) < (b.source_name, b.field_name)""",
    "numeric_signature_sim": f"""with {NUMERIC} select a.source_name as source_a, a.field_name as field_a, b.source_name as source_b, b.field_name as field_b from prof a join prof b on (a.source_name, a.field_name) < (b.source_name, b.field_name)
where pow(a.median - b.median, 2) + pow((a.q75 - a.q25) - (b.q75 - b.q25), 2) + pow(a.min_value - b.min_value, 2) + pow(a.max_value - b.max_value, 2) <= 0.09""",
    "text_content_sim_x": f"with {JACCARD} select {PAIR}, round(score, 9) as score from sim",
    "schema_sim_x": f"""with {NAMES} select a.s as source_a, a.f as field_a, b.s as source_b, b.f as field_b, round(sum(a.w * b.w), 6) as score from w a join w b on a.tok = b.tok and (a.s, a.f) <> (b.s, b.f) group by 1, 2, 3, 4 having round(sum(a.w * b.w), 9) >= 0.5""",
    "pkfk": f"with {KEYS} select * from keys",
    "pkfk_lineitem": f"with {KEYS} select * from keys where source_a = 'lineitem' or source_b = 'lineitem'",
    "ks_prices": """with st as (select c_acctbal as v, 1.0 / (select count(c_acctbal) from customer) as s from customer where c_acctbal is not null union all select s_acctbal, -1.0 / (select count(s_acctbal) from supplier) from supplier where s_acctbal is not null),
g as (select v, sum(s::double) as s from st group by v) select round(max(abs(c)), 9) as statistic from (select sum(s) over (order by v) as c from g)""",
    "value_overlap": """with a as (select distinct o_custkey as v from orders where o_custkey is not null), b as (select distinct c_custkey as v from customer where c_custkey is not null),
n as (select (select count(*) from a join b using (v)) as shared, (select count(*) from a) as size_a, (select count(*) from b) as size_b)
select shared, size_a, size_b, shared >= 0.4 * (size_a + size_b) as overlaps from n""",
    "cast_float": "select count(o_totalprice) as parsed, round(max(o_totalprice::float)::double, 2) as greatest from orders",
}
