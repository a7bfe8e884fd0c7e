"""SQL twins of this package's queries, for DuckDB over the same tables."""

from columnscout.llm.shapes import WORDS

COMMON = ", ".join(f"'{w}'" for w in WORDS)

CURRENT = """cur as (select * from modeldb where nid is not null
    qualify row_number() over (partition by nid order by updated_at desc nulls last, received_at desc nulls last) = 1)"""

#: (id, term, c) of each record's terms, its number of records N, and d of each term.
TERMS = f"""{CURRENT},
rec as (select nid, t_data from cur where len(list_filter(t_data, lambda v: v is not null and trim(v, ' ') <> '')) > 0),
txt as (select nid, unnest(t_data) as v from rec
        union all select r.nid, p.name from rec r join (select id, max(columnName) as name from profile where columnName is not null group by id) p on p.id = r.nid),
occ as (select nid, unnest(regexp_extract_all(lower(v), '[0-9]*[a-z][a-z0-9]*')) as term from txt where v is not null),
cnt as (select nid, term, count(*) as c from occ group by 1, 2),
df as (select term, count(*) as d, sum(c) as col_total from cnt group by 1)"""

SQL = {
    "p4_found": """
with m as (select distinct nid, ident from idents where nid is not null and ident is not null),
s as (select nid, count(*) as n from m group by nid),
j as (select a.nid as x, b.nid as y, count(*) as o from m a join m b on a.ident = b.ident and a.nid < b.nid group by 1, 2)
select x as nid_a, y as nid_b from j join s p on x = p.nid join s q on y = q.nid where o >= 0.4 * least(p.n, q.n) - 1e-9""",
    "p4_changes": """
with r as (select nid, ident, seen_at::date - date '1970-01-01' as day from idents where nid is not null and ident is not null),
b as (select min(day) as lo, max(day) as hi from r),
m as (select nid, ident from r, b group by nid, ident, lo, hi having max(coalesce(day, lo)) >= lo + (hi - lo) // 10),
s as (select nid, count(*) as n from m group by nid),
j as (select a.nid as x, b.nid as y, count(*) as o from m a join m b on a.ident = b.ident and a.nid < b.nid group by 1, 2)
select x as nid_a, y as nid_b, o as shared from j join s p on x = p.nid join s q on y = q.nid where o >= 0.4 * least(p.n, q.n) - 1e-9""",
    "p5_found": f"""
with {TERMS}
select nid, term from cnt join df using (term), (select count(*) as n from rec)
where d >= 2
qualify row_number() over (partition by nid order by round((1 + ln(c)) * ln(n / d), 9) desc, term) <= 3""",
    "p5_residuals": f"""
with {TERMS},
rows_ as (select nid, sum(c) as row_total from cnt group by 1),
tot as (select sum(c) as total from cnt),
res as (select nid, term, d, (c - row_total * col_total / total) / sqrt(row_total * col_total / total * (1 - row_total / total) * (1 - col_total / total)) as r
        from cnt join df using (term) join rows_ using (nid), tot)
select nid, term, round(r, 6) as residual from res where d >= 2
qualify row_number() over (partition by nid order by round(r, 6) desc, term) <= 3""",
    "p6_found": f"""
with {CURRENT},
sig as (select nid, signature::double[] as v from cur where len(signature) = 64
        and len(list_filter(signature, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(signature, lambda x: x <> 0)) > 0),
sim as (select a.nid as x, b.nid as y, round(list_cosine_similarity(a.v, b.v), 12) as s from sig a join sig b on a.nid <> b.nid),
top as (select x, y, s from sim qualify row_number() over (partition by x order by s desc, y) <= 5)
select distinct least(x, y) as nid_a, greatest(x, y) as nid_b from top where s >= 0.8""",
    "p1_found": f"""
with {CURRENT},
tok as (select distinct nid, lower(trim(v, ' ')) as v from (select nid, unnest(t_data) as v from cur)
        where v is not null and trim(v, ' ') <> ''),
s as (select nid, count(*) as n from tok group by nid having count(*) >= 5),
j as (select a.nid as x, b.nid as y, count(*) as o from tok a join tok b on a.v = b.v and a.nid < b.nid group by 1, 2)
select x as nid_a, y as nid_b from j join s p on x = p.nid join s q on y = q.nid where o >= 0.7 * (p.n + q.n - o) - 1e-9""",
    "p1_classes": f"""
with {CURRENT},
tok as (select distinct nid, lower(trim(v, ' ')) as v from (select nid, unnest(t_data) as v from cur)
        where v is not null and trim(v, ' ') <> ''),
s as (select nid, count(*) as n, list_sort(list(v)) as whole from tok group by nid having count(*) >= 5),
c as (select whole, min(nid) as class_id, count(*) as members from s group by whole),
j as (select a.nid as x, b.nid as y, count(*) as o from tok a join tok b on a.v = b.v and a.nid <> b.nid group by 1, 2),
l as (select x, count(*) as links from j join s p on x = p.nid join s q on y = q.nid where o >= 0.7 * (p.n + q.n - o) - 1e-9 group by 1)
select s.nid, class_id, members, coalesce(links, 0) as links from s join c using (whole) left join l on x = s.nid""",
    "p3_found": """
with recursive links as (
    select distinct source_node_id as u, target_node_id as v from edges
    where relation_type in (2, 10) and source_node_id <> target_node_id
      and source_node_id in (select node_id from nodes) and target_node_id in (select node_id from nodes)),
both_ways as (select u, v from links union select v, u from links),
reach as (select u as node_id, u as other from both_ways
          union select r.node_id, b.v from reach r join both_ways b on r.other = b.u)
select node_id, min(other) as group_id from reach group by node_id""",
    "p9_statistics": f"""
with t as (select doc_id, coalesce(text, '') as x from documents),
w as (select doc_id, length(x) as n_characters, regexp_extract_all(x, '[^ \\t\\r\\n]+') as w,
      list_filter(list_transform(regexp_split_to_array(x, '[\\r\\n]+'), lambda y: trim(y, ' ')), lambda y: y <> '') as l,
      length(regexp_replace(x, '[^#$%&*+/<=>@^_`{{|}}~\\\\]', '', 'g')) as s from t)
select doc_id, n_characters, len(w) as n_words,
  case when len(w) > 0 then round(list_sum(list_transform(w, lambda y: length(y))) / len(w), 6) end as mean_word_length,
  case when n_characters > 0 then round(s / n_characters, 6) end as symbol_ratio, len(l) as n_lines,
  case when len(l) > 0 then round(len(list_filter(l, lambda y: right(y, 1) in ('.', '!', '?', ':'))) / len(l), 6) end as ended_lines,
  case when len(w) > 0 then round(len(list_filter(w, lambda y: lower(y) in ({COMMON}))) / len(w), 6) end as common_words
from w""",
}
