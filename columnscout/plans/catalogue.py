"""Queries over the tables of the catalogue (problem 2), and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columnscout.operators import quality
from columnscout.plans.lineage import Stages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Stages(spark, "quality").write(quality.value_counts(_table(spark, sf_dir, "cells")), "counts")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.findings(None, _table(spark, sf_dir, "profile"), counts=_counts(spark, sf_dir))


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(spark, sf_dir)
    loads = quality.with_previous(quality.column_profile(counts).join(quality.power_sums(counts), ["nid", "load_no"], "left"))
    difference = quality.shift(loads)
    kept = ["nid", "load_no", "data_type", "total", "blanks", "uniques", "violations", "min_value", "max_value"]
    return loads.join(difference, ["nid", "load_no"], "left").select(*kept, F.round("difference", 4).alias("mean_shift"))


def p2_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each column and load, how many non-blank cells violate each named pattern."""
    profile = quality.column_profile(_counts(spark, sf_dir), quality.PATTERNS)
    return profile.select("nid", "load_no", "total", *(f"not_{name}" for name in quality.PATTERNS))


def p2_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both measures of change side by side: the standardised difference of means and the distance of the distributions, of loads that have either."""
    counts = _counts(spark, sf_dir)
    loads = quality.with_previous(quality.column_profile(counts).join(quality.power_sums(counts), ["nid", "load_no"], "left"))
    both = quality.shift(loads).join(quality.distribution_distance(counts, loads), ["nid", "load_no"], "full")
    return both.select("nid", "load_no", F.round("difference", 4).alias("mean_shift"), F.round("distance", 6).alias("distance"))


QUERIES = {"p2_found": p2_found, "p2_profile": p2_profile, "p2_patterns": p2_patterns, "p2_shifts": p2_shifts}

COUNTS = """vals as (
    select nid, load_no, case when v is null or v = '' or lower(v) = 'nan' then null else v end as v
    from (select nid, load_no, row_no, trim(value, ' ') as v from cells where nid is not null and load_no is not null and row_no is not null
          qualify row_number() over (partition by nid, load_no, row_no order by received_at desc nulls last, trim(value, ' ') desc nulls last) = 1)),
num as (select *, case when regexp_full_match(v, '[+-]?[0-9]+(,[0-9]+)*(\\.[0-9]+)?') then replace(v, ',', '')::double end as x from vals),
col as (select nid, load_no, count(v) as total, count(*) - count(v) as blanks, count(distinct v) as uniques, count(v) - count(x) as violations,
        case when count(v) > 0 and count(v) = count(x) then 'N' else 'T' end as data_type, min(x) as min_value, max(x) as max_value,
        avg(x) as mean, var_pop(x) as var from num group by 1, 2),
prev as (select *, lag(load_no) over w as p_load, lag(total) over w as p_total, lag(blanks) over w as p_blanks, lag(data_type) over w as p_type,
         lag(mean) over w as p_mean, lag(var) over w as p_var from col window w as (partition by nid order by load_no))"""

DISTANCES = """able as (select nid, load_no, p_load, total, p_total, data_type = 'N' and p_type = 'N' as numeric from prev where p_load is not null and total >= 30 and p_total >= 30),
steps as (select a.nid, a.load_no, case when numeric then x end as k1, case when numeric then null else encode(v) end as k2,
          sum(case when n.load_no = a.load_no then 1.0 / total else -1.0 / p_total end) as step
          from able a join num n on n.nid = a.nid and n.load_no in (a.load_no, a.p_load) where v is not null group by 1, 2, 3, 4),
run as (select nid, load_no, sum(step) over (partition by nid, load_no order by k1, k2) as s from steps),
dist as (select nid, load_no, max(abs(s)) as distance from run group by 1, 2)"""
SHIFT = "case when data_type = 'N' and p_type = 'N' and var + p_var > 1e-12 then round((mean - p_mean) / sqrt((var + p_var) / 2), 4) end"

SQL = {
    "p2_patterns": f"""
with {COUNTS}
select nid, load_no, count(v) as total, {", ".join(f"count(v) filter (not regexp_matches(v, '{p}')) as not_{n}" for n, p in quality.PATTERNS.items())} from vals group by 1, 2""",
    "p2_shifts": f"""
with {COUNTS}, {DISTANCES},
sh as (select nid, load_no, {SHIFT} as mean_shift from prev where data_type = 'N' and p_type = 'N')
select nid, load_no, mean_shift, round(distance, 6) as distance from sh full join dist using (nid, load_no)""",
    "p2_found": f"""
with {COUNTS},
st as (select id as nid, load_no, dataType, totalValues, uniqueValues, minValue from profile
       qualify row_number() over (partition by id, load_no order by updated_at desc nulls last, received_at desc nulls last) = 1),
able as (select nid, load_no, p_load, total, p_total, data_type = 'N' and p_type = 'N' as numeric from prev where p_load is not null and total >= 30 and p_total >= 30),
steps as (select a.nid, a.load_no, case when numeric then x end as k1, case when numeric then null else encode(v) end as k2,
          sum(case when n.load_no = a.load_no then 1.0 / total else -1.0 / p_total end) as step
          from able a join num n on n.nid = a.nid and n.load_no in (a.load_no, a.p_load) where v is not null group by 1, 2, 3, 4),
run as (select nid, load_no, sum(step) over (partition by nid, load_no order by k1, k2) as s from steps),
dist as (select nid, load_no, max(abs(s)) as distance from run group by 1, 2)
select nid, load_no, 'count' as finding from prev join st using (nid, load_no)
 where totalValues is null or uniqueValues is null or totalValues <> total or abs(uniqueValues - uniques) > 0.05 * uniques
union all select nid, load_no, 'type' from prev join st using (nid, load_no) where dataType is distinct from data_type
union all select nid, load_no, 'range' from prev join st using (nid, load_no) where data_type = 'N' and (minValue is null or abs(minValue - min_value) > 1e-6)
union all select nid, load_no, 'blank' from prev where p_load is not null and round(blanks / (blanks + total) - p_blanks / (p_blanks + p_total), 6) > 0.1
union all select nid, load_no, 'drift' from dist where round(distance, 6) > 0.25""",
    "p2_profile": f"""
with {COUNTS}
select nid, load_no, data_type, total, blanks, uniques, violations, min_value, max_value,
  case when data_type = 'N' and p_type = 'N' and var + p_var > 1e-12 then round((mean - p_mean) / sqrt((var + p_var) / 2), 4) end as mean_shift from prev""",
}
