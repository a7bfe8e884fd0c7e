"""Comparison of views: compatible, contained, complementary, contradictory."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnscout.plans.lineage import Stages

GROUPS = ("compatible", "contained", "complementary", "contradictory")


def curate(view: DataFrame) -> DataFrame:
    """Rows without null, each once, columns in order of name, values as strings."""
    return view.dropna().select(*(F.col(f"`{c}`").cast("string").alias(c) for c in sorted(view.columns))).distinct()


def column_uniqueness(view: DataFrame) -> DataFrame:
    """(column, uniqueness): distinct values over rows, in one pass."""
    counts = view.agg(F.count("*").alias("__n"), *(F.count_distinct(F.col(f"`{c}`")).alias(c) for c in view.columns))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), (F.col(f"`{c}`") / F.nullif(F.col("__n"), F.lit(0))).alias("uniqueness")) for c in view.columns))
    return counts.select(F.inline(cells))


def most_likely_key(view: DataFrame) -> str:
    """The most unique column; ties by the greater name."""
    rows = column_uniqueness(view).collect()  # one row a column
    return max(rows, key=lambda r: (r["uniqueness"] or 0.0, r["column"]))["column"]


def fingerprint(view: DataFrame) -> tuple[int, int, int]:
    """(rows, sum and sum of a second hash of the rows) of a curated view: equal for equal bags of rows whatever their order."""
    h, g = F.xxhash64(*view.columns), F.xxhash64(F.lit(7), *view.columns)
    r = view.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("h"), F.sum(g.cast("decimal(38,0)")).alias("g")).first()
    return r["n"], int(r["h"] or 0), int(r["g"] or 0)


def equivalent(a: DataFrame, b: DataFrame) -> bool:
    """Same columns, same number of rows, and in each column the same bag of lower-cased values."""
    if sorted(a.columns) != sorted(b.columns) or a.count() != b.count():
        return False
    return all(_bag(a, c).exceptAll(_bag(b, c)).isEmpty() and _bag(b, c).exceptAll(_bag(a, c)).isEmpty() for c in a.columns)


def _bag(view: DataFrame, c: str) -> DataFrame:
    return view.select(F.lower(F.col(f"`{c}`").cast("string")).alias("v"))


def contained(small: DataFrame, big: DataFrame) -> bool:
    """Every column of `small` is in `big`, and each column's set of lower-cased values is a subset."""
    return set(small.columns) <= set(big.columns) and all(_bag(small, c).join(_bag(big, c), "v", "left_anti").isEmpty() for c in small.columns)


def complementary(a: DataFrame, b: DataFrame, key: str) -> bool:
    """The sets of keys differ."""
    x, y = a.select(F.col(key).alias("k")), b.select(F.col(key).alias("k"))
    return not (x.join(y, "k", "left_anti").isEmpty() and y.join(x, "k", "left_anti").isEmpty())


def contradictions(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, rows_a, rows_b): keys of both views whose sets of rows differ. Aggregated by key on both sides at once; the rows of a key are only hashed."""
    h = [c for c in sorted(a.columns) if c in b.columns]
    part = lambda v, side: v.select(F.col(key).alias("key"), F.xxhash64(*h).alias("h")).distinct().withColumn("side", F.lit(side))
    rows = part(a, 0).unionByName(part(b, 1)).groupBy("key", "h").agg(F.count("*").alias("in_both"), F.min("side").alias("side"))
    each = rows.groupBy("key").agg(*(F.sum(F.when(cond, 1).otherwise(0)).alias(n) for n, cond in
                                     (("rows_a", (F.col("in_both") == 2) | (F.col("side") == 0)), ("rows_b", (F.col("in_both") == 2) | (F.col("side") == 1)), ("shared", F.col("in_both") == 2))))
    return each.where("rows_a > 0 and rows_b > 0 and (shared < rows_a or shared < rows_b)").select("key", "rows_a", "rows_b")


def inconsistent_on_key(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, finding): missing_in_a, missing_in_b, non_unique (in either), or conflicting single values."""
    side = lambda v, s: v.select(F.col(key).alias("key"), F.col(value).alias("v")).groupBy("key").agg(F.count("*").alias(f"n_{s}"), F.max("v").alias(f"v_{s}"))
    both = side(a, "a").join(side(b, "b"), "key", "full")
    finding = (F.when(F.col("n_a").isNull(), "missing_in_a").when(F.col("n_b").isNull(), "missing_in_b").when((F.col("n_a") > 1) | (F.col("n_b") > 1), "non_unique")
               .when(~F.col("v_a").eqNullSafe(F.col("v_b")), "conflicting"))
    return both.select("key", finding.alias("finding")).where("finding is not null")


def by_schema(views: Mapping[str, DataFrame]) -> dict[tuple[str, ...], list[str]]:
    """Names of views by their sorted columns."""
    out: dict[tuple[str, ...], list[str]] = {}
    for name, v in views.items():
        out.setdefault(tuple(sorted(v.columns)), []).append(name)
    return out


def pair_relations(views: Mapping[str, DataFrame], key: str | None = None) -> DataFrame:
    """(a, b, relation, detail): how each pair of views of one schema relates, a < b in name.

    One aggregation over the tagged rows of all views, instead of a job for each pair. contained has the
    number of the smaller view's rows as detail, contradictory the number of keys in contradiction.
    compat: all pairs are compared; raw values, no propagation along a chain.
    """
    names = sorted(views)
    curated = {n: curate(views[n]) for n in names}
    columns = curated[names[0]].columns
    key = key or most_likely_key(curated[names[0]])
    spark = curated[names[0]].sparkSession
    tagged = reduce(DataFrame.unionByName, (v.select(F.lit(n).alias("view"), F.col(f"`{key}`").alias("key"), F.xxhash64(*columns).alias("h")) for n, v in curated.items()))
    tagged = Stages(spark, "views").write(tagged, "rows")  # read by each of the aggregates below
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(names) for b in names[i + 1:]], "a string, b string")  # names only
    sizes = tagged.groupBy("view").agg(F.count("*").alias("n"))
    rows = tagged.groupBy("key", "h").agg(F.collect_set("view").alias("views"))
    # each row tells for each of its views whether a pair shares it
    both = rows.select("key", "h", F.explode("views").alias("a"), "views").select("key", "h", "a", F.explode("views").alias("b")).where("a < b")
    shared = both.groupBy("a", "b").agg(F.count("*").alias("shared"))
    per_key = tagged.groupBy("view", "key").agg(F.count("*").alias("n"))
    key_pair = per_key.select(F.col("view").alias("a"), "key", F.col("n").alias("na")).join(per_key.select(F.col("view").alias("b"), "key", F.col("n").alias("nb")), "key").where("a < b")
    key_shared = both.groupBy("a", "b", "key").agg(F.count("*").alias("s"))
    conflicts = key_pair.join(key_shared, ["a", "b", "key"], "left").where("coalesce(s, 0) < na or coalesce(s, 0) < nb").groupBy("a", "b").agg(F.count("*").alias("conflicts"))
    all_ = (pairs.join(sizes.select(F.col("view").alias("a"), F.col("n").alias("n_a")), "a", "left").join(sizes.select(F.col("view").alias("b"), F.col("n").alias("n_b")), "b", "left")
            .join(shared, ["a", "b"], "left").join(conflicts, ["a", "b"], "left").na.fill(0))
    relation = (F.when((F.col("shared") == F.col("n_a")) & (F.col("shared") == F.col("n_b")), "compatible").when((F.col("shared") == F.least("n_a", "n_b")), "contained")
                .when(F.col("conflicts") > 0, "contradictory").otherwise("complementary"))
    detail = F.when(F.col("relation") == "contained", F.least("n_a", "n_b")).when(F.col("relation") == "contradictory", F.col("conflicts")).otherwise(F.col("shared"))
    return all_.withColumn("relation", relation).select("a", "b", "relation", detail.cast("long").alias("detail"))


def classify(views: Mapping[str, DataFrame]) -> DataFrame:
    """`pair_relations` for every group of views with the same schema; groups of one view have no pairs."""
    parts = [pair_relations({n: views[n] for n in names}) for names in by_schema(views).values() if len(names) > 1]
    return reduce(DataFrame.unionByName, parts) if parts else next(iter(views.values())).sparkSession.createDataFrame([], "a string, b string, relation string, detail long")


def prune(relations: DataFrame) -> list[str]:
    """Names of views that remain for a user: of compatible ones the first, and none that is contained in another. Runs over pairs of views, on the driver."""
    rows = relations.collect()
    gone = {r["b"] for r in rows if r["relation"] == "compatible"}
    return sorted({n for r in rows for n in (r["a"], r["b"])} - gone)


def summary(relations: DataFrame) -> DataFrame:
    """(relation, pairs, views): how many pairs are in each relation, and how many views take part."""
    each = relations.select("relation", F.explode(F.array("a", "b")).alias("v"))
    return relations.groupBy("relation").agg(F.count("*").alias("pairs")).join(each.groupBy("relation").agg(F.count_distinct("v").alias("views")), "relation")
