"""Change of columns between two versions of a lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def column_jaccard(old: DataFrame, new: DataFrame, id_col: str = "nid", value_col: str = "value") -> DataFrame:
    """(id, old_size, new_size, shared, jaccard): exact Jaccard similarity of each column's value sets in two versions; a column of one version only has 0."""
    side = lambda df, s: df.where(F.col(value_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(value_col).alias("value")).distinct().withColumn("side", F.lit(s))
    both = side(old, 1).unionByName(side(new, 2)).groupBy("id", "value").agg(F.sum("side").alias("s"))
    count = lambda *s: F.sum(F.when(F.col("s").isin(*s), 1).otherwise(0))
    each = both.groupBy("id").agg(count(1, 3).alias("old_size"), count(2, 3).alias("new_size"), count(3).alias("shared"))
    return each.withColumn("jaccard", F.col("shared") / (F.col("old_size") + F.col("new_size") - F.col("shared"))).withColumnRenamed("id", id_col)


def load_jaccard(values: DataFrame, id_col: str = "nid", load_col: str = "load_no", value_col: str = "value") -> DataFrame:
    """(id, load, old_size, new_size, shared, jaccard): `column_jaccard` of every load with the load before it, that of the next smaller number of the same column.

    Null values don't count; a load without values shares nothing. `values` may hold a value more than once.
    """
    loads = values.select(F.col(id_col).alias("id"), F.col(load_col).alias("load")).where("id is not null and load is not null").distinct()
    before = F.lag("load").over(Window.partitionBy("id").orderBy("load"))  # one row a load
    steps = loads.withColumn("before", before).where("before is not null")
    held = values.where(F.col(value_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(load_col).alias("at"), F.col(value_col).alias("value")).distinct()
    roles = steps.select("id", F.col("load").alias("at"), "load", F.lit(2).alias("side")).union(steps.select("id", F.col("before").alias("at"), "load", F.lit(1).alias("side")))
    both = held.join(roles, ["id", "at"]).groupBy("id", "load", "value").agg(F.sum("side").alias("s"))
    count = lambda *s: F.coalesce(F.sum(F.when(F.col("s").isin(*s), 1).otherwise(0)), F.lit(0))
    each = both.groupBy("id", "load").agg(count(1, 3).alias("old_size"), count(2, 3).alias("new_size"), count(3).alias("shared"))
    whole = steps.select("id", "load").join(each, ["id", "load"], "left").na.fill(0, ["old_size", "new_size", "shared"])
    ratio = F.col("shared") / F.nullif(F.col("old_size") + F.col("new_size") - F.col("shared"), F.lit(0))
    return whole.withColumn("jaccard", ratio).withColumnsRenamed({"id": id_col, "load": load_col})


def changed_columns(jaccard: DataFrame, limit: float = 0.05) -> DataFrame:
    """Columns of which more than `limit` changed."""
    return jaccard.where(1 - F.col("jaccard") > limit)


def sketched_change(old: DataFrame, new: DataFrame, id_col: str = "nid") -> DataFrame:
    """(id, estimate, scaled): from sketches (id, minhash, n) of the old version and of a sample of the new one: the share of equal slots, and it over (n new / n old)."""
    a = old.select(id_col, F.col("minhash").alias("ma"), F.col("n").alias("na"))
    b = new.select(id_col, F.col("minhash").alias("mb"), F.col("n").alias("nb"))
    same = F.size(F.filter(F.zip_with("ma", "mb", lambda x, y: x == y), lambda x: x)) / F.size("ma")
    pairs = a.join(b, id_col).select(id_col, same.alias("estimate"), (F.col("nb") / F.col("na")).alias("ratio"))
    return pairs.select(id_col, "estimate", F.least(F.lit(1.0), F.col("estimate") / F.col("ratio")).alias("scaled"))


def perturb(values: DataFrame, fraction: float, put: str = "-1", seed: int = 1, id_col: str = "nid", value_col: str = "value") -> DataFrame:
    """The values with about `fraction` of the cells replaced, chosen by hash; for measuring change detection."""
    hit = F.pmod(F.xxhash64(F.lit(seed), id_col, value_col), F.lit(1_000_000)) < int(fraction * 1_000_000)
    return values.withColumn(value_col, F.when(hit, F.lit(put)).otherwise(F.col(value_col)))


def precision_recall(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row (precision, recall, f1) of found against truth; null where undefined."""
    t, f = truth.select(*keys, F.lit(1).alias("t")).distinct(), found.select(*keys, F.lit(1).alias("f")).distinct()
    both = t.join(f, keys, "full")
    hit = F.sum(F.when(F.col("t").isNotNull() & F.col("f").isNotNull(), 1).otherwise(0))
    one = both.agg((hit / F.nullif(F.count("f"), F.lit(0))).alias("precision"), (hit / F.nullif(F.count("t"), F.lit(0))).alias("recall"))
    return one.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))


def load_changes(tables: DataFrame, column: str = "source_name", load_col: str = "load_no") -> DataFrame:
    """(source_name, load_no, change): tables that are new in a load or removed by it, against the load of the next smaller number that the lake has."""
    held = tables.select(column, load_col).dropna().distinct()
    loads = held.select(load_col).distinct()
    pairs = loads.select(F.col(load_col).alias("load")).join(loads.select(F.col(load_col).alias("before")), F.col("before") < F.col("load")).groupBy("load").agg(F.max("before").alias("before"))
    now = held.join(F.broadcast(pairs), F.col(load_col) == F.col("load")).select(column, "load")  # one row a load
    then = held.join(F.broadcast(pairs), F.col(load_col) == F.col("before")).select(column, "load")
    out = now.join(then, [column, "load"], "left_anti").withColumn("change", F.lit("new")).unionByName(then.join(now, [column, "load"], "left_anti").withColumn("change", F.lit("removed")))
    return out.withColumnRenamed("load", load_col)


def table_changes(old: DataFrame, new: DataFrame, column: str = "source_name") -> DataFrame:
    """(source_name, change): tables that are new or removed."""
    a, b = old.select(column).distinct(), new.select(column).distinct()
    return b.join(a, column, "left_anti").withColumn("change", F.lit("new")).unionByName(a.join(b, column, "left_anti").withColumn("change", F.lit("removed")))
