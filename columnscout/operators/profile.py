"""Column profiles of a lake: catalogue, type inference, exact and approximate statistics, sketches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from columnscout.functions.numbers import is_blank, is_integer, is_numerical, to_integer, to_number
from columnscout.operators import quality
from columnscout.plans.lineage import Stages

COLUMNS = "nid long, db_name string, source_name string, field_name string, path string"


def nid_of(db: str, source: str, field: str) -> int:
    """A column's id: crc32 of the UTF-8 bytes of db, source and field name."""
    return zlib.crc32(f"{db}{source}{field}".encode())


def catalogue(spark: SparkSession, tables: Mapping[str, DataFrame], db: str, path: str = "") -> DataFrame:
    """(nid, db_name, source_name, field_name, path) of every column; two columns with one id raise an error."""
    rows = [(nid_of(db, t, c), db, t, c, path) for t, df in tables.items() for c in df.columns]
    if len({r[0] for r in rows}) != len(rows):
        raise ValueError("two columns of the lake have the same id")
    return spark.createDataFrame(rows, COLUMNS)


def as_cell(column: Column, kind: T.DataType) -> Column:
    """A typed value as the string that the profiler sees; fractions without exponent, nested values as JSON."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        plain = F.regexp_replace(column.cast("decimal(38,9)").cast("string"), r"(\.[0-9]*?)0+$", "$1")
        short = ((F.abs(column) >= 1e-3) & (F.abs(column) < 1e7)) | (column == 0)  # these have no exponent as they are
        return F.when(short | (F.abs(column) >= 1e28), column.cast("string")).otherwise(F.regexp_replace(plain, r"\.$", ".0"))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def melt(tables: Mapping[str, DataFrame], db: str) -> DataFrame:
    """(nid, value): every cell of every table as a string, one pass over each table."""
    parts = []
    for t, df in tables.items():
        cells = F.array(*(F.struct(F.lit(nid_of(db, t, f.name)).cast("long").alias("nid"), as_cell(df[f.name], f.dataType).alias("value")) for f in df.schema))
        parts.append(df.select(F.inline(cells)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def value_counts(cells: DataFrame) -> DataFrame:
    """(nid, value, n): distinct values of each column with their frequency; the base of all exact statistics."""
    return cells.groupBy("nid", "value").agg(F.count("*").alias("n"))


def table_counts(tables: Mapping[str, DataFrame], db: str) -> DataFrame:
    """`value_counts` of the cells that `melt` gives, but counted in the columns' own types: whole and floating numbers become strings once for each distinct value, not for each cell.

    A negative zero counts as zero.
    """
    kinds: dict[str, list[DataFrame]] = {"long": [], "double": [], "string": []}
    for t, df in tables.items():
        held: dict[str, list[Column]] = {k: [] for k in kinds}
        for f in df.schema:
            kind = "long" if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else "double" if isinstance(f.dataType, T.DoubleType) else "string"
            cell = as_cell(df[f.name], f.dataType) if kind == "string" else df[f.name].cast(kind)
            held[kind].append(F.struct(F.lit(nid_of(db, t, f.name)).cast("long").alias("nid"), cell.alias("value")))
        for kind, cells in held.items():
            if cells:
                kinds[kind].append(df.select(F.inline(F.array(*cells))))
    parts = []
    for kind, melted in kinds.items():
        if melted:
            counted = reduce(DataFrame.unionByName, melted).groupBy("nid", "value").agg(F.count("*").alias("n"))
            if kind == "long":
                counted = counted.withColumn("value", F.col("value").cast("string"))
            elif kind == "double":  # several tiny numbers may read alike
                counted = counted.withColumn("value", as_cell(F.col("value"), T.DoubleType())).groupBy("nid", "value").agg(F.sum("n").alias("n"))
            parts.append(counted)
    return reduce(DataFrame.unionByName, parts)


def infer_types(counts: DataFrame, text_only: bool = False) -> DataFrame:
    """(nid, data_type): STRING if any cell that isn't blank isn't numeric, else FLOAT if any isn't an integer, else INT; all blank is STRING.

    With `text_only` every column is STRING. compat: all rows are looked at, not only a first batch.
    """
    if text_only:
        return counts.select("nid", F.lit("STRING").alias("data_type")).distinct()
    seen = ~is_blank(F.col("value"))
    agg = counts.groupBy("nid").agg(
        F.max(seen).alias("any"), F.max(seen & ~is_numerical(F.col("value"))).alias("text"), F.max(seen & ~is_integer(F.col("value"))).alias("fraction"))
    kind = F.when(~F.coalesce("any", F.lit(False)) | F.col("text"), "STRING").when(F.col("fraction"), "FLOAT").otherwise("INT")
    return agg.select("nid", kind.alias("data_type"))


def nearest_ranks(steps: DataFrame, quantiles: tuple[float, ...]) -> DataFrame:
    """(nid, q, v): exact nearest-rank quantiles of non-negative whole numbers (nid, v, n), v occurring n times.

    First the bucket of each quantile is found among at most 64 x 1024 buckets a column (by leading bits, in order), then only the values of
    that bucket are sorted: no column is sorted in one task.
    """
    bits = F.length(F.bin("v"))
    lead = F.when(bits <= 11, F.col("v")).otherwise((bits - 11) * 1024 + F.call_function("shiftright", F.col("v"), (bits - 11).cast("int")))
    s = steps.withColumn("bucket", lead.cast("long"))
    order = Window.partitionBy("nid").orderBy("bucket")
    buckets = s.groupBy("nid", "bucket").agg(F.sum("n").alias("m")).withColumn("upto", F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("whole", F.sum("m").over(Window.partitionBy("nid")))
    each = buckets.withColumn("q", F.explode(F.array(*(F.lit(q) for q in quantiles)))).withColumn("rank", F.ceil(F.col("q") * F.col("whole")))
    aimed = each.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("m") < F.col("rank"))).select("nid", "bucket", "q", "rank", (F.col("upto") - F.col("m")).alias("below"))
    within = Window.partitionBy("nid", "q").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = s.join(aimed, ["nid", "bucket"]).withColumn("at", F.col("below") + F.sum("n").over(within))
    return found.where(F.col("at") >= F.col("rank")).groupBy("nid", "q").agg(F.min("v").alias("v"))


def profile(counts: DataFrame, types: DataFrame | None = None, stages: Stages | None = None) -> DataFrame:
    """Exact profile of each column: (nid, data_type N or T, total_values, unique_values, uniqueness, min_value, max_value, avg_value, stddev, q25, median, q75, iqr).

    Numeric columns count the cells that parse; text columns the cells that aren't null. Quantiles are the
    nearest rank of abs(trunc(v)); min and max keep the sign. compat: true extremes, where the stored ones started
    at a bound of the type. Runs over distinct values, so a column of few values costs little however long it is. With `stages` what
    is read several times is written once.
    """
    keep = (lambda df, name: stages.write(df, name)) if stages else (lambda df, name: df)
    types = keep(infer_types(counts), "types") if types is None else types
    typed = counts.join(types, "nid").withColumn("data_type", F.when(F.col("data_type") == "STRING", "T").otherwise("N"))
    typed = typed.withColumn("number", F.when(F.col("data_type") == "N", to_number(F.col("value"))))
    used = F.when(F.col("data_type") == "N", F.col("number").isNotNull()).otherwise(F.col("value").isNotNull())
    typed = keep(typed.where(used).select("nid", "data_type", "number", "n"), "typed")
    mean = F.sum(F.col("number") * F.col("n")) / F.sum(F.when(F.col("number").isNotNull(), F.col("n")))
    base = typed.groupBy("nid", "data_type").agg(
        F.sum("n").alias("total_values"), F.count("*").alias("unique_values"), F.min("number").alias("min_value"), F.max("number").alias("max_value"),
        mean.alias("avg_value"), (F.sum(F.col("number") * F.col("number") * F.col("n")) / F.sum(F.when(F.col("number").isNotNull(), F.col("n")))).alias("square"))
    base = base.withColumn("stddev", F.sqrt(F.greatest(F.col("square") - F.col("avg_value") * F.col("avg_value"), F.lit(0.0)))).drop("square")
    steps = typed.where("number is not null").groupBy("nid", F.abs(F.col("number").cast("long")).alias("v")).agg(F.sum("n").alias("n"))
    quantiles = nearest_ranks(keep(steps, "steps"), (0.25, 0.5, 0.75)).groupBy("nid").pivot("q", [0.25, 0.5, 0.75]).agg(F.first("v")).toDF("nid", "q25", "median", "q75")
    out = base.join(quantiles, "nid", "left")
    return out.withColumn("iqr", F.col("q75") - F.col("q25")).withColumn("uniqueness", F.col("unique_values") / F.col("total_values"))


def approximate_profile(cells: DataFrame, rsd: float = 0.01, accuracy: int = 10_000) -> DataFrame:
    """One-pass profile with sketches: (nid, total_values, unique_values, min_value, max_value, q25, median, q75). For lakes where exact distincts are too dear."""
    number = to_number(F.col("value"))
    q = F.percentile_approx(F.abs(number.cast("long")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), accuracy)
    agg = cells.groupBy("nid").agg(F.count("value").alias("total_values"), F.approx_count_distinct("value", rsd).alias("unique_values"), F.min(number).alias("min_value"), F.max(number).alias("max_value"), q.alias("q"))
    return agg.select("*", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75")).drop("q")


def cast_column(cells: DataFrame, kind: str) -> DataFrame:
    """(nid, value) cast as the profiler does: FLOAT drops commas and is 32 bit, INT is 64 bit; cells that don't parse are dropped."""
    if kind == "FLOAT":
        value = to_number(F.col("value")).cast("float")
    elif kind == "INT":
        value = to_integer(F.col("value"))
    else:
        value = F.col("value")
    return cells.select("nid", value.alias("value")).where("value is not null")


def minhash(values: DataFrame, k: int = 512, seed: int = 1, id_col: str = "nid", value_col: str = "value") -> DataFrame:
    """(id, minhash array<long>) of each column's tokens: k minima of xxhash64-based hashes.

    Tokens are the parts of the lower-cased value between spaces, `_` and `-`. Partial minima of a batch are merged by
    position, so a column of any size is never gathered. compat: one hash family throughout.
    """
    token = F.explode(F.filter(F.split(F.lower(F.translate(value_col, "_-", "  ")), " +"), lambda t: t != ""))
    hashes = values.where(F.col(value_col).isNotNull()).select(F.col(id_col).alias("id"), token.alias("t")).select("id", F.xxhash64("t").alias("h"))
    rng = np.random.default_rng(seed)
    odd, add = rng.integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, k, dtype=np.uint64)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            both = np.unique(np.stack((b.column(0).to_numpy(), b.column(1).to_numpy())), axis=1)
            ids, h = both[0], np.ascontiguousarray(both[1]).view(np.uint64)
            names, start = np.unique(ids, return_index=True)
            out = np.empty((len(names), k), np.int64)
            with np.errstate(over="ignore"):
                for i in range(k):
                    out[:, i] = (np.minimum.reduceat((h * odd[i] + add[i]) >> np.uint64(1), start)).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, k, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(names), lists], ["id", "m"])

    parts = hashes.mapInArrow(partial, "id long, m array<long>")
    slots = parts.select("id", F.posexplode("m").alias("slot", "h")).groupBy("id", "slot").agg(F.min("h").alias("h"))
    return slots.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "h"))), lambda x: x["h"]).alias("minhash")).withColumnRenamed("id", id_col)


def one_permutation(values: DataFrame, k: int = 512, id_col: str = "nid", value_col: str = "value") -> DataFrame:
    """(id, slot, h): one-permutation sketch; the hash picks the slot, and the least rest of a slot stays. Built-in functions only."""
    h = F.xxhash64(F.lower(value_col))
    return values.where(F.col(value_col).isNotNull()).groupBy(F.col(id_col), F.pmod(h, F.lit(k)).alias("slot")).agg(F.min(F.shiftrightunsigned(h, 10)).alias("h"))


#: Patterns of the entity tagger.
ENTITIES = {"date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", "money": r"^[$€£] ?[0-9][0-9,]*(\.[0-9]+)?$", "percentage": r"^[0-9]+(\.[0-9]+)? ?%$", "time": r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$"}


def entities(counts: DataFrame, least: float = 0.5) -> DataFrame:
    """(nid, entity, share): entities that at least `least` of a column's non-blank cells look like."""
    seen = counts.where(~is_blank(F.col("value")))
    total = seen.groupBy("nid").agg(F.sum("n").alias("total"), *(F.sum(F.when(F.col("value").rlike(p), F.col("n")).otherwise(0)).alias(e) for e, p in ENTITIES.items()))
    each = total.select("nid", "total", F.explode(F.create_map(*(x for e in ENTITIES for x in (F.lit(e), F.col(e))))).alias("entity", "n"))
    return each.select("nid", "entity", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= least)


def kolmogorov_smirnov(counts: DataFrame, a: int, b: int) -> DataFrame:
    """One row (statistic): the largest difference between the distribution functions of two different numeric columns; none if one is empty. Long columns are summed in ranges."""
    load = F.when(F.col("nid") == a, 1).otherwise(2)
    values = counts.where(F.col("nid").isin(a, b)).select(F.lit(0).cast("long").alias("nid"), load.alias("load_no"), "value", to_number(F.col("value")).alias("number"), "n").where("number is not null")
    loads = quality.with_previous(quality.column_profile(values))
    return quality.distribution_distance(values, loads, least=1).select(F.col("distance").alias("statistic"))


def value_overlap(counts: DataFrame, a: int, b: int, share: float = 0.4) -> DataFrame:
    """One row (shared, size_a, size_b, overlaps): distinct values in common, and whether they reach `share` of the sum of both sizes."""
    sides = counts.where(F.col("nid").isin(a, b) & F.col("value").isNotNull()).groupBy("value").agg(F.max(F.col("nid") == a).alias("in_a"), F.max(F.col("nid") == b).alias("in_b"))
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = sides.agg(one(F.col("in_a") & F.col("in_b")).alias("shared"), one(F.col("in_a")).alias("size_a"), one(F.col("in_b")).alias("size_b"))
    return out.withColumn("overlaps", F.col("shared") >= share * (F.col("size_a") + F.col("size_b")))
