"""Problem 2: column-level data quality profile.

`value_counts` reduces the cells to distinct values; everything else is an aggregate of
it: `column_profile` (nulls, distincts, ranges, violations of patterns), `power_sums` (exact sums that merge
across parts and loads), `shift` (standardised differences of successive loads, from the sums),
`distribution_distance` (the largest difference of their distribution functions) and `findings` (which
loads contradict the stored profile or differ from the load before).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the pattern of a numeric cell; commas are dropped for the number.
NUMBER = r"^[+-]?[0-9]+(,[0-9]+)*(\.[0-9]+)?$"
#: Columns with more distinct values than this are sorted in ranges, by splitters from a hash sample of their values.
RANGE_VALUES = 500_000
#: At most so many splitters a column, one for about every RANGE_VALUES values; they are searched in two steps.
SPLITTERS = 4095
STEP = 64
#: Named patterns of cells, for violation counts.
PATTERNS = {"integer": r"^[+-]?[0-9]+$", "number": NUMBER, "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "code": r"^[A-Z]+[-_]?[0-9]+$", "words": r"^[A-Za-z]+( [A-Za-z]+)*$"}
#: Numbers have so many significant digits; further ones are rounded.
DIGITS = 15


def blank(value: Column) -> Column:
    return value.isNull() | (value == "") | (F.lower(value) == "nan")


def counting_cells(cells: DataFrame) -> DataFrame:
    """(nid, load_no, row_no, value) with the latest row of each (nid, load_no, row_no), values trimmed of spaces.

    Rows with a null key don't count. Of rows that tie in received_at the one with the
    greatest value counts, null last. Repeats are merged before they are shuffled.
    """
    keyed = cells.where("nid is not null and load_no is not null and row_no is not null")
    # non-null received_at first, then the value: a struct whose null fields sort below all others
    return keyed.groupBy("nid", "load_no", "row_no").agg(F.max(F.struct("received_at", F.trim("value").alias("value"))).alias("m")).select("nid", "load_no", "row_no", F.col("m.value").alias("value"))


def value_counts(cells: DataFrame, pattern: str = NUMBER) -> DataFrame:
    """(nid, load_no, value, number, n): distinct trimmed values and how often each occurs.

    All blanks are one row with a null value. `number` is null unless the value matches `pattern` and,
    without its commas, reads as a number.
    """
    value = F.when(blank(F.col("value")), F.lit(None)).otherwise(F.col("value"))
    counted = counting_cells(cells).select("nid", "load_no", value.alias("value")).groupBy("nid", "load_no", "value").agg(F.count("*").alias("n"))
    number = F.when(F.col("value").rlike(pattern), F.regexp_replace("value", ",", "").try_cast("double"))
    return counted.select("nid", "load_no", "value", number.alias("number"), "n")


def column_profile(counts: DataFrame, patterns: Mapping[str, str] | None = None) -> DataFrame:
    """One row for each (nid, load_no) of `value_counts`.

    total, blanks, uniques, violations (non-blank cells that aren't numbers), data_type
    (N if there are non-blank cells and all are numbers, else T), min_value, max_value,
    and for each of `patterns` not_<name>: non-blank cells that don't match it.
    """
    seen = F.col("value").isNotNull()
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    agg = counts.groupBy("nid", "load_no").agg(
        count(seen).alias("total"), count(~seen).alias("blanks"), F.count("value").alias("uniques"),
        count(seen & F.col("number").isNull()).alias("violations"),
        F.min("number").alias("min_value"), F.max("number").alias("max_value"),
        *(count(seen & ~F.col("value").rlike(p)).alias(f"not_{name}") for name, p in (patterns or {}).items()))
    kind = F.when((F.col("total") > 0) & (F.col("violations") == 0), "N").otherwise("T")
    return agg.withColumn("data_type", kind)


def decimal_parts(value: Column, number: Column) -> tuple[Column, Column]:
    """(mantissa, exponent) of a numeric cell: the number is mantissa * 10 ** exponent, exactly for up to DIGITS significant digits."""
    clean = F.regexp_replace(value, "[+,-]", "")
    whole, part = F.split_part(clean, F.lit("."), F.lit(1)), F.rtrim(F.split_part(clean, F.lit("."), F.lit(2)), F.lit("0"))
    digits = F.ltrim(F.concat(whole, part), F.lit("0"))
    rounded = F.format_string(f"%.{DIGITS - 1}e", F.abs(number))
    fits = value.rlike(NUMBER) & (F.length(digits) <= DIGITS)
    mantissa = F.when(fits, F.when(digits == "", F.lit("0")).otherwise(digits)).otherwise(F.regexp_replace(F.split_part(rounded, F.lit("e"), F.lit(1)), "[.]", ""))
    exponent = F.when(fits, -F.length(part)).otherwise(F.split_part(rounded, F.lit("e"), F.lit(2)).try_cast("int") - (DIGITS - 1))
    sign = F.when(value.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    return mantissa.try_cast("long") * sign, exponent


def power_sums(counts: DataFrame) -> DataFrame:
    """(nid, load_no, sums): exact power sums of the numbers of each load, of any magnitude.

    `sums` has an entry (e, n, s1, hh, hl, ll) for each decimal exponent e that occurs, few in number: the numbers m * 10 ** e
    with integer m = h * 10 ** 8 + l have the count n, the sum s1 of the m, and the sums of h * h, h * l and l * l. All are integers
    in decimals, so they are the same in any order, and those of two parts add up entry by entry (`merge_sums`).
    """
    m, e = decimal_parts(F.col("value"), F.col("number"))
    rows = counts.where("number is not null").select("nid", "load_no", e.alias("e"), F.col("n").cast("decimal(18,0)").alias("n"), m.alias("m"))
    rows = rows.select("nid", "load_no", "e", "n", "m", F.expr("m div 100000000").alias("h"), F.expr("m % 100000000").alias("l"))
    product = lambda x: F.sum(x.cast("decimal(18,0)") * F.col("n")).cast("decimal(38,0)")
    each = rows.groupBy("nid", "load_no", "e").agg(F.sum("n").cast("decimal(38,0)").alias("n"), product(F.col("m")).alias("s1"), product(F.col("h") * F.col("h")).alias("hh"),
                                                   product(F.col("h") * F.col("l")).alias("hl"), product(F.col("l") * F.col("l")).alias("ll"))
    return each.groupBy("nid", "load_no").agg(F.array_sort(F.collect_list(F.struct("e", "n", "s1", "hh", "hl", "ll"))).alias("sums"))


def merge_sums(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sums): power sums of several parts or loads, as if they had been counted together."""
    each = parts.select(*keys, F.inline("sums")).groupBy(*keys, "e").agg(*(F.sum(c).cast("decimal(38,0)").alias(c) for c in ("n", "s1", "hh", "hl", "ll")))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("e", "n", "s1", "hh", "hl", "ll"))).alias("sums"))


def _moments(sums: list[dict]) -> tuple[int, Fraction, Fraction]:
    """Count, mean and variance (of the population) from power sums, without rounding."""
    n = sum(int(x["n"]) for x in sums)
    s1 = sum((Fraction(int(x["s1"])) * Fraction(10) ** x["e"] for x in sums), Fraction(0))
    s2 = sum((Fraction(int(x["hh"]) * 10**16 + 2 * int(x["hl"]) * 10**8 + int(x["ll"])) * Fraction(10) ** (2 * x["e"]) for x in sums), Fraction(0))
    mean = s1 / n
    return n, mean, s2 / n - mean * mean


def _root(x: Fraction) -> float:
    """The square root of a fraction of any magnitude."""
    shift = (x.denominator.bit_length() - x.numerator.bit_length()) // 2
    return math.ldexp(math.sqrt(x * Fraction(4) ** shift), -shift)


def with_previous(profile: DataFrame) -> DataFrame:
    """The profile with prev_* columns of the load with the next smaller load_no of the same nid (null for the first)."""
    order = Window.partitionBy("nid").orderBy("load_no")  # one row a load
    kept = [c for c in ("load_no", "total", "blanks", "data_type", "sums") if c in profile.columns]
    return profile.select("*", *(F.lag(c).over(order).alias(f"prev_{c}") for c in kept))


def _ranges(rows: DataFrame, counts: DataFrame, range_values: int) -> DataFrame:
    """`rows` with a column `part`: 0, or for a column of very many values the number of its splitters that aren't above the row's value.

    A column has a splitter for about every `range_values` of its values, up to SPLITTERS.
    """
    big = counts.where("value is not null").groupBy("nid").agg(F.count("*").alias("m")).where(F.col("m") > range_values).select("nid", F.least(F.ceil(F.col("m") / range_values), F.lit(SPLITTERS)).alias("most"))
    sample = counts.where("value is not null").join(big, "nid").select("nid", "number", "value", "most").withColumn(
        "nth", F.row_number().over(Window.partitionBy("nid").orderBy(F.xxhash64("value"), "value"))).where("nth <= most")
    splitters = sample.groupBy("nid").agg(F.array_sort(F.collect_list("value")).alias("by_value"), F.array_sort(F.collect_list("number")).alias("by_number"))

    def below(splits: str, x: str) -> Column:
        """How many splitters are at most x: first among every STEP-th, then in the step found."""
        every = F.filter(splits, lambda s, i: i % STEP == 0)
        steps = F.size(F.filter(every, lambda s: s <= F.col(x)))
        start = F.greatest(steps - 1, F.lit(0)) * STEP
        return start + F.size(F.filter(F.slice(splits, start + 1, F.lit(STEP)), lambda s: s <= F.col(x)))

    part = F.when(F.col("numeric"), below("by_number", "number")).otherwise(below("by_value", "value"))
    return rows.join(splitters, "nid", "left").withColumn("part", F.when(F.col("by_value").isNull(), 0).otherwise(part)).drop("by_value", "by_number")


def distribution_distance(counts: DataFrame, loads: DataFrame, least: int = 30, range_values: int | None = RANGE_VALUES) -> DataFrame:
    """(nid, load_no, distance): the largest difference over all v between the shares of non-blank values <= v in a load and the load before.

    `loads` is `with_previous`; only loads that have, like the load before, at
    least `least` non-blank values are compared. Ordered by number if both loads are N,
    else by bytes of the string. Each range of values of a column is summed by
    itself; its running extremes are then shifted by the totals of the ranges below.
    `range_values` None leaves out the ranges, for inputs whose columns are all short.
    """
    able = loads.where(F.col("prev_load_no").isNotNull() & (F.col("total") >= least) & (F.col("prev_total") >= least))
    numeric = (F.col("data_type") == "N") & (F.col("prev_data_type") == "N")
    able = able.select("nid", F.col("load_no").alias("at"), "prev_load_no", "total", "prev_total", numeric.alias("numeric"))
    now = able.select("nid", F.col("at").alias("load_no"), "at", "numeric", F.col("total").alias("of"), F.lit(1).alias("sign"))
    before = able.select("nid", F.col("prev_load_no").alias("load_no"), "at", "numeric", F.col("prev_total").alias("of"), F.lit(-1).alias("sign"))
    # at most two roles a load, so that the values are read and shuffled once
    roles = now.union(before).groupBy("nid", "load_no").agg(F.collect_list(F.struct("at", "numeric", "of", "sign")).alias("roles"))
    rows = counts.where("value is not null").join(roles, ["nid", "load_no"]).select("nid", "value", "number", "n", F.inline("roles"))
    share = F.col("sign") * F.col("n") / F.col("of")
    # values that are equal as numbers are one step
    rows = rows.select("nid", "at", "numeric", F.when(F.col("numeric"), F.col("number")).alias("number"), F.when(~F.col("numeric"), F.col("value")).alias("value"), share.alias("step"))
    rows = _ranges(rows, counts, range_values) if range_values is not None else rows.withColumn("part", F.lit(0))
    spot = Window.partitionBy("nid", "at", "part").orderBy("number", "value")
    running = rows.withColumn("sum", F.sum("step").over(spot))
    parts = running.groupBy("nid", "at", "part").agg(F.max("sum").alias("high"), F.min("sum").alias("low"), F.sum("step").alias("whole"))
    below = F.coalesce(F.sum("whole").over(Window.partitionBy("nid", "at").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    parts = parts.withColumn("below", below)
    distance = F.max(F.greatest(F.abs(F.col("below") + F.col("high")), F.abs(F.col("below") + F.col("low"))))
    return parts.groupBy("nid", F.col("at").alias("load_no")).agg(distance.alias("distance"))


def shift(loads: DataFrame) -> DataFrame:
    """(nid, load_no, difference): standardised difference of the means between a numeric load and the numeric load before.

    `loads` is `with_previous` of a profile with `sums` (`power_sums`). (mean - mean before) over the square root of the mean of the
    two variances, worked out in whole numbers and rounded once; null where both variances are 0. One row a load goes
    through Python, in Arrow batches: no type of the JVM's holds the products.
    """
    kinds = dict(loads.dtypes)

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for now, before in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                (_, mean, var), (_, old, old_var) = _moments(now), _moments(before)
                pooled = (var + old_var) / 2
                gap = mean - old
                out.append(None if pooled == 0 else math.copysign(_root(gap * gap / pooled), gap) if gap else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["nid", "load_no", "difference"])

    both = loads.where("data_type = 'N' and prev_data_type = 'N' and sums is not null and prev_sums is not null").select("nid", "load_no", "sums", "prev_sums")
    return both.mapInArrow(differences, f"nid {kinds['nid']}, load_no {kinds['load_no']}, difference double")


def stored_profiles(profile: DataFrame) -> DataFrame:
    """(nid, load_no, ...) the latest stored row of each (id, load_no); reads none of the sketches."""
    stored = F.struct("updated_at", "received_at", "dataType", "totalValues", "uniqueValues", "minValue")
    rows = profile.where("id is not null and load_no is not null").groupBy(F.col("id").alias("nid"), "load_no").agg(F.max(stored).alias("m"))
    return rows.select("nid", "load_no", F.lit(True).alias("stored"), *(F.col(f"m.{c}").alias(c) for c in ("dataType", "totalValues", "uniqueValues", "minValue")))


def findings(cells: DataFrame, profile: DataFrame, counts: DataFrame | None = None, range_values: int | None = RANGE_VALUES) -> DataFrame:
    """(nid, load_no, finding): loads whose stored profile is wrong (count, type, range) or that differ from the load before (blank, drift).

    A load without a stored row has no count, type or range finding. Empty tables give an empty result.
    Pass `counts` (a written `value_counts`) to read the cells only once.
    """
    counts = value_counts(cells) if counts is None else counts
    loads = with_previous(column_profile(counts))
    distance = distribution_distance(counts, loads, range_values=range_values)
    all_ = loads.join(stored_profiles(profile), ["nid", "load_no"], "left").join(distance, ["nid", "load_no"], "left")
    stored = F.coalesce("stored", F.lit(False))
    count = stored & (F.col("totalValues").isNull() | F.col("uniqueValues").isNull() | (F.col("totalValues") != F.col("total")) | (F.abs(F.col("uniqueValues") - F.col("uniques")) > 0.05 * F.col("uniques")))
    kind = stored & ~F.col("dataType").eqNullSafe(F.col("data_type"))
    range_ = stored & (F.col("data_type") == "N") & (F.col("minValue").isNull() | F.isnan("minValue") | (F.abs(F.col("minValue") - F.col("min_value")) > 1e-6))
    share = lambda p: F.col(f"{p}blanks") / (F.col(f"{p}blanks") + F.col(f"{p}total"))
    blanks = F.col("prev_load_no").isNotNull() & (F.round(share("") - share("prev_"), 6) > 0.1)
    drift = F.round("distance", 6) > 0.25
    named = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in (("count", count), ("type", kind), ("range", range_), ("blank", blanks), ("drift", drift))))
    return all_.select("nid", "load_no", F.explode(F.filter(named, lambda x: x.isNotNull())).alias("finding"))
