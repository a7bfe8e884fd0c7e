"""View search: tables that fill a requested schema, join graphs between them, and the views they give."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    """A requested attribute, and a sample value that its column must hold ("" for none)."""

    attr: str
    value: str = ""
    number: int = 0


def filters_of(attrs: Sequence[str], values: Sequence[str]) -> list[Filter]:
    return [Filter(a, v, i) for i, (a, v) in enumerate(zip(attrs, values, strict=True))]


def normal(c: Column) -> Column:
    """How join keys and filter values are compared: lower case, without spaces around."""
    return F.lower(F.trim(c.cast("string")))


def fulfilling_columns(tables: Mapping[str, DataFrame], filters: Sequence[Filter]) -> DataFrame:
    """(number, source_name, field_name): columns that fulfil each filter, by name and, if given, by a value they hold."""
    parts = []
    for f in filters:
        for t, df in tables.items():
            if f.attr in df.columns:
                row = df.sparkSession.range(1) if not f.value else df.where(normal(F.col(f.attr)) == f.value.strip().lower()).limit(1)
                parts.append(row.select(F.lit(f.number).alias("number"), F.lit(t).alias("source_name"), F.lit(f.attr).alias("field_name")))
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "number int, source_name string, field_name string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def filter_tables(columns: DataFrame) -> DataFrame:
    """(source_name, filters, n): which filters each table fulfils; most first, then name descending."""
    return columns.groupBy("source_name").agg(F.array_sort(F.collect_set("number")).alias("filters")).withColumn("n", F.size("filters")).orderBy(F.col("n").desc(), F.col("source_name").desc())


def candidate_groups(table_filters: Sequence[tuple[str, Sequence[int]]], n_filters: int) -> Iterator[tuple[tuple[str, ...], tuple[int, ...]]]:
    """(tables, filters) of groups of tables: complete ones first, then partial ones.

    Each table in turn is the pivot; tables after it join while they fulfil something new. Runs over table names.
    """
    partial, seen = [], set()
    for i, (pivot, own) in enumerate(table_filters):
        group, held = [pivot], set(own)
        for other, more in table_filters[i + 1:]:
            if len(held) == n_filters:
                break
            if set(more) - held:
                group.append(other)
                held |= set(more)
        name = tuple(sorted(group))
        if name in seen:
            continue
        seen.add(name)
        if len(held) == n_filters:
            yield name, tuple(sorted(held))
        else:
            partial.append((name, tuple(sorted(held))))
    yield from partial


def exhaustive_groups(table_filters: Sequence[tuple[str, Sequence[int]]], most_tables: int | None = None) -> list[tuple[tuple[str, ...], tuple[int, ...]]]:
    """All groups of tables (of up to most_tables, if given), by how many filters they fulfil and then by how few tables they have."""
    held = dict(table_filters)
    out = [(g, tuple(sorted(set().union(*(held[t] for t in g))))) for k in range(1, (most_tables or len(held)) + 1) for g in combinations(sorted(held), k)]
    return sorted(out, key=lambda x: (-len(x[1]), len(x[0]), x[0]))


@dataclass(frozen=True)
class Join:
    """A hop of a join graph."""

    left: str
    left_key: str
    right: str
    right_key: str

    def canonical(self) -> tuple:
        return tuple(sorted(((self.left, self.left_key), (self.right, self.right_key))))


def _shortest_first(options: Sequence[Sequence[Sequence[Join]]]) -> Iterator[list[Sequence[Join]]]:
    """One path of each list, in every combination, in the order of their summed lengths and then of their places; each list is sorted by length."""
    if not all(options):
        return
    total = lambda at: sum(len(o[i]) for o, i in zip(options, at))
    start = (0,) * len(options)
    heap, seen = [(total(start), start)], {start}
    while heap:
        _, at = heapq.heappop(heap)
        yield [o[i] for o, i in zip(options, at)]
        for k in range(len(at)):
            after = (*at[:k], at[k] + 1, *at[k + 1:])
            if after[k] < len(options[k]) and after not in seen:
                seen.add(after)
                heapq.heappush(heap, (total(after), after))


def join_graphs(group: Sequence[str], paths: Mapping[tuple[str, str], Sequence[Sequence[Join]]]) -> Iterator[list[Join]]:
    """Join graphs that cover the group: unions of a path for each pair of a spanning choice of pairs, each graph once, in the order of their summed path lengths.

    `paths` has the join paths of each pair of tables (as of `graph.table_paths`). All graphs come out, one at a time, in an order that
    doesn't depend on that of the paths; the caller stops when it has enough. compat: paths of all pairs are used.
    """
    need, found = set(group), set()
    pairs = [p for p in combinations(sorted(group), 2)]
    name = lambda path: (len(path), tuple(j.canonical() for j in path))

    def walks(choice: Sequence[tuple[str, str]]) -> Iterator[tuple[int, list[Join]]]:
        options = [sorted([*paths.get(p, ()), *([Join(j.right, j.right_key, j.left, j.left_key) for j in reversed(path)] for path in paths.get(p[::-1], ()))], key=name) for p in choice]
        for combo in _shortest_first(options):
            joins = {j.canonical(): j for path in combo for j in path}
            covered = {t for (a, _), (b, _) in joins for t in (a, b)}
            if need <= covered and len(joins) == len(covered) - 1:  # a tree
                yield sum(map(len, combo)), list(joins.values())

    merged = heapq.merge(*(((size, n, i, g) for i, (size, g) in enumerate(walks(choice))) for n, choice in enumerate(combinations(pairs, len(group) - 1))), key=lambda x: x[:3])
    for _, _, _, graph in merged:
        key = frozenset(j.canonical() for j in graph)
        if key not in found:
            found.add(key)
            yield graph


def rank_join_graphs(graphs: Sequence[Sequence[Join]], uniqueness: Mapping[tuple[str, str], float]) -> list[tuple[float, list[Join]]]:
    """Join graphs by the mean, over their joins, of the greater uniqueness of the two keys, best first; ties by name."""
    score = lambda g: sum(max(uniqueness.get((j.left, j.left_key), 0.0), uniqueness.get((j.right, j.right_key), 0.0)) for j in g) / max(1, len(g))
    return sorted(((score(g), list(g)) for g in graphs), key=lambda x: (-x[0], graph_id(x[1])))


def graph_id(joins: Sequence[Join]) -> str:
    """A name of the join graph that doesn't depend on the order of its joins."""
    return "|".join(sorted("=".join(f"{t}.{k}" for t, k in j.canonical()) for j in joins))


def equi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, drop_null: bool = True) -> DataFrame:
    """Inner join on the normalised keys; clashing columns of the right get the suffix _x, again and again until free.

    Null keys, and with drop_null keys that read `nan` or `null`, don't match. AQE splits skewed keys.
    """
    rename = {}
    for c in right.columns:
        n = c
        while n in left.columns or n in rename.values():
            n += "_x"
        rename[c] = n
    r = right.select(*(F.col(f"`{c}`").alias(n) for c, n in rename.items())).withColumn("__rk", normal(F.col(rename[right_key])))
    l = left.withColumn("__lk", normal(F.col(left_key)))  # noqa: E741
    if drop_null:
        l, r = l.where(~F.col("__lk").isin("", "nan", "null")), r.where(~F.col("__rk").isin("", "nan", "null"))  # noqa: E741
    return l.join(r, F.col("__lk") == F.col("__rk")).drop("__lk", "__rk")


def apply_filter(df: DataFrame, attr: str, value: str) -> DataFrame:
    return df.where(normal(F.col(attr)) == value.strip().lower())


def find_key_for(df: DataFrame, key: str, attr: str, value: str) -> DataFrame:
    """(key): keys of the rows whose attribute has the value."""
    return apply_filter(df, attr, value).select(F.col(key).alias("key"))


def value_in_column(df: DataFrame, attr: str, value: str) -> DataFrame:
    """One row (found)."""
    return apply_filter(df, attr, value).limit(1).agg((F.count("*") > 0).alias("found"))


def materialise(tables: Mapping[str, DataFrame], joins: Sequence[Join], filters: Sequence[Filter] = (), sample: int | None = None) -> DataFrame:
    """The joined tables of a join graph, folded hop by hop from the first table; filters are conjunctive and applied before the joins.

    compat: every filter counts, and each hop joins with what was joined before. With `sample` each
    hop keeps the rows of so many keys (`consistent_sample`).
    """
    base = dict(tables)
    for f in filters:
        if f.value:
            for t in [t for t in base if f.attr in base[t].columns]:
                base[t] = apply_filter(base[t], f.attr, f.value)
    left = [*joins]
    first = left[0].left if joins else next(iter(tables))
    prefixed = {t: df.select(*(F.col(f"`{c}`").alias(f"{t}.{c}") for c in df.columns)) for t, df in base.items()}
    out, done = prefixed[first], {first}
    while left:
        j = next(j for j in left if j.left in done or j.right in done)
        left.remove(j)
        if j.left in done and j.right in done:
            out = out.where(normal(F.col(f"`{j.left}.{j.left_key}`")) == normal(F.col(f"`{j.right}.{j.right_key}`")))
            continue
        if j.right in done:
            j = Join(j.right, j.right_key, j.left, j.left_key)
        lk, rk = f"{j.left}.{j.left_key}", f"{j.right}.{j.right_key}"
        right = prefixed[j.right]
        if sample is not None:
            out, right = consistent_sample(out, right, lk, rk, sample)
        keyed = out.withColumn("__k", normal(F.col(f"`{lk}`")))
        out = keyed.join(right.withColumn("__k", normal(F.col(f"`{rk}`"))), "__k").where(~F.col("__k").isin("", "nan", "null")).drop("__k")
        done.add(j.right)
    return out


def is_materialisable(tables, joins, filters) -> bool:
    """Whether the join graph has a row under the filters; stops at the first."""
    return not materialise(tables, joins, filters).isEmpty()


def consistent_sample(left: DataFrame, right: DataFrame, left_key: str, right_key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Both sides cut to the n greatest keys (normalised) that both have, each key once a side."""
    a, b = left.withColumn("__s", normal(F.col(f"`{left_key}`"))), right.withColumn("__s", normal(F.col(f"`{right_key}`")))
    keys = a.select("__s").join(b.select("__s"), "__s", "left_semi").distinct().orderBy(F.col("__s").desc()).limit(n)
    cut = lambda df: df.join(keys, "__s", "left_semi").dropDuplicates(["__s"]).drop("__s")
    return cut(a), cut(b)


def project(view: DataFrame, filters: Sequence[Filter], columns: Mapping[int, tuple[str, str]]) -> DataFrame:
    """The requested attributes of a materialised view; `columns` has the (table, column) that fulfils each filter."""
    return view.select(*(F.col(f"`{t}.{c}`").alias(c) for t, c in (columns[f.number] for f in filters)))


def describe(view: DataFrame) -> DataFrame:
    """(column, n, distinct, nulls): of each column, in one pass."""
    cells = [x for c in view.columns for x in (F.count(F.col(f"`{c}`")).alias(f"n {c}"), F.count_distinct(F.col(f"`{c}`")).alias(f"d {c}"))]
    one = view.agg(F.count("*").alias("__n"), *cells)
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`n {c}`").alias("n"), F.col(f"`d {c}`").alias("distinct"), (F.col("__n") - F.col(f"`n {c}`")).alias("nulls")) for c in view.columns))))


def cleanliness(df: DataFrame) -> DataFrame:
    """(column, blank_share): share of null, empty or `nan` cells of each column."""
    one = df.agg(F.count("*").alias("__n"), *(F.sum(F.when(F.col(f"`{c}`").isNull() | normal(F.col(f"`{c}`")).isin("", "nan"), 1).otherwise(0)).alias(c) for c in df.columns))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), (F.col(f"`{c}`") / F.nullif(F.col("__n"), F.lit(0))).alias("blank_share")) for c in df.columns))))
