"""View search from requested attributes to views, lazily from one view to the next."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnscout.operators import graph, views
from columnscout.operators.relate import RELATIONS
from columnscout.operators.views import Join


@dataclass
class View:
    """A view that fulfils some of the filters: its tables, joins and rows."""

    tables: tuple[str, ...]
    joins: list[Join]
    filters: tuple[int, ...]
    rows: DataFrame


def join_paths(group: Sequence[str], edges: DataFrame, columns: DataFrame, max_hops: int = 2) -> dict[tuple[str, str], list[list[Join]]]:
    """Join paths over key relations between the tables of a group. The model's graph is read once; paths of a few hops between a few tables reach the driver."""
    names = {r["nid"]: r["field_name"] for r in columns.select("nid", "field_name").collect()}
    found = graph.table_paths(list(group), list(group), edges, columns, RELATIONS["PKFK"], max_hops).where("source < target").collect()
    out: dict[tuple[str, str], list[list[Join]]] = {}
    for r in found:
        out.setdefault((r["source"], r["target"]), []).append([Join(a, names[j["l"]], b, names[j["r"]]) for a, b, j in zip(r["tables"], r["tables"][1:], r["joins"])])
    return out


def find_views(tables: Mapping[str, DataFrame], edges: DataFrame, columns: DataFrame, attrs: Sequence[str], values: Sequence[str], max_hops: int = 2, sample: int | None = None) -> Iterator[View]:
    """Views with the requested attributes, complete ones first, short join graphs first.

    All views come out, one at a time; the caller stops when it has enough. A join graph is probed only if a sample value is asked for.
    """
    filters = views.filters_of(attrs, values)
    fulfilling = views.fulfilling_columns(tables, filters).collect()  # names only
    by_table: dict[str, set[int]] = {}
    for r in fulfilling:
        by_table.setdefault(r["source_name"], set()).add(r["number"])
    ordered = sorted(by_table.items(), key=lambda x: (-len(x[1]), [-ord(c) for c in x[0]]))
    for group, held in views.candidate_groups([(t, sorted(f)) for t, f in ordered], len(filters)):
        where = {n: (next(t for t in group if n in by_table[t]), filters[n].attr) for n in held}
        wanted = [filters[n] for n in held]
        graphs = [[]] if len(group) == 1 else views.join_graphs(group, join_paths(group, edges, columns, max_hops))
        for joins in graphs:
            base = {t: tables[t] for t in ({t for j in joins for t in (j.left, j.right)} or set(group))}
            if any(f.value for f in wanted) and not views.is_materialisable(base, joins, wanted):
                continue
            rows = views.materialise(base, joins, wanted, sample)
            yield View(group, joins, held, views.project(rows, wanted, where))


def first_view(*args, **kwargs) -> DataFrame:
    """Rows of the first view found; an error if there is none."""
    for v in find_views(*args, **kwargs):
        return v.rows
    raise LookupError("no view has these attributes")


def describe(found: Sequence[View]) -> list[tuple[str, str]]:
    """(tables, join graph) of views."""
    return [(",".join(v.tables), views.graph_id(v.joins)) for v in found]


def with_graph_column(v: View) -> DataFrame:
    return v.rows.withColumn("join_graph", F.lit(views.graph_id(v.joins)))
