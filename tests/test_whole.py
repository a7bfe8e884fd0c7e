"""Operators run to the end: no caps on depth, graphs or hops; the same rows whatever is read; measured recall of the hashed searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from columnscout.functions.text import camel_to_snake, name_tokens
from columnscout.operators import ann, drift, graph, onto, relate, views
from columnscout.operators.drs import Drs, Op
from columnscout.operators.views import Join
from columnscout.plans import discovery, search_views
from columnscout.sources import readers


def test_ancestors_at_any_depth(spark):
    chain = [("k", f"c{i}", f"c{i + 1}") for i in range(20)] + [("k", "c20", None)] + [("k", "x", "y"), ("k", "y", "z"), ("k", "z", "y"), ("k", "s", "s")]
    got = {(r.name, r.ancestor): r.distance for r in onto.ancestors(spark.createDataFrame(chain, "kr string, name string, parent string")).collect()}
    assert {(a, d) for (n, a), d in got.items() if n == "c0"} == {(f"c{i}", i) for i in range(1, 21)}
    assert {k: d for k, d in got.items() if k[0] in "xyzs"} == {("x", "y"): 1, ("x", "z"): 2, ("y", "z"): 1, ("z", "y"): 1}
    assert onto.ancestors(spark.createDataFrame([], "kr string, name string, parent string")).count() == 0


def test_all_join_graphs_come_out_in_order():
    paths = {(a, b): [[Join(a, f"{b}{i}", b, f"{a}{i}")] for i in range(40)] for a, b in (("s", "t"), ("t", "u"))}
    graphs = list(views.join_graphs(["s", "t", "u"], paths))
    assert len(graphs) == 1600 and len({views.graph_id(g) for g in graphs}) == 1600
    longer = {("s", "t"): [[Join("s", "a", "m", "b"), Join("m", "c", "t", "d")], [Join("s", "a", "t", "d")]]}
    assert [len(g) for g in views.join_graphs(["s", "t"], longer)] == [1, 2]
    assert list(views.join_graphs(["s", "t"], {})) == []
    shuffled = {k: v[::-1] for k, v in paths.items()}
    assert next(views.join_graphs(["s", "t", "u"], shuffled)) == graphs[0]


def test_provenance_to_the_end(spark):
    """A chain of seven steps, a second way with a higher score, and a loop."""
    hits = spark.createDataFrame([(i, "d", "t", f"f{i}", float(i)) for i in range(9)], "nid long, db_name string, source_name string, field_name string, score double")
    steps = [(i, i + 1, int(Op.CONTENT_SIM)) for i in range(7)] + [(0, 8, int(Op.PKFK)), (8, 7, int(Op.PKFK)), (8, 7, int(Op.SCHEMA_SIM)), (6, 3, int(Op.CONTENT_SIM))]
    drs = Drs(hits, spark.createDataFrame(steps, "src_nid long, dst_nid long, op int"))
    assert {(r.nid, r.leaf) for r in drs.why().collect()} == {(i, 0) for i in range(9)}
    assert {(r.nid, r.leaf) for r in drs.why(1).collect()} == {(0, 0), (1, 0), (8, 0)}
    assert {r.nid: r.certainty for r in drs.certainty().collect()}[7] == sum(range(1, 8))
    assert sorted(len(r.path) for r in drs.paths_to(7).collect()) == [3, 8]
    texts = {r.explanation for r in drs.how(hits).where("nid = 7").collect()}
    assert "t:f0 -> PKFK -> t:f8 -> SCHEMA_SIM|PKFK -> t:f7" in texts and len(texts) == 2
    assert Drs.empty(spark).why().count() == Drs.empty(spark).certainty().count() == 0


def test_keyword_lookup_has_its_own_origin(spark):
    hits = spark.createDataFrame([(1, "d", "t", "f", 2.0)], "nid long, db_name string, source_name string, field_name string, score double")
    p = Drs.lookup(hits, "word").prov.first()
    assert p.dst_nid == 1 and p.op == Op.KW_LOOKUP and p.src_nid != 1


def test_shortest_paths_form_no_longer_ones(spark):
    ring = [(i, (i + 1) % 8) for i in range(8)]
    e = spark.createDataFrame([(a, b, 5, 1.0) for x, y in ring for a, b in ((x, y), (y, x))], "src long, dst long, relation int, score double")
    n = lambda *ids: spark.createDataFrame([(i,) for i in ids], "nid long")
    got = sorted(tuple(r.path) for r in graph.paths(n(0), n(4), e, 5, 6, shortest_only=True).collect())
    assert got == [(0, 1, 2, 3, 4), (0, 7, 6, 5, 4)]
    assert sorted(len(r.path) for r in graph.paths(n(0), n(3), e, 5, 6).collect()) == [4, 6]


def test_csv_rows_are_the_same_for_every_reader(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2\n3,y,z\n4,w\n")
    t = readers.csv_folder(spark, {"path": str(tmp_path)})["t.csv"]
    assert t.count() == len(t.collect()) == len(t.select("a").collect()) == len(t.select("b").collect()) == t.select(F.count("b")).first()[0] == 2


def test_names_of_any_script(spark):
    r = spark.createDataFrame([("prix_été",), ("客户 编号",), ("orderStatusCode",), ("HTTPServer2Name.csv",), ("",), (None,)], "n string").select(name_tokens(F.col("n")).alias("t"), camel_to_snake(F.col("n")).alias("s")).collect()
    assert [x.t for x in r] == [["prix", "été"], ["客户", "编号"], ["order", "status", "code"], ["http", "server2", "name"], [], None]


def test_changes_of_every_load(spark):
    v = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 3, "b"), (1, 3, "b"), (1, 3, None), (1, 4, None), (2, 2, "x"), (None, 1, "q")], "nid long, load_no int, value string")
    got = {(r.nid, r.load_no): (r.old_size, r.new_size, r.shared, r.jaccard) for r in drift.load_jaccard(v).collect()}
    assert got == {(1, 3): (2, 1, 1, 0.5), (1, 4): (1, 0, 0, 0.0)}
    t = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 2), ("b", 4), (None, 2)], "source_name string, load_no int")
    assert sorted(map(tuple, drift.load_changes(t).collect())) == [("a", 2, "removed"), ("c", 2, "new"), ("c", 4, "removed")]


@pytest.mark.parametrize("name, distance", [("rbp_buckets", "cosine"), ("rdp_buckets", "euclidean"), ("pca_buckets", "cosine"), ("rbp_tree", "cosine"), ("hamming1_probe", "cosine"), ("hamming2_permuted", "cosine")])
def test_recall_of_hashed_searches(spark, small, name, distance):
    """Of the ten nearest of every query, on the whole table."""
    folder = small.replace("sf0.001", "sf0.1")
    found = search_views.QUERIES[name](spark, folder).where("query <> id").select("query", "id")
    v = search_views._vectors(spark, folder)
    exact = ann.exact_nearest(v.where("id % 50 = 0"), v, 9, distance).select("query", "id")
    recall = ann.recall_precision(found, exact).first().recall
    print(name, round(recall, 3))
    assert recall >= 0.9


@pytest.mark.parametrize("few", [512, 8])
def test_all_similar_vectors(spark, monkeypatch, few):
    """Of clusters of more than ten vectors, none is left out, in one block and in several; zero vectors have no direction."""
    monkeypatch.setattr(relate, "FEW", few, raising=False)
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.standard_normal((6, 16)).repeat(15, axis=0) + 0.25 * rng.standard_normal((90, 16)), rng.standard_normal((30, 16)), np.zeros((2, 16))])
    got = relate.hashed_similarity(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>"))
    rows = [tuple(r) for r in got.collect()]
    u = v[:120] / np.linalg.norm(v[:120], axis=1)[:, None]
    cosine = u @ u.T
    np.fill_diagonal(cosine, 0)
    assert len(rows) == len({r[:2] for r in rows}) and {r[:2] for r in rows} == set(zip(*(x.tolist() for x in np.nonzero(cosine >= 0.8)), strict=True))
    assert max(np.bincount([r[0] for r in rows])) > 10 and all(abs(cosine[a, b] - s) < 1e-8 for a, b, s in rows)
    assert relate.hashed_similarity(spark.createDataFrame([], "id long, v array<double>")).count() == 0


def test_similar_names_of_stored_columns(spark, small):
    """As many as a comparison of all latent vectors gives."""
    names = discovery.columns_of(spark, small).select(name_tokens(F.lower("field_name")).alias("tokens")).where("size(tokens) > 0").distinct()
    v = np.stack([r.v for r in relate.reduced_vectors(names.select(F.xxhash64("tokens").alias("nid"), "tokens")).collect()])
    v = v[np.abs(v).max(axis=1) > 0]
    u = v / np.linalg.norm(v, axis=1)[:, None]
    assert discovery.schema_sim_hashed(spark, small).count() == (np.round(u @ u.T, 9) >= 0.8).sum() - len(u)


def test_pairs_of_vectors_are_not_shuffled(spark):
    """Ids of any type; the rows leave the tasks that compare the blocks, and nothing comes after them."""
    found = relate.hashed_similarity(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.1]), ("c", [0.0, 1.0])], "id string, v array<double>"))
    assert sorted((r.src, r.dst) for r in found.collect()) == [("a", "b"), ("b", "a")]
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("FlatMapGroupsInArrow")


def _above_last_join(df):
    """The optimised plan above its last join."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]


@pytest.mark.parametrize("chunk", [256, 2])
def test_links_of_all_elements(spark, monkeypatch, chunk):
    """Against all pairs; several vocabularies, sets of classes, columns without a name, repeated matchings, an unknown class."""
    monkeypatch.setattr(onto, "CHUNK", chunk, raising=False)
    rng = np.random.default_rng(5)
    voc = [("k", "c0", None), ("k", "c1", "c0"), ("k", "c2", "c0"), ("k", "c3", "c1"), ("k", "c3", "c2"), ("q", "c0", "c1"), ("q", "c1", None)]
    m = [("d", f"t{rng.integers(9)}", f"f{rng.integers(3)}", "kq"[rng.integers(2)], f"c{rng.integers(5)}") for _ in range(60)] + [("d", "t", None, "k", "c1"), (None, "t", "f", "k", "c1"), ("d", "t", "f", None, "c1"), ("d", "t", "f", "k", None)]
    step = {(k, n, p) for k, n, p in voc if p} | {(k, n, n) for k, n, _ in voc}
    differ = lambda a, b: any(x != y for x, y in zip(a, b, strict=True) if None not in (x, y))
    want = {(*a[:3], *b[:3], "is_a") for a in m for b in m if a[3] and a[3] == b[3] and (a[3], a[4], b[4]) in step and differ(a[:3], b[:3])}
    links = onto.find_links(spark.createDataFrame(m, "db_name string, source_name string, field_name string, kr string, name string"), spark.createDataFrame(voc, "kr string, name string, parent string"))
    rows = [tuple(r) for r in links.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_pairs_of_elements_are_not_gathered_again(spark, small):
    """The largest result of the vocabulary queries is written as it is joined, without a shuffle of its rows."""
    assert not any(x in _above_last_join(discovery.is_a_links(spark, small)) for x in ("Aggregate", "Repartition", "Sort", "Distinct"))
