"""Operators on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from columnscout.functions import numbers, text
from columnscout.functions.latest import latest_rows
from columnscout.operators import ann, annotations, drift, fourc, graph, onto, profile, relate, search, views
from columnscout.operators.drs import Drs, Mode, make_drs
from columnscout.operators.views import Join


@pytest.fixture(scope="module")
def hits(spark):
    """Hits h0 to h7 of the result set fixtures."""
    rows = [(10, "dba", "table_c", "v"), (0, "dba", "table_a", "a"), (1, "dba", "table_a", "b"), (2, "dba", "table_b", "c"), (3, "dba", "table_b", "d"), (1, "dba", "table_a", "b"), (16, "dba", "table_d", "a"), (17, "dba", "table_d", "b")]
    df = spark.createDataFrame([(i, *r, -1.0) for i, r in enumerate(rows)], "i int, nid long, db_name string, source_name string, field_name string, score double")
    return lambda *which: df.where(F.col("i").isin(*which)).drop("i")


def nids(df):
    return sorted(r.nid for r in df.collect())


def test_set_operators(hits):
    a, b = Drs.of(hits(0, 1, 2, 3, 4)), Drs.of(hits(5, 6, 7))
    assert (a.intersection(b).size(), a.union(b).size(), a.difference(b).size()) == (1, 7, 4)
    assert nids(a.table().intersection(b.table()).hits) == [0, 1]
    with pytest.raises(ValueError):
        a.union(b.table())


def test_modes(hits):
    d = Drs.of(hits(1, 2, 3, 4))
    assert d.rows().count() == 4 and sorted(r[0] for r in d.table().rows().collect()) == ["table_a", "table_b"]


def test_absorb_reaches_through_common_hit(spark, hits):
    columns = hits(0, 1, 2, 3, 4, 6, 7).drop("score")
    edges = spark.createDataFrame([(10, n, 2, 0.5) for n in (0, 1, 2, 3)] + [(1, n, 1, 0.5) for n in (16, 17)], "src long, dst long, relation int, score double")
    merged = Drs.of(hits(0)).content_similar_to(edges, columns).absorb(Drs.of(hits(5)).schema_similar_to(edges, columns))
    assert nids(merged.hits) == [0, 1, 2, 3, 16, 17]
    assert {(r.nid, r.leaf) for r in merged.why(3).collect()} == {(n, 10) for n in (0, 1, 2, 3, 16, 17)}
    assert {r.nid: round(r.certainty, 3) for r in merged.certainty(3).collect()}[16] == 1.0
    assert merged.coverage(3).where("coverage = 1").count() == 6


def test_make_drs(spark, hits):
    columns = hits(0, 1, 2, 3, 4, 6, 7).drop("score")
    assert nids(make_drs(spark, columns, 2, ("dba", "table_a", "a"), None).hits) == [0, 2]
    assert make_drs(spark, columns, "table_b").mode is Mode.TABLE
    with pytest.raises(TypeError):
        make_drs(spark, columns, 1.5)


@pytest.mark.parametrize("values, kind", [(["0", "9", "-324", "13457143587"], "INT"), (["160,124.08", "-71.0924"], "FLOAT"), (["1,234", "5"], "FLOAT"), (["6005262010"], "INT"), (["1", "2", "x"], "STRING"),
                                          (["", " ", "nan", "NaN", None], "STRING"), (["1e5", ".5"], "STRING")])
def test_type_inference(spark, values, kind):
    counts = profile.value_counts(spark.createDataFrame([(1, v) for v in values], "nid long, value string"))
    assert profile.infer_types(counts).first().data_type == kind


def test_casts(spark):
    c = spark.createDataFrame([(1, v) for v in ("+5", "-7", "1,000", "99999999999999999999", "x", None)], "nid long, value string")
    assert sorted(r.value for r in profile.cast_column(c, "INT").collect()) == [-7, 5]
    assert sorted(r.value for r in profile.cast_column(c, "FLOAT").where("value < 1e9").collect()) == [-7.0, 5.0, 1000.0]
    assert c.where(numbers.is_blank(F.col("value"))).count() == 1


def test_quantiles_of_a_seeded_sample(spark):
    x = np.random.default_rng(1).normal(175, 15, 20_000).round(3)
    p = profile.profile(profile.value_counts(spark.createDataFrame([(1, f"{v:.3f}") for v in x], "nid long, value string"))).first()
    s = np.sort(np.abs(np.trunc(x)))
    assert (p.q25, p.median, p.q75) == tuple(s[int(np.ceil(q * len(s))) - 1] for q in (0.25, 0.5, 0.75))
    assert p.avg_value == pytest.approx(x.mean()) and p.stddev == pytest.approx(x.std())


def test_floats_keep_their_digits(spark):
    df = spark.createDataFrame([(1.0e8,), (0.1,), (-12.5,), (None,)], "x double")
    assert sorted(r.value or "" for r in profile.melt({"t": df}, "d").collect()) == ["", "-12.5", "0.1", "100000000.0"]


def test_numeric_relations(spark):
    rows = [(1, 50, 50, 1.0, 100.0, 1.0), (2, 50, 40, 1.0, 100.0, 0.1), (3, 50, 45, 2.0, 99.0, 0.2), (4, 500, 10, 400.0, 600.0, 0.9), (5, 7, 0, 7.0, 7.0, 0.01), (6, 7, 0, 7.0, 7.0, 0.01), (7, -5, 2, -9.0, -1.0, 1.0)]
    p = spark.createDataFrame([(*r, "N") for r in rows], "nid long, median long, iqr long, min_value double, max_value double, uniqueness double, data_type string")
    pairs = lambda df: {(min(r.src, r.dst), max(r.src, r.dst)) for r in df.collect()}
    inclusion, content = relate.inclusion_dependencies(p), relate.numeric_content_similarity(p)
    assert pairs(inclusion) == {(1, 2), (1, 3)}
    assert {(r.src, r.dst): round(r.score, 3) for r in content.collect()} == {(3, 1): 0.9, (2, 3): 0.889}
    assert [(r.src, r.dst, r.score) for r in relate.single_point_clusters(p).collect()] == [(5, 6, 0.85)]
    assert pairs(relate.primary_foreign_keys(p, inclusion, content.limit(0))) == {(1, 2), (1, 3)}


def test_range_join_is_complete(spark):
    """The grid join finds every pair of domains that a double loop finds."""
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(-10**5, 10**5)), int(2 ** rng.uniform(0, 16)) * int(rng.integers(0, 2)), 0.0, 1.0, "N") for i in range(120)]
    p = spark.createDataFrame(rows, "nid long, median long, iqr long, min_value double, max_value double, data_type string")
    got = {(r.nid, r.ref_nid) for r in relate._numeric_pairs(p).where("overlap > 0").collect()}
    want = set()
    for a, m, q, *_ in rows:
        for b, n, w, *_ in rows:
            l, r, fl, fr = m - q, m + q, n - w, n + w
            if a != b and fr > fl:
                o = (r - l) if l >= fl and r <= fr else (fr - l) if fl <= l <= fr else (r - fl) if fl <= r <= fr else 0
                want |= {(a, b)} if o > 0 else set()
    assert got == want


def test_value_sets_against_brute_force(spark):
    rng = np.random.default_rng(5)
    sets = {i: set(rng.choice(30, rng.integers(1, 12), replace=False).tolist()) for i in range(40)}
    v = spark.createDataFrame([(i, str(x)) for i, s in sets.items() for x in s] + [(99, None)], "nid long, value string")
    got = {(r.src, r.dst) for r in relate.value_set_similarity(v, 0.5).collect()}
    assert got == {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5}


def test_minhash_estimates_jaccard(spark):
    v = spark.createDataFrame([(1, f"a{i}") for i in range(300)] + [(2, f"a{i}") for i in range(60, 360)], "nid long, value string")
    s = profile.minhash(v, k=256)
    assert s.count() == 2 and all(len(r.minhash) == 256 for r in s.collect())
    r = relate.minhash_content_similarity(s, 0.4, 2).first()
    assert r.score == pytest.approx(240 / 360, abs=0.1)


def test_search(spark):
    columns = spark.createDataFrame([(1, "t", "owner_address"), (2, "t", "AdressLine"), (3, "u", "price"), (4, "u", None)], "nid long, source_name string, field_name string")
    assert nids(search.fuzzy_match(columns, "address")) == [1]
    assert [r.field_name for r in search.suggest_schema(columns, "own").collect()] == ["owner_address"]
    near = search.fuzzy_terms(spark.createDataFrame([("address",), ("no",)], "term string"), spark.createDataFrame([("adress",), ("adres",), ("on",), ("no",)], "term string"))
    assert {(r.left_term, r.right_term) for r in near.collect()} == {("address", "adress"), ("address", "adres"), ("no", "no")}
    index = search.postings(spark.createDataFrame([(1, "The red dog's house"), (2, "red red wine"), (3, None), (4, "")], "nid long, text string"))
    assert [r.nid for r in search.bm25(index, ["red"], 5).collect()] == [2, 1]
    assert spark.range(1).select(text.stem_terms(F.array(F.lit("studies"), F.lit("glass"), F.lit("loading")))).first()[0] == ["study", "glass", "load"]
    assert spark.range(1).select(text.name_tokens(F.lit("orderStatusCode.csv"))).first()[0] == ["order", "status", "code"]


def test_graph(spark):
    e = graph.undirected(spark.createDataFrame([(1, 2, 5, 0.5), (2, 1, 5, 0.7), (2, 3, 5, 0.1), (3, 4, 5, 0.1), (1, 4, 5, 0.1), (4, 4, 5, 1.0), (None, 4, 5, 1.0)], "source_node_id long, target_node_id long, relation_type int, weight double"))
    one, four = (spark.createDataFrame([(n,)], "nid long") for n in (1, 4))
    assert {(r.nid, r.hops) for r in graph.traverse(one, e, 5, 3).collect()} == {(2, 1), (4, 1), (3, 2)}
    assert sorted(r.path for r in graph.paths(one, four, e, 5, 3).collect()) == [[1, 2, 3, 4], [1, 4]]
    assert [r.path for r in graph.paths(one, four, e, 5, 3, shortest_only=True).collect()] == [[1, 4]]
    assert graph.traverse(one.limit(0), e, 5, 3).count() == 0
    c = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "nid long, source_name string")
    found = graph.table_paths(["a"], ["c"], e, c, 5, 2).collect()
    assert sorted((r.hops, r.tables) for r in found) == [(1, ["a", "c"]), (2, ["a", "b", "c"])]


def test_views(spark):
    a = spark.createDataFrame([(1, "X "), (2, "y"), (3, None), (4, "nan")], "id int, k string")
    b = spark.createDataFrame([(9, "x"), (8, "Y"), (7, "nan")], "id int, k string")
    assert sorted((r.id, r.id_x) for r in views.equi_join(a, b, "k", "k").collect()) == [(1, 9), (2, 8)]
    v = views.materialise({"a": a, "b": b}, [Join("a", "k", "b", "k")], views.filters_of(["k"], ["x"]))
    assert [(r["a.id"], r["b.id"]) for r in v.collect()] == [(1, 9)]
    assert views.is_materialisable({"a": a, "b": b}, [Join("a", "k", "b", "k")], views.filters_of(["k"], ["z"])) is False
    groups = list(views.candidate_groups([("t1", [0, 1]), ("t2", [2]), ("t3", [2])], 3))
    assert groups[0] == (("t1", "t2"), (0, 1, 2))
    assert views.exhaustive_groups([("t1", [0, 1]), ("t2", [2])])[0] == (("t1", "t2"), (0, 1, 2))


def test_comparison_of_views(spark):
    make = lambda *rows: spark.createDataFrame(rows, "k string, v string")
    v = {"a": make(("1", "a"), ("2", "b"), ("3", "c")), "b": make(("3", "c"), ("1", "a"), ("2", "b")), "c": make(("1", "a"), ("2", "b")), "d": make(("2", "b"), ("3", "c"), ("4", "d")), "e": make(("1", "a"), ("2", "X"), ("3", "c"))}
    got = {(r.a, r.b): r.relation for r in fourc.pair_relations(v, "k").collect()}
    assert [got["a", x] for x in "bcde"] == ["compatible", "contained", "complementary", "contradictory"]
    assert fourc.contradictions(v["a"], v["e"], "k").first().key == "2"
    assert fourc.equivalent(v["a"], v["b"]) and fourc.contained(v["c"], v["a"]) and not fourc.contained(v["a"], v["c"]) and fourc.complementary(v["a"], v["d"], "k")
    assert fourc.fingerprint(fourc.curate(v["a"])) == fourc.fingerprint(fourc.curate(v["b"])) != fourc.fingerprint(fourc.curate(v["e"]))
    assert "b" not in fourc.prune(fourc.classify(v))


def test_hashes_and_filters(spark):
    rng = np.random.default_rng(7)
    v = spark.createDataFrame([(i, rng.standard_normal(16).tolist()) for i in range(200)] + [(900, None), (901, [1.0])], "id long, v array<double>")
    h = ann.binary_projections("h", 10, 16, 1)
    b = ann.buckets(v, [h], "id", "v")
    rows = b.collect()
    assert len(rows) == 200 and all(len(r.bucket_key) == 10 and set(r.bucket_key) <= {"0", "1"} for r in rows)
    assert {(r.id, r.bucket_key) for r in rows} == {(r.id, r.bucket_key) for r in ann.buckets(v, [h], "id", "v").collect()}
    self_ = ann.search(b.where("id = 5"), b, 1).first()
    assert (self_.id, self_.distance) == (5, 0.0)
    one = ann.buckets(v, [ann.unit_bucket("u", 16)], "id", "v")
    exact = ann.exact_nearest(v.where("id < 20"), v.where("id < 900"), 5)
    rp = ann.recall_precision(ann.search(one.where("id < 20"), one, 5, include_self=False), exact).first()
    assert (rp.recall, rp.precision) == (1.0, 1.0)
    keys = {r.id: r.bucket_key for r in rows}
    near = {(r["query"], r.id) for r in ann.hamming_within(b.where("id < 10"), b, 10, 2).collect()}
    assert near == {(q, i) for q in range(10) for i in keys if sum(x != y for x, y in zip(keys[q], keys[i])) <= 2}
    assert ann.tree_candidates(b.where("id = 3"), b, 20).count() >= 20
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate((.4, .9, 1.4, 2.1, .1, 8.7, 3.4, 2.8), 1)], "query long, id long, distance double")
    assert sorted(r.id for r in ann.threshold_filter(d, 1.0).collect()) == [1, 2, 5]
    assert [r.id for r in ann.nearest_filter(d, 5).orderBy("rank").collect()] == [5, 1, 2, 3, 4]


def test_drift(spark):
    old = spark.createDataFrame([(1, str(i)) for i in range(100)], "nid long, value string")
    new = drift.perturb(old, 0.3)
    j = drift.column_jaccard(old, new)
    assert drift.changed_columns(j).count() == 1 and drift.changed_columns(drift.column_jaccard(old, old)).count() == 0


def test_annotations(spark):
    a, c = annotations.empty(spark)
    a = annotations.annotate(a, "m1", "ann", "Totals may be off", "warning", 1, 2, "IS_SUPERCLASS_OF", ("money",))
    assert annotations.search_text(a, "totals").count() == 1 and annotations.search_text(a, "MONEY").count() == 1 and annotations.search_text(a, "tot").count() == 0
    c = annotations.add_comment(c, a, "c1", "m1", "bob", "agreed")
    assert annotations.with_comments(a, c).first().comments[0].text == "agreed"
    assert [t.tag for t in annotations.add_tags(a, "m1", "bob", ["x"]).first().tags] == ["x", "money"]
    assert [(r.origin, r.nid) for r in annotations.related(spark.createDataFrame([(1,)], "nid long"), a, "IS_SUPERCLASS_OF").collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        annotations.add_comment(c, a, "c2", "none", "bob", "x")


def test_vocabulary(spark):
    columns = spark.createDataFrame([("d", "prices.csv", "unitPrice", 1), ("d", "t", "owner", 2)], "db_name string, source_name string, field_name string, nid long")
    v = spark.createDataFrame([("k", "unit price", "money"), ("k", "money", None), ("k", "owner", "agent")], "kr string, name string, parent string")
    m = onto.syntactic(onto.attribute_elements(columns), onto.class_elements(v), "L5")
    assert {(r.field_name, r.name) for r in m.collect()} == {("unitPrice", "unit price"), ("owner", "owner")}
    e = spark.createDataFrame([("unit", [1.0, 0.0]), ("price", [0.0, 1.0]), ("money", [0.0, 1.0]), ("owner", [1.0, 0.0]), ("agent", [-1.0, 0.0])], "token string, vector array<double>")
    s = {(r.field_name, r.name): r.signal for r in onto.semantic(onto.attribute_elements(columns), onto.class_elements(v), e).collect()}
    assert s["unitPrice", "money"] == 1 and s["owner", "money"] == -1
    lines = onto.write_lines(m)
    assert {(r.field_name, r.name, r.kind) for r in onto.read_lines(lines).collect()} == {("unitPrice", "unit price", "L5"), ("owner", "owner", "L5")}
    assert {(r.name, r.ancestor) for r in onto.ancestors(v).collect()} == {("unit price", "money"), ("owner", "agent")}


def test_latest_rows(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "b"), (1, None, "c"), (None, 9, "d")], "k long, t long, v string")
    assert [tuple(r) for r in latest_rows(df, ["k"], "t", ["v"]).collect()] == [(1, 7, "b")]
    assert latest_rows(df.limit(0), ["k"], "t").count() == 0


def test_context_and_coarse_matching(spark):
    columns = spark.createDataFrame([("d", "prices", "unitPrice"), ("d", "prices", "amount")], "db_name string, source_name string, field_name string")
    v = spark.createDataFrame([("k", "amount", "money"), ("k", "price", "money"), ("k", "money", None)], "kr string, name string, parent string")
    tables, classes = onto.contexts(columns, v)
    assert ("money", "L3") in {(r.name, r.kind) for r in onto.syntactic(tables, classes, "L3", 0.2).collect()}
    e = spark.createDataFrame([("price", [0.0, 1.0]), ("amount", [0.1, 1.0]), ("money", [0.0, 1.0])], "token string, vector array<double>")
    assert onto.coarse_hooks(tables, classes, e).where("name = 'money'").count() == 1


def test_latent_names(spark):
    names = spark.createDataFrame([(1, ["unit", "price"]), (2, ["price", "unit"]), (3, ["owner"]), (4, ["zone"])], "nid long, tokens array<string>")
    got = {(r.src, r.dst) for r in relate.hashed_similarity(relate.reduced_vectors(names, 3, 64)).collect()}
    assert {(1, 2), (2, 1)} <= got and (1, 3) not in got


def test_ranking_of_join_graphs():
    a, b = [Join("t", "x", "u", "y")], [Join("t", "x", "u", "z")]
    assert [g for _, g in views.rank_join_graphs([a, b], {("u", "z"): 0.9, ("t", "x"): 0.1})] == [b, a]


def test_nearest_ranks_of_wide_numbers(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.integers(0, 2**62, 300), rng.integers(0, 3000, 300), 2 ** np.arange(62), 2 ** np.arange(1, 62) - 1])
    steps = spark.createDataFrame([(1, int(x), 1) for x in np.unique(v)] + [(2, 5, 1000)], "nid long, v long, n long")
    qs, u = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0), np.unique(v)
    got = {(r.nid, r.q): r.v for r in profile.nearest_ranks(steps, qs).collect()}
    assert got == {(1, q): int(u[int(np.ceil(q * len(u))) - 1]) for q in qs} | {(2, q): 5 for q in qs}


def test_table_paths_lead_through_other_targets(spark):
    c = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "nid long, source_name string")
    e = graph.undirected(spark.createDataFrame([(1, 2, 5, 1.0), (3, 4, 5, 1.0)], "source_node_id long, target_node_id long, relation_type int, weight double"))
    got = graph.table_paths(["a"], ["b", "c"], e, c, 5, 2).collect()
    assert sorted((r.target, r.hops, tuple(r.tables)) for r in got) == [("b", 1, ("a", "b")), ("c", 2, ("a", "b", "c"))]
