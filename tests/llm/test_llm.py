"""Operators of the training-data package: edges, brute force, and exact round trips."""

import base64
import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from columnscout.llm import byte_bpe, components, mixing, neighbours, overlaps, prose, set_pairs, shapes, terms
from columnscout.llm.queries import QUERIES
from columnscout.llm.sql import SQL
from columnscout.plans.lineage import Stages
from tests.oracle import check

needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{byte_bpe.TOKENIZERS}/{byte_bpe.VOCABULARY}"), reason="no vocabulary file")


@pytest.mark.parametrize("name", sorted(set(SQL) - {"p6_found"}))
def test_same_as_sql(spark, small, name):
    check(spark, small, QUERIES[name], SQL[name])


# --- 1: set pairs ---
def brute_pairs(sets, t, least):
    return {(i, j) for i, j in itertools.combinations(sorted(sets), 2) if min(len(sets[i]), len(sets[j])) >= least and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9}


@pytest.mark.parametrize("t, least, seed", [(0.7, 5, 1), (0.5, 1, 2), (0.85, 2, 3), (1.0, 1, 4)])
def test_set_pairs_lose_nothing(spark, t, least, seed):
    """Near copies of all sizes, over few tokens (so all are frequent) and over many."""
    rng = random.Random(seed)
    sets, n = {}, 0
    for universe in (12, 60, 4000):
        for _ in range(60):
            size = min(universe, int(math.exp(rng.uniform(0, 5.5))))
            base = set(rng.sample(range(universe), size))
            for _ in range(3):
                s = {x for x in base if rng.random() > rng.choice([0, 0.05, 0.15, 0.3])} | {rng.randrange(universe) for _ in range(int(size * rng.choice([0, 0.05, 0.2])))}
                n += 1
                sets[n] = {f"t{universe}-{x}" for x in s}
    df = spark.createDataFrame([(i, sorted(s), "x", 0) for i, s in sets.items()], "nid long, t_data array<string>, tokens string, n int")
    got = {(r.id_a, r.id_b): (r.shared, r.similarity) for r in set_pairs.similar_pairs(df, "nid", "t_data", t, least).collect()}
    assert set(got) == brute_pairs(sets, t, least)
    assert all(a == len(sets[i] & sets[j]) and s == pytest.approx(a / len(sets[i] | sets[j])) for (i, j), (a, s) in got.items())


def test_small_and_lumped_sets_lose_nothing(spark):
    """Sets of 5 to 16 values over few tokens: whole deletion signatures, and sets whose tokens fall into too few segments."""
    rng = random.Random(8)
    sets, n = {}, 0
    for _ in range(250):
        base = rng.sample(range(40), rng.randrange(5, 15))
        for _ in range(3):
            n += 1
            s = set(base) - set(rng.sample(base, rng.randrange(0, 3))) | {rng.randrange(40) for _ in range(rng.randrange(0, 3))}
            sets[n] = {f"v{x}" for x in s}
    lengths = set_pairs.Lengths(0.7, 5, 20)
    lengths.segments[:] = 2  # so that many sets need the way out
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "nid long, t_data array<string>")
    want = brute_pairs(sets, 0.7, 5)
    assert {(r.id_a, r.id_b) for r in set_pairs.similar_pairs(df, "nid", "t_data").collect()} == want
    keyed = spark.createDataFrame([(i, [hash((1, x)) for x in sorted(s)]) for i, s in sets.items() if len(s) >= 5], "rep long, hashes array<long>")
    found = {tuple(sorted((r.s_id, r.id))) for r in set_pairs.candidates(keyed, lengths, spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0)))).collect()}
    assert found >= want


def test_candidates_of_unrelated_sets_grow_with_their_number(spark):
    """Of sets that have nothing in common no two meet: no signature is shared by chance or by being empty."""
    lengths, none = set_pairs.Lengths(0.7, 5, 20), spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0)))
    for n in (10_000, 40_000):
        size = F.pmod(F.xxhash64("id"), F.lit(16)).cast("int") + 5
        sets = spark.range(n).select(F.col("id").alias("rep"), F.transform(F.sequence(F.lit(1), size), lambda k: F.xxhash64("id", k)).alias("hashes"))
        rows = sets.mapInArrow(lambda it: (set_pairs._published(lengths, none.value, b) for b in it if b.num_rows), "key long, id long, n int, sketch long")
        assert rows.groupBy("key").agg(F.count_distinct("id").alias("c")).agg(F.max("c")).first()[0] == 1
        assert set_pairs.candidates(sets, lengths, none).count() == 0


def test_class_members(spark):
    five, six = ["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e", "f"]
    rows = [(4, five), (2, five[::-1]), (7, six), (9, ["x1", "x2", "x3", "x4", "x5"]), (8, ["a"]), (None, five), (2, five)]
    df = spark.createDataFrame(rows, "nid long, t_data array<string>")
    assert sorted((r.id, r.class_id, r.members, r.links) for r in set_pairs.class_members(df, "nid", "t_data").collect()) == [(2, 2, 2, 2), (4, 2, 2, 2), (7, 7, 1, 2), (9, 9, 1, 0)]
    assert set_pairs.class_members(df.limit(0), "nid", "t_data").count() == 0


def test_set_pairs_edges(spark):
    five = ["A ", "b", "c", "d", "e"]
    rows = [(1, five), (2, ["a", "B", " c", "d", "e", None, "", "  ", "b"]), (3, None), (4, []), (5, ["a"]), (None, five), (6, [None, ""]), (2, ["a", "B", " c", "d", "e", None, "", "  ", "b"]), (7, [f"x{i}" for i in range(20_000)]), (8, [f"x{i}" for i in range(19_000)])]
    df = spark.createDataFrame(rows, "nid long, t_data array<string>")
    assert sorted((r.id_a, r.id_b, r.shared) for r in set_pairs.similar_pairs(df, "nid", "t_data").collect()) == [(1, 2, 5), (7, 8, 19_000)]
    assert set_pairs.similar_pairs(df.limit(0), "nid", "t_data").count() == 0
    assert sorted((r.id_a, r.id_b) for r in set_pairs.similar_pairs(df.where("nid = 1"), "nid", "t_data", other=df).collect()) == [(1, 1), (1, 2)]


def test_set_pairs_of_many_copies(spark):
    """A third of all records hold one set: one class, all of its pairs."""
    df = spark.range(90).select(F.col("id").alias("nid"), F.when(F.col("id") < 30, F.array(*(F.lit(f"c{k}") for k in range(6)))).otherwise(F.array(*(F.concat(F.lit(f"u{k}-"), F.col("id").cast("string")) for k in range(6)))).alias("t_data"))
    assert set_pairs.similar_pairs(df, "nid", "t_data").count() == 30 * 29 // 2


# --- 3: components ---
def groups(spark, links):
    """By rounds alone, by one task alone, and by both in turn, which must agree."""
    df = spark.createDataFrame(links, "u long, v long")
    rounds, one, both = (sorted(map(tuple, components.connected_groups(df, last_links=n).collect())) for n in (0, 20_000, 60))
    assert rounds == one == both
    return rounds


def test_groups_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 300)]
    star = [(1000, i) for i in range(1001, 1400)]
    got = groups(spark, chain + star + [(5, 4), (4, 5), (5, 4), (7, 7), (8, None)] + [(-3, 2), (2, -1)])
    assert got == sorted([(i, 100) for i in range(100, 301)] + [(i, 1000) for i in range(1000, 1400)] + [(4, 4), (5, 4), (-3, -3), (-1, -3), (2, -3)])


def test_groups_against_union_find(spark):
    rng = random.Random(9)
    links = [(rng.randrange(600), rng.randrange(600)) for _ in range(380)]
    parent = list(range(600))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    seen = {x for a, b in links if a != b for x in (a, b)}
    assert groups(spark, links) == sorted((x, find(x)) for x in seen)


def test_groups_edges(spark):
    assert groups(spark, []) == []
    e = spark.createDataFrame([(1, 2, 2, "q"), (2, 3, 5, "q"), (3, None, 2, "q"), (3, 4, None, "q"), (4, 4, 2, "q"), (4, 9, 10, "q"), (2, 1, 10, "q")], "source_node_id long, target_node_id long, relation_type int, u string")
    n = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 0), (None, 0)], "node_id long, v int")
    assert sorted(map(tuple, components.links_of(e, n, (2, 10)).collect())) == [(1, 2)]


# --- 4: overlaps ---
def brute_overlaps(sets, share):
    return {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= max(1, share * min(len(sets[a]), len(sets[b])) - 1e-9)}


def random_sets(seed, hot):
    rng = random.Random(seed)
    out = {}
    for i in range(40):
        own = {rng.randrange(80) for _ in range(rng.randrange(1, 25))}
        out[i] = own | {1000 + k for k in range(hot) if rng.random() < 0.8}
    return out


def as_rows(spark, sets):
    return spark.createDataFrame([(a, x, "z") for a, s in sets.items() for x in s] * 2 + [(None, 5, "z"), (5, None, "z")], "nid long, ident long, shared string")


@pytest.mark.parametrize("hot_degree", [1, 5, 20, 1000])
@pytest.mark.parametrize("hot", [0, 4, 12])
def test_overlaps_are_exact(spark, hot, hot_degree):
    sets = random_sets(hot + 1, hot)
    state = overlaps.load(as_rows(spark, sets), Stages(spark, "test"), hot_degree)
    assert {(r.nid_a, r.nid_b): r.shared for r in overlaps.overlapping_pairs(state, 0.4).collect()} == brute_overlaps(sets, 0.4)


@pytest.mark.parametrize("most_parts", [2, 8])
def test_overlaps_follow_changes(spark, monkeypatch, most_parts):
    """Batches of joins and leaves, which also move identifiers over the limit, give what loading anew gives."""
    monkeypatch.setattr(overlaps, "MOST_PARTS", most_parts)
    rng, sets, stages = random.Random(4), random_sets(2, 5), Stages(spark, "test")
    state = overlaps.load(as_rows(spark, sets), stages, 12)
    for step in range(3 if most_parts > 2 else 4):
        changes = [(rng.randrange(42), rng.choice([rng.randrange(80), 1000 + rng.randrange(5)]), rng.choice([1, -1, -1])) for _ in range(120)]
        state = overlaps.apply_changes(state, spark.createDataFrame(changes + [(1, None, 1)], "nid long, ident long, sign int"))
        net = {}
        for a, x, s in changes:
            net[a, x] = net.get((a, x), 0) + s
        for (a, x), s in net.items():
            if s > 0:
                sets.setdefault(a, set()).add(x)
            elif s < 0:
                sets.get(a, set()).discard(x)
        assert {(r.nid_a, r.nid_b): r.shared for r in overlaps.overlapping_pairs(state, 0.4).collect()} == brute_overlaps({a: s for a, s in sets.items() if s}, 0.4)
        anew = overlaps.load(as_rows(spark, sets), stages, 12)
        assert sorted(map(tuple, state.counts().select("nid_a", "nid_b", "shared").collect())) == sorted(map(tuple, anew.counts().select("nid_a", "nid_b", "shared").collect()))
        assert sorted(map(tuple, state.memberships().collect())) == sorted(map(tuple, anew.memberships().collect()))
    assert len(state.joined) <= most_parts


def test_overlaps_of_nothing(spark):
    state = overlaps.load(as_rows(spark, {}).limit(0), Stages(spark, "test"))
    assert overlaps.overlapping_pairs(state, 0.4).count() == 0


# --- 5: terms ---
def test_terms_of_a_text(spark):
    got = spark.createDataFrame([("ab-12 C3po 007 x_Y 9a9 é",), (None,), ("",), ("1" * 5000 + "a",)], "t string").select(terms.terms_of(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == [["ab", "c3po", "x", "y", "9a9"], [], [], ["1" * 5000 + "a"]]


def test_scores(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "c"), (3, "b"), (None, "a"), (3, None)]
    t = spark.createDataFrame(rows, "id long, term string")
    s = {(r.id, r.term): r for r in terms.term_scores(t, spark.createDataFrame([(1,), (2,), (3,), (4,), (4,), (None,)], "id long")).collect()}
    assert s[1, "a"].rarity == pytest.approx((1 + math.log(2)) * math.log(4 / 2))
    e = 3 * 3 / 6
    assert s[1, "a"].residual == pytest.approx((2 - e) / math.sqrt(e * (1 - 3 / 6) * (1 - 3 / 6)))
    scores = terms.term_scores(t, spark.createDataFrame([(1,), (2,), (3,)], "id long"))
    assert [(r.id, r.term, r["rank"]) for r in terms.best_terms(scores, "rarity", k=1).orderBy("id").collect()] == [(1, "a", 1), (2, "a", 1), (3, "b", 1)]
    assert terms.best_terms(terms.term_scores(t.limit(0), t.limit(0)), "residual").count() == 0


# --- 6: neighbours ---
def test_recall_and_copies(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 16))
    v = (centres[rng.integers(0, 60, 3000)] + 0.3 * rng.standard_normal((3000, 16))) * rng.lognormal(0, 4, (3000, 1))
    v[:700] = v[0]  # a group of copies
    df = spark.createDataFrame([(i, x.tolist(), "y") for i, x in enumerate(v.astype(np.float32))], "nid long, signature array<float>, v string")
    p = neighbours.Params(codes=64, parts=8, region=200, block=256, turn=500)
    got = neighbours.nearest_vectors(df, "nid", "signature", 16, p).toPandas()
    want = neighbours.brute_force(np.arange(3000), v.astype(np.float32).astype(float), 5)
    assert len(got) == 15_000 and got.groupby("id").size().eq(5).all()
    hit = got.merge(want[want.id >= 700], on=["id", "neighbour"])
    assert len(hit) / (5 * 2300) >= 0.9 and np.allclose(hit.similarity_x, hit.similarity_y, atol=1e-9)
    assert set(got[got.id == 3].neighbour) == {0, 1, 2, 4, 5}  # of equal copies the smallest ids


def test_neighbours_among_near_and_scaled_copies(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((3000, 16))
    v[::3] = v[0] / np.linalg.norm(v[0]) + rng.standard_normal((1000, 16)) * 0.001
    v[::6] = v[3] * rng.uniform(0.1, 9, (500, 1))
    v[600:1200:6] = v[600] * 2.0 ** rng.integers(-3, 4, (100, 1))
    v = v.astype(np.float32)
    df = spark.createDataFrame(list(enumerate(v.tolist())), "nid long, signature array<float>")
    got = neighbours.nearest_vectors(df, "nid", "signature", 16).toPandas()
    want = neighbours.brute_force(np.arange(3000), v.astype(float), 5)
    hit = got.merge(want, on=["id", "neighbour"])
    assert len(got) == len(want)
    assert len(hit[hit.id % 3 == 0]) / (5 * 1000) >= 0.98
    assert len(hit[hit.id % 6 == 0]) / (5 * 500) >= 0.98
    assert len(hit) / len(want) >= 0.9


@pytest.mark.parametrize("n, shape", [(2000, "isotropic"), (8000, "isotropic"), (2000, "clustered"), (8000, "clustered")])
def test_recall_by_shape(spark, n, shape):
    rng = np.random.default_rng(n)
    v = rng.standard_normal((n, 64))
    if shape == "clustered":
        v = rng.standard_normal((n // 40, 64))[rng.integers(0, n // 40, n)] + 0.5 * v
    v = v.astype(np.float32)
    df = spark.createDataFrame(list(enumerate(v.tolist())), "nid long, signature array<float>")
    got = neighbours.nearest_vectors(df, "nid", "signature", 64).toPandas()
    want = neighbours.brute_force(np.arange(n), v.astype(float), 5)
    assert len(got) == 5 * n and len(got.merge(want, on=["id", "neighbour"])) / len(want) >= 0.95


def test_exact_mode(spark):
    v = np.random.default_rng(1).standard_normal((1500, 16)).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(v.tolist())), "nid long, signature array<float>")
    got = neighbours.nearest_vectors(df, "nid", "signature", 16, neighbours.Params(recall=1, k=3, region=100)).toPandas()
    assert len(got.merge(neighbours.brute_force(np.arange(1500), v.astype(float), 3), on=["id", "neighbour", "rank"])) == 4500


def test_scores_are_products_with_the_decoded_entries():
    rng = np.random.default_rng(2)
    x = neighbours._unit(rng.standard_normal((3000, 16)))
    q = neighbours.Quantiser.fit(x.astype(np.float32), len(x), neighbours.Params(parts=4, codes=32))
    near, codes, err = q.encode(x)
    made = q.centroids[near] + q.scales[near][:, None] * np.concatenate([b[codes[:, i]] for i, b in enumerate(q.books)], axis=1)
    assert np.allclose(q.scores(x[:50].astype(np.float32), near, codes), x[:50] @ made.T, atol=1e-5)
    assert np.allclose(err, np.linalg.norm(x - made, axis=1), atol=1e-5) and err.mean() < np.linalg.norm(x - q.centroids[near], axis=1).mean()


def test_unusable_vectors(spark):
    ok, nan = [1.0, 2.0], float("nan")
    df = spark.createDataFrame([(1, ok), (2, [2.0, 4.0]), (3, None), (4, [1.0]), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (None, ok), (9, [1e-30, 2e-30]), (1, ok)], "nid long, signature array<float>")
    got = neighbours.nearest_vectors(df, "nid", "signature", 2, neighbours.Params(parts=2)).collect()
    assert sorted((r.id, r.neighbour) for r in got) == [(1, 2), (1, 9), (2, 1), (2, 9), (9, 1), (9, 2)]
    assert neighbours.nearest_vectors(df.limit(0), "nid", "signature", 2).count() == 0


# --- 7: encoding ---
@needs_vocabulary
def test_encoding_equals_public_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{byte_bpe.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    public = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["plain words, don't", "  \n\n\t x  ", "x<|endoftext|>y", "é" * 700, "漢字" * 400, "🧪👩‍🔬", "a" * 5000, "ab" * 3001, "=" * 999, "​\xa0", " " * 3000, "".join(rng.choice("!@#$%^&*()_+=-{}|") for _ in range(6000))]
    texts += ["".join(rng.choice("abcdefgh ijé\n1.") for _ in range(rng.randrange(300))) for _ in range(200)] + ["".join(rng.choice("abcdefgh") for _ in range(30_000))]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in byte_bpe.encode_corpus(df).collect()}
    assert got[len(texts)] == [] and got[len(texts) + 1] == []
    for i, t in enumerate(texts):
        assert got[i] == public.encode_ordinary(t), t[:40]
        assert public.decode(got[i]) == t
    counts = {r.doc_id: r.n_tokens for r in byte_bpe.encode_corpus(df, counts_only=True, keep=("ids",)).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert byte_bpe.encode_corpus(df.limit(0)).count() == 0


# --- 8: mixing ---
def test_quotas():
    q = {x.source: x for x in mixing.quotas({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": (1000, 10), "b": (100, 5)}, {"a": 1, "b": 4, "c": 9})}
    size = min(1000 / 0.625, 400 / 0.375)
    assert (q["b"].passes, q["b"].rest) == (4, 0) and q["a"].passes == 0 and q["a"].rest == round(0.625 * size) and q["c"].passes == q["c"].rest == 0
    assert mixing.quotas({}, {}, {}) == []


def test_temperature():
    tokens = {"a": 10_000, "b": 100, "c": 1, "d": 0}
    assert mixing.tempered(tokens, 0.0)["c"] == pytest.approx(1 / 3) and mixing.tempered(tokens, 1.0)["a"] == pytest.approx(10_000 / 10_101)
    e = mixing.exponent_for_entropy(tokens, 0.5)
    assert mixing.entropy(mixing.tempered(tokens, e)) == pytest.approx(0.5, abs=1e-6)
    a = mixing.exponent_for_repeats(tokens, 5000, 4)
    assert max(w * 5000 / tokens[s] for s, w in mixing.tempered(tokens, a).items() if tokens[s]) <= 4 + 1e-6 and 0 < a < 1


@needs_vocabulary
def test_drawing_reaches_the_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TEXTS", 16)
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["red", "blue", "green", "seven"]) + str(rng.randrange(9)) for _ in range(rng.randrange(5, 60)))
    rows = [(i, text(), rng.choice(["Big", " big ", "BIG"])) for i in range(600)] + [(1000 + i, text(), "small") for i in range(40)]
    rows += [(2000 + i, rows[i][1], "big") for i in range(50)] + [(3000, None, "big"), (3001, "", "big"), (3002, "x", None), (3003, "x", "other"), (None, "x", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixing.sized_texts(df, ["big", "small", "none"]).cache()
    assert sized.where("source = 'big'").count() <= 600 and sized.where("id >= 2000").count() == 0
    supply = {r.source: (r.t, r.n) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    targets = {"big": 0.7, "small": 0.2, "none": 0.1}
    parts = mixing.quotas(targets, supply, {"big": 1, "small": 3, "none": 2})
    drawn = mixing.draw(sized, parts)
    r = {x.source: x for x in mixing.shares(drawn, parts, targets).collect()}
    longest = sized.agg(F.max("n_tokens")).first()[0]
    for s, share in (("big", 0.7 / 0.9), ("small", 0.2 / 0.9)):
        total = sum(x.drawn_tokens for x in r.values())
        assert abs(r[s].drawn_tokens - share * total) <= 2 * longest
    assert r["small"].most_copies <= 3 and r["big"].most_copies == 1 and r["none"].drawn_tokens == 0
    assert drawn.groupBy("id").count().where("count > 1").count() == 0
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, mixing.draw(sized.repartition(7), parts).collect()))
    assert mixing.draw(sized.limit(0), []).count() == 0


@needs_vocabulary
def test_mix_of_the_tables(spark, small):
    flat = QUERIES["p8_repeats"](spark, small).collect()
    assert sum(x.actual_share for x in flat) == pytest.approx(1) and all(x.drawn_tokens <= x.available_tokens * max(1, x.most_copies) for x in flat)
    r = {x.source: x for x in QUERIES["p8_shares"](spark, small).collect()}
    assert sum(x.actual_share for x in r.values()) == pytest.approx(1) and all(x.most_copies >= 0 for x in r.values())


# --- 9: prose ---
def kinds_of(text):
    name = {v: k for known in (shapes.IDS, shapes.WORD_IDS) for k, v in known.items()}
    s = shapes.shapes([text])
    return [[name[k] for k in s.kind[s.unit == u]] for u in range(len(s.text))]


def test_shapes():
    assert kinds_of("The owner's table_name was 12.5, by 2024-01-02. Next \"one!\" C3PO") == [
        ["the", "lower", "identifier", "was", "large number", ",", "by", "date", "."], ["capitalised", '"', "one" if "one" in shapes.WORD_IDS else "lower", "!", '"'], ["identifier"]]
    assert kinds_of("a\r\n  b\n\nc\td  e") == [["a", "new line"], ["spaces", "lower", "new line"], ["new line"], ["lower", "tab", "lower", "spaces", "e" if "e" in shapes.WORD_IDS else "lower"]]
    assert kinds_of("漢字の。été Über 12abc a.b ½") == [["han", "han", "lower, not ascii", "。"], ["été", "über" if "über" in shapes.WORD_IDS else "capitalised", "number", "lower", "dotted", "number"]]
    assert kinds_of("x y\nX y \nq\nx y\n")[3] == ["again", "again", "again"] and kinds_of("") == [] and kinds_of(" ") == [[]]


def test_shapes_of_a_batch_are_those_of_each_text():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab Zé漢1.,\n\t -_'\"!?。🧪") for _ in range(rng.randrange(60))) for _ in range(300)]
    whole, at = shapes.shapes(texts), 0
    for i, t in enumerate(texts):
        one = shapes.shapes([t])
        mine = whole.text[whole.unit] == i
        assert whole.kind[mine].tolist() == one.kind.tolist() and whole.codes()[mine].tolist() == one.codes().tolist()
        assert whole.length[whole.text == i].tolist() == one.length.tolist() and one.length.sum() == len(t)


def test_divergences_follow_the_definition():
    """Against the sum over all successors of na p ln(p / m) + b q ln(q / m), context by context."""
    counts = {"prose": {5: 3, shapes.SIZE + 7: 9, 8: 1}, "prose xx": {5: 1, 6: 2}, "junk": {5: 8, shapes.SIZE * 2 + 1: 4}}
    p = prose.Profiles(counts)
    code, weight = np.array([5, 5, 6, shapes.SIZE + 7, 8]), np.array([4, 2, 4, 1, 4])
    got = p.divergences(np.zeros(5, np.int64), code, weight, 1)[:, 0]
    for i in range(3):
        q, b, want = p.q[i].reshape(shapes.SIZE, shapes.SIZE).astype(float), prose.PROFILE_WEIGHT, 0.0
        c = np.zeros((shapes.SIZE, shapes.SIZE))
        np.add.at(c, (code // shapes.SIZE, code % shapes.SIZE), weight / 4)
        for context in np.flatnonzero(c.sum(axis=1)):
            na = c[context].sum()
            s, t = c[context] / na, q[context]
            m = (na * s + b * t) / (na + b)
            want += (na * s[s > 0] * np.log(s[s > 0] / m[s > 0])).sum() + (b * t * np.log(t / m)).sum()
        assert got[i] == pytest.approx(want / c.sum(), rel=1e-4)
    assert p.names == ["prose", "prose xx", "junk"]


PROSE = ["The totals of the second table were not the same as those in the first, and nobody could say why it had been so.",
         "We asked the people at the office to send it again, but they have not done so yet. It should come after the weekend.",
         "Wir haben gesehen, dass die Werte in der Tabelle nicht mehr zu den alten passen, und das war auch im Bericht so.",
         "Before the new export was in use, each of the lists had to be checked by hand, which took most of the morning."]
LIST = ["- zone\n- price\n- owner\n- label\n- batch\n- term\n- crew\n- site", "red\nblue\ngreen\nyellow\norange\nblack\nwhite\ngrey", "* fig;\n* plum;\n* apple;\n* pear;\n* cherry;"]
TABLE = ["a|b|c\n12|3.5|\n14|2.5|x\n16|9.5|y\n11|8.5|z", "| a | b |\n| --- | --- |\n| 12 | 44 |\n| 13 | 45 |\n| 14 | 46 |"]
JUNK = ["ec e2 a0 5c 9c 6d 09 c4 71 da da fa 14 25 64 be\nd2 a7 ff 24 b2 71 bb 68 2f 22 e9 73 e2 51 a7 6a", "&*^%$ #@!) (*&^ %$#@ !)(* &^%$ #@!) (*&^"]


@pytest.fixture(scope="module")
def profiles(spark):
    texts = [(k, t) for k, ts in (("prose", PROSE), ("list", LIST), ("table", TABLE), ("junk", JUNK)) for t in ts]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(texts)] + [(0, "junk"), (0, "prose"), (1, None), (None, "junk"), (2, "other")], "doc_id long, kind string")
    return prose.fit_profiles(docs, labels)


def test_structure(spark, profiles):
    new = ["The owner of the first list could not say why it was not in the report.", "- crew\n- price\n- site\n- owner\n- colour\n- shade", "x|y\n17|4.5\n18|3.5\n19|2.5",
           "It was not so. " * 40, PROSE[1] + "\n\n" + "\n".join(f"- item{i}" for i in range(80)), None, "", " \n\t ", "\r\n".join([PROSE[0]] * 1 + [PROSE[1]])]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(new)], "doc_id long, text string, kind string")
    got = {r.doc_id: r.running_share for r in prose.structure(df, profiles).collect()}
    assert got[0] == 1 and got[1] == 0 and got[2] == 0 and got[3] < 0.1 and got[4] < 0.5 and got[5] is got[6] is got[7] is None and got[8] > 0.9
    assert prose.structure(df.limit(0), profiles).count() == 0


def test_structure_without_labels(spark):
    df = spark.createDataFrame([(1, "Some text.")], "doc_id long, text string")
    p = prose.fit_profiles(df, spark.createDataFrame([], "doc_id long, kind string"))
    assert prose.structure(df, p).first().running_share is None


def test_long_text(spark, profiles):
    df = spark.createDataFrame([(1, " ".join(PROSE[:2]) * 1 + " and so on" * 200_000)], "doc_id long, text string")
    assert 0 <= prose.structure(df, profiles).first().running_share <= 1


def test_held_out_accuracy(spark, small):
    """Profiles of half of the labelled documents, on the other half; labels themselves have errors."""
    folder = small.replace("sf0.001", "sf0.1")
    if not os.path.isdir(folder):
        pytest.skip("no larger tables")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/doclabels.parquet")
    train = prose.fit_profiles(docs, labels.where("doc_id % 2 = 0"))
    test = labels.where("doc_id % 2 = 1 and kind is not null").join(prose.structure(docs.where("doc_id % 2 = 1"), train), "doc_id").where("running_share is not null")
    assert test.agg(F.avg(((F.col("running_share") >= 0.5) == (labels["kind"] == "prose")).cast("double"))).first()[0] >= 0.9


def test_statistics(spark):
    df = spark.createDataFrame([(1, "One two.\nthree #\n\n"), (2, None), (3, "")], "doc_id long, text string")
    r = {x.doc_id: x for x in prose.statistics(df).collect()}
    assert (r[1].n_words, r[1].mean_word_length, r[1].n_lines, r[1].ended_lines) == (4, 3.25, 2, 0.5)
    assert r[2].n_words == r[3].n_words == 0 and r[2].mean_word_length is None and r[3].ended_lines is None
