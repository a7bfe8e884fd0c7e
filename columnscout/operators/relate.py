"""Relations between columns: similar names, similar content, inclusion, and likely keys."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from columnscout.functions.text import name_tokens
from columnscout.functions.vectors import unit

#: Numbers of the relation types.
RELATIONS = {"SCHEMA": 0, "SCHEMA_SIM": 1, "CONTENT_SIM": 2, "ENTITY_SIM": 3, "PKFK": 5, "INCLUSION_DEPENDENCY": 6, "MEANS_SAME": 10, "MEANS_DIFF": 11,
             "SUBCLASS": 12, "SUPERCLASS": 13, "MEMBER": 14, "CONTAINER": 15}
#: Fixed value: relation types from this number on come from annotations.
METADATA_FROM = 10
#: Vectors in a block: at least, where there are more blocks than one, and at most, about. Cells of a matrix product that are in memory at once.
FEW, MOST, STEP = 512, 16_384, 2**20


def both_directions(pairs: DataFrame) -> DataFrame:
    """(src, dst, score) pairs once in each direction, the greater score of repeats."""
    turned = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score")
    return pairs.select("src", "dst", "score").union(turned).groupBy("src", "dst").agg(F.max("score").alias("score"))


def _domains(profile: DataFrame) -> DataFrame:
    numeric = profile.where("data_type = 'N' and median is not null and iqr is not null")
    return numeric.select("nid", (F.col("median") - F.col("iqr")).alias("left"), (F.col("median") + F.col("iqr")).alias("right"), "min_value", "max_value")


def domain_overlap(ref_left, ref_right, left, right):
    """Share of the candidate's domain inside the reference: 1 inside, a part from either side, and 0 if the candidate encloses the reference.

    compat: asymmetric by design; the reverse pair is looked at as well.
    """
    inside = (left >= ref_left) & (right <= ref_right)
    from_left = (left >= ref_left) & (left <= ref_right)
    from_right = (right >= ref_left) & (right <= ref_right)
    share = (F.when(inside, (right - left) / (ref_right - ref_left).cast("double"))
             .when(from_left, (ref_right - left) / (ref_right - ref_left).cast("double"))
             .when(from_right, (right - ref_left) / (ref_right - ref_left).cast("double")).otherwise(0.0))
    return share


def _numeric_pairs(profile: DataFrame) -> DataFrame:
    """Candidate and reference domains that meet, with their overlap.

    A range join: every domain is put in the cells of a grid with a step for each order of
    magnitude of its width, so that two domains that meet share a cell of the wider
    one's step; no cross join of the columns.
    """
    d = _domains(profile)
    step = F.when(F.col("right") > F.col("left"), F.ceil(F.log2((F.col("right") - F.col("left")).cast("double"))).cast("int")).otherwise(0)
    d = d.withColumn("level", F.greatest(step, F.lit(0)))
    ref = d.where("right > left").select(*(F.col(c).alias(f"ref_{c}") for c in ("nid", "left", "right", "min_value", "max_value", "level")))
    floor = lambda c, level: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col(level))).cast("long")
    levels = d.select("level").union(ref.select(F.col("ref_level"))).distinct().agg(F.array_sort(F.collect_set("level")).alias("levels"))  # at most 64 levels
    # at its own level a domain covers at most three cells, and at a wider one at most two
    own = ref.withColumn("cell", F.explode(F.sequence(floor("ref_left", "ref_level"), floor("ref_right", "ref_level")))).withColumn("at", F.col("ref_level"))
    wider = d.crossJoin(F.broadcast(levels)).withColumn("at", F.explode(F.filter("levels", lambda x: x >= F.col("level")))).drop("levels")
    wider = wider.withColumn("cell", F.explode(F.sequence(floor("left", "at"), floor("right", "at"))))
    narrow_candidate = own.join(wider, ["at", "cell"])
    up = ref.crossJoin(F.broadcast(levels)).withColumn("at", F.explode(F.filter("levels", lambda x: x > F.col("ref_level")))).drop("levels")
    up = up.withColumn("cell", F.explode(F.sequence(floor("ref_left", "at"), floor("ref_right", "at"))))
    mine = d.withColumn("at", F.col("level")).withColumn("cell", F.explode(F.sequence(floor("left", "level"), floor("right", "level"))))
    wide_candidate = up.join(mine, ["at", "cell"])
    kept = ["ref_nid", "ref_left", "ref_right", "ref_min_value", "ref_max_value", "nid", "left", "right", "min_value", "max_value"]
    pairs = narrow_candidate.select(kept).union(wide_candidate.select(kept)).where("nid <> ref_nid").dropDuplicates(["nid", "ref_nid"])
    overlap = domain_overlap(F.col("ref_left"), F.col("ref_right"), F.col("left"), F.col("right"))
    return pairs.withColumn("overlap", overlap)


def inclusion_dependencies(profile: DataFrame, least: float = 0.3) -> DataFrame:
    """(src, dst, score 1): candidate src whose range lies in that of dst, not negative, with at least `least` of overlap of the domains. Directed."""
    p = _numeric_pairs(profile)
    inside = (F.col("min_value") >= F.col("ref_min_value")) & (F.col("max_value") <= F.col("ref_max_value")) & (F.col("min_value") >= 0)
    finite = (F.abs("max_value") < float("inf")) & (F.abs("ref_max_value") < float("inf"))
    return p.where(inside & finite & (F.col("overlap") >= least)).select(F.col("nid").alias("src"), F.col("ref_nid").alias("dst"), F.lit(1.0).alias("score"))


def numeric_content_similarity(profile: DataFrame, least: float = 0.85) -> DataFrame:
    """(src, dst, score): candidate src and reference dst whose domains overlap by at least `least`; score is the overlap. Directed."""
    return _numeric_pairs(profile).where(F.col("overlap") >= least).select(F.col("nid").alias("src"), F.col("ref_nid").alias("dst"), F.col("overlap").alias("score"))


def gap_clusters(points: DataFrame, id_col: str, value_col: str, eps: float, least: int = 2) -> DataFrame:
    """(id, cluster): one-dimensional DBSCAN; points no more than eps apart are chained, and chains of fewer than `least` points are noise.

    Exact for `least` of 1 or 2. The sort is over one row a column, not over cells.
    """
    order = Window.orderBy(value_col, id_col)
    start = F.when(F.col(value_col) - F.lag(value_col).over(order) <= eps, 0).otherwise(1)
    chained = points.withColumn("__start", start).withColumn("cluster", F.sum("__start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count("*").over(Window.partitionBy("cluster"))
    return chained.withColumn("__size", size).where(F.col("__size") >= least).select(F.col(id_col), "cluster")


def single_point_clusters(profile: DataFrame, eps: float = 0.1, score: float = 0.85) -> DataFrame:
    """(src, dst, score): pairs of columns with a domain of zero width whose half right ends are chained within eps. src < dst."""
    points = _domains(profile).where("left = right").select("nid", (F.col("right") / 2).alias("x"))
    c = gap_clusters(points, "nid", "x", eps)
    other = c.select(F.col("nid").alias("dst"), "cluster")
    return c.select(F.col("nid").alias("src"), "cluster").join(other, "cluster").where("src < dst").select("src", "dst", F.lit(score).alias("score"))


def numeric_signature_similarity(profile: DataFrame, eps: float = 0.3) -> DataFrame:
    """(src, dst, score 1), src < dst: columns whose (median, iqr, min, max) are within eps of each other (Euclidean); a grid join in four dimensions."""
    s = profile.where("data_type = 'N'").select("nid", F.array(*(F.col(c).cast("double") for c in ("median", "iqr", "min_value", "max_value"))).alias("v"))
    s = s.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    cell = lambda i: F.floor(F.col("v")[i] / eps).cast("long")
    grid = s.select("nid", "v", *(cell(i).alias(f"c{i}") for i in range(4)))
    near = s.select(F.col("nid").alias("o"), F.col("v").alias("w"), *(cell(i).alias(f"c{i}") for i in range(4)))
    for i in range(4):
        near = near.withColumn(f"c{i}", F.explode(F.array(*(F.col(f"c{i}") + k for k in (-1, 0, 1)))))
    d2 = F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    return grid.join(near, [f"c{i}" for i in range(4)]).where((F.col("nid") < F.col("o")) & (d2 <= eps * eps)).select(F.col("nid").alias("src"), F.col("o").alias("dst"), F.lit(1.0).alias("score"))


def tfidf(names: DataFrame, id_col: str = "nid", tokens_col: str = "tokens") -> DataFrame:
    """(id, token, weight): (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), scaled to unit length for each id."""
    tf = names.select(F.col(id_col).alias("id"), F.explode(tokens_col).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))
    return _weights(tf, names.agg(F.count("*").alias("docs")), id_col)


def _weights(tf: DataFrame, n: DataFrame, id_col: str) -> DataFrame:
    """`tfidf` of counted tokens (id, token, tf), of n documents."""
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    raw = tf.join(df, "token").crossJoin(F.broadcast(n)).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))  # one row
    length = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, "id").select(F.col("id").alias(id_col), "token", (F.col("w") / F.col("length")).alias("weight"))


def token_similarity(weights: DataFrame, least: float, k: int | None = None, id_col: str = "nid") -> DataFrame:
    """(src, dst, score): cosine of sparse unit vectors of at least `least`, and with k the k most similar of each src (ties by dst).

    Exact. Only the part of a vector whose length may reach `least` leads to candidates: the lightest-df-first order
    puts the common tokens last, and those whose remaining length is below the limit are passed over.
    """
    df = weights.groupBy("token").agg(F.count("*").alias("df"))
    w = weights.select(F.col(id_col).alias("id"), "token", "weight").join(df, "token")
    rest = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("id").orderBy("df", "token").rowsBetween(0, Window.unboundedFollowing)))
    prefix = w.withColumn("rest", rest).where(F.col("rest") >= least - 1e-9)
    lead = prefix.select(F.col("id").alias("src"), "token").join(prefix.select(F.col("id").alias("dst"), "token"), "token").where("src < dst").select("src", "dst").distinct()
    vectors = w.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("v"))
    a, b = vectors.select(F.col("id").alias("src"), F.col("v").alias("va")), vectors.select(F.col("id").alias("dst"), F.col("v").alias("vb"))
    common = F.array_sort(F.array_intersect(F.map_keys("va"), F.map_keys("vb")))
    score = F.aggregate(common, F.lit(0.0), lambda s, t: s + F.element_at("va", t) * F.element_at("vb", t))
    pairs = lead.join(a, "src").join(b, "dst").select("src", "dst", F.round(score, 9).alias("score")).where(F.col("score") >= least)
    both = pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"))
    if k is None:
        return both
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.col("score").desc(), "dst"))
    return both.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def schema_similarity(columns: DataFrame, least: float = 0.8, k: int | None = 10) -> DataFrame:
    """(src, dst, score): columns with similar names, by cosine of TF-IDF over name tokens; score is a similarity.

    compat: exact, where a random projection of 30 bits found little but equal token bags; score is 1 - distance.
    """
    tokens = columns.select("nid", name_tokens(F.col("field_name")).alias("tokens"))
    return token_similarity(tfidf(tokens), least, k)


def text_similarity(signatures: DataFrame, least: float = 0.7, k: int | None = None) -> DataFrame:
    """(src, dst, score): columns with similar content, by cosine of TF-IDF over their terms (nid, term, tf); exact."""
    tf = signatures.select(F.col("nid").alias("id"), F.col("term").alias("token"), "tf")
    return token_similarity(_weights(tf, tf.agg(F.count_distinct("id").alias("docs")), "nid"), least, k)


def reduced_vectors(names: DataFrame, dimensions: int = 16, buckets: int = 256, id_col: str = "nid", tokens_col: str = "tokens") -> DataFrame:
    """(id, v): latent vectors of token bags: hashed TF-IDF on its principal components, for `ann` hashes. The matrix that is decomposed has `buckets` columns, however many tokens there are."""
    from pyspark.ml.feature import IDF, PCA, HashingTF
    from pyspark.ml.functions import vector_to_array

    tf = HashingTF(numFeatures=buckets, inputCol=tokens_col, outputCol="__tf").transform(names.select(id_col, tokens_col))
    weighted = IDF(inputCol="__tf", outputCol="__w").fit(tf).transform(tf)
    return PCA(k=dimensions, inputCol="__w", outputCol="__p").fit(weighted).transform(weighted).select(F.col(id_col).alias("id"), vector_to_array("__p").alias("v"))


def hashed_similarity(vectors: DataFrame, least: float = 0.8) -> DataFrame:
    """(src, dst, score): approximate twin of `schema_similarity` over vectors (id, v) of one length and distinct ids: all pairs of vectors whose cosine, to nine places, is at least `least`, in both directions.

    The vectors approximate the names; their pairs are complete: blocks of vectors meet in matrix products, each two blocks once, so that
    vectors are shuffled once a block and pairs not at all. Zero vectors, which have no direction, are left out.
    """
    some = vectors.where(F.exists("v", lambda x: x != 0)).select("id", unit("v").alias("v"))
    id_type, count, cores = vectors.schema["id"].dataType.simpleString(), some.count(), vectors.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-count // MOST), min(count // FEW, math.isqrt(8 * cores)))  # then there are about four pairs of blocks for each core
    own, other = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = some.withColumn("own", own).withColumn("other", other).select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "v")

    def similar(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (k.as_py() for k in key)
        t = pa.Table.from_batches(list(batches))
        ids, at = t["id"].to_numpy(), t["own"].to_numpy()
        v = t["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        right, right_v = ids[at == b], v[at == b]
        left, left_v = ids[at == a], v[at == a]
        step = max(1, STEP // max(1, len(right)))
        for i in range(0, len(left), step):
            score = np.round(left_v[i : i + step] @ right_v.T, 9)
            x, y = np.nonzero(score >= least)
            src, dst, found = left[i : i + step][x], right[y], score[x, y]
            keep = src != dst
            for s, d in ((src[keep], dst[keep]), (dst[keep], src[keep]))[: 1 + (a != b)]:
                yield pa.RecordBatch.from_arrays([pa.array(s, t["id"].type), pa.array(d, t["id"].type), pa.array(found[keep])], ["src", "dst", "score"])

    return sent.repartition(n * (n + 1) // 2, "a", "b").groupBy("a", "b").applyInArrow(similar, f"src {id_type}, dst {id_type}, score double")


def entity_similarity(entities: DataFrame, least: float = 0.8) -> DataFrame:
    """(src, dst, score): columns with similar entity sets, by the same cosine."""
    return token_similarity(tfidf(entities.groupBy("nid").agg(F.collect_list("entity").alias("tokens"))), least)


def minhash_bands(sketches: DataFrame, rows: int = 8, id_col: str = "nid") -> DataFrame:
    """(id, band, key): one key for each band of `rows` slots."""
    k = F.size("minhash")
    bands = F.transform(F.sequence(F.lit(0), (k / rows).cast("int") - 1), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.slice("minhash", i * rows + 1, rows)).alias("key")))
    return sketches.where(k >= rows).select(F.col(id_col), F.inline(bands))


def minhash_content_similarity(sketches: DataFrame, least: float = 0.7, rows: int = 8, id_col: str = "nid", exact: bool = True) -> DataFrame:
    """(src, dst, score), src < dst: columns whose sketches agree in a band, with the share of equal slots of at least `least` as the score.

    compat: `exact=False` gives every candidate score 1, unverified.
    """
    bands = minhash_bands(sketches, rows, id_col)
    pairs = bands.select(F.col(id_col).alias("src"), "band", "key").join(bands.select(F.col(id_col).alias("dst"), "band", "key"), ["band", "key"]).where("src < dst").select("src", "dst").distinct()
    if not exact:
        return pairs.withColumn("score", F.lit(1.0))
    a, b = sketches.select(F.col(id_col).alias("src"), F.col("minhash").alias("ma")), sketches.select(F.col(id_col).alias("dst"), F.col("minhash").alias("mb"))
    same = F.size(F.filter(F.zip_with("ma", "mb", lambda x, y: x == y), lambda x: x))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", (same / F.size("ma")).alias("score")).where(F.col("score") >= least)


def value_set_similarity(values: DataFrame, least: float = 0.7, id_col: str = "nid", value_col: str = "value") -> DataFrame:
    """(src, dst, score), src < dst: exact Jaccard similarity of value sets, the exact twin of the sketches; by prefixes in order of frequency."""
    v = values.where(F.col(value_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(value_col).alias("value")).distinct()
    df = v.groupBy("value").agg(F.count("*").alias("df"))
    size = v.groupBy("id").agg(F.count("*").alias("size"))
    ranked = v.join(df, "value").join(size, "id").withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("df", "value")))
    prefix = ranked.where(F.col("at") <= F.col("size") - F.ceil(F.lit(least) * F.col("size") - 1e-9) + 1)
    a = prefix.select(F.col("id").alias("src"), F.col("size").alias("n"), "value")
    b = prefix.select(F.col("id").alias("dst"), F.col("size").alias("m"), "value")
    lead = a.join(b, "value").where("src < dst").where((F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9)).select("src", "dst").distinct()
    x = v.select(F.col("id").alias("src"), "value")
    shared = lead.join(x, "src").join(v.select(F.col("id").alias("dst"), "value"), ["dst", "value"]).groupBy("src", "dst").agg(F.count("*").alias("o"))
    sizes = lambda c: size.select(F.col("id").alias(c), F.col("size").alias(f"size_{c}"))
    score = F.col("o") / (F.col("size_src") + F.col("size_dst") - F.col("o"))
    return shared.join(sizes("src"), "src").join(sizes("dst"), "dst").select("src", "dst", score.alias("score")).where(F.col("score") >= least - 1e-9)


def primary_foreign_keys(profile: DataFrame, inclusion: DataFrame, content: DataFrame, least: float = 0.7) -> DataFrame:
    """(src, dst, score), src < dst: likely keys. Numeric columns through inclusion, text columns through content similarity; the more unique end must exceed `least`, and its uniqueness is the score."""
    u = profile.select("nid", "data_type", F.coalesce("uniqueness", F.lit(0.0)).alias("uniqueness"))
    end = lambda c: u.select(F.col("nid").alias(c), F.col("data_type").alias(f"type_{c}"), F.col("uniqueness").alias(f"u_{c}"))
    linked = inclusion.select("src", "dst", F.lit("N").alias("by")).union(content.select("src", "dst", F.lit("T").alias("by")))
    linked = linked.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "by").distinct()
    found = linked.join(end("src"), "src").join(end("dst"), "dst")
    # an edge counts when it is of the kind that the key column's type looks at
    key = lambda c: (F.col(f"u_{c}") > least) & (F.col(f"type_{c}") == F.col("by"))
    return found.where(key("src") | key("dst")).select("src", "dst", F.greatest("u_src", "u_dst").alias("score")).distinct()


def edges_of(relations: dict[str, DataFrame]) -> DataFrame:
    """(src, dst, relation, score): one edge table of several relations, both directions."""
    out = None
    for name, pairs in relations.items():
        part = both_directions(pairs).select("src", "dst", F.lit(RELATIONS[name]).alias("relation"), "score")
        out = part if out is None else out.unionByName(part)
    return out
