"""The queries of this package's operators over the tables of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columnscout.functions.latest import latest_rows
from columnscout.llm import byte_bpe, components, mixing, neighbours, overlaps, prose, set_pairs, terms
from columnscout.plans.lineage import Stages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_modeldb(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The row with the greatest updated_at of each nid, with the named columns."""
    rows = _table(spark, sf_dir, "modeldb").select("nid", "updated_at", "received_at", *columns)
    return latest_rows(rows, ["nid"], "updated_at", ["received_at", *columns]).select("nid", *columns)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = set_pairs.similar_pairs(current_modeldb(spark, sf_dir, "t_data"), "nid", "t_data", threshold=0.7, min_size=5)
    return pairs.select(F.col("id_a").alias("nid_a"), F.col("id_b").alias("nid_b"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as one row a record: its class of equal sets, and how many other records are similar."""
    rows = set_pairs.class_members(current_modeldb(spark, sf_dir, "t_data"), "nid", "t_data", threshold=0.7, min_size=5)
    return rows.select(F.col("id").alias("nid"), "class_id", "members", "links")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = components.links_of(_table(spark, sf_dir, "edges"), _table(spark, sf_dir, "nodes"), types=(2, 10))
    return components.connected_groups(links)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_corpus(_table(spark, sf_dir, "documents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = overlaps.load(_table(spark, sf_dir, "idents"), Stages(spark, "overlaps"))
    return overlaps.overlapping_pairs(state, 0.4).select("nid_a", "nid_b")


def p4_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps after a second batch: identifiers seen up to the middle day are loaded, then later ones join, and those last seen in the first tenth of the days leave."""
    rows = _table(spark, sf_dir, "idents").where("nid is not null and ident is not null")
    days = rows.agg(F.min(F.unix_date(F.to_date("seen_at"))).alias("lo"), F.max(F.unix_date(F.to_date("seen_at"))).alias("hi")).first()
    lo, hi = days["lo"] or 0, days["hi"] or 0
    rows = rows.select("nid", "ident", F.coalesce(F.unix_date(F.to_date("seen_at")), F.lit(lo)).alias("day"))
    middle, gone = lo + (hi - lo) // 2, lo + (hi - lo) // 10
    state = overlaps.load(rows.where(F.col("day") <= middle), Stages(spark, "overlaps"))
    joins = rows.where(F.col("day") > middle).select("nid", "ident", F.lit(1).alias("sign"))
    leaves = rows.groupBy("nid", "ident").agg(F.max("day").alias("last")).where(F.col("last") < gone).select("nid", "ident", F.lit(-1).alias("sign"))
    return overlaps.overlapping_pairs(overlaps.apply_changes(state, joins.union(leaves)), 0.4)


def _term_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the terms of each current modeldb record's values and of its column name in profile."""
    records = current_modeldb(spark, sf_dir, "t_data").where(F.exists("t_data", lambda v: v.isNotNull() & (F.trim(v) != "")))
    names = _table(spark, sf_dir, "profile").where("id is not null and columnName is not null").groupBy(F.col("id").alias("nid")).agg(F.max("columnName").alias("name"))
    texts = records.join(names, "nid", "left").select("nid", F.array_append("t_data", F.col("name")).alias("texts"))
    texts = Stages(spark, "terms").write(texts.select(F.col("nid").alias("id"), F.flatten(F.transform("texts", terms.terms_of)).alias("terms")), "terms")
    return terms.term_scores(texts.select("id", F.explode("terms").alias("term")), texts)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = terms.best_terms(_term_scores(spark, sf_dir), "rarity", k=3, least_records=2, places=9)
    return best.select(F.col("id").alias("nid"), "term")


def p5_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = terms.best_terms(_term_scores(spark, sf_dir), "residual", k=3, least_records=2, places=6)
    return best.select(F.col("id").alias("nid"), "term", F.col("score").alias("residual"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = current_modeldb(spark, sf_dir, "signature")
    near = neighbours.nearest_vectors(vectors, "nid", "signature", 64, neighbours.Params(k=5, min_similarity=0.8))
    return near.select(F.least("id", "neighbour").alias("nid_a"), F.greatest("id", "neighbour").alias("nid_b")).distinct()


def _mixture(spark: SparkSession, sf_dir: str, tempered: str | None = None):
    """Drawn texts, quotas and targets; by mix_targets, or tempered to the `entropy` of its shares, or as flat as its `repeats` allow for as many tokens as there are. A missing share is 0, a missing max_repeats 1."""
    rows = _table(spark, sf_dir, "mix_targets").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("most")).where("source <> ''").orderBy("source").collect()
    targets, repeats = {r["source"]: r["share"] for r in rows}, {r["source"]: r["most"] for r in rows}
    stages = Stages(spark, "mixing")
    sized = stages.write(mixing.sized_texts(_table(spark, sf_dir, "documents"), list(targets)), "sized")
    supply = {r["source"]: (r["tokens"], r["texts"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts")).collect()}
    weights = targets
    budget = None
    if tempered:
        tokens = {s: supply.get(s, (0, 0))[0] for s in targets}
        total = sum(tokens.values())
        budget = total if tempered == "repeats" else None
        held = [repeats[s] for s, t in tokens.items() if t > 0 and repeats[s] > 0]
        exponent = mixing.exponent_for_repeats(tokens, total, min(held, default=1)) if tempered == "repeats" else mixing.exponent_for_entropy(tokens, mixing.entropy(targets))
        weights = mixing.tempered(tokens, exponent)
    parts = mixing.quotas(weights, supply, repeats, budget)
    return mixing.draw(sized, parts), parts, weights


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn, _, _ = _mixture(spark, sf_dir)
    return drawn.select("source", F.col("id").alias("doc_id"), "n_tokens", "copies")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mixture(spark, sf_dir))


def p8_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mixture(spark, sf_dir, "entropy"))


def p8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of the flattest tempered mixture, of as many tokens as there are, in which no source is used more often than the strictest limit."""
    return mixing.shares(*_mixture(spark, sf_dir, "repeats"))


def _structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return prose.structure(documents, prose.fit_profiles(documents, _table(spark, sf_dir, "doclabels"), lang_col="lang"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure(spark, sf_dir).where("running_share < 0.5").select("doc_id")


def p9_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure(spark, sf_dir)


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.statistics(_table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p3_found": p3_found, "p4_found": p4_found, "p4_changes": p4_changes, "p5_found": p5_found, "p5_residuals": p5_residuals,
           "p6_found": p6_found, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_temperature": p8_temperature, "p8_repeats": p8_repeats,
           "p9_found": p9_found, "p9_structure": p9_structure, "p9_statistics": p9_statistics}
