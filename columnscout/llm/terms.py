"""Problem 5: how distinctive a term is per record.

Terms are counted per record, and the record and term margins are pre-aggregated. Two
scores come from the same counts:

* `residual`: the correspondence-analysis residual, observed minus expected count over
  the square root of the expectation, divided by the square root of
  (1 - row share)(1 - column share), which gives it unit variance under independence;
* `rarity`: (1 + ln c) * ln(N / d) of c occurrences in the record, d records with the term, N records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Maximal runs of ASCII letters and digits that hold a letter (of lower-cased text).
TERM = "[0-9]*[a-z][a-z0-9]*"


def terms_of(text: Column) -> Column:
    """The terms of a text in order, with repeats; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def term_scores(terms: DataFrame, records: DataFrame, id_col: str = "id", term_col: str = "term") -> DataFrame:
    """(id, term, c, d, rarity, residual) for each term of each record.

    `terms` has one row for each occurrence; `records` one row for each record that
    counts, with or without terms; repeated and null ids of it count once and not at all. Rows with a null id
    or term are no occurrences, and an empty input gives an empty result. A
    term in a large share of all records only widens the join's side with one row a
    term; occurrences are added up before they are shuffled.
    """
    occurrences = terms.where(F.col(id_col).isNotNull() & F.col(term_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(term_col).alias("term"))
    counts = occurrences.groupBy("id", "term").agg(F.count("*").alias("c"))
    columns = counts.groupBy("term").agg(F.count("*").alias("d"), F.sum("c").alias("column_total"))
    rows = counts.groupBy("id").agg(F.sum("c").alias("row_total"))
    n = records.agg(F.count_distinct(id_col).alias("n_records"))
    total = counts.agg(F.sum("c").alias("total"))
    joined = counts.join(columns, "term").join(rows, "id").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(total))  # one row each
    expected = F.col("row_total") * F.col("column_total") / F.col("total")
    spread = (1 - F.col("row_total") / F.col("total")) * (1 - F.col("column_total") / F.col("total"))
    residual = F.when(spread > 0, (F.col("c") - expected) / F.sqrt(expected * spread)).otherwise(F.lit(0.0))
    rarity = (1 + F.log(F.col("c").cast("double"))) * F.log(F.col("n_records").cast("double") / F.col("d"))
    return joined.select("id", "term", "c", "d", rarity.alias("rarity"), residual.alias("residual"))


def best_terms(scores: DataFrame, score: str, k: int = 3, least_records: int = 2, places: int = 9) -> DataFrame:
    """(id, term, score, rank): the k terms of each record with the highest score, rounded; ties by term, ascending."""
    ranked = scores.where(F.col("d") >= least_records).select("id", "term", F.round(score, places).alias("score"))
    order = Window.partitionBy("id").orderBy(F.col("score").desc(), F.col("term"))
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
