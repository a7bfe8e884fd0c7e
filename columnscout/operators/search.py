"""Keyword search over names and content of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from columnscout.functions.numbers import is_blank, is_numerical
from columnscout.functions.text import analyse, fuzzy_edits, stem_terms

#: The parameters of BM25.
K1, B = 1.2, 0.75


def postings(texts: DataFrame, id_col: str = "nid", text_col: str = "text", stem: bool = False) -> DataFrame:
    """(id, term, tf): the inverted index; several texts of an id are one document. Null texts have no terms."""
    terms = analyse(F.col(text_col))
    if stem:
        terms = stem_terms(terms)
    return texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf")).withColumnRenamed("id", id_col)


def query_terms(spark, query: str) -> list[str]:
    """The analysed terms of a query, each once."""
    return list(dict.fromkeys(spark.range(1).select(analyse(F.lit(query)).alias("t")).first()["t"]))


def bm25(index: DataFrame, terms: list[str], k: int | None = 10, id_col: str = "nid") -> DataFrame:
    """(id, score): BM25 of documents with any of the terms; the k best (ties by id), or all with k None.

    Only postings of the terms are joined with the lengths; lengths are one row a document.
    """
    length = index.groupBy(id_col).agg(F.sum("tf").alias("len"))
    stats = length.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    hit = index.where(F.col("term").isin(terms))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    scored = hit.join(F.broadcast(df), "term").join(length, id_col).crossJoin(F.broadcast(stats))  # as many rows as query terms; one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    out = scored.groupBy(id_col).agg(F.round(F.sum(weight), 9).alias("score"))
    return out if k is None else out.orderBy(F.col("score").desc(), id_col).limit(k)


def exact_search(columns: DataFrame, keyword: str, where: str = "field_name") -> DataFrame:
    """Columns whose name (or source_name) equals the keyword. compat: exact table search works."""
    return columns.where(F.col(where) == keyword)


def name_search(columns: DataFrame, query_terms_: list[str], where: str = "field_name") -> DataFrame:
    """Columns whose analysed name has any of the terms."""
    return columns.where(F.arrays_overlap(analyse(F.col(where)), F.array(*(F.lit(t) for t in query_terms_))))


def content_search(values: DataFrame, query_terms_: list[str], id_col: str = "nid", value_col: str = "value") -> DataFrame:
    """(id, n): columns that have values with any of the terms, and how many."""
    hit = F.arrays_overlap(analyse(F.col(value_col)), F.array(*(F.lit(t) for t in query_terms_)))
    return values.where(F.col(value_col).isNotNull() & hit).groupBy(id_col).agg(F.count("*").alias("n"))


def fuzzy_match(columns: DataFrame, keyword: str, where: str = "field_name", k: int | None = 15) -> DataFrame:
    """(columns..., edits): columns a term of whose name is within the edits that the keyword's length allows; the k nearest (ties by name)."""
    most = 0 if len(keyword) <= 2 else 1 if len(keyword) <= 5 else 2
    terms = columns.withColumn("term", F.explode(analyse(F.col(where))))
    near = terms.withColumn("edits", F.levenshtein("term", F.lit(keyword.lower()))).where(F.col("edits") <= most)
    out = near.groupBy(*columns.columns).agg(F.min("edits").alias("edits"))
    return out if k is None else out.orderBy("edits", where, "nid").limit(k)


def fuzzy_terms(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_term, right_term, edits): terms of two lists within the edits that the left one's length allows, by deletion keys of up to two letters.

    Two terms within two edits share a term that both give by up to two deletions, so no pair is lost and no cross join is needed.
    """
    def keys(df: DataFrame, name: str) -> DataFrame:
        t = df.select(F.lower("term").alias(name)).distinct().where(F.length(name) > 0)
        cut = "transform(sequence(1, length({0})), i -> concat(left({0}, i - 1), substring({0}, i + 1)))"
        t = t.withColumn("once", F.expr(cut.format(name)))
        t = t.withColumn("twice", F.flatten(F.transform("once", lambda x: F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.left(x, i - 1), F.substring(x, i + 1, F.length(x))))).otherwise(F.array().cast("array<string>")))))
        return t.select(name, F.explode(F.array_distinct(F.concat(F.array(name), "once", "twice"))).alias("key"))

    pairs = keys(left, "left_term").join(keys(right, "right_term"), "key").select("left_term", "right_term").distinct()
    return pairs.withColumn("edits", F.levenshtein("left_term", "right_term")).where(F.col("edits") <= fuzzy_edits(F.col("left_term")))


def suggest_schema(columns: DataFrame, prefix: str, k: int = 5) -> DataFrame:
    """(field_name, source_name, edits): names that start with the prefix, or whose start is within two edits of it; the k nearest (ties by name), each name once."""
    p = prefix.lower()
    edits = F.levenshtein(F.lower(F.substring("field_name", 1, len(p))), F.lit(p))
    near = columns.where(F.col("field_name").isNotNull()).withColumn("edits", edits).where(F.col("edits") <= min(2, max(0, len(p) - 1)))
    once = near.groupBy("field_name").agg(F.min("source_name").alias("source_name"), F.min("edits").alias("edits"))
    return once.orderBy("edits", "field_name").limit(k)


def path_of(columns: DataFrame, nid: int) -> DataFrame:
    return columns.where(F.col("nid") == nid).select("path")


def text_signatures(index: DataFrame, id_col: str = "nid") -> DataFrame:
    """(id, term, tf): terms of more than three letters that occur more than three times in a column and have no digit."""
    tf = index.groupBy(id_col, "term").agg(F.sum("tf").alias("tf"))
    return tf.where((F.length("term") > 3) & (F.col("tf") > 3) & ~F.col("term").rlike("[0-9]"))


def minhash_signatures(profile: DataFrame) -> DataFrame:
    """(nid, minhash) of text columns that have a sketch."""
    return profile.where("data_type = 'T' and size(minhash) > 1").select("nid", "minhash")


def numeric_signatures(profile: DataFrame) -> DataFrame:
    """(nid, median, iqr, min_value, max_value) of numeric columns."""
    return profile.where("data_type = 'N'").select("nid", "median", "iqr", "min_value", "max_value")


def peek_values(values: DataFrame, k: int = 15, id_col: str = "nid", value_col: str = "value") -> DataFrame:
    """(id, values): the k first distinct values of each column that are neither blank nor numbers, in order."""
    v = values.where(~is_blank(F.col(value_col)) & ~is_numerical(F.col(value_col))).select(id_col, value_col).distinct()
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy(value_col))
    return v.withColumn("nth", nth).where(F.col("nth") <= k).groupBy(id_col).agg(F.array_sort(F.collect_list(value_col)).alias("values"))


def for_client(hits: DataFrame, columns: DataFrame, values: DataFrame, k: int = 15) -> DataFrame:
    """(source_name, field_name, selected, values): all columns of the hits' tables, whether a hit names them, and k sample values of text columns."""
    c = columns.join(hits.select("source_name").distinct(), "source_name", "left_semi").join(hits.select("nid").distinct().withColumn("selected", F.lit("Y")), "nid", "left")
    return c.join(peek_values(values, k), "nid", "left").select("source_name", "field_name", F.coalesce("selected", F.lit("N")).alias("selected"), "values")
