"""Annotations of columns: warnings, insights, questions, their comments and tags.

compat: the metadata relations work; writes return a new DataFrame, to be stored by the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = ("md_id string, author string, text string, md_class string, source long, target struct<id:long,type:string>, "
          "tags array<struct<author:string,creation_date:timestamp,tag:string>>, creation_date timestamp, updated_date timestamp")
COMMENTS = "id string, md_id string, author string, text string, creation_date timestamp"
CLASSES = ("warning", "insight", "question")
#: The stored type of each relation between columns, and which end the annotated column is.
RELATIONS = {"MEANS_SAME_AS": ("same", True), "MEANS_DIFF_FROM": ("different", True), "IS_SUBCLASS_OF": ("subclass", True), "IS_SUPERCLASS_OF": ("subclass", False),
             "IS_MEMBER_OF": ("member", True), "IS_CONTAINER_OF": ("member", False)}


def annotate(annotations: DataFrame, md_id: str, author: str, text: str, md_class: str, source: int, target: int | None = None, relation: str | None = None, tags: tuple[str, ...] = (), at=None) -> DataFrame:
    """The annotations with one more, of a column or of a relation between two."""
    if md_class not in CLASSES:
        raise ValueError(f"no such class: {md_class}")
    kind, forward = RELATIONS[relation] if relation else (None, True)
    a, b = (source, target) if forward else (target, source)
    row = [(md_id, author, text, md_class, a, (b, kind) if relation else None, [(author, at, t) for t in tags], at, at)]
    return annotations.unionByName(annotations.sparkSession.createDataFrame(row, SCHEMA))


def add_comment(comments: DataFrame, annotations: DataFrame, comment_id: str, md_id: str, author: str, text: str, at=None) -> DataFrame:
    """The comments with one more; an unknown annotation raises ValueError."""
    if annotations.where(F.col("md_id") == md_id).isEmpty():
        raise ValueError(f"no annotation {md_id}")
    return comments.unionByName(comments.sparkSession.createDataFrame([(comment_id, md_id, author, text, at)], COMMENTS))


def add_tags(annotations: DataFrame, md_id: str, author: str, tags: list[str], at=None) -> DataFrame:
    """The annotations with tags put before those of one of them; an unknown one raises ValueError."""
    if annotations.where(F.col("md_id") == md_id).isEmpty():
        raise ValueError(f"no annotation {md_id}")
    new = F.array(*(F.struct(F.lit(author).alias("author"), F.lit(at).cast("timestamp").alias("creation_date"), F.lit(t).alias("tag")) for t in tags))
    hit = F.col("md_id") == md_id
    joined = F.concat(new, F.coalesce("tags", F.array().cast("array<struct<author:string,creation_date:timestamp,tag:string>>")))
    return annotations.withColumn("tags", F.when(hit, joined).otherwise(F.col("tags"))).withColumn("updated_date", F.when(hit & F.lit(at is not None), F.lit(at).cast("timestamp")).otherwise(F.col("updated_date")))


def search_text(annotations: DataFrame, keyword: str) -> DataFrame:
    """Annotations whose text has the keyword as a word, or that have it as a tag; any case."""
    k = keyword.lower()
    word = F.array_contains(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), k)
    tag = F.exists(F.coalesce("tags", F.array().cast("array<struct<author:string,creation_date:timestamp,tag:string>>")), lambda t: F.lower(t["tag"]) == k)
    return annotations.where(F.coalesce(word, F.lit(False)) | tag)


def search_comments(comments: DataFrame, keyword: str) -> DataFrame:
    return comments.where(F.array_contains(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), keyword.lower()))


def of_column(annotations: DataFrame, nid: int, relation: str | None = None) -> DataFrame:
    """Annotations of a column: all in which it is an end, or those of a relation in which it is the relation's end."""
    if relation is None:
        return annotations.where((F.col("source") == nid) | (F.col("target.id") == nid))
    kind, forward = RELATIONS[relation]
    end = F.col("source") if forward else F.col("target.id")
    return annotations.where((F.col("target.type") == kind) & (end == nid))


def related(hits: DataFrame, annotations: DataFrame, relation: str) -> DataFrame:
    """(origin, nid, score 1): columns that annotations relate to the hits' nids."""
    kind, forward = RELATIONS[relation]
    e = annotations.where(F.col("target.type") == kind).select(F.col("source").alias("a"), F.col("target.id").alias("b"))
    a, b = ("a", "b") if forward else ("b", "a")
    return e.join(hits.select(F.col("nid").alias(a)), a).select(F.col(a).alias("origin"), F.col(b).alias("nid"), F.lit(1.0).alias("score")).distinct()


def with_comments(annotations: DataFrame, comments: DataFrame) -> DataFrame:
    """(annotation columns, comments): each annotation with the list of its comments, oldest first."""
    each = comments.groupBy("md_id").agg(F.array_sort(F.collect_list(F.struct("creation_date", "id", "author", "text"))).alias("comments"))
    return annotations.join(each, "md_id", "left")


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], SCHEMA), spark.createDataFrame([], COMMENTS)
