"""Matching of tables and columns to the classes of a vocabulary, and the links that follow.

A vocabulary is (kr, name, parent); elements are (db_name, source_name, field_name), with
field_name `_` for a table. Matchings are (db_name, source_name, field_name, kr, name, kind).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from columnscout.functions.text import camel_to_snake, name_tokens
from columnscout.functions.vectors import dot, unit
from columnscout.operators.search import fuzzy_terms
from columnscout.plans.lineage import Stages

#: Kinds of evidence.
KINDS = ("L1", "L2", "L3", "L4", "L42", "L5", "L52", "L6", "L7")
ELEMENT, CLASS = ["db_name", "source_name", "field_name"], ["kr", "name"]
#: Elements of the same classes are linked in chunks of about so many.
CHUNK = 256


def attribute_elements(columns: DataFrame) -> DataFrame:
    return columns.select(*ELEMENT, name_tokens(F.col("field_name")).alias("tokens")).distinct()


def relation_elements(columns: DataFrame) -> DataFrame:
    return columns.select("db_name", "source_name", F.lit("_").alias("field_name"), name_tokens(F.col("source_name")).alias("tokens")).distinct()


def class_elements(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.select(*CLASS, name_tokens(F.col("name")).alias("tokens")).distinct()


def syntactic(elements: DataFrame, classes: DataFrame, kind: str, least: float = 0.5) -> DataFrame:
    """Matchings by Jaccard similarity of name tokens of at least `least`: L4 for relations, L5 for attributes. Exact, by an equi-join on tokens."""
    e = elements.select(*ELEMENT, F.array_distinct("tokens").alias("tokens"))
    c = classes.select(*CLASS, F.array_distinct("tokens").alias("ctokens"))
    pairs = e.withColumn("t", F.explode("tokens")).join(c.withColumn("t", F.explode("ctokens")), "t").groupBy(*ELEMENT, *CLASS).agg(F.count("*").alias("o"), F.first(F.size("tokens") + F.size("ctokens")).alias("n"))
    score = F.col("o") / (F.col("n") - F.col("o"))
    return pairs.withColumn("score", score).where(F.col("score") >= least - 1e-9).select(*ELEMENT, *CLASS, F.lit(kind).alias("kind"), "score")


def semantic(elements: DataFrame, classes: DataFrame, embedding: DataFrame, positive: float = 0.5, negative: float = 0.4, unknown_penalty: float = 0.0, ban_shared: bool = False, how: str = "avg") -> DataFrame:
    """(element, class, score, signal): mean similarity of the token pairs; signal is 1 from `positive` on, -1 below `negative`, else 0.

    `embedding` is (token, vector) with unit vectors; pairs with an unknown token count as `unknown_penalty`. L42 and L52, and with
    ban_shared without the tokens that both sides have. `how` may be avg, max, min or median of the pairs.
    """
    pairs = _meet(elements, classes)
    if ban_shared:
        pairs = pairs.select(*ELEMENT, *CLASS, F.array_except("tokens", "ctokens").alias("tokens"), F.array_except("ctokens", "tokens").alias("ctokens"))
    tokens = pairs.select(*ELEMENT, *CLASS, F.explode("tokens").alias("t"), "ctokens").select(*ELEMENT, *CLASS, "t", F.explode("ctokens").alias("u"))
    a, b = embedding.select(F.col("token").alias("t"), F.col("vector").alias("tv")), embedding.select(F.col("token").alias("u"), F.col("vector").alias("uv"))
    scored = tokens.join(a, "t", "left").join(b, "u", "left").withColumn("s", F.coalesce(F.when(F.col("t") == F.col("u"), F.lit(1.0)), dot("tv", "uv"), F.lit(unknown_penalty)))
    out = scored.groupBy(*ELEMENT, *CLASS).agg(F.round({"avg": F.avg, "max": F.max, "min": F.min, "median": F.median}[how]("s"), 9).alias("score"))
    return out.withColumn("signal", F.when(F.col("score") >= positive, 1).when(F.col("score") < negative, -1).otherwise(0))


def _meet(elements: DataFrame, classes: DataFrame) -> DataFrame:
    """All (element, class) pairs by blocks: a vocabulary is a stated set of queries against all elements."""
    blocks = 2 * elements.sparkSession.sparkContext.defaultParallelism
    c = classes.select(*CLASS, F.col("tokens").alias("ctokens"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    e = elements.select(*ELEMENT, "tokens", F.pmod(F.xxhash64(*ELEMENT), F.lit(blocks)).cast("int").alias("block"))
    return e.join(c, "block").drop("block")


def by_content(values: DataFrame, columns: DataFrame, classes: DataFrame, instances: DataFrame | None = None, least: float = 0.6) -> DataFrame:
    """Matchings of columns to classes by content: L1 the class names of a vocabulary, or with `instances` (kr, name, value) L2 a class's instances; Jaccard of the value sets of at least `least`."""
    low = F.lower(F.trim("value"))
    v = values.select("nid", low.alias("value")).where("value <> ''").distinct()
    c = (classes.select("kr", F.lit("_").alias("name"), F.lower("name").alias("value")) if instances is None else instances.select("kr", "name", F.lower("value").alias("value"))).distinct()
    nv, nc = v.groupBy("nid").agg(F.count("*").alias("nv")), c.groupBy("kr", "name").agg(F.count("*").alias("nc"))
    o = v.join(c, "value").groupBy("nid", "kr", "name").agg(F.count("*").alias("o")).join(nv, "nid").join(nc, ["kr", "name"])
    score = F.col("o") / (F.col("nv") + F.col("nc") - F.col("o"))
    return o.withColumn("score", score).where(F.col("score") >= least).join(columns.select("nid", *ELEMENT), "nid").select(*ELEMENT, *CLASS, F.lit("L1" if instances is None else "L2").alias("kind"), "score")


def by_hierarchy(values: DataFrame, columns: DataFrame, vocabulary: DataFrame, least_children: int = 50, accept: float = 0.4) -> DataFrame:
    """L7: columns whose values are, within the edits that their length allows, children of a class with many children.

    Accepted are columns that hold more than `accept` of the children.
    """
    children = vocabulary.where("parent is not null").select("kr", F.col("parent").alias("name"), F.lower("name").alias("term"))
    size = children.groupBy("kr", "name").agg(F.count_distinct("term").alias("size")).where(F.col("size") >= least_children)
    children = children.join(size, ["kr", "name"])
    v = values.select("nid", F.lower(F.trim("value")).alias("term")).where("term <> ''").distinct()
    near = fuzzy_terms(children.select("term"), v.select("term"))
    hit = near.join(children.withColumnRenamed("term", "left_term"), "left_term").join(v.withColumnRenamed("term", "right_term"), "right_term").groupBy("nid", "kr", "name", "size").agg(F.count_distinct("left_term").alias("n"))
    return hit.where(F.col("n") / F.col("size") > accept).join(columns.select("nid", *ELEMENT), "nid").select(*ELEMENT, *CLASS, F.lit("L7").alias("kind"), (F.col("n") / F.col("size")).alias("score"))


def contexts(columns: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L3: tables with the name tokens of all their columns, and classes with those of their name, parent and children; for `syntactic`."""
    tables = columns.select("db_name", "source_name", F.lit("_").alias("field_name"), F.explode(F.concat(name_tokens(F.col("field_name")), name_tokens(F.col("source_name")))).alias("t"))
    around = vocabulary.select("kr", "name", F.col("name").alias("x")).union(vocabulary.where("parent is not null").select("kr", "name", "parent")).union(vocabulary.where("parent is not null").select("kr", F.col("parent").alias("name"), F.col("name").alias("x")))
    classes = around.select("kr", "name", F.explode(name_tokens(F.col("x"))).alias("t"))
    return tables.groupBy(*ELEMENT).agg(F.collect_set("t").alias("tokens")), classes.groupBy(*CLASS).agg(F.collect_set("t").alias("tokens"))


def coarse_hooks(elements: DataFrame, classes: DataFrame, embedding: DataFrame, least: float = 0.6) -> DataFrame:
    """(element, class, score): tables and classes whose mean token vectors point the same way."""
    def mean(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        v = df.select(*keys, F.explode("tokens").alias("token")).join(embedding, "token").select(*keys, F.posexplode("vector").alias("at", "x"))
        each = v.groupBy(*keys, "at").agg(F.avg("x").alias("x"))
        return each.groupBy(*keys).agg(unit(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"])).alias(name))

    e, c = mean(elements, ELEMENT, "tokens"), mean(classes, CLASS, "tokens")
    return _meet(e, c).withColumn("score", dot("tokens", "ctokens")).where(F.col("score") >= least).select(*ELEMENT, *CLASS, "score")


def cohesive_groups(tokens: DataFrame, embedding: DataFrame, least: float = 0.5) -> DataFrame:
    """(source_name, token, cohesion): name tokens of a table's columns whose mean similarity to the table's other tokens is at least `least`."""
    t = tokens.select("source_name", F.explode("tokens").alias("token")).distinct().join(embedding, "token")
    o = t.select("source_name", F.col("token").alias("other"), F.col("vector").alias("ov"))
    pairs = t.join(o, "source_name").where("token <> other").groupBy("source_name", "token").agg(F.round(F.avg(dot("vector", "ov")), 9).alias("cohesion"))
    return pairs.where(F.col("cohesion") >= least)


def group_matchings(groups: DataFrame, classes: DataFrame, embedding: DataFrame, least: float = 0.5) -> DataFrame:
    """(source_name, kr, name, score): L6, classes whose tokens are, on the mean, at least as similar to a table's cohesive group as the group is to itself."""
    g = groups.join(embedding, "token")
    c = classes.select(*CLASS, F.explode("tokens").alias("token")).join(embedding.select("token", F.col("vector").alias("cv")), "token")
    # a stated set of classes against all groups, in blocks of tables
    n = 2 * groups.sparkSession.sparkContext.defaultParallelism
    blocks = c.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = g.withColumn("b", F.pmod(F.xxhash64("source_name"), F.lit(n)).cast("int")).join(blocks.drop("token"), "b").groupBy("source_name", *CLASS).agg(F.round(F.avg(dot("vector", "cv")), 9).alias("score"), F.round(F.avg("cohesion"), 9).alias("own"))
    return pairs.where((F.col("score") >= least) & (F.col("score") >= F.col("own"))).select("source_name", *CLASS, "score")


def cancel(matchings: DataFrame, semantic_scores: DataFrame) -> DataFrame:
    """Matchings without those against which the semantic signal speaks."""
    return matchings.join(semantic_scores.where("signal < 0").select(*ELEMENT, *CLASS), [*ELEMENT, *CLASS], "left_anti")


def confirm_by_group(matchings: DataFrame, groups: DataFrame) -> DataFrame:
    """Semantic matchings that a table's cohesive group confirms."""
    return matchings.join(groups.select("source_name", *CLASS), ["source_name", *CLASS], "left_semi")


def combine(matchings: DataFrame) -> DataFrame:
    """(element, class, kinds, n): the evidence of each pair, most first."""
    return matchings.groupBy(*ELEMENT, *CLASS).agg(F.array_sort(F.collect_set("kind")).alias("kinds")).withColumn("n", F.size("kinds"))


def ancestors(vocabulary: DataFrame) -> DataFrame:
    """(kr, name, ancestor, distance): every ancestor of every class with its least distance, at any depth; cycles are walked once, and a class isn't its own ancestor.

    One written stage a level, until a level has nothing new.
    """
    stages = Stages(vocabulary.sparkSession, "ancestors")
    step = vocabulary.where("parent is not null").select("kr", F.col("name").alias("child"), "parent").distinct()
    up = stages.write(step.select("kr", F.col("child").alias("ancestor"), "parent"), "up")
    out = level = stages.write(step.where("child <> parent").select("kr", F.col("child").alias("name"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance")), "level1")
    d = 1
    while not level.isEmpty():
        d += 1
        above = level.drop("distance").join(up, ["kr", "ancestor"]).where("parent <> name").select("kr", "name", F.col("parent").alias("ancestor"), F.lit(d).alias("distance")).distinct()
        level = stages.write(above.join(out, ["kr", "name", "ancestor"], "left_anti"), f"level{d}")
        out = out.unionByName(level)
    return out


def summarise_to_ancestor(matchings: DataFrame, vocabulary: DataFrame, fan_out: int = 2, share: float = 0.8, least_depth: int = 2, similar: float = 0.85) -> DataFrame:
    """Matchings in which an element's many classes are replaced by the deepest common ancestor that covers more than `share` of them.

    Only elements with more than fan_out classes, and only ancestors deeper than least_depth; matchings
    whose class name is nearly the element's name stay as well.
    """
    up = ancestors(vocabulary)
    depth = up.groupBy("kr", F.col("name").alias("ancestor")).agg(F.max("distance").alias("depth"))
    m = matchings.select(*ELEMENT, *CLASS).distinct()
    n = m.groupBy(*ELEMENT, "kr").agg(F.count("*").alias("n"))
    many = n.where(F.col("n") > fan_out)
    cover = m.join(up, ["kr", "name"]).groupBy(*ELEMENT, "kr", "ancestor").agg(F.count("*").alias("c")).join(many, [*ELEMENT, "kr"]).join(depth, ["kr", "ancestor"], "left").na.fill({"depth": 0})
    able = cover.where((F.col("c") / F.col("n") > share) & (F.col("depth") > least_depth))
    best = able.withColumn("r", F.row_number().over(Window.partitionBy(*ELEMENT, "kr").orderBy(F.col("depth").desc(), F.col("c").desc(), "ancestor"))).where("r = 1")
    name = camel_to_snake(F.col("name"))
    alike = 1 - F.levenshtein(name, camel_to_snake(F.col("field_name"))) / F.greatest(F.length(name), F.length("field_name"))
    replaced = m.join(best.select(*ELEMENT, "kr"), [*ELEMENT, "kr"], "left_semi")
    return (m.join(best.select(*ELEMENT, "kr"), [*ELEMENT, "kr"], "left_anti").unionByName(best.select(*ELEMENT, "kr", F.col("ancestor").alias("name")))
            .unionByName(replaced.where(alike >= similar)).distinct())


def find_links(matchings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(child and parent element, relation is_a): elements whose classes are the same, or of which one's class is the parent of the other's.

    Elements with the same set of classes have the same links. So links are found between sets, and written out for the members of both
    in chunks, in the order of the joins: no pair of elements is made twice, shuffled or sorted. The result has a row for each pair, so
    of a class with very many elements a quadratic number.
    """
    spark = matchings.sparkSession
    stages, tasks = Stages(spark, "links"), 4 * spark.sparkContext.defaultParallelism
    element = matchings.where("kr is not null and name is not null").groupBy(*ELEMENT).agg(F.array_sort(F.collect_set(F.struct(*CLASS))).alias("classes"))
    element = stages.write(element, "elements")
    sets = element.groupBy("classes").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    sets = stages.write(sets.select(F.monotonically_increasing_id().alias("set"), "classes", "chunks"), "sets")
    step = vocabulary.where("parent is not null").select("kr", "name", "parent").union(vocabulary.select("kr", "name", F.col("name").alias("parent"))).distinct()
    held = sets.select("set", "chunks", F.inline("classes"))
    parent = held.select(F.col("set").alias("parent_set"), F.col("chunks").alias("parent_chunks"), "kr", F.col("name").alias("parent"))
    linked = held.join(step, CLASS).repartition(tasks, "kr", "parent").join(parent, ["kr", "parent"]).select("set", "chunks", "parent_set", "parent_chunks").distinct()
    for c in ("", "parent_"):
        linked = linked.withColumn(f"{c}chunk", F.explode(F.sequence(F.lit(0), F.col(f"{c}chunks") - 1))).drop(f"{c}chunks")
    child = element.join(sets, "classes").select("set", F.pmod(F.xxhash64(*ELEMENT), F.col("chunks")).cast("int").alias("chunk"), *ELEMENT)
    other = child.toDF("parent_set", "parent_chunk", *(f"parent_{c}" for c in ELEMENT))
    # numbers of tasks are given, since the rows of the result don't follow the bytes that are shuffled
    pairs = child.join(linked.repartition(tasks, "set", "chunk"), ["set", "chunk"]).repartition(tasks, "parent_set", "parent_chunk").join(other, ["parent_set", "parent_chunk"])
    differ = (F.col("source_name") != F.col("parent_source_name")) | (F.col("field_name") != F.col("parent_field_name")) | (F.col("db_name") != F.col("parent_db_name"))
    return pairs.where(differ).select(*ELEMENT, *(f"parent_{c}" for c in ELEMENT), F.lit("is_a").alias("relation"))


def write_lines(matchings: DataFrame) -> DataFrame:
    """(line): `db %%% table %%% attr ==>> kr %%% class %%% kinds`."""
    return combine(matchings).select(F.concat(F.concat_ws(" %%% ", *ELEMENT), F.lit(" ==>> "), F.concat_ws(" %%% ", *CLASS, F.concat_ws(",", "kinds"))).alias("line"))


def read_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Matchings of lines as `write_lines` gives them; other lines are left out."""
    p = F.split(F.col(column), " ==>> ")
    a, b = F.split(p[0], " %%% "), F.split(p[1], " %%% ")
    ok = lines.where((F.size(p) == 2) & (F.size(a) == 3) & (F.size(b) == 3))
    return ok.select(a[0].alias("db_name"), a[1].alias("source_name"), a[2].alias("field_name"), b[0].alias("kr"), b[1].alias("name"), F.explode(F.split(b[2], ",")).alias("kind"))

