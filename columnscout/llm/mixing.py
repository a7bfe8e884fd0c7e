"""Problem 8: mixing sources to target weights.

Weights are either given or come from temperature mixing: the sources' token shares to
the power of an exponent, normalised, where the exponent is found by bisection. They are realised
as whole passes over a source plus a budgeted part of one more pass: the source's
texts are permuted in blocks by a hash, whole blocks are taken while the budget
lasts, and the block in which it ends is taken in part.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from columnscout.llm.byte_bpe import TOKENIZERS, VOCABULARY, encode_corpus

#: A block holds about so many texts, and a source has at most so many blocks.
BLOCK_TEXTS = 4096
MOST_BLOCKS = 65_536


def entropy(weights: Mapping[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def tempered(tokens: Mapping[str, int], exponent: float) -> dict[str, float]:
    """Token shares to the power of the exponent, normalised; sources without tokens have no weight."""
    top = max(tokens.values(), default=0)
    raw = {s: (t / top) ** exponent if t > 0 else 0.0 for s, t in tokens.items()}
    total = sum(raw.values())
    return {s: r / total if total else 0.0 for s, r in raw.items()}


def exponent_for_entropy(tokens: Mapping[str, int], target: float, steps: int = 60) -> float:
    """The exponent in [0, 8] whose weights have the target entropy; the nearer end if none has (entropy falls as it grows)."""
    low, high = 0.0, 8.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(tempered(tokens, middle)) > target else (low, middle)
    return (low + high) / 2


def exponent_for_repeats(tokens: Mapping[str, int], budget: int, max_repeats: float, steps: int = 60) -> float:
    """The least exponent in [0, 1], so the flattest mixture, at which no source is repeated more than max_repeats times for the budget; 1 if none is flat enough."""
    fits = lambda a: all(w * budget <= max_repeats * tokens[s] for s, w in tempered(tokens, a).items())
    if fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


@dataclass(frozen=True)
class Quota:
    """How much of a source is used: `passes` times the whole, and texts of up to `rest` tokens of one more pass."""

    source: str
    weight: float
    tokens: int
    texts: int
    passes: int
    rest: int


def quotas(weights: Mapping[str, float], supply: Mapping[str, tuple[int, int]], repeats: Mapping[str, int], budget: int | None = None) -> list[Quota]:
    """Each source's quota. `supply` has (tokens, texts) of a source.

    Sources without tokens supply nothing, and the others' weights are scaled up to
    add up to 1. Without `budget` it is the largest for which every source can
    supply its weight within its repeats; a larger `budget` is cut to that.
    """
    able = {s: w for s, w in weights.items() if w > 0 and supply.get(s, (0, 0))[0] > 0 and repeats[s] > 0}
    total = sum(able.values())
    able = {s: w / total for s, w in able.items()}
    most = min((repeats[s] * supply[s][0] / w for s, w in able.items()), default=0)
    size = most if budget is None else min(budget, most)
    out = []
    for s in weights:
        tokens, texts = supply.get(s, (0, 0))
        want = min(round(able.get(s, 0.0) * size), repeats[s] * tokens) if s in able else 0
        out.append(Quota(s, able.get(s, 0.0), tokens, texts, want // tokens if want else 0, want % tokens if want else 0))
    return out


def sized_texts(documents: DataFrame, sources: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, id, n_tokens): each different text of each of `sources` once, under its smallest id.

    Spellings of a source count as one after trimming and lower-casing. Null texts, texts
    without tokens, other sources, missing sources and null ids are left out.
    """
    read = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lower(F.trim(source_col)).alias("source"))
    read = read.where(F.col("source").isin(sources) & F.col("id").isNotNull() & (F.length("text") > 0))
    sized = encode_corpus(read.withColumn("digest", F.unhex(F.sha2("text", 256))), "id", "text", tokenizers, vocabulary, counts_only=True, keep=("source", "digest"))
    return sized.groupBy("source", "digest").agg(F.min("id").alias("id"), F.first("n_tokens").alias("n_tokens")).select("source", "id", "n_tokens")


def draw(sized: DataFrame, parts: list[Quota], seed: int = 1) -> DataFrame:
    """(source, id, n_tokens, copies): the texts used and how often, following `quotas`.

    The last block is taken up to the budget, so a source falls short of its quota by
    less than the length of one text. No source is gathered in one task: the running sum is over
    blocks, and over the rows of one block a source.
    """
    spark = sized.sparkSession
    table = spark.createDataFrame([(q.source, q.passes, q.rest, max(1, min(MOST_BLOCKS, -(-q.texts // BLOCK_TEXTS)))) for q in parts] or [("", 0, 0, 1)],
                                  "source string, passes long, rest long, blocks int")
    rows = sized.join(F.broadcast(table), "source")  # one row a source of the target table
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id"), "blocks").cast("int"))
    totals = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    before = F.coalesce(F.sum("block_tokens").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(totals.withColumn("before", before), ["source", "block"])
    cut = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("block_tokens") > F.col("rest"))
    whole = rows.where(~cut).select("source", "id", "n_tokens", (F.col("passes") + F.when(F.col("before") < F.col("rest"), 1).otherwise(0)).alias("copies"))
    running = F.sum("n_tokens").over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    part = rows.where(cut).withColumn("upto", F.col("before") + running).select("source", "id", "n_tokens", (F.col("passes") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    return whole.union(part).where("copies > 0").withColumn("copies", F.col("copies").cast("int"))


def shares(drawn: DataFrame, parts: list[Quota], targets: Mapping[str, float]) -> DataFrame:
    """(source, target_share, available_tokens, drawn_tokens, actual_share, most_copies): the shares reached, one row for each source."""
    spark = drawn.sparkSession
    table = spark.createDataFrame([(q.source, float(targets[q.source]), q.tokens) for q in parts], "source string, target_share double, available_tokens long")
    used = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn"), F.max("copies").alias("most"))
    out = table.join(used, "source", "left").select("source", "target_share", "available_tokens", F.coalesce("drawn", F.lit(0)).alias("drawn_tokens"), F.coalesce("most", F.lit(0)).alias("most_copies"))
    total = out.agg(F.sum("drawn_tokens").alias("total"))
    share = F.when(F.col("total") > 0, F.col("drawn_tokens") / F.col("total")).otherwise(0.0)
    return out.crossJoin(F.broadcast(total)).select("source", "target_share", "available_tokens", "drawn_tokens", share.alias("actual_share"), "most_copies")  # one row
