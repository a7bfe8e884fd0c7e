"""Problem 4: overlap sizes between many large sets.

Pair counts are maintained incrementally: when an identifier joins or leaves a set, it
is joined with the identifier's other memberships, and each partner gets a signed pair
delta. Loading is a batch of joins on an empty state; there is no other way to count.

An identifier in more than `hot_degree` sets would give a delta for every pair of them;
such identifiers leave the counts (with deltas, like any other departure). Their deltas are made when the overlaps are asked
for, and only for the pairs that they can still bring over the limit: those whose counts come near it, and those
that sets of mostly hot identifiers form through their rarest ones. The results are exact at every `hot_degree`.

The state is a log: a batch writes its own changes and deltas, and reading sums them up.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from columnscout.plans.lineage import Stages

HOT_DEGREE = 100
#: A log of more parts than this is merged into one.
MOST_PARTS = 8


@dataclass(frozen=True)
class OverlapState:
    """joined: parts (nid, ident, sign), the real changes so far; pairs: parts (nid_a, nid_b, delta), over identifiers of at most hot_degree sets; hot (ident, degree): the others."""

    stages: Stages
    hot_degree: int
    hot: DataFrame
    joined: list[DataFrame] = field(default_factory=list)
    pairs: list[DataFrame] = field(default_factory=list)

    def memberships(self, of: DataFrame | None = None) -> DataFrame:
        """(nid, ident): the memberships, each once; with `of` (ident) only those of these identifiers."""
        parts = [p if of is None else p.join(of, "ident", "left_semi").select("nid", "ident", "sign") for p in self.joined]
        if len(parts) == 1:
            return parts[0].select("nid", "ident")
        return _sum(parts, ["nid", "ident"], "sign", self.hot.sparkSession, "nid long, ident long, sign long").where("sign > 0").select("nid", "ident")

    def counts(self) -> DataFrame:
        """(nid_a, nid_b, shared): how many identifiers that aren't hot each pair shares; pairs without any are left out."""
        return _sum(self.pairs, ["nid_a", "nid_b"], "delta", self.hot.sparkSession, "nid_a long, nid_b long, delta long").where("delta <> 0").withColumnRenamed("delta", "shared")


def _sum(parts: list[DataFrame], keys: list[str], value: str, spark, schema: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum(value).alias(value))


def pair_deltas(members: DataFrame, changes: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(nid_a, nid_b, delta): what `changes` (nid, ident, sign) do to the pair counts over `members` (nid, ident); with `within` (nid_a, nid_b) only of these pairs.

    Changes must be real: +1 only for absent and -1 only for present memberships. A
    change meets the old memberships of its identifier once, and the other changes
    of it once, where the product of the signs makes up for counting both.
    """
    c = changes.select("nid", "ident", "sign")
    old = members.select(F.col("nid").alias("o_nid"), "ident")
    new = changes.select(F.col("nid").alias("o_nid"), "ident", F.col("sign").alias("o_sign"))
    if within is None:
        with_old, with_new = c.join(old, "ident").where("nid <> o_nid"), c.join(new, "ident").where("nid < o_nid")
    else:
        pairs = within.select(F.col("nid_a").alias("nid"), F.col("nid_b").alias("o_nid"))
        both = pairs.union(pairs.select(F.col("o_nid").alias("nid"), F.col("nid").alias("o_nid")))
        with_old, with_new = c.join(both, "nid").join(old, ["o_nid", "ident"]), c.join(pairs, "nid").join(new, ["o_nid", "ident"])
    with_old = with_old.select(F.least("nid", "o_nid").alias("nid_a"), F.greatest("nid", "o_nid").alias("nid_b"), F.col("sign").alias("delta"))
    with_new = with_new.select(F.col("nid").alias("nid_a"), F.col("o_nid").alias("nid_b"), (F.col("sign") * F.col("o_sign")).alias("delta"))
    return with_old.union(with_new).groupBy("nid_a", "nid_b").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def empty(stages: Stages, hot_degree: int = HOT_DEGREE) -> OverlapState:
    return OverlapState(stages, hot_degree, stages.spark.createDataFrame([], "ident long, degree long"))


def load(idents: DataFrame, stages: Stages, hot_degree: int = HOT_DEGREE, set_col: str = "nid", ident_col: str = "ident") -> OverlapState:
    """The state after all rows of `idents` joined their sets; repeats count once, rows with a null don't count."""
    joins = idents.select(F.col(set_col).cast("long").alias("nid"), F.col(ident_col).cast("long").alias("ident"), F.lit(1).alias("sign"))
    return apply_changes(empty(stages, hot_degree), joins)


def apply_changes(state: OverlapState, changes: DataFrame) -> OverlapState:
    """The state after `changes` (nid, ident, sign of +1 or -1); of repeats in a batch the sum's sign counts, changes without effect and rows with a null don't.

    Reads the old memberships of the changed identifiers, and writes the batch's own changes and deltas only.
    """
    s, first = state.stages, not state.joined
    name = lambda x: f"{x}{s.written}"
    net = changes.where("nid is not null and ident is not null").groupBy("nid", "ident").agg(F.signum(F.sum("sign")).cast("long").alias("sign")).where("sign <> 0")
    if first:
        held, real = None, s.write(net.where("sign > 0"), name("joined"))
    else:
        net = s.write(net, name("net"))
        held = s.write(state.memberships(net.select("ident").distinct()), name("held"))
        was = held.withColumn("was", F.lit(True))
        real = s.write(net.join(was, ["nid", "ident"], "left").where("(sign > 0 and was is null) or (sign < 0 and was)").select("nid", "ident", "sign"), name("joined"))
    after = real if first else _sum([held.withColumn("sign", F.lit(1).cast("long")), real], ["nid", "ident"], "sign", s.spark, "").where("sign > 0")
    now = after.groupBy("ident").agg(F.count("*").alias("degree")).where(F.col("degree") > state.hot_degree)
    hot = s.write(now if first else state.hot.join(net.select("ident"), "ident", "left_anti").unionByName(now), name("hot"))
    # what counts before and after for the touched identifiers; crossing the limit is leaving or joining as a whole
    signs = after.join(hot, "ident", "left_anti").select("nid", "ident", F.lit(1).cast("long").alias("sign"))
    if first:
        before = s.spark.createDataFrame([], "nid long, ident long")
    else:
        before = held.join(state.hot, "ident", "left_anti").select("nid", "ident")
        signs = _sum([signs, before.withColumn("sign", F.lit(-1).cast("long"))], ["nid", "ident"], "sign", s.spark, "").where("sign <> 0")
    new = replace(state, hot=hot, joined=[*state.joined, real], pairs=[*state.pairs, s.write(pair_deltas(before, signs), name("pairs"))])
    if len(new.joined) <= MOST_PARTS:
        return new
    whole = new.memberships().withColumn("sign", F.lit(1).cast("long"))
    return replace(new, joined=[s.write(whole, name("joined"))], pairs=[s.write(new.counts().withColumnRenamed("shared", "delta"), name("pairs"))])


def overlapping_pairs(state: OverlapState, share: float) -> DataFrame:
    """(nid_a, nid_b, shared): all pairs that share at least `share` of the smaller set's identifiers, with the exact number shared."""
    members = state.memberships()
    hot_rows = state.stages.write(members.join(state.hot, "ident").select("nid", "ident", "degree"), f"hot_rows{state.stages.written}")
    sizes = members.groupBy("nid").agg(F.count("*").alias("size"))
    held = hot_rows.groupBy("nid").agg(F.count("*").alias("held"))
    need = F.greatest(F.ceil(F.lit(share) * F.col("size") - 1e-9), F.lit(1))
    sets = sizes.join(held, "nid", "left").select("nid", need.alias("need"), F.coalesce("held", F.lit(0)).alias("held"))

    def side(s: str) -> DataFrame:
        return sets.select(*(F.col(c).alias(f"{c}_{s}") for c in ("nid", "need", "held")))

    counts = state.counts()
    limits = F.least("need_a", "need_b").alias("need")
    counted = counts.join(side("a"), "nid_a").join(side("b"), "nid_b").where(F.col("shared") + F.least("held_a", "held_b") >= F.least("need_a", "need_b")).select("nid_a", "nid_b", "shared", limits)
    # sets whose hot identifiers alone may reach the limit: of them, the rarest are enough to meet every such partner; those of one degree stay together
    alone = hot_rows.join(sets.where("held >= need"), "nid")
    upto = Window.partitionBy("nid").orderBy("degree")  # one row a degree
    rare = alone.groupBy("nid", "degree").agg(F.count("*").alias("n"), F.first(F.col("held") - F.col("need") + 1).alias("enough"))
    rare = rare.withColumn("upto", F.sum("n").over(upto)).where("upto - n < enough").select("nid", "degree")
    partner = hot_rows.select(F.col("nid").alias("other"), "ident")
    extra = alone.select("nid", "ident", "degree").join(rare, ["nid", "degree"]).join(partner, "ident").where("nid <> other").select(F.least("nid", "other").alias("nid_a"), F.greatest("nid", "other").alias("nid_b")).distinct()
    extra = extra.join(side("a"), "nid_a").join(side("b"), "nid_b").select("nid_a", "nid_b", F.lit(0).cast("long").alias("shared"), limits)
    near = counted.unionByName(extra.join(counted, ["nid_a", "nid_b"], "left_anti").join(counts.withColumnRenamed("shared", "s"), ["nid_a", "nid_b"], "left").select("nid_a", "nid_b", F.coalesce("s", "shared").alias("shared"), "need"))
    near = state.stages.write(near, f"near{state.stages.written}")
    hot = pair_deltas(state.stages.spark.createDataFrame([], "nid long, ident long"), hot_rows.select("nid", "ident", F.lit(1).cast("long").alias("sign")), near)
    total = near.join(hot, ["nid_a", "nid_b"], "left").select("nid_a", "nid_b", (F.col("shared") + F.coalesce("delta", F.lit(0))).alias("shared"), "need")
    return total.where("shared >= need").select("nid_a", "nid_b", "shared")
