"""From tables to the column graph in one plan: melt, count, profile, relate."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columnscout.operators import profile as P
from columnscout.operators import relate
from columnscout.plans.lineage import Stages


@dataclass
class Model:
    """A built model: written columns, value counts and profile, and lazy relations."""

    columns: DataFrame
    counts: DataFrame
    profile: DataFrame

    def inclusion(self) -> DataFrame:
        return relate.inclusion_dependencies(self.profile)

    def numeric_content(self) -> DataFrame:
        return relate.numeric_content_similarity(self.profile).unionByName(relate.single_point_clusters(self.profile))

    def text_content(self, least: float = 0.7) -> DataFrame:
        """Exact Jaccard similarity of the lower-cased values of text columns."""
        text = self.counts.join(self.profile.where("data_type = 'T'").select("nid"), "nid", "left_semi").select("nid", F.lower("value").alias("value"))
        return relate.value_set_similarity(text, least)

    def schema(self, least: float = 0.8) -> DataFrame:
        return relate.schema_similarity(self.columns, least)

    def keys(self) -> DataFrame:
        return relate.primary_foreign_keys(self.profile, self.inclusion(), self.text_content())

    def edges(self) -> DataFrame:
        """All relations, both directions."""
        return relate.edges_of({"SCHEMA_SIM": self.schema(), "CONTENT_SIM": self.numeric_content().unionByName(self.text_content()), "INCLUSION_DEPENDENCY": self.inclusion(), "PKFK": self.keys()})


def build(spark: SparkSession, tables: Mapping[str, DataFrame], db: str = "lake", name: str = "model") -> Model:
    """Profile all columns of the tables. One pass over each table; the counts of distinct values and the profile are written stages."""
    stages = Stages(spark, name)
    counts = stages.write(P.table_counts(tables, db), "counts")
    columns = P.catalogue(spark, tables, db)
    profile = stages.write(columns.join(P.profile(counts, stages=stages), "nid"), "profile")
    return Model(columns, counts, profile)
