"""Written stages."""

from pyspark.sql import functions as F

from columnscout.plans.lineage import Stages, shared_folder


def test_stages(spark, tmp_path):
    s = Stages(spark, "test")
    assert s.root.startswith(shared_folder(spark))
    one = s.write(spark.range(3).select("id", F.lit(None).cast("array<string>").alias("a")), "x")
    two = s.write(one.where("id > 0"), "x")  # reads the earlier stage of its own name
    assert (one.count(), two.count(), two.schema["a"].dataType.simpleString()) == (3, 2, "array<string>")
    s.drop("x")
    assert one.count() == 3


def test_folder_of_the_cluster_is_used(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/stages")


def test_empty_stage(spark):
    assert Stages(spark, "test").write(spark.range(0), "none").count() == 0
