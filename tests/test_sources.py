"""Sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from columnscout import cli
from columnscout.operators import ann, graph, profile
from columnscout.plans import model
from columnscout.sources import config, readers, sinks
from columnscout.sources.relations import Relations
from columnscout.streaming import profile as stream


def test_csv_folder(spark, tmp_path):
    (tmp_path / "lake").mkdir()
    (tmp_path / "lake" / "a.csv").write_text("x;y\n1;a\n2;b\n3\n")
    (tmp_path / "lake" / "b.csv").write_text("z\nq\n")
    path = tmp_path / "sources.json"
    config.dump([config.SourceConfig("lake", "csv", {"path": str(tmp_path / "lake"), "separator": ";"})], str(path))
    source = config.load(str(path))[0]
    tables = config.tables(spark, source)
    assert list(tables) == ["a.csv", "b.csv"] and tables["a.csv"].dtypes == [("x", "string"), ("y", "string")]
    assert sorted(map(tuple, tables["a.csv"].dropna().collect())) == [("1", "a"), ("2", "b")]
    path.write_text(json.dumps({"api_version": 0, "sources": [{"name": "s", "type": "tape"}]}))
    with pytest.raises(ValueError):
        config.load(str(path))


def test_other_readers(spark, small):
    assert set(config.tables(spark, config.SourceConfig("l", "parquet", {"path": small, "tables": ["region"]}))) == {"region"}
    spark.range(3).createOrReplaceTempView("three")
    assert config.tables(spark, config.SourceConfig("c", "hive"))["three"].count() == 3
    o = readers.jdbc_options("postgres", {"host": "h", "port": 5432, "database": "d", "user": "u"})
    assert o["url"] == "jdbc:postgresql://h:5432/d" and o["user"] == "u" and {"postgres", "sqlserver", "hive", "mysql", "oracle", "csv", "parquet"} <= set(config.READERS)
    assert readers.as_strings(spark.createDataFrame([(1, None)], "a int, b int")).first().asDict() == {"a": "1", "b": ""}


def test_network_round_trip(spark, tmp_path):
    columns, edges = graph.synthetic(spark, 50, 10, {1: 20, 2: 100}, {1: 0.2, 2: 0.5})
    sinks.write_network(columns, edges, f"{tmp_path}/net")
    c, e = sinks.read_network(spark, f"{tmp_path}/net")
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, edges.collect())) and c.count() == 50
    sinks.network_to_csv(columns, edges, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv/edges").count() == edges.where("src < dst").count()
    assert sinks.triples(edges).first().line.endswith(" .")


def test_catalogue_round_trips(spark, tmp_path):
    h = [ann.binary_projections("h", 4, 3, 1)]
    b = ann.buckets(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id long, v array<double>"), h, "id", "v")
    sinks.write_buckets(b, h, f"{tmp_path}/b")
    again, hashes = sinks.read_buckets(spark, f"{tmp_path}/b")
    assert again.count() == 1 and (hashes[0].normals == h[0].normals).all()
    p = spark.createDataFrame([(1, "N", 5), (2, "T", 6)], "nid long, data_type string, total_values long")
    new = spark.createDataFrame([(2, "T", 9)], "nid long, data_type string, total_values long")
    assert {r.nid: r.total_values for r in sinks.upsert_profile(p, new).collect()} == {1: 5, 2: 9}
    sinks.write_profile(p, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    sinks.write_nothing(p)


def test_model_edges_are_symmetric(spark, small):
    m = model.build(spark, {t: spark.read.parquet(f"{small}/{t}.parquet") for t in ("region", "nation", "customer", "orders")})
    e = m.edges()
    turned = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "score")
    assert e.exceptAll(turned).isEmpty() and e.count() > 0
    with pytest.raises(ValueError):
        profile.catalogue(spark, {"a": spark.createDataFrame([(1,)], "bc int"), "ab": spark.createDataFrame([(1,)], "c int")}, "d")


def test_stream_equals_batch(spark, tmp_path):
    cells = spark.createDataFrame([(i % 3, str(i % 50)) for i in range(600)], "nid long, value string")
    cells.repartition(4).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    q = stream.start(live, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.processAllAvailable()
    q.stop()
    merged = {r.nid: r for r in stream.read_sketches(stream.merge_sketches(spark.read.parquet(f"{tmp_path}/out"))).collect()}
    batch = {r.nid: r for r in stream.read_sketches(stream.batch_sketch(cells)).collect()}
    for nid, r in merged.items():
        assert (r.total, r.min_value, r.max_value) == (batch[nid].total, batch[nid].min_value, batch[nid].max_value)
        assert r.uniques == pytest.approx(batch[nid].uniques, rel=0.05)


def test_command_line(spark, small, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("COLUMNSCOUT_HOME", str(tmp_path))
    assert cli.main(["add-db", "lake", "parquet", json.dumps({"path": small, "tables": ["nation", "customer"], "password": "x"})]) == 0
    cli.main(["list-sources"])
    cli.main(["show-source", "lake"])
    assert "password" not in capsys.readouterr().out
    cli.main(["build-model", "lake", "m"])
    cli.main(["explore-model", "m", "--keyword", "nationkey"])
    assert "customer" in capsys.readouterr().out
    cli.main(["export-model", "m", f"{tmp_path}/out"])
    cli.main(["clear-store", "m"])
    cli.main(["list-models"])
    assert capsys.readouterr().out.strip() == ""


def test_relations_are_kept(spark, small):
    r = Relations(spark)
    assert r.get(f"{small}/region.parquet") is r.get(f"{small}/region.parquet") and r.get(f"{small}/region.parquet").is_cached
    r.clear()
    assert not r.held
