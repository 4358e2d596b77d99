"""Kept tables: keyed by content, published whole."""

import os

import pytest
from pyspark.sql import functions as F

from shipgraph.sources import artefacts as ar


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(10).withColumnRenamed("id", "x").write.parquet(path)
    return path


def test_built_once_until_the_input_or_a_setting_changes(spark, source):
    built = []

    def get(settings=None, **kw):
        def build():
            built.append(1)
            return spark.read.parquet(source).selectExpr("x", "x % 2 AS part")
        return ar.table(spark, "halves", [source], build, settings, ["part"], **kw)

    assert get().count() == 10 and get().count() == 10 and len(built) == 1
    assert get({"a": 1}).count() == 10 and len(built) == 2
    assert get(force_rebuild=True).count() == 10 and len(built) == 3
    spark.range(5).withColumnRenamed("id", "x").write.mode("append").parquet(source)
    assert get().count() == 15 and len(built) == 4


def test_split_folders_are_pruned(spark, source):
    t = ar.table(spark, "pruned", [source], lambda: spark.read.parquet(source).selectExpr(
        "x", "x % 2 AS part"), partition_by=["part"])
    odd = t.where("part = 1")
    read = {r[0] for r in odd.select(F.input_file_name()).collect()}
    assert odd.count() == 5 and read and all("part=1" in f for f in read)
    assert "PartitionFilters: [isnotnull(part" in odd._jdf.queryExecution().toString()


def test_a_failed_build_leaves_nothing_to_read(spark, source):
    def fails():
        return spark.read.parquet(source).selectExpr("x", "raise_error('no') AS y")
    for _ in range(2):
        with pytest.raises(Exception, match="no"):
            ar.table(spark, "failing", [source], fails)
    good = ar.table(spark, "failing", [source], lambda: spark.read.parquet(source))
    assert good.columns == ["x"] and good.count() == 10


def test_release_and_reports(spark, source, tmp_path):
    from shipgraph.sources.sinks import write_report
    ar.table(spark, "gone", [source], lambda: spark.read.parquet(source))
    key = ar.artefact_key(spark, "gone", [source], {})
    assert ar.release(spark, "gone", key) and not ar.release(spark, "gone", key)
    with pytest.raises(FileNotFoundError):
        ar.fingerprint(spark, [str(tmp_path / "missing")])
    report = str(tmp_path / "report")
    with pytest.raises(FileNotFoundError):
        ar.read_report(spark, report)
    write_report(spark.sql("SELECT 1 AS a, 'é' AS b"), report)
    assert [tuple(r) for r in ar.read_report(spark, report).collect()] == [(1, "é")]
    ar.publish_text(spark, str(tmp_path / "note.json"), "one")
    ar.publish_text(spark, str(tmp_path / "note.json"), "two")
    assert ar.read_text(spark, str(tmp_path / "note.json")) == "two"
    assert not [f for f in os.listdir(tmp_path) if f.startswith("note.json.")]


def test_reports_on_derived_rows_join_the_driver_tables_once(spark, monkeypatch):
    from shipgraph.plans import catalog
    monkeypatch.setattr(catalog, "risk_nodes", lambda spark, sf_dir: spark.createDataFrame(
        [("NAT001", 0.5), ("NAT002", 0.4), ("NAT003", 0.3), ("NAT004", 0.2)],
        "facility string, structural_risk_score double"))
    out = catalog.q_hub_exposure(spark, "/root/testdata/sf0.001")
    files = out.inputFiles()
    assert files and all("/derived_stats/" in f for f in files)
    assert out.first()["affected_trips"] > 0


def test_a_split_is_written_without_sorting_the_rows_by_it(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter
    from shipgraph.sources.sinks import WRITERS, write_table
    seen, plain = [], DataFrameWriter.parquet

    def parquet(self, *args, **kwargs):
        seen.append(int(spark.conf.get(WRITERS, "0")))
        return plain(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    before = spark.conf.get(WRITERS, None)
    rows = spark.range(40).withColumn("data", F.concat(F.lit("s"), (F.col("id") % 20).cast("string")))
    write_table(rows, str(tmp_path / "out"), partition_by=["data"])
    assert seen[0] >= 2 and spark.conf.get(WRITERS, None) == before
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.id, r.data) for r in back.collect()) == [(i, f"s{i % 20}") for i in range(40)]
