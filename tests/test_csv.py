"""Records from CSV with faults, the sample fallback, and missing features."""

import datetime

import pytest
from pyspark.sql import functions as F

from shipgraph.operators.features import feature_columns
from shipgraph.sources import csv
from shipgraph.sources.tables import RAW_COLUMNS


def line(**values):
    good = {"od_start_time": "2021-05-06 07:08:09", "actual_time": "12.5", "osrm_time": "3",
            "is_cutoff": "true", "trip_uuid": "T1"}
    return ",".join({**good, **values}.get(c, "") for c in RAW_COLUMNS)


def test_bad_values_and_records(spark, tmp_path):
    rows = [line(), line(trip_uuid="T2", od_start_time="06/05/2021", is_cutoff="maybe"),
            line(trip_uuid="T3", actual_time="fast"), line(trip_uuid="T4", osrm_time=""),
            "T5,too,short", line(trip_uuid="T6") + ",one,too,many"]
    (tmp_path / "in.csv").write_text("\n".join([",".join(RAW_COLUMNS), *rows]) + "\n")
    good, bad = csv.read_shipments_csv(spark, str(tmp_path / "in.csv"))
    got = {r["trip_uuid"]: r for r in good.collect()}
    assert set(got) == {"T1", "T2"} and good.columns == list(RAW_COLUMNS)
    assert got["T1"]["od_start_time"] == datetime.datetime(2021, 5, 6, 7, 8, 9)
    assert (got["T1"]["actual_time"], got["T1"]["is_cutoff"]) == (12.5, True)
    assert got["T2"]["od_start_time"] is None and got["T2"]["is_cutoff"] is None
    reasons = sorted(r["reason"] for r in bad.collect())
    assert reasons == ["actual_time is not a number", "malformed record", "malformed record",
                       "osrm_time is not a number"]
    with pytest.raises(FileNotFoundError):
        csv.read_shipments_csv(spark, str(tmp_path / "none.csv"))


def test_sample_is_read_where_the_records_lack(spark, tmp_path):
    full = spark.range(4000).select(F.concat(F.lit("T"), F.col("id").cast("string"))
                                    .alias("trip_uuid"))
    sample = csv.hash_sample(full)
    assert 60 < sample.count() < 200
    assert {r[0] for r in sample.collect()} == {
        r[0] for r in csv.hash_sample(full.repartition(7)).collect()}
    sample.write.parquet(str(tmp_path / "sample"))
    got = csv.shipments_or_sample(spark, str(tmp_path / "full"), str(tmp_path / "sample"))
    assert got.where("NOT is_sample").isEmpty() and got.count() == sample.count()
    full.write.parquet(str(tmp_path / "full"))
    got = csv.shipments_or_sample(spark, str(tmp_path / "full"), str(tmp_path / "sample"))
    assert got.where("is_sample").isEmpty() and got.count() == 4000
    with pytest.raises(FileNotFoundError):
        csv.shipments_or_sample(spark, str(tmp_path / "a"), str(tmp_path / "b"))


def test_missing_features_are_zero(spark):
    df = spark.createDataFrame([(1, None)], "a int, b double")
    assert tuple(df.select(*feature_columns(df, ["a", "b", "c"])).first()) == (1.0, 0.0, 0.0)


def test_percent_text(spark):
    rows = spark.createDataFrame([(12.34,), (None,), (80.0,)], "x double").select(
        csv.percent_text(F.col("x"))).collect()
    assert [r[0] for r in rows] == ["12.3%", None, "80.0%"]
