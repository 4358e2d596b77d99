"""Bracketed quantiles against numpy's, with few and many values in a bracket."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shipgraph.functions import quantile as qu

PS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def table(spark, groups):
    rows = [(g, None if x is None else float(x)) for g, xs in groups.items() for x in xs]
    return spark.createDataFrame(rows, "g string, x double").repartition(5)


def held(got, groups, ps=PS):
    assert set(got) == set(groups)
    for g, xs in groups.items():
        xs = [x for x in xs if x is not None]
        for p, v in zip(ps, got[g]):
            if not len(xs):
                assert v is None
            else:
                assert math.isclose(v, float(np.quantile(xs, p)), rel_tol=1e-12, abs_tol=1e-12)


def cases():
    rng = np.random.default_rng(1)
    return {"normal": rng.normal(size=7000), "ties": rng.integers(0, 6, 7000),
            "two": np.repeat([1.0, 2.0], 2500), "one": [3.5], "none": [None, None],
            None: rng.exponential(size=40), "skewed": np.append(np.zeros(6000), rng.random(30)),
            "mixed": [*rng.random(3000), *[None] * 20, *np.full(3000, 0.5)]}


@pytest.mark.parametrize("k, few", [(2000, 50_000), (64, 300), (16, 20), (8, 1)])
def test_groups_of_any_shape(spark, k, few):
    groups = cases()
    df = table(spark, groups)
    specs = [("x", p, f"q{i}") for i, p in enumerate(PS)]
    out = qu.distributed_quantiles(df, ["g"], specs, k=k, few=few)
    held({r["g"]: [r[f"q{i}"] for i in range(len(PS))] for r in out.collect()}, groups)


def test_whole_table_with_other_aggregates(spark):
    xs = np.random.default_rng(5).normal(size=5000)
    df = table(spark, {"a": xs})
    row = qu.global_quantiles(df, [("x", 0.5, "m"), (F.col("x") * 2, 0.9, "n")],
                              [F.count(F.lit(1)).alias("c")], method="distributed").first()
    assert row["c"] == 5000 and math.isclose(row["m"], np.quantile(xs, 0.5))
    assert math.isclose(row["n"], np.quantile(xs * 2, 0.9))
    none = qu.global_quantiles(df.where("false"), [("x", 0.5, "m")], method="distributed")
    assert [tuple(r) for r in none.collect()] == [(None,)]


def test_a_sketch_that_misses_its_rank_is_opened(spark, monkeypatch):
    monkeypatch.setattr(qu, "sketch_error", lambda k: 0.0)
    groups = {g: v for g, v in cases().items() if g in ("normal", "skewed")}
    out = qu.distributed_quantiles(table(spark, groups), ["g"],
                                   [("x", p, f"q{i}") for i, p in enumerate(PS)], k=8)
    held({r["g"]: [r[f"q{i}"] for i in range(len(PS))] for r in out.collect()}, groups)


def test_no_row_is_shuffled(spark):
    df = table(spark, cases()).persist()
    x = F.col("x")
    plan = df.groupBy("g").agg(qu._quantiles_of(x, [0.5], 200))._jdf.queryExecution() \
        .executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Sort" not in plan.replace(
        "SortAggregate", "")


def test_route_quantiles_send_the_bounds_to_the_rows(spark):
    """The rows aren't dealt by route type, which would put them into two tasks."""
    from shipgraph.operators.clean import route_quantiles
    rows = spark.range(4000).selectExpr(
        "CASE WHEN id % 4 = 0 THEN 'FTL' WHEN id % 4 < 3 THEN 'Carting' END AS route_type",
        "CAST(id AS DOUBLE) AS actual_time", "id / 7.0D AS delay_ratio")
    out = route_quantiles(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    found = {r["route_type"]: r["n_above_q99"] for r in out.collect()}
    assert found == {"FTL": 10, "Carting": 20}


@pytest.mark.parametrize("few", [5000, 3])
def test_hundreds_of_groups_have_the_medians_of_percentile(spark, monkeypatch, few):
    monkeypatch.setitem(qu.HOT, "few", few)
    df = spark.range(9000).select(
        F.when(F.col("id") % 300 > 0, F.concat(F.lit("g"), (F.col("id") % 300).cast("string")))
        .alias("g"), (F.col("id") % 2).alias("h"),
        F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id"), F.lit(1000)) / 8.0).alias("x"),
        F.when(F.col("id") % 300 != 5, (F.col("id") % 3).cast("double")).alias("y"))
    specs = [("x", 0.5, "mx"), ("y", 0.5, "my")]
    n = [F.count(F.lit(1)).alias("n")]
    got = qu.group_quantiles(df, ["g", "h"], specs, n, "hot")
    want = qu.group_quantiles(df, ["g", "h"], specs, n, "exact")
    assert got.columns == want.columns and got.count() == 300
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_baseline_medians_are_not_gathered_in_a_task(spark, monkeypatch, tmp_path):
    from shipgraph.plans import catalog
    rows = spark.range(60).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'test' ELSE 'training' END AS data", "string(id) AS trip_uuid",
        "'FTL' AS route_type", "CASE WHEN id > 8 THEN 'a' END AS source_center",
        "CASE WHEN id % 9 = 0 THEN 'new' ELSE 'b' END AS destination_center",
        "double(id + 3) AS actual_time", "2D AS osrm_time", "(id + 3) / 2D AS delay_ratio")
    (tmp_path / "input").write_text("baseline")
    monkeypatch.setattr(catalog, "cleaned", lambda spark, sf_dir: rows)
    monkeypatch.setattr(catalog, "shipment_files", lambda sf_dir: [str(tmp_path / "input")])
    out = catalog.baseline_predictions(spark, "")
    assert "percentile" not in out._jdf.queryExecution().toString()
    data = rows.where("data = 'training'").toPandas()
    whole = float(data["delay_ratio"].median())
    known = float(data[data["source_center"] == "a"]["delay_ratio"].median())
    got = {r["trip_uuid"]: r["corridor_pred"] for r in out.collect()}
    assert len(got) == 20 and got["3"] == 2 * whole and got["9"] == 2 * whole
    assert got["12"] == got["57"] == 2 * known
