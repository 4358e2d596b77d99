"""Metrics, lift, winsorizing, entropy and quantiles against results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from shipgraph.operators.clean import winsorize_by_group
from shipgraph.operators.corridor import categorical_entropy, route_type_entropy
from shipgraph.operators.evaluate import blend_search, graph_advantage, regression_metrics


def metrics(spark, y, p, **kw):
    df = spark.createDataFrame(list(zip(map(float, y), map(float, p))),
                               "actual_time double, prediction double")
    return regression_metrics(df, **kw).first().asDict()


def test_exact_prediction(spark):
    m = metrics(spark, [12, 75, 310], [12, 75, 310])
    assert (m["mae"], m["rmse"], m["r2"], m["within_15pct"]) == (0, 0, 1, 100)


def test_errors_by_hand(spark):
    m = metrics(spark, [50, 80, 120], [44, 80, 129])
    assert m["mae"] == 5 and m["rmse"] == round(math.sqrt(39), 3)   # errors 6, 0, 9
    # label mean 250/3: squared deviations sum to 7400/3
    assert m["r2"] == pytest.approx(1 - 117 / (7400 / 3), abs=1e-3)


def test_constant_label(spark):
    m = metrics(spark, [7, 7], [5, 8])
    assert m["rmse"] == round(math.sqrt(2.5), 3) and m["r2"] == 0.0


def test_tolerances(spark):
    m = metrics(spark, [100, 100, 100, 100], [86, 118, 119, 150])
    assert m["within_15pct"] == 25 and m["within_20pct"] == 75


def test_keys_and_label(spark):
    m = metrics(spark, [3, 6, 9], [4, 5, 9], model="third")
    assert m["model"] == "third"
    assert {"mae", "rmse", "mape", "r2", "within_15pct", "within_20pct"} <= set(m)


def test_lift(spark):
    cols = "rmse double, mae double, within_15pct double"
    plain = spark.createDataFrame([(80.0, 40.0, 30.0)], cols)
    better = spark.createDataFrame([(60.0, 38.0, 42.0)], cols)
    r = graph_advantage(plain, better).first()
    assert (r.rmse_improvement_pct, r.mae_improvement_pct) == (25, 5)
    assert r.within15_improvement_pp == 12 and len(r.asDict()) == 9
    same = graph_advantage(plain, plain).first()
    assert same.rmse_improvement_pct == 0 and same.within15_improvement_pp == 0


def test_winsorize_single_group(spark):
    df = spark.createDataFrame([(v, "solo") for v in (12, 14, 15, 17, 640)], "v long, g string")
    out = winsorize_by_group(df, "v", "g", 0.25, 0.75)
    # five values: the quartiles are the second and the fourth
    assert sorted(r.v for r in out.collect()) == [14, 14, 15, 17, 17]
    assert dict(out.dtypes)["v"] == "double"
    assert df.agg(F.max("v")).first()[0] == 640          # input unchanged


def test_winsorize_per_group(spark):
    rows = [(4.0, "sea"), (8.0, "sea"), (100.0, "sea"), (1.0, "air"), (2.0, "air"),
            (7.0, None), (9.0, None), (None, "sea")]
    df = spark.createDataFrame(rows, "v double, g string")
    out = winsorize_by_group(df, "v", "g", None, 0.5)
    assert sorted(((r.g or "", r.v) for r in out.collect()), key=str) == sorted(
        [("sea", 4.0), ("sea", 8.0), ("sea", 8.0), ("air", 1.0), ("air", 1.5), ("", 7.0),
         ("", 8.0), ("sea", None)], key=str)


def test_winsorize_again_changes_nothing(spark):
    df = spark.createDataFrame([(float(v * v), "q") for v in range(41)], "v double, g string")
    once = winsorize_by_group(df, "v", "g", 0.05, 0.95)
    assert once.agg(F.min("v"), F.max("v")).first() == (4.0, 1444.0)   # ranks 2 and 38
    twice = winsorize_by_group(once, "v", "g", 0.05, 0.95)
    assert twice.agg(F.sum("v")).first() == once.agg(F.sum("v")).first()


def test_entropy(spark):
    rows = [("mixed", "FTL")] * 1 + [("mixed", "Carting")] * 3 + [("pure", "Carting")] * 2
    df = spark.createDataFrame(rows, "k string, route_type string")
    want = {"mixed": 0.25 * math.log2(4) + 0.75 * math.log2(4 / 3), "pure": 0.0}
    for out in (df.groupBy("k").agg(route_type_entropy().alias("e")),
                categorical_entropy(df, ["k"], "route_type", "e")):
        assert {r.k: r.e for r in out.collect()} == pytest.approx(want, abs=1e-8)


def test_blend_one_pass(spark):
    df = spark.createDataFrame([(10.0, 10.0, 0.0), (20.0, 20.0, 0.0)],
                               "actual_time double, a double, b double")
    r = blend_search(df, "a", "b").collect()
    best = [x for x in r if x.is_best == 1]
    assert len(best) == 1 and best[0].weight == max(x.weight for x in r)


def test_distributed_quantile_matches_percentile(spark):
    from shipgraph.functions.quantile import global_quantiles
    df = spark.range(0, 1001).select(((F.col("id") * 7919) % 1009 / 3.0).alias("x")) \
              .repartition(5)
    for p in (0.01, 0.25, 0.5, 0.99):
        a = global_quantiles(df, [("x", p, "q")], method="distributed").first().q
        b = df.agg(F.percentile("x", p)).first()[0]
        assert a == pytest.approx(b, rel=1e-12)


def test_distributed_group_quantiles(spark):
    from shipgraph.functions.quantile import group_quantiles
    df = spark.range(0, 2000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise("cold")
        .alias("g"), ((F.col("id") * 7919) % 503 / 7.0).alias("x"),
        F.when(F.col("id") % 5 > 0, F.col("id") * 1.0).alias("y")).repartition(6)
    specs = [("x", 0.01, "a"), ("x", 0.5, "b"), ("y", 0.99, "c"), ("y", 1.0, "d")]
    how = {m: {r.g: r for r in group_quantiles(df, ["g"], specs, [F.count("y").alias("n")],
                                               method=m).collect()}
           for m in ("exact", "distributed")}
    assert set(how["exact"]) == set(how["distributed"]) == {"hot", "cold", None}
    for g, want in how["exact"].items():
        got = how["distributed"][g]
        assert got.n == want.n
        for c in "abcd":
            assert got[c] == pytest.approx(want[c], rel=1e-13)
    empty = group_quantiles(df.where("false"), ["g"], specs, method="distributed")
    assert empty.count() == 0
