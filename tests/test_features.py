"""Statistics from the training rows alone: no target of a test row reaches a feature."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shipgraph.operators.clean import clean_shipments
from shipgraph.operators.corridor import corridor_stats
from shipgraph.operators.facility import facility_stats
from shipgraph.operators.features import feature_store, graph_features

SF = "/root/testdata/sf0.001"
TRAINING = "data = 'training'"


def store(rows, by_training):
    clean = clean_shipments(rows, stats_where=TRAINING if by_training else None)
    known = clean.where(TRAINING) if by_training else clean
    nodes = facility_stats(known).withColumn("structural_risk_score", F.col("avg_delay_ratio"))
    corridors = corridor_stats(known).withColumn("cross_community", F.lit(0))
    out = feature_store(clean, nodes, corridors, keys=("row_id", "data"), stats=known)
    return {r.row_id: r for r in out.collect()}


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_test_targets_reach_no_feature(spark):
    from shipgraph.plans.catalog import derived
    rows = derived(spark, SF)
    later = F.when(F.expr(TRAINING), 1.0).otherwise(7.5)
    moved = rows.withColumn("actual_time", F.col("actual_time") * later) \
                .withColumn("delay_ratio", F.col("delay_ratio") * later)
    for by_training in (True, False):
        a, b = store(rows, by_training), store(moved, by_training)
        assert a.keys() == b.keys() and {r.data for r in a.values()} == {"training", "test"}
        names = [n for n in next(iter(a.values())).asDict() if n != "actual_time"]
        same = all(a[k][n] == b[k][n] for k in a for n in names)
        assert same == by_training
        kept = all(a[k].actual_time == b[k].actual_time for k in a if a[k].data == "training")
        assert kept or not by_training


def test_unknown_sources_of_statistics_are_refused(spark):
    from shipgraph.plans.catalog import feature_inputs
    with pytest.raises(ValueError, match="stats_from"):
        feature_inputs(spark, SF, stats_from="test")
    with pytest.raises(ValueError, match="community"):
        feature_inputs(spark, SF, community="guessed")


def test_correlation_is_one_matrix_and_not_one_aggregate_a_pair(spark):
    from shipgraph.operators.features import feature_correlation
    rng = np.random.default_rng(3)
    a = rng.normal(5, 2, 300)
    data = np.column_stack([a, 3 * a + rng.normal(0, 1, 300), 1e-14 * rng.random(300),
                            np.full(300, 0.1)])
    df = spark.createDataFrame(data.tolist(), "a double, b double, small double, same double")
    out = feature_correlation(df, ["a", "b", "small", "same"])
    assert "covar_pop" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in out.collect()}
    assert len(got) == 6
    want = np.corrcoef(data[:, :3], rowvar=False)
    assert got["a", "b"] == pytest.approx(want[0, 1], rel=1e-10)
    assert got["b", "small"] == pytest.approx(want[1, 2], rel=1e-9)
    assert all(got[x, "same"] is None for x in ("a", "b", "small"))
    none = feature_correlation(df.limit(0), ["a", "b"]).collect()
    assert [tuple(r) for r in none] == [("a", "b", None)]


LOOKUPS = ["betweenness", "structural_risk_score", "community_id"]


def lookup_tables(spark):
    rows = spark.createDataFrame(
        [(1, "kiln", "mill"), (2, "mill", "kiln"), (3, "dock", "mill"), (4, None, "kiln")],
        "id int, source_center string, destination_center string")
    nodes = spark.createDataFrame(
        [("kiln", 0.2, 0.5, 3), ("mill", None, 0.1, 4), ("shed", 0.6, None, 9)],
        "facility string, betweenness double, structural_risk_score double, community_id int")
    corridors = spark.createDataFrame(
        [("kiln", "mill", 2.0, None, 1), ("mill", "kiln", 3.0, 0.4, 0), ("shed", "mill", 7.0, 0.8, 0)],
        "source_center string, destination_center string, median_delay_ratio double, "
        "sla_breach_rate double, cross_community int")
    return rows, nodes, corridors


@pytest.mark.parametrize("fill,unknown,missing", [("corridor_median", (3.0, 0.6, 0), 0.6),
                                                  ("row_median", (2.5, 0.4, 0), 0.4)])
def test_lookups_fall_back_to_medians(spark, fill, unknown, missing):
    got = {r.id: r for r in graph_features(*lookup_tables(spark), fill).collect()}
    assert [got[i].src_betweenness for i in (1, 2, 3, 4)] == pytest.approx([0.2, 0.4, 0.4, 0.4])
    assert [got[i].dst_structural_risk_score for i in (1, 2, 3, 4)] == [0.1, 0.5, 0.1, 0.5]
    assert [got[i].src_community_id for i in (1, 2, 3, 4)] == [3.0, 4.0, 4.0, 4.0]
    seen = [(r.corr_median_delay_ratio, r.corr_sla_breach_rate, r.cross_community_flag)
            for r in (got[i] for i in (1, 2, 3, 4))]
    assert seen == [(2.0, pytest.approx(missing), 1), (3.0, 0.4, 0),
                    *[(unknown[0], pytest.approx(unknown[1]), unknown[2])] * 2]


def test_a_lookup_adds_one_column_to_the_joined_rows(spark):
    """Each value and median as a column of the joins made their code too long to compile."""
    def joins(plan):
        below = plan.children()
        found = [plan.output().size()] if plan.nodeName() == "Join" else []
        return found + [n for i in range(below.size()) for n in joins(below.apply(i))]

    rows, nodes, corridors = lookup_tables(spark)
    plan = graph_features(rows, nodes, corridors)._jdf.queryExecution().optimizedPlan()
    widths = [n for n in joins(plan)]
    assert widths and max(widths) <= max(len(nodes.columns) + len(LOOKUPS),
                                         len(rows.columns) + 3 + 2 + 2)
