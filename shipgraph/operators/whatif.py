"""Scenario (what-if) evaluations: every scenario's aggregates in one pass over
the shipments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corridor import top_k

# fixed values: hub-upgrade delay-reduction scenarios (fractions)
UPGRADE_SCENARIOS = (("worst_case", 0.10), ("expected", 0.20), ("best_case", 0.35))


def hub_upgrade_whatif(shipments: DataFrame, nodes_with_risk: DataFrame, n_hubs: int = 3,
                       scenarios=UPGRADE_SCENARIOS) -> DataFrame:
    """IMP1 (deterministic re-aim): cut actual time by r on trips touching the
    top-``n_hubs`` risk hubs and recount breaches (actual > cutoff).  Per
    scenario: affected trips, breaches before/after on them, breaches avoided,
    % reduction and the new overall breach rate."""
    hubs = top_k(nodes_with_risk, n_hubs, "structural_risk_score", ["facility"])
    h = F.broadcast(hubs.select(F.col("facility").alias("_h")))    # n_hubs rows
    t = (shipments.join(h, shipments.source_center == h._h, "left").withColumnRenamed("_h", "_a")
                  .join(h, F.col("destination_center") == h._h, "left")
                  .withColumn("_touch", F.col("_a").isNotNull() | F.col("_h").isNotNull()))
    touch, plain = F.col("_touch"), F.coalesce(F.col("is_sla_breach"), F.lit(False))
    aggs = [F.count(F.when(touch, 1)).alias("affected_trips"),
            F.count(F.when(touch & plain, 1)).alias("breaches_before")]
    parts = []
    for i, (name, r) in enumerate(scenarios):
        new = F.when(touch, F.coalesce(F.col("actual_time") * (1 - F.lit(float(r)))
                                       > F.col("cutoff_factor"), F.lit(False))).otherwise(plain)
        aggs += [F.count(F.when(touch & new, 1)).alias(f"_after{i}"),
                 (F.avg(new.cast("double")) * 100).alias(f"_rate{i}")]
        parts.append(f"'{name}', {float(r)!r}D, _after{i}, _rate{i}")
    row = t.agg(*aggs).selectExpr(
        "affected_trips", "breaches_before", f"stack({len(parts)}, {', '.join(parts)}) AS "
        "(scenario, reduction, breaches_after, new_overall_breach_rate)")
    return (row.select("scenario", "affected_trips", "breaches_before", "breaches_after",
                       "new_overall_breach_rate",
                       (F.col("reduction") * 100).alias("delay_reduction_pct"))
               .withColumn("breaches_avoided", F.col("breaches_before") - F.col("breaches_after"))
               .withColumn("pct_breach_reduction",
                           F.when(F.col("breaches_before") > 0,
                                  F.col("breaches_avoided") / F.col("breaches_before") * 100)))
