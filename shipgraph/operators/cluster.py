"""Corridor clustering (KMeans on standardised delay profiles) and naming."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLUSTER_FEATURES = ["median_delay_ratio", "trip_count", "sla_breach_rate", "median_distance",
                    "ftl_share", "route_type_entropy"]


def corridor_clusters(corridors: DataFrame, k: int = 5, seed: int = 42, n_init: int = 10
                      ) -> DataFrame:
    """FEA13: KMeans (k) on standardised features (NULL → 0); ``n_init``
    seeded restarts, keeping the lowest within-cluster cost."""
    x = corridors.na.fill(0.0, subset=CLUSTER_FEATURES)
    prep = Pipeline(stages=[
        VectorAssembler(inputCols=CLUSTER_FEATURES, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True)]).fit(x)
    z = prep.transform(x).persist()
    best, best_cost = None, None
    for i in range(n_init):
        m = KMeans(k=k, seed=seed + i, featuresCol="_z", predictionCol="cluster").fit(z)
        cost = m.summary.trainingCost
        if best_cost is None or cost < best_cost:
            best, best_cost = m, cost
    return best.transform(z).drop("_raw", "_z")


def cluster_profile(clustered: DataFrame) -> DataFrame:
    """AGG25: corridor count and mean profile per cluster (rounded 3)."""
    return clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("corridor_count"),
        F.round(F.avg("median_delay_ratio"), 3).alias("avg_delay_ratio"),
        F.round(F.avg("sla_breach_rate"), 3).alias("avg_sla_breach"),
        F.round(F.avg("median_distance"), 3).alias("avg_distance_km"),
        F.round(F.avg("trip_count"), 3).alias("avg_trips"),
        F.round(F.avg("ftl_share"), 3).alias("ftl_dominance"))


def cluster_names(profile: DataFrame) -> DataFrame:
    """FEA14: arg-max naming; a later rule overwrites an earlier one on the
    same cluster; the rest are 'Moderate Risk (C#)'.  Ties → lowest id."""
    am = profile.agg(*[F.max_by("cluster", F.struct(F.col(c), -F.col("cluster"))).alias(f"_{c}")
                       for c in ("avg_delay_ratio", "avg_trips", "avg_sla_breach",
                                 "avg_distance_km")])
    c = F.col("cluster")
    name = (F.when(c == F.col("_avg_distance_km"), "Long-Haul Delay")
             .when(c == F.col("_avg_sla_breach"), "SLA Critical")
             .when(c == F.col("_avg_trips"), "High-Volume Risk")
             .when(c == F.col("_avg_delay_ratio"), "Extreme Delay")
             .otherwise(F.concat(F.lit("Moderate Risk (C"), c.cast("string"), F.lit(")"))))
    return profile.crossJoin(am).withColumn("cluster_name", name).drop(*am.columns)
