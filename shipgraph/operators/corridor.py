"""Corridor (source → destination) aggregation and corridor-level reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import entropy_terms, exact_mean, rate
from ..functions.quantile import group_quantiles

KEYS = ["source_center", "destination_center"]
# fixed values: route types of the reference data
ROUTE_TYPES = ("FTL", "Carting")
BOTTLENECK_RATIO = 1.5
DELAYED_RATIO = 1.20
MIN_TRIPS = 5


def route_type_entropy(route_type: Column | None = None,
                       categories=ROUTE_TYPES) -> Column:
    """Aggregate: base-2 entropy of the route-type mix inside a group.

    With a known category set the shares come from conditional counts in the
    same aggregation (no second shuffle).  Values outside ``categories`` are
    counted in the denominator, so use :func:`categorical_entropy` when the
    category set is open.
    """
    route_type = F.col("route_type") if route_type is None else route_type
    n = F.count(route_type)
    terms = [entropy_terms(F.count(F.when(route_type == c, 1)) / n) for c in categories]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return -total


def categorical_entropy(df: DataFrame, keys: list[str], column: str,
                        alias: str = "entropy") -> DataFrame:
    """General two-level entropy for an open category set: counts per
    (keys, value) – pre-aggregated map-side – then shares per key."""
    counts = (df.where(F.col(column).isNotNull())
                .groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n")))
    return (counts.groupBy(*keys)
                  .agg(F.sum("_n").alias("_t"),
                       F.collect_list(F.col("_n")).alias("_ns"))
                  .select(*keys, (-F.aggregate(
                      "_ns", F.lit(0.0),
                      lambda acc, n: acc + entropy_terms(n / F.col("_t")))).alias(alias)))


def corridor_stats(df: DataFrame, method: str = "exact") -> DataFrame:
    """AGG1+AGG2: all corridor statistics in one shuffle on (src, dst)."""
    aggs = [
        F.count("trip_uuid").alias("trip_count"),
        exact_mean(F.col("actual_time")).alias("mean_actual_time"),
        F.avg("delay_ratio").alias("mean_delay_ratio"),
        F.stddev_samp("delay_ratio").alias("std_delay_ratio"),
        F.avg(F.col("is_sla_breach").cast("double")).alias("sla_breach_rate"),
        F.avg(F.col("is_delayed").cast("double")).alias("chronic_delay_rate"),
        F.avg((F.col("route_type") == "FTL").cast("double")).alias("ftl_share"),
        route_type_entropy().alias("route_type_entropy"),
    ]
    specs = [("actual_time", 0.5, "median_actual_time"),
             ("osrm_time", 0.5, "median_osrm_time"),
             ("delay_ratio", 0.5, "median_delay_ratio"),
             ("delay_pct", 0.5, "delay_pct"),
             ("actual_distance_to_destination", 0.5, "median_distance")]
    g = group_quantiles(df, KEYS, specs, aggs, method)
    return g.select(
        *KEYS, "trip_count", "median_actual_time", "mean_actual_time", "median_osrm_time",
        "median_delay_ratio", "mean_delay_ratio", "std_delay_ratio", "delay_pct",
        "sla_breach_rate", "chronic_delay_rate", "median_distance", "ftl_share",
        "route_type_entropy",
        (F.col("median_delay_ratio") > BOTTLENECK_RATIO).alias("is_bottleneck_corridor"))


def delayed_corridors(corridors: DataFrame, ratio: float = DELAYED_RATIO,
                      min_trips: int = MIN_TRIPS) -> DataFrame:
    """FLT4 + FEA12: chronically delayed corridors with audit columns."""
    return (corridors
            .where((F.col("median_delay_ratio") > ratio) & (F.col("trip_count") >= min_trips))
            .withColumn("delay_pct_over_osrm", (F.col("median_delay_ratio") - 1) * 100)
            .withColumn("revenue_risk_proxy", F.col("trip_count") * F.col("sla_breach_rate"))
            .withColumn("corridor_label", F.concat(F.right("source_center", F.lit(8)),
                                                   F.lit(" → "),
                                                   F.right("destination_center", F.lit(8))))
            .withColumn("dominant_route_type",
                        F.when(F.col("ftl_share") > 0.5, "FTL").otherwise("Carting")))


def top_k(df: DataFrame, k: int, by: str, tie_keys=KEYS, ascending: bool = False) -> DataFrame:
    """``nlargest``/``nsmallest`` with a total-order tie-break (TakeOrderedAndProject:
    each task keeps its own top k, the driver merges k·tasks rows)."""
    o = F.col(by).asc() if ascending else F.col(by).desc()
    return df.orderBy(o, *[F.col(c).asc() for c in tie_keys]).limit(k)


def route_type_corridors(df: DataFrame, method: str = "exact") -> DataFrame:
    """AGG7/GRF4: per route type corridor graphs in a single shuffle."""
    return group_quantiles(
        df, ["route_type", *KEYS], [("delay_ratio", 0.5, "median_delay")],
        [F.count("trip_uuid").alias("trip_count"),
         F.avg(F.col("is_sla_breach").cast("double")).alias("sla_rate")], method)


# fixed values: time-of-day slots, half-open hour ranges
TIME_SLOTS = (("night_00_06", 0, 6), ("morning_06_12", 6, 12),
              ("afternoon_12_18", 12, 18), ("evening_18_24", 18, 24))


def time_slot(hour: Column | None = None) -> Column:
    hour = F.col("hour") if hour is None else hour
    expr = None
    for name, lo, hi in TIME_SLOTS:
        cond = (hour >= lo) & (hour < hi)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr


def temporal_corridors(df: DataFrame, method: str = "exact") -> DataFrame:
    """FLT6/AGG8/GRF5: four time-slot corridor graphs in one shuffle; rows
    with an unknown hour belong to no slot."""
    sl = df.withColumn("slot", time_slot()).where(F.col("slot").isNotNull())
    return group_quantiles(sl, ["slot", *KEYS], [("delay_ratio", 0.5, "median_delay")],
                           [F.count("trip_uuid").alias("trip_count")], method)


def corridor_explorer(corridors: DataFrame, min_trips: int = 10, min_delay_pct: float = 20,
                      route_type: str = "All", limit: int = 50) -> DataFrame:
    """FLT5: the interactive corridor filter (top ``limit`` by delay %)."""
    f = (corridors.withColumn("delay_pct", (F.col("median_delay_ratio") - 1) * 100)
                  .where(F.col("trip_count") >= min_trips)
                  .where(F.col("delay_pct") >= min_delay_pct))
    if route_type == "FTL":
        f = f.where(F.col("ftl_share") > 0.5)
    elif route_type == "Carting":
        f = f.where(F.col("ftl_share") <= 0.5)
    elif route_type != "All":
        raise ValueError(f"route_type must be All, FTL or Carting, got {route_type!r}")
    return top_k(f, limit, "delay_pct").select(
        *KEYS, "trip_count", "median_delay_ratio", "delay_pct", "sla_breach_rate",
        "median_distance")


def corridor_kpis(corridors: DataFrame, ratio: float = DELAYED_RATIO) -> DataFrame:
    """AGG24: total corridors, chronic count/share, worst delay %, mean breach."""
    n = F.count(F.lit(1))
    chronic = F.count(F.when(F.col("median_delay_ratio") > ratio, 1))
    return corridors.agg(
        n.alias("total_corridors"), chronic.alias("chronic_corridors"),
        (chronic / n * 100).alias("chronic_pct"),
        ((F.max("median_delay_ratio") - 1) * 100).alias("worst_delay_pct"),
        (F.avg("sla_breach_rate") * 100).alias("avg_sla_breach_pct"))
