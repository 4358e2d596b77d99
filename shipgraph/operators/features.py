"""The 49-column feature store (19 base + 30 graph features)."""

from __future__ import annotations

import math

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.broadcast import bounded
from ..functions.quantile import global_quantiles

# fixed values: feature lists of the reference store, in order
BASE_FEATURES = [
    "route_type_enc", "log_osrm_time", "log_osrm_dist", "log_distance",
    "osrm_speed", "dist_time_ratio",
    "hour", "dow", "month", "is_weekend", "is_rush_hour",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos",
    "network_load_norm", "cutoff_factor",
]
GRAPH_FEATURES = [
    "src_betweenness", "src_pagerank", "src_closeness", "src_structural_risk_score",
    "src_in_degree", "src_out_degree", "src_avg_sla_breach", "src_avg_delay_ratio",
    "src_community_id", "src_hub_score",
    "dst_betweenness", "dst_pagerank", "dst_closeness", "dst_structural_risk_score",
    "dst_in_degree", "dst_out_degree", "dst_avg_sla_breach", "dst_avg_delay_ratio",
    "dst_community_id",
    "corr_median_delay_ratio", "corr_sla_breach_rate", "corr_trip_count",
    "corr_ftl_share", "corr_route_type_entropy", "corr_cross_community",
    "corr_corridor_risk", "cross_community_flag",
    "high_risk_src", "high_risk_dst", "both_high_risk",
]
ALL_FEATURES = BASE_FEATURES + GRAPH_FEATURES
# fixed values: columns looked up in the node and corridor tables
NODE_LOOKUP = ["betweenness", "pagerank", "closeness", "hub_score", "structural_risk_score",
               "in_degree", "out_degree", "community_id", "avg_sla_breach", "avg_delay_ratio"]
CORRIDOR_LOOKUP = ["median_delay_ratio", "sla_breach_rate", "chronic_delay_rate", "trip_count",
                   "ftl_share", "route_type_entropy", "cross_community", "corridor_risk"]
TARGET = "actual_time"


def base_features(df: DataFrame) -> DataFrame:
    """FEA1 + FEA2: encoded route type, log/ratio numerics, cyclical time."""
    two_pi = 2 * math.pi
    return (df
            .withColumn("route_type_enc", (F.col("route_type") == "FTL").cast("int"))
            .withColumn("log_osrm_time", F.log1p("osrm_time"))
            .withColumn("log_osrm_dist", F.log1p("osrm_distance"))
            .withColumn("log_distance", F.log1p("actual_distance_to_destination"))
            .withColumn("osrm_speed", F.col("osrm_distance") / (F.col("osrm_time") / 60 + 1e-5))
            .withColumn("dist_time_ratio",
                        F.col("actual_distance_to_destination") / (F.col("osrm_time") + 1))
            .withColumn("hour_sin", F.sin(two_pi * F.col("hour") / 24))
            .withColumn("hour_cos", F.cos(two_pi * F.col("hour") / 24))
            .withColumn("dow_sin", F.sin(two_pi * F.col("dow") / 7))
            .withColumn("dow_cos", F.cos(two_pi * F.col("dow") / 7))
            .withColumn("month_sin", F.sin(two_pi * F.col("month") / 12))
            .withColumn("month_cos", F.cos(two_pi * F.col("month") / 12)))


def network_load(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """FEA6/JN7/AGG27: trips in the row's hour, normalised by the busiest hour,
    counted over the rows of ``stats`` (by default of ``df``).
    The hourly table has at most 25 rows (24 hours + unknown), so it is
    broadcast; its maximum is folded in by a window over those rows."""
    from pyspark.sql import Window
    hv = ((df if stats is None else stats).where(F.col("hour").isNotNull()).groupBy("hour")
            .agg(F.count("trip_uuid").alias("network_load_hour")))
    hv = hv.withColumn("_max", F.max("network_load_hour").over(Window.partitionBy()))
    j = df.join(F.broadcast(hv), "hour", "left")
    load = F.coalesce(F.col("network_load_hour"), F.lit(0))
    return (j.withColumn("network_load_hour", load)
             .withColumn("network_load_norm", load / F.col("_max"))
             .drop("_max"))


def _with_medians(table: DataFrame, cols: list[str], prefix: str) -> DataFrame:
    return global_quantiles(table, [(c, 0.5, f"{prefix}{c}") for c in cols])


def filled_struct(cols: list[str], name: str, own: str | None = "") -> Column:
    """One struct of the columns as doubles, a missing value being the median ``_m_…``;
    the medians themselves where ``own`` is None."""
    return F.struct(*[(F.col(f"_m_{c}") if own is None else
                       F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"))).alias(c)
                      for c in cols]).alias(name)


def graph_features(df: DataFrame, nodes: DataFrame, corridors: DataFrame,
                   corridor_fill: str = "corridor_median") -> DataFrame:
    """FEA3-5, FEA7, FEA8 (JN4, JN5): node features for both endpoints and
    corridor features; an unknown facility gets the node-table median, an
    unknown corridor the corridor-table median (``corridor_fill='row_median'``
    uses the median over the joined rows instead).  Medians are one-row
    aggregates joined by a one-row cross join.

    The medians are filled in on the tables' own rows and a lookup adds one struct
    to a shipment: with a column for each value and median the generated code of
    the joined rows was too long for the JVM to compile."""
    if corridor_fill not in ("corridor_median", "row_median"):
        raise ValueError("corridor_fill must be corridor_median or row_median")
    ncols = [c for c in NODE_LOOKUP if c in nodes.columns]
    ccols = [c for c in CORRIDOR_LOOKUP if c in corridors.columns]
    n = nodes.count()
    nmed = _with_medians(nodes, ncols, "_m_").select(filled_struct(ncols, "_nm", None))
    filled = nodes.crossJoin(F.broadcast(_with_medians(nodes, ncols, "_m_")))
    src = filled.select(F.col("facility").alias("source_center"), filled_struct(ncols, "_s"))
    dst = filled.select(F.col("facility").alias("destination_center"), filled_struct(ncols, "_d"))
    pair = ["source_center", "destination_center"]
    corr = corridors.select(*pair, F.struct(*[F.col(c).cast("double").alias(c) for c in ccols])
                            .alias("_c"))
    j = (df.join(bounded(src, n), "source_center", "left")
           .join(bounded(dst, n), "destination_center", "left"))
    if corridor_fill == "corridor_median":
        cmed = _with_medians(corridors, ccols, "_m_")
        corr = corridors.crossJoin(F.broadcast(cmed)).select(*pair, filled_struct(ccols, "_c"))
    j = j.join(bounded(corr, corridors.count()), pair, "left")
    if corridor_fill == "row_median":
        cmed = global_quantiles(j, [(F.col(f"_c.{c}"), 0.5, f"_m_{c}") for c in ccols])
    other = nmed.crossJoin(cmed.select(filled_struct(ccols, "_cm", None)))
    j = (j.crossJoin(F.broadcast(other))   # one row
          .withColumn("_s", F.coalesce("_s", "_nm")).withColumn("_d", F.coalesce("_d", "_nm"))
          .withColumn("_c", F.coalesce("_c", "_cm")))
    fill = corridor_fill == "row_median"
    j = j.withColumns({
        **{f"{end}_{c}": F.col(f"_{end[0]}.{c}") for c in ncols for end in ("src", "dst")},
        **{f"corr_{c}": F.coalesce(F.col(f"_c.{c}"), F.col(f"_cm.{c}")) if fill
           else F.col(f"_c.{c}") for c in ccols}}).drop("_s", "_d", "_c", "_nm", "_cm")
    return j.withColumn("cross_community_flag",
                        F.coalesce(F.col("corr_cross_community"), F.lit(0.0)).cast("int"))


def risk_threshold(shipments: DataFrame, nodes: DataFrame, p: float = 0.75) -> DataFrame:
    """One row ``_q75``: the quantile of the shipments' source risk, from the node
    table alone: a source's risk counts as often as it has shipments (a source
    without a node has the nodes' median)."""
    risk = "structural_risk_score"
    trips = shipments.groupBy(F.col("source_center").alias("facility")).agg(
        F.count(F.lit(1)).alias("_n"))
    rows = trips.join(nodes.select("facility", F.col(risk).cast("double").alias("_r")),
                      "facility", "left").crossJoin(F.broadcast(_with_medians(nodes, [risk], "_m_")))
    return rows.agg(F.percentile(F.coalesce("_r", f"_m_{risk}"), F.lit(p), F.col("_n"))
                    .alias("_q75"))


def risk_flags(df: DataFrame, threshold: float | DataFrame | None = None) -> DataFrame:
    """FEA8: high-risk endpoint flags against the row-weighted 75th percentile
    of the source risk (one threshold for both ends): a number, a one-row table
    ``_q75`` (:func:`risk_threshold`), or taken from the rows themselves."""
    if threshold is None:
        threshold = global_quantiles(df, [("src_structural_risk_score", 0.75, "_q75")],
                                     method="distributed")
    if isinstance(threshold, DataFrame):
        df = df.crossJoin(F.broadcast(threshold))  # one row
        thr = F.col("_q75")
    else:
        thr = F.lit(threshold)
    out = (df.withColumn("high_risk_src", F.coalesce(F.col("src_structural_risk_score") > thr,
                                                     F.lit(False)).cast("int"))
             .withColumn("high_risk_dst", F.coalesce(F.col("dst_structural_risk_score") > thr,
                                                     F.lit(False)).cast("int"))
             .withColumn("both_high_risk", F.col("high_risk_src") * F.col("high_risk_dst")))
    return out.drop("_q75")


def feature_store(cleaned: DataFrame, nodes: DataFrame, corridors: DataFrame,
                  keys=("trip_uuid", "data", "route_type", "source_center",
                        "destination_center"), stats: DataFrame | None = None) -> DataFrame:
    """FEA10: cleaned shipments → 49 features (+ keys and target), NULL → 0.

    Medians, hourly load and the risk threshold are those of the rows of
    ``stats``, by default of ``cleaned``.  With training rows there, and node and
    corridor tables built from them alone, no feature of any row depends on a
    target outside the training rows.  Hours that no training row has have load 0;
    facilities and corridors that none has get the tables' medians."""
    stats = cleaned if stats is None else stats
    med = global_quantiles(stats, [("cutoff_factor", 0.5, "_cf")], method="distributed")
    df = (cleaned.crossJoin(F.broadcast(med))
                 .withColumn("cutoff_factor", F.coalesce("cutoff_factor", "_cf")).drop("_cf"))
    df = base_features(df)
    df = network_load(df, stats)
    df = graph_features(df, nodes, corridors)
    df = risk_flags(df, risk_threshold(stats, nodes))
    return df.select(*keys, TARGET, *feature_columns(df, ALL_FEATURES))


def feature_columns(df: DataFrame, names: list[str]) -> list:
    """PRJ12+PRJ13: the named features as doubles; NULL, and a column that ``df``
    lacks, is 0.0."""
    return [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns
             else F.lit(0.0)).alias(c) for c in names]


def feature_correlation(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """FEA11: Pearson correlation of each feature pair (i < j), long form.
    Constant columns, and ones with a missing value, give NULL.

    The columns are brought to mean 0 and deviation 1 first, so that small scales
    keep their digits; the products of all pairs are then summed up as one matrix
    per task.  The driver sees a matrix of as many rows as there are columns."""
    cols = columns or ALL_FEATURES[:25]
    spark = features.sparkSession
    rows = VectorAssembler(inputCols=cols, outputCol="_raw", handleInvalid="keep").transform(
        features.select(*[F.col(c).cast("double").alias(c) for c in cols])).select("_raw")
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    schema = "feature_a string, feature_b string, corr double"
    if rows.isEmpty():
        return spark.createDataFrame([(cols[i], cols[j], None) for i, j in pairs], schema)
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True).fit(rows)
    spread = scaler.std.toArray()
    known = [i for i, s in enumerate(spread) if s > 0]
    found = {}
    if known:
        matrix = Correlation.corr(scaler.transform(rows).select("_x"), "_x").first()[0].toArray()
        found = {(i, j): float(matrix[i, j]) for i in known for j in known
                 if not math.isnan(matrix[i, j])}
    return spark.createDataFrame([(cols[i], cols[j], found.get((i, j))) for i, j in pairs], schema)
