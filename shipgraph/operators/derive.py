"""Row-level derivations on the shipment table (narrow, no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import flag, safe_div

# fixed values: thresholds and hour sets of the derived flags
DELAY_THRESHOLD = 1.20
WEEKEND_DAYS = (5, 6)                 # Monday = 0
RUSH_HOURS = (7, 8, 9, 17, 18, 19)
LEAKY_COLUMNS = ("factor", "segment_factor", "od_end_time", "cutoff_timestamp",
                 "start_scan_to_end_scan")


def derive_shipments(df: DataFrame) -> DataFrame:
    """Adds delay_ratio, delay_pct, is_delayed, is_sla_breach, corridor, hour,
    dow (Monday=0), month, is_weekend, is_rush_hour, distance_km."""
    ratio = safe_div(F.col("actual_time"), F.col("osrm_time"))
    t = F.col("od_start_time")
    return (df
            .withColumn("delay_ratio", ratio)
            .withColumn("delay_pct", (F.col("delay_ratio") - 1) * 100)
            .withColumn("is_delayed", flag(F.col("delay_ratio") > DELAY_THRESHOLD))
            # bool(NaN) is True in the reference: an unknown cutoff counts as breach
            .withColumn("is_sla_breach", F.coalesce(F.col("is_cutoff"), F.lit(True)))
            .withColumn("corridor", F.concat(F.col("source_center"), F.lit(" → "),
                                             F.col("destination_center")))
            .withColumn("hour", F.hour(t))
            .withColumn("dow", F.weekday(t))
            .withColumn("month", F.month(t))
            .withColumn("is_weekend", flag(F.col("dow").isin(*WEEKEND_DAYS)).cast("int"))
            .withColumn("is_rush_hour", flag(F.col("hour").isin(*RUSH_HOURS)).cast("int"))
            .withColumn("distance_km", F.col("actual_distance_to_destination")))


def recompute_ratio(df: DataFrame) -> DataFrame:
    """Refresh the target-dependent columns after the target was capped."""
    return (df.withColumn("delay_ratio", safe_div(F.col("actual_time"), F.col("osrm_time")))
              .withColumn("delay_pct", (F.col("delay_ratio") - 1) * 100))


def impute_names(df: DataFrame) -> DataFrame:
    """Missing facility names fall back to the facility code."""
    return (df.withColumn("source_name", F.coalesce("source_name", "source_center"))
              .withColumn("destination_name",
                          F.coalesce("destination_name", "destination_center")))


def drop_leaky(df: DataFrame, leaky=LEAKY_COLUMNS) -> DataFrame:
    """Remove columns that reveal the target (leakage audit exclusion list)."""
    return df.drop(*[c for c in leaky if c in df.columns])


def split(df: DataFrame, column: str = "data"):
    """Train / test split by the split-flag column."""
    return (df.where(F.col(column) == "training"), df.where(F.col(column) == "test"))


# columns judged against the target; a fixed list of the table's numeric ones
AUDITED = ("factor", "segment_factor", "start_scan_to_end_scan", "segment_actual_time",
           "actual_distance_to_destination", "osrm_time", "osrm_distance")


def leakage_audit(df: DataFrame, target: str = "actual_time", columns=AUDITED,
                  high: float = 0.95, medium: float = 0.6) -> DataFrame:
    """PRJ14: (column, correlation, risk) of each column with the target, in one
    pass; risk HIGH / MEDIUM / LOW by the correlation's size (rounded to 6 digits)."""
    row = df.agg(*[F.round(F.corr(c, target), 6).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    size = F.abs("correlation")
    return row.selectExpr(f"stack({len(columns)}, {pairs}) AS (column, correlation)").withColumn(
        "risk", F.when(size >= high, "HIGH").when(size >= medium, "MEDIUM").otherwise("LOW"))
