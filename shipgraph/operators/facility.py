"""Facility (node) statistics from the shipment table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantile import group_quantiles


def facility_stats(df: DataFrame, method: str = "exact",
                   avg_over_present: bool = False) -> DataFrame:
    """JN1, AGG4-6, SET1: outbound stats per source, inbound per destination,
    over the union of both facility sets; missing side → 0.

    Both sides are aggregated by facility, so the full outer join reuses their
    hash partitioning (no extra exchange).  ``avg_over_present`` averages only
    the sides a facility has (the reference halves one-sided facilities).
    """
    out = group_quantiles(
        df.withColumnRenamed("source_center", "facility"), ["facility"],
        [("delay_ratio", 0.5, "out_delay_ratio")],
        [F.count("trip_uuid").alias("outbound_trips"),
         F.avg(F.col("is_sla_breach").cast("double")).alias("out_sla_breach")], method)
    inn = group_quantiles(
        df.withColumnRenamed("destination_center", "facility"), ["facility"],
        [("delay_ratio", 0.5, "in_delay_ratio")],
        [F.count("trip_uuid").alias("inbound_trips"),
         F.avg(F.col("is_sla_breach").cast("double")).alias("in_sla_breach")], method)
    j = out.join(inn, "facility", "full_outer")
    cols = ["outbound_trips", "out_delay_ratio", "out_sla_breach",
            "inbound_trips", "in_delay_ratio", "in_sla_breach"]
    filled = j.select("facility", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols],
                      F.col("outbound_trips").isNotNull().alias("_o"),
                      F.col("inbound_trips").isNotNull().alias("_i"))
    if avg_over_present:
        npres = F.col("_o").cast("int") + F.col("_i").cast("int")
        avg_d = (F.col("out_delay_ratio") + F.col("in_delay_ratio")) / npres
        avg_s = (F.col("out_sla_breach") + F.col("in_sla_breach")) / npres
    else:
        avg_d = (F.col("out_delay_ratio") + F.col("in_delay_ratio")) / 2
        avg_s = (F.col("out_sla_breach") + F.col("in_sla_breach")) / 2
    return filled.select(
        "facility", "outbound_trips", "out_delay_ratio", "out_sla_breach",
        "inbound_trips", "in_delay_ratio", "in_sla_breach",
        (F.col("outbound_trips") + F.col("inbound_trips")).alias("total_trips"),
        avg_d.alias("avg_delay_ratio"), avg_s.alias("avg_sla_breach"))
