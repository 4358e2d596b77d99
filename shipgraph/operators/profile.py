"""Profiling reports over the shipment table (one aggregation pass each)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, exact_mean, flag, hist_bin, rate
from ..functions.quantile import global_quantiles
from .clean import REALISTIC_CUTOFF_FACTOR


def _stack(row: DataFrame, names: list[str], value_cols: list[list[str]],
           out: list[str]) -> DataFrame:
    """Unpivot a one-row wide frame: each entry of ``names`` becomes one row
    with the columns listed in ``value_cols`` (same position in ``out``)."""
    parts = []
    for n, cols in zip(names, value_cols):
        parts.append(f"'{n}'")
        parts.extend(f"`{c}`" for c in cols)
    expr = f"stack({len(names)}, {', '.join(parts)}) AS ({', '.join(out)})"
    return row.selectExpr(expr)


def dataset_summary(derived: DataFrame, exact: bool = True) -> DataFrame:
    """AGG9+AGG15: row counts, distinct facility/trip/corridor counts, rates."""
    dc = F.count_distinct if exact else F.approx_count_distinct
    return global_quantiles(derived, [("delay_ratio", 0.5, "median_delay_ratio")], (
        F.count(F.lit(1)).alias("total_rows"),
        F.count(F.when(F.col("data") == "training", 1)).alias("train_rows"),
        F.count(F.when(F.col("data") == "test", 1)).alias("test_rows"),
        dc("source_center").alias("unique_sources"),
        dc("destination_center").alias("unique_destinations"),
        dc("trip_uuid").alias("unique_trips"),
        dc("route_schedule_uuid").alias("unique_schedules"),
        dc("corridor").alias("unique_corridors"),
        F.avg(F.col("is_sla_breach").cast("double")).alias("sla_breach_rate"),
        F.avg(F.col("is_delayed").cast("double")).alias("chronic_delay_rate"),
        F.avg("delay_ratio").alias("mean_delay_ratio")), method="distributed")


def value_share(df: DataFrame, column: str) -> DataFrame:
    """AGG10: value counts with the share of all rows (total via a window over
    the small grouped result, never over the raw rows)."""
    from pyspark.sql import Window
    g = df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    return g.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))


def missing_report(df: DataFrame, digits: int = 3) -> DataFrame:
    """AGG11: per column NULL count and % (rounded), columns with any NULL."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"m_{i}")
                   for i, c in enumerate(cols)])
    long = _stack(row.withColumn("_n2", F.col("_n")), cols,
                  [[f"m_{i}", "_n2"] for i in range(len(cols))],
                  ["column", "missing_count", "n_rows"])
    return (long.where(F.col("missing_count") > 0)
                .select("column", "missing_count",
                        F.round(F.col("missing_count") / F.col("n_rows") * 100, digits)
                         .alias("missing_pct")))


# fixed values: data-quality predicates of the reference report
def data_quality(derived: DataFrame) -> DataFrame:
    """FLT3+AGG12: rule violation counts in one pass, plus valid-actual %."""
    checks = [
        ("non_positive_actual_time", F.col("actual_time") <= 0),
        ("non_positive_osrm_time", F.col("osrm_time") <= 0),
        ("delay_ratio_over_10", F.col("delay_ratio") > 10),
        ("negative_segment_factor", F.col("segment_factor") < 0),
        ("same_source_destination", F.col("source_center") == F.col("destination_center")),
    ]
    row = derived.agg(F.count(F.lit(1)).alias("_n"),
                      *[F.count(F.when(flag(c), 1)).alias(n) for n, c in checks])
    long = _stack(row.withColumn("_n2", F.col("_n")), [n for n, _ in checks],
                  [[n, "_n2"] for n, _ in checks], ["issue", "n_rows", "_total"])
    first = checks[0][0]
    return long.select("issue", "n_rows",
                       F.when(F.col("issue") == first,
                              (1 - F.col("n_rows") / F.col("_total")) * 100)
                        .alias("valid_pct"))


OUTLIER_COLUMNS = ("actual_time", "osrm_time", "delay_ratio", "distance_km",
                   "segment_actual_time")


def iqr_outliers(derived: DataFrame, columns=OUTLIER_COLUMNS, k: float = 3.0) -> DataFrame:
    """AGG13: k×IQR fences per column from exact quartiles; the one-row
    quartile table is cross-joined (broadcast, size 1) for the counting pass."""
    specs = []
    for c in columns:
        specs += [(c, 0.25, f"{c}__q1"), (c, 0.75, f"{c}__q3")]
    q = global_quantiles(derived, specs, method="distributed")
    aggs = []
    for c in columns:
        iqr = F.col(f"{c}__q3") - F.col(f"{c}__q1")
        aggs += [F.count(F.when(F.col(c) < F.col(f"{c}__q1") - k * iqr, 1)).alias(f"{c}__lo"),
                 F.count(F.when(F.col(c) > F.col(f"{c}__q3") + k * iqr, 1)).alias(f"{c}__hi"),
                 F.first(f"{c}__q1").alias(f"{c}__Q1"), F.first(f"{c}__q3").alias(f"{c}__Q3")]
    row = derived.select(*columns).crossJoin(F.broadcast(q)).agg(*aggs)
    long = _stack(row, list(columns),
                  [[f"{c}__Q1", f"{c}__Q3", f"{c}__lo", f"{c}__hi"] for c in columns],
                  ["column", "q1", "q3", "low_outliers", "high_outliers"])
    return long.withColumn("iqr", F.col("q3") - F.col("q1"))


DESCRIBE_COLUMNS = ("actual_time", "osrm_time", "delay_ratio", "distance_km")


def describe_numeric(derived: DataFrame, columns=DESCRIBE_COLUMNS, digits: int = 2) -> DataFrame:
    """AGG14: pandas ``describe().round(2)`` with exact quartiles, long form."""
    stats = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    aggs = []
    for c in columns:
        x = F.col(c)
        aggs += [F.count(x).cast("double").alias(f"{c}__count"),
                 exact_mean(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    specs = [(c, q / 100, f"{c}__p{q}") for c in columns for q in (25, 50, 75)]
    row = global_quantiles(derived, specs, aggs, method="distributed")
    long = _stack(row, list(columns), [[f"{c}__{s}" for s in stats] for c in columns],
                  ["column", *stats])
    return long.select("column", *[F.round(s, digits).alias(s) for s in stats])


def rate_by(derived: DataFrame, key: str, flag_col: str = "is_sla_breach",
            alias: str = "sla_breach_rate") -> DataFrame:
    """AGG16: mean of a boolean flag per key."""
    return derived.groupBy(key).agg(F.avg(F.col(flag_col).cast("double")).alias(alias))


def mean_by(derived: DataFrame, key: str, col: str = "delay_ratio",
            alias: str = "mean_delay_ratio") -> DataFrame:
    """AGG17: mean per key (NULL keys kept as their own group, like dropna=False
    would not — pandas drops them, so we do too)."""
    return derived.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(col).alias(alias))


def monthly_delay(derived: DataFrame) -> DataFrame:
    """AGG17: mean ratio per month plus the mean of the monthly means."""
    from pyspark.sql import Window
    m = mean_by(derived, "month")
    return m.withColumn("mean_of_monthly_means",
                        F.avg("mean_delay_ratio").over(Window.partitionBy()))


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int,
              by: str | None = None, density: bool = False) -> DataFrame:
    """AGG18: numpy-style histogram of ``clip(column, lo, hi)`` (NULLs dropped),
    one row per non-empty bin; ``density`` divides by n·width per group."""
    width = (hi - lo) / bins
    keys = [by] if by else []
    h = (df.where(F.col(column).isNotNull())
           .withColumn("bin", hist_bin(F.col(column), lo, hi, bins))
           .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n_rows"))
           .withColumn("bin_lo", lo + F.col("bin") * width)
           .withColumn("bin_hi", lo + (F.col("bin") + 1) * width))
    if density:
        from pyspark.sql import Window
        tot = F.sum("n_rows").over(Window.partitionBy(*keys))
        h = h.withColumn("density", F.col("n_rows") / (tot * width))
    return h


def network_kpis(derived: DataFrame, corridors: DataFrame) -> DataFrame:
    """AGG23: dashboard KPIs (facilities counted two ways, see SURVEY §8 #14)."""
    k = global_quantiles(derived, [("delay_ratio", 0.5, "median_delay_ratio")], (
        F.count(F.lit(1)).alias("shipments"),
        F.count_distinct("source_center").alias("source_facilities"),
        (F.avg(F.col("is_sla_breach").cast("double")) * 100).alias("sla_breach_pct"),
        (rate(F.col("actual_time") > F.col("cutoff_factor") * REALISTIC_CUTOFF_FACTOR) * 100)
        .alias("realistic_breach_pct")), method="distributed")
    fac = (derived.select(F.col("source_center").alias("f"))
                  .union(derived.select(F.col("destination_center").alias("f")))
                  .agg(F.count_distinct("f").alias("all_facilities")))
    c = corridors.agg(F.count(F.lit(1)).alias("corridors"))
    return k.crossJoin(fac).crossJoin(c)
