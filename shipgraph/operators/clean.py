"""Cleaning: per-group winsorizing, zero-plan removal, SLA definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.broadcast import small
from ..functions.exprs import clip, exact_mean, rate
from ..functions.quantile import global_quantiles, group_quantiles
from .derive import drop_leaky, recompute_ratio

# fixed values: SLA re-definitions
REALISTIC_CUTOFF_FACTOR = 1.5
SEVERE_RATIO = 2.0


def winsorize_by_group(df: DataFrame, target_col: str, group_col: str,
                       lower_pct: float | None = 0.01, upper_pct: float | None = 0.99,
                       method: str = "distributed", stats: DataFrame | None = None) -> DataFrame:
    """Clip ``target_col`` to per-group quantile bounds (NULLs stay NULL).
    The bounds are those of the rows of ``stats``, by default of ``df``.

    The bounds are one row per group; they are broadcast when their counted
    size is within the session's threshold, so ``df`` isn't shuffled on a key
    of few values, and joined by a shuffle beyond it.
    """
    specs = []
    if lower_pct is not None:
        specs.append((target_col, lower_pct, "_lo"))
    if upper_pct is not None:
        specs.append((target_col, upper_pct, "_hi"))
    if not specs:
        return df.withColumn(target_col, F.col(target_col).cast("double"))
    bounds = group_quantiles(df if stats is None else stats, [group_col], specs, method=method)
    x = F.col(target_col).cast("double")
    capped = clip(x, F.col("_lo") if lower_pct is not None else None,
                  F.col("_hi") if upper_pct is not None else None)
    cols = [capped.alias(c) if c == target_col else F.col(f"`{c}`") for c in df.columns]
    bounds = bounds.withColumnRenamed(group_col, "_g")
    return df.join(small(bounds), F.col(group_col).eqNullSafe(F.col("_g")), "left").select(*cols)


def clean_shipments(derived: DataFrame, strategy: str = "winsorize",
                    cap_pct: float = 0.99, impute_cutoff: bool = True,
                    method: str = "distributed", stats_where: Column | str | None = None) -> DataFrame:
    """Canonical cleaning: drop non-positive plans, cap actual_time at the
    per-route-type ``cap_pct`` quantile (upper side only), recompute the ratio,
    fill a missing cutoff with the median, drop leaky columns.  Quantiles and
    median are those of the rows where ``stats_where`` holds (all by default)."""
    def known(rows: DataFrame) -> DataFrame:
        return rows if stats_where is None else rows.where(stats_where)

    df = derived.where(F.col("osrm_time") > 0)
    if strategy == "winsorize":
        df = recompute_ratio(winsorize_by_group(df, "actual_time", "route_type",
                                                None, cap_pct, method, known(df)))
    elif strategy == "drop":
        caps = group_quantiles(known(df), ["route_type"], [("actual_time", cap_pct, "_cap")],
                               method=method)
        df = df.join(small(caps), "route_type").where(F.col("actual_time") <= F.col("_cap")) \
               .drop("_cap")
    elif strategy != "none":
        raise ValueError(f"strategy must be winsorize, drop or none, got {strategy!r}")
    if impute_cutoff:
        med = global_quantiles(known(df), [("cutoff_factor", 0.5, "_cut_med")], method=method)
        df = (df.crossJoin(F.broadcast(med))   # one row by construction
                .withColumn("cutoff_factor", F.coalesce("cutoff_factor", "_cut_med"))
                .drop("_cut_med"))
    return drop_leaky(df)


def winsorize_upper(derived: DataFrame, cap_pct: float = 0.99,
                    method: str = "distributed") -> DataFrame:
    """CLN2 as in the outlier step: cap actual_time per route type, recompute
    the ratio, then drop rows without a positive plan."""
    df = winsorize_by_group(derived, "actual_time", "route_type", None, cap_pct, method)
    return recompute_ratio(df).where(F.col("osrm_time") > 0)


def route_quantiles(derived: DataFrame, method: str = "distributed") -> DataFrame:
    """AGG19: per route type q01/q99 of actual_time, q99 of delay ratio, and
    the number / share of rows above the q99."""
    q = group_quantiles(derived, ["route_type"],
                        [("actual_time", 0.01, "q01_actual"), ("actual_time", 0.99, "q99_actual"),
                         ("delay_ratio", 0.99, "q99_delay_ratio")], method=method)
    # a join on two keys would put the rows into two tasks: the bounds go to the rows
    j = derived.select("route_type", "actual_time").join(small(q), "route_type")
    return j.groupBy("route_type", "q01_actual", "q99_actual", "q99_delay_ratio").agg(
        F.count(F.when(F.col("actual_time") > F.col("q99_actual"), 1)).alias("n_above_q99"),
        F.round(rate(F.col("actual_time") > F.col("q99_actual")) * 100, 2).alias("pct_above_q99"))


def cleaning_impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """AGG20: mean/std/max of actual_time before and after, std reduction %."""
    b = before.agg(exact_mean(F.col("actual_time")).alias("mean_before"),
                   F.stddev_samp("actual_time").alias("std_before"),
                   F.max("actual_time").alias("max_before"),
                   F.max("delay_ratio").alias("max_ratio_before"))
    a = after.agg(exact_mean(F.col("actual_time")).alias("mean_after"),
                  F.stddev_samp("actual_time").alias("std_after"),
                  F.max("actual_time").alias("max_after"),
                  F.max("delay_ratio").alias("max_ratio_after"))
    return b.crossJoin(a).withColumn(
        "std_reduction_pct", (1 - F.col("std_after") / F.col("std_before")) * 100)


def route_ratio_profile(cleaned: DataFrame, method: str = "distributed") -> DataFrame:
    """AGG21: per route type median and p95 of the clipped delay ratio."""
    c = cleaned.withColumn("_r", clip(F.col("delay_ratio"), 0, 8))
    return group_quantiles(c, ["route_type"], [("_r", 0.5, "median_ratio"),
                                               ("_r", 0.95, "p95_ratio")], method=method)


def sla_clarification(derived: DataFrame, cleaned: DataFrame) -> DataFrame:
    """AGG22: original / realistic / severe breach %, std reduction, row counts.

    Realistic and severe rates are taken on the cleaned rows, the original
    rate on all rows (as in the reference report).
    """
    b = derived.agg(F.round(F.avg(F.col("is_sla_breach").cast("double")) * 100, 1)
                    .alias("original_breach_rate_pct"),
                    F.count(F.lit(1)).alias("rows_before"),
                    F.stddev_samp("actual_time").alias("_sb"))
    a = cleaned.agg(
        F.round(rate(F.col("actual_time") > F.col("cutoff_factor") * REALISTIC_CUTOFF_FACTOR)
                * 100, 1).alias("realistic_breach_rate_pct"),
        F.round(rate(F.col("delay_ratio") > SEVERE_RATIO) * 100, 1).alias("severe_delay_pct"),
        F.count(F.lit(1)).alias("rows_after"),
        F.stddev_samp("actual_time").alias("_sa"))
    return (b.crossJoin(a)
             .withColumn("std_reduction_pct", F.round((1 - F.col("_sa") / F.col("_sb")) * 100, 1))
             .drop("_sa", "_sb"))


def sla_recalibration(derived: DataFrame, factors=(1.0, 1.5, 1.86)) -> DataFrame:
    """IMP2: breach rate if the cutoff window were scaled by each factor.
    One pass: one conditional average per scenario."""
    aggs = [rate(F.col("actual_time") > F.col("cutoff_factor") * f).alias(f"s{i}")
            for i, f in enumerate(factors)]
    row = derived.agg(*aggs)
    stack = ", ".join(f"{float(f)}D, s{i}" for i, f in enumerate(factors))
    return row.selectExpr(f"stack({len(factors)}, {stack}) AS (cutoff_multiplier, breach_rate)")
