"""Regression metrics, lift reports, blend search — single aggregation passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip


def _metric_aggs(y: Column, p: Column, tolerances) -> list[Column]:
    err = y - p
    rel = F.abs(err) / (y + 1e-5)
    aggs = [F.avg(F.abs(err)).alias("_mae"), F.sqrt(F.avg(err * err)).alias("_rmse"),
            (F.avg(rel) * 100).alias("_mape"), F.sum(err * err).alias("_sse"),
            (F.var_pop(y) * F.count(y)).alias("_sst"), F.count(F.lit(1)).alias("n_rows")]
    for t in tolerances:
        aggs.append((F.avg((rel < t).cast("double")) * 100).alias(f"_w{int(round(t * 100))}"))
    return aggs


def regression_metrics(df: DataFrame, label: str = "actual_time", pred: str = "prediction",
                       model: str = "", tolerances=(0.15, 0.20), by: list[str] | None = None
                       ) -> DataFrame:
    """EVL1/EVL3: MAE, RMSE, MAPE (+1e-5), R², share within each tolerance
    (strict <), rounded 3/3/3/4/2; ``by`` gives one row per group.  R² with a
    constant label is 1 for a perfect fit and 0 otherwise."""
    keys = by or []
    g = df.groupBy(*keys) if keys else df
    m = g.agg(*_metric_aggs(F.col(label), F.col(pred), tolerances))
    r2 = F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")) \
          .otherwise(F.when(F.col("_sse") == 0, 1.0).otherwise(0.0))
    cols = [*keys, F.lit(model).alias("model"), F.round("_mae", 3).alias("mae"),
            F.round("_rmse", 3).alias("rmse"), F.round("_mape", 3).alias("mape"),
            F.round(r2, 4).alias("r2")]
    for t in tolerances:
        k = int(round(t * 100))
        cols.append(F.round(f"_w{k}", 2).alias(f"within_{k}pct"))
    return m.select(*cols, "n_rows")


def best_per_phase(table: DataFrame) -> DataFrame:
    """AGG28: lowest RMSE and MAE and highest ±15 % share of each phase's models."""
    return table.groupBy("phase").agg(F.min("rmse").alias("rmse"), F.min("mae").alias("mae"),
                                      F.max("within_15pct").alias("within_15pct"))


def graph_advantage(baseline: DataFrame, graph: DataFrame) -> DataFrame:
    """EVL2: RMSE and MAE improvement %, ±15 % improvement in points."""
    b = baseline.select(F.col("rmse").alias("baseline_rmse"), F.col("mae").alias("baseline_mae"),
                        F.col("within_15pct").alias("baseline_within15"))
    g = graph.select(F.col("rmse").alias("graph_rmse"), F.col("mae").alias("graph_mae"),
                     F.col("within_15pct").alias("graph_within15"))
    j = b.crossJoin(g)
    return j.select(
        "baseline_rmse", "graph_rmse",
        F.round((F.col("baseline_rmse") - F.col("graph_rmse")) / F.col("baseline_rmse") * 100, 2)
         .alias("rmse_improvement_pct"),
        "baseline_mae", "graph_mae",
        F.round((F.col("baseline_mae") - F.col("graph_mae")) / F.col("baseline_mae") * 100, 2)
         .alias("mae_improvement_pct"),
        "baseline_within15", "graph_within15",
        F.round(F.col("graph_within15") - F.col("baseline_within15"), 2)
         .alias("within15_improvement_pp"))


def blend_search(df: DataFrame, a: str, b: str, label: str = "actual_time",
                 weights=None) -> DataFrame:
    """ML16/ML21: RMSE and MAE of w·a + (1−w)·b for every weight in ONE pass
    over the rows; ``is_best`` marks the lowest RMSE, which must beat w=0.5
    strictly to replace it (ties keep the smaller weight)."""
    weights = weights or [round(0.30 + 0.05 * i, 2) for i in range(10)]
    grid = sorted(set([0.5, *weights]))
    aggs = []
    for i, w in enumerate(grid):
        e = F.col(label) - (w * F.col(a) + (1 - w) * F.col(b))
        aggs += [F.sqrt(F.avg(e * e)).alias(f"r{i}"), F.avg(F.abs(e)).alias(f"m{i}")]
    row = df.agg(*aggs)
    parts = ", ".join(f"{w}D, r{i}, m{i}" for i, w in enumerate(grid))
    long = row.selectExpr(f"stack({len(grid)}, {parts}) AS (weight, rmse, mae)")
    base = long.where(F.col("weight") == 0.5).select(F.col("rmse").alias("_base"))
    w_all = Window.partitionBy()        # over the weight grid rows only
    ranked = long.crossJoin(base).withColumn(
        "_key", F.when(F.col("rmse") < F.col("_base"), F.col("rmse")).otherwise(F.col("_base")))
    best_rmse = F.min("_key").over(w_all)
    best_w = F.min(F.when(F.col("_key") == best_rmse,
                          F.when(F.col("rmse") < F.col("_base"), F.col("weight"))
                           .otherwise(F.lit(0.5)))).over(w_all)
    return (ranked.withColumn("is_best", (F.col("weight") == best_w).cast("int"))
                  .drop("_base", "_key"))


def improvement_steps(steps: DataFrame, order_col: str = "step", value_col: str = "rmse"
                      ) -> DataFrame:
    """WIN2: delta of each step against the previous one (lag over the few
    step rows; one window partition by construction)."""
    w = Window.orderBy(order_col)
    return steps.withColumn("delta", F.col(value_col) - F.lag(value_col).over(w))


def residuals(df: DataFrame, label: str = "actual_time", pred: str = "prediction",
              limit: float = 500.0) -> DataFrame:
    """EVL5: residual y − ŷ and its clipped version."""
    r = F.col(label) - F.col(pred)
    return df.withColumn("residual", r).withColumn("residual_clipped", clip(r, -limit, limit))


def deterministic_sample(df: DataFrame, n: int, key_cols: list[str], seed: int = 42) -> DataFrame:
    """SET4: a reproducible sample of ``n`` rows — the ``n`` smallest hashes of
    the key (TakeOrderedAndProject: each task keeps n rows)."""
    h = F.xxhash64(*[F.col(c) for c in key_cols], F.lit(seed))
    return df.withColumn("_h", h).orderBy("_h", *key_cols).limit(n).drop("_h")
