"""Global ranks without a single-task window.

A global ``row_number``/``rank`` over an unpartitioned window moves every row
to one task.  Here the rows are range-partitioned by the order (balanced by
sampling), numbered inside each partition, and shifted by the running total
of the preceding partitions — a table with one row per partition, so its
size is bounded by the partition count and it is broadcast safely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _sorted_with_pid(df: DataFrame, order: list[Column]) -> DataFrame:
    return cut_lineage(df.orderBy(*order).withColumn("_pid", F.spark_partition_id()))


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """1-based position in the total order ``order`` (must be a total order)."""
    s = _sorted_with_pid(df, order)
    w = Window.partitionBy("_pid").orderBy(*order)
    local = s.withColumn("_local", F.row_number().over(w))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offs = counts.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
                 .withColumn(name, (F.col("_local") + F.col("_off")).cast("long"))
                 .drop("_pid", "_local", "_off"))


def average_rank_desc(df: DataFrame, col: str, name: str = "rank") -> DataFrame:
    """pandas ``rank(ascending=False)`` (ties share the mean position),
    truncated to an integer like ``astype(int)``.  Distinct values are ranked
    (one row per value), then joined back."""
    vals = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_ties"))
    s = _sorted_with_pid(vals, [F.col(col).desc()])
    w = Window.partitionBy("_pid").orderBy(F.col(col).desc()) \
              .rowsBetween(Window.unboundedPreceding, 0)
    local = s.withColumn("_cum", F.sum("_ties").over(w))
    tot = s.groupBy("_pid").agg(F.sum("_ties").alias("_cnt"))
    offs = tot.withColumn("_off", F.coalesce(F.sum("_cnt").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = (local.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
                   .select(col, F.floor(F.col("_cum") + F.col("_off")
                                        - (F.col("_ties") - 1) / 2.0).cast("long").alias(name)))
    return df.join(ranked, col, "left")
