"""Broadcast hints behind a check of the table's size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30,
         "gb": 1 << 30}


def threshold(spark: SparkSession) -> int:
    """The session's own broadcast limit in bytes."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10m").strip().lower()
    number = text.rstrip("kmgb")
    return int(number) * UNITS[text[len(number):]]


def row_bytes(schema: T.StructType) -> int:
    """A generous width of a row: 8 bytes a number, 64 a string, more for nested ones."""
    def width(t: T.DataType) -> int:
        if isinstance(t, T.StructType):
            return row_bytes(t)
        if isinstance(t, T.ArrayType):
            return 32 * width(t.elementType)
        return 64 if isinstance(t, T.StringType | T.BinaryType) else 16
    return 16 + sum(width(f.dataType) for f in schema)


def bounded(df: DataFrame, n_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if ``n_rows`` of it fit the session's limit;
    beyond it the join is left to the optimizer."""
    return F.broadcast(df) if n_rows * row_bytes(df.schema) <= threshold(df.sparkSession) else df


def small(df: DataFrame) -> DataFrame:
    """An aggregate written once, counted, and hinted only within the limit."""
    df = cut_lineage(df)
    return bounded(df, df.count())
