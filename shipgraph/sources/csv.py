"""Shipment records from CSV: explicit columns, coerced values, a quarantine.

Every column is read as text, so no schema is inferred and no value fails a
read.  Dates and flags that don't parse become NULL (the row stays, as the
reference's coercion has it); a row whose record is malformed, or whose required
numbers don't parse, goes to the quarantine with its reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .artefacts import exists
from .tables import RAW_COLUMNS

DATES = ("trip_creation_time", "od_start_time", "od_end_time")
FLAGS = ("is_cutoff",)
NUMBERS = ("start_scan_to_end_scan", "cutoff_factor", "actual_distance_to_destination",
           "actual_time", "osrm_time", "osrm_distance", "factor", "segment_actual_time",
           "segment_osrm_time", "segment_osrm_distance", "segment_factor")
REQUIRED = ("actual_time", "osrm_time")
CORRUPT = "_corrupt_record"
DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"


def coerced_date(text: Column, fmt: str = DATE_FORMAT) -> Column:
    """A timestamp, or NULL where the text isn't one."""
    return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")), F.lit(fmt))


def percent_text(x: Column, digits: int = 1) -> Column:
    """A number as text with a percent sign; NULL stays NULL."""
    return F.concat(F.round(x, digits).cast("string"), F.lit("%"))


def read_shipments_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(shipments, quarantined) of the CSV files at ``path`` (header line, columns in
    the order of RAW_COLUMNS).  Quarantined rows have the raw text and a reason."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*RAW_COLUMNS, CORRUPT)])
    raw = spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE",
                         columnNameOfCorruptRecord=CORRUPT)
    number = {c: F.expr(f"try_cast(nullif(trim({c}), '') AS double)") for c in NUMBERS}
    reason = F.when(F.col(CORRUPT).isNotNull(), "malformed record")
    for c in REQUIRED:
        reason = reason.when(number[c].isNull(), f"{c} is not a number")
    marked = raw.withColumn("reason", reason)
    bad = marked.where("reason IS NOT NULL")
    good = marked.where("reason IS NULL").select(*[
        (coerced_date(F.col(c)) if c in DATES else number[c] if c in NUMBERS
         else F.expr(f"try_cast({c} AS boolean)") if c in FLAGS else F.col(c)).alias(c)
        for c in RAW_COLUMNS])
    return good, bad


def shipments_or_sample(spark: SparkSession, path: str, sample_path: str) -> DataFrame:
    """SRC3: the Parquet records at ``path``, else those of the bundled sample,
    with ``is_sample`` carried along; neither raises FileNotFoundError."""
    for p, is_sample in ((path, False), (sample_path, True)):
        if exists(spark, p):
            return spark.read.parquet(p).withColumn("is_sample", F.lit(is_sample))
    raise FileNotFoundError(f"neither {path} nor {sample_path}")


def hash_sample(shipments: DataFrame, share: float = 1 / 32) -> DataFrame:
    """The shipments of a share of the trips, chosen by the trip's MD5: the same
    rows whatever the layout."""
    below = f"{int(share * 256):02x}"
    return shipments.where(F.substring(F.md5(F.col("trip_uuid").cast("binary")), 1, 2) < below)
