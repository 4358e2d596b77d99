"""Shared helpers of the training-data operators: work folders, row addresses,
Arrow batches of text and column-appending maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, ship_code

FILE, ROW = "__file", "__row"
#: Rows of an Arrow batch handed to Python.  Bounds a worker's memory by this
#: many texts; a batch is only a unit of transfer and never changes a result.
BATCH_ROWS = 256


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to BATCH_ROWS rows, as documents can be long."""
    ship_code(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts the lineage;
    the files survive the loss of executors)."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with its rows' addresses (FILE, ROW): the parquet file and the
    row number in it.  A frame that isn't a plain parquet scan is written to
    the shared folder first, so that addresses stay the same on every read.
    A frame that has addresses keeps them."""
    if FILE in docs.columns and ROW in docs.columns:
        return docs
    try:
        m = docs.metadataColumn("_metadata")
        return docs.select("*", m.getField("file_path").alias(FILE),
                           m.getField("row_index").alias(ROW))
    except AnalysisException:
        docs = stored(docs, "rows")
        m = docs.metadataColumn("_metadata")
        return docs.select("*", m.getField("file_path").alias(FILE),
                           m.getField("row_index").alias(ROW))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return df.select(*columns) if columns else df


def append_columns(df: DataFrame, col: str, fn: Callable[[pa.Array], list],
                   fields: T.StructType, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` plus the columns ``fields`` that ``fn`` derives from the text
    column, batch by batch.  Columns of ``df`` that carry an output name, or
    that are listed in ``drop``, are left out."""
    small_batches(df.sparkSession)
    new = {f.name for f in fields}
    kept = [c for c in df.columns if c not in new and c not in drop]
    inner = df.select(F.col(f"`{col}`").alias("__in"), *[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(list(b.columns[1:]) + fn(b.column(0)), names=names)

    return inner.mapInArrow(run, schema)


def texts_of(arr: pa.Array) -> list[str]:
    return ["" if t is None else t for t in arr.to_pylist()]


def bytes_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the documents' bounds; null is empty."""
    arr = arr.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def doc_runs(off: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes together (one, if longer)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
