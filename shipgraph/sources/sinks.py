"""Sinks: parquet tables and one-row JSON reports (reference: CSV/JSON/pickle)."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Files that a task keeps open side by side when it writes by split.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
OPEN_FILES = 8


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None, row_group: int | None = None) -> None:
    """Parquet write (in row groups of ``row_group`` bytes, if given); ``partition_by=['data']`` gives the train/test split dirs.  A
    task keeps a file open for each of a few splits, so its rows aren't sorted by
    split (and spilled) first; Spark sorts what goes beyond OPEN_FILES splits."""
    w = df.write.mode(mode)
    if row_group:
        w = w.option("parquet.block.size", str(row_group))
    if not partition_by:
        w.parquet(path)
        return
    conf = df.sparkSession.conf
    before = conf.get(WRITERS, None)
    conf.set(WRITERS, str(max(int(before or 0), OPEN_FILES)))
    try:
        w.partitionBy(*partition_by).parquet(path)
    finally:
        if before is None:
            conf.unset(WRITERS)
        else:
            conf.set(WRITERS, before)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small report DataFrame written as JSON lines (one file)."""
    df.coalesce(1).write.mode(mode).json(path)


def read_or_build(spark, path: str, build, force_rebuild: bool = False) -> DataFrame:
    """Cached artefact: reuse the parquet at ``path`` (any Hadoop file system)
    unless ``force_rebuild``."""
    from pyspark.errors import AnalysisException
    if not force_rebuild:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    write_table(build(), path)
    return spark.read.parquet(path)
