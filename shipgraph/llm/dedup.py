"""Operator 2: exact deduplication as a stateful stream.

A stream over the documents' digests keeps, per SHA-256 digest, disk-backed
keyed state (RocksDB) that never expires: the number of rows and the greatest
(doc_id, file, row), i.e. the stable identifier and the content's address.
Digests that more than one row hit are then checked on the full bytes: texts
of hits are grouped by (digest, text), so two texts that shared a digest would
be told apart.  The main path has DataFrame functions only.

Defined results: null text equals empty text; of equal texts the row with the
largest doc_id stays, of equal doc_ids the one with the greatest address, so
exactly one row of each group is kept; null doc_ids come before all others; an
empty table gives no rows.  Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE, ROW, located, stored, work_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Session settings while the stream runs: keyed state on disk, without
#: preallocated files, as most partitions' state is small (with them, 211
#: partitions of 0.03 GB of input take over 0.6 GB of disk).
STATE = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
         "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
#: Ways over which texts of one digest are spread before they are compared.
SALTS = 16


def digest_state(keys: DataFrame) -> DataFrame:
    """Streaming state of a stream with columns __digest and __id: per digest
    the number of rows and the greatest identifier.  No watermark: no expiry."""
    return keys.groupBy("__digest").agg(F.count(F.lit(1)).alias("__n"),
                                        F.max("__id").alias("__keep"))


def run_state(keys: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Run the stream over a stored table of keys until it has read all;
    returns the last state of each digest."""
    spark = keys.sparkSession
    path, at = keys.inputFiles(), work_dir(spark, "digests")
    if not path:
        return digest_state(keys)
    folder = path[0].rsplit("/", 1)[0]
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(keys.schema)
        if files_per_batch:
            source = source.option("maxFilesPerTrigger", files_per_batch)

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

        query = (digest_state(source.parquet(folder)).writeStream.outputMode("update")
                 .foreachBatch(keep).option("checkpointLocation", f"{at}/state")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = spark.read.parquet(f"{at}/out/*")
    return rows.groupBy("__digest").agg(F.max("__n").alias("__n"),
                                        F.max_by("__keep", "__n").alias("__keep"))


def classes(docs: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """One row per document: doc_id, FILE, ROW, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = located(docs).select(
        "doc_id", FILE, ROW, text.alias("__text"), F.sha2(text, 256).alias("__digest"))
    own = F.struct(F.col("doc_id"), F.col(FILE), F.col(ROW))
    keys = stored(rows.select("__digest", own.alias("__id")), "keys")
    groups = run_state(keys, files_per_batch).where("__n > 1")

    # full bytes of the hits: the salt spreads a digest that many rows share
    salt = F.pmod(F.xxhash64(FILE, ROW), F.lit(SALTS)).cast("int")
    hits = groups.select("__digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
                         .alias("__salt"))
    texts = rows.withColumn("__salt", salt).join(hits, ["__digest", "__salt"], "left_semi")
    same = (texts.groupBy("__digest", "__salt", "__text")
            .agg(F.count(F.lit(1)).alias("__n"), F.max(own).alias("__keep"))
            .groupBy("__digest", "__text")
            .agg(F.sum("__n").alias("__n"), F.max("__keep").alias("__keep")))
    same = stored(same.select("__digest", F.md5("__text").alias("__md5"), "__n", "__keep"),
                  "classes")
    split = same.groupBy("__digest").agg(F.count(F.lit(1)).alias("__texts")).where("__texts > 1")
    clear = same.join(split, "__digest", "left_anti")

    r = (keys.select("__digest", "__id.*")
         .join(clear.select("__digest", "__n", "__keep"), "__digest", "left"))
    n, keep = F.col("__n"), F.col("__keep")
    if not split.isEmpty():  # two texts with one digest: told apart by the second digest
        both = (rows.join(split, "__digest", "left_semi")
                .select(FILE, ROW, "__digest", F.md5("__text").alias("__md5"))
                .join(same, ["__digest", "__md5"])
                .select(FILE, ROW, F.col("__n").alias("__n2"), F.col("__keep").alias("__keep2")))
        r = r.join(both, [FILE, ROW], "left")
        n, keep = F.coalesce("__n2", n), F.coalesce("__keep2", keep)
    n = F.coalesce(n, F.lit(1))
    keep = F.coalesce(keep, F.struct("doc_id", FILE, ROW))
    return r.select("doc_id", FILE, ROW, keep.getField("doc_id").alias("keep_id"),
                    n.cast("long").alias("group_size"),
                    ((keep.getField(FILE) == F.col(FILE)) & (keep.getField(ROW) == F.col(ROW)))
                    .alias("kept"), F.col("__digest").alias("text_sha256"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    return classes(docs).drop(FILE, ROW)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns."""
    rows = located(docs)
    gone = stored(classes(rows).where("not kept").select(FILE, ROW), "dropped")
    return rows.join(gone, [FILE, ROW], "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
