"""Operator 6: token-id files with canonical length-limited Huffman coding.

Texts are dealt out by ranges of doc_id, encoded to token ids, and counted
over the whole corpus; the counts give code lengths (package-merge, at most
LIMIT bits) and those alone the canonical codes.  Each range's ids are written
in ascending doc_id order as independent blocks of whole documents, with a bit
offset every STRIDE ids.  Reading decodes a block by table look-up, all its
strides side by side.

File format (a folder): ``codes`` (id, bits); ``blocks`` (part, place of the
block's first id in its part, doc_ids, sizes, bit offsets, payload), rows of
Parquet files that Spark commits, so a lost executor leaves no half file.

Defined results: null or empty text has only the end id; null doc_ids come
first; rows with one doc_id stand in the order of their texts; an empty table
has no blocks; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, work_dir
from .tokens import encoder

#: Longest code in bits (one table of 2^LIMIT entries decodes), ids between
#: stored bit offsets, and ids after which a block ends with its document.
LIMIT, STRIDE, BLOCK_IDS = 20, 256, 1 << 17


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[:len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        pick = np.argsort(both, kind="stable")
        level = both[pick]
        is_leaf.append(pick < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        own = int(flags[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Codes:
    """Canonical codes from (id, length) pairs: by length, then id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order], lengths[order]
        self.limit = int(self.lengths.max()) if len(ids) else 1
        at = np.cumsum(np.int64(1) << (self.limit - self.lengths))
        left = np.append(0, at[:-1]).astype(np.int64)  # left-aligned codes
        size = int(self.ids.max()) + 1 if len(ids) else 1
        self.code, self.length = np.zeros(size, np.uint32), np.zeros(size, np.int64)
        self.code[self.ids] = left >> (self.limit - self.lengths)
        self.length[self.ids] = self.lengths
        span = np.int64(1) << (self.limit - self.lengths)
        self.look_id = np.zeros(1 << self.limit, np.uint32)
        self.look_len = np.zeros(1 << self.limit, np.uint8)
        used = int(span.sum())
        self.look_id[:used] = np.repeat(self.ids, span)
        self.look_len[:used] = np.repeat(self.lengths, span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits of the ids, and the bit offset of every STRIDE-th id."""
        size = self.length[ids]
        end = np.cumsum(size)
        start = end - size
        total = int(end[-1]) if len(ids) else 0
        # a code touches two 32-bit words at most; sums of bits that don't overlap are exact
        word = self.code[ids].astype(np.uint64) << (64 - size - (start & 31)).astype(np.uint64)
        at, n = start >> 5, total // 32 + 3
        out = np.bincount(at, weights=word >> np.uint64(32), minlength=n)
        out += np.bincount(at + 1, weights=word & np.uint64(0xFFFFFFFF), minlength=n)
        return out.astype(">u4").tobytes()[:total // 8 + 8], start[::STRIDE]

    def decode(self, payload: np.ndarray, offsets: np.ndarray, total: int) -> np.ndarray:
        """``total`` ids; each step reads one id of every stride."""
        b = np.append(payload, np.zeros(8, np.uint8)).astype(np.uint32)
        words = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        out = np.zeros((len(offsets), STRIDE), np.uint32)
        at, last = offsets.astype(np.int64), len(words) - 1
        for k in range(min(STRIDE, total)):
            if k == total - (len(offsets) - 1) * STRIDE:  # the last stride may be shorter
                at = at[:-1]
            w = words[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)
            w >>= np.uint32(32 - self.limit)
            out[:len(at), k] = self.look_id[w]
            at = at + self.look_len[w]
        return out.ravel()[:total]


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, part, start, n, ids) in ascending doc_id order: ``part`` numbers
    the ranges, ``start`` counts the part's ids before the document; ids are
    little-endian 16-bit numbers, or 32-bit ones for a vocabulary that needs them."""
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for b in batches:
            enc = encoder(tokenizer)
            kind = np.dtype(id_type(enc.lib.get_vocab_size(), end_id))
            end, w = np.array([end_id], kind).tobytes(), kind.itemsize
            ids = []
            for flat, at in enc.encode(b.column(1)):
                raw = flat.astype(kind).tobytes()
                ids += [raw[w * x:w * y] + end for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            size = np.array([len(x) // w for x in ids], np.int64)
            ends = start + np.cumsum(size)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(ids), part, np.int32)),
                 pa.array(ends - size), pa.array(size.astype(np.int32)),
                 pa.array(ids, pa.binary())], names=["doc_id", "part", "start", "n", "ids"])
            start = int(ends[-1]) if len(ends) else start

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", "text").repartitionByRange(n, "doc_id")
            .sortWithinPartitions("doc_id", "text")
            .mapInArrow(run, f"doc_id {kind}, part int, start long, n int, ids binary"))


def id_type(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"


def id_counts(rows: DataFrame) -> dict[int, int]:
    """Global count of each id (at most the vocabulary's size on the driver)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            n, raw = b.column(0).to_pylist(), b.column(1).to_pylist()
            if not n:
                continue
            # all rows' ids have one width
            c = np.bincount(np.frombuffer(b"".join(raw), f"<u{len(raw[0]) // n[0]}"))
            if len(c) > len(total):
                total = np.append(total, np.zeros(len(c) - len(total), np.int64))
            total[:len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "c"])

    got = rows.select("n", "ids").mapInArrow(run, "id long, c long").groupBy("id").agg(
        F.sum("c").alias("c")).collect()
    return {r["id"]: r["c"] for r in got}


BLOCKS = ("part int, first long, doc_ids array<{id}>, sizes array<int>, "
          "offsets array<long>, payload binary")


def write_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0) -> None:
    """Write the token files of ``docs`` (doc_id, text) into the folder ``path``."""
    spark = docs.sparkSession
    temp = f"{path}/ids"
    ids = tokenised(docs, tokenizer, end_id)
    ids.write.option("compression", "zstd").parquet(temp)
    rows = spark.read.schema(ids.schema).parquet(temp)
    counts = id_counts(rows)
    symbols = np.array(sorted(counts), np.int64)
    lengths = code_lengths(np.array([counts[s] for s in symbols.tolist()], np.int64))
    spark.createDataFrame(list(zip(symbols.tolist(), lengths.tolist())),
                          "id long, bits long").coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast((symbols, lengths))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(*shared.value)
        part, first, held, held_n = None, 0, [], 0

        def flush() -> pa.RecordBatch:
            payload, offsets = codes.encode(
                np.frombuffer(b"".join(x for _, _, x in held), kind_of_id).astype(np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()),
                 pa.array([[d for d, _, _ in held]], pa.list_(doc_type)),
                 pa.array([[n for _, n, _ in held]], pa.list_(pa.int32())),
                 pa.array([offsets.tolist()], pa.list_(pa.int64())),
                 pa.array([payload], pa.binary())],
                names=["part", "first", "doc_ids", "sizes", "offsets", "payload"])

        for b in batches:
            doc_type = b.column("doc_id").type
            for d, p, start, n, raw in zip(*(c.to_pylist() for c in b.columns)):
                if held and (p != part or start != first + held_n or held_n >= BLOCK_IDS):
                    yield flush()
                    held, held_n = [], 0
                if not held:
                    part, first = p, start
                held.append((d, n, raw))
                kind_of_id = f"<u{len(raw) // n}"
                held_n += n
        if held:
            yield flush()

    # the scan keeps the rows' order; a block is a run of documents of one part
    rows.mapInArrow(run, BLOCKS.format(id=kind)).write.option("compression", "none").parquet(
        f"{path}/blocks")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files of a folder: doc_id, start, n_tokens, ids_crc32."""
    pairs = spark.read.parquet(f"{path}/codes").collect()
    shared = spark.sparkContext.broadcast((np.array([r["id"] for r in pairs], np.int64),
                                           np.array([r["bits"] for r in pairs], np.int64)))
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(*shared.value)
        for b in batches:
            for i in range(b.num_rows):
                sizes = b.column("sizes")[i].values.to_numpy()
                ends = np.cumsum(sizes, dtype=np.int64)
                total = int(ends[-1])
                ids = codes.decode(np.frombuffer(b.column("payload")[i].as_buffer(), np.uint8),
                                   b.column("offsets")[i].values.to_numpy(), total)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * x:4 * y])
                       for x, y in zip((ends - sizes).tolist(), ends.tolist())]
                k = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_ids")[i].values, pa.array(np.full(k, b.column("part")[i].as_py(),
                                                                     np.int32)),
                     pa.array(b.column("first")[i].as_py() + ends - sizes),
                     pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["doc_id", "part", "start", "n_tokens", "ids_crc32"])

    docs = blocks.mapInArrow(
        run, f"doc_id {kind}, part int, start long, n_tokens long, ids_crc32 long")
    # one row per part: as many as the writing job had tasks
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = blocks.groupBy("part").agg(F.sum(size).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return docs.join(F.broadcast(parts), "part").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0,
               path: str | None = None) -> DataFrame:
    """Write the files, then return what reading them gives, one row per document."""
    path = path or work_dir(docs.sparkSession, "tokens")
    write_files(docs, tokenizer, path, end_id)
    return read_files(docs.sparkSession, path)
