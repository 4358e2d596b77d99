"""Byte-level BPE ids of whole texts, and bytes of ids, by Spark's higher-order functions.

A text is split by the tokenizer's pattern (Unicode white space, as the
library reads it).  A match that is a token itself has one id.  Any other
match is an array of single bytes that a fold merges: each step joins the
leftmost adjacent pair of the lowest rank and looks up the two pairs that the
joint piece forms with its neighbours.  Ranks are a literal of the plan: maps
from piece to rank, dealt to buckets by the piece's CRC so that a look-up
scans few keys.  Bytes are characters U+0000 to U+00FF (ISO-8859-1).

The commonest distinct matches of the corpus, COMMON at most, are folded once and
broadcast.  Matches beyond them are folded where they stand, so the
bound saves work and never changes an id.  Matches of more than LONG bytes,
where a fold's steps would each copy a long array, go to a heap in Python.

Null and empty texts have no ids.  Repeated rows, and rows of one key, each
keep their result; columns other than the keys are left out.  An empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_code, stored

#: Distinct matches whose ids are broadcast at most (some 100 bytes each).
COMMON = 500_000
#: Bytes of a match that the fold takes; longer ones go to the heap.
LONG = 64
#: More than the places of a match that the fold takes.
PLACES = 128
BYTES = "ISO-8859-1"


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a rank file (base64 piece and rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def _buckets(entries: dict[str, object], kind: str) -> Column:
    """A literal array of maps: an entry's map is its key's CRC modulo their number."""
    n = 1 << max(4, len(entries).bit_length() - 2)
    parts: list[dict] = [{} for _ in range(n)]
    for k, v in entries.items():
        parts[zlib.crc32(k.encode()) % n][k] = v
    return F.from_json(F.lit(json.dumps(parts)), f"array<map<string,{kind}>>")


def _get(buckets: Column, key: Column) -> Column:
    at = F.crc32(key.cast("binary")).bitwiseAND(F.size(buckets) - 1).cast("int")
    return F.try_element_at(F.get(buckets, at), key)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(word: Column, ranks: Column) -> Column:
    """The ids of one match, not null and not empty."""

    def state(pieces, pairs):
        # rank and place in one number: the least is the leftmost of the lowest rank
        return _let(pairs, lambda r: F.struct(
            pieces.alias("p"), r.alias("r"), (F.array_min(F.transform(
                r, lambda x, k: x * PLACES + k)) % PLACES + 1).alias("i")))

    def merge(s, _):
        p, r, i, n = s["p"], s["r"], s["i"], F.size(s["p"])
        one = F.concat(F.get(p, i - 1), F.get(p, i))

        def joined(m):
            no = F.slice(r, 1, 0)
            left = F.array(_get(ranks, F.concat(F.get(p, i - 2), m)))
            right = F.array(_get(ranks, F.concat(m, F.get(p, i + 1))))
            return state(F.flatten(F.array(F.slice(p, 1, i - 1), F.array(m),
                                           F.slice(p, i + 2, n))),
                         F.flatten(F.array(F.when(i > 2, F.slice(r, 1, i - 2)).otherwise(no),
                                           F.when(i > 1, left).otherwise(no),
                                           F.when(i + 1 < n, right).otherwise(no),
                                           F.slice(r, i + 2, n))))

        return F.when(i.isNull(), s).otherwise(_let(one, joined))

    def merged(b):
        p = F.split(b, "")
        pairs = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p)),
                           lambda x, y: _get(ranks, F.concat(x, y)))
        return F.aggregate(F.sequence(F.lit(2), F.length(b)), state(p, pairs), merge,
                           lambda s: F.transform(s["p"], lambda x: _get(ranks, x)))

    def ids(b):
        whole = _get(ranks, b)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(merged(b))

    return _let(F.decode(F.encode(word, "UTF-8"), BYTES), ids)


def heap_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long match: the lowest-ranked, leftmost pair comes off a heap."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1)
            if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if end[i] != j or j >= n or end[j] != stop:  # a piece has grown or gone since
            continue
        end[i], end[j] = stop, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(word[a:end[b]])) is not None:
                heapq.heappush(heap, (r, a, b, end[b]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = after[i]
    return out


def _common(split: DataFrame, ranks: Column, most: int, long: int) -> DataFrame:
    """(w, known) of the commonest distinct matches, each folded once: those in
    at least t rows, with the lowest t above 1 that leaves at most ``most``."""
    seen = stored(split.select(F.explode(F.array_distinct("__words")).alias("w"))
                  .where(F.octet_length("w") <= long).groupBy("w")
                  .agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "matches")
    sizes = seen.groupBy(F.least("n", F.lit(10_000)).alias("n")).count()
    total, least = 0, None
    for n, count in sorted(sizes.collect(), reverse=True):  # 10,000 rows at most
        total += count
        if total > most:
            break
        least = n
    if least is None:
        seen, least = seen.limit(0), 0
    return seen.where(F.col("n") >= least).select(
        "w", _let(ranks, lambda r: fold(F.col("w"), r)).alias("known"))


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text",
            keys: tuple[str, ...] = ("doc_id",), common: int = COMMON, long: int = LONG
            ) -> DataFrame:
    """Per row of ``docs`` the key columns and ``ids`` (array of int).

    A text's matches become rows of their own, which meet the common ones'
    ids in a broadcast join and are folded otherwise; as both keep the order,
    a text's rows stay together, and a task sets its ids in a row again."""
    spark = docs.sparkSession
    ship_code(spark)
    # rows of this plan are single matches, so batches of many are small; Spark's own check of
    # a batch's bytes after each row costs more than the row
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str((1 << 31) - 1))
    table = read_ranks(path)
    ranks = _buckets({k.decode(BYTES): v for k, v in table.items()}, "int")
    words = F.regexp_extract_all(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")),
                                 F.lit(f"(?U){pattern}"), F.lit(0))
    names = [f"__key{i}" for i in range(len(keys))]
    split = docs.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)],
                        words.alias("__words"))
    known = _common(split, ranks, common, long)
    rows = (split.withColumn("__row", F.monotonically_increasing_id())
            .select(*names, "__row", F.explode_outer("__words").alias("w"))
            .join(F.broadcast(known), "w", "left"))
    far = F.octet_length("w") > long
    folded = F.when(far | F.col("w").isNull(), F.lit(None)).otherwise(
        F.coalesce("known", _let(ranks, lambda r: fold(F.col("w"), r))))
    schema = T.StructType([T.StructField(k, docs.schema[k].dataType) for k in keys]
                          + [T.StructField("ids", T.ArrayType(T.IntegerType()))])
    sent = spark.sparkContext.broadcast(table)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of a row that may go on in the next batch
        for b in batches:
            row = b.column("__row").to_numpy()
            cut = int(np.searchsorted(row, row[-1])) if len(row) else 0
            if cut:
                yield whole([*held, b.slice(0, cut)])
                held = []
            elif held and len(row) and held[-1].column("__row")[-1].as_py() != row[0]:
                yield whole(held)
                held = []
            if len(row):
                held.append(b.slice(cut))
        if held:
            yield whole(held)

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        ids = t["ids"].combine_chunks()
        if t["far"].null_count < len(t):
            got, texts = ids.to_pylist(), t["far"].to_pylist()
            ids = pa.array([heap_ids(w.encode(), sent.value) if w is not None else i
                            for i, w in zip(got, texts)], pa.list_(pa.int32()))
        first = np.flatnonzero(np.diff(t["__row"].to_numpy(), prepend=-1))
        size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        at = np.append(0, np.cumsum(size))[np.append(first, len(t))]
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), ids.flatten())
        some = t.select(names).take(pa.array(first)).combine_chunks()
        return pa.RecordBatch.from_arrays([*[some[n].combine_chunks() for n in names], lists],
                                          names=schema.names)

    return rows.select(*names, "__row", folded.alias("ids"),
                       F.when(far, F.col("w")).alias("far")).mapInArrow(together, schema)


def decoded(df: DataFrame, path: str, ids: str = "ids", name: str = "bytes") -> DataFrame:
    """``df`` plus the bytes (binary) of its ids.  A null array gives null; an
    id that no piece has raises."""
    pieces = {v: k for k, v in read_ranks(path).items()}
    table = F.from_json(F.lit(json.dumps([pieces[i].decode(BYTES) for i in range(len(pieces))])),
                        "array<string>")
    joined = _let(table, lambda t: F.array_join(
        F.transform(ids, lambda i: F.element_at(t, i + 1)), ""))
    return df.withColumn(name, F.encode(joined, BYTES))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: n_tokens, and the SHA-256 of its ids in decimal, joined by
    one space, and of the bytes that they decode to."""
    back = decoded(encoded(docs, path, pattern), path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
                       .alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
