"""Operator 7: benchmark decontamination.

The n-gram set of the benchmark (normalised words) is broadcast in parts of
checked size; each part's hashes are looked up for every window of a
document's words, hits are verified word by word, and the hit spans or the
documents that hold them are removed.  A benchmark beyond the size of one part
is worked off part by part, so no broadcast grows with it.

Defined results: null or empty text has no words and no hit; items without
words count for nothing; equal windows of several items hit all of them;
repeated rows are judged each on its own; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FILE, ROW, append_columns, bytes_of, doc_runs, located, small_batches, stored
from .words import spans, table, window_hashes, window_starts, word_hashes

#: Words of an item that make a window.
WINDOW = 10
#: Bytes of benchmark text in one broadcast part (its n-grams take some 40 times that).
PART_BYTES = 4 << 20
# fixed values: what is no word character, after lower-casing A-Z
WORD = table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Grams:
    """Windows of benchmark items: words joined by a space -> items; per window
    length the sorted hashes and a bitmap of their low bits."""
    items: dict[bytes, tuple[str, ...]]
    hashes: dict[int, np.ndarray]
    bitmap: dict[int, np.ndarray]


BITS = 22


def _low(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << BITS) - 1)).astype(np.int64)


def grams(ids: list[str], texts: list[str | None], k: int) -> Grams:
    items: dict[bytes, set[str]] = {}
    hashes: dict[int, list[np.ndarray]] = {}
    data, off = bytes_of(pa.array(texts, pa.string()))
    data = LOWER[data]
    st, en, doc = spans(data, off, WORD) if len(data) else (np.zeros(0, int),) * 2 + (off,)
    raw = data.tobytes()
    words = [raw[x:y] for x, y in zip(st.tolist(), en.tolist())]
    h = word_hashes(data, st, en) if len(data) else np.zeros(0, np.uint64)
    for i, name in enumerate(ids):
        lo, hi = int(doc[i]), int(doc[i + 1])
        if lo == hi:
            continue
        n = min(k, hi - lo)
        for a in range(lo, hi - n + 1):
            items.setdefault(b" ".join(words[a:a + n]), set()).add(name)
        hashes.setdefault(n, []).append(window_hashes(h[lo:hi], n))
    flat = {n: np.unique(np.concatenate(v)) for n, v in hashes.items()}
    maps = {}
    for n, v in flat.items():
        maps[n] = np.zeros(1 << BITS, bool)
        maps[n][_low(v)] = True
    return Grams({w: tuple(sorted(s)) for w, s in items.items()}, flat, maps)


def find(arr: pa.Array, g: Grams) -> Iterator[tuple[int, list[tuple[int, int, int, int]], list[str]]]:
    """Per document: number of words, hit runs (first word, end word, first and
    end byte) that don't touch, and the items."""
    data_all, off_all = bytes_of(arr)
    for i, j in doc_runs(off_all):
        data = LOWER[data_all[off_all[i]:off_all[j]]]
        off = off_all[i:j + 1] - off_all[i]
        if not len(data):
            for _ in range(i, j):
                yield 0, [], []
            continue
        st, en, doc = spans(data, off, WORD)
        h = word_hashes(data, st, en)
        raw = None
        hits: dict[int, list[tuple[int, int]]] = {}
        names: dict[int, set[str]] = {}
        for n, want in g.hashes.items():
            w = window_hashes(h, n)
            at, of = window_starts(doc, n)
            if not len(at):
                continue
            near = np.flatnonzero(g.bitmap[n][_low(w[at])])
            w = w[at[near]]
            near = near[want[np.minimum(np.searchsorted(want, w), len(want) - 1)] == w]
            for p, d in zip(at[near].tolist(), of[near].tolist()):
                raw = raw if raw is not None else data.tobytes()
                got = g.items.get(b" ".join([raw[st[q]:en[q]] for q in range(p, p + n)]))
                if got:
                    hits.setdefault(d, []).append((p, p + n))
                    names.setdefault(d, set()).update(got)
        for d in range(j - i):
            runs: list[list[int]] = []
            for x, y in sorted(hits.get(d, [])):
                if runs and x <= runs[-1][1]:
                    runs[-1][1] = max(y, runs[-1][1])
                else:
                    runs.append([x, y])
            yield (int(doc[d + 1] - doc[d]),
                   [(int(x - doc[d]), int(y - doc[d]), int(st[x] - off[d]), int(en[y - 1] - off[d]))
                    for x, y in runs], sorted(names.get(d, ())))


RUN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("first", "last", "from", "to")])
FIELDS = T.StructType([T.StructField("n_words", T.LongType()),
                       T.StructField("hit_runs", T.ArrayType(RUN)),
                       T.StructField("items", T.ArrayType(T.StringType()))])
ARROW_RUNS = pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "from", "to")]))


def parts(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> list[DataFrame]:
    """The benchmark in parts of about ``part_bytes`` of text."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // part_bytes) or 1
    if n == 1:
        return [b]
    return [b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def hits(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, part_bytes: int = PART_BYTES,
         text: str = "text") -> list[DataFrame]:
    """For each part of the benchmark: ``docs`` with n_words, hit_runs and items."""
    spark, out = docs.sparkSession, []
    for part in parts(benchmark, part_bytes):
        rows = part.collect()
        shared = spark.sparkContext.broadcast(
            grams([r["item_id"] or "" for r in rows], [r["text"] for r in rows], k))

        def fn(arr: pa.Array, shared=shared) -> list[pa.Array]:
            n, runs, items = zip(*find(arr, shared.value)) if len(arr) else ((), (), ())
            runs = [[dict(zip(("first", "last", "from", "to"), r)) for r in x] for x in runs]
            return [pa.array(n, pa.int64()), pa.array(runs, ARROW_RUNS),
                    pa.array(items, pa.list_(pa.string()))]

        out.append(append_columns(docs, text, fn, FIELDS))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW,
                 part_bytes: int = PART_BYTES, text: str = "text") -> DataFrame:
    """``docs`` with n_words, hit_runs (maximal, ascending) and items over the
    whole benchmark.  Over several parts, hits meet by the rows' addresses."""
    found = hits(located(docs) if docs.columns and FILE not in docs.columns else docs,
                 benchmark, k, part_bytes, text)
    if len(found) == 1:
        return found[0]
    more = [stored(f.where(F.size("items") > 0).select(FILE, ROW, "hit_runs", "items"), "hits")
            for f in found[1:]]
    rest = (reduce(DataFrame.unionByName, more).groupBy(FILE, ROW)
            .agg(F.flatten(F.collect_list("hit_runs")).alias("__runs"),
                 F.flatten(F.collect_list("items")).alias("__items")))
    all_runs = F.array_sort(F.concat("hit_runs", F.coalesce("__runs", F.expr(
        "cast(array() as array<struct<first:int,last:int,`from`:int,`to`:int>>)"))))
    # ascending runs: a run that starts within the last one extends it
    merged = F.expr("""aggregate(__all, cast(array() as
        array<struct<first:int,last:int,`from`:int,`to`:int>>), (a, r) ->
        CASE WHEN size(a) > 0 AND r.first <= element_at(a, -1).last THEN
          concat(slice(a, 1, size(a) - 1), array(named_struct(
            'first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, r.last),
            'from', element_at(a, -1).from, 'to', greatest(element_at(a, -1).to, r.to))))
        ELSE concat(a, array(r)) END)""")
    names = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("__items", F.expr(
        "cast(array() as array<string>)")))))
    return (found[0].join(rest, [FILE, ROW], "left").withColumn("__all", all_runs)
            .withColumn("items", names).withColumn("hit_runs", merged)
            .drop("__runs", "__items", "__all"))


def report(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW,
           part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document with the digest columns of the contract."""
    d = contaminated(docs.select("doc_id", "text"), benchmark, k, part_bytes)
    n_hit = F.aggregate("hit_runs", F.lit(0), lambda a, r: a + r["last"] - r["first"])
    return d.select("doc_id", "n_words", n_hit.cast("long").alias("n_hit"),
                    F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    (F.size("hit_runs") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents",
                  k: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove='spans'``) with the
    hit spans cut out of their texts; the columns stay as they are."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be 'documents' or 'spans', got {remove!r}")
    own = [F.col(f"`{c}`") for c in docs.columns]
    data = docs.select(*own[:0], F.struct(*own).alias("__doc"), F.col("text").alias("__text"))
    if remove == "documents":
        found = contaminated(data, benchmark, k, part_bytes, "__text")
        return found.where(F.size("hit_runs") == 0).select("__doc.*")
    found = contaminated(data, benchmark, k, part_bytes, "__text")
    raw = F.encode("__doc.text", "utf-8")
    cut = F.expr("""aggregate(hit_runs, struct(cast('' as binary) as t, 0 as p),
        (a, r) -> struct(concat(a.t, substring(__raw, a.p + 1, r.from - a.p)) as t, r.to as p),
        a -> decode(concat(a.t, substring(__raw, a.p + 1)), 'utf-8'))""")
    new = F.when(F.size("hit_runs") == 0, F.col("__doc.text")).otherwise(cut)
    return (found.withColumn("__raw", raw)
            .withColumn("__doc", F.col("__doc").withField("text", new)).select("__doc.*"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(
       coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(
       coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
       FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bi),
di AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw)
       WHERE len(w) >= n),
h AS (SELECT rid, item_id, i, di.n FROM di JOIN bw ON di.n = bw.n
       AND array_to_string(w[i:i + di.n - 1], ' ') = g),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h)
      GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
       FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN it USING (rid)
"""
