"""Operator 9: substring deduplication with difference-cover anchors.

Two equal windows of 20 words at any two places share an aligned anchor: with
a difference cover modulo 13, some shift k below 13 puts both places plus k
on cover positions, and the 8 words from there lie within both windows.  So
only the 8-word windows at cover positions (4 of 13) are hashed and compared
across the corpus; around anchors that recur, the full windows are hashed
(extension), and of each window all but its first occurrence are removed.

Work is cut into blocks of rows that are neighbours in their file.  A block
sends each anchor and each window once, whatever their number in it, so a
passage in a third of all documents gives a task one entry a block, not one a
document; what comes back to a block is bounded by what it sent.

Defined results: null or empty text has no words; fewer than 20 words are
never covered; documents are ordered by doc_id (null first), rows with one
doc_id by block and place, and repeated rows lose all covered words but the
first one's; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE, ROW, bytes_of, doc_runs, located, small_batches, stored
from .words import SPACE_WORDS, TWIN, spans, window_hashes, window_starts, word_hashes

WINDOW = 20
# a difference cover modulo 13: every difference modulo 13 is one of two members
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Neighbouring rows that make a block, and characters of text for each bucket
#: of hashes (buckets grow with the corpus, so a bucket's size doesn't).
BLOCK_ROWS, BUCKET_CHARS, LEAST_BUCKETS = 128, 4 << 20, 256
IS_COVER = np.isin(np.arange(PERIOD), COVER)


def _parts(arr: pa.Array):
    """Runs of documents: first one's number, bytes, word starts, ends, bounds."""
    data_all, off_all = bytes_of(arr)
    for i, j in doc_runs(off_all):
        data = data_all[off_all[i]:off_all[j]]
        off = off_all[i:j + 1] - off_all[i]
        if len(data):
            yield i, data, off, *spans(data, off, SPACE_WORDS)


def anchors(h: np.ndarray, bounds: np.ndarray):
    """Hash, document and place within it of the anchors at cover positions."""
    at, doc = window_starts(bounds, ANCHOR)
    place = at - bounds[doc]
    on = IS_COVER[place % PERIOD]
    return window_hashes(h, ANCHOR)[at[on]], doc[on], place[on]


def _by_bucket(h: np.ndarray, buckets: int):
    """Sorted distinct (bucket, low half) keys of hashes."""
    return ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def anchor_sets(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, low halves of the block's distinct anchors)."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(block: int, held: list[np.ndarray]) -> pa.RecordBatch:
            key, times = np.unique(np.concatenate(held), return_counts=True)
            key = np.repeat(key, np.minimum(times, 2))  # twice: recurs within the block
            which = (key >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.diff(which, prepend=-1))
            low = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
            ends = np.append(cut[1:], len(key))
            return pa.RecordBatch.from_arrays(
                [pa.array(which[cut].astype(np.int32)), pa.array(np.full(len(cut), block)),
                 pa.array([low[x:y].tobytes() for x, y in zip(cut.tolist(), ends.tolist())],
                          pa.binary())], names=["bucket", "block", "keys"])

        now, held = None, []
        for b in batches:
            blocks = b.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(blocks)) + 1
            for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)]):
                if x == y:
                    continue
                if now != blocks[x] and held:
                    yield flush(now, held)
                    held = []
                now = blocks[x]
                for _, data, _, st, en, doc in _parts(b.column(1).slice(x, y - x)):
                    h, _, _ = anchors(word_hashes(data, st, en), doc)
                    if len(h):
                        held.append(_by_bucket(h, buckets))
        if held:
            yield flush(now, held)

    return rows.select("block", "text").mapInArrow(run, "bucket int, block long, keys binary")


def repeated(sets: DataFrame) -> DataFrame:
    """(block, bucket, keys): of each sent set the keys that occur elsewhere too."""
    def fn(t: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, "<u4") for k in t["keys"].to_pylist()]
        every, times = np.unique(np.concatenate(keys), return_counts=True)
        again = every[times > 1]
        out = []
        for block, k in zip(t["block"].to_pylist(), keys):
            k = np.unique(k)
            at = np.minimum(np.searchsorted(again, k), max(len(again) - 1, 0))
            k = k[again[at] == k] if len(again) else k[:0]
            if len(k):
                out.append((block, k.astype("<u4").tobytes()))
        return pa.table({"block": pa.array([x for x, _ in out], pa.int64()),
                         "bucket": pa.array([t["bucket"][0].as_py()] * len(out), pa.int32()),
                         "keys": pa.array([k for _, k in out], pa.binary())})

    return sets.groupBy("bucket").applyInArrow(fn, "block long, bucket int, keys binary")


class Block:
    """The candidate windows of a block's documents, in doc_id order."""

    def __init__(self, docs: pa.Table, known: list[tuple[int, bytes]], buckets: int):
        order = sorted(range(docs.num_rows), key=lambda i: (
            docs["doc_id"][i].as_py() is not None, docs["doc_id"][i].as_py() or 0,
            docs[FILE][i].as_py(), docs[ROW][i].as_py()))
        self.docs = docs.take(pa.array(order, pa.int64())) if order else docs
        self.text = self.docs["text"].combine_chunks()
        self.buckets = buckets
        again = [np.frombuffer(k, "<u4").astype(np.uint64) | np.uint64(b) << np.uint64(32)
                 for b, k in known]
        again = np.sort(np.concatenate(again)) if again else np.zeros(0, np.uint64)
        a, b, docs_at, place = [], [], [], []
        for i, data, off, st, en, bounds in _parts(self.text):
            h = word_hashes(data, st, en)
            key, doc, at = anchors(h, bounds)
            key = _by_bucket(key, buckets)
            hit = again[np.minimum(np.searchsorted(again, key), max(len(again) - 1, 0))] == key \
                if len(again) else np.zeros(len(key), bool)
            n = np.diff(bounds)
            mark = np.zeros(len(h) + 1, np.int64)
            lo = bounds[doc[hit]] + np.maximum(at[hit] - PERIOD + 1, 0)
            hi = bounds[doc[hit]] + np.minimum(at[hit], n[doc[hit]] - WINDOW) + 1
            ok = hi > lo
            np.add.at(mark, lo[ok], 1)
            np.add.at(mark, hi[ok], -1)
            start = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            if len(start):
                a.append(window_hashes(h, WINDOW)[start])
                b.append(window_hashes(word_hashes(data, st, en, TWIN), WINDOW, TWIN)[start])
                d = np.searchsorted(bounds, start, side="right") - 1
                docs_at.append(d + i)
                place.append(start - bounds[d])
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.hash, other = cat(a, np.uint64), cat(b, np.uint64)
        self.doc, self.place = cat(docs_at, np.int64), cat(place, np.int64)
        self.bucket = (other % np.uint64(buckets)).astype(np.int64)
        # one entry per distinct window, at its first occurrence here
        order = np.lexsort((self.place, self.doc, self.hash, self.bucket))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(self.hash[order].view(np.int64)) != 0) | (np.diff(self.bucket[order]) != 0)
        self.first = order[new]
        self.entry = np.zeros(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1

    def sets(self, block: int) -> pa.Table:
        ids = self.docs["doc_id"].to_pylist()
        ids = np.array([-(1 << 63) if x is None else x for x in ids], "<i8")
        which = self.bucket[self.first]
        cut = np.flatnonzero(np.diff(which, prepend=-1))
        ends = np.append(cut[1:], len(which)) if len(cut) else cut
        rows = [(int(which[x]), self.hash[self.first[x:y]].astype("<u8").tobytes(),
                 *np.unique(self.doc[self.first[x:y]], return_inverse=True))
                for x, y in zip(cut.tolist(), ends.tolist())]
        return pa.table({
            "bucket": pa.array([r[0] for r in rows], pa.int32()),
            "block": pa.array([block] * len(rows), pa.int64()),
            "keys": pa.array([r[1] for r in rows], pa.binary()),
            "ids": pa.array([ids[r[2]].tobytes() for r in rows], pa.binary()),
            "owner": pa.array([r[3].astype("<u2").tobytes() for r in rows], pa.binary())})

    def result(self, later: list[tuple[int, bytes]]) -> pa.Table:
        """Digest rows; ``later``: per bucket one bit per entry, set where its
        window starts earlier in another block."""
        gone = np.zeros(len(self.first), bool)
        which = self.bucket[self.first]
        for bucket, bits in later:
            x, y = np.searchsorted(which, [bucket, bucket + 1])
            gone[x:y] = np.unpackbits(np.frombuffer(bits, np.uint8))[:y - x]
        again = np.ones(len(self.entry), bool)
        again[self.first] = False
        remove = again | gone[self.entry]
        by_doc = np.argsort(self.doc, kind="stable")
        cut = np.searchsorted(self.doc[by_doc], np.arange(self.docs.num_rows + 1))
        n_words, n_removed, kept = [], [], []
        for d, text in enumerate(self.text):
            words = (text.as_py() or "").encode().split()
            own = by_doc[cut[d]:cut[d + 1]]
            start = self.place[own[remove[own]]]
            if len(start):
                mark = np.zeros(len(words) + 1, np.int64)
                np.add.at(mark, start, 1)
                np.add.at(mark, np.minimum(start + WINDOW, len(words)), -1)
                stay = np.cumsum(mark[:-1]) == 0
                left = [w for w, s in zip(words, stay.tolist()) if s]
            else:
                left = words
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        return pa.table({
            "doc_id": self.docs["doc_id"].combine_chunks(),
            "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            "kept_text": pa.array([k.decode() for k in kept], pa.string())})


def first_elsewhere(sets: DataFrame) -> DataFrame:
    """(block, bucket, bits): which of a block's windows start earlier in another block."""
    def fn(t: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, "<u8") for k in t["keys"].to_pylist()]
        ids = [np.frombuffer(i, "<i8")[np.frombuffer(o, "<u2")]
               for i, o in zip(t["ids"].to_pylist(), t["owner"].to_pylist())]
        size = np.array([len(k) for k in keys])
        blocks = t["block"].to_numpy()
        key, doc, block = np.concatenate(keys), np.concatenate(ids), np.repeat(blocks, size)
        order = np.lexsort((block, doc, key))
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        later = np.zeros(len(order), bool)
        later[order] = ~new
        ends = np.cumsum(size)
        bits = [np.packbits(later[x:y]).tobytes() for x, y in zip(ends - size, ends)]
        some = [b for b in range(len(bits)) if any(bits[b])]
        return pa.table({"block": pa.array(blocks[some], pa.int64()),
                         "bucket": pa.array([t["bucket"][0].as_py()] * len(some), pa.int32()),
                         "keys": pa.array([bits[b] for b in some], pa.binary())})

    return sets.groupBy("bucket").applyInArrow(fn, "block long, bucket int, keys binary")


def without_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, on
    request, kept_text (the words that stay, joined by one space)."""
    rows = located(docs.select("doc_id", "text")).withColumn(
        "block", F.xxhash64(FILE, F.floor(F.col(ROW) / BLOCK_ROWS)))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-chars // BUCKET_CHARS))
    again = stored(repeated(anchor_sets(rows, buckets)).withColumn("step", F.lit(1)), "anchors")

    def pairs(t: pa.Table, step: int) -> list[tuple[int, bytes]]:
        return [(b, k) for s, b, k in zip(t["step"].to_pylist(), t["bucket"].to_pylist(),
                                         t["keys"].to_pylist()) if s == step]

    def windows(d: pa.Table, known: pa.Table) -> pa.Table:
        block = d["block"][0].as_py() if d.num_rows else 0
        return Block(d, pairs(known, 1), buckets).sets(block)

    sent = rows.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(
        windows, "bucket int, block long, keys binary, ids binary, owner binary")
    later = stored(first_elsewhere(sent).withColumn("step", F.lit(2)), "windows")
    kind = docs.schema["doc_id"].dataType.simpleString()
    cols = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text

    def apply(d: pa.Table, known: pa.Table) -> pa.Table:
        return Block(d, pairs(known, 1), buckets).result(pairs(known, 2)).select(cols)

    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" \
        + ", kept_text string" * keep_text
    return rows.groupBy("block").cogroup(again.unionByName(later).groupBy("block")).applyInArrow(
        apply, schema)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
           FROM documents),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
seen AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ')
                                             ORDER BY doc_id, i) AS k FROM win),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM
         (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM seen WHERE k > 1) GROUP BY doc_id),
r AS (SELECT doc_id, w, [p FOR p IN range(1, len(w) + 1)
                         IF ps IS NULL OR NOT list_contains(ps, p)] AS stay
      FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(stay) AS BIGINT) AS n_removed,
       sha256(array_to_string([w[p] FOR p IN stay], ' ')) AS kept_sha256
FROM r
"""
