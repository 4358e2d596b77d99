"""Operator 5: n-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word shingles.  Equal sets are one class from the start.
MinHash bands give candidates; linked to their bucket's first member (never
pair by pair) they fall into loose groups.  Within a group, blocks of
documents are compared: MinHash values are looked at a few at a time, a pair
is dropped when the posterior probability of a similarity at or above the
threshold falls below a tolerance, and what is left is verified exactly on
the shingle sets.  Blocks return counts of links and a spanning forest, never
pairs; classes are the connected components of the verified links.

Defined results: null or empty text has no shingle, and all such documents
form one class (equal sets); fewer words than a shingle make one shingle of
all; words are lower-cased and parted by ASCII white space; repeated rows are
documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE, ROW, bytes_of, doc_runs, located, small_batches, stored
from .graph import components
from .words import SPACE_WORDS, mix, spans, window_hashes, window_starts, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Bands of rows: a pair at the threshold misses all with probability 3e-6.
BANDS, BAND_ROWS = 42, 6
#: MinHash values kept for comparison, and how many are looked at in one step.
KEPT, STEP = 128, 32
#: A pair is dropped when its posterior chance to reach the threshold is below this.
TOLERANCE = 1e-7
#: Documents of one block of a large group.
BLOCK = 256


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Each document's shingle hashes (not yet distinct)."""
    if not len(data):
        return [np.zeros(0, np.uint64)] * (len(off) - 1)
    st, en, doc = spans(data, off, SPACE_WORDS)
    h = word_hashes(data, st, en)
    w = window_hashes(h, k)
    out = []
    for x, y in zip(doc[:-1].tolist(), doc[1:].tolist()):
        out.append(w[x:y - k + 1] if y - x >= k else
                   window_hashes(h[x:y], y - x) if y > x else np.zeros(0, np.uint64))
    return out


def text_sets(arr: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    data, off = bytes_of(arr)
    for i, j in doc_runs(off):
        for s in shingles(data[off[i]:off[j]], off[i:j + 1] - off[i], k):
            yield np.unique(s)


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    n = BANDS * BAND_ROWS
    return (rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1),
            rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32))


PERM_A, PERM_B = permutations()
FULL = np.uint32(0xFFFFFFFF)


def minhash(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(PERM_A), FULL)
    for i in range(0, len(x), 1024):
        v = x[i:i + 1024, None] * PERM_A
        v += PERM_B
        np.minimum(least, v.min(0), out=least)
    return least


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Per band one 64-bit key, of its number and its MinHash values."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(BAND_ROWS):
        key = mix(key ^ sig[r::BAND_ROWS].astype(np.uint64)) + np.uint64(r)
    return key


SIGNED = ("doc_id {id}, `%s` string, `%s` long, n int, d1 long, d2 long, "
          "bands array<long>, sig binary" % (FILE, ROW))


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Per document: set size, a 128-bit digest of the set, band keys, low MinHash bits."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d1, d2, bands, sig = [], [], [], [], []
            for s in text_sets(b.column(3), k):
                m = minhash(s)
                n.append(len(s))
                d1.append(np.add.reduce(mix(s)).view(np.int64))
                d2.append(np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64))
                bands.append(band_keys(m).view(np.int64) if len(s) else np.zeros(0, np.int64))
                sig.append((m[:KEPT] & np.uint32(0xFFFF)).astype("<u2").tobytes())
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            at = np.append(0, np.cumsum([len(x) for x in bands])).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(n, pa.int32()), pa.array(d1, pa.int64()),
                 pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(at), flat),
                 pa.array(sig, pa.binary())],
                names=["doc_id", FILE, ROW, "n", "d1", "d2", "bands", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", FILE, ROW, F.lower("text").alias("text")).mapInArrow(
        run, SIGNED.format(id=kind))


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For STEP, 2 STEP, ... compared values: the fewest matches with which the
    posterior of the similarity (uniform prior) still reaches the threshold
    with probability ``tolerance`` or more."""
    out, grid = [], (np.arange(20_000) + 0.5) / 20_000
    for n in range(STEP, KEPT + 1, STEP):
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(logs - logs.max())
            if p[grid >= threshold].sum() / p.sum() >= tolerance:
                out.append(m)
                break
    return out


def candidate_pairs(sig: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray,
                    threshold: float, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of left x right (once each, when they are the same) that survive."""
    x, y = np.meshgrid(left, right, indexing="ij")
    x, y = x.ravel(), y.ravel()
    if left is right:
        x, y = x[x < y], y[x < y]
    small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
    ok = small >= threshold * large - 1e-9
    x, y = x[ok], y[ok]
    met = np.zeros(len(x), np.int64)
    for step, need in enumerate(least):
        part = sig[:, step * STEP:(step + 1) * STEP]
        for i in range(0, len(x), 1 << 15):
            met[i:i + (1 << 15)] += (part[x[i:i + (1 << 15)]]
                                     == part[y[i:i + (1 << 15)]]).sum(1)
        ok = met >= need
        x, y, met = x[ok], y[ok], met[ok]
    return x, y


def overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of pairs of sorted sets.  Many pairs are
    counted by products of 0/1 matrices over slices of the shingles in use."""
    if len(x) < 200:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                         for a, b in zip(x, y)], np.int64)
    used = np.unique(np.concatenate([x, y]))
    at = np.zeros(len(sets), np.int64)
    at[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    vocab, col, times = np.unique(np.concatenate([sets[u] for u in used]),
                                  return_inverse=True, return_counts=True)
    shared = times > 1
    rank = np.cumsum(shared) - 1
    keep = shared[col]
    row, col, width = row[keep], rank[col[keep]], int(shared.sum())
    total = np.zeros((len(used), len(used)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for c in range(0, width, 4096):
        i, j = np.searchsorted(col, [c, c + 4096])
        m = np.zeros((len(used), 4096), np.float32)
        m[row[i:j], col[i:j] - c] = 1
        total += m @ m.T
    return total[at[x], at[y]].astype(np.int64)


def compare(uid: list[int], block: np.ndarray, size: np.ndarray, n: np.ndarray,
            sig: np.ndarray, texts: pa.Array, same: bool, k: int, threshold: float,
            least: list[int]) -> list[tuple[int, int, int, int]]:
    """Rows (uid, forest parent, linked sets, documents of linked sets) of two
    blocks, or of one with itself (``same``)."""
    first = np.flatnonzero(block == block.min())
    second = first if same else np.flatnonzero(block != block.min())
    x, y = candidate_pairs(sig, n, first, second, threshold, least)
    if not len(x):
        return []
    sets = list(text_sets(texts, k))
    both = overlaps(sets, x, y)
    ok = both * (1 + threshold) >= threshold * (n[x] + n[y]) - 1e-9
    x, y = x[ok], y[ok]
    links, docs = np.zeros(len(uid), np.int64), np.zeros(len(uid), np.int64)
    for a, b in ((x, y), (y, x)):
        np.add.at(links, a, 1)
        np.add.at(docs, a, size[b])
    up = list(range(len(uid)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in zip(x.tolist(), y.tolist()):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(uid[i], uid[root(i)], int(links[i]), int(docs[i]))
            for i in np.flatnonzero(links).tolist()]


def block_links(rows: DataFrame, k: int, threshold: float, tolerance: float) -> DataFrame:
    """Compare within (comp, bi, bj); rows arrive sorted by that key, so a task
    holds one block pair at a time."""
    least = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            got = compare(t["uid"].to_pylist(), t["block"].to_numpy(), t["size"].to_numpy(),
                          t["n"].to_numpy().astype(np.int64),
                          np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2")
                          .reshape(t.num_rows, KEPT),
                          t["text"].combine_chunks(), t["bi"][0] == t["bj"][0], k, threshold,
                          least)
            cols = list(zip(*got)) if got else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                              names=["uid", "parent", "links", "docs"])

        key, held = None, []
        for b in batches:
            keys = list(zip(*[b.column(c).to_pylist() for c in ("comp", "bi", "bj")]))
            i = 0
            while i < len(keys):
                j = i
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if keys[i] != key and held:
                    yield flush(held)
                    held = []
                key = keys[i]
                held.append(b.slice(i, j - i))
                i = j
        if held:
            yield flush(held)

    small_batches(rows.sparkSession)
    return (rows.repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj", "uid")
            .mapInArrow(run, "uid long, parent long, links long, docs long"))


def joined(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD,
           tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc_id, FILE, ROW, class_id (smallest doc_id of the
    class), class_size, n_links (other documents at or above the threshold),
    n_linked_sets, kept (one row per class: its smallest doc_id's first row)."""
    rows = located(docs).select("doc_id", "text", FILE, ROW)
    a = stored(signatures(rows, k).withColumn("uid", F.monotonically_increasing_id()), "sets")
    # equal sets are one class; the first row of each stands for it
    sets = stored(a.groupBy("d1", "d2", "n").agg(
        F.min("uid").alias("rep"), F.count(F.lit(1)).alias("size"),
        F.min(F.struct("doc_id", "uid")).alias("first")), "classes")
    reps = a.join(sets.select(F.col("rep").alias("uid"), "size"), "uid")
    keys = reps.select("uid", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("uid").alias("leader"),
                                      F.count(F.lit(1)).alias("m")).where("m > 1")
    stars = (keys.join(buckets, "key").where("uid != leader")
             .select(F.col("uid").alias("a"), F.col("leader").alias("b")).distinct())
    loose = stored(components(stars), "loose")
    groups = (loose.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
              .select("root", F.ceil(F.col("m") / BLOCK).cast("long").alias("blocks")))
    block = F.pmod(F.xxhash64("uid"), F.col("blocks"))
    members = (loose.select(F.col("node").alias("uid"), "root").join(groups, "root")
               .withColumn("block", block))
    text = rows.select(FILE, ROW, F.lower("text").alias("text"))
    dealt = (members.join(reps.select("uid", FILE, ROW, "n", "size", "sig"), "uid")
             .join(text, [FILE, ROW])
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"),
                                                       F.col("blocks") - 1)))
             .select("uid", F.col("root").alias("comp"), F.least("block", "other").alias("bi"),
                     F.greatest("block", "other").alias("bj"), "block", "n", "size", "sig",
                     "text"))
    links = stored(block_links(dealt, k, threshold, tolerance), "links")
    linked = links.groupBy(F.col("uid").alias("rep")).agg(F.sum("links").alias("links"),
                                                         F.sum("docs").alias("docs"))
    root = components(links.select(F.col("uid").alias("a"), F.col("parent").alias("b")))
    found = (sets.join(linked, "rep", "left")
             .join(root.select(F.col("node").alias("rep"), "root"), "rep", "left")
             .withColumn("root", F.coalesce("root", "rep")))
    classes = found.groupBy("root").agg(F.min("first").alias("first"),
                                        F.sum("size").alias("class_size"))
    found = stored(found.drop("first").join(classes, "root"), "found")
    return a.select("doc_id", FILE, ROW, "uid", "d1", "d2", "n").join(
        found, ["d1", "d2", "n"]).select(
        "doc_id", FILE, ROW, F.col("first.doc_id").alias("class_id"), "class_size",
        (F.coalesce("docs", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.coalesce("links", F.lit(0)).alias("n_linked_sets"),
        (F.col("first.uid") == F.col("uid")).alias("kept"))


def similar_documents(docs: DataFrame, **how) -> DataFrame:
    return joined(docs, **how).drop(FILE, ROW)


def drop_similar(docs: DataFrame, **how) -> DataFrame:
    """One document of each class, with the documents' own columns."""
    rows = located(docs)
    gone = stored(joined(rows, **how).where("not kept").select(FILE, ROW), "dropped")
    return rows.join(gone, [FILE, ROW], "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns])
