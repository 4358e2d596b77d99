"""Operator 1: best-fit packing of token pieces into fixed-length sequences.

Method: a configuration linear program over the histogram of piece lengths
(a configuration is a multiset of lengths that fits one sequence), solved by
multiplicative weights with a knapsack dynamic program as its pricing step,
then rounded down; what rounding leaves is a smaller program, and at last
sequences filled one by one with a knapsack of the remaining pieces.  The
weights' prices also give a lower bound on the number of sequences.  Only the histogram (at most ``capacity`` numbers, whatever
the corpus) reaches the driver; tokenising, ranking and placing are Spark jobs.

Defined results: null or empty text has only the end id; rows are pieces of
their own even when repeated or with equal or null doc_id; an empty table has
no pieces; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored
from .tokens import encoder

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Each document's ids and the end id, cut from behind into pieces of
    ``capacity``: only a document's first piece may be shorter."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            d = 0
            for ids, at in encoder(tokenizer).encode(b.column(1)):
                ids = ids.astype("<u4")
                end = np.array([end_id], "<u4")
                for k in range(len(at) - 1):
                    one = np.concatenate([ids[at[k]:at[k + 1]], end])
                    cut = [0, *range((len(one) - 1) % capacity + 1, len(one) + 1, capacity)]
                    raw = one.tobytes()
                    rows += [(d, p, x, y - x, zlib.crc32(raw[4 * x:4 * y]))
                             for p, (x, y) in enumerate(zip(cut, cut[1:]))]
                    d += 1
            t = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(t[:, 0])), pa.array(t[:, 1].astype(np.int32)),
                 pa.array(t[:, 2]), pa.array(t[:, 3]), pa.array(t[:, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, PIECES.format(id=kind))


def knapsack(value: np.ndarray, lengths: np.ndarray, copies: np.ndarray,
             capacity: int) -> tuple[np.ndarray, float]:
    """The most valuable multiset of lengths that fits, by dynamic programming
    over capacities; each length's copies go in as powers of two."""
    items: list[tuple[int, int]] = []
    for i in np.flatnonzero((copies > 0) & (value > 0)):
        left, k = int(min(copies[i], capacity // lengths[i])), 1
        while left > 0:
            k = min(k, left)
            items.append((int(i), k))
            left, k = left - k, 2 * k
    best = np.zeros(capacity + 1)
    took = np.zeros((len(items), capacity + 1), bool)
    for t, (i, k) in enumerate(items):
        size = k * int(lengths[i])
        with_it = best[:capacity + 1 - size] + k * value[i]
        better = with_it > best[size:] + 1e-12
        took[t, size:] = better
        best[size:][better] = with_it[better]
    counts, room = np.zeros(len(lengths), np.int64), capacity
    for t in range(len(items) - 1, -1, -1):
        if took[t, room]:
            i, k = items[t]
            counts[i] += k
            room -= k * int(lengths[i])
    return counts, float(best[capacity])


def best_values(price: np.ndarray) -> tuple[list, list, list]:
    """Unbounded knapsack by dynamic programming: for each capacity the greatest
    value of a multiset of lengths that fits, the length taken last (0: none)
    and the capacity that it leaves.  ``price`` is indexed by length; a length
    that may not be used has -inf."""
    n = len(price)
    best, took, rest = np.zeros(n), [0] * n, [0] * n
    back = price[::-1]  # back[n - 1 - x] is the price of x
    for w in range(1, n):
        value = best[:w] + back[n - 1 - w:n - 1]  # by the room r that is left: length w - r
        r = int(value.argmax())
        if value[r] > best[w - 1]:
            best[w], took[w], rest[w] = value[r], w - r, r
        else:
            best[w], took[w], rest[w] = best[w - 1], took[w - 1], rest[w - 1]
    return best.tolist(), took, rest


def covering(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 0.002,
             rates: tuple = (0.1, 0.03, 0.01, 0.003), phases: int | None = None
             ) -> tuple[dict[tuple, float], float]:
    """A fractional cover of the counts by configurations, and a lower bound of
    any cover, by multiplicative weights.

    Minimise the sum of x_c subject to sum_c x_c * c_i >= count_i.  A length's
    price starts at its share of the capacity and falls by
    exp(-rate) whenever its count is covered once more.  Each phase prices configurations
    by one knapsack program: its table holds, for every length, the dearest
    configuration with that length.  Those worth at least 1 - rate / 4 of the
    dearest of all (prices only fall within a phase, so the table's value
    stays an upper bound) are taken in turn, the least covered lengths first:
    x_c grows until its scarcest length is covered once more.  Prices over the
    dearest configuration's value are feasible for the dual program, so their worth
    is a lower bound; a cover divided by its least coverage is feasible.  The rate falls
    from stage to stage, each a new cover that goes on with the prices found.  A cover
    within ``gap`` of the bound is returned at once; after the last stage its shares,
    scaled to as many sequences as the bound, are (they leave some counts uncovered).
    """
    phases = phases or max(80, min(300, 20_000 // len(lengths)))
    size = capacity + 1
    demand, price = np.zeros(size), np.full(size, -np.inf)
    demand[lengths], price[lengths] = counts, lengths / capacity
    need, order = demand.tolist(), lengths.tolist()
    bound = float(lengths @ counts) / capacity
    for rate in rates:
        for phase in range(phases):
            if phase == 0:
                covered, x, total = [0.0] * size, {}, 0.0
            best, took, rest = best_values(price)
            top = best[capacity]
            bound = max(bound, float(price[lengths] @ counts) / top)
            now = (price / top).tolist()
            for first in sorted(order, key=covered.__getitem__):
                if now[first] + best[capacity - first] / top < 1 - rate / 4:
                    continue
                copies, room = {first: 1}, capacity - first
                while took[room]:
                    copies[took[room]] = copies.get(took[room], 0) + 1
                    room = rest[room]
                if sum(k * now[i] for i, k in copies.items()) < 1 - rate / 4:
                    continue
                grow = min(need[i] / k for i, k in copies.items())
                key = tuple(sorted(copies.items()))
                x[key] = x.get(key, 0.0) + grow
                total += grow
                for i, k in copies.items():
                    more = grow * k / need[i]
                    covered[i] += more
                    now[i] *= math.exp(-rate * more)
            price = np.array(now)
            once = min(covered[i] for i in order)
            if total <= once * (1 + gap) * bound:
                return {c: v / once for c, v in x.items()}, bound
    return {c: v * bound / total for c, v in x.items()}, bound


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int
                   ) -> tuple[list[tuple[np.ndarray, int]], float]:
    """(copies of each length, number of sequences), covering every count
    exactly, and the lower bound of the linear program.

    The fractional cover is rounded down, largest shares first, to what is left of the
    counts; the rest is a smaller program of the same kind, until rounding
    gives nothing; then a knapsack over the remaining pieces fills
    sequence after sequence.
    """
    full = lengths == capacity
    whole = int(counts[full].sum())
    plan = [(np.where(full, 1, 0), whole)] if whole else []
    left = np.where(full, 0, counts).astype(np.int64)
    bound = None
    while left.sum():
        here = left > 0
        x, least = covering(lengths[here], left[here], capacity)
        bound = least if bound is None else bound
        at = {int(n): i for i, n in enumerate(lengths)}
        found = 0
        for copies, share in sorted(x.items(), key=lambda e: (-e[1], e[0])):
            m = min(int(share + 1e-9), *(int(left[at[i]]) // k for i, k in copies))
            if m > 0:
                c = np.zeros(len(lengths), np.int64)
                for i, k in copies:
                    c[at[i]] = k
                plan.append((c, m))
                left -= m * c
                found += m
        if found * 20 < max(least, 1):  # rounding takes little more
            break
    worth = lengths / capacity * (1 + lengths / capacity)
    while left.sum():
        here = np.flatnonzero(left)
        some, _ = knapsack(worth[here], lengths[here], left[here], capacity)
        c = np.zeros(len(lengths), np.int64)
        c[here] = some
        used = c > 0
        m = int(np.min(left[used] // c[used]))
        plan.append((c, m))
        left -= m * c
    return plan, whole + (bound or 0.0)


def slots(plan: list[tuple[np.ndarray, int]], lengths: np.ndarray) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, copies a sequence, first sequence, offset)."""
    out: dict[int, list] = {int(x): [] for x in lengths}
    seen = dict.fromkeys(out, 0)
    base = 0
    for c, m in plan:
        at = 0
        for i in np.flatnonzero(c):
            x, k = int(lengths[i]), int(c[i])
            out[x].append((seen[x], k, base, at))
            seen[x] += k * m
            at += k * x
        base += m
    return {x: np.array(v, np.int64).reshape(-1, 4) for x, v in out.items()}


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (column length, 1 to capacity) with sequence_id and offset.

    Pieces are ranked within their length by salted groups: counts of each
    (salt, length) are summed up over the salts, so a length that most pieces
    share is spread over all tasks.
    """
    spark = pieces.sparkSession
    salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = pieces.withColumn("__salt", F.pmod(F.xxhash64(*pieces.columns), F.lit(salts)))
    groups = p.groupBy("__salt", "length").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt") \
        .rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    hist = p.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()
    lengths = np.array([r["length"] for r in hist], np.int64)
    counts = np.array([r["n"] for r in hist], np.int64)
    table = slots(configurations(lengths, counts, capacity)[0] if len(lengths) else [], lengths)
    within = Window.partitionBy("__salt", "length").orderBy("doc_id", "piece", "start")
    ranked = (p.withColumn("__k", F.row_number().over(within) - 1)
               .join(groups.select("__salt", "length", "__before"), ["__salt", "length"])
               .select(*pieces.columns, (F.col("__k") + F.col("__before")).alias("__rank")))
    names = [*pieces.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("__rank").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for x in np.unique(size):
                of = np.flatnonzero(size == x)
                t = table[int(x)]
                r = t[np.searchsorted(t[:, 0], rank[of], side="right") - 1]
                j = rank[of] - r[:, 0]
                seq[of] = r[:, 2] + j // r[:, 1]
                off[of] = r[:, 3] + (j % r[:, 1]) * x
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(seq), pa.array(off)], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024,
                     end_id: int = 2) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text)."""
    return pack(stored(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
