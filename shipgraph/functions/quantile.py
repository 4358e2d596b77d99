"""Exact and approximate quantiles (pandas ``quantile``: linear interpolation).

``method='exact'`` uses Spark's ``percentile`` aggregate, which pre-aggregates
map-side into (value → count) maps, so its memory per group is bounded by the
number of *distinct* values, not rows.  ``method='approx'`` uses
``percentile_approx`` (mergeable Greenwald–Khanna sketches of bounded size,
rank error ≤ n/accuracy).  ``method='distributed'`` is exact as well and puts
no group into one task: the choice for few groups that can each hold a large
share of the rows (route types, facilities, the whole table); ``method='hot'`` is
the same with smaller sketches, for hundreds of groups of any size (pairs of facilities).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Size of the bracketing sketches (some 40 KB), and the values that one task orders.
SKETCH_K = 2000
FEW = 50_000
#: The same where there are hundreds of groups: sketches of some 5 KB, lists of at
#: most 5,000 values for each group and quantile, and the columns read from disk.
HOT = {"k": 200, "few": 5000, "level": StorageLevel.DISK_ONLY}


def quantile_expr(x: Column, p: float, method: str = "exact",
                  accuracy: int = 100000) -> Column:
    if method == "exact":
        return F.percentile(x, F.lit(p))
    if method == "approx":
        return F.percentile_approx(x, F.lit(p), accuracy)
    raise ValueError(f"method must be 'exact' or 'approx', got {method!r}")


def group_quantiles(df: DataFrame, keys: list[str], specs, aggs=(),
                    method: str = "exact") -> DataFrame:
    """``specs`` is [(column or Column, p, alias)], ``aggs`` extra aggregates.

    ``exact`` and ``approx`` are one aggregation pass and fit many small groups;
    ``distributed`` fits few groups of any size and ``hot`` hundreds of them
    (see :func:`distributed_quantiles`).
    """
    if method in ("distributed", "hot"):
        return distributed_quantiles(df, keys, specs, aggs, **(HOT if method == "hot" else {}))
    qcols = [quantile_expr(F.col(c) if isinstance(c, str) else c, p, method).alias(a)
             for c, p, a in specs]
    return df.groupBy(*keys).agg(*qcols, *aggs)


def global_quantiles(df: DataFrame, specs, aggs=(), method: str = "exact") -> DataFrame:
    """Whole-table quantiles as a one-row DataFrame (join it back with a cross
    join of one row, never by the driver)."""
    return group_quantiles(df, [], specs, aggs, method)


def sketch_error(k: int) -> float:
    """Rank error of a KLL sketch, two-sided, at 99 % confidence."""
    return 2.296 / k ** 0.9021


@dataclass
class _Target:
    """One quantile of one group: its ranks, the bracket [low, high] that holds
    them, and how many values lie below it and in it."""
    column: int
    ranks: tuple[int, int]
    low: float
    high: float
    below: int = 0
    inside: int = 0
    value: tuple[float, float] | None = None


def _quantiles_of(x: Column, ranks: list[float], k: int) -> Column:
    return F.when(F.count(x) > 0, F.kll_sketch_get_quantile_double(
        F.kll_sketch_agg_double(x, F.lit(k)),
        F.expr(f"array({', '.join(f'{r!r}D' for r in ranks)})")))


def distributed_quantiles(df: DataFrame, keys: list[str], specs, aggs=(), k: int = SKETCH_K,
                          few: int = FEW, level: StorageLevel = StorageLevel.MEMORY_AND_DISK
                          ) -> DataFrame:
    """Exact quantiles (linear interpolation) of few groups, however large, by
    bracketing and counting.  No row is sorted or shuffled.

    A KLL sketch per group and column, merged map-side, brackets each rank by
    twice its error.  The next pass counts exactly what lies below and in
    each bracket and sketches the inside; brackets with more than ``few`` values are
    narrowed by that sketch, ones that miss their rank (the sketch errs with a
    small probability) are opened.  At last the values inside are gathered and
    the one or two at the ranks picked.  A bracket of one value needs no gathering,
    and one that ties keep from shrinking is gathered as values with their counts.
    The driver holds a bracket per group and quantile, so this is for few groups, or
    with small sketches (``k``) for hundreds.
    """
    exprs: dict[str, int] = {}
    cols: list[Column] = []
    which = []
    for c, _, _ in specs:
        name = c if isinstance(c, str) else str(c)
        if name not in exprs:
            exprs[name] = len(cols)
            cols.append(F.col(c) if isinstance(c, str) else c)
        which.append(exprs[name])
    names = [f"_k{i}" for i in range(len(keys))]
    data = df.select(*[F.col(c).alias(n) for c, n in zip(keys, names)],
                     *[x.cast("double").alias(f"_x{i}") for i, x in enumerate(cols)]) \
        .persist(level)
    try:
        groups = _picked(data, names, [(i, p) for i, (_, p, _) in zip(which, specs)], k, few)
    finally:
        data.unpersist()
    fields = [T.StructField(c, df.schema[c].dataType) for c in keys]
    fields += [T.StructField(a, T.DoubleType()) for _, _, a in specs]
    rows = [(*key, *[None if t is None else _between(t, p) for t, (_, p, _) in zip(ts, specs)])
            for key, ts in groups.items()]
    found = df.sparkSession.createDataFrame(rows, T.StructType(fields))
    if not aggs:
        return found
    if not keys:
        return found.crossJoin(df.agg(*aggs))
    # few groups: the quantiles are as many rows as were collected
    base = df.groupBy(*keys).agg(*aggs)
    for c in keys:
        found = found.withColumnRenamed(c, f"_of_{c}")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    return base.join(F.broadcast(found), reduce(and_, same)).select(
        *keys, *[a for _, _, a in specs], *[c for c in base.columns if c not in keys])


def _between(t: tuple[_Target, float], p: float) -> float:
    """Linear interpolation as pandas does it; equal neighbours need none."""
    target, at = t
    lo, hi = target.value
    return lo if lo == hi else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi


def _picked(data: DataFrame, keys: list[str], wanted: list[tuple[int, float]], k: int, few: int
            ) -> dict[tuple, list]:
    """Per group the (target with its values, exact rank) of each wanted quantile."""
    margin, columns = 2 * sketch_error(k), sorted({i for i, _ in wanted})
    edges = {i: sorted({min(1.0, max(0.0, p + side)) for j, p in wanted if j == i
                        for side in (-margin, margin)}) for i in columns}
    aggs = []
    for i in columns:
        x = F.col(f"_x{i}")
        aggs += [F.count(x).alias(f"n{i}"), _quantiles_of(x, edges[i], k).alias(f"q{i}")]
    groups: dict[tuple, list] = {}
    for r in data.groupBy(*keys).agg(*aggs).collect():
        found = []
        for i, p in wanted:
            if not r[f"n{i}"]:
                found.append(None)
                continue
            at = (r[f"n{i}"] - 1) * p
            low, high = (r[f"q{i}"][edges[i].index(min(1.0, max(0.0, p + s)))]
                         for s in (-margin, margin))
            found.append((_Target(i, (math.floor(at), math.ceil(at)), low, high), at))
        groups[tuple(r[c] for c in keys)] = found
    grid = [g / 200 for g in range(201)]
    for step in range(8):
        open_ = [j for j in range(len(wanted))
                 if any(ts[j] and ts[j][0].value is None for ts in groups.values())]
        if not open_:
            return groups
        rows, low, high = _with_brackets(data, keys, groups, open_)
        aggs = []
        for j in open_:
            x, a, b = F.col(f"_x{wanted[j][0]}"), low[j], high[j]
            within = F.when((x >= a) & (x <= b), x)
            aggs += [F.count(F.when(x < a, 1)).alias(f"below{j}"),
                     F.count(within).alias(f"inside{j}"),
                     _quantiles_of(within, grid, k).alias(f"q{j}")]
        shrinks = []
        for r in rows.groupBy(*keys).agg(*aggs).collect():
            ts = groups[tuple(r[c] for c in keys)]
            for j in open_:
                t = ts[j] and ts[j][0]
                if not t or t.value is not None:
                    continue
                t.below, t.inside = r[f"below{j}"], r[f"inside{j}"]
                first, last = t.ranks
                if not (t.below <= first and last < t.below + t.inside):
                    t.low, t.high = ((-math.inf if first < t.below else t.low),
                                     (math.inf if last >= t.below + t.inside else t.high))
                    t.inside = -1  # counted anew
                    shrinks.append(True)
                elif t.low == t.high:
                    t.value = (t.low, t.low)
                elif t.inside > few:
                    q, share = r[f"q{j}"], [(x - t.below) / t.inside for x in t.ranks]
                    a = q[max(0, math.floor((share[0] - margin) * 200))]
                    b = q[min(200, math.ceil((share[1] + margin) * 200))]
                    shrinks.append((a, b) != (t.low, t.high))
                    t.low, t.high = max(a, t.low), min(b, t.high)
        small = [j for j in open_ if all(
            not ts[j] or ts[j][0].value is not None or 0 <= ts[j][0].inside <= few
            for ts in groups.values())]
        if small:
            _gather(data, keys, groups, small, wanted)
        elif step == 7 or not any(shrinks):
            _gather_counts(data, keys, groups, open_, wanted)
    return groups


def _with_brackets(data: DataFrame, keys: list[str], groups: dict, which: list[int]):
    """``data`` with its group's brackets, and these as columns: literals without
    keys, else a broadcast join with a table of as many rows as there are groups."""
    def edge(t, name):
        return None if t is None else getattr(t[0], name)

    if not keys:
        ts = next(iter(groups.values()))
        return data, *({j: F.lit(edge(ts[j], side)).cast("double") for j in which}
                       for side in ("low", "high"))
    fields = [T.StructField(f"_of{c}", data.schema[c].dataType) for c in keys]
    fields += [T.StructField(f"_{s}{j}", T.DoubleType()) for j in which for s in "ab"]
    table = data.sparkSession.createDataFrame(
        [(*key, *[edge(ts[j], s) for j in which for s in ("low", "high")])
         for key, ts in groups.items()], T.StructType(fields))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in keys])
    return (data.join(F.broadcast(table), same), {j: F.col(f"_a{j}") for j in which},
            {j: F.col(f"_b{j}") for j in which})


def _gather(data, keys, groups, which, wanted) -> None:
    """Sort the few values in each bracket and pick those at the ranks, where they are:
    the driver sees two values for each."""
    rows, low, high = _with_brackets(data, keys, groups, which)
    fields = [T.StructField(f"_of{c}", data.schema[c].dataType) for c in keys]
    fields += [T.StructField(f"_{s}{j}", T.LongType()) for j in which for s in "rs"]
    ranks = F.broadcast(data.sparkSession.createDataFrame(
        [(*key, *[None if ts[j] is None else x for j in which
                  for x in ((None, None) if ts[j] is None else ts[j][0].ranks)])
         for key, ts in groups.items()], T.StructType(fields)))
    aggs = []
    for j in which:
        x = F.col(f"_x{wanted[j][0]}")
        aggs += [F.count(F.when(x < low[j], 1)).alias(f"below{j}"), F.array_sort(F.collect_list(
            F.when((x >= low[j]) & (x <= high[j]), x))).alias(f"v{j}")]
    found = rows.groupBy(*keys).agg(*aggs).join(ranks, _same(keys)).select(*keys, *[
        F.get(f"v{j}", (F.col(f"_{s}{j}") - F.col(f"below{j}")).cast("int")).alias(f"{s}{j}")
        for j in which for s in "rs"])
    for r in found.collect():
        for j in which:
            t = groups[tuple(r[c] for c in keys)][j]
            if t and t[0].value is None:
                t[0].value = (r[f"r{j}"], r[f"s{j}"])


def _gather_counts(data, keys, groups, which, wanted) -> None:
    """The same for brackets that many equal values fill: by value and count."""
    for j in which:
        rows, low, high = _with_brackets(data, keys, groups, [j])
        x = F.col(f"_x{wanted[j][0]}")
        below = {tuple(r[c] for c in keys): r["n"] for r in rows.groupBy(*keys).agg(
            F.count(F.when(x < low[j], 1)).alias("n")).collect()}
        counts = (rows.where((x >= low[j]) & (x <= high[j])).groupBy(*keys, x.alias("v"))
                  .agg(F.count(F.lit(1)).alias("n")))
        upto = Window.partitionBy(*keys).orderBy("v")
        counts = counts.withColumn("upto", F.sum("n").over(upto))
        hits = {}
        for r in counts.join(_rank_table(data, keys, groups, j, below), _same(keys)).where(
                "(upto - n <= _r0 AND _r0 < upto) OR (upto - n <= _r1 AND _r1 < upto)").collect():
            hits.setdefault(tuple(r[c] for c in keys), []).append((r["upto"] - r["n"], r["upto"],
                                                                   r["v"]))
        for key, found in hits.items():
            t = groups[key][j][0]
            if t.value is None:
                at = [x - below[key] for x in t.ranks]
                t.value = tuple(next(v for a, b, v in found if a <= r < b) for r in at)


def _same(keys: list[str]):
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in keys], F.lit(True))


def _rank_table(data, keys, groups, j, below) -> DataFrame:
    fields = [T.StructField(f"_of{c}", data.schema[c].dataType) for c in keys]
    fields += [T.StructField("_r0", T.LongType()), T.StructField("_r1", T.LongType())]
    return F.broadcast(data.sparkSession.createDataFrame(
        [(*key, *[x - below[key] for x in ts[j][0].ranks]) for key, ts in groups.items()
         if ts[j]], T.StructType(fields)))
