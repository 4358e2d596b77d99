"""Shortest-path centralities from blocks of sources.

Sources are worked off in blocks of bounded size.  A block's state is a table of
matrices: one row per strip of sources and group of nodes holds their distances,
path counts σ and dependencies δ.  The edges from one group to another are one row, too.
A step joins the matrices to the edges of their group and works out each strip's next
matrix of a group in a task: distances by relaxation (Bellman–Ford), σ over the
tight edges, δ backwards over them (Brandes), each until nothing changes.  The block's share
of closeness and betweenness is added to totals per node and its state is
dropped, so the state is O(block · N), never all pairs; every source is
processed and the result is exact.  A task holds one strip's matrices and the edges of
one group, and nothing is gathered.

Edges without a distance connect nothing.  Negative distances are refused,
and so are zero distances where paths are counted (cycles of length 0 have
infinitely many shortest paths).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.broadcast import bounded
from ...functions.ranking import global_row_number
from ...session import ship_code
from .edges import vertices
from .iterate import Loop

#: Sources whose distances to all nodes exist at the same time.
BLOCK = 1024
#: Sources and nodes of one matrix.
STRIP, GROUP = 64, 256
STATE = "g int, k int, d binary, sigma binary, delta binary, moved boolean"


def _usable(edges: DataFrame, distance_col: str, least: float = 0.0,
            open_end: bool = False) -> DataFrame:
    """(v, w, c): edges with a distance and without self-loops."""
    e = (edges.where(F.col("src") != F.col("dst"))
              .select(F.col("src").alias("v"), F.col("dst").alias("w"),
                      F.col(distance_col).cast("double").alias("c"))
              .where(F.col("c").isNotNull() & ~F.isnan("c")))
    low = e.agg(F.min("c")).first()[0]
    if low is not None and (low < least or open_end and low == least):
        raise ValueError(f"distances must be {'above' if open_end else 'at least'} {least}, "
                         f"got {low}")
    return e


def _distances(e: DataFrame, n_e: int, sources: DataFrame, loop: Loop) -> DataFrame:
    eb = bounded(e, n_e).withColumnRenamed("v", "t")
    dist = loop.keep(sources.select("s", F.col("s").alias("t"), F.lit(0.0).alias("d")), 1)
    frontier, i = dist, 1
    while True:
        i += 1
        cand = (frontier.join(eb, "t").groupBy("s", F.col("w").alias("t"))
                        .agg(F.min(F.col("d") + F.col("c")).alias("d")))
        old = dist.select("s", "t", F.col("d").alias("_old"), F.lit(True).alias("_seen"))
        better = (cand.join(old, ["s", "t"], "left")
                      .where(F.col("_seen").isNull() | (F.col("d") < F.col("_old")))
                      .select("s", "t", "d")).persist()
        if better.isEmpty():
            better.unpersist()
            return dist
        dist = loop.keep(dist.join(better.select("s", "t"), ["s", "t"], "left_anti")
                             .unionByName(better), i)
        if frontier is not dist:
            frontier.unpersist()
        frontier = better


def shortest_paths(edges: DataFrame, distance_col: str = "weight",
                   sources: DataFrame | None = None, checkpoint_every: int = 3) -> DataFrame:
    """(s, t, d): shortest distance from each source (column ``s``; all nodes by
    default) to every node t it reaches (d(s,s) = 0).  All sources at once."""
    loop = Loop(checkpoint_every)
    edges = loop.hold(edges.select("src", "dst", distance_col))
    e = loop.hold(_usable(edges, distance_col))
    src = sources if sources is not None else vertices(edges).select(F.col("facility").alias("s"))
    return _distances(e, e.count(), src, loop)


def _packed(e: DataFrame, node: str, other: str, group: int) -> DataFrame:
    """One row (k, o, near, far, c) for the edges between two groups of nodes: their places in
    the group k of ``node``, in order, their places in the group o of ``other``, and distances."""
    def run(t: pa.Table) -> pa.Table:
        near, far, c, k, o = (t[x].to_numpy() for x in ("near", "far", "c", "k", "o"))
        order = np.argsort(near, kind="stable")
        return pa.table([pa.array([k[0]], pa.int32()), pa.array([o[0]], pa.int32()),
                         *[pa.array([x[order].tobytes()], pa.binary()) for x in (near, far, c)]],
                        names=["k", "o", "near", "far", "c"])

    def place(col):
        return (F.col(col) % group).cast("int"), F.floor(F.col(col) / group).cast("int")

    (near, k), (far, o) = place(node), place(other)
    return (e.select(k.alias("k"), o.alias("o"), near.alias("near"), far.alias("far"), "c")
             .groupBy("k", "o").applyInArrow(run, "k int, o int, near binary, far binary, c binary"))


def _start(spark: SparkSession, lo: int, hi: int, n: int, strip: int, group: int) -> DataFrame:
    """The state of the sources lo to hi: each is at distance 0 of itself alone."""
    groups = -(-n // group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                g, k = divmod(i, groups)
                first = lo + g * strip
                d = np.full((group, strip), np.nan)
                at = np.arange(first, min(hi, first + strip)) - k * group
                own = np.flatnonzero((at >= 0) & (at < group))
                d[at[own], own] = 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g], pa.int32()), pa.array([k], pa.int32()),
                     pa.array([d.tobytes()], pa.binary()), pa.nulls(1, pa.binary()),
                     pa.nulls(1, pa.binary()), pa.array([True])],
                    names=["g", "k", "d", "sigma", "delta", "moved"])

    return spark.range(-(-(hi - lo) // strip) * groups).mapInArrow(run, STATE)


def _runs(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places of a sorted run of them, and where each begins."""
    first = np.flatnonzero(np.diff(near, prepend=-1))
    return near[first], first


def _relaxed(own: dict, others: list[dict], edges: list[tuple]) -> dict:
    new = own["d"].copy()
    for o, (near, far, c) in zip(others, edges):
        at, first = _runs(near)
        new[at] = np.fmin(new[at], np.fmin.reduceat(o["d"][far] + c[:, None], first))
    return {"d": new, "moved": bool((np.isnan(own["d"]) & ~np.isnan(new)
                                     | (new < own["d"])).any())}


def _counted(own: dict, others: list[dict], edges: list[tuple]) -> dict:
    """σ(s,w) = [w = s] + Σ_{tight (s,v,w)} σ(s,v)"""
    seed = (own["d"] == 0).astype(float)
    new = seed.copy()
    for o, (near, far, c) in zip(others, edges):
        at, first = _runs(near)
        sigma = o["sigma"] if o["sigma"] is not None else (o["d"] == 0).astype(float)
        tight = o["d"][far] + c[:, None] == own["d"][near]
        new[at] += np.add.reduceat(np.where(tight, sigma[far], 0.0), first)
    old = own["sigma"] if own["sigma"] is not None else seed
    return {"sigma": new, "moved": bool((new != old).any())}


def _depending(own: dict, others: list[dict], edges: list[tuple]) -> dict:
    """δ(s,v) = Σ_{tight (s,v,w)} σ(s,v)/σ(s,w) · (1 + δ(s,w))"""
    total = np.zeros_like(own["d"])
    for o, (near, far, c) in zip(others, edges):
        at, first = _runs(near)
        later = o["delta"] if o["delta"] is not None else 0.0
        share = np.divide(1 + later, o["sigma"], out=np.zeros_like(total), where=o["sigma"] > 0)
        tight = own["d"][near] + c[:, None] == o["d"][far]
        total[at] += np.add.reduceat(np.where(tight, share[far], 0.0), first)
    new = own["sigma"] * total
    old = own["delta"] if own["delta"] is not None else 0.0
    return {"delta": new, "moved": bool((np.abs(new - old) > 1e-12 * np.abs(new)).any())}


def _settled(state: DataFrame, edges: DataFrame, work: Callable, loop: Loop, strip: int,
             group: int) -> DataFrame:
    """The state after steps of ``work`` until no matrix changes: it gets a strip's own row of
    a group, its rows of the groups that share edges with this one, and those edges."""
    def matrices(row: dict) -> dict:
        return row | {x: np.frombuffer(row[x]).reshape(group, strip)
                      for x in ("d", "sigma", "delta") if row[x] is not None}

    def run(t: pa.Table) -> pa.Table:
        rows = [matrices(r) for r in t.to_pylist()]
        own = next(r for r in rows if r["near"] is None)
        others = [r for r in rows if r["near"] is not None]
        new = own | work(own, others, [
            (np.frombuffer(r["near"], np.int32), np.frombuffer(r["far"], np.int32),
             np.frombuffer(r["c"])) for r in others])
        kept = [None if new[x] is None else new[x].tobytes() for x in ("d", "sigma", "delta")]
        return pa.table([pa.array([new["g"]], pa.int32()), pa.array([new["k"]], pa.int32()),
                         *[pa.array([x], pa.binary()) for x in kept], pa.array([new["moved"]])],
                        names=["g", "k", "d", "sigma", "delta", "moved"])

    i = 0
    while True:
        i += 1
        far = state.withColumnRenamed("k", "o").join(edges, "o").select(*state.columns, "near",
                                                                        "far", "c")
        own = state.select("*", *[F.lit(None).cast("binary").alias(x)
                                  for x in ("near", "far", "c")])
        state = loop.keep(own.unionByName(far).groupBy("g", "k").applyInArrow(run, STATE), i)
        if state.where("moved").isEmpty():
            return state


def _shares(state: DataFrame, lo: int, strip: int, group: int) -> DataFrame:
    """(idx, r, tot, b) of each strip and node: the sources that reach the node, their
    distances' sum and their dependencies' sum, without the node itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d = np.frombuffer(row["d"]).reshape(group, strip)
                idx = row["k"] * group + np.arange(group)
                source = lo + row["g"] * strip + np.arange(strip)
                use = ~np.isnan(d) & (idx[:, None] != source)
                b = np.zeros(group)
                if row["delta"] is not None:
                    b = np.where(use, np.frombuffer(row["delta"]).reshape(group, strip), 0).sum(1)
                some = use.any(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(idx[some], pa.int64()), pa.array(use.sum(1)[some], pa.int64()),
                     pa.array(np.where(use, d, 0).sum(1)[some]), pa.array(b[some])],
                    names=["idx", "r", "tot", "b"])

    return state.mapInArrow(run, "idx long, r long, tot double, b double")


def path_centralities(edges: DataFrame, distance_col: str = "weight", normalized: bool = True,
                      block: int = BLOCK, count_paths: bool = True,
                      checkpoint_every: int = 3, strip: int = STRIP,
                      group: int = GROUP) -> DataFrame:
    """(facility, closeness, betweenness) of every vertex.

    Closeness is on incoming distances with the Wasserman–Faust correction:
    r/Σd · r/(N−1), r = number of other nodes that reach the node.
    Betweenness is directed, normalised by 1/((N−1)(N−2)); without
    ``count_paths`` it is left out (NULL).
    """
    spark, loop = edges.sparkSession, Loop(checkpoint_every)
    ship_code(spark)
    edges = loop.hold(edges.select("src", "dst", distance_col))
    nodes = loop.hold(global_row_number(vertices(edges), [F.col("facility")], "idx")
                      .withColumn("idx", F.col("idx") - 1))
    n = nodes.count()
    e = _usable(edges, distance_col, 0.0, open_end=count_paths)
    v, w = (nodes.select(F.col("facility").alias(x), F.col("idx").alias(f"{x}_idx"))
            for x in ("v", "w"))
    e = loop.hold(e.join(bounded(v, n), "v").join(bounded(w, n), "w"))
    into = loop.hold(_packed(e, "w_idx", "v_idx", group))
    out = loop.hold(_packed(e, "v_idx", "w_idx", group)) if count_paths else None
    total = None
    for lo in range(0, n, block):
        state = _start(spark, lo, min(n, lo + block), n, strip, group)
        state = _settled(state, into, _relaxed, loop, strip, group)
        if count_paths:
            state = _settled(state, into, _counted, loop, strip, group)
            state = _settled(state, out, _depending, loop, strip, group)
        part = _shares(state, lo, strip, group)
        part = part if total is None else total.unionByName(part)
        total = loop.hold(part.groupBy("idx").agg(
            F.sum("r").alias("r"), F.sum("tot").alias("tot"), F.sum("b").alias("b")))
        loop.close()
    if total is None:
        return nodes.select("facility", F.lit(0.0).alias("closeness"),
                            F.lit(0.0).alias("betweenness"))
    c = F.when((F.col("tot") > 0) & (F.lit(n) > 1),
               (F.col("r") / F.col("tot")) * (F.col("r") / F.lit(max(n - 1, 1))))
    scale = 1.0 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0
    b = F.coalesce("b", F.lit(0.0)) * F.lit(scale) if count_paths else F.lit(None).cast("double")
    return nodes.join(total, "idx", "left").select(
        "facility", F.coalesce(c, F.lit(0.0)).alias("closeness"), b.alias("betweenness"))


def closeness(edges: DataFrame, distance_col: str = "weight", block: int = BLOCK) -> DataFrame:
    return path_centralities(edges, distance_col, block=block, count_paths=False).select(
        "facility", "closeness")


def betweenness(edges: DataFrame, distance_col: str = "weight", normalized: bool = True,
                block: int = BLOCK) -> DataFrame:
    return path_centralities(edges, distance_col, normalized, block).select(
        "facility", "betweenness")
