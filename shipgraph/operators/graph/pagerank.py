"""Weighted PageRank and HITS by power iteration over edge/rank DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.broadcast import bounded
from .edges import vertices
from .iterate import Loop


def pagerank(edges: DataFrame, alpha: float = 0.85, max_iter: int = 500,
             tol: float = 1e-6, checkpoint_every: int = 5) -> DataFrame:
    """PageRank with weight-proportional transitions and dangling mass spread
    uniformly (personalisation uniform).

    Stops when Σ|x' − x| < N·tol; raises when ``max_iter`` steps don't get there.

    Each step: ranks ⋈ transitions (hash-partitioned on src, checkpointed
    once) → sum per dst; the dangling mass is a one-row aggregate joined back
    by a one-row cross join.
    """
    loop = Loop(checkpoint_every)
    edges = loop.hold(edges.select("src", "dst", "weight"))
    nodes = loop.hold(vertices(edges))
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("pagerank", F.lit(0.0))
    out_w = edges.groupBy("src").agg(F.sum("weight").alias("_ow"))
    trans = loop.hold(edges.join(out_w, "src")
                           .where(F.col("_ow") > 0)
                           .select("src", "dst", (F.col("weight") / F.col("_ow")).alias("p")))
    live = trans.select(F.col("src").alias("facility")).distinct()
    dangling = loop.hold(nodes.join(live, "facility", "left_anti"))
    x = loop.keep(nodes.withColumn("x", F.lit(1.0 / n)), 1)
    db = bounded(dangling, n)
    for i in range(1, max_iter + 1):
        # x is materialised, so using it twice in one plan costs no recompute;
        # the dangling mass is a one-row aggregate joined by a one-row cross join
        dmass = (x.join(db, "facility", "left_semi")
                  .agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("_d")))
        xb = bounded(x, n)
        contrib = (trans.join(xb, xb.facility == trans.src)
                        .groupBy(F.col("dst").alias("facility"))
                        .agg(F.sum(F.col("x") * F.col("p")).alias("_c")))
        new = (nodes.join(bounded(contrib, n), "facility", "left").crossJoin(dmass)
                    .select("facility",
                            (alpha * F.coalesce(F.col("_c"), F.lit(0.0))
                             + (alpha * F.col("_d") + (1 - alpha)) / n).alias("x")))
        new = loop.keep(new, i + 1, release=False)
        err = (new.join(bounded(x.withColumnRenamed("x", "_old"), n), "facility")
                  .agg(F.sum(F.abs(F.col("x") - F.col("_old")))).first()[0])
        loop.release_but(new)
        x = new
        if err < n * tol:
            return x.withColumnRenamed("x", "pagerank")
    raise RuntimeError(f"PageRank is not within {tol} after {max_iter} steps")


def hits(edges: DataFrame, max_iter: int = 1000, tol: float = 1e-8,
         checkpoint_every: int = 5) -> DataFrame:
    """Weighted HITS: authority ∝ Aᵀh, hub ∝ A·a, each normalised to sum 1
    (the principal singular vectors of the weighted adjacency matrix).
    Nodes without edges on a side get 0.  Stops when Σ|a' − a| < tol; raises
    when ``max_iter`` steps don't get there."""
    loop = Loop(checkpoint_every)
    edges = loop.hold(edges.select("src", "dst", "weight"))
    nodes = loop.hold(vertices(edges))
    e = loop.hold(edges.where(F.col("weight") != 0).select("src", "dst", "weight"))
    n = nodes.count()
    h = loop.keep(nodes.withColumn("h", F.lit(1.0)).withColumn("a", F.lit(0.0)), 1)

    def normalised(df: DataFrame, c: str) -> DataFrame:
        return (df.crossJoin(df.agg(F.sum(c).alias("_s")))
                  .select("facility", (F.col(c) / F.col("_s")).alias(c)))

    step = 1
    for i in range(1, max_iter + 1):
        hb = bounded(h.select("facility", "h"), n)
        # authority step materialised so the hub step and the join reuse it
        a_new = loop.keep(normalised(e.join(hb, hb.facility == e.src)
                                      .groupBy(F.col("dst").alias("facility"))
                                      .agg(F.sum(F.col("h") * F.col("weight")).alias("a")), "a"),
                          step := step + 1, release=False)
        ab = bounded(a_new, n)
        h_new = normalised(e.join(ab, ab.facility == e.dst)
                            .groupBy(F.col("src").alias("facility"))
                            .agg(F.sum(F.col("a") * F.col("weight")).alias("h")), "h")
        new = loop.keep(nodes.join(bounded(h_new, n), "facility", "left")
                             .join(bounded(a_new, n), "facility", "left")
                             .select("facility", F.coalesce("h", F.lit(0.0)).alias("h"),
                                     F.coalesce("a", F.lit(0.0)).alias("a")), step := step + 1,
                        release=False)
        err = (new.join(bounded(h.select("facility", F.col("a").alias("_o")), n), "facility")
                  .agg(F.sum(F.abs(F.col("a") - F.col("_o")))).first()[0]) or 0.0
        loop.release_but(new)
        h = new
        if err < tol:
            return h.select("facility", F.col("h").alias("hub_score"),
                            F.col("a").alias("authority_score"))
    raise RuntimeError(f"HITS is not within {tol} after {max_iter} steps")
