"""Community detection (parallel modularity local moving) and modularity.

The reference agglomerates communities greedily, which is sequential.  Here
nodes fall into hash classes; in each round every node of one class evaluates
in parallel the modularity gain of joining each neighbouring community, and
moves to the best one if that gains.  A sweep is a round of each class.  Moves
made side by side can undo each other's gain, so a sweep that doesn't raise
the modularity is taken back; instead only moves are made that are the best
one of both communities they touch.  Such moves share no community, so their
gains add up: every step raises the modularity, and sweeps end when a whole
one moves nothing.  Communities then become super-nodes and the procedure
repeats until a level moves nothing.  Merged levels can leave single nodes
that would gain elsewhere, so nodes then move again from the communities found,
and levels follow again, until the nodes stay where they are:
:func:`certificate` tells the largest gain that is left to any single move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.ranking import global_row_number
from ...functions.broadcast import bounded
from .edges import undirected, vertices
from .iterate import Loop


def _symmetric(und: DataFrame) -> DataFrame:
    """(i, j, w) both directions, self-loops excluded (they add to k_i only)."""
    nl = und.where(F.col("u") != F.col("v"))
    return (nl.select(F.col("u").alias("i"), F.col("v").alias("j"), "weight")
              .union(nl.select(F.col("v").alias("i"), F.col("u").alias("j"), "weight")))


def _strength(und: DataFrame) -> DataFrame:
    """k_i: weighted degree, a self-loop counted twice."""
    ends = (und.select(F.col("u").alias("i"), "weight")
               .union(und.select(F.col("v").alias("i"), "weight")))
    return ends.groupBy("i").agg(F.sum("weight").alias("k"))


def _quality(adj: DataFrame, label: DataFrame, m: float, resolution: float, n: int) -> float:
    """Modularity of a labelling of one level, but for its constant share of loops."""
    lab = bounded(label.select("i", "c"), n)
    inner = (adj.join(lab, "i").join(bounded(label.select(F.col("i").alias("j"),
                                                          F.col("c").alias("cj")), n), "j")
             .where("c = cj").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")))
    tot = label.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("t"))
    r = inner.crossJoin(tot).first()
    return r["w"] / (2 * m) - resolution * r["t"] / (4 * m * m)


def _best_moves(adj: DataFrame, label: DataFrame, n: int, m: float, resolution: float,
                mine: Column | None = None) -> DataFrame:
    """(i, own, to, gain): the best move to another neighbouring community of each
    node where ``mine`` holds, whatever it gains.

    Moving node i from D to C gains ΔQ = (w_iC − w_iD)/m − γ k_i (tot_C − tot_D + k_i)/(2m²),
    so per node it suffices to compare max_C [w_iC/m − γ k_i tot_C/(2m²)] with the stay
    score w_iD/m − γ k_i (tot_D − k_i)/(2m²): one aggregation over (i, C) rows.
    """
    g = resolution / (2 * m * m)
    tot = label.groupBy("c").agg(F.sum("k").alias("tot"))
    me = bounded((label if mine is None else label.where(mine)).select("i", F.col("c").alias("own"), "k")
                 .join(tot.select(F.col("c").alias("own"), F.col("tot").alias("tot_own")),
                       "own"), n)
    nb = (adj.join(me, "i").join(bounded(label.select(F.col("i").alias("j"), "c"), n), "j")
          .groupBy("i", "c", "own", "k", "tot_own").agg(F.sum("weight").alias("w_ic")))
    cand = nb.join(bounded(tot, n), "c")
    move_score = F.col("w_ic") / m - g * F.col("k") * F.col("tot")
    stay_score = F.col("w_ic") / m - g * F.col("k") * (F.col("tot_own") - F.col("k"))
    other = F.col("c") != F.col("own")
    best = cand.groupBy("i", "own", "k", "tot_own").agg(
        F.max_by(F.when(other, F.col("c")),
                 F.struct(F.when(other, move_score), -F.hash("c"))).alias("to"),
        F.max(F.when(other, move_score)).alias("best"),
        F.max(F.when(~other, stay_score)).alias("stay"))
    stay0 = -g * F.col("k") * (F.col("tot_own") - F.col("k"))
    return best.where("to IS NOT NULL").select(
        "i", "own", "to", (F.col("best") - F.coalesce("stay", stay0)).alias("gain"))


def _local_moving(und: DataFrame, m: float, loop: Loop, resolution: float,
                  max_sweeps: int | None, start: DataFrame | None = None
                  ) -> tuple[DataFrame, bool]:
    """One Louvain level of parallel local moving, until no node gains by moving,
    from the communities (i, c) of ``start`` or from each node alone."""
    adj = loop.hold(_symmetric(und))
    k = loop.hold(_strength(und))
    n = k.count()
    label = loop.hold(k.select("i", F.col("i").alias("c"), "k") if start is None
                      else k.join(start, "i").select("i", "c", "k"))

    def gains(label: DataFrame, mine) -> DataFrame:
        """Each node's best move, where it gains."""
        return _best_moves(adj, label, n, m, resolution, mine).where(F.col("gain") > 1e-12)

    def moved_by(label: DataFrame, moves: DataFrame) -> DataFrame:
        # a checkpoint each time: plans that use a labelling several times would nest
        return loop.hold(label.join(bounded(moves.select("i", "to"), n), "i", "left")
                         .select("i", F.coalesce("to", "c").alias("c"), "k"))

    sweep, moved = 0, False
    quality = _quality(adj, label, m, resolution, n)
    while True:
        sweep += 1
        if max_sweeps is not None and sweep > max_sweeps:
            raise RuntimeError(f"communities still move after {max_sweeps} sweeps")
        before, n_moves = label, 0
        for turn in range(2):
            moves = gains(label, F.pmod(F.xxhash64("i"), F.lit(2)) == turn).persist()
            some = moves.count()
            if some:
                label = moved_by(label, moves)
            moves.unpersist()
            n_moves += some
        if n_moves == 0:
            return label.select("i", "c"), moved
        now = _quality(adj, label, m, resolution, n)
        if now <= quality + 1e-12:   # side-by-side moves undid each other
            moves = gains(before, F.lit(True)).persist()
            rank = F.struct("gain", "i")
            best = (moves.select(F.explode(F.array("own", "to")).alias("c"), rank.alias("r"))
                    .groupBy("c").agg(F.max("r").alias("r"))
                    .select(F.col("r.i").alias("i")).groupBy("i")
                    .agg(F.count(F.lit(1)).alias("_n")).where("_n = 2"))
            label = moved_by(before, moves.join(best, "i"))
            moves.unpersist()
            now = _quality(adj, label, m, resolution, n)
            if now <= quality:       # gains below the arithmetic's resolution
                return before.select("i", "c"), moved
        quality, moved = now, True


def communities(edges: DataFrame, max_sweeps: int | None = None, resolution: float = 1.0,
                checkpoint_every: int = 4) -> DataFrame:
    """(facility, community_id): ids numbered by community size (desc), then
    smallest member, starting at 0.  Runs until nothing moves; ``max_sweeps``
    raises instead of returning an unfinished result."""
    loop = Loop(checkpoint_every)
    edges = loop.hold(edges.select("src", "dst", "weight"))
    und = loop.hold(undirected(edges))
    m = und.agg(F.sum("weight")).first()[0] or 0.0
    nodes = vertices(edges)
    assign = loop.hold(nodes.select("facility", F.col("facility").alias("c")))

    def relabelled(col: str, lab: DataFrame) -> DataFrame:
        new = lab.withColumnRenamed("c", "c2")
        return loop.hold(assign.join(new, assign[col] == new.i, "left")
                               .select("facility", F.coalesce("c2", "c").alias("c")))

    def collapsed(level: DataFrame, lab: DataFrame) -> DataFrame:
        """The edges between communities as super-nodes."""
        a = lab.select(F.col("i").alias("_x"), F.col("c").alias("_cx"))
        b = lab.select(F.col("i").alias("_y"), F.col("c").alias("_cy"))
        return loop.hold(
            level.join(a, level.u == a._x).join(b, level.v == b._y)
            .select(F.least("_cx", "_cy").alias("u"), F.greatest("_cx", "_cy").alias("v"),
                    "weight")
            .groupBy("u", "v").agg(F.sum("weight").alias("weight")))

    while m > 0:
        lab, moved = _local_moving(und, m, loop, resolution, max_sweeps,
                                   assign.withColumnRenamed("facility", "i"))
        if not moved:
            break
        assign = relabelled("facility", lab)
        level, merged = und, False
        while True:
            level = collapsed(level, lab)
            lab, moved = _local_moving(level, m, loop, resolution, max_sweeps)
            if not moved:
                break
            assign, merged = relabelled("c", lab), True
        if not merged:   # the nodes' own moves were the last ones
            break
    sizes = assign.groupBy("c").agg(F.count(F.lit(1)).alias("_size"),
                                    F.min("facility").alias("_first"))
    ids = global_row_number(sizes, [F.col("_size").desc(), F.col("_first").asc()], "_rn")
    return (assign.join(ids.select("c", (F.col("_rn") - 1).alias("community_id")), "c")
                  .select("facility", "community_id"))


def certificate(edges: DataFrame, assignment: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row of facts on an assignment (facility, community_id):

    n_nodes and n_assigned (nodes with a community), n_communities, dense_ids (ids
    run from 0 without a gap), sizes_fall (no community is larger than one of a
    lower id), largest_gain (the most that any single node's move to a neighbouring
    community would raise the modularity; 0 or less where all are settled),
    quality and quality_alone (modularity of the assignment, and of each node alone).
    """
    loop, spark = Loop(), edges.sparkSession
    und = loop.hold(undirected(edges.select("src", "dst", "weight")))
    m = und.agg(F.sum("weight")).first()[0] or 0.0
    nodes = vertices(edges).withColumnRenamed("facility", "i")
    given = assignment.select(F.col("facility").alias("i"), F.col("community_id").alias("c"))
    label = loop.hold(nodes.join(given, "i", "left").join(_strength(und), "i", "left")
                      .select("i", "c", F.coalesce("k", F.lit(0.0)).alias("k")))
    n, n_assigned = label.agg(F.count(F.lit(1)), F.count("c")).first()
    known = label.where("c IS NOT NULL")
    gain, quality, alone = 0.0, None, None
    if m > 0:
        adj = loop.hold(_symmetric(und))
        gain = _best_moves(adj, known, n, m, resolution).agg(F.max("gain")).first()[0] or 0.0
        # a loop's weight stays inside its community, whichever that is
        loops = und.where("u = v").agg(F.sum("weight")).first()[0] or 0.0
        quality, alone = (_quality(adj, x, m, resolution, n) + loops / m for x in (
            known, known.withColumn("c", F.col("i"))))
    sizes = loop.hold(known.groupBy("c").agg(F.count(F.lit(1)).alias("size")))
    last = sizes.select((F.col("c") + 1).alias("c"), F.col("size").alias("_before"))
    f = sizes.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"),
                  F.max("c").alias("hi")).first()
    fall = sizes.join(last, "c").where("size > _before").isEmpty()
    dense = f["n"] == 0 or f["lo"] == 0 and f["hi"] == f["n"] - 1
    return spark.createDataFrame(
        [(n, n_assigned, f["n"], dense, fall, float(gain), quality, alone)],
        "n_nodes long, n_assigned long, n_communities long, dense_ids boolean, "
        "sizes_fall boolean, largest_gain double, quality double, quality_alone double")


def modularity(edges: DataFrame, assignment: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Newman modularity of a node → community assignment on the undirected
    projection: Σ_c L_c/m − γ (d_c / 2m)²  (one row, column ``modularity``)."""
    und = undirected(edges)
    a = assignment.select(F.col("facility").alias("_f"), F.col("community_id").alias("_c"))
    m = und.agg(F.sum("weight").alias("m"))
    intra = (und.join(a, und.u == a._f).withColumnRenamed("_c", "cu").drop("_f")
                .join(a, F.col("v") == a._f).withColumnRenamed("_c", "cv")
                .where(F.col("cu") == F.col("cv"))
                .groupBy(F.col("cu").alias("c")).agg(F.sum("weight").alias("L")))
    k = _strength(und)
    deg = (k.join(a, k.i == a._f).groupBy(F.col("_c").alias("c"))
            .agg(F.sum("k").alias("D")))
    per = deg.join(intra, "c", "left").crossJoin(m)
    return per.agg(F.sum(F.coalesce("L", F.lit(0.0)) / F.col("m")
                         - resolution * F.pow(F.col("D") / (2 * F.col("m")), 2))
                   .alias("modularity"))


def community_summary(assignment: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG26: number of communities, size min/median/max, cross-community
    corridor count and share."""
    sizes = assignment.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"))
    s = sizes.agg(F.count(F.lit(1)).alias("n_communities"), F.min("size").alias("min_size"),
                  F.percentile("size", 0.5).alias("median_size"), F.max("size").alias("max_size"))
    a = assignment.select(F.col("facility").alias("_f"), F.col("community_id").alias("_c"))
    e = (edges.join(a, edges.src == a._f, "left").withColumnRenamed("_c", "cs").drop("_f")
              .join(a, F.col("dst") == a._f, "left").withColumnRenamed("_c", "cd"))
    x = e.agg(F.count(F.when(F.coalesce("cs", F.lit(-1)) != F.coalesce("cd", F.lit(-1)), 1))
              .alias("cross_community_corridors"),
              F.avg((F.coalesce("cs", F.lit(-1)) != F.coalesce("cd", F.lit(-1))).cast("double"))
              .alias("cross_community_share"))
    return s.crossJoin(x)
