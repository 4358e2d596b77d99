"""Node features, structural risk score, hub rankings, corridor enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import average_rank_desc
from ..session import concurrently, cut_lineage
from .corridor import KEYS, top_k
from .graph.edges import degrees, induced_subgraph, neighbourhood, vertices
from .graph.pagerank import hits, pagerank
from .graph.paths import path_centralities

# fixed values: default structural-risk weights
RISK_WEIGHTS = {
    "norm_betweenness": 0.30,
    "norm_sla_breach": 0.25,
    "norm_delay": 0.20,
    "norm_throughput": 0.15,
    "norm_pagerank": 0.10,
}
RISK_INPUTS = {
    "norm_betweenness": "betweenness",
    "norm_sla_breach": "avg_sla_breach",
    "norm_delay": "avg_delay_ratio",
    "norm_throughput": "total_trips",
    "norm_pagerank": "pagerank",
}


def node_centrality(edges: DataFrame, pagerank_tol: float = 1e-6, hits_tol: float = 1e-8,
                    distance_col: str = "weight") -> DataFrame:
    """GRF16: degrees, weighted degrees, betweenness, PageRank, closeness, HITS
    — one row per vertex, missing values 0; PageRank and HITS run to tolerance."""
    from .graph.iterate import Loop
    edges = Loop().hold(edges.select("src", "dst", "weight"))
    nodes = vertices(edges)
    # three loops of small jobs that don't depend on each other
    parts = [degrees(edges), *concurrently(edges.sparkSession, [
        lambda: path_centralities(edges, distance_col),
        lambda: pagerank(edges, tol=pagerank_tol), lambda: hits(edges, tol=hits_tol)])]
    out = nodes
    for p in parts:
        out = out.join(p, "facility", "left")
    cols = ["in_degree", "out_degree", "total_degree", "in_degree_w", "out_degree_w",
            "betweenness", "pagerank", "closeness", "hub_score", "authority_score"]
    # one row per vertex: written once to the checkpoint folder and reused
    return cut_lineage(out.select("facility",
                                  *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols]))


def node_features(centrality: DataFrame, facility: DataFrame,
                  community: DataFrame | None = None) -> DataFrame:
    """JN2: centralities ⋈ facility statistics (missing → 0) and the community
    id (missing → −1)."""
    stat_cols = [c for c in facility.columns if c != "facility"]
    j = centrality.join(facility, "facility", "left")
    if community is not None:
        j = j.join(community.select("facility", "community_id"), "facility", "left")
    else:
        j = j.withColumn("community_id", F.lit(None).cast("long"))
    keep = [c for c in centrality.columns if c != "facility"]
    return j.select("facility", *keep,
                    F.coalesce(F.col("community_id"), F.lit(-1)).cast("long").alias("community_id"),
                    *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in stat_cols])


def structural_risk(nodes: DataFrame, weights: dict | None = None) -> DataFrame:
    """GRF17+GRF18: min-max normalise the five inputs (+1e-10 guard) and add
    the weighted ``structural_risk_score``; an absent input column counts as 0.
    The min/max are a one-row aggregate joined back by a one-row cross join."""
    weights = weights or RISK_WEIGHTS
    df = nodes
    for norm, src in RISK_INPUTS.items():
        if src not in df.columns:
            df = df.withColumn(src, F.lit(0.0))
    mm = df.agg(*[F.min(s).alias(f"_mn_{s}") for s in RISK_INPUTS.values()],
                *[F.max(s).alias(f"_mx_{s}") for s in RISK_INPUTS.values()])
    df = df.crossJoin(F.broadcast(mm))
    for norm, src in RISK_INPUTS.items():
        lo, hi = F.col(f"_mn_{src}"), F.col(f"_mx_{src}")
        df = df.withColumn(norm, (F.col(src) - lo) / (hi - lo + F.lit(1e-10)))
    score = None
    for col, w in weights.items():
        term = F.lit(w) * F.col(col)
        score = term if score is None else score + term
    return df.withColumn("structural_risk_score", score).drop(*mm.columns)


def risk_rank(nodes_with_risk: DataFrame) -> DataFrame:
    """WIN1: average rank of the risk score, descending, truncated."""
    return average_rank_desc(nodes_with_risk, "structural_risk_score", "risk_rank")


def top_hubs(nodes_with_risk: DataFrame, n: int = 20,
             sort_by: str = "structural_risk_score") -> DataFrame:
    """TOP3 + PRJ15 + WIN3: top ``n`` hubs by a metric with display columns."""
    t = top_k(nodes_with_risk, n, sort_by, ["facility"])
    from pyspark.sql import Window
    w = Window.orderBy(F.col(sort_by).desc(), F.col("facility"))   # n rows only
    return t.select(
        F.row_number().over(w).alias("rank"), "facility", "structural_risk_score",
        "betweenness", "pagerank", "total_trips", "avg_sla_breach", "avg_delay_ratio",
        "community_id", "in_degree", "out_degree",
        F.round(F.col("betweenness") * 100, 3).alias("betweenness_pct"),
        F.round(F.col("avg_sla_breach") * 100, 1).alias("sla_breach_pct"),
        F.round(F.col("avg_delay_ratio"), 2).alias("delay_ratio"),
        F.round(F.col("structural_risk_score"), 4).alias("risk_score"))


def risk_components(nodes_with_risk: DataFrame, n: int = 25) -> DataFrame:
    """TOP5: the normalised components of the top ``n`` risk hubs."""
    return top_k(nodes_with_risk, n, "structural_risk_score", ["facility"]).select(
        "facility", "norm_betweenness", "norm_sla_breach", "norm_delay",
        "norm_throughput", "norm_pagerank", "structural_risk_score")


def corridor_enriched(corridors: DataFrame, nodes_with_risk: DataFrame) -> DataFrame:
    """JN3 + GRF19: source/destination centralities, risk and community on
    every corridor (role-playing joins; missing → 0, community → −1)."""
    n = nodes_with_risk.select("facility", "betweenness", "pagerank", "structural_risk_score",
                               "community_id")
    s = n.select(F.col("facility").alias("source_center"),
                 F.col("betweenness").alias("src_betweenness"),
                 F.col("pagerank").alias("src_pagerank"),
                 F.col("structural_risk_score").alias("src_risk"),
                 F.col("community_id").alias("src_community"))
    d = n.select(F.col("facility").alias("destination_center"),
                 F.col("betweenness").alias("dst_betweenness"),
                 F.col("pagerank").alias("dst_pagerank"),
                 F.col("structural_risk_score").alias("dst_risk"),
                 F.col("community_id").alias("dst_community"))
    j = corridors.join(s, "source_center", "left").join(d, "destination_center", "left")
    z = F.lit(0.0)
    j = (j.withColumn("src_betweenness", F.coalesce("src_betweenness", z))
          .withColumn("dst_betweenness", F.coalesce("dst_betweenness", z))
          .withColumn("src_pagerank", F.coalesce("src_pagerank", z))
          .withColumn("dst_pagerank", F.coalesce("dst_pagerank", z))
          .withColumn("src_risk", F.coalesce("src_risk", z))
          .withColumn("dst_risk", F.coalesce("dst_risk", z))
          .withColumn("src_community", F.coalesce("src_community", F.lit(-1)))
          .withColumn("dst_community", F.coalesce("dst_community", F.lit(-1))))
    return (j.withColumn("cross_community",
                         (F.col("src_community") != F.col("dst_community")).cast("int"))
             .withColumn("corridor_risk", (F.col("src_risk") + F.col("dst_risk")) / 2))


def ego_subgraph(edges: DataFrame, nodes_with_risk: DataFrame, top_n: int = 30,
                 core_n: int = 5) -> DataFrame:
    """GRF20: edges among the top-``top_n`` risk hubs plus every predecessor and
    successor of the top-``core_n`` hubs (no node cap: whole result)."""
    ranked = top_k(nodes_with_risk, top_n, "structural_risk_score", ["facility"])
    core = top_k(nodes_with_risk, core_n, "structural_risk_score", ["facility"])
    ego = ranked.select("facility").union(neighbourhood(edges, core)).distinct()
    return induced_subgraph(edges, ego)


def community_subgraph(edges: DataFrame, nodes_with_risk: DataFrame,
                       min_trips: float = 5) -> DataFrame:
    """FLT8 + SET3: the subgraph induced by facilities with more than
    ``min_trips`` trips that are graph vertices."""
    busy = nodes_with_risk.where(F.col("total_trips") > min_trips).select("facility")
    busy = busy.join(vertices(edges), "facility", "left_semi")
    return induced_subgraph(edges, busy)


def hub_exposure(shipments: DataFrame, nodes_with_risk: DataFrame, n: int = 3) -> DataFrame:
    """AGG29: trips touching the top-``n`` risk hubs (either end): count, share
    of all trips and their breach rate.  The hub list has ``n`` rows."""
    hubs = top_k(nodes_with_risk, n, "structural_risk_score", ["facility"]).select("facility")
    h = F.broadcast(hubs.select(F.col("facility").alias("_h")))
    touched = (shipments.join(h, shipments.source_center == h._h, "left")
                        .withColumnRenamed("_h", "_hs")
                        .join(h, F.col("destination_center") == h._h, "left")
                        .withColumn("_touch", F.col("_hs").isNotNull() | F.col("_h").isNotNull()))
    return touched.agg(
        F.count(F.when(F.col("_touch"), 1)).alias("affected_trips"),
        (F.count(F.when(F.col("_touch"), 1)) / F.count(F.lit(1)) * 100).alias("affected_pct"),
        F.avg(F.when(F.col("_touch"), F.col("is_sla_breach").cast("double")))
         .alias("affected_breach_rate"))
