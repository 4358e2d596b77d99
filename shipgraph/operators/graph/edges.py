"""Edge and vertex tables; sizes, degrees, undirected projection, subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corridor_edges(corridors: DataFrame, weight_col: str = "trip_count",
                   source_col: str = "source_center", dest_col: str = "destination_center",
                   edge_attrs=()) -> DataFrame:
    """GRF1: edge table (src, dst, weight, *attrs).  Attributes missing from the
    input are ignored; (src, dst) must be unique (corridor tables are)."""
    attrs = [a for a in edge_attrs if a in corridors.columns and a != weight_col]
    return corridors.select(F.col(source_col).alias("src"), F.col(dest_col).alias("dst"),
                            F.col(weight_col).cast("double").alias("weight"), *attrs)


def vertices(edges: DataFrame) -> DataFrame:
    """Distinct endpoints of an edge table (column ``facility``)."""
    return (edges.select(F.col("src").alias("facility"))
                 .union(edges.select(F.col("dst").alias("facility"))).distinct())


def graph_sizes(edges: DataFrame, by: list[str]) -> DataFrame:
    """GRF6: node and edge counts per graph variant in one pass each."""
    e = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("n_edges"))
    ends = (edges.select(*by, F.col("src").alias("f"))
                 .union(edges.select(*by, F.col("dst").alias("f"))))
    n = ends.groupBy(*by).agg(F.count_distinct("f").alias("n_nodes"))
    return n.join(e, by)


def degrees(edges: DataFrame) -> DataFrame:
    """GRF7+GRF8: in/out/total degree (a self-loop counts on both sides) and
    weighted in/out degree; one aggregation per side, joined on facility."""
    o = edges.groupBy(F.col("src").alias("facility")).agg(
        F.count(F.lit(1)).alias("out_degree"), F.sum("weight").alias("out_degree_w"))
    i = edges.groupBy(F.col("dst").alias("facility")).agg(
        F.count(F.lit(1)).alias("in_degree"), F.sum("weight").alias("in_degree_w"))
    j = o.join(i, "facility", "full_outer")
    ind = F.coalesce("in_degree", F.lit(0))
    outd = F.coalesce("out_degree", F.lit(0))
    return j.select("facility", ind.alias("in_degree"), outd.alias("out_degree"),
                    (ind + outd).alias("total_degree"),
                    F.coalesce("in_degree_w", F.lit(0.0)).alias("in_degree_w"),
                    F.coalesce("out_degree_w", F.lit(0.0)).alias("out_degree_w"))


def undirected(edges: DataFrame) -> DataFrame:
    """GRF14: undirected projection; both directions of a pair are merged and
    their weights summed (u ≤ v)."""
    u = F.least("src", "dst")
    v = F.greatest("src", "dst")
    return edges.groupBy(u.alias("u"), v.alias("v")).agg(F.sum("weight").alias("weight"))


def induced_subgraph(edges: DataFrame, nodes: DataFrame, node_col: str = "facility") -> DataFrame:
    """JN8: edges whose both endpoints are in ``nodes`` (two semi joins)."""
    n = nodes.select(F.col(node_col).alias("_n")).distinct()
    return (edges.join(n, edges.src == n._n, "left_semi")
                 .join(n, edges.dst == n._n, "left_semi"))


def neighbourhood(edges: DataFrame, hubs: DataFrame, node_col: str = "facility") -> DataFrame:
    """JN9: the hubs plus their predecessors and successors (distinct)."""
    h = hubs.select(F.col(node_col).alias("_h")).distinct()
    succ = edges.join(h, edges.src == h._h, "inner").select(F.col("dst").alias(node_col))
    pred = edges.join(h, edges.dst == h._h, "inner").select(F.col("src").alias(node_col))
    return h.select(F.col("_h").alias(node_col)).union(succ).union(pred).distinct()
