"""Readers for the driver tables and the shipments view built on them.

The reference reads one CSV of shipment segments.  Here the same 24-column
record is derived from the TPC-H-like tables so that the work grows with the
scale factor: one row per lineitem, joined to its order, customer and
supplier.  The formulas are fixed values shared with the DuckDB oracle
(``shipgraph.plans.oracle.SHIPMENTS_SQL``) and listed in FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# fixed values: the reference's columns
RAW_COLUMNS = (
    "data", "trip_creation_time", "route_schedule_uuid", "route_type", "trip_uuid",
    "source_center", "source_name", "destination_center", "destination_name",
    "od_start_time", "od_end_time", "start_scan_to_end_scan", "is_cutoff",
    "cutoff_factor", "cutoff_timestamp", "actual_distance_to_destination",
    "actual_time", "osrm_time", "osrm_distance", "factor", "segment_actual_time",
    "segment_osrm_time", "segment_osrm_distance", "segment_factor",
)


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def shipment_files(sf_dir: str) -> list[str]:
    """The tables that the shipments view reads."""
    return [f"{sf_dir.rstrip('/')}/{t}.parquet"
            for t in ("lineitem", "orders", "customer", "supplier", "nation")]


def facility_id(prefix: str, key: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), width, "0"))


def shipments(spark: SparkSession, sf_dir: str, grain: str = "coarse") -> DataFrame:
    """The shipment-segment table (24 reference columns + ``row_id``).

    ``grain='coarse'``: facilities are nations (sources = supplier nation,
    destinations = customer nation; one id space, self-loops exist).
    ``grain='fine'``: sources are suppliers, destinations nations.

    Join plan: lineitem ⋈ orders on the order key is the big sort-merge join;
    customer and supplier are joined on their keys and left to AQE, which
    broadcasts them only when their runtime size is under the threshold.
    ``nation`` is broadcast: TPC-H fixes it at 25 rows for every scale.
    """
    if grain not in ("coarse", "fine"):
        raise ValueError(f"grain must be 'coarse' or 'fine', got {grain!r}")
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                     "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                     "l_linestatus", "l_shipdate"])
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    sn = F.broadcast(nation.select(F.col("n_nationkey").alias("s_nationkey"),
                                   F.col("n_name").alias("s_nation_name")))
    cn = F.broadcast(nation.select(F.col("n_nationkey").alias("c_nationkey"),
                                   F.col("n_name").alias("c_nation_name")))

    orders = o.join(c, o.o_custkey == c.c_custkey, "inner").join(cn, "c_nationkey", "inner")
    rows = (li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")
              .join(s, li.l_suppkey == s.s_suppkey, "inner")
              .join(sn, "s_nationkey", "inner"))

    actual = F.col("l_extendedprice") / 100
    osrm = F.when(F.col("o_orderkey") % 997 == 0, F.lit(0.0)).otherwise(F.col("l_quantity") * 15)
    ratio = actual / F.nullif(osrm, F.lit(0.0))
    if grain == "coarse":
        src = facility_id("NAT", F.col("s_nationkey"), 3)
    else:
        src = facility_id("SUP", F.col("l_suppkey"), 7)
    start = F.col("o_orderdate") + F.make_dt_interval(
        F.lit(0), (F.col("o_orderkey") % 24).cast("int"), F.lit(0), F.lit(0))
    lineitem_cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                     "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                     "l_linestatus", "l_shipdate"]
    return rows.select(
        F.xxhash64(*[F.col(x) for x in lineitem_cols]).alias("row_id"),
        F.when(F.col("o_orderkey") % 10 < 7, "training").otherwise("test").alias("data"),
        F.col("o_orderdate").alias("trip_creation_time"),
        F.concat(F.lit("RS"), F.col("o_custkey").cast("string")).alias("route_schedule_uuid"),
        F.when(F.col("l_returnflag") == "N", "Carting").otherwise("FTL").alias("route_type"),
        F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("trip_uuid"),
        src.alias("source_center"),
        F.when(F.col("l_suppkey") % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("s_nation_name")).alias("source_name"),
        facility_id("NAT", F.col("c_nationkey"), 3).alias("destination_center"),
        F.when(F.col("o_custkey") % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("c_nation_name")).alias("destination_name"),
        start.alias("od_start_time"),
        F.col("l_shipdate").alias("od_end_time"),
        (actual * (1 + F.col("l_discount"))).alias("start_scan_to_end_scan"),
        (actual > F.col("l_quantity") * 12).alias("is_cutoff"),
        (F.col("l_quantity") * 12).alias("cutoff_factor"),
        F.col("l_shipdate").cast("date").cast("string").alias("cutoff_timestamp"),
        (F.col("l_quantity") * 12 * (1 + F.col("l_tax"))).alias("actual_distance_to_destination"),
        actual.alias("actual_time"),
        osrm.alias("osrm_time"),
        (F.col("l_quantity") * 12).alias("osrm_distance"),
        ratio.alias("factor"),
        (actual * (1 - F.col("l_discount"))).alias("segment_actual_time"),
        osrm.alias("segment_osrm_time"),
        (F.col("l_quantity") * 12).alias("segment_osrm_distance"),
        (ratio - 1).alias("segment_factor"),
    )


def supplier_chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a graph that grows with the data: consecutive suppliers inside an order.

    Returns one row per (src, dst) supplier pair with its ``trip_count``.
    The window is partitioned by order key, so each window partition is one
    order's lines (bounded by the order size, never a hot key).
    """
    from pyspark.sql import Window as W
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     "l_shipdate", "l_extendedprice"])
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey",
                                            "l_shipdate", "l_extendedprice")
    nxt = li.select(facility_id("SUP", F.col("l_suppkey"), 7).alias("src"),
                    facility_id("SUP", F.lead("l_suppkey").over(w), 7).alias("dst"))
    return (nxt.where(F.col("dst").isNotNull())
               .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("trip_count")))


def region_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed facility → community assignment for the coarse view: the
    nation's region (used where a check needs a deterministic partition)."""
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    return n.select(facility_id("NAT", F.col("n_nationkey"), 3).alias("facility"),
                    F.col("n_regionkey").cast("long").alias("community_id"))
