"""Query catalog: one Spark plan and (where SQL can express it) one DuckDB
oracle per key.  Every query reads the driver tables of ``sf_dir``."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import normalise_output
from ..functions.quantile import global_quantiles, group_quantiles
from ..operators import clean as cl
from ..operators import corridor as co
from ..operators.derive import derive_shipments, drop_leaky, impute_names
from ..session import cut_lineage
from ..sources import artefacts as ar
from ..sources.tables import RAW_COLUMNS, shipment_files, shipments
from . import oracle as O

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalise_output(fn(spark, sf_dir))
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- shared inputs

def derived(spark, sf_dir, grain="coarse") -> DataFrame:
    return derive_shipments(shipments(spark, sf_dir, grain))


#: The derived columns that corridor, facility and hub statistics read.
STAT_COLS = ["trip_uuid", "route_type", "source_center", "destination_center", "od_start_time",
             "actual_time", "osrm_time", "actual_distance_to_destination", "delay_ratio",
             "delay_pct", "is_delayed", "is_sla_breach"]


def derived_stats(spark, sf_dir) -> DataFrame:
    """The derived rows' STAT_COLS, written once per content of the input: reports
    that aggregate them several ways join the driver tables once."""
    return ar.table(spark, "derived_stats", shipment_files(sf_dir),
                    lambda: derived(spark, sf_dir).select(*STAT_COLS))


def cleaned(spark, sf_dir, grain="coarse") -> DataFrame:
    return cl.clean_shipments(derived(spark, sf_dir, grain), impute_cutoff=False)


def corridors(spark, sf_dir, grain="coarse", clean=False) -> DataFrame:
    src = cleaned(spark, sf_dir, grain) if clean else derived(spark, sf_dir, grain)
    return co.corridor_stats(src)


def _w(body: str, *ctes) -> str:
    return O.ctes(*ctes) + body


COARSE = O.base_ctes("coarse")
FINE = O.base_ctes("fine")
FINE_CORR = O.base_ctes("fine", corridor=True)
COARSE_CLEAN = O.base_ctes("coarse", clean=True)

# ---------------------------------------------------------------- stage 1

RAW_SQL = ", ".join(RAW_COLUMNS)


@query("shipments_view", _w(f"SELECT {RAW_SQL} FROM ship", *COARSE[:1]))
def q_shipments_view(spark, sf_dir):
    return shipments(spark, sf_dir).select(*RAW_COLUMNS)


DERIVED_COLS = ["trip_uuid", "source_center", "destination_center", "actual_time",
                "osrm_time", "delay_ratio", "delay_pct", "is_delayed", "is_sla_breach",
                "corridor", "hour", "dow", "month", "is_weekend", "is_rush_hour",
                "distance_km"]


@query("derive_shipments", _w(f"SELECT {', '.join(DERIVED_COLS)} FROM der", *COARSE))
def q_derive(spark, sf_dir):
    return derived(spark, sf_dir).select(*DERIVED_COLS)


@query("impute_names", _w(
    "SELECT trip_uuid, source_center, destination_center, "
    "COALESCE(source_name, source_center) AS source_name, "
    "COALESCE(destination_name, destination_center) AS destination_name FROM ship",
    *COARSE[:1]))
def q_impute(spark, sf_dir):
    return impute_names(shipments(spark, sf_dir)).select(
        "trip_uuid", "source_center", "destination_center", "source_name", "destination_name")


@query("corridor_stats", _w("SELECT * FROM corr", *FINE_CORR))
def q_corridor_stats(spark, sf_dir):
    return corridors(spark, sf_dir, "fine")


DELAYED_SQL = """
SELECT *, (median_delay_ratio - 1) * 100 AS delay_pct_over_osrm,
  trip_count * sla_breach_rate AS revenue_risk_proxy,
  right(source_center, 8) || ' → ' || right(destination_center, 8) AS corridor_label,
  CASE WHEN ftl_share > 0.5 THEN 'FTL' ELSE 'Carting' END AS dominant_route_type
FROM corr WHERE median_delay_ratio > 1.2 AND trip_count >= 5
"""


@query("delayed_corridors", _w(DELAYED_SQL, *FINE_CORR))
def q_delayed(spark, sf_dir):
    return co.delayed_corridors(corridors(spark, sf_dir, "fine"))


@query("top_delayed_corridors", _w(
    "SELECT * FROM dl ORDER BY delay_pct_over_osrm DESC, source_center, destination_center "
    "LIMIT 50", *FINE_CORR, ("dl", DELAYED_SQL)))
def q_top_delayed(spark, sf_dir):
    return co.top_k(co.delayed_corridors(corridors(spark, sf_dir, "fine")), 50,
                    "delay_pct_over_osrm")


def flagship(spark, sf_dir) -> DataFrame:
    """shipments → derive → corridor stats → delayed → top-50 audit."""
    return q_top_delayed(spark, sf_dir)


# ---------------------------------------------------------------- stage 2: profiling
from ..operators import profile as pf  # noqa: E402
from ..operators import facility as fa  # noqa: E402
from ..operators.graph import edges as ge  # noqa: E402

DER_COLUMNS = list(RAW_COLUMNS) + ["delay_ratio", "delay_pct", "is_delayed", "is_sla_breach",
                                   "corridor", "hour", "dow", "month", "is_weekend",
                                   "is_rush_hour", "distance_km"]


@query("dataset_summary", _w("""
SELECT count(*) AS total_rows,
  count(CASE WHEN data = 'training' THEN 1 END) AS train_rows,
  count(CASE WHEN data = 'test' THEN 1 END) AS test_rows,
  count(DISTINCT source_center) AS unique_sources,
  count(DISTINCT destination_center) AS unique_destinations,
  count(DISTINCT trip_uuid) AS unique_trips,
  count(DISTINCT route_schedule_uuid) AS unique_schedules,
  count(DISTINCT corridor) AS unique_corridors,
  avg(CAST(is_sla_breach AS DOUBLE)) AS sla_breach_rate,
  avg(CAST(is_delayed AS DOUBLE)) AS chronic_delay_rate,
  median(delay_ratio) AS median_delay_ratio,
  avg(delay_ratio) AS mean_delay_ratio
FROM der""", *FINE))
def q_dataset_summary(spark, sf_dir):
    return pf.dataset_summary(derived(spark, sf_dir, "fine"))


@query("route_type_dist", _w(
    "SELECT route_type, count(*) AS n_rows, count(*) / sum(count(*)) OVER () AS share "
    "FROM der GROUP BY route_type", *COARSE))
def q_route_type_dist(spark, sf_dir):
    return pf.value_share(derived(spark, sf_dir), "route_type")


_MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
    f"round((count(*) - count({c})) / count(*) * 100, 3) AS missing_pct FROM der"
    for c in DER_COLUMNS)


@query("missing_report", _w(f"SELECT * FROM ({_MISSING_SQL}) WHERE missing_count > 0", *COARSE))
def q_missing_report(spark, sf_dir):
    return pf.missing_report(derived(spark, sf_dir).select(*DER_COLUMNS))


@query("data_quality", _w("""
SELECT 'non_positive_actual_time' AS issue, count(CASE WHEN actual_time <= 0 THEN 1 END) AS n_rows,
       (1 - count(CASE WHEN actual_time <= 0 THEN 1 END) / count(*)) * 100 AS valid_pct FROM der
UNION ALL SELECT 'non_positive_osrm_time', count(CASE WHEN osrm_time <= 0 THEN 1 END), NULL FROM der
UNION ALL SELECT 'delay_ratio_over_10', count(CASE WHEN delay_ratio > 10 THEN 1 END), NULL FROM der
UNION ALL SELECT 'negative_segment_factor', count(CASE WHEN segment_factor < 0 THEN 1 END), NULL FROM der
UNION ALL SELECT 'same_source_destination', count(CASE WHEN source_center = destination_center THEN 1 END), NULL FROM der
""", *COARSE))
def q_data_quality(spark, sf_dir):
    return pf.data_quality(derived(spark, sf_dir))


_IQR_SQL = " UNION ALL ".join(f"""
SELECT '{c}' AS "column", q1, q3, q3 - q1 AS iqr,
  (SELECT count(*) FROM der WHERE {c} < q1 - 3 * (q3 - q1)) AS low_outliers,
  (SELECT count(*) FROM der WHERE {c} > q3 + 3 * (q3 - q1)) AS high_outliers
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM der)"""
                              for c in pf.OUTLIER_COLUMNS)


@query("iqr_outliers", _w(_IQR_SQL, *COARSE))
def q_iqr(spark, sf_dir):
    return pf.iqr_outliers(derived(spark, sf_dir))


_DESC_SQL = " UNION ALL ".join(f"""
SELECT '{c}' AS "column", round(CAST(count({c}) AS DOUBLE), 2) AS count,
  round(CAST(sum(CAST({c} AS DECIMAL(38,10))) AS DOUBLE) / count({c}), 2) AS mean,
  round(stddev_samp({c}), 2) AS std, round(min({c}), 2) AS min,
  round(quantile_cont({c}, 0.25), 2) AS p25, round(quantile_cont({c}, 0.5), 2) AS p50,
  round(quantile_cont({c}, 0.75), 2) AS p75, round(max({c}), 2) AS max FROM der"""
                               for c in pf.DESCRIBE_COLUMNS)


@query("describe_numeric", _w(_DESC_SQL, *COARSE))
def q_describe(spark, sf_dir):
    return pf.describe_numeric(derived(spark, sf_dir))


@query("sla_by_route", _w("SELECT route_type, avg(CAST(is_sla_breach AS DOUBLE)) AS "
                          "sla_breach_rate FROM der GROUP BY route_type", *COARSE))
def q_sla_by_route(spark, sf_dir):
    return pf.rate_by(derived(spark, sf_dir), "route_type")


@query("hourly_delay", _w("SELECT hour, avg(delay_ratio) AS mean_delay_ratio FROM der "
                          "WHERE hour IS NOT NULL GROUP BY hour", *COARSE))
def q_hourly(spark, sf_dir):
    return pf.mean_by(derived(spark, sf_dir), "hour")


@query("monthly_delay", _w(
    "SELECT month, mean_delay_ratio, avg(mean_delay_ratio) OVER () AS mean_of_monthly_means "
    "FROM (SELECT month, avg(delay_ratio) AS mean_delay_ratio FROM der "
    "WHERE month IS NOT NULL GROUP BY month)", *COARSE))
def q_monthly(spark, sf_dir):
    return pf.monthly_delay(derived(spark, sf_dir))


def _hist_sql(src, column, lo, hi, bins, by=None, density=False):
    w = (hi - lo) / bins
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    dens = (f", n_rows / (sum(n_rows) OVER ({part}) * {w!r}) AS density" if density else "")
    return f"""
SELECT {keys}bin, n_rows, CAST({lo!r} AS DOUBLE) + bin * CAST({w!r} AS DOUBLE) AS bin_lo,
  CAST({lo!r} AS DOUBLE) + (bin + 1) * CAST({w!r} AS DOUBLE) AS bin_hi{dens}
FROM (SELECT {keys}CAST(least(floor((least(greatest({column}, {lo!r}), {hi!r}) - {lo!r}) / {w!r}), {bins - 1}) AS BIGINT) AS bin,
             count(*) AS n_rows
      FROM {src} WHERE {column} IS NOT NULL GROUP BY ALL)"""


@query("delay_histogram", _w(_hist_sql("der", "delay_ratio", 0.0, 8.0, 80), *COARSE))
def q_delay_hist(spark, sf_dir):
    return pf.histogram(derived(spark, sf_dir), "delay_ratio", 0.0, 8.0, 80)


@query("network_kpis", _w("""
SELECT count(*) AS shipments, count(DISTINCT source_center) AS source_facilities,
  median(delay_ratio) AS median_delay_ratio,
  avg(CAST(is_sla_breach AS DOUBLE)) * 100 AS sla_breach_pct,
  avg(CAST(COALESCE(actual_time > cutoff_factor * 1.5, false) AS DOUBLE)) * 100 AS realistic_breach_pct,
  (SELECT count(*) FROM (SELECT source_center FROM der UNION SELECT destination_center FROM der)) AS all_facilities,
  (SELECT count(*) FROM corr) AS corridors
FROM der""", *FINE_CORR))
def q_network_kpis(spark, sf_dir):
    d = derived(spark, sf_dir, "fine")
    return pf.network_kpis(d, co.corridor_stats(d))


# ---------------------------------------------------------------- stage 3: cleaning
LEAKY_SQL = "factor, segment_factor, od_end_time, cutoff_timestamp, start_scan_to_end_scan"


@query("clean_shipments", _w(f"SELECT * EXCLUDE ({LEAKY_SQL}) FROM cln", *COARSE_CLEAN))
def q_clean(spark, sf_dir):
    return cl.clean_shipments(derived(spark, sf_dir)).drop("row_id")


@query("split_counts", _w("SELECT data, count(*) AS n_rows FROM cln GROUP BY data",
                          *COARSE_CLEAN))
def q_split_counts(spark, sf_dir):
    return cleaned(spark, sf_dir).groupBy("data").agg(F.count(F.lit(1)).alias("n_rows"))


@query("winsorize_by_group", _w("""
SELECT d.trip_uuid, d.route_type, d.source_center, d.destination_center,
  CASE WHEN d.actual_time IS NULL THEN NULL
       ELSE least(greatest(d.actual_time, q.lo), q.hi) END AS actual_time
FROM der d JOIN (SELECT route_type, quantile_cont(actual_time, 0.01) AS lo,
                        quantile_cont(actual_time, 0.99) AS hi FROM der GROUP BY route_type) q
  ON d.route_type = q.route_type""", *COARSE))
def q_winsor(spark, sf_dir):
    w = cl.winsorize_by_group(derived(spark, sf_dir), "actual_time", "route_type", 0.01, 0.99)
    return w.select("trip_uuid", "route_type", "source_center", "destination_center",
                    "actual_time")


WINSOR_UPPER_SQL = """
SELECT d.trip_uuid, d.route_type, d.source_center, d.destination_center, d.osrm_time,
  least(d.actual_time, q.hi) AS actual_time,
  least(d.actual_time, q.hi) / NULLIF(d.osrm_time, 0.0) AS delay_ratio
FROM der d JOIN (SELECT route_type, quantile_cont(actual_time, 0.99) AS hi
                 FROM der GROUP BY route_type) q ON d.route_type = q.route_type
WHERE d.osrm_time > 0"""


@query("winsorize_upper", _w(WINSOR_UPPER_SQL, *COARSE))
def q_winsor_upper(spark, sf_dir):
    return cl.winsorize_upper(derived(spark, sf_dir)).select(
        "trip_uuid", "route_type", "source_center", "destination_center", "osrm_time",
        "actual_time", "delay_ratio")


@query("route_quantiles", _w("""
SELECT q.route_type, q.q01_actual, q.q99_actual, q.q99_delay_ratio,
  count(CASE WHEN d.actual_time > q.q99_actual THEN 1 END) AS n_above_q99,
  round(avg(CAST(COALESCE(d.actual_time > q.q99_actual, false) AS DOUBLE)) * 100, 2) AS pct_above_q99
FROM der d JOIN (SELECT route_type, quantile_cont(actual_time, 0.01) AS q01_actual,
                        quantile_cont(actual_time, 0.99) AS q99_actual,
                        quantile_cont(delay_ratio, 0.99) AS q99_delay_ratio
                 FROM der GROUP BY route_type) q ON d.route_type = q.route_type
GROUP BY ALL""", *COARSE))
def q_route_quantiles(spark, sf_dir):
    return cl.route_quantiles(derived(spark, sf_dir))


@query("cleaning_impact", _w("""
SELECT b.*, a.*, (1 - a.std_after / b.std_before) * 100 AS std_reduction_pct
FROM (SELECT CAST(sum(CAST(actual_time AS DECIMAL(38,10))) AS DOUBLE) / count(actual_time) AS mean_before, stddev_samp(actual_time) AS std_before,
             max(actual_time) AS max_before, max(delay_ratio) AS max_ratio_before FROM der) b,
     (SELECT CAST(sum(CAST(actual_time AS DECIMAL(38,10))) AS DOUBLE) / count(actual_time) AS mean_after, stddev_samp(actual_time) AS std_after,
             max(actual_time) AS max_after, max(delay_ratio) AS max_ratio_after FROM wu) a""",
    *COARSE, ("wu", WINSOR_UPPER_SQL)))
def q_cleaning_impact(spark, sf_dir):
    d = derived(spark, sf_dir)
    return cl.cleaning_impact(d, cl.winsorize_upper(d))


@query("route_ratio_profile", _w("""
SELECT route_type,
  quantile_cont(least(greatest(delay_ratio, 0.0), 8.0), 0.5) AS median_ratio,
  quantile_cont(least(greatest(delay_ratio, 0.0), 8.0), 0.95) AS p95_ratio
FROM wu GROUP BY route_type""", *COARSE, ("wu", WINSOR_UPPER_SQL)))
def q_route_ratio_profile(spark, sf_dir):
    d = derived(spark, sf_dir)
    return cl.route_ratio_profile(cl.winsorize_upper(d))


@query("sla_clarification", _w("""
SELECT b.original_breach_rate_pct, b.rows_before, a.realistic_breach_rate_pct,
  a.severe_delay_pct, a.rows_after, round((1 - a.sa / b.sb) * 100, 1) AS std_reduction_pct
FROM (SELECT round(avg(CAST(is_sla_breach AS DOUBLE)) * 100, 1) AS original_breach_rate_pct,
             count(*) AS rows_before, stddev_samp(actual_time) AS sb FROM der) b,
     (SELECT round(avg(CAST(COALESCE(w_actual > cutoff_factor * 1.5, false) AS DOUBLE)) * 100, 1)
               AS realistic_breach_rate_pct,
             round(avg(CAST(COALESCE(w_ratio > 2.0, false) AS DOUBLE)) * 100, 1) AS severe_delay_pct,
             count(*) AS rows_after, stddev_samp(w_actual) AS sa
      FROM (SELECT d.*, least(d.actual_time, q.hi) AS w_actual,
                   least(d.actual_time, q.hi) / NULLIF(d.osrm_time, 0.0) AS w_ratio
            FROM der d JOIN (SELECT route_type, quantile_cont(actual_time, 0.99) AS hi
                             FROM der GROUP BY route_type) q ON d.route_type = q.route_type
            WHERE d.osrm_time > 0)) a""",
    *COARSE))
def q_sla_clarification(spark, sf_dir):
    d = derived(spark, sf_dir)
    c = cl.winsorize_upper(d)
    return cl.sla_clarification(d, c)


@query("sla_recalibration", _w("""
SELECT * FROM (VALUES (1.0::DOUBLE), (1.5::DOUBLE), (1.86::DOUBLE)) s(cutoff_multiplier),
LATERAL (SELECT avg(CAST(COALESCE(actual_time > cutoff_factor * s.cutoff_multiplier, false)
                    AS DOUBLE)) AS breach_rate FROM der)""", *COARSE))
def q_sla_recalibration(spark, sf_dir):
    return cl.sla_recalibration(derived(spark, sf_dir))


# ---------------------------------------------------------------- stage 4: facility & graphs
FAC_SQL = O.FACILITY.format(src="der")


@query("facility_stats", _w("SELECT * FROM fac", *COARSE, ("fac", FAC_SQL)))
def q_facility_stats(spark, sf_dir):
    return fa.facility_stats(derived(spark, sf_dir))


ROUTE_TYPE_CORR_SQL = """
SELECT route_type, source_center, destination_center, median(delay_ratio) AS median_delay,
  count(trip_uuid) AS trip_count, avg(CAST(is_sla_breach AS DOUBLE)) AS sla_rate
FROM der GROUP BY ALL"""


@query("route_type_corridors", _w(ROUTE_TYPE_CORR_SQL, *COARSE))
def q_route_type_corridors(spark, sf_dir):
    return co.route_type_corridors(derived(spark, sf_dir))


SLOT_SQL = """CASE WHEN hour >= 0 AND hour < 6 THEN 'night_00_06'
  WHEN hour >= 6 AND hour < 12 THEN 'morning_06_12'
  WHEN hour >= 12 AND hour < 18 THEN 'afternoon_12_18'
  WHEN hour >= 18 AND hour < 24 THEN 'evening_18_24' END"""
TEMPORAL_SQL = f"""
SELECT slot, source_center, destination_center, median(delay_ratio) AS median_delay,
  count(trip_uuid) AS trip_count
FROM (SELECT *, {SLOT_SQL} AS slot FROM der) WHERE slot IS NOT NULL GROUP BY ALL"""


@query("temporal_corridors", _w(TEMPORAL_SQL, *COARSE))
def q_temporal(spark, sf_dir):
    return co.temporal_corridors(derived(spark, sf_dir))


COARSE_CORR = O.base_ctes("coarse", corridor=True)
BASE_EDGES = ("e", O.EDGES.format(corr="corr"))
BASE_NODES = ("nodes", O.NODES.format(e="e"))


def base_edges(spark, sf_dir) -> DataFrame:
    return ge.corridor_edges(corridors(spark, sf_dir))


@query("corridor_graph", _w("""
SELECT 'base' AS graph, source_center AS src, destination_center AS dst,
  CAST(trip_count AS DOUBLE) AS weight, trip_count, median_delay_ratio AS delay_ratio,
  sla_breach_rate FROM corr
UNION ALL
SELECT 'delay', source_center, destination_center, median_delay_ratio, trip_count,
  median_delay_ratio, sla_breach_rate FROM corr""", *COARSE_CORR))
def q_corridor_graph(spark, sf_dir):
    c = corridors(spark, sf_dir).withColumn("delay_ratio", F.col("median_delay_ratio"))
    attrs = ["trip_count", "delay_ratio", "sla_breach_rate"]
    base = ge.corridor_edges(c, "trip_count", edge_attrs=attrs).withColumn(
        "trip_count", F.col("weight").cast("long"))
    delay = ge.corridor_edges(c, "median_delay_ratio", edge_attrs=attrs)
    cols = ["graph", "src", "dst", "weight", "trip_count", "delay_ratio", "sla_breach_rate"]
    return (base.withColumn("graph", F.lit("base")).select(*cols)
                .unionByName(delay.withColumn("graph", F.lit("delay")).select(*cols)))


@query("graph_sizes", _w(f"""
SELECT graph, count(DISTINCT f) AS n_nodes, count(*) // 2 AS n_edges FROM (
  SELECT graph, src AS f FROM ge UNION ALL SELECT graph, dst FROM ge) GROUP BY graph""",
    *COARSE_CORR,
    ("ge", f"""SELECT 'base' AS graph, source_center AS src, destination_center AS dst FROM corr
              UNION ALL SELECT 'delay', source_center, destination_center FROM corr
              UNION ALL SELECT route_type, source_center, destination_center
                        FROM ({ROUTE_TYPE_CORR_SQL})
              UNION ALL SELECT slot, source_center, destination_center FROM ({TEMPORAL_SQL})""")))
def q_graph_sizes(spark, sf_dir):
    d = derived(spark, sf_dir)
    c = co.corridor_stats(d)
    base = ge.corridor_edges(c).select(F.lit("base").alias("graph"), "src", "dst")
    delay = base.withColumn("graph", F.lit("delay"))
    rt = co.route_type_corridors(d).select(F.col("route_type").alias("graph"),
                                           F.col("source_center").alias("src"),
                                           F.col("destination_center").alias("dst"))
    tm = co.temporal_corridors(d).select(F.col("slot").alias("graph"),
                                         F.col("source_center").alias("src"),
                                         F.col("destination_center").alias("dst"))
    return ge.graph_sizes(base.union(delay).union(rt).union(tm), ["graph"])


@query("degrees", _w(O.DEGREES.format(nodes="nodes", e="e"), *COARSE_CORR, BASE_EDGES,
                     BASE_NODES))
def q_degrees(spark, sf_dir):
    return ge.degrees(base_edges(spark, sf_dir))


@query("top_degree", _w(O.DEGREES.format(nodes="nodes", e="e")
                        + " ORDER BY total_degree DESC, facility LIMIT 15",
                        *COARSE_CORR, BASE_EDGES, BASE_NODES))
def q_top_degree(spark, sf_dir):
    return co.top_k(ge.degrees(base_edges(spark, sf_dir)), 15, "total_degree", ["facility"])


@query("undirected_edges", _w(
    "SELECT least(src, dst) AS u, greatest(src, dst) AS v, sum(weight) AS weight "
    "FROM e GROUP BY ALL", *COARSE_CORR, BASE_EDGES))
def q_undirected(spark, sf_dir):
    return ge.undirected(base_edges(spark, sf_dir))


@query("top_volume_corridors", _w(
    "SELECT * FROM corr ORDER BY trip_count DESC, source_center, destination_center LIMIT 300",
    *FINE_CORR))
def q_top_volume(spark, sf_dir):
    return co.top_k(corridors(spark, sf_dir, "fine"), 300, "trip_count")


@query("corridor_explorer", _w("""
SELECT source_center, destination_center, trip_count, median_delay_ratio,
  (median_delay_ratio - 1) * 100 AS delay_pct, sla_breach_rate, median_distance
FROM corr WHERE trip_count >= 10 AND (median_delay_ratio - 1) * 100 >= 20 AND ftl_share > 0.5
ORDER BY delay_pct DESC, source_center, destination_center LIMIT 50""", *FINE_CORR))
def q_explorer(spark, sf_dir):
    return co.corridor_explorer(corridors(spark, sf_dir, "fine"), 10, 20, "FTL", 50)


@query("corridor_kpis", _w("""
SELECT count(*) AS total_corridors,
  count(CASE WHEN median_delay_ratio > 1.2 THEN 1 END) AS chronic_corridors,
  count(CASE WHEN median_delay_ratio > 1.2 THEN 1 END) / count(*) * 100 AS chronic_pct,
  (max(median_delay_ratio) - 1) * 100 AS worst_delay_pct,
  avg(sla_breach_rate) * 100 AS avg_sla_breach_pct FROM corr""", *FINE_CORR))
def q_corridor_kpis(spark, sf_dir):
    return co.corridor_kpis(corridors(spark, sf_dir, "fine"))


@query("route_entropy", _w("""
SELECT source_center, destination_center,
  -sum((n / t) * log2(n / t + 1e-10)) AS entropy
FROM (SELECT *, sum(n) OVER (PARTITION BY source_center, destination_center) AS t
      FROM (SELECT source_center, destination_center, route_type, count(*) AS n
            FROM der WHERE route_type IS NOT NULL GROUP BY ALL))
GROUP BY source_center, destination_center""", *FINE))
def q_route_entropy(spark, sf_dir):
    return co.categorical_entropy(derived(spark, sf_dir, "fine"),
                                  ["source_center", "destination_center"], "route_type")


# ---------------------------------------------------------------- stage 5-7: graph algorithms
from ..operators import risk as rk  # noqa: E402
from ..operators.graph import community as cm  # noqa: E402
from ..operators.graph import pagerank as gp  # noqa: E402
from ..operators.graph import paths as gpaths  # noqa: E402
from ..operators.derive import AUDITED, leakage_audit  # noqa: E402
from ..sources.tables import region_communities, supplier_chain_edges  # noqa: E402

# PageRank and HITS run to a tolerance far below the compared digits; the oracle
# unrolls more steps than that takes on its small dense graph
TIGHT, UNROLLED = 1e-13, 40


def _wr(body: str, *ctes) -> str:
    return O.ctes_rec(*ctes) + body


GRAPH = [*COARSE_CORR, BASE_EDGES, BASE_NODES]
CENT = GRAPH + O.centrality_ctes("e", "nodes", UNROLLED)
NODEF = CENT + [("fac", FAC_SQL), ("comm", O.REGION_COMMUNITY), ("nf", O.NODE_FEATURES),
                ("risk", O.RISK)]


@query("pagerank", _wr("SELECT * FROM pr", *GRAPH, *O.pagerank_ctes("e", "nodes", UNROLLED)))
def q_pagerank(spark, sf_dir):
    return gp.pagerank(base_edges(spark, sf_dir), tol=TIGHT)


@query("hits", _wr("SELECT * FROM hits", *GRAPH, *O.hits_ctes("e", "nodes", UNROLLED)))
def q_hits(spark, sf_dir):
    return gp.hits(base_edges(spark, sf_dir), tol=TIGHT)


@query("closeness", _wr(O.closeness_sql("dist", "nodes"), *GRAPH, *O.apsp_ctes("e", "nodes")))
def q_closeness(spark, sf_dir):
    return gpaths.closeness(base_edges(spark, sf_dir))


@query("betweenness", _wr("SELECT * FROM btw", *GRAPH, *O.apsp_ctes("e", "nodes"),
                          *O.betweenness_ctes("e", "nodes")))
def q_betweenness(spark, sf_dir):
    return gpaths.betweenness(base_edges(spark, sf_dir))


@query("node_centrality", _wr("SELECT * FROM cent", *CENT))
def q_node_centrality(spark, sf_dir):
    return rk.node_centrality(base_edges(spark, sf_dir), pagerank_tol=TIGHT, hits_tol=TIGHT)


def risk_nodes(spark, sf_dir, community=None):
    """Centralities ⋈ facility stats ⋈ communities → risk score (coarse view);
    with the fixed communities the table is built once per content of its input."""
    def build(comm):
        d = derived_stats(spark, sf_dir)
        cent = rk.node_centrality(ge.corridor_edges(co.corridor_stats(d)), pagerank_tol=TIGHT,
                                  hits_tol=TIGHT)
        # one row per facility, read by the score and by its minima and maxima
        return rk.structural_risk(cut_lineage(
            rk.node_features(cent, fa.facility_stats(d, "distributed"), comm)))

    if community is not None:
        return cut_lineage(build(community))
    return ar.table(spark, "risk_nodes", shipment_files(sf_dir),
                    lambda: build(region_communities(spark, sf_dir)))


@query("node_features", _wr("SELECT * FROM nf", *NODEF[:-1]))
def q_node_features(spark, sf_dir):
    d = derived_stats(spark, sf_dir)
    e = ge.corridor_edges(co.corridor_stats(d))
    return rk.node_features(rk.node_centrality(e, pagerank_tol=TIGHT, hits_tol=TIGHT),
                            fa.facility_stats(d, "distributed"), region_communities(spark, sf_dir))


@query("structural_risk", _wr("SELECT * FROM risk ORDER BY structural_risk_score DESC, facility",
                              *NODEF))
def q_structural_risk(spark, sf_dir):
    return risk_nodes(spark, sf_dir).orderBy(F.desc("structural_risk_score"), "facility")


# a second graph, whose nodes (suppliers) and edges grow with the data
CHAIN = [("e", """
SELECT 'SUP' || lpad(CAST(s AS VARCHAR), 7, '0') AS src, 'SUP' || lpad(CAST(d AS VARCHAR), 7, '0') AS dst,
       CAST(count(*) AS DOUBLE) AS weight
FROM (SELECT l_suppkey AS s, lead(l_suppkey) OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS d FROM lineitem)
WHERE d IS NOT NULL GROUP BY s, d"""), BASE_NODES]


def chain_edges(spark, sf_dir) -> DataFrame:
    return supplier_chain_edges(spark, sf_dir).select(
        "src", "dst", F.col("trip_count").cast("double").alias("weight"))


@query("supplier_degrees", _w(O.DEGREES.format(nodes="nodes", e="e"), *CHAIN))
def q_supplier_degrees(spark, sf_dir):
    return ge.degrees(chain_edges(spark, sf_dir))


@query("supplier_pagerank", _wr("SELECT * FROM pr", *CHAIN,
                                *O.pagerank_ctes("e", "nodes", UNROLLED)))
def q_supplier_pagerank(spark, sf_dir):
    return gp.pagerank(chain_edges(spark, sf_dir), tol=TIGHT)


@query("supplier_hits", _wr("SELECT * FROM hits", *CHAIN, *O.hits_ctes("e", "nodes", UNROLLED)))
def q_supplier_hits(spark, sf_dir):
    return gp.hits(chain_edges(spark, sf_dir), tol=TIGHT)


@query("supplier_closeness", _wr(O.closeness_sql("dist", "nodes"), *CHAIN,
                                 *O.apsp_ctes("e", "nodes")))
def q_supplier_closeness(spark, sf_dir):
    return gpaths.closeness(chain_edges(spark, sf_dir))


@query("supplier_betweenness", _wr("SELECT * FROM btw", *CHAIN, *O.apsp_ctes("e", "nodes"),
                                   *O.betweenness_ctes("e", "nodes")))
def q_supplier_betweenness(spark, sf_dir):
    return gpaths.betweenness(chain_edges(spark, sf_dir))


@query("leakage_audit", _w(" UNION ALL ".join(f"""
SELECT '{c}' AS "column", round(corr({c}, actual_time), 6) AS correlation,
  CASE WHEN abs(round(corr({c}, actual_time), 6)) >= 0.95 THEN 'HIGH'
       WHEN abs(round(corr({c}, actual_time), 6)) >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS risk
FROM ship""" for c in AUDITED), *COARSE[:1]))
def q_leakage_audit(spark, sf_dir):
    return leakage_audit(shipments(spark, sf_dir))


@query("risk_rank", _wr("""
SELECT facility, structural_risk_score,
  CAST(floor(rank() OVER (ORDER BY structural_risk_score DESC)
             + (count(*) OVER (PARTITION BY structural_risk_score) - 1) / 2.0) AS BIGINT) AS risk_rank
FROM risk""", *NODEF))
def q_risk_rank(spark, sf_dir):
    return rk.risk_rank(risk_nodes(spark, sf_dir)).select(
        "facility", "structural_risk_score", "risk_rank")


@query("top_hubs", _wr("""
SELECT row_number() OVER (ORDER BY structural_risk_score DESC, facility) AS rank, facility,
  structural_risk_score, betweenness, pagerank, total_trips, avg_sla_breach, avg_delay_ratio,
  community_id, in_degree, out_degree, round(betweenness * 100, 3) AS betweenness_pct,
  round(avg_sla_breach * 100, 1) AS sla_breach_pct, round(avg_delay_ratio, 2) AS delay_ratio,
  round(structural_risk_score, 4) AS risk_score
FROM risk ORDER BY structural_risk_score DESC, facility LIMIT 20""", *NODEF))
def q_top_hubs(spark, sf_dir):
    return rk.top_hubs(risk_nodes(spark, sf_dir), 20)


@query("risk_components", _wr("""
SELECT facility, norm_betweenness, norm_sla_breach, norm_delay, norm_throughput, norm_pagerank,
  structural_risk_score FROM risk ORDER BY structural_risk_score DESC, facility LIMIT 25""",
    *NODEF))
def q_risk_components(spark, sf_dir):
    return rk.risk_components(risk_nodes(spark, sf_dir))


ENRICHED_SQL = """
SELECT c.*, COALESCE(s.betweenness, 0.0) AS src_betweenness,
  COALESCE(d.betweenness, 0.0) AS dst_betweenness, COALESCE(s.pagerank, 0.0) AS src_pagerank,
  COALESCE(d.pagerank, 0.0) AS dst_pagerank, COALESCE(s.structural_risk_score, 0.0) AS src_risk,
  COALESCE(d.structural_risk_score, 0.0) AS dst_risk,
  COALESCE(s.community_id, -1) AS src_community, COALESCE(d.community_id, -1) AS dst_community,
  CAST(COALESCE(s.community_id, -1) <> COALESCE(d.community_id, -1) AS BIGINT) AS cross_community,
  (COALESCE(s.structural_risk_score, 0.0) + COALESCE(d.structural_risk_score, 0.0)) / 2
    AS corridor_risk
FROM corr c LEFT JOIN risk s ON c.source_center = s.facility
LEFT JOIN risk d ON c.destination_center = d.facility"""


@query("corridor_enriched", _wr(ENRICHED_SQL, *NODEF))
def q_corridor_enriched(spark, sf_dir):
    return rk.corridor_enriched(corridors(spark, sf_dir), risk_nodes(spark, sf_dir))


@query("ego_subgraph", _wr("""
SELECT * FROM e WHERE src IN (SELECT facility FROM ego) AND dst IN (SELECT facility FROM ego)""",
    *NODEF, ("ego", """
SELECT facility FROM (SELECT facility FROM risk ORDER BY structural_risk_score DESC, facility LIMIT 30)
UNION SELECT dst FROM e WHERE src IN (SELECT facility FROM (SELECT facility FROM risk
       ORDER BY structural_risk_score DESC, facility LIMIT 5))
UNION SELECT src FROM e WHERE dst IN (SELECT facility FROM (SELECT facility FROM risk
       ORDER BY structural_risk_score DESC, facility LIMIT 5))""")))
def q_ego(spark, sf_dir):
    return rk.ego_subgraph(base_edges(spark, sf_dir), risk_nodes(spark, sf_dir))


@query("community_subgraph", _wr("""
SELECT * FROM e WHERE src IN (SELECT facility FROM fac WHERE total_trips > 5)
                  AND dst IN (SELECT facility FROM fac WHERE total_trips > 5)""",
    *GRAPH, ("fac", FAC_SQL)))
def q_community_subgraph(spark, sf_dir):
    d = derived(spark, sf_dir)
    e = ge.corridor_edges(co.corridor_stats(d))
    return rk.community_subgraph(e, fa.facility_stats(d))


@query("hub_exposure", _wr("""
SELECT count(CASE WHEN t THEN 1 END) AS affected_trips,
  count(CASE WHEN t THEN 1 END) / count(*) * 100 AS affected_pct,
  avg(CASE WHEN t THEN CAST(is_sla_breach AS DOUBLE) END) AS affected_breach_rate
FROM (SELECT *, (source_center IN (SELECT facility FROM h3) OR destination_center IN
                 (SELECT facility FROM h3)) AS t FROM der)""",
    *NODEF, ("h3", "SELECT facility FROM risk ORDER BY structural_risk_score DESC, facility LIMIT 3")))
def q_hub_exposure(spark, sf_dir):
    return rk.hub_exposure(derived_stats(spark, sf_dir), risk_nodes(spark, sf_dir))


@query("modularity", _wr("""
SELECT sum(COALESCE(l.L, 0.0) / (SELECT sum(weight) FROM und)
           - power(k.D / (2 * (SELECT sum(weight) FROM und)), 2)) AS modularity
FROM (SELECT c.community_id AS c, sum(s.k) AS D
      FROM (SELECT i, sum(weight) AS k FROM (SELECT u AS i, weight FROM und
                                             UNION ALL SELECT v, weight FROM und) GROUP BY i) s
      JOIN comm c ON s.i = c.facility GROUP BY c.community_id) k
LEFT JOIN (SELECT a.community_id AS c, sum(u.weight) AS L FROM und u
           JOIN comm a ON u.u = a.facility JOIN comm b ON u.v = b.facility
           WHERE a.community_id = b.community_id GROUP BY a.community_id) l ON k.c = l.c""",
    *GRAPH, ("comm", O.REGION_COMMUNITY),
    ("und", "SELECT least(src, dst) AS u, greatest(src, dst) AS v, sum(weight) AS weight "
            "FROM e GROUP BY ALL")))
def q_modularity(spark, sf_dir):
    return cm.modularity(base_edges(spark, sf_dir), region_communities(spark, sf_dir))


@query("communities")
def q_communities(spark, sf_dir):
    return cm.communities(base_edges(spark, sf_dir))


# what holds for any settled communities, whichever they are
CERTIFICATE_SQL = """
SELECT n AS n_nodes, n AS n_assigned, yes AS dense_ids, yes AS sizes_fall, yes AS settled,
  yes AS no_worse_than_alone FROM (SELECT count(*) AS n, CAST(1 AS BIGINT) AS yes FROM nodes)"""


def _certified(edges: DataFrame) -> DataFrame:
    e = cut_lineage(edges)
    return cm.certificate(e, cm.communities(e)).select(
        "n_nodes", "n_assigned", "dense_ids", "sizes_fall",
        (F.col("largest_gain") <= 1e-11).alias("settled"),
        (F.col("quality") >= F.col("quality_alone") - 1e-12).alias("no_worse_than_alone"))


@query("community_certificate", _w(CERTIFICATE_SQL, *GRAPH))
def q_community_certificate(spark, sf_dir):
    return _certified(base_edges(spark, sf_dir))


@query("supplier_communities")
def q_supplier_communities(spark, sf_dir):
    return cm.communities(chain_edges(spark, sf_dir))


@query("supplier_community_certificate", _w(CERTIFICATE_SQL, *CHAIN))
def q_supplier_community_certificate(spark, sf_dir):
    return _certified(chain_edges(spark, sf_dir))


@query("community_summary")
def q_community_summary(spark, sf_dir):
    e = base_edges(spark, sf_dir)
    return cm.community_summary(cm.communities(e), e)


# ---------------------------------------------------------------- stage 8: features
from ..operators import features as fe  # noqa: E402


TRAINING = "data = 'training'"


def feature_inputs(spark, sf_dir, community=None, stats_from="all"):
    """Canonical order: clean → corridors → graph + centralities → node risk →
    corridor enrichment.  The cleaned rows, the node table and the corridor
    table are each written once per content of the input (with the fixed
    communities, or those detected where ``community`` is 'detected'), so queries
    and requests read them instead of building them.

    ``stats_from='all'`` takes all rows' statistics, as the reference does, so
    that test targets reach the features; 'train' takes caps, corridors, graph
    and nodes from the training rows alone."""
    if stats_from not in ("all", "train"):
        raise ValueError(f"stats_from must be all or train, got {stats_from!r}")
    files = shipment_files(sf_dir)
    kind = {} if stats_from == "all" else {"stats_from": stats_from}
    c = ar.table(spark, "cleaned", files, lambda: cl.clean_shipments(
        derived(spark, sf_dir), impute_cutoff=False,
        stats_where=TRAINING if kind else None), kind)
    known = c.where(TRAINING) if kind else c

    def build_nodes(comm):
        edges = ge.corridor_edges(co.corridor_stats(known))
        if comm is None:
            edges = cut_lineage(edges)
            comm = cm.communities(edges)
        cent = rk.node_centrality(edges, pagerank_tol=TIGHT, hits_tol=TIGHT)
        return rk.structural_risk(cut_lineage(
            rk.node_features(cent, fa.facility_stats(known, "distributed"), comm)))

    if isinstance(community, DataFrame):
        nodes = cut_lineage(build_nodes(community))
        return c, nodes, cut_lineage(rk.corridor_enriched(
            co.corridor_stats(known, "hot"), nodes))
    if community not in (None, "detected"):
        raise ValueError(f"community must be a table or 'detected', got {community!r}")
    settings = kind | ({"community": community} if community else {})
    nodes = ar.table(spark, "clean_nodes", files, lambda: build_nodes(
        None if community else region_communities(spark, sf_dir)), settings)
    return c, nodes, ar.table(spark, "clean_corridors", files, lambda: rk.corridor_enriched(
        co.corridor_stats(known, "hot"), nodes), settings)


def features(spark, sf_dir, community=None, stats_from="all") -> DataFrame:
    c, nodes, enr = feature_inputs(spark, sf_dir, community, stats_from)
    return fe.feature_store(c, nodes, enr, stats=c if stats_from == "all" else c.where(TRAINING))


CLEAN_GRAPH = [*O.base_ctes("coarse", clean=True, corridor=True), BASE_EDGES, BASE_NODES]
FEAT_CTES = (CLEAN_GRAPH + O.centrality_ctes("e", "nodes", UNROLLED)
             + [("fac", O.FACILITY.format(src="cln")), ("comm", O.REGION_COMMUNITY),
                ("nf", O.NODE_FEATURES), ("risk", O.RISK), ("enr", ENRICHED_SQL),
                ("feat", O.feature_store_sql())])


@query("feature_store", _wr("SELECT * FROM feat", *FEAT_CTES))
def q_feature_store(spark, sf_dir):
    return features(spark, sf_dir)


TRAIN_FEAT_CTES = (
    [*O.base_ctes("coarse"), ("cln", O.CLEAN_BY_TRAINING.format(src="der")),
     ("trn", "SELECT * FROM cln WHERE data = 'training'"),
     ("corr", O.CORRIDOR.format(src="trn")), BASE_EDGES, BASE_NODES]
    + O.centrality_ctes("e", "nodes", UNROLLED)
    + [("fac", O.FACILITY.format(src="trn")), ("comm", O.REGION_COMMUNITY),
       ("nf", O.NODE_FEATURES), ("risk", O.RISK), ("enr", ENRICHED_SQL),
       ("feat", O.feature_store_sql(stats="training"))])


@query("feature_store_train", _wr("SELECT * FROM feat", *TRAIN_FEAT_CTES))
def q_feature_store_train(spark, sf_dir):
    return features(spark, sf_dir, stats_from="train")


BASE_FEAT_COLS = ["trip_uuid", "route_type", "route_type_enc", "log_osrm_time", "log_osrm_dist",
                  "log_distance", "osrm_speed", "dist_time_ratio", "hour_sin", "hour_cos",
                  "dow_sin", "dow_cos", "month_sin", "month_cos"]


@query("base_features", _w("""
SELECT trip_uuid, route_type, CAST(route_type = 'FTL' AS BIGINT) AS route_type_enc,
  ln(1 + osrm_time) AS log_osrm_time, ln(1 + osrm_distance) AS log_osrm_dist,
  ln(1 + actual_distance_to_destination) AS log_distance,
  osrm_distance / (osrm_time / 60 + 1e-5) AS osrm_speed,
  actual_distance_to_destination / (osrm_time + 1) AS dist_time_ratio,
  sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos,
  sin(2 * pi() * dow / 7) AS dow_sin, cos(2 * pi() * dow / 7) AS dow_cos,
  sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos
FROM der""", *COARSE))
def q_base_features(spark, sf_dir):
    return fe.base_features(derived(spark, sf_dir)).select(*BASE_FEAT_COLS)


@query("network_load", _w("""
SELECT d.trip_uuid, d.hour, COALESCE(hv.n, 0) AS network_load_hour,
  COALESCE(hv.n, 0) / (SELECT max(n) FROM hv) AS network_load_norm
FROM der d LEFT JOIN hv ON d.hour = hv.hour""", *COARSE,
    ("hv", "SELECT hour, count(trip_uuid) AS n FROM der WHERE hour IS NOT NULL GROUP BY hour")))
def q_network_load(spark, sf_dir):
    return fe.network_load(derived(spark, sf_dir)).select(
        "trip_uuid", "hour", "network_load_hour", "network_load_norm")


@query("risk_flags", _wr("""
SELECT trip_uuid, source_center, destination_center, src_structural_risk_score,
  dst_structural_risk_score, high_risk_src, high_risk_dst, both_high_risk FROM feat""",
    *FEAT_CTES))
def q_risk_flags(spark, sf_dir):
    return features(spark, sf_dir).select(
        "trip_uuid", "source_center", "destination_center", "src_structural_risk_score",
        "dst_structural_risk_score", "high_risk_src", "high_risk_dst", "both_high_risk")


_CORR_COLS = fe.ALL_FEATURES[:25]
_CORR_PAIRS = [(a, b) for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]]
_CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, "
    f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END AS corr FROM feat"
    for a, b in _CORR_PAIRS)


@query("feature_correlation", _wr(_CORR_SQL, *FEAT_CTES))
def q_feature_correlation(spark, sf_dir):
    return fe.feature_correlation(features(spark, sf_dir))


# ---------------------------------------------------------------- stage 9: evaluation
from ..operators import evaluate as ev  # noqa: E402


#: The cleaned columns that the deterministic predictors read.
BASELINE_COLS = ["data", "trip_uuid", "route_type", "source_center", "destination_center",
                 "actual_time", "osrm_time", "delay_ratio"]


def baseline_predictions(spark, sf_dir) -> DataFrame:
    """Two deterministic predictors on the test split: the planned time, and
    planned time × the corridor's median delay ratio learned on the training
    split (unknown corridor → training median)."""
    c = ar.table(spark, "baseline_rows", shipment_files(sf_dir),
                 lambda: cleaned(spark, sf_dir).select(*BASELINE_COLS))
    train = c.where(F.col("data") == "training")
    ratio = group_quantiles(train, ["source_center", "destination_center"],
                            [("delay_ratio", 0.5, "_r")], method="hot")
    glob = global_quantiles(train, [("delay_ratio", 0.5, "_g")], method="distributed")
    test = c.where(F.col("data") == "test")
    return (test.join(ratio, ["source_center", "destination_center"], "left")
                .crossJoin(F.broadcast(glob))
                .select("trip_uuid", "route_type", "actual_time",
                        F.col("osrm_time").alias("naive_pred"),
                        (F.col("osrm_time") * F.coalesce("_r", "_g")).alias("corridor_pred")))


PRED_CTES = [*COARSE_CLEAN, ("pred", """
SELECT t.trip_uuid, t.route_type, t.actual_time, t.osrm_time AS naive_pred,
  t.osrm_time * COALESCE(c.r, (SELECT median(delay_ratio) FROM cln WHERE data = 'training'))
    AS corridor_pred
FROM cln t LEFT JOIN (SELECT source_center, destination_center, median(delay_ratio) AS r
                      FROM cln WHERE data = 'training' GROUP BY ALL) c
  USING (source_center, destination_center)
WHERE t.data = 'test'""")]


def metrics_sql(pred: str, model: str, src: str = "pred", by: str | None = None) -> str:
    keys = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    rel = f"abs(actual_time - {pred}) / (actual_time + 1e-5)"
    return f"""
SELECT {keys}'{model}' AS model,
  round(avg(abs(actual_time - {pred})), 3) AS mae,
  round(sqrt(avg((actual_time - {pred}) * (actual_time - {pred}))), 3) AS rmse,
  round(avg({rel}) * 100, 3) AS mape,
  round(CASE WHEN var_pop(actual_time) * count(actual_time) > 0
        THEN 1 - sum((actual_time - {pred}) * (actual_time - {pred}))
                 / (var_pop(actual_time) * count(actual_time))
        WHEN sum((actual_time - {pred}) * (actual_time - {pred})) = 0 THEN 1.0 ELSE 0.0 END, 4) AS r2,
  round(avg(CAST({rel} < 0.15 AS DOUBLE)) * 100, 2) AS within_15pct,
  round(avg(CAST({rel} < 0.2 AS DOUBLE)) * 100, 2) AS within_20pct,
  count(*) AS n_rows
FROM {src}{grp}"""


@query("regression_metrics", _w(metrics_sql("corridor_pred", "corridor_ratio"), *PRED_CTES))
def q_regression_metrics(spark, sf_dir):
    return ev.regression_metrics(baseline_predictions(spark, sf_dir), pred="corridor_pred",
                                 model="corridor_ratio")


@query("naive_eval", _w(metrics_sql("naive_pred", "planned_time"), *PRED_CTES))
def q_naive_eval(spark, sf_dir):
    return ev.regression_metrics(baseline_predictions(spark, sf_dir), pred="naive_pred",
                                 model="planned_time")


@query("metrics_by_route", _w(metrics_sql("corridor_pred", "corridor_ratio", by="route_type"),
                              *PRED_CTES))
def q_metrics_by_route(spark, sf_dir):
    return ev.regression_metrics(baseline_predictions(spark, sf_dir), pred="corridor_pred",
                                 model="corridor_ratio", by=["route_type"])


@query("graph_advantage", _w("""
SELECT b.rmse AS baseline_rmse, g.rmse AS graph_rmse,
  round((b.rmse - g.rmse) / b.rmse * 100, 2) AS rmse_improvement_pct,
  b.mae AS baseline_mae, g.mae AS graph_mae,
  round((b.mae - g.mae) / b.mae * 100, 2) AS mae_improvement_pct,
  b.within_15pct AS baseline_within15, g.within_15pct AS graph_within15,
  round(g.within_15pct - b.within_15pct, 2) AS within15_improvement_pp
FROM mb b, mg g""", *PRED_CTES, ("mb", metrics_sql("naive_pred", "planned_time")),
    ("mg", metrics_sql("corridor_pred", "corridor_ratio"))))
def q_graph_advantage(spark, sf_dir):
    p = baseline_predictions(spark, sf_dir).persist()
    return ev.graph_advantage(ev.regression_metrics(p, pred="naive_pred"),
                              ev.regression_metrics(p, pred="corridor_pred"))


_BLEND_W = sorted(set([0.5] + [round(0.30 + 0.05 * i, 2) for i in range(10)]))
BLEND_SQL = f"""
SELECT weight, rmse, mae,
  CAST(weight = COALESCE((SELECT min(weight) FROM g WHERE rmse < (SELECT rmse FROM g WHERE weight = 0.5)
                          AND rmse = (SELECT min(rmse) FROM g)), 0.5) AS BIGINT) AS is_best
FROM g"""
BLEND_G = ("g", " UNION ALL ".join(
    f"SELECT CAST({w} AS DOUBLE) AS weight, "
    f"sqrt(avg(power(actual_time - ({w} * corridor_pred + {round(1 - w, 10)} * naive_pred), 2))) AS rmse, "
    f"avg(abs(actual_time - ({w} * corridor_pred + {round(1 - w, 10)} * naive_pred))) AS mae FROM pred"
    for w in _BLEND_W))


@query("blend_search", _w(BLEND_SQL, *PRED_CTES, BLEND_G))
def q_blend_search(spark, sf_dir):
    return ev.blend_search(baseline_predictions(spark, sf_dir), "corridor_pred", "naive_pred")


@query("improvement_steps", _w("""
SELECT step, name, rmse, rmse - lag(rmse) OVER (ORDER BY step) AS delta FROM (
  SELECT CAST(1 AS BIGINT) AS step, 'planned_time' AS name, (SELECT rmse FROM mb) AS rmse
  UNION ALL SELECT CAST(2 AS BIGINT), 'corridor_ratio', (SELECT rmse FROM mg)
  UNION ALL SELECT CAST(3 AS BIGINT), 'blend', (SELECT round(rmse, 3) FROM bl WHERE is_best = 1))""",
    *PRED_CTES, ("mb", metrics_sql("naive_pred", "planned_time")),
    ("mg", metrics_sql("corridor_pred", "corridor_ratio")), BLEND_G, ("bl", BLEND_SQL)))
def q_improvement_steps(spark, sf_dir):
    p = baseline_predictions(spark, sf_dir).persist()
    nb = ev.regression_metrics(p, pred="naive_pred").select(
        F.lit(1).alias("step"), F.lit("planned_time").alias("name"), "rmse")
    cr = ev.regression_metrics(p, pred="corridor_pred").select(
        F.lit(2).alias("step"), F.lit("corridor_ratio").alias("name"), "rmse")
    bl = ev.blend_search(p, "corridor_pred", "naive_pred").where("is_best = 1").select(
        F.lit(3).alias("step"), F.lit("blend").alias("name"), F.round("rmse", 3).alias("rmse"))
    return ev.improvement_steps(nb.unionByName(cr).unionByName(bl))


@query("residual_histogram", _w(
    _hist_sql("(SELECT actual_time - corridor_pred AS residual FROM pred)", "residual",
              -500.0, 500.0, 80), *PRED_CTES))
def q_residual_histogram(spark, sf_dir):
    r = ev.residuals(baseline_predictions(spark, sf_dir), pred="corridor_pred")
    return pf.histogram(r, "residual", -500.0, 500.0, 80)


# ---------------------------------------------------------------- stage 11: decisions
from ..operators import recommend as rc  # noqa: E402
from ..operators import whatif as wi  # noqa: E402


def _rec_sql(src: str) -> str:
    return f"""
SELECT *, CASE WHEN ftl_score >= carting_score THEN 'FTL' ELSE 'Carting' END AS recommended,
  CASE WHEN distance_km > 150 AND weekly_trips > 20 THEN 'FTL'
       WHEN distance_km < 50 OR weekly_trips < 10 THEN 'Carting'
       WHEN ftl_score >= carting_score THEN 'FTL' ELSE 'Carting' END AS recommended_memo,
  abs(ftl_score - carting_score) / greatest(ftl_score + carting_score, 1) AS confidence,
  CASE WHEN abs(ftl_score - carting_score) / greatest(ftl_score + carting_score, 1) > 0.4 THEN 'High'
       WHEN abs(ftl_score - carting_score) / greatest(ftl_score + carting_score, 1) > 0.2 THEN 'Medium'
       ELSE 'Low' END AS confidence_level,
  CASE WHEN sla_breach_rate > 0.7 THEN 'HIGH' WHEN sla_breach_rate > 0.4 THEN 'MEDIUM'
       ELSE 'LOW' END AS sla_risk
FROM (SELECT *,
  CAST(CASE WHEN distance_km >= 150 THEN 3 WHEN distance_km < 50 THEN 0 ELSE 1 END
   + CASE WHEN weekly_trips >= 30 THEN 2 ELSE 0 END
   + CASE WHEN sla_breach_rate > 0.8 THEN 2 ELSE 0 END
   + CASE WHEN src_risk > 0.5 THEN 1 ELSE 0 END AS BIGINT) AS ftl_score,
  CAST(CASE WHEN distance_km >= 150 THEN 0 WHEN distance_km < 50 THEN 3 ELSE 0 END
   + CASE WHEN weekly_trips >= 30 THEN 0 ELSE 2 END AS BIGINT) AS carting_score
  FROM {src})"""


REC_INPUT = ("rin", """
SELECT source_center, destination_center, trip_count, ftl_share, sla_breach_rate, src_risk,
  median_distance AS distance_km,
  trip_count / ((SELECT date_diff('day', CAST(min(od_start_time) AS DATE),
                                  CAST(max(od_start_time) AS DATE)) + 1 FROM der) / 7.0) AS weekly_trips
FROM enr0""")
REC_COLS = ["source_center", "destination_center", "trip_count", "ftl_share", "sla_breach_rate",
            "src_risk", "distance_km", "weekly_trips", "ftl_score", "carting_score",
            "recommended", "recommended_memo", "confidence", "confidence_level", "sla_risk"]


def recommendations(spark, sf_dir) -> DataFrame:
    d = derived_stats(spark, sf_dir)
    enr = rk.corridor_enriched(co.corridor_stats(d), risk_nodes(spark, sf_dir))
    req = rc.corridor_requests(enr, d)
    memo = rc.memo_rule(F.col("distance_km"), F.col("weekly_trips"), F.col("recommended"))
    return rc.recommend_route(req, hour=None).withColumn("recommended_memo", memo) \
        .select(*REC_COLS)


REC_CTES = [*NODEF, ("enr0", ENRICHED_SQL), REC_INPUT, ("rec", _rec_sql("rin"))]


@query("recommend_route", _wr(f"SELECT {', '.join(REC_COLS)} FROM rec", *REC_CTES))
def q_recommend_route(spark, sf_dir):
    return recommendations(spark, sf_dir)


@query("misrouted_corridors", _wr(f"""
SELECT {', '.join(REC_COLS)}, CASE WHEN ftl_share > 0.5 THEN 'FTL' ELSE 'Carting' END
  AS dominant_route_type
FROM rec WHERE (CASE WHEN ftl_share > 0.5 THEN 'FTL' ELSE 'Carting' END) <> recommended""",
    *REC_CTES))
def q_misrouted(spark, sf_dir):
    return rc.misrouted(recommendations(spark, sf_dir))


@query("distance_bands", _w("""
SELECT g.band_order, g.band, g.recommended, g.sla_risk, COALESCE(a.n, 0) AS n_corridors,
  a.m AS mean_sla_breach_rate
FROM (VALUES (0::BIGINT, '<50km', 'Carting', 'Low'), (1, '50-150km', 'Model-Dep', 'Medium'),
             (2, '150-300km', 'FTL', 'Medium'), (3, '300-600km', 'FTL', 'High'),
             (4, '>600km', 'FTL', 'High')) g(band_order, band, recommended, sla_risk)
LEFT JOIN (SELECT CASE WHEN median_distance < 50 THEN 0 WHEN median_distance < 150 THEN 1
                       WHEN median_distance < 300 THEN 2 WHEN median_distance < 600 THEN 3
                       WHEN median_distance >= 600 THEN 4 END AS b,
                  count(*) AS n, avg(sla_breach_rate) AS m
           FROM corr GROUP BY 1) a ON g.band_order = a.b""", *FINE_CORR))
def q_distance_bands(spark, sf_dir):
    return rc.distance_bands(corridors(spark, sf_dir, "fine"))


@query("hub_upgrade_whatif", _wr("""
SELECT s.scenario, count(CASE WHEN t THEN 1 END) AS affected_trips,
  count(CASE WHEN t AND is_sla_breach THEN 1 END) AS breaches_before,
  count(CASE WHEN t AND COALESCE(actual_time * (1 - s.r) > cutoff_factor, false) THEN 1 END)
    AS breaches_after,
  avg(CAST(COALESCE(CASE WHEN t THEN actual_time * (1 - s.r) > cutoff_factor
                         ELSE is_sla_breach END, false) AS DOUBLE)) * 100 AS new_overall_breach_rate,
  s.r * 100 AS delay_reduction_pct,
  count(CASE WHEN t AND is_sla_breach THEN 1 END)
    - count(CASE WHEN t AND COALESCE(actual_time * (1 - s.r) > cutoff_factor, false) THEN 1 END)
    AS breaches_avoided,
  CASE WHEN count(CASE WHEN t AND is_sla_breach THEN 1 END) > 0 THEN
    (count(CASE WHEN t AND is_sla_breach THEN 1 END)
     - count(CASE WHEN t AND COALESCE(actual_time * (1 - s.r) > cutoff_factor, false) THEN 1 END))
    / count(CASE WHEN t AND is_sla_breach THEN 1 END) * 100 END AS pct_breach_reduction
FROM (SELECT *, (source_center IN (SELECT facility FROM h3)
                 OR destination_center IN (SELECT facility FROM h3)) AS t FROM der) x,
     (VALUES ('worst_case', 0.10::DOUBLE), ('expected', 0.20::DOUBLE), ('best_case', 0.35::DOUBLE)) s(scenario, r)
GROUP BY s.scenario, s.r""",
    *NODEF, ("h3", "SELECT facility FROM risk ORDER BY structural_risk_score DESC, facility LIMIT 3")))
def q_hub_upgrade(spark, sf_dir):
    return wi.hub_upgrade_whatif(derived(spark, sf_dir), risk_nodes(spark, sf_dir))


# ---------------------------------------------------------------- stage 10: models
from ..operators import cluster as cu  # noqa: E402
from ..operators import models as ml  # noqa: E402
from ..operators import score as sc  # noqa: E402
from ..operators.graph import embedding as emb  # noqa: E402

FEATURE_KEYS = ("row_key", "trip_uuid", "data", "route_type", "source_center",
                "destination_center")


#: Bytes of a row group of the feature store (some 10,000 rows).
ROW_GROUP = 2 << 20


def cached_features(spark, sf_dir, force_rebuild: bool = False) -> DataFrame:
    """SRC4: the feature store (with ``row_key``), built once per content of
    its input files, split into folders by ``data`` so a split reads its own."""
    def build():
        c, nodes, enr = feature_inputs(spark, sf_dir)
        out = fe.feature_store(c.withColumnRenamed("row_id", "row_key"), nodes, enr,
                               keys=FEATURE_KEYS)
        return out.select(*[x for x in out.columns if x != "data"], "data")

    # a task reads whole row groups: many small ones let every core score a small store, too
    return ar.table(spark, "features", shipment_files(sf_dir), build, partition_by=["data"],
                    force_rebuild=force_rebuild, row_group=ROW_GROUP)


def _split(spark, sf_dir):
    fs = cached_features(spark, sf_dir)
    return fs.where(F.col("data") == "training"), fs.where(F.col("data") == "test")


# fixed values: which route types' models make up a family
FAMILIES = {"histgbm": {"FTL": "hgb_ftl", "Carting": "hgb_carting"},
            "xgboost": {"FTL": "xgb_route", "Carting": "xgb_route"},
            "lightgbm": {"FTL": "lgbm_route", "Carting": "lgbm_route"}}
#: What models and their metrics depend on beside the input files.
MODEL_FACTS = {"rows": "all labelled", "kinds": ml.SETTINGS, "patience": ml.PATIENCE}
DIM = 32
EMB_FEATURES = [f"{e}_emb_{i}" for e in ("src", "dst") for i in range(DIM)]


def _features_of(kind: str) -> list[str]:
    if kind.endswith("_base"):
        return fe.BASE_FEATURES
    return fe.ALL_FEATURES + (EMB_FEATURES if kind.endswith("_emb") else [])


def model_store(spark, sf_dir) -> "ar.ModelStore":
    """SNK3: the store of the models fitted on these input files and settings."""
    key = ar.artefact_key(spark, "models", shipment_files(sf_dir),
                          MODEL_FACTS)
    return ar.ModelStore(spark, f"{ar.artefact_root(spark)}/models-{key}")


def fitted(spark, sf_dir, train, kinds, then=lambda kind, model: model) -> dict:
    """Models of the kinds, or what ``then`` makes of each; they are loaded from the
    store, and missing ones are fitted and stored: boostings side by side, forests one
    by one, as their parts are side by side and their nodes fill the driver.  A kind
    may be (kind, route type), learned from its rows."""
    store, rows = model_store(spark, sf_dir), ml.fitting_rows(train)

    def one(kind):
        name, rt = kind if isinstance(kind, tuple) else (kind, None)
        label = f"{name}-{rt}" if rt else name
        with ar.alone(f"{store.path}/{label}"):
            if label in store.names():
                return store.load(label)
            mine = rows.where(F.col("route_type") == rt) if rt else rows
            model = ml.fit(mine, _features_of(name), name)
            family = next((f for f, m in FAMILIES.items() if m.get(rt) == name), None)
            store.save(label, model, kind=name, family=family, route_type=rt,
                       features=_features_of(name), settings=ml.SETTINGS[name])
            return model

    forests = [k for k in kinds if str(k).startswith(("rf_", "et_"))]
    strings = [[k] for k in kinds if k not in forests] + ([forests] if forests else [])
    return {k: x for part in ml.concurrently(spark, [
        lambda ks=ks: [(k, then(k, one(k))) for k in ks] for ks in strings]) for k, x in part}


def route_models(spark, sf_dir, train, family: str = "histgbm") -> dict:
    """{route type: model} of a family, fitted and stored if missing."""
    kinds = [(kind, rt) for rt, kind in FAMILIES[family].items()]
    return {rt: m for (_, rt), m in fitted(spark, sf_dir, train, kinds).items()}


def _metrics(spark, sf_dir, name, build) -> DataFrame:
    """Metric rows kept in the store, so reports share them."""
    return ar.table(spark, f"metrics_{name}", shipment_files(sf_dir), build,
                    MODEL_FACTS)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _evaluated(spark, sf_dir, name, rows) -> DataFrame:
    """Metrics over the test split of models [(kind, label, phase)]."""
    def build():
        tr, te = _split(spark, sf_dir)
        found = fitted(spark, sf_dir, tr, [k for k, _, _ in rows], lambda kind, model: _union([
            ml.evaluate(model, te, label, phase) for k, label, phase in rows if k == kind]))
        return _union([found[k] for k, _, _ in rows])
    return _metrics(spark, sf_dir, name, build)


@query("lr_eval")
def q_lr_eval(spark, sf_dir):
    tr, te = _split(spark, sf_dir)
    return ml.evaluate(ml.linear(tr, fe.BASE_FEATURES), te, "Linear Regression", "base")


@query("ridge_eval")
def q_ridge_eval(spark, sf_dir):
    tr, te = _split(spark, sf_dir)
    return ml.evaluate(ml.linear(tr, fe.BASE_FEATURES, alpha=10.0), te, "Ridge", "base")


@query("rf_eval")
def q_rf_eval(spark, sf_dir):
    return _evaluated(spark, sf_dir, "rf", [
        ("rf_base", "Random Forest", "rf_base"),
        ("et_base", "Extra Trees (substitute)", "et_base"), ("rf_v2", "RF v2", "rf_v2")])


@query("gbt_eval")
def q_gbt_eval(spark, sf_dir):
    return _evaluated(spark, sf_dir, "gbt", [(k, k, k) for k in
                                             ("gbt_base", "hgb_base", "hgb_graph")])


def _base_and_graph(spark, sf_dir) -> DataFrame:
    """ML1-ML9: metrics of the phases Baseline and Graph-Enhanced."""
    def plain():
        tr, te = _split(spark, sf_dir)
        naive = ev.regression_metrics(te.withColumn("prediction", F.expm1("log_osrm_time")),
                                      model="Planned time (naive)") \
            .withColumn("phase", F.lit("Baseline"))
        return _union([naive, ml.evaluate(ml.linear(tr, fe.BASE_FEATURES), te,
                                          "Linear Regression", "Baseline"),
                       ml.evaluate(ml.linear(tr, fe.BASE_FEATURES, alpha=10.0), te, "Ridge",
                                   "Baseline")])

    trees = [(f"{k}_{x}", label + extra, phase)
             for k, label in (("rf", "Random Forest"), ("gbt", "GBT"),
                              ("et", "Extra Trees (substitute)"))
             for x, extra, phase in (("base", "", "Baseline"),
                                     ("graph", " + graph", "Graph-Enhanced"))]
    return _metrics(spark, sf_dir, "plain", plain).unionByName(
        _evaluated(spark, sf_dir, "base_and_graph", trees))


@query("graph_lift")
def q_graph_lift(spark, sf_dir):
    best = ev.best_per_phase(_base_and_graph(spark, sf_dir))
    return ev.graph_advantage(best.where("phase = 'Baseline'"),
                              best.where("phase = 'Graph-Enhanced'"))


def _embeddings(spark, sf_dir, dim=DIM):
    d = derived(spark, sf_dir)
    e = ge.corridor_edges(co.corridor_stats(d), "median_delay_ratio")
    return emb.svd_embedding(e, dim)


@query("node_embeddings")
def q_node_embeddings(spark, sf_dir):
    return _embeddings(spark, sf_dir, DIM)


def _embedded(spark, sf_dir) -> DataFrame:
    """ML10: metrics of the models with embeddings of both endpoints."""
    def build():
        tr, te = _split(spark, sf_dir)
        em = _embeddings(spark, sf_dir)
        rows = emb.add_embeddings(ml.fitting_rows(tr), em, DIM)
        te = emb.add_embeddings(te, em, DIM)
        kinds = (("rf_emb", "Random Forest"), ("gbt_emb", "GBT"))
        models = ml.concurrently(spark, [lambda k=k: ml.fit(rows, _features_of(k), k)
                                         for k, _ in kinds])
        return _union([ml.evaluate(m, te, f"{name} + graph + embeddings", "Graph-ML")
                       for m, (_, name) in zip(models, kinds)])
    return _metrics(spark, sf_dir, "embedded", build)


@query("embedding_lift")
def q_embedding_lift(spark, sf_dir):
    g = _evaluated(spark, sf_dir, "rf_graph", [("rf_graph", "RF + graph", "Graph-Enhanced")])
    return ev.graph_advantage(g, _embedded(spark, sf_dir).where("model like 'Random Forest%'"))


@query("per_route_eval")
def q_per_route_eval(spark, sf_dir):
    tr, te = _split(spark, sf_dir)
    preds = ml.per_route(route_models(spark, sf_dir, tr), te)
    return (ev.regression_metrics(preds, model="per-route GBT", by=["route_type"])
              .unionByName(ev.regression_metrics(preds, model="per-route GBT")
                             .withColumn("route_type", F.lit("all"))))


STACK_NAMES = {ml.STACK: "3-fold stack → ridge", ml.STACK_BOOSTED: "3-fold stack of five → ridge"}


def _stack(spark, sf_dir, train, kinds):
    """The stack of the kinds on all labelled rows; its fold models are stored, so
    stacks share those of their common kinds."""
    store = model_store(spark, sf_dir)

    def fold_model(rows, features, kind, fold):
        label = f"{kind}-fold{fold}"
        with ar.alone(f"{store.path}/{label}"):
            if label in store.names():
                return store.load(label)
            model = ml.fit(rows, features, kind)
            store.save(label, model, kind=kind, fold=fold, features=features)
            return model

    return ml.stacking(ml.fitting_rows(train), fe.ALL_FEATURES, kinds,
                       fit_fold=fold_model)


def _stacked(spark, sf_dir, kinds):
    """The test split with the stack's prediction."""
    tr, te = _split(spark, sf_dir)
    return _stack(spark, sf_dir, tr, kinds)(te, "stack")


@query("stacking_eval")
def q_stacking_eval(spark, sf_dir):
    return _union(ml.concurrently(spark, [
        lambda kinds=kinds, n=n: _metrics(spark, sf_dir, f"stack_of_{len(kinds)}", lambda:
                                          ev.regression_metrics(_stacked(spark, sf_dir, kinds),
                                                                pred="stack", model=n))
        for kinds, n in STACK_NAMES.items()]))


def _ensembles(spark, sf_dir, kinds, routes: dict, grid, fixed=(), name="blend") -> list:
    """Metric rows [(label, metrics)] of the stack, the route models of the
    families, their blends at fixed weights and at the best weight of the grid."""
    tr, te = _split(spark, sf_dir)
    stack, *by_family = ml.concurrently(spark, [
        lambda: _stack(spark, sf_dir, tr, kinds),
        *[lambda f=f: route_models(spark, sf_dir, tr, f) for f in routes]])
    p = stack(te, "stack")
    for f, models in zip(routes, by_family):
        p = ml.per_route(models, p, f)
    p = p.select("row_key", "route_type", ml.LABEL, "stack", *routes).persist()
    rows, errors = [], {}
    for f, label in routes.items():
        m = ev.regression_metrics(p, pred=f, model=label)
        errors[f] = m.first()["rmse"]
        rows.append((label, m))
    rows.append((STACK_NAMES[kinds], ev.regression_metrics(p, pred="stack",
                                                           model=STACK_NAMES[kinds])))
    better = min(errors, key=errors.get)
    for w, label in fixed:
        rows.append((label, ev.regression_metrics(ml.blend(p, "stack", better, w), model=label)))
    w, best = ml.best_blend(p, "stack", better, grid)
    return rows + [(name, ev.regression_metrics(best, model=f"{name} (w={w:.2f})"))]


@query("boosted_eval")
def q_boosted_eval(spark, sf_dir):
    """ML17-ML22: boosted models, per route, stack of five, blend with the better route models."""
    def ensembles():
        rows = _ensembles(spark, sf_dir, ml.STACK_BOOSTED,
                          {"xgboost": "per-route xgb_route", "lightgbm": "per-route lgbm_route"},
                          [round(0.30 + 0.05 * i, 2) for i in range(11)], name="blend v2")
        return _union([m.withColumn("phase", F.lit("BEST-v2" if label == "blend v2" else "boosted"))
                       for label, m in rows])

    single = [("hgb_boosted", "hgb_boosted", "existing"), ("xgb_like", "xgb_like", "boosted"),
              ("lgbm_like", "lgbm_like", "boosted")]
    return _union(ml.concurrently(spark, [
        lambda: _evaluated(spark, sf_dir, "boosted", single),
        lambda: _metrics(spark, sf_dir, "boosted_ensembles", ensembles)]))


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    tr, _ = _split(spark, sf_dir)
    m = fitted(spark, sf_dir, tr, ["rf_graph"])["rf_graph"]
    return ml.importances(spark, m, fe.ALL_FEATURES).orderBy(F.col("importance").desc(), "feature")


# fixed values: the order of the phases in the overall table
PHASES = ["Baseline", "Graph-Enhanced", "Graph-ML", "v2-Baseline", "v2-Graph", "v2-PerRoute",
          "v2-Ensemble", "v2-BEST"]


@query("benchmark_table")
def q_benchmark_table(spark, sf_dir):
    """FLT7 + SRT2: the overall table, without models of one route type's
    slice, by phase and RMSE."""
    def ensembles():
        rows = _ensembles(spark, sf_dir, ml.STACK, {"histgbm": "per-route GBT"},
                          [round(0.30 + 0.05 * i, 2) for i in range(10)],
                          [(0.5, "stack and per-route, halves")])
        phase = {"per-route GBT": "v2-PerRoute", "blend": "v2-BEST"}
        return _union([m.withColumn("phase", F.lit(phase.get(label, "v2-Ensemble")))
                       for label, m in rows])

    v2 = [("rf_v2", "RF v2", "v2-Graph"), ("hgb_base", "Hist GBT", "v2-Baseline"),
          ("hgb_graph", "Hist GBT + graph", "v2-Graph")]
    rows = _union(ml.concurrently(spark, [
        lambda: _base_and_graph(spark, sf_dir), lambda: _embedded(spark, sf_dir),
        lambda: _evaluated(spark, sf_dir, "v2", v2),
        lambda: _metrics(spark, sf_dir, "ensembles", ensembles)]))
    order = F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col("phase"))
    return rows.orderBy(order, "rmse", "model")


@query("residual_sample")
def q_residual_sample(spark, sf_dir):
    tr, te = _split(spark, sf_dir)
    m = fitted(spark, sf_dir, tr, ["hgb_graph"])["hgb_graph"]
    r = ev.residuals(ml.predict(m, te), pred="prediction")
    return ev.deterministic_sample(r.select("row_key", "route_type", "actual_time", "prediction",
                                            "residual"), 3000, ["row_key"])


# ---------------------------------------------------------------- records from CSV, fallbacks
from ..sources import csv as sc_csv  # noqa: E402

def faulty_csv(spark, sf_dir) -> str:
    """The shipments as CSV files with faults by order number; their folder."""
    o = F.substring("trip_uuid", 2, 20).cast("long")
    s = shipments(spark, sf_dir)
    texts = [F.date_format(c, sc_csv.DATE_FORMAT).alias(c) if c in sc_csv.DATES
             else F.col(c).cast("string").alias(c) for c in RAW_COLUMNS]
    s = s.select(*texts, o.alias("o"))
    s = (s.withColumn("od_start_time", F.when(F.col("o") % 13 == 0, "no date")
                      .when(F.col("o") % 17 == 0, "").otherwise(F.col("od_start_time")))
          .withColumn("actual_time", F.when(F.col("o") % 19 == 0, "n/a")
                      .otherwise(F.col("actual_time"))))
    path = f"{ar.artefact_root(spark)}/csv-{uuid.uuid4().hex}"
    s.drop("o").write.csv(path, header=True)
    return path


@query("csv_shipments", _w("""
SELECT trip_uuid, destination_center,
  CASE WHEN o % 19 <> 0 THEN actual_time END AS actual_time,
  CASE WHEN o % 19 <> 0 THEN hour(t) END AS start_hour,
  CASE WHEN o % 19 <> 0 THEN month(t) END AS start_month,
  CASE WHEN o % 19 = 0 THEN 'actual_time is not a number' END AS reason
FROM (SELECT *, try_cast(CASE WHEN o % 13 = 0 THEN 'no date' WHEN o % 17 = 0 THEN ''
                              ELSE CAST(od_start_time AS VARCHAR) END AS TIMESTAMP) AS t
      FROM (SELECT *, CAST(substr(trip_uuid, 2) AS BIGINT) AS o FROM ship))""", *COARSE[:1]))
def q_csv_shipments(spark, sf_dir):
    """SRC1 from CSV: kept and quarantined rows together."""
    good, bad = sc_csv.read_shipments_csv(spark, faulty_csv(spark, sf_dir))
    none = F.lit(None)
    return good.select(
        "trip_uuid", "destination_center", "actual_time",
        F.hour("od_start_time").alias("start_hour"), F.month("od_start_time").alias("start_month"),
        none.cast("string").alias("reason")).unionByName(bad.select(
            "trip_uuid", "destination_center", none.cast("double").alias("actual_time"),
            none.cast("int").alias("start_hour"), none.cast("int").alias("start_month"),
            "reason"))


@query("sample_summary", _w("""
SELECT is_sample, count(*) AS n_rows, count(DISTINCT trip_uuid) AS n_trips,
  max(actual_time) AS max_actual_time
FROM (SELECT false AS is_sample, * FROM ship
      UNION ALL SELECT true, * FROM ship WHERE substr(md5(trip_uuid), 1, 2) < '08')
GROUP BY is_sample""", *COARSE[:1]))
def q_sample_summary(spark, sf_dir):
    """SRC3: the report on the full records, and on the sample that is read where they lack."""
    root = f"{ar.artefact_root(spark)}/records-{uuid.uuid4().hex}"
    s = shipments(spark, sf_dir).select("trip_uuid", "actual_time")
    s.write.parquet(f"{root}/full")
    sc_csv.hash_sample(s).write.parquet(f"{root}/sample")
    both = _union([sc_csv.shipments_or_sample(spark, f"{root}/{name}", f"{root}/sample")
                   for name in ("full", "missing")])
    return both.groupBy("is_sample").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("trip_uuid").alias("n_trips"),
        F.max("actual_time").alias("max_actual_time"))


@query("clean_strategies", _w("""
SELECT 'none' AS strategy, count(*) AS n_rows, max(actual_time) AS max_actual_time
FROM der WHERE osrm_time > 0
UNION ALL SELECT 'winsorize', count(*), max(least(actual_time, cap))
FROM der JOIN q USING (route_type) WHERE osrm_time > 0
UNION ALL SELECT 'drop', count(*), max(actual_time)
FROM der JOIN q USING (route_type) WHERE osrm_time > 0 AND actual_time <= cap""", *COARSE,
    ("q", "SELECT route_type, quantile_cont(actual_time, 0.99) AS cap FROM der "
          "WHERE osrm_time > 0 GROUP BY route_type")))
def q_clean_strategies(spark, sf_dir):
    """CLN3: rows and greatest time under each strategy."""
    d = derived(spark, sf_dir)
    return _union([cl.clean_shipments(d, s, impute_cutoff=False).agg(
        F.lit(s).alias("strategy"), F.count(F.lit(1)).alias("n_rows"),
        F.max("actual_time").alias("max_actual_time")) for s in ("none", "winsorize", "drop")])


@query("delay_density_by_route", _w(
    _hist_sql("der", "delay_ratio", 0.0, 8.0, 40, by="route_type", density=True), *COARSE))
def q_delay_density(spark, sf_dir):
    return pf.histogram(derived(spark, sf_dir), "delay_ratio", 0.0, 8.0, 40, by="route_type",
                        density=True)


@query("breach_labels", _w("""
SELECT route_type, CAST(round(avg(CAST(is_sla_breach AS DOUBLE)) * 100, 1) AS VARCHAR) || '%'
  AS breach_label FROM der GROUP BY route_type""", *COARSE))
def q_breach_labels(spark, sf_dir):
    return pf.rate_by(derived(spark, sf_dir), "route_type").select(
        "route_type", sc_csv.percent_text(F.col("sla_breach_rate") * 100).alias("breach_label"))


def _delayed_fine(spark, sf_dir):
    return co.delayed_corridors(corridors(spark, sf_dir, "fine"))


@query("corridor_clusters")
def q_corridor_clusters(spark, sf_dir):
    return cu.cluster_profile(cu.corridor_clusters(_delayed_fine(spark, sf_dir)))


@query("cluster_names")
def q_cluster_names(spark, sf_dir):
    return cu.cluster_names(cu.cluster_profile(cu.corridor_clusters(_delayed_fine(spark, sf_dir))))


# ---------------------------------------------------------------- scoring
def requests(c: DataFrame) -> DataFrame:
    """Scoring requests: the cleaned test-split shipments as ETA requests."""
    return c.where(F.col("data") == "test").select(
        F.col("trip_uuid").alias("request_id"), "osrm_time", "osrm_distance",
        F.col("actual_distance_to_destination").alias("actual_distance"), "route_type", "hour",
        F.col("dow").alias("day_of_week"), "month", "source_center", "destination_center",
        "cutoff_factor")


SCORE_SQL = """
SELECT request_id, route_type, source_center, destination_center, osrm_time, {feats},
  CASE WHEN COALESCE(r_sla, 0.0) > 0.7 THEN 'HIGH' WHEN COALESCE(r_sla, 0.0) > 0.4 THEN 'MEDIUM'
       ELSE 'LOW' END AS corridor_sla_risk,
  round(corr_median_delay_ratio, 3) AS corridor_delay_ratio,
  round(src_structural_risk_score, 4) AS source_risk_score,
  round(dst_structural_risk_score, 4) AS destination_risk_score,
  CAST(r_trips IS NULL AS BIGINT) AS is_cold_corridor
FROM (SELECT *, CAST(src_structural_risk_score > 0.3 AS BIGINT) AS high_risk_src,
             CAST(dst_structural_risk_score > 0.3 AS BIGINT) AS high_risk_dst,
             CAST(src_structural_risk_score > 0.3 AS BIGINT)
               * CAST(dst_structural_risk_score > 0.3 AS BIGINT) AS both_high_risk
      FROM (SELECT q.*, COALESCE(q.cutoff_factor0, 180.0) AS cutoff_factor,
              CAST(q.route_type = 'FTL' AS BIGINT) AS route_type_enc,
              ln(1 + q.osrm_time) AS log_osrm_time, ln(1 + q.osrm_distance) AS log_osrm_dist,
              ln(1 + q.actual_distance) AS log_distance,
              q.osrm_distance / (q.osrm_time / 60 + 1e-5) AS osrm_speed,
              q.actual_distance / (q.osrm_time + 1) AS dist_time_ratio,
              q.day_of_week AS dow,
              CAST(COALESCE(q.day_of_week IN (5, 6), false) AS BIGINT) AS is_weekend,
              CAST(COALESCE(q.hour IN (7, 8, 9, 17, 18, 19), false) AS BIGINT) AS is_rush_hour,
              sin(2 * pi() * q.hour / 24) AS hour_sin, cos(2 * pi() * q.hour / 24) AS hour_cos,
              sin(2 * pi() * q.day_of_week / 7) AS dow_sin, cos(2 * pi() * q.day_of_week / 7) AS dow_cos,
              sin(2 * pi() * q.month / 12) AS month_sin, cos(2 * pi() * q.month / 12) AS month_cos,
              0.5 AS network_load_norm, 0 AS cross_community_flag,
              {nodes},
              {corr},
              r.sla_breach_rate AS r_sla, r.trip_count AS r_trips
            FROM req q
            LEFT JOIN risk s ON q.source_center = s.facility
            LEFT JOIN risk d ON q.destination_center = d.facility
            LEFT JOIN enr r ON q.source_center = r.source_center
                           AND q.destination_center = r.destination_center))"""


def _score_sql() -> str:
    nodes = ",\n              ".join(
        f"COALESCE(CAST(s.{c} AS DOUBLE), (SELECT median({c}) FROM risk)) AS src_{c}, "
        f"COALESCE(CAST(d.{c} AS DOUBLE), (SELECT median({c}) FROM risk)) AS dst_{c}"
        for c in sc.NODE_SERVE)
    corr = ",\n              ".join(
        f"COALESCE(NULLIF(COALESCE(CAST(r.{c} AS DOUBLE), 0.0), 0.0), {v!r}) AS corr_{c}"
        for c, v in sc.CORRIDOR_DEFAULTS.items())
    feats = ", ".join(f"COALESCE(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in fe.ALL_FEATURES)
    return SCORE_SQL.format(feats=feats, nodes=nodes, corr=corr)


@query("score_features", _wr(_score_sql(), *FEAT_CTES[:-1], ("req", """
SELECT trip_uuid AS request_id, osrm_time, osrm_distance,
  actual_distance_to_destination AS actual_distance, route_type, hour, dow AS day_of_week,
  month, source_center, destination_center, cutoff_factor AS cutoff_factor0
FROM cln WHERE data = 'test'""")))
def q_score_features(spark, sf_dir):
    c, nodes, enr = feature_inputs(spark, sf_dir)
    reqs = requests(c)
    sc.validate_requests(reqs)
    return sc.score_features(reqs, nodes, enr)


@query("score_eta")
def q_score_eta(spark, sf_dir):
    """INF1/INF4/INF5: the route models are trained if the store lacks them;
    scoring itself loads them and never fits."""
    tr, _ = _split(spark, sf_dir)
    route_models(spark, sf_dir, tr)
    models = ar.merged_models([model_store(spark, sf_dir)])
    c, nodes, enr = feature_inputs(spark, sf_dir)
    reqs = requests(c)
    sc.validate_requests(reqs)
    return sc.score_eta(sc.score_features(reqs, nodes, enr), models, "histgbm")
