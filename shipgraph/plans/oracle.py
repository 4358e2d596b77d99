"""SQL building blocks for the DuckDB oracle.

Each block restates, in plain SQL over the driver's tables, the same formulas
the Spark operators use, so the driver can compare the two engines.
"""

from __future__ import annotations


def shipments_sql(grain: str = "coarse") -> str:
    src = ("'NAT' || lpad(CAST(s.s_nationkey AS VARCHAR), 3, '0')" if grain == "coarse"
           else "'SUP' || lpad(CAST(l.l_suppkey AS VARCHAR), 7, '0')")
    return f"""
SELECT
  CASE WHEN o.o_orderkey % 10 < 7 THEN 'training' ELSE 'test' END AS data,
  o.o_orderdate AS trip_creation_time,
  'RS' || CAST(o.o_custkey AS VARCHAR) AS route_schedule_uuid,
  CASE WHEN l.l_returnflag = 'N' THEN 'Carting' ELSE 'FTL' END AS route_type,
  'T' || CAST(l.l_orderkey AS VARCHAR) AS trip_uuid,
  {src} AS source_center,
  CASE WHEN l.l_suppkey % 7 = 0 THEN NULL ELSE sn.n_name END AS source_name,
  'NAT' || lpad(CAST(c.c_nationkey AS VARCHAR), 3, '0') AS destination_center,
  CASE WHEN o.o_custkey % 11 = 0 THEN NULL ELSE cn.n_name END AS destination_name,
  o.o_orderdate + to_hours(CAST(o.o_orderkey % 24 AS BIGINT)) AS od_start_time,
  l.l_shipdate AS od_end_time,
  l.l_extendedprice / 100 * (1 + l.l_discount) AS start_scan_to_end_scan,
  l.l_extendedprice / 100 > l.l_quantity * 12 AS is_cutoff,
  l.l_quantity * 12 AS cutoff_factor,
  CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR) AS cutoff_timestamp,
  l.l_quantity * 12 * (1 + l.l_tax) AS actual_distance_to_destination,
  l.l_extendedprice / 100 AS actual_time,
  CASE WHEN o.o_orderkey % 997 = 0 THEN 0.0 ELSE l.l_quantity * 15 END AS osrm_time,
  l.l_quantity * 12 AS osrm_distance,
  (l.l_extendedprice / 100) / NULLIF(CASE WHEN o.o_orderkey % 997 = 0 THEN 0.0 ELSE l.l_quantity * 15 END, 0.0) AS factor,
  l.l_extendedprice / 100 * (1 - l.l_discount) AS segment_actual_time,
  CASE WHEN o.o_orderkey % 997 = 0 THEN 0.0 ELSE l.l_quantity * 15 END AS segment_osrm_time,
  l.l_quantity * 12 AS segment_osrm_distance,
  (l.l_extendedprice / 100) / NULLIF(CASE WHEN o.o_orderkey % 997 = 0 THEN 0.0 ELSE l.l_quantity * 15 END, 0.0) - 1 AS segment_factor
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation cn ON c.c_nationkey = cn.n_nationkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation sn ON s.s_nationkey = sn.n_nationkey
"""


DERIVED = """
SELECT *,
  actual_time / NULLIF(osrm_time, 0.0) AS delay_ratio,
  (actual_time / NULLIF(osrm_time, 0.0) - 1) * 100 AS delay_pct,
  COALESCE(actual_time / NULLIF(osrm_time, 0.0) > 1.2, false) AS is_delayed,
  COALESCE(is_cutoff, true) AS is_sla_breach,
  source_center || ' → ' || destination_center AS corridor,
  hour(od_start_time) AS hour,
  isodow(od_start_time) - 1 AS dow,
  month(od_start_time) AS month,
  CAST(COALESCE(isodow(od_start_time) - 1 IN (5, 6), false) AS BIGINT) AS is_weekend,
  CAST(COALESCE(hour(od_start_time) IN (7, 8, 9, 17, 18, 19), false) AS BIGINT) AS is_rush_hour,
  actual_distance_to_destination AS distance_km
FROM {src}
"""

ENTROPY = """-(
  (count(CASE WHEN route_type = 'FTL' THEN 1 END) / count(route_type))
    * log2(count(CASE WHEN route_type = 'FTL' THEN 1 END) / count(route_type) + 1e-10)
  + (count(CASE WHEN route_type = 'Carting' THEN 1 END) / count(route_type))
    * log2(count(CASE WHEN route_type = 'Carting' THEN 1 END) / count(route_type) + 1e-10))"""

CORRIDOR = f"""
SELECT source_center, destination_center,
  count(trip_uuid) AS trip_count,
  median(actual_time) AS median_actual_time,
  CAST(sum(CAST(actual_time AS DECIMAL(38,10))) AS DOUBLE) / count(actual_time) AS mean_actual_time,
  median(osrm_time) AS median_osrm_time,
  median(delay_ratio) AS median_delay_ratio,
  avg(delay_ratio) AS mean_delay_ratio,
  stddev_samp(delay_ratio) AS std_delay_ratio,
  median(delay_pct) AS delay_pct,
  avg(CAST(is_sla_breach AS DOUBLE)) AS sla_breach_rate,
  avg(CAST(is_delayed AS DOUBLE)) AS chronic_delay_rate,
  median(actual_distance_to_destination) AS median_distance,
  avg(CAST(route_type = 'FTL' AS DOUBLE)) AS ftl_share,
  {ENTROPY} AS route_type_entropy,
  median(delay_ratio) > 1.5 AS is_bottleneck_corridor
FROM {{src}}
GROUP BY source_center, destination_center
"""

# cleaning: drop osrm_time <= 0, cap actual_time at the per-route-type q99
CLEAN = """
SELECT d.* REPLACE (
    CASE WHEN d.actual_time > q.cap THEN q.cap ELSE d.actual_time END AS actual_time,
    CASE WHEN d.actual_time > q.cap THEN q.cap ELSE d.actual_time END
      / NULLIF(d.osrm_time, 0.0) AS delay_ratio,
    (CASE WHEN d.actual_time > q.cap THEN q.cap ELSE d.actual_time END
      / NULLIF(d.osrm_time, 0.0) - 1) * 100 AS delay_pct)
FROM (SELECT * FROM {src} WHERE osrm_time > 0) d
JOIN (SELECT route_type, quantile_cont(actual_time, 0.99) AS cap
      FROM {src} WHERE osrm_time > 0 GROUP BY route_type) q
  ON d.route_type = q.route_type
"""
# the same with the quantiles of the training rows
CLEAN_BY_TRAINING = CLEAN.replace("WHERE osrm_time > 0 GROUP",
                                  "WHERE osrm_time > 0 AND data = 'training' GROUP")


def ctes(*pairs) -> str:
    """``WITH name AS MATERIALIZED (sql), ...`` from (name, sql) pairs."""
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in pairs) + "\n"


def base_ctes(grain: str = "coarse", clean: bool = False, corridor: bool = False) -> list:
    out = [("ship", shipments_sql(grain)), ("der", DERIVED.format(src="ship"))]
    src = "der"
    if clean:
        out.append(("cln", CLEAN.format(src="der")))
        src = "cln"
    if corridor:
        out.append(("corr", CORRIDOR.format(src=src)))
    return out


FACILITY = """
SELECT COALESCE(o.facility, i.facility) AS facility,
  COALESCE(o.outbound_trips, 0) AS outbound_trips,
  COALESCE(o.out_delay_ratio, 0) AS out_delay_ratio,
  COALESCE(o.out_sla_breach, 0) AS out_sla_breach,
  COALESCE(i.inbound_trips, 0) AS inbound_trips,
  COALESCE(i.in_delay_ratio, 0) AS in_delay_ratio,
  COALESCE(i.in_sla_breach, 0) AS in_sla_breach,
  COALESCE(o.outbound_trips, 0) + COALESCE(i.inbound_trips, 0) AS total_trips,
  (COALESCE(o.out_delay_ratio, 0) + COALESCE(i.in_delay_ratio, 0)) / 2 AS avg_delay_ratio,
  (COALESCE(o.out_sla_breach, 0) + COALESCE(i.in_sla_breach, 0)) / 2 AS avg_sla_breach
FROM (SELECT source_center AS facility, count(trip_uuid) AS outbound_trips,
             median(delay_ratio) AS out_delay_ratio,
             avg(CAST(is_sla_breach AS DOUBLE)) AS out_sla_breach
      FROM {src} GROUP BY source_center) o
FULL OUTER JOIN
     (SELECT destination_center AS facility, count(trip_uuid) AS inbound_trips,
             median(delay_ratio) AS in_delay_ratio,
             avg(CAST(is_sla_breach AS DOUBLE)) AS in_sla_breach
      FROM {src} GROUP BY destination_center) i
ON o.facility = i.facility
"""

EDGES = "SELECT source_center AS src, destination_center AS dst, CAST(trip_count AS DOUBLE) AS weight FROM {corr}"

NODES = "SELECT src AS facility FROM {e} UNION SELECT dst FROM {e}"

DEGREES = """
SELECT n.facility,
  COALESCE(i.c, 0) AS in_degree, COALESCE(o.c, 0) AS out_degree,
  COALESCE(i.c, 0) + COALESCE(o.c, 0) AS total_degree,
  COALESCE(i.w, 0.0) AS in_degree_w, COALESCE(o.w, 0.0) AS out_degree_w
FROM {nodes} n
LEFT JOIN (SELECT dst AS f, count(*) AS c, sum(weight) AS w FROM {e} GROUP BY dst) i ON n.facility = i.f
LEFT JOIN (SELECT src AS f, count(*) AS c, sum(weight) AS w FROM {e} GROUP BY src) o ON n.facility = o.f
"""


def ctes_rec(*pairs) -> str:
    """Like :func:`ctes` but allows recursive members (given as (name, sql, True))."""
    parts = []
    for p in pairs:
        if len(p) == 3 and p[2]:
            parts.append(f"{p[0]} AS ({p[1]})")
        else:
            parts.append(f"{p[0]} AS MATERIALIZED ({p[1]})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def pagerank_ctes(e: str = "e", nodes: str = "nodes", iters: int = 20,
                  alpha: float = 0.85, out: str = "pr") -> list:
    """Unrolled power iteration, same update as the Spark operator."""
    cs = [("pr_n", f"SELECT count(*) AS n FROM {nodes}"),
          ("pr_t", f"SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p "
                   f"FROM {e} WHERE weight <> 0"),
          ("pr_dg", f"SELECT facility FROM {nodes} WHERE facility NOT IN "
                    f"(SELECT src FROM pr_t)"),
          ("pr_0", f"SELECT facility, 1.0 / (SELECT n FROM pr_n) AS x FROM {nodes}")]
    for i in range(1, iters + 1):
        prev = f"pr_{i - 1}"
        cs.append((f"pr_{i}", f"""
SELECT n.facility, {alpha!r} * COALESCE(c.v, 0.0)
  + ({alpha!r} * (SELECT COALESCE(sum(x), 0.0) FROM {prev} WHERE facility IN (SELECT facility FROM pr_dg))
     + {1 - alpha!r}) / (SELECT n FROM pr_n) AS x
FROM {nodes} n LEFT JOIN (SELECT t.dst, sum(p.x * t.p) AS v FROM {prev} p
                          JOIN pr_t t ON p.facility = t.src GROUP BY t.dst) c
  ON n.facility = c.dst"""))
    cs.append((out, f"SELECT facility, x AS pagerank FROM pr_{iters}"))
    return cs


def hits_ctes(e: str = "e", nodes: str = "nodes", iters: int = 20, out: str = "hits") -> list:
    cs = [("h_e", f"SELECT src, dst, weight FROM {e} WHERE weight <> 0"),
          ("h_0", f"SELECT facility, 1.0 AS h, 0.0 AS a FROM {nodes}")]
    for i in range(1, iters + 1):
        prev = f"h_{i - 1}"
        cs.append((f"a_{i}", f"""
SELECT facility, a / sum(a) OVER () AS a FROM (
  SELECT t.dst AS facility, sum(p.h * t.weight) AS a FROM {prev} p JOIN h_e t ON p.facility = t.src
  GROUP BY t.dst)"""))
        cs.append((f"h_{i}", f"""
SELECT n.facility, COALESCE(hh.h, 0.0) AS h, COALESCE(aa.a, 0.0) AS a
FROM {nodes} n
LEFT JOIN (SELECT facility, h / sum(h) OVER () AS h FROM (
             SELECT t.src AS facility, sum(q.a * t.weight) AS h FROM a_{i} q
             JOIN h_e t ON q.facility = t.dst GROUP BY t.src)) hh ON n.facility = hh.facility
LEFT JOIN a_{i} aa ON n.facility = aa.facility"""))
    cs.append((out, f"SELECT facility, h AS hub_score, a AS authority_score FROM h_{iters}"))
    return cs


def apsp_ctes(e: str = "e", nodes: str = "nodes", rounds: int = 6, out: str = "dist") -> list:
    """Min-plus squaring: after r rounds every shortest path of up to 2^r hops."""
    cs = [("dist_0", f"""
SELECT s, t, min(d) AS d FROM (
  SELECT facility AS s, facility AS t, 0.0 AS d FROM {nodes}
  UNION ALL SELECT src, dst, weight FROM {e} WHERE src <> dst) GROUP BY s, t""")]
    for i in range(1, rounds + 1):
        p = f"dist_{i - 1}"
        cs.append((f"dist_{i}", f"""
SELECT a.s, b.t, min(a.d + b.d) AS d FROM {p} a JOIN {p} b ON a.t = b.s GROUP BY a.s, b.t"""))
    cs.append((out, f"SELECT * FROM dist_{rounds}"))
    return cs


def closeness_sql(dist: str = "dist", nodes: str = "nodes") -> str:
    return f"""
SELECT n.facility, COALESCE(CASE WHEN c.tot > 0 AND (SELECT count(*) FROM {nodes}) > 1
    THEN (c.r / c.tot) * (c.r / ((SELECT count(*) FROM {nodes}) - 1)) END, 0.0) AS closeness
FROM {nodes} n LEFT JOIN (SELECT t, count(*) AS r, sum(d) AS tot FROM {dist}
                          WHERE s <> t GROUP BY t) c ON n.facility = c.t"""


def betweenness_ctes(e: str = "e", nodes: str = "nodes", dist: str = "dist",
                     out: str = "btw") -> list:
    """Path counts by enumerating shortest paths over tight edges (recursive),
    then pair dependencies σ(s,v)σ(v,t)/σ(s,t) summed per v."""
    return [
        ("b_tight", f"""
SELECT dv.s, x.src AS v, x.dst AS w FROM {dist} dv
JOIN {e} x ON dv.t = x.src AND x.src <> x.dst
JOIN {dist} dw ON dw.s = dv.s AND dw.t = x.dst
WHERE dv.d + x.weight = dw.d"""),
        ("b_paths", f"""
SELECT facility AS s, facility AS w FROM {nodes}
UNION ALL SELECT p.s, t.w FROM b_paths p JOIN b_tight t ON p.s = t.s AND p.w = t.v""", True),
        ("b_sigma", "SELECT s, w AS t, CAST(count(*) AS DOUBLE) AS sigma FROM b_paths GROUP BY s, w"),
        (out, f"""
SELECT n.facility, COALESCE(b.bc, 0.0) / (((SELECT count(*) FROM {nodes}) - 1.0)
                                       * ((SELECT count(*) FROM {nodes}) - 2.0)) AS betweenness
FROM {nodes} n LEFT JOIN (
  SELECT sv.t AS facility, sum(sv.sigma * vt.sigma / st.sigma) AS bc
  FROM b_sigma sv
  JOIN b_sigma vt ON vt.s = sv.t
  JOIN b_sigma st ON st.s = sv.s AND st.t = vt.t
  JOIN {dist} d1 ON d1.s = sv.s AND d1.t = sv.t
  JOIN {dist} d2 ON d2.s = sv.t AND d2.t = vt.t
  JOIN {dist} d3 ON d3.s = sv.s AND d3.t = vt.t
  WHERE sv.s <> sv.t AND vt.t <> sv.t AND sv.s <> vt.t AND d1.d + d2.d = d3.d
  GROUP BY sv.t) b ON n.facility = b.facility"""),
    ]


def centrality_ctes(e: str = "e", nodes: str = "nodes", iters: int = 20) -> list:
    """All node centralities as one CTE ``cent`` (GRF16)."""
    return (pagerank_ctes(e, nodes, iters) + hits_ctes(e, nodes, iters) + apsp_ctes(e, nodes)
            + betweenness_ctes(e, nodes)
            + [("deg", DEGREES.format(nodes=nodes, e=e)),
               ("clo", closeness_sql("dist", nodes)),
               ("cent", """
SELECT d.facility, d.in_degree, d.out_degree, d.total_degree, d.in_degree_w, d.out_degree_w,
  b.betweenness, p.pagerank, c.closeness, h.hub_score, h.authority_score
FROM deg d JOIN btw b USING (facility) JOIN pr p USING (facility) JOIN clo c USING (facility)
JOIN hits h USING (facility)""")])


REGION_COMMUNITY = """
SELECT 'NAT' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS facility,
       CAST(n_regionkey AS BIGINT) AS community_id FROM nation"""

NODE_FEATURES = """
SELECT c.*, COALESCE(g.community_id, -1) AS community_id,
  COALESCE(f.outbound_trips, 0) AS outbound_trips, COALESCE(f.out_delay_ratio, 0) AS out_delay_ratio,
  COALESCE(f.out_sla_breach, 0) AS out_sla_breach, COALESCE(f.inbound_trips, 0) AS inbound_trips,
  COALESCE(f.in_delay_ratio, 0) AS in_delay_ratio, COALESCE(f.in_sla_breach, 0) AS in_sla_breach,
  COALESCE(f.total_trips, 0) AS total_trips, COALESCE(f.avg_delay_ratio, 0) AS avg_delay_ratio,
  COALESCE(f.avg_sla_breach, 0) AS avg_sla_breach
FROM cent c LEFT JOIN fac f USING (facility) LEFT JOIN comm g USING (facility)"""

RISK = """
SELECT n.*, nb AS norm_betweenness, ns AS norm_sla_breach, nd AS norm_delay,
  nt AS norm_throughput, np AS norm_pagerank,
  0.3 * nb + 0.25 * ns + 0.2 * nd + 0.15 * nt + 0.1 * np AS structural_risk_score
FROM nf n, LATERAL (SELECT
  (n.betweenness - m.b0) / (m.b1 - m.b0 + 1e-10) AS nb,
  (n.avg_sla_breach - m.s0) / (m.s1 - m.s0 + 1e-10) AS ns,
  (n.avg_delay_ratio - m.d0) / (m.d1 - m.d0 + 1e-10) AS nd,
  (n.total_trips - m.t0) / (m.t1 - m.t0 + 1e-10) AS nt,
  (n.pagerank - m.p0) / (m.p1 - m.p0 + 1e-10) AS np
  FROM (SELECT min(betweenness) b0, max(betweenness) b1, min(avg_sla_breach) s0,
               max(avg_sla_breach) s1, min(avg_delay_ratio) d0, max(avg_delay_ratio) d1,
               min(total_trips) t0, max(total_trips) t1, min(pagerank) p0, max(pagerank) p1
        FROM nf) m)"""


def feature_store_sql(src: str = "cln", nodes: str = "risk", corr: str = "enr",
                      stats: str | None = None) -> str:
    """FEA10 in SQL: same formulas as ``operators.features.feature_store``;
    ``stats`` ('training') limits the rows that statistics are taken from."""
    known = f" AND data = '{stats}'" if stats else ""
    from ..operators.features import ALL_FEATURES, CORRIDOR_LOOKUP, NODE_LOOKUP
    node_cols = ",\n  ".join(
        f"COALESCE(CAST(s.{c} AS DOUBLE), (SELECT median({c}) FROM {nodes})) AS src_{c},\n  "
        f"COALESCE(CAST(d.{c} AS DOUBLE), (SELECT median({c}) FROM {nodes})) AS dst_{c}"
        for c in NODE_LOOKUP)
    corr_cols = ",\n  ".join(
        f"COALESCE(CAST(r.{c} AS DOUBLE), (SELECT median({c}) FROM {corr})) AS corr_{c}"
        for c in CORRIDOR_LOOKUP)
    final = ",\n  ".join(f"COALESCE(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in ALL_FEATURES)
    return f"""
WITH hv AS (SELECT hour, count(trip_uuid) AS n FROM {src} WHERE hour IS NOT NULL{known} GROUP BY hour),
f0 AS (
SELECT c.trip_uuid, c.data, c.route_type, c.source_center, c.destination_center, c.actual_time,
  c.hour, c.dow, c.month, c.is_weekend, c.is_rush_hour,
  COALESCE(c.cutoff_factor, (SELECT median(cutoff_factor) FROM {src} WHERE true{known})) AS cutoff_factor,
  CAST(c.route_type = 'FTL' AS BIGINT) AS route_type_enc,
  ln(1 + c.osrm_time) AS log_osrm_time, ln(1 + c.osrm_distance) AS log_osrm_dist,
  ln(1 + c.actual_distance_to_destination) AS log_distance,
  c.osrm_distance / (c.osrm_time / 60 + 1e-5) AS osrm_speed,
  c.actual_distance_to_destination / (c.osrm_time + 1) AS dist_time_ratio,
  sin(2 * pi() * c.hour / 24) AS hour_sin, cos(2 * pi() * c.hour / 24) AS hour_cos,
  sin(2 * pi() * c.dow / 7) AS dow_sin, cos(2 * pi() * c.dow / 7) AS dow_cos,
  sin(2 * pi() * c.month / 12) AS month_sin, cos(2 * pi() * c.month / 12) AS month_cos,
  COALESCE(hv.n, 0) / (SELECT max(n) FROM hv) AS network_load_norm,
  {node_cols},
  {corr_cols}
FROM {src} c
LEFT JOIN {nodes} s ON c.source_center = s.facility
LEFT JOIN {nodes} d ON c.destination_center = d.facility
LEFT JOIN {corr} r ON c.source_center = r.source_center AND c.destination_center = r.destination_center
LEFT JOIN hv ON c.hour = hv.hour),
f1 AS (
SELECT *, CAST(trunc(COALESCE(corr_cross_community, 0.0)) AS BIGINT) AS cross_community_flag,
  CAST(COALESCE(src_structural_risk_score > (SELECT quantile_cont(src_structural_risk_score, 0.75) FROM f0 WHERE true{known}), false) AS BIGINT) AS high_risk_src,
  CAST(COALESCE(dst_structural_risk_score > (SELECT quantile_cont(src_structural_risk_score, 0.75) FROM f0 WHERE true{known}), false) AS BIGINT) AS high_risk_dst
FROM f0)
SELECT trip_uuid, data, route_type, source_center, destination_center, actual_time,
  {final.replace("COALESCE(CAST(both_high_risk AS DOUBLE), 0.0)", "CAST(high_risk_src * high_risk_dst AS DOUBLE)")}
FROM f1"""
