"""Stand-in views: drainage tables derived from the given ones, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {}

VIEWS["v_node"] = """
SELECT CAST(s_nationkey % 5 AS BIGINT) AS aoi_id, s_suppkey AS node_key,
       concat('MH', CAST(s_suppkey AS STRING)) AS node,
       -1234e-1 + (s_suppkey % 10) * 1e-3 AS lon,
       484e-1 + floor(s_suppkey / 10) * 1e-3 AS lat,
       round(20 + abs(s_acctbal) / 100, 4) AS rim_m
FROM supplier
"""

VIEWS["v_raw_pipe"] = """
WITH l AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS up_key, max(l_partkey) AS pk,
                  min(l_extendedprice) AS ep, min(l_discount) AS disc, max(l_tax) AS tax,
                  min(l_quantity) AS q, min(l_returnflag) AS rf, min(l_linestatus) AS ls
           FROM lineitem GROUP BY l_orderkey, l_linenumber),
     n AS (SELECT count(*) AS k FROM supplier)
SELECT l_orderkey * 10 + l_linenumber AS file_seq,
       concat('P', CAST(l_orderkey AS STRING)) AS name,
       up_key, pk % n.k AS dn_key,
       CASE WHEN disc = 0 THEN 0e0 ELSE round(ep / 1000, 5) END AS inv_up,
       CASE WHEN tax = 0 THEN -99e0 ELSE round(ep / 1000 - 5e-1, 5) END AS inv_dn,
       CAST(CAST(q * 20 AS BIGINT) AS STRING) AS diameter_mm,
       CASE rf WHEN 'A' THEN 'PVC' WHEN 'N' THEN 'Reinforced Concrete' ELSE 'unknown' END AS material,
       CASE ls WHEN 'O' THEN 'Storm' ELSE 'Combined' END AS content
FROM l CROSS JOIN n
"""

# Pipes of many small networks, one for each order; published levels, rims and terrain are missing for some nodes.
VIEWS["v_reach"] = """
SELECT l_orderkey * 10 + l_linenumber AS file_seq, concat('R', CAST(l_orderkey * 10 + l_linenumber AS STRING)) AS name,
       l_orderkey * 10 + l_linenumber AS up_key, l_orderkey * 10 + l_linenumber - 1 AS dn_key,
       CASE WHEN min(l_discount) < 8e-2 THEN 0e0 ELSE round(min(l_extendedprice) / 1000, 5) END AS inv_up,
       CASE WHEN min(l_tax) < 7e-2 THEN -99e0 ELSE round(min(l_extendedprice) / 1000 - 5e-1, 5) END AS inv_dn,
       CASE WHEN min(l_quantity) > 40 THEN round(min(l_extendedprice) / 1000 + 3, 5) END AS rim_m,
       CASE WHEN min(l_quantity) > 20 THEN round(min(l_extendedprice) / 1000 + 28e-1, 5) END AS dem_m
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""

VIEWS["v_obs_hourly"] = """
SELECT concat('ST', CAST(user_id % 5 AS STRING)) AS climate_id, event_id AS file_seq,
       date_trunc('hour', ts) AS ts,
       CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE round(value / 100, 4) END AS precip_raw,
       CASE WHEN event_type = 'signup' THEN 'T' END AS flag
FROM events
"""

VIEWS["v_flow_obs"] = """
SELECT CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice) / 1000, 6) AS obs_cms FROM orders GROUP BY 1
"""

VIEWS["v_flow_sim"] = """
SELECT CAST(l_shipdate AS DATE) AS day, round(avg(l_extendedprice) / 100, 6) AS sim_cms FROM lineitem GROUP BY 1
"""

VIEWS["v_symbol"] = """
SELECT p_partkey AS symbol_key, CASE p_size % 8 WHEN 0 THEN 'MANHOLE' WHEN 1 THEN 'CB/MH' WHEN 2 THEN 'MANHOLE, DUMMY' WHEN 3 THEN 'SETTLING CHAMBER'
       WHEN 4 THEN 'CATCHBASIN' WHEN 5 THEN 'LAWN BASIN' WHEN 6 THEN 'VALVE' END AS symbol_type
FROM part
"""

VIEWS["v_gauge"] = """
SELECT o_custkey % 40 AS station_key, -124.95e0 + (o_custkey % 40) * 1e0 AS lon, 44.05e0 + (o_custkey % 40) % 8 AS lat, CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice) / 1000, 6) AS obs_cms
FROM orders GROUP BY o_custkey % 40, CAST(o_orderdate AS DATE)
"""

VIEWS["v_px"] = """
SELECT CAST(floor(o_orderkey / 2500) AS BIGINT) AS aoi_id,
       o_orderkey % 50 AS ix, CAST(floor((o_orderkey % 2500) / 50) AS BIGINT) AS iy,
       round(50 + o_totalprice / 100000, 7) AS z_m,
       1 + o_custkey % 19 AS landcover, 1 + o_custkey % 4 AS hsg_code
FROM orders
"""

VIEWS["v_catchment"] = """
SELECT p_partkey AS cell_key, concat('S_', CAST(p_partkey AS STRING)) AS name,
       p_partkey % n.k AS outlet_key, p_size / 10e0 AS area_ha,
       round(p_retailprice % 100, 2) AS pct_imperv
FROM part CROSS JOIN (SELECT count(*) AS k FROM supplier) n
"""

VIEWS["v_service_area"] = """
SELECT concat('SSA_', CAST(c_custkey AS STRING)) AS name, CAST(c_nationkey AS BIGINT) AS node_key,
       round(abs(c_acctbal) / 1000, 5) AS area_ha,
       CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(c_custkey % 500 AS DOUBLE) END AS population,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN c_custkey % 40 END AS dwelling_units
FROM customer
"""

VIEWS["v_layer"] = """
SELECT CAST(p_partkey % 25 AS BIGINT) AS city_key, p_partkey AS layer_id,
       CASE p_partkey % 3 WHEN 0 THEN 'OpenData_StormDrain' WHEN 1 THEN 'Sewer_External' ELSE 'Utilities' END AS service_name,
       CASE p_partkey % 8 WHEN 0 THEN 'Storm Catch Basins' WHEN 1 THEN 'SanitaryGravityMain'
            WHEN 2 THEN 'Combined Sewer Catchment Areas' WHEN 3 THEN 'StormPipe' WHEN 4 THEN 'Water Mains'
            WHEN 5 THEN 'Flow Arrows - Gravity Mains' WHEN 6 THEN 'Sewer SubCatchment Areas' ELSE p_name END AS layer_name,
       CASE WHEN p_partkey % 8 IN (2, 6) THEN 'esriGeometryPolygon' WHEN p_partkey % 8 = 0 THEN 'esriGeometryPoint'
            ELSE 'esriGeometryPolyline' END AS geometry_type,
       p_size AS n_features
FROM part
"""

VIEWS["v_idf"] = """
SELECT s_suppkey AS station_key, -125e0 + (s_suppkey % 25) * 25e-1 + s_suppkey * 1e-5 AS lon, 44e0 + (s_suppkey % 10) + s_suppkey * 1e-5 AS lat,
       d.duration_min, round((20 + s_suppkey % 25) * pow(d.duration_min / 60e0, -65e-2), 6) AS mm_h
FROM supplier CROSS JOIN (VALUES (5),(10),(15),(30),(60),(120),(360),(720),(1440)) AS d(duration_min)
"""

# Stations of an index with their names and provinces.
VIEWS["v_station"] = """
SELECT s_suppkey AS station_key, s_name AS name, n_name AS province, -125e0 + (s_suppkey % 25) * 25e-1 + s_suppkey * 1e-5 AS lon, 44e0 + (s_suppkey % 10) + s_suppkey * 1e-5 AS lat
FROM supplier JOIN nation ON n_nationkey = s_nationkey
"""

# Lots: ring number, side and a key for the cases that rings must cover.
VIEWS["v_lot"] = "SELECT p_partkey AS n_nationkey FROM part"

# Cells of all shapes: every 97th is far larger than its area's median, every 89th far smaller.
VIEWS["v_cell_shape"] = """
SELECT p_partkey AS cell_key, p_partkey % 5 AS aoi_id, round(p_retailprice % 100, 2) / 10 AS thinness,
       CASE WHEN p_partkey % 97 = 0 THEN p_size * 10e0 + 50 WHEN p_partkey % 89 = 0 THEN p_size * 1e-3 ELSE p_size / 10e0 + 1 END AS area_ha
FROM part
"""

VIEWS["v_tree"] = """
SELECT concat('C', CAST(p_partkey AS STRING)) AS name, p_partkey AS from_key,
       CAST(floor(p_partkey / 3) AS BIGINT) AS to_key, p_size * 10e0 AS length_m,
       200e0 + floor(p_partkey / 3) * 1e-2 AS inv_to, 200e0 + p_partkey * 1e-2 AS inv_from,
       CASE WHEN p_partkey % 5 = 0 THEN 'sanitary' ELSE 'storm_minor' END AS system
FROM part WHERE p_partkey > 2 AND p_partkey % 17 <> 0
"""

# The tree with second conduits, and pairs of nodes that lead only to each other.
VIEWS["v_web"] = """
SELECT p_partkey AS from_key, CAST(floor(p_partkey / 3) AS BIGINT) AS to_key FROM part WHERE p_partkey > 2 AND p_partkey % 17 <> 0
UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 2) AS BIGINT) FROM part WHERE p_partkey > 2 AND p_partkey % 17 <> 0 AND p_partkey % 4 = 0
UNION ALL SELECT p_partkey, p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 17 ELSE -17 END FROM part WHERE p_partkey % 17 = 0
"""

# Vertices of features of 3 to 7 corners: every third has a hole, every ninth an island in it, every eleventh is nearly all hole, every seventh crosses itself; even ones run clockwise.
VIEWS["v_vertex"] = """
SELECT p_partkey AS feature, ring_no, j AS i,
       round(p_partkey % 40 * 16 + scale * (5 + (p_partkey * 7 + n * 5) % 9 / 3e0) * cos(2 * pi() * n / m), 6) AS x,
       round(floor(p_partkey / 40) * 16 + scale * (5 + (p_partkey * 7 + n * 5) % 9 / 3e0) * sin(2 * pi() * n / m), 6) AS y
FROM (SELECT p_partkey, ring_no, j, m, CASE ring_no WHEN 0 THEN 1e0 WHEN 1 THEN CASE WHEN p_partkey % 11 = 0 THEN 8e-1 ELSE 3e-1 END ELSE 1e-1 END AS scale,
             CASE WHEN p_partkey % 7 = 6 THEN CASE j % 4 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE j % 4 END WHEN p_partkey % 2 = 0 THEN (m - j) % m ELSE j % m END AS n
      FROM (SELECT p_partkey, ring_no, j, CASE WHEN p_partkey % 7 = 6 THEN 4 ELSE 3 + p_partkey % 5 END AS m
            FROM part CROSS JOIN (VALUES (0),(1),(2)) AS r(ring_no) CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7)) AS c(j)) a
      WHERE j <= m AND (ring_no = 0 OR (p_partkey % 7 <> 6 AND ((ring_no = 1 AND (p_partkey % 3 = 0 OR p_partkey % 11 = 0)) OR (ring_no = 2 AND p_partkey % 9 = 0))))) b
"""

# Points over the features' ground.
VIEWS["v_spot"] = """
SELECT o_orderkey AS point_key, round(o_custkey * 37 % 6400 / 1e1 + o_orderkey % 7 * 1e-3, 4) AS x, round(o_orderkey * 13 % 8000 / 1e1 + o_custkey % 11 * 1e-3, 4) AS y FROM orders
"""

# Ragged cells of pixels, some in more than one piece, over official basins that end at a line.
VIEWS["v_offer"] = """
SELECT CAST(floor(o_orderkey / 2500) AS BIGINT) AS aoi_id, o_orderkey % 50 AS ix, CAST(floor((o_orderkey % 2500) / 50) AS BIGINT) AS iy,
       CAST(floor((o_orderkey % 50 + floor((o_orderkey % 2500) / 50) * 3 % 4) / 9) + 10 * floor((floor((o_orderkey % 2500) / 50) + o_orderkey % 50 * 2 % 3) / 8) AS BIGINT) AS cell,
       CASE WHEN floor((o_orderkey % 2500) / 50) < 44 THEN CAST(floor((o_orderkey % 50 + floor((o_orderkey % 2500) / 50) % 11 + floor(o_orderkey / 2500) * 3) / 17) + 10 * floor(floor((o_orderkey % 2500) / 50) / 21) AS BIGINT) END AS basin
FROM orders
"""

# Catchments with every fault that a check looks for.
VIEWS["v_checked"] = """
SELECT CAST(p_partkey % 5 AS BIGINT) AS aoi_id, CASE WHEN p_partkey % 53 <> 0 THEN concat('S_', CAST(p_partkey - CASE WHEN p_partkey % 60 = 0 THEN 5 ELSE 0 END AS STRING)) END AS name,
       CASE WHEN p_partkey % 31 <> 0 THEN p_partkey % 12 + CASE WHEN p_partkey % 37 = 0 THEN 1000000 ELSE 0 END END AS outlet_key,
       CASE WHEN p_partkey % 41 = 0 THEN 0e0 WHEN p_partkey % 83 = 0 THEN NULL ELSE p_size / 1e1 END AS area_ha, p_partkey % 43 <> 0 AS has_polygon,
       CASE WHEN p_partkey % 47 = 0 THEN CAST('NaN' AS DOUBLE) WHEN p_partkey % 97 <> 0 THEN round(p_retailprice % 100, 2) END AS pct_imperv
FROM part
"""


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in view, or a given table, of one data folder."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", VIEWS[name])}
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", VIEWS[name])
    return spark.sql(text, **used)


def with_views(sql: str) -> str:
    """sql with the views that it names as common table expressions."""
    used = [f"{name} AS ({text.strip()})" for name, text in VIEWS.items() if re.search(rf"\b{name}\b", sql)]
    if not used:
        return sql
    body = sql.strip()
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if head:
        return f"WITH {head[1] or ''}" + ", ".join(used) + ", " + body[head.end() :]
    return "WITH " + ", ".join(used) + " " + body
