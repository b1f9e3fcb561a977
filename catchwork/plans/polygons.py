"""Polygons with holes, islands and crossing rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwork.operators import polygons as op
from catchwork.operators.grid import ring_area
from catchwork.plans.registry import query

BAND = 2.0  # of y, in which points meet edges

EDGES = "e AS (SELECT a.feature, a.ring_no, a.i, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v_vertex a JOIN v_vertex b ON b.feature = a.feature AND b.ring_no = a.ring_no AND b.i = a.i + 1)"
CROSSED = "(e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1"
NESTED = f"""{EDGES},
size AS (SELECT feature, ring_no, abs(sum(x1 * y2 - x2 * y1)) / 2 AS size, sum(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) AS perimeter,
                sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS x, sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS y FROM e WHERE feature % 7 <> 6 GROUP BY ALL),
around AS (SELECT p.feature, p.ring_no, e.ring_no AS other FROM v_vertex p JOIN e ON e.feature = p.feature AND e.ring_no <> p.ring_no AND p.i = 0 AND {CROSSED} GROUP BY ALL HAVING count(*) % 2 = 1),
above AS (SELECT a.feature, a.ring_no, count(*) AS depth, arg_min(a.other, s.size) AS parent FROM around a JOIN size s ON s.feature = a.feature AND s.ring_no = a.other GROUP BY ALL),
n AS (SELECT s.*, coalesce(depth, 0) AS depth, coalesce(depth, 0) % 2 = 1 AS hole, parent FROM size s LEFT JOIN above a USING (feature, ring_no))"""


def _nested(vertices: DataFrame) -> DataFrame:
    """Rings that do not cross themselves, with their depth."""
    return op.nested(op.rings_of(vertices.where("feature % 7 <> 6")), BAND)


@query("g02_nested_rings", "v_vertex", sql=f"WITH {NESTED} SELECT feature, ring_no, depth, hole, parent FROM n")
def nested_rings(vertices: DataFrame) -> DataFrame:
    """How deep each ring of a feature lies in the others, and whether it is a hole."""
    return _nested(vertices).select("feature", "ring_no", "depth", "hole", "parent")


@query("g02_hole_measures", "v_vertex", sql=f"""WITH {NESTED}, t AS (SELECT *, CASE WHEN hole THEN -size ELSE size END AS net FROM n)
SELECT feature, round(sum(net), 4) AS area, round(coalesce(sum(size) FILTER (WHERE hole), 0), 4) AS hole_area, round(sum(perimeter), 4) AS perimeter, round(sum(net * x) / sum(net), 4) AS cx, round(sum(net * y) / sum(net), 4) AS cy,
       count(*) FILTER (WHERE NOT hole) AS n_shells, count(*) FILTER (WHERE hole) AS n_holes FROM t GROUP BY 1""")
def hole_measures(vertices: DataFrame) -> DataFrame:
    x = op.measures(_nested(vertices))
    return x.select("feature", *(F.round(c, 4).alias(c) for c in ("area", "hole_area", "perimeter")), F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), "n_shells", "n_holes")


@query("g12_largest_parts", "v_vertex", sql=f"""WITH {NESTED}, p AS (SELECT feature, CASE WHEN hole THEN parent ELSE ring_no END AS part, sum(CASE WHEN hole THEN -size ELSE size END) AS area FROM n GROUP BY ALL)
SELECT feature, part, round(area, 4) AS area FROM p QUALIFY row_number() OVER (PARTITION BY feature ORDER BY area DESC, part) = 1""")
def largest_parts(vertices: DataFrame) -> DataFrame:
    """The part of a feature that stays where one ring is wanted."""
    return op.largest_parts(_nested(vertices)).withColumn("area", F.round("area", 4))


@query("u07_holes_and_shells", "v_vertex", sql=f"WITH {NESTED} SELECT feature FROM n GROUP BY 1 HAVING coalesce(sum(size) FILTER (WHERE hole), 0) <= 0.5 * sum(size) FILTER (WHERE NOT hole)")
def remainders(vertices: DataFrame) -> DataFrame:
    """Features whose holes take over half of their shells are remainders and go."""
    return op.without_remainders(_nested(vertices))


@query("g03_points_in_holed", "v_spot", "v_vertex", sql=f"WITH {EDGES} SELECT p.point_key, e.feature FROM v_spot p JOIN e ON {CROSSED} GROUP BY ALL HAVING count(*) % 2 = 1")
def points_inside(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """Points inside a feature: not in a hole, but on an island in one."""
    return op.points_inside(points, op.rings_of(vertices), BAND)


@query("g04_even_odd_pixels", "v_vertex", sql=f"""WITH {EDGES}, box AS (SELECT feature, CAST(floor(min(x)) AS BIGINT) AS a, CAST(floor(max(x)) AS BIGINT) AS z, CAST(floor(min(y)) AS BIGINT) AS b, CAST(floor(max(y)) AS BIGINT) AS c FROM v_vertex GROUP BY 1),
col AS (SELECT feature, b, c, unnest(range(a, z + 1)) AS ix FROM box), p AS (SELECT feature, ix, iy, ix + 0.5::DOUBLE AS x, iy + 0.5::DOUBLE AS y FROM (SELECT feature, ix, unnest(range(b, c + 1)) AS iy FROM col))
SELECT p.feature, p.ix, p.iy FROM p JOIN e ON e.feature = p.feature AND {CROSSED} GROUP BY ALL HAVING count(*) % 2 = 1""")
def pixels(vertices: DataFrame) -> DataFrame:
    """Pixels whose centre a feature covers; holes stay open, and rings that cross themselves are filled even-odd."""
    return op.filled(op.rings_of(vertices), 1.0)


@query("g22_crossing_edges", "v_vertex", sql=f"""WITH {EDGES}, s AS (SELECT p.feature, sign((q.x2 - q.x1) * (p.y1 - q.y1) - (q.y2 - q.y1) * (p.x1 - q.x1)) * sign((q.x2 - q.x1) * (p.y2 - q.y1) - (q.y2 - q.y1) * (p.x2 - q.x1)) AS a,
sign((p.x2 - p.x1) * (q.y1 - p.y1) - (p.y2 - p.y1) * (q.x1 - p.x1)) * sign((p.x2 - p.x1) * (q.y2 - p.y1) - (p.y2 - p.y1) * (q.x2 - p.x1)) AS b
FROM e p JOIN e q ON q.feature = p.feature AND (p.ring_no, p.i) < (q.ring_no, q.i))
SELECT feature, count(*) AS n_crossings FROM s WHERE a < 0 AND b < 0 GROUP BY 1""")
def crossings(vertices: DataFrame) -> DataFrame:
    """Features with edges that cross, within a ring or between two."""
    return op.crossing_pairs(op.rings_of(vertices), 4.0)


SCOPE = """l AS (SELECT p_partkey % 25 AS city_key, CASE WHEN p_partkey % 2 = 0 THEN 'storm' ELSE 'sanitary' END AS system, p_partkey AS layer_id, x, y, CASE WHEN p_partkey % 25 <> 4 THEN x + p_size * 4 END AS x2, y + p_size * 3 AS y2 FROM (SELECT *, p_partkey * 7 % 500::DOUBLE AS x, p_partkey * 3 % 400::DOUBLE AS y FROM part) WHERE p_partkey % 6 IN (0, 1)),
an AS (SELECT o_orderkey % 25 AS city_key, CASE WHEN o_custkey % 2 = 0 THEN 'storm' ELSE 'sanitary' END AS system, o_custkey * 37 % 6400 / 10::DOUBLE AS x, o_orderkey * 13 % 8000 / 16::DOUBLE AS y FROM orders)"""


@query("a30_scoped_anchors", "part", "orders", sql=f"""WITH {SCOPE}, b AS (SELECT * FROM l WHERE x2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY city_key, system ORDER BY (x2 - x) * (y2 - y) DESC, layer_id) = 1)
SELECT an.city_key, an.system, count(*) AS n_city_wide, count(*) FILTER (WHERE b.x IS NULL OR (an.x BETWEEN b.x AND b.x2 AND an.y BETWEEN b.y AND b.y2)) AS n_features, bool_or(b.x IS NOT NULL) AS scoped
FROM an LEFT JOIN b USING (city_key, system) GROUP BY ALL""")
def scoped_anchors(part: DataFrame, orders: DataFrame) -> DataFrame:
    """Anchors of each city's system within the largest extent of its area layers, and city-wide where no layer states one."""
    key, side = F.col("p_partkey"), lambda c: F.when(c % 2 == 0, "storm").otherwise("sanitary")
    x, y = (key * 7 % 500).cast("double"), (key * 3 % 400).cast("double")
    layers = part.where("p_partkey % 6 in (0, 1)").select((key % 25).alias("city_key"), side(key).alias("system"), key.alias("layer_id"), x.alias("x1"), y.alias("y1"), F.when(key % 25 != 4, x + F.col("p_size") * 4).alias("x2"), (y + F.col("p_size") * 3).alias("y2"))
    anchors = orders.select((F.col("o_orderkey") % 25).alias("city_key"), side(F.col("o_custkey")).alias("system"), (F.col("o_custkey") * 37 % 6400 / 10).alias("x"), (F.col("o_orderkey") * 13 % 8000 / 16).alias("y"))
    return op.scoped_counts(layers, anchors)


FRAMES = "CASE feature % 29 WHEN 3 THEN 'urn:ogc:def:crs:EPSG::3857' WHEN 4 THEN 'urn:ogc:def:crs:OGC:1.3:CRS84' WHEN 5 THEN 'EPSG:4326' END"


@query("g21_dissolved_areas", "v_vertex", sql=f"""WITH {EDGES}, box AS (SELECT feature, CAST(floor(min(x)) AS BIGINT) AS a, CAST(floor(max(x)) AS BIGINT) AS z, CAST(floor(min(y)) AS BIGINT) AS b, CAST(floor(max(y)) AS BIGINT) AS c FROM v_vertex GROUP BY 1),
col AS (SELECT feature, b, c, unnest(range(a, z + 1)) AS ix FROM box), p AS (SELECT feature, ix, iy, ix + 0.5::DOUBLE AS x, iy + 0.5::DOUBLE AS y FROM (SELECT feature, ix, unnest(range(b, c + 1)) AS iy FROM col)),
inn AS (SELECT p.feature, p.ix, p.iy FROM p JOIN e ON e.feature = p.feature AND {CROSSED} GROUP BY ALL HAVING count(*) % 2 = 1),
ar AS (SELECT feature // 3 AS area_id, max({FRAMES}) AS frame, round(min(x), 6) AS west, round(min(y), 6) AS south, round(max(x), 6) AS east, round(max(y), 6) AS north FROM v_vertex GROUP BY 1),
n AS (SELECT feature // 3 AS area_id, count(DISTINCT (ix, iy)) AS area FROM inn GROUP BY 1)
SELECT CAST(area_id AS BIGINT) AS area_id, coalesce(area, 0)::DOUBLE AS area, west, south, east, north, CASE WHEN frame LIKE '%3857%' THEN 'unsupported_frame' WHEN coalesce(area, 0) = 0 THEN 'no_area' WHEN area > 250 THEN 'too_large' ELSE 'ok' END AS verdict FROM ar LEFT JOIN n USING (area_id)""")
def dissolved_areas(vertices: DataFrame) -> DataFrame:
    """Areas of up to three features each: dissolved area, box, and the first thing wrong."""
    of = F.floor(F.col("feature") / 3).alias("area_id")
    rest = F.col("feature") % 29
    frame = F.when(rest == 3, "urn:ogc:def:crs:EPSG::3857").when(rest == 4, "urn:ogc:def:crs:OGC:1.3:CRS84").when(rest == 5, "EPSG:4326")
    areas = vertices.groupBy(of).agg(F.max(frame).alias("frame"))
    return op.area_checks(areas, op.rings_of(vertices).withColumn("area_id", of), 1.0, 250.0)


@query("g21_ring_order", "v_vertex", sql=f"WITH {NESTED} SELECT n.feature, n.ring_no, CASE WHEN hole THEN -1 ELSE 1 END AS turn FROM n")
def ring_order(vertices: DataFrame) -> DataFrame:
    """Which way each ring runs in canonical order."""
    x = op.oriented_rings(_nested(vertices))
    return x.select("feature", "ring_no", F.signum(ring_area(F.col("ring"))).cast("int").alias("turn"))
