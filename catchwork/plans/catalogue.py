"""Queries over layer catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwork import constants as k
from catchwork.operators import catalogue as op
from catchwork.plans.registry import query


def _sp(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"


LOW = f"lower({_sp('layer_name')})"


def _q(p: str) -> str:
    return p.replace("'", "''")


ROLE = f"CASE WHEN regexp_matches({LOW}, '{_q(k.DERIVATIVE)}') OR regexp_matches({LOW}, '{_q(k.NOT_DRAINAGE)}') OR regexp_matches({LOW}, '{_q(k.PRESSURISED)}') OR regexp_matches({LOW}, '{_q(k.DRAFT)}') THEN NULL " + " ".join(f"WHEN regexp_matches({LOW}, '{_q(p)}') THEN '{r}'" for p, r in k.ROLE_PATTERNS) + " END"
ONE = "CASE WHEN regexp_matches({0}, 'combined') THEN 'combined' WHEN regexp_matches({0}, '" + _q(k.SANITARY) + "') THEN 'sanitary' WHEN regexp_matches({0}, '" + _q(k.STORM) + "') THEN 'storm' END"
SYSTEM = f"coalesce({ONE.format(LOW)}, {ONE.format('lower(' + _sp('service_name') + ')')})"
RULES = " ".join(f"WHEN '{r}' THEN geometry_type IN ({', '.join(repr(g) for g in kinds)})" for r, kinds in k.EXPECTED_GEOMETRY.items())
CLASS = f"g AS (SELECT *, {ROLE} AS guess, {SYSTEM} AS system FROM v_layer), c AS (SELECT *, coalesce(CASE guess {RULES} END, true) AS fits FROM g), r AS (SELECT *, CASE WHEN fits THEN guess END AS role FROM c)"
COUNTS = CLASS + ", n AS (SELECT city_key, system, role, sum(n_features)::BIGINT AS n FROM r WHERE role IS NOT NULL AND system IS NOT NULL AND n_features > 0 GROUP BY ALL)"
RANKED = "list_position(CASE system WHEN 'storm' THEN ['catch_basin', 'inlet', 'manhole'] WHEN 'combined' THEN ['catch_basin', 'inlet', 'gravity_main', 'manhole'] ELSE ['gravity_main', 'manhole'] END, role)"
ANCHOR = COUNTS + f", ra AS (SELECT *, {RANKED} AS rank FROM n), an AS (SELECT city_key, system, min_by(n, rank) AS n_anchors, min_by(role, rank) AS anchor_role FROM ra WHERE rank > 0 GROUP BY ALL)"
VERDICT = ANCHOR + """, ar AS (SELECT city_key, system, max(role) AS polygon_role, max_by(n, role) AS n_polygons FROM n WHERE role IN ('subcatchment', 'catchment') GROUP BY ALL),
v AS (SELECT ar.*, n_anchors, anchor_role, n_polygons / n_anchors::DOUBLE AS q, CASE WHEN n_anchors IS NULL THEN 'level_2_review' WHEN n_polygons / n_anchors::DOUBLE < 0.05 THEN 'level_2' WHEN n_polygons / n_anchors::DOUBLE < 0.5 THEN 'level_2_review' ELSE 'level_1_candidate' END AS level FROM ar LEFT JOIN an USING (city_key, system))"""


@query("p33_layer_roles", "v_layer", sql=f"SELECT city_key, layer_id, {ROLE} AS role FROM v_layer")
def p33(layers: DataFrame) -> DataFrame:
    return layers.select("city_key", "layer_id", op.role(F.col("layer_name")).alias("role"))


@query("p34_layer_systems", "v_layer", sql=f"SELECT city_key, layer_id, {SYSTEM} AS system FROM v_layer")
def p34(layers: DataFrame) -> DataFrame:
    return layers.select("city_key", "layer_id", op.system(F.col("service_name"), F.col("layer_name")).alias("system"))


@query("p35_relevant_layers", "v_layer", sql="SELECT city_key, layer_id FROM v_layer WHERE service_name = 'Utilities' OR " + " OR ".join(f"contains(lower(layer_name), '{w}')" for w in k.KEYWORDS))
def p35(layers: DataFrame) -> DataFrame:
    """Layers with a keyword, and all of a service that an adapter names."""
    return layers.where((F.col("service_name") == "Utilities") | op.relevant(F.col("layer_name"))).select("city_key", "layer_id")


@query("p36_geometry_agreement", "v_layer", sql=f"WITH {CLASS} SELECT city_key, layer_id, role, system, CASE WHEN guess IS NULL THEN 'unclassified' WHEN NOT fits THEN 'geometry disagrees with ' || guess END AS skip_reason FROM r")
def p36(layers: DataFrame) -> DataFrame:
    return op.classified(layers).select("city_key", "layer_id", "role", "system", "skip_reason")


@query("j23_human_role_map", "v_layer", sql=f"WITH {CLASS} SELECT city_key, layer_id, CASE WHEN layer_id % 50 = 0 THEN NULL WHEN layer_id % 20 = 0 THEN 'inlet' ELSE role END AS role, layer_id % 50 = 0 OR layer_id % 20 = 0 AS overridden FROM r")
def j23(layers: DataFrame) -> DataFrame:
    """A human's entry wins, also one that says that a layer has no role."""
    human = layers.where("layer_id % 50 = 0 or layer_id % 20 = 0").select("layer_id", F.when(F.col("layer_id") % 50 != 0, "inlet").alias("human_role"), F.lit(True).alias("overridden"))
    x = op.classified(layers).join(human, "layer_id", "left")
    return x.select("city_key", "layer_id", F.when(F.col("overridden"), F.col("human_role")).otherwise(F.col("role")).alias("role"), F.coalesce("overridden", F.lit(False)).alias("overridden"))


@query("a27_anchor_counts", "v_layer", sql=f"WITH {ANCHOR} SELECT city_key, system, n_anchors, anchor_role, anchor_role = 'manhole' AS is_proxy FROM an")
def a27(layers: DataFrame) -> DataFrame:
    return op.anchors(op.counts(op.classified(layers)))


@query("a28_level_verdicts", "v_layer", sql=f"WITH {VERDICT} SELECT city_key, system, polygon_role, n_polygons, n_anchors, anchor_role, round(q, 5) AS ratio, level FROM v")
def a28(layers: DataFrame) -> DataFrame:
    return op.verdicts(op.counts(op.classified(layers)))


@query("a29_level_confirmation", "v_layer", sql=f"WITH {VERDICT}, m AS (SELECT *, CASE WHEN city_key % 4 <> 0 THEN (90 + city_key % 10) / 100::DOUBLE END AS rate, 20 + city_key AS sample FROM v) SELECT city_key, system, level AS before_level, CASE WHEN level <> 'level_1_candidate' OR rate IS NULL THEN level WHEN sample < 30 THEN 'level_2_review' WHEN rate < 0.95 THEN 'level_2' ELSE 'level_1' END AS level FROM m")
def a29(layers: DataFrame) -> DataFrame:
    x = op.verdicts(op.counts(op.classified(layers)))
    rate = F.when(F.col("city_key") % 4 != 0, (90 + F.col("city_key") % 10) / 100)
    return x.select("city_key", "system", F.col("level").alias("before_level"), op.confirmed(F.col("level"), rate, 20 + F.col("city_key")).alias("level"))


@query("a30_capability_table", "v_layer", sql=f"WITH {VERDICT}, u AS (SELECT city_key, count(*) AS n_layers, count(*) FILTER (WHERE guess IS NULL) AS n_unclassified FROM r GROUP BY 1) SELECT u.city_key, n_layers, n_unclassified, count(v.system) AS n_systems, count(*) FILTER (WHERE v.level = 'level_1_candidate') AS n_candidates FROM u LEFT JOIN v USING (city_key) GROUP BY ALL")
def a30(layers: DataFrame) -> DataFrame:
    c = op.classified(layers)
    n = c.groupBy("city_key").agg(F.count("*").alias("n_layers"), F.count_if(F.col("skip_reason") == "unclassified").alias("n_unclassified"))
    v = op.verdicts(op.counts(c)).groupBy("city_key").agg(F.count("*").alias("n_systems"), F.count_if(F.col("level") == "level_1_candidate").alias("n_candidates"))
    return n.join(v, "city_key", "left").select("city_key", "n_layers", "n_unclassified", F.coalesce("n_systems", F.lit(0)).alias("n_systems"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


@query("p40_layer_admission", "v_layer", sql="SELECT layer_id, geometry_type = 'esriGeometryPolygon' AND n_features > 0 AS admitted, CASE WHEN geometry_type <> 'esriGeometryPolygon' THEN 'not polygonal' WHEN n_features <= 0 THEN 'no features' END AS reason FROM v_layer")
def p40(layers: DataFrame) -> DataFrame:
    polygon, some = F.col("geometry_type") == k.POLYGON, F.col("n_features") > 0
    return layers.select("layer_id", (polygon & some).alias("admitted"), F.when(~polygon, "not polygonal").when(~some, "no features").alias("reason"))


@query("s18_coverage_summary", "v_layer", "v_node", sql=f"""WITH {COUNTS}, cs AS (SELECT city_key, array_to_string(list_sort(list(DISTINCT system)), ',') AS systems, sum(n)::BIGINT AS n_features FROM n GROUP BY 1),
bs AS (SELECT node_key % 25 AS city_key, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, round(stddev_pop(rim_m), 4) AS typical_error_m, count(CASE WHEN node_key % 3 <> 0 THEN rim_m END) / count(*)::DOUBLE AS share FROM v_node GROUP BY 1)
SELECT cs.*, contains(systems, 'sanitary') AS has_sanitary, west, south, east, north, typical_error_m, CASE WHEN 1 - share <= 0.10 THEN 'A' WHEN 1 - share <= 0.35 THEN 'B' WHEN share IS NOT NULL THEN 'C' END AS tier FROM cs LEFT JOIN bs USING (city_key)""")
def s18(layers: DataFrame, nodes: DataFrame) -> DataFrame:
    """Systems, box, typical error (here the spread of rims) and data tier of each city."""
    city = F.col("node_key") % 25
    share = F.count(F.when(F.col("node_key") % 3 != 0, F.col("rim_m"))) / F.count("*")
    facts = nodes.groupBy(city.alias("city_key")).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"), F.round(F.stddev_pop("rim_m"), 4).alias("typical_error_m"), (1 - share).alias("filled"))
    return op.coverage_summary(op.counts(op.classified(layers)), facts)


@query("s09_truncated_sources", "v_layer", sql="WITH t AS (SELECT city_key, count(*) AS n FROM v_layer GROUP BY 1) SELECT v.city_key, CASE WHEN t.n >= 85 THEN 'truncated' WHEN t.n = 0 THEN 'not_applicable' ELSE 'ok' END AS status, CASE WHEN t.n < 85 THEN count(v.layer_id) ELSE 0 END AS n_rows FROM v_layer v JOIN t USING (city_key) GROUP BY v.city_key, t.n")
def s09(layers: DataFrame) -> DataFrame:
    """A fetch that reached its cap (here 85 rows) is truncated: none of its rows may be used."""
    n = layers.groupBy("city_key").agg(F.count("*").alias("n"))
    status = n.withColumn("status", F.when(F.col("n") >= 85, "truncated").when(F.col("n") == 0, "not_applicable").otherwise("ok"))
    used = layers.join(status.where("status = 'truncated'"), "city_key", "left_anti").groupBy("city_key").agg(F.count("*").alias("rows"))
    return status.join(used, "city_key", "left").select("city_key", "status", F.coalesce("rows", F.lit(0)).alias("n_rows"))


@query("s08_polygon_scan", "v_layer", sql="SELECT layer_id, service_name FROM v_layer WHERE geometry_type = 'esriGeometryPolygon' AND service_name <> 'Utilities'")
def s08(layers: DataFrame) -> DataFrame:
    return layers.where((F.col("geometry_type") == k.POLYGON) & (F.col("service_name") != "Utilities")).select("layer_id", "service_name")
