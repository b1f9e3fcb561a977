"""Queries over raw pipes and their attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwork.constants import CITY_RULE_SCHEMA, CITY_RULES
from catchwork.frames import ranked
from catchwork.functions import values as v
from catchwork.operators import ingest as op
from catchwork.plans.registry import query


@query("p01_numeric_cleaning", "v_raw_pipe", sql="""
SELECT file_seq, TRY_CAST(trim(diameter_mm) AS DOUBLE) AS diameter, nullif(inv_up, 0) AS inv_up, TRY_CAST(material AS DOUBLE) AS not_a_number FROM v_raw_pipe""")
def p01(pipes: DataFrame) -> DataFrame:
    return pipes.select("file_seq", v.number(F.col("diameter_mm")).alias("diameter"), v.number(F.col("inv_up"), True).alias("inv_up"), v.number(F.col("material")).alias("not_a_number"))


@query("p02_sentinel_policy", "v_raw_pipe", sql="""
SELECT file_seq, CASE file_seq % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'none' ELSE 'below:-90' END AS policy,
       CASE file_seq % 3 WHEN 0 THEN nullif(inv_up, 0) WHEN 1 THEN inv_up ELSE CASE WHEN inv_up > -90 THEN inv_up END END AS up,
       CASE file_seq % 3 WHEN 0 THEN nullif(inv_dn, 0) WHEN 1 THEN inv_dn ELSE CASE WHEN inv_dn > -90 THEN inv_dn END END AS dn FROM v_raw_pipe""")
def p02(pipes: DataFrame) -> DataFrame:
    k = F.col("file_seq") % 3
    policy = F.when(k == 0, "zero").when(k == 1, "none").otherwise("below:-90")
    x = pipes.withColumn("policy", policy)
    return x.select("file_seq", "policy", v.without_sentinel(F.col("inv_up"), F.col("policy")).alias("up"), v.without_sentinel(F.col("inv_dn"), F.col("policy")).alias("dn"))


@query("p03_plausibility_bands", "v_raw_pipe", sql="""
SELECT file_seq, CASE WHEN inv_up BETWEEN 5 AND 60 THEN inv_up END AS inv_up, CASE WHEN inv_dn BETWEEN 5 AND 60 THEN inv_dn END AS inv_dn FROM v_raw_pipe""")
def p03(pipes: DataFrame) -> DataFrame:
    return pipes.select("file_seq", v.banded(F.col("inv_up"), 5, 60).alias("inv_up"), v.banded(F.col("inv_dn"), 5, 60).alias("inv_dn"))


@query("p04_invert_above_rim", "v_raw_pipe", "v_node", sql="""
SELECT p.file_seq, CASE WHEN n.rim_m IS NULL OR p.inv_up <= n.rim_m THEN p.inv_up END AS inv_up, n.rim_m AS rim_m
FROM v_raw_pipe p LEFT JOIN v_node n ON n.node_key = p.up_key""")
def p04(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    x = pipes.join(nodes.select(F.col("node_key").alias("up_key"), "rim_m"), "up_key", "left")
    return x.select("file_seq", v.below_rim(F.col("inv_up"), F.col("rim_m")).alias("inv_up"), "rim_m")


@query("p05_canonical_pipes", "v_raw_pipe", sql="""
SELECT CASE up_key % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS city, file_seq, name,
       CASE up_key % 3 WHEN 0 THEN nullif(inv_up, 0) WHEN 1 THEN inv_up ELSE CASE WHEN inv_up > -90 THEN inv_up END END AS inv_up,
       CASE up_key % 3 WHEN 0 THEN nullif(inv_dn, 0) WHEN 1 THEN inv_dn ELSE CASE WHEN inv_dn > -90 THEN inv_dn END END AS inv_dn,
       CASE WHEN CAST(diameter_mm AS DOUBLE) > 0 THEN CAST(diameter_mm AS DOUBLE) / CASE up_key % 3 WHEN 0 THEN 1000 WHEN 1 THEN 100 ELSE 1000 END END AS diameter_m,
       CASE material WHEN 'PVC' THEN 0.010 ELSE 0.013 END::DOUBLE AS roughness_n FROM v_raw_pipe""")
def p05(pipes: DataFrame) -> DataFrame:
    k = F.col("up_key") % 3
    city = F.when(k == 0, "alpha").when(k == 1, "beta").otherwise("gamma")
    props = F.create_map(*(x for c in ("name", "inv_up", "inv_dn", "diameter_mm", "material") for x in (F.lit(c), F.col(c).cast("string"))))
    rows = [("alpha", ["label", "name"], "inv_up", "inv_dn", "diameter_mm", 1000.0, "material", "zero"), ("beta", ["name"], "inv_up", "inv_dn", "diameter_mm", 100.0, "material", "none"), ("gamma", ["name"], "inv_up", "inv_dn", "diameter_mm", 1000.0, "material", "below:-90")]
    config = pipes.sparkSession.createDataFrame(rows, "city string, name_fields array<string>, inv_up string, inv_dn string, diameter string, divisor double, material string, policy string")
    return op.canonical(pipes.select(city.alias("city"), "file_seq", props.alias("props")), config)


@query("p06_diameter_text", "v_raw_pipe", sql="""
SELECT file_seq, CASE WHEN CAST(diameter_mm AS DOUBLE) > 0 THEN CAST(diameter_mm AS DOUBLE) / 1000 END AS diameter_m,
       CASE WHEN file_seq % 2 = 0 THEN CAST(diameter_mm AS DOUBLE) END AS larger_side FROM v_raw_pipe""")
def p06(pipes: DataFrame) -> DataFrame:
    text = F.concat(F.col("diameter_mm"), F.lit(" mm"))
    half = F.when(F.col("file_seq") % 2 == 0, F.col("diameter_mm").cast("double"))
    return pipes.select("file_seq", v.diameter_m(text).alias("diameter_m"), F.greatest(half, half / 2).alias("larger_side"))


@query("p07_material_roughness", "v_raw_pipe", sql="SELECT file_seq, material, CASE upper(material) WHEN 'PVC' THEN 0.01 ELSE 0.013 END::DOUBLE AS n FROM v_raw_pipe")
def p07(pipes: DataFrame) -> DataFrame:
    return pipes.select("file_seq", "material", v.roughness(F.col("material")).alias("n"))


@query("p08_material_codes", "v_raw_pipe", sql="""
SELECT file_seq, CASE material WHEN 'Reinforced Concrete' THEN 'RC' WHEN 'unknown' THEN 'UNKNOWN' ELSE material END AS code,
       CASE material WHEN 'PVC' THEN 0.01 ELSE 0.013 END::DOUBLE AS n FROM v_raw_pipe""")
def p08(pipes: DataFrame) -> DataFrame:
    x = pipes.withColumn("code", v.material_code(F.col("material")))
    return x.select("file_seq", "code", v.roughness(F.col("code")).alias("n"))


SHAPE = "CASE file_seq % 4 WHEN 0 THEN 'Box' WHEN 1 THEN 'egg' WHEN 2 THEN 'ROUND' ELSE 'odd' END"


@query("p09_section_shape", "v_raw_pipe", sql=f"""
WITH x AS (SELECT file_seq, {SHAPE} AS raw, CASE WHEN inv_up > 20 THEN inv_up / 10 END AS h, CAST(diameter_mm AS DOUBLE) / 1000 AS w FROM v_raw_pipe),
y AS (SELECT *, h > 0 AND w > 0 AND raw IN ('Box', 'egg') AS ok FROM x)
SELECT file_seq, CASE WHEN ok THEN CASE raw WHEN 'Box' THEN 'RECT_CLOSED' ELSE 'EGG' END ELSE 'CIRCULAR' END AS shape,
       CASE WHEN ok THEN h END AS height_m, CASE WHEN ok THEN w END AS width_m FROM y""")
def p09(pipes: DataFrame) -> DataFrame:
    x = pipes.select("file_seq", F.expr(SHAPE).alias("raw"), F.when(F.col("inv_up") > 20, F.col("inv_up") / 10).alias("h"), (F.col("diameter_mm").cast("double") / 1000).alias("w"))
    return x.select("file_seq", v.section_shape(F.col("raw"), F.col("h"), F.col("w")).alias("s")).select("file_seq", "s.*")


@query("p10_safe_names", "part", sql="""
SELECT p_partkey, regexp_replace(trim(p_name || ' #' || p_partkey), '[^A-Za-z0-9._-]+', '', 'g') AS safe, regexp_replace(trim(p_name), '\\s+', '_', 'g') AS underscored FROM part""")
def p10(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", v.safe_name(F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string"))).alias("safe"), v.underscored(F.col("p_name")).alias("underscored"))


@query("p11_status_filter", "orders", sql="SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority <> '5-LOW'")
def p11(orders: DataFrame) -> DataFrame:
    return orders.where("o_orderstatus in ('O', 'P') and o_orderpriority <> '5-LOW'").select("o_orderkey", "o_orderstatus")


@query("p12_system_split", "v_raw_pipe", sql="""
SELECT file_seq, CASE content WHEN 'Storm' THEN 'storm_minor' ELSE 'combined' END AS system, content IN ('Storm', 'Combined') AS joins_storm FROM v_raw_pipe""")
def p12(pipes: DataFrame) -> DataFrame:
    x = pipes.withColumn("system", v.system_of(F.col("content")))
    return x.select("file_seq", "system", F.col("system").isin("storm_minor", "combined").alias("joins_storm"))


@query("p13_symbol_split", "v_symbol", sql="""SELECT symbol_key, 'rim' AS carries FROM v_symbol WHERE symbol_type IN ('MANHOLE', 'CB/MH', 'MANHOLE, DUMMY', 'SETTLING CHAMBER')
UNION ALL SELECT symbol_key, 'seed' FROM v_symbol WHERE symbol_type IN ('CATCHBASIN', 'CB/MH', 'LAWN BASIN')""")
def p13(symbols: DataFrame) -> DataFrame:
    return op.carriers(symbols).select("symbol_key", "carries")


@query("p14_outfall_tokens", "v_layer", sql="""
SELECT layer_id, len(list_intersect(string_split_regex(lower(layer_name), '[\\s,;:/()._-]+'), ['basins', 'catchment', 'outfall'])) > 0 AS is_outfall FROM v_layer""")
def p14(layers: DataFrame) -> DataFrame:
    return layers.select("layer_id", v.has_token(F.col("layer_name"), ["basins", "catchment", "outfall"]).alias("is_outfall"))


@query("p15_outfall_candidates", "v_node", sql="SELECT node_key, node FROM v_node WHERE starts_with(node, 'MH1') OR rim_m > 100")
def p15(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node").startswith("MH1") | (F.col("rim_m") > 100)).select("node_key", "node")


@query("p16_inlet_seeds", "v_raw_pipe", "v_node", sql="""
WITH e AS (SELECT up_key AS node_key FROM v_raw_pipe UNION SELECT dn_key FROM v_raw_pipe),
s AS (SELECT n.node_key, n.node, round(n.lon, 5) AS x, round(n.lat, 5) AS y FROM e JOIN v_node n USING (node_key) WHERE starts_with(n.node, 'MH2'))
SELECT min(node_key) AS node_key, min_by(node, node_key) AS node, x, y FROM s GROUP BY x, y""")
def p16(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    keys = op.ends(pipes).select("node_key").distinct()
    seeds = keys.join(nodes, "node_key").where(F.col("node").startswith("MH2")).select("node_key", "node", F.round("lon", 5).alias("x"), F.round("lat", 5).alias("y"))
    return seeds.groupBy("x", "y").agg(F.min("node_key").alias("node_key"), F.min_by("node", "node_key").alias("node"))


@query("p17_rims_on_pipes", "v_raw_pipe", sql="""
SELECT file_seq, up_key AS node_key, inv_up + 2 AS ground_m FROM v_raw_pipe WHERE inv_up + 2 BETWEEN 3 AND 70
UNION ALL SELECT file_seq, dn_key, inv_dn + 2 FROM v_raw_pipe WHERE inv_dn + 2 BETWEEN 3 AND 70""")
def p17(pipes: DataFrame) -> DataFrame:
    return op.ends(pipes).select("file_seq", "node_key", (F.col("invert") + 2).alias("ground_m")).where("ground_m between 3 and 70")


@query("w01_duplicate_suffix", "v_raw_pipe", sql="""
WITH x AS (SELECT file_seq, name, row_number() OVER (PARTITION BY name ORDER BY file_seq) AS k FROM v_raw_pipe)
SELECT file_seq, name, CASE WHEN k > 1 THEN name || '_' || k ELSE name END AS unique_name FROM x""")
def w01(pipes: DataFrame) -> DataFrame:
    return op.unique_names(pipes.select("file_seq", "name"), "name", "file_seq")


@query("w04_folded_names", "v_layer", sql="""
WITH x AS (SELECT layer_id, layer_name, row_number() OVER (PARTITION BY lower(layer_name) ORDER BY layer_id) AS k FROM v_layer)
SELECT layer_id, layer_name, CASE WHEN k > 1 THEN layer_name || '_' || k ELSE layer_name END AS unique_name FROM x""")
def w04(layers: DataFrame) -> DataFrame:
    return op.unique_folded(layers.select("layer_id", "layer_name"), "layer_name", "layer_id")


@query("w05_pair_suffix", "v_raw_pipe", sql="""
WITH x AS (SELECT file_seq, up_key, dn_key, row_number() OVER (PARTITION BY up_key, dn_key ORDER BY file_seq) AS k FROM v_raw_pipe)
SELECT file_seq, up_key, dn_key, substr('123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(least(k, 35) AS INT), 1) AS suffix, k > 35 AS clamped FROM x""")
def w05(pipes: DataFrame) -> DataFrame:
    x = ranked(pipes.select("file_seq", "up_key", "dn_key"), [F.col("up_key"), F.col("dn_key")], ["file_seq"], "k")
    pool = F.lit("123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return x.select("file_seq", "up_key", "dn_key", F.substring(pool, F.least("k", F.lit(35)), F.lit(1)).alias("suffix"), (F.col("k") > 35).alias("clamped"))


@query("a01_node_inverts", "v_raw_pipe", sql="""
WITH e AS (SELECT up_key AS node_key, nullif(inv_up, 0) AS i FROM v_raw_pipe UNION ALL SELECT dn_key, CASE WHEN inv_dn > -90 THEN inv_dn END FROM v_raw_pipe)
SELECT node_key, min(i) AS invert_m, count(*) AS n_ends FROM e GROUP BY node_key""")
def a01(pipes: DataFrame) -> DataFrame:
    clean = pipes.withColumn("inv_up", v.without_sentinel(F.col("inv_up"), F.lit("zero"))).withColumn("inv_dn", v.without_sentinel(F.col("inv_dn"), F.lit("below:-90")))
    return op.ends(clean).groupBy("node_key").agg(F.min("invert").alias("invert_m"), F.count("*").alias("n_ends"))


@query("a02_assembly_diagnostics", "v_raw_pipe", "v_node", sql="""
WITH p AS (SELECT * FROM v_raw_pipe WHERE up_key <> dn_key),
e AS (SELECT up_key AS node_key, nullif(inv_up, 0) AS i FROM p UNION ALL SELECT dn_key, CASE WHEN inv_dn > -90 THEN inv_dn END FROM p),
n AS (SELECT node_key, min(i) AS i FROM e GROUP BY 1)
SELECT CAST(v.aoi_id AS BIGINT) AS aoi_id, count(*) AS n_nodes, count(n.i) AS n_with_invert, count(*) - count(n.i) AS n_to_fill,
       round((count(*) - count(n.i)) / count(*)::DOUBLE, 6) AS fill_share FROM n JOIN v_node v USING (node_key) GROUP BY 1""")
def a02(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each area: how many nodes have a published invert, and what share must be filled."""
    clean = pipes.where("up_key <> dn_key").withColumn("inv_up", v.without_sentinel(F.col("inv_up"), F.lit("zero"))).withColumn("inv_dn", v.without_sentinel(F.col("inv_dn"), F.lit("below:-90")))
    inverts = op.ends(clean).groupBy("node_key").agg(F.min("invert").alias("i"))
    n, have = F.count("*"), F.count("i")
    return inverts.join(nodes.select("node_key", "aoi_id"), "node_key").groupBy("aoi_id").agg(n.alias("n_nodes"), have.alias("n_with_invert"), (n - have).alias("n_to_fill"), F.round((n - have) / n, 6).alias("fill_share"))


@query("a03_histograms", "v_raw_pipe", sql="SELECT content, material, count(*) AS n FROM v_raw_pipe GROUP BY content, material")
def a03(pipes: DataFrame) -> DataFrame:
    return pipes.groupBy("content", "material").agg(F.count("*").alias("n"))


LABEL = "CASE WHEN node_key % 7 = 0 THEN 'N' || node_key WHEN node_key % 5 = 0 THEN 'Mh ' || (node_key % 20) ELSE node || '#' END"


@query("a04_safe_labels", "v_node", sql=f"""
WITH x AS (SELECT node_key, regexp_replace(trim({LABEL}), '[^A-Za-z0-9._-]+', '', 'g') AS clean, round(lon, 5) AS x, round(lat, 5) AS y FROM v_node),
c AS (SELECT lower(clean) AS k, count(DISTINCT (x, y)) AS places FROM x WHERE clean <> '' GROUP BY 1)
SELECT node_key, clean, CASE WHEN clean = '' THEN 'dropped' WHEN regexp_matches(lower(clean), '^n[1-9]\\d*$') THEN 'reserved' WHEN places <> 1 THEN 'dropped' ELSE 'kept' END AS verdict
FROM x LEFT JOIN c ON c.k = lower(clean)""")
def a04(nodes: DataFrame) -> DataFrame:
    return op.safe_labels(nodes.withColumn("label", F.expr(LABEL))).select("node_key", "clean", "verdict")


@query("j01_endpoints_by_id", "v_raw_pipe", "v_node", sql="""
SELECT p.file_seq, p.name, p.up_key, p.dn_key, coalesce(u.lon, d.lon) AS a_lon, coalesce(u.lat, d.lat) AS a_lat, coalesce(d.lon, u.lon) AS b_lon, coalesce(d.lat, u.lat) AS b_lat,
       CAST(u.lon IS NULL AS INT) + CAST(d.lon IS NULL AS INT) AS n_dangling
FROM v_raw_pipe p LEFT JOIN v_node u ON u.node_key = p.up_key LEFT JOIN v_node d ON d.node_key = p.dn_key""")
def j01(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    return op.resolved_ends(pipes, nodes)


@query("j02_integer_ids", "v_raw_pipe", "v_node", sql="""
WITH p AS (SELECT file_seq, CASE WHEN up_key % 11 = 0 THEN NULL ELSE up_key END AS u FROM v_raw_pipe)
SELECT p.file_seq, p.u AS node_key, n.node FROM p LEFT JOIN v_node n ON n.node_key = p.u""")
def j02(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    raw = F.when(F.col("up_key") % 11 == 0, F.when(F.col("up_key") % 2 == 0, -1).otherwise(0)).otherwise(F.col("up_key"))  # -1 and 0 mean none
    ids = pipes.select("file_seq", F.when(raw > 0, raw).alias("node_key"))
    return ids.join(nodes.select("node_key", "node"), "node_key", "left").select("file_seq", "node_key", "node")


@query("j03_stray_ends", "v_raw_pipe", "v_node", sql="""
WITH x AS (SELECT p.file_seq, u.lon AS ax, u.lat AS ay, d.lon AS bx, d.lat AS b_y, u.lon + CASE WHEN p.file_seq % 9 = 0 THEN 1e-2 ELSE 0 END AS px, u.lat AS py
           FROM v_raw_pipe p JOIN v_node u ON u.node_key = p.up_key JOIN v_node d ON d.node_key = p.dn_key),
y AS (SELECT *, least((px - ax) * (px - ax) + (py - ay) * (py - ay), (px - bx) * (px - bx) + (py - b_y) * (py - b_y)) > 5e-4 * 5e-4 AS stray FROM x)
SELECT file_seq, stray, CASE WHEN stray THEN ax ELSE px END AS lon, CASE WHEN stray THEN ay ELSE py END AS lat FROM y""")
def j03(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    """An end more than 0.0005 degrees from both line ends moves to the free line end."""
    p = op.resolved_ends(pipes, nodes).where("n_dangling = 0").withColumn("px", F.col("a_lon") + F.when(F.col("file_seq") % 9 == 0, 1e-2).otherwise(0.0))
    far = lambda s: F.pow(F.col("px") - F.col(f"{s}_lon"), 2) + F.pow(F.col("a_lat") - F.col(f"{s}_lat"), 2)
    p = p.withColumn("stray", F.least(far("a"), far("b")) > 0.0005**2)
    return p.select("file_seq", "stray", F.when(F.col("stray"), F.col("a_lon")).otherwise(F.col("px")).alias("lon"), F.col("a_lat").alias("lat"))


@query("j04_asbuilt_inverts", "v_raw_pipe", "v_node", sql="""
WITH b AS (SELECT file_seq, CASE WHEN file_seq % 4 = 0 THEN inv_up + 1e-1 END AS built FROM v_raw_pipe)
SELECT p.file_seq, coalesce(b.built, nullif(p.inv_up, 0), n.rim_m - 25e-1) AS invert_m,
       CASE WHEN b.built IS NOT NULL THEN 'as_built' WHEN p.inv_up <> 0 THEN 'published' WHEN n.rim_m IS NOT NULL THEN 'rim' END AS tier
FROM v_raw_pipe p JOIN b USING (file_seq) LEFT JOIN v_node n ON n.node_key = p.up_key""")
def j04(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    built = pipes.where("file_seq % 4 = 0").select("file_seq", (F.col("inv_up") + 0.1).alias("built"))
    x = pipes.join(built, "file_seq", "left").join(nodes.select(F.col("node_key").alias("up_key"), "rim_m"), "up_key", "left")
    own = F.nullif("inv_up", F.lit(0.0))
    tier = F.when(F.col("built").isNotNull(), "as_built").when(own.isNotNull(), "published").when(F.col("rim_m").isNotNull(), "rim")
    return x.select("file_seq", F.coalesce("built", own, F.col("rim_m") - 2.5).alias("invert_m"), tier.alias("tier"))


@query("j05_chamber_lift", "v_raw_pipe", "v_node", sql="""
SELECT p.file_seq, coalesce(nullif(p.inv_up, 0), u.rim_m - 3) AS up, coalesce(CASE WHEN p.inv_dn > -90 THEN p.inv_dn END, d.rim_m - 3) AS dn
FROM v_raw_pipe p LEFT JOIN v_node u ON u.node_key = p.up_key LEFT JOIN v_node d ON d.node_key = p.dn_key""")
def j05(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends without an invert take that of the chamber at the node."""
    u = nodes.select(F.col("node_key").alias("up_key"), (F.col("rim_m") - 3).alias("cu"))
    d = nodes.select(F.col("node_key").alias("dn_key"), (F.col("rim_m") - 3).alias("cd"))
    x = pipes.join(u, "up_key", "left").join(d, "dn_key", "left")
    return x.select("file_seq", F.coalesce(F.nullif("inv_up", F.lit(0.0)), "cu").alias("up"), F.coalesce(F.when(F.col("inv_dn") > -90, F.col("inv_dn")), "cd").alias("dn"))


@query("m01_great_circle_length", "v_raw_pipe", "v_node", sql="""
SELECT p.file_seq, round(2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(d.lat - u.lat) / 2), 2) + cos(radians(u.lat)) * cos(radians(d.lat)) * pow(sin(radians(d.lon - u.lon) / 2), 2)))), 4) AS length_m
FROM v_raw_pipe p JOIN v_node u ON u.node_key = p.up_key JOIN v_node d ON d.node_key = p.dn_key""")
def m01(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    x = op.resolved_ends(pipes, nodes).where("n_dangling = 0")
    return x.select("file_seq", F.round(v.haversine_m(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat")), 4).alias("length_m"))


@query("m03_bearing", "v_raw_pipe", "v_node", sql="""
WITH x AS (SELECT p.file_seq, d.lon - u.lon AS dx, d.lat - u.lat AS dy FROM v_raw_pipe p JOIN v_node u ON u.node_key = p.up_key JOIN v_node d ON d.node_key = p.dn_key)
SELECT file_seq, CASE WHEN dx <> 0 OR dy <> 0 THEN round((degrees(atan2(dx, dy)) + 360) % 360, 6) END AS bearing FROM x""")
def m03(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    x = op.resolved_ends(pipes, nodes).where("n_dangling = 0")
    return x.select("file_seq", F.round(v.bearing(F.col("b_lon") - F.col("a_lon"), F.col("b_lat") - F.col("a_lat")), 6).alias("bearing"))


@query("m17_bbox_text", "v_node", sql="""
SELECT aoi_id, printf('%.6f,%.6f,%.6f,%.6f', min(lon), min(lat), max(lon), max(lat)) AS bbox FROM v_node GROUP BY aoi_id""")
def m17(nodes: DataFrame) -> DataFrame:
    box = nodes.groupBy("aoi_id").agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    return box.select("aoi_id", v.bbox_text(F.col("w"), F.col("s"), F.col("e"), F.col("n")).alias("bbox"))


@query("m20_utm_zone", "v_idf", sql="SELECT DISTINCT station_key, CAST(32600 + least(60, floor((lon + 180) / 6) + 1) AS INT) AS epsg FROM v_idf")
def m20(idf: DataFrame) -> DataFrame:
    return idf.select("station_key", v.utm_zone(F.col("lon"), F.col("lat")).alias("epsg")).distinct()


@query("m14_standard_time", "v_idf", sql="SELECT DISTINCT station_key, CAST(round_even(lon / 15, 0) AS INT) AS hours FROM v_idf")
def m14(idf: DataFrame) -> DataFrame:
    return idf.select("station_key", v.local_hours(F.col("lon"), F.col("lat")).alias("hours")).distinct()


@query("u01_graft_second_system", "v_tree", sql="""
SELECT 'storm_minor' AS system, name, CAST(from_key AS VARCHAR) AS from_node, CAST(to_key AS VARCHAR) AS to_node FROM v_tree WHERE system <> 'sanitary'
UNION ALL SELECT 'sanitary', 'san_' || name, 'san_' || from_key, 'san_' || to_key FROM v_tree WHERE system = 'sanitary'""")
def u01(tree: DataFrame) -> DataFrame:
    """Two systems share one model: the second one's names and ends get a prefix, so nothing collides."""
    keys = [F.col(c).cast("string") for c in ("from_key", "to_key")]
    first = tree.where("system <> 'sanitary'").select("system", "name", keys[0].alias("from_node"), keys[1].alias("to_node"))
    second = tree.where("system = 'sanitary'").select("system", F.concat(F.lit("san_"), "name").alias("name"), *(F.concat(F.lit("san_"), k).alias(n) for k, n in zip(keys, ("from_node", "to_node"), strict=True)))
    return first.unionByName(second)


@query("u02_storm_and_combined", "v_raw_pipe", sql="SELECT file_seq, name, content FROM v_raw_pipe WHERE content = 'Storm' UNION ALL SELECT file_seq, name, content FROM v_raw_pipe WHERE content = 'Combined'")
def u02(pipes: DataFrame) -> DataFrame:
    x = pipes.select("file_seq", "name", "content")
    return x.where("content = 'Storm'").unionByName(x.where("content = 'Combined'"))


def _literal(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else repr(x)


RULES = "r(city, policy, il, ih, rl, rh, snap) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in CITY_RULES) + ")"
CITIES = "[" + ", ".join(f"'{row[0]}'" for row in CITY_RULES) + "]"


def _kept(c: str) -> str:
    clean = f"CASE WHEN policy = 'zero' THEN nullif({c}, 0) WHEN policy = 'below:0' THEN CASE WHEN {c} > 0 THEN {c} END WHEN policy = 'below:-90' THEN CASE WHEN {c} > -90 THEN {c} END ELSE {c} END"
    return f"CASE WHEN ({clean}) >= coalesce(il, -1e9) AND ({clean}) <= coalesce(ih, 1e9) THEN {c} END AS {c}"


@query("p_city_rules", "v_raw_pipe", "v_node", sql=f"""WITH {RULES}, p AS (SELECT p.*, n.rim_m, ({CITIES})[CAST(1 + up_key % 35 AS INT)] AS city FROM v_raw_pipe p JOIN v_node n ON n.node_key = p.up_key)
SELECT city, file_seq, {_kept('inv_up')}, {_kept('inv_dn')}, CASE WHEN rim_m >= coalesce(rl, -1e9) AND rim_m <= coalesce(rh, 1e9) THEN rim_m END AS rim_m, snap AS snap_decimals FROM p JOIN r USING (city)""")
def p_city_rules(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every city's ingest rules at once over the fleet's pipes."""
    names = F.array(*(F.lit(row[0]) for row in CITY_RULES))
    x = pipes.join(nodes.select(F.col("node_key").alias("up_key"), "rim_m"), "up_key").withColumn("city", F.get(names, (F.col("up_key") % 35).cast("int")))
    rules = pipes.sparkSession.createDataFrame(CITY_RULES, CITY_RULE_SCHEMA)
    return op.by_city_rules(x, rules).select("city", "file_seq", "inv_up", "inv_dn", "rim_m", "snap_decimals")
