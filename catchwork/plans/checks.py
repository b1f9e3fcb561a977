"""Validation of models: each check gives rows of (check, severity, passed, metrics)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwork import constants as k
from catchwork.operators import checks
from catchwork.operators.quantiles import percentiles
from catchwork.plans.registry import query


@query("a22_catchment_checks", "v_checked", "v_node", sql="""
WITH b AS (SELECT c.*, n.node_key IS NULL AS dangling FROM v_checked c LEFT JOIN v_node n ON n.node_key = c.outlet_key),
twice AS (SELECT aoi_id, count(*) AS k FROM (SELECT aoi_id, name FROM v_checked WHERE name IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY 1),
c AS (SELECT aoi_id, 'outlet_present' AS check, 'error' AS severity, count(*) FILTER (WHERE outlet_key IS NULL) AS n_bad FROM b GROUP BY 1
UNION ALL SELECT aoi_id, 'outlet_exists', 'error', count(*) FILTER (WHERE dangling) FROM b GROUP BY 1
UNION ALL SELECT aoi_id, 'area_positive', 'error', count(*) FILTER (WHERE NOT coalesce(area_ha > 0, false)) FROM b GROUP BY 1
UNION ALL SELECT aoi_id, 'geometry_absent', 'warning', count(*) FILTER (WHERE NOT has_polygon) FROM b GROUP BY 1
UNION ALL SELECT aoi_id, 'finite_hydraulics', 'error', count(*) FILTER (WHERE NOT isfinite(pct_imperv)) FROM b GROUP BY 1
UNION ALL SELECT aoi_id, 'unique_ids', 'error', coalesce(any_value(k), 0) FROM b LEFT JOIN twice USING (aoi_id) GROUP BY 1)
SELECT *, n_bad = 0 AS passed FROM c""")
def a22(catchments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Checks of an area's catchments that need no geometry but its presence, by whole names."""
    return checks.catchment_checks(catchments, nodes.select("node_key"))


@query("t04_check_samples", "v_catchment", sql="SELECT outlet_key % 5 AS area, array_to_string(list_sort(list(name) FILTER (WHERE area_ha < 2))[1:10], ',') AS sample, count(*) FILTER (WHERE area_ha < 2) AS n_bad FROM v_catchment GROUP BY 1")
def t04(catchments: DataFrame) -> DataFrame:
    """The first ten names of what fails."""
    x = catchments.select((F.col("outlet_key") % 5).alias("area"), "name", "area_ha")
    n = x.groupBy("area").agg(F.count_if(F.col("area_ha") < 2).alias("n_bad"))
    return n.join(checks.samples(x.where("area_ha < 2"), "area", "name"), "area", "left").select("area", F.coalesce("sample", F.lit("")).alias("sample"), "n_bad")


@query("j21_missing_outlets", "v_catchment", "v_node", sql="SELECT cell_key, outlet_key FROM v_catchment WHERE outlet_key NOT IN (SELECT node_key FROM v_node WHERE node_key % 7 <> 0)")
def j21(catchments: DataFrame, nodes: DataFrame) -> DataFrame:
    known = nodes.where("node_key % 7 <> 0").select(F.col("node_key").alias("outlet_key"))
    return catchments.join(known, "outlet_key", "left_anti").select("cell_key", "outlet_key")


@query("j22_missing_conduit_ends", "v_raw_pipe", "v_node", sql="WITH n AS (SELECT node_key FROM v_node WHERE node_key % 7 <> 0) SELECT file_seq, up_key AS node_key, 'from' AS side FROM v_raw_pipe WHERE up_key NOT IN (FROM n) UNION ALL SELECT file_seq, dn_key, 'to' FROM v_raw_pipe WHERE dn_key NOT IN (FROM n)")
def j22(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    known = nodes.where("node_key % 7 <> 0").select("node_key")
    ends = pipes.select("file_seq", F.col("up_key").alias("node_key"), F.lit("from").alias("side")).unionByName(pipes.select("file_seq", F.col("dn_key").alias("node_key"), F.lit("to").alias("side")))
    return ends.join(known, "node_key", "left_anti").select("file_seq", "node_key", "side")


RISE = """r AS (SELECT p.file_seq, p.up_key AS from_key, d.rim_m - u.rim_m AS rise FROM v_raw_pipe p JOIN v_node u ON u.node_key = p.up_key JOIN v_node d ON d.node_key = p.dn_key)"""


def rises(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    u, d = (nodes.select(F.col("node_key").alias(c), F.col("rim_m").alias(f"i_{c}")) for c in ("up_key", "dn_key"))
    return pipes.join(u, "up_key").join(d, "dn_key").select("file_seq", F.col("up_key").alias("from_key"), (F.col("i_dn_key") - F.col("i_up_key")).alias("rise"))


@query("t04_steepest_rises", "v_raw_pipe", "v_node", sql=f"""WITH {RISE} SELECT n.aoi_id, array_to_string(list(file_seq ORDER BY rise DESC, file_seq)[1:10], ',') AS sample FROM r JOIN v_node n ON n.node_key = r.from_key WHERE rise > 0.01 GROUP BY 1""")
def t04_rises(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ten conduits of each area that rise most."""
    x = rises(pipes, nodes).where(F.col("rise") > k.INVERT_RISE_TOL_M).join(nodes.select(F.col("node_key").alias("from_key"), "aoi_id"), "from_key")
    return checks.samples(x.withColumn("fall", -F.col("rise")), "aoi_id", "file_seq", "fall")


@query("a23_invert_consistency", "v_raw_pipe", "v_node", sql=f"""WITH {RISE}, n AS (SELECT from_key, bool_and(rise > 0.01) AS pit, max(rise) AS top, count(*) FILTER (WHERE rise > 0.01) AS n_adverse FROM r GROUP BY 1)
SELECT from_key, pit, round(top, 4) AS max_rise_m, n_adverse FROM n WHERE n_adverse > 0""")
def a23(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with conduits that rise by over a centimetre; a pit is one where every outgoing conduit does."""
    up = F.col("rise") > k.INVERT_RISE_TOL_M
    x = rises(pipes, nodes).groupBy("from_key").agg(F.bool_and(up).alias("pit"), F.round(F.max("rise"), 4).alias("max_rise_m"), F.count_if(up).alias("n_adverse"))
    return x.where("n_adverse > 0")


@query("a24_cross_connections", "v_tree", sql="""WITH s AS (SELECT from_key AS n, min(system) AS system FROM v_tree GROUP BY 1)
SELECT t.name, a.system AS from_system, b.system AS to_system FROM v_tree t JOIN s a ON a.n = t.from_key JOIN s b ON b.n = t.to_key WHERE a.system <> b.system""")
def a24(tree: DataFrame) -> DataFrame:
    """Conduits that join a storm and a sanitary node although neither is combined."""
    s = tree.groupBy(F.col("from_key").alias("n")).agg(F.min("system").alias("system"))
    a, b = s.select(F.col("n").alias("from_key"), F.col("system").alias("from_system")), s.select(F.col("n").alias("to_key"), F.col("system").alias("to_system"))
    x = tree.join(a, "from_key").join(b, "to_key").where("from_system <> to_system and from_system <> 'combined' and to_system <> 'combined'")
    return x.select("name", "from_system", "to_system")


@query("a20_outlet_distance", "v_catchment", "v_node", sql="""
WITH d AS (SELECT n.aoi_id, c.area_ha * 12 AS m FROM v_catchment c JOIN v_node n ON n.node_key = c.outlet_key),
r AS (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY aoi_id) AS n FROM d)
SELECT aoi_id, round(max(m), 4) AS max_m, round(max(CASE WHEN i = floor(0.95::DOUBLE * (n - 1)) THEN m END), 4) AS p95_m, count(*) FILTER (WHERE m > 20 AND m <= 50) AS n_20_50, count(*) FILTER (WHERE m > 50) AS n_over_50 FROM r GROUP BY 1""")
def a20(catchments: DataFrame, nodes: DataFrame) -> DataFrame:
    d = catchments.join(nodes.select(F.col("node_key").alias("outlet_key"), "aoi_id"), "outlet_key").select("aoi_id", (F.col("area_ha") * 12).alias("m"))
    x = checks.distance_summary(d, "m", "aoi_id")
    return x.withColumn("max_m", F.round("max_m", 4)).withColumn("p95_m", F.round("p95_m", 4))


@query("a21_shape_outliers", "v_cell_shape", sql="""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY area_ha) - 1 AS i, count(*) OVER (PARTITION BY aoi_id) AS n FROM v_cell_shape),
m AS (SELECT aoi_id, max(CASE WHEN i = n // 2 THEN area_ha END) AS med FROM r GROUP BY 1)
SELECT cell_key, area_ha > 20 * med AS large, area_ha < med / 20 AS small, thinness > 8 AS elongated FROM r JOIN m USING (aoi_id) WHERE area_ha > 20 * med OR area_ha < med / 20 OR thinness > 8""")
def a21(cells: DataFrame) -> DataFrame:
    return checks.shape_outliers(cells, "aoi_id").select("cell_key", "large", "small", "elongated")


@query("a25_verdict_rollup", "v_catchment", "v_raw_pipe", "v_node", sql=f"""WITH {RISE},
c AS (SELECT n.aoi_id, 'invert_consistency' AS check, 'warning' AS severity, count(*) FILTER (WHERE rise > 0.01) AS bad FROM r JOIN v_node n ON n.node_key = r.from_key GROUP BY 1
 UNION ALL SELECT n.aoi_id, 'area_positive', 'error', count(*) FILTER (WHERE area_ha < 0.15) FROM v_catchment c JOIN v_node n ON n.node_key = c.outlet_key GROUP BY 1)
SELECT aoi_id, count(*) FILTER (WHERE severity = 'error' AND bad > 0) AS n_errors, count(*) FILTER (WHERE severity = 'warning' AND bad > 0) AS n_warnings, count(*) FILTER (WHERE severity = 'error' AND bad > 0) = 0 AS ok FROM c GROUP BY 1""")
def a25(catchments: DataFrame, pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Errors, warnings and the verdict of each area over all check rows."""
    area = nodes.select(F.col("node_key").alias("key"), "aoi_id")
    inverts = rises(pipes, nodes).withColumn("key", F.col("from_key")).join(area, "key").groupBy("aoi_id").agg(F.lit("warning").alias("severity"), F.count_if(F.col("rise") > k.INVERT_RISE_TOL_M).alias("bad"))
    sizes = catchments.withColumn("key", F.col("outlet_key")).join(area, "key").groupBy("aoi_id").agg(F.lit("error").alias("severity"), F.count_if(F.col("area_ha") < 0.15).alias("bad"))
    failed = lambda s: F.count_if((F.col("severity") == s) & (F.col("bad") > 0))
    return inverts.unionByName(sizes).groupBy("aoi_id").agg(failed("error").alias("n_errors"), failed("warning").alias("n_warnings"), (failed("error") == 0).alias("ok"))


@query("a26_outlet_agreement", "v_catchment", "v_tree", "v_node", sql="""
WITH RECURSIVE walk(node, reached) AS (SELECT from_key, from_key FROM v_tree UNION SELECT to_key, to_key FROM v_tree UNION ALL SELECT w.node, t.to_key FROM walk w JOIN v_tree t ON t.from_key = w.reached),
term AS (SELECT node, min(reached) AS ours FROM walk GROUP BY 1), outfalls AS (SELECT DISTINCT ours AS name FROM term),
u AS (SELECT c.outlet_key % 5 AS aoi_id, c.cell_key AS unit, CASE WHEN c.cell_key % 11 <> 0 THEN (c.cell_key * 37 % 1200) + 0.5 END AS x, (c.cell_key * 53 % 600) + 0.5 AS y, t.ours FROM v_catchment c LEFT JOIN term t ON t.node = c.outlet_key),
a AS (SELECT DISTINCT aoi_id, node_key % 10 AS gx, node_key // 10 % 5 AS gy, 1 + (node_key % 10 + node_key // 10 % 5 + aoi_id) % 3 AS declared FROM v_node),
b AS (SELECT u.*, CASE WHEN u.x IS NULL THEN 'no_geometry' WHEN a.declared IS NULL THEN 'outside_official' WHEN u.ours IS NULL THEN 'reaches_no_outfall' WHEN u.ours % 13 = 0 THEN 'left_extract'
  WHEN a.declared NOT IN (SELECT name FROM outfalls) THEN 'declared_unknown' WHEN u.ours = a.declared THEN 'agree' ELSE 'disagree' END AS bucket
  FROM u LEFT JOIN a ON a.aoi_id = u.aoi_id AND a.gx = floor(u.x / 100) AND a.gy = floor(u.y / 100))
SELECT aoi_id, count(*) FILTER (WHERE bucket = 'agree') AS n_agree, count(*) FILTER (WHERE bucket IN ('agree', 'disagree')) AS n_comparable, count(*) FILTER (WHERE bucket = 'no_geometry') AS n_no_geometry, count(*) FILTER (WHERE bucket = 'outside_official') AS n_outside,
  count(*) FILTER (WHERE bucket = 'reaches_no_outfall') AS n_no_outfall, count(*) FILTER (WHERE bucket = 'left_extract') AS n_left, count(*) FILTER (WHERE bucket = 'declared_unknown') AS n_unknown,
  round(count(*) FILTER (WHERE bucket = 'agree') / nullif(count(*) FILTER (WHERE bucket IN ('agree', 'disagree')), 0)::DOUBLE, 6) AS rate, round(100.0::DOUBLE * count(*) FILTER (WHERE bucket IN ('agree', 'disagree')) / count(*), 1) AS pct_scored FROM b GROUP BY 1""")
def a26(catchments: DataFrame, tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """Official areas are squares of 100 m that declare one of three outfalls; outfalls divisible by 13 were made up at the border."""
    from catchwork.operators import network

    ours = network.terminals(network.parents(tree)).select(F.col("node").alias("outlet_key"), F.col("terminal").alias("ours"))
    key = F.col("cell_key")
    units = catchments.join(ours, "outlet_key", "left").select((F.col("outlet_key") % 5).alias("aoi_id"), key.alias("unit"), F.when(key % 11 != 0, key * 37 % 1200 + 0.5).alias("x"), (key * 53 % 600 + 0.5).alias("y"), "ours")
    gx, gy = F.col("node_key") % 10, F.floor(F.col("node_key") / 10) % 5
    corner = lambda i, j: F.struct(((F.col("gx") + i) * 100.0).alias("x"), ((F.col("gy") + j) * 100.0).alias("y"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    areas = nodes.select("aoi_id", gx.alias("gx"), gy.alias("gy"), (1 + (gx + gy + F.col("aoi_id")) % 3).alias("declared")).distinct().select("aoi_id", ring.alias("ring"), "declared")
    named = areas.select("aoi_id", F.col("declared").alias("name")).union(units.select("aoi_id", "ours")).distinct()  # an area's outfalls, so far as anything names them
    outfalls = named.join(ours.select(F.col("ours").alias("name")), "name", "left_semi").select("aoi_id", "name", (F.col("name") % 13 == 0).alias("synthesised"))
    return checks.agreement_rate(checks.outlet_agreement(units, areas, outfalls))


@query("a31_noise_share", "v_cell_shape", sql="SELECT aoi_id, round(avg(CAST(area_ha < 0.05 AS INT)), 6) AS noise_share, avg(CAST(area_ha < 0.05 AS INT)) > 0.5 AS mostly_noise FROM v_cell_shape GROUP BY 1")
def a31(cells: DataFrame) -> DataFrame:
    """Share of cells below 0.05 ha and whether they are the majority."""
    return checks.noise_share(cells, "aoi_id").withColumn("noise_share", F.round("noise_share", 6))


@query("a41_delineation_table", "v_catchment", sql="SELECT outlet_key % 5 AS aoi, count(*) AS n_cells, round(median(area_ha), 6) AS median_ha, round(sum(area_ha), 4) AS area_ha, count(*) FILTER (WHERE area_ha < 1) AS n_failing FROM v_catchment GROUP BY 1")
def a41(catchments: DataFrame) -> DataFrame:
    x = catchments.withColumn("aoi", F.col("outlet_key") % 5)
    sums = x.groupBy("aoi").agg(F.count("*").alias("n_cells"), F.round(F.sum("area_ha"), 4).alias("area_ha"), F.count_if(F.col("area_ha") < 1).alias("n_failing"))
    return sums.join(percentiles(x, ["aoi"], "area_ha", 0.5, "median_ha").withColumn("median_ha", F.round("median_ha", 6)), "aoi")


@query("a42_model_manifest", "v_tree", "v_catchment", sql="""WITH c AS (SELECT system, count(*) AS n_conduits, count(DISTINCT from_key) AS n_nodes, round(sum(length_m), 3) AS length_m FROM v_tree GROUP BY 1)
SELECT c.*, (SELECT count(*) FROM v_catchment JOIN v_tree t ON t.from_key = outlet_key WHERE t.system = c.system) AS n_catchments FROM c""")
def a42(tree: DataFrame, catchments: DataFrame) -> DataFrame:
    c = tree.groupBy("system").agg(F.count("*").alias("n_conduits"), F.count_distinct("from_key").alias("n_nodes"), F.round(F.sum("length_m"), 3).alias("length_m"))
    s = catchments.join(tree.select(F.col("from_key").alias("outlet_key"), "system"), "outlet_key").groupBy("system").agg(F.count("*").alias("n_catchments"))
    return c.join(s, "system", "left").select("system", "n_conduits", "n_nodes", "length_m", F.coalesce("n_catchments", F.lit(0)).alias("n_catchments"))


@query("p19_request_admission", "orders", sql="""WITH r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_custkey % 900 - 30 AS INT) AS e, o_totalprice / 1000 AS km2, o_custkey % 30 AS hours FROM orders)
SELECT o_orderkey, CASE WHEN e < s THEN 'dates' WHEN e - s > 731 THEN 'span' WHEN NOT (km2 > 0 AND km2 <= 300) THEN 'area' WHEN hours NOT BETWEEN 1 AND 24 THEN 'duration' ELSE 'admitted' END AS verdict FROM r""")
def p19(orders: DataFrame) -> DataFrame:
    """The first rule that a request breaks: date order, a span of 731 days, a positive area under the cap, a duration of 1 to 24 hours."""
    s = F.to_date("o_orderdate")
    e = F.date_add(s, (F.col("o_custkey") % 900 - 30).cast("int"))
    km2, hours = F.col("o_totalprice") / 1000, F.col("o_custkey") % 30
    verdict = F.when(e < s, "dates").when(F.datediff(e, s) > 731, "span").when(~((km2 > 0) & (km2 <= 300)), "area").when(~hours.between(1, 24), "duration").otherwise("admitted")
    return orders.select("o_orderkey", verdict.alias("verdict"))


@query("p30_delineation_plan", "customer", sql="""WITH e AS (SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN 5 ELSE 0 END AS user_units, c_custkey % 6 AS nodes, c_custkey % 4 AS streets, c_custkey % 3 AS parcels, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 7 + 0.5 END AS dem, c_custkey % 2 AS kerbs FROM customer)
SELECT c_custkey, CASE WHEN user_units > 0 THEN 'user_supplied' WHEN nodes > 0 AND streets > 0 THEN 'junction_street' WHEN nodes > 0 AND dem <= 2 THEN 'junction_dem' WHEN nodes > 0 AND parcels > 0 THEN 'junction_parcel' ELSE 'junction_nearest' END AS method,
 CASE WHEN user_units > 0 THEN 'unrated' WHEN nodes > 0 AND streets > 0 THEN 'medium' WHEN nodes > 0 AND dem <= 2 THEN CASE WHEN kerbs > 0 THEN 'high' ELSE 'medium' END WHEN nodes > 0 AND parcels > 0 THEN 'medium' ELSE 'low' END AS confidence FROM e""")
def p30(customer: DataFrame) -> DataFrame:
    """How an area's land is divided, by the best evidence that it has, and how far that is to be trusted."""
    c = F.col("c_custkey")
    user, nodes, streets, land = c % 20 == 0, c % 6 > 0, c % 4 > 0, c % 3 > 0
    fine = F.coalesce(F.when(c % 5 != 0, c % 7 + 0.5) <= 2, F.lit(False))
    method = F.when(user, "user_supplied").when(nodes & streets, "junction_street").when(nodes & fine, "junction_dem").when(nodes & land, "junction_parcel").otherwise("junction_nearest")
    trust = F.when(user, "unrated").when(nodes & streets, "medium").when(nodes & fine, F.when(c % 2 > 0, "high").otherwise("medium")).when(nodes & land, "medium").otherwise("low")
    return customer.select("c_custkey", method.alias("method"), trust.alias("confidence"))


@query("p29_method_label", "customer", sql="""WITH r AS (SELECT c_custkey, ['junction_street_segment', 'junction_dem', 'nearest (parcel-shaped)', 'nearest (voronoi-shaped)', 'other'][1 + c_custkey % 5] AS m, c_custkey % 2 = 0 AS basins, c_custkey % 4 = 0 AS kerbed FROM customer)
SELECT c_custkey, CASE WHEN m = 'junction_street_segment' THEN m WHEN m = 'junction_dem' AND basins THEN 'catchbasin_dem' WHEN m = 'junction_dem' THEN m WHEN m LIKE '%parcel%' THEN 'catchbasin_parcel' WHEN m LIKE '%voronoi%' THEN 'fallback_voronoi_catchbasin' ELSE 'fallback_voronoi_junction' END AS label,
  CASE WHEN m = 'junction_dem' AND basins AND kerbed THEN 'high' WHEN m IN ('junction_dem', 'junction_street_segment') OR m LIKE '%parcel%' THEN 'medium' ELSE 'low' END AS confidence FROM r""")
def p29(customer: DataFrame) -> DataFrame:
    """Label and confidence of each run."""
    c = F.col("c_custkey")
    names = F.array(*map(F.lit, ("junction_street_segment", "junction_dem", "nearest (parcel-shaped)", "nearest (voronoi-shaped)", "other")))
    runs = customer.select("c_custkey", F.get(names, (c % 5).cast("int")).alias("method"), F.when(c % 2 == 0, "catch_basin").otherwise("manhole").alias("seeded_on"), (c % 4 == 0).alias("kerbed"))
    return checks.method_labels(runs).select("c_custkey", "label", "confidence")


@query("g20_delineation_fallback", "v_catchment", sql="""WITH x AS (SELECT outlet_key AS area, avg(CAST(area_ha < 0.5 AS INT)) AS noise, median(pct_imperv) / 20 AS slope, count(*) AS n, count(*) FILTER (WHERE area_ha < 0.15) AS errors FROM v_catchment GROUP BY 1)
SELECT area, CASE WHEN area % 6 = 0 AND area % 4 <> 0 THEN 'corridor_voronoi' WHEN area % 6 = 0 AND noise > 0.5 THEN 'noise_cell_fallback' WHEN area % 6 = 0 THEN 'corridor_frontage' WHEN area % 7 = 0 THEN 'no_dem' WHEN area % 11 = 0 THEN 'no_dem_overlap' WHEN slope < CASE WHEN area % 2 = 0 THEN 1 ELSE 4 END THEN 'below_slope_gate'
  WHEN area % 13 = 0 THEN 'dem_degenerate' WHEN errors > 0 THEN 'posterior_fallback' WHEN noise > 0.5 THEN 'noise_cell_fallback' ELSE 'dem' END AS decision FROM x""")
def g20(catchments: DataFrame) -> DataFrame:
    """The chain for the drainage area of each node; the view states which areas have a corridor, streets and terrain."""
    a = F.col("area")
    x = catchments.groupBy(F.col("outlet_key").alias("area")).agg(F.avg((F.col("area_ha") < 0.5).cast("int")).alias("noise_share"), F.count("*").alias("n"), F.count_if(F.col("area_ha") < 0.15).alias("n_errors"))
    slopes = percentiles(catchments.withColumn("area", F.col("outlet_key")), ["area"], "pct_imperv", 0.5, "median")
    x = x.join(slopes, "area").withColumn("slope_pct", F.col("median") / 20)
    x = x.select("*", (a % 6 == 0).alias("corridor"), (a % 4 == 0).alias("streets"), (a % 7 != 0).alias("has_dem"), (a % 11 != 0).alias("overlaps"), F.when(a % 2 == 0, 1.0).otherwise(4.0).alias("gate_pct"), F.when(a % 13 != 0, F.col("n")).otherwise(0).alias("n_cells"))
    return checks.delineation_decisions(x).select("area", "decision")


COVER = """c AS (SELECT aoi_id, cell, ix, iy FROM v_offer WHERE (ix + iy * 3) % 41 <> 0 UNION ALL SELECT aoi_id, 900 + aoi_id, 60 + ix, iy FROM v_offer WHERE ix < 3 AND iy < 4 AND aoi_id % 2 = 0),
a AS (SELECT aoi_id, ix, iy FROM v_offer WHERE ix < 49 - aoi_id % 3 * 5)"""


def _covered(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    aoi = F.col("aoi_id")
    cells = px.where("(ix + iy * 3) % 41 <> 0").select("aoi_id", "cell", "ix", "iy").union(px.where("ix < 3 and iy < 4 and aoi_id % 2 = 0").select("aoi_id", 900 + aoi, 60 + F.col("ix"), "iy"))
    return cells, px.where(F.col("ix") < 49 - aoi % 3 * 5).select("aoi_id", "ix", "iy")


@query("a19_containment", "v_offer", sql=f"""WITH {COVER}, x AS (SELECT c.*, a.ix IS NULL AS outside FROM c LEFT JOIN a USING (aoi_id, ix, iy)),
b AS (SELECT aoi_id, count(*) FILTER (WHERE bad) AS n_mostly_outside FROM (SELECT aoi_id, cell, count(*) FILTER (WHERE outside) > 0.5 * count(*) AS bad FROM x GROUP BY ALL) GROUP BY 1),
f AS (SELECT aoi_id, count(*) FILTER (WHERE outside) / count(*)::DOUBLE AS outside_fraction FROM (SELECT DISTINCT aoi_id, ix, iy, outside FROM x) GROUP BY 1)
SELECT aoi_id, n_mostly_outside, round(outside_fraction, 6) AS outside_fraction, CASE WHEN n_mostly_outside > 0 THEN 'error' WHEN outside_fraction > 0.02 THEN 'warning' ELSE 'ok' END AS verdict FROM b JOIN f USING (aoi_id)""")
def a19_containment(px: DataFrame) -> DataFrame:
    """Cells that lie mostly outside their area, and the share of all covered land that does."""
    return checks.containment(*_covered(px)).withColumn("outside_fraction", F.round("outside_fraction", 6))


@query("a19_node_coverage", "v_offer", "v_node", sql=f"""WITH {COVER}, n AS (SELECT aoi_id, node_key, node_key * 7 % 60 AS ix, node_key * 11 % 50 AS iy FROM v_node)
SELECT n.aoi_id, count(*) AS n_nodes, count(a.ix) AS n_in_area, count(*) FILTER (WHERE a.ix IS NOT NULL AND c.ix IS NULL) AS n_uncovered FROM n LEFT JOIN a USING (aoi_id, ix, iy) LEFT JOIN (SELECT DISTINCT aoi_id, ix, iy FROM c) c USING (aoi_id, ix, iy) GROUP BY 1""")
def a19_nodes(px: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes on an area's land that no cell covers; nodes beyond it are not judged."""
    at = nodes.select("aoi_id", "node_key", (F.col("node_key") * 7 % 60).alias("ix"), (F.col("node_key") * 11 % 50).alias("iy"))
    return checks.node_coverage(at, *_covered(px))
