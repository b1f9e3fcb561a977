"""Queries over sources, stores and export tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwork import constants as k
from catchwork.frames import new_path, ranked
from catchwork.operators import grid, ingest
from catchwork.plans.checks import rises
from catchwork.plans.registry import query
from catchwork.sources import features as src


@query("s01_feature_scan", "v_node", sql="SELECT node AS name, round(lon, 6) AS x, round(lat, 6) AS y, CASE WHEN node_key % 2 = 0 THEN 'Point' END AS kind FROM v_node")
def s01(nodes: DataFrame) -> DataFrame:
    """Pages of both feature dialects, one for each area, read back as rows."""
    geo = F.struct(F.create_map(F.lit("name"), F.col("node")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"))
    esri = F.struct(F.create_map(F.lit("name"), F.col("node")).alias("attributes"), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("geometry"))
    item = F.when(F.col("node_key") % 2 == 0, F.to_json(geo)).otherwise(F.to_json(esri))
    page = nodes.select(F.floor(F.col("node_key") / 20).alias("page"), item.alias("item")).groupBy("page").agg(F.concat(F.lit('{"features":['), F.array_join(F.collect_list("item"), ","), F.lit("]}")).alias("value"))  # 20 features a page
    return src.features(page).select(F.col("props")["name"].alias("name"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "kind")


@query("s01_polygon_scan", "v_lot", sql="SELECT n_nationkey AS lot, CASE n_nationkey % 3 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'MultiPolygon' ELSE 'rings' END AS kind, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 2 END AS n_rings, round(0.75::DOUBLE * (n_nationkey % 50 + 2) * (n_nationkey % 50 + 2), 6) AS area FROM v_lot")
def s01_polygons(lots: DataFrame) -> DataFrame:
    """Polygons of both feature dialects, of one or two rings, read back; the area of the first ring."""
    s = (F.col("n_nationkey") % 50 + 2).cast("double")
    pt = lambda x, y: F.array(x, y)
    z, half = s * 0.0, s / 2
    ring = F.array(pt(z, z), pt(s, z), pt(s, half), pt(half, half), pt(half, s), pt(z, s), pt(z, z))
    small = F.array(pt(z, z), pt(z + 0.1, z), pt(z, z + 0.1), pt(z, z))
    name = F.create_map(F.lit("lot"), F.col("n_nationkey").cast("string"))
    one = F.to_json(F.struct(name.alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry")))
    two = F.to_json(F.struct(name.alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring), F.array(small)).alias("coordinates")).alias("geometry")))
    esri = F.to_json(F.struct(name.alias("attributes"), F.struct(F.array(ring, small).alias("rings")).alias("geometry")))
    item = F.when(F.col("n_nationkey") % 3 == 0, one).when(F.col("n_nationkey") % 3 == 1, two).otherwise(esri)
    page = lots.select(F.floor(F.col("n_nationkey") / 20).alias("page"), item.alias("item")).groupBy("page").agg(F.concat(F.lit('{"features":['), F.array_join(F.collect_list("item"), ","), F.lit("]}")).alias("value"))  # 20 features a page
    first = F.transform(F.get("rings", 0), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return src.features(page).select(F.col("props")["lot"].cast("long").alias("lot"), "kind", F.size("rings").alias("n_rings"), F.round(F.abs(grid.ring_area(first)), 6).alias("area"))


@query("s02_line_ends", "v_tree", sql="SELECT name, CASE WHEN from_key % 6 <> 0 THEN from_key::DOUBLE END AS ax, CASE WHEN from_key % 6 <> 0 THEN to_key::DOUBLE END AS bx FROM v_tree")
def s02(tree: DataFrame) -> DataFrame:
    """Ends of lines of one or several parts; a line of one point has none."""
    p = lambda c: F.array(F.col(c).cast("double"), F.lit(1.0), F.lit(9.0))
    one, two = F.array(p("from_key"), p("to_key")), F.array(F.array(p("from_key"), p("from_key")), F.array(p("to_key"), p("to_key")))
    k6 = F.col("from_key") % 6
    line = F.when(k6 == 0, F.array(p("from_key"))).when(k6 == 1, F.flatten(two)).otherwise(one)
    a, b = src.line_ends(F.col("line"))
    return tree.withColumn("line", line).select("name", a["x"].alias("ax"), b["x"].alias("bx"))


@query("s07_idf_texts", "v_idf", sql="SELECT 'station' || station_key AS path, CAST(y AS INT) AS years, duration_min, round(mm_h * f, 2) AS mm_h FROM v_idf, (VALUES (2, 1.0::DOUBLE), (5, 1.5::DOUBLE)) AS v(y, f) WHERE round(mm_h * f, 2) > 0")
def s07(idf: DataFrame) -> DataFrame:
    """Station texts, one for each station, read into a long table."""
    n = F.col("duration_min")
    head = F.when(n >= 120, F.concat((n / 60).cast("int").cast("string"), F.lit(" h"))).otherwise(F.concat(n.cast("string"), F.lit(" min")))
    row = F.concat(head, *(x for f in (1.0, 1.5) for x in (F.lit("   "), F.round(F.col("mm_h") * f, 2).cast("string"))), F.lit("   -99.9"))
    text = F.concat_ws("\n", F.lit("Table 2b"), F.array_join(F.collect_list(row), "\n"), F.lit("5 min +/- 1.0 1.0"))
    files = idf.groupBy("station_key").agg(text.alias("value")).select(F.concat(F.lit("station"), F.col("station_key").cast("string")).alias("path"), "value")
    return src.idf_tables(files)


@query("s07_idf_coefficients", "v_idf", sql="SELECT 'station' || station_key AS path, CAST(y AS INT) AS years, round(max(mm_h) * f, 2) AS a, -0.65::DOUBLE AS b FROM v_idf, (VALUES (2, 1.0::DOUBLE), (5, 1.5::DOUBLE), (10, 2.0::DOUBLE), (25, 2.5::DOUBLE), (50, 3.0::DOUBLE), (100, 3.5::DOUBLE)) AS v(y, f) GROUP BY station_key, y, f")
def s07_coefficients(idf: DataFrame) -> DataFrame:
    """The coefficients of station texts."""
    top = F.max("mm_h")
    a = F.concat_ws("  ", F.lit("Coefficient (A)"), *(F.round(top * f, 2).cast("string") for f in (1.0, 1.5, 2.0, 2.5, 3.0, 3.5)))
    b = F.concat_ws("  ", F.lit("Exponent    (B)"), *(F.lit("-0.65"),) * 6)
    files = idf.groupBy("station_key").agg(F.concat_ws("\n", F.lit("Table 3 : Interpolation Equation R = A*T^B"), F.lit("Mean of RR 1.0 2.0"), a, b).alias("value"))
    return src.idf_coefficients(files.select(F.concat(F.lit("station"), F.col("station_key").cast("string")).alias("path"), "value"))


@query("s20_idf_index", "v_station", sql="SELECT station_key, name, province, lat, lon FROM v_station")
def s20(stations: DataFrame) -> DataFrame:
    """The station index as CSV with a schema, written and read."""
    path = new_path(stations.sparkSession, "idf_index")
    stations.select("station_key", "name", "province", "lat", "lon").write.option("header", True).csv(path)
    return stations.sparkSession.read.schema("station_key long, name string, province string, lat double, lon double").option("header", True).csv(path)


@query("s11_store_round_trip", "v_node", "v_catchment", sql="SELECT aoi_id, node_key, node, rim_m, 'storm_minor' AS system FROM v_node")
def s11(nodes: DataFrame, catchments: DataFrame) -> DataFrame:
    """Tables written by area and read with a schema; a column that the store lacks gets its default."""
    folder = new_path(nodes.sparkSession, "store")
    src.write_store({"nodes": nodes.select("aoi_id", "node_key", "node", "rim_m"), "catchments": catchments.withColumn("aoi_id", F.col("outlet_key") % 5)}, folder)
    return src.read_store(nodes.sparkSession, folder, "nodes", "node_key long, node string, rim_m double, system string, aoi_id long", {"system": "storm_minor"}).select("aoi_id", "node_key", "node", "rim_m", "system")


@query("s11_store_settings", "v_catchment", sql="SELECT 'catchments' AS name, outlet_key % 5 AS aoi_id, count(*)::VARCHAR AS value FROM v_catchment GROUP BY 2 UNION ALL SELECT v.name, NULL, v.value FROM (VALUES ('config.infiltration', 'horton'), ('provenance.source', 'published')) v(name, value)")
def s11_settings(catchments: DataFrame) -> DataFrame:
    """A store's catchments, counted, with its configuration and provenance; the build folder is no part of it."""
    spark, folder = catchments.sparkSession, new_path(catchments.sparkSession, "store")
    src.write_store({"catchments": catchments.withColumn("aoi_id", F.col("outlet_key") % 5)}, folder, {"infiltration": "horton", "out_dir": folder}, {"source": "published"})
    back = src.read_store(spark, folder, "catchments", "cell_key long, name string, outlet_key long, area_ha double, pct_imperv double, aoi_id long")
    rows = back.groupBy("aoi_id").agg(F.count("*").cast("string").alias("value")).select(F.lit("catchments").alias("name"), "aoi_id", "value")
    settings = src.store_settings(spark, folder)
    return rows.unionByName(settings.select(F.concat_ws(".", "part", "name").alias("name"), F.lit(None).cast("long").alias("aoi_id"), "value"))


@query("s12_store_pruned_read", "v_node", "v_catchment", sql="SELECT outlet_key % 5 AS aoi_id, cell_key, area_ha FROM v_catchment WHERE outlet_key % 5 = 2")
def s12(nodes: DataFrame, catchments: DataFrame) -> DataFrame:
    """One area of a store: the partition column prunes the scan."""
    folder = new_path(nodes.sparkSession, "store")
    src.write_store({"catchments": catchments.withColumn("aoi_id", F.col("outlet_key") % 5)}, folder)
    return src.read_store(nodes.sparkSession, folder, "catchments", "cell_key long, area_ha double, aoi_id long").where("aoi_id = 2").select("aoi_id", "cell_key", "area_ha")


@query("s13_forcing_sink", "v_obs_hourly", "v_flow_obs", sql="""SELECT 'rain' AS variable, 'mm' AS unit, 'precipitation depth per interval' AS long_name, 'observed' AS provenance, count(precip_raw) AS n, min(ts) AS first_ts FROM v_obs_hourly WHERE precip_raw IS NOT NULL
UNION ALL SELECT 'flow', 'm3/s', 'observed discharge', 'observed', count(*), min(day)::TIMESTAMP FROM v_flow_obs
UNION ALL SELECT 'temperature', 'degC', 'daily mean air temperature', 'observed', count(*), min(day)::TIMESTAMP FROM v_flow_obs WHERE extract(month FROM day) <> 2
UNION ALL SELECT 'evaporation', 'mm/day', 'potential evaporation', 'computed from temperature', count(*), min(day)::TIMESTAMP FROM v_flow_obs WHERE extract(month FROM day) <> 2
UNION ALL SELECT 'tide', 'm', 'predicted water level', 'predicted', count(*), min(day)::TIMESTAMP FROM v_flow_obs WHERE extract(day FROM day) = 1""")
def s13(obs: DataFrame, flows: DataFrame) -> DataFrame:
    """Series on their own axes in one long table with units, names and provenance, written and read."""
    day, winter = F.col("day").cast("timestamp_ntz"), F.month("day") != 2
    series = {
        "rain": (obs.where("precip_raw is not null").select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("precip_raw").alias("value")), "observed"),
        "flow": (flows.select(day.alias("ts"), F.col("obs_cms").alias("value")), "observed"),
        "temperature": (flows.where(winter).select(day.alias("ts"), (F.col("obs_cms") / 10).alias("value")), "observed"),
        "evaporation": (flows.where(winter).select(day.alias("ts"), (F.col("obs_cms") / 100).alias("value")), "computed from temperature"),
        "tide": (flows.where(F.dayofmonth("day") == 1).select(day.alias("ts"), (F.col("obs_cms") / 50).alias("value")), "predicted"),
    }
    path = new_path(obs.sparkSession, "forcing")
    src.write_forcing(series, path)
    x = obs.sparkSession.read.parquet(path)
    return x.groupBy("variable", "unit", "long_name", "provenance").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query("s14_rain_csv", "v_obs_hourly", sql="SELECT climate_id, strftime(ts, '%Y-%m-%d %H:%M') AS datetime, round(sum(precip_raw), 5) AS depth_mm FROM v_obs_hourly WHERE precip_raw IS NOT NULL GROUP BY 1, 2")
def s14(obs: DataFrame) -> DataFrame:
    """A folder of CSV files for each station, read back."""
    return _csv(obs.where("precip_raw is not null").groupBy("climate_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("datetime")).agg(F.round(F.sum("precip_raw"), 5).alias("depth_mm")), "datetime string, depth_mm double, climate_id string", "climate_id")


@query("s21_stage_csv", "v_flow_obs", sql="SELECT strftime(day, '%Y-%m-%d') AS datetime, round(obs_cms / 100, 3) AS level_m FROM v_flow_obs")
def s21(flows: DataFrame) -> DataFrame:
    return _csv(flows.select(F.date_format("day", "yyyy-MM-dd").alias("datetime"), F.round(F.col("obs_cms") / 100, 3).alias("level_m")), "datetime string, level_m double")


def _csv(df: DataFrame, schema: str, *by: str) -> DataFrame:
    """The series as CSV files in the order of time, one folder for each value of by, read back."""
    path = new_path(df.sparkSession, "series")
    df.orderBy(*by, "datetime").write.partitionBy(*by).option("header", True).csv(path)
    return df.sparkSession.read.schema(schema).option("header", True).csv(path)


@query("s15_map_preview", "v_node", "v_tree", "v_catchment", sql="""
SELECT CASE WHEN node_key % 10 = 0 THEN 'outfall' ELSE 'junction' END AS kind, node AS id, round(rim_m - 2, 2) AS value, NULL::VARCHAR AS node FROM v_node
UNION ALL SELECT 'conduit', t.name, round(t.length_m, 1), b.node FROM v_tree t JOIN v_node a ON a.node_key = t.from_key JOIN v_node b ON b.node_key = t.to_key
UNION ALL SELECT 'subcatchment', name, round(area_ha, 4), 'MH' || outlet_key FROM v_catchment WHERE cell_key % 3 <> 0""")
def s15(nodes: DataFrame, tree: DataFrame, catchments: DataFrame) -> DataFrame:
    """Preview features of all kinds, parsed back; a third of the catchments has no outline."""
    known = nodes.select("node_key", F.col("node").alias("name"), (F.col("rim_m") - 2).alias("invert_m"), F.lit(2.0).alias("max_depth_m"), F.lit("FREE").alias("outfall_type"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    ends = tree.join(known.select(F.col("node_key").alias("from_key"), F.col("name").alias("from_node")), "from_key", "left").join(known.select(F.col("node_key").alias("to_key"), F.col("name").alias("to_node")), "to_key", "left")
    lines = ends.select("name", "length_m", F.coalesce("from_node", F.lit("")).alias("from_node"), F.coalesce("to_node", F.lit("")).alias("to_node"))
    outline = F.when(F.col("cell_key") % 3 != 0, F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.col("area_ha").alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y"))))
    land = catchments.select("name", "area_ha", "pct_imperv", F.concat(F.lit("MH"), F.col("outlet_key").cast("string")).alias("outlet_node"), outline.alias("ring"))
    features = src.preview(known.where("node_key % 10 <> 0"), known.where("node_key % 10 = 0"), lines, land)
    p = features.select(F.from_json("feature", "properties struct<kind: string, id: string, invert_m: double, length_m: double, area_ha: double, to_node: string, outlet_node: string>").alias("f")).select("f.properties.*")
    return p.select("kind", "id", F.coalesce("invert_m", "length_m", "area_ha").alias("value"), F.coalesce("to_node", "outlet_node").alias("node"))


@query("s16_package_checksums", "v_layer", sql="SELECT city_key, sha256(array_to_string(list(layer_id::VARCHAR ORDER BY layer_id), ',') || chr(10)) AS sha256, sum(strlen(layer_id::VARCHAR) + 1)::BIGINT AS size FROM v_layer GROUP BY 1")
def s16(layers: DataFrame) -> DataFrame:
    """One text file for each city, then the checksum and size of each file as stored."""
    spark, path = layers.sparkSession, new_path(layers.sparkSession, "package")
    text = layers.groupBy("city_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("layer_id")), lambda x: x.cast("string")), ",").alias("value"))  # a city's member list
    text.write.partitionBy("city_key").text(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    return files.select(F.regexp_extract("path", r"city_key=(\d+)", 1).cast("long").alias("city_key"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


REQUIRED = ("model", "nodes", "conduits", "catchments", "forcing", "manifest")


@query("s17_required_members", "orders", sql="WITH p AS (SELECT DISTINCT o_custkey AS package FROM orders), h AS (SELECT DISTINCT o_custkey AS package, ['model', 'nodes', 'conduits', 'catchments', 'forcing', 'manifest'][1 + o_orderkey % 6] AS member FROM orders), r AS (SELECT unnest(['model', 'nodes', 'conduits', 'catchments', 'forcing', 'manifest']) AS member) SELECT package, member FROM p, r WHERE (package, member) NOT IN (SELECT (package, member) FROM h)")
def s17(orders: DataFrame) -> DataFrame:
    """Members that packages should have and lack."""
    have = orders.select(F.col("o_custkey").alias("package"), F.get(F.array(*map(F.lit, REQUIRED)), (F.col("o_orderkey") % 6).cast("int")).alias("member")).distinct()
    want = orders.select(F.col("o_custkey").alias("package")).distinct().withColumn("member", F.explode(F.array(*map(F.lit, REQUIRED))))
    return want.join(have, ["package", "member"], "left_anti")


@query("p21_section_tables", "v_node", "v_tree", sql="SELECT 'JUNCTIONS' AS section, node AS name, round(rim_m, 3) AS value FROM v_node WHERE node_key % 10 <> 0 UNION ALL SELECT 'OUTFALLS', node || CASE WHEN node_key % 20 = 0 THEN ' TIMESERIES' ELSE ' FREE' END, round(rim_m, 3) FROM v_node WHERE node_key % 10 = 0 UNION ALL SELECT 'CONDUITS', name, round(length_m, 3) FROM v_tree")
def p21(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """Rows by section; a tidal outfall without a series falls back to FREE."""
    tide = nodes.where("node_key % 20 = 0").select("node_key", F.lit("TIMESERIES").alias("kind"))
    j = nodes.where("node_key % 10 <> 0").select(F.lit("JUNCTIONS").alias("section"), F.col("node").alias("name"), F.round("rim_m", 3).alias("value"))
    o = nodes.where("node_key % 10 = 0").join(tide, "node_key", "left").select(F.lit("OUTFALLS").alias("section"), F.concat_ws(" ", "node", F.coalesce("kind", F.lit("FREE"))).alias("name"), F.round("rim_m", 3).alias("value"))
    return j.unionByName(o).unionByName(tree.select(F.lit("CONDUITS").alias("section"), "name", F.round("length_m", 3).alias("value")))


@query("p22_export_conduits", "v_raw_pipe", "v_node", sql="SELECT p.file_seq, u.node AS us_node, d.node AS ds_node, substr('123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(least(35, row_number() OVER (PARTITION BY p.up_key, p.dn_key ORDER BY p.file_seq)) AS INT), 1) AS suffix, CAST(p.diameter_mm AS DOUBLE) AS width_mm, round(u.rim_m - 2, 4) AS us_invert, round(d.rim_m - 2, 4) AS ds_invert FROM v_raw_pipe p JOIN v_node u ON u.node_key = p.up_key JOIN v_node d ON d.node_key = p.dn_key")
def p22(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    u, d = (nodes.select(F.col("node_key").alias(c), F.col("node").alias(f"{s}_node"), F.round(F.col("rim_m") - 2, 4).alias(f"{s}_invert")) for c, s in (("up_key", "us"), ("dn_key", "ds")))
    x = ranked(pipes.select("file_seq", "up_key", "dn_key", "diameter_mm"), [F.col("up_key"), F.col("dn_key")], ["file_seq"], "n")
    x = x.join(u, "up_key").join(d, "dn_key").withColumn("n", F.least("n", F.lit(35)).cast("int"))
    return x.select("file_seq", "us_node", "ds_node", F.substring(F.lit("123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col("n"), F.lit(1)).alias("suffix"), F.col("diameter_mm").cast("double").alias("width_mm"), "us_invert", "ds_invert")


@query("p23_export_catchments", "v_catchment", "v_node", sql="SELECT name, round(sqrt(area_ha * 10000 / pi()), 6) AS dimension_m, round(pct_imperv / 100, 6) AS slope, 100 - pct_imperv AS pervious FROM v_catchment WHERE outlet_key IN (SELECT node_key FROM v_node WHERE node_key % 7 <> 0)")
def p23(catchments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Equal-area radius, slope in m/m and pervious share; rows that drain outside the view go."""
    view = nodes.where("node_key % 7 <> 0").select(F.col("node_key").alias("outlet_key"))
    return catchments.join(view, "outlet_key", "left_semi").select("name", F.round(F.sqrt(F.col("area_ha") * 10000 / F.pi()), 6).alias("dimension_m"), F.round(F.col("pct_imperv") / 100, 6).alias("slope"), (100 - F.col("pct_imperv")).alias("pervious"))


@query("p24_export_links", "v_tree", sql="SELECT name, CASE WHEN from_key % 9 = 0 THEN 75 ELSE 1 / 0.013::DOUBLE END AS manning_m, from_key % 9 = 0 AS defaulted, round(5.7::DOUBLE / 3.6e6, 12) AS ksat_ms FROM v_tree")
def p24(tree: DataFrame) -> DataFrame:
    """Manning's M as 1/n; an n of 0 or less takes a stated default and is marked."""
    n = F.when(F.col("from_key") % 9 == 0, 0.0).otherwise(k.DEFAULT_N)
    return tree.select("name", F.when(n > 0, 1 / F.nullif(n, F.lit(0.0))).otherwise(75.0).alias("manning_m"), (n <= 0).alias("defaulted"), F.round(F.lit(k.HORTON["B"][1]) / 3.6e6, 12).alias("ksat_ms"))


@query("p25_node_supplement", "v_node", "v_catchment", "v_px", sql="""WITH d AS (SELECT n.*, p.z_m AS dem FROM v_node n LEFT JOIN v_px p ON p.aoi_id = n.aoi_id AND p.ix = n.node_key % 60 AND p.iy = n.node_key // 10 % 50), c AS (SELECT outlet_key, count(*) AS n, sum(area_ha) AS a FROM v_catchment GROUP BY 1)
SELECT node, round(rim_m - dem, 3) AS rim_minus_dem_m, rim_m - 2 >= dem AS invert_ge_dem, coalesce(c.n, 0) AS n_catchments, round(coalesce(c.a, 0), 4)::DOUBLE AS drained_ha, coalesce(c.n, 0) > 0 AS drop_inlet FROM d LEFT JOIN c ON c.outlet_key = d.node_key""")
def p25(nodes: DataFrame, catchments: DataFrame, px: DataFrame) -> DataFrame:
    """Rim, difference to terrain, drained area and drop-inlet flag for each node."""
    at = nodes.withColumn("aoi", F.col("aoi_id")).withColumn("ix", F.col("node_key") % 60).withColumn("iy", F.floor(F.col("node_key") / 10) % 50)
    dem = px.select(F.col("aoi_id").alias("aoi"), "ix", "iy", F.col("z_m").alias("dem"))
    c = catchments.groupBy(F.col("outlet_key").alias("node_key")).agg(F.count("*").alias("n"), F.sum("area_ha").alias("a"))
    x = at.join(dem, ["aoi", "ix", "iy"], "left").join(c, "node_key", "left")
    n = F.coalesce("n", F.lit(0))
    return x.select("node", F.round(F.col("rim_m") - F.col("dem"), 3).alias("rim_minus_dem_m"), (F.col("rim_m") - 2 >= F.col("dem")).alias("invert_ge_dem"), n.alias("n_catchments"), F.round(F.coalesce("a", F.lit(0.0)), 4).alias("drained_ha"), (n > 0).alias("drop_inlet"))


@query("p26_boundary_conditions", "v_raw_pipe", "v_node", sql="""WITH r AS (SELECT p.dn_key, max((u.rim_m - d.rim_m) / CAST(p.diameter_mm AS DOUBLE)) AS s FROM v_raw_pipe p JOIN v_node u ON u.node_key = p.up_key JOIN v_node d ON d.node_key = p.dn_key GROUP BY 1)
SELECT n.node, CASE n.node_key % 3 WHEN 0 THEN 'Stage Hydrograph' ELSE 'Normal Depth' END AS suggestion, round(greatest(0.001, coalesce(r.s, 0)), 5)::DOUBLE AS slope FROM v_node n LEFT JOIN r ON r.dn_key = n.node_key WHERE n.node_key % 5 = 0""")
def p26(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    """What to set at each outfall: a stage where there is one, else normal depth at the steepest incoming slope, 0.001 at least."""
    u, d = (nodes.select(F.col("node_key").alias(c), F.col("rim_m").alias(f"i_{c}")) for c in ("up_key", "dn_key"))
    s = pipes.join(u, "up_key").join(d, "dn_key").groupBy(F.col("dn_key").alias("node_key")).agg(F.max((F.col("i_up_key") - F.col("i_dn_key")) / F.col("diameter_mm").cast("double")).alias("s"))
    x = nodes.where("node_key % 5 = 0").join(s, "node_key", "left")
    return x.select("node", F.when(F.col("node_key") % 3 == 0, "Stage Hydrograph").otherwise("Normal Depth").alias("suggestion"), F.round(F.greatest(F.lit(0.001), F.coalesce("s", F.lit(0.0))), 5).alias("slope"))


@query("p27_lookup_tables", "v_px", sql="WITH c AS (SELECT DISTINCT landcover FROM v_px), g AS (SELECT unnest(['A', 'B', 'C', 'D']) AS g, unnest([1, 2, 3, 4]) AS i) SELECT CAST(landcover AS INT) AS landcover, g AS soil_group, (CASE " + " ".join(f"WHEN landcover = {code} THEN [{', '.join(str(k.CURVE_NUMBERS[cat][x]) for x in 'ABCD')}]" for code, cat in k.COVER_CATEGORY.items()) + " END)[i]::DOUBLE AS cn FROM c, g")
def p27(px: DataFrame) -> DataFrame:
    """Curve numbers of the classes that occur, for every soil group."""
    c = px.select(F.col("landcover").cast("int").alias("landcover")).distinct().withColumn("soil_group", F.explode(F.array(*map(F.lit, "ABCD"))))
    return c.withColumn("cn", grid.curve_number(c, [], F.col("soil_group")))


@query("p28_lossy_report", "v_tree", "v_catchment", sql="WITH s AS (SELECT system, bool_or(length_m > 480) AS special, bool_or(inv_from > 210) AS tide FROM v_tree GROUP BY 1) SELECT system, 'mapping' AS source, 'restructured' AS kind FROM s UNION ALL SELECT system, 'section shape', 'approximated' FROM s WHERE special UNION ALL SELECT system, 'tide series', 'dropped' FROM s WHERE tide")
def p28(tree: DataFrame, catchments: DataFrame) -> DataFrame:
    """What an export changes: fixed entries, and those that a model's contents call for."""
    s = tree.groupBy("system").agg(F.lit(True).alias("always"), F.bool_or(F.col("length_m") > 480).alias("special"), F.bool_or(F.col("inv_from") > 210).alias("tide"))
    rows = [("always", "mapping", "restructured"), ("special", "section shape", "approximated"), ("tide", "tide series", "dropped")]
    return reduce(DataFrame.unionByName, (s.where(flag).select("system", F.lit(a).alias("source"), F.lit(b).alias("kind")) for flag, a, b in rows))


@query("p37_tidal_outfalls", "v_node", "v_flow_obs", sql="SELECT node, CASE WHEN rim_m - 60 <= (SELECT max(obs_cms) / 100 FROM v_flow_obs) + 0.5 THEN 'TIMESERIES' ELSE 'FREE' END AS kind FROM v_node WHERE node_key % 5 = 0")
def p37(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """Outfalls at most half a metre above the highest level are tidal."""
    top = flows.agg((F.max("obs_cms") / 100 + 0.5).alias("top"))
    return nodes.where("node_key % 5 = 0").join(F.broadcast(top)).select("node", F.when(F.col("rim_m") - 60 <= F.col("top"), "TIMESERIES").otherwise("FREE").alias("kind"))


@query("p38_area_perimeter", "v_node", sql="SELECT aoi_id, CASE aoi_id % 3 WHEN 0 THEN 'polygon' WHEN 1 THEN 'box' ELSE 'envelope' END AS source, round(CASE WHEN aoi_id % 3 = 0 THEN -123.5 ELSE min(lon) END, 6)::DOUBLE AS west, round(CASE WHEN aoi_id % 3 = 0 THEN -123.0 ELSE max(lon) END, 6)::DOUBLE AS east FROM v_node GROUP BY 1")
def p38(nodes: DataFrame) -> DataFrame:
    """An area's outline: its polygon, else its box, else the envelope of its cells."""
    x = nodes.groupBy("aoi_id").agg(F.min("lon").alias("w"), F.max("lon").alias("e"))
    own = F.col("aoi_id") % 3 == 0
    return x.select("aoi_id", F.when(own, "polygon").when(F.col("aoi_id") % 3 == 1, "box").otherwise("envelope").alias("source"), F.round(F.when(own, -123.5).otherwise(F.col("w")), 6).alias("west"), F.round(F.when(own, -123.0).otherwise(F.col("e")), 6).alias("east"))


@query("p42_stand_in_squares", "v_catchment", sql="SELECT name, round(sqrt(area_ha * 10000), 4) AS side_m, cell_key % 3 = 0 AS stand_in FROM v_catchment")
def p42(catchments: DataFrame) -> DataFrame:
    """Catchments without an outline get a square of their area; its ring gives the side back."""
    half = F.sqrt(F.col("area_ha") * 10000) / 2
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(pt(-half, -half), pt(half, -half), pt(half, half), pt(-half, half), pt(-half, -half))
    return catchments.select("name", F.round(grid.ring_perimeter(ring) / 4, 4).alias("side_m"), (F.col("cell_key") % 3 == 0).alias("stand_in"))


@query("m22_rim_elevation", "v_node", "v_px", sql="SELECT n.node_key, round(n.rim_m - 2 + 2, 4) AS rim_m, round(n.rim_m - p.z_m, 4) AS above_dem_m FROM v_node n LEFT JOIN v_px p ON p.aoi_id = n.aoi_id AND p.ix = n.node_key % 60 AND p.iy = n.node_key // 10 % 50")
def m22(nodes: DataFrame, px: DataFrame) -> DataFrame:
    at = nodes.select("node_key", "rim_m", "aoi_id", (F.col("node_key") % 60).alias("ix"), (F.floor(F.col("node_key") / 10) % 50).alias("iy"))
    x = grid.sampled(at, px, "z_m")
    return x.select("node_key", F.round(F.col("rim_m") - 2 + 2, 4).alias("rim_m"), F.round(F.col("rim_m") - F.col("z_m"), 4).alias("above_dem_m"))


@query("j06_directional_inverts", "v_raw_pipe", "v_node", sql="""WITH b AS (SELECT p.file_seq, d.lon - u.lon AS dx, d.lat - u.lat AS dy, u.rim_m AS w FROM v_raw_pipe p JOIN v_node u ON u.node_key = p.up_key JOIN v_node d ON d.node_key = p.dn_key),
x AS (SELECT *, CASE WHEN dx <> 0 OR dy <> 0 THEN CAST(floor(((degrees(atan2(dx, dy)) + 360 + 45) % 360) / 90) AS INT) END AS wall FROM b),
y AS (SELECT *, [CASE WHEN file_seq % 2 = 0 THEN w - 1 END, w - 2, CASE WHEN file_seq % 3 = 0 THEN w - 3 END, w - 4] AS walls, CASE WHEN file_seq % 5 = 0 THEN w - 5 END AS centre FROM x)
SELECT file_seq, wall, round(coalesce(walls[wall + 1], centre, list_min(walls)), 4) AS invert_m FROM y""")
def j06(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The chamber wall that a pipe leaves by (its bearing within 45 degrees), else the centre, else the lowest wall."""
    from catchwork.functions import values as v

    p = ingest.resolved_ends(pipes, nodes).where("n_dangling = 0").join(nodes.select(F.col("node_key").alias("up_key"), F.col("rim_m").alias("w")), "up_key")
    angle = v.bearing(F.col("b_lon") - F.col("a_lon"), F.col("b_lat") - F.col("a_lat"))
    q, w = F.col("file_seq"), F.col("w")
    walls = F.array(F.when(q % 2 == 0, w - 1), w - 2, F.when(q % 3 == 0, w - 3), w - 4)
    x = p.withColumn("wall", F.floor(F.pmod(angle + 45, F.lit(360.0)) / 90).cast("int")).withColumn("walls", walls)
    return x.select("file_seq", "wall", F.round(F.coalesce(F.get("walls", F.col("wall")), F.when(q % 5 == 0, w - 5), F.array_min("walls")), 4).alias("invert_m"))


@query("j09_published_patches", "v_node", sql="SELECT node_key, CASE WHEN node_key % 8 = 0 THEN rim_m - 3 ELSE rim_m - 2 END AS invert_m, CASE WHEN node_key % 2 = 0 THEN 3.5 ELSE 2.0 END::DOUBLE AS depth_m FROM v_node")
def j09(nodes: DataFrame) -> DataFrame:
    """Published outfall inverts replace assembled ones; depths only where the default stands."""
    published = nodes.where("node_key % 8 = 0").select("node_key", (F.col("rim_m") - 3).alias("published"))
    depths = nodes.where("node_key % 2 = 0").select("node_key", F.lit(3.5).alias("d"))
    x = nodes.withColumn("depth", F.lit(k.DEFAULT_DEPTH_M)).join(published, "node_key", "left").join(depths, "node_key", "left")
    return x.select("node_key", F.coalesce("published", F.col("rim_m") - 2).alias("invert_m"), F.when(F.col("depth") == k.DEFAULT_DEPTH_M, F.coalesce("d", "depth")).otherwise(F.col("depth")).alias("depth_m"))


@query("a37_gap_fill_error", "v_raw_pipe", "v_node", sql="""WITH e AS (SELECT p.up_key AS n, p.dn_key AS o, nullif(p.inv_up, 0) AS i FROM v_raw_pipe p WHERE p.up_key <> p.dn_key UNION ALL SELECT dn_key, up_key, CASE WHEN inv_dn > -90 THEN inv_dn END FROM v_raw_pipe WHERE up_key <> dn_key),
t AS (SELECT n, min(i) AS truth FROM e GROUP BY 1), s AS (SELECT n, CASE WHEN n % 7 <> 3 THEN truth END AS kept FROM t),
f AS (SELECT e.n, min(s.kept) AS near FROM e JOIN s ON s.n = e.o GROUP BY 1)
SELECT v.aoi_id, count(*) AS n_hidden, round(avg(abs(f.near - t.truth)), 4) AS mae_m FROM t JOIN f USING (n) JOIN v_node v ON v.node_key = t.n WHERE t.n % 7 = 3 AND t.truth IS NOT NULL AND f.near IS NOT NULL GROUP BY 1""")
def a37(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Typical error of filled inverts: a seventh of the known ones is hidden, refilled from neighbours and compared."""
    p = pipes.where("up_key <> dn_key")
    up, dn = F.nullif("inv_up", F.lit(0.0)), F.when(F.col("inv_dn") > -90, F.col("inv_dn"))
    e = p.select(F.col("up_key").alias("n"), F.col("dn_key").alias("o"), up.alias("i")).union(p.select("dn_key", "up_key", dn))
    truth = e.groupBy("n").agg(F.min("i").alias("truth"))
    kept = truth.where("n % 7 <> 3").select(F.col("n").alias("o"), F.col("truth").alias("kept"))
    near = e.select("n", "o").distinct().join(kept, "o").groupBy("n").agg(F.min("kept").alias("near"))
    x = truth.where("n % 7 = 3 and truth is not null").join(near, "n").where("near is not null").join(nodes.select(F.col("node_key").alias("n"), "aoi_id"), "n")
    return x.groupBy("aoi_id").agg(F.count("*").alias("n_hidden"), F.round(F.avg(F.abs(F.col("near") - F.col("truth"))), 4).alias("mae_m"))


@query("t05_greedy_spacing", "v_px")
def t05(px: DataFrame) -> DataFrame:
    x = px.select("aoi_id", grid.pixel_id(F.col("ix"), F.col("iy"), F.lit(0)).alias("key"), F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), F.col("z_m").alias("z"))
    return grid.spaced(x, 9.0).select("aoi_id", "key")


@query("n13_sink_choice", "v_px")
def n13(px: DataFrame) -> DataFrame:
    """Sinks near water, which is class 18."""
    return grid.sinks(px, F.col("landcover") == 18, 3.0, 12.0)


SEG = "m AS (SELECT node_key, radians(lon + 123.4) * 6371000 * cos(radians(48.4)) AS x, radians(lat - 48.4) * 6371000 AS y FROM v_node), g AS (SELECT t.name, t.from_key, t.to_key, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM v_tree t JOIN m a ON a.node_key = t.from_key JOIN m b ON b.node_key = t.to_key)"
PTS = "p AS (SELECT cell_key, radians((cell_key % 10) * 1e-3 + (cell_key % 7) * 1e-5) * 6371000 * cos(radians(48.4)) AS x, radians(cell_key % 40 * 1e-3 + (cell_key % 3) * 1e-5) * 6371000 AS y FROM v_catchment)"


@query("j14_nearest_conduit_end", "v_tree", "v_node", "v_catchment", sql=f"""WITH {SEG}, {PTS}, t AS (SELECT p.cell_key, p.x, p.y, g.*, coalesce(greatest(0, least(1, ((p.x - ax) * (bx - ax) + (p.y - ay) * (b_y - ay)) / nullif((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay), 0))), 0) AS u
  FROM p JOIN g ON p.x BETWEEN least(ax, bx) - 200 AND greatest(ax, bx) + 200 AND p.y BETWEEN least(ay, b_y) - 200 AND greatest(ay, b_y) + 200),
d AS (SELECT cell_key, name, round(sqrt(pow(x - ax - u * (bx - ax), 2) + pow(y - ay - u * (b_y - ay), 2)), 6) AS dist,
  CASE WHEN sqrt(pow(x - ax, 2) + pow(y - ay, 2)) <= sqrt(pow(x - bx, 2) + pow(y - b_y, 2)) THEN from_key ELSE to_key END AS near FROM t),
c AS (SELECT cell_key, arg_min(name, (dist, name)) AS conduit, arg_min(near, (dist, name)) AS node_key, min(dist) AS dist FROM d WHERE dist <= 200 GROUP BY 1),
n AS (SELECT p.cell_key, arg_min(m.node_key, (round(sqrt(pow(p.x - m.x, 2) + pow(p.y - m.y, 2)), 6), m.node_key)) AS node_key, min(sqrt(pow(p.x - m.x, 2) + pow(p.y - m.y, 2))) AS dist FROM p, m WHERE p.cell_key NOT IN (SELECT cell_key FROM c) GROUP BY 1)
SELECT p.cell_key, c.conduit, coalesce(c.node_key, n.node_key) AS node_key, round(coalesce(c.dist, n.dist), 2) AS distance, CASE WHEN c.cell_key IS NOT NULL THEN 'conduit' ELSE 'node' END AS "by" FROM p LEFT JOIN c USING (cell_key) LEFT JOIN n USING (cell_key)""")
def j14(tree: DataFrame, nodes: DataFrame, catchments: DataFrame) -> DataFrame:
    """Each catchment's outlet: the nearer end of its nearest conduit within 200 m, else the nearest node."""
    x, y = grid.metric(F.col("lon"), F.col("lat"), F.lit(-123.4), F.lit(48.4))
    m = nodes.select("node_key", x.alias("x"), y.alias("y"))
    a, b = (m.select(F.col("node_key").alias(c), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y")) for c, s in (("from_key", "a"), ("to_key", "b")))
    g = tree.join(a, "from_key").join(b, "to_key").select("name", F.col("from_key").alias("a_key"), "ax", "ay", F.col("to_key").alias("b_key"), "bx", "by")
    c = F.col("cell_key")
    px_, py_ = grid.metric((c % 10) * 1e-3 + (c % 7) * 1e-5, (c % 40) * 1e-3 + (c % 3) * 1e-5, F.lit(0.0), F.lit(0.0))
    p = catchments.select("cell_key", (px_ * F.cos(F.radians(F.lit(48.4)))).alias("x"), py_.alias("y"))
    seeds = m.select(F.col("node_key").alias("seed_key"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    return grid.by_place(p, lambda q: grid.resolved_outlets(q, g, seeds, 200.0, "cell_key"), "cell_key").withColumn("distance", F.round("distance", 2))


@query("j17_street_sample_labels", "v_tree", sql="""WITH st AS (SELECT name, from_key, to_key, CASE WHEN from_key % 3 <> 0 THEN (from_key % 5) / 4.0::DOUBLE END AS crest, greatest(2, CAST(floor(length_m / 10) AS BIGINT)) AS n FROM v_tree),
s AS (SELECT *, unnest(range(0, n + 1)) AS i FROM st), i AS (SELECT name, (from_key * 7 % 10) / 10.0::DOUBLE AS t, from_key * 10 + 5 AS node_key FROM v_tree WHERE from_key % 4 <> 0),
x AS (SELECT s.*, s.i / s.n::DOUBLE AS t, i.t AS it, i.node_key AS ik FROM s LEFT JOIN i USING (name))
SELECT name, round(t, 6) AS t, CASE WHEN crest IS NULL THEN CASE WHEN t <= 0.5 THEN from_key ELSE to_key END WHEN t < crest THEN CASE WHEN it <= t THEN ik ELSE from_key END ELSE CASE WHEN it >= t THEN ik ELSE to_key END END AS node_key FROM x""")
def j17(tree: DataFrame) -> DataFrame:
    """Samples of each street every 10 m, labelled by its crest, its inlet or its nearer end."""
    key = F.col("from_key")
    streets = tree.select("name", F.when(key % 3 != 0, (key % 5) / 4.0).alias("crest"), key.alias("a_key"), F.col("to_key").alias("b_key"))
    n = F.greatest(F.lit(2).cast("long"), F.floor(F.col("length_m") / 10))
    samples = tree.withColumn("n", n).select("name", "n", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("i")).select("name", (F.col("i") / F.col("n")).alias("t"))
    inlets = tree.where("from_key % 4 <> 0").select("name", (key * 7 % 10 / 10.0).alias("t"), (key * 10 + 5).alias("node_key"))
    return grid.street_labels(samples, streets, inlets).withColumn("t", F.round("t", 6))


@query("p_rises_of_conduits", "v_raw_pipe", "v_node", sql="SELECT p.file_seq, round(d.rim_m - u.rim_m, 4) AS rise FROM v_raw_pipe p JOIN v_node u ON u.node_key = p.up_key JOIN v_node d ON d.node_key = p.dn_key")
def p_rises(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    return rises(pipes, nodes).select("file_seq", F.round("rise", 4).alias("rise"))
