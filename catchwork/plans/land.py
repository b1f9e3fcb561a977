"""Queries over pixels, points and rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwork import constants as k
from catchwork.frames import ranked
from catchwork.operators import flow
from catchwork.operators import grid as op
from catchwork.operators.quantiles import percentiles
from catchwork.plans.registry import query

CELL = "aoi_id, ix // 10 + 10 * (iy // 10) AS cell"
ZONE = f"z AS (SELECT {CELL}, ix, iy, z_m, landcover, hsg_code FROM v_px)"
ZONES = ["aoi_id", "cell"]
IMPERV = "CASE landcover WHEN 9 THEN 0.02 WHEN 10 THEN 0.02 WHEN 13 THEN 0.05 WHEN 15 THEN 0.02 WHEN 16 THEN 0.05 WHEN 17 THEN 0.7 ELSE 0 END::DOUBLE"


def _zones(px: DataFrame) -> DataFrame:
    return px.withColumn("cell", F.floor(F.col("ix") / 10) + 10 * F.floor(F.col("iy") / 10))


@query("s10_pixel_scan", "v_px", sql="SELECT aoi_id, ix, iy, nullif(landcover, 18) AS landcover FROM v_px WHERE ix BETWEEN 10 AND 29 AND iy BETWEEN 5 AND 40")
def s10(px: DataFrame) -> DataFrame:
    return px.where("ix between 10 and 29 and iy between 5 and 40").select("aoi_id", "ix", "iy", F.nullif("landcover", F.lit(18)).alias("landcover"))


@query("a08_zonal_imperviousness", "v_px", sql=f"WITH {ZONE} SELECT aoi_id, cell, round(100 * avg({IMPERV}), 6) AS pct_imperv FROM z GROUP BY ALL")
def a08(px: DataFrame) -> DataFrame:
    return op.impervious_pct(_zones(px), ZONES).withColumn("pct_imperv", F.round("pct_imperv", 6))


MAJOR = "n AS (SELECT aoi_id, cell, hsg_code, count(*) AS n FROM z WHERE hsg_code IN (1, 2, 3, 4) GROUP BY ALL), m AS (SELECT aoi_id, cell, hsg_code, n FROM (SELECT *, row_number() OVER (PARTITION BY aoi_id, cell ORDER BY n DESC, hsg_code) AS r FROM n) WHERE r = 1)"


@query("a09_zonal_majority", "v_px", sql=f"WITH {ZONE}, {MAJOR} SELECT aoi_id, cell, hsg_code, n FROM m")
def a09(px: DataFrame) -> DataFrame:
    return op.majority(_zones(px), ZONES, "hsg_code", F.col("hsg_code").isin(*k.GROUP_CODES))


CAT = "CASE WHEN landcover <= 6 THEN 'forest' WHEN landcover IN (7, 8, 11) THEN 'shrub' WHEN landcover IN (9, 10, 12) THEN 'grass' WHEN landcover IN (13, 16, 19) THEN 'barren' WHEN landcover = 14 THEN 'wetland' WHEN landcover = 15 THEN 'crop' WHEN landcover = 17 THEN 'built' ELSE 'water' END"
CN = f"CASE {CAT} " + " ".join(f"WHEN '{c}' THEN [{', '.join(str(row[g]) for g in 'ABCD')}]" for c, row in k.CURVE_NUMBERS.items()) + " END"


@query("a10_zonal_curve_number", "v_px", sql=f"WITH {ZONE}, {MAJOR} SELECT aoi_id, cell, round(avg(({CN})[m.hsg_code]::DOUBLE), 3) AS cn FROM z JOIN m USING (aoi_id, cell) GROUP BY ALL")
def a10(px: DataFrame) -> DataFrame:
    """Area-weighted curve number of each cell's cover classes for its dominant soil group. The zone's group joins back on the zone key."""
    z = _zones(px)
    group = op.majority(z, ZONES, "hsg_code", F.col("hsg_code").isin(*k.GROUP_CODES)).select(*ZONES, k.lookup(k.GROUP_CODES, F.col("hsg_code").cast("int")).alias("letter"))
    n = z.groupBy(*ZONES, F.col("landcover").cast("int").alias("landcover")).agg(F.count("*").alias("n"))
    x = n.join(group, ZONES).withColumn("cn", op.curve_number(n, ZONES, F.col("letter")))
    return x.groupBy(*ZONES).agg(F.round(F.sum(F.col("n") * F.col("cn")) / F.sum("n"), 3).alias("cn"))


def _side(axis: str, across: str) -> str:
    w = f"OVER (PARTITION BY aoi_id, {across} ORDER BY {axis})"
    lo, hi = f"CASE WHEN lag({axis}) {w} = {axis} - 1 THEN lag(z_m) {w} END", f"CASE WHEN lead({axis}) {w} = {axis} + 1 THEN lead(z_m) {w} END"
    return f"coalesce(({hi} - {lo}) / 2, {hi} - z_m, z_m - {lo})"


SLOPE = f"s AS (SELECT aoi_id, ix, iy, 100 * sqrt(pow({_side('ix', 'iy')}, 2) + pow({_side('iy', 'ix')}, 2)) AS p FROM v_px)"


@query("w08_pixel_gradient", "v_px", sql=f"WITH {SLOPE} SELECT aoi_id, ix, iy, round(p, 5) AS slope_pct FROM s")
def w08(px: DataFrame) -> DataFrame:
    return op.slope_pct(px).select("aoi_id", "ix", "iy", F.round("slope_pct", 5).alias("slope_pct"))


@query("a11_zonal_median_slope", "v_px", sql=f"WITH {SLOPE} SELECT {CELL}, round(median(p), 5) AS slope_pct FROM s WHERE p IS NOT NULL GROUP BY ALL")
def a11(px: DataFrame) -> DataFrame:
    median = percentiles(_zones(op.slope_pct(px)).where("slope_pct is not null"), ZONES, "slope_pct", 0.5, "slope_pct")
    return median.withColumn("slope_pct", F.round("slope_pct", 5))


@query("a32_slope_gate", "v_px", sql=f"WITH {SLOPE}, t AS (SELECT aoi_id, CASE WHEN aoi_id % 3 = 0 THEN p / 100 ELSE p END AS p, CASE WHEN aoi_id % 2 = 0 THEN 1.0 ELSE 4.0 END::DOUBLE AS gate FROM s WHERE p IS NOT NULL) SELECT aoi_id, round(median(p), 5) AS median_pct, min(gate) AS gate_pct, median(p) < min(gate) AS flat FROM t GROUP BY 1")
def a32(px: DataFrame) -> DataFrame:
    """Every third area is flat; even areas have terrain of 1 m posting, the others of 30 m."""
    area = F.col("aoi_id")
    x = op.slope_pct(px).withColumn("slope_pct", F.when(area % 3 == 0, F.col("slope_pct") / 100).otherwise(F.col("slope_pct")))
    return op.slope_gate(x, F.when(area % 2 == 0, 1.0).otherwise(30.0)).withColumn("median_pct", F.round("median_pct", 5))


@query("a39_terrain_coverage", "v_px", sql="SELECT aoi_id, round(avg(CAST(landcover % 5 <> 0 AS INT)), 6) AS valid_share, CASE WHEN avg(CAST(landcover % 5 <> 0 AS INT)) >= 0.99 THEN 'full' WHEN avg(CAST(landcover % 5 <> 0 AS INT)) >= 0.7 THEN 'fine' ELSE 'coarse' END AS choice FROM v_px GROUP BY 1")
def a39(px: DataFrame) -> DataFrame:
    q = F.avg((F.col("landcover") % 5 != 0).cast("int"))
    return px.groupBy("aoi_id").agg(F.round(q, 6).alias("valid_share"), F.when(q >= 0.99, "full").when(q >= 0.7, "fine").otherwise("coarse").alias("choice"))


FLAGS = "landcover IN (3, 7, 11) AS roof, iy % 7 = 0 AS road, landcover % 4 <> 0 AS parcel"


def _flags(px: DataFrame) -> DataFrame:
    return _zones(px).withColumn("roof", F.col("landcover").isin(3, 7, 11)).withColumn("road", F.col("iy") % 7 == 0).withColumn("parcel", F.col("landcover") % 4 != 0)


@query("a12_parcel_imperviousness", "v_px", sql=f"""WITH {ZONE}, f AS (SELECT *, {FLAGS} FROM z), s AS (SELECT aoi_id, cell, count(*) AS n, count(*) FILTER (WHERE roof) AS r, count(*) FILTER (WHERE NOT parcel AND NOT roof) AS v FROM f GROUP BY ALL)
SELECT aoi_id, cell, r / n::DOUBLE >= 0.02 AS parcel_based, CASE WHEN r / n::DOUBLE >= 0.02 THEN round(greatest(1, least(95, 100 * (r + 0.85::DOUBLE * v) / n)), 6) ELSE 95 END AS pct FROM s""")
def a12(px: DataFrame) -> DataFrame:
    """Roofs in full and the street reserve at its paved share; without mapped roofs (2 % of a cell) there is no evidence and the upper limit stands."""
    n, r, v = F.count("*"), F.count_if("roof"), F.count_if(~F.col("parcel") & ~F.col("roof"))
    seen = r / n >= 0.02
    pct = F.round(F.greatest(F.lit(1.0), F.least(F.lit(95.0), 100 * (r + 0.85 * v) / n)), 6)
    return _flags(px).groupBy(*ZONES).agg(seen.alias("parcel_based"), F.when(seen, pct).otherwise(95.0).alias("pct"))


@query("a13_physical_imperviousness", "v_px", sql=f"""WITH {ZONE}, f AS (SELECT *, {FLAGS} FROM z), s AS (SELECT aoi_id, cell, count(*) AS n, count(*) FILTER (WHERE roof AND cell % 3 <> 0) AS r, count(*) FILTER (WHERE roof AND cell % 3 <> 0 OR road) AS u, avg({IMPERV}) AS i FROM f GROUP BY ALL)
SELECT aoi_id, cell, round(CASE WHEN r / n::DOUBLE >= 0.02 THEN least(90, 100 * u / n::DOUBLE + 10) ELSE 100 * i END, 6) AS pct FROM s""")
def a13(px: DataFrame) -> DataFrame:
    """Roofs are mapped in two of three cells only."""
    mapped = _flags(px).withColumn("roof", F.col("roof") & (F.col("cell") % 3 != 0))
    return op.physical_imperviousness(mapped, ZONES).withColumn("pct", F.round("pct", 6))


@query("a17_dwellings_per_cell", "v_px", sql=f"WITH {ZONE}, f AS (SELECT *, {FLAGS} FROM z) SELECT aoi_id, cell, count(*) FILTER (WHERE roof) AS n FROM f GROUP BY ALL HAVING count(*) FILTER (WHERE roof) > 0")
def a17(px: DataFrame) -> DataFrame:
    return _flags(px).where("roof").groupBy(*ZONES).agg(F.count("*").alias("n"))


@query("a18_service_area_dissolve", "v_px", sql=f"WITH {ZONE} SELECT aoi_id, cell % 6 AS node, count(*) AS pixels, count(DISTINCT cell) AS cells FROM z GROUP BY ALL")
def a18(px: DataFrame) -> DataFrame:
    return _zones(px).groupBy("aoi_id", (F.col("cell") % 6).alias("node")).agg(F.count("*").alias("pixels"), F.count_distinct("cell").alias("cells"))


@query("a19_overlap_and_coverage", "v_px", sql="""WITH c AS (SELECT aoi_id, ix, iy, 1 AS cell FROM v_px WHERE landcover <= 12 UNION ALL SELECT aoi_id, ix, iy, 2 FROM v_px WHERE landcover BETWEEN 10 AND 17),
u AS (SELECT aoi_id, count(*) AS total, count(DISTINCT (ix, iy)) AS covered FROM c GROUP BY 1), a AS (SELECT aoi_id, count(*) AS area FROM v_px GROUP BY 1)
SELECT aoi_id, round((total - covered) / total::DOUBLE, 6) AS overlap, round((area - covered) / area::DOUBLE, 6) AS uncovered, round(abs(total - area) / area::DOUBLE, 6) AS conservation,
 CASE WHEN (total - covered) / total::DOUBLE > 0.05 THEN 'error' WHEN (total - covered) / total::DOUBLE > 0.005 THEN 'warning' ELSE 'ok' END AS overlap_verdict FROM u JOIN a USING (aoi_id)""")
def a19(px: DataFrame) -> DataFrame:
    """Overlap, holes and conservation of two sets of cells against their area: distinct pixels against all pixels."""
    cells = px.where("landcover <= 12").select(*op.PIXEL).unionByName(px.where("landcover between 10 and 17").select(*op.PIXEL))
    once = cells.groupBy(*op.PIXEL).agg(F.count("*").alias("n"))
    u = once.groupBy("aoi_id").agg(F.sum("n").alias("total"), F.count("*").alias("covered"))
    x = u.join(px.groupBy("aoi_id").agg(F.count("*").alias("area")), "aoi_id")
    over = (F.col("total") - F.col("covered")) / F.col("total")
    return x.select("aoi_id", F.round(over, 6).alias("overlap"), F.round((F.col("area") - F.col("covered")) / F.col("area"), 6).alias("uncovered"), F.round(F.abs(F.col("total") - F.col("area")) / F.col("area"), 6).alias("conservation"), F.when(over > k.OVERLAP_ERROR, "error").when(over > k.OVERLAP_WARN, "warning").otherwise("ok").alias("overlap_verdict"))


@query("u03_effective_area", "v_px", sql="SELECT aoi_id, count(*) AS pixels FROM v_px WHERE landcover <> 18 AND iy % 5 <> 0 GROUP BY 1")
def u03(px: DataFrame) -> DataFrame:
    """Pixels of the area that are served and no water."""
    area, served, water = px.select(*op.PIXEL), px.where("iy % 5 <> 0").select(*op.PIXEL), px.where("landcover = 18").select(*op.PIXEL)
    return area.join(served, op.PIXEL, "left_semi").join(water, op.PIXEL, "left_anti").groupBy("aoi_id").agg(F.count("*").alias("pixels"))


@query("u04_right_of_way", "v_px", sql="SELECT aoi_id, ix, iy FROM v_px WHERE landcover % 4 = 0")
def u04(px: DataFrame) -> DataFrame:
    return px.select(*op.PIXEL).join(px.where("landcover % 4 <> 0").select(*op.PIXEL), op.PIXEL, "left_anti")


@query("u05_water_removal", "v_px", sql=f"""WITH {ZONE}, s AS (SELECT aoi_id, cell, count(*) AS n, count(*) FILTER (WHERE landcover NOT IN (16, 17, 18)) AS land FROM z GROUP BY ALL)
SELECT aoi_id, cell, land, round(30 * land / n::DOUBLE, 6) AS width_m FROM s WHERE land / n::DOUBLE >= 0.01 AND land >= 70""")
def u05(px: DataFrame) -> DataFrame:
    """Land pixels of each cell without water; cells that are nearly all water or under the least area go; width scales with the area left."""
    z = _zones(px)
    land = z.join(px.where("landcover in (16, 17, 18)").select(*op.PIXEL), op.PIXEL, "left_anti").groupBy(*ZONES).agg(F.count("*").alias("land"))
    x = z.groupBy(*ZONES).agg(F.count("*").alias("n")).join(land, ZONES)
    share = F.col("land") / F.col("n")
    return x.where((share >= 0.01) & (F.col("land") >= 70)).select(*ZONES, "land", F.round(30 * F.col("land") / F.col("n"), 6).alias("width_m"))


def _reach(test: str) -> str:
    return f"""WITH RECURSIVE p AS (SELECT aoi_id, ix, iy FROM v_px WHERE {test}),
w(aoi_id, ix, iy, ox, oy) AS (SELECT aoi_id, ix, iy, ix, iy FROM p UNION SELECT w.aoi_id, w.ix, w.iy, q.ix, q.iy FROM w JOIN p q ON q.aoi_id = w.aoi_id AND abs(q.ix - w.ox) + abs(q.iy - w.oy) = 1),
g AS (SELECT aoi_id, ix, iy, min((aoi_id * 1000000 + oy) * 1000000 + ox) AS part FROM w GROUP BY ALL)"""


@query("g08_connected_parts", "v_px", sql=_reach("landcover IN (1, 2, 3, 4, 5, 6)") + " SELECT aoi_id, ix, iy, part FROM g")
def g08(px: DataFrame) -> DataFrame:
    return op.parts(px.where("landcover in (1, 2, 3, 4, 5, 6)").withColumn("kind", F.lit(1)), "kind").select("aoi_id", "ix", "iy", "part")


@query("g14_water_blobs", "v_px", sql=_reach("landcover IN (14, 15, 16, 17, 18)") + ", n AS (SELECT part, count(*) AS pixels FROM g GROUP BY 1) SELECT aoi_id, part, pixels FROM n JOIN (SELECT DISTINCT aoi_id, part FROM g) USING (part) WHERE pixels >= 3")
def g14(px: DataFrame) -> DataFrame:
    """Connected water of a least size (here 3 pixels of a wider class set, so that blobs occur)."""
    parts = op.parts(px.where("landcover in (14, 15, 16, 17, 18)").withColumn("kind", F.lit(1)), "kind")
    return parts.groupBy("aoi_id", "part").agg(F.count("*").alias("pixels")).where("pixels >= 3")


@query("t07_largest_part", "v_px", sql=_reach("landcover IN (1, 2, 3, 4, 5, 6)") + ", n AS (SELECT aoi_id, part, count(*) AS pixels FROM g GROUP BY ALL) SELECT aoi_id, part, pixels FROM (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY pixels DESC, part) AS r FROM n) WHERE r = 1")
def t07(px: DataFrame) -> DataFrame:
    parts = op.parts(px.where("landcover in (1, 2, 3, 4, 5, 6)").withColumn("kind", F.lit(1)), "kind")
    n = parts.groupBy("aoi_id", "part").agg(F.count("*").alias("pixels"))
    return n.groupBy("aoi_id").agg(F.max(F.struct("pixels", (-F.col("part")).alias("p"))).alias("m")).select("aoi_id", (-F.col("m.p")).alias("part"), "m.pixels")


@query("w11_piece_names", "v_px", sql=_reach("landcover IN (1, 2, 3, 4, 5, 6)") + ", n AS (SELECT aoi_id, part, count(*) AS pixels FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY pixels DESC, part) AS i FROM n) SELECT aoi_id, part, 'S_' || aoi_id || CASE WHEN i > 1 THEN '__' || i ELSE '' END AS name FROM r")
def w11(px: DataFrame) -> DataFrame:
    parts = op.parts(px.where("landcover in (1, 2, 3, 4, 5, 6)").withColumn("kind", F.lit(1)), "kind")
    n = parts.groupBy("aoi_id", "part").agg((-F.count("*")).alias("fewer"))
    return ranked(n, [F.col("aoi_id")], ["fewer", "part"], "i").select("aoi_id", "part", F.concat(F.lit("S_"), F.col("aoi_id").cast("string"), F.when(F.col("i") > 1, F.concat(F.lit("__"), F.col("i").cast("string"))).otherwise("")).alias("name"))


EDGE = "e AS (SELECT z.aoi_id, z.cell AS a, q.cell AS b, count(*) AS edges FROM z JOIN z q ON q.aoi_id = z.aoi_id AND abs(q.ix - z.ix) + abs(q.iy - z.iy) = 1 WHERE z.cell <> q.cell GROUP BY ALL)"
ODD = "z AS (SELECT aoi_id, ix, iy, CASE WHEN ix % 10 = 0 AND iy % 10 < 4 THEN 1000 ELSE 0 END + ix // 10 + 10 * (iy // 10) AS cell FROM v_px)"


def _odd(px: DataFrame) -> DataFrame:
    return _zones(px).withColumn("cell", F.when((F.col("ix") % 10 == 0) & (F.col("iy") % 10 < 4), 1000).otherwise(0) + F.col("cell")).select("aoi_id", "ix", "iy", "cell")


@query("t06_sliver_merge", "v_px", sql=f"""WITH {ODD}, s AS (SELECT aoi_id, cell AS a, count(*) AS n FROM z GROUP BY ALL), {EDGE},
t AS (SELECT e.aoi_id, e.a, e.b, row_number() OVER (PARTITION BY e.aoi_id, e.a ORDER BY edges DESC, e.b) AS r FROM e JOIN s x ON x.aoi_id = e.aoi_id AND x.a = e.a AND x.n < 20 JOIN s y ON y.aoi_id = e.aoi_id AND y.a = e.b AND y.n >= 20),
lone AS (SELECT s.aoi_id, s.a FROM s LEFT JOIN t ON t.aoi_id = s.aoi_id AND t.a = s.a WHERE s.n < 20 AND t.a IS NULL),
far AS (SELECT l.aoi_id, l.a, arg_min(q.cell, (sqrt(pow(z.ix - q.ix, 2) + pow(z.iy - q.iy, 2)), q.cell)) AS b FROM lone l JOIN z ON z.aoi_id = l.aoi_id AND z.cell = l.a JOIN z q ON q.aoi_id = l.aoi_id JOIN s y ON y.aoi_id = q.aoi_id AND y.a = q.cell AND y.n >= 20 GROUP BY ALL)
SELECT z.aoi_id, coalesce(t.b, far.b, z.cell) AS cell, count(*) AS pixels FROM z LEFT JOIN t ON t.aoi_id = z.aoi_id AND t.a = z.cell AND t.r = 1 LEFT JOIN far ON far.aoi_id = z.aoi_id AND far.a = z.cell GROUP BY ALL""")
def t06(px: DataFrame) -> DataFrame:
    return op.merged_slivers(_odd(px), "cell", 20).groupBy("aoi_id", "cell").agg(F.count("*").alias("pixels"))


@query("j19_parcel_to_cell", "v_px", sql=f"WITH {ZONE}, n AS (SELECT aoi_id, ix // 7 AS parcel, cell, count(*) AS n FROM z WHERE landcover % 4 <> 0 GROUP BY ALL) SELECT aoi_id, parcel, cell, n FROM (SELECT *, row_number() OVER (PARTITION BY aoi_id, parcel ORDER BY n DESC, cell) AS r FROM n) WHERE r = 1")
def j19(px: DataFrame) -> DataFrame:
    """Each parcel goes to the cell that it overlaps most."""
    z = _flags(px).where("parcel").withColumn("parcel", F.floor(F.col("ix") / 7))
    return op.majority(z, ["aoi_id", "parcel"], "cell", F.lit(True))


@query("g11_parcel_snap", "v_px", sql=f"""WITH {ZONE}, f AS (SELECT *, {FLAGS}, ix // 7 AS pk FROM z), n AS (SELECT aoi_id, pk, cell, count(*) AS n FROM f WHERE parcel GROUP BY ALL),
m AS (SELECT aoi_id, pk, cell FROM (SELECT *, row_number() OVER (PARTITION BY aoi_id, pk ORDER BY n DESC, cell) AS r FROM n) WHERE r = 1)
SELECT f.aoi_id, coalesce(m.cell, f.cell) AS cell, count(*) AS pixels FROM f LEFT JOIN m ON f.parcel AND m.aoi_id = f.aoi_id AND m.pk = f.pk GROUP BY ALL""")
def g11(px: DataFrame) -> DataFrame:
    """Pixels of a parcel move to the parcel's cell, others keep theirs."""
    z = _flags(px).withColumn("pk", F.when(F.col("parcel"), F.floor(F.col("ix") / 7)))
    own = op.majority(z.where("pk is not null"), ["aoi_id", "pk"], "cell", F.lit(True)).select("aoi_id", "pk", F.col("cell").alias("to_cell"))
    return z.join(own, ["aoi_id", "pk"], "left").groupBy("aoi_id", F.coalesce("to_cell", "cell").alias("cell")).agg(F.count("*").alias("pixels"))


@query("j20_raster_sampling", "v_node", "v_px", sql="SELECT n.node_key, p.z_m FROM v_node n LEFT JOIN v_px p ON p.aoi_id = n.aoi_id AND p.ix = n.node_key % 60 AND p.iy = n.node_key // 10 % 50")
def j20(nodes: DataFrame, px: DataFrame) -> DataFrame:
    """Terrain at points by their pixel; null outside."""
    at = nodes.select("node_key", "aoi_id", (F.col("node_key") % 60).alias("ix"), (F.floor(F.col("node_key") / 10) % 50).alias("iy"))
    return op.sampled(at, px, "z_m").select("node_key", "z_m")


@query("g15_street_burn", "v_px", sql="SELECT aoi_id, ix, iy, round(z_m + CASE WHEN landcover = 3 THEN 10 ELSE 0 END - CASE WHEN iy % 7 = 0 THEN 2 ELSE 0 END + CASE WHEN iy % 7 = 1 AND ix % 9 <> 0 THEN 0.3 ELSE 0 END, 7) AS z_m FROM v_px")
def g15(px: DataFrame) -> DataFrame:
    """Streets go down 2 m, kerbs up 0.30 m except at gates, buildings up 10 m."""
    lift = F.when(F.col("landcover") == 3, 10.0).otherwise(0.0) - F.when(F.col("iy") % 7 == 0, 2.0).otherwise(0.0) + F.when((F.col("iy") % 7 == 1) & (F.col("ix") % 9 != 0), 0.3).otherwise(0.0)
    return px.select(*op.PIXEL, F.round(F.col("z_m") + lift, 7).alias("z_m"))


@query("g16_local_low", "v_px", sql="""WITH p AS (SELECT * FROM v_px WHERE ix % 10 = 5 AND iy % 10 = 5)
SELECT p.aoi_id, p.ix, p.iy, min_by((q.iy * 1000 + q.ix), (q.z_m, q.iy, q.ix)) AS low FROM p JOIN v_px q ON q.aoi_id = p.aoi_id AND abs(q.ix - p.ix) <= 2 AND abs(q.iy - p.iy) <= 2 GROUP BY ALL""")
def g16(px: DataFrame) -> DataFrame:
    """Pour points move to the lowest pixel within two; each names its 25 candidates, which an equi-join looks up."""
    p = px.where("ix % 10 = 5 and iy % 10 = 5").select(*op.PIXEL)
    around = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    c = p.withColumn("a", around).withColumn("b", around).select(*op.PIXEL, (F.col("ix") + F.col("a")).alias("n_ix"), (F.col("iy") + F.col("b")).alias("n_iy"))
    q = px.select("aoi_id", F.col("ix").alias("n_ix"), F.col("iy").alias("n_iy"), "z_m")
    low = F.min_by(F.col("n_iy") * 1000 + F.col("n_ix"), F.struct("z_m", "n_iy", "n_ix"))
    return c.join(q, ["aoi_id", "n_ix", "n_iy"]).groupBy(*op.PIXEL).agg(low.alias("low"))


@query("g17_flow_directions", "v_px", sql="""WITH d AS (SELECT p.aoi_id, p.ix, p.iy, q.ix AS nx, q.iy AS ny, (p.z_m - q.z_m) / CASE WHEN p.ix <> q.ix AND p.iy <> q.iy THEN sqrt(2) ELSE 1 END AS dz FROM v_px p JOIN v_px q ON q.aoi_id = p.aoi_id AND abs(q.ix - p.ix) <= 1 AND abs(q.iy - p.iy) <= 1 WHERE p.z_m > q.z_m),
r AS (SELECT *, row_number() OVER (PARTITION BY aoi_id, ix, iy ORDER BY dz DESC, ny, nx) AS i FROM d)
SELECT p.aoi_id, p.ix, p.iy, r.nx AS d_ix, r.ny AS d_iy FROM v_px p LEFT JOIN r ON r.aoi_id = p.aoi_id AND r.ix = p.ix AND r.iy = p.iy AND r.i = 1""")
def g17(px: DataFrame) -> DataFrame:
    return op.flow_directions(px).select(*op.PIXEL, "d_ix", "d_iy")


POURS = "pour AS (SELECT aoi_id, ix, iy, iy * 1000 + ix AS label FROM v_px WHERE ix % 9 = 4 AND iy % 9 = 4)"
STEEPEST = """d AS (SELECT p.aoi_id, p.ix, p.iy, q.ix AS nx, q.iy AS ny, CASE WHEN p.ix <> q.ix AND p.iy <> q.iy THEN sqrt(2) ELSE 1 END AS w, p.z_m - q.z_m AS dz FROM v_px p JOIN v_px q ON q.aoi_id = p.aoi_id AND abs(q.ix - p.ix) <= 1 AND abs(q.iy - p.iy) <= 1 WHERE p.z_m > q.z_m),
r AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY aoi_id, ix, iy ORDER BY dz / w DESC, ny, nx) = 1)"""
BASINS = f"""WITH RECURSIVE {STEEPEST}, {POURS},
up AS (SELECT r.* FROM r ANTI JOIN pour USING (aoi_id, ix, iy)),
walk(aoi_id, ix, iy, label, length) AS (SELECT aoi_id, ix, iy, label, 0::DOUBLE FROM pour UNION ALL SELECT w.aoi_id, u.ix, u.iy, w.label, w.length + u.w FROM walk w JOIN up u ON u.aoi_id = w.aoi_id AND u.nx = w.ix AND u.ny = w.iy)"""


def _basins(px: DataFrame) -> DataFrame:
    return flow.basins(op.flow_directions(px), px.where("ix % 9 = 4 and iy % 9 = 4").select(*op.PIXEL, (F.col("iy") * 1000 + F.col("ix")).alias("label")))


@query("g17_basins", "v_px", sql=BASINS + " SELECT p.aoi_id, p.ix, p.iy, w.label, round(w.length, 6) AS length FROM v_px p LEFT JOIN walk w USING (aoi_id, ix, iy)")
def g17_basins(px: DataFrame) -> DataFrame:
    """Every pixel's pour point (here one in 81 pixels) and the way there."""
    return _basins(px).withColumn("length", F.round("length", 6))


@query("g17_flow_lengths", "v_px", sql=BASINS + " SELECT aoi_id, label, count(*) AS pixels, CASE WHEN max(length) > 1 THEN round(max(length), 6) END AS flow_m FROM walk GROUP BY ALL")
def g17_lengths(px: DataFrame) -> DataFrame:
    return flow.flow_lengths(_basins(px)).withColumn("flow_m", F.round("flow_m", 6))


@query("g18_absorbed_land", "v_px")
def g18_absorbed(px: DataFrame) -> DataFrame:
    """Land that drains past every pour point goes to the basins beside it, ring by ring, and pockets to the nearest pour point. A recursive query can't take the least of a ring, so there is no SQL; a test holds the operator against the plain rule."""
    found = _basins(px.where("landcover <> 18"))
    seeds = px.where("ix % 9 = 4 and iy % 9 = 4").select("aoi_id", (F.col("iy") * 1000 + F.col("ix")).alias("seed_key"), F.col("ix").cast("double").alias("sx"), F.col("iy").cast("double").alias("sy"))
    return op.absorbed(found, "label", seeds).groupBy("aoi_id", "label").agg(F.count("*").alias("pixels"))


@query("g18_grown_labels", "v_px", sql="""WITH l0 AS (SELECT aoi_id, ix, iy, CASE WHEN landcover = 1 THEN ix * 100 + iy END AS lab FROM v_px),
l1 AS (SELECT p.aoi_id, p.ix, p.iy, coalesce(any_value(p.lab), min(q.lab)) AS lab FROM l0 p LEFT JOIN l0 q ON p.lab IS NULL AND q.aoi_id = p.aoi_id AND abs(q.ix - p.ix) + abs(q.iy - p.iy) = 1 GROUP BY ALL),
l2 AS (SELECT p.aoi_id, p.ix, p.iy, coalesce(any_value(p.lab), min(q.lab)) AS lab FROM l1 p LEFT JOIN l1 q ON p.lab IS NULL AND q.aoi_id = p.aoi_id AND abs(q.ix - p.ix) + abs(q.iy - p.iy) = 1 GROUP BY ALL)
SELECT aoi_id, ix, iy, lab FROM l2""")
def g18(px: DataFrame) -> DataFrame:
    return op.grown_labels(px.select(*op.PIXEL, F.when(F.col("landcover") == 1, F.col("ix") * 100 + F.col("iy")).alias("lab")), "lab", 2)


SEED = "seeds AS (SELECT aoi_id, ix * 100 + iy AS seed, ix AS sx, iy AS sy FROM v_px WHERE ix % 12 = 3 AND iy % 12 = 3)"


@query("g05_nearest_seed_cells", "v_px", sql=f"""WITH {SEED}, d AS (SELECT p.aoi_id, p.ix, p.iy, s.seed, row_number() OVER (PARTITION BY p.aoi_id, p.ix, p.iy ORDER BY (p.ix - s.sx) * (p.ix - s.sx) + (p.iy - s.sy) * (p.iy - s.sy), s.seed) AS r FROM v_px p JOIN seeds s USING (aoi_id))
SELECT aoi_id, seed, count(*) AS pixels FROM d WHERE r = 1 GROUP BY ALL""")
def g05(px: DataFrame) -> DataFrame:
    """Every pixel of an area goes to its nearest seed."""
    found = op.nearest(_centres(px), _grid_seeds(px), 12.0, area=AREA)
    return found.where("seed_key is not null").groupBy("aoi_id", F.col("seed_key").alias("seed")).agg(F.count("*").alias("pixels"))


AREA = ("aoi_id",)


def _centres(px: DataFrame) -> DataFrame:
    """Pixels as points of their area's plane."""
    return px.select("aoi_id", op.pixel_id(F.col("ix"), F.col("iy"), F.lit(0)).alias("point_key"), F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"))


def _grid_seeds(px: DataFrame) -> DataFrame:
    seeds = px.where("ix % 12 = 3 and iy % 12 = 3")
    return seeds.select("aoi_id", (F.col("ix") * 100 + F.col("iy")).alias("seed_key"), F.col("ix").cast("double").alias("sx"), F.col("iy").cast("double").alias("sy"))


def _street_samples(px: DataFrame) -> DataFrame:
    return px.where("iy = 20 and ix % 5 = 0").select("aoi_id", F.col("ix").alias("seed_key"), F.col("ix").cast("double").alias("sx"), F.col("iy").cast("double").alias("sy"))


@query("g06_street_band", "v_px", sql="SELECT aoi_id, ix, iy FROM v_px p WHERE EXISTS (SELECT 1 FROM v_px q WHERE q.aoi_id = p.aoi_id AND q.iy = 20 AND q.ix % 5 = 0 AND sqrt(pow(q.ix - p.ix, 2) + pow(q.iy - p.iy, 2)) <= 4)")
def g06(px: DataFrame) -> DataFrame:
    """Pixels within 4 m of a street's samples."""
    near = op.nearest_within(_centres(px), _street_samples(px), 4.0, area=AREA)
    at = px.select(*op.PIXEL, op.pixel_id(F.col("ix"), F.col("iy"), F.lit(0)).alias("point_key"))
    return at.join(near.select("aoi_id", "point_key"), ["aoi_id", "point_key"]).select(*op.PIXEL)


@query("u08_official_edge", "v_px", sql=f"""WITH {ZONE}, b AS (SELECT *, ix // 25 AS basin FROM z), own AS (SELECT aoi_id, cell, cell % 10 // 3 AS seed_basin FROM b GROUP BY ALL)
SELECT b.aoi_id, b.cell, count(*) FILTER (WHERE b.basin = o.seed_basin) AS kept, count(*) FILTER (WHERE b.basin <> o.seed_basin) AS moved, count(*) FILTER (WHERE b.basin = o.seed_basin) / count(*)::DOUBLE < 0.2 AS refused FROM b JOIN own o USING (aoi_id, cell) GROUP BY ALL""")
def u08(px: DataFrame) -> DataFrame:
    """Pixels outside the official basin of a cell's seed leave it; a cell that would keep under a fifth is refused."""
    b = _zones(px).withColumn("basin", F.floor(F.col("ix") / 25)).withColumn("own", F.floor(F.col("cell") % 10 / 3))
    kept = F.count_if(F.col("basin") == F.col("own"))
    return b.groupBy(*ZONES).agg(kept.alias("kept"), (F.count("*") - kept).alias("moved"), (kept / F.count("*") < 0.2).alias("refused"))


@query("g13_nominal_catchments", "v_node", "v_catchment", sql="SELECT n.node_key, coalesce(sum(c.area_ha), 0.5) AS area_ha, count(c.cell_key) = 0 AS nominal FROM v_node n LEFT JOIN v_catchment c ON c.outlet_key = n.node_key GROUP BY 1")
def g13(nodes: DataFrame, catchments: DataFrame) -> DataFrame:
    """Nodes for which nothing was measured get a nominal catchment, marked as such."""
    area = catchments.groupBy(F.col("outlet_key").alias("node_key")).agg(F.sum("area_ha").alias("a"))
    return nodes.join(area, "node_key", "left").select("node_key", F.coalesce("a", F.lit(0.5)).alias("area_ha"), F.col("a").isNull().alias("nominal"))


METRIC = "m AS (SELECT node_key, radians(lon + 123.4) * 6371000 * cos(radians(48.4)) AS x, radians(lat - 48.4) * 6371000 AS y FROM v_node)"
POINT = "p AS (SELECT cell_key, radians((cell_key % 10) * 1e-3 + (cell_key % 7) * 1e-5) * 6371000 * cos(radians(48.4)) AS x, radians(cell_key % 40 * 1e-3 + (cell_key % 3) * 1e-5) * 6371000 AS y FROM v_catchment)"


def _metric(nodes: DataFrame) -> DataFrame:
    x, y = op.metric(F.col("lon"), F.col("lat"), F.lit(-123.4), F.lit(48.4))
    return nodes.select(F.col("node_key").alias("seed_key"), x.alias("sx"), y.alias("sy"))


def _points(catchments: DataFrame) -> DataFrame:
    c = F.col("cell_key")
    x, y = op.metric((c % 10) * 1e-3 + (c % 7) * 1e-5, (c % 40) * 1e-3 + (c % 3) * 1e-5, F.lit(0.0), F.lit(0.0))
    return catchments.select(c.alias("point_key"), (x * F.cos(F.radians(F.lit(48.4)))).alias("x"), y.alias("y"))


@query("g01_metric_plane", "v_node", sql=f"WITH {METRIC} SELECT node_key, round(x, 4) AS x, round(y, 4) AS y FROM m")
def g01(nodes: DataFrame) -> DataFrame:
    return _metric(nodes).select(F.col("seed_key").alias("node_key"), F.round("sx", 4).alias("x"), F.round("sy", 4).alias("y"))


def _nearest_sql(radius: float) -> str:
    return f"WITH {METRIC}, {POINT}, d AS (SELECT p.cell_key, m.node_key, sqrt(pow(p.x - m.x, 2) + pow(p.y - m.y, 2)) AS d FROM p JOIN m ON abs(p.x - m.x) <= {radius} AND abs(p.y - m.y) <= {radius}) SELECT cell_key, min_by(node_key, (d, node_key)) AS node_key, round(min(d), 4) AS distance FROM d WHERE d <= {radius} GROUP BY 1"


@query("j07_structure_within_5m", "v_node", "v_catchment", sql=_nearest_sql(5.0))
def j07(nodes: DataFrame, catchments: DataFrame) -> DataFrame:
    return op.nearest_within(_points(catchments), _metric(nodes), 5.0).select(F.col("point_key").alias("cell_key"), F.col("seed_key").alias("node_key"), F.round("distance", 4).alias("distance"))


@query("j08_ground_within_60m", "v_node", "v_catchment", sql=_nearest_sql(60.0))
def j08(nodes: DataFrame, catchments: DataFrame) -> DataFrame:
    return op.nearest_within(_points(catchments), _metric(nodes), 60.0).select(F.col("point_key").alias("cell_key"), F.col("seed_key").alias("node_key"), F.round("distance", 4).alias("distance"))


@query("j18_parcel_to_seed", "v_node", "v_catchment", sql=f"WITH {METRIC}, {POINT}, d AS (SELECT p.cell_key, m.node_key, round(sqrt(pow(p.x - m.x, 2) + pow(p.y - m.y, 2)), 5) AS d FROM p, m) SELECT cell_key, min_by(node_key, (d, node_key)) AS seed, round(min(d), 1) AS distance FROM d GROUP BY 1")
def j18(nodes: DataFrame, catchments: DataFrame) -> DataFrame:
    """Each parcel's nearest seed at any distance."""
    found = op.by_place(_points(catchments), lambda p: op.nearest(p, _metric(nodes), 100.0))
    return found.select(F.col("point_key").alias("cell_key"), F.col("seed_key").alias("seed"), F.round(F.round("distance", 5), 1).alias("distance"))


@query("j16_lateral_seeds", "v_node", "v_catchment", sql=f"WITH {METRIC}, {POINT}, d AS (SELECT m.node_key, count(*) FILTER (WHERE sqrt(pow(p.x - m.x, 2) + pow(p.y - m.y, 2)) <= 60) AS n FROM m LEFT JOIN p ON abs(p.x - m.x) <= 60 AND abs(p.y - m.y) <= 60 GROUP BY 1) SELECT node_key % 5 AS area, count(*) FILTER (WHERE n > 0) AS n_seeds, CASE WHEN count(*) FILTER (WHERE n > 0) >= 2 THEN 'laterals' ELSE 'manholes' END AS seeds FROM d GROUP BY 1")
def j16(nodes: DataFrame, catchments: DataFrame) -> DataFrame:
    """Nodes with a lateral end within 60 m; an area needs two, else its manholes serve."""
    seeds, ends = _metric(nodes), _points(catchments)
    near = op.nearest_within(seeds.select(F.col("seed_key").alias("point_key"), F.col("sx").alias("x"), F.col("sy").alias("y")), ends.select(F.col("point_key").alias("seed_key"), F.col("x").alias("sx"), F.col("y").alias("sy")), 60.0)
    x = seeds.join(near.select(F.col("point_key").alias("seed_key"), "distance"), "seed_key", "left").groupBy((F.col("seed_key") % 5).alias("area")).agg(F.count("distance").alias("n_seeds"))
    return x.withColumn("seeds", F.when(F.col("n_seeds") >= 2, "laterals").otherwise("manholes"))


def _rings(nation: DataFrame) -> DataFrame:
    """An L-shaped ring with side s at (0, 0) for each nation; every seventh is a bow tie."""
    s = (F.col("n_nationkey") % 5 + 2).cast("double")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    z = F.lit(0.0)
    ell = F.array(pt(z, z), pt(s, z), pt(s, s / 2), pt(s / 2, s / 2), pt(s / 2, s), pt(z, s), pt(z, z))
    bow = F.array(pt(z, z), pt(s, s), pt(s, z), pt(z, s), pt(z, z))
    return nation.select("n_nationkey", s.alias("s"), F.when(F.col("n_nationkey") % 7 == 6, bow).otherwise(ell).alias("ring"))


S = "(n_nationkey % 5 + 2)::DOUBLE"


@query("g02_ring_measures", "v_lot", sql=f"SELECT n_nationkey, round({S} * {S} * 0.75, 6)::DOUBLE AS area, 4 * {S} AS perimeter, round({S} * 5 / 12, 6) AS cx, round({S} * 5 / 12, 6) AS cy FROM v_lot WHERE n_nationkey % 7 <> 6")
def g02(nation: DataFrame) -> DataFrame:
    x, y = op.ring_centroid(F.col("ring"))
    return _rings(nation).where("n_nationkey % 7 <> 6").select("n_nationkey", F.round(op.ring_area(F.col("ring")), 6).alias("area"), op.ring_perimeter(F.col("ring")).alias("perimeter"), F.round(x, 6).alias("cx"), F.round(y, 6).alias("cy"))


@query("g03_point_in_polygon", "nation", "part", sql=f"SELECT p_partkey, n_nationkey FROM part JOIN nation ON n_nationkey % 7 <> 6 AND p_size % 7 + 0.3 < {S} AND p_partkey % 7 + 0.4 < {S} AND NOT (p_size % 7 + 0.3 > {S} / 2 AND p_partkey % 7 + 0.4 > {S} / 2)")
def g03(nation: DataFrame, part: DataFrame) -> DataFrame:
    """Points inside rings: the box test joins first, then the exact one. Points carry their unit square, rings the squares of their box, so it is an equi-join."""
    rings = _rings(nation).where("n_nationkey % 7 <> 6")
    rings = rings.withColumn("bx", F.explode(F.sequence(F.lit(0), F.col("s").cast("int")))).withColumn("by", F.explode(F.sequence(F.lit(0), F.col("s").cast("int"))))
    points = part.select("p_partkey", (F.col("p_size") % 7 + 0.3).alias("x"), (F.col("p_partkey") % 7 + 0.4).alias("y"))
    points = points.withColumn("bx", F.floor("x").cast("int")).withColumn("by", F.floor("y").cast("int"))
    return points.join(rings, ["bx", "by"]).where(op.inside(F.col("ring"), F.col("x"), F.col("y"))).select("p_partkey", "n_nationkey")


@query("g04_rasterised_rings", "v_lot", sql=f"SELECT n_nationkey, x AS ix, y AS iy FROM v_lot, (SELECT unnest(range(0, 12)) AS x) a, (SELECT unnest(range(0, 12)) AS y) b WHERE n_nationkey % 7 <> 6 AND (x + 0.5) / 2 < {S} AND (y + 0.5) / 2 < {S} AND NOT ((x + 0.5) / 2 >= {S} / 2 AND (y + 0.5) / 2 >= {S} / 2)")
def g04(nation: DataFrame) -> DataFrame:
    return op.rasterised(_rings(nation).where("n_nationkey % 7 <> 6"), "ring", "n_nationkey", 0.5)


@query("g07_frontage", "v_lot", sql=f"SELECT n_nationkey, {S} AS long_m, {S} AS short_m FROM v_lot WHERE n_nationkey % 7 <> 6")
def g07(nation: DataFrame) -> DataFrame:
    x = op.frontage(_rings(nation).where("n_nationkey % 7 <> 6"), "ring", "n_nationkey")
    return x.select("n_nationkey", F.round("long_m", 6).alias("long_m"), F.round("short_m", 6).alias("short_m"))


@query("g22_ring_validity", "v_lot", sql="SELECT n_nationkey, n_nationkey % 7 <> 6 AS valid, CASE WHEN n_nationkey % 7 = 6 THEN 1 ELSE 0 END::BIGINT AS n_crossings FROM v_lot")
def g22(nation: DataFrame) -> DataFrame:
    """Closed, of four points or more, with area and without edges that cross."""
    r = _rings(nation)
    x = op.crossing_edges(r, "ring", "n_nationkey").join(r, "n_nationkey")
    closed = F.col("ring")[0] == F.element_at("ring", -1)
    ok = closed & (F.size("ring") >= 4) & (F.col("n_crossings") == 0) & (F.abs(op.ring_area(F.col("ring"))) > 0)
    return x.select("n_nationkey", ok.alias("valid"), "n_crossings")


@query("u07_remainder_parcels", "v_lot", sql=f"SELECT n_nationkey FROM v_lot WHERE NOT ((n_nationkey % 9) * 0.5 > 0.5 * {S} * {S} * 0.75) AND n_nationkey % 7 <> 6")
def u07(nation: DataFrame) -> DataFrame:
    """Polygons whose holes take over half of their outline are remainders and go."""
    area = op.ring_area(F.col("ring"))
    return _rings(nation).where("n_nationkey % 7 <> 6").where(~((F.col("n_nationkey") % 9) * 0.5 > 0.5 * area)).select("n_nationkey")


@query("g21_area_checks", "v_lot", sql=f"SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 6 THEN 'no area' WHEN {S} * {S} * 0.75 > 20 THEN 'too large' ELSE 'ok' END AS verdict, 0::DOUBLE AS west, {S} AS east FROM v_lot")
def g21(nation: DataFrame) -> DataFrame:
    area, xs = op.ring_area(F.col("ring")), F.transform("ring", lambda p: p["x"])
    verdict = F.when(F.abs(area) < 1e-9, "no area").when(area > 20, "too large").otherwise("ok")
    return _rings(nation).select("n_nationkey", verdict.alias("verdict"), F.array_min(xs).alias("west"), F.array_max(xs).alias("east"))


@query("m12_flow_length", "v_catchment", sql="SELECT cell_key, round(greatest(1, area_ha * 10000 / greatest(1, pct_imperv)), 4) AS flow_m, round(area_ha * 10000 / greatest(1, area_ha * 10000 / greatest(1, pct_imperv)), 4) AS width_m FROM v_catchment")
def m12(catchments: DataFrame) -> DataFrame:
    """Flow length from area and frontage, at least 1 m, and the width that follows."""
    m2 = F.col("area_ha") * 10000
    flow = F.greatest(F.lit(1.0), m2 / F.greatest(F.lit(1.0), F.col("pct_imperv")))
    return catchments.select("cell_key", F.round(flow, 4).alias("flow_m"), F.round(m2 / flow, 4).alias("width_m"))


@query("p18_city_of_point", "v_node", "nation", sql="SELECT node_key, min_by(n_nationkey, ((n_nationkey % 5 + 1), n_nationkey)) AS city FROM v_node JOIN nation ON lon BETWEEN -123.4 AND -123.4 + (n_nationkey % 5 + 1) * 0.002 AND lat BETWEEN 48.4 AND 48.4 + (n_nationkey % 5 + 1) * 0.002 GROUP BY 1")
def p18(nodes: DataFrame, nation: DataFrame) -> DataFrame:
    """The smallest coverage box around a point."""
    return _boxed(nodes, nation).groupBy("node_key").agg(F.min_by("n_nationkey", F.struct("z", "n_nationkey")).alias("city"))


def _boxed(nodes: DataFrame, nation: DataFrame) -> DataFrame:
    """Points with the boxes that hold them: boxes name the grid squares that they touch, points theirs, so it is an equi-join."""
    size = F.col("n_nationkey") % 5 + 1
    boxes = nation.select("n_nationkey", size.alias("z")).withColumn("bx", F.explode(F.sequence(F.lit(0), F.col("z").cast("int")))).withColumn("by", F.explode(F.sequence(F.lit(0), F.col("z").cast("int"))))
    p = nodes.withColumn("bx", F.floor((F.col("lon") + 123.4) / 0.002 + 1e-9).cast("int")).withColumn("by", F.floor((F.col("lat") - 48.4) / 0.002 + 1e-9).cast("int"))
    edge = F.col("z") * 0.002
    inside: Column = (F.col("lon") >= -123.4) & (F.col("lon") <= -123.4 + edge) & (F.col("lat") >= 48.4) & (F.col("lat") <= 48.4 + edge)
    return p.join(boxes, ["bx", "by"]).where(inside)


@query("j26_smallest_box", "v_node", "nation", sql="SELECT node_key, count(*) AS n_boxes FROM v_node JOIN nation ON lon BETWEEN -123.4 AND -123.4 + (n_nationkey % 5 + 1) * 0.002 AND lat BETWEEN 48.4 AND 48.4 + (n_nationkey % 5 + 1) * 0.002 GROUP BY 1")
def j26(nodes: DataFrame, nation: DataFrame) -> DataFrame:
    return _boxed(nodes, nation).groupBy("node_key").agg(F.count("*").alias("n_boxes"))


@query("j10_points_in_area", "v_idf", sql="SELECT DISTINCT station_key FROM v_idf WHERE lon BETWEEN -100 AND -80 AND lat BETWEEN 44 AND 50")
def j10(idf: DataFrame) -> DataFrame:
    """Stations inside an area's ring: box first, then the ring. No station lies on its edge."""
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-100.0, 44.0), (-80.0, 44.0), (-80.0, 50.0), (-100.0, 50.0), (-100.0, 44.0))))
    box = idf.where("lon between -101 and -79 and lat between 43 and 51")
    return box.where(op.inside(ring, F.col("lon"), F.col("lat"))).select("station_key").distinct()


LEADS = "l AS (SELECT t.from_key * 2 AS lead, a.x, a.y, t.to_key AS far FROM v_tree t JOIN m a ON a.node_key = t.from_key JOIN m b ON b.node_key = t.to_key UNION ALL SELECT t.from_key * 2 + 1, b.x, b.y, t.from_key FROM v_tree t JOIN m a ON a.node_key = t.from_key JOIN m b ON b.node_key = t.to_key)"


@query("j15_lateral_relocation", "v_tree", "v_node", "v_catchment", sql=f"WITH {METRIC}, {POINT}, {LEADS}, d AS (SELECT p.cell_key, l.far, l.lead, sqrt(pow(p.x - l.x, 2) + pow(p.y - l.y, 2)) AS d FROM p JOIN l ON abs(p.x - l.x) <= 25 AND abs(p.y - l.y) <= 25) SELECT cell_key, min_by(far, (d, lead)) AS node_key FROM d WHERE d <= 25 GROUP BY 1")
def j15(tree: DataFrame, nodes: DataFrame, catchments: DataFrame) -> DataFrame:
    """An inlet moves to the far end of the lead whose nearer end is within 25 m; leads count in both directions."""
    m = _metric(nodes)
    a, b = (m.select(F.col("seed_key").alias(c), F.col("sx").alias(f"{s}x"), F.col("sy").alias(f"{s}y")) for c, s in (("from_key", "a"), ("to_key", "b")))
    t = tree.join(a, "from_key").join(b, "to_key")
    ends = t.select((F.col("from_key") * 2).alias("seed_key"), F.col("ax").alias("sx"), F.col("ay").alias("sy"), F.col("to_key").alias("far"))
    ends = ends.union(t.select(F.col("from_key") * 2 + 1, "bx", "by", "from_key"))
    found = op.nearest_within(_points(catchments), ends, 25.0)
    return found.join(ends.select("seed_key", "far"), "seed_key").select(F.col("point_key").alias("cell_key"), F.col("far").alias("node_key"))


BLOCK = "o AS (SELECT aoi_id, ix, iy, landcover FROM v_px WHERE ix % 9 <> 0 AND iy % 7 <> 0), b AS (SELECT o.*, aoi_id * 10000 + (ix // 9) * 100 + iy // 7 AS k FROM o)"


@query("g19_block_service_mask", "v_px", sql=f"""WITH {BLOCK}, n AS (SELECT b.k, b.ix, b.iy, count(q.z_m) AS sides FROM b LEFT JOIN v_px q ON q.aoi_id = b.aoi_id AND abs(q.ix - b.ix) + abs(q.iy - b.iy) = 1 GROUP BY ALL),
e AS (SELECT k, min(sides) = 4 AS enclosed FROM n GROUP BY 1), s AS (SELECT k, count(*) AS n, bool_or(landcover = 3) AS built, any_value(aoi_id) AS aoi_id FROM b GROUP BY 1)
SELECT aoi_id, count(*) AS blocks, sum(n)::BIGINT AS pixels FROM s JOIN e USING (k) WHERE enclosed AND (n <= 40 OR built) GROUP BY 1""")
def g19(px: DataFrame) -> DataFrame:
    """Block interiors that streets enclose are served whole if they are small (here 40 pixels) or hold a building."""
    street = (F.col("ix") % 9 == 0) | (F.col("iy") % 7 == 0)
    inner = op.parts(px.where(~street).withColumn("kind", F.lit(1)), "kind")
    there = px.select("aoi_id", F.col("ix").alias("n_ix"), F.col("iy").alias("n_iy"))
    open_parts = op.neighbours(inner).join(there, ["aoi_id", "n_ix", "n_iy"], "left_anti").select("part").distinct()
    s = inner.join(open_parts, "part", "left_anti").groupBy("aoi_id", "part").agg(F.count("*").alias("n"), F.bool_or(F.col("landcover") == 3).alias("built"))
    return s.where((F.col("n") <= 40) | F.col("built")).groupBy("aoi_id").agg(F.count("*").alias("blocks"), F.sum("n").alias("pixels"))


PARCELS = f"{SEED}, pc AS (SELECT aoi_id, ix // 7 AS pk, floor(avg(ix)) AS cx, floor(avg(iy)) AS cy, count(*) AS n FROM v_px WHERE landcover % 4 <> 0 GROUP BY ALL)"


@query("g09_parcel_cells", "v_px", sql=f"""WITH {PARCELS}, a AS (SELECT aoi_id, seed, n, row_number() OVER (PARTITION BY aoi_id, pk ORDER BY (cx - sx) * (cx - sx) + (cy - sy) * (cy - sy), seed) AS r FROM pc JOIN seeds USING (aoi_id)),
b AS (SELECT p.aoi_id, s.seed, row_number() OVER (PARTITION BY p.aoi_id, p.ix, p.iy ORDER BY (p.ix - s.sx) * (p.ix - s.sx) + (p.iy - s.sy) * (p.iy - s.sy), s.seed) AS r FROM v_px p JOIN seeds s USING (aoi_id) WHERE p.landcover % 4 = 0),
u AS (SELECT aoi_id, seed, n FROM a WHERE r = 1 UNION ALL SELECT aoi_id, seed, 1 FROM b WHERE r = 1) SELECT aoi_id, seed, sum(n)::BIGINT AS pixels FROM u GROUP BY ALL""")
def g09(px: DataFrame) -> DataFrame:
    """Cells along lot lines: a whole parcel goes to the seed nearest to its centre, each street pixel to its own nearest seed."""
    seeds = _grid_seeds(px)
    lots = px.where("landcover % 4 <> 0").groupBy("aoi_id", F.floor(F.col("ix") / 7).alias("point_key")).agg(F.floor(F.avg("ix")).cast("double").alias("x"), F.floor(F.avg("iy")).cast("double").alias("y"), F.count("*").alias("n"))
    a = op.nearest(lots.drop("n"), seeds, 12.0, area=AREA).join(lots.select("aoi_id", "point_key", "n"), ["aoi_id", "point_key"]).select("aoi_id", "seed_key", "n")
    every = a.union(op.nearest(_centres(px.where("landcover % 4 = 0")), seeds, 12.0, area=AREA).select("aoi_id", "seed_key", F.lit(1)))
    return every.where("seed_key is not null").groupBy("aoi_id", F.col("seed_key").alias("seed")).agg(F.sum("n").alias("pixels"))


@query("g10_frontage_cells", "v_px", sql="""WITH s AS (SELECT aoi_id, ix, iy, ix // 20 AS label FROM v_px WHERE iy = 20 AND ix % 5 = 0),
d AS (SELECT p.aoi_id, p.ix, p.iy, s.label, row_number() OVER (PARTITION BY p.aoi_id, p.ix, p.iy ORDER BY (p.ix - s.ix) * (p.ix - s.ix) + (p.iy - s.iy) * (p.iy - s.iy), s.ix) AS r FROM v_px p JOIN s USING (aoi_id))
SELECT aoi_id, label, count(*) AS pixels FROM d WHERE r = 1 GROUP BY ALL""")
def g10(px: DataFrame) -> DataFrame:
    """Pixels take the label of their nearest street sample; cells under 20 pixels then merge into a neighbour."""
    found = op.nearest(_centres(px), _street_samples(px), 10.0, area=AREA).where("seed_key is not null")
    key = op.pixel_id(F.col("ix"), F.col("iy"), F.lit(0))
    cells = px.withColumn("point_key", key).join(found, ["aoi_id", "point_key"]).withColumn("label", F.floor(F.col("seed_key") / 20))
    return op.merged_slivers(cells.select(*op.PIXEL, "label"), "label", 20).groupBy("aoi_id", "label").agg(F.count("*").alias("pixels"))


@query("g12_user_layer", "v_lot", "v_node", sql=f"""WITH {METRIC}, u AS (SELECT n_nationkey, {S} * {S} * 0.75 AS area, (n_nationkey * 7) % 30 + CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 100000 END AS declared, {S} * 5 / 12 * 100 AS cx, {S} * 5 / 12 * 100 AS cy FROM v_lot WHERE n_nationkey % 7 <> 6),
d AS (SELECT n_nationkey, min_by(node_key, (sqrt(pow(x - cx, 2) + pow(y - cy, 2)), node_key)) AS near FROM u, m GROUP BY 1)
SELECT u.n_nationkey, round(u.area, 6)::DOUBLE AS area, coalesce(m.node_key, d.near) AS outlet, m.node_key IS NOT NULL AS declared FROM u JOIN d USING (n_nationkey) LEFT JOIN m ON m.node_key = u.declared""")
def g12(nation: DataFrame, nodes: DataFrame) -> DataFrame:
    """A user's catchments as drawn: the declared outlet where it is known, else the nearest node."""
    k2 = F.col("n_nationkey")
    cx, cy = op.ring_centroid(F.col("ring"))
    u = _rings(nation).where("n_nationkey % 7 <> 6").select("n_nationkey", F.round(op.ring_area(F.col("ring")), 6).alias("area"), ((k2 * 7) % 30 + F.when(k2 % 2 == 0, 0).otherwise(100_000)).cast("long").alias("want"), (cx * 100).alias("x"), (cy * 100).alias("y"))
    m = _metric(nodes)
    near = op.by_place(u.select(k2.cast("long").alias("point_key"), "x", "y"), lambda p: op.nearest(p, m, 500.0)).select(F.col("point_key").alias("n_nationkey"), F.col("seed_key").alias("near"))
    known = m.select(F.col("seed_key").alias("want"), F.lit(True).alias("known"))
    x = u.join(near, "n_nationkey").join(known, "want", "left")
    return x.select("n_nationkey", "area", F.when(F.col("known"), F.col("want")).otherwise(F.col("near")).alias("outlet"), F.coalesce("known", F.lit(False)).alias("declared"))
