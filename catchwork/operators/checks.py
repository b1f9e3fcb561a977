"""Checks of catchments: summaries and outliers of each area, by percentiles and joins with one row an area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwork import constants as k
from catchwork.frames import ranked
from catchwork.operators.grid import inside
from catchwork.operators.quantiles import percentiles


def order_statistic(rows: DataFrame, value: str, by: str, share: float, upper: bool = False) -> DataFrame:
    """(by, q): the value of each group at place share * (n - 1) in ascending order, rounded down, or up. Exact: the interpolated percentile lies between the two values at its sides, so the last one up to it, or the first one from it on, is meant."""
    p = percentiles(rows.where(F.col(value).isNotNull()), [by], value, share, "_p")
    near = rows.join(p, by)
    pick = F.min(F.when(F.col(value) >= F.col("_p"), F.col(value))) if upper else F.max(F.when(F.col(value) <= F.col("_p"), F.col(value)))
    return near.groupBy(by).agg(pick.alias("q"))


def catchment_checks(catchments: DataFrame, nodes: DataFrame) -> DataFrame:
    """(aoi_id, check, severity, passed, n_bad): an area's catchments without an outlet, with one that is no node, without a positive area, without a polygon (a warning), with hydraulics that are no finite number, and how many names occur more than once.

    catchments: (aoi_id, name, outlet_key, area_ha, has_polygon, pct_imperv), null as missing; nodes: (node_key). Names are compared whole; null names are nobody's.
    """
    known = nodes.select(F.col("node_key").alias("outlet_key"), F.lit(True).alias("_known")).distinct()
    x = catchments.join(known, "outlet_key", "left")
    finite = F.coalesce(F.abs("pct_imperv") < float("inf"), F.lit(True))
    rules = {
        "outlet_present": ("error", F.col("outlet_key").isNull()), "outlet_exists": ("error", F.col("_known").isNull()), "area_positive": ("error", ~F.coalesce(F.col("area_ha") > 0, F.lit(False))),
        "geometry_absent": ("warning", ~F.coalesce("has_polygon", F.lit(False))), "finite_hydraulics": ("error", ~finite),
    }
    counts = x.groupBy("aoi_id").agg(*(F.count_if(bad).alias(name) for name, (_, bad) in rules.items()))
    twice = catchments.where("name is not null").groupBy("aoi_id", "name").count().where("count > 1").groupBy("aoi_id").agg(F.count("*").alias("unique_ids"))
    counts = counts.join(twice, "aoi_id", "left").withColumn("unique_ids", F.coalesce("unique_ids", F.lit(0)))
    listed = F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.col(n).cast("long").alias("n_bad")) for n, s in [*((n, s) for n, (s, _) in rules.items()), ("unique_ids", "error")])))
    return counts.select("aoi_id", listed.alias("c")).select("aoi_id", "c.check", "c.severity", (F.col("c.n_bad") == 0).alias("passed"), "c.n_bad")


def distance_summary(rows: DataFrame, value: str, by: str, warn_m: float = 20.0, error_m: float = 50.0) -> DataFrame:
    """(by, max_m, p95_m, n_20_50, n_over_50): largest distance, 95th percentile (lower of the two values beside it), and how many lie over the two limits."""
    m = F.col(value)
    x = rows.groupBy(by).agg(F.max(m).alias("max_m"), F.count_if((m > warn_m) & (m <= error_m)).alias("n_20_50"), F.count_if(m > error_m).alias("n_over_50"))
    return x.join(order_statistic(rows, value, by, 0.95).withColumnRenamed("q", "p95_m"), by, "left").select(by, "max_m", "p95_m", "n_20_50", "n_over_50")


def shape_outliers(cells: DataFrame, by: str, factor: float = k.SHAPE_AREA_FACTOR, thinness: float = k.SHAPE_THINNESS) -> DataFrame:
    """Cells over factor times the upper median area of their group, under a factor-th of it, or more elongated than thinness, with the flags large, small and elongated. cells has area_ha and thinness."""
    med = order_statistic(cells, "area_ha", by, 0.5, upper=True).withColumnRenamed("q", "_med")
    x = cells.join(med, by).withColumn("large", F.col("area_ha") > factor * F.col("_med")).withColumn("small", F.col("area_ha") < F.col("_med") / factor)
    return x.withColumn("elongated", F.col("thinness") > thinness).where("large or small or elongated").drop("_med")


def outlet_agreement(units: DataFrame, areas: DataFrame, outfalls: DataFrame, square: float = 100.0) -> DataFrame:
    """(unit, bucket): how the outfall that a unit's outlet leads to compares with the one that the official area around the unit declares.

    units: (aoi_id, unit, x, y, ours), x and y null without a geometry, ours null where no outfall is reached; areas: (aoi_id, ring, declared), the
    lesser declared one where areas overlap; outfalls: (aoi_id, name, synthesised). Points and areas meet in squares, so it is an equi-join. The
    first bucket that applies: no_geometry, outside_official, reaches_no_outfall, left_extract (ours was made up at the border), declared_unknown, agree, disagree.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    span = lambda v: F.explode(F.sequence(F.floor(F.array_min(v) / square), F.floor(F.array_max(v) / square)))
    a = areas.where("declared is not null").withColumn("_i", span(xs)).withColumn("_j", span(ys))
    p = units.withColumn("_i", F.floor(F.col("x") / square)).withColumn("_j", F.floor(F.col("y") / square))
    match = p.join(a, ["aoi_id", "_i", "_j"]).where(inside(F.col("ring"), F.col("x"), F.col("y"))).groupBy("aoi_id", "unit").agg(F.min("declared").alias("declared"))
    known = outfalls.select("aoi_id", F.col("name").alias("declared"), F.lit(True).alias("_known"))
    made = outfalls.where("synthesised").select("aoi_id", F.col("name").alias("ours"), F.lit(True).alias("_made"))
    x = units.join(match, ["aoi_id", "unit"], "left").join(known, ["aoi_id", "declared"], "left").join(made, ["aoi_id", "ours"], "left")
    bucket = (
        F.when(F.col("x").isNull() | F.col("y").isNull(), "no_geometry").when(F.col("declared").isNull(), "outside_official").when(F.col("ours").isNull(), "reaches_no_outfall")
        .when(F.col("_made"), "left_extract").when(F.col("_known").isNull(), "declared_unknown").when(F.col("ours") == F.col("declared"), "agree").otherwise("disagree")
    )
    return x.select("aoi_id", "unit", bucket.alias("bucket"))


def agreement_rate(buckets: DataFrame) -> DataFrame:
    """Counts of each bucket by area, the rate over comparable units (null without any) and their share of all units in percent."""
    n = lambda *b: F.count_if(F.col("bucket").isin(*b))
    both = n("agree", "disagree")
    out = {"n_agree": "agree", "n_no_geometry": "no_geometry", "n_outside": "outside_official", "n_no_outfall": "reaches_no_outfall", "n_left": "left_extract", "n_unknown": "declared_unknown"}
    counts = [n(b).alias(name) for name, b in out.items()]
    return buckets.groupBy("aoi_id").agg(*counts, both.alias("n_comparable"), F.round(n("agree") / F.nullif(both, F.lit(0)), 6).alias("rate"), F.round(100 * both / F.count("*"), 1).alias("pct_scored"))


def method_labels(runs: DataFrame) -> DataFrame:
    """runs with label and confidence of their delineation, from the table of methods. They have method (the delineator's own name), seeded_on and kerbed; what no row fits is the nearest-node method."""
    m, inlets = F.col("method"), (F.col("method") == "junction_dem") & (F.col("seeded_on") == "catch_basin")
    rules = {"street": m == "junction_street_segment", "inlets_kerbed": inlets & F.col("kerbed"), "inlets": inlets, "parcel": m.contains("parcel-shaped"), "voronoi": m.contains("voronoi-shaped"), "terrain": m == "junction_dem"}
    key = F.coalesce(*(F.when(rule, name) for name, rule in rules.items()), F.lit("nearest"))
    return runs.withColumn("label", k.lookup({n: v[0] for n, v in k.METHODS.items()}, key)).withColumn("confidence", k.lookup({n: v[1] for n, v in k.METHODS.items()}, key))


def noise_share(cells: DataFrame, by: str, least_ha: float = k.NOISE_HA, majority: float = k.NOISE_SHARE) -> DataFrame:
    """(by, noise_share, mostly_noise): share of a group's cells under least_ha, and whether it is over majority. A cell without an area is not counted."""
    share = F.avg((F.col("area_ha") < least_ha).cast("int"))
    return cells.groupBy(by).agg(share.alias("noise_share"), (share > majority).alias("mostly_noise"))


def samples(rows: DataFrame, by: str, name: str, *first: str, n: int = 10) -> DataFrame:
    """(by, sample): the names of a group's first n rows in the order of the columns in first, then name, joined by commas. Ranges of a group are ranked apart, so no task holds it whole; null names take a place and are not shown."""
    x = ranked(rows.select(by, name, *first), [F.col(by)], [*first, name], "_r").where(F.col("_r") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_r", F.col(name).cast("string").alias("name"))))
    return x.groupBy(by).agg(F.array_join(F.transform(listed, lambda v: v["name"]), ",").alias("sample"))


def delineation_decisions(areas: DataFrame) -> DataFrame:
    """areas with the decision on their delineation, the first that applies. They have corridor (a service mask is given), streets, has_dem, overlaps, slope_pct, gate_pct, n_cells, n_errors and noise_share; null counts as not met.

    Along a corridor, streets give frontage cells unless these are mostly noise, else nearest-node cells. Elsewhere terrain decides if there is any, it reaches the area, is
    steep enough, gives cells, passes its checks and is not mostly noise.
    """
    noise = F.col("noise_share") > k.NOISE_SHARE
    rules = {
        "corridor_voronoi": F.col("corridor") & ~F.coalesce("streets", F.lit(False)), "noise_cell_fallback": F.col("corridor") & noise, "corridor_frontage": F.col("corridor"), "no_dem": ~F.coalesce("has_dem", F.lit(False)), "no_dem_overlap": ~F.coalesce("overlaps", F.lit(False)),
        "below_slope_gate": F.col("slope_pct") < F.col("gate_pct"), "dem_degenerate": F.coalesce("n_cells", F.lit(0)) == 0, "posterior_fallback": F.col("n_errors") > 0,
    }
    return areas.withColumn("decision", F.coalesce(*(F.when(rule, name) for name, rule in rules.items()), F.when(noise, "noise_cell_fallback"), F.lit("dem")))


def containment(cells: DataFrame, area: DataFrame, most: float = k.CELL_OUTSIDE_ERROR, share: float = k.AREA_OUTSIDE_WARNING) -> DataFrame:
    """(aoi_id, n_mostly_outside, outside_fraction, verdict): cells of which more than `most` lies outside their area, and the share of all covered land outside it. cells: (aoi_id, cell, ix, iy); area: (aoi_id, ix, iy)."""
    inner = area.select("aoi_id", "ix", "iy", F.lit(True).alias("_in")).distinct()
    x = cells.join(inner, ["aoi_id", "ix", "iy"], "left").withColumn("_out", F.col("_in").isNull())
    bad = x.groupBy("aoi_id", "cell").agg((F.count_if("_out") > most * F.count("*")).alias("bad")).groupBy("aoi_id").agg(F.count_if("bad").alias("n_mostly_outside"))
    once = x.groupBy("aoi_id", "ix", "iy").agg(F.bool_or("_out").alias("_out")).groupBy("aoi_id").agg((F.count_if("_out") / F.count("*")).alias("outside_fraction"))
    verdict = F.when(F.col("n_mostly_outside") > 0, "error").when(F.col("outside_fraction") > share, "warning").otherwise("ok")
    return bad.join(once, "aoi_id").withColumn("verdict", verdict)


def node_coverage(nodes: DataFrame, cells: DataFrame, area: DataFrame) -> DataFrame:
    """(aoi_id, n_nodes, n_in_area, n_uncovered): an area's nodes, those on its land, and those of them that no cell covers. nodes: (aoi_id, node_key, ix, iy)."""
    place = ["aoi_id", "ix", "iy"]
    x = nodes.join(area.select(*place, F.lit(True).alias("_in")).distinct(), place, "left").join(cells.select(*place, F.lit(True).alias("_held")).distinct(), place, "left")
    return x.groupBy("aoi_id").agg(F.count("*").alias("n_nodes"), F.count("_in").alias("n_in_area"), F.count_if(F.col("_in").isNotNull() & F.col("_held").isNull()).alias("n_uncovered"))
