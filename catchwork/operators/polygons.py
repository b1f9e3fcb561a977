"""Polygons with holes: a feature is any number of rings, and what it covers is decided by the parity of crossings over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchwork import constants as k
from catchwork.frames import written
from catchwork.operators.grid import ring_area, ring_centroid, ring_perimeter

# rings: (feature, ring_no, ring), ring an array of structs (x, y), the first and last equal. vertices: (feature, ring_no, i, x, y).


def rings_of(vertices: DataFrame) -> DataFrame:
    """Rings from their vertices in order."""
    points = F.array_sort(F.collect_list(F.struct("i", "x", "y")))  # the vertices of one ring
    return vertices.groupBy("feature", "ring_no").agg(F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))


def edges_of(rings: DataFrame) -> DataFrame:
    """(feature, ring_no, edge_no, x1, y1, x2, y2)."""
    n = F.size("ring")
    pairs = F.arrays_zip(F.slice("ring", F.lit(1), n - 1).alias("p"), F.slice("ring", F.lit(2), n - 1).alias("q"))
    e = rings.where(n > 1).select("feature", "ring_no", F.posexplode(pairs).alias("edge_no", "e"))
    return e.select("feature", "ring_no", "edge_no", F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))


def _banded(edges: DataFrame, band: float) -> DataFrame:
    """Edges in every band of y that they touch; level ones cross no ray."""
    at = lambda f: F.floor(f("y1", "y2") / band)
    return edges.where("y1 <> y2").withColumn("band", F.explode(F.sequence(at(F.least), at(F.greatest))))


def _crossed(x: Column, y: Column) -> Column:
    """Whether an edge crosses the ray from a point to the right."""
    at = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    return ((F.col("y1") > y) != (F.col("y2") > y)) & (x < at)


def nested(rings: DataFrame, band: float) -> DataFrame:
    """rings with depth (how many rings of the feature hold its first vertex), hole (an odd depth) and parent (the smallest of those rings, null at depth 0).

    Vertices meet the edges of their feature's other rings in their band of y only.
    """
    sized = written(rings.withColumn("size", F.abs(ring_area(F.col("ring")))), "rings_sized")
    first = sized.select("feature", F.col("ring_no").alias("own"), F.col("ring")[0]["x"].alias("x"), F.col("ring")[0]["y"].alias("y")).withColumn("band", F.floor(F.col("y") / band))
    met = first.join(_banded(edges_of(sized), band), ["feature", "band"]).where(F.col("own") != F.col("ring_no")).where(_crossed(F.col("x"), F.col("y")))
    around = met.groupBy("feature", "own", "ring_no").agg(F.count("*").alias("n")).where("n % 2 = 1").join(sized.select("feature", "ring_no", "size"), ["feature", "ring_no"])
    above = around.groupBy("feature", F.col("own").alias("ring_no")).agg(F.count("*").alias("depth"), F.min(F.struct("size", "ring_no")).alias("m"))
    x = sized.join(above, ["feature", "ring_no"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    return x.select("feature", "ring_no", "ring", "size", "depth", (F.col("depth") % 2 == 1).alias("hole"), F.col("m.ring_no").alias("parent"))


def measures(found: DataFrame) -> DataFrame:
    """(feature, area, hole_area, perimeter, cx, cy, n_shells, n_holes) of the rings of nested: holes count against area and centroid, and for the perimeter."""
    x, y = ring_centroid(F.col("ring"))
    net = F.when(F.col("hole"), -F.col("size")).otherwise(F.col("size"))
    each = found.select("feature", "hole", "size", net.alias("net"), ring_perimeter(F.col("ring")).alias("p"), x.alias("x"), y.alias("y"))
    total = lambda c: F.sum(F.col("net") * F.coalesce(c, F.lit(0.0))) / F.nullif(F.sum("net"), F.lit(0.0))
    return each.groupBy("feature").agg(F.sum("net").alias("area"), F.coalesce(F.sum(F.when(F.col("hole"), F.col("size"))), F.lit(0.0)).alias("hole_area"), F.sum("p").alias("perimeter"), total("x").alias("cx"), total("y").alias("cy"), F.count_if(~F.col("hole")).alias("n_shells"), F.count_if("hole").alias("n_holes"))


def parts_of(found: DataFrame) -> DataFrame:
    """(feature, part, area): shells with the holes right inside them taken off; part is the shell's ring_no."""
    part = F.when(F.col("hole"), F.col("parent")).otherwise(F.col("ring_no"))
    return found.groupBy("feature", part.alias("part")).agg(F.sum(F.when(F.col("hole"), -F.col("size")).otherwise(F.col("size"))).alias("area"))


def largest_parts(found: DataFrame) -> DataFrame:
    """(feature, part, area): the largest part of each feature, the lesser ring of equals."""
    best = parts_of(found).groupBy("feature").agg(F.max(F.struct("area", (-F.col("part")).alias("p"))).alias("m"))
    return best.select("feature", (-F.col("m.p")).alias("part"), "m.area")


def boxes_of(rings: DataFrame) -> DataFrame:
    """(feature, x1, y1, x2, y2): the box around all rings of a feature."""
    side = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    each = rings.select("feature", side(F.array_min, "x").alias("x1"), side(F.array_min, "y").alias("y1"), side(F.array_max, "x").alias("x2"), side(F.array_max, "y").alias("y2"))
    return each.groupBy("feature").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def in_boxes(points: DataFrame, boxes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points (*keys, x, y, ...) with every box (*keys, x1, y1, x2, y2, ...) of their keys that holds them, edges included. Other column names are all different.

    A box names the squares of its own size, a power of two, that it touches: nine at most. A point names its square of each size that occurs. So
    large and small boxes meet points by one equi-join.
    """
    level = F.ceil(F.log2(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(1e-9)))).cast("int")
    b = boxes.where("x1 <= x2 and y1 <= y2").withColumn("_level", level)
    levels = [r[0] for r in b.select("_level").distinct().collect()]  # exponents of two: a few dozen at most
    square = lambda c, l: F.floor(c / F.pow(F.lit(2.0), l))
    span = lambda p, q: F.explode(F.sequence(square(F.col(p), F.col("_level")), square(F.col(q), F.col("_level"))))
    b = b.withColumn("_sx", span("x1", "x2")).withColumn("_sy", span("y1", "y2"))
    p = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    p = p.withColumn("_sx", square(F.col("x"), F.col("_level"))).withColumn("_sy", square(F.col("y"), F.col("_level")))
    return p.join(b, [*keys, "_level", "_sx", "_sy"]).where("x between x1 and x2 and y between y1 and y2").drop("_level", "_sx", "_sy")


def points_inside(points: DataFrame, rings: DataFrame, band: float) -> DataFrame:
    """(point_key, feature) for points (point_key, x, y) inside a feature: an odd number of edges of all its rings crosses the ray to the right. Boxes first, then only edges in the point's band of y."""
    near = in_boxes(points.select("point_key", "x", "y"), boxes_of(rings)).select("point_key", "feature", "x", "y").withColumn("band", F.floor(F.col("y") / band))
    met = near.join(_banded(edges_of(rings), band), ["feature", "band"]).where(_crossed(F.col("x"), F.col("y")))
    return met.groupBy("point_key", "feature").agg(F.count("*").alias("n")).where("n % 2 = 1").select("point_key", "feature")


def filled_spans(rings: DataFrame, cell: float = 1.0) -> DataFrame:
    """(feature, iy, from, upto): the grid cells of each row whose centres a feature covers, from and upto included, even-odd over all its rings, so holes stay open and rings that cross themselves are filled too."""
    e = edges_of(rings).where("y1 <> y2")
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = e.withColumn("iy", F.explode(F.sequence(F.ceil(lo / cell - 0.5), F.ceil(hi / cell - 0.5)))).withColumn("yc", (F.col("iy") + 0.5) * cell)
    rows = rows.where((F.col("yc") >= lo) & (F.col("yc") < hi))
    at = F.col("x1") + (F.col("yc") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    line = rows.groupBy("feature", "iy").agg(F.array_sort(F.collect_list(at)).alias("xs"))  # a feature's crossings of one row of pixels
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.get("xs", 2 * i).alias("a"), F.get("xs", 2 * i + 1).alias("b")))
    spans = line.where("size(xs) >= 2").select("feature", "iy", F.explode(pairs).alias("p")).withColumn("from", F.ceil(F.col("p.a") / cell - 0.5)).withColumn("upto", F.ceil(F.col("p.b") / cell - 0.5) - 1)
    return spans.where("upto >= from").select("feature", "iy", "from", "upto")


def filled(rings: DataFrame, cell: float = 1.0) -> DataFrame:
    """(feature, ix, iy): the grid cells of filled_spans, one by one."""
    return filled_spans(rings, cell).select("feature", F.explode(F.sequence("from", "upto")).alias("ix"), "iy")


def covered_cells(spans: DataFrame, by: str) -> DataFrame:
    """(by, cells): how many different grid cells the spans (by, iy, from, upto) cover. In each row a span counts from where the earlier ones end, so cells are never listed."""
    earlier = Window.partitionBy(by, "iy").orderBy("from", "upto").rowsBetween(Window.unboundedPreceding, -1)
    first = F.greatest("from", F.max("upto").over(earlier) + 1)
    own = spans.select(by, "iy", (F.col("upto") - first + 1).alias("_n"))
    return own.groupBy(by).agg(F.sum(F.greatest("_n", F.lit(0))).alias("cells"))


def crossing_pairs(rings: DataFrame, band: float) -> DataFrame:
    """(feature, n_crossings): pairs of edges of a feature, of one ring or of two, that cross each other properly; features without any are left out. Edges meet in squares of `band` that their boxes share."""
    at = lambda f, p, q: F.floor(f(p, q) / band)
    e = edges_of(rings).withColumn("id", F.struct("ring_no", "edge_no"))
    e = e.withColumn("sx", F.explode(F.sequence(at(F.least, "x1", "x2"), at(F.greatest, "x1", "x2")))).withColumn("sy", F.explode(F.sequence(at(F.least, "y1", "y2"), at(F.greatest, "y1", "y2"))))
    e = e.select("feature", "sx", "sy", "id", "x1", "y1", "x2", "y2")
    o = e.select("feature", "sx", "sy", *(F.col(c).alias(f"{c}_") for c in ("id", "x1", "y1", "x2", "y2")))
    c = F.col
    side = lambda a, b, p: F.signum((c(f"x2{b}") - c(f"x1{b}")) * (c(f"y{p}{a}") - c(f"y1{b}")) - (c(f"y2{b}") - c(f"y1{b}")) * (c(f"x{p}{a}") - c(f"x1{b}")))
    cross = (side("", "_", 1) * side("", "_", 2) < 0) & (side("_", "", 1) * side("_", "", 2) < 0)
    pairs = e.join(o, ["feature", "sx", "sy"]).where((c("id") < c("id_")) & cross).select("feature", "id", "id_").distinct()
    return pairs.groupBy("feature").agg(F.count("*").alias("n_crossings"))


def without_remainders(found: DataFrame, most: float = 0.5) -> DataFrame:
    """(feature): features whose holes take at most that share of what their shells enclose. A street area published as one parcel with all lots as holes goes."""
    shells = F.sum(F.when(~F.col("hole"), F.col("size")))
    holes = F.coalesce(F.sum(F.when(F.col("hole"), F.col("size"))), F.lit(0.0))
    return found.groupBy("feature").agg(shells.alias("s"), holes.alias("h")).where(F.col("h") <= most * F.col("s")).select("feature")


def largest_extents(layers: DataFrame) -> DataFrame:
    """(city_key, system, x1, y1, x2, y2): the largest box among an area's layers, the least layer_id of equals. layers: (city_key, system, layer_id, x1, y1, x2, y2), null where a layer states none."""
    size = F.abs((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    best = layers.where(size.isNotNull()).groupBy("city_key", "system").agg(F.max_by(F.struct("x1", "y1", "x2", "y2"), F.struct(size, -F.col("layer_id"))).alias("b"))
    return best.select("city_key", "system", "b.x1", "b.y1", "b.x2", "b.y2")


def scoped_counts(layers: DataFrame, anchors: DataFrame) -> DataFrame:
    """(city_key, system, n_city_wide, n_features, scoped): anchors of a city's system, all of them and those within the largest extent of its area layers. Without an extent all count, and scoped is false, so that a missing bound shows. anchors: (city_key, system, x, y)."""
    key = ("city_key", "system")
    extents = written(largest_extents(layers), "extents")
    inner = in_boxes(anchors.select(*key, "x", "y"), extents, key).groupBy(*key).agg(F.count("*").alias("inside"))
    every = anchors.groupBy(*key).agg(F.count("*").alias("n_city_wide"))
    x = every.join(extents.select(*key, F.lit(True).alias("has")), list(key), "left").join(inner, list(key), "left")
    scoped = F.coalesce("has", F.lit(False))
    return x.select(*key, "n_city_wide", F.when(scoped, F.coalesce("inside", F.lit(0))).otherwise(F.col("n_city_wide")).alias("n_features"), scoped.alias("scoped"))


def oriented_rings(found: DataFrame) -> DataFrame:
    """The rings of nested in canonical order: shells anticlockwise, holes clockwise."""
    backward = (ring_area(F.col("ring")) < 0) != F.col("hole")
    return found.withColumn("ring", F.when(backward, F.reverse("ring")).otherwise(F.col("ring")))


def area_checks(areas: DataFrame, rings: DataFrame, cell: float, most: float) -> DataFrame:
    """(area_id, area, west, south, east, north, verdict): what an area of one or several features covers, each place once, its box to 6 decimals, and the first thing wrong with it: unsupported_frame, no_area, too_large, or ok.

    areas: (area_id, frame), frame null or the name of longitude and latitude; rings: (area_id, feature, ring_no, ring), feature unique among all areas. Features that overlap are
    dissolved as rows of pixels of size cell; most bounds the area.
    """
    of = rings.select("feature", "area_id").distinct()
    covered = covered_cells(filled_spans(rings, cell).join(of, "feature"), "area_id").select("area_id", (F.col("cells") * cell * cell).alias("area"))
    box = boxes_of(rings.withColumn("feature", F.col("area_id"))).select(F.col("feature").alias("area_id"), *(F.round(a, 6).alias(b) for a, b in (("x1", "west"), ("y1", "south"), ("x2", "east"), ("y2", "north"))))
    known = F.col("frame").isNull() | F.exists(F.array(*map(F.lit, k.FRAMES)), lambda n: F.contains(F.col("frame"), n))
    x = areas.join(covered, "area_id", "left").join(box, "area_id", "left").withColumn("area", F.coalesce("area", F.lit(0.0)))
    verdict = F.when(~known, "unsupported_frame").when(F.col("area") == 0, "no_area").when(F.col("area") > most, "too_large").otherwise("ok")
    return x.select("area_id", "area", "west", "south", "east", "north", verdict.alias("verdict"))
