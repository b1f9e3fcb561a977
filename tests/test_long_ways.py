"""Steps that grew faster than their input: long segments, points that share places, levels that are filled, ties of rounding."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from catchwork.operators import grid, network
from catchwork.plans.network import _snap


def test_a_segment_of_any_length_stands_in_few_squares(spark):
    """A segment of 3 million km would name more buckets of 1 m than a sequence holds; a short one beside it is found, too."""
    segments = spark.createDataFrame([("long", 1, -1e9, 0.0, 2, 2e9, 0.0), ("short", 3, 5.0, 2.0, 4, 6.0, 2.0)], "name string, a_key long, ax double, ay double, b_key long, bx double, by double")
    points = spark.createDataFrame([(1, 0.0, 0.5), (2, 5.5, 1.5), (3, 1.9e9, -1.0), (4, 0.0, 1.5), (5, -1e9 - 0.5, 0.0)], "point_key long, x double, y double")
    got = {r.point_key: (r.name, r.end_key, r.distance) for r in grid.nearest_segment(points, segments, 1.0).collect()}
    assert got == {1: ("long", 1, 0.5), 2: ("short", 3, 0.5), 3: ("long", 2, 1.0), 5: ("long", 1, 0.5)}


def test_points_of_one_place_are_looked_up_once(spark):
    points = spark.range(1000).select(F.col("id").alias("point_key"), (F.col("id") % 2 * 10.0).alias("x"), F.lit(0.0).alias("y"))
    seeds = spark.createDataFrame([(7, 1.0, 0.0), (8, 1.0, 0.0), (9, 900.0, 0.0)], "seed_key long, sx double, sy double")
    asked = []

    def found(places):
        asked.append(places.count())
        return grid.nearest(places, seeds, 2.0)

    got = {(r.point_key, r.seed_key, r.distance) for r in grid.by_place(points, found).collect()}
    assert asked == [2] and got == {(i, 7, 9.0 if i % 2 else 1.0) for i in range(1000)}


def test_filled_levels_are_written_once(spark, monkeypatch):
    """A known level is not written again in the rounds after, and edges go once nodes are filled."""
    sizes, plain = [], network.written

    def counted(df, name):
        out = plain(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(network, "written", counted)
    nodes = spark.range(200).select(F.col("id").alias("node_key"), F.when(F.col("id") % 10 < 8, F.col("id") * 1.0).alias("invert_m"), F.lit(None).cast("double").alias("ground_m"), F.lit(None).cast("double").alias("dem_m"))
    edges = spark.range(199).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node_key: (r.invert_m, r.source) for r in network.filled_inverts(nodes, edges, 2).collect()}
    for i in range(200):
        want = (float(i), "data") if i % 10 < 8 else (float(i - 1), "neighbour") if i % 10 == 8 else (float(i + 1) if i < 199 else float(i - 2), "neighbour")
        assert got[i] == want, i
    assert sum(sizes) <= 500  # nodes once, edges to nodes without a level, and these; every round wrote all 200 nodes before, and 398 edges


def test_ties_of_snapping_do_not_depend_on_float_noise(spark):
    places = [f"484e-1 + floor({n} / 10) * 1e-3" for n in range(0, 6000, 50)]
    ours = spark.sql("SELECT " + ", ".join(f"round({p}, 2)" for p in places)).first()
    theirs = duckdb.connect().execute("SELECT " + ", ".join(f"{_snap(p)}::DOUBLE" for p in places)).fetchone()
    assert list(ours) == list(theirs)


def test_parts_link_runs_not_pixels(spark, monkeypatch):
    """A block of 10 by 10 pixels is 10 runs and 9 links; gaps, other labels and null labels part runs."""
    counts, plain = [], grid.connected_components
    monkeypatch.setattr(grid, "connected_components", lambda edges: counts.append(edges.count()) or plain(edges))
    cells = [(1, x, y, "a") for x in range(10) for y in range(10)] + [(1, 20, 0, "a"), (1, 22, 0, "a"), (1, 23, 0, "b"), (1, 23, 1, None), (1, 24, 1, None), (2, 10, 0, "a")]
    px = spark.createDataFrame(cells, "aoi_id long, ix long, iy long, kind string")
    got = {(r.aoi_id, r.ix, r.iy): r.part for r in grid.parts(px, "kind").collect()}
    key = lambda a, x, y: (a * 1_000_000 + y) * 1_000_000 + x
    want = {(1, x, y): key(1, 0, 0) for x in range(10) for y in range(10)} | {c: key(*c) for c in ((1, 20, 0), (1, 22, 0), (1, 23, 0), (1, 23, 1), (2, 10, 0))} | {(1, 24, 1): key(1, 23, 1)}
    assert got == want and counts == [9]
