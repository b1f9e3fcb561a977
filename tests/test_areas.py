"""Outlet agreement, street labels, station texts and coverage on hand-made rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchwork.operators import catalogue, checks, forcing, grid
from catchwork.sources import features as src


def square(x, y, size):
    return [{"x": x, "y": y}, {"x": x + size, "y": y}, {"x": x + size, "y": y + size}, {"x": x, "y": y + size}, {"x": x, "y": y}]


RING = "ring array<struct<x:double,y:double>>"


def test_outlet_agreement(spark):
    areas = spark.createDataFrame([(1, square(0.0, 0.0, 250.0), "O1"), (1, square(300.0, 0.0, 50.0), "O9"), (1, square(500.0, 0.0, 50.0), None), (2, square(0.0, 0.0, 9.0), "O1")], f"aoi_id int, {RING}, declared string")
    outfalls = spark.createDataFrame([(1, "O1", False), (1, "O2", False), (1, "X", True)], "aoi_id int, name string, synthesised boolean")
    units = [("a", 10.0, 240.0, "O1"), ("b", 10.0, 240.0, "O2"), ("c", None, None, "O1"), ("d", 260.0, 10.0, "O1"), ("e", 10.0, 10.0, None), ("f", 10.0, 10.0, "X"), ("g", 310.0, 10.0, "O1"), ("h", 510.0, 10.0, "O1")]
    units = spark.createDataFrame([(1, *u) for u in units], "aoi_id int, unit string, x double, y double, ours string")
    found = checks.outlet_agreement(units, areas, outfalls)
    assert {r.unit: r.bucket for r in found.collect()} == {"a": "agree", "b": "disagree", "c": "no_geometry", "d": "outside_official", "e": "reaches_no_outfall", "f": "left_extract", "g": "declared_unknown", "h": "outside_official"}
    r = checks.agreement_rate(found).first()
    assert (r.n_agree, r.n_comparable, r.rate, r.pct_scored) == (1, 2, 0.5, 25.0)
    assert checks.agreement_rate(found.where("bucket = 'no_geometry'")).first().rate is None


def test_street_labels(spark):
    streets = spark.createDataFrame([("s", 0.5, 1, 2), ("flat", None, 3, 4), ("falls", 0.0, 5, 6)], "name string, crest double, a_key int, b_key int")
    inlets = spark.createDataFrame([("s", 0.2, 20), ("s", 0.4, 40), ("s", 0.9, 90), ("flat", 0.1, 10)], "name string, t double, node_key int")
    samples = spark.createDataFrame([("s", t) for t in (0.0, 0.1, 0.2, 0.3, 0.45, 0.5, 0.9, 0.95)] + [("flat", 0.5), ("flat", 0.6), ("falls", 0.0)], "name string, t double")
    got = {(r.name, r.t): r.node_key for r in grid.street_labels(samples, streets, inlets).collect()}
    assert got == {("s", 0.0): 1, ("s", 0.1): 1, ("s", 0.2): 20, ("s", 0.3): 20, ("s", 0.45): 40, ("s", 0.5): 90, ("s", 0.9): 90, ("s", 0.95): 2, ("flat", 0.5): 3, ("flat", 0.6): 4, ("falls", 0.0): 6}


def test_coefficients(spark):
    text = "Table 3\nStatistics 2yr 5yr\nCoefficient (A)  20.1 27.0 31.5 -99.9 41.6 45.0\nExponent    (B)  -0.65 -0.66 -0.67 -0.68 -0.69 -0.70\nMean % Error 1 2"
    rows = spark.createDataFrame([("p", text), ("short", "Coefficient (A) 1.0 2.0\nExponent (B) 1 2"), ("none", None)], "path string, value string")
    got = {(r.path, r.years): (r.a, r.b) for r in src.idf_coefficients(rows).collect()}
    assert got == {("p", 2): (20.1, -0.65), ("p", 5): (27.0, -0.66), ("p", 10): (31.5, -0.67), ("p", 50): (41.6, -0.69), ("p", 100): (45.0, -0.70)}


def test_coverage(spark):
    counts = spark.createDataFrame([(1, "storm_minor", 3), (1, "sanitary", 2), (2, "storm_minor", 1)], "city_key int, system string, n int")
    facts = spark.createDataFrame([(1, 0.0, 1.0, 2.0, 3.0, 0.4, 0.2)], "city_key int, west double, south double, east double, north double, typical_error_m double, filled double")
    got = {r.city_key: (r.systems, r.n_features, r.has_sanitary, r.east, r.tier) for r in catalogue.coverage_summary(counts, facts).collect()}
    assert got == {1: ("sanitary,storm_minor", 5, True, 2.0, "B"), 2: ("storm_minor", 1, False, None, None)}


def test_ranked_stations(spark):
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 170.0, 80.0)], "aoi_id int, x double, y double")
    stations = spark.createDataFrame([(i, float(i), 0.0) for i in range(5)] + [(0, 0.0, 0.0)], "station_key int, lon double, lat double")
    away = F.sqrt(F.pow(F.col("lon") - F.col("x"), 2) + F.pow(F.col("lat") - F.col("y"), 2))
    got = {(r.aoi_id, r.rank): r.station_key for r in forcing.ranked_stations(places, stations, 2, away, 1.0, 1.0, 0.1).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (2, 1): 4, (2, 2): 3}
