"""Operators on hand-made rows."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from catchwork.frames import bucket_bits, prefix_sum
from catchwork.functions import values as v
from catchwork.operators import forcing, grid, ingest, loading, network
from catchwork.operators.components import connected_components
from catchwork.operators.grid import spaced
from catchwork.sources import features


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "zero", "want"), [("12.5", False, 12.5), (" 7 ", False, 7.0), ("", False, None), ("abc", False, None), ("0", True, None), ("0", False, 0.0), (None, False, None), ("-3", True, -3.0)])
def test_number(spark, text, zero, want):
    assert one(spark, v.number(F.lit(text).cast("string"), zero)) == want


@pytest.mark.parametrize(("value", "policy", "want"), [(0.0, "zero", None), (0.0, "none", 0.0), (-99.0, "below:-90", None), (-1.5, "below:-90", -1.5), (None, "zero", None)])
def test_sentinels(spark, value, policy, want):
    assert one(spark, v.without_sentinel(F.lit(value).cast("double"), F.lit(policy))) == want


def test_shape_needs_both_dimensions(spark):
    shape = lambda raw, h, w: tuple(one(spark, v.section_shape(F.lit(raw).cast("string"), F.lit(h).cast("double"), F.lit(w).cast("double"))))
    assert shape("box", 1.0, 2.0) == ("RECT_CLOSED", 1.0, 2.0)
    assert shape("box", 1.0, None) == shape("circ", 1.0, 2.0) == shape(None, 1.0, 2.0) == ("CIRCULAR", None, None)


def test_names_and_bearings(spark):
    assert one(spark, v.safe_name(F.lit(' A-1 "x"/é.9 '))) == "A-1x.9"
    assert one(spark, v.bearing(F.lit(1.0), F.lit(0.0))) == 90.0
    assert one(spark, v.bearing(F.lit(0.0), F.lit(0.0))) is None
    assert round(one(spark, v.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)))) == 111195


def test_labels(spark):
    df = spark.createDataFrame([("A 1", 0.0, 0.0), ("a1", 5.0, 0.0), ("N12", 1.0, 1.0), ("##", 2.0, 2.0), ("B", 3.0, 3.0), ("b", 3.0, 3.0)], "label string, lon double, lat double")
    assert [r.verdict for r in ingest.safe_labels(df).orderBy("lon", "label").collect()] == ["dropped", "reserved", "dropped", "kept", "kept", "dropped"]


@pytest.mark.parametrize("parts", [1, 7])
def test_components(spark, parts):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (None, 3)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(parts)).collect()}
    root = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}


def test_no_components(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_sum(spark):
    r = random.Random(2)
    rows = [("hot" if i % 3 else None, r.randrange(1 << 60), i, r.randrange(5)) for i in range(2000)]
    got = prefix_sum(spark.createDataFrame(rows, "k string, h long, i long, n long"), ["k"], "h", ["i"], F.col("n"), "upto", 200_000).collect()
    want, total = {}, {}
    for k, h, i, n in sorted(rows, key=lambda x: (x[1], x[2])):
        total[k] = total.get(k, 0) + n
        want[i] = total[k]
    assert {x.i: x.upto for x in got} == want
    assert bucket_bits(0) == 4 and bucket_bits(10**12) == 20


TREE = [("c1", 1, 10, 100.0, 5.0, 4.0), ("c2", 2, 10, 50.0, 5.0, 4.0), ("c3", 10, 20, 80.0, 4.0, 3.9), ("c4", 3, 20, 10.0, 4.0, 4.5)]


def test_sizing_follows_flow(spark):
    edges = spark.createDataFrame(TREE, "name string, from_key long, to_key long, length_m double, inv_from double, inv_to double").withColumn("roughness_n", F.lit(0.013))
    cells = spark.createDataFrame([(1, 2.0, 100.0), (1, 1.0, 0.0), (2, 0.5, 50.0)], "outlet_key long, area_ha double, pct_imperv double")
    got = {r.name: r for r in network.sized(edges, cells).collect()}
    assert round(got["c1"].ca_ha, 6) == 2.0 and round(got["c3"].ca_ha, 6) == 2.275
    assert got["c3"].tc_min == 10 + 180 / 60
    assert got["c3"].diameter_m >= max(got["c1"].diameter_m, got["c2"].diameter_m)
    assert got["c4"].diameter_m == 0.30 and got["c4"].ca_ha == 0


def test_terminals_and_cycles(spark):
    edges = spark.createDataFrame([("a", 1, 2), ("b", 2, 3), ("c", 7, 8), ("d", 8, 7), ("e", 1, 3)], "name string, from_key long, to_key long")
    got = {r.node: r.terminal for r in network.terminals(network.parents(edges)).collect()}
    assert got[1] == got[2] == got[3] == 3 and got[7] is None and got[8] is None


def test_invert_tiers(spark):
    nodes = spark.createDataFrame([(1, 5.0, None, None), (2, None, None, None), (3, None, 9.0, None), (4, None, None, 8.0), (5, None, None, None)], "node_key long, invert_m double, ground_m double, dem_m double")
    edges = spark.createDataFrame([(1, 2), (4, 9)], "a long, b long")
    got = {r.node_key: (r.invert_m, r.source) for r in network.filled_inverts(nodes, edges).collect()}
    assert got == {1: (5.0, "data"), 2: (5.0, "neighbour"), 3: (6.5, "rim"), 4: (5.5, "dem"), 5: (5.0, "global_min")}


def test_orientation(spark):
    pipes = spark.createDataFrame([("p", 1, 2, None, None), ("q", 1, 2, 3.0, 40.0), ("r", 2, 3, None, None)], "name string, a long, b long, inv_a double, inv_b double")
    inverts = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 9.0)], "node_key long, invert_m double")
    got = {r.name: r for r in network.oriented(pipes, inverts, inverts.where("node_key = 3").select("node_key")).collect()}
    assert (got["p"].from_key, got["p"].to_key) == (2, 1)
    assert (got["q"].from_key, got["q"].rejected, got["q"].inlet_offset_m) == (1, 1, 2.0)
    assert got["r"].to_key == 3


def test_storm_total_and_peak(spark):
    idf = spark.createDataFrame([(1, d, 20 * (d / 60) ** -0.65) for d in (5, 10, 15, 30, 60, 120, 360, 720, 1440)], "station_key int, duration_min int, mm_h double")
    rows = sorted(forcing.alternating_blocks(idf).collect(), key=lambda r: r.hour)
    assert [r.hour for r in rows] == list(range(24))
    assert abs(sum(r.depth_mm for r in rows) - 20 * 24**-0.65 * 24) < 1e-9
    assert max(rows, key=lambda r: r.depth_mm).hour == 12


def test_unknown_unit_stops(spark):
    assert abs(one(spark, loading.in_units(F.lit(1.0), F.lit("cms"))) - 0.001) < 1e-15
    with pytest.raises(PySparkException):
        spark.createDataFrame([("acre",)], "u string").select(loading.in_units(F.lit(1.0), F.col("u"))).collect()


def test_nearest(spark):
    r = random.Random(9)
    points = [(i, r.random() * 1000, r.random() * 1000) for i in range(60)]
    seeds = [(i, r.random() * 1000, r.random() * 1000) for i in range(9)]
    got = {x.point_key: x.seed_key for x in grid.nearest(spark.createDataFrame(points, "point_key long, x double, y double"), spark.createDataFrame(seeds, "seed_key long, sx double, sy double"), 40.0).collect()}
    assert got == {i: min(seeds, key=lambda s: ((s[1] - x) ** 2 + (s[2] - y) ** 2, s[0]))[0] for i, x, y in points}


def test_rings(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1, square)], "k int, ring array<struct<x:double,y:double>>")
    assert df.select(grid.ring_area(F.col("ring")).alias("a"), grid.ring_perimeter(F.col("ring")).alias("p")).first() == (16.0, 16.0)
    assert df.select(grid.inside(F.col("ring"), F.lit(1.0), F.lit(3.0)).alias("a"), grid.inside(F.col("ring"), F.lit(5.0), F.lit(3.0)).alias("b")).first() == (True, False)
    assert grid.rasterised(df, "ring", "k").count() == 16
    assert grid.frontage(df, "ring", "k").first().long_m == pytest.approx(4.0)


def test_spacing_is_greedy(spark):
    r = random.Random(6)
    rows = [(a, 100 * a + i, r.random() * 50, r.random() * 50, r.randrange(8) * 1.0) for a in (1, 2) for i in range(60)]
    want = set()
    for a in (1, 2):
        kept = []
        for p in sorted((x for x in rows if x[0] == a), key=lambda x: (x[4], x[1])):
            if all((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 >= 64 for q in kept):
                kept.append(p)
        want |= {p[1] for p in kept}
    assert {x.key for x in spaced(spark.createDataFrame(rows, "aoi_id long, key long, x double, y double, z double"), 8.0).collect()} == want


def test_store_refuses_other_versions(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    features.write_store({"t": spark.createDataFrame([(1, 2)], "aoi_id long, k long")}, folder)
    assert features.read_store(spark, folder, "t", "k long, extra string, aoi_id long", {"extra": "d"}).first() == (2, "d", 1)
    spark.createDataFrame([(9, 0)], "major int, minor int").write.mode("overwrite").json(f"{folder}/version")
    with pytest.raises(ValueError, match="version 9"):
        features.read_store(spark, folder, "t", "k long")


def test_checksums(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "manifest.json").write_bytes(b"{}")
    assert [tuple(r) for r in features.checksums(spark, f"file://{tmp_path}").collect()] == [("a.txt", 3, hashlib.sha256(b"one").hexdigest())]


def test_feature_dialects(spark):
    pages = spark.createDataFrame([('{"features":[{"properties":{"id":"1"},"geometry":{"type":"MultiLineString","coordinates":[[[0,1,9],[2,3]],[[4,5],[6,7]]]}},{"attributes":{"id":"2"},"geometry":{"paths":[[[1,1],[2,2]]]}},{"properties":{"id":"3"},"geometry":null}]}',)], "value string")
    rows = {r.props["id"]: r for r in features.features(pages).collect()}
    assert rows["1"].line[0][:2] == [0, 1] and rows["1"].line[-1] == [6, 7] and rows["2"].line == [[1, 1], [2, 2]] and rows["3"].line is None
