"""Greedy spacing and sink choice look at every pixel."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from catchwork.operators import grid
from catchwork.plans import exports


def greedy(points, least):
    kept = []
    for p in sorted(points, key=lambda p: (p[2], p[3])):
        if all((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 >= least * least for q in kept):
            kept.append(p)
    return sorted(p[3] for p in kept)


@pytest.mark.parametrize("name", ["t05", "n13"])
def test_every_pixel_counts(spark, name):
    cells = [(1, x, y, float((x * 37 + y * 91) % 101), 18 if (x, y) == (7, 7) else 1) for x in range(16) for y in range(16)]
    px = spark.createDataFrame(cells, "aoi_id long, ix long, iy long, z_m double, landcover int")
    keyed = px.withColumn("key", exports.grid.pixel_id(px.ix, px.iy, px.aoi_id if name == "n13" else exports.F.lit(0))).collect()
    near = [r for r in keyed if name == "t05" or (r.ix - 7) ** 2 + (r.iy - 7) ** 2 <= 9]
    want = greedy([(r.ix, r.iy, r.z_m, r.key) for r in near], 9.0 if name == "t05" else 12.0)
    assert sorted(r.key for r in getattr(exports, name)(px).collect()) == want


def test_sinks(spark):
    """Against the plain sequential rule; one area has no water and takes its lowest pixel."""
    r = random.Random(9)
    px = [(a, x, y, round(r.uniform(0, 9), 1), 18 if a < 3 and r.random() < 0.03 else 1) for a in (1, 2, 3) for x in range(20) for y in range(20)]
    key = lambda a, x, y: (a * 1_000_000 + y) * 1_000_000 + x
    want = set()
    for a in (1, 2, 3):
        own = [p for p in px if p[0] == a]
        water = [p for p in own if p[4] == 18]
        close = sorted((z, key(a, x, y), x, y) for _, x, y, z, _ in own if any(math.hypot(x - w[1], y - w[2]) <= 3 for w in water))
        kept = []
        for z, k, x, y in close:
            if all(math.hypot(x - u, y - v) >= 12 for u, v in kept):
                kept.append((x, y))
                want.add((a, k))
        if not kept:
            want.add((a, min((z, key(a, x, y)) for _, x, y, z, _ in own)[1]))
    df = spark.createDataFrame(px, "aoi_id long, ix long, iy long, z_m double, landcover int")
    assert {(x.aoi_id, x.key) for x in grid.sinks(df, F.col("landcover") == 18, 3.0, 12.0).collect()} == want


def test_pairs_are_not_written(spark, monkeypatch):
    """1,600 dense points have some 300,000 pairs within reach; no round writes more rows than there are points, and the result is the sequential one."""
    r = random.Random(3)
    cells = [(1, i, float(i % 40), float(i // 40), round(r.uniform(0, 9), 1)) for i in range(1600)]
    sizes, plain = [], grid.written

    def counted(df, name):
        out = plain(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(grid, "written", counted)
    points = spark.createDataFrame(cells, "aoi_id long, key long, x double, y double, z double")
    assert sorted(x.key for x in grid.spaced(points, 9.0).collect()) == greedy([(x, y, z, i) for _, i, x, y, z in cells], 9.0)
    assert max(sizes) <= 1600
