"""Polygons with holes, islands and crossing rings against plain loops."""

from __future__ import annotations

import math
import random

from catchwork.operators import polygons


def star(r, cx, cy, size, n, order=None):
    at = [(cx + size * (0.6 + 0.4 * r.random()) * math.cos(2 * math.pi * j / n), cy + size * (0.6 + 0.4 * r.random()) * math.sin(2 * math.pi * j / n)) for j in range(n)]
    at = [at[j] for j in order] if order else at
    return [*at, at[0]]


def scaled(ring, cx, cy, by):
    return [(cx + (x - cx) * by, cy + (y - cy) * by) for x, y in ring]


def features():
    """Lone rings, a hole, an island in a hole, two shells of which one has a hole, a remainder full of holes, a bow tie; some run clockwise."""
    r = random.Random(2)
    out = {}
    for f in range(40):
        cx, cy, n = r.uniform(0, 90), r.uniform(0, 90), r.randrange(3, 9)
        shell = star(r, cx, cy, r.uniform(3, 12), n)
        rings = [shell[::-1] if f % 3 else shell]
        if f % 4 == 1:
            rings.append(scaled(shell, cx, cy, 0.4))
        if f % 8 == 1:
            rings.append(scaled(shell, cx, cy, 0.2)[::-1])
        if f % 5 == 2:
            rings += [[(x + 40, y) for x, y in shell], scaled([(x + 40, y) for x, y in shell], cx + 40, cy, 0.3)]
        out[f] = rings[::-1] if f % 2 else rings
    out[50] = [[(0, 0), (30, 0), (30, 30), (0, 30), (0, 0)]] + [[(x, y), (x, y + 4.5), (x + 4.5, y + 4.5), (x + 4.5, y), (x, y)] for x in (0.2, 5.2, 10.2, 15.2, 20.2, 25.2) for y in (0.3, 5.3, 10.3, 15.3, 20.3, 25.3)]
    out[60] = [star(r, 60.0, 60.0, 8.0, 4, (0, 2, 1, 3))]
    return out


def frame(spark, found):
    rows = [(f, i, [(float(x), float(y)) for x, y in ring]) for f, rings in found.items() for i, ring in enumerate(rings)]
    return spark.createDataFrame(rows, "feature long, ring_no int, ring array<struct<x:double,y:double>>").repartition(4)


def odd(rings, x, y):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            n += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return n % 2 == 1


def area(ring):
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False)) / 2


def test_nesting_and_measures(spark):
    found = {f: rings for f, rings in features().items() if f != 60}
    nested = polygons.nested(frame(spark, found), 2.0)
    rows = {(x.feature, x.ring_no): x for x in nested.collect()}
    want, parts = {}, {}
    for f, rings in found.items():
        net = hole = 0.0
        for i, ring in enumerate(rings):
            around = [j for j, other in enumerate(rings) if j != i and odd([other], *ring[0])]
            got = rows[f, i]
            assert got.depth == len(around) and got.hole == (len(around) % 2 == 1)
            assert got.parent == (min(around, key=lambda j: abs(area(rings[j]))) if around else None)
            a = abs(area(ring))
            net += -a if len(around) % 2 else a
            hole += a if len(around) % 2 else 0
            shell = got.parent if got.hole else i
            parts[f, shell] = parts.get((f, shell), 0.0) + (-a if got.hole else a)
        want[f] = (net, hole, sum(math.dist(p, q) for ring in rings for p, q in zip(ring, ring[1:], strict=False)))
    for x in polygons.measures(nested).collect():
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip((x.area, x.hole_area, x.perimeter), want[x.feature], strict=True))
    square = next(x for x in polygons.measures(nested).collect() if x.feature == 50)
    assert (square.n_shells, square.n_holes) == (1, 36) and math.isclose(square.hole_area, 36 * 4.5**2)
    assert {(x.feature, x.part): round(x.area, 9) for x in polygons.parts_of(nested).collect()} == {k: round(v, 9) for k, v in parts.items()}
    best = {x.feature: x.area for x in polygons.largest_parts(nested).collect()}
    assert all(math.isclose(best[f], max(v for (g, _), v in parts.items() if g == f)) for f in found)
    kept = {x.feature for x in polygons.without_remainders(nested).collect()}
    shells = {f: w[0] + w[1] for f, w in want.items()}
    assert 50 not in kept and kept == {f for f, w in want.items() if w[1] <= 0.5 * shells[f]}


def test_points_pixels_and_crossings(spark):
    found = features()
    rings = frame(spark, found)
    r = random.Random(4)
    points = [(i, r.uniform(-5, 140), r.uniform(-5, 100)) for i in range(800)]
    got = {(x.point_key, x.feature) for x in polygons.points_inside(spark.createDataFrame(points, "point_key long, x double, y double"), rings, 1.5).collect()}
    assert got == {(i, f) for i, x, y in points for f, rs in found.items() if odd(rs, x, y)}
    filled = [(x.feature, x.ix, x.iy) for x in polygons.filled(rings, 0.5).collect()]
    assert len(filled) == len(set(filled))
    assert set(filled) == {(f, ix, iy) for f, rs in found.items() for ix in range(-40, 300) for iy in range(-40, 220) if odd(rs, (ix + 0.5) * 0.5, (iy + 0.5) * 0.5)}
    crossed = {x.feature: x.n_crossings for x in polygons.crossing_pairs(rings, 3.0).collect()}
    assert crossed.get(60) == 1 and set(crossed) == {60}


def test_boxes_of_all_sizes(spark):
    r = random.Random(9)
    boxes = [(i, x, y, x + w, y + w * r.random()) for i, (x, y, w) in enumerate((r.uniform(-50, 50), r.uniform(-50, 50), 10 ** r.uniform(-3, 2.5)) for _ in range(150))] + [(900, 5.0, 5.0, 5.0, 5.0), (901, 3.0, 3.0, 2.0, 9.0)]
    points = [(i, r.uniform(-60, 60), r.uniform(-60, 60)) for i in range(400)] + [(1000, 5.0, 5.0)]
    got = polygons.in_boxes(spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(boxes, "b long, x1 double, y1 double, x2 double, y2 double")).collect()
    assert sorted((x.p, x.b) for x in got) == sorted((p, b) for p, x, y in points for b, x1, y1, x2, y2 in boxes if x1 <= x <= x2 and y1 <= y <= y2)


def test_cells_of_overlapping_spans_are_counted_not_listed(spark):
    """A row of 10^12 cells is one span; cells under several spans count once."""
    rows = [(1, 0, 0, 10**12 - 1), (1, 0, 5, 20), (1, 1, 3, 4), (1, 1, 4, 6), (1, 1, 9, 9), (1, 1, 9, 9), (1, 2, 0, 9), (1, 2, 2, 3), (1, 2, 5, 12), (2, 0, -5, -5)]
    spans = spark.createDataFrame(rows, "area_id long, iy long, `from` long, upto long").repartition(3)
    assert {q.area_id: q.cells for q in polygons.covered_cells(spans, "area_id").collect()} == {1: 10**12 + 5 + 13, 2: 1}
