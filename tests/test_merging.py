"""Cells that change hands, against the sequential rules; percentiles of large groups."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchwork.operators import grid as grid_op
from catchwork.operators import merging, quantiles

SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1))
ALL = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def grid(seed, size=24, cells=40):
    """Cells as Voronoi regions of random seeds, connected for the most part, many of them small."""
    r = random.Random(seed)
    seeds = [(r.uniform(0, size), r.uniform(0, size)) for _ in range(cells)]
    return {(x, y): min(range(cells), key=lambda c: (abs(seeds[c][0] - x) + abs(seeds[c][1] - y), c)) for x in range(size) for y in range(size) if (x * 7 + y * 3) % 29}


def components(pixels):
    left, out = set(pixels), []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            p = todo.pop()
            seen.add(p)
            for a, b in SIDES:
                q = (p[0] + a, p[1] + b)
                if q in left:
                    left.discard(q)
                    todo.append(q)
        out.append(seen)
    return sorted(out, key=lambda s: (-len(s), min((y, x) for x, y in s)))


def one_after_another(cells, least):
    """The rule as it is stated: slivers in order, each into the cell it shares most with, which grows."""
    own = defaultdict(set)
    for p, c in cells.items():
        own[c].add(p)
    big = {c: set(s) for c, s in own.items() if len(s) >= least}
    area = {c: len(s) for c, s in big.items()}
    if not big:
        return dict(cells), {c: len(s) for c, s in own.items()}
    for c in sorted(set(own) - set(big)):
        touch = {}
        for b, s in big.items():
            edges = sum((x + dx, y + dy) in s for x, y in own[c] for dx, dy in SIDES)
            if any((x + dx, y + dy) in s for x, y in own[c] for dx, dy in ALL):
                touch[b] = edges
        if touch:
            best = max(touch, key=lambda b: (touch[b], -b))
        else:
            best = min(big, key=lambda b: (min((x - u) ** 2 + (y - v) ** 2 for x, y in own[c] for u, v in big[b]), b))
        area[best] += len(own[c])
        if touch.get(best, 0) > 0:
            big[best] |= own[c]
    return {p: b for b, s in big.items() for p in s}, area


def pixels(spark, areas):
    return spark.createDataFrame([(a, x, y, c) for a, cells in areas.items() for (x, y), c in cells.items()], "aoi_id long, ix long, iy long, cell long").repartition(3)


def test_slivers(spark):
    areas = {1: grid(1), 2: grid(2, cells=90), 3: grid(3, size=9, cells=20), 4: {(x, y): 2 + x // 12 for x in range(24) for y in range(9)} | {(40, 40): 1, (41, 41): 0, (100, 3): 5, (12, 9): 6}}
    got = {(r.aoi_id, r.ix, r.iy): (r.cell, r.area) for r in merging.slivers_in_order(pixels(spark, areas), "cell", 12).collect()}
    assert len(got) == sum(map(len, areas.values()))
    for a, cells in areas.items():
        want, area = one_after_another(cells, 12)
        for (x, y), c in cells.items():
            to = want.get((x, y))
            assert got[a, x, y][0] == to, (a, x, y, c)
            assert to is None or got[a, x, y][1] == area[to]


def test_scraps(spark):
    r = random.Random(5)
    areas = {a: {p: c if r.random() > 0.25 else r.randrange(12) for p, c in grid(a, size=18, cells=12).items()} for a in (1, 2)}
    got = {(x.aoi_id, x.ix, x.iy): x.cell for x in merging.scraps_attached(pixels(spark, areas), "cell", 2).collect()}
    for a, cells in areas.items():
        main, scraps = {}, []
        for c in set(cells.values()):
            first, *others = components([p for p, v in cells.items() if v == c])
            main[c] = set(first)
            scraps += [s for s in others if len(s) >= 2]
        for s in sorted(scraps, key=lambda s: min((y, x) for x, y in s)):
            edges = {c: sum((x + dx, y + dy) in m for x, y in s for dx, dy in SIDES) for c, m in main.items()}
            # of equals the one whose first part stands first
            best = max(edges, key=lambda c: (edges[c], tuple(-v for v in min((y, x) for x, y in components([p for p, v in cells.items() if v == c])[0]))))
            if edges[best]:
                main[best] |= s
        where = {p: c for c, m in main.items() for p in m}
        assert {p: got[a, *p] for p in cells} == {p: where.get(p) for p in cells}


def exchange(cells, basin, seeds, share=0.2):
    own = defaultdict(set)
    for p, c in cells.items():
        own[c].add(p)
    home = {c: basin.get(seeds[c]) for c in own}
    n, offers = Counter(), {}
    for c in own:
        if home[c] is None:
            n["outside"] += 1
            continue
        stay = {p for p in own[c] if basin.get(p) == home[c]}
        if len(components(stay)) != 1 or len(stay) < share * len(own[c]):
            n["too_small"] += 1
        elif len(stay) < len(own[c]):
            cut, placed = own[c] - stay, []
            for b in {basin.get(p) for p in cut}:
                for piece in components([p for p in cut if basin.get(p) == b]):
                    edges = {d: sum((x + dx, y + dy) in own[d] for x, y in piece for dx, dy in SIDES) for d in own if d != c and home[d] == b and b is not None}
                    best = max(edges, key=lambda d: (edges[d], -d), default=None)
                    placed.append((piece, best if best is not None and edges[best] else None))
            if any(t is None for _, t in placed):
                n["nowhere"] += 1
            else:
                offers[c] = placed
    out = dict(cells)
    for c, placed in offers.items():
        if any(t in offers or len(components(own[t])) > 1 for _, t in placed):
            n["unmergeable"] += 1
            continue
        n["clipped"] += 1
        for piece, t in placed:
            n["moved"] += len(piece)
            out |= dict.fromkeys(piece, t)
    return out, tuple(n[k] for k in ("clipped", "outside", "too_small", "nowhere", "unmergeable", "moved"))


def test_official_edges(spark):
    areas = {a: grid(a, size=26, cells=16 + 5 * a) for a in (1, 2, 3, 4)}
    basin = {a: {(x, y): (x + a * y // 3) // 9 + 10 * (y // (9 + a)) for x in range(26) for y in range(23)} for a in areas}
    seeds = {a: {c: min((p for p, v in cells.items() if v == c), key=lambda p: ((p[0] * 31 + p[1] * 17) % 23, p)) for c in set(cells.values())} for a, cells in areas.items()}
    rows = [(a, x, y, c, basin[a].get((x, y))) for a, cells in areas.items() for (x, y), c in cells.items()]
    px = spark.createDataFrame(rows, "aoi_id long, ix long, iy long, cell long, basin long").repartition(3)
    given = spark.createDataFrame([(a, c, *p) for a, s in seeds.items() for c, p in s.items()], "aoi_id long, cell long, ix long, iy long")
    out, counts = merging.official_edges(px, given)
    got = {(r.aoi_id, r.ix, r.iy): r.cell for r in out.collect()}
    said = {r.aoi_id: tuple(r[f"n_{k}"] for k in ("clipped", "outside", "too_small", "nowhere", "unmergeable", "moved")) for r in counts.collect()}
    total = Counter()
    for a, cells in areas.items():
        want, n = exchange(cells, basin[a], seeds[a])
        assert {p: got[a, *p] for p in cells} == want and said[a] == n
        total.update(dict(enumerate(n)))
    assert all(total[i] for i in range(6))


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_percentiles(spark, share, monkeypatch):
    """As Spark's percentile gives them, with ties, nulls, a null key, huge and tiny ranges, and a group with most rows."""
    monkeypatch.setattr(quantiles, "FEW", 50)
    r = np.random.default_rng(3)
    rows = [("big", float(v)) for v in r.lognormal(0, 6, 4000)] + [("ties", float(v)) for v in r.integers(0, 3, 700)] + [(None, float(v)) for v in r.normal(size=301)]
    rows += [("one", 4.5), ("two", 1.0), ("two", 2.0), ("none", None), ("same", 7.0), ("same", 7.0)] + [("near", 1.0 + i * 2.0**-52) for i in range(200)] + [("wide", v) for v in (-1e300, 1e300, 0.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    want = {x.k: x.v for x in df.groupBy("k").agg(F.percentile("x", share).alias("v")).collect()}
    got = {x.k: x.value for x in quantiles.percentiles(df, ["k"], "x", share).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (v if v is None else pytest.approx(v, rel=1e-12, abs=0)), k


def test_absorbed_land(spark):
    """Rings of eight neighbours, the least label of a ring, pockets to the nearest seed, an area without labels and one without seeds."""
    r = random.Random(8)
    land = {1: {(x, y) for x in range(20) for y in range(20) if x != 12}, 2: {(x, 0) for x in range(9)}, 3: {(0, 0), (5, 5)}}
    label = {1: {p: 10 + p[0] // 7 for p in land[1] if p[0] < 11 and r.random() < 0.1}, 2: {}, 3: {(0, 0): 4}}
    seeds = {1: [(10, 2, 3), (11, 9, 9), (77, 19, 2), (76, 19, 15)], 2: [(50, 4, 0)], 3: []}
    rows = [(a, x, y, label[a].get((x, y))) for a, s in land.items() for x, y in s]
    px = spark.createDataFrame(rows, "aoi_id long, ix long, iy long, label long").repartition(3)
    given = spark.createDataFrame([(a, k, float(x), float(y)) for a, s in seeds.items() for k, x, y in s], "aoi_id long, seed_key long, sx double, sy double")
    got = {(x.aoi_id, x.ix, x.iy): x.label for x in grid_op.absorbed(px, "label", given).collect()}
    for a, s in land.items():
        known = dict(label[a])
        while True:
            new = {}
            for x, y in s - set(known):
                near = [known[x + dx, y + dy] for dx, dy in ALL if (x + dx, y + dy) in known]
                if near:
                    new[x, y] = min(near)
            if not new:
                break
            known |= new
        for x, y in s - set(known):
            known[x, y] = min(((x - u) ** 2 + (y - v) ** 2, k) for k, u, v in seeds[a])[1] if seeds[a] else None
        assert {p: got[a, *p] for p in s} == known
