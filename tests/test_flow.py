"""Walks in few rounds against plain sequential rules."""

from __future__ import annotations

import heapq
import math
import random
from collections import defaultdict, deque

import pytest

from catchwork.operators import flow, grid, network


@pytest.fixture
def rounds(monkeypatch):
    """Counts written tables."""
    seen = []
    for module in (flow, network):
        plain = module.written
        monkeypatch.setattr(module, "written", lambda df, name, f=plain: (seen.append(name), f(df, name))[1])
    return seen


def test_basins_stop_at_pour_points(spark, rounds):
    """A long way down through two pour points, a low without one, and a null pixel row."""
    n = 3000
    chain = [(1, i, 0, i - 1 if i else None, 0 if i else None) for i in range(n)]
    side = [(1, 5, 1, 4, 0), (1, 9, 9, None, None), (2, 5, 0, None, None), (2, 6, 1, 5, 0)]
    px = spark.createDataFrame(chain + side, "aoi_id long, ix long, iy long, d_ix long, d_iy long")
    pours = spark.createDataFrame([(1, 0, 0, 7), (1, 1000, 0, 8), (3, 0, 0, 9)], "aoi_id long, ix long, iy long, label long")
    got = {(r.aoi_id, r.ix, r.iy): (r.label, r.length) for r in flow.basins(px, pours, cell=2.0).collect()}
    for i in range(n):
        label, at = (8, 1000) if i >= 1000 else (7, 0)
        assert got[1, i, 0] == (label, pytest.approx(2.0 * (i - at)))
    assert got[1, 5, 1] == (7, pytest.approx(8 + 2 * math.sqrt(2)))
    assert got[1, 9, 9] == got[2, 5, 0] == got[2, 6, 1] == (None, None) and len(got) == n + 4
    assert len(rounds) <= math.log2(n) + 4
    lengths = {r.label: (r.pixels, r.flow_m) for r in flow.flow_lengths(flow.basins(px, pours, cell=2.0), 2.0).collect()}
    assert lengths == {7: (1001, 1998.0), 8: (2000, 3998.0)}


def sequential_inverts(parent, length, ground, sink, slope=0.005, depth=1.5, least=1e-4):
    children, out = defaultdict(list), {}
    for n, p in parent.items():
        if p is not None:
            children[p].append(n)
    queue = deque((n, 0) for n, p in parent.items() if p is None)
    for n, _ in queue:
        out[n] = (sink[n], False, 0)
    while queue:
        n, level = queue.popleft()
        for c in children[n]:
            low = out[n][0] + length[c] * least
            want = min(out[n][0] + length[c] * slope, ground[c] - depth)
            out[c] = (max(low, want), want < low, level + 1)
            queue.append((c, level + 1))
    return out


@pytest.mark.parametrize("kind", ["chain", "random", "bushy", "lone"])
def test_inverts_along_a_forest(spark, rounds, kind):
    r = random.Random(3)
    n = {"chain": 10_000, "random": 700, "bushy": 600, "lone": 3}[kind]
    if kind == "chain":
        parent = {i: i - 1 if i else None for i in range(n)}
    elif kind == "random":
        parent = {i: None if i % 101 == 0 else r.randrange(max(0, i - 9), i) for i in range(n)}
    elif kind == "bushy":
        parent = {i: None if i == 0 else i - 1 if i < 70 else r.choice([69, 68, 64, 63, 32, 1]) for i in range(n)}
    else:
        parent = dict.fromkeys(range(n))
    ground = {i: 100 + r.random() * 8 for i in range(n)}
    length = {i: r.uniform(1, 90) for i in range(n)}
    nodes = spark.createDataFrame([(i, ground[i], ground[i] - 1.5) for i in range(n)], "node long, ground double, outfall_invert double")
    forest = spark.createDataFrame([(i, p, length[i]) for i, p in parent.items()] + [(-1, -2, 1.0), (-2, -1, 1.0)], "node long, parent long, length double")
    got = {x.node: (x.invert_m, x.violated, x.level) for x in flow.propagated_inverts(forest, nodes).collect()}
    want = sequential_inverts(parent, length, ground, {i: g - 1.5 for i, g in ground.items()})
    assert got == want
    if kind == "chain":
        assert len(rounds) < 6 * math.log2(n)
        assert any(v for _, v, _ in want.values())


def dijkstra(edges, sources):
    near = defaultdict(list)
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    dist, heap = {}, [(0.0, s, s) for s in sources]
    while heap:
        d, s, n = heapq.heappop(heap)
        if n not in dist:
            dist[n] = (d, s)
            for m, w in near[n]:
                heapq.heappush(heap, (d + w, s, m))
    parent = {}
    for n, (d, s) in dist.items():
        options = [m for m, w in near[n] if n != m and m in dist and dist[m][0] + w == d and dist[m][1] == s]
        parent[n] = min(options) if d else None
    return {n: (*dist[n], parent[n]) for n in dist}


def test_shortest_forest(spark):
    """Streets with long runs, parallel edges, loops, ties, a run between sources, and a part without any."""
    r = random.Random(11)
    edges, nodes = [], 30
    for i in range(1, 30):
        edges.append((i, r.randrange(i), float(r.randrange(1, 5))))
    for _ in range(20):
        a, b = r.randrange(30), r.randrange(30)
        last = a
        for _ in range(r.randrange(0, 12)):
            edges.append((last, nodes, float(r.randrange(1, 5))))
            last, nodes = nodes, nodes + 1
        edges.append((last, b, float(r.randrange(1, 5))))
    edges += [(3, 3, 1.0), (2, 1, 9.0), (900, 901, 1.0), (901, 902, 1.0), (902, 900, 1.0), (950, 951, 2.0), (951, 952, 2.0)]
    sources = [0, 7, 33, 951]
    got = flow.shortest_forest(spark.createDataFrame(edges, "a long, b long, length double"), spark.createDataFrame([(s,) for s in sources], "node long"))
    assert {x.node: (x.dist, x.source, x.parent) for x in got.collect()} == dijkstra(edges, sources)


def test_a_long_street_costs_few_rounds(spark, rounds):
    n = 10_000
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)], "a long, b long, length double")
    got = {x.node: (x.dist, x.source, x.parent) for x in flow.shortest_forest(edges, spark.createDataFrame([(0,), (n,)], "node long")).collect()}
    assert got[4999] == (4999.0, 0, 4998) and got[5001] == (4999.0, n, 5002) and got[5000] == (5000.0, 0, 4999) and len(got) == n + 1
    assert len(rounds) < 30


def test_missing_lengths(spark):
    edges = spark.createDataFrame([(1, 2, None), (2, 3, 0.0), (1, 3, 7.0), (1, 9, None)], "a long, b long, length double")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 3.0, 5.0)], "node long, x double, y double")
    assert sorted((r.a, r.b, r.length) for r in flow.measured_edges(edges, nodes).collect()) == [(1, 2, 5.0), (1, 3, 7.0), (1, 9, None), (2, 3, 1.0)]


def test_branching_outfalls(spark):
    r = random.Random(5)
    edges = [(i, r.randrange(max(0, i - 12), i)) for i in range(1, 300)] + [(i, r.randrange(300)) for i in range(1, 300, 5)] + [(500, 501), (501, 500), (502, 500), (503, 503), (40, 41), (41, 40)]
    ends = {0, 50, 77, 600}
    out = defaultdict(set)
    for a, b in edges:
        if a != b:
            out[a].add(b)
    nodes = {x for e in edges if e[0] != e[1] for x in e} | ends

    def nearest(n):
        seen, front, hops = {n}, [n], 0
        while front:
            hit = [x for x in front if x in ends]
            if hit:
                return min(hit), hops
            front = sorted({y for x in front for y in out[x]} - seen)
            seen |= set(front)
            hops += 1
        return None, None

    got = flow.reached_outfalls(spark.createDataFrame(edges, "from_key long, to_key long"), spark.createDataFrame([(x,) for x in ends], "node long"))
    assert {x.node: (x.outfall, x.hops) for x in got.collect()} == {n: nearest(n) for n in nodes}


def test_directions_beside_gaps_without_a_row_for_each_neighbour(spark):
    """Pixels are sent twice, not to all eight neighbours; corners are seen across gaps, single and wide ones."""
    r = random.Random(4)
    z = {(a, x, y): float(r.randrange(30)) for a in (1, 2) for x in range(-2, 15) for y in range(12) if r.random() < 0.6}
    px = spark.createDataFrame([(*p, v) for p, v in z.items()] + [(3, 5, 5, 1.0), (3, 6, 6, 0.5), (4, 1, 1, None), (4, 2, 1, 2.0)], "aoi_id long, ix long, iy long, z_m double").repartition(3)
    found = grid.flow_directions(px)
    got = {(q.aoi_id, q.ix, q.iy): (q.d_ix, q.d_iy) for q in found.collect()}
    want = {(3, 5, 5): (6, 6), (3, 6, 6): (None, None), (4, 1, 1): (None, None), (4, 2, 1): (None, None)}
    for (a, x, y), v in z.items():
        steps = [((v - z[a, x + i, y + j]) / (2**0.5 if i and j else 1.0), -(y + j), -(x + i)) for i in (-1, 0, 1) for j in (-1, 0, 1) if z.get((a, x + i, y + j), v) < v]
        want[a, x, y] = (-max(steps)[2], -max(steps)[1]) if steps else (None, None)
    assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Join" not in plan and plan.count("hashpartitioning") == 2
