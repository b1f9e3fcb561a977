"""Checks, ranks and slivers on hand-made rows."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from catchwork.frames import ranked
from catchwork.operators import checks, grid


def test_order_statistics(spark):
    r = random.Random(2)
    rows = [(g, float(r.randrange(40))) for g in range(12) for _ in range(r.randrange(1, 60))] + [(99, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    low = {x.g: x.q for x in checks.order_statistic(df, "v", "g", 0.95).collect()}
    high = {x.g: x.q for x in checks.order_statistic(df, "v", "g", 0.5, upper=True).collect()}
    for g in range(12):
        own = sorted(v for k, v in rows if k == g)
        assert low[g] == own[int(0.95 * (len(own) - 1))] and high[g] == own[len(own) // 2]
    assert low.get(99) is None


def test_shape_outliers(spark):
    cells = spark.createDataFrame([(i, 1, 1.0, 1.0) for i in range(9)] + [(10, 1, 21.0, 1.0), (11, 1, 0.04, 1.0), (12, 1, 1.0, 9.0), (13, 1, 20.0, 8.0)], "cell_key int, aoi_id int, area_ha double, thinness double")
    got = {r.cell_key: (r.large, r.small, r.elongated) for r in checks.shape_outliers(cells, "aoi_id").collect()}
    assert got == {10: (True, False, False), 11: (False, True, False), 12: (False, False, True)}


def test_ranked(spark):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.5 else None if r.random() < 0.2 else f"k{r.randrange(9)}", i) for i in range(2000)]
    got = ranked(spark.createDataFrame(rows, "k string, v int").repartition(5), [F.col("k")], ["v"], "n").collect()
    want, seen = {}, Counter()
    for k, v in rows:
        seen[k] += 1
        want[v] = seen[k]
    assert {x.v: x.n for x in got} == want and len(got) == 2000


def test_sliver_without_a_neighbour(spark):
    """A sliver that touches no larger cell joins the nearest one of its area; an area of slivers keeps them."""
    px = [(1, x, y, 1) for x in range(5) for y in range(5)] + [(1, x, y, 2) for x in range(20, 25) for y in range(5)] + [(1, 8, 2, 3), (1, 17, 2, 4), (2, 0, 0, 5)]
    got = grid.merged_slivers(spark.createDataFrame(px, "aoi_id long, ix long, iy long, cell long"), "cell", 20).collect()
    assert Counter((r.aoi_id, r.cell) for r in got) == {(1, 1): 26, (1, 2): 26, (2, 5): 1}


def test_slope_gate(spark):
    px = spark.createDataFrame([(1, 0.5, 1.0), (1, 1.5, 1.0), (1, None, 1.0), (2, 3.9, 30.0), (3, 3.9, 5.0)], "aoi_id int, slope_pct double, posting double")
    got = {r.aoi_id: (r.median_pct, r.gate_pct, r.flat) for r in grid.slope_gate(px, F.col("posting")).collect()}
    assert got == {1: (1.0, 1.0, False), 2: (3.9, 4.0, True), 3: (3.9, 1.0, False)}


def test_samples_and_noise(spark):
    rows = [(a, f"n{i:02}", float(i % 7)) for a in (1, 2) for i in range(15 * a)] + [(3, "only", 1.0)]
    df = spark.createDataFrame(rows, "area int, name string, v double")
    got = {r.area: r.sample for r in checks.samples(df, "area", "name", "v").collect()}
    assert got == {a: ",".join(n for _, n in sorted((v, n) for b, n, v in rows if b == a)[:10]) for a in (1, 2, 3)}
    cells = spark.createDataFrame([(1, 0.04), (1, 0.049), (1, 0.05), (1, None), (2, 0.01), (2, 1.0)], "aoi_id int, area_ha double")
    assert {r.aoi_id: (round(r.noise_share, 4), r.mostly_noise) for r in checks.noise_share(cells, "aoi_id").collect()} == {1: (0.6667, True), 2: (0.5, False)}
