"""Refilling hides inverts in a level for each fold, not in a copy of the network for each."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from catchwork import constants as k
from catchwork.operators import network


def refilled(nodes, edges, folds, rounds):
    """The tiers, node by node, once for each fold."""
    near = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for f in range(folds):
        at = {n: (level, "data") for n, (level, _, _) in nodes.items() if level is not None and n % folds != f}
        for tier, place in (("rim", 1), ("dem", 2), (None, None)):
            for _ in range(rounds):
                at |= {n: (min(at[o][0] for o in near[n] if o in at), "neighbour") for n in nodes if n not in at and any(o in at for o in near[n])}
            if tier:
                at |= {n: (row[place] - k.FALLBACK_NODE_DEPTH_M, tier) for n, row in nodes.items() if n not in at and row[place] is not None}
        least = min((level for level, _ in at.values()), default=0.0)
        out |= {n: (f, row[0], *at.get(n, (least, "global_min"))) for n, row in nodes.items() if n % folds == f and row[0] is not None}
    return out


@pytest.mark.parametrize(("folds", "rounds", "n"), [(3, 2, 200), (5, 1, 120), (2, 0, 40), (4, 3, 1)])
def test_as_each_copy_alone(spark, folds, rounds, n):
    rng = random.Random(folds)
    some = lambda share: round(rng.uniform(0, 50), 2) if rng.random() < share else None
    nodes = {i: (some(0.3), some(0.1), some(0.1)) for i in range(n)}
    edges = [(i, j) for i in range(n) for j in {i, i + 1, i + folds, rng.randrange(n)} if j < n and rng.random() < 0.4]
    rows = spark.createDataFrame([(i, *row) for i, row in nodes.items()], "node_key long, invert_m double, ground_m double, dem_m double")
    got = network.refilled_errors(rows, spark.createDataFrame(edges, "a long, b long"), folds, rounds, (F.col("node_key") % folds).cast("int")).collect()
    assert {r.node_key: (r.fold, r.truth_m, r.refilled_m, r.source) for r in got} == refilled(nodes, edges, folds, rounds)
    assert len(got) == sum(level is not None for level, _, _ in nodes.values())


def test_rows_do_not_grow_with_the_folds(spark, monkeypatch):
    """No table that is written has more rows than the network has nodes or ways along its edges."""
    sizes, kept = [], network.written

    def counted(df, name):
        out = kept(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(network, "written", counted)
    nodes = spark.range(100).select(F.col("id").alias("node_key"), F.when(F.col("id") % 4 == 0, F.col("id") * 1.0).alias("invert_m"), F.lit(None).cast("double").alias("ground_m"), F.lit(None).cast("double").alias("dem_m"))
    edges = spark.range(99).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert network.refilled_errors(nodes, edges, 10, 2).count() == 25
    assert max(sizes) <= 2 * 99
