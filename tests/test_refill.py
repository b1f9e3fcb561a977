"""Hidden inverts are refilled from their own copy of the network only."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchwork import constants as k
from catchwork.operators import network


def test_refilled_errors(spark):
    """A chain of known inverts, one alone with terrain, one alone with nothing: neighbours, terrain and the least of the other fold serve."""
    rows = [(i, float(i), None, None) for i in range(6)] + [(6, None, None, None), (10, 50.0, None, 60.0), (11, 0.5, None, None), (12, None, 9.0, None)]
    nodes = spark.createDataFrame(rows, "node_key long, invert_m double, ground_m double, dem_m double")
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long")
    got = {r.node_key: (r.fold, r.truth_m, r.refilled_m, r.source) for r in network.refilled_errors(nodes, edges, 2, 1, (F.col("node_key") % 2).cast("int")).collect()}
    least = {0: 0.5, 1: 0.0}  # of what each fold still knows
    want = {i: (i % 2, float(i), float(max(0, i - 1)) if i else 1.0, "neighbour") for i in range(6)}
    want |= {10: (0, 50.0, 60.0 - k.FALLBACK_NODE_DEPTH_M, "dem"), 11: (1, 0.5, least[1], "global_min")}
    assert got == want
