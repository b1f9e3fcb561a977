"""The texture triangle at places inside each class, and over a whole grid."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catchwork import constants as k
from catchwork.functions import soil

INSIDE = {
    "sand": (3, 92), "loamy sand": (6, 82), "sandy loam": (10, 65), "loam": (18, 42), "silt loam": (15, 20), "silt": (5, 8), "sandy clay loam": (27, 60),
    "clay loam": (33, 33), "silty clay loam": (33, 10), "sandy clay": (42, 50), "silty clay": (46, 7), "clay": (60, 20),
}


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(float(c), float(s)) for c in range(-1, 102, 1) for s in range(-1, 102, 1)] + [(float(c), float(s)) for c, s in INSIDE.values()]
    x = spark.createDataFrame(rows, "clay double, sand double")
    return x.select("clay", "sand", soil.texture(F.col("clay"), F.col("sand")).alias("t")).collect()


def test_each_class(grid):
    got = {(r.clay, r.sand): r.t for r in grid}
    assert {name: got[float(c), float(s)] for name, (c, s) in INSIDE.items()} == {name: name for name in INSIDE}
    assert got[60.0, 60.0] == got[-1.0, 5.0] == k.TEXTURE_UNKNOWN


def test_regions_are_apart_and_cover_the_triangle():
    """No mixture lies in two classes, and each valid one lies in one."""
    for clay in range(0, 1001, 7):
        for sand in range(0, 1001 - clay, 7):
            c, s = clay / 10, sand / 10
            given = {"clay": c, "sand": s, "silt": 100 - c - s, "silt + 1.5 * clay": 100 - c - s + 1.5 * c, "silt + 2 * clay": 100 - c - s + 2 * c}
            inside = set()
            for name, bounds in k.TEXTURES:
                low = all((given[q] > a if q == "sand" else given[q] >= a) for q, (a, _) in bounds.items() if a is not None)
                high = all((given[q] <= b if q == "sand" else given[q] < b) for q, (_, b) in bounds.items() if b is not None)
                if low and high:
                    inside.add(name)
            assert len(inside) == 1, (c, s, inside)
