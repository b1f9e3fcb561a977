"""Every registered query of the library against DuckDB on the smallest tables; those that read small tables only on larger ones, too."""

from __future__ import annotations

import glob
import math
import os
import re

import duckdb
import pytest

from catchwork.plans import registry
from catchwork.plans.views import TABLES, VIEWS

FOLDERS = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")
registry.load()


def small(name):
    """Whether a query reads none of the large tables."""
    read = {t for s in registry.SOURCES[name] for t in TABLES if s == t or s in VIEWS and re.search(rf"\b{t}\b", VIEWS[s])}
    return not read & {"orders", "lineitem", "events"}


@pytest.fixture(scope="module", params=FOLDERS)
def duck(request):
    con = duckdb.connect()
    for path in glob.glob(f"{request.param}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con, request.param


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    con, folder = duck
    if folder != FOLDERS[0] and not small(name):
        pytest.skip("reads a large table")
    df = registry.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in registry.ORACLES:
        assert got or df.columns
        return
    rel = con.execute(registry.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in rel.fetchall())
