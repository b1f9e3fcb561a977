"""The pipeline's stages on hard rows against plain definitions, and on empty tables; the registered queries with their SQL."""

from __future__ import annotations

import glob
import math
import os
import re
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from catchwork.frames import new_path, written
from catchwork.llm import registry, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"


def folder(spark, docs):
    path = new_path(spark, "pipeline_input")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near(a, b):
    return len(a & b) * 5 >= 4 * len(a | b)


def passes(text):
    """The fixed rules: ten words, and at most a fifth of them in repeated windows of five."""
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    covered = {p for j in range(len(w) - 4) if seen[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)}
    return len(w) >= 10 and 100 * len(covered) <= 20 * len(w)


def test_stages(spark, docs):
    path = folder(spark, docs.withColumnRenamed("spans", "q_kept"))
    given = spark.read.parquet(f"{path}/documents.parquet")
    at = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "secret scan", "source mix", "best-fit packing"]

    good = written(at["quality rules"](spark, given, path), "test_stage")
    assert good.columns == given.columns
    row = lambda r: tuple(r.asDict().values())
    assert Counter(map(row, good.collect())) == Counter(row(r) for r in given.collect() if passes(r.text))

    single = written(at["simhash near-dedup"](spark, good, path), "test_stage")
    assert single.columns == given.columns
    kept = [shingles(r.text) for r in single.collect()]
    assert not any(near(a, b) for i, a in enumerate(kept) for b in kept[:i])
    assert all(any(near(shingles(r.text), k) for k in kept) for r in good.collect())  # stars only here, so every dropped row is near a kept one
    assert {row(r) for r in single.collect()} <= {row(r) for r in good.collect()}

    clean = written(at["secret scan"](spark, single, path), "test_stage")
    assert clean.columns == given.columns and clean.count() == single.count()
    before = {r.doc_id: r for r in single.collect()}
    for r in clean.collect():
        assert not secrets._base(r.text) and r.n_chars == len(r.text)
        assert ("[SECRET]" in r.text) == bool(secrets._base(before[r.doc_id].text))

    mixed = written(at["source mix"](spark, clean, path), "test_stage")
    assert mixed.columns == given.columns
    taken = Counter(map(row, mixed.collect()))
    assert taken and set(taken) <= set(map(row, clean.collect())) and max(taken.values()) <= 2

    packed = at["best-fit packing"](spark, mixed, path).collect()
    tokens = defaultdict(int)
    for r in packed:
        tokens[r.doc_id] += r.n_tokens
    want = defaultdict(int)
    for r in mixed.collect():
        want[r.doc_id] += len(WORD.findall(r.text))
    assert tokens == want
    bins = defaultdict(int)
    for r in packed:
        bins[r.pack, r.bin, r.capacity] += r.n_tokens
    assert all(used <= capacity for (_, _, capacity), used in bins.items())
    assert Counter((r.doc_id, r.piece, r.n_tokens) for r in corpus_pipeline.run(spark, path).collect()) == Counter((r.doc_id, r.piece, r.n_tokens) for r in packed)


def test_no_documents(spark, empty):
    assert corpus_pipeline.run(spark, folder(spark, empty)).count() == 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got
    sql = registry.oracle_sql().get(name)
    if sql:
        rel = duck.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(names) == columns
        assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in rel.fetchall())


def test_columns_of_any_name_survive_every_stage(spark, docs):
    """Names that stages might use themselves keep their values through all stages that return documents."""
    clash = ["_id", "_times", "_text_key", "_text_hash", "_lang", "_source", "_th", "_l", "_s", "row", "own", "key", "id", "of", "times", "set_key", "group_key"]
    path = folder(spark, docs.selectExpr("*", *(f"concat('{c} of ', coalesce(doc_id, 0)) as {c}" for c in clash)))
    rows = spark.read.parquet(f"{path}/documents.parquet")
    columns = rows.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = written(stage(spark, rows, path), "test_stage")
        assert rows.columns == columns, name
    found = rows.collect()
    assert found and all(r[c] == f"{c} of {r.doc_id or 0}" for r in found for c in clash)
