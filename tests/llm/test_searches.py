"""Exact searches among vectors against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from catchwork.llm import negatives, packs, topk

FIELDS = "vec_id long, embedding array<float>, label int, rank string, pack int, row string, cluster string"


def odd_rows(n=600, dim=6, seed=3):
    """Clusters, copies, ties, repeated rows and ids, null and strange vectors, another length."""
    r = np.random.default_rng(seed)
    middle = r.standard_normal((12, dim))
    rows = []
    for i in range(n):
        v = middle[0] if i % 3 == 0 else middle[i % 12] + 0.1 * r.standard_normal(dim)
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(r.integers(10))))
    rows += [(100, rows[100][1], 4), (100, rows[100][1], 4), (None, rows[7][1], 1), (None, rows[8][1], 2), (700, None, 3), (1400, [1.0, None, 0.0, 0.0, 0.0, 0.0], 3)]
    rows += [(1500, [math.nan, 1.0, 0.0, 0.0, 0.0, 0.0], 3), (1600, [math.inf, 1.0, 0.0, 0.0, 0.0, 0.0], 3), (1700, [0.0] * dim, 3), (1750, [0.0] * dim, 3), (1800, [1.0, 2.0], 5), (1900, [0.5, 2.0], 5), (1950, [0.25, 2.0], 6), (2000, [], 5), (2050, rows[50][1], None)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*x, "clash", 9, "clash", "clash") for x in rows], FIELDS).repartition(5)


def scored(rows, scale):
    """(place, id, label, vector) of rows that take part."""
    out = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((len(out), i, label, [math.floor(scale * x) for x in v]))
    return out


def in_order(of, others):
    found = [(-sum(a * b for a, b in zip(of[3], x[3], strict=True)), math.inf if x[1] is None else x[1], x[0], x) for x in others if x[0] != of[0] and len(x[3]) == len(of[3])]
    return [(-s, x) for s, _, _, x in sorted(found)]


def test_top_k(spark):
    rows = odd_rows()
    valid = scored(rows, 1024)
    want = sorted((q[1], n + 1, repr(x[1]), s) for q in valid if q[1] is not None and q[1] % 100 == 0 for n, (s, x) in enumerate(in_order(q, valid)[:10]))
    got = topk.top_k(table(spark, rows), pack=64, group=4, block=8)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((r.query_id, r["rank"], repr(r.vec_id), r.score) for r in got.collect()) == want


def test_hard_negatives(spark):
    rows = odd_rows(seed=5)
    valid = [(p, i, None if label is None else (label + 1) % 10 if i is not None and i % 7 == 0 else label, v) for p, i, label, v in scored(rows, 256)]
    valid = [x for x in valid if x[2] is not None]
    want = []
    for a in valid:
        if a[1] is not None and a[1] % 50 == 0:
            near = in_order(a, valid)
            for ps, p in [x for x in near if x[1][2] == a[2]][:5]:
                hard = [(s, x) for s, x in near if x[2] != a[2] and 50 * ps <= 100 * s <= 95 * ps][:3]
                want += [(a[1], repr(p[1]), n + 1, repr(x[1]), ps, s) for n, (s, x) in enumerate(hard)]
    got = negatives.hard_negatives(table(spark, rows), pack=64, group=4)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((r.anchor_id, repr(r.positive_id), r["rank"], repr(r.negative_id), r.positive_score, r.negative_score) for r in got.collect()) == sorted(want)
    assert len(want) > 50


@pytest.mark.parametrize("search", [topk.top_k, negatives.hard_negatives])
def test_no_rows(spark, search):
    assert search(table(spark, [])).collect() == []
    assert search(table(spark, [(1, [1.0, 0.0], 1), (3, None, 2), (None, [1.0, 1.0], 1)])).collect() == []


def test_saturation(spark):
    rows = [(0, [3e38, 1.0], 1), (1, [3e38, -1.0], 1)]
    got = topk.top_k(table(spark, rows)).collect()
    cap = math.isqrt(2**52)
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 1, cap * cap - 1024 * 1024)]


def clusters(n, dim, k, seed):
    r = np.random.default_rng(seed)
    x = r.standard_normal((k, dim))[np.sort(r.integers(k, size=n))] + 0.05 * r.standard_normal((n, dim))
    return np.floor(1024 * packs.directions(x))


def test_blocks_are_pruned():
    """Blocks whose bound is below the k-th score are not scored; no bound is below a score."""
    x = clusters(4096, 16, 64, 1)
    rows = np.arange(len(x))
    queries = x[::100]
    found, scored = topk.block_at_a_time(queries, rows[::100], np.full(len(queries), -np.inf), x, rows, rows, 10, 16)
    for q, best in zip(range(0, len(x), 100), found, strict=True):
        scores = x @ x[q]
        order = [i for i in np.lexsort((rows, -scores)).tolist() if i != q][:10]
        assert [r for _, _, r in best.kept] == order
    assert scored < len(queries) * len(x) / 16 / 4
    bounds = topk.summed_bounds(queries, np.stack([topk.extremes(x[a : a + 16]) for a in range(0, len(x), 16)]))
    assert (bounds >= (queries @ x.T).reshape(len(queries), -1, 16).max(axis=2)).all()


def test_walks_end_early():
    """The shared list's bounds hold for every member, and a walk ends long before the list where members are near each other."""
    x = clusters(4096, 16, 64, 2)
    rows = np.arange(len(x))
    members = x[:8]
    order, bounds = negatives.shared_list(members, x)
    assert (np.linalg.norm(members, axis=1)[:, None] * bounds >= members @ x[order].T).all() and (np.diff(bounds) <= 0).all()
    labels = np.zeros(len(x), dtype=np.int64)
    taken = []
    best = [packs.Best(5, -math.inf) for _ in members]

    def take(live, few, scores):
        taken.append(len(live) * len(few))
        for i, m in enumerate(live.tolist()):
            best[m].take(scores[i], rows[few], rows[few])

    negatives.walk(members, x, lambda: np.array([b.floor for b in best]), take)
    assert sum(taken) < len(members) * len(x) / 8
    found = negatives.positives_of(members, rows[:8], labels[:8], np.full(8, -np.inf), x, rows, rows, labels, 5)
    for m, b in enumerate(found):
        scores = x @ x[m]
        assert [r for _, _, r in b.kept] == [i for i in np.lexsort((rows, -scores)).tolist() if i != m][:5]
