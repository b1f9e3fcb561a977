"""Web archives and vectors against brute force."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from catchwork.llm import vectors, warc


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted(((r.randrange(30), i), (i, n)) for n in range(r.randrange(20))) for i in range(k)]
    assert list(warc.LoserTree([iter(x) for x in runs])) == [row for _, row in sorted(x for run in runs for x in run)]


PAGES = [(1, "http://B.example.org/x?q=1#f", "<p>same</p>"), (2, "https://a.example.org/", "<p>same</p>"), (3, None, None), (4, "notaurl", ""), (5, "http://a.example.org/", "é" * 70_000), (5, "http://a.example.org/", "é" * 70_000), (None, "http://c.org", "<p>same</p>"), (6, "http://a.example.org/ b\r\n", "one")]


def test_archives(spark):
    pages = spark.createDataFrame([(i, u, h, "clash") for i, u, h in PAGES], "page_id long, url string, html string, record_type string")
    rows = warc.archived_pages(pages).collect()
    newest = defaultdict(lambda: -1)
    for i, _, h in PAGES:
        newest[h or ""] = max(newest[h or ""], -1 if i is None else i)
    want = Counter()
    for i, _, h in PAGES:
        body = (h or "").encode()
        first = i == newest[h or ""]
        want[i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else newest[h or ""]] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    assert sorted(r.merge_pos for r in rows) == list(range(len(PAGES)))
    order = sorted(rows, key=lambda r: r.merge_pos)
    keys = [(r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in order]
    assert keys == sorted(keys)


def test_least_bytes_and_rotation(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/{i}", "x" * (i % 2 * 50)) for i in range(60)], "page_id long, url string, html string")
    rows = warc.archived_pages(pages, least_bytes=10).collect()
    assert all((r.record_type == "revisit") == (r.payload_bytes == 50 and r.page_id != 59) for r in rows) and len(rows) == 60


def test_payloads_round_trip(spark):
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", f"<p>é {i}\r\n\r\n</p>") for i in range(20)], "page_id long, url string, html string")
    rows = pages.selectExpr("*", "sha1(html) as sha1", "false as revisit", "null as refers_to", "0L + page_id as captured", "'k' as url_key")
    folder = warc.new_path(spark, "archives")
    read = warc.read_archives(warc.write_archives(rows.coalesce(1), folder, archive_bytes=500), folder)
    assert {(r.page_id, r.payload) for r in read.collect()} == {(r.page_id, r.html) for r in pages.collect()}
    assert read.select("archive").distinct().count() > 1


def test_ids_of_64_bits(spark):
    ids = [10**15, 1 << 60, (1 << 63) - 1, -(1 << 63), -5, None, 253402300799]
    pages = spark.createDataFrame([(i, "http://a.org/", f"p{n}") for n, i in enumerate(ids)], "page_id long, url string, html string")
    rows = sorted(warc.archived_pages(pages).collect(), key=lambda r: r.merge_pos)
    assert sorted(map(str, ids)) == sorted(str(r.page_id) for r in rows) and {r.record_type for r in rows} == {"response"}
    keys = [(r.captured, r.page_id is not None, r.page_id) for r in rows]
    assert keys == sorted(keys)


@pytest.mark.parametrize("width", [2, 3, 64])
def test_merge_in_passes(spark, width):
    """Many small runs, merged in several passes, against one sort; a third of the captures are of one URL."""
    r = random.Random(width)
    rows = []
    for a in range(23):
        own = sorted((("hot)/" if r.random() < 0.34 else f"h{r.randrange(40)})/"), r.randrange(50), r.randrange(9)) for _ in range(r.randrange(1, 60)))
        rows += [(u, c, p or None, f"a{a}", i, i) for i, (u, c, p) in enumerate(own)]
    index = spark.createDataFrame(rows, "url_key string, captured long, page_id long, archive string, record int, run_pos int")
    got = sorted(warc.merge_index(index, rows_a_part=20, width=width).collect(), key=lambda x: x.merge_pos)
    assert [x.merge_pos for x in got] == list(range(len(rows)))
    want = sorted((u, c, p is not None, p or 0, a, i) for u, c, p, a, i, _ in rows)
    assert [(x.url_key, x.captured, x.archive, x.record) for x in got] == [(w[0], w[1], w[4], w[5]) for w in want]


def test_no_pages(spark):
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute(rows, threshold=0.95):
    def ok(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(n):
            a, b = rows[i][1], rows[j][1]
            if i != j and ok(a) and ok(b) and len(a) == len(b):
                x, y = np.float32(a).astype(float), np.float32(b).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[i] += 1
                    root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(rows[i][0])
    return Counter((rows[i][0], links[i], min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(n))


def test_vectors(spark):
    r = np.random.default_rng(5)
    rows, at = [], 0
    for _ in range(30):
        centre = r.standard_normal(16)
        for _ in range(int(r.integers(1, 9))):
            rows.append((at, (centre + r.standard_normal(16) * r.choice([0.02, 0.1, 0.25])).tolist()))
            at += 1
    rows += [(at, rows[0][1]), (at + 1, None), (at + 2, []), (at + 3, [0.0] * 16), (at + 4, [float("nan")] * 16), (at + 5, [None] * 16), (at + 6, [1.0, 2.0]), (at + 7, [2.0, 4.0]), (None, rows[3][1]), (1, rows[1][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = vectors.vector_groups(df).collect()
    assert Counter((x.vec_id, x.n_links, x.component_id) for x in got) == brute(rows)
    assert all(x.kept == (x.vec_id is not None and x.vec_id == x.component_id) for x in got)


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, the hardest to find: at least 0.99 of them are."""
    r = np.random.default_rng(8)
    rows = []
    for i in range(400):
        a = r.standard_normal(64)
        a /= np.linalg.norm(a)
        b = r.standard_normal(64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.951 * a + np.sqrt(1 - 0.951**2) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vectors.vector_groups(df).collect()
    assert sum(x.n_links for x in got) >= 0.99 * 800


def test_collision_formula():
    r = np.random.default_rng(2)
    a, b = np.zeros(32), np.full(32, 0.5 / np.sqrt(32))
    p = r.standard_normal((32, 200_000))
    shift = r.random(200_000) * 2
    same = np.floor((a @ p + shift) / 2) == np.floor((b @ p + shift) / 2)
    assert abs(same.mean() - vectors.collision(0.5, 2.0)) < 0.01


def test_no_vectors(spark):
    assert vectors.vector_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_strangers_a_vector_do_not_grow(spark):
    """Unrelated vectors: compared pairs a vector stay the same over a hundredfold table, and pairs in a bucket near what the key length aims at."""
    r, shares = np.random.default_rng(4), []
    for n in (1_000, 10_000, 100_000):
        keys = vectors.key_length(n, 2.0, 4.0)
        tables = 4
        df = spark.createDataFrame(pa.table({"cell": np.arange(n), "v": pa.array(list(r.standard_normal((n, 32)).astype(np.float32)))}))
        cells = vectors._sketched(df.selectExpr("cell", "0 as wide", "v"), 11).select("cell", "sketch", "wide", "v")
        sizes = vectors._hashed(cells, keys, tables, 2.0, 11).groupBy("bucket").count().selectExpr("sum(count * (count - 1))").first()[0]
        shares.append((sizes / n / tables, vectors.candidate_cells(cells, keys, tables, 2.0, 11).count() / n))
    assert max(a for a, _ in shares) < 16 and max(a for a, _ in shares) < 2 * min(a for a, _ in shares)
    assert all(b < 1 for _, b in shares)


def test_vectors_of_extreme_length(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1.0, 1.0]), (4, [1e300, -1e300])]
    got = {x.vec_id: (x.n_links, x.component_id) for x in vectors.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


@pytest.mark.parametrize("n", [300, 3000])
def test_recall_against_brute_force(spark, n):
    """Clusters of all widths: nearly every brute-force link is found, and no other."""
    r = np.random.default_rng(n)
    centres = r.standard_normal((n // 6, 24))
    x = (centres[r.integers(0, len(centres), n)] + r.standard_normal((n, 24)) * r.choice([0.05, 0.15, 0.2], (n, 1))).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x))}))
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (y @ y.T >= 0.95).sum(axis=1) - 1
    got = {row.vec_id: row.n_links for row in vectors.vector_groups(df).select("vec_id", "n_links").collect()}
    assert all(got[i] <= want[i] for i in range(n)) and sum(got.values()) >= 0.995 * want.sum() > 0
