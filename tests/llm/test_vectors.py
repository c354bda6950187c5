"""Vector operators against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("wayfarer.llm")
from wayfarer.llm import neighbours, topk  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(n: int, d: int = 16, seed: int = 1):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    x[n // 2:n // 2 + n // 6] = x[3]  # many copies of one vector
    return x


@pytest.fixture(scope="module")
def table(spark):
    x = rows_of(600)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] * 16, 0), (1060, [None] + [1.0] * 15, 0), (1080, [1.0, 2.0], 0), (None, [1.0] * 16, 0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "node", "shard", "score", "rank", "terms")})
    return x, frame.repartition(4).cache()


def test_top_k_is_exact(spark, table, monkeypatch):
    x, frame = table
    monkeypatch.setattr(topk, "CANDIDATES", 150)
    monkeypatch.setattr(topk, "QUERIES", 10)
    found = topk.search(topk.sparse_rows(frame.where("vec_id is null or vec_id not in (1020, 1080)"), "vec_id", "embedding", 64.0), F.col("id") % 20 == 0, 20).collect()
    z = np.floor(64 * x.astype(float)).astype(np.int64)
    got: dict = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 20))
    for q, rows in got.items():
        s = z @ z[q]
        order = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        assert sorted(rows) == [(k + 1, i, s[i]) for k, i in enumerate(order)]
    none = topk.sparse_rows(frame.where("false"), "vec_id", "embedding", 64.0)
    assert topk.search(none, F.col("id") % 20 == 0, 20).count() == 0


def test_neighbours_reach_recall(spark, table, monkeypatch):
    x, frame = table
    monkeypatch.setattr(neighbours, "SHARD", 200)
    monkeypatch.setattr(neighbours, "NODES", 100)
    found = neighbours.search(frame, "vec_id", "embedding", "id % 20 = 0", 10).collect()
    got: dict = {}
    for r in found:
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    for q, rows in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 11))
        for r in rows:
            assert r["vec_id"] != q and r["score"] == pytest.approx(d[r["vec_id"]], abs=1e-12)
        assert [(r["score"], r["vec_id"]) for r in rows] == sorted((r["score"], r["vec_id"]) for r in rows)
        order = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        hits += len(set(order) & {r["vec_id"] for r in rows})
    assert hits >= 0.9 * 10 * len(got)
    assert neighbours.search(frame.where("false"), "vec_id", "embedding", "id % 20 = 0", 10).count() == 0
    few = neighbours.search(frame.where("vec_id in (0, 1, 2)"), "vec_id", "embedding", "id = 0", 10).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]


def grouped_rows(n: int, groups: int, d: int, spread: float) -> np.ndarray:
    rng = np.random.default_rng(8)
    return rng.normal(size=(groups, d))[np.arange(n) % groups] + spread * rng.normal(size=(n, d))


def test_search_reaches_every_island_of_the_graph():
    x = grouped_rows(6000, 150, 32, 0.3)
    d = (x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T
    nearest = np.argsort(d, axis=1)[:, :17]
    lists = [[int(v) for v in row if v != u][:16] for u, row in enumerate(nearest)]
    place, far = neighbours.greedy(np.arange(6000), x, lists, x[:300], 11)
    hits = sum(len(set(place[u, :11].tolist()) & set(nearest[u, :11].tolist())) for u in range(300))
    assert hits >= 0.98 * 11 * 300


def test_neighbours_reach_recall_in_tight_groups_over_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 2000)
    monkeypatch.setattr(neighbours, "NODES", 1000)
    x = grouped_rows(6000, 60, 16, 0.05).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got: dict = {}
    for r in neighbours.search(frame, "vec_id", "embedding", "id % 50 = 0", 10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    x = x.astype(float)
    hits = 0
    for q in range(0, 6000, 50):
        order = [i for i in np.lexsort((np.arange(6000), ((x - x[q]) ** 2).sum(1))) if i != q][:10]
        hits += len(got[q] & set(order))
    print("recall", hits / 1200)
    assert hits >= 0.95 * 1200


def test_top_k_of_large_scores_ties_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    rng = np.random.default_rng(4)
    v = rng.integers(-(2**21), 2**21, size=(200, 4)) * 16  # scores near 2 ** 52
    v[50:90] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [rows[0], rows[0], rows[20], (40, [1, 0, 0, 0])]  # equal rows, and an id with two vectors
    frame = spark.createDataFrame([(i, [float(c) / 64 for c in x]) for i, x in rows], "vec_id long, embedding array<double>")
    found = topk.search(topk.sparse_rows(frame, "vec_id", "embedding", 64.0), F.col("id") % 20 == 0, 20).collect()
    distinct = sorted({(i, tuple(x)) for i, x in rows})
    query = {}
    for i, x in distinct:  # of two vectors of an id the one of least terms, then weights
        key = ([t for t, c in enumerate(x) if c], [c for c in x if c])
        if i % 20 == 0 and (i not in query or key < query[i][0]):
            query[i] = (key, x)
    for q, (_, x) in query.items():
        wanted = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in distinct if i != q)[:20]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [(i, s) for _, i, s in got] == [(i, -s) for s, i in wanted] and [r for r, _, _ in got] == list(range(1, 21))
