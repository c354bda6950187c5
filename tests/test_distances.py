"""Distances in bulk: estimates first, exact sums for what may count, each pair of blocks once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from wayfarer.operators import clusters, neighbours, splits


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("kind", ["plain", "ties", "copies", "far", "odd"])
def test_closest_equals_a_full_sort(metric, kind):
    rng = np.random.default_rng(3)
    for n, width, k in ((1, 2, 3), (500, 1, 5), (3000, 17, 4)):
        a, b = rng.normal(size=(40, width)), rng.normal(size=(n, width))
        if kind == "ties":
            a, b = np.round(a), np.round(b)
        if kind == "copies":
            b[:], a[:5] = b[0], b[0]
        if kind == "far":
            a, b = a + 1e6, b + 1e6
        if kind == "odd":
            a[3], b[n // 2], a[5, 0], b[0, 0] = np.nan, np.inf, 1e200, 1e200
        skip = rng.random((40, n)) < 0.3
        with np.errstate(all="ignore"):
            whole = np.array([[np.abs(x - y).cumsum()[-1] if metric == "manhattan" else np.sqrt(((x - y) * (x - y)).cumsum()[-1]) for y in b] for x in a])
            whole[skip] = np.inf
            rows, columns, distance = neighbours.closest(a, b, k, metric, skip)
        take = np.argsort(whole, axis=1, kind="stable")[:, :k]
        wanted = [(i, j, whole[i, j]) for i in range(40) for j in take[i].tolist() if np.isfinite(whole[i, j])]
        assert list(zip(rows.tolist(), columns.tolist(), distance.tolist())) == wanted


def test_distance_sums_over_blocks(spark):
    """Repeated keys and equal vectors; blocks of 40 rows, each pair of which meets once."""
    rng = np.random.default_rng(1)
    rows = [(i // 2 if i < 40 else i, int(rng.integers(4)), rng.normal(size=3).tolist()) for i in range(200)]
    rows += [(1000 + i, 2, rows[7][2]) for i in range(50)]
    found = clusters._distance_sums(spark.createDataFrame(rows, "__k long, __c int, __x array<double>"), 40)
    x, c = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    wanted: dict = {}
    for at, (key, own, _) in enumerate(rows):
        for other in range(4):
            size, total = wanted.get((key, own, other), (0, 0.0))
            wanted[key, own, other] = (size + (c == other).sum(), total + d[at, c == other].sum())
    got = {(r["__k"], r["__c"], r["__other"]): (r["size"], r["total"]) for r in found.collect()}
    assert set(got) == set(wanted)
    assert all(got[k][0] == n and got[k][1] == pytest.approx(t, abs=1e-9) for k, (n, t) in wanted.items())


def test_a_query_is_staged_once(spark, monkeypatch):
    """However many cells it must visit."""
    staged = {}

    def keep(df, label):
        staged[label] = df.cache()
        return staged[label]

    monkeypatch.setattr(neighbours, "stage", keep)
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(i, rng.normal(size=12).tolist()) for i in range(300)], "id long, x array<double>")
    queries = points.selectExpr("id as q", "x").where("q < 20")
    assert neighbours.nearest_neighbours(queries, points, "q", "id", "x", 3).count() == 60
    assert staged["queries"].count() == 20


def test_flags_are_compared_by_products(monkeypatch):
    """Columns of 0 and 1 beside one other column, as encoded text gives: no pass over the pairs per column, whatever the metric."""

    def never(*_):
        raise AssertionError("pairs were measured column by column")

    monkeypatch.setattr(neighbours, "pairwise", never)
    rng = np.random.default_rng(5)
    a, b = ((rng.random((n, 30)) < 0.3).astype(float) for n in (300, 2500))
    a[:, 0], b[:, 0] = rng.normal(size=300), rng.normal(size=2500)
    for metric in ("euclidean", "manhattan"):
        gaps = a[:, None] - b[None]
        whole = np.abs(gaps).cumsum(axis=2)[..., -1] if metric == "manhattan" else np.sqrt((gaps * gaps).cumsum(axis=2)[..., -1])
        take = np.argsort(whole, axis=1, kind="stable")[:, :6]
        rows, columns, distance = neighbours.closest(a, b, 6, metric)
        assert rows.tolist() == np.repeat(np.arange(300), 6).tolist() and columns.tolist() == take.reshape(-1).tolist()
        assert distance.tolist() == np.take_along_axis(whole, take, axis=1).reshape(-1).tolist()


@pytest.mark.parametrize("alone", [False, True])
def test_copies_are_compared_once(spark, monkeypatch, alone):
    """Four vectors in 400 rows, keys that repeat: only as many copies as can count are kept, and the nearest are those of a full sort."""
    staged = {}

    def keep(df, label):
        staged[label] = df.cache()
        return staged[label]

    monkeypatch.setattr(neighbours, "stage", keep)
    rows = [(i if i > 6 else 3, [float(i % 2), float(i % 4 // 2)]) for i in range(400)]
    points = spark.createDataFrame(rows, "id long, x array<double>").repartition(3)
    found = neighbours.nearest_neighbours(points.where("id >= 350"), points, "id", "id", "x", 5, exclude_self=alone)
    got = {}
    for r in found.collect():
        got.setdefault(r["id"], []).append((r["place"], r["distance"], r["neighbour_id"]))
    assert sorted(got) == list(range(350, 400))
    for q, near in got.items():
        wanted = sorted((float(np.sqrt(((np.array(x) - rows[q][1]) ** 2).sum())), p) for p, x in rows if not alone or p != q)[:5]
        assert [(d, p) for _, d, p in sorted(near)] == wanted
    assert staged["points"].count() <= 4 * 8


def test_equal_queries_are_looked_up_once(spark, monkeypatch):
    """Three vectors in 300 queries, a key that comes twice: three searches, and every query gets the nearest of its vector."""
    staged = {}

    def keep(df, label):
        staged[label] = df.cache()
        return staged[label]

    monkeypatch.setattr(neighbours, "stage", keep)
    points = spark.createDataFrame([(i, [float(i)]) for i in range(40)], "id long, x array<double>")
    queries = spark.createDataFrame([(max(i, 1), [float(i % 3) + 0.25]) for i in range(300)], "q long, x array<double>")
    found = neighbours.nearest_neighbours(queries, points, "q", "id", "x", 2)
    got = {}
    for r in found.collect():
        got.setdefault(r["q"], []).append((r["place"], r["id"]))
    assert staged["asked"].count() == 3
    assert sorted(got) == list(range(1, 300)) and all([p for _, p in sorted(got[q])] == [q % 3, q % 3 + 1] for q in range(2, 300))
    assert [p for _, p in sorted(got[1])] == [0, 1]  # of the two queries of this key the nearest two together


def test_oversampling_keeps_few_copies(spark, monkeypatch):
    """A class of 120 rows with one vector: as neighbours count those of the six smallest keys, for 180 rows that are made."""
    staged = {}

    def keep(df, label):
        staged[label] = df.cache()
        return staged[label]

    monkeypatch.setattr(neighbours, "stage", keep)
    rows = spark.createDataFrame([(i, int(i < 120), [1.0, 2.0] if i < 120 else [float(i), 0.0]) for i in range(420)], "id long, label int, x array<double>")
    made = splits.smote(rows, "id", "label", "x", k=5).where("synthetic").collect()
    assert len(made) == 180 and {tuple(r["x"]) for r in made} == {(1.0, 2.0)}
    assert all(r["neighbour"] in set(range(6)) - {r["base"]} for r in made)
    assert staged["points"].count() == 6


def test_vectors_of_flags_travel_in_few_bytes():
    """Rows of 0 and 1 and one other number; equal rows give equal bytes, and nothing is lost."""
    rng = np.random.default_rng(2)
    x = (rng.random((300, 105)) < 0.2).astype(float)
    x[:, 7] = rng.normal(size=300)
    x[1], x[2, 9], x[3, 4] = x[0], np.nan, -0.0
    packed = neighbours._packed(x)
    assert max(map(len, packed)) <= 2 * 14 + 2 * 8 and packed[0] == packed[1] != packed[2]
    assert np.array_equal(neighbours._unpacked(pa.chunked_array([packed]), 300, 105), x, equal_nan=True)


def test_oversampling_looks_up_only_the_neighbour_it_picks(spark, monkeypatch):
    """The search carries a number, not the neighbours' vectors; each synthetic row lies between its base and the neighbour it names."""
    carried = []
    kept = splits.nearest_neighbours

    def search(*args, carry=(), **more):
        carried.append(list(carry))
        return kept(*args, carry=carry, **more)

    monkeypatch.setattr(splits, "nearest_neighbours", search)
    rng = np.random.default_rng(4)
    rows = [(i, float(i < 12), [float(v) for v in rng.normal(size=3)]) for i in range(60)]
    found = splits.smote(spark.createDataFrame(rows, "id long, label double, x array<double>"), "id", "label", "x", 3).collect()
    assert carried == [["__row"]] and len(found) == 96
    at = {i: (c, np.array(x)) for i, c, x in rows}
    for r in found:
        if r["synthetic"]:
            (c, a), (d, b) = at[r["base"]], at[r["neighbour"]]
            share = (np.array(r["x"]) - a) / (b - a)
            assert c == d == r["label"] and np.ptp(share) < 1e-9 and 0 <= share[0] <= 1
            near = sorted((i for i in at if at[i][0] == c and i != r["base"]), key=lambda i: ((at[i][1] - a) ** 2).sum())[:3]
            assert r["neighbour"] in near
