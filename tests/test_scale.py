"""What must hold whatever the size: no caps, no assumed keys, no machine-local staging on a cluster."""

from __future__ import annotations

import itertools
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer import session
from wayfarer.operators import clean, clusters, neighbours, ordering, quantiles, rules
from wayfarer.plans.star import Dimension, Star


def test_staging_needs_a_shared_folder_off_local_masters():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.staging_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_orphan_keys_drop_out_unless_declared_whole(spark):
    fact = spark.createDataFrame([(1, 10), (2, 20), (9, 30)], "k int, v int")
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    assert Star(fact, {"d": Dimension(dim, "k")}).flat(["v"]).count() == 2
    assert Star(fact, {"d": Dimension(dim, "k", total=True)}).flat(["v"]).count() == 3


def test_twenty_thousand_labels(spark):
    rows = spark.range(40_000).select(F.concat(F.lit("v"), F.lpad((F.col("id") % 20_000).cast("string"), 5, "0")).alias("c"), "id")
    found = clean.label_encode(rows, "c", "code")
    assert found.where(F.col("code") != F.col("id") % 20_000).count() == 0 and found.count() == 40_000
    assert clean.label_encode(spark.createDataFrame([(None,), ("x",)], "c string"), "c", "code").where("c is null and code is null").count() == 1


def test_one_hot_of_twenty_thousand_values(spark):
    rows = spark.range(40_000).select(F.concat(F.lit("v"), F.lpad((F.col("id") % 20_000).cast("string"), 5, "0")).alias("c"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, -1)], "c string, id long"))
    found = clean.one_hot_vector(rows, "c", "hot")
    vectors = {r["id"]: r["hot"] for r in found.where("id < 0 or id in (0, 7, 20007, 39999)").collect()}
    assert vectors[-1].size == 20_000 and vectors[-1].numNonzeros() == 0
    assert [vectors[i].indices.tolist() for i in (0, 7, 20007, 39999)] == [[0], [7], [7], [19_999]] and found.count() == 40_001
    assert clean.one_hot_vector(rows.where("id < 0"), "c", "hot").first()["hot"].size == 0


def test_tiny_gaps_decide_neighbours_and_clusters(spark):
    points = spark.createDataFrame([(i, [i * 1e-10]) for i in range(20)], "id long, x array<double>")
    query = spark.createDataFrame([(0, [9e-10])], "q long, x array<double>")
    assert [r["id"] for r in neighbours.nearest_neighbours(query, points, "q", "id", "x", 1, pivots=1).collect()] == [9]
    near = clusters.assign_nearest(spark.createDataFrame([([2e-7],)], "x array<double>"), "x", {0: [0.0], 1: [2e-7]})
    assert near.first()["cluster"] == 1


def test_itemsets_are_all_frequent_sets(spark):
    rng = random.Random(1)
    baskets = [sorted(rng.sample("abcdefgh", rng.randint(0, 6))) for _ in range(200)]
    found = rules.frequent_itemsets(spark.createDataFrame([(b,) for b in baskets], "items array<string>"), 0.2)
    wanted = {}
    for size in range(1, 9):
        for items in itertools.combinations("abcdefgh", size):
            n = sum(set(items) <= set(b) for b in baskets)
            if n >= 40:
                wanted[items] = n
    assert {tuple(r["items"]): r["n"] for r in found.itemsets.collect()} == wanted


def test_candidates_are_counted_in_groups(spark, monkeypatch):
    """Groups smaller than the candidates, rows that fill no whole word, null items and rows."""
    monkeypatch.setattr(rules, "CANDIDATES", 7)
    rng = random.Random(4)
    baskets = [sorted(rng.sample("abcdefgh", rng.randint(0, 6))) + [None] * (i % 5 == 0) for i in range(131)] + [None]
    pairs = list(itertools.combinations(range(8), 2))
    found = rules._count(spark.createDataFrame([(b,) for b in baskets], "items array<string>").coalesce(2), list("abcdefgh"), pairs)
    wanted = {at: sum({"abcdefgh"[i], "abcdefgh"[j]} <= set(b or []) for b in baskets) for at, (i, j) in enumerate(pairs)}
    assert {r["at"]: r["n"] for r in found.collect()} == {at: n for at, n in wanted.items() if n}


def test_rules_of_thirty_items(spark):
    """Only what reaches the confidence is grown: no 2^30 splits."""
    items = [f"i{k:02d}" for k in range(30)]
    sets = [(items, 95)] + [(items[:k] + items[k + 1:], 100 if k < 4 else 300) for k in range(30)] + [([i], 400) for i in items]
    sets += [([i for i in items if i not in (items[0], items[1])], 104), ([i for i in items if i not in (items[2], items[3])], 200), (items[:2], 390)]
    mined = rules.Mined(spark.createDataFrame(sets, "items array<string>, n bigint"), 1000)
    found = rules.association_rules(mined, min_confidence=0.9)
    got = sorted((tuple(r["consequent"]), len(r["antecedent"]), round(r["confidence"], 6)) for r in found.where("size(antecedent) + size(consequent) = 30").collect())
    assert got == sorted([((items[k],), 29, 0.95) for k in range(4)] + [((items[0], items[1]), 28, round(95 / 104, 6))])


def test_skewed_keys_are_cut_evenly(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 500)
    u = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = F.sqrt(-2 * F.log(u)) * F.cos(6.283185307179586 * F.pmod(F.col("id") * 0.6180339887498949, F.lit(1.0)))
    for v in (F.exp(3 * normal), 1 / F.pow(u, 2.0), F.tan(3.141592653589793 * (u - 0.5)), F.lit(1.0)):
        rows = spark.range(20_000).select("id", v.alias("v"))
        sizes = [r["count"] for r in ordering.sample_sorted(rows, "v", "id").groupBy(ordering.BUCKET).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 3 * 500
    got = ordering.placed(rows, "v", "id").where("position <> id").count()
    assert got == 0


def test_quantiles_of_groups_on_different_scales(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "small").when(F.col("id") % 3 == 1, "heavy").otherwise("two").alias("g"), "id",
        F.when(F.col("id") % 3 == 0, F.col("id") * 1e-10).when(F.col("id") % 3 == 1, F.exp(F.col("id") / 1000.0)).otherwise(F.col("id") % 2 * 1.0).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("one", 1, 5.0), ("none", 2, None), (None, 3, 7.0)], "g string, id long, v double"))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = {r["g"]: list(r)[1:] for r in quantiles.quantiles(rows, "v", probs, ["g"], list("abcde"), held=50).collect()}
    values = {}
    for r in rows.where("v is not null").collect():
        values.setdefault(r["g"], []).append(r["v"])
    assert set(found) == set(values)
    for g, wanted in values.items():
        assert found[g] == pytest.approx(np.quantile(wanted, probs).tolist(), rel=1e-12)


def test_kmeans_runs_find_separate_groups(spark):
    rng = random.Random(2)
    rows = [(i, [5.0 * (i % 3) + rng.random(), rng.random()]) for i in range(150)]
    table, best, model = clusters.kmeans_sweep(spark.createDataFrame(rows, "id long, features array<double>"), "id", range(2, 6), restarts=4)
    assert best == 3 and table.count() == 4
    assert model.transform(spark.createDataFrame(rows, "id long, features array<double>")).groupBy("cluster").count().where("count = 50").count() == 3


def test_kmeans_starts_meet_every_group(spark):
    """A hot vector on most rows, and small far groups that a sample in hash order could miss."""
    hot = spark.range(20_000).select("id", F.array(F.lit(1.0), F.lit(1.0)).alias("features"))
    far = spark.createDataFrame([(30_000 + i, [100.0 * (i % 6), -50.0 + i % 6 + i / 1000]) for i in range(12)], "id long, features array<double>")
    for seed in (1, 2):
        model = clusters.kmeans(hot.unionByName(far), 7, seed=seed, restarts=3)
        assert len(model.centres) == 7 and model.cost < 1.0
    few = spark.createDataFrame([(i, [float(i % 3)]) for i in range(50)], "id long, features array<double>")
    assert len(clusters.kmeans(few, 5).centres) == 3


def test_columns_stay_side_by_side(spark, monkeypatch):
    """No row per column and value: ties, a constant, nulls, an empty column; a column whose sketch misses goes the long way."""
    rng = random.Random(8)
    rows = [(rng.lognormvariate(0, 3), float(i % 7), 5.0 if i % 3 else None, None, 1 << 40 | i) for i in range(5001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e long")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    wanted = {c: np.quantile([r[i] for r in rows if r[i] is not None], probs).tolist() for i, c in enumerate("abcde") if c != "d"}
    take = lambda: {r["column"]: [r[f"p.{i}"] for i in range(5)] for r in quantiles.column_quantiles(df, list("abcde"), probs, [f"p.{i}" for i in range(5)]).collect()}
    long = quantiles.quantiles
    monkeypatch.setattr(quantiles, "quantiles", None)
    found = take()
    assert set(found) == set(wanted) and all(found[c] == pytest.approx(wanted[c], rel=1e-12) for c in wanted)
    monkeypatch.setattr(quantiles, "quantiles", long)
    monkeypatch.setattr(quantiles, "HELD", -1)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    found = take()
    assert set(found) == set(wanted) and all(found[c] == pytest.approx(wanted[c], rel=1e-12) for c in wanted)


def test_bayes_judges_a_row_once(spark):
    from pyspark.ml.functions import array_to_vector

    from wayfarer.operators import models

    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (300, 4)) + np.arange(300)[:, None] % 3
    rows = [(i, float(i % 3), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, label double, x array<double>").select("id", "label", array_to_vector("x").alias("features"))
    model = models.GaussianBayes(1e-9).fit(df)
    out = model.transform(df)
    assert "zip_with" not in out._jdf.queryExecution().analyzed().toString()  # neither in lambdas nor once per class and use
    dense = np.stack([np.log(p) - 0.5 * (np.log(2 * np.pi * np.array(v)) + (x - m) ** 2 / v).sum(axis=1) for _, p, m, v in model.classes], axis=1)
    mass = np.exp(dense - dense.max(axis=1)[:, None])
    for r in out.collect():
        assert r["prediction"] == dense[r["id"]].argmax()
        assert r["probability"] == pytest.approx((mass / mass.sum(axis=1)[:, None])[r["id"]].tolist(), abs=1e-12)


def test_sweep_scores_come_from_two_passes(spark, monkeypatch):
    """Silhouettes of all k without a row per dimension or k plans: equal to those of the rows, with ties, copies, a class of one and no vector."""
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(3)), float(rng.randrange(2)), rng.random() if i % 4 else 0.5]) for i in range(400)] + [(900, [500.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    runs = clusters.kmeans_runs(df, range(2, 6), restarts=2)
    wanted = {k: clusters.silhouette_score(m.transform(df), "id") for k, m in runs.items()}
    monkeypatch.setattr(clusters, "silhouettes", None)
    table, _, _ = clusters.kmeans_sweep(df, "id", range(2, 6), restarts=2)
    assert {r["k"]: r["silhouette"] for r in table.collect()} == pytest.approx(wanted, abs=1e-9)
    gap = spark.createDataFrame([*rows, (901, None)], "id long, features array<double>")
    table, _, _ = clusters.kmeans_sweep(gap, "id", range(2, 6), restarts=2)
    assert {r["k"]: r["silhouette"] for r in table.collect()} == pytest.approx({k: v * 401 / 402 for k, v in wanted.items()}, abs=1e-9)


def test_kmeans_step_reads_packed_blocks(spark, monkeypatch):
    """Blocks of a few rows give the sums of a row by row assignment; rows between two centres go to the earlier one."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (500, 3)).astype(float)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>")
    monkeypatch.setattr(clusters, "PACK", 30)
    rows, width = clusters.packed(df, "features")
    assert width == 3 and rows.count() > 40 and rows.selectExpr("sum(n)").first()[0] == 500
    centres = {0: np.array([[0.0, 0, 0], [2, 0, 0], [0, 2, 2]]), 7: np.array([[1.0, 1, 1], [1, 1, 1], [3, 3, 3]])}
    for run, (cost, counts, sums) in clusters._step(rows, centres).items():
        gaps = ((x[:, None, :] - centres[run][None]) ** 2).sum(axis=2)
        own = gaps.argmin(axis=1)
        assert cost == pytest.approx(gaps.min(axis=1).sum()) and counts.tolist() == np.bincount(own, minlength=3).tolist()
        assert sums == pytest.approx(np.array([x[own == c].sum(axis=0) for c in range(3)]))


def test_kmeans_starts_draw_without_a_sort(spark, monkeypatch):
    """Each round reads the rows twice, for the costs and for the draw: a global sort of what is drawn would read them once more."""
    from pyspark.sql import DataFrame

    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 2))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>")
    rows, width = clusters.packed(df, "features")
    pools = [x[:3], x[5:9]]
    assert clusters._least(x, pools) == pytest.approx(np.stack([((x[:, None] - p[None]) ** 2).sum(axis=2).min(axis=1) for p in pools]), abs=1e-12)
    monkeypatch.setattr(DataFrame, "orderBy", None)
    found = clusters._starts(rows, width, 4, 1, 3)
    assert len(found) == 3
    for pool, weights in found:
        own = ((x[:, None] - pool[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert weights.tolist() == np.bincount(own, minlength=len(pool)).tolist()


def test_cluster_profile_reads_the_rows_once(spark):
    rows = [(None, 1.0)] * 2 + [(0, 2.0)] * 5 + [(1, None)]
    out = clusters.cluster_profile(spark.createDataFrame(rows, "c int, v double"), "c", ["v"], [])
    assert "subquery" not in out._jdf.queryExecution().toString().lower()
    assert {tuple(r) for r in out.collect()} == {(None, 1.0, 2, 25.0), (0, 2.0, 5, 62.5), (1, None, 1, 12.5)}
