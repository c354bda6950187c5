"""Deep trees against Spark's own, and their nodes kept off the driver."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from wayfarer.operators import evaluation, folds, forests, models
from wayfarer.session import stage


@pytest.fixture(scope="module")
def noisy(spark):
    """Flags, small codes and a wide number; classes that depend on some of them, with noise; copies of one row."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(3000):
        x = [float(v) for v in rng.integers(0, 2, 4)] + [float(rng.integers(0, 7)), float(rng.lognormal(0, 1)), 1.0] if i % 10 else [1.0, 0.0, 1.0, 0.0, 3.0, 0.5, 1.0]
        rows.append((i, float((x[0] + x[4] > 4) + (x[5] > 1) if rng.random() < 0.8 else rng.integers(0, 3)), x))
    return spark.createDataFrame(rows, "id long, label double, x array<double>").select("id", "label", array_to_vector("x").alias("features")).repartition(4).cache()


def said(model, rows):
    return [(r["id"], r["prediction"], [round(float(v), 9) for v in r["p"]]) for r in model.transform(rows).select("id", "prediction", vector_to_array("probability").alias("p")).orderBy("id").collect()]


@pytest.mark.parametrize("held", [100_000, 300])
@pytest.mark.parametrize("impurity, least, depth", [("gini", 1, 30), ("entropy", 4, 12)])
def test_a_tree_is_sparks_tree(noisy, monkeypatch, held, impurity, least, depth):
    """Grown in one part and from tops and many parts."""
    monkeypatch.setattr(forests, "HELD", held)
    monkeypatch.setattr(forests, "CELLS", 400)
    monkeypatch.setattr(forests, "LOCAL_CELLS", 300)
    monkeypatch.setattr(forests, "SLICE", 100)
    params = {"maxDepth": depth, "impurity": impurity, "minInstancesPerNode": least}
    mine = models.make_model("decision_tree", params).fit(noisy)
    assert isinstance(mine, forests.DeepForestModel) and (mine.parts.count() > 5) == (held == 300)
    wanted = DecisionTreeClassifier(**params).fit(noisy)
    assert said(mine, noisy) == said(wanted, noisy)
    assert mine.featureImportances.toArray() == pytest.approx(wanted.featureImportances.toArray(), abs=1e-9)
    shallow = [evaluation.accuracy(DecisionTreeClassifier(**params | {"maxDepth": d}).fit(noisy).transform(noisy)) for d in (2, 5, depth)]
    assert [right / n for right, n in mine.hits(noisy, [2, 5, depth], [1]).values()] == pytest.approx(shallow)


def test_a_deep_forest_does_as_well_as_sparks(noisy, monkeypatch):
    """The same whichever part of it is grown across tasks; votes of all trees for every row."""
    train, test = noisy.where("id % 4 <> 0"), noisy.where("id % 4 = 0")
    wanted = evaluation.accuracy(RandomForestClassifier(numTrees=30, maxDepth=30, seed=1).fit(train).transform(test))
    for held in (100_000, 400):
        monkeypatch.setattr(forests, "HELD", held)
        model = models.make_model("random_forest", {"numTrees": 30}).fit(train)
        assert evaluation.accuracy(model.transform(test)) == pytest.approx(wanted, abs=0.04)
        rows = model.transform(test).select(vector_to_array("rawPrediction").alias("r")).collect()
        assert len(rows) == test.count() and all(sum(r["r"]) == pytest.approx(30) for r in rows)
        assert model.featureImportances.toArray().sum() == pytest.approx(1) and model.featureImportances.toArray()[6] == 0
        scores = models.class_scores(model, test, "id").groupBy("id").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n")).collect()
        assert all(r["s"] == pytest.approx(1) and r["n"] == 3 for r in scores)


def test_a_deep_search_equals_single_fits(noisy):
    rows = noisy.withColumn("fold", (F.col("id") % 3).cast("int"))
    grid = {"maxDepth": [30, 3], "minInstancesPerNode": [1, 4]}
    found, _ = folds.search(rows, "decision_tree", grid, "fold", 3, "id")
    for r in found.collect():
        params = models.grid(grid)[r["setting"]]
        single = [evaluation.accuracy(DecisionTreeClassifier(**params).fit(rows.where(F.col("fold") != f)).transform(rows.where(F.col("fold") == f))) for f in range(3)]
        assert r["accuracy"] == pytest.approx(sum(single) / 3)


def test_rows_travel_packed_and_some_trees_at_a_time(noisy, monkeypatch):
    """Few bytes a row and tree are shuffled to grow a forest, none to ask it, and dealing tree by tree changes nothing."""
    whole = models.make_model("random_forest", {"numTrees": 3}).fit(noisy)
    monkeypatch.setattr(forests, "DEALT", 1)
    single = models.make_model("random_forest", {"numTrees": 3}).fit(noisy)
    assert (len(whole.files), len(single.files)) == (1, 3)
    assert said(whole, noisy) == said(single, noisy)
    asked = whole.votes(stage(noisy, "rows"), "id", [30], [3])
    assert "Exchange" not in asked._jdf.queryExecution().executedPlan().toString()
    assert asked.count() == noisy.count()


def test_bins_and_nodes_are_packed_without_loss():
    rng = np.random.default_rng(5)
    sizes = (2, 1, 32, 7, *[2] * 20, 3)
    b = np.stack([rng.integers(0, s, 900) for s in sizes], axis=1).astype(np.uint8)
    packing = forests.Packing(sizes)
    assert packing.width == 4 and (packing.unpack(packing.pack(b)) == b).all()
    y, w = rng.integers(0, 3, 900), rng.integers(1, 4, 900).astype(float)
    for keep in (5, len(sizes)):
        nodes = forests._grown(b, y, w, 30, list(sizes), 3, "gini", 1, keep, [1])
        again = forests.Nodes.unpacked(nodes.packed(), 3)
        for name in ("feature", "left", "right", "stats"):
            assert (getattr(again, name)[nodes.left >= 0] == getattr(nodes, name)[nodes.left >= 0]).all()
        ends = nodes.down(b, np.zeros(900, int))
        assert (again.down(b, np.zeros(900, int)) == ends).all() and (again.stats[ends] == nodes.stats[ends]).all()
        # every row counts where it ends
        assert sum(w[ends == e].sum() for e in np.unique(ends)) == nodes.stats[np.unique(ends)].sum() == w.sum()
