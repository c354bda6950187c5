"""Invariants and brute-force checks of neighbours, splits, models and clusters."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wayfarer.operators import clusters, evaluation, features, folds, models, neighbours, splits
from wayfarer.plans import study


@pytest.fixture(scope="module")
def blobs(spark):
    """Three classes; a third of the rows are copies of one point."""
    rng = np.random.default_rng(5)
    rows = []
    for label, n in ((0, 40), (1, 90), (2, 50)):
        for _ in range(n):
            x = rng.normal(label * 4, 1, 3) if label != 1 else np.array([4.0, 4.0, 4.0])
            rows.append((len(rows), label, [float(v) for v in x]))
    return spark.createDataFrame(rows, "id bigint, label int, x array<double>")


def brute(points, queries, k, metric="euclidean", same=False):
    out = {}
    for q in queries:
        gaps = []
        for p in points:
            if same and (p["id"] == q["id"] or p["label"] != q["label"]):
                continue
            d = np.array(p["x"]) - np.array(q["x"])
            gaps.append((float(np.abs(d).sum() if metric == "manhattan" else np.sqrt((d * d).sum())), p["id"]))
        out[q["id"]] = sorted(gaps)[:k]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("block_rows", [7, 4096])
def test_neighbours_equal_brute_force(blobs, metric, block_rows):
    got = {}
    found = neighbours.nearest_neighbours(
        blobs, blobs, "id", "id", "x", 4, metric, exclude_self=True, within="label", pivots=6, block_rows=block_rows
    )
    for r in found.orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["distance"], r["neighbour_id"]))
    rows = blobs.collect()
    wanted = brute(rows, rows, 4, metric, same=True)
    assert {q: [i for _, i in near] for q, near in got.items()} == {q: [i for _, i in near] for q, near in wanted.items()}
    assert [d for q in sorted(got) for d, _ in got[q]] == pytest.approx([d for q in sorted(wanted) for d, _ in wanted[q]], rel=1e-12)


def test_smote_balances_and_stays_on_segments(blobs):
    out = splits.smote(blobs, "id", "label", "x", k=5, chunk=3).collect()
    by_label = {}
    for r in out:
        by_label[r["label"]] = by_label.get(r["label"], 0) + 1
    assert set(by_label.values()) == {90}
    points = {r["id"]: (r["label"], np.array(r["x"])) for r in blobs.collect()}
    for r in out:
        if r["synthetic"]:
            base, near = points[r["base"]], points[r["neighbour"]]
            assert base[0] == near[0] == r["label"]
            low, high = np.minimum(base[1], near[1]) - 1e-9, np.maximum(base[1], near[1]) + 1e-9
            assert ((low <= r["x"]) & (r["x"] <= high)).all()


def test_smote_is_repeatable(blobs):
    take = lambda df: sorted((r["base"], tuple(r["x"])) for r in df.where("synthetic").collect())
    assert take(splits.smote(blobs, "id", "label", "x")) == take(splits.smote(blobs.repartition(3), "id", "label", "x"))


def test_splits_keep_class_shares(blobs):
    train = splits.stratified_split(blobs, ["id"], "label", 0.8).where("is_train").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in train} == {0: 32, 1: 72, 2: 40}
    folds = splits.stratified_folds(blobs, ["id"], "label", 5).groupBy("label", "fold").count().collect()
    assert len(folds) == 15 and {r["count"] for r in folds} == {8, 18, 10}


def test_time_folds_expand(spark):
    df = spark.range(25).withColumnRenamed("id", "k")
    folds = {r["position"]: r["test_fold"] for r in splits.time_series_folds(df, "k", 5).collect()}
    assert [folds[i] for i in range(25)] == [0] * 5 + [f for f in range(1, 6) for _ in range(4)]
    assert [r["train_rows"] for r in splits.time_fold_ranges(df, 5).orderBy("fold").collect()] == [5, 9, 13, 17, 21]


@pytest.fixture(scope="module")
def table(blobs):
    return blobs.select(
        "id", F.when(F.col("label") == 0, "low").when(F.col("label") == 1, "mid").otherwise("high").alias("target"),
        *[F.col("x")[i].alias(f"x{i}") for i in range(3)], F.when(F.col("id") % 2 == 0, "even").alias("parity"),
    )


@pytest.fixture(scope="module")
def prepared(table):
    return study.prepare(table, "id", "target", ["x0", "x1", "x2"], ["parity"])


@pytest.mark.parametrize("name, params", [
    ("random_forest", {"numTrees": 5, "maxDepth": 4}), ("decision_tree", {"maxDepth": 4}),
    ("logistic_regression", {"C": 1.0, "maxIter": 20}), ("linear_svm", {"maxIter": 20}), ("gaussian_nb", {}),
    ("knn", {"k": 3, "weights": "distance"}), ("mlp", {"hidden": (5,), "maxIter": 60}),
])
def test_models_beat_the_majority(prepared, name, params):
    model = models.make_model(name, params, **models.context(prepared.train, "id")).fit(prepared.train)
    assert evaluation.accuracy(model.transform(prepared.test)) > 0.6


def test_importances_sum_to_one(prepared, spark):
    model = models.make_model("random_forest", {"numTrees": 5, "maxDepth": 4}).fit(prepared.train)
    rows = models.feature_importance(model, prepared.names, spark).collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1)
    assert [r["feature"] for r in rows if r["feature"].startswith("parity")] == ["parity_even"]


def test_grid_search_and_bake_off(prepared):
    found, model, best = study.tune(prepared, "decision_tree", {"maxDepth": [1, 4]}, folds=3)
    assert best == {"maxDepth": 4} and found.count() == 2
    out = study.run(prepared, {"gaussian_nb": {}, "knn": {"k": 3}}, folds=3)
    assert out["leaderboard"].count() == 2 and out["report"].count() == 6


def test_time_validation_and_multi_output(table):
    small = {"numTrees": 3, "maxDepth": 3}
    scores = study.time_validation(table.withColumn("id", F.pmod(F.col("id") * 77, F.lit(181))), "id", "target", ["x0", "x1"], [], 3, params=small)
    assert all(0 <= r["accuracy"] <= 1 for r in scores.collect())
    two = table.withColumn("other", F.when(F.col("x0") > 4, "a").otherwise("b"))
    assert {r["target"] for r in study.multi_output(two, "id", ["target", "other"], ["x0", "x1", "x2"], [], params=small).collect()} == {"target", "other"}


def test_unseen_text_gets_the_zero_row(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "a")], "n double, t string")
    model = features.fit_feature_pipeline(train, ["n"], ["t"])
    row = features.encode(model, spark.createDataFrame([(2.0, "new")], "n double, t string")).first()
    assert row["features"].toArray().tolist() == [0.0, 0.0, 0.0]


def test_pca_is_centred_and_signed(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(10)], "id int, x array<double>")
    scores, ratios, loadings = features.pca(df, "x", 2)
    first = [r["pc"][0] for r in scores.orderBy("id").collect()]
    assert sum(first) == pytest.approx(0, abs=1e-9) and first == sorted(first)
    assert ratios[0] == pytest.approx(1) and loadings[1, 0] > 0


def test_silhouettes(blobs):
    vectors = blobs.withColumn("features", array_to_vector("x")).withColumnRenamed("label", "cluster")
    for metric in ("squared", "euclidean"):
        values = [r["silhouette"] for r in clusters.silhouettes(vectors, "id", "features", metric=metric).collect()]
        assert len(values) == 180 and all(-1 <= v <= 1 for v in values)
    table, k, model = clusters.kmeans_sweep(vectors.drop("cluster"), "id", range(2, 5), restarts=2)
    assert k in (2, 3, 4) and table.count() == 3 and len(model.centres) == k


def test_one_tree_serves_every_depth_and_number(prepared, spark):
    """A tree cut at a depth predicts like the tree fitted to that depth; a forest's first trees like the forest itself."""
    rows = prepared.train.select("id", "label", "features")
    x = np.array([r["features"].toArray() for r in rows.orderBy("id").collect()])
    deep = folds.read_trees(models.make_model("decision_tree", {"maxDepth": 8}).fit(rows), spark).votes(x, [2, 4, 8], [1])
    for place, depth in enumerate((2, 4, 8)):
        alone = models.make_model("decision_tree", {"maxDepth": depth}).fit(rows).transform(rows).orderBy("id")
        assert deep[place].argmax(axis=1).tolist() == [int(r["prediction"]) for r in alone.collect()]
    forest = models.make_model("random_forest", {"numTrees": 7, "maxDepth": 5}).fit(rows)
    votes = folds.read_trees(forest, spark).votes(x, [3, 5], [4, 7])
    whole = np.array([r["rawPrediction"].toArray() for r in forest.transform(rows).orderBy("id").collect()])
    assert np.allclose(votes[3], whole) and np.allclose(votes.sum(axis=2), np.array([4, 7, 4, 7])[:, None])


def test_shared_searches_equal_single_fits(prepared):
    rows = splits.stratified_folds(prepared.train, ["id"], "label", 3).cache()
    for name, grid in (("gaussian_nb", {"smoothing": [1e-9, 1e-1]}), ("knn", {"k": [1, 4], "weights": ["uniform", "distance"], "metric": ["euclidean", "manhattan"]}),
                       ("decision_tree", {"maxDepth": [1, 3], "impurity": ["gini", "entropy"]})):
        shared, best = folds.search(rows, name, grid, "fold", 3, "id")
        single, _, wanted = models.grid_search(rows, name, grid, "fold", 3, "id")
        a, b = ([r["accuracy"] for r in t.orderBy("setting").collect()] for t in (shared, single))
        assert a == pytest.approx(b) and best == wanted


def test_fold_moments_are_those_of_the_rows(prepared):
    rows = splits.stratified_folds(prepared.train, ["id"], "label", 3).cache()
    every = [(r["fold"], r["label"], r["features"].toArray()) for r in rows.collect()]
    moments = folds.fold_moments(rows, "fold")
    for fold in (0, 1, 2, None):
        for c, m in folds.training_moments(moments, fold).items():
            x = np.array([v for f, y, v in every if y == c and f != fold])
            assert m.n == len(x) and np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.gaps, ((x - x.mean(axis=0)) ** 2).sum(axis=0))


def test_selection_stage_saves_loads_and_names(prepared, spark, tmp_path):
    from pyspark.ml import PipelineModel

    model = folds.selecting("random_forest", {"numTrees": 3, "maxDepth": 3}, 2, **models.context(prepared.train, "id")).fit(prepared.train)
    slots = model.stages[0].getIndices()
    wanted = folds.selected(folds.training_moments(folds.fold_moments(prepared.train.withColumn("f", F.lit(0)), "f"), None), 2)
    assert list(slots) == wanted.tolist()
    model.save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    rows = prepared.test.orderBy("id")
    assert [r["prediction"] for r in again.transform(rows).collect()] == [r["prediction"] for r in model.transform(rows).collect()]
    found = models.feature_importance(model, [prepared.names[i] for i in slots], spark).collect()
    assert len(found) == 2 and sum(r["importance"] for r in found) == pytest.approx(1)


def test_oversampling_leaves_the_test_rows_alone(prepared):
    report, made = study.oversampled_report(prepared, "decision_tree", {"maxDepth": 4})
    sizes = {r["label"]: r["count"] for r in made.groupBy("label").count().collect()}
    assert len(set(sizes.values())) == 1
    kept = {r["id"] for r in made.where("not synthetic").collect()}
    assert kept == {r["id"] for r in prepared.train.collect()}
    assert report.where("name = 'accuracy'").first()["support"] == prepared.test.count()
