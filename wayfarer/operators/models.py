"""Classifiers behind one factory, so that search and bake-off treat them alike.

Spark ML supplies shallow trees and forests (deep ones are in `forests`), logistic regression, linear SVM and the
perceptron; Gaussian naive Bayes with a smoothing knob and k nearest neighbours
are estimators of our own. Every table reads ``features`` (vector) and
``label`` (double).
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators.evaluation import accuracy
from wayfarer.operators.features import feature_names
from wayfarer.operators.forests import DeepForest
from wayfarer.operators.neighbours import knn_classify, nearest_neighbours, vote_shares
from wayfarer.session import checkpoints

SEED = 42
SHALLOW = 10  #: depth up to which Spark's own trees are used: at most 2^11 nodes each, which the driver holds; deeper ones are `DeepForest`
#: Spark's trees: each row keeps the node it is in, so no tree travels with the tasks of a level, and more nodes share a pass
DEEP = {"cacheNodeIds": True, "maxMemoryInMB": 512, "checkpointInterval": 10}


class GaussianBayes(Estimator):
    """Gaussian naive Bayes. `smoothing` times the largest feature variance is
    added to every class variance."""

    def __init__(self, smoothing: float = 1e-9):
        super().__init__()
        self.smoothing = smoothing

    def _fit(self, dataset: DataFrame) -> "GaussianBayesModel":
        # one row per class: count, means, variances
        summary = Summarizer.metrics("mean", "variance", "count")
        rows = dataset.groupBy("label").agg(summary.summary(F.col("features")).alias("s")).collect()
        whole = dataset.select(Summarizer.metrics("variance", "count").summary(F.col("features")).alias("s")).first()["s"]
        shrink = (whole["count"] - 1) / whole["count"] if whole["count"] > 1 else 1.0
        extra = self.smoothing * max(whole["variance"].toArray() * shrink)
        total = sum(r["s"]["count"] for r in rows)
        classes = []
        for r in sorted(rows, key=lambda r: r["label"]):
            n = r["s"]["count"]
            variance = r["s"]["variance"].toArray() * ((n - 1) / n) + extra
            classes.append((float(r["label"]), n / total, r["s"]["mean"].toArray().tolist(), variance.tolist()))
        return GaussianBayesModel(classes)


class GaussianBayesModel(Model):
    def __init__(self, classes: Sequence[tuple]):
        super().__init__()
        self.classes = list(classes)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Prediction and probabilities in the order of `classes`, from log densities less their maximum; ties to the smaller class."""
        names = np.array([c for c, *_ in self.classes])
        constants = [math.log(p) - 0.5 * sum(math.log(2 * math.pi * v) for v in variances) for _, p, _, variances in self.classes]
        means, weights = np.array([m for *_, m, _ in self.classes]), np.array([[0.5 / v for v in variances] for *_, variances in self.classes])

        @F.arrow_udf("struct<prediction:double,probability:array<double>>")
        def judge(x: pa.Array) -> pa.Array:
            held = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
            rows = x.take(pa.array(held)).flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)
            total = np.zeros((len(names), len(held)))
            for i in range(means.shape[1]):  # one dimension after the other, as a sum per row would go
                total += (rows[:, i] - means[:, i, None]) ** 2 * weights[:, i, None]
            scores = np.array(constants)[:, None] - total
            mass = np.exp(scores - scores.max(axis=0))
            shares = np.zeros((len(x), len(names)))
            shares[held] = (mass / mass.cumsum(axis=0)[-1]).T
            said = np.zeros(len(x))
            said[held] = names[scores.argmax(axis=0)]
            empty = pa.array(~x.is_valid().to_numpy(zero_copy_only=False))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(names)), pa.array(shares.reshape(-1)))
            return pa.StructArray.from_arrays([pa.array(said, mask=empty.to_numpy(zero_copy_only=False)), lists], ["prediction", "probability"], mask=empty)

        return dataset.withColumn("__judged", judge(vector_to_array("features"))).withColumns(
            {"prediction": F.col("__judged.prediction"), "probability": F.col("__judged.probability")}).drop("__judged")


class Neighbours(Estimator):
    """k nearest neighbours; rows are told apart by the column `key`."""

    def __init__(self, key: str, k: int = 5, weights: str = "uniform", metric: str = "euclidean"):
        super().__init__()
        self.key, self.k, self.weights, self.metric = key, k, weights, metric

    def _fit(self, dataset: DataFrame) -> "NeighboursModel":
        return NeighboursModel(self, dataset.select(self.key, "label", vector_to_array("features").alias("features")))


class NeighboursModel(Model):
    def __init__(self, spec: Neighbours, points: DataFrame):
        super().__init__()
        self.spec, self.points = spec, points

    def _transform(self, dataset: DataFrame) -> DataFrame:
        s = self.spec
        queries = dataset.select(s.key, vector_to_array("features").alias("features"))
        found = knn_classify(queries, self.points, s.key, "features", "label", s.k, s.weights, s.metric)
        return dataset.join(found, s.key)


def class_scores(model: Model, df: DataFrame, key: str) -> DataFrame:
    """``(key, label, class, score)``: how strongly a fitted model holds each row to be of each class. Probabilities of Bayes, trees,
    forests, regression and the perceptron; shares of the votes of neighbours; margins of one-vs-rest."""
    if isinstance(model, NeighboursModel):
        s = model.spec
        queries = df.select(s.key, vector_to_array("features").alias("features"))
        near = nearest_neighbours(queries, model.points, s.key, s.key, "features", s.k, s.metric, carry=["label"])
        shares = vote_shares(near, s.key, "label", s.k, s.weights).withColumnRenamed("label", "class")
        classes = model.points.select(F.col("label").alias("class")).distinct()
        # every class of a row, also those without a vote: a row per class is broadcast
        every = df.select(key, "label").join(F.broadcast(classes), F.lit(True))
        return every.join(shares, [key, "class"], "left").select(key, "label", "class", F.coalesce("share", F.lit(0.0)).alias("score"))
    found = model.transform(df)
    if isinstance(model, GaussianBayesModel):
        labels, column = [c for c, *_ in model.classes], F.col("probability")
    else:
        column = vector_to_array("rawPrediction" if isinstance(model, OneVsRestModel) else "probability")
        labels = [float(i) for i in range(model.numClasses if hasattr(model, "numClasses") else len(model.models))]
    pairs = F.inline(F.arrays_zip(F.array(*[F.lit(c) for c in labels]).alias("class"), column.alias("score")))
    return found.select(key, "label", pairs).toDF(key, "label", "class", "score")


def make_model(
    name: str, params: Mapping | None = None, *, rows: int | None = None, width: int | None = None,
    classes: int | None = None, key: str | None = None,
) -> Estimator:
    """An estimator by name. `C` needs `rows` (regularisation is 1 / (C rows)),
    hidden layers need `width` and `classes`, neighbours need `key`."""
    p = dict(params or {})
    columns = {"featuresCol": "features", "labelCol": "label"}
    if name in ("random_forest", "decision_tree") and p.get("maxDepth", 30) > SHALLOW:
        return DeepForest(**({"numTrees": 100} if name == "random_forest" else {}) | p, seed=SEED)
    if name == "random_forest":
        return RandomForestClassifier(seed=SEED, **{"numTrees": 100, **DEEP, **p}, **columns)
    if name == "decision_tree":
        return DecisionTreeClassifier(seed=SEED, **{**DEEP, **p}, **columns)
    if name == "logistic_regression":
        strength, penalty = p.pop("C", 1.0), p.pop("penalty", "l2")
        return LogisticRegression(
            regParam=1.0 / (strength * rows), elasticNetParam=1.0 if penalty == "l1" else 0.0,
            **{"maxIter": 1000, **p}, **columns,
        )
    if name == "linear_svm":
        strength = p.pop("C", 1.0)
        return OneVsRest(classifier=LinearSVC(regParam=1.0 / (strength * rows), **{"maxIter": 100, **p}), **columns)
    if name == "mlp":
        hidden = list(p.pop("hidden", (100,)))
        return MultilayerPerceptronClassifier(layers=[width, *hidden, classes], seed=SEED, **{"maxIter": 1000, **p}, **columns)
    if name == "gaussian_nb":
        return GaussianBayes(**p)
    if name == "knn":
        return Neighbours(key, **p)
    raise ValueError(f"no model {name!r}")


def context(df: DataFrame, key: str) -> dict:
    """What `make_model` must know about a training table: one aggregate, with a
    row per class."""
    checkpoints(df.sparkSession)  # for the node ids of trees
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    return {
        "rows": sum(r["n"] for r in counts), "classes": int(max(r["label"] for r in counts)) + 1,
        "width": len(feature_names(df)) or _width(df), "key": key,
    }


def _width(df: DataFrame) -> int:
    return len(df.select("features").first()[0])


def grid(params: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(params, values)) for values in itertools.product(*params.values())]


def grid_search(
    df: DataFrame, name: str, params: Mapping[str, Sequence], fold_col: str, folds: int, key: str, parallelism: int = 4,
) -> tuple[DataFrame, Model, dict]:
    """All settings by k-fold accuracy: the table ``(params, accuracy)``, the best
    model refitted on all rows, and its settings. Ties keep the earlier setting.

    Folds are plain filters on a staged table; Spark's own cross-validator would
    check the fold column by a Python function on every row."""
    settings = grid(params)
    known = context(df, key)
    parts = [(df.where(F.col(fold_col) != i), df.where(F.col(fold_col) == i)) for i in range(folds)]

    def run(job: tuple[int, int]) -> float:
        setting, fold = job
        train, test = parts[fold]
        return accuracy(make_model(name, settings[setting], **known).fit(train).transform(test)) or 0.0

    jobs = [(s, f) for s in range(len(settings)) for f in range(folds)]
    with ThreadPoolExecutor(parallelism) as pool:
        found = list(pool.map(inheritable_thread_target(df.sparkSession)(run), jobs))
    scores = [sum(a for (s, _), a in zip(jobs, found) if s == i) / folds for i in range(len(settings))]
    best = max(range(len(settings)), key=lambda i: (scores[i], -i))
    table = df.sparkSession.createDataFrame(
        [(i, json.dumps(s), float(a)) for i, (s, a) in enumerate(zip(settings, scores))], "setting int, params string, accuracy double"
    )
    return table, make_model(name, settings[best], **known).fit(df), settings[best]


def bake_off(
    train: DataFrame, test: DataFrame, models: Mapping[str, Mapping], key: str, parallelism: int = 3,
) -> tuple[DataFrame, dict]:
    """Fit every model, score it on `test`: ``(model, accuracy)`` best first, and
    the fitted models. Fits run side by side; Spark shares its slots among them."""
    known = context(train, key)
    spark = train.sparkSession

    def run(name: str) -> tuple[str, float, Model]:
        model = make_model(name, models[name], **known).fit(train)
        return name, accuracy(model.transform(test)), model

    with ThreadPoolExecutor(parallelism) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(run), models))
    board = spark.createDataFrame([(n, float(a)) for n, a, _ in done], "model string, accuracy double")
    return board.orderBy(F.desc("accuracy"), "model"), {n: m for n, _, m in done}


def has_importances(model: Model) -> bool:
    """Whether `feature_importance` can explain the model: trees and linear models, not
    neighbours, Bayes or perceptrons."""
    if isinstance(model, PipelineModel):
        model = model.stages[-1]
    return isinstance(model, OneVsRestModel) or hasattr(model, "featureImportances") or hasattr(model, "coefficientMatrix")


def feature_importance(model: Model, names: Sequence[str], spark, k: int | None = None) -> DataFrame:
    """``(feature, importance)``, highest first: tree importances, or mean absolute
    coefficients of linear models. As many rows as features."""
    if isinstance(model, PipelineModel):
        model = model.stages[-1]
    if isinstance(model, OneVsRestModel):
        parts = [m.coefficients.toArray() for m in model.models]
        values = [sum(abs(p[i]) for p in parts) / len(parts) for i in range(len(parts[0]))]
    elif hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray().tolist()
    elif hasattr(model, "coefficientMatrix"):
        values = abs(model.coefficientMatrix.toArray()).mean(axis=0).tolist()
    else:
        raise ValueError(f"{type(model).__name__} has no importances")
    rows = spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")
    rows = rows.orderBy(F.desc("importance"), "feature")
    return rows.limit(k) if k else rows


def fold_scores(df: DataFrame, name: str, params: Mapping, fold_col: str, folds: int, key: str) -> DataFrame:
    """Accuracy per expanding window: fold i trains on all rows of earlier folds."""
    rows = []
    for fold in range(1, folds + 1):
        train, test = df.where(F.col(fold_col) < fold), df.where(F.col(fold_col) == fold)
        model = make_model(name, params, **context(train, key)).fit(train)
        rows.append((fold, accuracy(model.transform(test))))
    return df.sparkSession.createDataFrame(rows, "fold int, accuracy double")
