"""The model study: prepare a target, fit models, tune the best, explain it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer import vocabulary as vocab
from wayfarer.operators import folds as fold_search
from wayfarer.operators import models
from wayfarer.operators.clean import bounded_values
from wayfarer.operators.clusters import kmeans_sweep
from wayfarer.operators.evaluation import classification_report
from wayfarer.operators.features import encode, feature_names, fit_feature_pipeline
from wayfarer.operators.splits import smote, stratified_folds, stratified_split, time_series_folds
from wayfarer.session import release, spread, stage


@dataclass(frozen=True)
class Study:
    """Encoded train and test tables ``(key, label, features)`` of one target."""

    key: str
    train: DataFrame
    test: DataFrame
    names: list[str]
    classes: list
    pipeline: PipelineModel


def with_label(df: DataFrame, target: str) -> tuple[DataFrame, list]:
    """Rows with a target, its classes coded 0..k-1 in sorted order as ``label``."""
    classes = bounded_values(df, target)
    codes = F.array(*[F.lit(c) for c in classes])
    label = (F.array_position(codes, F.col(target)) - 1).cast("double")
    return df.where(F.col(target).isNotNull()).withColumn("label", label), classes


def prepare(
    df: DataFrame, key: str, target: str, numeric: Sequence[str], text: Sequence[str], train_share: float = 0.8, seed: int = 42,
) -> Study:
    """Split by class, fit the encoding on the training rows only, stage both."""
    labelled, classes = with_label(df, target)
    parts = stage(
        stratified_split(labelled, [key], "label", train_share, seed).select(key, "label", "is_train", *numeric, *text), "study"
    )
    pipeline = fit_feature_pipeline(parts.where("is_train"), numeric, text)
    encoded = encode(pipeline, parts).select(key, "label", "is_train", "features")
    rows = stage(spread(encoded, key), "encoded")
    release(df.sparkSession)
    return Study(
        key, rows.where("is_train").drop("is_train"), rows.where(~F.col("is_train")).drop("is_train"),
        feature_names(encoded), classes, pipeline,
    )


def report(study: Study, name: str, params: Mapping | None = None) -> DataFrame:
    """Fit one model and report its scores on the test rows."""
    model = models.make_model(name, params, **models.context(study.train, study.key)).fit(study.train)
    return classification_report(model.transform(study.test))


def oversampled_report(study: Study, name: str, params: Mapping | None = None, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Oversample the training rows so that all classes are as large as the largest, fit on them, report on the untouched test rows.
    Returns the report and the training rows with the synthetic ones marked.

    Neighbours are looked for among encoded vectors of one class; the test rows take no part in it."""
    dense = study.train.select(study.key, "label", vector_to_array("features").alias("features"))
    made = stage(spread(smote(dense, study.key, "label", "features", k), "label", "base"), "oversampled")
    release(made.sparkSession)
    train = made.withColumn("features", array_to_vector("features"))
    model = models.make_model(name, params, **models.context(train, study.key)).fit(train)
    return classification_report(model.transform(study.test)), made


def tune(study: Study, name: str, grid: Mapping[str, Sequence] | None = None, folds: int = 5, parallelism: int = 4, keep: int | None = None):
    """Grid search over stratified folds of the training rows: the table, the best model on all training rows, its settings.

    Bayes, neighbours, trees and forests share the work of their settings (`folds.search`); with `keep` every fold of those selects
    that many features on its training rows."""
    rows = stage(spread(stratified_folds(study.train, [study.key], "label", folds), study.key), "folds")
    if name in fold_search.SHARED:
        table, best = fold_search.search(rows, name, grid or vocab.TUNING_GRIDS[name], "fold", folds, study.key, keep)
        return table, models.make_model(name, best, **models.context(rows, study.key)).fit(rows), best
    return models.grid_search(rows, name, grid or vocab.TUNING_GRIDS[name], "fold", folds, study.key, parallelism)


def run(study: Study, settings: Mapping[str, Mapping], folds: int = 5) -> dict[str, DataFrame]:
    """Bake-off, tuning of the winner where it has a grid, and importances."""
    board, fitted = models.bake_off(study.train, study.test, settings, study.key)
    best = board.first()["model"]
    out = {"leaderboard": board}
    model = fitted[best]
    if best in vocab.TUNING_GRIDS:
        out["tuning"], model, _ = tune(study, best, folds=folds)
    out["report"] = classification_report(model.transform(study.test))
    if models.has_importances(model):
        out["importance"] = models.feature_importance(model, study.names, study.train.sparkSession)
    return out


def multi_output(
    df: DataFrame, key: str, targets: Sequence[str], numeric: Sequence[str], text: Sequence[str], name: str = "random_forest",
    params: Mapping | None = None,
) -> DataFrame:
    """One model per target on one shared feature table: ``(target, report…)``."""
    coded = df
    for t in targets:
        coded, _ = with_label(coded, t)
        coded = coded.withColumnRenamed("label", f"label_{t}")
    parts = stage(stratified_split(coded, [key], None), "multi")
    pipeline = fit_feature_pipeline(parts.where("is_train"), numeric, text)
    rows = stage(spread(encode(pipeline, parts).select(key, "is_train", "features", *[f"label_{t}" for t in targets]), key), "multi-encoded")
    out = None
    for t in targets:
        one = rows.withColumnRenamed(f"label_{t}", "label")
        train, test = one.where("is_train"), one.where(~F.col("is_train"))
        model = models.make_model(name, params, **models.context(train, key)).fit(train)
        scores = classification_report(model.transform(test)).select(F.lit(t).alias("target"), "*")
        out = scores if out is None else out.unionByName(scores)
    return out


def time_validation(
    df: DataFrame, key: str, target: str, numeric: Sequence[str], text: Sequence[str], folds: int = 5,
    name: str = "random_forest", params: Mapping | None = None,
) -> DataFrame:
    """``(fold, accuracy)`` of expanding windows in key order. The encoding is
    fitted on each fold's training rows."""
    labelled, _ = with_label(df, target)
    placed = stage(time_series_folds(labelled.select(key, "label", *numeric, *text), key, folds), "time")
    rows = []
    for fold in range(1, folds + 1):
        pipeline = fit_feature_pipeline(placed.where(F.col("test_fold") < fold), numeric, text)
        encoded = encode(pipeline, placed.where(F.col("test_fold") <= fold))
        train = stage(spread(encoded.where(F.col("test_fold") < fold).select(key, "label", "features"), key), "time-train")
        release(df.sparkSession)
        model = models.make_model(name, params, **models.context(train, key)).fit(train)
        rows.append((fold, models.accuracy(model.transform(encoded.where(F.col("test_fold") == fold)))))
    return df.sparkSession.createDataFrame(rows, "fold int, accuracy double")


def rank_feature_sets(
    df: DataFrame, key: str, sets: Mapping[str, tuple[Sequence[str], Sequence[str]]], ks: Sequence[int] = range(2, 11),
    restarts: int = 10, impute: str = "mean",
) -> DataFrame:
    """``(feature_set, k, silhouette)`` of each set's best k, best set first."""
    rows = []
    for name, (numeric, text) in sets.items():
        pipeline = fit_feature_pipeline(df, numeric, text, impute)
        encoded = stage(encode(pipeline, df).select(key, "features"), f"set-{name}")
        table, best, _ = kmeans_sweep(encoded, key, ks, restarts=restarts)
        rows.append((name, best, table.where(F.col("k") == best).first()["silhouette"]))
    return df.sparkSession.createDataFrame(rows, "feature_set string, k int, silhouette double").orderBy(
        F.desc("silhouette"), "feature_set"
    )
