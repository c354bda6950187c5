"""Scores of classifiers, as aggregates over (label, prediction) tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators.ordering import running_sum


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction", digits: int = 6) -> DataFrame:
    """``(name, precision, recall, f1, support)`` per class, then accuracy (in
    ``f1``), macro and weighted means. Empty denominators give 0. Everything
    after the confusion counts is one row per class."""
    types = dict(df.dtypes)
    if types[label] != types[prediction]:
        df = df.withColumns({label: F.col(label).cast("double"), prediction: F.col(prediction).cast("double")})
    counts = confusion_matrix(df, label, prediction)
    as_label = counts.select(
        F.col("label").cast("string").alias("name"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
        F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"),
    )
    as_prediction = counts.select(
        F.col("prediction").cast("string").alias("name"), F.lit(0).cast("bigint").alias("support"),
        F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hit"),
    )
    sums = as_label.unionByName(as_prediction).groupBy("name").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    hit, support, predicted = F.col("hit"), F.col("support"), F.col("predicted")
    per_class = sums.select(
        "name", ratio(hit, predicted).alias("precision"), ratio(hit, support).alias("recall"),
        ratio(2 * hit, support + predicted).alias("f1"), "support", "hit",
    )
    marks = ["precision", "recall", "f1"]
    means = per_class.agg(
        F.sum("support").alias("support"), F.sum("hit").alias("hit"), *[F.avg(m).alias(f"macro_{m}") for m in marks],
        *[F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in marks],
    )
    nothing = F.lit(None).cast("double")
    summary = means.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("name"), nothing.alias("precision"), nothing.alias("recall"),
                 ratio(hit, support).alias("f1"), F.col("support")),
        *[F.struct(F.lit(f"{kind} avg").alias("name"), *[F.col(f"{kind}_{m}").alias(m) for m in marks], F.col("support"))
          for kind in ("macro", "weighted")],
    )))
    return per_class.drop("hit").unionByName(summary).withColumns({m: F.round(m, digits) for m in marks})


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double"))).first()[0]


def _threshold_counts(df: DataFrame, label: str, score: str, positive) -> DataFrame:
    """Hits and misses at or above each distinct score. Scores are folded first,
    so a score shared by many rows is one row in the running sum."""
    is_positive = (F.col(label) == F.lit(positive)).cast("bigint")
    folded = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.sum(is_positive).alias("pos"), F.sum(1 - is_positive).alias("neg")
    )
    return running_sum(folded, "threshold", ["pos", "neg"], descending=True)


def roc_curve(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """``(threshold, fpr, tpr)`` at every distinct score, and the start (inf, 0, 0)."""
    points = _threshold_counts(df, label, score, positive).select(
        "threshold", F.try_divide(F.col("neg_cum").cast("double"), F.col("neg_total")).alias("fpr"),
        F.try_divide(F.col("pos_cum").cast("double"), F.col("pos_total")).alias("tpr"),
    )
    start = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return points.unionByName(start)


def roc_auc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """Trapezoid area. Each step's start is its end less its own counts, so no
    row needs its neighbour."""
    steps = _threshold_counts(df, label, score, positive)
    area = F.sum(F.col("neg").cast("double") * (F.col("pos_cum") - F.col("pos") / 2.0))
    return steps.agg(F.try_divide(area, F.max("pos_total").cast("double") * F.max("neg_total")).alias("auc"))


def pr_curve(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """``(threshold, precision, recall)`` at every distinct score, and the end (null, 1, 0)."""
    tp, fp = F.col("pos_cum").cast("double"), F.col("neg_cum").cast("double")
    points = _threshold_counts(df, label, score, positive).select(
        "threshold", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, F.col("pos_total")).alias("recall")
    )
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return points.unionByName(end)


def curves(scores: DataFrame, by: Sequence[str] = ("model", "class"), label: str = "label", positive: str = "class", score: str = "score") -> DataFrame:
    """Points of the one-against-rest ROC and PR curves of every group `by` (a model and a class, say): ``(by…, threshold,
    pos, neg, tp, fp, fpr, tpr, precision)`` at each distinct score. All groups share one fold and one running sum, so the
    number of models and classes adds rows but no shuffles. Rates without a denominator are null."""
    by = list(by)
    hit = (F.col(label) == F.col(positive)).cast("bigint")
    folded = scores.groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    steps = running_sum(folded, "threshold", ["pos", "neg"], by=by, descending=True)
    tp, fp = F.col("pos_cum").cast("double"), F.col("neg_cum").cast("double")
    return steps.select(
        *by, "threshold", "pos", "neg", F.col("pos_cum").alias("tp"), F.col("neg_cum").alias("fp"),
        F.try_divide(fp, F.col("neg_total")).alias("fpr"), F.try_divide(tp, F.col("pos_total")).alias("tpr"), F.try_divide(tp, tp + fp).alias("precision"))


def areas(points: DataFrame, by: Sequence[str] = ("model", "class")) -> DataFrame:
    """``(by…, auc, average_precision, points)`` of `curves`: trapezoids of the ROC curve, steps of the PR curve."""
    found = points.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"),
        F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.sum("pos").cast("double")).alias("average_precision"), F.count(F.lit(1)).alias("points"))
    return found
