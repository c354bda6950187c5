"""Feature preparation: scaling, selection, encoding pipelines, projection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators.bins import with_scalars
from wayfarer.operators.quantiles import medians, modes


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores by the population deviation; a constant column gives 0."""
    stats = df.agg(*[e for c in columns for e in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))])
    out = with_scalars(df, stats, "__z")
    scaled = {}
    for c in columns:
        mean, std = F.col(f"__z.{c}__m"), F.col(f"__z.{c}__s")
        scaled[c] = (F.col(c) - mean) / F.when(std == 0, 1.0).otherwise(std)
    return out.withColumns(scaled).drop("__z")


def variance_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, variance, kept)``; kept means the variance is not 0."""
    row = df.agg(*[F.var_pop(c).alias(c) for c in columns])
    return row.unpivot([], list(columns), "feature", "variance").withColumn("kept", F.col("variance") > 0)


def variance_filter(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Names of the columns that vary (runs one aggregate)."""
    keep = {r["feature"] for r in variance_table(df, columns).where("kept").collect()}
    return [c for c in columns if c in keep]


def anova_scores(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """``(feature, f_score)``: between-class over within-class variance."""
    per_class = df.where(F.col(label).isNotNull()).groupBy(label).agg(*[
        F.struct(F.count(c).cast("double").alias("n"), F.avg(c).alias("m"), F.var_pop(c).alias("v")).alias(c) for c in columns
    ])
    # one row per class and feature
    long = per_class.unpivot([label], list(columns), "feature", "s").select("feature", "s.n", "s.m", "s.v").where("n > 0")
    parts = long.groupBy("feature").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("m")).alias("nm"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.collect_list(F.struct("n", "m")).alias("groups"),
    )
    grand = F.col("nm") / F.col("n")
    between = F.aggregate("groups", F.lit(0.0), lambda s, g: s + g["n"] * (g["m"] - grand) * (g["m"] - grand))
    f = F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return parts.select("feature", f.alias("f_score"))


def anova_top_k(df: DataFrame, columns: Sequence[str], label: str, k: int = 15) -> DataFrame:
    return anova_scores(df, columns, label).orderBy(F.desc_nulls_last("f_score"), "feature").limit(min(k, len(columns)))


def fit_feature_pipeline(
    df: DataFrame, numeric: Sequence[str], text: Sequence[str], impute: str = "median", output: str = "features",
) -> PipelineModel:
    """Impute and scale numbers, impute and one-hot text, assemble a vector.

    Fill values and moments are one row of statistics, written into the pipeline
    as constants. Text seen only later becomes the all-zero row. Numbers are
    filled with the exact median or the mean and scaled by the population
    deviation of the filled column.
    """
    fills: dict[str, float] = {}
    if numeric:
        if impute == "median":
            fills = {r["column"]: r["median"] for r in medians(df, numeric).collect()}
        else:
            fills = df.agg(*[F.avg(c).alias(c) for c in numeric]).first().asDict()
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(fills.get(c))) for c in numeric]
        moments = df.agg(*[e for i, x in enumerate(filled) for e in (F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"))]).first()
    common = {r["column"]: r["mode"] for r in modes(df, text).collect()} if text else {}
    fields = []
    for i, c in enumerate(numeric):
        mean, std = moments[f"m{i}"], moments[f"s{i}"] or 1.0
        fields.append(f"(coalesce(CAST(`{c}` AS DOUBLE), {float(fills.get(c) or 0.0)!r}D) - {float(mean or 0.0)!r}D) / {float(std)!r}D AS `{c}__n`")
    for c in text:
        fill = str(common.get(c, "Unknown")).replace("\\", "\\\\").replace("'", "\\'")
        fields.append(f"coalesce(CAST(`{c}` AS STRING), '{fill}') AS `{c}__t`")
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(fields)} FROM __THIS__")]
    if text:
        stages.append(StringIndexer(
            inputCols=[f"{c}__t" for c in text], outputCols=[f"{c}__i" for c in text], handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ))
        stages.append(OneHotEncoder(inputCols=[f"{c}__i" for c in text], outputCols=[f"{c}__o" for c in text], dropLast=True))
    stages.append(VectorAssembler(
        inputCols=[f"{c}__n" for c in numeric] + [f"{c}__o" for c in text], outputCol=output, handleInvalid="error"
    ))
    return Pipeline(stages=stages).fit(df)


def encode(model: PipelineModel, df: DataFrame, output: str = "features") -> DataFrame:
    """Apply the pipeline and drop its helper columns."""
    return model.transform(df).select(*df.columns, output)


def feature_names(df: DataFrame, column: str = "features") -> list[str]:
    """Names of the vector's slots, e.g. ``Age`` or ``Class_Economy``."""
    attributes = df.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    slots = sorted((a["idx"], a["name"]) for kind in attributes.values() for a in kind)
    return [_slot(name) for _, name in slots]


def _slot(name: str) -> str:
    for mark, glue in (("__n", ""), ("__o_", "_")):
        if mark in name:
            head, _, tail = name.partition(mark)
            return f"{head}{glue}{tail}"
    return name


def pca(df: DataFrame, features: str, components: int = 2) -> tuple[DataFrame, list[float], np.ndarray]:
    """Centred scores ``pc`` (array), explained variance ratios, loadings.

    `features` is an array or vector column. The Gram matrix is summed on the
    executors; its size is the number of features squared. Each component is
    signed so that its largest loading is positive.
    """
    is_array = df.schema[features].dataType.typeName() == "array"
    vectors = df.withColumn("__v", array_to_vector(F.col(features).cast("array<double>")) if is_array else F.col(features))
    scaler = StandardScaler(inputCol="__v", outputCol="__x", withMean=True, withStd=False).fit(vectors)
    centred = scaler.transform(vectors)
    model = PCA(k=components, inputCol="__x", outputCol="__p").fit(centred)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(components)])
    signs[signs == 0] = 1
    scores = model.transform(centred).withColumn("pc", vector_to_array("__p"))
    scores = scores.withColumn("pc", F.zip_with("pc", F.array(*[F.lit(float(s)) for s in signs]), lambda a, b: a * b))
    return scores.drop("__v", "__x", "__p"), [float(v) for v in model.explainedVariance], loadings * signs
