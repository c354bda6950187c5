"""Bins whose edges come from the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators.quantiles import quantiles


def with_scalars(df: DataFrame, one_row: DataFrame, name: str = "__s") -> DataFrame:
    """Attach a one-row result as a struct column, by scalar subquery (no join)."""
    return df.withColumn(name, one_row.select(F.struct(*one_row.columns).alias(name)).scalar())


def bin_quantile(df: DataFrame, column: str, labels: Sequence[str], name: str) -> DataFrame:
    """Equal-count bins, right-closed, the minimum included. Equal edges raise:
    the labels could not be told apart."""
    k = len(labels)
    probs = [i / k for i in range(k + 1)]
    edges = [f"e{i}" for i in range(k + 1)]
    out = with_scalars(df, quantiles(df, column, probs, names=edges), "__e")
    v = F.col(column)
    clash = F.lit(False)
    for low, high in zip(edges, edges[1:]):
        clash = clash | (F.col(f"__e.{low}") >= F.col(f"__e.{high}"))
    label = F.when(clash, F.raise_error(F.lit(f"equal quantile edges of {column}")).cast("string"))
    label = label.when(v.isNull(), F.lit(None))
    for edge, text in zip(edges[1:-1], labels):
        label = label.when(v <= F.col(f"__e.{edge}"), F.lit(text))
    return out.withColumn(name, label.otherwise(F.lit(labels[-1]))).drop("__e")


def bin_equal_width_counts(df: DataFrame, column: str, bins: int = 5) -> DataFrame:
    """``(bin, left, right, count)`` of right-closed equal-width bins, every bin
    listed. The first left edge lies 0.1% of the range below the minimum."""
    return _width_counts(df, column, bins, right_closed=True)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """``(bin, left, right, count)`` of left-closed bins, the last one closed."""
    return _width_counts(df, column, bins, right_closed=False)


def _width_counts(df: DataFrame, column: str, bins: int, right_closed: bool) -> DataFrame:
    v = F.col(column).cast("double")
    edges = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    rows = with_scalars(df.where(v.isNotNull()).select(v.alias("__v")), edges, "__e")
    width = (F.col("__e.hi") - F.col("__e.lo")) / bins
    raw = F.try_divide(F.col("__v") - F.col("__e.lo"), width)
    index = F.ceil(raw) - 1 if right_closed else F.floor(raw)
    index = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(index, F.lit(0)))).cast("int")
    counts = rows.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # the bin list is fixed by `bins`, not by the data
    listed = with_scalars(df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")), edges, "__e")
    width = (F.col("__e.hi") - F.col("__e.lo")) / bins
    left = F.col("__e.lo") + F.col("bin") * width
    right = F.col("__e.lo") + (F.col("bin") + 1) * width
    if right_closed:
        left = F.when(F.col("bin") == 0, F.col("__e.lo") - (F.col("__e.hi") - F.col("__e.lo")) * 0.001).otherwise(left)
    return (
        listed.join(counts, "bin", "left")
        .select("bin", left.alias("left"), right.alias("right"), F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))
    )
