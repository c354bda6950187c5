"""Group-by shapes: counts, shares, rates, pivots, extremes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.columns import flag
from wayfarer.operators.quantiles import column_quantiles, modes


def not_null(columns: Sequence[str]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).isNotNull()
    return test


def group_agg(df: DataFrame, keys: Sequence[str], **measures: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[m.alias(name) for name, m in measures.items()])


def value_counts(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """Count per value, most frequent first; nulls are not a value."""
    return (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))
        .orderBy(F.desc(name), column)
    )


def value_shares(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """Counts and percentages of all non-null values. The total is a scalar
    subquery over the counts, not a one-partition window."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    whole = counts.agg(F.sum("count").cast("double").alias("t")).scalar()
    return counts.withColumn("share", F.round(F.col("count") * 100.0 / whole, digits)).orderBy(F.desc("count"), column)


def group_value_shares(df: DataFrame, group: str, column: str, digits: int = 6) -> DataFrame:
    """Share (0..1) of each value within its group, long form."""
    counts = df.where(not_null([group, column])).groupBy(group, column).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(group))
    return counts.select(group, column, F.round(F.col("n").cast("double") / whole, digits).alias("share"))


def unstack(df: DataFrame, index: str, column: str, value: str, columns: Sequence) -> DataFrame:
    """Long to wide; `columns` lists the values that become columns."""
    return df.groupBy(index).pivot(column, list(columns)).agg(F.first(value))


def pivot_mean(df: DataFrame, index: str, column: str, value: str, columns: Sequence, digits: int = 6) -> DataFrame:
    """Mean matrix; rows with a null index or column are left out."""
    return (
        df.where(not_null([index, column])).groupBy(index).pivot(column, list(columns))
        .agg(F.round(F.avg(value), digits))
    )


def crosstab_row_pct(df: DataFrame, index: str, column: str, columns: Sequence, digits: int = 6) -> DataFrame:
    """Cross-tabulated counts as percentages of each row's total."""
    wide = (
        df.where(not_null([index, column]))
        .groupBy(index).pivot(column, list(columns)).agg(F.count(F.lit(1)))
    )
    whole = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in columns), F.lit(0))
    return wide.select(index, *[
        F.round(F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("double") * 100.0 / whole, digits).alias(str(c)) for c in columns
    ])


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(not_null([a, b])).groupBy(a, b).agg(F.count(F.lit(1)).alias("count"))


def rollup(df: DataFrame, keys: Sequence[str], **measures: Column) -> DataFrame:
    """Subtotals with ``level`` (grouping id): 0 for leaves, so that a subtotal
    differs from a null key."""
    return df.rollup(*keys).agg(
        *[m.alias(name) for name, m in measures.items()], F.grouping_id().cast("bigint").alias("level")
    )


def group_means(df: DataFrame, key: str, columns: Sequence[str], digits: int = 6) -> DataFrame:
    return (
        df.where(F.col(key).isNotNull()).groupBy(key)
        .agg(*[F.round(F.avg(c), digits).alias(c) for c in columns])
    )


def group_rate(df: DataFrame, key: str, column: str, yes: str = "Yes", digits: int = 6) -> DataFrame:
    return (
        df.where(F.col(key).isNotNull()).groupBy(key)
        .agg(F.round(F.avg(flag(column, yes)) * 100, digits).alias("rate"))
    )


def flag_mean(df: DataFrame, column: str, yes: str = "Yes", digits: int = 6) -> DataFrame:
    return df.agg(F.round(F.avg(flag(column, yes)) * 100, digits).alias("rate"))


def group_mode(df: DataFrame, key: str, columns: Sequence[str], missing: str = "Unknown") -> DataFrame:
    """Most common value of text columns per group, wide; `missing` where a
    group has no value."""
    keyed = df.where(F.col(key).isNotNull())
    found = modes(keyed, columns, [key]).groupBy(key).agg(
        *[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(c) for c in columns]
    )
    groups = keyed.select(key).distinct()
    return groups.join(found, key, "left").select(key, *[F.coalesce(c, F.lit(missing)).alias(c) for c in columns])


def distinct_groups(df: DataFrame, *columns: str, name: str = "groups") -> DataFrame:
    """Number of distinct tuples without nulls."""
    return df.agg(F.count_distinct(*columns).alias(name))


def column_means_ranked(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    means = df.agg(*[F.round(F.avg(c), digits).alias(c) for c in columns])
    return means.unpivot([], list(columns), "column", "mean").orderBy(F.desc("mean"), "column")


def arg_extremes(df: DataFrame, key: str, value: str) -> DataFrame:
    """Key of the highest and of the lowest group mean; ties go to the smallest key."""
    means = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias("m")).where(F.col("m").isNotNull())
    return means.agg(
        F.min_by(key, F.struct(-F.col("m"), F.col(key))).alias("highest"),
        F.min_by(key, F.struct(F.col("m"), F.col(key))).alias("lowest"),
    )


def difference_of_means(df: DataFrame, key: str, a, b, value: str, digits: int = 6) -> DataFrame:
    return df.agg(
        F.round(F.avg(F.when(F.col(key) == a, F.col(value))) - F.avg(F.when(F.col(key) == b, F.col(value))), digits)
        .alias("difference")
    )


def scalar_stats(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """One row: mean, exact median, min, max."""
    v = F.col(column).cast("double")
    median = column_quantiles(df, [column], [0.5], ["median"]).select("median").scalar()
    return df.agg(
        F.round(F.avg(v), digits).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")
    ).withColumn("median", F.round(median, digits))


def kpi_row(df: DataFrame, **measures: Column) -> DataFrame:
    return df.agg(*[m.alias(name) for name, m in measures.items()])


def conditional_counts(df: DataFrame, keys: Sequence[str], tests: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(test).alias(name) for name, test in tests.items()])
