"""Table profiles: schema, nulls, distinct values, numeric and text summaries.

Profiles of many columns turn each row into ``(column, value)`` pairs once and
fold them, so a table is scanned once whatever its width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators.quantiles import column_quantiles, modes


def describe_numeric(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """``(column, count, mean, std, min, q25, q50, q75, max)``, exact quartiles."""
    moments = df.agg(*[
        F.struct(
            F.count(v).alias("count"), F.round(F.avg(v), digits).alias("mean"), F.round(F.stddev_samp(v), digits).alias("std"),
            F.min(v).alias("min"), F.max(v).alias("max"),
        ).alias(c) for c, v in ((c, F.col(c).cast("double")) for c in columns)
    ]).unpivot([], list(columns), "column", "m").select("column", "m.*")
    cuts = column_quantiles(df, columns, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    # one row per column on both sides
    return moments.join(cuts, "column", "left").select(
        "column", "count", "mean", "std", "min",
        *[F.round(q, digits).alias(q) for q in ("q25", "q50", "q75")], "max",
    )


def describe_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, count, unique, top, freq)``; ties of `top` go to the smallest."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).unpivot([], list(columns), "column", "count")
    found = modes(df, columns)
    return counts.join(found, "column", "left").select(
        "column", "count", F.coalesce("distinct", F.lit(0)).alias("unique"), F.col("mode").alias("top"), "freq"
    )


def describe_all(df: DataFrame, numeric: Sequence[str], text: Sequence[str], digits: int = 6) -> DataFrame:
    return describe_numeric(df, numeric, digits).unionByName(describe_text(df, text), allowMissingColumns=True)


def null_profile(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """``(column, nulls, percent)``, most nulls first, in one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    ).unpivot("__rows", columns, "column", "nulls")
    return counts.select(
        "column", "nulls", F.round(F.try_divide(F.col("nulls") * 100.0, F.col("__rows")).cast("double"), digits).alias("percent")
    ).orderBy(F.desc("nulls"), "column")


def null_pattern(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Which columns are missing together: one bit per column, and its count."""
    bits = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return df.groupBy(bits.alias("pattern")).agg(F.count(F.lit(1)).alias("count"))


def distinct_profile(df: DataFrame, columns: Sequence[str], list_below: int = 10) -> DataFrame:
    """``(column, distinct, values)``; values are listed only below `list_below`.

    Distinct pairs are formed by a group-by. The list keeps at most `list_below`
    values per column because later ones are dropped before collecting."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    pairs = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    small = sizes.where(F.col("distinct") < list_below).select("column")
    lists = pairs.join(small, "column").groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("values"))
    return sizes.join(lists, "column", "left").select(
        "column", "distinct", F.array_join("values", ",").alias("values")
    )


def schema_profile(df: DataFrame) -> DataFrame:
    """``(column, type, rows, columns)`` from the schema and one count."""
    spark = df.sparkSession
    fields = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    listed = spark.createDataFrame(fields, "position int, column string, type string")
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return listed.select(
        "position", "column", "type", rows.alias("rows"), F.lit(len(fields)).alias("columns")
    )
