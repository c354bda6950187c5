"""Projection, filter, recode and repair of columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.functions.columns import in_range, null_outside, scale, title_case
from wayfarer.operators.quantiles import medians, mode_of, modes
from wayfarer.session import stage


def present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """Those of `columns` the table has, in the given order."""
    have = set(df.columns)
    return [c for c in columns if c in have]


def select_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.select(*present(df, columns))


def columns_by_type(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, text) column names by schema."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return numeric, text


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def keep_original(df: DataFrame, columns: Iterable[str], suffix: str = "_Original") -> DataFrame:
    return df.withColumns({c + suffix: F.col(c) for c in present(df, columns)})


def filter_eq(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value)


def filter_in_and(df: DataFrame, members: Mapping[str, Sequence], equals: Mapping[str, object]) -> DataFrame:
    test: Column = F.lit(True)
    for c, values in members.items():
        test = test & F.col(c).isin(*values)
    for c, value in equals.items():
        test = test & (F.col(c) == value)
    return df.where(test)


def filter_ne_notnull(df: DataFrame, column: str, value) -> DataFrame:
    return df.where((F.col(column) != value) & F.col(column).isNotNull())


def out_of_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows whose value lies outside ``[low, high]`` (nulls are not outside)."""
    return df.where(F.col(column).isNotNull() & ~in_range(column, low, high))


def recode_columns(df: DataFrame, scales: Mapping[str, Mapping]) -> DataFrame:
    """Replace text by numbers, one scale per column; absent columns are skipped."""
    return df.withColumns({c: scale(c, scales[c]) for c in present(df, scales)})


def replace_values(df: DataFrame, spellings: Mapping[str, Mapping[str, str]]) -> DataFrame:
    for c in present(df, spellings):
        df = df.replace(dict(spellings[c]), subset=[c])
    return df


def null_if_out_of_range(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: null_outside(c, *ranges[c]) for c in present(df, ranges)})


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    kept = {c: values[c] for c in present(df, values)}
    return df.fillna(kept) if kept else df


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls to the exact median (interpolated), read as one scalar subquery."""
    table = medians(df, columns).agg(*[
        F.max(F.when(F.col("column") == c, F.col("median"))).alias(c) for c in columns
    ])
    return _fill_from(df, table, columns)


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _fill_from(df, df.agg(*[F.avg(c).alias(c) for c in columns]), columns)


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls to the most frequent value, ties to the smallest. Text columns are
    counted together in one pass; others keep their own order of values."""
    text = [c for c in columns if dict(df.dtypes)[c] == "string"]
    out = df
    if text:
        table = modes(df, text).agg(*[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(c) for c in text])
        out = out.withColumn("__fill", table.select(F.struct(*text).alias("__fill")).scalar())
        out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"__fill.{c}")) for c in text}).drop("__fill")
    return out.withColumns({c: F.coalesce(F.col(c), mode_of(df, c).scalar()) for c in columns if c not in text})


def _fill_from(df: DataFrame, one_row: DataFrame, columns: Sequence[str]) -> DataFrame:
    fill = one_row.select(F.struct(*columns).alias("__fill")).scalar()
    out = df.withColumn("__fill", fill)
    return out.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.col(f"__fill.{c}")) for c in columns}
    ).drop("__fill")


def drop_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to number; what does not read as one becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def clean_names(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: title_case(c) for c in columns})


SENT_VALUES = 100_000  #: distinct values that may be broadcast


def rare_to_other(df: DataFrame, columns: Sequence[str], min_count: int, label: str) -> DataFrame:
    """Replace values seen fewer than `min_count` times over all `columns` together.

    Counts each distinct tuple once before the columns are stacked, so the
    stacked table is as small as the number of tuples. The frequent values are
    counted; up to `SENT_VALUES` of them are sent to every task, so rows with a hot value
    stay where they are, and beyond that they are joined by shuffle. Null counts as rare.
    """
    tuples = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    stacked = tuples.unpivot("__n", list(columns), "__col", "__value")
    frequent = (
        stacked.where(F.col("__value").isNotNull()).groupBy("__value").agg(F.sum("__n").alias("__n"))
        .where(F.col("__n") >= min_count).select("__value")
    )
    frequent = stage(frequent, "frequent")
    if frequent.count() <= SENT_VALUES:
        frequent = F.broadcast(frequent)
    out = df
    for c in columns:
        keep = frequent.select(F.col("__value").alias(f"__keep_{c}"))
        out = out.join(keep, out[c] == keep[f"__keep_{c}"], "left")
    return out.withColumns(
        {c: F.coalesce(F.col(f"__keep_{c}"), F.lit(label)) for c in columns}
    ).drop(*[f"__keep_{c}" for c in columns])


class TooManyValues(ValueError):
    """A column has more distinct values than the plan may turn into columns."""


def bounded_values(df: DataFrame, column: str, limit: int = 1000) -> list:
    """Sorted distinct non-null values, for plans that need one column or code
    per value. Runs a job; more than `limit` values raise instead of being cut."""
    rows = df.where(F.col(column).isNotNull()).select(column).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooManyValues(f"{column} has more than {limit} distinct values")
    return sorted(r[0] for r in rows)


def label_encode(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Classes to 0..k-1 in sorted order, null for null, any number of classes.

    The distinct values are sorted by range over all tasks and numbered by
    their place in the partition and the sizes of those before; the codes are joined back.
    """
    values = df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)
    # the number holds the partition in its upper bits and the place there in the lower 33
    numbered = stage(values.select(F.col(column).alias("__value"), F.monotonically_increasing_id().alias("__id")), "labels")
    part = F.shiftright("__id", 33)
    sizes = numbered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # a row per partition
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    codes = numbered.withColumn("__part", part).join(starts, "__part").select(
        "__value", (F.col("__before") + F.col("__id") - F.shiftleft("__part", 33)).cast("int").alias("__code"))
    return df.join(codes, df[column] == codes["__value"], "left").drop("__value").withColumn(name or column, F.col("__code")).drop("__code")


def one_hot(
    df: DataFrame, columns: Mapping[str, str] | Sequence[str], values: Mapping[str, Sequence] | None = None,
    limit: int = 1000,
) -> DataFrame:
    """0/1 columns ``<prefix>_<value>`` beside the row (no join). A null or
    unknown value gives zeros. `columns` maps column to prefix. More than `limit` values raise:
    `one_hot_vector` takes any number."""
    prefixes = columns if isinstance(columns, Mapping) else {c: c for c in columns}
    added = {}
    for c, prefix in prefixes.items():
        known = values[c] if values and c in values else bounded_values(df, c, limit)
        for v in known:
            added[f"{prefix}_{v}"] = F.when(F.col(c) == v, 1).otherwise(0)
    return df.withColumns(added)


def one_hot_vector(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """`name` (default ``<column>_vector``): a sparse 0/1 vector with a slot per distinct value, in sorted order; any number of
    values. A null gives zeros. The values are ranked by a distributed sort and joined back (`label_encode`)."""
    code = "__slot"
    values = df.select(F.count_distinct(column).alias("n")).first()["n"]
    coded = label_encode(df, column, code)
    # one more, last category for null, which the encoder drops; the size goes with the column, so no scan finds it out
    size = {"ml_attr": {"type": "nominal", "num_vals": values + 1}}
    coded = coded.withColumn(code, F.coalesce(F.col(code), F.lit(values)).cast("double")).withMetadata(code, size)
    if not values:
        return coded.drop(code).withColumn(name or f"{column}_vector", array_to_vector(F.array().cast("array<double>")))
    encoder = OneHotEncoder(inputCol=code, outputCol=name or f"{column}_vector", dropLast=True)
    return encoder.fit(coded).transform(coded).drop(code)
