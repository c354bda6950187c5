"""Data-quality checks. Each returns ``(check, column, violations)`` and all of
them together read the table once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.functions.columns import in_range
from wayfarer.operators.clean import present


def _null_tests(df: DataFrame, columns: Sequence[str]) -> dict:
    return {("nulls", c): F.col(c).isNull() for c in present(df, columns)}


def _range_tests(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> dict:
    return {
        ("range", c): F.col(c).isNotNull() & ~in_range(c, *ranges[c]) for c in present(df, ranges)
    }


def _domain_tests(df: DataFrame, domains: Mapping[str, Sequence]) -> dict:
    return {
        ("domain", c): F.coalesce(~F.col(c).isin(*domains[c]), F.lit(True)) for c in present(df, domains)
    }


def _type_tests(df: DataFrame, part: str) -> dict:
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    return {("type", c): F.lit(c not in numeric) for c in df.columns if part in c}


def _report(df: DataFrame, tests: Mapping[tuple[str, str], Column]) -> DataFrame:
    """One aggregate of all tests, one output row per test."""
    if not tests:
        return df.sparkSession.createDataFrame([], "check string, column string, violations bigint")
    names = list(tests)
    row = df.agg(*[
        (F.max(tests[n].cast("bigint")) if n[0] == "type" else F.count_if(tests[n])).alias(f"t{i}")
        for i, n in enumerate(names)
    ])
    entries = F.array(*[
        F.struct(F.lit(check).alias("check"), F.lit(column).alias("column"),
                 F.coalesce(F.col(f"t{i}"), F.lit(0)).cast("bigint").alias("violations"))
        for i, (check, column) in enumerate(names)
    ])
    return row.select(F.inline(entries))


def check_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _report(df, _null_tests(df, columns or df.columns))


def check_types(df: DataFrame, part: str = "Delay") -> DataFrame:
    """1 for each column whose name holds `part` and whose type is not numeric."""
    return _report(df, _type_tests(df, part))


def check_range(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    return _report(df, _range_tests(df, ranges))


def check_domain(df: DataFrame, domains: Mapping[str, Sequence]) -> DataFrame:
    """Values outside the domain; a null is a violation."""
    return _report(df, _domain_tests(df, domains))


def validate(
    df: DataFrame, ranges: Mapping[str, tuple[float, float]], domains: Mapping[str, Sequence], part: str = "Delay",
) -> DataFrame:
    """All four checks in one pass."""
    return _report(df, {
        **_null_tests(df, df.columns), **_type_tests(df, part), **_range_tests(df, ranges), **_domain_tests(df, domains),
    })
