"""Wide to long and stacked columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], key: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), key, value)


def stack_columns(df: DataFrame, columns: Sequence[str], name: str = "value") -> DataFrame:
    """Columns put under each other. One scan: each row yields one per column,
    where a union would read the table once per column."""
    return df.select(F.explode(F.array(*columns)).alias(name))
