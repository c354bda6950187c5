"""Writing results, rules and labelled rows. Output stays as many part files as
the result has partitions; nothing passes through the driver."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def result_name(title: str) -> str:
    """``"1. Delay Analysis"`` -> ``"1._delay_analysis"``."""
    return title.lower().replace(" ", "_")


def write_csv_result(df: DataFrame, folder: str, title: str, mode: str = "overwrite") -> str:
    path = os.path.join(folder, result_name(title) + ".csv")
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_csv_results(results: dict[str, DataFrame], folder: str) -> dict[str, str]:
    return {title: write_csv_result(df, folder, title) for title, df in results.items()}


def join_arrays(df: DataFrame, separator: str = ", ") -> DataFrame:
    """Arrays as text, for formats without arrays."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return df.withColumns({c: F.concat_ws(separator, c) for c in arrays})


def write_rules(df: DataFrame, path: str, form: str = "csv", mode: str = "overwrite") -> str:
    """Itemsets or rules: as CSV with joined item lists, or as parquet arrays."""
    if form == "csv":
        join_arrays(df).write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).parquet(path)
    return path


def write_labeled(rows: DataFrame, labels: DataFrame, key: str, path: str, mode: str = "overwrite") -> str:
    """Source rows with their cluster label, joined by the row key."""
    rows.join(labels, key, "left").write.mode(mode).parquet(path)
    return path


def to_json_records(df: DataFrame, name: str = "record") -> DataFrame:
    """One JSON object per row; null fields are kept."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias(name))
