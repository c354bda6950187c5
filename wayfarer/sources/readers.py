"""Reading flat files and warehouse tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Give a schema on big inputs: without one the types are
    inferred, which reads the files once more."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def read_parquet_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def jdbc_options(
    url: str, table: str | None = None, query: str | None = None, user: str | None = None,
    password_env: str = "WAREHOUSE_PASSWORD", partition_column: str | None = None,
    lower: int | None = None, upper: int | None = None, partitions: int = 64, fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a parallel JDBC read. The password comes from the environment.

    With `partition_column` and its bounds the database is read by `partitions`
    range scans; filters and column choices are pushed to it either way."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    options = {"url": url, "fetchsize": str(fetch_size)}
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partitioned read needs both bounds")
        # a query cannot be partitioned as such; Spark takes it as a derived table
        options["dbtable"] = table or f"({query}) warehouse_query"
        options |= {
            "partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    else:
        options["dbtable" if table else "query"] = table or query
    if user:
        options["user"] = user
    if os.environ.get(password_env):
        options["password"] = os.environ[password_env]
    return options


def read_jdbc_table(spark: SparkSession, url: str, **kwargs) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, **kwargs)).load()
