"""What the operators of this subpackage share: reading, shipping code, bounded Arrow batches."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from wayfarer.session import ship, stage, staged_path, staging_dir

__all__ = ["prepare", "read", "shared_path", "stage"]


def prepare(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Send this package to the workers, and keep Arrow batches to `rows` rows
    where the session leaves Spark's default of 10,000 (texts may be long)."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name in the staging folder, as a path that workers can open; `session.drop_staged` removes it. Memory
    maps need one: a shared folder behind a scheme other than ``file`` raises."""
    scheme = urlparse(staging_dir(spark)).scheme
    if scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted folder in spark.checkpoint.dir, not {scheme}://")
    return urlparse(staged_path(spark, label)).path
