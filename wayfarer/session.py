"""Session defaults and the shared staging folder."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wayfarer", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution; `conf` keys use `_` for `.`-free names
    or may be passed as a dict under ``extra``."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in (conf.pop("extra", None) or {}).items():
        builder = builder.config(key, str(value))
    return ship(builder.getOrCreate())


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers, once per application: functions that run there are imported by name,
    and a worker need not start where the package lies."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="ship-"), "wayfarer.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(root)))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark


_STAGED: list[str] = []


def staging_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the
    session. Where none is named a local master gets a folder of this machine,
    removed when the process ends; any other master raises, because its
    executors would not see such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    folder = tempfile.mkdtemp(prefix="wayfarer-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def drop_staged(spark: SparkSession) -> int:
    """Remove all tables this process has staged; returns how many. For the end
    of a run: frames that still read a staged table fail afterwards."""
    done = 0
    while _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        done += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return done


def staged_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that `drop_staged` removes."""
    path = os.path.join(staging_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _STAGED.append(path)
    return path


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write `df` once as parquet in the shared folder and read it back.

    Cuts lineage for loops (level-wise mining, model sweeps); `drop_staged`
    removes the tables. Unlike a cache or
    a local checkpoint the table outlives lost executors, and unlike
    ``checkpoint()`` the plan behind it runs once, and the result stays
    columnar, so later steps still prune columns.
    """
    spark = df.sparkSession
    path = staged_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of frames nobody refers to any more, as those behind a staged table: it does so
    after the driver collected its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def shared_files(df: DataFrame) -> list[str]:
    """The files of a staged table, for tasks that read them by `shared_file`."""
    return sorted(df.inputFiles())


def shared_file(uri: str) -> tuple[pafs.FileSystem, str]:
    """How a task opens a file of the shared folder: one of the file systems of Arrow and the path on it."""
    return pafs.FileSystem.from_uri(uri)


def spread(df: DataFrame, *keys: str, rows: int = 20_000) -> DataFrame:
    """`df` dealt by `keys` over every core at least, and over more tasks where they would hold over `rows` rows:
    for tables that many passes follow, which small files would otherwise leave to one core."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)


def checkpoints(spark: SparkSession) -> SparkSession:
    """See that Spark's own checkpoints have a folder: the shared one."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(staging_dir(spark))
    return spark


def shuffle_width(spark: SparkSession, floor: int = 16) -> int:
    """How many ordered buckets a distributed sort or rank should use at least."""
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions")))
