"""Train/test splits, folds and oversampling, all by fixed hashes of row ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators.neighbours import nearest_neighbours
from wayfarer.operators.ordering import hash_order, position, shuffled_rank
from wayfarer.session import release, stage


def stratified_split(
    df: DataFrame, id_cols: Sequence[str], label: str | None, train_share: float = 0.8, seed: int = 42,
) -> DataFrame:
    """Add boolean ``is_train``: that share of every class (of all rows without
    `label`), rounded to whole rows."""
    ranked = shuffled_rank(df, id_cols, [label] if label else [], seed, "__r")
    return ranked.withColumn("is_train", F.col("__r") <= F.round(F.col("__r_of") * train_share)).drop("__r", "__r_of")


def stratified_folds(
    df: DataFrame, id_cols: Sequence[str], label: str, folds: int = 5, seed: int = 42, name: str = "fold",
) -> DataFrame:
    """Add ``fold`` 0..folds-1; each class is dealt out evenly."""
    ranked = shuffled_rank(df, id_cols, [label], seed, "__r")
    return ranked.withColumn(name, ((F.col("__r") - 1) % folds).cast("int")).drop("__r", "__r_of")


def time_fold_ranges(df: DataFrame, folds: int = 5) -> DataFrame:
    """``(fold, train_rows, test_from, test_to)`` of expanding windows: the last
    ``folds`` blocks of ``n // (folds + 1)`` rows are tested in turn."""
    rows = df.agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.floor(F.col("n") / (folds + 1)))
    out = rows.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    start = F.col("n") - (folds + 1 - F.col("fold")) * F.col("size")
    return out.select("fold", start.alias("train_rows"), start.alias("test_from"), (start + F.col("size")).alias("test_to"))


def time_series_folds(df: DataFrame, key: str, folds: int = 5) -> DataFrame:
    """Add ``position`` in key order and ``test_fold`` (0 for rows that only
    train). Fold i trains on all rows with a smaller ``test_fold``."""
    placed = position(df, key)
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    size = F.floor(n / (folds + 1))
    first = n - folds * size
    fold = F.when(F.col("position") < first, 0).otherwise(F.floor((F.col("position") - first) / size) + 1)
    return placed.withColumn("test_fold", fold.cast("int"))


def smote(
    df: DataFrame, key: str, label: str, features: str, k: int = 5, seed: int = 42, chunk: int = 10_000, **tuning,
) -> DataFrame:
    """Rows plus synthetic ones so that every class is as large as the largest.

    A synthetic row lies on the segment from a row to one of its `k` nearest
    rows of the same class. Which row, which neighbour and how far follow from
    hashes, so the result does not depend on partitioning. Give it training rows
    only. Output: ``(key, label, features, synthetic, base, neighbour)``; keys
    of synthetic rows are null. A class of one row is copied.

    Rows are multiplied in chunks, so one that must yield many copies is spread
    over tasks.
    """
    rows = stage(df.select(key, label, F.col(features).cast("array<double>").alias(features)).withColumn("__row", F.monotonically_increasing_id()), "smote")
    # one row per class
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    top = max(counts.values())
    need = F.lit(0).cast("bigint")
    for value, n in counts.items():
        need = F.when(F.col(label) == F.lit(value), F.lit(top - n).cast("bigint")).otherwise(need)
    minority = rows.where(need > 0)
    ranked = shuffled_rank(minority, [key], [label], seed, "__r").withColumn("__need", need)
    size = F.col("__r_of")
    copies = F.floor(F.col("__need") / size) + F.when(F.col("__r") <= F.col("__need") % size, 1).otherwise(0)
    base = ranked.withColumn("__copies", copies).where(F.col("__copies") > 0).select(key, label, features, "__copies")
    # neighbours go by number; only the one that a synthetic row picks is looked up
    near = nearest_neighbours(
        base, minority, key, key, features, k, within=label, carry=["__row"], exclude_self=True, **tuning
    )
    release(df.sparkSession)
    near = stage(near.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("place", F.col(f"neighbour_{key}").alias("id"), F.col("__row").alias("row")))).alias("__near")
    ), "near")
    release(df.sparkSession)
    chunks = base.join(near, key, "left").withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__copies") - 1) / chunk)))
    ).repartition(key, "__chunk")
    made = chunks.withColumn("__i", F.explode(F.sequence(
        F.col("__chunk") * chunk, F.least(F.col("__chunk") * chunk + chunk, F.col("__copies")) - 1
    )))
    pick = F.get("__near", F.pmod(hash_order(key, "__i", seed=seed + 1), F.size("__near").cast("bigint")).cast("int"))
    made = made.withColumn("__pick", F.when(F.size("__near") > 0, pick))
    gap = hash_order(key, "__i", seed=seed + 2).cast("double") / float(2**60)
    made = made.withColumn("__gap", gap).drop("__near").join(
        minority.select(F.col("__row").alias("__at"), F.col(features).alias("__x")), F.col("__pick.row") == F.col("__at"), "left")
    moved = F.coalesce(
        F.zip_with(features, F.col("__x"), lambda a, b: a + F.col("__gap") * (b - a)), F.col(features)
    )
    synthetic = made.select(
        F.lit(None).cast(dict(rows.dtypes)[key]).alias(key), label, moved.alias(features), F.lit(True).alias("synthetic"),
        F.col(key).alias("base"), F.col("__pick.id").alias("neighbour"),
    )
    kept = rows.select(
        key, label, features, F.lit(False).alias("synthetic"), F.col(key).alias("base"),
        F.lit(None).cast(dict(rows.dtypes)[key]).alias("neighbour"),
    )
    return kept.unionByName(synthetic)
