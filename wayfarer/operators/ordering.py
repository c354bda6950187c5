"""Global order without a one-task sort: ranks, running sums, positions, top-k.

A total order is cut into even buckets by a sample sort that is written once, each
bucket is ordered by itself, and bucket totals (one row per bucket) supply
the offsets. Every use of the table sees the same cut whatever is recomputed after a
lost executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.session import shuffle_width, stage

BUCKET, BEFORE = "__bucket", "__before"

BUCKET_ROWS = 50_000  #: rows a bucket should hold: their number follows the table


def hash_order(*cols: Column | str, seed: int = 42) -> Column:
    """A 60-bit number that orders rows by ``md5(cols || seed)``."""
    text = F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_bucket(order: Column, buckets: int) -> Column:
    """Bucket of a `hash_order` number: equal slices, even by construction."""
    return F.floor(order.cast("double") / F.lit(float(2**60)) * buckets).cast("int")


def running_sum(
    df: DataFrame, key: str, weights: Sequence[str], by: Sequence[str] = (), descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``<w>_cum`` (inclusive running sum) and ``<w>_total`` (sum of the
    group) per weight, in the order of `key` within `by`.

    Rows must be unique in (`by`, `key`); fold duplicates by grouping first.
    """
    cut = sample_sorted(df, *by, key, parts=buckets).drop("__at")
    return _accumulate(cut, F.col(key), weights, by, descending)


def _accumulate(cut: DataFrame, order: Column, weights: Sequence[str], by: Sequence[str], descending: bool) -> DataFrame:
    by = list(by)
    totals = cut.groupBy(*by, BUCKET).agg(*[F.sum(w).alias(f"__t_{w}") for w in weights])
    bucket_order = F.desc(BUCKET) if descending else F.asc(BUCKET)
    prior = Window.partitionBy(*by).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    # one row per bucket and group: small beside the table it indexes
    offsets = totals.select(
        *by, BUCKET,
        *[F.coalesce(F.sum(f"__t_{w}").over(prior), F.lit(0)).alias(f"__o_{w}") for w in weights],
        *[F.sum(f"__t_{w}").over(group).alias(f"{w}_total") for w in weights],
    )
    within = (
        Window.partitionBy(*by, BUCKET).orderBy(order.desc() if descending else order.asc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        cut.join(offsets, [*by, BUCKET])
        .withColumns({f"{w}_cum": F.col(f"__o_{w}") + F.sum(w).over(within) for w in weights})
        .drop(BUCKET, *[f"__o_{w}" for w in weights])
    )


def sample_sorted(df: DataFrame, *order: Column | str, parts: int | None = None) -> DataFrame:
    """`df` staged in the total order `order`, with ``__bucket`` (rises with the order) and ``__at``
    (0-based place in the bucket).

    A sample sort: splitters of equal depth come from a sample of every partition, merged by weight, so
    buckets are even whatever the distribution of the keys. Let `order` end with a column that tells equal
    keys apart: ties are then cut between tasks too. The cut is written once, so that every later use sees the same.
    """
    n = parts or max(shuffle_width(df.sparkSession), -(-df.count() // BUCKET_ROWS))
    cut = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the upper bits of this id are the partition, the lower 33 the place in it
    cut = stage(cut.withColumn("__m", F.monotonically_increasing_id()), "sorted")
    return cut.withColumns({BUCKET: F.shiftright("__m", 33).cast("int"), "__at": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__m")


def placed(df: DataFrame, *order: Column | str, name: str = "position", parts: int | None = None) -> DataFrame:
    """0-based place of each row in the total order `order` (see `sample_sorted`)."""
    cut = sample_sorted(df, *order, parts=parts)
    counts = cut.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("__n")).orderBy(BUCKET).collect()  # one row per bucket
    starts, total = [], 0
    for row in counts:
        starts.append((row[BUCKET], total))
        total += row["__n"]
    offsets = df.sparkSession.createDataFrame(starts, f"{BUCKET} int, __start bigint")
    joined = cut.join(F.broadcast(offsets), BUCKET)  # as many rows as there are buckets
    return joined.withColumn(name, F.col("__start") + F.col("__at")).drop(BUCKET, "__at", "__start")


def position(df: DataFrame, key: str, name: str = "position", buckets: int | None = None) -> DataFrame:
    """0-based place of each row in the order of a unique `key`."""
    return placed(df, key, name=name, parts=buckets)


def shuffled_rank(
    df: DataFrame, id_cols: Sequence[str], by: Sequence[str] = (), seed: int = 42, name: str = "rank",
    buckets: int | None = None,
) -> DataFrame:
    """1-based rank within `by` in a fixed pseudo-random order of the row ids,
    with the size of the group as ``<name>_of``.

    A group of any size is spread over all buckets, so a class that holds most
    of the rows is not ranked by one task.
    """
    n = buckets or max(shuffle_width(df.sparkSession), -(-df.count() // BUCKET_ROWS))
    out = df.withColumns({"__order": hash_order(*id_cols, seed=seed), "__one": F.lit(1).cast("bigint")})
    out = out.withColumn(BUCKET, hash_bucket(F.col("__order"), n))
    out = _accumulate(out, F.col("__order"), ["__one"], by, False)
    return out.withColumnsRenamed({"__one_cum": name, "__one_total": f"{name}_of"}).drop("__one", "__order")


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """First `k` rows of a total order: plans as TakeOrderedAndProject."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, k: int, by: Sequence[str], *order: Column | str, name: str = "place") -> DataFrame:
    """First `k` rows per group. Spark trims each partition to `k` rows per
    group before the shuffle (window group limit), so hot groups stay cheap."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def sort_rows(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.orderBy(*order)


def head(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """First `n` rows; without an order any `n` rows."""
    return top_k(df, n, *order) if order else df.limit(n)
