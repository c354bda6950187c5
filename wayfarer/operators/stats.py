"""Distribution and association statistics: the data behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators.bins import with_scalars
from wayfarer.operators.quantiles import quantiles


def kde_curve(df: DataFrame, column: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian density on an even grid, ``(point, x, density)``.

    Scott's bandwidth ``n^(-1/5) * std``; the grid runs `cut` bandwidths past
    the data. Values are folded to counts, each distinct value adds to the
    grid's `points` sums on the map side, so what is shuffled is the grid.
    """
    v = F.col(column).cast("double")
    stats = df.agg(
        F.count(v).cast("double").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_samp(v).alias("sd")
    ).select("n", "lo", "hi", (F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))).alias("h"))
    counts = df.where(v.isNotNull()).groupBy(v.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    rows = with_scalars(counts, stats, "s").withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    low = F.col("s.lo") - cut * F.col("s.h")
    span = (F.col("s.hi") - F.col("s.lo")) + 2 * cut * F.col("s.h")
    rows = rows.withColumn("x", low + span * F.col("point") / (points - 1))
    z = (F.col("x") - F.col("__v")) / F.col("s.h")
    kernel = F.exp(-0.5 * z * z) * F.col("__n")
    norm = F.max(F.col("s.n") * F.col("s.h")) * (2 * 3.141592653589793) ** 0.5
    return rows.groupBy("point").agg(F.max("x").alias("x"), (F.sum(kernel) / norm).alias("density"))


def box_stats(df: DataFrame, column: str, by: str) -> DataFrame:
    """Quartiles per group, whiskers at the last value within 1.5 IQR, and how
    many values lie beyond them."""
    keyed = df.where(F.col(by).isNotNull() & F.col(column).isNotNull()).select(by, F.col(column).cast("double").alias("__v"))
    # quartiles: one row per group
    cuts = quantiles(keyed, "__v", [0.25, 0.5, 0.75], [by], ["q1", "median", "q3"])
    rows = keyed.groupBy(by, "__v").agg(F.count(F.lit(1)).alias("__n")).join(cuts, by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("__v").between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.groupBy(by).agg(
        F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col("__v"))).alias("low"), F.max(F.when(inside, F.col("__v"))).alias("high"),
        F.sum(F.when(~inside, F.col("__n")).otherwise(0)).alias("outliers"),
    )


def corr_pairs(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Pearson r of all column pairs ``(a, b, r)`` with a before b, over the rows
    where both are present: one scan, one row of partial sums per task."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    row = df.agg(*[
        F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)
    ])
    entries = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"r{i}"), digits).alias("r"))
        for i, (a, b) in enumerate(pairs)
    ])
    return row.select(F.inline(entries))


def corr_matrix(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """The whole symmetric matrix, long form, with 1 on the diagonal."""
    pairs = corr_pairs(df, columns, digits)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("a"), F.col("b").alias("b"), F.col("r").alias("r")),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("r").alias("r")),
    )).alias("e")).select("e.*")
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, r double")
    return both.unionByName(diagonal)


def corr_with_target(df: DataFrame, columns: Sequence[str], target: str, digits: int = 6) -> DataFrame:
    others = [c for c in columns if c != target]
    row = df.agg(*[F.round(F.corr(F.col(c).cast("double"), F.col(target).cast("double")), digits).alias(c) for c in others])
    return row.unpivot([], others, "column", "r").orderBy(F.desc("r"), "column")


def strong_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.3, k: int = 5, digits: int = 6) -> DataFrame:
    pairs = corr_pairs(df, columns, digits).where(F.abs("r") > threshold)
    return pairs.orderBy(F.desc(F.abs("r")), "a", "b").limit(k)
