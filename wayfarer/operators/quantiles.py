"""Exact quantiles, medians and modes that never hold a group in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.session import stage

ACCURACY = 10_000  #: of the sketches: a rank is found to within one part in so many
GRID = 64  #: cells an interval is cut into when it is still too wide
HELD = 200_000  #: rows of an interval above which it is narrowed again


def quantiles(
    df: DataFrame, column: str, probs: Sequence[float], by: Sequence[str] = (), names: Sequence[str] | None = None,
    few_groups: bool = False, held: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per group, nulls skipped; exact.

    A mergeable sketch per group brackets each wanted rank between two values of that group, so groups on
    different scales don't disturb each other. Exact counts outside the bracket check it; one that holds over
    `held` rows is cut by a sketch of its own rows until it does not, or can't get narrower. Only the rows inside the
    brackets are shuffled, folded to distinct values and ranked. Spark's own ``percentile`` would keep every
    distinct value of a group in one buffer.

    `few_groups` says that `by` has few values by construction (column names,
    say), so the list of brackets may be broadcast; without `by` it is one row and always is.
    """
    by = list(by)
    names = list(names or [f"q{p:g}" for p in probs])
    held = held or HELD
    rows = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("__v"))
    brackets = stage(_checked(rows, _first_brackets(rows, probs, by), len(probs), by, few_groups), "brackets")
    while True:
        wide = brackets.where((F.col("inside") > held) & (F.col("lo") < F.col("hi")) & F.col("narrowed"))
        if wide.isEmpty():
            break
        cut = _narrower(_inside(rows, wide, by, few_groups), wide, by)
        tested = _checked(rows, cut, len(probs), by, few_groups)
        # one that does not hold its ranks keeps the bracket before, and neither that nor one that hardly shrank goes on
        good = (F.col("before") <= F.col("first")) & (F.col("before") + F.col("inside") > F.col("last"))
        kept = tested.withColumn("good", good).select(
            *by, "i", "size", "first", "last", *[F.when(F.col("good"), F.col(c)).otherwise(F.col(f"old.{c}")).alias(c) for c in ("lo", "hi", "before", "inside")],
            (F.col("good") & (F.col("inside") * 2 <= F.col("old.inside"))).alias("narrowed"))
        done = brackets.where(~((F.col("inside") > held) & (F.col("lo") < F.col("hi")) & F.col("narrowed")))
        brackets = stage(done.unionByName(kept), "brackets")
    hits = _inside(rows, brackets, by, few_groups)
    folded = hits.groupBy(*by, "i", "__v").agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in ("before", "first", "last", "size")])
    within = Window.partitionBy(*by, "i").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = folded.withColumn("__upto", F.col("before") + F.sum("__n").over(within))
    ends = ranked.groupBy(*by, "i").agg(
        F.max("size").alias("size"), F.min(F.when(F.col("__upto") > F.col("first"), F.col("__v"))).alias("lo"),
        F.min(F.when(F.col("__upto") > F.col("last"), F.col("__v"))).alias("hi"))
    at = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1) * (F.col("size") - 1)
    values = ends.withColumn("q", F.col("lo") + (F.col("hi") - F.col("lo")) * (at - F.floor(at)))
    picks = [F.max(F.when(F.col("i") == i, F.col("q"))).alias(name) for i, name in enumerate(names)]
    return values.groupBy(*by).agg(*picks).select(*by, *[F.col(f"`{n}`") for n in names])


def _first_brackets(rows: DataFrame, probs: Sequence[float], by: list[str]) -> DataFrame:
    """A row per group and probability `i`: wanted ranks `first` and `last` (0-based), bracket `lo` to `hi`."""
    margin = 2 / ACCURACY
    edges = [min(1.0, max(0.0, p + side)) for p in probs for side in (-margin, margin)]
    found = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("size"), F.percentile_approx("__v", edges, ACCURACY).alias("cuts"), F.min("__v").alias("low"), F.max("__v").alias("high")
    ).where("size > 0")
    wanted = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("size") - 1)
        # at the ends the exact extremes serve
        lo = F.col("low") if edges[2 * i] == 0 else F.col("cuts")[2 * i]
        hi = F.col("high") if edges[2 * i + 1] == 1 else F.col("cuts")[2 * i + 1]
        wanted.append(F.struct(F.lit(i).alias("i"), F.floor(at).alias("first"), F.ceil(at).alias("last"), lo.alias("lo"), hi.alias("hi")))
    return found.select(*by, "size", "low", "high", F.inline(F.array(*wanted))).select(*by, "size", "i", "first", "last", "lo", "hi", F.struct("low", "high").alias("ends"))


def _same(by: list[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}"))
    return out


def _joined(rows: DataFrame, brackets: DataFrame, by: list[str], few: bool, more: Column | None = None) -> DataFrame:
    """Rows beside the brackets of their group."""
    right = F.broadcast(brackets) if few or not by else brackets
    on = _same(by) if more is None else _same(by) & more
    return rows.alias("r").join(right.alias("b"), on)


def _inside(rows: DataFrame, brackets: DataFrame, by: list[str], few: bool) -> DataFrame:
    within = (F.col("r.__v") >= F.col("b.lo")) & (F.col("r.__v") <= F.col("b.hi"))
    rest = [c for c in brackets.columns if c not in by]
    return _joined(rows, brackets, by, few, within).select(*[F.col(f"r.{c}") for c in by], F.col("r.__v"), *[F.col(f"b.{c}") for c in rest])


def _checked(rows: DataFrame, brackets: DataFrame, n: int, by: list[str], few: bool) -> DataFrame:
    """Exact counts below (`before`) and in (`inside`) each bracket. A first bracket that misses its ranks
    is widened to the group's extremes."""
    rest = [c for c in brackets.columns if c not in [*by, "i"]]
    grouped = brackets.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", *rest))).alias("bs"))  # one entry per probability
    joined = _joined(rows, grouped, by, few).select(*[F.col(f"r.{c}") for c in by], "__v", "b.bs")
    one = lambda k: F.get("bs", F.lit(k))
    tests = [(F.col("__v") < one(k)["lo"], (F.col("__v") >= one(k)["lo"]) & (F.col("__v") <= one(k)["hi"])) for k in range(n)]
    counts = joined.groupBy(*by).agg(F.first("bs").alias("bs"), *[F.count(F.when(t, 1)).alias(f"__{side}{k}") for k, pair in enumerate(tests) for side, t in zip("bi", pair)])
    flat = counts.select(*by, F.inline(F.array(*[F.struct(one(k).alias("x"), F.col(f"__b{k}").alias("before"), F.col(f"__i{k}").alias("inside")) for k in range(n)])))
    out = flat.where("x is not null").select(*by, "x.i", *[F.col(f"x.{c}").alias(c) for c in rest], "before", "inside")
    if "ends" not in rest:
        return out
    good = (F.col("before") <= F.col("first")) & (F.col("before") + F.col("inside") > F.col("last"))
    pick = lambda c, other: F.when(good, F.col(c)).otherwise(other)
    return out.select(*by, "i", "size", "first", "last", pick("lo", F.col("ends.low")).alias("lo"), pick("hi", F.col("ends.high")).alias("hi"),
                      pick("before", F.lit(0).cast("bigint")).alias("before"), pick("inside", F.col("size")).alias("inside"), F.lit(True).alias("narrowed"))


def _narrower(hits: DataFrame, wide: DataFrame, by: list[str]) -> DataFrame:
    """The cells of an even cut of each wide bracket's rows that hold its ranks, with one more cell on both sides."""
    found = hits.groupBy(*by, "i").agg(
        F.percentile_approx("__v", [k / GRID for k in range(1, GRID)], ACCURACY).alias("cuts"), *[F.first(c).alias(c) for c in ("size", "first", "last", "lo", "hi", "before", "inside")])
    cell = lambda rank: F.floor((F.col(rank) - F.col("before")) * GRID / F.col("inside")).cast("int")
    low, high = cell("first") - 1, cell("last") + 2
    lo = F.when(low < 1, F.col("lo")).otherwise(F.get("cuts", low - 1))
    hi = F.when(high >= GRID, F.col("hi")).otherwise(F.get("cuts", high - 1))
    return found.select(*by, "i", "size", "first", "last", F.struct("lo", "hi", "before", "inside").alias("old"), lo.alias("lo"), hi.alias("hi"))


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, median)`` of several numeric columns, in one pass over the rows."""
    return column_quantiles(df, columns, [0.5], ["median"])


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Quantiles of several columns as rows ``(column, ...)``; exact.

    As `quantiles`, but the columns stay side by side: one scan sketches them all, one counts below and in every bracket, and one takes
    out what is inside, folded to distinct values before it is shuffled. A column goes the way of `quantiles` if a sketch missed one of
    its ranks, or left clearly more rows strictly between two ends than its accuracy promises.
    """
    columns, probs, names = list(columns), [float(p) for p in probs], list(names)
    rows = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    margin = 2 / ACCURACY
    edges = [min(1.0, max(0.0, p + side)) for p in probs for side in (-margin, margin)]
    seen = rows.agg(*[e for k in range(len(columns)) for e in (
        F.count(f"c{k}").alias(f"n{k}"), F.percentile_approx(f"c{k}", edges, ACCURACY).alias(f"q{k}"), F.min(f"c{k}").alias(f"a{k}"), F.max(f"c{k}").alias(f"z{k}"))]).first()
    brackets = {}  # a row per column and probability
    for k in range(len(columns)):
        for i, p in enumerate(probs if seen[f"n{k}"] else []):
            at = p * (seen[f"n{k}"] - 1)
            brackets[k, i] = (math.floor(at), math.ceil(at), seen[f"a{k}"] if edges[2 * i] == 0 else seen[f"q{k}"][2 * i], seen[f"z{k}"] if edges[2 * i + 1] == 1 else seen[f"q{k}"][2 * i + 1])
    counts = rows.agg(F.lit(0).alias("none"), *[e for (k, i), (_, _, lo, hi) in brackets.items() for e in (
        F.count_if(F.col(f"c{k}") < lo).alias(f"b{k}_{i}"), F.count_if((F.col(f"c{k}") >= lo) & (F.col(f"c{k}") <= hi)).alias(f"i{k}_{i}"),
        F.count_if((F.col(f"c{k}") > lo) & (F.col(f"c{k}") < hi)).alias(f"s{k}_{i}"))]).first()
    good = {}
    for (k, i), (first, last, lo, hi) in brackets.items():
        before, inside = counts[f"b{k}_{i}"], counts[f"i{k}_{i}"]
        if before <= first and before + inside > last and counts[f"s{k}_{i}"] <= max(HELD, 4 * margin * seen[f"n{k}"]):
            good[k, i] = (first, last, lo, hi, before)
    sides = {k for k in range(len(columns)) if all((k, i) in good for i in range(len(probs))) and seen[f"n{k}"]}
    out = df.sparkSession.createDataFrame([], "column string, " + ", ".join(f"`{n}` double" for n in names))
    if sides:
        mine = {key: b for key, b in good.items() if key[0] in sides}
        kept = F.array(*[F.when((F.col(f"c{k}") >= lo) & (F.col(f"c{k}") <= hi), F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.col(f"c{k}").alias("v"))) for (k, i), (_, _, lo, hi, _) in mine.items()])
        folded = rows.select(F.explode(F.filter(kept, lambda x: x.isNotNull())).alias("x")).groupBy("x.k", "x.i", "x.v").agg(F.count(F.lit(1)).alias("n"))
        known = df.sparkSession.createDataFrame([(k, i, first, last, before, probs[i] * (seen[f"n{k}"] - 1), columns[k]) for (k, i), (first, last, _, _, before) in mine.items()],
                                                "k int, i int, first long, last long, before long, at double, column string")
        ranked = folded.join(F.broadcast(known), ["k", "i"]).withColumn("upto", F.col("before") + F.sum("n").over(  # a row per column and probability
            Window.partitionBy("k", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        ends = ranked.groupBy("column", "i").agg(
            F.min(F.when(F.col("upto") > F.col("first"), F.col("v"))).alias("lo"), F.min(F.when(F.col("upto") > F.col("last"), F.col("v"))).alias("hi"), F.first("at").alias("at"))
        values = ends.withColumn("q", F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at")))
        out = values.groupBy("column").agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(n) for i, n in enumerate(names)])
    rest = [k for k in range(len(columns)) if k not in sides and seen[f"n{k}"]]
    if rest:
        long = rows.select(*[F.col(f"c{k}").alias(columns[k]) for k in rest]).unpivot([], [columns[k] for k in rest], "column", "value")
        out = out.unionByName(quantiles(long, "value", probs, ["column"], names, few_groups=True))
    return out


def modes(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by…, column, mode, freq, distinct)``: most frequent value as text, ties
    to the smallest; nulls skipped. Values are counted first, so a frequent
    value is folded on the map side and no task holds a group's values."""
    by = list(by)
    long = df.select(*by, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        by, list(columns), "column", "value"
    )
    counts = long.where(F.col("value").isNotNull()).groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by, "column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
        F.max("n").alias("freq"), F.count(F.lit(1)).alias("distinct"),
    )


def mode_of(df: DataFrame, column: str, by: Sequence[str] = (), name: str = "mode") -> DataFrame:
    """Typed mode of one column per group (one row when ungrouped)."""
    by = list(by)
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*by).agg(F.min_by(column, F.struct(-F.col("__n"), F.col(column))).alias(name))
