"""K-means sweeps, silhouettes, cluster profiles."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.operators.aggregates import value_counts
from wayfarer.operators.neighbours import BLOCK, _matrix, paired, pairwise, products, slack, squares
from wayfarer.operators.quantiles import modes
from wayfarer.session import stage


@dataclass(frozen=True)
class Centres:
    """A fitted k-means: centres, total squared distance, and the column it reads."""

    centres: np.ndarray
    cost: float
    features: str

    def transform(self, df: DataFrame, name: str = "cluster") -> DataFrame:
        array = _as_array(df, self.features)
        return assign_nearest(df.withColumn("__x", array), "__x", dict(enumerate(self.centres.tolist())), name).drop("__x")


def _as_array(df: DataFrame, features: str) -> Column:
    is_array = df.schema[features].dataType.typeName() == "array"
    return F.col(features).cast("array<double>") if is_array else vector_to_array(features)


def kmeans_runs(
    df: DataFrame, ks: Sequence[int], features: str = "features", seed: int = 42, restarts: int = 10,
    max_iter: int = 300, tol: float = 1e-4,
) -> dict[int, Centres]:
    """The cheapest of `restarts` runs for each k.

    All runs of all k go on side by side: one pass over the rows per step assigns
    them for every run that still moves, and a task gives back one array of sums. Starts come from all rows (see
    `_starts`); fewer distinct rows than k give fewer centres.
    """
    rows, width = packed(df, features)
    return _runs(rows, width, ks, features, seed, restarts, max_iter, tol)


PACK = 1 << 16  #: numbers in a block of packed rows
PART = 1 << 21  #: numbers in a file of packed rows


def packed(df: DataFrame, features: str) -> tuple[DataFrame, int]:
    """The vectors that are not null, staged as blocks ``(row, n, x)``: `n` rows, numbered from `row` on, as the bytes of one matrix. A pass
    over them converts no row. Also the vectors' width (0 without rows)."""
    vectors = df.select(_as_array(df, features).alias("x")).where("x is not null")
    first = vectors.first()
    width = len(first["x"]) if first else 0
    n, cores = vectors.count(), df.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-n // 20_000))
    numbered = vectors.repartition(parts).withColumn("row", F.monotonically_increasing_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            row = batch.column("row").to_numpy()  # one after the other inside a partition
            for low in range(0, len(x), max(1, PACK // max(1, width))):
                some = x[low:low + max(1, PACK // max(1, width))]
                yield pa.RecordBatch.from_arrays([pa.array([row[low]]), pa.array([len(some)], pa.int32()), pa.array([some.tobytes()], pa.binary())], ["row", "n", "x"])

    # small parts number the rows; passes meet few large files
    blocks = numbered.mapInArrow(pack, "row long, n int, x binary").coalesce(max(cores, min(parts, -(-n * width // PART))))
    return stage(blocks, "points"), width


def _runs(rows: DataFrame, width: int, ks: Sequence[int], features: str, seed: int, restarts: int, max_iter: int, tol: float) -> dict[int, Centres]:
    """`kmeans_runs` over packed rows."""
    if rows.isEmpty():
        return {k: Centres(np.zeros((0, 0)), 0.0, features) for k in ks}
    n, total, squares = (lambda t: (t[0, 0], t[0, 1:width + 1], t[0, width + 1:]))(
        _summed(rows, lambda x, _: np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0)))[None, :], (1, 2 * width + 1)))
    still = tol * np.maximum(squares / n - (total / n) ** 2, 0).mean()
    pools = _starts(rows, width, max(ks), seed, restarts)
    runs = [(k, r) for k in ks for r in range(restarts)]
    centres = [_spread(*pools[r], k, np.random.Generator(np.random.PCG64([seed, k, r]))) for k, r in runs]
    costs, moving = [np.inf] * len(runs), list(range(len(runs)))
    for _ in range(max_iter):
        if not moving:
            break
        left = []
        for run, (cost, counts, sums) in _step(rows, {i: centres[i] for i in moving}).items():
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres[run])
            costs[run] = cost
            if ((new - centres[run]) ** 2).sum() > still:
                left.append(run)
            centres[run] = new
        moving = left
    best: dict[int, Centres] = {}
    for i, (k, _) in enumerate(runs):
        if k not in best or costs[i] < best[k].cost:
            best[k] = Centres(centres[i], float(costs[i]), features)
    return best


GROUPS = 64  #: arrays of sums that reach the driver at most


def _summed(rows: DataFrame, part, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all blocks of part(matrix of x, row numbers): one array a task, added up in `GROUPS` tasks, the last few by the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for x, row in _blocks(batch):
                total += part(x, row)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([total.tobytes()])], ["g", "part"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"part": pa.array([sum(np.frombuffer(raw) for raw in table["part"].to_pylist()).tobytes()])})

    parts = rows.mapInArrow(run, "g int, part binary")
    if rows.rdd.getNumPartitions() > GROUPS:
        parts = parts.groupBy("g").applyInArrow(add, "part binary")
    return sum((np.frombuffer(r["part"]).reshape(shape) for r in parts.select("part").collect()), np.zeros(shape))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The matrix and the row numbers of every block of a batch of packed rows."""
    for row, n, x in zip(batch.column("row").to_pylist(), batch.column("n").to_pylist(), batch.column("x")):
        yield np.frombuffer(x.as_buffer()).reshape(n, -1), np.arange(row, row + n)


def _pieces(x: np.ndarray, centres: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Piece by piece the rows with a one behind each, and half their squared distances to the centres less half the row's own
    square, a line per centre: one matrix product, small enough for a core's cache."""
    halves = np.concatenate((-centres, 0.5 * (centres**2).sum(axis=1)[:, None]), axis=1)
    size = max(256, min(8192, (1 << 17) // len(centres)))
    for low in range(0, len(x), size):
        some = np.ones((len(x[low:low + size]), x.shape[1] + 1))
        some[:, :-1] = x[low:low + size]
        yield some, halves @ some.T


def _bounds(parts: Sequence[np.ndarray]) -> list[tuple[int, int]]:
    """Where each part lies when all are stacked."""
    edges = np.cumsum([0, *[len(p) for p in parts]]).tolist()
    return list(zip(edges, edges[1:]))


def _least(x: np.ndarray, pools: Sequence[np.ndarray]) -> np.ndarray:
    """Squared distance of every row to the nearest of each pool, a line per pool."""
    bounds, out = _bounds(pools), []
    for some, half in _pieces(x, np.concatenate(pools)):
        out.append(np.stack([half[a:b].min(axis=0) for a, b in bounds]) + 0.5 * squares(some[:, :-1]))
    return np.maximum(2 * np.concatenate(out, axis=1), 0)


def _uniform(row: np.ndarray, *salt: int) -> np.ndarray:
    """A number in (0, 1) per row, the same whenever the row is read."""
    v = row.astype(np.uint64) + np.uint64(1)
    for s in salt:
        v = (v ^ np.uint64(s + 0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(32)
    return ((v >> np.uint64(11)).astype(float) + 0.5) / 2**53


OVERSAMPLING = 2  #: candidates drawn a round, times k
DRAWS = 4  #: rounds at least


def _starts(rows: DataFrame, width: int, k: int, seed: int, restarts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Candidate starts of every restart with the number of rows nearest to each.

    From one random row on, every round draws each row with a chance in proportion to its squared distance from the candidates so far,
    about `OVERSAMPLING` * `k` a round, over all rows: an outlying group of any size is met. Rounds go on while there are
    fewer than k candidates and rows apart from all of them.
    """
    numbers = rows.select(F.explode(F.sequence("row", F.col("row") + F.col("n") - 1)).alias("row"))
    least = numbers.select(*[F.min(F.struct(F.xxhash64(F.lit(seed), F.lit(r), "row"), "row"))["row"].alias(str(r)) for r in range(restarts)]).first()
    firsts = [least[str(r)] for r in range(restarts)]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, row in _blocks(batch):
                hit = np.flatnonzero(np.isin(row, firsts))
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(row[hit]), pa.array(list(x[hit]), pa.list_(pa.float64()))], ["row", "x"])

    found = {r["row"]: r["x"] for r in rows.where(" or ".join(f"{i} between row and row + n - 1" for i in firsts)).mapInArrow(fetch, "row long, x array<double>").collect()}
    pools = [np.array([found[i]], float) for i in firsts]
    for number in range(20):
        wanted = [r for r in range(restarts) if number < DRAWS or len(pools[r]) < k]
        if not wanted:
            break
        known = [pools[r] for r in wanted]
        costs = _summed(rows, lambda x, _: _least(x, known).sum(axis=1), (len(known),))

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, row in (block for batch in batches for block in _blocks(batch)):
                for r, gaps, cost in zip(wanted, _least(x, known), costs.tolist()):
                    if cost > 0:
                        chance = OVERSAMPLING * k * gaps / cost
                        hit = np.flatnonzero(_uniform(row, seed, r, number) < chance)
                        if not len(hit):
                            continue
                        yield pa.RecordBatch.from_arrays([pa.array([r] * len(hit), pa.int32()), pa.array(row[hit]), pa.array(list(x[hit]), pa.list_(pa.float64()))], ["r", "row", "x"])

        drawn = rows.mapInArrow(draw, "r int, row long, x array<double>").collect()  # about OVERSAMPLING * k a restart
        if not drawn and number >= DRAWS - 1 and not any(c > 0 for c in costs):
            break
        for r in wanted:
            mine = [d["x"] for d in drawn if d["r"] == r]
            if mine:
                pools[r] = np.unique(np.concatenate((pools[r], np.array(mine, float))), axis=0)
    stacked, bounds = np.concatenate(pools), _bounds(pools)

    def weigh(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        out = np.zeros(len(stacked))
        for _some, half in _pieces(x, stacked):
            for a, b in bounds:
                out[a:b] += np.bincount(half[a:b].argmin(axis=0), minlength=b - a)
        return out

    weights = _summed(rows, weigh, (len(stacked),))
    return [(p, weights[a:b]) for p, (a, b) in zip(pools, bounds)]


def _spread(pool: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of `pool`, each drawn in proportion to its weight and squared distance from those before."""
    chosen = [pool[rng.choice(len(pool), p=weights / weights.sum())]]
    gap = ((pool - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k and (gap > 0).any():
        mass = gap * np.maximum(weights, 1e-9)
        chosen.append(pool[rng.choice(len(pool), p=mass / mass.sum())])
        gap = np.minimum(gap, ((pool - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def _step(rows: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """One assignment of all rows for each run: its cost, and the size and sum of every centre's rows. The centres of all
    runs stand in one matrix, so distances (half of them, less the row's own square) and sums are two matrix products a piece."""
    stacked, bounds = np.concatenate(list(centres.values())), _bounds(list(centres.values()))
    firsts, sizes, width = [a for a, _ in bounds], [b - a for a, b in bounds], stacked.shape[1]

    def part(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        out = np.zeros((len(stacked), width + 2))
        for some, half in _pieces(x, stacked):
            least = np.stack([half[a:b].min(axis=0) for a, b in bounds])
            own = half == np.repeat(least, sizes, axis=0)
            # a row with equally near centres goes to the earlier one
            for i in np.flatnonzero(np.add.reduceat(np.count_nonzero(own, axis=1), firsts) != len(some)).tolist():
                a, b = bounds[i]
                unclear = np.flatnonzero(own[a:b].sum(axis=0) != 1)
                own[a:b, unclear] = False
                own[a + half[a:b, unclear].argmin(axis=0), unclear] = True
            sums = own.astype(float) @ some
            out[:, 0] += sums[:, -1]
            out[:, 2:] += sums[:, :-1]
            out[firsts, 1] += 2 * least.sum(axis=1) + (some[:, :-1] ** 2).sum()
        return out

    total = _summed(rows, part, (len(stacked), width + 2))
    return {run: (max(0.0, float(total[a:b, 1].sum())), total[a:b, 0], total[a:b, 2:]) for run, (a, b) in zip(centres, bounds)}


def kmeans(df: DataFrame, k: int, features: str = "features", seed: int = 42, restarts: int = 1) -> Centres:
    """The cheapest of `restarts` runs."""
    return kmeans_runs(df, [k], features, seed, restarts)[k]


def kmeans_sweep(
    df: DataFrame, key: str, ks: Sequence[int] = range(2, 11), features: str = "features", seed: int = 42,
    restarts: int = 10, metric: str = "squared",
) -> tuple[DataFrame, int, Centres]:
    """``(k, inertia, silhouette)`` per k, the k with the best silhouette, its model."""
    rows, width = packed(df, features)
    runs = _runs(rows, width, list(ks), features, seed, restarts, 300, 1e-4)
    if metric == "squared" and not rows.isEmpty():
        scores = _squared_scores(rows, [m.centres for m in runs.values()], df.count())
    else:
        scores = [silhouette_score(m.transform(df), key, features, metric=metric) for m in runs.values()]
    done = [(k, m.cost, score, m) for (k, m), score in zip(runs.items(), scores)]
    table = df.sparkSession.createDataFrame([r[:3] for r in done], "k int, inertia double, silhouette double")
    best = max(done, key=lambda r: (r[2], -r[0]))
    return table, best[0], best[3]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """What `assign_nearest` gives: products tell, and where they can't the squared gaps are summed dimension by dimension."""
    nx, nc = squares(x), squares(centres)
    gaps = products(x, centres, nx, nc)
    near = gaps <= (gaps.min(axis=1) + 2 * slack(nx, nc, x.shape[1]))[:, None]
    out = near.argmax(axis=1)
    unclear = np.flatnonzero(near.sum(axis=1) != 1)
    if len(unclear):
        exact = np.zeros((len(unclear), len(centres)))
        for d in range(x.shape[1]):
            exact += (x[unclear, d][:, None] - centres[:, d][None, :]) ** 2
        out[unclear] = exact.argmin(axis=1)
    return out


def _squared_scores(rows: DataFrame, models: Sequence[np.ndarray], n: int) -> list[float]:
    """The mean over `n` rows of the squared silhouettes of every model's clusters, from two passes over the packed rows for all
    models: sizes, sums and squares per cluster, then each row's value from these. Rows without a vector count as 0."""
    edges = np.concatenate(([0], np.cumsum([len(m) for m in models])))
    bounds = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    width = models[0].shape[1]

    def moments(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        out = np.zeros((int(edges[-1]), width + 2))
        full = np.concatenate((np.ones((len(x), 1)), squares(x)[:, None], x), axis=1)
        for m, (a, b) in zip(models, bounds):
            own = np.zeros((len(m), len(x)))
            own[_nearest(x, m), np.arange(len(x))] = 1.0
            out[a:b] += own @ full
        return out

    known = _summed(rows, moments, (int(edges[-1]), width + 2))

    def values(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        out, nx, at = np.zeros(len(models)), squares(x), np.arange(len(x))
        for i, (m, (a, b)) in enumerate(zip(models, bounds)):
            size, square, sums = known[a:b, 0], known[a:b, 1], known[a:b, 2:]
            mine, held = _nearest(x, m), size > 0
            # sum over y of |x - y|^2 = n |x|^2 - 2 x.S + Q
            total = np.maximum(nx[:, None] * size - 2 * (x @ sums.T) + square, 0)
            own = total[at, mine] / np.maximum(size[mine] - 1, 1)
            means = np.where(held, total / np.maximum(size, 1), np.inf)
            means[at, mine] = np.inf
            other = means.min(axis=1)
            scored = (size[mine] != 1) & np.isfinite(other) & (np.maximum(own, other) > 0)
            out[i] = ((other - own)[scored] / np.maximum(own, other)[scored]).sum()
        return out

    return [float(v) / n for v in _summed(rows, values, (len(models),))]


def silhouette_score(df: DataFrame, key: str, features: str = "features", cluster: str = "cluster", metric: str = "squared") -> float:
    rows = silhouettes(df, key, features, cluster, metric)
    return rows.agg(F.avg("silhouette")).first()[0] or 0.0


def silhouettes(df: DataFrame, key: str, features: str, cluster: str = "cluster", metric: str = "squared") -> DataFrame:
    """``(key, cluster, silhouette)`` per row.

    ``"squared"`` uses squared Euclidean distance, whose mean over a cluster
    follows from the cluster's size, mean and mean square: exact and linear.
    ``"euclidean"`` is the textbook distance and needs every pair; it is worked
    off in blocks of rows (see `_distance_sums`) and is meant for tables where a
    quadratic number of distances is affordable.
    """
    array = _as_array(df, features)
    rows = df.select(F.col(key).alias("__k"), F.col(cluster).cast("int").alias("__c"), array.alias("__x"))
    if metric == "squared":
        return _squared_silhouettes(rows, key, cluster)
    sums = _distance_sums(rows)
    own = F.col("__other") == F.col("__c")
    # sums: total distance of the row to each cluster, and that cluster's size
    scored = sums.groupBy("__k", "__c").agg(
        F.max(F.when(own, F.col("size"))).alias("size"),
        F.max(F.when(own, F.col("total") / F.greatest(F.col("size") - 1, F.lit(1)))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"),
    )
    value = F.when(F.col("size") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    return scored.select(F.col("__k").alias(key), F.col("__c").alias(cluster), value.alias("silhouette"))


def _squared_silhouettes(rows: DataFrame, key: str, cluster: str) -> DataFrame:
    """Row by row from cluster moments (k rows of d numbers, read to the driver):
    all a row needs is in the row, so nothing is shuffled."""
    long = rows.select("__c", F.posexplode("__x").alias("at", "v"))
    moments = long.groupBy("__c", "at").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    clusters: dict = {}
    for r in moments.collect():
        clusters.setdefault(r["__c"], {})[r["at"]] = (r["n"], r["s"], r["q"])
    norm = F.aggregate("__x", F.lit(0.0), lambda acc, v: acc + v * v)
    rows = rows.withColumn("__norm", norm)
    gaps = []
    for c, dims in sorted(clusters.items()):
        n = dims[0][0]
        total = F.lit(sum(q for _, _, q in dims.values()))
        s = F.array(*[F.lit(dims[i][1]) for i in range(len(dims))])
        dot = F.aggregate(F.zip_with("__x", s, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        # sum over y of |x - y|^2 = n |x|^2 - 2 x.S + Q
        gap = F.greatest(F.lit(0.0), float(n) * F.col("__norm") - 2.0 * dot + total)
        gaps.append(F.struct((F.col("__c") == c).alias("own"), F.lit(float(n)).alias("size"), gap.alias("total")))
    placed = rows.select("__k", "__c", F.array(*gaps).alias("__gaps"))
    mine = F.filter("__gaps", lambda g: g["own"])[0]
    others = F.array_min(F.transform(F.filter("__gaps", lambda g: ~g["own"]), lambda g: g["total"] / g["size"]))
    placed = placed.select("__k", "__c", mine["size"].alias("size"), (mine["total"] / F.greatest(mine["size"] - 1, F.lit(1))).alias("a"), others.alias("b"))
    value = F.when(F.col("size") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return placed.select(F.col("__k").alias(key), F.col("__c").alias(cluster), value.alias("silhouette"))


SLICE = 2048  #: rows of a block whose totals travel together
NEAR = 1e-4  #: of the squared lengths: squared distances below are not taken from a product but measured


def _distances(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Euclidean distances by a matrix product, those of near rows summed dimension by dimension."""
    if not (np.isfinite(nx).all() and np.isfinite(ny).all()):
        return pairwise(x, y, "euclidean")
    d = products(x, y, nx, ny)
    rows, columns = np.nonzero(d <= NEAR * (nx + ny.max(initial=0.0))[:, None])
    if len(rows) > d.size // 8:
        return pairwise(x, y, "euclidean")
    d[rows, columns] = 0
    np.sqrt(d, out=d)
    d[rows, columns] = paired(x, y, rows, columns, "euclidean")
    return d


def _distance_sums(rows: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Distance totals per row and cluster. Rows are cut into blocks; each unordered pair of blocks
    meets in one task, which gives back one array of totals per slice of a block, never a pair.
    The arrays of a slice are then added up and become a row per row and cluster."""
    rows = stage(rows.withColumn("__id", F.monotonically_increasing_id()), "distances")
    sizes = rows.agg(F.count(F.lit(1)), F.max(F.size("__x"))).first()
    block_rows = block_rows or max(256, min(16_384, BLOCK // max(1, sizes[1] or 1)))
    blocks = max(1, -(-sizes[0] // block_rows))
    cut = rows.withColumn("__b", F.pmod(F.xxhash64("__id"), F.lit(blocks)).cast("int"))
    left = cut.withColumnRenamed("__b", "__i").withColumn("__j", F.explode(F.sequence("__i", F.lit(blocks - 1)))).select("__i", "__j", "__id", "__k", "__c", "__x")
    right = cut.withColumnRenamed("__b", "__j").withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__j"))))
    right = right.select("__i", "__j", *[F.col(c).alias(c) for c in ("__id", "__c", "__x")])  # columns of its own: cogroup takes equal ones for one side's
    types = dict(rows.dtypes)

    def fold(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            a, b = (side.sort_values(["__c", "__id"], kind="stable").reset_index(drop=True) for side in (a, b))
            x, y = _matrix(a["__x"]), _matrix(b["__x"])
            nx, ny = squares(x), squares(y)
            (mine, at_a, n_a), (theirs, at_b, n_b) = (np.unique(side["__c"].to_numpy(), return_inverse=True, return_counts=True) for side in (a, b))
            ours, others = np.zeros((len(x), len(theirs))), np.zeros((len(y), len(mine)))
            for low in range(0, len(x), 256):
                for start in range(0, len(y), 1024):
                    some, part = slice(low, low + 256), slice(start, start + 1024)
                    d = _distances(x[some], y[part], nx[some], ny[part])
                    seen, firsts = np.unique(at_b[part], return_index=True)
                    ours[some, seen] += np.add.reduceat(d, firsts, axis=1)
                    if key[0] != key[1]:
                        seen, firsts = np.unique(at_a[some], return_index=True)
                        others[part, seen] += np.add.reduceat(d, firsts, axis=0).T
            sides = [(key[0], key[1], a, theirs, n_b, ours)] + ([(key[1], key[0], b, mine, n_a, others)] if key[0] != key[1] else [])
            for block, partner, side, names, counts, totals in sides:
                for at in range(0, len(totals), SLICE):
                    own = side.iloc[at:at + SLICE] if block == partner else side.iloc[:0]
                    out.append((block, at // SLICE, partner, own["__k"].tolist() if block == partner else [], own["__c"].tolist(),
                                names.tolist(), counts.astype(float).tolist(), totals[at:at + SLICE].tobytes()))
        return pd.DataFrame(out, columns=["block", "slice", "partner", "keys", "own", "others", "sizes", "totals"])

    def add(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("partner")
        own = found[found["partner"] == found["block"]].iloc[0]
        keys, n = list(own["keys"]), len(own["own"])
        names = np.unique(np.concatenate(found["others"].tolist()))
        sizes, totals = np.zeros(len(names)), np.zeros((n, len(names)))
        for others, counts, raw in zip(found["others"], found["sizes"], found["totals"]):
            at = np.searchsorted(names, others)
            sizes[at] += counts
            totals[:, at] += np.frombuffer(raw).reshape(n, -1)
        wide = np.repeat(np.arange(n), len(names))
        return pd.DataFrame({
            "__k": pd.Series(keys, dtype=object).iloc[wide].reset_index(drop=True), "__c": np.asarray(own["own"])[wide],
            "__other": np.tile(names, n), "size": np.tile(sizes, n), "total": totals.ravel()})

    pieces = left.groupBy("__i", "__j").cogroup(right.groupBy("__i", "__j")).applyInPandas(
        fold, f"block int, slice int, partner int, keys array<{types['__k']}>, own array<int>, others array<int>, sizes array<double>, totals binary"
    )
    sums = pieces.groupBy("block", "slice").applyInPandas(add, f"`__k` {types['__k']}, `__c` int, `__other` int, size double, total double")
    return sums.groupBy("__k", "__c", "__other").agg(F.sum("size").alias("size"), F.sum("total").alias("total"))


def assign_nearest(df: DataFrame, features: str, centres: Mapping[int, Sequence[float]], name: str = "cluster") -> DataFrame:
    """Label of the nearest centre (ties to the smaller label); centres are few
    and travel as constants."""
    x = F.col(features).cast("array<double>")
    gaps = F.array(*[
        F.struct(
            F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v).alias("d"),
            F.lit(int(label)).alias("c"),
        ) for label, c in sorted(centres.items())
    ])
    return df.withColumn(name, F.array_min(gaps)["c"])


def class_means(df: DataFrame, features: str, label: str) -> dict[int, list[float]]:
    """Mean vector per class: one row per class and dimension to the driver."""
    long = df.select(label, F.posexplode(F.col(features).cast("array<double>")).alias("at", "v"))
    found: dict[int, dict[int, float]] = {}
    for r in long.groupBy(label, "at").agg(F.avg("v").alias("m")).collect():
        found.setdefault(r[label], {})[r["at"]] = r["m"]
    return {c: [dims[i] for i in range(len(dims))] for c, dims in found.items()}


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return value_counts(df, cluster, "size")


def cluster_profile(df: DataFrame, cluster: str, numeric: Sequence[str], text: Sequence[str], digits: int = 6) -> DataFrame:
    """Per cluster: mean of numbers, mode of text (``Unknown`` without values),
    size and percentage (half-even, two places)."""
    sums = df.groupBy(cluster).agg(
        *[F.round(F.avg(c), digits).alias(c) for c in numeric], F.count(F.lit(1)).alias("Cluster_Size")
    )
    # one row per cluster from here on, so one task adds them up; a subquery would read the rows again
    whole = F.sum("Cluster_Size").over(Window.partitionBy(F.lit(0))).cast("double")
    sums = sums.withColumn("Cluster_Percentage", F.bround(F.col("Cluster_Size") / whole * 100, 2))
    if not text:
        return sums
    common = modes(df, text, [cluster]).groupBy(cluster).agg(
        *[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(c) for c in text]
    )
    return sums.join(common, cluster, "left").withColumns({c: F.coalesce(c, F.lit("Unknown")) for c in text})


def distinctive_features(
    df: DataFrame, cluster: str, numeric: Sequence[str], text: Sequence[str], gap: float = 0.5, digits: int = 6,
) -> DataFrame:
    """``(cluster, feature, kind, value, overall)``: numbers whose cluster mean is
    more than `gap` sample deviations from the overall mean (``higher``/``lower``),
    text whose cluster mode is not the overall mode (``different``)."""
    per = df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in numeric]).unpivot(cluster, list(numeric), "feature", "mean")
    overall = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in numeric])
    overall = overall.unpivot([], list(numeric), "feature", "o")
    shift = F.col("mean") - F.col("o.m")
    numbers = per.join(overall, "feature").where(F.abs(shift) > gap * F.col("o.s")).select(
        cluster, "feature", F.when(shift > 0, "higher").otherwise("lower").alias("kind"),
        F.round("mean", digits).cast("string").alias("value"), F.round("o.m", digits).cast("string").alias("overall"),
    )
    if not text:
        return numbers
    here = modes(df, text, [cluster]).select(cluster, F.col("column").alias("feature"), F.col("mode").alias("value"))
    everywhere = modes(df, text).select(F.col("column").alias("feature"), F.col("mode").alias("overall"))
    words = here.join(everywhere, "feature").where(F.col("value") != F.col("overall")).select(
        cluster, "feature", F.lit("different").alias("kind"), "value", "overall"
    )
    return numbers.unionByName(words)
