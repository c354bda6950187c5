"""Exact k nearest neighbours without a cross join.

Points are assigned to the nearest of a few pivots. The triangle inequality then
tells, from pivot distances alone, which cells can hold a neighbour of a query,
and only those meet. Cells are cut into blocks of bounded size (a cell may hold
most of the rows), each block of points meets a block of queries in one task,
and only the best `k` per query leave the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.operators.ordering import hash_order
from wayfarer.session import stage

QUERY_CHUNK = 256
TILE = 128  #: columns of a piece of distances that stays in a core's cache with its query chunk
BLOCK = 1 << 20  #: numbers in a block of vectors
POINTS = 1 << 23  #: numbers in a block of points that a search keeps at hand
SLICE_ROWS = 16_384  #: queries that meet a block in one task
PAIRS = 1 << 27  #: comparisons a task should make, about a second's work
FIRST = 1024  #: points whose distances bound the rest of a block; estimates of so many and a query chunk stay in a core's cache


def pairwise(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of `a` to all rows of `b`, summed dimension by
    dimension: equal rows give equal distances to the last bit."""
    out = np.empty((len(a), len(b)), a.dtype)
    left, right = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    step = max(TILE, (QUERY_CHUNK * TILE) // max(1, len(a)))
    for low in range(0, len(b), step):
        some = right[:, low:low + step]
        total, gap = np.zeros((len(a), some.shape[1]), a.dtype), np.empty((len(a), some.shape[1]), a.dtype)
        for d in range(len(left)):
            np.subtract(left[d][:, None], some[d][None, :], out=gap)
            if metric == "manhattan":
                np.abs(gap, out=gap)
            else:
                np.multiply(gap, gap, out=gap)
            total += gap
        out[:, low:low + step] = total
    return out if metric == "manhattan" else np.sqrt(out, out=out)


def paired(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray, metric: str) -> np.ndarray:
    """`pairwise(a, b)[rows, columns]` to the last bit, for these pairs only."""
    out = np.zeros(len(rows))
    for d in range(a.shape[1]):
        gap = a[rows, d] - b[columns, d]
        out += np.abs(gap) if metric == "manhattan" else gap * gap
    return out if metric == "manhattan" else np.sqrt(out)


def squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def products(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product, off by at most `slack`."""
    out = a @ b.T
    out *= -2.0
    out += na[:, None]
    out += nb[None, :]
    return out


def slack(na: np.ndarray, nb: np.ndarray, width: int) -> np.ndarray:
    """What rounding may change in `products` (both ways) and in the exact sums, with room to spare; one number per row of `a`."""
    return np.finfo(float).eps * (4 * width + 32) * (na + nb.max(initial=0.0))


def _single(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[Callable, np.ndarray] | None:
    """Estimates in single precision: a function of a range of `a` and one of `b`, and by how much it may err for each row of `a`. Most
    of it is a matrix product: of the centred rows for Euclidean distances (squared), of the columns that hold only 0 and 1 for
    Manhattan ones, to which the other columns are added one by one. None where the numbers are too large for it."""
    width = a.shape[1]
    na, nb = (squares(a), squares(b)) if metric == "euclidean" else (np.abs(a).sum(axis=1), np.abs(b).sum(axis=1))
    if not len(b) or not ((na < 1e30).all() and (nb < 1e30).all()):
        return None
    single = np.finfo(np.float32).eps * (4 * width + 32)
    if metric == "euclidean":
        centre = b.mean(axis=0)
        x, y, others = a - centre, b - centre, []
        nx, ny = squares(x), squares(y)
        room = slack(na, nb, width) + single * (nx + ny.max()) + 1e-30
    else:
        flags = ((a == 0) | (a == 1)).all(axis=0) & ((b == 0) | (b == 1)).all(axis=0)
        x, y, others = a[:, flags], b[:, flags], np.flatnonzero(~flags).tolist()
        nx, ny = x.sum(axis=1), y.sum(axis=1)
        room = single * (na + nb.max()) + 1e-30
    left = np.column_stack((-2 * x, nx, np.ones(len(x)))).astype(np.float32)
    right = np.column_stack((y, np.ones(len(y)), ny)).astype(np.float32)
    more = [(a[:, f].astype(np.float32), b[:, f].astype(np.float32)) for f in others]

    def guess(lo: int, hi: int, start: int, end: int) -> np.ndarray:
        out = left[lo:hi] @ right[start:end].T
        for u, v in more:
            gap = u[lo:hi, None] - v[None, start:end]
            out += np.abs(gap, out=gap)
        return out

    return guess, room


def _double(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[Callable, np.ndarray]:
    """As `_single`, in double precision; exact sums for Manhattan distances and where products overflow."""
    na, nb = squares(a), squares(b)
    if metric == "euclidean" and np.isfinite(na).all() and np.isfinite(nb).all():
        return lambda lo, hi, start, end: products(a[lo:hi], b[start:end], na[lo:hi], nb[start:end]), slack(na, nb, a.shape[1])
    return lambda lo, hi, start, end: pairwise(a[lo:hi], b[start:end], metric), np.zeros(len(a))


def _candidates(guess: Callable, lo: int, hi: int, n: int, k: int, room: np.ndarray, gone: tuple[np.ndarray, np.ndarray], most: float) -> tuple[np.ndarray, np.ndarray] | None:
    """All pairs of the rows from `lo` to `hi` with the `n` points that can be among a row's `k`, row by row; None where they are over `most`.
    What is looked at doubles from step to step, and each step's k-th estimate bounds the next."""
    k = min(k, n)
    count, bound = hi - lo, np.full(hi - lo, np.inf)
    rows, columns, near = np.empty(0, int), np.empty(0, int), np.empty(0)
    at = 0
    while at < n:
        end = min(n, max(FIRST, 2 * at))
        parts = [(rows, columns, near)]
        for start in range(at, end, FIRST):
            d = guess(lo, hi, start, min(end, start + FIRST))
            out = (gone[1] >= start) & (gone[1] < start + d.shape[1])
            d[gone[0][out], gone[1][out] - start] = np.inf
            if not at and k <= d.shape[1]:
                d[np.isnan(d)] = np.inf
                bound = np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * room
            # rounded up, so that the comparison stays in the precision of the estimates
            hit = np.flatnonzero(d <= np.nextafter(bound.astype(d.dtype), np.array(np.inf, d.dtype))[:, None])
            value = d.reshape(-1)[hit]
            if not np.isfinite(value).all():
                hit, value = hit[np.isfinite(value)], value[np.isfinite(value)]
            r, c = np.divmod(hit, d.shape[1])
            parts.append((r, c + start, value.astype(float)))
        rows, columns, near = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((near, rows))
        rows, columns, near = rows[order], columns[order], near[order]
        first, counts = np.searchsorted(rows, np.arange(count)), np.bincount(rows, minlength=count)
        full = counts >= k
        bound[full] = np.minimum(bound[full], near[first[full] + k - 1] + 2 * room[full])
        kept = near <= bound[rows]
        rows, columns, near = rows[kept], columns[kept], near[kept]
        if len(rows) > most:
            return None
        at = end
    return rows, columns


def closest(
    a: np.ndarray, b: np.ndarray, k: int, metric: str, skip: np.ndarray | tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of `a`, row of `b`, distance) of the `k` rows of `b` nearest to each row of `a`, nearest first, ties to the earlier row;
    distances that are not finite are left out, and so are the pairs of `skip`: a mask, or row and column numbers in the order of rows.

    Distances are first estimated in single precision, or in double where that leaves too many; all pairs that can be
    among the k by the estimate's error bound are then measured exactly."""
    gone = (np.empty(0, int), np.empty(0, int)) if skip is None else np.nonzero(skip) if isinstance(skip, np.ndarray) else skip
    quick, careful = _single(a, b, metric), None
    found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    for lo in range(0, len(a), QUERY_CHUNK):
        hi = min(len(a), lo + QUERY_CHUNK)
        i, j = np.searchsorted(gone[0], [lo, hi])
        out = (gone[0][i:j] - lo, gone[1][i:j])
        pairs = quick and _candidates(quick[0], lo, hi, len(b), k, quick[1][lo:hi], out, 32 * k * (hi - lo))
        if pairs is None:
            careful = careful or _double(a, b, metric)
            pairs = _candidates(careful[0], lo, hi, len(b), k, careful[1][lo:hi], out, np.inf)
        rows, columns = pairs
        distance = paired(a[lo:hi], b, rows, columns, metric)
        order = np.lexsort((columns, distance, rows))
        rows, columns, distance = rows[order], columns[order], distance[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = (place < k) & np.isfinite(distance)
        found.append((rows[kept] + lo, columns[kept], distance[kept]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), -1)


def pick_pivots(points: DataFrame, pid: str, features: str, n: int) -> np.ndarray:
    """`n` points in a fixed pseudo-random order: a bounded read to the driver."""
    rows = points.select(pid, features).orderBy(hash_order(pid, seed=7), pid).limit(n).collect()
    return np.array([r[1] for r in rows], dtype=float)


def _packed(x: np.ndarray) -> list[bytes]:
    """Every row as bytes, equal rows as equal ones: which numbers are 1 and which neither 0 nor 1, a bit each, then the latter."""
    ones = x == 1
    other = ~ones & (x != 0)
    marks = np.concatenate((np.packbits(ones, axis=1), np.packbits(other, axis=1)), axis=1)
    ends, values = np.cumsum(other.sum(axis=1)).tolist(), x[other]
    return [m.tobytes() + values[a:z].tobytes() for m, a, z in zip(marks, [0, *ends], ends)]


def _unpacked(column: pa.ChunkedArray, rows: int, width: int) -> np.ndarray:
    parts, m = column.to_pylist(), -(-width // 8)
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.fromiter(map(len, parts), np.intp, rows)
    at = (np.cumsum(size) - size)[:, None] + np.arange(2 * m)
    marks = data[at]
    out = np.unpackbits(marks[:, :m], axis=1)[:, :width].astype(float)
    other = np.unpackbits(marks[:, m:], axis=1)[:, :width].astype(bool)
    left = np.ones(len(data), bool)
    left[at] = False
    out[other] = data[left].view(float)
    return out


def _copies(column: str, *group: str) -> tuple:
    return F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*group, column)).alias("kinds")


def nearest_neighbours(
    queries: DataFrame, points: DataFrame, qid: str, pid: str, features: str, k: int, metric: str = "euclidean",
    within: str | None = None, carry: Sequence[str] = (), exclude_self: bool = False, pivots: int = 32,
    block_rows: int | None = None,
) -> DataFrame:
    """``(qid, pid, distance, place, *carry)``: the `k` nearest points per query.

    Both sides hold `features` as an array of numbers. `within` restricts
    neighbours to points that share that column (a class). Ties go to the
    smaller point id. The result is exact for any data. A block holds `block_rows`
    rows, by default as many as `POINTS` numbers make.

    Of points with equal vectors only as many as a query can need are compared, and queries with equal vectors are looked up once
    if most of them have one. Where the pivots rule out little, cells are dropped and blocks cut from all points.
    """
    spark = points.sparkSession
    group = [within] if within else []
    renamed = {c: f"__c_{c}" for c in carry}
    id_type = dict(points.dtypes)[pid]
    pts = points.select(
        F.col(pid).alias("__pid"), F.col(features).cast("array<double>").alias("__x"),
        *[F.col(c).alias(n) for c, n in renamed.items()], *[F.col(g).alias("__g") for g in group],
    )
    qs = queries.select(
        F.col(qid).alias("__qid"), F.col(features).cast("array<double>").alias("__x"), *[F.col(g).alias("__g") for g in group]
    )
    if not group:
        pts, qs = pts.withColumn("__g", F.lit(0)), qs.withColumn("__g", F.lit(0))
    out_pid = pid if pid != qid else f"neighbour_{pid}"
    centres = pick_pivots(points, pid, features, pivots)
    if not len(centres):
        fields = f"`{qid}` {dict(queries.dtypes)[qid]}, `{out_pid}` {id_type}, distance double, place int"
        fields += "".join(f", `{c}` {dict(points.dtypes)[c]}" for c in carry)
        return spark.createDataFrame([], fields)
    block_rows = block_rows or max(256, min(65_536, POINTS // max(1, centres.shape[1])))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch["__x"])
                d = pairwise(x, centres, metric)
                cell = d.argmin(axis=1)
                yield batch.assign(__x=_packed(x), __cell=cell.astype("int32"), __d=d[np.arange(len(d)), cell])

    held = {**dict(pts.dtypes), "__x": "binary"}
    schema = ", ".join(f"`{n}` {t}" for n, t in held.items())
    located = pts.mapInPandas(assign, f"{schema}, `__cell` int, `__d` double")
    # of equal vectors, those that can be among the k of any query: by id, one id more where a query's own may not count
    alike = Window.partitionBy("__g", "__x").orderBy("__pid")
    located = located.withColumn("__copy", F.dense_rank().over(alike) if exclude_self else F.row_number().over(alike))
    located = stage(located.where(F.col("__copy") <= k + int(exclude_self)).drop("__copy"), "points")

    # per cell: size, radius and the k smallest pivot distances; at most
    # pivots x groups rows of k numbers
    ranked = located.select("__g", "__cell", "__d").withColumn(
        "r", F.row_number().over(Window.partitionBy("__g", "__cell").orderBy("__d"))
    ).where(F.col("r") <= k + int(exclude_self))
    near = ranked.groupBy("__g", "__cell").agg(F.array_sort(F.collect_list("__d")).alias("near"))
    sizes = located.groupBy("__g", "__cell").agg(F.count(F.lit(1)).alias("n"), F.max("__d").alias("radius"))
    cells = near.join(sizes, ["__g", "__cell"]).collect()
    stats: dict = {}
    for c in cells:
        stats.setdefault(c["__g"], []).append((c["__cell"], c["radius"], c["n"], list(c["near"])))
    wanted = k + int(exclude_self)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query with the cells that can hold one of its k nearest."""
        for batch in batches:
            for g, part in batch.groupby("__g", sort=False):
                known = stats.get(g)
                if not known:
                    continue
                x = _matrix(part["__x"])
                d = pairwise(x, centres, metric)
                ids = np.array([c[0] for c in known])
                radii = np.array([c[1] for c in known])
                to_cell = d[:, ids]
                # a stored pivot distance t bounds that point's distance by d + t
                bounds = np.concatenate([to_cell[:, [i]] + np.array(c[3])[None, :] for i, c in enumerate(known)], axis=1)
                at = min(wanted, bounds.shape[1]) - 1
                reach = np.partition(bounds, at, axis=1)[:, at]
                if bounds.shape[1] < wanted:
                    reach[:] = np.inf
                hit = to_cell - radii[None, :] <= reach[:, None] * (1 + 1e-9) + 1e-12
                yield part.assign(__x=_packed(x), __cells=[ids[h].astype("int32") for h in hit])

    q_type = dict(qs.dtypes)["__qid"]
    fields = ", ".join(f"`{n}` {t}" for n, t in ({**dict(qs.dtypes), "__x": "binary"}).items())
    asked = routed = stage(qs.mapInPandas(route, f"{fields}, `__cells` array<int>"), "queries")
    seen = routed.agg(*_copies("__x", "__g")).first()
    folded = not exclude_self and 2 * seen["kinds"] < seen["n"]
    if folded:  # a number for every vector that is asked for
        routed = asked.groupBy("__g", "__x").agg(F.first("__cells").alias("__cells")).withColumn("__qid", F.monotonically_increasing_id())
        routed, q_type = stage(routed, "asked"), "bigint"
    kinds = routed
    visits = [(v["__g"], v["__cell"], v["n"]) for v in routed.select("__g", F.explode("__cells").alias("__cell")).groupBy("__g", "__cell").agg(F.count(F.lit(1)).alias("n")).collect()]
    counts = {r["__g"]: r["n"] for r in routed.groupBy("__g").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = {(g, c[0]): c[2] for g, cs in stats.items() for c in cs}
    pairs, every = sum(n * size[g, c] for g, c, n in visits), sum(n * sum(c[2] for c in stats[g]) for g, n in counts.items())
    if 2 * pairs > every:
        pairs, visits = every, [(g, 0, n) for g, n in counts.items()]
        size = {(g, 0): sum(c[2] for c in cs) for g, cs in stats.items()}
        routed, located = routed.drop("__cells").withColumn("__cell", F.lit(0)), located.withColumn("__cell", F.lit(0))
    else:
        routed = routed.withColumn("__cell", F.explode("__cells")).drop("__cells")

    def per_cell(counts: dict) -> Column:
        """A small lookup by cell; at most pivots x groups entries."""
        out = F.lit(1)
        for (g, cell), n in counts.items():
            out = F.when((F.col("__g") == F.lit(g)) & (F.col("__cell") == int(cell)), F.lit(int(n))).otherwise(out)
        return out

    # the queries of a busy cell are cut into slices; its blocks meet each slice
    most = min(block_rows, SLICE_ROWS)
    slices = per_cell({(g, c): -(-n // most) for g, c, n in visits if n > most})
    blocks = per_cell({at: -(-n // block_rows) for at, n in size.items() if n > block_rows})
    routed = routed.withColumn("__slice", F.pmod(F.xxhash64("__qid"), slices).cast("int"))
    routed = routed.withColumn("__block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = located.drop("__d").withColumn("__block", F.pmod(F.xxhash64("__pid"), blocks).cast("int"))
    placed = placed.withColumn("__slice", F.explode(F.sequence(F.lit(0), slices - 1)))

    carried = list(renamed.values())
    out_schema = f"`__qid` {q_type}, `__pid` {id_type}, distance double" + "".join(
        f", `{n}` {dict(pts.dtypes)[n]}" for n in carried
    )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right["__pid"].to_pandas().sort_values(kind="stable")
        right = right.take(pa.array(ids.index.to_numpy()))
        rows = flat = np.empty(0, int)
        distance = np.empty(0)
        if left.num_rows and right.num_rows:
            own = None
            if exclude_self:
                mine = pd.DataFrame({"id": left["__qid"].to_pandas(), "r": np.arange(left.num_rows)})
                theirs = pd.DataFrame({"id": ids.to_numpy(), "c": np.arange(right.num_rows)})
                if ids.dtype.kind == "f":  # a number that is missing equals none
                    mine = mine.dropna()
                same = mine.merge(theirs, on="id").sort_values("r")
                own = (same["r"].to_numpy(int), same["c"].to_numpy(int))
            rows, flat, distance = closest(_unpacked(left["__x"], left.num_rows, centres.shape[1]), _unpacked(right["__x"], right.num_rows, centres.shape[1]), k, metric, own)
        taken = right.take(pa.array(flat))
        return pa.Table.from_arrays(
            [left["__qid"].take(pa.array(rows)), taken["__pid"], pa.array(distance), *[taken[n] for n in carried]], ["__qid", "__pid", "distance", *carried])

    key = ["__g", "__cell", "__block", "__slice"]
    # every task gets about as many comparisons, and no more tasks than they are worth
    parts = int(max(1, min(4000, pairs // PAIRS)))
    best = routed.repartition(parts, *key).groupBy(*key).cogroup(placed.repartition(parts, *key).groupBy(*key)).applyInArrow(meet, out_schema)
    # a query has at most k rows per block it met
    order = Window.partitionBy("__qid").orderBy("distance", "__pid")
    found = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    if folded:  # back to the queries; ids that repeat share their k
        known = kinds.select("__g", "__x", F.col("__qid").alias("__v"))
        found = asked.select("__qid", "__g", "__x").join(known, ["__g", "__x"]).select("__qid", "__v").join(
            found.drop("place").withColumnRenamed("__qid", "__v"), "__v").drop("__v")
        found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return found.select(
        F.col("__qid").alias(qid), F.col("__pid").alias(out_pid), "distance", "place",
        *[F.col(n).alias(c) for c, n in renamed.items()],
    )


def vote_shares(neighbours: DataFrame, qid: str, label: str, k: int, weights: str = "uniform") -> DataFrame:
    """``(qid, label, share)``: what part of the votes of its nearest `k` each class has. With ``"distance"`` weights a
    query that coincides with points counts those only."""
    used = neighbours.where(F.col("place") <= k)
    if weights == "distance":
        zero = F.min("distance").over(Window.partitionBy(qid)) == 0
        weight = F.when(zero, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
        used = used.withColumn("__w", weight)
    else:
        used = used.withColumn("__w", F.lit(1.0))
    votes = used.groupBy(qid, label).agg(F.round(F.sum("__w"), 9).alias("__v"))
    return votes.select(qid, label, "__v", (F.col("__v") / F.sum("__v").over(Window.partitionBy(qid))).alias("share"))


def vote(neighbours: DataFrame, qid: str, label: str, k: int, weights: str = "uniform") -> DataFrame:
    """``(qid, prediction)`` from the nearest `k` (see `vote_shares`); ties go to the smallest label."""
    votes = vote_shares(neighbours, qid, label, k, weights)
    return votes.groupBy(qid).agg(F.min_by(label, F.struct(-F.col("__v"), F.col(label))).alias("prediction"))


def knn_classify(
    queries: DataFrame, points: DataFrame, key: str, features: str, label: str, k: int = 5, weights: str = "uniform",
    metric: str = "euclidean", **tuning,
) -> DataFrame:
    """``(key, prediction)`` for the queries."""
    found = nearest_neighbours(queries, points, key, key, features, k, metric, carry=[label], **tuning)
    return vote(found, key, label, k, weights)
