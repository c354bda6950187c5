"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed. A pass sends an orthonormal block Q (dimensions x width) to the tasks, each gives back
its rows' part of X'X Q with X centred, and the parts add up in Spark: that is one application of the covariance. A round

1. takes QR of the block, one pass, and Rayleigh-Ritz: eigenpairs of the covariance within the block and their residuals;
2. stops if the residuals certify the wanted pairs, twice: in between the columns beside the wanted ones are
   replaced by fresh random ones, so a direction the start had missed would show;
3. otherwise filters the block by a Chebyshev polynomial of the covariance, a pass a degree, which stays within one on
   the unwanted part of the spectrum (from 0 to the least Ritz value) and grows fast above it.

Entries become whole numbers first, so their sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.base import stage

SCALE, SHIFT = 1024.0, 100_000
GUARD = 8  #: columns beside the wanted ones
DEGREE = 8  #: of the filter, at most
SPREAD = 1e6  #: how much more the filter may raise the first wanted direction than the last: rounding in the first must not drown the last
ROUNDS = 60
TOLERANCE = 1e-12  #: residual over the distance to the nearest other Ritz value that certifies a vector
FLOOR = 1e-12  #: residual over the greatest eigenvalue that also does, once filtering no longer halves it: rounding is reached
GROUPS = 64  #: tasks that add up the parts of a pass
LARGEST = 1 << 52  #: entries after scaling beyond this are refused: doubles don't hold them exactly


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation: exact counts and sums, components as columns with falling eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    rounds: int
    residuals: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_vectors(frame: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): floor(1024 c) + 100000 of every component, staged. Rows whose vector is null or empty or holds a null or
    non-finite component go, and so do vectors of another length than the most frequent one (of equally frequent
    ones the longer): no covariance joins them with the rest. A row without an id stays."""
    v = F.transform(vector_col, lambda c: c.cast("double"))
    rows = frame.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    kept = rows.where(F.size("v") == F.lit(usual["d"] if usual else 0))
    exact = F.transform("v", lambda c: F.when(F.abs(c * SCALE) < float(LARGEST), F.floor(c * SCALE).cast("long") + SHIFT)
                        .otherwise(F.raise_error(F.lit("component too large to be a whole number")).cast("long")))
    return stage(kept.select("vec_id", exact.alias("x")), "vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _summed(rows: DataFrame, part, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of part(matrix of x), an array of `shape` doubles: one array a task, added up in
    `GROUPS` tasks, the last few by the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape), False
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column("x")))
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([total.tobytes()])], ["g", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(shape)
        for raw in table["part"].to_pylist():
            total += np.frombuffer(raw).reshape(shape)
        return pa.table({"part": pa.array([total.tobytes()])})

    out = np.zeros(shape)
    for row in rows.select("x").mapInArrow(run, "g int, part binary").groupBy("g").applyInArrow(add, "part binary").collect():  # GROUPS at most
        out += np.frombuffer(row["part"]).reshape(shape)
    return out


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Rows and the exact sum of each dimension: a task adds whole numbers of any size and gives one row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        n, total = 0, None
        for batch in batches:
            x = _matrix(batch.column("x")) if batch.num_rows else None
            for k in range(0, batch.num_rows, 512):  # 512 entries under 2 ** 53 fit
                part = x[k : k + 512].sum(axis=0).astype(object)
                total = part if total is None else total + part
            n += batch.num_rows
        if n:
            values = [Decimal(n), *(Decimal(v) for v in total.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(values) - 1), pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["i", "s"])

    parts = rows.select("x").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    found = {r["i"]: int(r["s"]) for r in parts}  # a row per dimension, and the count
    n = found.pop(-1, 0)
    return n, [found[i] for i in sorted(found)]


def fit(rows: DataFrame, k: int = 8, guard: int = GUARD, degree: int = DEGREE, seed: int = 0) -> Whitening | None:
    """The `k` leading eigenpairs of the covariance (divisor n) of `rows` (x, as from `whole_vectors`); None without rows.

    Fewer come out where there are fewer dimensions, or fewer directions with variance: one whose eigenvalue
    is rounding (under 1e-13 of the greatest) can't be whitened. Raises if the residuals don't reach the
    tolerance in `ROUNDS` rounds.
    """
    n, sums = exact_sums(rows)
    if not n:
        return None
    d = len(sums)
    mean = np.array([s / n for s in sums])
    width, k = min(d, k + guard), min(d, k)
    rng = np.random.default_rng(seed)

    def apply(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)

        return _summed(rows, part, q.shape) / n

    trace = float(_summed(rows, lambda x: ((x - mean) ** 2).sum(axis=0), (d,)).sum()) / n
    block, probed, waits, last = rng.normal(size=(d, width)), width == d, False, np.inf
    for number in range(1, ROUNDS + 1):
        q, _ = np.linalg.qr(block)
        image = apply(q)
        inner = q.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        residuals = np.linalg.norm(image - q * values, axis=0)[:k]
        top = max(values[0], 0.0)
        if top <= 0:
            return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), trace, number, np.zeros(0))
        gaps = np.array([np.abs(np.delete(values, j) - values[j]).min(initial=top if width == d else values[j]) for j in range(k)])
        worst = residuals.max()
        settled = (residuals <= TOLERANCE * gaps).all() or (worst <= FLOOR * top and worst > last / 2)
        last = worst
        if width == d or (settled and not waits):
            if probed:
                some = values[:k] > 1e-13 * top
                return Whitening(n, sums, q[:, :k][:, some], values[:k][some], trace, number, residuals[some])
            probed = waits = True
            block = np.column_stack((q[:, :k], rng.normal(size=(d, width - k))))
            continue
        waits = False  # fresh columns are filtered before they are judged
        # the filter keeps [0, cut] within one; scaled so that the leading column keeps its length
        cut = max(float(values[-1]), 1e-9 * top)
        centre = half = cut / 2
        sigma = first = half / (top - centre) if top > centre else 1.0
        before, now = q, (image - centre * q) * (sigma / half)
        for _ in range(_degree((top - centre) / half, (values[k - 1] - centre) / half, degree) - 1):
            after = 1 / (2 / first - sigma)
            before, now = now, (apply(now) - centre * now) * (2 * after / half) - before * (sigma * after)
            sigma = after
        block = now
    raise ArithmeticError(f"no certificate after {ROUNDS} rounds: residuals {residuals}, gaps {gaps}")


def _degree(first: float, last: float, most: int) -> int:
    """The greatest degree up to `most` whose Chebyshev polynomial at `first` is at most `SPREAD` times that at `last`."""
    a, b = np.arccosh(max(first, 1.0)), np.arccosh(max(last, 1.0))
    rise = lambda n: np.logaddexp(n * a, -n * a) - np.logaddexp(n * b, -n * b)
    return next((n for n in range(most, 1, -1) if rise(n) <= np.log(SPREAD)), 1)


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation decimal(38,0), whitened array<double>) of each of `rows`: the exact sum of (n x - S)^2 over dimensions, and
    the projections of x - S/n on the components over the roots of their eigenvalues."""
    n, sums, mean = model.n, model.sums, model.mean
    scaled = model.components / np.sqrt(model.eigenvalues)

    def squares(x: np.ndarray) -> list[int]:
        widest = max((max(abs(n * int(lo) - s), abs(n * int(hi) - s)) for lo, hi, s in zip(x.min(axis=0), x.max(axis=0), sums)), default=0)
        if len(sums) * widest * widest < 1 << 63 and max(map(abs, sums)) < 1 << 62:
            return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
        gaps = n * x.astype(object) - np.array(sums, object)
        return (gaps * gaps).sum(axis=1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            white = (x - mean) @ scaled
            at = np.arange(len(x) + 1, dtype=np.int32) * scaled.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([Decimal(v) for v in squares(x)], pa.decimal128(38, 0)), pa.ListArray.from_arrays(pa.array(at), pa.array(white.reshape(-1)))],
                ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance (divisor n) minus the identity."""
    mean, scaled = model.mean, model.components / np.sqrt(model.eigenvalues)
    k = scaled.shape[1]

    def part(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ scaled
        return np.vstack((white.T @ white, white.sum(axis=0)))

    total = _summed(rows, part, (k + 1, k)) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8) -> DataFrame:
    """One row per row kept by `whole_vectors` and component: vec_id, component (from 1), n, deviation (decimal), whitened, eigenvalue,
    explained, identity_error.

    Repeated rows count and come out each; ids may be null or shared. An empty table, one without a usable vector, or one whose
    vectors are all equal (no direction has variance) gives no rows. Other columns are ignored.
    """
    spark = frame.sparkSession
    rows = whole_vectors(frame, id_col, vector_col)
    model = fit(rows, k)
    columns = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, eigenvalue double, explained double, identity_error double"
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], columns)
    error = identity_error(rows, model)
    values = F.array(*[F.lit(float(e)) for e in model.eigenvalues])  # k at most
    flat = transform(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    eigenvalue = F.get(values, F.col("at"))
    return flat.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       eigenvalue.alias("eigenvalue"), (eigenvalue / model.trace).alias("explained"), F.lit(error).alias("identity_error"))
