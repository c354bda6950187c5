"""Deep trees and forests whose nodes stay in a table.

Spark's own learners keep every node of every tree on the driver, and without a tight depth the nodes grow in step with the rows.
Here the driver holds the tops of the trees only: nodes of over `HELD` rows, split level by level from class counts per bin that all
tasks add up. The rows of every smaller node meet in one task, which grows the rest of that tree and leaves it as one row of a staged
table. Rows travel as packed bins, some trees at a time, so that a forest takes the disk of a few trees. Rows to be classified stay
where they lie: a task reads the staged nodes from the shared folder, part by part, and sends a row's own part of them down.

The rules are those of Spark's learners: at most `BINS` bins a feature, the split of the highest gain (ties to the earlier feature and
bound), the root of the number of features drawn per node and Poisson weights per row in forests, siblings that predict
alike merged at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators.clusters import _uniform
from wayfarer.session import release, shared_file, shared_files, stage

BINS = 32
HELD = 100_000  #: rows (by weight) of the largest node that a task grows to its end
CELLS = 1 << 21  #: class counts of one pass over the rows
LOCAL_CELLS = 1 << 20  #: class counts a task holds at a time when it grows a part
SLICE = 1 << 15  #: counts added up by one reducer
DISTINCT = 1 << 16  #: values of a feature a task holds before it condenses them
KEPT = 1 << 11  #: values it keeps then
DEALT = 1 << 25  #: rows times trees that are shuffled at a time
GATHERED = 1 << 15  #: rows a task works on at a time
ENTRIES = 1 << 18  #: counts added at a time, which stay in a core's cache
ASKED = 1 << 26  #: bytes of the rows that one reading of the nodes serves
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


# --- bins ---------------------------------------------------------------------------------

def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _condensed(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    if len(values) <= most:
        return values, counts
    upto = np.cumsum(counts)
    at = np.unique(np.searchsorted(upto, np.linspace(0, upto[-1], most + 1)[1:]).clip(max=len(values) - 1))
    return values[at], np.diff(upto[at], prepend=0)


def _merged(values: Sequence[np.ndarray], counts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(values), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate(counts), minlength=len(found))


def _bounds(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring values: all of them, or those nearest to equal shares of the rows."""
    if len(values) <= BINS:
        return (values[:-1] + values[1:]) / 2
    stride = counts.sum() / BINS
    out, upto, target = [], counts[0], stride
    for i in range(1, len(values)):
        before, upto = upto, upto + counts[i]
        if abs(before - target) < abs(upto - target):
            out.append((values[i - 1] + values[i]) / 2)
            target += stride
    return np.array(out[: BINS - 1])


def _feature_bounds(rows: DataFrame, width: int) -> list[np.ndarray]:
    """The bounds of every feature's bins, from the counts of its values; at most `BINS` numbers a feature reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0), np.empty(0))] * width
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            ones = x.sum(axis=0)
            flags = ((x == 0) | (x == 1)).all(axis=0)
            for f in range(width):
                if flags[f]:
                    new = [(v, c) for v, c in ((0.0, len(x) - ones[f]), (1.0, ones[f])) if c]
                    new = (np.array([v for v, _ in new]), np.array([c for _, c in new], float))
                else:
                    new = np.unique(x[:, f], return_counts=True)
                held[f] = _merged((held[f][0], new[0]), (held[f][1], new[1]))
                if len(held[f][0]) > DISTINCT:
                    held[f] = _condensed(*held[f], KEPT)
        held = [_condensed(*h, KEPT) for h in held]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([v.tobytes() for v, _ in held]), pa.array([c.astype(float).tobytes() for _, c in held])], ["f", "v", "c"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        read = lambda c: [np.frombuffer(raw) for raw in table[c].to_pylist()]
        return pa.table({"f": pa.array([key[0].as_py()], pa.int32()), "b": pa.array([_bounds(*_merged(read("v"), read("c"))).tobytes()])})

    found = rows.select("x").mapInArrow(count, "f int, v binary, c binary").groupBy("f").applyInArrow(merge, "f int, b binary").collect()
    bounds = {r["f"]: np.frombuffer(r["b"]) for r in found}
    return [bounds.get(f, np.empty(0)) for f in range(width)]


@dataclass(frozen=True)
class Packing:
    """The bins of a row in as many bits as they need, bit by bit in the order of the features."""

    sizes: tuple[int, ...]

    @property
    def planes(self) -> tuple[np.ndarray, np.ndarray]:
        """Feature and place of every bit."""
        bits = [(f, k) for f, size in enumerate(self.sizes) for k in range((size - 1).bit_length())]
        return np.array([f for f, _ in bits], int), np.array([k for _, k in bits], np.uint8)

    @property
    def width(self) -> int:
        return -(-len(self.planes[0]) // 8)

    def pack(self, b: np.ndarray) -> np.ndarray:
        feature, place = self.planes
        return np.packbits((b[:, feature] >> place) & 1, axis=1)

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        feature, place = self.planes
        bits = np.unpackbits(packed, axis=1)
        out = np.zeros((len(packed), len(self.sizes)), np.uint8)
        for k in range(int(place.max(initial=0)) + 1):
            at = np.flatnonzero(place == k)
            out[:, feature[at]] |= bits[:, at] << np.uint8(k)
        return out


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches put together to tables of at least `rows` rows (the last may be smaller)."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _bytes(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The bytes of a binary column end to end, as rows of `width`."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = []
    for part in parts:
        if len(part):
            ends = np.frombuffer(part.buffers()[1], np.int64 if pa.types.is_large_binary(part.type) else np.int32)[part.offset : part.offset + len(part) + 1]
            out.append(np.frombuffer(part.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]])
    return (np.concatenate(out) if len(out) != 1 else out[0]).reshape(-1, width) if out else np.empty((0, width), np.uint8)


def _blobs(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of the rows of `data`, each as one value."""
    ends = np.append(starts, len(data)) * data.shape[1]
    if ends[-1] >= 1 << 31:
        return pa.array([data[a:z].tobytes() for a, z in zip(starts, [*starts[1:], len(data)])], pa.large_binary())
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _unpacked(table: pa.Table, packing: Packing) -> np.ndarray:
    """Bins of the column `b`: a row per row."""
    return packing.unpack(_bytes(table["b"], packing.width) if packing.width else np.empty((table.num_rows, 0), np.uint8))


def _binned(df: DataFrame, bounds: list[np.ndarray], columns: Sequence[str]) -> DataFrame:
    """`columns` and `b`: the packed bins of the vector `x`."""
    packing = Packing(tuple(len(e) + 1 for e in bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                b = packing.pack(np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(bounds)], axis=1).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], _blobs(b, np.arange(len(b)))], [*columns, "b"])

    types = dict(df.dtypes)
    return df.select(*columns, "x").mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in columns], "b binary"]))


# --- splits -------------------------------------------------------------------------------

def _impurity(counts: np.ndarray, n: np.ndarray, kind: str) -> np.ndarray:
    n = np.maximum(n, 1e-300)
    out = np.ones(n.shape) if kind == "gini" else np.zeros(n.shape)
    for c in range(counts.shape[-1]):
        share = counts[..., c] / n
        if kind == "gini":
            out -= share * share
        else:
            out -= share * (np.log(np.where(share > 0, share, 1.0)) / math.log(2))
    return out


class Cells:
    """Where the weights per (node, feature that it uses, bin, class) lie, end to end, how they are counted and what they tell. All nodes
    use as many features."""

    def __init__(self, uses: np.ndarray, sizes: Sequence[int], classes: int):
        k, self.classes, self.sizes = len(uses), classes, np.array(sizes)
        self.features = np.nonzero(uses)[1].reshape(k, -1)
        self.span = self.sizes[self.features]
        ends = np.cumsum(self.span.reshape(-1)) * classes
        self.start = (ends - self.span.reshape(-1) * classes).reshape(k, -1)
        self.ends = ends.reshape(k, -1)[:, -1]
        self.all = self.features.shape[1] == len(sizes)

    def __len__(self) -> int:
        return int(self.ends[-1])

    def count(self, total: np.ndarray, b: np.ndarray, entries: np.ndarray | None, row: np.ndarray, y: np.ndarray, w: np.ndarray, slot: np.ndarray) -> None:
        """Add the weights `w` of the rows `row` of `b`, which are in the nodes `slot`. With all features in use, `entries` has the rows' uncommon bins."""
        classes, across = self.classes, (entries if self.all else self.features).shape[1]
        step = max(1, ENTRIES // max(1, across))
        for a in range(0, len(row), step):
            s, r, c, v = slot[a : a + step], row[a : a + step], y[a : a + step], w[a : a + step]
            first, last = int(s.min()), int(s.max())
            lo, hi = int(self.start[first, 0]), int(self.ends[last])
            if not self.all:
                at = b.reshape(-1).take(self.features[s] + (r * b.shape[1])[:, None]).astype(np.intp)
                at *= classes
                at += self.start[s]
                at += (c - lo)[:, None]
                total[lo:hi] += np.bincount(at.reshape(-1), weights=np.repeat(v, across), minlength=hi - lo)
                continue
            # only bins other than a feature's common one are counted; the common one has the rest of the node
            k, width, offsets = last + 1 - first, int(self.sizes.sum()), np.cumsum(self.sizes) - self.sizes
            at = entries[r] * classes
            at += ((s - first) * ((width + 1) * classes) + c)[:, None]
            found = np.bincount(at.reshape(-1), weights=np.repeat(v, across), minlength=k * (width + 1) * classes).reshape(k, width + 1, classes)[:, :width]
            whole = np.bincount((s - first) * classes + c, weights=v, minlength=k * classes).reshape(k, 1, classes)
            found[:, offsets + _common(b)] += whole - np.add.reduceat(found, offsets, axis=1)
            total[lo:hi] += found.reshape(-1)

    def best(self, flat: np.ndarray, impurity: str, least: int):
        """Per node: class weights, gain, feature (-1: none gains), last bin that goes left, class weights on the left."""
        (k, keep), classes = self.features.shape, self.classes
        totals = np.add.reduceat(flat.reshape(-1, classes), self.start[:, 0] // classes, axis=0) / keep  # every feature has all rows
        n = totals.sum(axis=1)
        whole = _impurity(totals, n, impurity)
        gains, cuts, lefts = np.full((k, keep), -np.inf), np.zeros((k, keep), int), np.zeros((k, keep, classes))
        for size in np.unique(self.span).tolist():
            if size < 2:
                continue
            i, j = np.nonzero(self.span == size)
            left = flat[self.start[i, j][:, None] + np.arange((size - 1) * classes)].reshape(-1, size - 1, classes).cumsum(axis=1)
            right = totals[i][:, None] - left
            nl, nr, all_ = left.sum(axis=2), right.sum(axis=2), np.maximum(n[i], 1e-300)[:, None]
            some = whole[i][:, None] - nl / all_ * _impurity(left, nl, impurity) - nr / all_ * _impurity(right, nr, impurity)
            some[(nl < least) | (nr < least)] = -np.inf
            place, rows = some.argmax(axis=1), np.arange(len(i))
            gains[i, j], cuts[i, j], lefts[i, j] = some[rows, place], place, left[rows, place]
        at = np.arange(k), gains.argmax(axis=1)  # of equal gains the earlier feature
        gain = np.maximum(gains[at], 0.0)
        return totals, gain, np.where(gain > 0, self.features[at], -1), cuts[at], lefts[at]


def _common(b: np.ndarray) -> np.ndarray:
    """A bin per feature that many rows have, going by the first ones."""
    return np.sort(b[:1001], axis=0)[(min(len(b), 1001) - 1) // 2]


def _entries(b: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """The bins of every row that are not the feature's common one, as places among the bins of all features; filled up by the place after the last."""
    other = b != _common(b)
    row, feature = np.nonzero(other)
    held = other.sum(axis=1)
    out = np.full((len(b), max(1, int(held.max(initial=0)))), sum(sizes), np.intp)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)] = (np.cumsum(sizes) - sizes)[feature] + b[row, feature]
    return out


def _drawn(seed: Sequence[int], nodes: int, width: int, keep: int) -> np.ndarray:
    """Which features each of the nodes of a level may use."""
    if keep >= width:
        return np.ones((nodes, width), bool)
    rank = np.random.Generator(np.random.PCG64(list(seed))).random((nodes, width)).argpartition(keep, axis=1)[:, :keep]
    out = np.zeros((nodes, width), bool)
    out[np.arange(nodes)[:, None], rank] = True
    return out


# --- nodes --------------------------------------------------------------------------------

@dataclass
class Nodes:
    """Nodes as flat arrays, parents before children; leaves have no child (-1)."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    gain: np.ndarray
    stats: np.ndarray

    @staticmethod
    def of(stats: np.ndarray) -> "Nodes":
        k = len(stats)
        return Nodes(np.full(k, -1, np.int32), np.zeros(k, np.int32), np.full(k, -1, np.int32), np.full(k, -1, np.int32), np.zeros(k), stats)

    def __len__(self) -> int:
        return len(self.feature)

    def split(self, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, lefts: np.ndarray) -> np.ndarray:
        """Split the nodes `at`; the numbers of their left children (the right ones follow them)."""
        first = len(self) + 2 * np.arange(len(at))
        self.feature[at], self.cut[at], self.gain[at], self.left[at], self.right[at] = feature, cut, gain, first, first + 1
        new = Nodes.of(np.stack([lefts, self.stats[at] - lefts], axis=1).reshape(-1, lefts.shape[1]))
        for name in ("feature", "cut", "left", "right", "gain", "stats"):
            setattr(self, name, np.concatenate((getattr(self, name), getattr(new, name))))
        return first

    def prune(self, fixed: np.ndarray | None = None) -> None:
        """Merge sibling leaves that predict alike; nodes that are `fixed` are no leaves."""
        said = self.stats.argmax(axis=1)
        leaf = self.left < 0 if fixed is None else (self.left < 0) & ~fixed
        inner = np.flatnonzero(self.left >= 0)
        above = np.full(len(self), -1)
        above[self.left[inner]] = above[self.right[inner]] = inner
        while len(inner):
            left, right = self.left[inner], self.right[inner]
            alike = inner[leaf[left] & leaf[right] & (said[left] == said[right])]
            self.left[alike] = self.right[alike] = -1
            leaf[alike] = True
            inner = np.unique(above[alike])  # only above a new leaf can there be more
            inner = inner[inner >= 0]

    def reached(self, roots: np.ndarray) -> np.ndarray:
        out, at = [roots], roots
        while len(at):
            at = at[self.left[at] >= 0]
            at = np.concatenate((self.left[at], self.right[at]))
            out.append(at)
        return np.sort(np.concatenate(out))

    def compact(self) -> "Nodes":
        """Without the nodes that pruning cut off."""
        kept = self.reached(np.array([0]))
        at = np.full(len(self), -1, np.int32)
        at[kept] = np.arange(len(kept))
        move = lambda child: np.where(child[kept] >= 0, at[child[kept]], -1).astype(np.int32)
        return Nodes(self.feature[kept], self.cut[kept], move(self.left), move(self.right), self.gain[kept], self.stats[kept])

    def shares(self) -> np.ndarray:
        return self.stats / np.maximum(self.stats.sum(axis=1, keepdims=True), 1e-300)

    def importance(self, at: np.ndarray, width: int) -> np.ndarray:
        at = at[self.left[at] >= 0]
        return np.bincount(self.feature[at], weights=self.gain[at] * self.stats[at].sum(axis=1), minlength=width)

    def down(self, b: np.ndarray, at: np.ndarray, steps: int | None = None, row: np.ndarray | None = None) -> np.ndarray:
        """Where the rows of `b` (or the rows `row` of it) get to from the nodes `at`, in `steps` steps or to the end."""
        flat, width, at, some = b.reshape(-1), b.shape[1], at.copy(), np.arange(len(at))
        while len(some) and (steps is None or steps > 0):
            some = some[self.left[at[some]] >= 0]
            here = at[some]
            bins = flat.take((some if row is None else row[some]) * width + self.feature[here])
            at[some] = np.where(bins <= self.cut[here], self.left[here], self.right[here])
            steps = None if steps is None else steps - 1
        return at

    def packed(self) -> bytes:
        """Features, cuts and the class weights of the leaves, compressed. Children need no numbers: those of the nodes with children follow each other."""
        inner = self.left >= 0
        leaves = self.stats[~inner]
        kinds = [np.min_scalar_type(int(self.feature.max(initial=0)) + 1), np.min_scalar_type(int(leaves.max(initial=0)))]
        body = b"".join([
            np.array([len(self), *[k.itemsize for k in kinds]], np.int32).tobytes(), np.where(inner, self.feature + 1, 0).astype(kinds[0]).tobytes(),
            self.cut[inner].astype(np.uint8).tobytes(), leaves.T.astype(kinds[1]).tobytes()])
        return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)

    @staticmethod
    def unpacked(raw: bytes, classes: int) -> "Nodes":
        body = pa.decompress(memoryview(raw)[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
        n, *sizes = np.frombuffer(body, np.int32, 3).tolist()
        feature = np.frombuffer(body, f"u{sizes[0]}", n, 12).astype(np.int32) - 1
        inner = np.flatnonzero(feature >= 0)
        out = Nodes.of(np.zeros((n, classes)))
        out.feature = feature
        out.cut[inner] = np.frombuffer(body, np.uint8, len(inner), 12 + n * sizes[0])
        out.left[inner] = 1 + 2 * np.arange(len(inner))
        out.right[inner] = out.left[inner] + 1
        out.stats[feature < 0] = np.frombuffer(body, f"u{sizes[1]}", (n - len(inner)) * classes, 12 + n * sizes[0] + len(inner)).reshape(classes, -1).T
        levels = [inner[:1]]
        while len(levels[-1]):
            below = np.concatenate((out.left[levels[-1]], out.right[levels[-1]]))
            levels.append(below[out.left[below] >= 0])
        for level in reversed(levels):
            out.stats[level] = out.stats[out.left[level]] + out.stats[out.right[level]]
        return out


def _grown(b: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, sizes: list[int], classes: int, impurity: str, least: int, keep: int, seed: Sequence[int]) -> Nodes:
    """One part of a tree grown to its end: `depth` levels more at most."""
    nodes = Nodes.of(np.bincount(y, weights=w, minlength=classes)[None, :])
    entries = _entries(b, sizes) if keep >= len(sizes) else None
    flat, width = b.reshape(-1), b.shape[1]
    # the rows lie by node, in the order of the level's nodes: `held` of them in each
    row, level, held = np.arange(len(y)), np.zeros(1, int), np.array([len(y)])
    step = max(1, LOCAL_CELLS // (max(1, keep * sum(sizes) // len(sizes)) * classes))
    for number in range(depth):
        stats = nodes.stats[level]
        n = stats.sum(axis=1)
        going = (stats.max(axis=1) < n) & (n >= 2 * least)
        if not going.any():
            break
        row, level, held = row[np.repeat(going, held)], level[going], held[going]
        slot, ends = np.repeat(np.arange(len(level)), held), np.append(0, np.cumsum(held))
        uses = _drawn([*seed, number], len(level), len(sizes), keep)
        found = []
        for a in range(0, len(level), step):
            lo, hi = ends[a], ends[min(a + step, len(level))]
            cells = Cells(uses[a : a + step], sizes, classes)
            total, part = np.zeros(len(cells)), row[lo:hi]
            cells.count(total, b, entries, part, y[part], w[part], slot[lo:hi] - a)
            found.append(cells.best(total, impurity, least)[1:])
        gain, feature, cut, lefts = (np.concatenate(c) for c in zip(*found))
        good = feature >= 0
        if not good.any():
            break
        first = nodes.split(level[good], feature[good], cut[good], gain[good], lefts[good])
        some = np.repeat(good, held)
        row, held, feature, cut = row[some], held[good], feature[good], cut[good]
        right = flat.take(row * width + np.repeat(feature, held)) > np.repeat(cut, held)
        starts = np.cumsum(held) - held
        turned = np.add.reduceat(right, starts, dtype=int)
        # left rows of a node to its front, right ones behind them, each in their order
        before = np.cumsum(right) - right
        ahead = before - np.repeat(before[starts], held)
        at = np.arange(len(row))
        place = np.where(right, np.repeat(starts + held - turned, held) + ahead, at - ahead)
        moved = np.empty_like(row)
        moved[place] = row
        row, held = moved, np.stack([held - turned, turned], axis=1).reshape(-1)
        level = np.stack([first, first + 1], axis=1).reshape(-1)
    nodes.prune()
    return nodes.compact()


# --- the estimator ------------------------------------------------------------------------

class DeepForest(Estimator):
    """A forest, or a single tree (`numTrees` None) on all rows and features."""

    def __init__(self, numTrees: int | None = None, maxDepth: int = 30, impurity: str = "gini", minInstancesPerNode: int = 1, seed: int = 42):
        super().__init__()
        self.trees, self.depth, self.impurity, self.least, self.seed = numTrees, maxDepth, impurity, minInstancesPerNode, seed
        self.features = "features"

    def setFeaturesCol(self, name: str) -> "DeepForest":
        self.features = name
        return self

    def _fit(self, dataset: DataFrame) -> "DeepForestModel":
        rows = dataset.select(F.col("label").cast("int").alias("y"), vector_to_array(self.features).alias("x"))
        sample = rows.select(F.size("x").alias("width")).first()
        if sample is None:
            raise ValueError("no rows to grow a tree from")
        width = sample["width"]
        bounds = _feature_bounds(rows, width)
        rows = stage(_binned(rows, bounds, ["y"]).withColumn("id", F.monotonically_increasing_id()), "binned")
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("y")).first()
        sizes, classes = [len(e) + 1 for e in bounds], seen["y"] + 1
        bagged = self.trees is not None and self.trees > 1
        trees = self.trees or 1
        keep = math.ceil(math.sqrt(width)) if bagged else width
        tops, tree, depth = self._tops(rows, seen["n"], trees, bagged, sizes, classes, keep)
        part = (tops.left < 0) & self._open(tops, depth)
        step, grown, files = max(1, DEALT // max(1, seen["n"])), [], []
        for a in range(0, trees, step):
            some = range(a, min(a + step, trees))
            grown.append(stage(self._parts(rows, tops, tree, depth, part & np.isin(tree, some), bagged, sizes, classes, keep), "parts"))
            files.append((some, shared_files(grown[-1])))
            release(rows.sparkSession)
        whole = reduce(DataFrame.unionByName, grown)
        # parts that became one leaf, or got no row, are leaves of the tops, which may merge further: a number per part
        part = np.zeros(len(part), bool)
        part[[r["part"] for r in whole.where(~F.col("leaf")).select("part").collect()]] = True
        for r in whole.where(F.col("part") < trees).select("part", "root").collect():
            tops.stats[r["part"]] = np.frombuffer(r["root"])
        tops.prune(part)
        return DeepForestModel(self, bounds, classes, tops, tree, depth, part, whole, files, trees, width)

    def _open(self, tops: Nodes, depth: np.ndarray) -> np.ndarray:
        """Nodes that may be split: impure, large and shallow enough. A root that was not counted is."""
        n = tops.stats.sum(axis=1)
        return (depth < self.depth) & ((n == 0) & (depth == 0) | (tops.stats.max(axis=1) < n) & (n >= 2 * self.least))

    def _tops(self, rows: DataFrame, n: int, trees: int, bagged: bool, sizes: list[int], classes: int, keep: int) -> tuple[Nodes, np.ndarray, np.ndarray]:
        """The nodes of over `HELD` rows and their children."""
        tops = Nodes.of(np.zeros((trees, classes)))
        tree, depth = np.arange(trees), np.zeros(trees, int)
        level = np.arange(trees) if n > HELD else np.empty(0, int)
        while len(level):
            uses = np.concatenate([_drawn([self.seed, 1, int(depth[level[0]]), t], int((tree[level] == t).sum()), len(sizes), keep) for t in np.unique(tree[level]).tolist()])
            cost = np.cumsum((uses * np.array(sizes)).sum(axis=1) * classes)
            found = []
            for a, z in _ranges(cost):
                cells = Cells(uses[a:z], sizes, classes)
                found.append(cells.best(self._counted(rows, tops, tree, level[a:z], cells, bagged), self.impurity, self.least))
            totals, gain, feature, cut, lefts = (np.concatenate(c) for c in zip(*found))
            tops.stats[level] = totals
            good = (feature >= 0) & self._open(tops, depth)[level]
            first = tops.split(level[good], feature[good], cut[good], gain[good], lefts[good])
            new = np.stack([first, first + 1], axis=1).reshape(-1)
            # by tree, so that the features drawn for a level follow the order of its nodes
            tree, depth = np.concatenate((tree, np.repeat(tree[level[good]], 2))), np.concatenate((depth, np.repeat(depth[level[good]] + 1, 2)))
            level = new[self._open(tops, depth)[new] & (tops.stats[new].sum(axis=1) > HELD)]
        return tops, tree, depth

    def _counted(self, rows: DataFrame, tops: Nodes, tree: np.ndarray, level: np.ndarray, cells: Cells, bagged: bool) -> np.ndarray:
        """The weights in the `cells` of the nodes `level` over all rows, added up slice by slice."""
        seed, wanted, packing = self.seed, np.unique(tree[level]).tolist(), Packing(tuple(cells.sizes.tolist()))
        slots = np.full(len(tops), -1)
        slots[level] = np.arange(len(level))
        sent = rows.sparkSession.sparkContext.broadcast((tops, slots, cells))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            tops, slots, cells = sent.value
            for table in _gathered(batches, GATHERED):
                b, y, ids = _unpacked(table, packing), table["y"].to_numpy(), table["id"].to_numpy()
                entries = _entries(b, packing.sizes) if cells.all else None
                total = np.zeros(len(cells)) if total is None else total
                for t in wanted:
                    w = _weights(ids, seed, t, bagged)
                    some = np.flatnonzero(w > 0)
                    at = slots[tops.down(b, np.full(len(some), t), row=some)]
                    some, at = some[at >= 0], at[at >= 0]
                    if len(some):
                        cells.count(total, b, entries, some, y[some], w[some], at)
            if total is not None:
                for g, a in enumerate(range(0, len(total), SLICE)):
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([total[a : a + SLICE].tobytes()])], ["g", "part"])

        def add(key: tuple, table: pa.Table) -> pa.Table:
            return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([sum(np.frombuffer(raw) for raw in table["part"].to_pylist()).tobytes()])})

        found = rows.mapInArrow(run, "g int, part binary").groupBy("g").applyInArrow(add, "g int, part binary").collect()
        return np.concatenate([np.frombuffer(r["part"]) for r in sorted(found, key=lambda r: r["g"])])

    def _parts(self, rows: DataFrame, tops: Nodes, tree: np.ndarray, depth: np.ndarray, part: np.ndarray, bagged: bool, sizes: list[int], classes: int, keep: int) -> DataFrame:
        """``(part, tree, leaf, root, importance, nodes)``: the rest of the trees, grown from the rows of each `part`. A part's rows of a
        table travel as one value: weight, class and bins of one after the other."""
        seed, most, impurity, least, packing = self.seed, self.depth, self.impurity, self.least, Packing(tuple(sizes))
        sent = rows.sparkSession.sparkContext.broadcast((tops, tree, depth, part))
        trees = np.unique(tree[part]).tolist()

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tops, _, _, part = sent.value
            for table in _gathered(batches, GATHERED):
                b, ids = _unpacked(table, packing), table["id"].to_numpy()
                own = table["y"].to_numpy().astype("<i4").view(np.uint8).reshape(-1, 4)
                record = np.concatenate([np.zeros((len(b), 1), np.uint8), own, packing.pack(b)], axis=1)
                for t in trees:
                    w = _weights(ids, seed, t, bagged)
                    some = np.flatnonzero(w > 0)
                    at = tops.down(b, np.full(len(some), t), row=some)
                    some, at = some[part[at]], at[part[at]]
                    if not len(some):
                        continue
                    order = np.argsort(at, kind="stable")
                    some, at = some[order], at[order]
                    taken = record[some]
                    taken[:, 0] = w[some]
                    starts = np.flatnonzero(np.diff(at, prepend=-1) != 0)
                    yield pa.RecordBatch.from_arrays([pa.array(at[starts], pa.int32()), _blobs(taken, starts)], ["part", "rows"])

        def grow(key: tuple, table: pa.Table) -> pa.Table:
            p = key[0].as_py()
            _, tree, depth, _ = sent.value
            record = _bytes(table["rows"], 5 + packing.width)
            w, y = record[:, 0].astype(float), np.ascontiguousarray(record[:, 1:5]).view("<i4").reshape(-1).astype(np.intp)
            nodes = _grown(packing.unpack(record[:, 5:]), y, w, most - int(depth[p]), sizes, classes, impurity, least, keep, [seed, 2, p])
            return pa.table({
                "part": pa.array([p], pa.int32()), "tree": pa.array([int(tree[p])], pa.int32()), "leaf": [len(nodes) == 1], "root": [nodes.stats[0].tobytes()],
                "importance": [nodes.importance(np.arange(len(nodes)), len(sizes)).tobytes()], "nodes": [nodes.packed()]})

        dealt = rows.mapInArrow(deal, "part int, rows binary")
        width = max(2 * rows.sparkSession.sparkContext.defaultParallelism, int(part.sum()) // 4)
        return dealt.repartition(min(width, 4000), "part").groupBy("part").applyInArrow(grow, "part int, tree int, leaf boolean, root binary, importance binary, nodes binary")


def _ranges(cost: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of nodes whose counts fit one pass; `cost` is a running sum."""
    a = 0
    while a < len(cost):
        z = max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + CELLS, side="right")))
        yield a, z
        a = z


def _weights(ids: np.ndarray, seed: int, tree: int, bagged: bool) -> np.ndarray:
    return np.searchsorted(_POISSON, _uniform(ids, seed, tree)).astype(float) if bagged else np.ones(len(ids))


class DeepForestModel(Model):
    def __init__(self, spec: DeepForest, bounds: list[np.ndarray], classes: int, tops: Nodes, tree: np.ndarray, depth: np.ndarray, part: np.ndarray, parts: DataFrame, files: list[tuple[range, list[str]]], trees: int, width: int):
        super().__init__()
        self.spec, self.bounds, self.numClasses, self.tops, self.tree, self.depth, self.part, self.parts, self.files, self.trees, self.width = spec, bounds, classes, tops, tree, depth, part, parts, files, trees, width

    @property
    def featureImportances(self) -> DenseVector:
        """Gains by weight, each tree's to a sum of 1, then all; a row per tree reaches the driver."""
        def add(key: tuple, table: pa.Table) -> pa.Table:
            return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "importance": pa.array([sum(np.frombuffer(raw) for raw in table["importance"].to_pylist()).tobytes()])})

        found = self.parts.select("tree", "importance").groupBy("tree").applyInArrow(add, "tree int, importance binary").collect()
        below = {r["tree"]: np.frombuffer(r["importance"]) for r in found}
        total = np.zeros(self.width)
        for t in range(self.trees):
            one = self.tops.importance(self.tops.reached(np.array([t])), self.width) + below.get(t, 0.0)
            total += one / one.sum() if one.sum() > 0 else 0.0
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def votes(self, df: DataFrame, key: str, depths: Sequence[int], numbers: Sequence[int]) -> DataFrame:
        """``(key, votes)``: class shares added over the first `number` trees cut at `depth`, for depths times numbers, end to end.

        The rows stay in their task, which reads the nodes of some trees at a time from the shared folder."""
        tops, classes, depth = self.tops, self.numClasses, self.depth
        inner = np.flatnonzero(tops.left >= 0)
        above = np.arange(len(tops))
        above[tops.left[inner]] = above[tops.right[inner]] = inner
        cut = []  # where a tree cut at a depth ends, for every node of the tops
        for d in depths:
            up = np.arange(len(tops))
            for _ in range(int(depth.max())):  # what pruning cut off has no node above it and is never reached
                up = np.where(depth[up] > d, above[up], up)
            cut.append(up)
        spark, packing = df.sparkSession, Packing(tuple(len(e) + 1 for e in self.bounds))
        sent = spark.sparkContext.broadcast((tops, tops.shares(), cut, depth, self.tree, self.part))
        files = [(range(some.start, min(some.stop, max(numbers))), paths) for some, paths in self.files if some.start < max(numbers)]
        cells = len(depths) * len(numbers) * classes
        asked = max(1, ASKED // (len(packing.sizes) + 8 * cells + 12 * max(len(some) for some, _ in files)))

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tops, shares, cut, depth, tree, part = sent.value
            for table in _gathered(batches, asked):
                b = _unpacked(table, packing)
                out = np.zeros((len(depths), len(numbers), len(b), classes))

                def add(i: int, t: int, rows: np.ndarray, found: np.ndarray) -> None:
                    for j, number in enumerate(numbers):
                        if t < number:
                            out[i, j, rows] += found

                for some, paths in files:
                    met = {}
                    for t in some:
                        at = tops.down(b, np.full(len(b), t))
                        for i, d in enumerate(depths):
                            ended = np.flatnonzero(~part[at] | (depth[at] >= d))
                            add(i, t, ended, shares[cut[i][at[ended]]])
                        rows = np.flatnonzero(part[at])
                        rows = rows[np.argsort(at[rows], kind="stable")]
                        starts = np.flatnonzero(np.diff(at[rows], prepend=-1) != 0)
                        met |= {int(at[rows[a]]): rows[a:z].astype(np.int32) for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)])}
                    for p, raw in _read(paths, met):
                        below, rows = Nodes.unpacked(raw, classes), met[p].astype(np.intp)
                        own = below.shares()
                        for i, d in enumerate(depths):
                            if d > depth[p]:
                                add(i, int(tree[p]), rows, own[below.down(b, np.zeros(len(rows), np.intp), d - int(depth[p]), rows)])
                lists = np.ascontiguousarray(np.moveaxis(out, 2, 0)).reshape(-1)
                votes = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * cells), pa.array(lists))
                yield pa.RecordBatch.from_arrays([table[key].combine_chunks() if table[key].num_chunks != 1 else table[key].chunk(0), votes], [key, "votes"])

        # a task reads all nodes, so there are no more tasks than can run
        rows = _binned(df.select(key, vector_to_array(self.spec.features).alias("x")).coalesce(spark.sparkContext.defaultParallelism), self.bounds, [key])
        return rows.mapInArrow(vote, f"`{key}` {dict(df.dtypes)[key]}, votes array<double>")

    def hits(self, df: DataFrame, depths: Sequence[int], numbers: Sequence[int]) -> dict[int, tuple[int, int]]:
        """(right, rows) per setting, as depths times numbers: one search serves them all."""
        rows = stage(df.select("label", self.spec.features).withColumn("__id", F.monotonically_increasing_id()), "asked")
        found = self.votes(rows, "__id", depths, numbers).join(rows.select("__id", "label"), "__id")
        said = [_largest(F.slice("votes", s * self.numClasses + 1, self.numClasses)) for s in range(len(depths) * len(numbers))]
        r = found.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(p == F.col("label")).alias(f"r{s}") for s, p in enumerate(said)]).first()
        return {s: (r[f"r{s}"], r["n"]) for s in range(len(said))} if r["n"] else {}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = stage(dataset.withColumn("__id", F.monotonically_increasing_id()), "asked")
        found = self.votes(rows, "__id", [self.spec.depth], [self.trees])
        out = rows.join(found, "__id").drop("__id")
        return out.withColumns({
            "rawPrediction": array_to_vector("votes"), "probability": array_to_vector(F.transform("votes", lambda v: v / float(self.trees))), "prediction": _largest(F.col("votes")),
        }).drop("votes")


def _read(paths: Sequence[str], wanted) -> Iterator[tuple[int, bytes]]:
    """``(part, nodes)`` of the parts in `wanted`, from staged files."""
    for path in paths:
        store, at = shared_file(path)
        with store.open_input_file(at) as source:
            for batch in pq.ParquetFile(source).iter_batches(16, columns=["part", "nodes"]):
                for p, raw in zip(batch.column("part").to_pylist(), batch.column("nodes")):
                    if p in wanted:
                        yield p, raw.as_py()


def _largest(shares):
    """The first class of the largest share."""
    return (F.array_position(shares, F.array_max(shares)) - 1).cast("double")
