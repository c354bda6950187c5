"""Toxicity by a classifier chain.

Categories are predicted in a fixed order. Each has a linear model over hashed words and word beginnings; the model
of a later category also sees the logits of the earlier ones. For training those are out-of-fold
predictions, so a later model never learns from an earlier model's memory of the same row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm import words as W
from wayfarer.llm.descent import descend

STEMS = (4, 5, 6)  #: bytes of a word beginning that are features as well
BITS = 18  #: weights of a model: 2**BITS, bounded whatever the vocabulary
SAMPLE = 10_000  #: labelled rows a chain is fitted on at most
FOLDS = 3
STEPS = 30
L2 = 1e-3
RARE = 4  #: features of fewer training rows have no weight


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words and word beginnings (stems) of each row: values and row offsets."""
    w = W.words(column, W.LETTERS, STEMS)
    both = np.stack((w.hashes, *w.prefixes), axis=1).ravel()
    return W.row_sets(both >> W.U64(64 - bits), w.offsets * (1 + len(STEMS)))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class Linear:
    """Logistic regression over presence features and a few dense columns. Classes weigh the same in sum."""

    def __init__(self, size: int, dense: int) -> None:
        self.sparse, self.dense, self.bias = np.zeros(size), np.zeros(dense), 0.0

    def fit(self, index: np.ndarray, offsets: np.ndarray, extra: np.ndarray, y: np.ndarray, use: np.ndarray | None = None, steps: int = STEPS) -> "Linear":
        """Fit on the rows marked in `use` (all without it). Rows are walked in blocks, so beside the data only
        a block's features and a few arrays of the model's size are held."""
        use = np.ones(len(y), bool) if use is None else use
        n, share = int(use.sum()), y[use].mean() if use.any() else 0.0
        if not 0 < share < 1:  # one class only: its smoothed share is the answer
            p = (y[use].sum() + 0.5) / (n + 1.0)
            self.bias = float(np.log(p / (1 - p)))
            return self
        weight = np.where(use, np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / n, 0.0)
        size, lengths = len(self.sparse), np.diff(offsets)
        blocks = list(_blocks(offsets))
        counts = np.zeros(size, np.int64)
        for a, b in blocks:
            counts += np.bincount(index[offsets[a] : offsets[b]][np.repeat(use[a:b], lengths[a:b])], minlength=size)
        kept = counts >= RARE
        shrink = np.concatenate((np.full(size + extra.shape[1], L2), [0.0]))

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            gradient, value = shrink * w, 0.5 * float(shrink @ w**2)
            for a, b in blocks:
                ids = index[offsets[a] : offsets[b]]
                z = _sums(w[:size][ids], offsets[a : b + 1] - offsets[a]) + extra[a:b] @ w[size:-1] + w[-1]
                g = weight[a:b] * (_sigmoid(z) - y[a:b])
                gradient[:size] += np.bincount(ids, np.repeat(g, lengths[a:b]), size) * kept
                gradient[size:-1] += g @ extra[a:b]
                gradient[-1] += g.sum()
                value += float(weight[a:b] @ np.logaddexp(0, np.where(y[a:b] == 1, -z, z)))
            return value, gradient

        w = descend(loss, np.zeros(size + extra.shape[1] + 1), steps)
        self.sparse, self.dense, self.bias = w[:size], w[size:-1], float(w[-1])
        return self

    def logit(self, index: np.ndarray, offsets: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return np.clip(_sums(self.sparse[index], offsets) + extra @ self.dense + self.bias, -30, 30)


def _blocks(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `most` features each (one longer row stands alone)."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, end
        at = end


def fit_chain(index: np.ndarray, offsets: np.ndarray, targets: np.ndarray, folds: np.ndarray, bits: int = BITS):
    """Models in order, and the threshold on the last category with the best F1 out of fold."""
    n = len(offsets) - 1
    earlier = np.zeros((n, 0))
    models, held = [], np.zeros(n)
    for k in range(targets.shape[1]):
        y, held = targets[:, k], np.zeros(n)
        for fold in np.unique(folds):
            test = folds == fold
            model = Linear(1 << bits, k).fit(index, offsets, earlier, y, ~test)
            for a, b in _blocks(offsets):
                own = model.logit(index[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], earlier[a:b])
                held[a:b] = np.where(test[a:b], own, held[a:b])
        models.append(Linear(1 << bits, k).fit(index, offsets, earlier, y))
        earlier = np.column_stack((earlier, held))
    y = targets[:, -1]
    if not 0 < y.sum() < n:
        return models, 1.0
    order = np.argsort(-held, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, n + 1) + y.sum())
    best = int(np.argmax(f1))
    after = held[order[best + 1]] if best + 1 < n else held[order[best]] - 1
    return models, float(_sigmoid((held[order[best]] + after) / 2))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = SAMPLE, folds: int = FOLDS) -> tuple[list[Linear], float]:
    """Fit the chain on at most `sample` labelled documents, those with the smallest id hash. An id that several
    rows share gives one of them, the least text; labels without a document don't count.

    `categories`: name -> SQL condition over the label columns, in chain order; a null condition
    counts as not in the category. Repeated label rows of a document count once (the largest).
    """
    rows = labels.where("doc_id is not null").groupBy("doc_id").agg(
        *[F.max(F.coalesce(F.expr(sql).cast("int"), F.lit(0))).alias(f"y{k}") for k, sql in enumerate(categories.values())])
    rows = rows.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id").limit(sample)
    # at most `sample` short rows by construction, so sending them to every executor is bounded
    picked = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id", "at", *[f"y{k}" for k in range(len(categories))]).agg(F.min("text").alias("text"))
    names = [f"y{k}" for k in range(len(categories))]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                values, offsets = features(part.column("text"))
                values = values.astype(np.uint32)
                blobs = [values[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("at"), pa.array(blobs, pa.binary()), *[part.column(c) for c in names]], ["at", "words", *names])

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at", "words"], kind="stable")
        parts = [np.frombuffer(b, np.uint32) for b in frame["words"]]
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        models, threshold = fit_chain(np.concatenate(parts), offsets, frame[names].to_numpy(float), frame["at"].to_numpy() % folds)
        return pd.DataFrame({"k": range(len(models)), "weights": [m.sparse.astype(np.float32).tobytes() for m in models],
                             "dense": [m.dense.tolist() for m in models], "bias": [m.bias for m in models], "threshold": threshold})

    found = (picked.mapInArrow(vectors, "at long, words binary, " + ", ".join(f"{c} int" for c in names))
             .groupBy().applyInPandas(fitted, "k int, weights binary, dense array<double>, bias double, threshold double")
             .orderBy("k").collect())
    models = []
    for k in range(len(categories)):
        model = Linear(1 << BITS, k)
        if found:
            model.sparse = np.frombuffer(found[k]["weights"], np.float32).astype(float)
            model.dense, model.bias = np.array(found[k]["dense"], float), found[k]["bias"]
        else:
            model.bias = -30.0
        models.append(model)
    return models, found[0]["threshold"] if found else 1.0


def score(docs: DataFrame, models: list[Linear], threshold: float, categories: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per document: `keep` (default doc_id), ``p_<category>`` for each, ``rejected``.

    Whole texts are read. Null and empty texts have no words and get the intercepts' probabilities,
    never rejected. Repeated rows are scored each. Extra columns do no harm.
    """
    spark = docs.sparkSession
    keep = keep or ["doc_id"]
    sent = spark.sparkContext.broadcast([(m.sparse.astype(np.float32), m.dense, m.bias) for m in models])  # 2**BITS floats each
    schema = docs.select(*keep).schema
    text = docs.select(*keep, F.col("text").alias("text__")) if "text" in keep else docs.select(*keep, F.col("text").alias("text__"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = []
        for sparse, dense, bias in sent.value:
            model = Linear(0, 0)
            model.sparse, model.dense, model.bias = sparse, dense, bias
            chain.append(model)
        for batch in batches:
            for part in W.slices(batch, "text__"):
                index, offsets = features(part.column("text__"))
                index = index.astype(np.int64)
                earlier = np.zeros((part.num_rows, 0))
                for model in chain:
                    earlier = np.column_stack((earlier, model.logit(index, offsets, earlier)))
                p = _sigmoid(earlier)
                rejected = (p[:, -1] >= threshold) & (np.diff(offsets) > 0)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], *[pa.array(p[:, k]) for k in range(len(chain))], pa.array(rejected)],
                    [*keep, *[f"p_{c}" for c in categories], "rejected"])

    for c in categories:
        schema = schema.add(f"p_{c}", "double")
    return text.mapInArrow(scored, schema.add("rejected", "boolean"))


#: chain order over the label table: general quality first, toxicity last
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Train on the labelled documents and score every document; empty tables give empty results."""
    models, threshold = train(docs, labels, CATEGORIES)
    return score(docs, models, threshold, list(CATEGORIES), keep)
