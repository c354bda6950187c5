"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted arrays, memory-mapped for scoring.

Words are known by 64-bit fingerprints. The range of fingerprints is cut into shards, one for each
partition of the corpus, so the model grows with the corpus and no task holds more than a shard of it.

1. Vocabulary: tasks count the tokens they read, counts are merged by shard, and every shard is written as a
   sorted array of fingerprints with counts. A word's id is its place in the whole order.
2. Bigrams: tasks count pairs of ids, merged by the first word's shard and written as sorted
   second ids under each first one, with counts and the first word's totals. Continuation counts of
   second words are merged by their shard.
3. Scoring: workers map the files and look up each distinct pair of a block by binary search.

Files lie in the shared folder of the session, which has to be a path workers can open; they are
written aside and renamed, so a task that runs again does no harm.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm import words as W
from wayfarer.llm.base import shared_path

END = np.uint64(0x1F83D9ABFB41BD6B)
BEGIN = np.uint64(0x9B05688C2B3E6C1F)
TOKENS = 1_500_000  #: tokens counted together
_MAPS: dict = {}


class Model(NamedTuple):
    folder: str
    offsets: np.ndarray  #: first id of each shard, and the number of ids
    train_tokens: int
    vocabulary: int  #: distinct training tokens
    discounts: np.ndarray  #: by count 1, 2, 3 and more
    low_discounts: np.ndarray
    low_total: float  #: distinct bigrams
    low_spare: float  #: weight of the uniform distribution


def _save(path: str, array: np.ndarray) -> None:
    aside = f"{path}.{uuid.uuid4().hex}"
    array.tofile(aside)
    os.replace(aside, path)


def _map(path: str, kind) -> np.ndarray:
    if path not in _MAPS:
        if len(_MAPS) > 4096:
            _MAPS.clear()
        _MAPS[path] = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    return _MAPS[path]


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> W.U64(32)) * W.U64(shards) >> W.U64(32)).astype(np.int64)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each text's words and its end, and row offsets."""
    w = W.words(column)
    rows = len(w.offsets) - 1
    return np.insert(w.hashes, w.offsets[1:], END), w.offsets + np.arange(rows + 1)


def _fold(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def ids_of(hashes: np.ndarray, folder: str, offsets: np.ndarray) -> np.ndarray:
    """Ids of sorted distinct fingerprints, -1 for unknown ones."""
    shards = len(offsets) - 1
    out = np.full(len(hashes), -1, np.int64)
    cuts = np.searchsorted(_shard(hashes, shards), np.arange(shards + 1))
    for s in range(shards):
        a, b = cuts[s], cuts[s + 1]
        if a == b or offsets[s] == offsets[s + 1]:
            continue
        known = _map(f"{folder}/words-{s}", W.U64)
        place = np.searchsorted(known, hashes[a:b])
        place[place == len(known)] = 0
        out[a:b] = np.where(known[place] == hashes[a:b], place + offsets[s], -1)
    return out


def _pairs(hashes: np.ndarray, offsets: np.ndarray, folder: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the word before and of each token."""
    codes, distinct = pd.factorize(hashes)
    distinct = np.asarray(distinct, W.U64)
    by = np.argsort(distinct)
    ids = np.empty(len(distinct) + 1, np.int64)
    ids[by] = ids_of(distinct[by], folder, starts)
    ids[-1] = ids_of(np.array([BEGIN]), folder, starts)[0]
    token = ids[codes]
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[offsets[:-1][np.diff(offsets) > 0]] = ids[-1]
    return before, token


def _discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts from how many n-grams occur 1, 2, 3 and 4 times; 0.5, 1 and 1.5
    where those don't give any."""
    if (n[:4] > 0).all():
        y = n[0] / (n[0] + 2 * n[1])
        d = np.array([k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)])
        if ((d > 0) & (d < [1, 2, 3])).all():
            return d
    return np.array([0.5, 1.0, 1.5])


def _less(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts, 0 for none."""
    return np.where(counts > 0, counts - np.concatenate(([0], d))[np.minimum(counts, 3).astype(np.int64)], 0.0)


def _narrow(x: np.ndarray, what: str) -> np.ndarray:
    """As 32 bits, which ids and pair counts are stored in; more raises, nothing wraps."""
    if len(x) and int(x.max()) >= 1 << 32:
        raise OverflowError(f"{what} {int(x.max())} times or more, beyond 32 bits")
    return x.astype(np.uint32)


def fit(docs: DataFrame) -> Model:
    """Count the model over all rows of `docs` (text; null is empty). Without rows all words are unknown.

    Word counts are 64-bit. Over 2 ** 32 distinct words, or occurrences of one pair of words, raise."""
    spark = docs.sparkSession
    folder = shared_path(spark, "lm")
    text = docs.select("text")
    shards = max(1, text.rdd.getNumPartitions())

    def packed(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray, split: bool) -> pa.RecordBatch:
        """One row for each shard of ascending keys."""
        used, begins = np.unique(shard, return_index=True)
        cuts = list(zip(begins.tolist(), [*begins[1:].tolist(), len(shard)]))
        parts = ((keys >> W.U64(32)).astype(np.uint32), keys.astype(np.uint32)) if split else (keys, np.zeros(len(keys), np.uint8)[:0])
        rows = [pa.array([(x[a:b] if len(x) else x).tobytes() for a, b in cuts], pa.binary()) for x in (*parts, counts.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *rows], ["shard", "high", "low", "counts"])

    blob = "shard int, high binary, low binary, counts binary"

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.array([BEGIN])], [np.zeros(1, np.int64)]
        held = 0
        for batch in batches:
            for part in W.slices(batch, "text"):
                codes, distinct = pd.factorize(tokens_of(part.column("text"))[0])
                keys.append(np.asarray(distinct, W.U64))
                counts.append(np.bincount(codes, minlength=len(distinct)))
                held += len(distinct)
                if held > TOKENS:
                    k, c = _fold(keys, counts)
                    if len(k) > TOKENS // 2:
                        yield packed(k, c, _shard(k, shards), False)
                        keys, counts, held = [], [], 0
                    else:
                        keys, counts, held = [k], [c], len(k)
        if keys:
            k, c = _fold(keys, counts)
            yield packed(k, c, _shard(k, shards), False)

    def write_words(frame: pd.DataFrame) -> pd.DataFrame:
        os.makedirs(folder, exist_ok=True)
        s = int(frame["shard"].iloc[0])
        k, c = _fold([np.frombuffer(x, W.U64) for x in frame["high"]], [np.frombuffer(x, np.uint32) for x in frame["counts"]])
        _save(f"{folder}/words-{s}", k)
        _save(f"{folder}/counts-{s}", c.astype(np.uint64))
        return pd.DataFrame({"shard": [s], "ids": [len(k)], "tokens": [int(c.sum())], "distinct": [int((c > 0).sum())]})

    sizes = text.mapInArrow(count_words, blob).groupBy("shard").applyInPandas(write_words, "shard int, ids long, tokens long, distinct long").collect()  # a row a shard
    ids = np.zeros(shards, np.int64)
    for row in sizes:
        ids[row["shard"]] = row["ids"]
    offsets = np.concatenate(([0], np.cumsum(ids)))
    _narrow(offsets[-1:], "distinct words number")
    total, distinct = sum(r["tokens"] for r in sizes), sum(r["distinct"] for r in sizes)

    def shard_of(word_ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(offsets, word_ids, side="right") - 1

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for part in W.slices(batch, "text"):
                before, token = _pairs(*tokens_of(part.column("text")), folder, offsets)
                k = (before.astype(W.U64) << W.U64(32)) | token.astype(W.U64)
                k.sort()
                first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                keys.append(k[first])
                counts.append(np.diff(np.append(first, len(k))))
                held += len(first)
                if held > 2 * TOKENS:
                    k, c = _fold(keys, counts)
                    yield packed(k, c, shard_of((k >> W.U64(32)).astype(np.int64)), True)
                    keys, counts, held = [], [], 0
        if keys:
            k, c = _fold(keys, counts)
            yield packed(k, c, shard_of((k >> W.U64(32)).astype(np.int64)), True)

    def write_pairs(frame: pd.DataFrame) -> pd.DataFrame:
        s = int(frame["shard"].iloc[0])
        k, c = _fold([(np.frombuffer(a, np.uint32).astype(W.U64) << W.U64(32)) | np.frombuffer(b, np.uint32).astype(W.U64) for a, b in zip(frame["high"], frame["low"])],
                     [np.frombuffer(x, np.uint32) for x in frame["counts"]])
        first = (k >> W.U64(32)).astype(np.int64) - offsets[s]
        second = k.astype(np.uint32)
        n = int(offsets[s + 1] - offsets[s])
        _save(f"{folder}/starts-{s}", np.searchsorted(first, np.arange(n + 1)).astype(np.int64))
        _save(f"{folder}/seconds-{s}", second)
        _save(f"{folder}/pairs-{s}", _narrow(c, "a pair of words occurs"))
        _save(f"{folder}/totals-{s}", np.column_stack([np.bincount(first, c, n), *[np.bincount(first[kind], minlength=n) for kind in (c == 1, c == 2, c > 2)]]).astype(np.float64))
        seen, times = np.unique(second, return_counts=True)
        target = shard_of(seen.astype(np.int64))
        used, begins = np.unique(target, return_index=True)
        cuts = list(zip(begins.tolist(), [*begins[1:].tolist(), len(target)]))
        own = [np.count_nonzero(c == j) for j in (1, 2, 3, 4)]
        return pd.DataFrame({"shard": used.astype(np.int32), "ids": [seen[a:b].tobytes() for a, b in cuts], "counts": [times[a:b].astype(np.uint32).tobytes() for a, b in cuts],
                             "n": [own if j == 0 else [0] * 4 for j in range(len(used))]})

    def write_low(frame: pd.DataFrame) -> pd.DataFrame:
        s = int(frame["shard"].iloc[0])
        counts = np.zeros(int(offsets[s + 1] - offsets[s]), np.uint32)
        for i, c in zip(frame["ids"], frame["counts"]):
            counts[np.frombuffer(i, np.uint32).astype(np.int64) - offsets[s]] += np.frombuffer(c, np.uint32)
        _save(f"{folder}/low-{s}", counts)
        return pd.DataFrame({"total": [int(counts.sum(dtype=np.int64))], "n": [np.sum(frame["n"].to_list(), axis=0).astype(np.int64).tolist()],
                             "low": [[int((counts == j).sum()) for j in (1, 2, 3, 4)] + [int((counts > 2).sum())]]})

    merged = (text.mapInArrow(count_pairs, blob).groupBy("shard").applyInPandas(write_pairs, "shard int, ids binary, counts binary, n array<long>")
              .groupBy("shard").applyInPandas(write_low, "total long, n array<long>, low array<long>").collect())  # a row a shard
    n = np.sum([r["n"] for r in merged], axis=0) if merged else np.zeros(4)
    low = np.sum([r["low"] for r in merged], axis=0) if merged else np.zeros(5)
    types = float(sum(r["total"] for r in merged))
    d = _discounts(low)
    spare = float(d @ [low[0], low[1], low[4]]) / types if types else 1.0
    return Model(folder, offsets, total, distinct, _discounts(n), d, types, spare)


def _low(model: Model, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-order probability and training count of each id."""
    p, count = np.full(len(token), model.low_spare / (model.vocabulary + 1)), np.zeros(len(token))
    distinct, inverse = np.unique(token, return_inverse=True)
    values, counts = np.zeros(len(distinct)), np.zeros(len(distinct))
    known = np.flatnonzero(distinct >= 0)
    shard = np.searchsorted(model.offsets, distinct[known], side="right") - 1
    for s in np.unique(shard).tolist():
        at = known[shard == s]
        place = distinct[at] - model.offsets[s]
        path = f"{model.folder}/low-{s}"
        if model.low_total and os.path.exists(path):
            values[at] = _less(_map(path, np.uint32)[place].astype(np.int64), model.low_discounts) / model.low_total
        counts[at] = _map(f"{model.folder}/counts-{s}", np.uint64)[place]
    return p + values[inverse], count + counts[inverse]


def probabilities(model: Model, before: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(token | before) and the tokens' training counts, by ids."""
    low, counts = _low(model, token)
    key = (before.astype(W.U64) << W.U64(32)) | (token & 0xFFFFFFFF).astype(W.U64)
    order = np.argsort(key)  # neighbours in the files are looked up together
    high, weight = np.zeros(len(key)), np.ones(len(key))
    b, t = before[order], token[order]
    shard = np.searchsorted(model.offsets, b, side="right") - 1
    shard[b < 0] = -1
    for s in np.unique(shard).tolist():
        if s < 0 or not os.path.exists(f"{model.folder}/starts-{s}"):
            continue
        at = np.flatnonzero(shard == s)
        starts, seconds = _map(f"{model.folder}/starts-{s}", np.int64), _map(f"{model.folder}/seconds-{s}", np.uint32)
        place = b[at] - model.offsets[s]
        totals = _map(f"{model.folder}/totals-{s}", np.float64).reshape(-1, 4)[place]
        lo, hi = starts[place].copy(), starts[place + 1].copy()
        stop = hi.copy()
        wanted = np.where(t[at] >= 0, t[at], 0xFFFFFFFF)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = seconds[mid] < wanted[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        hit = np.flatnonzero((lo < stop) & (t[at] >= 0))
        hit = hit[seconds[lo[hit]] == wanted[hit]]
        c = np.zeros(len(at), np.int64)
        c[hit] = _map(f"{model.folder}/pairs-{s}", np.uint32)[lo[hit]]
        seen = totals[:, 0] > 0
        whole = np.where(seen, totals[:, 0], 1.0)
        high[order[at]] = _less(c, model.discounts) / whole
        weight[order[at]] = np.where(seen, totals[:, 1:] @ model.discounts / whole, 1.0)
    return high + weight * low, counts


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """`keep`, n_tokens, n_known, base_score and score of every row; null texts are empty (their end is scored).
    Repeated rows are scored each; other columns are ignored."""
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text__"):
                hashes, offsets = tokens_of(part.column("text__"))
                p, counts = probabilities(model, *_pairs(hashes, offsets, model.folder, model.offsets))
                base = np.log10((counts + 0.1) / (model.train_tokens + 0.1 * (model.vocabulary + 1)))
                sums = [np.add.reduceat(x, offsets[:-1]) for x in (counts > 0, base, np.log10(p))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(np.diff(offsets)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                                                 [*keep, "n_tokens", "n_known", "base_score", "score"])

    return docs.select(*keep, F.col("text").alias("text__")).mapInArrow(run, schema)
