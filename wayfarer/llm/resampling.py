"""Importance resampling towards a target distribution over hashed word runs.

1. Both corpora are counted into `buckets` counters, an array per task; the arrays add up in Spark.
2. The gain of every bucket is a fixed array of whole numbers, and a document's weight the sum of its features' gains,
   read from that array where the text is read.
3. A keyed exponential race (weight plus Gumbel noise from a hash of the id) turns the weighted draw without replacement
   into a top share of scores. Its cutoff is bracketed by a quantile sketch; exact counts outside the bracket validate
   it or widen it; only the bracket's rows are sorted to find the last one drawn.

A word is a run of bytes a-z, 0-9 and 0x80 up, A-Z lower-cased first. Counts, weights and scores cover all rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.llm import words as W
from wayfarer.llm.base import stage
from wayfarer.operators.ordering import placed

BUCKETS = 10_000
SEED = 2024
ACCURACY = 10_000  #: of the quantile sketch
MARGINS = (2 / ACCURACY, 16 / ACCURACY, 128 / ACCURACY, 1.0)  #: of the brackets tried, around the wanted share; the last is everything
LONG_WORD = 64  #: bytes above which a word's checksum is taken by itself

ALPHABET = W.LETTERS.copy()
ALPHABET[48:58] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _feed(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes data[start:end], all words side by side, a byte at a time."""
    lengths = ends - starts
    by = np.argsort(-lengths, kind="stable")
    out, first = state[by], starts[by]
    falling = -lengths[by]
    for k in range(min(LONG_WORD, int(lengths.max(initial=0)))):
        n = int(np.searchsorted(falling, -k, side="left"))  # words longer than k bytes
        head = out[:n]
        out[:n] = _CRC[(head ^ data[first[:n] + k]) & 0xFF] ^ (head >> np.uint32(8))
    for j in range(int(np.searchsorted(falling, -LONG_WORD, side="left"))):
        rest = data[first[j] + LONG_WORD : first[j] - falling[j]].tobytes()
        out[j] = zlib.crc32(rest, int(out[j]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[by] = out
    return back


def features(column: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features of each text, row offsets into them, and the words of each text."""
    w = W.words(column, ALPHABET)
    data = _LOWER[w.data]
    counts = np.diff(w.offsets)
    row = W.row_index(w.offsets)
    state = _feed(np.full(len(row), 0xFFFFFFFF, np.uint32), data, w.starts, w.ends)
    found, rows = [state], [row]
    left = w.offsets[1:][row] - np.arange(len(row))  # words of the row from here on
    at = np.arange(len(row))
    for length in range(2, longest + 1):
        some = left[at] >= length
        at, state = at[some], found[-1][some]
        state = _CRC[(state ^ np.uint32(32)) & 0xFF] ^ (state >> np.uint32(8))
        last = at + length - 1
        found.append(_feed(state, data, w.starts[last], w.ends[last]))
        rows.append(row[at])
    flat, rows = np.concatenate(found), np.concatenate(rows)
    by = np.argsort(rows, kind="stable") if longest > 1 else slice(None)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(counts)))))
    return ((flat[by] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64), bounds, counts


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of column `text` fall in each bucket, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in W.slices(batch, "text"):
                total += np.bincount(features(part.column("text"), longest, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of every bucket, in doubles."""
    size = len(source)
    s_all, t_all = float(int(source.sum()) + size), float(int(target.sum()) + size)
    return np.array([math.floor(1000 * math.log(((t + 1.0) * s_all) / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, longest: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; null and empty texts have no features and weight 0."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                found, bounds, words = features(part.column("text"), longest, len(gains))
                total = np.concatenate(([0], np.cumsum(gains[found])))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(words.astype(np.int64)), pa.array(np.diff(bounds)), pa.array(total[bounds[1:]] - total[bounds[:-1]])],
                    ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise from the first 32 bits of a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def bracket(rows: DataFrame, count: int, wanted: int) -> tuple[int, int, int]:
    """(low, high, above): score bounds that hold the `wanted`-th highest of `count` scores, and the exact number of
    scores above `high`. All brackets come from one sketch and are counted in one pass; the narrowest
    valid one is taken, and the widest, from the least to the greatest score, always is."""
    share = 1 - wanted / count
    edges = [min(1.0, max(0.0, share + side * m)) for m in MARGINS for side in (-1, 1)]
    found = rows.agg(F.percentile_approx("score", edges, ACCURACY).alias("cuts"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    tried = [(found["low"] if a <= 0 else lo, found["high"] if b >= 1 else hi) for a, b, lo, hi in zip(edges[::2], edges[1::2], found["cuts"][::2], found["cuts"][1::2])]
    tried[-1] = (found["low"], found["high"])
    counted = rows.agg(*[F.count(F.when(t, 1)).alias(f"{side}{k}") for k, (lo, hi) in enumerate(tried) for side, t in (("above", F.col("score") > hi), ("from", F.col("score") >= lo))]).first()
    for k, (lo, hi) in enumerate(tried):
        if counted[f"above{k}"] < wanted <= counted[f"from{k}"]:
            return lo, hi, counted[f"above{k}"]
    raise AssertionError("the widest bracket holds every score")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, n_features, weight, score, rank.

    Of the N rows with at least `least_words` words and a doc_id, the floor(`percent` * N / 100) highest scores are drawn;
    `rank` counts them from 1, ties to the smaller doc_id, and is null for all others. `target` has a column `text`.

    Null and empty texts have weight 0. A row without a doc_id counts as part of the corpus and is weighed, but has no
    noise: its score is null and it is never drawn. Rows that share a doc_id are rows of their own; those that also share the
    score are ranked by n_features, and equal rows in the order they were read. Other columns are ignored. An empty target or
    an empty corpus gives the smoothed gains, an empty corpus no rows.
    """
    gains = bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored = weighed(docs, gains, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    # what tells equal rows apart is written with them, so it stays the same in every later pass
    scored = stage(scored.withColumn("row__", F.monotonically_increasing_id()), "scored")
    fit = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    count = scored.where(fit).count()
    wanted = percent * count // 100
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select(*columns, none)
    low, high, above = bracket(scored.where(fit), count, wanted)
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("row__")]
    edge = placed(scored.where(fit & F.col("score").between(low, high)), *order).withColumn("rank", F.col("position") + above + 1)
    edge = edge.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    out = scored.where(~(fit & (F.col("score") >= low))).select(*columns, none).unionByName(edge.select(*columns, "rank"))
    if above:
        drawn = placed(scored.where(fit & (F.col("score") > high)), *order).withColumn("rank", F.col("position") + 1)
        out = out.unionByName(drawn.select(*columns, "rank"))
    return out
