"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Patterns are searched in every whole text. The field tags the tokens of each line as secret begin,
inside or outside, from their shape, the neighbouring words, the signs around them and features
of the file, and is decoded by Viterbi. It is fitted on a bounded sample in which the patterns'
own finds are the labels; since words around a find and shapes carry weights of their own, it also
tags secrets the patterns do not describe.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.llm import words as W
from wayfarer.llm.descent import descend

# Kinds in rank order, each with a search pattern, what a find must be, and a wider pattern that skips texts fast.
PATTERNS = {
    "assign": (re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
               lambda m: len(m[2]) >= 6, r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=]"""),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20, r"AKIA[A-Z0-9]{16}"),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24, r"[0-9a-f]{24}"),
}
FIELD = "crf"
KINDS = [*PATTERNS, FIELD]
OUT, BEGIN, INSIDE = 0, 1, 2
SAMPLE = 1000  #: documents with finds the field is fitted on at most, and as many without
BUCKETS = 4096  #: weights for neighbouring words, by hash
STEPS = 25
L2 = 1e-2

#: signs a token is made of; all others part tokens
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-", *range(128, 256)]] = True
_CLASS = {"digit": [*range(48, 58)], "upper": [*range(65, 91)], "hexletter": [*range(97, 103)], "lower": [*range(103, 123)]}
_MARK = np.zeros(256, np.int64)  # kinds of sign beside a token
for _k, _group in enumerate((b" ", b"\t\n\r", b"=", b":", b"\"'`", b"([{", b")]}", b",;", b"."), 1):
    _MARK[list(_group)] = _k
_LENGTHS = np.array([2, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64])
#: sizes of the feature groups, in order
SIZES = [12 * 16, 12 * 4 * 4 * 4, 12 * 6, BUCKETS, BUCKETS, 10 * 10, 8 * 5]
FEATURES = sum(SIZES)
_BASE = np.concatenate(([0], np.cumsum(SIZES)))[:-1]


class Tokens:
    """Tokens of a column with feature numbers (a row for each token) and their lines."""

    def __init__(self, column: pa.Array) -> None:
        w = W.words(column, _TOKEN)
        self.data, self.starts, self.ends, self.offsets = w.data, w.starts, w.ends, w.offsets
        n = len(w.starts)
        bounds = W.bytes_of(column)[1]
        self.row_start = bounds
        if not n:
            self.features, self.lines = np.zeros((0, len(SIZES)), np.int64), np.zeros(1, np.int64)
            return
        length = w.ends - w.starts
        share = []
        for signs in _CLASS.values():
            flags = np.zeros(256, np.int32)
            flags[signs] = 1
            total = np.concatenate(([0], np.cumsum(flags[w.data], dtype=np.int64)))
            share.append(total[w.ends] - total[w.starts])
            if not len(share) - 1:
                digits = total
        kind = np.zeros(256, np.int8)
        for k, signs in enumerate(_CLASS.values(), 1):
            kind[signs] = min(k, 3)
        signs = kind[w.data]
        turns = np.concatenate(([0], np.cumsum(np.concatenate(([0], signs[1:] != signs[:-1]))[: len(signs)], dtype=np.int64)))
        turn = turns[w.ends] - turns[np.minimum(w.starts + 1, w.ends)]
        size = np.searchsorted(_LENGTHS, length, side="right")
        digit, upper, hexa, lower = share
        present = (digit > 0) + 2 * (upper > 0) + 4 * ((hexa + lower) > 0) + 8 * (digit + upper + hexa + lower < length)
        part = lambda x: np.minimum(3, (4 * x) // np.maximum(1, length))
        rows = W.row_index(w.offsets)
        line_no = np.concatenate(([0], np.cumsum(w.data == 10, dtype=np.int64)))[w.starts]
        new = np.ones(n, bool)
        new[1:] = (line_no[1:] != line_no[:-1]) | (rows[1:] != rows[:-1])
        self.lines = np.append(np.flatnonzero(new), n)
        word = (w.hashes >> W.U64(52)).astype(np.int64)  # 12 bits: BUCKETS
        before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
        before[1:], after[:-1] = word[:-1], word[1:]
        before[new] = 0
        after[self.lines[1:] - 1] = 0
        mark = _MARK[w.data]
        left = np.where(w.starts > bounds[rows], mark[np.maximum(w.starts - 1, 0)], 2)
        right = np.where(w.ends < bounds[rows + 1], mark[np.minimum(w.ends, len(mark) - 1)], 2)
        text_size = np.minimum(7, np.log2(np.maximum(1, np.diff(bounds)) / 64 + 1)).astype(np.int64)
        text_digits = np.minimum(4, 40 * np.diff(digits[bounds]) // np.maximum(1, np.diff(bounds)))
        groups = (size * 16 + present, ((size * 4 + part(digit)) * 4 + part(upper)) * 4 + part(hexa + digit), size * 6 + np.minimum(5, (8 * turn) // np.maximum(1, length)),
                  before, after, left * 10 + right, (text_size * 5 + text_digits)[rows])
        self.features = np.column_stack(groups) + _BASE


def _emissions(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(features), 3), weights.dtype)
    for k in range(features.shape[1]):
        out += weights[features[:, k]]
    return out


def _steps(lines: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Lines side by side, longest first: (the lines still running, their number) for each place."""
    lengths = np.diff(lines)
    order = np.argsort(-lengths, kind="stable")
    running = np.searchsorted(-lengths[order], -np.arange(1, lengths.max() + 1), side="right") if len(lengths) else []
    for t, n in enumerate(running):
        yield lines[:-1][order[:n]] + t, n


def viterbi(emit: np.ndarray, lines: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Most probable tags; `moves[i, j]` from i to j, row 3 the start."""
    back = np.zeros((len(emit), 3), np.int8)
    best = np.zeros((len(emit), 3), emit.dtype)
    places = [at for at, _ in _steps(lines)]
    for t, at in enumerate(places):
        if t == 0:
            best[at] = moves[3] + emit[at]
        else:
            score = best[at - 1][:, :, None] + moves[None, :3, :]
            back[at] = score.argmax(1)
            best[at] = score.max(1) + emit[at]
    tags = np.zeros(len(emit), np.int8)
    ends = lines[1:] - 1
    tags[ends] = best[ends].argmax(1)
    for at in reversed(places[1:]):
        tags[at - 1] = back[at, tags[at]]
    return tags


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


NEVER = -1e4
_FORBIDDEN = np.zeros((4, 3), bool)
_FORBIDDEN[[OUT, 3], INSIDE] = True


def fit(features: np.ndarray, lines: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x 3) and moves (4 x 3) of greatest penalised likelihood."""
    shape = (FEATURES, 3)
    places = [at for at, _ in _steps(lines)]
    gold = np.zeros(shape)
    for k in range(features.shape[1]):
        np.add.at(gold, (features[:, k], tags), 1)
    gold_moves = np.zeros((4, 3))
    begins = np.zeros(len(tags), bool)
    begins[lines[:-1]] = True
    np.add.at(gold_moves, (np.where(begins, 3, np.concatenate(([0], tags[:-1]))), tags), 1)
    n = max(1, len(lines) - 1)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        weights, moves = w[: FEATURES * 3].reshape(shape), np.where(_FORBIDDEN, NEVER, w[FEATURES * 3 :].reshape(4, 3))
        emit = _emissions(features, weights)
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        for t, at in enumerate(places):
            alpha[at] = emit[at] + (moves[3] if t == 0 else _logsum(alpha[at - 1][:, :, None] + moves[None, :3], 1))
        z = _logsum(alpha[lines[1:] - 1], 1)
        for t in range(len(places) - 1, 0, -1):
            at = places[t]
            beta[at - 1] = _logsum(moves[None, :3] + (emit[at] + beta[at])[:, None, :], 2)
        whole = np.repeat(z, np.diff(lines))[:, None]
        p = np.exp(alpha + beta - whole)
        gradient = np.zeros(shape)
        for k in range(features.shape[1]):
            for state in range(3):
                gradient[:, state] += np.bincount(features[:, k], p[:, state], FEATURES)
        later = np.flatnonzero(~begins)
        pairs = np.exp(alpha[later - 1][:, :, None] + moves[None, :3] + (emit[later] + beta[later])[:, None, :] - whole[later][:, :, None]).sum(0)
        move_gradient = np.vstack((pairs, p[begins].sum(0))) - gold_moves
        move_gradient[_FORBIDDEN] = 0
        score = (weights * gold).sum() + (np.where(_FORBIDDEN, 0, moves) * gold_moves).sum()
        g = np.concatenate(((gradient - gold).ravel(), move_gradient.ravel())) / n + L2 / n * w
        return float((z.sum() - score) / n + L2 / n / 2 * w @ w), g

    w = descend(loss, np.zeros(FEATURES * 3 + 12), STEPS)
    return w[: FEATURES * 3].reshape(shape), np.where(_FORBIDDEN, NEVER, w[FEATURES * 3 :].reshape(4, 3))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' finds, in code points, by start and then kind."""
    found = [(m.start(), k, m.end()) for k, (pattern, holds, _) in enumerate(PATTERNS.values()) for m in pattern.finditer(text) if holds(m)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def _suspects(column: pa.Array) -> np.ndarray:
    """Texts in which some pattern may find something."""
    flags = np.zeros(len(column), bool)
    for _, _, wide in PATTERNS.values():
        flags |= pc.match_substring_regex(column, wide).fill_null(False).to_numpy(zero_copy_only=False)
    return flags


def _span_tags(tokens: Tokens, row: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tags of a row's tokens: the last token of each find (its secret part) begins it."""
    a, b = tokens.offsets[row], tokens.offsets[row + 1]
    tags = np.zeros(b - a, np.int8)
    starts, ends = tokens.starts[a:b] - tokens.row_start[row], tokens.ends[a:b] - tokens.row_start[row]
    for start, end in spans:
        inside = np.flatnonzero((starts >= start) & (ends <= end))
        if len(inside):
            tags[inside] = INSIDE
            tags[inside[0]] = BEGIN
    return tags


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """Fit the field on at most `sample` documents with finds and as many without, by least hash of
    the id; None where nothing was found (the scan then has the patterns alone)."""
    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_suspects(batch.column("text")))], ["doc_id", "suspect"])

    ids = docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(flag, "doc_id long, suspect boolean")
    ids = ids.withColumn("at", F.xxhash64("doc_id"))
    # 2 * sample ids at most, so sending them to every executor is bounded
    picked = ids.where("suspect").orderBy("at", "doc_id").limit(sample).union(ids.where("not suspect").orderBy("at", "doc_id").limit(sample))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id", "at").distinct()), "doc_id")

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", 1 << 20):
                column = part.column("text")
                tokens = Tokens(column)
                tags = np.zeros(len(tokens.starts), np.int8)
                for row, text in enumerate(column.to_pylist()):
                    spans = []
                    for pattern, holds, _ in PATTERNS.values():
                        for m in pattern.finditer(text):
                            if holds(m):
                                a, b = m.span(2) if pattern.groups else m.span()
                                spans.append((len(text[:a].encode()), len(text[:b].encode())))
                    if spans:
                        tags[tokens.offsets[row] : tokens.offsets[row + 1]] = _span_tags(tokens, row, spans)
                lines = tokens.lines
                hit = np.add.reduceat(tags > 0, lines[:-1]) if len(lines) > 1 else np.zeros(0, int)
                # every line with a find, and of the others every fifth and no more than 300 tokens: a bounded sample
                keep = [k for k in range(len(lines) - 1) if lines[k + 1] - lines[k] <= 2000 and (hit[k] or k % 5 == 0)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(lines[k]) for k in keep], pa.int64()),
                    pa.array([tokens.features[lines[k] : lines[k + 1]].astype(np.int32).tobytes() for k in keep], pa.binary()),
                    pa.array([tags[lines[k] : lines[k + 1]].tobytes() for k in keep], pa.binary())], ["line", "features", "tags"])

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tags", "features"], kind="stable")
        rows = [np.frombuffer(f, np.int32).reshape(-1, len(SIZES)) for f in frame["features"]]
        lines = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        tags = np.frombuffer(b"".join(frame["tags"]), np.int8).astype(np.int64)
        if not len(tags) or not tags.any():
            return pd.DataFrame({"weights": [], "moves": []}).astype({"weights": object, "moves": object})
        weights, moves = fit(np.concatenate(rows).astype(np.int64), lines, tags)
        return pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()], "moves": [moves.astype(np.float32).tobytes()]})

    found = texts.select("text").mapInArrow(lines_of, "line long, features binary, tags binary").groupBy().applyInPandas(fitted, "weights binary, moves binary").collect()
    if not found:
        return None
    return np.frombuffer(found[0]["weights"], np.float32).reshape(FEATURES, 3), np.frombuffer(found[0]["moves"], np.float32).reshape(4, 3)


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, keep: list[str] | None = None) -> DataFrame:
    """`keep` (default doc_id) and `spans` for every row: patterns' finds and, apart from them, the field's.

    Spans count code points, ends excluded, ordered by start and then kind. Null and empty texts have
    none. Repeated rows are scanned each; other columns are ignored.
    """
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x 3 weights
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            for part in W.slices(batch, "text__", 2 << 20):
                column = part.column("text__")
                spans: list[list] = [[] for _ in range(part.num_rows)]
                for row in np.flatnonzero(_suspects(column)).tolist():
                    spans[row] = base_spans(column[row].as_py())
                if field is not None:
                    for row, a, b in _tagged(column, *field):
                        if all(b <= start or end <= a for start, kind, end in spans[row] if kind != FIELD):
                            spans[row].append((a, FIELD, b))
                out = [[{"kind": k, "start": a, "end": b} for a, k, b in sorted(s, key=lambda x: (x[0], KINDS.index(x[1])))] for s in spans]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(out, struct)], [*keep, "spans"])

    return docs.select(*keep, F.col("text").alias("text__")).mapInArrow(scan, docs.select(*keep).schema.add("spans", docs.sparkSession.createDataFrame([], SPANS_SCHEMA).schema[0].dataType))


SPANS_SCHEMA = f"spans {SPANS}"


def _tagged(column: pa.Array, weights: np.ndarray, moves: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of what the field tags, in code points."""
    tokens = Tokens(column)
    if not len(tokens.starts):
        return
    tags = viterbi(_emissions(tokens.features, weights), tokens.lines, moves)
    begins = np.flatnonzero(tags == BEGIN)
    if not len(begins):
        return
    points = np.concatenate(([0], np.cumsum((tokens.data & 0xC0) != 0x80, dtype=np.int64)))
    rows = W.row_index(tokens.offsets)
    for k in begins.tolist():
        last = k
        while last + 1 < len(tags) and tags[last + 1] == INSIDE and rows[last + 1] == rows[k]:
            last += 1
        origin = points[tokens.row_start[rows[k]]]
        yield int(rows[k]), int(points[tokens.starts[k]] - origin), int(points[tokens.ends[last]] - origin)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """`text` with every span replaced; spans that overlap become one mask."""
    step = F.aggregate(
        spans, F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.struct(
            F.when(x["start"] >= s["at"], F.concat(s["done"], F.substring(text, s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int")), F.lit(mask))).otherwise(s["done"]).alias("done"),
            F.greatest(s["at"], x["end"]).alias("at")),
        lambda s: F.concat(s["done"], F.substring(text, s["at"].cast("int") + 1, F.length(text))))
    return F.when(F.size(spans) > 0, step).otherwise(text)
