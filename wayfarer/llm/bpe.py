"""Byte-level BPE encoding and decoding by tree concatenation.

A text longer than `LEAF` characters is halved until its parts fit; the parts are rows of their own
that tasks encode in parallel. Neighbouring parts are then joined pairwise, up the tree. A join
re-encodes a window around the seam. Between two places where a letter, a space and a letter meet,
the pre-tokenizer splits whatever stands elsewhere, so a window that ends there on both sides
settles the join. Where text has no such place for long (one unbroken run), the window grows token
by token until its first and last tokens are those the two sides already had: every neighbouring
pair of tokens is then one that BPE itself would leave apart, which makes the whole sequence the
encoding of the joined run. Runs inside one task go through the same tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm import words as W

LEAF = 1 << 16  #: characters of a part
RUN = 4096  #: bytes of an unbroken run encoded in one go
SPECIAL = "<|endoftext|>"
_CODECS: dict = {}


class Codec:
    """One vocabulary: `ranks` as tiktoken reads them, and the special token's id."""

    def __init__(self, ranks_path: str, pattern: str, special_id: int) -> None:
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern)
        self.long_run = regex.compile(r"\p{L}{%d}|\p{N}{%d}|[^\s\p{L}\p{N}]{%d}|\s{%d}" % ((RUN // 4,) * 4))
        self.gap = regex.compile(r"\p{L} \p{L}")
        self.token_bytes = {i: b for b, i in ranks.items()}
        self.width = np.zeros(max(self.token_bytes) + 1, np.int64)
        for i, b in self.token_bytes.items():
            self.width[i] = len(b)
        self.special_id = special_id

    @classmethod
    def of(cls, *key) -> "Codec":
        """The worker's copy, loaded once."""
        if key not in _CODECS:
            _CODECS[key] = cls(*key)
        return _CODECS[key]

    def encode(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        if not self.long_run.search(text):
            return self.core.encode_ordinary(text)
        out: list[int] = []
        for piece in self.pieces.finditer(text):
            out += self.encode_run(piece[0].encode())
        return out

    def encode_run(self, run: bytes) -> list[int]:
        """Ids of one pre-token, however long."""
        if len(run) <= RUN:
            return self.core._encode_single_piece(run)
        half = len(run) // 2
        return self.join_run(self.encode_run(run[:half]), self.encode_run(run[half:]))

    def join_run(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of a run from those of its two halves."""
        size = 4
        while True:
            a, b = left[-size:], right[:size]
            seam = self.core._encode_single_piece(b"".join(self.token_bytes[i] for i in (*a, *b)))
            agree_left = size >= len(left) or seam[0] == a[0]
            agree_right = size >= len(right) or seam[-1] == b[-1]
            if agree_left and agree_right:
                return left[: max(0, len(left) - size)] + seam + right[size:]
            size *= 2

    def _tail(self, ids: list[int], n: int) -> int | None:
        """How many ids from the end make `n` bytes; None if none do."""
        for k, i in enumerate(reversed(ids)):
            if n <= 0:
                return k if n == 0 else None
            n -= int(self.width[i])
        return len(ids) if n == 0 else None

    def join(self, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
        """Text and ids of two neighbouring texts, from theirs."""
        (a, x), (b, y) = left, right
        if not a or not b:
            return a + b, x + y
        size = 64
        while True:  # grow until both ends are at a gap, or the text ends
            start = next((m.start() + 1 for m in reversed(list(self.gap.finditer(a, max(0, len(a) - size))))), None)
            stop = (m := self.gap.search(b, 0, size)) and m.start() + 1
            if (start or size >= len(a)) and (stop or size >= len(b)):
                break
            size *= 2
        start, stop = start or 0, stop or len(b)
        seam = next(((m.start(), m.end()) for m in self.pieces.finditer(a + b, start) if m.end() >= len(a)), None)
        if seam and seam[0] < len(a) < seam[1] and seam[1] - seam[0] >= RUN // 4:
            ours, theirs = a[seam[0] :], b[: seam[1] - len(a)]
            first = self.pieces.match(b)
            keep = self._tail(x, len(ours.encode()))
            lead = self._head(y, len(theirs.encode()))
            if first and first.end() == len(theirs) and keep and lead:
                return a + b, x[: len(x) - keep] + self.join_run(x[len(x) - keep :], y[:lead]) + y[lead:]
        keep, lead = self._tail(x, len(a[start:].encode())), self._head(y, len(b[:stop].encode()))
        if keep is None or lead is None:
            return a + b, self.encode(a + b)
        return a + b, x[: len(x) - keep] + self.encode(a[start:] + b[:stop]) + y[lead:]

    def _head(self, ids: list[int], n: int) -> int | None:
        for k, i in enumerate(ids):
            if n <= 0:
                return k if n == 0 else None
            n -= int(self.width[i])
        return len(ids) if n == 0 else None

    def tree(self, parts: list[tuple[str, list[int]]]) -> tuple[str, list[int]]:
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else ("", [])

    def encode_text(self, text: str) -> list[int]:
        """Ids of a whole text; its special tokens' strings become their id."""
        out: list[int] = []
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                out.append(self.special_id)
            out += self.encode(part)
        return out

    def decode(self, ids: np.ndarray) -> str:
        out, special = [], SPECIAL.encode()
        at = 0
        for stop in [*np.flatnonzero(ids == self.special_id).tolist(), len(ids)]:
            out.append(self.core.decode_bytes(ids[at:stop].tolist()))
            if stop < len(ids):
                out.append(special)
            at = stop + 1
        return b"".join(out).decode("utf-8", "replace")


def halves(text: str, most: int = LEAF) -> list[str]:
    """`text` halved until every part has at most `most` characters."""
    if len(text) <= most:
        return [text]
    half = len(text) // 2
    return halves(text[:half], most) + halves(text[half:], most)


def encode(docs: DataFrame, ranks_path: str, pattern: str, special_id: int, leaf: int = LEAF) -> DataFrame:
    """Return doc_id, `ids` (array of int) and `decoded` (the ids' text) for every row of `docs`.

    Null and empty texts have no ids and decode to an empty text. Repeated rows are encoded each;
    other columns are ignored. `ranks_path`, `pattern`, `special_id`: the vocabulary.
    """
    key = (ranks_path, pattern, special_id)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, ids array<int>, decoded string"

    def batch_of(doc_ids: pa.Array, ids: list[np.ndarray], decoded: list[str]) -> pa.RecordBatch:
        offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
        values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(offsets, pa.array(values)), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(*key)
        for batch in batches:
            for part in W.slices(batch, "text", 2 << 20):
                ids = [np.array(codec.encode_text(t), np.int32) for t in part.column("text").to_pylist()]
                yield batch_of(part.column("doc_id"), ids, [codec.decode(i) for i in ids])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*[batch.column(c).to_pylist() for c in ("row", "doc_id", "text")]):
                parts = [(s, p) for s, section in enumerate(text.split(SPECIAL)) for p in halves(section, leaf)]
                for k in range(0, len(parts), 16):
                    some = parts[k : k + 16]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(some), pa.int64()), pa.array([doc] * len(some), pa.int64()), pa.array(range(k, k + len(some)), pa.int32()),
                         pa.array([s for s, _ in some], pa.int32()), pa.array([p for _, p in some], pa.string())], ["row", "doc_id", "part", "section", "text"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(*key)
        for batch in batches:
            ids = [np.array(codec.encode(t), np.int32).tobytes() for t in batch.column("text").to_pylist()]
            yield batch.append_column("ids", pa.array(ids, pa.binary()))

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        codec = Codec.of(*key)
        out: list[int] = []
        for section, group in frame.sort_values("part").groupby("section", sort=True):
            if section:
                out.append(codec.special_id)
            out += codec.tree([(t, np.frombuffer(i, np.int32).tolist()) for t, i in zip(group["text"], group["ids"])])[1]
        return pd.DataFrame({"doc_id": [frame["doc_id"].iloc[0]], "ids": [out], "decoded": [codec.decode(np.array(out, np.int64))]}).astype({"doc_id": "Int64"})

    short = rows.where(F.length("text") <= leaf).mapInArrow(whole, schema)
    # the row number is fixed by the scan; it keeps repeated doc_ids apart
    parts = (rows.where(F.length("text") > leaf).withColumn("row", F.monotonically_increasing_id())
             .mapInArrow(cut, "row long, doc_id long, part int, section int, text string").repartition("row", "part"))
    long = parts.mapInArrow(leaves, "row long, doc_id long, part int, section int, text string, ids binary").groupBy("row").applyInPandas(joined, schema)
    return short.unionByName(long)
