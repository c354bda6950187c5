"""Hierarchical multi-length packing of tokenised documents.

Documents go to the smallest of several context sizes (tiers) that holds them; what exceeds the
largest is cut into full windows of it first. Each tier is packed by itself, longest documents
first; gaps of a longer tier's windows are filled with documents of shorter tiers, cut where the
gap ends. Every window is therefore full, its length a power of two, but for what remains at the end
of a task, which is cut into powers of two too: no sequence needs padding. Windows of one size form
step groups of equal tokens, dealt so that the groups' attention costs are near each other.

Tokenising and packing happen in the task that reads the rows, so nothing is shuffled. A task packs
pools of `POOL` tokens at a time, which bounds its memory.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm import words as W

TIERS = (512, 1024, 2048, 4096)
POOL = 1 << 20  #: tokens packed together
STEP = 1 << 16  #: tokens of a step group
CACHED = 600_000  #: words a worker remembers the ids of
_ENCODERS: dict = {}
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")
#: byte-level vocabularies write each byte as a visible sign: bytes without one are numbered from 256
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


class WordEncoder:
    """Ids by the tokenizers library, word by word.

    The vocabulary drops white space and never merges across it, so a text's ids are those of its
    words in turn; each distinct word is encoded once while it is remembered.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.n, self.ids = np.zeros(0, W.U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _ids_of(self, texts: list[str]) -> list[list[int]]:
        """Ids of distinct words. Plain Latin letters with at most one mark behind them need no normaliser and
        split in one known way, so they go to the model at once; the rest takes the tokenizer's whole path."""
        tokenize, found, rest = self.tokenizer.model.tokenize, [], []
        for k, text in enumerate(texts):
            if plain := PLAIN.fullmatch(text):
                ids = [t.id for t in tokenize(plain[1].lower().encode().decode("latin-1").translate(BYTE_SIGNS))]
                found.append(ids + [t.id for t in tokenize(plain[2])] if plain[2] else ids)
            else:
                found.append([])
                rest.append(k)
        for k in range(0, len(rest), 20_000):
            some = rest[k : k + 20_000]
            for j, e in zip(some, self.tokenizer.encode_batch_fast([texts[j] for j in some], add_special_tokens=False)):
                found[j] = e.ids
        return found

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each row and the row offsets."""
        w = W.words(column, fold=False)  # case tells special tokens' strings from others
        distinct, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHED:
            self._forget()
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != distinct
        if new.any():
            raw = w.data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist())]
            found = self._ids_of(texts)
            n = np.array([len(f) for f in found], np.int64)
            flat = np.fromiter((i for f in found for i in f), np.uint32, int(n.sum()))
            at = len(self.ids) + np.concatenate(([0], np.cumsum(n)))[:-1]
            self.ids = np.concatenate((self.ids, flat))
            self.known = np.insert(self.known, place[new], distinct[new])
            self.at, self.n = np.insert(self.at, place[new], at), np.insert(self.n, place[new], n)
            place = np.searchsorted(self.known, distinct)
        lengths = self.n[place][inverse]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        take = np.arange(ends[-1]) + np.repeat(self.at[place][inverse] - ends[:-1], lengths)
        return self.ids[take], ends[w.offsets]


class Packer:
    """Windows from pieces (document row, start, length). Every token ends in exactly one window."""

    def __init__(self, tiers: tuple[int, ...]) -> None:
        self.tiers = tiers
        self.queues = [deque() for _ in tiers]

    def add(self, row: int, length: int) -> None:
        start, top = 0, self.tiers[-1]
        while length - start > top:
            self.queues[-1].append((row, start, top))
            start += top
        rest = length - start
        self.queues[next(k for k, size in enumerate(self.tiers) if rest <= size)].append((row, start, rest))

    def windows(self, last: bool) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(size, pieces) of each window. Unless `last`, what can't fill a window is left waiting."""
        queues = [deque(sorted(q, key=lambda p: (-p[2], p[0], p[1]))) for q in self.queues]
        for k in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[k]
            total = sum(p[2] for q in queues[: k + 1] for p in q)
            while queues[k] and total >= size:
                room, pieces = size, []
                held: list = []
                while queues[k] and room:  # the tier's own documents, whole
                    if queues[k][0][2] <= room:
                        p = queues[k].popleft()
                    elif queues[k][-1][2] <= room:
                        p = queues[k].pop()
                    else:
                        break
                    pieces.append(p)
                    room -= p[2]
                for low in range(k - 1, -1, -1):  # shorter tiers fill the gap, whole where they fit
                    while room and queues[low] and queues[low][0][2] <= room:
                        p = queues[low].popleft()
                        pieces.append(p)
                        room -= p[2]
                if room:  # and one document is cut where the gap ends
                    source = next(q for q in [*reversed(queues[:k]), queues[k]] if q)
                    row, start, n = source.popleft()
                    pieces.append((row, start, room))
                    held.append((row, start + room, n - room))
                    room = 0
                for p in held:
                    queues[next(j for j, tier in enumerate(self.tiers) if p[2] <= tier)].append(p)
                total -= size
                yield size, pieces
        self.queues = queues
        if last:
            rest = deque(p for q in queues for p in q)
            total = sum(p[2] for p in rest)
            while total:
                size = min(self.tiers[-1], 1 << (total.bit_length() - 1))
                room, pieces = size, []
                while room:
                    row, start, n = rest.popleft()
                    took = min(n, room)
                    pieces.append((row, start, took))
                    if took < n:
                        rest.appendleft((row, start + took, n - took))
                    room -= took
                total -= size
                yield size, pieces
            self.queues = [deque() for _ in self.tiers]


def step_groups(sizes: np.ndarray, costs: np.ndarray, step: int) -> np.ndarray:
    """A group for each window: windows of one size, `step` tokens a group, costs dealt to and fro."""
    out, used = np.zeros(len(sizes), np.int64), 0
    for size in np.unique(sizes)[::-1]:
        members = np.flatnonzero(sizes == size)
        groups = max(1, round(len(members) * int(size) / step))
        order = members[np.argsort(-costs[members], kind="stable")]
        turn = np.arange(len(order)) % (2 * groups)
        out[order] = used + np.where(turn < groups, turn, 2 * groups - 1 - turn)
        used += groups
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, pool: int = POOL) -> DataFrame:
    """Return one row per piece: doc_id, start, `ids` (little-endian unsigned 32-bit), length,
    doc_tokens, sequence_id, offset, window (the sequence's length), step_group.

    Null and empty texts are the end id alone. Repeated rows are packed each; doc_id may be null;
    other columns are ignored. Ids of sequences follow from the reading task and the order there,
    so a task that runs again gives the same.
    """
    rows = docs.select("doc_id", F.col("text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer_path)
        base = TaskContext.get().partitionId() << 40
        packer, store, waiting = Packer(tiers), {}, 0
        count = sequences = groups = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, groups, waiting
            made = list(packer.windows(last))
            if made:
                sizes = np.array([size for size, _ in made])
                costs = np.array([sum(p[2] ** 2 for p in pieces) for _, pieces in made], float)
                group = step_groups(sizes, costs, STEP)
                for k in range(0, len(made), 256):
                    out: list[list] = [[] for _ in range(9)]
                    for j, (size, pieces) in enumerate(made[k : k + 256], k):
                        offset = 0
                        for row, start, n in pieces:
                            doc, ids = store[row]
                            for column, value in zip(out, (doc, start, ids[start : start + n].tobytes(), n, len(ids), base + sequences + j, offset, size, base + groups + int(group[j]))):
                                column.append(value)
                            offset += n
                    kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 6]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], NAMES)
                sequences += len(made)
                groups += int(group.max()) + 1
            left = {p[0] for q in packer.queues for p in q}
            for row in [r for r in store if r not in left]:
                del store[row]
            waiting = sum(p[2] for q in packer.queues for p in q)

        for batch in batches:
            for part in W.slices(batch, "text", 2 << 20):
                ids, offsets = encoder.encode(part.column("text"))
                for doc, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    own = np.empty(b - a + 1, "<u4")
                    own[:-1], own[-1] = ids[a:b], end_id
                    store[count] = (doc, own)
                    packer.add(count, len(own))
                    count += 1
                    waiting += len(own)
                if waiting >= pool:
                    yield from flush(False)
        yield from flush(True)

    return rows.mapInArrow(packed, "doc_id long, start long, ids binary, length long, doc_tokens long, sequence_id long, offset long, window long, step_group long")


NAMES = ["doc_id", "start", "ids", "length", "doc_tokens", "sequence_id", "offset", "window", "step_group"]
