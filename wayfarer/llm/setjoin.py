"""Exact similarity joins of shingle sets, for documents and lines.

A node is a distinct shingle set, named by its fingerprint, so copies fold where they are read. No pair of nodes
is ever a row:

1. `scan` reads the texts once: every piece's node, size and signature (a parity bit map of its tokens), and the tokens each
   task sees most. Their counts order the tokens by rarity; all others count as rare, by fingerprint. Any total order keeps the join exact.
2. Two sets of Jaccard >= t share a token among the first |x| - ceil(t|x|) + 1 of each. Those prefix tokens
   are shuffled in packed form; entries without a partner that passes the length and the positional filter go (`members`).
3. Nodes of one token meet with their signatures: two sets differ in at least as many tokens as their parity maps
   differ in bits, an exact filter. What passes all filters is joined to groups inside the task and leaves it as one edge a node
   (`candidates`); contraction gives the connected candidates.
4. The whole sets of a connected candidate group are gathered once, into one task, and verified there. A group over `NODES` or `TOKENS`
   is cut into slices: each slice meets the first one, then what may still change meets every slice.

A token or group of any size is so cut into blocks of bounded size, and what leaves a task is linear in what entered it.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.llm import words as W
from wayfarer.llm.base import stage
from wayfarer.operators.ordering import placed

THRESHOLD = (3, 4)  #: Jaccard as numerator and denominator, so tests stay in integers
FREQUENT = 1 << 17  #: tokens whose counts order the sets; all others count as rare
LOCAL = 1 << 14  #: tokens one task reports as frequent, those it saw most
ENTRIES = 1 << 19  #: prefix tokens of a bucket
HOT = 1 << 16  #: occurrences above which a token's entries are dealt over buckets
CLOSE = 1024  #: entries of a token up to which each is held against each by size and place
SMALL = 64  #: members up to which a token's pairs are formed side by side with those of other tokens
BLOCK = 4096  #: members of one token in a slice
NODES, TOKENS = 4096, 4_000_000  #: of a slice of a connected candidate group
FILTER_BITS = 1 << 27  #: bound of the bit maps that keep unneeded sets from being read and shuffled
SLICE = 2 << 20  #: bytes of text that are parted at once
I64 = np.int64

Pieces = Callable[[pa.Array], tuple[pa.Array, np.ndarray]]


def need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap of sets of these sizes at the threshold: ceil(t (a + b) / (1 + t))."""
    p, q = THRESHOLD
    return -(-(p * (a + b)) // (p + q))


def prefix_length(n: np.ndarray) -> np.ndarray:
    p, q = THRESHOLD
    return n + (-(p * n) // q) + 1


def admissible(x: np.ndarray, y: np.ndarray, behind_x: np.ndarray, behind_y: np.ndarray) -> np.ndarray:
    """The length and the positional filter. At the first token two sets share they can still overlap by
    the smaller number of tokens from it on."""
    p, q = THRESHOLD
    return (q * np.minimum(x, y) >= p * np.maximum(x, y)) & (np.minimum(behind_x, behind_y) >= need(x, y))


def with_partner(tokens: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which entries, sorted by token, have another of their token that passes `admissible`. Tokens of more
    than `CLOSE` entries keep all of them: the signatures see to those."""
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, I64)
    counts = np.diff(np.append(starts, len(tokens)))
    behind = sizes - places
    out = np.zeros(len(tokens), bool)
    two = starts[counts == 2]
    good = admissible(sizes[two], sizes[two + 1], behind[two], behind[two + 1])
    out[two[good]] = out[two[good] + 1] = True
    for a, n in zip(starts[counts > 2].tolist(), counts[counts > 2].tolist()):
        if n > CLOSE:
            out[a : a + n] = True
            continue
        at = np.arange(a, a + n)
        grid = admissible(sizes[at, None], sizes[None, at], behind[at, None], behind[None, at])
        np.fill_diagonal(grid, False)
        out[at] = grid.any(axis=1)
    return out


def set_nodes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A fingerprint of each row's set (as signed 64-bit), 0 for empty ones."""
    n = np.diff(offsets)
    total = np.concatenate((np.zeros(1, W.U64), np.cumsum(W.mix(values ^ W.U64(0x5851F42D4C957F2D)))))  # wraps, as fingerprints may
    out = W.mix(total[offsets[1:]] - total[offsets[:-1]] + n.astype(W.U64) * W.U64(0x9E3779B97F4A7C15))
    return np.where(n > 0, out.view(I64), 0)


def text_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct five-word shingles of each text."""
    w = W.words(column)
    return W.row_sets(*W.shingles(w.hashes, w.offsets))


def signatures(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bit maps, as bytes with row offsets: bit (token mod w) of a row is 1 if an odd number of its tokens fall on it.
    w is the power of two at or above the set's size, 64 at least, so wider maps fold onto narrower ones by XOR of their halves."""
    n = np.diff(offsets)
    width = np.maximum(64, np.left_shift(1, np.ceil(np.log2(np.maximum(n, 1))).astype(I64)))
    bounds = np.concatenate(([0], np.cumsum(width)))
    out = np.empty(bounds[-1] // 8, np.uint8)
    for a, b in _runs(width, 1 << 19):  # counters are 64 times as wide as their bits
        row = np.repeat(np.arange(a, b), n[a:b])
        at = bounds[row] - bounds[a] + (values[offsets[a] : offsets[b]] & (width[row] - 1).astype(W.U64)).astype(I64)
        odd = np.bincount(at, minlength=bounds[b] - bounds[a]) & 1
        out[bounds[a] // 8 : bounds[b] // 8] = np.packbits(odd.astype(np.uint8), bitorder="little")
    return out, bounds // 8


def whole(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Each text as its only piece."""
    return column, np.ones(len(column), I64)


class _Counter:
    """The tokens a task sees most, with their counts; twice in one fold at least."""

    def __init__(self) -> None:
        self.tokens, self.counts, self.waiting, self.size = np.zeros(0, W.U64), np.zeros(0, I64), [], 0

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(values)
        self.size += len(values)
        if self.size > 1_000_000:
            self.fold()

    def fold(self) -> None:
        if not self.waiting:
            return
        u, c = np.unique(np.concatenate(self.waiting), return_counts=True)
        u, c = np.concatenate((self.tokens, u[c > 1])), np.concatenate((self.counts, c[c > 1]))
        u, inverse = np.unique(u, return_inverse=True)
        c = np.bincount(inverse, c, len(u)).astype(I64)
        if len(u) > 4 * LOCAL:
            best = np.argpartition(-c, 4 * LOCAL)[: 4 * LOCAL]
            u, c = u[best], c[best]
        self.tokens, self.counts, self.waiting, self.size = u, c, [], 0

    def top(self) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        best = np.argsort(-self.counts, kind="stable")[:LOCAL]
        return self.tokens[best], self.counts[best]


def scan(docs: DataFrame, pieces: Pieces = whole, empty: bool = False) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows (doc_id, key, piece, node, n, sig) of the pieces of `docs` (doc_id, text) that have words (`empty`: of all);
    `key` is the text's hash, pieces count from 0. And at most `FREQUENT` tokens, least frequent first, with counts."""
    names = ["doc_id", "key", "piece", "node", "n", "sig", "token", "seen"]
    schema = "doc_id long, key long, piece long, node long, n long, sig binary, token long, seen long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            for part in W.slices(batch, "text", SLICE):
                texts, counts = pieces(part.column("text"))
                values, offsets = text_sets(texts)
                counter.add(values)
                n = np.diff(offsets)
                rows = np.repeat(np.arange(len(counts)), counts)
                number = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
                some = np.flatnonzero(n > 0) if not empty else np.arange(len(n))
                signs, bounds = signatures(values, offsets)
                raw = signs.tobytes()
                sigs = pa.array([raw[a:b] for a, b in zip(bounds[some].tolist(), bounds[some + 1].tolist())], pa.binary())
                blank = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(pa.array(rows[some])) for c in ("doc_id", "key")], pa.array(number[some]), pa.array(set_nodes(values, offsets)[some]), pa.array(n[some]), sigs, blank, blank], names)
        tokens, seen = counter.top()
        if len(tokens):
            blank = pa.nulls(len(tokens), pa.int64())
            yield pa.RecordBatch.from_arrays([blank] * 5 + [pa.nulls(len(tokens), pa.binary()), pa.array(tokens.view(I64)), pa.array(seen)], names)

    found = stage(docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, schema), "scanned")
    counts = found.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen"))
    top = counts.orderBy(F.desc("seen"), "token").limit(FREQUENT).toPandas().sort_values(["seen", "token"])  # bounded
    return found.where("token is null").drop("token", "seen"), top["token"].to_numpy(I64).view(W.U64), top["seen"].to_numpy(I64)


def members(docs: DataFrame, pieces: Pieces, frequent: np.ndarray, seen: np.ndarray, entries: int) -> DataFrame:
    """Staged rows (token, node, n, place) of the prefix entries that have a partner."""
    buckets = max(1, -(-entries // ENTRIES))
    order = np.argsort(frequent)
    sent = docs.sparkSession.sparkContext.broadcast((frequent[order], (order + 1).astype(np.int32), seen[order]))  # FREQUENT tokens at most
    blob = "bucket int, tokens binary, nodes binary, sizes binary, places binary"

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank_of, seen_of = sent.value
        waiting: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            tokens, nodes, sizes, places = (np.concatenate(x) for x in zip(*waiting))
            to = tokens % W.U64(buckets)
            if len(known):  # a hot token's entries are dealt by node over the buckets behind its own
                at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                hot = np.flatnonzero((known[at] == tokens) & (seen_of[at] > HOT))
                spread = (seen_of[at[hot]] // (HOT // 2)).astype(W.U64)
                to[hot] = (to[hot] + W.mix(nodes[hot].view(W.U64)) % spread) % W.U64(buckets)
            bucket = to.astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            tokens, nodes, sizes, places, bucket = tokens[by], nodes[by], sizes[by], places[by], bucket[by]
            used, begins = np.unique(bucket, return_index=True)
            cuts = list(zip(begins.tolist(), [*begins[1:].tolist(), len(bucket)]))
            yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (tokens, nodes, sizes, places)]], ["bucket", "tokens", "nodes", "sizes", "places"])

        for batch in batches:
            for part in W.slices(batch, "text", SLICE):
                values, offsets = text_sets(pieces(part.column("text"))[0])
                n = np.diff(offsets)
                nodes = set_nodes(values, offsets)
                _, first = np.unique(nodes, return_index=True)  # copies in this slice fold here
                mine = np.zeros(len(nodes), bool)
                mine[first] = True
                mine &= n > 0
                rows = W.row_index(offsets)
                keep = mine[rows]
                values, rows = values[keep], rows[keep]
                if not len(values):
                    continue
                rank = np.zeros(len(values), np.int32)
                if len(known):
                    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
                    hit = known[place] == values
                    rank[hit] = rank_of[place[hit]]
                if rank.any():  # values ascend in a row, so a stable sort by rank and row leaves rare ones by fingerprint
                    by = np.argsort(rows * (len(known) + 1) + rank, kind="stable")
                    values = values[by]
                starts = np.concatenate(([0], np.cumsum(np.where(mine, n, 0))))[rows]
                place = np.arange(len(values)) - starts
                inside = place < prefix_length(n)[rows]
                waiting.append((values[inside], nodes[rows[inside]], n[rows[inside]].astype(np.int32), place[inside].astype(np.int32)))
                held += int(inside.sum())
                if held > ENTRIES:
                    yield from flush()
                    waiting, held = [], 0
        if waiting:
            yield from flush()

    def partnered(frame: pd.DataFrame) -> pd.DataFrame:
        known, _, seen_of = sent.value
        tokens, nodes, sizes, places = (np.concatenate([np.frombuffer(b, kind) for b in frame[c]]) for c, kind in (("tokens", W.U64), ("nodes", I64), ("sizes", np.int32), ("places", np.int32)))
        by = np.lexsort((nodes, tokens))
        tokens, nodes, sizes, places = tokens[by], nodes[by], sizes[by].astype(I64), places[by].astype(I64)
        keep = np.ones(len(tokens), bool)
        keep[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
        tokens, nodes, sizes, places = tokens[keep], nodes[keep], sizes[keep], places[keep]
        left = with_partner(tokens, sizes, places)
        if len(known):  # a dealt token's partners may be in other buckets
            at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
            left |= (known[at] == tokens) & (seen_of[at] > HOT)
        return pd.DataFrame({"token": tokens[left].view(I64), "node": nodes[left], "n": sizes[left], "place": places[left]})

    packed = docs.select("text").mapInArrow(prefixes, blob)
    return stage(packed.groupBy("bucket").applyInPandas(partnered, "token long, node long, n long, place long"), "members")


class _Signs:
    """Signatures of a run of members, compared in whole 64-bit words."""

    def __init__(self, column: pa.Array, sizes: np.ndarray) -> None:
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, I64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        self.words, self.starts, self.width = raw.view(W.U64), (bounds[:-1] - bounds[0]) // 8, np.diff(bounds) // 8
        self.sizes = sizes

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the members a[i] and b[i] may reach the threshold: parity maps that differ in more bits than the sets may
        differ in tokens rule it out."""
        out = np.zeros(len(a), bool)
        narrow, wide = np.minimum(self.width[a], self.width[b]), np.maximum(self.width[a], self.width[b])
        for shape in np.unique(narrow * (1 << 32) + wide).tolist():
            w, v = shape >> 32, shape & 0xFFFFFFFF
            mine = np.flatnonzero((narrow == w) & (wide == v))
            step = max(1, (1 << 18) // v)
            for k in range(0, len(mine), step):
                some = mine[k : k + step]
                maps = [self._folded(x[some], w) for x in (a, b)]
                apart = np.bitwise_count(maps[0] ^ maps[1]).sum(axis=1, dtype=I64)
                x, y = self.sizes[a[some]], self.sizes[b[some]]
                out[some] = apart <= x + y - 2 * need(x, y)
        return out

    def _folded(self, at: np.ndarray, width: int) -> np.ndarray:
        found = np.zeros((len(at), width), W.U64)
        for own in np.unique(self.width[at]).tolist():
            mine = self.width[at] == own
            for k in range(0, own, width):
                found[mine] ^= self.words[self.starts[at[mine], None] + np.arange(k, k + width)]
        return found


def linked_members(starts: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, places: np.ndarray, signs: _Signs) -> tuple[np.ndarray, np.ndarray]:
    """Edges (leader, member) that connect, within each run of members from `starts`, what passes all filters pairwise."""
    counts = np.diff(np.append(starts, len(nodes)))
    behind = sizes - places
    label = np.arange(len(nodes))

    def passing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        good = np.flatnonzero((nodes[a] != nodes[b]) & admissible(sizes[a], sizes[b], behind[a], behind[b]))
        return good[signs.close(a[good], b[good])]

    few = counts <= SMALL
    inside = np.repeat(few, counts)
    after = np.where(inside, np.repeat(starts + counts, counts) - 1 - np.arange(len(nodes)), 0)
    bounds = np.append(starts, len(nodes))
    for first, last in _runs(np.where(few, counts * (counts - 1) // 2, 0), 1 << 18):  # whole runs of members
        begin, end = int(bounds[first]), int(bounds[last])
        a = np.repeat(np.arange(begin, end), after[begin:end])
        ends = np.cumsum(after[begin:end])
        b = a + 1 + np.arange(len(a)) - np.repeat(ends - after[begin:end], after[begin:end])
        good = passing(a, b)
        a, b = a[good], b[good]
        while True:
            lower = label.copy()
            np.minimum.at(lower, a, label[b])
            np.minimum.at(lower, b, label[a])
            lower = lower[lower]
            if (lower == label).all():
                break
            label = lower
    for s, n in zip(starts[~few].tolist(), counts[~few].tolist()):
        left = np.arange(s, s + n)
        while len(left):  # grow one group from the least member that has none
            seed, queue, left = left[0], [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                hit = np.zeros(len(left), bool)
                hit[passing(np.full(len(left), x), left)] = True
                found = left[hit]
                label[found] = seed
                queue.extend(found.tolist())
                left = left[~hit]
    some = np.flatnonzero(label != np.arange(len(label)))
    return nodes[label[some]], nodes[some]


def _runs(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about `most` in total weight."""
    total = np.concatenate(([0], np.cumsum(weights)))
    at = 0
    while at < len(weights):
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield at, end
        at = end


def grouped(rows: DataFrame, keys: list[str], then: list[str], work: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str, most: int = 16 << 20) -> DataFrame:
    """Deal `rows` by `keys`, sort by `keys` and `then`, and give `work` tables of whole groups with the groups' first rows; a table holds about
    `most` bytes, and one group at least."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        held = 0

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            return work(table, _starts(table, keys))

        for batch in batches:
            if not batch.num_rows:
                continue
            load = batch.nbytes
            if held + load > most and kept:
                # the last group may go on, so only what stands before it is given away
                table = pa.Table.from_batches([*kept, batch]).combine_chunks()
                last = int(_starts(table, keys)[-1])
                if last:
                    yield flush(table.slice(0, last).to_batches())
                kept = table.slice(last).to_batches()
                held = sum(b.nbytes for b in kept) if last else held + load
                continue
            kept.append(batch)
            held += load
        if kept:
            yield flush(kept)

    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *then).mapInArrow(run, schema)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        x = table[key].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def linked_targets(nodes: np.ndarray, sizes: np.ndarray, places: np.ndarray, signs: _Signs, target: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (target, member) that join each target to every group (`known` labels) with a member that passes all filters, in one run of members."""
    behind = sizes - places
    _, label = np.unique(known, return_inverse=True)
    a, b = [], []
    for x in np.flatnonzero(target).tolist():
        other = np.flatnonzero(label != label[x])
        other = other[admissible(sizes[x], sizes[other], behind[x], behind[other])]
        other = other[signs.close(np.full(len(other), x), other)]
        found, first = np.unique(label[other], return_index=True)
        a += [x] * len(found)
        b += other[first].tolist()
        label[np.isin(label, found)] = label[x]
    return nodes[np.array(a, I64)], nodes[np.array(b, I64)]


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.column_stack((np.minimum(a, b), np.maximum(a, b))).view("i8,i8").ravel()) if len(a) else np.zeros(0, "i8,i8")
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[f])) for f in ("f0", "f1")], ["a", "b"])


def candidates(entries: DataFrame, signs: DataFrame) -> DataFrame:
    """Staged edges (a, b) that connect all nodes which pass the filters pairwise. `entries` as from `members`, `signs` is (node, sig).

    The entries of a token with more than `BLOCK` are cut into slices by node. First each slice meets the first one, which joins what is
    near a common leader; then the members outside their token's largest group meet every slice. Of two members in
    different groups one is outside the largest, so nothing is missed, and a large group of near copies costs rows in proportion to its size.
    """
    size = entries.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK)
    big = stage(size.select("token", F.ceil(F.col("size") / BLOCK).cast("int").alias("slices")), "big")
    cut = entries.join(big, "token", "left").withColumn("own", F.when(F.col("slices").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")))
    place = F.when(F.col("own") == 0, F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)).otherwise(F.array("own"))

    def work(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        node, n, at = (table[c].to_numpy().astype(I64) for c in ("node", "n", "place"))
        return _edges(*linked_members(starts, node, n, at, _Signs(table["sig"].combine_chunks(), n)))

    first = cut.select("token", F.explode(place).alias("j"), "node", "n", "place").join(signs, "node")
    edges = stage(grouped(first, ["token", "j"], ["node"], work, "a long, b long").distinct(), "candidates")
    if big.isEmpty():
        return edges
    labels = components(None, edges)
    known = stage(cut.where("slices is not null").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "known")
    most = known.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("most"))
    hungry = stage(known.join(most, "token").where("label <> most").drop("most"), "hungry")
    if hungry.isEmpty():
        return edges
    # blocks of one slice (i) and the hungry members of another (j); a hungry member of the same slice is there once, as a target
    every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    targets = hungry.withColumns({"j": F.col("own"), "target": F.lit(True)}).withColumn("i", every)
    base = known.withColumnRenamed("own", "i").join(hungry.select("token", F.col("own").alias("j")).distinct(), "token").withColumn("target", F.lit(False))
    base = base.join(hungry.select("token", "node", F.col("own").alias("i"), F.lit(True).alias("also")), ["token", "node", "i"], "left").where("also is null or i <> j")
    columns = ["token", "i", "j", "node", "n", "place", "label", "target"]

    def again(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        node, n, at, label = (table[c].to_numpy().astype(I64) for c in ("node", "n", "place", "label"))
        target, sig = table["target"].to_numpy(zero_copy_only=False), table["sig"].combine_chunks()
        found = [linked_targets(node[s:e], n[s:e], at[s:e], _Signs(sig.slice(s, e - s), n[s:e]), target[s:e], label[s:e]) for s, e in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows])]
        return _edges(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))

    more = grouped(targets.select(*columns).unionByName(base.select(*columns)).join(signs, "node"), ["token", "i", "j"], ["node"], again, "a long, b long")
    return stage(edges.unionByName(more).distinct(), "candidates")


def components(state: DataFrame | None, links: DataFrame) -> DataFrame:
    """Fold `links` (a, b) into `state` (node, label; nodes without a row are their own label) by
    repeated contraction: every label hangs itself on its least neighbour, and links are renamed."""
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = nodes.withColumn("label", F.col("node")) if state is None else nodes.join(state, "node", "full").select("node", F.coalesce("label", "node").alias("label"))
    labels = stage(labels, "labels")

    def renamed(edges: DataFrame, table: DataFrame) -> DataFrame:
        left, right = table.select(F.col("node").alias("a"), F.col("label").alias("x")), table.select(F.col("node").alias("b"), F.col("label").alias("y"))
        return edges.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    edges = stage(links.where("a <> b") if state is None else renamed(links, labels), "edges")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
        jump = stage(up.join(up.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label")), "jump")
        labels = stage(labels.join(jump.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
        edges = stage(renamed(edges, jump), "edges")
    return labels


def _flags(keys: DataFrame) -> tuple[np.ndarray, int]:
    """A bit map of a column of hashes, of bounded size; where it fills up, more than the keys pass."""
    keys = keys.toDF("k")
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(15, (32 * keys.count()).bit_length()))
    # the functions number bits from 1
    mapped = keys.select((F.pmod("k", F.lit(bits)) + 1).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("map")).collect()
    flags = np.zeros(max(4096, bits // 8), np.uint8)
    for row in mapped:
        k = (row["k"] - 1) * 4096
        flags[k : k + 4096] = np.frombuffer(row["map"], np.uint8)
    return flags, bits


def sets_of(docs: DataFrame, pieces: Pieces, wanted: DataFrame) -> DataFrame:
    """(node, tokens binary) of all nodes in `wanted` (node, key: the hash of a text that holds it), one row each. Only texts
    that pass a bit map of the keys are parted again, and few unwanted sets pass that of the nodes."""
    sent = docs.sparkSession.sparkContext.broadcast([_flags(wanted.select("key").distinct()), _flags(wanted.select("node"))])

    def marked(flags: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
        at = (hashes.view(W.U64) & W.U64(flags[1] - 1)).astype(I64)
        return ((flags[0][at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(marked(sent.value[0], batch.column("key").to_numpy())))
            for part in W.slices(batch, "text", SLICE):
                values, offsets = text_sets(pieces(part.column("text"))[0])
                nodes = set_nodes(values, offsets)
                hit = marked(sent.value[1], nodes) & (np.diff(offsets) > 0)
                _, first = np.unique(nodes, return_index=True)
                rows = [k for k in np.sort(first).tolist() if hit[k]]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[rows]), pa.array([values[offsets[k] : offsets[k + 1]].tobytes() for k in rows], pa.binary())], ["node", "tokens"])

    found = docs.select(F.xxhash64("text").alias("key"), "text").mapInArrow(gather, "node long, tokens binary")
    return found.groupBy("node").agg(F.first("tokens").alias("tokens"))


def sliced(groups: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame | None]:
    """`groups` (node, label, n, ...) as those that fit a task, and the others staged with `slice` (by the total order `order` within the
    group, the first slice first) and `slices`."""
    size = groups.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("load"))
    size = stage(size.where("size > 1").withColumn("slices", F.ceil(F.greatest(F.col("size") / NODES, F.col("load") / TOKENS))), "sizes")
    few = groups.join(size.where("slices <= 1").select("label"), "label")
    large = size.where("slices > 1")
    if large.isEmpty():
        return few, None
    rows = placed(groups.join(large, "label"), "label", *order, "node")
    rows = rows.join(rows.groupBy("label").agg(F.min("position").alias("start")), "label")
    per = F.ceil(F.col("size") / F.col("slices"))
    return few, stage(rows.withColumn("slice", F.floor((F.col("position") - F.col("start")) / per).cast("int")).drop("position", "start", "size", "load"), "slices")


def met(rows: DataFrame, sets: DataFrame, order: list[str], work: Callable, schema: str) -> DataFrame:
    """Give `work(sets, known, target, fields)` each block of `rows` (label, i, j, node, target, known, ...) with its whole sets, sorted
    by `order`: a list of token arrays, the labels known before, which of them are targets, and the other columns as arrays."""
    names = schema.split(", ")

    def each(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        tokens = table["tokens"].to_pylist()
        fields = {c: table[c].to_numpy() for c in ["node", "known", *order]}
        target = table["target"].to_numpy(zero_copy_only=False)
        found: list[list[np.ndarray]] = [[] for _ in names]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
            out = work([np.frombuffer(t, W.U64) for t in tokens[a:b]], target[a:b], {c: v[a:b] for c, v in fields.items()})
            for column, values in zip(found, out):
                column.append(values)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, I64)) for c in found], [n.split(" ")[0] for n in names])

    columns = list(dict.fromkeys(["label", "i", "j", "node", "target", "known", *order]))
    return grouped(rows.select(*columns).join(sets, "node"), ["label", "i", "j"], order, each, schema)


def blocks(large: DataFrame, hungry: DataFrame | None = None, earlier: bool = False) -> DataFrame:
    """The blocks of sliced groups. Without `hungry` each slice meets the first; with it, the hungry
    rows of each slice (marked as targets) meet every slice, or with `earlier` those between the first and their own."""
    if hungry is None:
        first = large.where("slice = 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("target", F.col("j") == 0)
        rest = large.where("slice > 0").withColumns({"j": F.col("slice").cast("long"), "target": F.lit(True)})
        return first.unionByName(rest).withColumn("i", F.lit(0)).drop("slice")
    low, high = (1, F.col("slice") - 1) if earlier else (0, (F.col("slices") - 1).cast("int"))
    some = hungry.where("slice > 1") if earlier else hungry
    some = some.withColumns({"j": F.col("slice").cast("long"), "target": F.lit(True)}).withColumn("i", F.explode(F.sequence(F.lit(low), high)))
    base = large.withColumnRenamed("slice", "i").join(some.select("label", "i", "j").distinct(), ["label", "i"]).withColumn("target", F.lit(False))
    # a hungry row of the same slice is there as a target already
    base = base.join(some.select("node", "i", "j").withColumn("also", F.lit(True)), ["node", "i", "j"], "left").where("also is null").drop("also")
    return base.unionByName(some.drop("slice"))


def _postings(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inverted lists of the tokens that several sets hold: owners in ascending order, bounds of the lists, and the lists of each set with bounds."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    counts = np.diff(np.append(starts, len(flat)))
    keep = np.repeat(counts > 1, counts)
    owner, counts = owner[keep], counts[counts > 1]
    bounds = np.concatenate(([0], np.cumsum(counts)))
    back = np.argsort(owner, kind="stable")
    lists = np.repeat(np.arange(len(counts)), counts)[back]
    return owner, bounds, lists, np.searchsorted(owner[back], np.arange(len(sets) + 1))


def join_by_occurrence(sets: list[np.ndarray], target: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Group labels after linking each target with all that reach the threshold, by T-occurrence search (DivideSkip).

    A target's inverted lists, rid of members of its own group, are divided: the longest are set aside, the short ones merged
    through a heap; what they give often enough is looked up in the long lists by binary search until it reaches
    the overlap it needs or can't. Found members' groups become one.
    """
    sizes = np.array([len(s) for s in sets], I64)
    owner, bounds, lists, ends = _postings(sets)
    _, label = np.unique(known, return_inverse=True)
    p, q = THRESHOLD
    for x in np.flatnonzero(target).tolist():
        mine = lists[ends[x] : ends[x + 1]]
        # two targets are tested when the first of them is up
        open_ = (label != label[x]) & (~target | (np.arange(len(sets)) > x)) & (q * np.minimum(sizes, sizes[x]) >= p * np.maximum(sizes, sizes[x]))
        if not open_.any():
            continue
        least = int(need(sizes[x], sizes[open_]).min())
        found = [row for k in mine.tolist() if len(row := owner[bounds[k] : bounds[k + 1]][open_[owner[bounds[k] : bounds[k + 1]]]])]
        if len(found) < least:
            continue
        found.sort(key=len)
        spare = min(len(found), least - 1, int(least / (0.0085 * np.log2(max(2, len(found[-1]))) + 1)))
        short, long = found[: len(found) - spare], [row.tolist() for row in found[len(found) - spare :][::-1]]
        enough = least - len(long)

        def settle(y: int, have: int) -> None:
            if have < enough or label[y] == label[x]:
                return
            goal = int(need(sizes[x], sizes[y]))
            for done, row in enumerate(long):
                if have >= goal or have + len(long) - done < goal:
                    break
                at = bisect_left(row, y)
                have += at < len(row) and row[at] == y
            if have >= goal:
                label[label == label[y]] = label[x]

        last, count = -1, 0
        for y in heapq.merge(*[row.tolist() for row in short]):
            if y != last:
                if count:
                    settle(last, count)
                last, count = y, 0
            count += 1
        if count:
            settle(last, count)
    return label


def matched_earlier(sets: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Which targets reach the threshold with a set before them, by counting shared tokens."""
    sizes = np.array([len(s) for s in sets], I64)
    owner, bounds, lists, ends = _postings(sets)
    out = np.zeros(len(sets), bool)
    for x in np.flatnonzero(target).tolist():
        mine = lists[ends[x] : ends[x + 1]]
        if x and len(mine):
            shared = np.concatenate([owner[bounds[k] : bounds[k + 1]] for k in mine.tolist()])
            have = np.bincount(shared[shared < x], minlength=x)
            out[x] = (have >= need(sizes[x], sizes[:x])).any()
    return out


def prefix_entries(nodes: DataFrame) -> int:
    """Prefix tokens of all `nodes` (n)."""
    return nodes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * THRESHOLD[0] / THRESHOLD[1]) + 1)).first()[0] or 0
