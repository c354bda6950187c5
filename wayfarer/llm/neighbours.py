"""Approximate nearest neighbours: NN-descent in Spark, greedy search on the graph.

Equal vectors are folded first (a node of the graph is a distinct vector), so copies can't fill a
neighbour list. Nodes are dealt into shards of at most about `SHARD` nodes by hash, and every shard
gets a graph of its own, which bounds what one search task holds whatever the table's size; a query
visits all shards and the shards' results merge by exact distance. A search starts from so many nodes that
every node of the shard is within two links of one, however many parts the graph falls into.

Every row of the descent is a node with its vector, its K nearest so far and their vectors, or an
offer to a node. A round shuffles offers to the nodes they are for, joins them with the node's list,
compares the list's members with each other (neighbours of neighbours, at least one of them new)
and offers the closer ones to one another. Distances in the descent use copies of one byte a component;
the search ranks by distances of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.llm.base import stage
from wayfarer.llm.topk import finite_of

SHARD = 16_384  #: nodes of a graph
NODES = 2_048  #: nodes of a descent task
LINKS = 16  #: K
ROUNDS = 6
OFFERS = 2  #: best offers a node makes to each of its neighbours in a round
BEAM = 500  #: candidates a search keeps
EXPAND = 4  #: candidates a search expands at a time
ENTRIES = 64  #: nodes a search starts from at least
HOPS = 2  #: links between any node and the nearest start
QUERIES = 512
FAR = np.float32(np.inf)


def distinct_vectors(frame: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<double>, key): rows that take part, with the folded vector's key. Left out:
    null ids; vectors null, zero, holding null or non-finite components, or not of the most frequent length."""
    x = frame.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda v: v.cast("double") + F.lit(0.0)).alias("vector"))
    x = x.where("id is not null and vector is not null and size(vector) > 0").where(finite_of("vector")).where(F.exists("vector", lambda v: v != 0))
    size = x.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return x.where(F.size("vector") == (size["d"] if size else 0)).withColumn("key", F.sha2(F.array_join(F.col("vector").cast("array<string>"), ","), 256))


def _pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of each pair of stacked matrices."""
    d = (a**2).sum(-1)[..., :, None] + (b**2).sum(-1)[..., None, :] - 2 * (a @ np.swapaxes(b, -1, -2))
    return np.maximum(d, 0)


def squeeze(x: np.ndarray) -> np.ndarray:
    """Rows as bytes: components in 1/127 of the row's largest, and that scale."""
    scale = np.abs(x).max(axis=1, keepdims=True).astype(np.float32) / 127
    scale[scale == 0] = 1
    return np.concatenate((np.rint(x / scale).astype(np.int8).view(np.uint8), scale.view(np.uint8)), axis=1)


def spread(raw: np.ndarray) -> np.ndarray:
    """The rows that `squeeze` made bytes of, about."""
    scale = np.ascontiguousarray(raw[..., -4:]).view(np.float32)
    return np.ascontiguousarray(raw[..., :-4]).view(np.int8).astype(np.float32) * scale


SCHEMA = "shard int, node long, other long, distance float, worst float, vector binary, ids binary, distances binary, fresh binary, worsts binary, vectors binary"
_EMPTY = (None,) * 5


def _round(links: int, offers: int, last: bool):
    """One round over a partition that holds all rows of its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]  # about NODES nodes and what is offered to them
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        other = table["other"].to_numpy()
        own = np.flatnonzero(np.isnan(table["distance"].to_numpy()))
        node, shard = table["node"].to_numpy()[own], table["shard"].to_numpy()[own]
        by = np.argsort(node, kind="stable")
        own, node, shard = own[by], node[by], shard[by]
        m = len(node)
        if not m:
            return
        take = lambda c, kind, rows: np.frombuffer(b"".join(table[c].take(pa.array(rows)).to_pylist()), kind)
        vector = take("vector", np.uint8, own).reshape(m, -1)
        d = vector.shape[1]
        # what is on each list, then what is offered, as one flat table of (node, candidate)
        listed = take("ids", np.int64, own).reshape(m, links)
        flat_node = np.repeat(np.arange(m), links)
        parts = [(flat_node, listed.ravel(), take("distances", np.float32, own), take("fresh", np.uint8, own), take("worsts", np.float32, own), take("vectors", np.uint8, own).reshape(-1, d))]
        new = np.flatnonzero(~np.isnan(table["distance"].to_numpy()))
        at = np.searchsorted(node, table["node"].to_numpy()[new])
        new, at = new[at < m], at[at < m]
        parts.append((at, other[new], table["distance"].to_numpy()[new], np.ones(len(new), np.uint8), table["worst"].to_numpy()[new], take("vector", np.uint8, new).reshape(-1, d) if len(new) else np.zeros((0, d), np.uint8)))
        to, who, far, fresh, worst, vectors = (np.concatenate(x) for x in zip(*parts))
        real = (who >= 0) & (who != node[to])
        order = np.lexsort((fresh, who, to))  # the listed one before the same one offered again
        order = order[real[order]]
        first = np.ones(len(order), bool)
        first[1:] = (to[order][1:] != to[order][:-1]) | (who[order][1:] != who[order][:-1])
        order = order[first]
        order = order[np.lexsort((who[order], far[order], to[order]))]
        starts = np.searchsorted(to[order], np.arange(m))
        rank = np.arange(len(order)) - starts[to[order]]
        order, rank = order[rank < links], rank[rank < links]
        cell = (to[order], rank)
        ids, distance = np.full((m, links), -1, np.int64), np.full((m, links), FAR, np.float32)
        is_new, worsts, near = np.zeros((m, links), np.uint8), np.zeros((m, links), np.float32), np.zeros((m, links, d), np.uint8)
        ids[cell], distance[cell], is_new[cell], worsts[cell], near[cell] = who[order], far[order], fresh[order], worst[order], vectors[order]
        limit = distance[:, -1]
        out: list[tuple] = []
        for a in range(0, m if not last else 0, 256):
            b = min(m, a + 256)
            v = spread(near[a:b])
            pair = np.sqrt(_pairwise(v, v)).astype(np.float32)
            wanted = (is_new[a:b, :, None] | is_new[a:b, None, :]).astype(bool) & (ids[a:b, :, None] >= 0) & (ids[a:b, None, :] >= 0)
            wanted &= (pair < worsts[a:b, :, None]) & (ids[a:b, :, None] != ids[a:b, None, :])
            pair = np.where(wanted, pair, FAR)
            closest = np.argsort(pair, axis=2, kind="stable")[:, :, :offers]
            gap = np.take_along_axis(pair, closest, axis=2)
            i, j, k = np.nonzero(gap < FAR)
            mate = closest[i, j, k]
            # a node offers its neighbours to each other, and itself to its new ones
            out.append((shard[a:b][i], ids[a:b][i, j], ids[a:b][i, mate], gap[i, j, k], worsts[a:b][i, mate], near[a:b][i, mate]))
            i, j = np.nonzero((is_new[a:b] == 1) & (ids[a:b] >= 0) & (distance[a:b] < worsts[a:b]))
            out.append((shard[a:b][i], ids[a:b][i, j], node[a:b][i], distance[a:b][i, j], limit[a:b][i], vector[a:b][i]))
        blobs = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
        none = lambda n: pa.nulls(n, pa.binary())
        names = table.schema.names
        for a in range(0, m, 1024):
            s = slice(a, a + 1024)
            n = len(node[s])
            yield pa.RecordBatch.from_arrays([pa.array(shard[s]), pa.array(node[s]), pa.array(np.full(n, -1)), pa.array(np.full(n, np.nan, np.float32)), pa.array(limit[s]), blobs(vector[s]),
                                              blobs(ids[s]), blobs(distance[s]), blobs(np.zeros((n, links), np.uint8)), blobs(worsts[s]), blobs(near[s])], names)
        for s, t, w, g, far_w, vec in out:
            if len(t):
                n = len(t)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(t), pa.array(w), pa.array(g), pa.array(far_w), blobs(vec), none(n), none(n), none(n), none(n), none(n)], names)

    return run


def _start(links: int, lists: bool):
    """Nodes of a partition offer themselves to a few others of their shard there; `lists`: their empty lists as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, shard = batch.column("node").to_numpy(), batch.column("shard").to_numpy()
            vec = squeeze(np.stack(batch.column("vector").to_numpy(zero_copy_only=False)).astype(np.float32))
            n, d = vec.shape
            nil = lambda x: pa.array([x.tobytes()] * n, pa.binary())
            blobs = pa.array([r.tobytes() for r in vec], pa.binary())
            if lists:
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(node), pa.array(np.full(n, -1)), pa.array(np.full(n, np.nan, np.float32)), pa.array(np.full(n, FAR, np.float32)), blobs,
                                                  nil(np.full(links, -1, np.int64)), nil(np.full(links, FAR, np.float32)), nil(np.zeros(links, np.uint8)), nil(np.zeros(links, np.float32)), nil(np.zeros((links, d), np.uint8))], [f.split()[0] for f in SCHEMA.split(", ")])
            for s in np.unique(shard):
                rows = np.flatnonzero(shard == s)
                rng = np.random.Generator(np.random.PCG64(int(s) + int(node[rows].min() & 0x7FFFFFFF)))
                for _ in range(max(1, links // 5)):
                    turn = rng.permutation(rows)
                    mate = np.roll(turn, 1)
                    keep = turn != mate
                    turn, mate = turn[keep], mate[keep]
                    gap = np.sqrt(((spread(vec[turn]) - spread(vec[mate])) ** 2).sum(1)).astype(np.float32)
                    for x, y in ((turn, mate), (mate, turn)):
                        k = len(x)
                        if k:
                            empty = pa.nulls(k, pa.binary())
                            yield pa.RecordBatch.from_arrays([pa.array(shard[x]), pa.array(node[x]), pa.array(node[y]), pa.array(gap), pa.array(np.full(k, FAR, np.float32)), blobs.take(pa.array(y)), empty, empty, empty, empty, empty],
                                                             [f.split()[0] for f in SCHEMA.split(", ")])

    return run


def build_graph(nodes: DataFrame, count: int, links: int = LINKS, rounds: int = ROUNDS) -> DataFrame:
    """(shard, node, links array<long>) by NN-descent over `nodes` (node, vector)."""
    shards = -(-count // SHARD) or 1
    parts = max(1, -(-count // NODES))
    dealt = nodes.select(F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), "node", "vector")
    # nodes first meet at random; three dealings, or the partitions of one would stay islands
    rows = dealt.repartition(parts, F.xxhash64("node", F.lit(0))).mapInArrow(_start(links, True), SCHEMA)
    for turn in (1, 2):
        rows = rows.unionByName(dealt.repartition(parts, F.xxhash64("node", F.lit(turn))).mapInArrow(_start(links, False), SCHEMA))
    for k in range(rounds + 1):
        rows = rows.repartition(parts, "node").mapInArrow(_round(links, OFFERS, k == rounds), SCHEMA)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b, np.int64) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("node"), pa.array([i[i >= 0].tolist() for i in ids], pa.list_(pa.int64()))], ["shard", "node", "links"])

    return rows.where("ids is not null").select("shard", "node", "ids").mapInArrow(lists, "shard int, node long, links array<long>")


def starts_of(adjacent: np.ndarray, entries: int = ENTRIES) -> np.ndarray:
    """Nodes a search starts from: `entries` random ones, and more until every node lies within `HOPS` links of one.

    Nearest neighbours alone may leave a graph of many islands, which no small number of random starts reaches.
    `adjacent` holds the places each node links to, filled up with its number of nodes.
    """
    n = len(adjacent) - 1
    order = np.random.Generator(np.random.PCG64(n)).permutation(n)
    near, starts = np.zeros(n + 1, bool), []
    for k, u in enumerate(order.tolist()):
        if k >= entries and near[u]:
            continue
        starts.append(u)
        ring = np.array([u])
        near[u] = True
        for _ in range(HOPS):
            ring = np.unique(adjacent[ring])
            near[ring] = True
    return np.array(starts)


def greedy(ids: np.ndarray, x: np.ndarray, lists: list, queries: np.ndarray, keep: int, beam: int = BEAM, entries: int = ENTRIES) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one graph for a block of queries: positions and distances of the `keep` nearest found."""
    n, q = len(ids), len(queries)
    place = {int(i): k for k, i in enumerate(ids)}
    out = [[place[v] for v in row if v in place] for row in lists]
    back: list[list[int]] = [[] for _ in range(n)]
    for u, row in enumerate(out):
        for v in row:
            if len(back[v]) < 2 * LINKS:  # the longer way round stays open through the forward links
                back[v].append(u)
    both = [list(dict.fromkeys((*a, *b))) for a, b in zip(out, back)]
    width = max(1, max(map(len, both)))
    adjacent = np.full((n + 1, width), n)
    for u, row in enumerate(both):
        adjacent[u, : len(row)] = row
    x32, sq = np.vstack((x, np.zeros((1, x.shape[1])))).astype(np.float32), None
    sq = np.append((x32[:n] ** 2).sum(1), np.inf).astype(np.float32)
    q32 = queries.astype(np.float32)
    at = np.arange(q)[:, None]
    seen, spent = np.zeros((q, n + 1), bool), np.zeros((q, n + 1), bool)
    seen[:, n] = spent[:, n] = True
    begin = starts_of(adjacent, entries)
    pool = np.tile(begin, (q, 1))
    seen[at, pool] = True
    gap = sq[begin] - 2 * (q32 @ x32[begin].T)
    if pool.shape[1] > beam:
        best = np.argpartition(gap, beam - 1, axis=1)[:, :beam]
        pool, gap = np.take_along_axis(pool, best, 1), np.take_along_axis(gap, best, 1)
    while True:
        open_gap = np.where(spent[at, pool], np.inf, gap)
        if open_gap.shape[1] > EXPAND:
            pick = np.argpartition(open_gap, EXPAND - 1, axis=1)[:, :EXPAND]
        else:
            pick = np.tile(np.arange(open_gap.shape[1]), (q, 1))
        live = np.isfinite(np.take_along_axis(open_gap, pick, 1))
        if not live.any():
            break
        chosen = np.where(live, np.take_along_axis(pool, pick, 1), n)
        spent[at, chosen] = True
        more = adjacent[chosen].reshape(q, -1)
        more = np.where(seen[at, more], n, more)
        more.sort(axis=1)
        more[:, 1:][more[:, 1:] == more[:, :-1]] = n
        seen[at, more] = True
        more_gap = np.where(more == n, np.inf, sq[more] - 2 * np.einsum("qd,qkd->qk", q32, x32[more]))
        pool, gap = np.concatenate((pool, more), 1), np.concatenate((gap, more_gap), 1)
        if pool.shape[1] > beam:
            best = np.argpartition(gap, beam - 1, axis=1)[:, :beam]
            pool, gap = np.take_along_axis(pool, best, 1), np.take_along_axis(gap, best, 1)
    some = min(pool.shape[1], keep + 8)  # single precision may swap near ties: rank a few more exactly
    best = np.argpartition(gap, some - 1, axis=1)[:, :some]
    pool = np.take_along_axis(pool, best, 1)
    exact = np.full(pool.shape, np.inf)
    for k in range(q):
        real = pool[k] < n
        exact[k, real] = np.sqrt(((x[pool[k][real]] - queries[k]) ** 2).sum(1))
    order = np.argsort(exact, axis=1, kind="stable")
    return np.take_along_axis(pool, order, 1), np.take_along_axis(exact, order, 1)


def search(frame: DataFrame, id_col: str, vector_col: str, is_query: str, k: int = 10, links: int = LINKS, rounds: int = ROUNDS, beam: int = BEAM) -> DataFrame:
    """The `k` nearest rows found for each row meeting `is_query` (SQL over `id`): query_id, rank, vec_id, score.

    Rows named in `distinct_vectors` take no part. Copies of a vector are all candidates; of rows with
    one id and one vector one counts. Ties go to the smaller id. Empty tables give no rows.
    """
    x = stage(distinct_vectors(frame, id_col, vector_col), "vectors")
    nodes = stage(x.groupBy("key").agg(F.min("id").alias("node"), F.first("vector").alias("vector")), "nodes")
    count = nodes.count()
    shards = -(-count // SHARD) or 1
    graph = nodes.drop("key").join(build_graph(nodes, count, links, rounds), "node")
    asked = x.where(is_query).dropDuplicates(["id", "key"])
    blocks = -(-asked.count() // QUERIES) or 1
    left = graph.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "node", "vector", "links")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "vector")

    def found(g: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(q):
            return pd.DataFrame({"query_id": [], "node": [], "score": []}).astype({"query_id": "int64", "node": "int64", "score": "float64"})
        g, q = g.sort_values("node"), q.sort_values("id")
        ids, query_ids = g["node"].to_numpy(), q["id"].to_numpy()
        place, far = greedy(ids, np.stack(g["vector"]), g["links"].tolist(), np.stack(q["vector"]), k + 1, beam)
        rows, cols = np.nonzero(np.isfinite(far))
        return pd.DataFrame({"query_id": query_ids[rows], "node": ids[place[rows, cols]], "score": far[rows, cols]})

    near = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(found, "query_id long, node long, score double")
    top = Window.partitionBy("query_id").orderBy("score", "node")
    near = near.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).drop("r")
    # of a vector's copies no query needs more than the k + 1 with the smallest ids
    member = x.select("key", "id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= k + 1)
    member = member.join(nodes.select("key", "node"), "key").select("node", F.col("id").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.join(member, "node").where("vec_id <> query_id").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
