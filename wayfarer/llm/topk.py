"""Exact top-k inner-product search by term-at-a-time accumulation.

Rows are sparse: the terms with a non-zero integer weight. Candidates are cut into blocks, each an
inverted index (for every term its postings of row and weight). A query block meets every
candidate block once; there, for each term of the queries in turn, the weighted postings are
scattered into dense score arrays, the best k of a block are split off by partition selection, and
blocks merge by rank. Every candidate is scored exactly; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 8192  #: rows of a candidate block
QUERIES = 1024  #: rows of a query block
COLUMNS = 32  #: queries whose scores are accumulated side by side


def sparse_rows(frame: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, terms, weights): floor(scale * x) of each component that is not 0. Rows whose id or
    vector is null, or whose vector holds a null or non-finite component, are left out."""
    x = F.transform(vector_col, lambda v: v.cast("double"))
    pairs = F.filter(F.transform(F.col("x"), lambda v, i: F.struct(i.alias("t"), F.floor(v * scale).cast("long").alias("w"))), lambda p: p["w"] != 0)
    return (frame.select(F.col(id_col).alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(finite_of("x"))
            .select("id", pairs.alias("p")).select("id", F.col("p.t").alias("terms"), F.col("p.w").alias("weights")))


def finite_of(name: str):
    return F.forall(name, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def _flat(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = frame["terms"].map(len).to_numpy(dtype=np.int64)
    rows = np.repeat(np.arange(len(frame)), lengths)
    if not lengths.sum():
        return rows, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return rows, np.concatenate(frame["terms"].to_list()).astype(np.int64), np.concatenate(frame["weights"].to_list()).astype(np.int64)


def best(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of one block for every query: query_id, vec_id, score."""
    candidates = candidates.sort_values("id", kind="stable")
    ids, query_ids = candidates["id"].to_numpy(), queries["id"].to_numpy()
    n = len(ids)
    rows, terms, weights = _flat(candidates)
    order = np.argsort(terms, kind="stable")
    rows, terms, weights = rows[order], terms[order], weights[order]
    vocabulary, firsts = np.unique(terms, return_index=True)
    bounds = np.append(firsts, len(terms))
    q_rows, q_terms, q_weights = _flat(queries)
    out = []
    for at in range(0, len(queries), COLUMNS):
        width = min(COLUMNS, len(queries) - at)
        scores = np.zeros((n, width), np.int64)
        mine = (q_rows >= at) & (q_rows < at + width)
        t, r, w = q_terms[mine], q_rows[mine] - at, q_weights[mine]
        by_term = np.argsort(t, kind="stable")
        t, r, w = t[by_term], r[by_term], w[by_term]
        used, begins = np.unique(t, return_index=True)
        for term, a, b in zip(used.tolist(), begins.tolist(), [*begins[1:].tolist(), len(t)]):
            place = int(np.searchsorted(vocabulary, term))
            if place == len(vocabulary) or vocabulary[place] != term:
                continue
            postings = slice(bounds[place], bounds[place + 1])
            weight = np.zeros(width, np.int64)
            weight[r[a:b]] = w[a:b]
            scores[rows[postings]] += weights[postings, None] * weight  # a row is once in a term's postings
        for j in range(width):
            own = ids == query_ids[at + j]
            some, mine = np.flatnonzero(~own), scores[:, j]
            if len(some) > k:  # split by score alone; ties at the last place go to the smaller ids, which stand first
                least = np.partition(mine[some], len(some) - k)[len(some) - k]
                above = some[mine[some] > least]
                some = np.concatenate((above, some[mine[some] == least][: k - len(above)]))
            out.append(pd.DataFrame({"query_id": query_ids[at + j], "vec_id": ids[some], "score": scores[some, j]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def search(rows: DataFrame, is_query, k: int) -> DataFrame:
    """For each row of `rows` (id, terms, weights) that meets `is_query`, its k best other rows:
    query_id, rank, vec_id, score. Rows with the query's id are not its candidates; fewer than k
    candidates give fewer ranks; rows without terms score 0 and take part.

    Equal rows are one. Of rows that share an id but not the vector, each is a candidate, and an id's query is the one of
    them with the least terms and weights.
    """
    rows = rows.distinct()
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    blocks, query_blocks = -(-count["n"] // CANDIDATES) or 1, -(-count["q"] // QUERIES) or 1
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    query_block = F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")
    left = rows.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"), "id", "terms", "weights")
    asked = rows.where(is_query).groupBy("id").agg(F.min(F.struct("terms", "weights")).alias("q")).select("id", "q.terms", "q.weights")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), query_block.alias("query_block"), "id", "terms", "weights")
    found = left.groupBy("block", "query_block").cogroup(right.groupBy("block", "query_block")).applyInPandas(
        lambda c, q: best(c, q, k) if len(c) and len(q) else best(c.iloc[:0], q.iloc[:0], k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
