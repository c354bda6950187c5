"""Line dedup: an exact set-similarity join of lines that removes later matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm import setjoin as S
from wayfarer.llm import words as W
from wayfarer.llm.base import stage


def _lines(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lines of every text (parted by line feeds) as one column, and their number by text."""
    parted = pc.split_pattern(column.fill_null(""), "\n")
    return parted.flatten(), parted.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def later_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, key, line) of every line that has an earlier match, by doc_id, `key` (the text's hash) and then line.

    Lines match at Jaccard >= 0.75 of their five-word shingles (a shorter line is one shingle); lines
    without words match nothing. Rows of equal doc_id and text are one: their lines don't remove each other. Rows
    that share a doc_id only are different texts. Rows without a doc_id are left alone.
    """
    docs = docs.where("doc_id is not null")
    rows, frequent, seen = S.scan(docs, _lines)
    here = F.struct("doc_id", "key", "piece")
    classes = stage(rows.groupBy("node").agg(F.min(here).alias("at"), F.max(here).alias("end"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    settled = _matched(docs, classes, S.members(docs, _lines, frequent, seen, S.prefix_entries(classes)))
    marked = classes.withColumn("settled", F.lit(False)) if settled is None else classes.join(settled.withColumn("settled", F.lit(True)), "node", "left")
    marked = marked.where("settled or at <> end").select("node", "at", F.coalesce("settled", F.lit(False)).alias("settled"))
    return rows.join(marked, "node").where(F.col("settled") | (here > F.col("at"))).select("doc_id", "key", F.col("piece").alias("line"))


def _matched(docs: DataFrame, classes: DataFrame, entries: DataFrame) -> DataFrame | None:
    """The nodes (node) that match a node which occurs earlier."""
    edges = S.candidates(entries, classes.select("node", "sig"))
    if edges.isEmpty():
        return None
    order = ["first", "second", "third"]
    groups = stage(S.components(None, edges).join(classes, "node").select(
        "node", "label", "n", F.lit(0).cast("long").alias("known"), *[F.col(f"at.{c}").alias(o) for c, o in zip(("doc_id", "key", "piece"), order)]), "groups")
    sets = stage(S.sets_of(docs, _lines, groups.select("node", F.col("second").alias("key"))), "tokens")

    def work(tokens: list[np.ndarray], target: np.ndarray, fields: dict) -> list[np.ndarray]:
        return [fields["node"][S.matched_earlier(tokens, target)]]

    def settle(rows: DataFrame) -> DataFrame:
        return S.met(rows, sets, order, work, "node long")

    few, large = S.sliced(groups, [F.col(o) for o in order])
    found = settle(few.withColumns({"i": F.lit(0), "j": F.lit(0).cast("long"), "target": F.lit(True)}))
    if large is not None:
        first = stage(settle(S.blocks(large)), "settled")
        hungry = stage(large.join(first, "node", "left_anti"), "hungry")
        found = found.unionByName(first).unionByName(settle(S.blocks(large, hungry, earlier=True)))
    return stage(found.distinct(), "settled")


def dedup_lines(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` with `text` rid of later lines (null texts stay null), `n_lines`, and `removed` (line numbers)."""
    gone = later_lines(docs).distinct().groupBy("doc_id", F.col("key").alias("key__")).agg(F.sort_array(F.collect_list("line")).alias("removed"))  # one text's lines
    joined = docs.select(*keep, F.xxhash64("text").alias("key__")).join(gone, ["doc_id", "key__"], "left").select(*keep, "removed")
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("removed", i.cast("long"))), "\n")
    return joined.withColumn("n_lines", F.coalesce(F.size(F.when(F.col("text").isNotNull(), lines)), F.lit(0))).withColumn(
        "text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(left)).withColumn("removed", F.coalesce("removed", F.array().cast("array<long>")))
