"""N-gram Jaccard join of documents by T-occurrence search, and the groups its links make."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm import setjoin as S
from wayfarer.llm.base import stage


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, `key` (the text's hash), the set size `n`, the component's `label` and its least doc_id `component_id` of every
    row of `docs`. Rows of one doc_id may be in several components; texts without words have no label."""
    rows, frequent, seen = S.scan(docs, empty=True)
    nodes = stage(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "sig", "key")]), "nodes")
    labels = _components(docs, nodes, S.members(docs, S.whole, frequent, seen, S.prefix_entries(nodes)))
    named = nodes.select("node", "first").withColumn("label", F.col("node")) if labels is None else nodes.join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    named = stage(named, "named")
    per_node = named.join(named.groupBy("label").agg(F.min("first").alias("component_id")), "label").select("node", "label", "component_id")
    return rows.join(per_node, "node", "left").select("doc_id", "key", "n", "label", "component_id")


def _components(docs: DataFrame, nodes: DataFrame, entries: DataFrame) -> DataFrame | None:
    """(node, label) of the nodes that are linked with another."""
    edges = S.candidates(entries, nodes.select("node", "sig"))
    if edges.isEmpty():
        return None
    # what near copies were made from shares tokens with most of them: it leads
    lead = entries.groupBy("node").agg((-F.count(F.lit(1))).alias("lead"))
    groups = S.components(None, edges).join(nodes, "node").join(lead, "node")
    groups = stage(groups.select("node", "label", "n", "key", "lead", F.col("node").alias("known")), "groups")
    sets = stage(S.sets_of(docs, S.whole, groups.select("node", "key")), "tokens")

    def work(tokens: list[np.ndarray], target: np.ndarray, fields: dict) -> list[np.ndarray]:
        label = S.join_by_occurrence(tokens, target, fields["known"])
        _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
        node, head = fields["node"], fields["node"][first[inverse]]
        some = node != head
        return [np.minimum(node, head)[some], np.maximum(node, head)[some]]

    def links(rows: DataFrame) -> DataFrame:
        return S.met(rows, sets, ["lead"], work, "a long, b long")

    few, large = S.sliced(groups, [F.col("lead")])
    found = links(few.withColumns({"i": F.lit(0), "j": F.lit(0).cast("long"), "target": F.lit(True)}))
    if large is None:
        return S.components(None, stage(found.distinct(), "links"))
    state = S.components(None, stage(found.unionByName(links(S.blocks(large))).distinct(), "links"))
    large = stage(large.drop("known").join(state.withColumnRenamed("label", "known"), "node", "left").withColumn("known", F.coalesce("known", "node")), "known")
    most = large.groupBy("label", "known").agg(F.count(F.lit(1)).alias("c")).groupBy("label").agg(F.max_by("known", F.struct("c", "known")).alias("most"))
    # of two nodes in different components one is outside the group's most frequent one
    hungry = stage(large.join(most, "label").where("known <> most").drop("most"), "hungry")
    if hungry.isEmpty():
        return state
    return S.components(state, stage(links(S.blocks(large, hungry)).distinct(), "links"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    Five-word shingles, Jaccard >= 0.75, whole texts. component_id is the least doc_id reachable by
    links; texts with one shingle set are linked. Texts without words (null, empty, blank) are linked with
    nothing: component_id is their own doc_id. Rows that share a doc_id have each their own text. Rows
    without a doc_id take part in links and have a null component_id only if no linked row has an id.
    """
    found = labelled(docs)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
