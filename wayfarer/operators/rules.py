"""Frequent itemsets and association rules.

Mining is level-wise (Apriori): items, pairs, then itemsets grown only from
frequent ones. What is shuffled are candidate counts, folded per task; no step
pairs rows with rows or blows a row up to its combinations.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer import vocabulary as vocab
from wayfarer.functions.columns import snake, unsnake
from wayfarer.operators.ordering import top_k, top_k_per_group
from wayfarer.session import stage



# --- transactions ---------------------------------------------------------------

def _items(parts: Sequence[Column]) -> Column:
    # array_except drops nulls and repeats, sort_array orders: all in generated code
    nothing = F.array(F.lit(None).cast("string"))
    return F.sort_array(F.array_except(F.array(*parts), nothing)).alias("items")


def transactions_keyed(
    df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), city_columns: Sequence[str] = (),
    skip: str | None = vocab.RARE_LABEL,
) -> DataFrame:
    """Items ``column=value``, blanks as ``_``; nulls are no item. City columns
    shorten their name to the part before ``_`` and leave out the `skip` value."""
    parts = []
    for c in columns:
        value = F.col(c).cast("string")
        if c in city_columns:
            item = F.concat(F.lit(c.split("_")[0] + "="), value)
            parts.append(F.when(value != F.lit(skip), item) if skip is not None else item)
        else:
            parts.append(F.concat(F.lit(c + "="), snake(value)))
    return df.select(*keep, _items(parts))


def transactions_prefixed(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Items ``column_value``; nulls are no item."""
    return df.select(*keep, _items([F.concat(F.lit(c + "_"), F.col(c).cast("string")) for c in columns]))


def transactions_flags(
    df: DataFrame, flags: Sequence[str], dummies: Sequence[str] = (), keep: Sequence[str] = (), yes: str = "Yes",
) -> DataFrame:
    """Flag names that hold, and ``column_value`` of category columns. A missing
    flag is absent."""
    parts = [F.when(F.col(c) == yes, F.lit(c)) for c in flags]
    parts += [F.concat(F.lit(c + "_"), F.col(c).cast("string")) for c in dummies]
    return df.select(*keep, _items(parts))


# --- itemsets ---------------------------------------------------------------------

@dataclass(frozen=True)
class Mined:
    itemsets: DataFrame
    transactions: int


def frequent_itemsets(transactions: DataFrame, min_support: float, max_len: int | None = None) -> Mined:
    """Itemsets ``(items, n, support)`` held by at least `min_support` of the rows.

    One pass over the rows per level. A task turns its rows into one bit row per
    frequent item and counts every candidate by joint bits, so no row is blown up to
    its combinations and only counts are shuffled. Frequent itemsets come to the driver to
    name the next candidates: at support s and L items per row there are at most L / s
    items and (L / s)^k sets of k, whatever the number of rows.
    """
    transactions = stage(transactions.select("items"), "baskets")
    total = transactions.count()
    need = _needed(total, min_support)
    singles = (
        transactions.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= need).collect()
    )
    names = sorted(r["item"] for r in singles)
    counts = {r["item"]: r["n"] for r in singles}
    found = [([name], counts[name]) for name in names]
    level = [(i,) for i in range(len(names))]
    size = 1
    while len(level) > 1 and (max_len is None or size < max_len):
        candidates = _candidates(level)
        if not candidates:
            break
        kept = [(candidates[r["at"]], r["n"]) for r in _count(transactions, names, candidates).where(F.col("n") >= need).collect()]
        level = sorted(c for c, _ in kept)
        found += [([names[i] for i in c], n) for c, n in kept]
        size += 1
    rows = transactions.sparkSession.createDataFrame(found, "items array<string>, n bigint")
    support = F.try_divide(F.col("n").cast("double"), F.lit(float(total)))
    return Mined(rows.select("items", "n", support.alias("support")), total)


def _candidates(level: Sequence[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Sets one larger, all of whose subsets are in the sorted `level`."""
    known, out = set(level), []
    for at, left in enumerate(level):
        for right in level[at + 1:]:
            if left[:-1] != right[:-1]:
                break
            wider = (*left, right[-1])
            if all(wider[:k] + wider[k + 1:] in known for k in range(len(wider) - 2)):
                out.append(wider)
    return out


CANDIDATES = 512  #: counted at a time: their bits stay in a core's cache


def _count(transactions: DataFrame, names: Sequence[str], candidates: Sequence[tuple[int, ...]]) -> DataFrame:
    """``(at, n)``: rows that hold each candidate, by its place in `candidates`."""
    sets = np.array(candidates, dtype=np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(sets), dtype=np.int64)
        for batch in batches:
            items = batch.column("items")
            codes = pc.index_in(items.flatten(), value_set=pa.array(names, items.type.value_type)).fill_null(-1).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(items)), items.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            held = np.zeros((len(names), -(-len(items) // 64) * 64), dtype=bool)
            held[codes[codes >= 0], rows[codes >= 0]] = True
            bits = np.packbits(held, axis=1).view(np.uint64)  # 64 rows a word
            for start in range(0, len(sets), CANDIDATES):
                part = sets[start:start + CANDIDATES]
                joint = bits[part[:, 0]]
                for k in range(1, part.shape[1]):
                    joint &= bits[part[:, k]]
                totals[start:start + CANDIDATES] += np.bitwise_count(joint).sum(axis=1, dtype=np.int64)
        at = np.flatnonzero(totals)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], ["at", "n"])

    return transactions.select("items").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))


def _needed(total: int, min_support: float) -> int:
    """Smallest count whose share reaches the support."""
    need = max(1, int(min_support * total))
    while need / total < min_support if total else False:
        need += 1
    return need


# --- rules ----------------------------------------------------------------------------

def association_rules(
    mined: Mined, min_confidence: float = 0.0, min_lift: float = 0.0, max_consequent: int | None = None,
) -> DataFrame:
    """All splits of each itemset into antecedent and consequent, with support,
    confidence, lift, leverage and conviction (infinite at confidence 1).

    Rules are grown from their consequents, one item a round: an itemset's antecedent only gets more frequent as items move
    out of it, so a consequent below `min_confidence` has no larger one above it. Two kept consequents that differ in their last
    item make the next candidate, and its antecedent's count is looked up. Itemsets may be of any size.
    """
    sets = mined.itemsets
    total = F.lit(float(mined.transactions))
    a = sets.select(F.col("items").alias("antecedent"), F.col("n").alias("n_a"))
    c = sets.select(F.col("items").alias("consequent"), F.col("n").alias("n_c"))
    whole = stage(sets.where(F.size("items") > 1).select(F.monotonically_increasing_id().alias("set"), F.array_sort("items").alias("items"), F.col("n").alias("n_both")), "wholes")

    def kept(level: DataFrame) -> DataFrame:
        found = level.withColumn("antecedent", F.array_except("items", "consequent")).join(a, "antecedent")
        return stage(found.where(F.col("n_both").cast("double") / F.col("n_a") >= min_confidence), "consequents")

    level = kept(whole.select("set", "items", "n_both", F.explode("items").alias("item")).select("set", "items", "n_both", F.array("item").alias("consequent")))
    joined, size = level, 1
    while (max_consequent is None or size < max_consequent) and not level.isEmpty():
        parts = level.select("set", "items", "n_both", F.slice("consequent", 1, size - 1).alias("head") if size > 1 else F.array().cast("array<string>").alias("head"), F.element_at("consequent", -1).alias("last"))
        other = parts.select("set", "head", F.col("last").alias("next"))
        grown = parts.where(F.size("items") > size + 1).join(other, ["set", "head"]).where("last < next")
        level = kept(grown.select("set", "items", "n_both", F.concat("head", F.array("last", "next")).alias("consequent")))
        joined = joined.unionByName(level)
        size += 1
    joined = joined.join(c, "consequent")
    sup, sa, sc = F.col("n_both") / total, F.col("n_a") / total, F.col("n_c") / total
    conf = F.col("n_both").cast("double") / F.col("n_a")
    rules = joined.select(
        "antecedent", "consequent", sa.alias("antecedent_support"), sc.alias("consequent_support"),
        sup.alias("support"), conf.alias("confidence"), (conf / sc).alias("lift"), (sup - sa * sc).alias("leverage"),
        F.when(F.col("n_both") == F.col("n_a"), F.lit(float("inf"))).otherwise((1 - sc) / (1 - conf)).alias("conviction"),
    )
    return rules.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))


def mine_with_fallback(
    transactions: DataFrame, supports: Sequence[float] = tuple(vocab.FLAG_SUPPORTS),
    confidences: Sequence[float] = tuple(vocab.FLAG_CONFIDENCES), max_len: int | None = None,
) -> tuple[Mined, DataFrame]:
    """First support that finds itemsets, then first confidence that finds rules."""
    mined = None
    for support in supports:
        mined = frequent_itemsets(transactions, support, max_len)
        if not mined.itemsets.isEmpty():
            break
    rules = None
    for confidence in confidences:
        rules = association_rules(mined, min_confidence=confidence)
        if not rules.isEmpty():
            break
    return mined, rules


def rule_order() -> list[Column]:
    """By lift, ties by the item lists."""
    return [F.desc(F.round("lift", 9)), F.asc("antecedent"), F.asc("consequent")]


def rules_top(rules: DataFrame, k: int = 5) -> DataFrame:
    return top_k(rules, k, *rule_order())


def _any_contains(items: Column | str, words: Sequence[str]) -> Column:
    return F.exists(items, lambda x: reduce(lambda p, q: p | q, [F.contains(x, F.lit(w)) for w in words]))


def rule_category(
    rules: DataFrame, categories: Mapping[str, Sequence[str]] = vocab.RULE_CATEGORIES,
    other: str = vocab.RULE_CATEGORY_OTHER, k: int = 3,
) -> DataFrame:
    """The first category one of whose words occurs in an item of the rule, and
    the best `k` rules of each."""
    items = F.concat("antecedent", "consequent")
    label = None
    for name, words in categories.items():
        test = _any_contains(items, words)
        label = F.when(test, name) if label is None else label.when(test, name)
    return top_k_per_group(rules.withColumn("category", label.otherwise(other)), k, ["category"], *rule_order())


def itemsets_by_prefix(itemsets: DataFrame, words: Sequence[str], k: int = 5) -> DataFrame:
    """Best-supported itemsets with an item that holds one of the words."""
    return top_k(itemsets.where(_any_contains("items", words)), k, F.desc("n"), "items")


def rules_by_prefix(rules: DataFrame, antecedent: Sequence[str], consequent: Sequence[str], k: int = 5) -> DataFrame:
    hit = _any_contains("antecedent", antecedent) & _any_contains("consequent", consequent)
    return top_k(rules.where(hit), k, *rule_order())


def rule_edges(rules: DataFrame, k: int = 200) -> DataFrame:
    """Undirected item pairs of the best `k` rules, weighted by the lowest lift
    among the rules that name the pair."""
    best = top_k(rules, k, *rule_order())
    pairs = best.select("lift", F.explode("antecedent").alias("a"), "consequent").select(
        "lift", unsnake("a").alias("a"), F.explode("consequent").alias("b")
    ).withColumn("b", unsnake("b"))
    return pairs.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min("lift").alias("weight"))


def itemset_matrix(itemsets: DataFrame, k: int = 20) -> DataFrame:
    """0/1 cells of the best-supported `k` itemsets against the items they use,
    long form ``(place, item, held)``."""
    best = top_k(itemsets, k, F.desc("n"), "items")
    placed = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.col("items"))))
    # at most `k` short lists
    names = best.agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("names")).scalar()
    cells = placed.withColumn("names", names).select("place", "items", F.explode("names").alias("item"))
    return cells.select("place", unsnake("item").alias("item"), F.array_contains("items", F.col("item")).cast("int").alias("held"))


def rule_summary(mined: Mined, rules: DataFrame) -> DataFrame:
    """``(rows, itemsets, rules)``."""
    return mined.itemsets.agg(F.count(F.lit(1)).alias("itemsets")).select(
        F.lit(mined.transactions).cast("bigint").alias("rows"), "itemsets",
        rules.agg(F.count(F.lit(1)).alias("rules")).scalar().alias("rules"),
    )
