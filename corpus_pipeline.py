"""The corpus pipeline over `documents`: toxicity, line dedup, near duplicates, secrets, packing.

Every stage but the last returns the columns of `documents`; `n_chars` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm import linededup, neardups, packing, secrets, toxicity
from wayfarer.llm.base import prepare, read, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _sized(docs: DataFrame) -> DataFrame:
    """The columns of documents, with `n_chars` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier chain rejects go; all others stay as they are."""
    prepare(spark)
    return toxicity.classify(docs, read(spark, sf_dir, "labels"), COLUMNS).where("not rejected").select(*COLUMNS)


def drop_later_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an earlier match go, and documents of which no word is left; documents without words before stay."""
    prepare(spark)
    left = linededup.dedup_lines(docs, COLUMNS)
    return _sized(left.where((F.size("removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the least doc_id stays (of several texts with that id the one of
    least hash), and rows of equal doc_id and text are one row. Rows that share a doc_id only are different
    documents; those without words are in no group, and rows without a doc_id stay."""
    prepare(spark)
    named = docs.where("doc_id is not null").select(*COLUMNS, F.xxhash64("text").alias("key"))
    rows = stage(neardups.labelled(docs).where("doc_id is not null"), "labelled")
    heads = rows.where("n > 0").groupBy("label").agg(F.min(F.struct("doc_id", "key")).alias("head")).select("head.*")
    kept = heads.unionByName(rows.where("n = 0").select("doc_id", "key").distinct())
    one = named.join(kept, ["doc_id", "key"], "left_semi").groupBy("doc_id", "key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return one.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mask; no document goes."""
    prepare(spark)
    found = secrets.find(docs, secrets.train(docs), COLUMNS)
    return _sized(found.withColumn("text", secrets.redact(F.col("text"), F.col("spans"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, as op6 returns them."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_later_lines), ("ngram_jaccard", keep_one_of_group), ("secrets", mask_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: a fitted model decides in the first stage, so SQL can't give these rows; tests hold the stages against brute force
ORACLE_SQL = None
