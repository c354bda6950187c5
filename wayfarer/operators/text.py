"""Term statistics of free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.session import stage

# fixed value: runs of two or more letters, digits or underscores
TOKEN = r"([\p{L}\p{N}_]{2,})"


def tokens(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def vocabulary(df: DataFrame, text: str, max_terms: int = 50) -> DataFrame:
    """The most frequent terms ``(term, n)``, ties alphabetical. Frequent terms
    are folded per task before the shuffle."""
    terms = df.where(F.col(text).isNotNull()).select(F.explode(tokens(text)).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(max_terms)


def tfidf_terms(df: DataFrame, key: str, text: str, max_terms: int = 50) -> DataFrame:
    """``(key, term, weight)``: term counts times ``ln((1+N)/(1+df)) + 1``, each
    text scaled to length 1, over the `max_terms` most frequent terms.

    Texts are split once, into one row of terms and counts each; vocabulary and
    hits are read from that. The vocabulary is at most `max_terms` rows, which is why
    it may travel as constants.
    """
    texts = df.where(F.col(text).isNotNull())
    pairs = texts.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    pairs = stage(pairs, "terms")
    known = pairs.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("n"), "term").limit(max_terms)
    rows = texts.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = known.select("term", (F.log((1.0 + rows) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    raw = pairs.join(F.broadcast(idf), "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("raw") / norm).alias("weight"))


def vocabulary_size(df: DataFrame, text: str, max_terms: int = 50) -> DataFrame:
    return vocabulary(df, text, max_terms).agg(F.count(F.lit(1)).alias("themes"))
