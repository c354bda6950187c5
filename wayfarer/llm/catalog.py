"""Registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm import bpe, idplanes, kneser_ney, licenses, linededup, neardups, neighbours, packing, resampling, secrets, topk, toxicity, whitening
from wayfarer.llm.base import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.dedup_lines(read(spark, sf_dir, "documents"), ["doc_id", "text"])
    return rows.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"),
                       F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.sha2("text", 256).alias("text_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.search(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "id % 100 = 0", 10)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0)
    model = kneser_ney.fit(docs.where(~F.col("held_out")))
    rows = kneser_ney.score(docs, model, ["doc_id", "held_out"])
    return rows.withColumn("train_tokens", F.lit(model.train_tokens).cast("long"))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardups.near_duplicates(read(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != secrets.FIELD)
    counts = [_of_kind(spans, k).alias(f"n_{k}") for k in secrets.KINDS]
    return secrets.find(docs, secrets.train(docs)).select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(spans).alias("spans"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(topk.sparse_rows(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64.0), F.col("id") % 20 == 0, 20)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op12_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = idplanes.write(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return idplanes.read(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_license_scan, op3_bpe, op4_neighbours, op5_toxicity, op6_packing, op7_ngram_jaccard, op8_kneser_ney, op9_secrets, op10_topk, op11_resampling, op12_id_planes, op13_whitening)}

_SHINGLES = """
shingled AS (
  SELECT *, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh
  FROM parted
)"""
_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

ORACLES = {
    "op1_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL
), parted AS MATERIALIZED (SELECT doc_id, line, {_WORDS.format("l")} AS w FROM lines), {_SHINGLES},
tokens AS MATERIALIZED (SELECT doc_id, line, len(sh) AS n, unnest(sh) AS s FROM shingled),
classes AS MATERIALIZED (SELECT doc_id, line, n, row_number() OVER (PARTITION BY list_sort(sh) ORDER BY doc_id, line) AS place FROM (SELECT doc_id, line, len(sh) AS n, sh FROM shingled WHERE len(sh) > 0)),
firsts AS MATERIALIZED (SELECT t.* FROM tokens t JOIN classes c USING (doc_id, line) WHERE c.place = 1),
pairs AS (
  SELECT b.doc_id, b.line FROM firsts a JOIN firsts b ON a.s = b.s AND (a.doc_id, a.line) < (b.doc_id, b.line) AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.doc_id, a.line, a.n, b.doc_id, b.line, b.n HAVING 4 * count(*) >= 3 * (a.n + b.n - count(*))
), classed AS (
  SELECT doc_id, line, list_sort(sh) AS k FROM shingled WHERE len(sh) > 0
), gone AS MATERIALIZED (
  SELECT DISTINCT c.doc_id, c.line FROM classed c LEFT JOIN classes p ON c.doc_id = p.doc_id AND c.line = p.line
  WHERE p.place > 1 OR (c.doc_id, c.line) IN (SELECT (doc_id, line) FROM pairs)
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.doc_id) AS n_removed, coalesce(string_agg(CAST(g.line AS VARCHAR), ',' ORDER BY l.line), '') AS removed,
         coalesce(string_agg(CASE WHEN g.doc_id IS NULL THEN l.l END, chr(10) ORDER BY l.line), '') AS t
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_removed, removed, sha256(t) AS text_sha256 FROM kept
UNION ALL SELECT doc_id, 0, 0, '', NULL FROM documents WHERE text IS NULL""",
    "op7_ngram_jaccard": f"""
WITH RECURSIVE parted AS MATERIALIZED (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), {_SHINGLES},
tokens AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS s FROM shingled),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.s = b.s AND a.doc_id <> b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.doc_id, a.n, b.doc_id, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.doc_id
)
SELECT d.doc_id, CAST(len(d.sh) AS BIGINT) AS n_shingles, min(r.r) AS component_id FROM shingled d JOIN reach r USING (doc_id) GROUP BY d.doc_id, len(d.sh)""",
    "op11_resampling": """
WITH crc AS (
  SELECT list(t ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM (SELECT unnest(range(0, 256)) AS i)
  )
), parted AS MATERIALIZED (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 'b', NULL, 0, text FROM benchmark
), words AS MATERIALIZED (
  SELECT side, r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM parted
), counted AS MATERIALIZED (SELECT side, r, w, count(*) AS n FROM words GROUP BY ALL),
bytes AS (SELECT w, list_transform(range(0, strlen(w)), lambda k: CAST('0x' || hex(encode(w))[2 * k + 1:2 * k + 2] AS BIGINT)) AS b FROM (SELECT DISTINCT w FROM counted)),
hashed AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc
), sums AS (
  SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM counted JOIN hashed USING (w) GROUP BY bucket
), alls AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums),
gains AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST(s_all AS DOUBLE) + 10000) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (CAST(t_all AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM sums, alls
), per AS MATERIALIZED (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM counted JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || sha256('2024:' || d.doc_id)[1:8] AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM parted d LEFT JOIN per USING (r) WHERE side = 'd'
), drawn AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank, n_features AS n_words FROM drawn""",
    "op10_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
}
