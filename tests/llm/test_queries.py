"""The registered queries of the subpackage: SQL where it can express them, stage by stage for the pipeline."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("wayfarer.llm")
import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
import oracle  # noqa: E402
from wayfarer.llm import catalog  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    assert oracle.compare(catalog.QUERIES[name](spark, SMALL), oracle.connect(SMALL), catalog.ORACLES[name]) is None


def test_all_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} and "pipeline" in names


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    copy = docs.where("doc_id = 3").withColumn("doc_id", F.lit(5003).cast("long"))
    odd = spark.createDataFrame([(6000, None, "en", "s", 0), (6001, "", "en", "s", 0), (6002, 'He wrote token = "0123456789abcdef01234567" there for once', "en", "s", 0)], docs.schema)
    docs = docs.unionByName(copy).unionByName(odd)
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "secrets", "packing"]
    calm = steps["toxicity"](spark, docs, SMALL)
    assert calm.columns == docs.columns and 0 < calm.count() <= docs.count()
    lines = steps["line_dedup"](spark, docs, SMALL).cache()
    assert lines.columns == docs.columns
    ids = {r[0] for r in lines.select("doc_id").collect()}
    assert 5003 not in ids and {3, 6000, 6001, 6002} <= ids
    groups = {r[0] for r in steps["ngram_jaccard"](spark, docs, SMALL).select("doc_id").collect()}
    assert 5003 not in groups and {3, 6000, 6001, 6002} <= groups
    masked = {r["doc_id"]: r for r in steps["secrets"](spark, docs, SMALL).collect()}
    assert len(masked) == docs.count()
    assert masked[6002]["text"] == 'He wrote [SECRET]" there for once' and masked[6002]["n_chars"] == len(masked[6002]["text"]) and masked[6000]["text"] is None
    pieces = steps["packing"](spark, docs, SMALL)
    assert pieces.where("start = 0").select("doc_id").distinct().count() == docs.count()


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(30)) for c in "abc")
    near = one.replace("a29", "other")
    rows = [(1, f"{one}\n{two}"), (1, f"{three}\n{one}"), (1, two[:60]), (1, two[:60]), (2, near), (1, ""), (1, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    steps = dict(corpus_pipeline.STAGES)
    kept = sorted((r["doc_id"], str(r["text"])) for r in steps["ngram_jaccard"](spark, docs, SMALL).collect())
    assert kept == sorted({(d, str(t)) for d, t in rows})
    lines = [(r["doc_id"], line) for r in steps["line_dedup"](spark, docs, SMALL).where("text is not null").collect() for line in r["text"].split("\n")]
    # each line stays once; equal rows are one text and keep theirs
    assert sorted(lines) == sorted([(1, one), (1, two), (1, three), (1, two[:60]), (1, two[:60]), (1, "")])
