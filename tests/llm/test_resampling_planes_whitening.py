"""Importance resampling, id planes and whitening against brute force, and their odd inputs."""

from __future__ import annotations

import hashlib
import io
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("wayfarer.llm")
import public_tokenizers  # noqa: E402
from wayfarer.llm import catalog, idplanes, resampling, whitening  # noqa: E402

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = "/root/testdata/sf0.001"


def brute_features(text, longest):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORDS.findall(low)
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute_resample(docs, target, percent, least, longest, buckets, seed):
    """Plain Python; rows are (doc_id, text)."""
    found = [brute_features(t, longest) for _, t in docs]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, fs in found:
        for f in fs:
            s[bucket(f)] += 1
    for text in target:
        for f in brute_features(text, longest)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + buckets) / ((a + 1.0) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for (doc, _), (n, fs) in zip(docs, found):
        weight = sum(gain[bucket(f)] for f in fs)
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"{seed}:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, n, len(fs), weight, score, None])
    fit = sorted((r for r in rows if r[0] is not None and r[1] >= least), key=lambda r: (-r[4], r[0], r[2]))
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = place
    return rows


def as_set(rows):
    return sorted(map(str, (list(r) for r in rows)))


@pytest.mark.parametrize("longest, percent, least", [(1, 10, 3), (3, 50, 0), (2, 100, 1), (1, 0, 1)])
def test_resampling_equals_brute_force(spark, longest, percent, least):
    rng = np.random.default_rng(longest)
    vocabulary = ["Alpha", "beta", "été", "x1", "漢字", "long" * 40, "a", "B9"]
    docs = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(0, 12)))) for i in range(300)]
    docs += [(7, docs[3][1]), (7, docs[3][1]), (9, "beta-beta,beta"), (None, "alpha beta x1 a"), (400, None), (401, ""), (402, "?!"), (403, "word " * 20_000)]
    docs += [(1000, "same text here for many")] * 150  # one id on a third of all rows
    target = ["alpha x1 x1", None, "", "漢字 beta"]
    frame = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], "doc_id long, text string, score int, rank int, row__ int")
    found = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), percent, least, longest, buckets=97, seed=5)
    assert as_set(found.collect()) == as_set(brute_resample(docs, target, percent, least, longest, 97, 5))


def test_brackets_hold_the_cutoff(spark):
    """Heavy ties and any share: the bracket is valid and its outside counts are exact."""
    for score in (F.col("id") % 3, F.lit(5), F.col("id") * 7, F.floor(F.log(F.col("id") + 1.0))):
        rows = spark.range(2000).select(score.cast("long").alias("score"))
        values = sorted((r[0] for r in rows.collect()), reverse=True)
        for wanted in (1, 2, 777, 1999, 2000):
            low, high, above = resampling.bracket(rows, 2000, wanted)
            assert low <= values[wanted - 1] <= high and above == sum(v > high for v in values) < wanted


def test_resampling_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resampling.resample(empty, some).count() == 0
    row = resampling.resample(some, empty, percent=100, least_words=1).first()
    assert row["n_features"] == 3 and row["rank"] == 1


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(3)
    docs = [(5, rng.integers(0, 50_000, 700)), (None, np.array([1])), (6, np.zeros(0, int)), (7, rng.integers(0, 2**32, 300)), (8, np.zeros(500, int)), (2**62, np.array([2**32 - 1]))]
    sink = io.BytesIO()
    writer = idplanes.PlaneWriter(sink, kind, block=256)
    for doc, ids in docs:
        writer.add(doc, ids.astype("<u4"))
    writer.close()
    assert writer.at == len(sink.getvalue())
    reader = idplanes.PlaneReader(io.BytesIO(sink.getvalue()), writer.at)
    flat = np.concatenate([ids for _, ids in docs]).astype("<u4")
    assert reader.lengths.tolist() == [len(ids) for _, ids in docs] and reader.null.tolist() == [d is None for d, _ in docs]
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(flat) + 1, 2).tolist())
        assert (reader.read(a, b - a) == flat[a:b]).all()
    with pytest.raises(ValueError):
        idplanes.PlaneReader(io.BytesIO(sink.getvalue()[:-3]), writer.at - 3)
    with pytest.raises(ValueError):
        idplanes.split_planes(flat, "nibble")


def reference_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in texts]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_id_files_equal_the_library(spark, kind):
    texts = {3: "Hello, world", 1: None, 2: "", 9: "<|endoftext|> Été 漢字 " * 30, 5: "word " * 30_000, 4: "ünbroken" * 400}
    rows = [(k, t, 0, 0) for k, t in texts.items()] + [(3, "Hello, world", 0, 0), (None, "no id", 0, 0)] + [(50, "copy of one row", 0, 0)] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, row__ int").repartition(5)
    manifest = idplanes.write(docs, public_tokenizers.path("word_bpe_49k.json"), kind=kind, file_bytes=20_000)
    assert manifest.count() > 3
    found = idplanes.read(spark, manifest).orderBy("start").collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in found] == [r[0] for r in ordered]
    at = 0
    for row, ids in zip(found, reference_ids([r[1] for r in ordered])):
        assert (row["start"], row["n_tokens"], bytes(row["ids"])) == (at, len(ids), ids.tobytes())
        at += len(ids)


def test_no_documents_no_files(spark):
    manifest = idplanes.write(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"))
    assert manifest.count() == 0 and idplanes.read(spark, manifest).count() == 0


def brute_whiten(x, k):
    c = x - x.mean(axis=0)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return e, c @ u / np.sqrt(e)


def check_whitening(rows, ids, x, k):
    e, w = brute_whiten(x.astype(float), k)
    total, n = x.sum(axis=0).astype(object), len(x)
    deviation = {i: int((((n * v.astype(object)) - total) ** 2).sum()) for i, v in zip(ids, x)}
    place = {i: j for j, i in enumerate(ids)}
    got = np.zeros((n, k))
    for r in rows:
        assert r["n"] == n and int(r["deviation"]) == deviation[r["vec_id"]]
        got[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["eigenvalue"] == pytest.approx(e[r["component"] - 1], rel=1e-10) and r["identity_error"] < 1e-8
    signs = np.sign((got * w).sum(axis=0))
    assert np.abs(got - w * signs).max() < 1e-7 * max(1, np.abs(w).max())
    assert len(rows) == n * k


@pytest.mark.parametrize("d, shape", [(40, "flat"), (30, "steep"), (5, "few"), (1, "one")])
def test_whitening_equals_dense_eigenvectors(spark, d, shape):
    rng = np.random.default_rng(d)
    scale = np.ones(d) if shape == "flat" else 2.0 ** -np.arange(d) * 50
    v = (rng.normal(size=(400, d)) * scale) @ np.linalg.qr(rng.normal(size=(d, d)))[0]
    odd = [(1000, None), (1001, [float("nan")] * d), (1002, [float("inf")] * d), (1003, [None] * d), (1004, []), (1005, [1.0] * (d + 1))]
    rows = [(i, x.tolist(), i) for i, x in enumerate(v)] + [(i, x, 0) for i, x in odd]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int")
    x = np.floor(1024 * v).astype(np.int64) + 100_000
    check_whitening(whitening.whiten(frame).collect(), list(range(400)), x, min(d, 8))


def test_whitening_with_less_variance_than_dimensions(spark):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), 1.0]) for i in range(50)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in found} == {1} and len(found) == 50 and found[0]["explained"] == pytest.approx(1)
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(0)).count() == 0


def test_equal_eigenvalues_end(spark):
    """A spectrum of equal values has no single vectors to find, but its whitening is still the identity."""
    rows = [(2 * i + s, [8.0 * (-1) ** s if j == i else 0.0 for j in range(40)]) for i in range(40) for s in (0, 1)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 80 * 8 and found[0]["identity_error"] < 1e-8


def test_huge_values_stay_exact(spark):
    rows = [(i, [float(2.0**40 * (i % 3)), float(-i)]) for i in range(30)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    wanted = {i: sum((30 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}
    assert all(int(r["deviation"]) == wanted[r["vec_id"]] for r in found) and found


def test_registered_planes_and_whitening(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    at, wanted = 0, {}
    for (doc, _), ids in zip(docs, reference_ids([t for _, t in docs])):
        wanted[doc] = (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r["doc_id"]: tuple(r) for r in catalog.op12_id_planes(spark, SMALL).collect()} == wanted
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(1024 * np.array([r["embedding"] for r in vectors], float)).astype(np.int64) + 100_000
    found = catalog.op13_whitening(spark, SMALL)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    e, _ = brute_whiten(x.astype(float), 8)
    trace = x.astype(float).var(axis=0).sum()
    check_whitening([r.asDict() | {"eigenvalue": e[r["component"] - 1]} for r in found.collect()], [r["vec_id"] for r in vectors], x, 8)
    assert all(r["explained"] == pytest.approx(e[r["component"] - 1] / trace, rel=1e-9) for r in found.limit(20).collect())
