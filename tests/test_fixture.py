"""Hand-computed answers on a small passenger table with every edge in it."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from wayfarer import vocabulary as vocab
from wayfarer.functions import columns as fn
from wayfarer.operators import aggregates, bins, clean, ordering, profile, quality, quantiles, rules, text
from wayfarer.sources import readers, writers

ROWS = [
    # id, age, gender, nationality, duration, rating, airline, program
    (1, -1.0, "Male", "Ind", "01:00", "Poor", "SpiceJet", "Star\r"),
    (2, 0.0, "X", "Indien", "2:05", "Fair", "IndiGo", "Star"),
    (3, 18.0, "Unknown", "Indian", "25:61", "Good", "Air India", "N/A"),
    (4, 25.0, "Female", "German", "90", "Excellent", "TruJet", None),
    (5, 100.0, "Female", "German", "bad", "excellent", "SpiceJet", "Sky"),
    (6, 101.0, "Male", None, None, None, None, "Sky"),
    (7, 130.0, None, "French", "00:59", "Unavailable", "Vistara", "Sky"),
    (8, None, "Male", "French", "a:b", "No Connection", "Vistara", "Sky"),
]
SCHEMA = "id bigint, age double, gender string, nationality string, duration string, rating string, airline string, program string"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def column(df, c):
    return [r[0] for r in df.orderBy("id").select(c).collect()]


def test_age_bins_are_right_closed(people):
    got = column(people, fn.bin_fixed("age", *vocab.AGE_BINS))
    assert got == [None, None, "<18", "18-25", "60+", None, None, None]


def test_age_case_sends_null_to_the_rest(people):
    got = column(people, fn.bin_case("age", *vocab.AGE_CASE_SERVICE))
    assert got == ["Under 18", "Under 18", "18-25", "18-25", "60+", "60+", "60+", "60+"]


def test_delay_bins(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([-3.0, 0.0, 15.0, 45.0, 46.0])], "id int, d double")
    assert column(df, fn.bin_fixed("d", *vocab.DELAY_BINS)) == ["On-time"] * 3 + ["Minor Delay", "Significant Delay"]


@pytest.mark.parametrize("fallback, want", [
    ("null", [60, 125, 1561, None, None, None, 59, None]),
    ("zero", [60, 125, 1561, 0, 0, 0, 59, None]),
    ("number", [60, 125, 1561, 90, None, None, 59, None]),
])
def test_durations(people, fallback, want):
    assert column(people, fn.hhmm_to_minutes("duration", fallback)) == want


def test_duration_category_is_left_closed(people):
    got = column(people, fn.bin_left_closed(fn.hhmm_to_minutes("duration") / 60, *vocab.DURATION_HOURS))
    assert got == ["Medium", "Long", "Long", None, None, None, "Short", None]


def test_scales(people):
    take = lambda name: column(people, fn.scale("rating", vocab.SCALES[name]))
    assert take("rating_encoded") == [1, 2, 3, 4, None, None, 0, 0]
    assert take("rating_prepared") == [1, 2, 3, 4, 4, 0, 0, 0]
    assert take("rating_clustering") == [1, 2, 3, 4, 0, 0, 0, 0]
    assert take("rating_composite") == [1, 2, 3, 4, 2, 2, 2, 2]
    assert take("rating_profile") == [1, None, 2, 3, None, None, None, None]


def test_title_case(spark):
    df = spark.createDataFrame([(1, "  new-delhi o'hare "), (2, "ßtadt"), (3, None)], "id int, c string")
    assert column(df, fn.title_case("c")) == ["New-Delhi O'Hare", "Sstadt", None]


def test_cleaning(people):
    fixed = clean.replace_values(people, {"gender": vocab.SPELLINGS["Gender"], "nationality": vocab.SPELLINGS["Nationality"]})
    assert column(fixed, "gender")[1:3] == ["Other", "Other"]
    assert column(fixed, "nationality")[:3] == ["Indian"] * 3
    ranged = clean.null_if_out_of_range(people, {"age": (0, 120)})
    assert column(ranged, "age") == [None, 0, 18, 25, 100, 101, None, None]
    assert clean.out_of_range(people, "age", 0, 120).count() == 2


def test_imputation(people):
    assert column(clean.impute_median(people, ["age"]), "age")[-1] == 25
    assert column(clean.impute_mode(people, ["gender"]), "gender")[6] == "Male"
    # a tie goes to the smallest value
    assert column(clean.impute_mode(people, ["nationality"]), "nationality")[5] == "French"
    assert column(clean.impute_mean(people, ["age"]), "age")[-1] == pytest.approx(373 / 7)


def test_member_and_index(spark):
    df = spark.createDataFrame([(1, 4.0, 1.0, 0.0), (2, 0.0, 0.0, 1.0), (3, None, 1.0, 0.0)], "id int, s double, r double, c double")
    score = fn.weighted_score({"s": 2.5, "r": 5, "c": -2})
    assert column(df, fn.clipped_index(score, 15, 10)) == [10, 0, None]


def test_row_mean_skips_nulls(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 1.0, 2.0)], "id int, a double, b double")
    assert column(df, fn.row_mean("a", "b")) == [1, None, 1.5]


def test_equal_quantile_edges_raise(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(9)], "id int, v double")
    with pytest.raises(Exception, match="equal quantile edges"):
        bins.bin_quantile(df, "v", vocab.SERVICE_TERTILES, "c").collect()


def test_too_many_values_raise(people):
    with pytest.raises(clean.TooManyValues):
        clean.bounded_values(people, "id", 3)


def test_null_keys_are_dropped(people):
    assert {r[0] for r in aggregates.value_counts(people, "gender").collect()} == {"Male", "Female", "X", "Unknown"}
    assert profile.null_profile(people, ["gender", "age", "id"]).collect()[-1]["nulls"] == 0


def test_checks(people):
    got = {(r["check"], r["column"]): r["violations"] for r in quality.validate(
        people.withColumn("Delay_text", F.lit("x")), {"age": (0, 120)}, {"gender": ["Male", "Female"]}).collect()}
    assert got[("range", "age")] == 2
    assert got[("domain", "gender")] == 3  # two odd spellings and a null
    assert got[("type", "Delay_text")] == 1
    assert got[("nulls", "age")] == 1


def test_golden_rules(spark):
    baskets = spark.createDataFrame([(["a", "b", "c"],), (["a", "b", "c"],), (["a", "b"],), (["c"],)], "items array<string>")
    mined = rules.frequent_itemsets(baskets, 0.5)
    support = {tuple(r["items"]): r["support"] for r in mined.itemsets.collect()}
    assert support[("a", "b")] == 0.75 and support[("a", "b", "c")] == 0.5 and len(support) == 7
    found = {(tuple(r["antecedent"]), tuple(r["consequent"])): r for r in rules.association_rules(mined).collect()}
    assert found[("a",), ("b",)]["confidence"] == 1.0
    assert found[("a",), ("b",)]["lift"] == pytest.approx(4 / 3)
    assert math.isinf(found[("a",), ("b",)]["conviction"])
    assert found[("a",), ("c",)]["lift"] == pytest.approx(8 / 9)
    assert found[("c",), ("a", "b")]["confidence"] == pytest.approx(2 / 3)


def test_mining_equals_brute_force(spark):
    import itertools
    import random

    rng = random.Random(3)
    # a third of all rows are copies of one basket
    data = [sorted(rng.sample("abcdefgh", rng.randint(0, 6))) for _ in range(80)] + [list("abcde")] * 40
    mined = rules.frequent_itemsets(spark.createDataFrame([(d,) for d in data], "items array<string>"), 0.1)
    got = {tuple(r["items"]): r["n"] for r in mined.itemsets.collect()}
    want = {}
    for k in range(1, 9):
        for c in itertools.combinations("abcdefgh", k):
            n = sum(set(c) <= set(d) for d in data)
            if n / len(data) >= 0.1:
                want[c] = n
    assert got == want


def test_fallback_lowers_the_bar(spark):
    baskets = spark.createDataFrame([(["a"],), (["b"],), (["a", "b"],), (["c"],)], "items array<string>")
    mined, found = rules.mine_with_fallback(baskets, (0.9, 0.25), (0.9, 0.5))
    assert mined.itemsets.count() == 4 and found.count() == 2


def test_tfidf_rows_have_length_one(spark):
    df = spark.createDataFrame([(1, "Delay delay food"), (2, "food x été"), (3, None)], "id int, t string")
    out = text.tfidf_terms(df, "id", "t").collect()
    assert {r["term"] for r in out} == {"delay", "food", "été"}
    for key in (1, 2):
        assert sum(r["weight"] ** 2 for r in out if r["id"] == key) == pytest.approx(1)
    assert text.vocabulary_size(df, "t", 2).first()[0] == 2


@pytest.mark.parametrize("copies", [0, 400])
def test_quantiles_equal_numpy(spark, copies):
    import numpy as np

    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(0, 3, 500), np.full(copies, 7.5)])
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)], "g int, v double")
    probs = [0, 0.1, 0.25, 0.5, 0.9, 1]
    got = quantiles.quantiles(df, "v", probs).first()
    assert list(got) == pytest.approx(list(np.quantile(values, probs)))
    for row in quantiles.quantiles(df, "v", probs, ["g"]).collect():
        part = values[row["g"]::2]
        assert list(row)[1:] == pytest.approx(list(np.quantile(part, probs)))


def test_running_sum_with_a_hot_group(spark):
    df = spark.createDataFrame([("hot", float(i), i % 3) for i in range(600)] + [("b", float(i), 1) for i in range(9)], "g string, k double, w int")
    got = ordering.running_sum(df, "k", ["w"], ["g"], buckets=64).where("g = 'hot'").orderBy("k").collect()
    total = 0
    for row in got:
        total += row["w"]
        assert row["w_cum"] == total and row["w_total"] == 600
    ranks = ordering.shuffled_rank(df, ["g", "k"], ["g"]).where("g = 'hot'").select("rank").collect()
    assert sorted(r[0] for r in ranks) == list(range(1, 601))


def test_position_needs_no_global_sort(spark):
    df = spark.range(1000).select((F.col("id") * 3 - 7).alias("k"))
    assert [r["position"] for r in ordering.position(df, "k").orderBy("k").collect()] == list(range(1000))


def test_csv_round_trip(spark, people, tmp_path):
    path = writers.write_csv_result(people.drop("program"), str(tmp_path), "1. Delay Analysis")
    assert path.endswith("1._delay_analysis.csv")
    assert readers.read_csv_table(spark, path, people.drop("program").schema).count() == len(ROWS)
    assert dict(readers.read_csv_table(spark, path).dtypes)["age"] == "double"


def test_rules_are_written_both_ways(spark, tmp_path):
    found = spark.createDataFrame([(["a", "b"], ["c"], 0.5)], "antecedent array<string>, consequent array<string>, lift double")
    writers.write_rules(found, str(tmp_path / "r.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r.csv")).first()["antecedent"] == "a, b"
    writers.write_rules(found, str(tmp_path / "r.parquet"), "parquet")
    assert spark.read.parquet(str(tmp_path / "r.parquet")).first()["antecedent"] == ["a", "b"]


def test_jdbc_options(monkeypatch):
    monkeypatch.setenv("WAREHOUSE_PASSWORD", "from-environment")
    options = readers.jdbc_options("jdbc:x", table="Fact", user="u", partition_column="Passenger_Key", lower=0, upper=100, partitions=4)
    assert options["numPartitions"] == "4" and options["password"] == "from-environment" and options["dbtable"] == "Fact"
    assert readers.jdbc_options("jdbc:x", query="SELECT 1")["query"] == "SELECT 1"
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x")


def test_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert writers.to_json_records(df).first()[0] == '{"a":1,"b":null}'
