"""Registered queries: distributions, correlations, quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer import vocabulary as vocab
from wayfarer.functions.columns import scale
from wayfarer.operators import aggregates, bins, quality, stats
from wayfarer.plans import olap
from wayfarer.plans.binding import oracle, star, table, view

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
RATED = ["Seat_Comfort", "Food_Quality", "Cleanliness", "Overall_Satisfaction"]
RANGES = {"Age": (0, 120), "Seat_Comfort": (0, 5), "Food_Quality": (0, 5)}
DOMAINS = {"Complaint_Type": ["Delay"], "Preferred_Airline": ["no", "YES"]}


def histogram(spark, sf_dir):
    out = bins.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 20)
    return out.select("bin", F.round("left", 4).alias("left"), F.round("right", 4).alias("right"), "count")


def kde_curve(spark, sf_dir):
    out = stats.kde_curve(view(spark, sf_dir, "raw"), "Age", 50)
    return out.select("point", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


def box_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("value", F.pow(F.col("value"), 2))
    out = stats.box_stats(rows, "value", "event_type")
    return out.select("event_type", *[F.round(c, 8).alias(c) for c in ("q1", "median", "q3", "low", "high")], "outliers")


def _scored(spark, sf_dir):
    rows = view(spark, sf_dir, "service")
    columns = {c: scale(c, vocab.SCALES["rating_encoded"]) for c in RATED[:3]}
    columns["Overall_Satisfaction"] = scale("Overall_Satisfaction", vocab.SCALES["satisfaction_profile"])
    return rows.withColumns(columns)


def _checked(spark, sf_dir):
    raw = view(spark, sf_dir, "raw").withColumn("Text_Delay", F.col("Seat_Comfort")).withColumn("Number_Delay", F.col("Age"))
    return raw.withColumns({c: F.col(c).try_cast("double") for c in ("Seat_Comfort", "Food_Quality")})


QUERIES = {
    "histogram": histogram,
    "kde_curve": kde_curve,
    "box_stats": box_stats,
    "corr_matrix": lambda s, d: stats.corr_matrix(table(s, d, "lineitem"), NUMBERS),
    "corr_with_target": lambda s, d: stats.corr_with_target(_scored(s, d), RATED, "Overall_Satisfaction"),
    "strong_pairs": lambda s, d: stats.strong_pairs(_scored(s, d), RATED, 0.3, 5),
    "contingency_counts": lambda s, d: aggregates.contingency(view(s, d, "raw"), "Gender", "Travel_Purpose"),
    "line_metrics": lambda s, d: olap.class_performance(star(s, d)),
    "check_nulls": lambda s, d: quality.check_nulls(view(s, d, "raw")),
    "check_types": lambda s, d: quality.check_types(_checked(s, d)),
    "check_range": lambda s, d: quality.check_range(_checked(s, d), RANGES),
    "check_domain": lambda s, d: quality.check_domain(view(s, d, "raw"), DOMAINS),
    "validate": lambda s, d: quality.validate(_checked(s, d), RANGES, DOMAINS),
}

_R = {"Poor": 1, "Fair": 2, "Good": 3, "Excellent": 4, "Unavailable": 0}
_S = {"Happy": 3, "Satisfied": 2, "Neutral": 1, "Dissatisfied": 0}


def _coded(c: str) -> str:
    values = _S if c == "Overall_Satisfaction" else _R
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" END AS {c}"


_CODED = f"(SELECT {', '.join(_coded(c) for c in RATED)} FROM service)"


def _check(check: str, column: str, test: str) -> str:
    return f"SELECT '{check}' AS \"check\", '{column}' AS \"column\", count(*) FILTER ({test}) AS violations FROM raw"


_RAW = [
    "Passenger_ID", "Age", "Gender", "Nationality", "Flight_Distance", "Seat_Comfort", "Food_Quality", "Travel_Purpose",
    "Flight_Duration", "Complaint_Type", "Preferred_Airline",
]
_NULLS = [_check("nulls", c, f"{c} IS NULL") for c in _RAW]
_NUMBER_NULLS = [
    _check("nulls", c, f"TRY_CAST({c} AS DOUBLE) IS NULL" if c in ("Seat_Comfort", "Food_Quality") else f"{c} IS NULL") for c in _RAW
] + [_check("nulls", "Text_Delay", "Seat_Comfort IS NULL"), _check("nulls", "Number_Delay", "Age IS NULL")]
_TYPES = [
    "SELECT 'type' AS \"check\", 'Text_Delay' AS \"column\", CAST(1 AS BIGINT) AS violations",
    "SELECT 'type', 'Number_Delay', CAST(0 AS BIGINT)",
]
_RANGES = [
    _check("range", c, f"TRY_CAST({c} AS DOUBLE) < {lo} OR TRY_CAST({c} AS DOUBLE) > {hi}") for c, (lo, hi) in RANGES.items()
]
_DOMAINS = [
    _check("domain", "Complaint_Type", "Complaint_Type IS NULL OR Complaint_Type <> 'Delay'"),
    _check("domain", "Preferred_Airline", "Preferred_Airline IS NULL OR Preferred_Airline NOT IN ('no', 'YES')"),
]

ORACLES = {name: oracle(sql) for name, sql in {
    "histogram":
        "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), "
        "c AS (SELECT CAST(least(19, floor((o_totalprice - lo) / ((hi - lo) / 20))) AS INT) AS bin, count(*) AS n FROM orders, e GROUP BY 1) "
        "SELECT CAST(i AS INT) AS bin, round(lo + i * ((hi - lo) / 20), 4) AS \"left\", round(lo + (i + 1) * ((hi - lo) / 20), 4) AS \"right\", "
        "coalesce(n, 0) AS count FROM e, range(20) t(i) LEFT JOIN c ON c.bin = i",
    "kde_curve":
        "WITH e AS (SELECT count(Age) AS n, min(Age) AS lo, max(Age) AS hi, stddev_samp(Age) * pow(count(Age), -0.2) AS h FROM raw), "
        "g AS (SELECT CAST(i AS INT) AS point, lo - 3 * h + (hi - lo + 6 * h) * i / 49 AS x, n, h FROM e, range(50) t(i)) "
        "SELECT point, round(any_value(x), 6) AS x, round(sum(exp(-0.5 * pow((x - Age) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density "
        "FROM g, raw WHERE Age IS NOT NULL GROUP BY point",
    "box_stats":
        "WITH v AS (SELECT event_type, pow(value, 2) AS v FROM events), q AS (SELECT event_type, quantile_cont(v, [0.25, 0.5, 0.75]) AS q FROM v GROUP BY 1), "
        "j AS (SELECT event_type, v, q, v BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1]) AS ok FROM v JOIN q USING (event_type)) "
        "SELECT event_type, round(any_value(q)[1], 8) AS q1, round(any_value(q)[2], 8) AS median, round(any_value(q)[3], 8) AS q3, "
        "round(min(v) FILTER (ok), 8) AS low, round(max(v) FILTER (ok), 8) AS high, count(*) FILTER (NOT ok) AS outliers FROM j GROUP BY 1",
    "corr_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, " + ("1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 6)") + " AS r FROM " + ("(SELECT 1)" if a == b else "lineitem")
        for a in NUMBERS for b in NUMBERS),
    "corr_with_target": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(corr({c}, Overall_Satisfaction), 6) AS r FROM {_CODED}" for c in RATED[:3]),
    "strong_pairs": "SELECT a, b, r FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM {_CODED}"
        for i, a in enumerate(RATED) for b in RATED[i + 1:]) + ") WHERE abs(r) > 0.3 ORDER BY abs(r) DESC, a, b LIMIT 5",
    "contingency_counts":
        "SELECT Gender, Travel_Purpose, count(*) AS count FROM raw WHERE Gender IS NOT NULL AND Travel_Purpose IS NOT NULL GROUP BY 1, 2",
    "line_metrics":
        "SELECT Class, round(avg(Departure_Delay), 6) AS Avg_Departure_Delay, round(avg(Arrival_Delay), 6) AS Avg_Arrival_Delay, "
        "round(100.0::DOUBLE * count(*) FILTER (Overall_Satisfaction IN ('Happy', 'Satisfied')) / count(*), 2) AS Positive_Satisfaction_Percentage FROM staging GROUP BY 1",
    "check_nulls": " UNION ALL ".join(_NULLS),
    "check_types": " UNION ALL ".join(_TYPES),
    "check_range": " UNION ALL ".join(_RANGES),
    "check_domain": " UNION ALL ".join(_DOMAINS),
    "validate": " UNION ALL ".join(_NUMBER_NULLS + _TYPES + _RANGES + _DOMAINS),
}.items()}
