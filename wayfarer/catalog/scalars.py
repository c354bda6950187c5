"""Registered queries: scalar functions and derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer import vocabulary as vocab
from wayfarer.functions import columns as fn
from wayfarer.operators import aggregates, bins, clean
from wayfarer.plans.binding import oracle, star, table, view

_R = vocab.SCALES["rating_prepared"]


def hhmm_to_minutes(spark, sf_dir):
    return view(spark, sf_dir, "raw").select(
        "Passenger_ID",
        fn.hhmm_to_minutes("Flight_Duration").alias("or_null"),
        fn.hhmm_to_minutes("Flight_Duration", "zero").alias("or_zero"),
        fn.hhmm_to_minutes("Flight_Duration", "number").alias("or_number"),
    )


def sum_cols(spark, sf_dir):
    return view(spark, sf_dir, "fact").select(
        "Service_Key", "Leg", "Flight_Key", "Airline_Key", fn.row_sum("Departure_Delay", "Arrival_Delay").alias("Total_Delay")
    )


def row_mean(spark, sf_dir):
    rows = clean.coerce_numeric(view(spark, sf_dir, "raw"), ["Seat_Comfort", "Food_Quality"])
    return rows.select("Passenger_ID", F.round(fn.row_mean("Seat_Comfort", "Food_Quality"), 6).alias("Service_Score"))


def bin_fixed(spark, sf_dir):
    raw = view(spark, sf_dir, "raw")
    edges, labels = vocab.AGE_BINS
    return raw.select(
        "Passenger_ID", fn.bin_fixed("Age", edges, labels).alias("Age_Group"),
        fn.bin_ordinal("Age", edges).alias("Age_Group_ord"),
        fn.bin_fixed(fn.hhmm_to_minutes("Flight_Duration"), *vocab.FLIGHT_TIME_BINS).alias("Flight_Time_Cat"),
        fn.bin_fixed("Flight_Distance", *vocab.DELAY_BINS).alias("Distance_Cat"),
    )


def bin_quantile(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return bins.bin_quantile(rows, "o_totalprice", vocab.SERVICE_TERTILES, "Service_Class")


def bin_case(spark, sf_dir):
    return view(spark, sf_dir, "passenger").select(
        "Passenger_Key", fn.bin_case("Age", *vocab.AGE_CASE_SERVICE).alias("Service_Group"),
        fn.bin_case("Age", *vocab.AGE_CASE_SEGMENT).alias("Segment_Group"),
    )


def bin_equal_width(spark, sf_dir):
    out = bins.bin_equal_width_counts(view(spark, sf_dir, "raw"), "Age", 5)
    return out.select("bin", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"), "count")


def duration_category(spark, sf_dir):
    hours = fn.hhmm_to_minutes("Flight_Duration") / 60
    return view(spark, sf_dir, "flight").select(
        "Flight_Key", fn.bin_left_closed(hours, *vocab.DURATION_HOURS).alias("Flight_Duration_Category")
    )


def safe_ratio(spark, sf_dir):
    minutes = fn.hhmm_to_minutes("Flight_Duration", "zero")
    return view(spark, sf_dir, "raw").select(
        "Passenger_ID", F.round(fn.safe_ratio(minutes, "Flight_Distance"), 6).alias("Flight_Efficiency")
    )


def member_flag(spark, sf_dir):
    return view(spark, sf_dir, "airline").select(
        "Airline_Key",
        F.when(F.col("Airline_Name").isin(*vocab.BUDGET_AIRLINES), "Budget").otherwise("Full-Service").alias("Airline_Category"),
    )


def weighted_score(spark, sf_dir):
    rows = star(spark, sf_dir).flat(["Service_Key", "Leg", "Class", "Loyalty_Membership", "Frequent_Flyer"])
    coded = rows.select(
        "Service_Key", "Leg", fn.scale("Class", vocab.SCALES["class_value"]).alias("c"),
        fn.scale("Loyalty_Membership", vocab.SCALES["loyalty_rank"]).alias("l"),
        fn.scale("Frequent_Flyer", vocab.SCALES["yes_no_prepared"]).alias("f"),
    )
    score = fn.weighted_score({"c": 2, "l": 1, "f": 2})
    return coded.select(
        "Service_Key", "Leg", score.alias("Customer_Value_Score"),
        fn.bin_fixed(score, *vocab.CUSTOMER_VALUE_BINS).alias("Customer_Value"),
    )


def clipped_index(spark, sf_dir):
    coded = view(spark, sf_dir, "service").select(
        "Service_Key", fn.scale("Overall_Satisfaction", vocab.SCALES["satisfaction_prepared"]).alias("s"),
        fn.scale("Recommendation", vocab.SCALES["recommendation_prepared"]).alias("r"),
        fn.scale("Complaint_Submitted", vocab.SCALES["yes_no_prepared"]).alias("c"),
    )
    score = fn.weighted_score({"s": 2.5, "r": 5, "c": -2})
    return coded.select("Service_Key", F.round(fn.clipped_index(score, 15, 10), 6).alias("Satisfaction_Index"))


def strip_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.title_case("text").alias("title"))


def rare_to_other(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("Departure_City"),
        F.col("l_suppkey").cast("string").alias("Arrival_City"),
    )
    return clean.rare_to_other(rows, ["Departure_City", "Arrival_City"], 35, vocab.RARE_LABEL)


def round_n(spark, sf_dir):
    price = F.col("l_extendedprice").cast("decimal(18,3)")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.round(price, 1).cast("double").alias("half_up"),
        F.bround(price, 1).cast("double").alias("half_even"),
    )


def one_hot(spark, sf_dir):
    rows = view(spark, sf_dir, "fact").select("Service_Key", "Leg", "Payment_Method", "Booking_Channel")
    return clean.one_hot(rows, {"Payment_Method": "Payment", "Booking_Channel": "Booking_Channel"})


QUERIES = {
    "hhmm_to_minutes": hhmm_to_minutes,
    "sum_cols": sum_cols,
    "row_mean": row_mean,
    "bin_fixed": bin_fixed,
    "bin_quantile": bin_quantile,
    "bin_case": bin_case,
    "bin_equal_width": bin_equal_width,
    "duration_category": duration_category,
    "safe_ratio": safe_ratio,
    "member_flag": member_flag,
    "weighted_score": weighted_score,
    "clipped_index": clipped_index,
    "strip_title": strip_title,
    "strip_char": lambda s, d: view(s, d, "airline").select("Airline_Key", fn.strip_char("Airline_Loyalty_Program").alias("program")),
    "lower_replace": lambda s, d: view(s, d, "service").select(
        "Service_Key", fn.snake(F.lower("WiFi_Service")).alias("snake"), fn.unsnake(F.lit("Seat_Comfort")).alias("shown")),
    "rare_to_other": rare_to_other,
    "round_n": round_n,
    "label_encode": lambda s, d: clean.label_encode(view(s, d, "service").select("Service_Key", "Overall_Satisfaction"), "Overall_Satisfaction"),
    "one_hot": one_hot,
    "bool_flag_mean": lambda s, d: aggregates.flag_mean(view(s, d, "fact"), "Festival_Season_Travel"),
}


def _cut(value: str, edges, labels) -> str:
    arms = []
    for low, high, label in zip(edges, edges[1:], labels):
        tests = [f"{value} IS NOT NULL"]
        if low != -vocab.INF:
            tests.append(f"{value} > {low}")
        if high != vocab.INF:
            tests.append(f"{value} <= {high}")
        shown = f"'{label}'" if isinstance(label, str) else str(label)
        arms.append(f"WHEN {' AND '.join(tests)} THEN {shown}")
    return f"CASE {' '.join(arms)} END"


_MINUTES = (
    "CAST(TRY_CAST(split_part(Flight_Duration, ':', 1) AS INT) * 60 + TRY_CAST(split_part(Flight_Duration, ':', 2) AS INT) AS DOUBLE)"
)


def _hhmm(rest: str) -> str:
    return f"CASE WHEN contains(Flight_Duration, ':') THEN {_MINUTES} ELSE {rest} END"


_SCORE = "2.0::DOUBLE * c + l + 2 * f"

ORACLES = {name: oracle(sql) for name, sql in {
    "hhmm_to_minutes":
        f"SELECT Passenger_ID, {_hhmm('NULL')} AS or_null, {_hhmm('0')} AS or_zero, "
        f"{_hhmm('TRY_CAST(Flight_Duration AS DOUBLE)')} AS or_number FROM raw",
    "sum_cols":
        "SELECT Service_Key, Leg, Flight_Key, Airline_Key, Departure_Delay + Arrival_Delay AS Total_Delay FROM fact",
    "row_mean":
        "SELECT Passenger_ID, round(list_avg([x for x in [TRY_CAST(Seat_Comfort AS DOUBLE), TRY_CAST(Food_Quality AS DOUBLE)] if x is not null]), 6) "
        "AS Service_Score FROM raw",
    "bin_fixed":
        f"SELECT Passenger_ID, {_cut('Age', *vocab.AGE_BINS)} AS Age_Group, {_cut('Age', vocab.AGE_BINS[0], range(5))} AS Age_Group_ord, "
        f"{_cut('m', *vocab.FLIGHT_TIME_BINS)} AS Flight_Time_Cat, {_cut('Flight_Distance', *vocab.DELAY_BINS)} AS Distance_Cat "
        f"FROM (SELECT *, {_hhmm('NULL')} AS m FROM raw)",
    "bin_quantile":
        "SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice <= q[1] THEN 'Basic' WHEN o_totalprice <= q[2] THEN 'Standard' ELSE 'Premium' END AS Service_Class "
        "FROM orders, (SELECT quantile_cont(o_totalprice, [1.0/3, 2.0/3]) AS q FROM orders)",
    "bin_case":
        "SELECT Passenger_Key, CASE WHEN Age < 18 THEN 'Under 18' WHEN Age <= 25 THEN '18-25' WHEN Age <= 40 THEN '26-40' WHEN Age <= 60 THEN '41-60' ELSE '60+' END AS Service_Group, "
        "CASE WHEN Age < 25 THEN 'Under 25' WHEN Age <= 40 THEN '25-40' WHEN Age <= 60 THEN '41-60' ELSE '60+' END AS Segment_Group FROM passenger",
    "bin_equal_width":
        "WITH e AS (SELECT min(Age) AS lo, max(Age) AS hi FROM raw), "
        "b AS (SELECT CAST(i AS INT) AS bin, lo + i * (hi - lo) / 5 AS l, lo + (i + 1) * (hi - lo) / 5 AS r, lo, hi FROM e, range(5) t(i)) "
        "SELECT bin, round(CASE WHEN bin = 0 THEN lo - 0.001 * (hi - lo) ELSE l END, 6) AS \"left\", round(r, 6) AS \"right\", "
        "(SELECT count(*) FROM raw WHERE (Age > l OR bin = 0) AND Age <= r) AS count FROM b",
    "duration_category":
        f"SELECT Flight_Key, CASE WHEN m < 60 THEN 'Short' WHEN m < 120 THEN 'Medium' ELSE 'Long' END AS Flight_Duration_Category "
        f"FROM (SELECT *, {_hhmm('NULL')} AS m FROM flight)",
    "safe_ratio":
        f"SELECT Passenger_ID, round(CASE WHEN Flight_Distance > 0 THEN m / Flight_Distance ELSE 0 END, 6) AS Flight_Efficiency "
        f"FROM (SELECT *, {_hhmm('0')} AS m FROM raw)",
    "member_flag":
        "SELECT Airline_Key, CASE WHEN Airline_Name IN ('SpiceJet', 'IndiGo', 'TruJet') THEN 'Budget' ELSE 'Full-Service' END AS Airline_Category FROM airline",
    "weighted_score":
        f"SELECT Service_Key, Leg, {_SCORE} AS Customer_Value_Score, {_cut('(' + _SCORE + ')', *vocab.CUSTOMER_VALUE_BINS)} AS Customer_Value FROM ("
        "SELECT Service_Key, Leg, CASE Class WHEN 'Business' THEN 2 WHEN 'First Class' THEN 3 ELSE 1 END AS c, "
        "CASE Loyalty_Membership WHEN 'Bronze' THEN 1 WHEN 'Silver' THEN 2 WHEN 'Gold' THEN 3 WHEN 'Platinum' THEN 4 ELSE 0 END AS l, "
        "CASE Frequent_Flyer WHEN 'Yes' THEN 1 ELSE 0 END AS f FROM staging)",
    "clipped_index":
        "SELECT Service_Key, round(greatest(0, least(15, 2.5::DOUBLE * s + 5 * r - 2 * c)) * 10 / 15, 6) AS Satisfaction_Index FROM ("
        "SELECT Service_Key, CASE Overall_Satisfaction WHEN 'Happy' THEN 4 WHEN 'Satisfied' THEN 3 WHEN 'Neutral' THEN 2 WHEN 'Dissatisfied' THEN 1 ELSE 0 END AS s, "
        "CASE Recommendation WHEN 'Yes' THEN 1.0::DOUBLE WHEN 'Maybe' THEN 0.5 ELSE 0 END AS r, CASE Complaint_Submitted WHEN 'Yes' THEN 1 ELSE 0 END AS c FROM service)",
    "strip_title":
        r"SELECT doc_id, array_to_string([CASE WHEN x[1] = 'ß' THEN 'Ss' ELSE upper(x[1]) END || x[2:] for x in regexp_extract_all(lower(trim(text, ' ' || chr(9) || chr(13) || chr(10) || chr(12))), '\p{L}+|[^\p{L}]+')], '') AS title FROM documents",
    "strip_char": "SELECT Airline_Key, replace(Airline_Loyalty_Program, chr(13), '') AS program FROM airline",
    "lower_replace": "SELECT Service_Key, replace(lower(WiFi_Service), ' ', '_') AS snake, 'Seat Comfort' AS shown FROM service",
    "rare_to_other":
        "WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS a, CAST(l_suppkey AS VARCHAR) AS b FROM lineitem), "
        "keep AS (SELECT v FROM (SELECT a AS v FROM t UNION ALL SELECT b FROM t) GROUP BY v HAVING count(*) >= 35) "
        "SELECT l_orderkey, l_linenumber, CASE WHEN a IN (SELECT v FROM keep) THEN a ELSE 'Rare_City' END AS Departure_City, "
        "CASE WHEN b IN (SELECT v FROM keep) THEN b ELSE 'Rare_City' END AS Arrival_City FROM t",
    "round_n":
        "SELECT l_orderkey, l_partkey, l_suppkey, CAST(round(CAST(l_extendedprice AS DECIMAL(18, 3)), 1) AS DOUBLE) AS half_up, "
        "CAST(round_even(CAST(l_extendedprice AS DECIMAL(18, 3)), 1) AS DOUBLE) AS half_even FROM lineitem",
    "label_encode":
        "SELECT Service_Key, CAST(dense_rank() OVER (ORDER BY Overall_Satisfaction) - 1 AS INT) AS Overall_Satisfaction FROM service",
    "one_hot":
        "SELECT Service_Key, Leg, Payment_Method, Booking_Channel, " + ", ".join(
            f"CAST({c} = '{v}' AS INT) AS \"{p}_{v}\"" for c, p, vs in (
                ("Payment_Method", "Payment", ["Card", "Cash", "UPI"]),
                ("Booking_Channel", "Booking_Channel", ["Mobile App", "Travel Agent", "Website"])) for v in vs)
        + " FROM fact",
    "bool_flag_mean": "SELECT round(100.0::DOUBLE * count(*) FILTER (Festival_Season_Travel = 'Yes') / count(*), 6) AS rate FROM fact",
}.items()}
