"""Registered queries: joins, aggregations, windows, sorts and reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer import vocabulary as vocab
from wayfarer.functions.columns import scale
from wayfarer.operators import aggregates as agg
from wayfarer.operators import clean, ordering, profile, reshape
from wayfarer.plans import olap
from wayfarer.plans.binding import oracle, star, table, view

SATISFACTION = ["Dissatisfied", "Happy", "Neutral", "Satisfied"]
RATED = ["Seat_Comfort", "Food_Quality", "Cleanliness"]


RAW_NUMBERS = ["Passenger_ID", "Age", "Flight_Distance"]
RAW_TEXTS = ["Gender", "Nationality", "Seat_Comfort", "Food_Quality", "Travel_Purpose", "Flight_Duration", "Complaint_Type", "Preferred_Airline"]
LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_COLUMNS = [*LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]


def _lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def _raw(spark, sf_dir):
    return view(spark, sf_dir, "raw")


def _rated(spark, sf_dir):
    rows = view(spark, sf_dir, "service")
    return rows.withColumns({c: scale(c, vocab.SCALES["rating_prepared"]) for c in RATED})


def star_join(spark, sf_dir):
    return star(spark, sf_dir).flat(
        ["Service_Key", "Leg", "Airline_Name", "Class", "Overall_Satisfaction", "Travel_Purpose"]
    )


def key_rename_join(spark, sf_dir):
    """Inner join on keys with different names."""
    service = view(spark, sf_dir, "service").select("Service_Key", "Passenger_Key")
    staged = view(spark, sf_dir, "passenger").select(F.col("Passenger_Key").alias("Passenger_ID"), "Gender")
    return service.join(staged, service["Passenger_Key"] == staged["Passenger_ID"]).select("Service_Key", "Gender")


def scalar_subquery(spark, sf_dir):
    counts = view(spark, sf_dir, "fact").groupBy("Payment_Method").agg(F.count(F.lit(1)).alias("n"))
    return olap.share_of_total(counts, "n", "share", 4)


def column_concat(spark, sf_dir):
    """Derived columns beside the row they come from; no join is needed."""
    rows = clean.one_hot(view(spark, sf_dir, "passenger").select("Passenger_Key", "Seat_Type"), {"Seat_Type": "Seat"})
    return clean.keep_original(rows, ["Seat_Type"])


def group_agg(spark, sf_dir):
    return agg.group_agg(
        _lineitem(spark, sf_dir), ["l_returnflag", "l_linestatus"], avg_qty=F.round(F.avg("l_quantity"), 6),
        sum_qty=F.sum("l_quantity"), n=F.count(F.lit(1)), avg_price=F.round(F.avg("l_extendedprice"), 4),
    )


def conditional_agg(spark, sf_dir):
    return agg.conditional_counts(
        view(spark, sf_dir, "fact"), ["Booking_Channel"],
        {"late": F.col("Departure_Delay") > 15, "lost": F.col("Baggage_Lost") == "Yes"},
    )


def ordinal_avg(spark, sf_dir):
    rows = view(spark, sf_dir, "service")
    return rows.groupBy("Complaint_Submitted").agg(*[
        F.round(F.avg(scale(c, vocab.SCALES["rating_olap"])), 6).alias(c) for c in RATED
    ])


def rollup(spark, sf_dir):
    return agg.rollup(
        _lineitem(spark, sf_dir), ["l_returnflag", "l_linestatus"], avg_qty=F.round(F.avg("l_quantity"), 6), n=F.count(F.lit(1))
    )


def group_value_shares(spark, sf_dir):
    shares = agg.group_value_shares(view(spark, sf_dir, "service"), "Complaint_Submitted", "Overall_Satisfaction")
    return agg.unstack(shares, "Complaint_Submitted", "Overall_Satisfaction", "share", SATISFACTION)


def share_in_partition(spark, sf_dir):
    counts = view(spark, sf_dir, "fact").groupBy("Payment_Method", "Booking_Channel").agg(F.count(F.lit(1)).alias("n"))
    return olap.with_share(counts, "n", ["Payment_Method"], "share", 4)


def kpi_row(spark, sf_dir):
    delay = F.col("Departure_Delay")
    return agg.kpi_row(
        view(spark, sf_dir, "fact"), flights=F.count(F.lit(1)), avg_departure=F.round(F.avg(delay), 6),
        avg_arrival=F.round(F.avg("Arrival_Delay"), 6), worst=F.max(delay),
        on_time=F.round(F.avg(F.when(delay <= 0, 1.0).otherwise(0.0)) * 100, 6),
        baggage=F.round(F.avg(F.when(F.col("Baggage_Lost") == "Yes", 1.0).otherwise(0.0)) * 100, 6),
    )


def describe_all(spark, sf_dir):
    """Every column of the table."""
    return profile.describe_all(_raw(spark, sf_dir), RAW_NUMBERS, RAW_TEXTS)


def schema_profile(spark, sf_dir):
    return profile.schema_profile(table(spark, sf_dir, "orders"))


def time_order_index(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return ordering.position(rows, "event_id")


QUERIES = {
    "star_join": star_join,
    "key_rename_join": key_rename_join,
    "scalar_subquery": scalar_subquery,
    "column_concat": column_concat,
    "group_agg": group_agg,
    "conditional_agg": conditional_agg,
    "ordinal_avg": ordinal_avg,
    "rollup": rollup,
    "rollup_leaves": lambda s, d: olap.rollup_leaves(star(s, d)),
    "pivot_mean": lambda s, d: agg.pivot_mean(_raw(s, d), "Gender", "Travel_Purpose", "Age", ["BUILDING", "FURNITURE", "MACHINERY"]),
    "crosstab_row_pct": lambda s, d: agg.crosstab_row_pct(view(s, d, "service"), "Seat_Comfort", "Overall_Satisfaction", SATISFACTION),
    "value_counts": lambda s, d: agg.value_counts(_raw(s, d), "Nationality"),
    "value_shares": lambda s, d: agg.value_shares(_raw(s, d), "Gender"),
    "group_value_shares": group_value_shares,
    "describe_numeric": lambda s, d: profile.describe_numeric(
        _lineitem(s, d), LINE_NUMBERS, 4),
    "describe_all": describe_all,
    "null_profile": lambda s, d: profile.null_profile(_raw(s, d)),
    "null_pattern": lambda s, d: profile.null_pattern(_raw(s, d), [*RAW_NUMBERS, *RAW_TEXTS]),
    "distinct_profile": lambda s, d: profile.distinct_profile(_lineitem(s, d), LINE_COLUMNS),
    "schema_profile": schema_profile,
    "scalar_stats": lambda s, d: agg.scalar_stats(_raw(s, d), "Age"),
    "group_mean_multi": lambda s, d: agg.group_means(_raw(s, d), "Travel_Purpose", ["Age", "Flight_Distance"]),
    "group_rate": lambda s, d: agg.group_rate(view(s, d, "fact"), "Booking_Channel", "Discount_Received"),
    "group_mode": lambda s, d: agg.group_mode(_raw(s, d), "Nationality", ["Gender", "Travel_Purpose"]),
    "distinct_groups": lambda s, d: agg.distinct_groups(_raw(s, d), "Nationality", "Travel_Purpose"),
    "col_means_rank": lambda s, d: agg.column_means_ranked(_rated(s, d), RATED),
    "arg_extreme": lambda s, d: agg.arg_extremes(table(s, d, "orders"), "o_orderpriority", "o_totalprice"),
    "kpi_row": kpi_row,
    "difference_of_means": lambda s, d: agg.difference_of_means(
        view(s, d, "fact"), "Festival_Season_Travel", "Yes", "No", "Departure_Delay"),
    "share_in_partition": share_in_partition,
    "time_order_index": time_order_index,
    "sort": lambda s, d: ordering.sort_rows(
        table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", F.desc("o_totalprice"), "o_orderkey"),
    "top_k": lambda s, d: ordering.top_k(
        _lineitem(s, d).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")), 10, F.desc("n"), "l_suppkey"),
    "top_k_per_group": lambda s, d: ordering.top_k_per_group(
        table(s, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), 3, ["o_orderpriority"], F.desc("o_totalprice"), "o_orderkey"),
    "head": lambda s, d: ordering.head(table(s, d, "customer"), 5, "c_custkey"),
    "concat_columns_rows": lambda s, d: reshape.stack_columns(
        view(s, d, "flight"), ["Departure_City", "Arrival_City"], "city").groupBy("city").agg(F.count(F.lit(1)).alias("n")),
    "unpivot": lambda s, d: reshape.unpivot(
        _rated(s, d).groupBy("Complaint_Submitted").agg(*[F.round(F.avg(c), 6).alias(c) for c in RATED]),
        ["Complaint_Submitted"], RATED, "Service", "Rating"),
    "unstack": lambda s, d: agg.unstack(
        view(s, d, "fact").groupBy("Payment_Method", "Booking_Channel").agg(F.count(F.lit(1)).alias("n")),
        "Payment_Method", "Booking_Channel", "n", ["Mobile App", "Travel Agent", "Website"]),
}

_VALUE = {"Poor": 1, "Fair": 2, "Good": 3, "Excellent": 4}


def _score(c: str) -> str:
    return f"(CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _VALUE.items()) + " ELSE 0 END)"


def _describe(source: str, columns: list[str], digits: int) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), {digits}) AS mean, round(stddev_samp({c}), {digits}) AS std, "
        f"CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), {digits}) AS q25, round(quantile_cont({c}, 0.5), {digits}) AS q50, "
        f"round(quantile_cont({c}, 0.75), {digits}) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM {source}" for c in columns
    )


def _top(source: str, c: str, what: str) -> str:
    return f"(SELECT {what} FROM (SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"


def _describe_all() -> str:
    numeric = f"SELECT *, CAST(NULL AS BIGINT) AS \"unique\", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq FROM ({_describe('raw', RAW_NUMBERS, 6)})"
    text = " UNION ALL ".join(
        f"SELECT '{c}', count({c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(DISTINCT {c}), {_top('raw', c, 'v')}, {_top('raw', c, 'n')} FROM raw"
        for c in RAW_TEXTS
    )
    return f"{numeric} UNION ALL {text}"


_RAW_COLUMNS = [
    "Passenger_ID", "Age", "Gender", "Nationality", "Flight_Distance", "Seat_Comfort", "Food_Quality", "Travel_Purpose",
    "Flight_Duration", "Complaint_Type", "Preferred_Airline",
]


def _group_mode(c: str) -> str:
    return (
        f"coalesce((SELECT v FROM (SELECT Nationality AS g, {c} AS v, count(*) AS n FROM raw WHERE {c} IS NOT NULL GROUP BY 1, 2) "
        f"WHERE g = Nationality_ ORDER BY n DESC, v LIMIT 1), 'Unknown') AS {c}"
    )


ORACLES = {name: oracle(sql) for name, sql in {
    "star_join": "SELECT Service_Key, Leg, Airline_Name, Class, Overall_Satisfaction, Travel_Purpose FROM staging",
    "key_rename_join":
        "SELECT Service_Key, Gender FROM service JOIN (SELECT Passenger_Key AS Passenger_ID, Gender FROM passenger) p ON service.Passenger_Key = p.Passenger_ID",
    "scalar_subquery":
        "SELECT Payment_Method, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM fact), 4) AS share FROM fact GROUP BY 1",
    "column_concat":
        "SELECT Passenger_Key, Seat_Type, Seat_Type AS Seat_Type_Original, CAST(Seat_Type = 'Aisle' AS INT) AS Seat_Aisle, "
        "CAST(Seat_Type = 'Middle' AS INT) AS Seat_Middle, CAST(Seat_Type = 'Window' AS INT) AS Seat_Window FROM passenger",
    "group_agg":
        "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS avg_qty, sum(l_quantity) AS sum_qty, count(*) AS n, "
        "round(avg(l_extendedprice), 4) AS avg_price FROM lineitem GROUP BY 1, 2",
    "conditional_agg":
        "SELECT Booking_Channel, count(*) FILTER (Departure_Delay > 15) AS late, count(*) FILTER (Baggage_Lost = 'Yes') AS lost FROM fact GROUP BY 1",
    "ordinal_avg":
        "SELECT Complaint_Submitted, " + ", ".join(f"round(avg({_score(c)}), 6) AS {c}" for c in RATED) + " FROM service GROUP BY 1",
    "rollup":
        "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n, "
        "CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "rollup_leaves":
        "SELECT Airline_Name, Class, round(avg(Departure_Delay), 6) AS Avg_Departure_Delay, round(avg(Arrival_Delay), 6) AS Avg_Arrival_Delay FROM staging GROUP BY 1, 2",
    "pivot_mean":
        "SELECT Gender, " + ", ".join(f"round(avg(Age) FILTER (Travel_Purpose = '{p}'), 6) AS \"{p}\"" for p in ("BUILDING", "FURNITURE", "MACHINERY"))
        + " FROM raw WHERE Gender IS NOT NULL AND Travel_Purpose IS NOT NULL GROUP BY 1",
    "crosstab_row_pct":
        "SELECT Seat_Comfort, " + ", ".join(f"round(100.0::DOUBLE * count(*) FILTER (Overall_Satisfaction = '{v}') / count(*), 6) AS \"{v}\"" for v in SATISFACTION)
        + " FROM service GROUP BY 1",
    "value_counts": "SELECT Nationality, count(*) AS count FROM raw WHERE Nationality IS NOT NULL GROUP BY 1",
    "value_shares":
        "SELECT Gender, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM raw WHERE Gender IS NOT NULL GROUP BY 1",
    "group_value_shares":
        "SELECT Complaint_Submitted, " + ", ".join(
            f"round(nullif(count(*) FILTER (Overall_Satisfaction = '{v}'), 0)::DOUBLE / count(*), 6) AS \"{v}\"" for v in SATISFACTION)
        + " FROM service WHERE Overall_Satisfaction IS NOT NULL GROUP BY 1",
    "describe_numeric": _describe("lineitem", LINE_NUMBERS, 4),
    "describe_all": _describe_all(),
    "null_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, round(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 6) AS percent FROM raw"
        for c in _RAW_COLUMNS),
    "null_pattern":
        "SELECT " + " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in (*RAW_NUMBERS, *RAW_TEXTS))
        + " AS pattern, count(*) AS count FROM raw GROUP BY 1",
    "distinct_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\", CASE WHEN count(DISTINCT {c}) < 10 THEN "
        f"array_to_string(list_sort(list(DISTINCT CAST({c} AS VARCHAR))), ',') END AS \"values\" FROM lineitem"
        for c in LINE_COLUMNS),
    "schema_profile":
        "SELECT * FROM (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_orderstatus', 'string'), (3, 'o_totalprice', 'double'), "
        "(4, 'o_orderdate', 'timestamp_ntz'), (5, 'o_orderpriority', 'string')) AS v(position, \"column\", type), (SELECT count(*) AS rows, 6 AS columns FROM orders)",
    "scalar_stats": "SELECT round(avg(Age), 6) AS mean, min(Age) AS min, max(Age) AS max, round(median(Age), 6) AS median FROM raw",
    "group_mean_multi":
        "SELECT Travel_Purpose, round(avg(Age), 6) AS Age, round(avg(Flight_Distance), 6) AS Flight_Distance FROM raw WHERE Travel_Purpose IS NOT NULL GROUP BY 1",
    "group_rate":
        "SELECT Booking_Channel, round(100.0::DOUBLE * count(*) FILTER (Discount_Received = 'Yes') / count(*), 6) AS rate FROM fact GROUP BY 1",
    "group_mode":
        f"SELECT Nationality_ AS Nationality, {_group_mode('Gender')}, {_group_mode('Travel_Purpose')} "
        "FROM (SELECT DISTINCT Nationality AS Nationality_ FROM raw WHERE Nationality IS NOT NULL)",
    "distinct_groups":
        "SELECT count(*) AS groups FROM (SELECT DISTINCT Nationality, Travel_Purpose FROM raw WHERE Nationality IS NOT NULL AND Travel_Purpose IS NOT NULL)",
    "col_means_rank": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({_score(c)}), 6) AS mean FROM service" for c in RATED),
    "arg_extreme":
        "WITH m AS (SELECT o_orderpriority AS k, avg(o_totalprice) AS m FROM orders GROUP BY 1) "
        "SELECT (SELECT k FROM m ORDER BY m DESC, k LIMIT 1) AS highest, (SELECT k FROM m ORDER BY m, k LIMIT 1) AS lowest",
    "kpi_row":
        "SELECT count(*) AS flights, round(avg(Departure_Delay), 6) AS avg_departure, round(avg(Arrival_Delay), 6) AS avg_arrival, max(Departure_Delay) AS worst, "
        "round(100.0::DOUBLE * count(*) FILTER (Departure_Delay <= 0) / count(*), 6) AS on_time, "
        "round(100.0::DOUBLE * count(*) FILTER (Baggage_Lost = 'Yes') / count(*), 6) AS baggage FROM fact",
    "difference_of_means":
        "SELECT round(avg(Departure_Delay) FILTER (Festival_Season_Travel = 'Yes') - avg(Departure_Delay) FILTER (Festival_Season_Travel = 'No'), 6) AS difference FROM fact",
    "share_in_partition":
        "SELECT Payment_Method, Booking_Channel, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY Payment_Method), 4) AS share FROM fact GROUP BY 1, 2",
    "time_order_index": "SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events",
    "sort": "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey",
    "top_k": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 10",
    "top_k_per_group":
        "SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3",
    "head": "SELECT * FROM customer ORDER BY c_custkey LIMIT 5",
    "concat_columns_rows":
        "SELECT city, count(*) AS n FROM (SELECT Departure_City AS city FROM flight UNION ALL SELECT Arrival_City FROM flight) GROUP BY 1",
    "unpivot": " UNION ALL ".join(
        f"SELECT Complaint_Submitted, '{c}' AS Service, round(avg({_score(c)}), 6) AS Rating FROM service GROUP BY 1" for c in RATED),
    "unstack":
        "SELECT Payment_Method, " + ", ".join(f"count(*) FILTER (Booking_Channel = '{v}') AS \"{v}\"" for v in ("Mobile App", "Travel Agent", "Website"))
        + " FROM fact GROUP BY 1",
}.items()}
